"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_top(spark: SparkSession) -> str:
    """The folder that the whole cluster can write to, as the session or its context names it.

    Only a session in local mode that names none, as in tests, gets a temporary one; on a
    cluster that would be a different disk for each machine, so there it is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", "")
    if top:
        return top
    sc = spark.sparkContext
    set_before = sc._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="vigil-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_top(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder where the whole cluster can write."""
    return f"{shared_top(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: smaller than a checkpoint where columns repeat."""
    path = shared_folder(df.sparkSession)
    df.write.option("parquet.enable.dictionary", "false").parquet(path)
    return df.sparkSession.read.parquet(path)
