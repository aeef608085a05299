"""The folds over streams: the same step functions as in batch, the states of a bucket of keys kept together.

A key's state is a dict of a few scalars; a bucket's are pickled. Rows that arrive in one micro-batch are taken in
event-time order; rows older than the watermark are late and go. A key without rows for
``ttl_s`` of event time loses its state by a timer.
"""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..config import DEFAULT, IDENTITY, Config
from ..operators import folds


def on_time(stream: DataFrame, column: str = "snapshot_ts", delay: str = "1 minute") -> DataFrame:
    """Late snapshots are dropped by the stateful operators behind this."""
    return stream.withWatermark(column, delay)


def snapshots(flows: DataFrame, interval: str = "15 seconds") -> DataFrame:
    """Flow counts of each host and snapshot interval of a stream of flows."""
    return flows.groupBy("host_id", F.window("snapshot_ts", interval).alias("w")).agg(F.count("*").alias("flows")).select(
        "host_id", F.col("w.start").alias("snapshot_ts"), "flows"
    )


def stateful(stream: DataFrame, key: list[str], order: str, step: Callable[[dict, dict], dict], added: str, ttl_s: int, buckets: int = 256) -> DataFrame:
    """stream (with a watermark on ``order``) and the columns of the step.

    Keys are dealt to buckets. A bucket is one group with one state, that of each of its keys and when it runs out, so that
    the cost of a group is not that of a key.
    """
    timed = stream.withColumns({"t": F.unix_timestamp(order), "bucket": F.pmod(F.xxhash64(*key), F.lit(buckets))})
    schema = StructType([*timed.schema.fields, *StructType.fromDDL(added).fields])
    names = [f.name for f in StructType.fromDDL(added).fields]
    reads = list(getattr(step, "reads", timed.columns))

    def keep(held: GroupState, states: dict[tuple, tuple[dict, int]]) -> None:
        """What has not run out, and a timer at the first end."""
        watermark = held.getCurrentWatermarkMs()
        states = {k: (state, end) for k, (state, end) in states.items() if end * 1000 >= watermark}
        if not states:
            held.remove()
            return
        held.update((pickle.dumps(states),))
        held.setTimeoutTimestamp(min(end for _, end in states.values()) * 1000)

    def run(_: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        states = pickle.loads(held.get[0]) if held.exists else {}
        if held.hasTimedOut:
            keep(held, states)
            return
        rows = pd.concat(list(frames)).sort_values(order, kind="stable").reset_index(drop=True)
        out = []
        for own, t, *values in zip(zip(*(rows[k].tolist() for k in key)), rows["t"].tolist(), *(rows[c].tolist() for c in reads)):
            state = states[own][0] if own in states else {}
            out.append(step(state, dict(zip(reads, values))))
            states[own] = state, t + ttl_s
        keep(held, states)
        yield pd.concat([rows, pd.DataFrame(out, columns=names)], axis=1)

    return timed.groupBy("bucket").applyInPandasWithState(run, schema, "state binary", "update", GroupStateTimeout.EventTimeTimeout).drop("t", "bucket")


def behavior_state(features: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return stateful(on_time(features), IDENTITY, "snapshot_ts", folds.ewma_step(config), folds.EWMA_COLUMNS, config.ewma_ttl_s)


def emit_state(hits: DataFrame, config: Config = DEFAULT) -> DataFrame:
    added = "emitted boolean, emit_reason string, suppress_reason string"
    return stateful(on_time(hits), IDENTITY, "snapshot_ts", folds.emit_step(config), added, config.emit_ttl_s)


def resource_state(pressures: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return stateful(on_time(pressures, "ts"), ["host_id", "instance"], "ts", folds.resource_step(config), folds.RESOURCE_COLUMNS, 86400 * 365)


def threat_state(signals: DataFrame) -> DataFrame:
    added = "intel_ewma double, intel_combined double"
    return stateful(on_time(signals), ["host_id", "instance"], "snapshot_ts", folds.intel_step, added, 86400)


def contact_state(routed: DataFrame, config: Config = DEFAULT, buckets: int = 64) -> DataFrame:
    """routed pairs and whether each is a new contact; a pair's state goes once an interval has passed without it.

    The pairs of a list and machine are dealt to buckets by their digest. A bucket is one group with one state, the last time of
    each of its pairs, so that the cost of a group is not that of a pair.
    """
    key, ttl = ["host_id", "list", "instance", "bucket"], int(2 * config.interval_s)
    digest = F.unhex(F.sha2(F.to_json("pair"), 256))
    keyed = on_time(routed.withColumn("pair_id", digest).drop("pair")).withColumns({"bucket": F.pmod(F.xxhash64("pair_id"), F.lit(buckets)), "t": F.unix_timestamp("snapshot_ts")})
    schema = StructType([*keyed.schema.fields, *StructType.fromDDL("is_new boolean").fields])

    def run(_: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(frames)).sort_values("t", kind="stable").reset_index(drop=True)
        seen = pickle.loads(held.get[0]) if held.exists else {}
        last = rows.groupby("pair_id", sort=False)["t"].shift()
        last = last.where(last.notna(), rows["pair_id"].map(seen))
        rows["is_new"] = last.isna() | (rows["t"] - last > config.interval_s)
        seen.update(zip(rows["pair_id"], rows["t"].tolist()))
        watermark = held.getCurrentWatermarkMs()
        seen = {pair: t for pair, t in seen.items() if (t + ttl) * 1000 > watermark}
        held.update((pickle.dumps(seen),))
        if seen:
            held.setTimeoutTimestamp((max(seen.values()) + ttl) * 1000)
        yield rows

    return keyed.groupBy(*key).applyInPandasWithState(run, schema, "state binary", "update", GroupStateTimeout.EventTimeTimeout).drop("t", "bucket")


def against_current_lists(flows: DataFrame, read_list: Callable[[], DataFrame], out: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch meets the list as it is then. Returns the started query."""

    def batch(rows: DataFrame, n: int) -> None:
        out(rows.join(read_list(), rows["dst_ip"] == F.col("ip")), n)

    return flows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def shared(spark: SparkSession) -> str:
    """A new folder that the whole cluster can write to, as the session or its context names it; a temporary one in local mode only."""
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", "")
    if not top and sc._jsc.sc().getCheckpointDir().isDefined():
        top = sc._jsc.sc().getCheckpointDir().get()
    if not top:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="vigil-stream-")
    return f"{top}/{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session for a while; names have __ for dots."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def replay(rows: DataFrame, build: Callable[[DataFrame], DataFrame], slices: Sequence[Column] = (), mode: str = "update", **conf: str) -> DataFrame:
    """rows written out, streamed through ``build`` until none are left, and what came out.

    ``slices`` are conditions, one for each part that is written by itself and read as a
    micro-batch of its own, in that order; without any there is one part. The stream is started
    anew on the same checkpoint for each part, so that a part may have any number of files.
    """
    spark, folder = rows.sparkSession, shared(rows.sparkSession)
    if slices:
        rows.write.parquet(f"{folder}/all")
        rows = spark.read.parquet(f"{folder}/all")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")  # a batch that is run again replaces itself

    with settings(spark, **conf):
        for n, part in enumerate(slices or (None,), 1):
            (rows if part is None else rows.where(part)).write.mode("append").parquet(f"{folder}/in")
            stream = build(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
            # batches without rows, for what the watermark lets go, come at the end only
            with settings(spark, spark__sql__streaming__noDataMicroBatches__enabled=str(n >= len(slices)).lower()):
                stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")
