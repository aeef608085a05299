"""Threat lists as one table of versions with a commit log.

A load writes its entries under a new version and then appends one commit: its version, whether
it is good, how many entries it has. The current version of a list is that of its latest good
commit, so a load that fails, or has not finished, changes nothing; with ``keep_on_empty`` an empty
load counts as failed. Readers pin the versions once, and a micro-batch has the same lists to its
end whatever is committed meanwhile.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

LOG = "list string, version long, ok boolean, entries long"


class VersionedLists:
    def __init__(self, spark: SparkSession, path: str, keep_on_empty: bool = False):
        self.spark, self.path, self.keep_on_empty = spark, path, keep_on_empty

    def load(self, name: str, version: int, read: Callable[[], DataFrame]) -> bool:
        """One load of a list; whether it is good."""
        place, n, ok = f"{self.path}/entries/list={name}/version={version}", 0, True
        try:
            read().write.mode("overwrite").parquet(place)
            n = self.spark.read.parquet(place).count()
        except Exception:  # whatever a source raises: the version before stays
            ok = False
        commit = self.spark.createDataFrame([(name, version, ok, n)], LOG).coalesce(1)
        commit.write.mode("overwrite").parquet(f"{self.path}/log/commit={name}-{version}")
        return ok

    def log(self) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", "true").schema(LOG).parquet(f"{self.path}/log")

    def pinned(self) -> dict[str, int]:
        """The current version of each list: as many rows as there are lists."""
        good = self.log().where("ok" + (" and entries > 0" if self.keep_on_empty else ""))
        return {r["list"]: r["version"] for r in good.groupBy("list").agg(F.max("version").alias("version")).collect()}

    def read(self, versions: dict[str, int]) -> DataFrame | None:
        """Entries of these versions with their list and version; None without any."""
        frames = [
            self.spark.read.parquet(f"{self.path}/entries/list={name}/version={v}").withColumns({"list": F.lit(name), "version": F.lit(v).cast("long")})
            for name, v in sorted(versions.items())
        ]
        for frame in frames[1:]:
            frames[0] = frames[0].unionByName(frame)
        return frames[0] if frames else None

    def against(self, stream: DataFrame, meet: Callable[[DataFrame, DataFrame], DataFrame], out: Callable[[DataFrame, int], None], checkpoint: str, before: Callable[[int], None] = lambda n: None) -> StreamingQuery:
        """Each micro-batch meets the lists of the versions pinned at its start; ``before`` runs ahead of the pin."""

        def batch(rows: DataFrame, n: int) -> None:
            before(n)
            entries = self.read(self.pinned())
            if entries is not None:
                out(meet(rows, entries), n)

        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
