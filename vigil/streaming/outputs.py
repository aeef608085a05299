"""Streams written exactly once: a ledger of batches, and tables whose readers see only what it lists.

A micro-batch writes its rows under its own number and is entered in the ledger afterwards. A batch
that is run again, after a crash before or after the entry, replaces its own rows; rows of a batch
that never finished are not read. Within a batch the rows lie by date.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


class LedgerTable:
    """A table in a shared folder that streams write batch by batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, rows: DataFrame, batch: int, ts: str) -> None:
        dated = rows.withColumn("date", F.to_date(ts))
        dated.write.mode("overwrite").partitionBy("date").parquet(f"{self.path}/rows/batch={batch}")
        self.enter(batch)

    def enter(self, batch: int) -> None:
        """The entry is one small file that either is there or is not."""
        self.spark.range(batch, batch + 1, 1, 1).write.mode("overwrite").parquet(f"{self.path}/ledger/entry={batch}")

    def batches(self) -> list[int]:
        """Numbers of finished batches: one for each micro-batch since the table began."""
        return [r["id"] for r in self.spark.read.option("recursiveFileLookup", "true").schema("id long").parquet(f"{self.path}/ledger").collect()]

    def read(self) -> DataFrame:
        done = self.spark.read.option("recursiveFileLookup", "true").schema("id long").parquet(f"{self.path}/ledger")
        rows = self.spark.read.parquet(f"{self.path}/rows")
        return rows.join(F.broadcast(done.select(F.col("id").cast(rows.schema["batch"].dataType).alias("batch"))), "batch", "left_semi").drop("batch", "date")

    def start(self, stream: DataFrame, ts: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> StreamingQuery:
        """Writes what is there of the stream; ``shape`` turns a batch into records."""
        return (
            stream.writeStream.foreachBatch(lambda rows, n: self.write(shape(rows), n, ts)).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
