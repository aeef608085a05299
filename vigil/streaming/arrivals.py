"""What arrives: snapshots that close when they are complete, and rows that come too late, told apart and counted.

A host reads its two address families one after the other and may send a reading twice, or only one
of them. A snapshot closes, as ``ok``, once both have come, and as ``partial`` when the watermark
passes it; a second reading of a family changes nothing, before or after that, as long as
the watermark lets it in.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

FAMILIES = (4, 6)


class Closing(StatefulProcessor):
    """State of one snapshot: which families have come with how many flows, and whether it is closed."""

    def __init__(self, grace_s: float):
        self.grace_s = grace_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.read = handle.getMapState("read", "family int", "flows long")
        self.closed = handle.getValueState("closed", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = not self.read.exists()
        for frame in rows:
            for family, flows in zip(frame["family"].tolist(), frame["flows"].tolist()):
                if not self.read.containsKey((family,)):
                    self.read.updateValue((family,), (flows,))
        if first:
            self.handle.registerTimer(int((key[1].timestamp() + self.grace_s) * 1000))
        if not self.closed.exists() and all(self.read.containsKey((f,)) for f in FAMILIES):
            yield self.close_as(key, "ok")

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.closed.exists():
            yield self.close_as(key, "partial")
        self.read.clear()  # the watermark has passed: nothing of this snapshot comes any more
        self.closed.clear()

    def close_as(self, key: Any, status: str) -> pd.DataFrame:
        self.closed.update((int(key[1].timestamp()),))
        flows = sum(self.read.getValue((f,))[0] for f in FAMILIES if self.read.containsKey((f,)))
        return pd.DataFrame({"host_id": [key[0]], "snapshot_ts": [key[1]], "flows": [flows], "status": [status]})


def closed_snapshots(reads: DataFrame, delay: str = "1 minute", grace_s: float = 0.0) -> DataFrame:
    """reads (host_id, snapshot_ts, family, flows) as a stream -> host_id, snapshot_ts, flows, status, a row for each snapshot when it closes."""
    keyed = reads.withWatermark("snapshot_ts", delay).groupBy("host_id", "snapshot_ts")
    return keyed.transformWithStateInPandas(Closing(grace_s), "host_id string, snapshot_ts timestamp, flows long, status string", "Append", "EventTime", eventTimeColumnName="snapshot_ts")


class Marking(StatefulProcessor):
    """State of one source: the latest time seen in batches before. No row is dropped, late ones are marked."""

    def __init__(self, delay_s: float, names: list[str]):
        self.delay_s, self.names = delay_s, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "t long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = self.latest.get()[0] if self.latest.exists() else None
        most = before
        for frame in rows:
            t = frame["t"]
            late = pd.Series(False, index=frame.index) if before is None else t < before - self.delay_s
            most = int(t.max()) if most is None else max(most, int(t.max()))
            yield frame.assign(late=late)[self.names]
        if most is not None:
            self.latest.update((most,))


def marked(stream: DataFrame, source: list[str], delay_s: float = 60, column: str = "snapshot_ts") -> DataFrame:
    """Every row of the stream with ``late``: whether it lies more than ``delay_s`` behind what its source has sent in batches before.

    on_time() of the rows that are not late loses nothing more for the same delay; the others can be kept and counted.
    """
    timed = stream.withColumn("t", F.unix_timestamp(column))
    schema = timed.drop("t").schema.add("late", "boolean")
    return timed.groupBy(*source).transformWithStateInPandas(Marking(delay_s, schema.names), schema, "Append", "None")


def late_counts(rows: DataFrame, source: list[str]) -> DataFrame:
    """What has come on time and what too late: source, on_time, late."""
    return rows.groupBy(*source).agg(F.count_if(~F.col("late")).alias("on_time"), F.count_if("late").alias("late"))
