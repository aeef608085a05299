"""Bounded summaries that can be stored for each snapshot and merged later: heavy remotes and distinct remotes.

Heavy hitters hold ``items`` remotes at most; a remote's count is off by no more than ``error_bound``
of the flows merged. Distinct counts come from HyperLogLog sketches; theta sketches also tell
the remotes of one span that another did not have.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import IDENTITY, SNAPSHOT


#: Standard errors that an estimate is allowed.
ERRORS = 5


def precision(tolerance: float, share: float = 1.0) -> int:
    """lg_k with which a distinct count stays within ``tolerance``, and that of a part of ``share`` of the set or more as well."""
    return math.ceil(math.log2((ERRORS / tolerance) ** 2 / share))


def remote_summaries(events: DataFrame, items: int = 10_000, lg_k: int = 14, lg_theta: int | None = None) -> DataFrame:
    """One row for each identity and snapshot, to be kept instead of its remotes: heavy hitters, an HLL and a theta sketch."""
    return events.groupBy(*SNAPSHOT).agg(
        F.expr(f"approx_top_k_accumulate(hex(remote), {items})").alias("heavy"),
        F.hll_sketch_agg("remote", lg_k).alias("distinct_hll"), F.theta_sketch_agg("remote", lg_theta or lg_k).alias("distinct_theta"), F.count("*").alias("flows"),
    )


def merged(summaries: DataFrame, span: Column, items: int = 10_000, lg_k: int = 14) -> DataFrame:
    """The summaries of each identity and span of time (a column of the summaries' snapshot_ts), as one; those that were not kept are left out.

    lg_k is that of the theta sketches."""
    kept = {
        "heavy": F.expr(f"approx_top_k_combine(heavy, {items})"), "distinct_hll": F.hll_union_agg("distinct_hll"),
        "distinct_theta": F.theta_union_agg("distinct_theta", lg_k), "flows": F.sum("flows"),
    }
    told = [c.alias(name) for name, c in kept.items() if name in summaries.columns]
    return summaries.groupBy(*IDENTITY, span.alias("span")).agg(*told, F.count("*").alias("snapshots"))


def top(summaries: DataFrame, k: int = 5) -> DataFrame:
    """Adds top: the k heaviest remotes (hex) with their counts, heaviest first."""
    return summaries.withColumn("top", F.expr(f"approx_top_k_estimate(heavy, {k})"))


def error_bound(items: int) -> float:
    """The share of all flows by which a count may be off: 3.5 over the map's size, the power of two of which three quarters hold the items."""
    size = 1 << max(3, (items * 4 // 3 - 1).bit_length())
    return 3.5 / size


def distinct(summaries: DataFrame) -> DataFrame:
    return summaries.withColumn("remotes", F.hll_sketch_estimate("distinct_hll"))


def fresh(now: DataFrame, before: DataFrame, key: list[str] = IDENTITY, lg_k: int = 14) -> DataFrame:
    """now (key, distinct_theta) and how many of its remotes are not in ``before`` (all where that has no row), and by what share of
    that number it may be off: 0 where both sets fit into their sketches. A small part of large sets is told badly, whatever lg_k."""
    old = before.select(*key, F.col("distinct_theta").alias("_old"))
    size = F.theta_sketch_estimate("distinct_theta")
    gone = F.theta_sketch_estimate(F.theta_difference("distinct_theta", "_old"))
    most = F.greatest(size, F.coalesce(F.theta_sketch_estimate("_old"), F.lit(0)))
    kept = F.least(F.lit(1.0), F.lit(float(1 << lg_k)) / F.greatest(most, F.lit(1)))  # the share of all remotes that the sketches hold
    rows = now.join(old, key, "left").withColumn("new_remotes", F.coalesce(gone, size))
    return rows.withColumn("new_error", ERRORS * F.sqrt((1 - kept) / (kept * F.greatest("new_remotes", F.lit(1))))).drop("_old")
