"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): every v, and u, linked to the least of u and its v.

    The minima are written out first, so that the join below has a plain exchange on
    either side and a hub's rows can be split.
    """
    least = checkpoint(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (u, v) of longs -> (node, root), root being the least node reachable.

    Nodes without an edge to another one are absent. Each round costs a few shuffles of the
    remaining edges; the number of rounds is logarithmic in practice.
    """
    now = checkpoint(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    state = None
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = checkpoint(large)
        small = _star(large)
        now = checkpoint(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        last, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
