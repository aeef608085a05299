"""Questions asked of the metric table: thresholds, rates, sustained conditions, rankings.

metrics: host_id, ts, metric, type, labels MAP<STRING,STRING>, value. Rates are reset-aware
sums of increases over a time range, not extrapolated to its edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPS = {">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__", "==": "__eq__"}


def select(metrics: DataFrame, metric: str, labels: Sequence[str], where: Column | None = None) -> DataFrame:
    """One metric with chosen labels as columns."""
    rows = metrics.where(F.col("metric") == metric)
    rows = rows if where is None else rows.where(where)
    return rows.select("host_id", "ts", *(F.col("labels")[x].alias(x) for x in labels), "value")


def compare(value: Column, op: str, limit: float) -> Column:
    return getattr(value, OPS[op])(F.lit(limit))


def threshold_max_by(rows: DataFrame, labels: Sequence[str], op: str, limit: float) -> DataFrame:
    return rows.groupBy(*labels, "ts").agg(F.max("value").alias("value")).where(compare(F.col("value"), op, limit))


def gauge_threshold(rows: DataFrame, op: str, limit: float, where: Column | None = None) -> DataFrame:
    rows = rows if where is None else rows.where(where)
    return rows.where(compare(F.col("value"), op, limit))


def count_having(rows: DataFrame, labels: Sequence[str], op: str, limit: float, least: int) -> DataFrame:
    return rows.where(compare(F.col("value"), op, limit)).groupBy(*labels, "ts").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _increases(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """The increase since the sample before; after a reset, the counter itself."""
    order = Window.partitionBy(*key).orderBy("ts")
    last = F.lag("value").over(order)
    step = F.when(last.isNull(), F.lit(0.0)).when(F.col("value") < last, F.col("value")).otherwise(F.col("value") - last)
    return rows.withColumns({"_step": step, "_t": F.unix_timestamp("ts")})


def _range(key: Sequence[str], seconds: int):
    return Window.partitionBy(*key).orderBy("_t").rangeBetween(-seconds, 0)


def increase(rows: DataFrame, key: Sequence[str], seconds: int) -> DataFrame:
    """Increases whose samples lie in the range, the first one's own step excepted."""
    span = _range(key, seconds)
    out = _increases(rows, key)
    total = F.sum("_step").over(span) - F.first("_step").over(span)
    return out.withColumn("increase", total).drop("_step", "_t")


def rate(rows: DataFrame, key: Sequence[str], seconds: int) -> DataFrame:
    span = _range(key, seconds)
    out = _increases(rows, key)
    total = F.sum("_step").over(span) - F.first("_step").over(span)
    width = F.col("_t") - F.min("_t").over(span)
    return out.withColumn("rate", F.when(width > 0, total / width).otherwise(0.0)).drop("_step", "_t")


def rate_ratio(a: DataFrame, b: DataFrame, key: Sequence[str], seconds: int) -> DataFrame:
    """rate(a) over rate(b), the latter 1 at least."""
    one = rate(a, key, seconds).select(*key, "ts", F.col("rate").alias("_a"))
    two = rate(b, key, seconds).select(*key, "ts", F.col("rate").alias("_b"))
    return one.join(two, [*key, "ts"]).select(*key, "ts", (F.col("_a") / F.greatest("_b", F.lit(1.0))).alias("ratio"))


def avg_over_rate(rows: DataFrame, key: Sequence[str], inner: int, outer: int) -> DataFrame:
    out = rate(rows, key, inner).withColumn("_t", F.unix_timestamp("ts"))
    return out.withColumn("avg_rate", F.avg("rate").over(_range(key, outer))).drop("_t")


def max_over_time(rows: DataFrame, key: Sequence[str], seconds: int) -> DataFrame:
    out = rows.withColumn("_t", F.unix_timestamp("ts"))
    return out.withColumn("max_value", F.max("value").over(_range(key, seconds))).drop("_t")


def deriv(rows: DataFrame, key: Sequence[str], seconds: int) -> DataFrame:
    """Slope of a least-squares line, a second."""
    out = rows.withColumn("_t", F.unix_timestamp("ts"))
    slope = F.regr_slope(F.col("value"), F.col("_t").cast("double")).over(_range(key, seconds))
    return out.withColumn("slope", slope).drop("_t")


def compound_and(conditions: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Label sets for which every condition holds at once."""
    out = conditions[0].select(*key, "ts").distinct()
    for other in conditions[1:]:
        out = out.join(other.select(*key, "ts").distinct(), [*key, "ts"], "left_semi")
    return out


def staleness(rows: DataFrame, key: Sequence[str], now: Column, limit: float) -> DataFrame:
    """rows whose value is a unix time, at most ``now`` less the limit."""
    return rows.groupBy(*key).agg(F.max("value").alias("last")).withColumn("age", now - F.col("last")).where(F.col("age") > limit)


def for_duration(conditions: DataFrame, key: Sequence[str], samples: DataFrame, seconds: int) -> DataFrame:
    """Condition rows that have held at every sample for that long. samples: all rows (key, ts) seen."""
    order = Window.partitionBy(*key).orderBy("ts")
    held = samples.select(*key, "ts").distinct().join(conditions.select(*key, "ts").distinct().withColumn("_on", F.lit(True)), [*key, "ts"], "left")
    island = F.sum(F.when(F.col("_on").isNull(), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    held = held.withColumn("_island", island).where("_on")
    start = F.min(F.unix_timestamp("ts")).over(Window.partitionBy(*key, "_island"))
    return held.withColumn("held_s", F.unix_timestamp("ts") - start).where(F.col("held_s") >= seconds).drop("_on", "_island")


def top_k(rows: DataFrame, by: Sequence[str], value: str, tie: Sequence[str], k: int) -> DataFrame:
    """The k rows of each group with the largest value, ranked."""
    order = Window.partitionBy(*by).orderBy(F.desc(value), *tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def noisy_ips(ip_flows: DataFrame, hosts: DataFrame, least_utilization: float, k: int) -> DataFrame:
    """Addresses with most flows on hosts whose table is that full. hosts: host_id, snapshot_ts, utilization."""
    full = hosts.where(F.col("utilization") >= least_utilization).select("host_id", "snapshot_ts", "utilization")
    return top_k(ip_flows.join(full, ["host_id", "snapshot_ts"]), ["host_id", "snapshot_ts"], "flows_total", ["instance", "ip"], k)


def noisy_neighbors(severities: DataFrame, hosts: DataFrame, axis: str, least: float, k: int) -> DataFrame:
    """Machines with the worst severity on an axis, on hosts under pressure. hosts: host_id, ts, pressure."""
    loud = hosts.where(F.col("pressure") >= least).select("host_id", "ts")
    return top_k(severities.join(loud, ["host_id", "ts"], "left_semi"), ["host_id", "ts"], f"{axis}_severity", ["instance"], k)


def host_rollup(instances: DataFrame, disks: DataFrame, ips: DataFrame) -> DataFrame:
    own = instances.groupBy("host_id").agg(
        F.count_distinct("instance").alias("active_vms"), F.sum("vcpus").alias("active_vcpus"), F.count_distinct("project").alias("active_projects")
    )
    d = disks.groupBy("host_id").agg(F.count("*").alias("active_disks"))
    i = ips.select("host_id", "instance", "ip").distinct().groupBy("host_id").agg(F.count("*").alias("active_fixed_ips"))
    return own.join(d, "host_id", "left").join(i, "host_id", "left").fillna(0)


def showback(instances: DataFrame, by: Sequence[str] = ("project", "owner")) -> DataFrame:
    """Allocated and used memory and processors for each owner, with subtotals (nulls stand for all)."""
    return instances.rollup(*by).agg(
        F.count("*").alias("machines"), F.sum("vcpus").alias("vcpus"), F.sum("mem_mb").alias("allocated_mb"), F.sum("used_mb").alias("used_mb")
    )
