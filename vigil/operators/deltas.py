"""Rates from cumulative counters: lag windows, one sort for each key. A reset gives 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars

INSTANCE = ["host_id", "instance"]


def _lagged(df: DataFrame, key: list[str], counters: list[str]) -> DataFrame:
    """Adds elapsed seconds (0 for a first sample) and the increase of each counter."""
    order = Window.partitionBy(*key).orderBy("ts")
    before = F.lag("ts").over(order)
    df = df.withColumn("_dt", F.coalesce((F.col("ts").cast("double") - before.cast("double")), F.lit(0.0)))
    step = lambda c: F.col(c) - F.lag(c).over(order)
    return df.withColumns({f"_d_{c}": F.greatest(F.coalesce(step(c), F.lit(0)), F.lit(0)).cast("double") for c in counters})


def _rate(counter: str, per: float = 1.0) -> Column:
    return F.when(F.col("_dt") > 0, F.col(f"_d_{counter}") / F.col("_dt") * per).otherwise(0.0)


def _clean(df: DataFrame) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.startswith("_")))


def cpu_usage(samples: DataFrame) -> DataFrame:
    """samples: host_id, instance, ts, cpu_ns, steal_ns, wait_ns, vcpus -> percentages of all vCPUs, 100 at most."""
    df = _lagged(samples, INSTANCE, ["cpu_ns", "steal_ns", "wait_ns"])
    share = lambda c: F.when((F.col("vcpus") > 0), F.least(_rate(c, 1e-9) * 100 / F.col("vcpus"), F.lit(100.0))).otherwise(0.0)
    return _clean(df.withColumns({"cpu_percent": share("cpu_ns"), "steal_percent": share("steal_ns"), "wait_percent": share("wait_ns")}))


DISK = ["host_id", "instance", "volume", "path"]
DISK_COUNTERS = ["rd_reqs", "wr_reqs", "fl_reqs", "rd_bytes", "wr_bytes", "rd_ns", "wr_ns", "fl_ns"]


def disk_io(samples: DataFrame) -> DataFrame:
    df = _lagged(samples, DISK, DISK_COUNTERS)
    d, live = (lambda c: F.col(f"_d_{c}")), F.col("_dt") > 0
    latency = lambda t, n: F.when(live & (d(n) > 0), d(t) / d(n) / 1e9).otherwise(0.0)
    requests, volume = d("rd_reqs") + d("wr_reqs"), d("rd_bytes") + d("wr_bytes")
    return _clean(df.withColumns({
        "rd_iops": _rate("rd_reqs"), "wr_iops": _rate("wr_reqs"), "fl_iops": _rate("fl_reqs"),
        "rd_latency": latency("rd_ns", "rd_reqs"), "wr_latency": latency("wr_ns", "wr_reqs"), "fl_latency": latency("fl_ns", "fl_reqs"),
        "avg_io_size": F.when(live & (requests > 0), volume / requests).otherwise(0.0),
        "rw_requests": F.when(live, requests).otherwise(0.0), "fl_requests": F.when(live, d("fl_reqs")).otherwise(0.0),
        "bandwidth": F.when(live, volume / F.col("_dt")).otherwise(0.0),
    }))


def mem_rates(samples: DataFrame) -> DataFrame:
    df = _lagged(samples, INSTANCE, ["swap_in", "swap_out", "major_faults"])
    return _clean(df.withColumns({f"{c}_rate": _rate(c) for c in ("swap_in", "swap_out", "major_faults")}))


def net_totals(samples: DataFrame, ifaces: DataFrame) -> DataFrame:
    """Packets and drops over the interfaces that the inventory knows."""
    known = samples.join(ifaces.select("instance", "iface").distinct(), ["instance", "iface"], "left_semi")
    return known.groupBy(*INSTANCE, "ts").agg(
        F.sum(F.col("rx_packets") + F.col("tx_packets")).alias("packets"), F.sum(F.col("rx_drops") + F.col("tx_drops")).alias("drops")
    )


def net_rates(totals: DataFrame) -> DataFrame:
    df = _lagged(totals, INSTANCE, ["packets", "drops"])
    share = F.when((F.col("_dt") > 0) & (F.col("_d_packets") > 0), F.col("_d_drops") / F.col("_d_packets")).otherwise(0.0)
    return _clean(df.withColumns({"pps": _rate("packets"), "drop_ratio": share, "drops_per_s": _rate("drops")}))


def vcpu_steal_wait(vcpus: DataFrame) -> DataFrame:
    """vcpus: host_id, instance, ts, vcpu, delay, wait (ns) -> sums for each machine."""
    return vcpus.groupBy(*INSTANCE, "ts").agg(F.sum("delay").alias("steal_ns"), F.sum("wait").alias("wait_ns"))


def host_cpu_percent(samples: DataFrame) -> DataFrame:
    """samples: host_id, ts, total, idle (jiffies, idle with iowait)."""
    order = Window.partitionBy("host_id").orderBy("ts")
    total, idle = (F.col(c) - F.lag(c).over(order) for c in ("total", "idle"))
    return samples.withColumn("cpu_percent", F.when(total > 0, (total - idle) * 100.0 / total).otherwise(0.0))


def collection_lag(loads: DataFrame) -> DataFrame:
    """loads: host_id, ts, ok -> seconds since the cycle before and since the last good read (-1 if none)."""
    order = Window.partitionBy("host_id").orderBy("ts")
    now = F.col("ts").cast("long")
    good = F.last(F.when(F.col("ok"), now), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return loads.withColumns({
        "cycle_lag": F.coalesce(now - F.lag("ts").over(order).cast("long"), F.lit(0)),
        "stale_seconds": F.coalesce(now - good, F.lit(-1)),
    })


def join_disk_metadata(samples: DataFrame, disks: DataFrame) -> DataFrame:
    """samples (.., path), disks (instance, path, disk_type, volume): unknown where the inventory has none; one row each."""
    known = disks.select("instance", "path", "disk_type", "volume").dropDuplicates(["instance", "path"])
    out = samples.join(known, ["instance", "path"], "left").fillna("unknown", ["disk_type", "volume"])
    return out.dropDuplicates(["host_id", "instance", "volume", "path", "ts"])


def disk_worst(rates: DataFrame) -> DataFrame:
    return disk_pressure(rates).groupBy(*INSTANCE, "ts").agg(
        F.max("disk_signal").alias("disk_signal"), F.max("disk_activity").alias("disk_activity"), F.count("*").alias("disks")
    )


def disk_pressure(rates: DataFrame) -> DataFrame:
    """Adds disk_signal (0-100) and disk_activity of each disk."""
    c = F.col
    size = scalars.clamp((c("avg_io_size") - 65536) / (1048576 - 65536))
    ceiling = 0.020 + size * 0.080
    severity = lambda x, low, high: F.when(x > low, scalars.clamp((x - low) / (high - low)) * 100).otherwise(0.0)
    rw = F.greatest(severity(c("rd_latency"), 0.002, ceiling), severity(c("wr_latency"), 0.002, ceiling))
    flush = F.when((c("fl_requests") > 0) & (c("fl_latency") > 0), severity(c("fl_latency"), 0.001, 0.040)).otherwise(0.0)
    return rates.withColumns({
        "disk_signal": F.greatest(F.when(c("rw_requests") >= 5, rw).otherwise(0.0), flush),
        "disk_activity": F.greatest((c("rd_iops") + c("wr_iops")) / 100, c("bandwidth") / (10 * 1024 * 1024)),
    })


def state_islands(samples: DataFrame, key: list[str], ttl_s: float, ts: str = "ts") -> DataFrame:
    """Adds island: state is kept within one, and starts anew where a key was idle for longer than ttl_s."""
    order = Window.partitionBy(*key).orderBy(ts)
    gap = F.col(ts).cast("double") - F.lag(ts).over(order).cast("double")
    return samples.withColumn("island", F.sum(F.when(gap > ttl_s, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def presence_islands(active: DataFrame, cycles: DataFrame, key: list[str]) -> DataFrame:
    """Adds island: a new one where a key was away for one of its host's cycles, for state that ends with absence.

    active: host_id, snapshot_ts and the key, a row for each cycle that saw it; cycles: host_id, snapshot_ts.
    """
    numbers = cycles.select("host_id", "snapshot_ts").distinct()
    numbers = numbers.withColumn("_no", F.row_number().over(Window.partitionBy("host_id").orderBy("snapshot_ts")))
    order = Window.partitionBy(*key).orderBy("_no")
    away = F.col("_no") - F.lag("_no").over(order) > 1
    rows = active.join(numbers, ["host_id", "snapshot_ts"]).withColumn("_away", F.when(away, 1).otherwise(0))
    return rows.withColumn("island", F.sum("_away").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_no", "_away")


def absences(active: DataFrame, cycles: DataFrame, key: list[str] = INSTANCE) -> DataFrame:
    """The first cycle of each absence of a key: key and snapshot_ts. What presence_islands is to batches, this is to streams."""
    numbers = cycles.select("host_id", "snapshot_ts").distinct()
    numbers = numbers.withColumn("_no", F.row_number().over(Window.partitionBy("host_id").orderBy("snapshot_ts")))
    after = F.lead("_no").over(Window.partitionBy(*key).orderBy("_no"))
    rows = active.select(*key, "snapshot_ts").join(numbers, ["host_id", "snapshot_ts"]).withColumn("_after", after)
    gone = rows.where("_after is null or _after > _no + 1").select(*key, (F.col("_no") + 1).alias("_no"))
    return gone.join(numbers, ["host_id", "_no"]).select(*key, "snapshot_ts")
