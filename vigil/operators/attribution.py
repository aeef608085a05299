"""Which machine a flow belongs to, and what it means to that machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars


def read_flows(raw: DataFrame) -> DataFrame:
    """Flows with both addresses; absent counters are 0."""
    counters = ("fwd_packets", "fwd_bytes", "rev_packets", "rev_bytes")
    return raw.where("src_ip is not null and dst_ip is not null").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counters})


def active_only(df: DataFrame, active: DataFrame) -> DataFrame:
    return df.join(active.select("instance").distinct(), "instance", "left_semi")


def distinct_identities(instance_ips: DataFrame) -> DataFrame:
    return instance_ips.select("host_id", "instance", "ip").distinct()


def by_zone(flows: DataFrame, zone_ips: DataFrame) -> DataFrame:
    """zone_ips (host_id, zone, instance, ip): adds zone_src and zone_dst."""
    zones = zone_ips.select("host_id", "zone", "ip", "instance").distinct()
    for side in ("src", "dst"):
        own = zones.withColumnRenamed("ip", f"{side}_ip").withColumnRenamed("instance", f"zone_{side}")
        flows = flows.join(own, ["host_id", "zone", f"{side}_ip"], "left")
    return flows


def unique_ips(instance_ips: DataFrame) -> DataFrame:
    """Addresses that one machine of the host has alone."""
    return (
        instance_ips.groupBy("host_id", "ip").agg(F.min("instance").alias("instance"), F.max("instance").alias("other"))
        .where("instance = other").drop("other")
    )


def attribute(flows: DataFrame, zone_ips: DataFrame, instance_ips: DataFrame) -> DataFrame:
    """Adds src_inst and dst_inst: by zone, or, if neither side has one, by unique address."""
    out, unique = by_zone(flows, zone_ips), unique_ips(instance_ips)
    for side in ("src", "dst"):
        own = unique.withColumnRenamed("ip", f"{side}_ip").withColumnRenamed("instance", f"only_{side}")
        out = out.join(own, ["host_id", f"{side}_ip"], "left")
    zoned = F.col("zone_src").isNotNull() | F.col("zone_dst").isNotNull()
    return out.withColumns({f"{s}_inst": F.when(zoned, F.col(f"zone_{s}")).otherwise(F.col(f"only_{s}")) for s in ("src", "dst")}).drop(
        "zone_src", "zone_dst", "only_src", "only_dst"
    )


def owned(attributed: DataFrame) -> DataFrame:
    return attributed.where("src_inst is not null or dst_inst is not null")


def unattributed(attributed: DataFrame) -> DataFrame:
    return attributed.where("src_inst is null and dst_inst is null")


def identity_events(attributed: DataFrame, accounting: bool = True) -> DataFrame:
    """Each flow as seen by the machines at its ends; the port is the destination's either way."""
    volume = (lambda c: F.col(f"fwd_{c}") + F.col(f"rev_{c}")) if accounting else (lambda c: F.lit(0))
    side = lambda inst, ip, direction, remote: F.struct(
        F.col(inst).alias("instance"), F.col(ip).alias("ip"), F.lit(direction).alias("direction"), F.col(remote).alias("remote")
    )
    ends = F.array(
        F.when(F.col("src_inst").isNotNull(), side("src_inst", "src_ip", "outbound", "dst_ip")),
        F.when(
            F.col("dst_inst").isNotNull() & (F.col("src_inst").isNull() | (F.col("src_inst") != F.col("dst_inst"))),
            side("dst_inst", "dst_ip", "inbound", "src_ip"),
        ),
    )
    return attributed.select(
        "host_id", "snapshot_ts", F.explode(ends).alias("e"),
        F.col("dst_port").alias("port"), "proto", (F.col("rev_packets") == 0).alias("unreplied"),
        volume("bytes").alias("bytes"), volume("packets").alias("packets"),
    ).where("e is not null").select("host_id", "snapshot_ts", "e.*", "port", "proto", "unreplied", "bytes", "packets")


def instance_flow_totals(attributed: DataFrame) -> DataFrame:
    """Flows of each machine; one between two of its own addresses counts once."""
    owners = F.array_distinct(F.array_compact(F.array("src_inst", "dst_inst")))
    return attributed.select("host_id", "snapshot_ts", F.explode(owners).alias("instance")).groupBy("host_id", "snapshot_ts", "instance").agg(
        F.count("*").alias("flows")
    )


def ip_flows(events: DataFrame, instance_ips: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Inbound, outbound and total flows of every fixed address in every snapshot, 0 where it has none."""
    key = ["host_id", "snapshot_ts", "instance", "ip"]
    seen = events.groupBy(*key).agg(
        F.count_if(F.col("direction") == "inbound").alias("flows_in"),
        F.count_if(F.col("direction") == "outbound").alias("flows_out"),
        F.count("*").alias("flows_total"),
    )
    every = distinct_identities(instance_ips).join(snapshots.select("host_id", "snapshot_ts").distinct(), "host_id")
    return every.join(seen, key, "left").fillna(0, ["flows_in", "flows_out", "flows_total"])


def host_conntrack(flows: DataFrame, host_samples: DataFrame) -> DataFrame:
    """Entries, maximum and utilization of each host's flow table. host_samples has (host_id, table_max)."""
    return (
        flows.groupBy("host_id", "snapshot_ts").agg(F.count("*").alias("entries")).join(host_samples.select("host_id", "table_max"), "host_id")
        .withColumn("utilization", scalars.ratio(F.col("entries"), F.col("table_max")))
    )


def usable(flows: DataFrame, reads: DataFrame) -> DataFrame:
    """Flows of the snapshots that were read at least in part. reads: host_id, snapshot_ts, status."""
    failed = reads.where(F.col("status") == "failed").select("host_id", "snapshot_ts")
    return flows.join(failed, ["host_id", "snapshot_ts"], "left_anti")


def last_good_active(loads: DataFrame, active: DataFrame) -> DataFrame:
    """The active machines at each load: those of the latest good one up to then; none before the first.

    loads: host_id, snapshot_ts, ok; active: host_id, snapshot_ts, instance, as each load saw them.
    """
    order = Window.partitionBy("host_id").orderBy("snapshot_ts").rowsBetween(Window.unboundedPreceding, 0)
    good = loads.withColumn("_good", F.last(F.when(F.col("ok"), F.col("snapshot_ts")), ignorenulls=True).over(order))
    seen = active.withColumnRenamed("snapshot_ts", "_good")
    return good.join(seen, ["host_id", "_good"]).select("host_id", "snapshot_ts", "instance")
