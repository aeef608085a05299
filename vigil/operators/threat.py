"""Threat lists against flows and hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import ip as addr
from ..functions import scalars


def sides(attributed: DataFrame) -> DataFrame:
    """Each owned flow with its pair key, once for either end."""
    pair = scalars.flow_pair(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"), F.col("proto"))
    ends = F.array(F.struct(F.lit("src").alias("side"), F.col("src_ip").alias("ip")), F.struct(F.lit("dst").alias("side"), F.col("dst_ip").alias("ip")))
    return attributed.select("host_id", "snapshot_ts", "src_inst", "dst_inst", pair.alias("pair"), F.explode(ends).alias("e")).select(
        "host_id", "snapshot_ts", "src_inst", "dst_inst", "pair", "e.side", "e.ip"
    )


def match_ips(attributed: DataFrame, threat_ips: DataFrame) -> DataFrame:
    """An equi-join on the address; Spark broadcasts the list where its size allows."""
    return sides(attributed).join(threat_ips.select("list", "ip").distinct(), "ip").drop("ip")


def cidr_join(rows: DataFrame, cidrs: DataFrame, ip: str = "ip") -> DataFrame:
    """rows whose address lies in a network, with its list. cidrs: list, family, prefix_len, network (BINARY).

    The address is taken at every prefix length that the lists hold (at most 32 + 128), so
    the range join becomes an equi-join on the bits that count.
    """
    nets = cidrs.select("list", F.col("family").alias("_family"), F.col("prefix_len").alias("_len"), addr.masked(F.col("network"), F.col("family"), F.col("prefix_len")).alias("_bits")).distinct()
    lengths = nets.groupBy("_family").agg(F.collect_set("_len").alias("_lens"))  # one row for each family
    family = F.when(addr.is_v4_mapped(F.col(ip)), 4).otherwise(6)
    at = rows.withColumn("_family", family).join(F.broadcast(lengths), "_family").withColumn("_len", F.explode("_lens"))
    at = at.withColumn("_bits", addr.masked(F.col(ip), F.col("_family"), F.col("_len")))
    return at.join(nets, ["_family", "_len", "_bits"]).drop("_family", "_len", "_bits", "_lens")


def match_cidrs(attributed: DataFrame, cidrs: DataFrame) -> DataFrame:
    return cidr_join(sides(attributed), cidrs).drop("ip").distinct()


def route(matches: DataFrame, directions: DataFrame) -> DataFrame:
    """Which machine a match counts for. directions is (list, contact): out, in or any."""
    out = F.when((F.col("side") == "dst") & F.col("contact").isin("out", "any"), F.col("src_inst"))
    back = F.when((F.col("side") == "src") & F.col("contact").isin("in", "any"), F.col("dst_inst"))
    own = F.when(F.col("contact") == "any", F.array("src_inst", "dst_inst")).otherwise(F.array(out, back))
    routed = matches.join(F.broadcast(directions), "list").withColumn("instance", F.explode(F.array_distinct(F.array_compact(own))))
    return routed.select("host_id", "snapshot_ts", "list", "instance", "pair").distinct()


def hit_counts(routed: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Distinct pairs of each list and machine: kept up to the cap, and dropped beyond it."""
    n, cap = F.count("*"), F.lit(config.threat_cap)
    return routed.groupBy("host_id", "snapshot_ts", "list", "instance").agg(
        F.least(n, cap).alias("active"), F.greatest(n - cap, F.lit(0)).alias("dropped")
    )


def capped_hits(routed: DataFrame, config: Config = DEFAULT) -> DataFrame:
    order = Window.partitionBy("host_id", "snapshot_ts", "list", "instance").orderBy("pair")
    return routed.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= config.threat_cap).drop("nth")


def contacts(routed: DataFrame, snapshots: DataFrame) -> DataFrame:
    """New pairs against the snapshot right before (an empty one counts), and their running total."""
    numbers = snapshots.select("host_id", "snapshot_ts").distinct()
    numbers = numbers.withColumn("no", F.row_number().over(Window.partitionBy("host_id").orderBy("snapshot_ts")))
    pair = Window.partitionBy("host_id", "list", "instance", "pair").orderBy("no")
    marked = routed.join(numbers, ["host_id", "snapshot_ts"]).withColumn("last", F.lag("no").over(pair))
    new = marked.groupBy("host_id", "list", "instance", "snapshot_ts").agg(F.count_if(F.col("last").isNull() | (F.col("last") != F.col("no") - 1)).alias("new_contacts"))
    running = Window.partitionBy("host_id", "list", "instance").orderBy("snapshot_ts").rowsBetween(Window.unboundedPreceding, 0)
    return new.withColumn("contacts_total", F.sum("new_contacts").over(running))


def list_health(loads: DataFrame) -> DataFrame:
    """loads: list, ts, ok, duration_s, entries."""
    good = F.when(F.col("ok"), F.col("ts"))
    return loads.groupBy("list").agg(
        F.max(good).alias("last_success"), F.max_by("duration_s", "ts").alias("duration_s"), F.count_if(~F.col("ok")).alias("errors"),
        F.max_by("entries", good).alias("entries"),
    )


def current_lists(loads: DataFrame, entries: DataFrame, keep_on_empty: bool = False) -> DataFrame:
    """Entries of each list's latest good load; with keep_on_empty an empty load counts as failed.

    loads: list, family, version, ok, entries; entries: list, family, version, ...
    """
    good = loads.where("ok" + (" and entries > 0" if keep_on_empty else ""))
    latest = good.groupBy("list", "family").agg(F.max("version").alias("version"))
    return entries.join(latest, ["list", "family", "version"], "left_semi")


def host_listed(host_ips: DataFrame, threat_ips: DataFrame, cidrs: DataFrame, skip_private: bool = False, ifaces: list[str] | None = None) -> DataFrame:
    """A host's own addresses on any list. host_ips: host_id, iface, ip."""
    own = host_ips
    if ifaces:
        own = own.where(F.col("iface").isin(*ifaces))
    if skip_private:
        own = own.where(~addr.is_private_or_local(F.col("ip")))
    own = own.select("host_id", "ip").distinct()
    return own.join(threat_ips.select("list", "ip"), "ip").select("host_id", "list", "ip").union(cidr_join(own, cidrs).select("host_id", "list", "ip")).distinct()
