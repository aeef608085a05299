"""Output tables: the long metric table and typed event records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ip as addr
from .features import alert_ends


def metrics(wide: DataFrame, names: dict[str, tuple[str, str]], labels: Sequence[str], ts: str = "snapshot_ts") -> DataFrame:
    """Wide rows -> host_id, ts, metric, type, labels, value. names: column -> (metric, gauge or counter); nulls are not emitted."""
    cells = [F.struct(F.lit(m).alias("metric"), F.lit(t).alias("type"), F.col(c).cast("double").alias("value")) for c, (m, t) in names.items()]
    tags = F.create_map(*(x for name in labels for x in (F.lit(name), F.col(name).cast("string"))))
    rows = wide.select("host_id", F.col(ts).alias("ts"), tags.alias("labels"), F.explode(F.array(*cells)).alias("m"))
    return rows.select("host_id", "ts", "m.metric", "m.type", "labels", "m.value").where("value is not null")


def write_metrics(rows: DataFrame, path: str) -> None:
    rows.withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("date").parquet(path)


def alerts(gated: DataFrame, ends: DataFrame) -> DataFrame:
    """The alert record of each emitted hit. ends is features.alert_endpoints of the same events."""
    key = ["host_id", "instance", "ip", "direction", "snapshot_ts"]
    c = F.col
    rows = gated.where("emitted").join(ends, key, "left")
    src, dst = alert_ends(c("direction"), c("kind"), c("ip"))
    detail = F.format_string(
        "Alert: %s detected (Flows: %d, Unreplied: %.0f%%, Impact: %.2f%%)", "kind", "flows", c("unreplied_ratio") * 100, c("host_impact") * 100
    )
    five = lambda x: F.round(x + 1e-9, 5)  # noqa: E731  halves go up, also where a double lies just below one
    return rows.select(
        *key[:2], "snapshot_ts", addr.show(c("ip")).alias("fixed_ip"), "kind", "reason", detail.alias("detail"), "direction", "rule_id", "source",
        "synergy_scan", "synergy_physics", "threshold_flows", "local_scan_hits", "infra_hits", "infra_max_flows",
        c("flows").alias("flows_current"), "unique_remotes", "unique_remotes_saturated", "new_remotes", "new_remotes_saturated",
        "unique_ports", "new_ports", c("top_port").alias("top_dst_port"), addr.show(c("top_remote")).alias("top_remote_ip"),
        five(c("remote_share")).alias("top_remote_share"), five(c("port_share")).alias("top_port_share"), c("mode").alias("evidence_mode"),
        c("hits").alias("persistence_hits"), c("required").alias("persistence_required"), "emit_reason", "severity_score",
        "confidence_score", "severity_band", "priority", "priority_basis", five(c("unreplied_ratio")).alias("unreplied_ratio"),
        "multicast", "icmp", "udp", five(c("host_impact") * 100).alias("host_impact_percent"), five(c("signal")).alias("behavior_signal"),
        "accounting", five(c("bytes_per_flow")).alias("bytes_per_flow"), five(c("packets_per_flow")).alias("packets_per_flow"),
        "remote_map_capped", F.when(~c("remote_map_capped"), c("max_single_remote")).alias("max_flows_single_remote"),
        c("max_single_port").alias("max_flows_single_port"), addr.show(src).alias("src_ip"), addr.show(dst).alias("dst_ip"),
    )


def threat_events(routed: DataFrame) -> DataFrame:
    """One record for each pair that a list hit."""
    p = F.col("pair")
    return routed.select(
        "host_id", "snapshot_ts", "list", "instance", addr.show(p["a"]["ip"]).alias("a_ip"), p["a"]["port"].alias("a_port"),
        addr.show(p["b"]["ip"]).alias("b_ip"), p["b"]["port"].alias("b_port"), p["proto"].alias("proto"),
    )


def notices(alerts: DataFrame, routed: DataFrame, listed: DataFrame) -> DataFrame:
    """Every event that may be told, with the key under which it is throttled: machine and kind of an alert; list, machine and
    both addresses of a threat hit; list and address of a host's own. listed: host_id, snapshot_ts, list, ip."""
    c = F.col
    key = lambda *parts: F.concat_ws("|", *(p.cast("string") for p in parts)).alias("key")
    shown = lambda x: F.when(addr.is_v4_mapped(x), addr.to_long(x).cast("string")).otherwise(F.hex(x))
    head = lambda family: (F.lit(family).alias("family"), "host_id")
    behavior = alerts.select(*head("behavior"), key(c("instance"), c("kind")), "snapshot_ts")
    hits = routed.select(*head("threat"), key(c("list"), c("instance"), shown(c("pair.a.ip")), shown(c("pair.b.ip"))), "snapshot_ts")
    own = listed.select(*head("host"), key(c("list"), shown(c("ip"))), "snapshot_ts")
    return behavior.unionByName(hits).unionByName(own)


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def resource_records(events: DataFrame) -> DataFrame:
    """Resource change records with the detail of each axis."""
    axis = lambda a: F.struct(*(F.round(f"{a}_{n}", 5).alias(n) for n in ("p", "conf", "impact", "ewma", "severity"))).alias(a)
    return events.select(
        "host_id", "instance", "ts", F.round("overall", 5).alias("overall"), F.round("overall_raw", 5).alias("overall_raw"), "band", "top_axis",
        "cap_active", "persistence_triggered", *map(axis, ("cpu", "mem", "disk", "net")),
    )


