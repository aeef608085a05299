"""The ordered rules: kind, reason, rule id and source of a feature row; the first that fires wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config, Scaler
from ..functions import scalars

HIT = "struct<kind:string,reason:string,rule_id:string,source:string>"
# Throughput a flow that counts as low or heavy.
LOW_BYTES, LOW_PACKETS, HEAVY_BYTES, HEAVY_PACKETS = 1000, 10, 100_000, 100


def c(name: str) -> Column:
    return F.col(name)


def hit(when: Column, kind, reason, rule_id: str, source: str = "internal") -> Column:
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(when, F.struct(text(kind).alias("kind"), text(reason).alias("reason"), F.lit(rule_id).alias("rule_id"), F.lit(source).alias("source")))


def restricted(k: Scaler) -> list[Column]:
    out, u = c("direction") == "outbound", c("metadata_unreplied_ratio")
    meta = F.format_string("flows_%d_unreplied_%.2f", "metadata_flows", u)
    share = c("infra_max_flows") >= c("flows") * 0.30 / k.s
    return [
        hit(out & (c("bgp_flows") > 0), "bgp_peering_attempt", "dst_port_179_seen", "restricted_bgp"),
        hit(out & (c("geneve_flows") > 0), "geneve_underlay_attempt", "dst_port_6081_seen", "restricted_geneve"),
        hit(out & (c("metadata_flows") >= k.high(100)), "metadata_service_hammering", meta, "restricted_metadata_hammer"),
        hit(out & (c("metadata_flows") >= k.high(30)) & (u >= k.ratio(0.60)), "metadata_probe_suspected", meta, "restricted_metadata_probe"),
        hit(out & (c("local_scan_hits") > 0), "restricted_network_probe", "traffic_to_host_or_link_local", "restricted_local_scan"),
        hit(
            out & (c("infra_hits") > 0) & (c("unreplied_ratio") >= k.ratio(0.80)) & share,
            "lateral_probe_suspected", "high_unreplied_local_flows", "restricted_lateral_probe",
        ),
        hit(out & (c("infra_hits") > 0), "restricted_network_probe", "traffic_to_infrastructure", "restricted_infra_probe"),
    ]


def dark(k: Scaler) -> list[Column]:
    kind = F.when(c("direction") == "inbound", "inbound_darkspace_port_detected").otherwise("darkspace_port_detected")
    loud = (c("dark_flows") > 0) & (c("unreplied_ratio") >= k.ratio(0.80)) & (c("dark_flows") >= k.high(20))
    return [
        hit(loud, kind, F.format_string("unmonitored_flows_%d_unreplied_%.2f", "dark_flows", "unreplied_ratio"), "darkspace_unreplied"),
        hit(c("dark_flows") >= k.high(50), kind, F.format_string("unmonitored_flows_%d", "dark_flows"), "darkspace_total"),
    ]


def protocol(k: Scaler) -> list[Column]:
    out, u = c("direction") == "outbound", c("unreplied_ratio")
    spam = (
        (c("smtp_flows") >= k.high(50)) & c("top_port").isin(*scalars.SMTP) & (c("unique_remotes") >= k.high(20)) & (u >= k.ratio(0.30))
        & ((c("mode") == "dominant_port") | (c("port_share") >= k.above(0.70)))
    )
    mining = (c("stratum_flows") >= k.high(2)) & c("top_port").isin(*scalars.STRATUM) & (c("unique_remotes") <= k.high(10))
    tunnel = c("accounting") & (c("top_port") == 53) & (c("udp") > k.high(10)) & (c("bytes_per_flow") > k.above(3000)) & (u >= k.ratio(0.60))
    fan = (c("udp") > k.high(100)) & (u >= k.ratio(0.90)) & (c("unique_remotes") >= k.high(50))
    f = F.format_string
    return [
        hit(out & spam, "smtp_spam_behavior_suspected", f("smtp_flows_%d_remotes_%d_unreplied_%.2f", "smtp_flows", "unique_remotes", u), "proto_smtp_spam"),
        hit(
            out & mining, "outbound_stratum_mining_suspected",
            f("stratum_flows_%d_port_%d_remotes_%d", "stratum_flows", "top_port", "unique_remotes"), "proto_stratum_mining",
        ),
        hit(
            out & tunnel, "outbound_dns_tunneling_suspected",
            f("port_53_avg_bytes_%.0f_udp_%d_unreplied_%.2f", "bytes_per_flow", "udp", u), "proto_dns_tunnel",
        ),
        hit(out & fan, "outbound_udp_fanout_suspected", f("remotes_%d_unreplied_%.2f", "unique_remotes", u), "proto_udp_fanout"),
    ]


def scan(k: Scaler) -> list[Column]:
    gate = (c("direction") == "outbound") & (c("flows") >= k.high(20)) & (c("unreplied_ratio") >= k.ratio(0.60))
    one, f, rule = c("mode") == "dominant_remote", F.format_string, "legacy_scan"
    return [
        hit(
            gate & (c("mode") == "dominant_port") & (c("unique_remotes") >= k.high(20)) & (c("top_port") != 0),
            "outbound_horizontal_scan_suspected", f("many_remotes_single_port_unreplied_ratio_%.2f", "unreplied_ratio"), rule,
        ),
        hit(gate & one & (c("unique_ports") >= k.high(20)), "outbound_vertical_scan_suspected", f("many_ports_single_remote_ports_%d", "unique_ports"), rule),
        hit(
            gate & one & (c("remote_share") >= k.above(0.90)) & (c("flows") >= k.high(200)),
            "outbound_single_remote_flood", f("dominant_remote_share_%.2f", "remote_share"), rule,
        ),
        hit(
            gate & (c("signal") >= k.anomaly(0.80)) & (c("unique_remotes") >= k.high(30)),
            "outbound_distributed_fanout_unreplied", "deviation_from_baseline", rule,
        ),
    ]


def attack(k: Scaler) -> list[Column]:
    gate = (c("direction") == "inbound") & (c("flows") >= k.high(20)) & (c("unreplied_ratio") >= k.ratio(0.60))
    one, many, f, rule = c("mode") == "dominant_remote", c("mode") == "dominant_port", F.format_string, "legacy_inbound_attack_patterns"
    spray = F.when(many, "inbound_service_spray_suspected").otherwise("inbound_distributed_probe_suspected")
    flood = F.when(many, "inbound_udp_targeted_flood_suspected").otherwise("inbound_udp_flood_suspected")
    return [
        hit(gate & (c("new_remotes") >= k.high(20)) & (c("unique_ports") <= k.high(4)), spray, "rapid_new_remote_ips", rule),
        hit(
            gate & one & (c("unique_ports") >= k.high(10)), "inbound_single_remote_multiport_probe_suspected",
            f("many_ports_single_remote_ports_%d", "unique_ports"), rule,
        ),
        hit(
            gate & one & (c("remote_share") >= k.above(0.90)) & (c("flows") >= k.high(200)),
            "inbound_single_remote_flood", f("dominant_remote_share_%.2f", "remote_share"), rule,
        ),
        hit(gate & (c("udp") >= k.high(100)) & (c("unreplied_ratio") >= k.ratio(0.90)), flood, f("udp_unreplied_spike_count_%d", "udp"), rule),
    ]


def exposure(k: Scaler) -> list[Column]:
    top = c("top_port").isin(*scalars.ADMIN)
    share = c("admin_flows") / F.greatest(c("flows"), F.lit(1))
    loud = (c("new_remotes") >= k.high(10)) | (c("unique_remotes") >= k.high(20)) | (c("unreplied_ratio") >= k.ratio(0.60))
    when = (c("direction") == "inbound") & (c("admin_flows") > 0) & (c("public_remotes") > 0) & (top | (share >= k.above(0.50))) & loud
    reason = F.format_string(
        "admin_flows_%d_admin_ratio_%.2f_port_%d_public_remotes_%d", "admin_flows", share, F.when(top, c("top_port")).otherwise(0), "public_remotes"
    )
    return [hit(when, "inbound_admin_port_exposure_suspected", reason, "legacy_inbound_exposure")]


def capacity(k: Scaler) -> list[Column]:
    rule, impact = "legacy_capacity_and_flood", F.format_string("host_table_impact_%.2f%%", c("host_impact") * 100)
    limit = (c("threshold_flows") > 0) & (c("flows") > F.greatest(F.ceil(2 * c("threshold_flows") / k.s), F.lit(1)))
    gate = (c("host_impact") > k.above(0.10)) & (c("flows") > k.high(200))
    replied = c("accounting") & (c("unreplied_ratio") < k.ratio(0.2))
    low = lambda name, most: (c(name) > 0) & (c(name) < k.below(most))
    stale = replied & (low("bytes_per_flow", LOW_BYTES) | low("packets_per_flow", LOW_PACKETS))
    heavy = replied & ((c("bytes_per_flow") > k.above(HEAVY_BYTES)) | (c("packets_per_flow") > k.above(HEAVY_PACKETS)))
    return [
        hit(limit, "conntrack_flow_limit_exceeded", F.format_string("2x_configured_threshold_%d", "threshold_flows"), rule),
        hit(gate & (c("icmp") > k.high(50)), "host_icmp_flood_suspected", impact, rule),
        hit(gate & (c("multicast") > k.high(50)), "host_multicast_storm_suspected", impact, rule),
        hit(gate & (c("direction") == "inbound"), "inbound_conntrack_pressure", impact, rule),
        hit(gate & stale, "host_accumulating_stale_flows", "low_throughput_high_count", rule),
        hit(gate & heavy, "host_high_throughput_anomaly", "high_bytes_per_flow", rule),
        hit(gate, "host_conntrack_pressure", impact, rule),
    ]


def bands(k: Scaler) -> list[Column]:
    gate, reason = c("flows") >= k.high(10), F.format_string("signal_%.2f", "signal")
    kind = lambda band: F.concat(c("direction"), F.lit(f"_behavior_spike_{band}_suspected"))
    steps = (("critical", 0.90), ("high", 0.80), ("medium", 0.65), ("low", 0.50))
    return [hit(gate & (c("signal") >= k.anomaly(at)), kind(band), reason, "legacy_ewma_bands") for band, at in steps]


def first(hits: list[Column]) -> Column:
    return F.coalesce(*hits)


FAMILIES = {
    "restricted": restricted, "dark": dark, "protocol": protocol, "scan": scan, "attack": attack,
    "exposure": exposure, "capacity": capacity, "bands": bands,
}


def rule_flags(features: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Every rule on its own: a boolean column for each, family_number."""
    k = Scaler(config.s)
    return features.withColumns({f"{n}_{i}": h.isNotNull() for n, f in FAMILIES.items() for i, h in enumerate(f(k))})


def classify(features: DataFrame, external: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """features (with ``signal``) and kind, reason, rule_id, source, and the two synergy flags; kind is null without a hit.

    external is (host_id, instance, ip, direction, snapshot_ts, hit), as match_external gives it.
    """
    k = Scaler(config.s)
    out = features.withColumns({f"_{n}": first(f(k)) for n, f in FAMILIES.items()})
    if external is not None:
        out = out.join(external.withColumnRenamed("hit", "_external"), ["host_id", "instance", "ip", "direction", "snapshot_ts"], "left")
    else:
        out = out.withColumn("_external", F.lit(None).cast(HIT))

    def both(kind: str, other: str, rule: str) -> Column:
        return hit(c("_dark").isNotNull() & c(other).isNotNull(), kind, F.concat(c("_dark.reason"), F.lit(" | "), c(f"{other}.reason")), rule)

    won = first([
        c("_restricted"), both("darkspace_plus_physics", "_protocol", "synergy_darkspace_plus_physics"),
        both("darkspace_plus_scan", "_scan", "synergy_darkspace_plus_scan"),
        c("_dark"), c("_scan"), c("_protocol"), c("_attack"), c("_exposure"), c("_capacity"), c("_bands"), c("_external"),
    ])
    free = c("_restricted").isNull() & c("_dark").isNotNull()
    out = out.withColumns({"_won": won, "synergy_scan": free & c("_scan").isNotNull(), "synergy_physics": free & c("_protocol").isNotNull()})
    inner = [f"_{n}" for n in FAMILIES] + ["_external", "_won"]
    return out.withColumns({n: c(f"_won.{n}") for n in ("kind", "reason", "rule_id", "source")}).drop(*inner)


def match_external(features: DataFrame, ports: DataFrame, rules: DataFrame) -> DataFrame:
    """The first user rule of each feature row. rules is bounded (100 compiled rules) and goes to every task.

    rules: rule_order, rule_id, kind, reason, direction, ports array<int>, flows_min, remotes_min, unreplied_min,
    mode, remote_share_min, port_share_min. ports is by_port of the same events.
    """
    key = ["host_id", "instance", "ip", "direction", "snapshot_ts"]
    seen = ports.groupBy(*key).agg(F.collect_set("port").alias("seen_ports"))
    f = features.join(seen, key, "left")
    r = F.broadcast(rules.limit(100))
    fits = (
        F.expr("rule_direction = 'any' or rule_direction = direction")
        & ((F.size("ports") == 0) | F.arrays_overlap(F.coalesce("seen_ports", F.array(c("top_port").cast("int"))), c("ports")))
        & (c("flows") >= c("flows_min")) & (c("unique_remotes") >= c("remotes_min")) & (c("unreplied_ratio") >= c("unreplied_min"))
        & ((c("rule_mode") == "any") | (c("rule_mode") == c("mode")))
        & (c("remote_share") >= c("remote_share_min")) & (c("port_share") >= c("port_share_min"))
    )
    won = F.struct(c("rule_kind").alias("kind"), c("rule_reason").alias("reason"), "rule_id", F.lit("external").alias("source"))
    return f.join(r, fits).groupBy(*key).agg(F.min_by(won, "rule_order").alias("hit"))
