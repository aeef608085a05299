"""Scores: projections over feature rows, resource samples and threat counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, IDENTITY, Config
from ..functions.scalars import clamp, half_away, ratio


def c(name: str) -> Column:
    return F.col(name)


def alert_severity() -> Column:
    """0-100 of a feature row."""
    share = lambda n: F.when(c("flows") > 0, clamp(c(n) / c("flows")) * 100).otherwise(0.0)
    policy = F.greatest(
        share("infra_max_flows"), share("local_scan_hits"), share("metadata_flows"),
        F.when((c("bgp_flows") > 0) | (c("geneve_flows") > 0), 100.0).otherwise(0.0),
        F.when(c("direction") == "inbound", share("admin_flows")).otherwise(0.0),
    )
    impact = clamp(F.round(c("host_impact") * 100, 5) / 10) * 100
    flows = clamp(F.log10(1.0 + c("flows")) / 3) * 100
    total = 0.35 * impact + 0.30 * flows + 0.20 * clamp(c("unreplied_ratio")) * 100 + 0.15 * policy
    return half_away(clamp(total, 0, 100)).cast("int")


def alert_confidence(hits: Column) -> Column:
    dominance = F.greatest(c("remote_share"), c("port_share")) * 100
    fresh = F.greatest(ratio(c("new_remotes"), c("unique_remotes")), ratio(c("new_ports"), c("unique_ports"))) * 100
    base = 0.55 * dominance + 0.20 * fresh + 0.25 * clamp(hits / 3) * 100
    base = F.when((c("mode") == "distributed") & (dominance < 40), base * 0.85).otherwise(base)
    probe = c("kind").isin("restricted_network_probe", "lateral_probe_suspected") & ((c("infra_hits") > 0) | (c("local_scan_hits") > 0))
    floor = (
        F.when(probe, 70.0).when(c("kind").isin("bgp_peering_attempt", "geneve_underlay_attempt"), 80.0)
        .when(c("kind").isin("metadata_probe_suspected", "metadata_service_hammering"), 75.0).otherwise(0.0)
    )
    bonus = F.when(c("synergy_scan"), 15.0).otherwise(0.0) + F.when(c("synergy_physics"), 25.0).otherwise(0.0)
    return half_away(clamp(F.greatest(base, floor) + bonus, 0, 100)).cast("int")


def severity_band(sev: Column) -> Column:
    return F.when(sev >= 85, "critical").when(sev >= 65, "high").when(sev >= 35, "medium").otherwise("low")


def priority(sev: Column, conf: Column) -> Column:
    return (
        F.when((sev >= 75) & (conf >= 75), "P1")
        .when(((sev >= 75) & (conf >= 50)) | ((sev >= 50) & (conf >= 75)), "P2")
        .when(((sev >= 50) & (conf >= 50)) | ((sev >= 75) & (conf >= 25)) | ((sev >= 25) & (conf >= 75)), "P3")
        .otherwise("P4")
    )


def priority_basis(sev: Column, conf: Column) -> Column:
    return F.when((sev >= 75) & (conf < 50), "severity").when((conf >= 75) & (sev < 50), "confidence").otherwise("mixed")


def persistence(hits: DataFrame, config: Config = DEFAULT, key: list[str] = IDENTITY) -> DataFrame:
    """Adds hits: how many times in a row an identity's kind has fired, gaps up to the limit allowed. key may add the island of presence."""
    order = Window.partitionBy(*key, "kind").orderBy("snapshot_ts")
    gap = F.unix_timestamp("snapshot_ts") - F.unix_timestamp(F.lag("snapshot_ts").over(order))
    island = F.sum(F.when(gap > config.persist_gap_s, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return hits.withColumn("_island", island).withColumn("hits", F.row_number().over(Window.partitionBy(*key, "kind", "_island").orderBy("snapshot_ts"))).drop("_island")


def score_alerts(classified: DataFrame, config: Config = DEFAULT, key: list[str] = IDENTITY) -> DataFrame:
    """Rule hits with their scores, priority and the hits they need."""
    out = persistence(classified.where("kind is not null"), config, key)
    out = out.withColumns({"severity_score": alert_severity(), "confidence_score": alert_confidence(c("hits"))})
    sev, conf = c("severity_score"), c("confidence_score")
    out = out.withColumns({"severity_band": severity_band(sev), "priority": priority(sev, conf), "priority_basis": priority_basis(sev, conf)})
    return out.withColumn("required", F.when(c("priority").isin("P1", "P2"), 2).otherwise(3))


def behavior_signal(impact: Column, signal: Column, prio: Column) -> Column:
    """0-1; a rule hit's priority sets a floor."""
    floor = F.when(prio == "P1", 1.0).when(prio == "P2", 0.7).when(prio == "P3", 0.5).otherwise(0.0)
    return F.greatest(clamp(clamp(F.log10(1 + 9 * impact)) + signal), floor)


def behavior_score(outbound: Column, inbound: Column, out_on: bool = True, in_on: bool = True) -> Column:
    on = [x for x, y in ((outbound, out_on), (inbound, in_on)) if y]
    return clamp(sum(on, F.lit(0.0)) / max(1, len(on))) * 100


def ip_signal(identities: DataFrame) -> DataFrame:
    """identities with behavior_signal -> the worst outbound and inbound one of each machine and its score."""
    worst = lambda d: F.coalesce(F.max(F.when(c("direction") == d, c("behavior_signal"))), F.lit(0.0))
    got = identities.groupBy("host_id", "instance", "snapshot_ts").agg(worst("outbound").alias("out_signal"), worst("inbound").alias("in_signal"))
    return got.withColumn("behavior_score", behavior_score(c("out_signal"), c("in_signal")))


def cpu_pressure(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "cpu_p": F.greatest(clamp((c("steal_percent") + c("wait_percent")) / 50), 0.3 * clamp(c("cpu_percent") / 100)),
        "cpu_conf": F.lit(1.0),
        "cpu_impact": clamp(F.log1p(c("vcpus")) / F.log1p(F.lit(16.0))),
    })


def mem_pressure(df: DataFrame) -> DataFrame:
    """df: used_mb, mem_mb, swap_in_rate, major_faults_rate."""
    ramp = lambda x, low, high: clamp((x - low) / (high - low))
    usage = F.when((c("used_mb") > 0) & (c("mem_mb") > 0), ramp(F.least(c("used_mb") / c("mem_mb"), F.lit(1.5)), 0.80, 1.50)).otherwise(0.0)
    return df.withColumns({
        "mem_p": F.greatest(usage, ramp(c("swap_in_rate"), 1024, 16384), ramp(c("major_faults_rate"), 5, 200)),
        "mem_conf": F.when(c("mem_mb") > 0, F.when(c("used_mb") > 0, 1.0).otherwise(0.5)).otherwise(0.0),
        "mem_impact": clamp(F.log1p(c("mem_mb")) / F.log1p(F.lit(32768.0))),
    })


def disk_axis(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "disk_p": clamp(c("disk_signal") / 100), "disk_conf": clamp(c("disk_activity")), "disk_impact": clamp(c("disk_activity")),
    })


def net_pressure(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """df: pps, drop_ratio, flows, table_max."""
    limit = F.when(c("table_max") > 0, c("table_max")).otherwise(config.table_max_default)
    share = F.when(c("flows") > 0, c("flows") / limit).otherwise(0.0)
    drop = F.when(c("drop_ratio") > 1e-4, clamp(F.log10(c("drop_ratio") / 1e-4) / 2)).otherwise(0.0)
    return df.withColumns({
        "net_p": F.greatest(drop, clamp((share - 0.01) / 0.09)),
        "net_conf": F.greatest(clamp(c("pps") / 1000), F.when(c("flows") > 0, 1.0).otherwise(0.0)),
        "net_impact": F.greatest(clamp(F.log1p(c("pps")) / F.log1p(F.lit(20000.0))), clamp(share / 0.10)),
    })


def threat_signal(per_list: DataFrame) -> DataFrame:
    """per_list (host_id, snapshot_ts, instance, list, hits) -> instant: one less the product of what is left."""
    left = F.aggregate(F.collect_list(1 - clamp(c("hits") / 10)), F.lit(1.0), lambda a, x: a * x)
    return per_list.groupBy("host_id", "snapshot_ts", "instance").agg((1 - left).alias("instant"))


def attention(resource: Column, running: Column, behavior: Column, threat: Column, threats_on: bool = True, config: Config = DEFAULT) -> Column:
    """Weighted mean over the parts that are active."""
    parts = [
        (resource, F.when(running, config.weight_resource).otherwise(0.0)),
        (behavior, F.lit(config.weight_behavior)),
        (threat, F.lit(config.weight_threat if threats_on else 0.0)),
    ]
    total = sum((w for _, w in parts), F.lit(0.0))
    return F.when(total > 0, clamp(sum((x * w for x, w in parts), F.lit(0.0)) / total, 0, 100)).otherwise(0.0)


def resource_events(scored: DataFrame) -> DataFrame:
    """Rows at which the band, top axis or cap changes, or the streak lifts the cap, from 30 on."""
    order = Window.partitionBy("host_id", "instance").orderBy("ts")
    was = lambda n: F.lag(n).over(order)
    changed = [F.coalesce(c(n) != was(n), F.lit(n != "cap_active") | c("cap_active").cast("boolean")) for n in ("band", "top_axis", "cap_active")]
    return scored.withColumn("_changed", changed[0] | changed[1] | changed[2] | c("persistence_triggered")).where("_changed and overall >= 30").drop("_changed")
