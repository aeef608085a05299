"""Every operator as a query over the given tables, and its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import ip as addr
from ..functions import scalars
from ..operators import attribution, catalogue, classifier, deltas, features, fleet, folds, scoring, sinks, threat
from ..sources.builtin_ports import BUILTIN
from . import adapters, metric_frames, oracle, oracle_state
from .adapters import ComingAndGoing, Fleet, plain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
ID = oracle.ID
IDENT = ["host_id", "instance", "ip", "direction", "snapshot_ts"]


def query(sql: str | None = None, raw: bool = False, places: int = 4, fleet: type[Fleet] = Fleet, config: Config = DEFAULT):
    def add(f: Callable[[Fleet], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            got = f(fleet(spark, sf_dir, config))
            return got if raw else plain(got, places=places)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = oracle.coming_and_going(sql) if fleet is ComingAndGoing else oracle.with_tables(sql)
        return f

    return add


# ---- sources and attribution ------------------------------------------------------------


@query("SELECT host_id, ts, count(*) AS flows, CAST(sum(fwd_bytes + rev_bytes) AS BIGINT) AS bytes FROM flows GROUP BY host_id, ts")
def scan_flow_snapshot(f):
    return f.flows.groupBy("host_id", "snapshot_ts").agg(F.count("*").alias("flows"), F.sum(F.col("fwd_bytes") + F.col("rev_bytes")).alias("bytes"))


@query("SELECT host_id, ts, zone_src, zone_dst, count(*) AS flows FROM attr GROUP BY host_id, ts, zone_src, zone_dst")
def join_flow_zone_attribution(f):
    return attribution.by_zone(f.flows, f.zone_ips).groupBy("host_id", "snapshot_ts", "zone_src", "zone_dst").agg(F.count("*").alias("flows"))


@query("SELECT host_id, ts, src_inst, dst_inst, count(*) AS flows FROM attr GROUP BY host_id, ts, src_inst, dst_inst")
def join_flow_unique_ip_fallback(f):
    return f.attributed.groupBy("host_id", "snapshot_ts", "src_inst", "dst_inst").agg(F.count("*").alias("flows"))


@query("SELECT host_id, ts, count(*) AS flows FROM attr WHERE src_inst IS NULL AND dst_inst IS NULL GROUP BY host_id, ts")
def flow_unattributed(f):
    return attribution.unattributed(f.attributed).groupBy("host_id", "snapshot_ts").agg(F.count("*").alias("flows"))


@query(f"SELECT {ID}, count(*) AS events, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(packets) AS BIGINT) AS packets FROM ev GROUP BY {ID}")
def flow_to_identity_events(f):
    return f.events.groupBy(*IDENT).agg(F.count("*").alias("events"), F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"))


@query("SELECT DISTINCT host_id, instance, ip FROM inst")
def distinct_identities(f):
    return attribution.distinct_identities(f.instance_ips)


@query("SELECT f.host_id, f.ts, count(*) AS flows FROM flows f JOIN (SELECT DISTINCT host_id, ip FROM inst WHERE vcpus > 4) i ON i.host_id = f.host_id AND i.ip = f.src_ip GROUP BY f.host_id, f.ts")
def join_active_instances(f):
    active = attribution.active_only(f.instance_ips, f.instances.where("vcpus > 4")).select("host_id", F.col("ip").alias("src_ip")).distinct()
    return f.flows.join(active, ["host_id", "src_ip"], "left_semi").groupBy("host_id", "snapshot_ts").agg(F.count("*").alias("flows"))


@query("SELECT e.host_id, e.instance, i.server_name, i.project, i.owner, count(*) AS events FROM ev e JOIN inst i ON i.instance = e.instance GROUP BY 1, 2, 3, 4, 5")
def join_inventory_labels(f):
    labels = f.instances.select("instance", "server_name", "project", "owner")
    return f.events.groupBy("host_id", "instance").agg(F.count("*").alias("events")).join(labels, "instance").select("host_id", "instance", "server_name", "project", "owner", "events")


@query("SELECT host_id, zone, count(*) AS ips, count(DISTINCT instance) AS instances FROM inst GROUP BY host_id, zone")
def zone_port_ips(f):
    return f.zone_ips.groupBy("host_id", "zone").agg(F.count("*").alias("ips"), F.count_distinct("instance").alias("instances"))


@query("SELECT host_id, sum(CASE WHEN src_ip BETWEEN 167772160 AND 184549375 THEN 1 ELSE 0 END) AS private_src, sum(CASE WHEN dst_ip BETWEEN 3758096384 AND 4026531839 THEN 1 ELSE 0 END) AS multicast_dst, sum(CASE WHEN dst_ip = 2852039166 THEN 1 ELSE 0 END) AS metadata_dst, sum(CASE WHEN dst_ip BETWEEN 2851995648 AND 2852061183 OR dst_ip BETWEEN 3758096384 AND 4026531839 THEN 1 ELSE 0 END) AS local_dst, count(*) AS v4 FROM flows GROUP BY host_id")
def address_classes(f):
    src, dst, n = F.col("src_ip"), F.col("dst_ip"), F.count_if
    return f.flows.groupBy("host_id").agg(
        n(addr.is_private_or_local(src) & ~addr.is_local_only(src)).alias("private_src"), n(addr.is_multicast(dst)).alias("multicast_dst"),
        n(addr.is_metadata_service(dst)).alias("metadata_dst"), n(addr.is_local_only(dst)).alias("local_dst"), n(addr.is_v4_mapped(src)).alias("v4"),
    )


@query("SELECT host_id, count(*) AS flows, count(DISTINCT (a_ip, a_port, b_ip, b_port, proto)) AS pairs FROM (SELECT host_id, least(src_ip * 65536 + src_port, dst_ip * 65536 + dst_port) // 65536 AS a_ip, least(src_ip * 65536 + src_port, dst_ip * 65536 + dst_port) % 65536 AS a_port, greatest(src_ip * 65536 + src_port, dst_ip * 65536 + dst_port) // 65536 AS b_ip, greatest(src_ip * 65536 + src_port, dst_ip * 65536 + dst_port) % 65536 AS b_port, proto FROM flows) GROUP BY host_id")
def flow_pair_key(f):
    pair = scalars.flow_pair(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"), F.col("proto"))
    return f.flows.select("host_id", pair.alias("p")).groupBy("host_id", "p").count().groupBy("host_id").agg(F.sum("count").alias("flows"), F.count("*").alias("pairs"))


@query("SELECT host_id, ts, CASE WHEN s AND NOT d THEN 'out' WHEN d AND NOT s THEN 'in' ELSE 'any' END AS direction, count(*) AS flows FROM (SELECT host_id, ts, src_ip IN (SELECT ip FROM inst) AS s, dst_ip IN (SELECT ip FROM inst) AS d FROM flows) GROUP BY 1, 2, 3")
def flow_direction(f):
    ips = f.instances.select("ip").distinct()
    rows = f.flows
    for side in ("src", "dst"):
        rows = rows.join(ips.select(F.col("ip").alias(f"{side}_ip"), F.lit(True).alias(side)), f"{side}_ip", "left")
    own = lambda c: F.coalesce(c, F.lit(False))
    return rows.groupBy("host_id", "snapshot_ts", scalars.flow_direction(own("src"), own("dst")).alias("direction")).agg(F.count("*").alias("flows"))


@query("SELECT host_id, sum(CASE WHEN rev_packets > 0 THEN 1 ELSE 0 END) AS seen_reply, sum(CASE WHEN fwd_packets > 0 AND rev_packets > 0 THEN 1 ELSE 0 END) AS assured, sum(CASE WHEN rev_packets = 0 THEN 1 ELSE 0 END) AS unreplied, CAST(sum(fwd_bytes + rev_bytes) AS BIGINT) AS bytes FROM flows GROUP BY host_id")
def flow_status_volume(f):
    r, w, n = F.col("rev_packets"), F.col("fwd_packets"), F.count_if
    return f.flows.groupBy("host_id").agg(n(r > 0).alias("seen_reply"), n((w > 0) & (r > 0)).alias("assured"), n(r == 0).alias("unreplied"), F.sum(F.col("fwd_bytes") + F.col("rev_bytes")).alias("bytes"))


@query("SELECT host_id, ts, count(*) AS flows, sum(CASE WHEN proto = 6 THEN 1 ELSE 0 END) AS tcp FROM flows GROUP BY host_id, ts")
def union_families(f):
    from ..sources import ingest

    both = ingest.union_families(f.flows.where("proto = 6"), f.flows.where("proto <> 6"))
    return both.groupBy("host_id", "snapshot_ts").agg(F.count("*").alias("flows"), F.count_if(F.col("proto") == 6).alias("tcp"))


# ---- aggregations ------------------------------------------------------------------------


@query("SELECT host_id, ts, instance, flows FROM totals")
def agg_instance_flow_totals(f):
    return f.totals


@query("SELECT i.host_id, s.ts, i.instance, i.ip, coalesce(e.flows_in, 0) AS flows_in, coalesce(e.flows_out, 0) AS flows_out, coalesce(e.flows_in + e.flows_out, 0) AS flows_total FROM (SELECT DISTINCT host_id, instance, ip FROM inst) i JOIN (SELECT DISTINCT host_id, ts FROM flows) s ON s.host_id = i.host_id LEFT JOIN (SELECT host_id, ts, instance, ip, sum(CASE WHEN direction = 'inbound' THEN 1 ELSE 0 END) AS flows_in, sum(CASE WHEN direction = 'outbound' THEN 1 ELSE 0 END) AS flows_out FROM ev GROUP BY host_id, ts, instance, ip) e ON e.host_id = i.host_id AND e.ts = s.ts AND e.instance = i.instance AND e.ip = i.ip")
def agg_ip_flows(f):
    return attribution.ip_flows(f.events, f.instance_ips, f.flows).select("host_id", "snapshot_ts", "instance", "ip", "flows_in", "flows_out", "flows_total")


@query(f"SELECT {ID}, flows, unreplied, CAST(bytes AS BIGINT) AS bytes, CAST(packets AS BIGINT) AS packets, multicast, icmp, udp FROM stats")
def agg_behavior_stats(f):
    return features.stats(f.remotes).select(*IDENT, "flows", "unreplied", "bytes", "packets", "multicast", "icmp", "udp")


@query(f"SELECT {ID}, unique_remotes, unique_remotes >= 32768 AS unique_remotes_saturated, unique_remotes > 32768 AS remote_map_capped FROM stats")
def agg_unique_remotes(f):
    return features.unique_remotes(f.remotes, f.config)


@query(f"SELECT {ID}, unique_ports, bgp_flows, geneve_flows, smtp_flows, stratum_flows, admin_flows FROM groups")
def agg_port_groups(f):
    return features.port_groups(f.ports)


@query(f"SELECT {ID}, count(DISTINCT nullif(port, 0)) AS unique_ports FROM ev GROUP BY {ID} HAVING count(nullif(port, 0)) > 0")
def agg_unique_dst_ports(f):
    return features.port_groups(f.ports).select(*IDENT, "unique_ports")


@query(f"SELECT {ID}, top_remote, max_single_remote FROM top_remote")
def agg_top_remote(f):
    return features.top_remote(f.remotes)


@query(f"SELECT {ID}, top_port, max_single_port FROM top_port")
def agg_top_dst_port(f):
    return features.top_port(f.ports)


@query(f"SELECT {ID}, rank, flows FROM (SELECT *, row_number() OVER (PARTITION BY {ID} ORDER BY flows DESC, remote) AS rank FROM rem) WHERE rank <= 5")
def agg_top_remote_approx(f):
    # the sketch is exact while an identity has fewer remotes than it holds items; which of equal remotes it lists is open
    top = features.top_remotes_sketch(f.events, k=5, items=10_000)
    return top.select(*IDENT, F.posexplode("top").alias("n", "t")).select(*IDENT, (F.col("n") + 1).alias("rank"), F.col("t.count").alias("flows"))


_NAMED = ", ".join(f"('{d}', {p}, '{n}')" for d, ports in BUILTIN.items() for p, n in ports.items())


@query(f"SELECT {ID}, p.port, flows, coalesce(name, '') AS port_name FROM prt p LEFT JOIN (SELECT * FROM (VALUES {_NAMED}) v(d, port, name)) m ON m.d = p.direction AND m.port = p.port")
def port_name(f):
    return features.port_names(f.ports, f.monitored).select(*IDENT, "port", "flows", "port_name")


@query(f"SELECT {ID}, public_remotes, metadata_flows, round(metadata_unreplied_ratio, 4) AS metadata_unreplied_ratio, infra_hits, infra_max_flows, local_scan_hits FROM policy")
def agg_public_infra_local_metadata(f):
    return features.policy(f.remotes, f.host_ips).select(*IDENT, "public_remotes", "metadata_flows", "metadata_unreplied_ratio", "infra_hits", "infra_max_flows", "local_scan_hits")


@query("SELECT * FROM (SELECT host_id, instance, ip, direction, ts, port, flows FROM darkp)")
def join_monitored_ports(f):
    return features.unmonitored(f.ports, f.monitored).select(*IDENT, "port", "flows")


@query(f"SELECT {ID}, dark_flows, dark_ports, top_dark_port, max_single_dark_port FROM dark")
def agg_darkspace(f):
    return features.darkspace(f.ports, f.monitored).select(*IDENT, "dark_flows", "dark_ports", "top_dark_port", "max_single_dark_port")


@query(f"SELECT {ID}, round(unreplied_ratio, 4) AS unreplied_ratio, round(bytes_per_flow, 4) AS bytes_per_flow, round(packets_per_flow, 4) AS packets_per_flow, round(host_impact, 4) AS host_impact, round(remote_share, 4) AS remote_share, round(port_share, 4) AS port_share, mode FROM featm")
def agg_flow_ratios(f):
    return f.features.select(*IDENT, "unreplied_ratio", "bytes_per_flow", "packets_per_flow", "host_impact", "remote_share", "port_share", "mode")


@query("SELECT host_id, ts, count(*) AS entries, 500 AS table_max, round(count(*) / 500.0, 4) AS utilization FROM flows GROUP BY host_id, ts")
def agg_host_conntrack(f):
    return attribution.host_conntrack(f.flows, f.table_max).select("host_id", "snapshot_ts", "entries", "table_max", "utilization")


@query("SELECT host_id, count(DISTINCT instance) AS active_vms, sum(vcpus) AS active_vcpus, count(DISTINCT project) AS active_projects, count(*) AS active_disks, count(DISTINCT (instance, ip)) AS active_fixed_ips FROM inst GROUP BY host_id")
def agg_host_rollup(f):
    disks = f.instances.select("host_id", "instance", F.lit("vda").alias("path"))
    return fleet.host_rollup(f.instances, disks, f.instance_ips).select("host_id", "active_vms", "active_vcpus", "active_projects", "active_disks", "active_fixed_ips")


@query("SELECT project, owner, count(*) AS machines, sum(vcpus) AS vcpus, sum(mem_mb) AS allocated_mb, sum(used_mb) AS used_mb FROM inst GROUP BY ROLLUP (project, owner)")
def agg_project_showback(f):
    return fleet.showback(f.instances)


@query("SELECT host_id, instance, ts, CAST(sum(counter * 7) AS BIGINT) AS steal_ns, CAST(sum(counter * 3) AS BIGINT) AS wait_ns FROM (SELECT *, UNNEST([0, 1]) AS vcpu FROM counters) GROUP BY host_id, instance, ts")
def agg_vcpu_steal_wait(f):
    rows = f.counters.select("host_id", "instance", "ts", F.explode(F.array(F.lit(0), F.lit(1))).alias("vcpu"), (F.col("counter") * 7).alias("delay"), (F.col("counter") * 3).alias("wait"))
    return deltas.vcpu_steal_wait(rows)


@query("SELECT host_id, instance, ts, CAST(sum(counter * 12) AS BIGINT) AS packets, CAST(sum(counter * 2) AS BIGINT) AS drops FROM (SELECT *, UNNEST(['tap0', 'tap1']) AS iface FROM counters) WHERE iface = 'tap0' OR user_id % 3 = 0 GROUP BY host_id, instance, ts")
def agg_net_totals(f):
    rows = f.counters.select("host_id", "instance", "ts", F.explode(F.array(F.lit("tap0"), F.lit("tap1"))).alias("iface"), (F.col("counter") * 5).alias("rx_packets"), (F.col("counter") * 7).alias("tx_packets"), F.col("counter").alias("rx_drops"), F.col("counter").alias("tx_drops"))
    machines = f.counters.select("instance", "user_id").distinct()
    known = machines.select("instance", F.lit("tap0").alias("iface")).union(machines.where("user_id % 3 = 0").select("instance", F.lit("tap1")))
    return deltas.net_totals(rows, known)


# ---- windows -----------------------------------------------------------------------------


@query(f"SELECT {ID}, new_remotes, new_remotes >= 32768 AS new_remotes_saturated FROM newr")
def win_new_remotes(f):
    return features.new_remotes(f.remotes, f.config)


@query(f"SELECT {ID}, new_ports FROM newp")
def win_new_dst_ports(f):
    return features.new_ports(f.ports, f.remotes, f.config)


@query(f"SELECT {ID}, ports - new_ports AS kept_ports FROM newp")
def intersect_port_overlap(f):
    return features.port_overlap(f.ports, f.remotes, f.config)


@query("SELECT host_id, ts, instance, remote FROM (SELECT DISTINCT host_id, ts, instance, remote FROM ev) c WHERE NOT EXISTS (SELECT 1 FROM ev p WHERE p.host_id = c.host_id AND p.instance = c.instance AND p.remote = c.remote AND p.ts = c.ts - 15)")
def except_prev_set(f):
    now = f.events.select("host_id", "instance", "remote", "snapshot_ts").distinct()
    before = now.withColumn("snapshot_ts", F.timestamp_seconds(F.unix_timestamp("snapshot_ts") + 15))
    return now.join(before, ["host_id", "instance", "remote", "snapshot_ts"], "left_anti").select("host_id", "snapshot_ts", "instance", "remote")


_CPU = oracle_state.CPU


@query(f"SELECT host_id, instance, ts, counter, round({_CPU.format(n=400000000)}, 4) AS cpu_percent, round({_CPU.format(n=30000000)}, 4) AS steal_percent, round({_CPU.format(n=9000000)}, 4) AS wait_percent FROM lagged")
def win_cpu_usage(f):
    return f.cpu.select("host_id", "instance", "ts", (F.col("cpu_ns") / 400000000).cast("long").alias("counter"), "cpu_percent", "steal_percent", "wait_percent")


@query("SELECT host_id, instance, ts, counter, round(coalesce(inc * 3 / nullif(dt, 0), 0), 4) AS rd_iops, round(coalesce(inc * 2 / nullif(dt, 0), 0), 4) AS wr_iops, CASE WHEN dt > 0 AND inc > 0 THEN 0.003 ELSE 0 END AS rd_latency, CASE WHEN dt > 0 AND inc > 0 THEN 0.011 ELSE 0 END AS wr_latency, CASE WHEN dt > 0 AND inc > 0 THEN 73728.0 ELSE 0 END AS avg_io_size, round(coalesce(inc * 368640.0 / nullif(dt, 0), 0), 2) AS bandwidth FROM lagged")
def win_disk_io(f):
    return f.disk.select("host_id", "instance", "ts", (F.col("rd_reqs") / 3).cast("long").alias("counter"), "rd_iops", "wr_iops", "rd_latency", "wr_latency", "avg_io_size", F.round("bandwidth", 2).alias("bandwidth"))


@query("SELECT host_id, instance, ts, counter, round(coalesce(inc * 5000.0 / nullif(dt, 0), 0), 3) AS swap_in_rate, round(coalesce(inc * 60.0 / nullif(dt, 0), 0), 4) AS major_faults_rate FROM lagged")
def win_mem_rates(f):
    return f.mem.select("host_id", "instance", "ts", (F.col("swap_in") / 5000).cast("long").alias("counter"), F.round("swap_in_rate", 3).alias("swap_in_rate"), "major_faults_rate")


@query("SELECT host_id, instance, ts, counter, round(coalesce(inc * 9000.0 / nullif(dt, 0), 0), 3) AS pps, round(CASE WHEN dt > 0 AND inc > 0 THEN 17.0 / 9000 ELSE 0 END, 4) AS drop_ratio FROM lagged")
def win_net_rates(f):
    return f.net.select("host_id", "instance", "ts", (F.col("packets") / 9000).cast("long").alias("counter"), F.round("pps", 3).alias("pps"), "drop_ratio")


@query("SELECT host_id, ts, round(CASE WHEN dt > 0 THEN (dt - di) * 100.0 / dt ELSE 0 END, 4) AS cpu_percent FROM (SELECT host_id, ts, total - lag(total) OVER w AS dt, idle - lag(idle) OVER w AS di FROM (SELECT host_id, ts, CAST(sum(n) OVER (PARTITION BY host_id ORDER BY ts) AS BIGINT) AS total, CAST(sum(i) OVER (PARTITION BY host_id ORDER BY ts) AS BIGINT) AS idle FROM (SELECT host_id, ts, count(*) AS n, sum(CASE WHEN rev_packets = 0 THEN 1 ELSE 0 END) AS i FROM flows GROUP BY host_id, ts)) WINDOW w AS (PARTITION BY host_id ORDER BY ts))")
def win_host_cpu_percent(f):
    own = Window.partitionBy("host_id").orderBy("snapshot_ts").rowsBetween(Window.unboundedPreceding, 0)
    per = f.flows.groupBy("host_id", "snapshot_ts").agg(F.count("*").alias("n"), F.count_if(F.col("rev_packets") == 0).alias("i"))
    rows = per.select("host_id", F.col("snapshot_ts").alias("ts"), F.sum("n").over(own).alias("total"), F.sum("i").over(own).alias("idle"))
    return deltas.host_cpu_percent(rows).select("host_id", F.col("ts").alias("snapshot_ts"), "cpu_percent")


_EW = ", ".join(f"round({n}_{k}, 3) AS {n}_{k}" for n in ("flows", "unique_remotes", "unique_ports", "unreplied_ratio") for k in ("fast", "slow"))


@query(f"SELECT {ID}, {_EW} FROM sig")
def win_flow_ewma(f):
    return f.scored.select(*IDENT, *(F.round(f"{n}_{k}", 3).alias(f"{n}_{k}") for n in ("flows", "unique_remotes", "unique_ports", "unreplied_ratio") for k in ("fast", "slow")))


@query(f"SELECT {ID}, {_EW}, round(signal, 3) AS signal FROM sig")
def win_flow_ewma_sliced(f):
    """The averages with each history cut into slices of a minute, whose maps are composed."""
    got = folds.flow_ewma_sliced(f.features, f.config, slice_s=60)
    return got.select(*IDENT, *(F.round(f"{n}_{k}", 3).alias(f"{n}_{k}") for n in ("flows", "unique_remotes", "unique_ports", "unreplied_ratio") for k in ("fast", "slow")), F.round("signal", 3).alias("signal"))


@query(f"SELECT {ID}, round(signal, 3) AS signal FROM sig")
def win_behavior_anomaly(f):
    return f.scored.select(*IDENT, F.round("signal", 3).alias("signal"))


@query(f"SELECT {ID}, kind, hits, CASE WHEN priority IN ('P1', 'P2') THEN 2 ELSE 3 END AS required FROM prio")
def win_alert_persistence(f):
    return f.alerts.select(*IDENT, "kind", "hits", "required")


@query(f"SELECT {ID}, kind, priority, hits, required, emitted, emit_reason, suppress_reason FROM gated")
def win_alert_emit_gate(f):
    return f.gated.select(*IDENT, "kind", "priority", "hits", "required", "emitted", "emit_reason", "suppress_reason")


@query("SELECT family, host_id, key, ts, events, delivered FROM throttled")
def win_event_throttle(f):
    listed = threat.host_listed(f.host_ips, f.threat_ips, f.threat_cidrs).join(f.flows.select("host_id", "snapshot_ts").distinct(), "host_id")
    sent = folds.throttle(sinks.notices(f.gated.where("emitted"), f.routed, listed), ["family", "host_id", "key"], "snapshot_ts", f.config)
    return sent.groupBy("family", "host_id", "key", "snapshot_ts").agg(F.count("*").alias("events"), F.count_if("delivered").alias("delivered"))


_AXES = [f"{a}_{c}" for a in ("cpu", "mem", "disk", "net") for c in ("ewma", "severity")]


@query(f"SELECT host_id, instance, ts AS at, {', '.join(f'round({c}, 4) AS {c}' for c in _AXES)} FROM res")
def win_resource_axis_ewma(f):
    return f.resources.select("host_id", "instance", F.col("ts").alias("at"), *_AXES)


@query("SELECT host_id, instance, ts AS at, round(overall_raw, 4) AS overall_raw, round(overall, 4) AS overall, axes90, streak, cap_active, persistence_triggered, top_axis, band FROM res")
def win_resource_cap_streak(f):
    return f.resources.select("host_id", "instance", F.col("ts").alias("at"), "overall_raw", "overall", "axes90", "streak", "cap_active", "persistence_triggered", "top_axis", "band")


@query("SELECT host_id, instance, ts AS at, round(overall, 4) AS overall, band, top_axis, cap_active FROM resev")
def win_resource_events(f):
    return scoring.resource_events(f.resources).select("host_id", "instance", F.col("ts").alias("at"), "overall", "band", "top_axis", "cap_active")


@query("SELECT host_id, instance, ts, round(instant, 4) AS instant, round(e, 4) AS intel_ewma, round(least(1, greatest(0, 0.5 * instant + 0.5 * e)), 4) AS intel_combined FROM intel")
def win_threat_intel_ewma(f):
    counts = threat.hit_counts(f.routed).select("host_id", "snapshot_ts", "instance", "list", F.col("active").alias("hits"))
    return folds.threat_intel(scoring.threat_signal(counts)).select("host_id", "instance", "snapshot_ts", "instant", "intel_ewma", "intel_combined")


@query("SELECT host_id, list, instance, ts, new_contacts, CAST(sum(new_contacts) OVER (PARTITION BY host_id, list, instance ORDER BY ts) AS BIGINT) AS contacts_total FROM (SELECT host_id, list, instance, ts, sum(CASE WHEN last IS NULL OR last <> no - 1 THEN 1 ELSE 0 END) AS new_contacts FROM (SELECT r.*, n.no, lag(n.no) OVER (PARTITION BY r.host_id, r.list, r.instance, a_ip, a_port, b_ip, b_port, proto ORDER BY n.no) AS last FROM routed r JOIN (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY ts) AS no FROM (SELECT DISTINCT host_id, ts FROM flows)) n ON n.host_id = r.host_id AND n.ts = r.ts) GROUP BY host_id, list, instance, ts)")
def win_threat_contacts_total(f):
    return threat.contacts(f.routed, f.flows).select("host_id", "list", "instance", "snapshot_ts", "new_contacts", "contacts_total")


_LOADS = "SELECT host_id, ts, count(*) AS n, count(*) % 3 <> 0 AS ok FROM flows GROUP BY host_id, ts"


@query(f"SELECT host_id, ts, ok, ts - coalesce(lag(ts) OVER w, ts) AS cycle_lag, coalesce(ts - max(CASE WHEN ok THEN ts END) OVER w, -1) AS stale_seconds FROM ({_LOADS}) WINDOW w AS (PARTITION BY host_id ORDER BY ts)")
def win_collection_lag_stale(f):
    loads = f.flows.groupBy("host_id", F.col("snapshot_ts").alias("ts")).agg((F.count("*") % 3 != 0).alias("ok"))
    return deltas.collection_lag(loads).select("host_id", F.col("ts").alias("snapshot_ts"), "ok", "cycle_lag", "stale_seconds")


@query("SELECT host_id, ts, CASE WHEN a AND b THEN 'ok' WHEN a OR b THEN 'partial' ELSE 'failed' END AS status FROM (SELECT host_id, ts, count(*) % 2 = 0 AS a, count(*) % 3 = 0 AS b FROM flows GROUP BY host_id, ts)")
def snapshot_partial_read(f):
    from ..sources import ingest

    n = f.flows.groupBy("host_id", "snapshot_ts").agg(F.count("*").alias("n"))
    family = lambda v, m: F.struct(F.lit(v).alias("family"), F.lit(True).alias("enabled"), (F.col("n") % m == 0).alias("ok"))
    return ingest.partial_reads(n.select("host_id", "snapshot_ts", F.inline(F.array(family(4, 2), family(6, 3)))))


@query("SELECT host_id, ts, src_inst, dst_inst, count(*) AS flows FROM attr a WHERE EXISTS (SELECT 1 FROM (SELECT host_id, ts, count(*) AS n FROM flows GROUP BY host_id, ts) s WHERE s.host_id = a.host_id AND s.ts = a.ts AND (n % 2 = 0 OR n % 3 = 0)) GROUP BY host_id, ts, src_inst, dst_inst")
def attribution_without_failed_reads(f):
    rows = attribution.usable(f.flows, snapshot_partial_read(f))
    return attribution.attribute(rows, f.zone_ips, f.instance_ips).groupBy("host_id", "snapshot_ts", "src_inst", "dst_inst").agg(F.count("*").alias("flows"))


@query(f"SELECT l.host_id, l.ts, i.instance FROM (SELECT host_id, ts, max(CASE WHEN ok THEN ts END) OVER (PARTITION BY host_id ORDER BY ts) AS good FROM ({_LOADS})) l JOIN (SELECT DISTINCT host_id, instance, vcpus FROM inst) i ON i.host_id = l.host_id WHERE l.good IS NOT NULL AND (i.vcpus + l.good) % 4 <> 0")
def last_good_active(f):
    """The machines that each load saw, or the last good one before a failed load."""
    loads = f.flows.groupBy("host_id", "snapshot_ts").agg((F.count("*") % 3 != 0).alias("ok"))
    seen = loads.select("host_id", "snapshot_ts").join(f.instances.select("host_id", "instance", "vcpus"), "host_id")
    return attribution.last_good_active(loads, seen.where((F.col("vcpus") + F.unix_timestamp("snapshot_ts")) % 4 != 0).drop("vcpus"))


@query("SELECT host_id, instance, ts, CAST(sum(CASE WHEN no - last > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY host_id, instance ORDER BY no) AS BIGINT) AS island FROM (SELECT *, lag(no) OVER (PARTITION BY host_id, instance ORDER BY no) AS last FROM (SELECT t.*, n.no FROM totals t JOIN (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY ts) AS no FROM (SELECT DISTINCT host_id, ts FROM flows)) n ON n.host_id = t.host_id AND n.ts = t.ts WHERE t.flows % 5 <> 0))")
def win_presence_islands(f):
    active = f.totals.where("flows % 5 <> 0").select("host_id", "snapshot_ts", "instance")
    return deltas.presence_islands(active, f.flows, ["host_id", "instance"]).select("host_id", "instance", "snapshot_ts", "island")


# ---- rules and scores --------------------------------------------------------------------


@query(f"SELECT {ID}, " + ", ".join(f"coalesce({w}, false) AS {fam}_{i}" for fam, rules in oracle.RULES.items() for i, (w, _, _) in enumerate(rules)) + " FROM sig")
def rule_flags(f):
    out = classifier.rule_flags(f.scored, f.config)
    return out.select(*IDENT, *(c for c in out.columns if c.rsplit("_", 1)[0] in classifier.FAMILIES and c.rsplit("_", 1)[1].isdigit()))


@query(f"SELECT {ID}, kind, rule_id, synergy_scan, synergy_physics FROM cls")
def first_match_rule(f):
    return f.classified.select(*IDENT, "kind", "rule_id", "synergy_scan", "synergy_physics")


@query(f"SELECT {ID}, " + ", ".join(f"coalesce({w}, false) AS {fam}_{i}" for fam, rules in oracle.RULES.items() for i, (w, _, _) in enumerate(rules)) + " FROM loudsig")
def rule_flags_loud(f):
    out = classifier.rule_flags(f.loud, f.config)
    return out.select(*IDENT, *(c for c in out.columns if c.rsplit("_", 1)[0] in classifier.FAMILIES and c.rsplit("_", 1)[1].isdigit()))


#: Families whose thresholds the tables' own traffic stays under: asked of the fleet with more of it.
LOUD_FAMILIES = ("dark", "protocol", "scan", "attack", "capacity")


def _family(name: str):
    loud = name in LOUD_FAMILIES
    chosen = sorted({r for _, _, r in oracle.RULES[name]})

    def run(f):
        rows = classifier.classify(f.loud, config=f.config) if loud else f.classified
        return rows.where(F.col("rule_id").isin(*chosen)).select(*IDENT, "kind", "rule_id")

    run.__name__ = f"rules_{name}"
    query(f"SELECT {ID}, kind, rule_id FROM {'loudcls' if loud else 'cls'} WHERE rule_id IN ({', '.join(map(repr, chosen))})")(run)


for _name in oracle.RULES:
    _family(_name)


@query(f"SELECT {ID}, kind, rule_id, synergy_scan, synergy_physics FROM loudcls")
def rule_synergy(f):
    return classifier.classify(f.loud, config=f.config).select(*IDENT, "kind", "rule_id", "synergy_scan", "synergy_physics")


@query(f"SELECT {ID}, kind, severity_score FROM prio")
def score_alert_severity(f):
    return f.alerts.select(*IDENT, "kind", "severity_score")


@query(f"SELECT {ID}, kind, confidence_score FROM prio")
def score_alert_confidence(f):
    return f.alerts.select(*IDENT, "kind", "confidence_score")


@query(f"SELECT {ID}, severity_band, priority, priority_basis FROM prio")
def score_band_priority(f):
    return f.alerts.select(*IDENT, "severity_band", "priority", "priority_basis")


_SIG = oracle_state.SIGNAL


def _signals(f) -> DataFrame:
    prio = f.alerts.select(*IDENT, "priority")
    rows = f.classified.select(*IDENT, "host_impact", "signal").join(prio, IDENT, "left")
    return rows.withColumn("behavior_signal", scoring.behavior_signal(F.col("host_impact"), F.col("signal"), F.col("priority")))


@query(f"SELECT s.host_id, s.instance, s.ip, s.direction, s.ts, round({_SIG}, 3) AS behavior_signal FROM sig s LEFT JOIN prio p ON {oracle.same('s', 'p')}")
def score_behavior_signal(f):
    return _signals(f).select(*IDENT, F.round("behavior_signal", 3).alias("behavior_signal"))


@query(f"SELECT host_id, instance, ts, round(o, 3) AS out_signal, round(i, 3) AS in_signal, round((o + i) / 2 * 100, 2) AS behavior_score FROM (SELECT s.host_id, s.instance, s.ts, coalesce(max(CASE WHEN s.direction = 'outbound' THEN {_SIG} END), 0) AS o, coalesce(max(CASE WHEN s.direction = 'inbound' THEN {_SIG} END), 0) AS i FROM sig s LEFT JOIN prio p ON {oracle.same('s', 'p')} GROUP BY s.host_id, s.instance, s.ts)")
def agg_ip_signal(f):
    got = scoring.ip_signal(_signals(f))
    return got.select("host_id", "instance", "snapshot_ts", *(F.round(c, 3).alias(c) for c in ("out_signal", "in_signal")), F.round("behavior_score", 2).alias("behavior_score"))


_USAGE = {n: _CPU.format(n=v) for n, v in (("u", 400000000), ("s", 30000000), ("w", 9000000))}


@query(f"SELECT host_id, instance, ts, round(greatest(least(1, ({_USAGE['s']} + {_USAGE['w']}) / 50), 0.3 * {_USAGE['u']} / 100), 4) AS cpu_p, round(least(1, ln(1 + vcpus) / ln(17)), 4) AS cpu_impact FROM lagged")
def score_cpu_pressure(f):
    return scoring.cpu_pressure(f.cpu).select("host_id", "instance", "ts", "cpu_p", "cpu_impact")


@query("SELECT host_id, instance, ts, round(least(1, (CASE WHEN dt > 0 AND inc > 0 THEN 0.011 - 0.002 ELSE 0 END) / (0.018 + 0.08 * 8192 / 983040.0)) * 100, 3) AS lat, round(greatest(inc * 5 / nullif(dt, 0) / 100, inc * 368640 / nullif(dt, 0) / 10485760), 4) AS disk_activity FROM lagged WHERE dt > 0 AND inc >= 1")
def score_disk_pressure(f):
    rows = deltas.disk_pressure(f.disk).where("rw_requests > 0")
    size = scalars.clamp((F.col("avg_io_size") - 65536) / 983040)
    lat = F.least((F.col("wr_latency") - 0.002) / (0.018 + size * 0.08), F.lit(1.0)) * 100
    return rows.select("host_id", "instance", "ts", F.round(lat, 3).alias("lat"), "disk_activity")


@query("SELECT host_id, instance, ts, round(greatest(CASE WHEN used > 0 THEN least(1, greatest(0, (least(used / 4096, 1.5) - 0.8) / 0.7)) ELSE 0 END, least(1, greatest(0, (coalesce(inc * 5000.0 / nullif(dt, 0), 0) - 1024) / 15360)), least(1, greatest(0, (coalesce(inc * 60.0 / nullif(dt, 0), 0) - 5) / 195))), 4) AS mem_p, CASE WHEN used > 0 THEN 1.0 ELSE 0.5 END AS mem_conf FROM (SELECT *, (counter * 5000 % 6000) * 1.0 AS used FROM lagged)")
def score_mem_pressure(f):
    rows = f.mem.withColumns({"mem_mb": F.lit(4096), "used_mb": (F.col("swap_in") % 6000).cast("double")})
    return scoring.mem_pressure(rows).select("host_id", "instance", "ts", "mem_p", "mem_conf")


@query("SELECT host_id, instance, ts, round(greatest(CASE WHEN dt > 0 AND inc > 0 THEN log10(17.0 / 9000 / 0.0001) / 2 ELSE 0 END, least(1, greatest(0, ((counter * 9000 % 900) / 5000.0 - 0.01) / 0.09))), 4) AS net_p, round(greatest(least(1, coalesce(inc * 9000.0 / nullif(dt, 0), 0) / 1000), CASE WHEN counter * 9000 % 900 > 0 THEN 1 ELSE 0 END), 4) AS net_conf FROM lagged")
def score_net_pressure(f):
    rows = f.net.withColumns({"flows": F.col("packets") % 900, "table_max": F.lit(adapters.TABLE_MAX * 10)})
    return scoring.net_pressure(rows, f.config).select("host_id", "instance", "ts", "net_p", "net_conf")


@query("SELECT host_id, instance, ts, round(CASE WHEN dt > 0 AND inc > 0 THEN 0.009 / (0.018 + 0.08 * 8192 / 983040.0) * 100 ELSE 0 END, 3) AS disk_signal, round(coalesce(greatest(inc * 5 / nullif(dt, 0) / 100, inc * 368640 / nullif(dt, 0) / 10485760), 0), 4) AS disk_activity, 1 AS disks FROM lagged")
def agg_disk_worst(f):
    got = deltas.disk_worst(f.disk)
    return got.select("host_id", "instance", "ts", F.round("disk_signal", 3).alias("disk_signal"), "disk_activity", "disks")


@query("SELECT host_id, instance, ts, CAST(sum(CASE WHEN gap > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY host_id, instance ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM (SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY host_id, instance ORDER BY ts)) AS gap FROM counters)")
def win_state_ttl(f):
    return deltas.state_islands(f.counters.select("host_id", "instance", "ts"), ["host_id", "instance"], 86400)


@query("SELECT host_id, instance, ts AS at, round(overall_raw, 4) AS overall_raw, top_axis, axes90, band FROM res")
def score_resource_overall(f):
    return f.resources.select("host_id", "instance", F.col("ts").alias("at"), "overall_raw", "top_axis", "axes90", "band")


@query("SELECT host_id, ts, instance, round(1 - exp(sum(ln(greatest(1 - least(1, active / 10.0), 1e-300)))), 4) AS instant FROM (SELECT host_id, ts, list, instance, least(count(*), 5000) AS active FROM routed GROUP BY host_id, ts, list, instance) GROUP BY host_id, ts, instance")
def score_threat_signal(f):
    counts = threat.hit_counts(f.routed).select("host_id", "snapshot_ts", "instance", "list", F.col("active").alias("hits"))
    return scoring.threat_signal(counts)


def _attention(f) -> DataFrame:
    """Resource, behaviour and threat scores of every machine and snapshot, and their blend; a stopped machine has no resource part."""
    counts = threat.hit_counts(f.routed).select("host_id", "snapshot_ts", "instance", "list", F.col("active").alias("hits"))
    intel = folds.threat_intel(scoring.threat_signal(counts)).select("host_id", "instance", "snapshot_ts", "intel_combined")
    key = ["host_id", "instance", "snapshot_ts"]
    rows = scoring.ip_signal(_signals(f)).join(f.machine_scores, key, "left").join(intel, key, "left")
    running = F.coalesce("running", F.lit(False))
    rows = rows.withColumns({
        "running": running, "resource_score": F.when(running, F.col("overall")).otherwise(0.0), "threat_score": F.coalesce("intel_combined", F.lit(0.0)) * 100,
    })
    return rows.withColumn("attention", scoring.attention(F.col("resource_score"), F.col("running"), F.col("behavior_score"), F.col("threat_score"), config=f.config))


@query(f"SELECT host_id, instance, ts, running, round(resource + 1e-9, 3) AS resource_score, round(behavior + 1e-9, 2) AS behavior_score, round(threat + 1e-9, 3) AS threat_score, round({oracle_state.ATTENTION} + 1e-9, 2) AS attention FROM attend")
def score_attention(f):
    # the little that is added parts halves alike on every engine
    scores = (F.round(F.col(c) + 1e-9, n).alias(c) for c, n in (("resource_score", 3), ("behavior_score", 2), ("threat_score", 3), ("attention", 2)))
    return _attention(f).select("host_id", "instance", "snapshot_ts", "running", *scores)


# ---- threat lists ------------------------------------------------------------------------


@query("SELECT host_id, ts, list, side, count(*) AS matches FROM (SELECT t.*, l.list FROM tsides t JOIN (SELECT DISTINCT list, ip FROM threat_ips) l ON l.ip = t.ip) GROUP BY host_id, ts, list, side")
def join_threat_ip(f):
    return threat.match_ips(attribution.owned(f.attributed), f.threat_ips).groupBy("host_id", "snapshot_ts", "list", "side").agg(F.count("*").alias("matches"))


@query("SELECT host_id, ts, side, count(*) AS matches FROM (SELECT DISTINCT t.host_id, t.ts, t.side, t.src_inst, t.dst_inst, a_ip, a_port, b_ip, b_port, proto FROM tsides t JOIN threat_cidrs c ON t.ip BETWEEN c.network AND c.network + CAST(power(2, 32 - c.prefix_len) AS BIGINT) - 1) GROUP BY host_id, ts, side")
def join_threat_cidr(f):
    return threat.match_cidrs(attribution.owned(f.attributed), f.threat_cidrs).groupBy("host_id", "snapshot_ts", "side").agg(F.count("*").alias("matches"))


@query("SELECT host_id, ts, list, instance, count(*) AS pairs FROM routed GROUP BY host_id, ts, list, instance")
def route_threat_hit(f):
    return f.routed.groupBy("host_id", "snapshot_ts", "list", "instance").agg(F.count("*").alias("pairs"))


@query("SELECT host_id, ts, list, instance, least(count(*), 5000) AS active, greatest(count(*) - 5000, 0) AS dropped FROM routed GROUP BY host_id, ts, list, instance")
def agg_threat_hits(f):
    return threat.hit_counts(f.routed, f.config)


@query("SELECT host_id, ts, list, instance, count(*) AS kept, min(a_ip) AS least_ip FROM (SELECT *, row_number() OVER (PARTITION BY host_id, ts, list, instance ORDER BY a_ip, a_port, b_ip, b_port, proto) AS n FROM routed) WHERE n <= 5000 GROUP BY host_id, ts, list, instance")
def topk_threat_cap(f):
    return threat.capped_hits(f.routed, f.config).groupBy("host_id", "snapshot_ts", "list", "instance").agg(F.count("*").alias("kept"), F.min("pair.a.ip").alias("least_ip"))


@query("SELECT DISTINCT h.host_id, l.list, h.ip FROM host_ips h JOIN threat_ips l ON l.ip = h.ip UNION SELECT DISTINCT h.host_id, c.list, h.ip FROM host_ips h JOIN threat_cidrs c ON h.ip BETWEEN c.network AND c.network + CAST(power(2, 32 - c.prefix_len) AS BIGINT) - 1")
def join_host_ip_listed(f):
    return threat.host_listed(f.host_ips, f.threat_ips, f.threat_cidrs)


@query("SELECT list, max(CASE WHEN ok THEN v END) AS last_success, sum(CASE WHEN ok THEN 0 ELSE 1 END) AS errors FROM (SELECT concat('l', CAST(s_suppkey % 5 AS STRING)) AS list, s_suppkey AS v, s_suppkey % 4 <> 0 AS ok FROM supplier) GROUP BY list")
def threat_list_health(f):
    loads = f.table("supplier").select(F.concat(F.lit("l"), (F.col("s_suppkey") % 5).cast("string")).alias("list"), F.col("s_suppkey").alias("ts"), (F.col("s_suppkey") % 4 != 0).alias("ok"), F.lit(1.0).alias("duration_s"), F.lit(1).alias("entries"))
    return threat.list_health(loads).select("list", "last_success", "errors")


@query("SELECT list, count(*) AS entries, min(version) AS version FROM (SELECT concat('l', CAST(s_suppkey % 3 AS STRING)) AS list, s_suppkey // 10 AS version FROM supplier) e JOIN (SELECT list AS l, max(version) AS v FROM (SELECT DISTINCT concat('l', CAST(s_suppkey % 3 AS STRING)) AS list, s_suppkey // 10 AS version FROM supplier) WHERE version % 4 <> 3 GROUP BY 1) g ON g.l = e.list AND g.v = e.version GROUP BY list")
def threat_list_swap(f):
    entries = f.table("supplier").select(F.concat(F.lit("l"), (F.col("s_suppkey") % 3).cast("string")).alias("list"), F.lit(4).alias("family"), F.expr("s_suppkey div 10").alias("version"))
    loads = entries.distinct().withColumns({"ok": F.col("version") % 4 != 3, "entries": F.lit(1)})
    return threat.current_lists(loads, entries).groupBy("list").agg(F.count("*").alias("entries"), F.min("version").alias("version"))


# ---- questions over the metric table --------------------------------------------------------

_M = "(SELECT host_id, ts, event_id, instance, concat('p', CAST(user_id % 5 AS STRING)) AS project, event_type AS kind, counter, step, t, step2 FROM lagged)"
KEY = ["host_id", "instance"]


def _gauge(f, *labels: str) -> DataFrame:
    return fleet.select(f.metrics, "load", labels)


def _counter(f, name: str = "work_total") -> DataFrame:
    return fleet.select(f.metrics, name, ["instance"])


@query(f"SELECT project, ts, CAST(max(step) AS DOUBLE) AS value FROM {_M} GROUP BY project, ts HAVING max(step) >= 3000")
def q_threshold_max_by(f):
    return fleet.threshold_max_by(_gauge(f, "project"), ["project"], ">=", 3000)


@query(f"SELECT host_id, ts, instance, CAST(step AS DOUBLE) AS value FROM {_M} WHERE step > 4000 AND kind = 'click'")
def q_gauge_threshold(f):
    return fleet.gauge_threshold(_gauge(f, "instance", "kind"), ">", 4000, F.col("kind") == "click").drop("kind")


@query(f"SELECT project, date_trunc('day', ts) AS day, count(*) AS n FROM {_M} WHERE step >= 2000 GROUP BY project, date_trunc('day', ts) HAVING count(*) >= 10")
def q_count_having(f):
    rows = _gauge(f, "project").withColumn("ts", F.date_trunc("day", "ts"))
    return fleet.count_having(rows, ["project"], ">=", 2000, 10).withColumnRenamed("ts", "day").select("project", "day", "n")


def _over(seconds: int) -> str:
    return f"(PARTITION BY host_id, instance ORDER BY t RANGE BETWEEN {seconds} PRECEDING AND CURRENT ROW)"


def _total(seconds: int, col: str = "step2") -> str:
    return f"(sum({col}) OVER {_over(seconds)} - first_value({col}) OVER {_over(seconds)})"


def _rate(seconds: int) -> str:
    return f"CASE WHEN t > min(t) OVER {_over(seconds)} THEN {_total(seconds)} * 1.0 / (t - min(t) OVER {_over(seconds)}) ELSE 0 END"


@query(f"SELECT host_id, instance, ts, round({_rate(86400)}, 4) AS rate FROM {_M}")
def q_counter_rate(f):
    return fleet.rate(_counter(f), KEY, 86400).select(*KEY, "ts", "rate")


@query(f"SELECT host_id, instance, ts, round(r / greatest(3 * r, 1), 4) AS ratio FROM (SELECT *, {_rate(86400)} AS r FROM {_M})")
def q_rate_ratio(f):
    return fleet.rate_ratio(_counter(f), _counter(f, "requests_total"), KEY, 86400)


@query(f"SELECT host_id, instance, ts, CAST({_total(172800)} AS DOUBLE) AS increase FROM {_M}")
def q_counter_increase(f):
    return fleet.increase(_counter(f), KEY, 172800).select(*KEY, "ts", "increase")


@query(f"SELECT host_id, instance, ts, round(avg(r) OVER {_over(259200)}, 4) AS avg_rate FROM (SELECT *, {_rate(86400)} AS r FROM {_M})")
def q_avg_over_rate(f):
    return fleet.avg_over_rate(_counter(f), KEY, 86400, 259200).select(*KEY, "ts", "avg_rate")


@query(f"SELECT host_id, instance, ts, CAST(max(step) OVER {_over(86400)} AS DOUBLE) AS max_value FROM {_M}")
def q_max_over_time(f):
    return fleet.max_over_time(_gauge(f, "instance"), KEY, 86400).select(*KEY, "ts", "max_value")


@query(f"SELECT host_id, instance, ts, n, CASE WHEN n > 2 THEN round(s, 3) END AS slope FROM (SELECT *, count(*) OVER {_over(259200)} AS n, regr_slope(step, t - 1704067200) OVER {_over(259200)} AS s FROM {_M})")
def q_deriv(f):
    rows = _gauge(f, "instance").withColumn("_t", F.unix_timestamp("ts"))
    n = F.count("*").over(Window.partitionBy(*KEY).orderBy("_t").rangeBetween(-259200, 0))
    got = fleet.deriv(rows.withColumn("n", n), KEY, 259200)
    return got.select(*KEY, "ts", "n", F.when(F.col("n") > 2, F.round("slope", 3)).alias("slope"))


@query(f"SELECT DISTINCT host_id, instance, ts FROM {_M} WHERE step >= 2000 AND kind <> 'view' AND counter >= 5000")
def q_compound_and(f):
    loud = fleet.gauge_threshold(_gauge(f, "instance", "kind"), ">=", 2000, F.col("kind") != "view")
    large = fleet.gauge_threshold(_counter(f), ">=", 5000)
    return fleet.compound_and([loud, large], KEY)


@query(f"SELECT instance, last, 1706745600 - last AS age FROM (SELECT instance, CAST(max(t) AS DOUBLE) AS last FROM {_M} GROUP BY instance) WHERE 1706745600 - last > 43200")
def q_staleness(f):
    rows = _gauge(f, "instance").withColumn("value", F.unix_timestamp("ts").cast("double"))
    return fleet.staleness(rows, ["instance"], F.lit(1706745600.0), 43200)


@query(f"SELECT host_id, instance, ts, t - min(t) OVER (PARTITION BY host_id, instance, island) AS held_s FROM (SELECT *, sum(CASE WHEN step >= 500 THEN 0 ELSE 1 END) OVER (PARTITION BY host_id, instance ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT DISTINCT host_id, instance, ts, t, step FROM {_M})) WHERE step >= 500 QUALIFY t - min(t) OVER (PARTITION BY host_id, instance, island) >= 86400")
def q_for_duration(f):
    rows = _gauge(f, "instance")
    return fleet.for_duration(fleet.gauge_threshold(rows, ">=", 500), KEY, rows, 86400)


@query("SELECT host_id, ts, instance, ip, flows_total, rank FROM (SELECT e.host_id, e.ts, e.instance, e.ip, e.n AS flows_total, row_number() OVER (PARTITION BY e.host_id, e.ts ORDER BY e.n DESC, e.instance, e.ip) AS rank FROM (SELECT host_id, ts, instance, ip, count(*) AS n FROM ev GROUP BY host_id, ts, instance, ip) e JOIN (SELECT host_id, ts FROM flows GROUP BY host_id, ts HAVING count(*) / 500.0 >= 0.5) h ON h.host_id = e.host_id AND h.ts = e.ts) WHERE rank <= 3")
def topk_noisy_ips(f):
    per_ip = f.events.groupBy("host_id", "snapshot_ts", "instance", "ip").agg(F.count("*").alias("flows_total"))
    hosts = attribution.host_conntrack(f.flows, f.table_max)
    return fleet.noisy_ips(per_ip, hosts, 0.5, 3).select("host_id", "snapshot_ts", "instance", "ip", "flows_total", "rank")


@query("SELECT host_id, day, instance, round(disk_severity, 4) AS disk_severity, rank FROM (SELECT *, row_number() OVER (PARTITION BY host_id, day ORDER BY disk_severity DESC, instance) AS rank, max(disk_severity) OVER (PARTITION BY host_id, day) AS pressure FROM (SELECT host_id, instance, date_trunc('day', ts) AS day, round(max(disk_severity), 6) AS disk_severity FROM res GROUP BY 1, 2, 3)) WHERE rank <= 3 AND pressure >= 10")
def topk_noisy_neighbors(f):
    day = F.date_trunc("day", "ts")
    worst = f.resources.groupBy("host_id", "instance", day.alias("ts")).agg(F.round(F.max("disk_severity"), 6).alias("disk_severity"))
    hosts = worst.groupBy("host_id", "ts").agg(F.max("disk_severity").alias("pressure"))
    return fleet.noisy_neighbors(worst, hosts, "disk", 10.0, 3).select("host_id", F.col("ts").alias("day"), "instance", "disk_severity", "rank")


# ---- sinks ---------------------------------------------------------------------------------


@query(metric_frames.TOTALS)
def sink_metrics(f):
    """Rows and total of every family of the catalogue. Totals are BIGINT, as in SQL, unless one does not fit; then they are decimals, where SQL fails."""
    f.keep("flows", "counters", "routed", "resources")  # most frames read one of them
    rows = catalogue.emit(metric_frames.frames(f, _attention(f)))
    return catalogue.whole(f.written("family_totals", catalogue.totals(rows)), "total")


@query(oracle_state.ALERTS, places=5)
def sink_alert_events(f):
    """Records hold 5 places; they are compared as they are, since a second rounding meets ties."""
    return sinks.alerts(f.gated, features.alert_endpoints(f.remotes, f.host_ips))


@query("SELECT host_id, ts, list, instance, a_port, b_port, proto FROM routed")
def sink_threat_events(f):
    return sinks.threat_events(f.routed).select("host_id", "snapshot_ts", "list", "instance", "a_port", "b_port", "proto")


_DETAIL = ["overall", *(f"{a}_{n}" for a in ("cpu", "mem", "disk", "net") for n in ("p", "conf", "ewma", "severity"))]


@query(f"SELECT host_id, instance, t, band, top_axis, cap_active, persistence_triggered, {', '.join(f'round({c}, 5) AS {c}' for c in _DETAIL)} FROM resev", raw=True)
def sink_resource_events(f):
    """The JSON records, read back."""
    records = sinks.resource_records(scoring.resource_events(f.resources))
    read = sinks.as_json(records).select(F.from_json("value", records.schema).alias("r")).select("r.*")
    detail = (F.col(c.replace("_", ".")).alias(c) for c in _DETAIL)
    return read.select("host_id", "instance", F.unix_timestamp("ts").alias("t"), F.col("band").cast("long").alias("band"), "top_axis", "cap_active", "persistence_triggered", *detail)


@query(f"SELECT host_id, instance, ip, direction, ts, min(remote) AS sample_remote, min(CASE WHEN {oracle.PRIVATE} AND NOT {oracle.INFRA} THEN remote END) AS private_remote, min(CASE WHEN {oracle.INFRA} THEN remote END) AS infra_remote FROM marked GROUP BY {ID}")
def alert_endpoints(f):
    return features.alert_endpoints(f.remotes, f.host_ips)


@query(f"SELECT {ID}, min(remote) AS sample_remote FROM rem GROUP BY {ID}")
def first_sample_remote(f):
    return features.sample_remote(f.remotes)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows per fixed address with the labels of its machine."""
    f = Fleet(spark, sf_dir)
    labels = f.instances.select("instance", "server_name", "project")
    return plain(attribution.ip_flows(f.events, f.instance_ips, f.flows).join(labels, "instance"))


# ---- streams: the same rows through the streaming operators ----------------------------------


@query("SELECT host_id, ts, count(*) AS flows FROM flows GROUP BY host_id, ts")
def stream_snapshots(f):
    from ..streaming import state

    return state.replay(f.flows.select("host_id", "snapshot_ts"), lambda s: state.snapshots(state.on_time(s)))


_CHAIN = f"""SELECT s.host_id, s.instance, s.ip, s.direction, s.ts, s.new_remotes, s.new_ports, round(s.signal, 3) AS signal, g.kind, coalesce(g.hits, 0) AS hits, coalesce(g.required, 0) AS required,
       g.priority, coalesce(g.emitted, false) AS emitted, g.emit_reason, g.suppress_reason FROM sig s LEFT JOIN gated g ON {oracle.same('s', 'g')}"""


def _thirds(f: Fleet, ts: str = "snapshot_ts") -> list[Column]:
    """Three micro-batches of the snapshots, in order."""
    cut = [adapters.START + 15 * n for n in (9, 18)]
    at = F.unix_timestamp(ts)
    return [at < cut[0], (at >= cut[0]) & (at < cut[1]), at >= cut[1]]


@query(_CHAIN)
def stream_behavior_state(f):
    """The whole chain over three micro-batches: prior sets, averages, persistence and the emit gate as streaming state."""
    return _streamed(f)


@query(oracle_state.CLOCKS)
def stream_ttl_timers(f):
    """The clocks of the four kinds of state over machines that are seen at odd times, for a month."""
    from ..streaming import behavior, state

    rows = f.counters.select("host_id", "instance", F.col("ts").alias("snapshot_ts"))
    day = F.dayofmonth("snapshot_ts")
    conf = {"spark__sql__streaming__stateStore__providerClass": behavior.ROCKS, "spark__sql__shuffle__partitions": "8"}
    got = state.replay(rows, lambda s: behavior.clocks(s, f.config), [day <= 10, (day > 10) & (day <= 20), day > 20], "append", **conf)
    return got.select("host_id", "instance", "t", *behavior.Alive.KINDS)


def _streamed(f: Fleet, absences: DataFrame | None = None) -> DataFrame:
    from ..streaming import behavior, state

    conf = {"spark__sql__streaming__stateStore__providerClass": behavior.ROCKS, "spark__sql__shuffle__partitions": "8"}
    rows = state.replay(behavior.inputs(f.features, f.remotes, f.ports, absences), lambda s: behavior.chain(s, f.config), _thirds(f), "append", **conf)
    return _told(rows)


def _told(rows: DataFrame) -> DataFrame:
    """Rows without a rule hit have 0 hits and none required."""
    rows = rows.fillna(0, ["hits", "required"]).withColumn("emitted", F.coalesce("emitted", F.lit(False)))
    names = "new_remotes new_ports kind hits required priority emitted emit_reason suppress_reason".split()
    return rows.select(*IDENT, *names, F.round("signal", 3).alias("signal"))


_PRESENT = _CHAIN.replace("s.instance, s.ip", "split_part(s.instance, '#', 1) AS instance, s.ip")


@query(_PRESENT, fleet=ComingAndGoing)
def win_presence_state(f):
    """The chain in batch where machines leave and return: the island of presence is part of every state's key."""
    hits = f.gated.select(*IDENT, "kind", "hits", "required", "priority", "emitted", "emit_reason", "suppress_reason")
    return _told(f.scored.select(*IDENT, "new_remotes", "new_ports", "signal").join(hits, IDENT, "left"))


@query(_PRESENT, fleet=ComingAndGoing)
def stream_presence_state(f):
    """The same from the stream, where a machine that is absent takes its state with it."""
    return _streamed(f, f.absences)


#: Stores of the single folds: each is a file in every micro-batch, and their states are small.
STATES = {"spark__sql__shuffle__partitions": "24"}


@query("SELECT host_id, instance, ts AS at, round(overall, 4) AS overall, top_axis, band FROM res")
def stream_resource_state(f):
    from ..streaming import state

    return state.replay(f.pressures, state.resource_state, **STATES).select("host_id", "instance", F.col("ts").alias("at"), "overall", "top_axis", "band")


@query("SELECT host_id, instance, ts, round(e, 4) AS intel_ewma, round(least(1, greatest(0, 0.5 * instant + 0.5 * e)), 4) AS intel_combined FROM intel")
def stream_threat_state(f):
    from ..streaming import state

    counts = threat.hit_counts(f.routed).select("host_id", "snapshot_ts", "instance", "list", F.col("active").alias("hits"))
    return state.replay(scoring.threat_signal(counts), state.threat_state, **STATES).select("host_id", "instance", "snapshot_ts", "intel_ewma", "intel_combined")


@query(f"SELECT {ID}, kind, emitted, emit_reason, suppress_reason FROM gated")
def stream_emit_gate(f):
    from ..streaming import state

    needed = ("kind", "hits", "required", "priority", "severity_band", "remote_share", "port_share", "top_remote", "top_port")
    return state.replay(f.alerts.select(*IDENT, *needed), state.emit_state, **STATES).select(*IDENT, "kind", "emitted", "emit_reason", "suppress_reason")


@query("SELECT host_id, list, instance, ts, sum(CASE WHEN last IS NULL OR ts - last > 15 THEN 1 ELSE 0 END) AS new_contacts FROM (SELECT *, lag(ts) OVER (PARTITION BY host_id, list, instance, a_ip, a_port, b_ip, b_port, proto ORDER BY ts) AS last FROM routed) GROUP BY host_id, list, instance, ts")
def stream_threat_contacts(f):
    from ..streaming import behavior, state

    rows = state.replay(f.routed, state.contact_state, spark__sql__streaming__stateStore__providerClass=behavior.ROCKS)
    return rows.groupBy("host_id", "list", "instance", "snapshot_ts").agg(F.count_if("is_new").alias("new_contacts"))


@query("SELECT f.host_id, l.list, count(*) AS hits FROM flows f JOIN (SELECT DISTINCT list, ip FROM threat_ips) l ON l.ip = f.dst_ip GROUP BY f.host_id, l.list")
def stream_list_refresh(f):
    from ..streaming import state

    folder = state.shared(f.spark)
    f.flows.select("host_id", "snapshot_ts", "dst_ip").write.parquet(f"{folder}/in")
    rows = f.spark.read.parquet(f"{folder}/in")
    stream = f.spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    fresh = lambda: f.threat_ips.select("list", "ip").distinct()
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
    state.against_current_lists(stream, fresh, keep, f"{folder}/log").awaitTermination()
    return f.spark.read.parquet(f"{folder}/out").groupBy("host_id", "list").agg(F.count("*").alias("hits"))
