"""Wide frames for the catalogue of metrics, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ip as addr
from ..operators import attribution, catalogue, deltas, fleet, threat
from . import oracle_state
from .adapters import START, TABLE_MAX, Fleet

GB = 1024**3
KEY = ["host_id", "instance", "ts"]
c = F.col


def stamped(rows: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("ts", "snapshot_ts")


def hosts(f: Fleet) -> DataFrame:
    rollup = fleet.host_rollup(f.instances, f.instances.select("host_id", "instance", F.lit("vda").alias("path")), f.instance_ips)
    per = f.flows.groupBy("host_id", "snapshot_ts").agg(F.count("*").alias("n"), F.count_if(c("rev_packets") == 0).alias("i"))
    own = Window.partitionBy("host_id").orderBy("snapshot_ts").rowsBetween(Window.unboundedPreceding, 0)
    cpu = deltas.host_cpu_percent(per.select("host_id", c("snapshot_ts").alias("ts"), "n", F.sum("n").over(own).alias("total"), F.sum("i").over(own).alias("idle")))
    return stamped(cpu).join(rollup, "host_id").select(
        "host_id", "snapshot_ts", F.lit(65536).alias("host_mem_mb_total"), c("active_vms").alias("host_libvirt_active_vms"),
        c("active_vcpus").alias("host_cpu_active_vcpus"), c("active_disks").alias("host_active_disks"), c("active_fixed_ips").alias("host_active_fixed_ips"),
        c("active_projects").alias("host_active_projects"), (c("active_vcpus") * 2).alias("host_cpu_threads"), c("cpu_percent").alias("host_cpu_usage_percent"),
        (65536 - c("n")).alias("host_mem_free_mb"), (65536 - c("n") / 2).alias("host_mem_available_mb"),
    )


def tables(f: Fleet) -> DataFrame:
    full = attribution.host_conntrack(f.flows, f.table_max)
    loads = full.select("host_id", c("snapshot_ts").alias("ts"), "entries", "table_max", "utilization", (c("entries") % 3 != 0).alias("ok"))
    own = Window.partitionBy("host_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    failed = F.sum((~c("ok")).cast("int")).over(own)
    return stamped(deltas.collection_lag(loads).select(
        "host_id", "ts", failed.alias("host_collection_errors_total"), c("cycle_lag").alias("host_collection_cycle_lag_seconds"), c("entries").alias("host_conntrack_entries"),
        failed.alias("host_conntrack_read_errors_total"), c("ok").cast("int").alias("host_conntrack_raw_ok"),
        F.sum(c("entries") % 7).over(own).alias("host_conntrack_raw_parse_errors_total"),
        F.when(c("stale_seconds") >= 0, F.unix_timestamp("ts") - c("stale_seconds")).alias("host_conntrack_last_success_timestamp_seconds"),
        c("stale_seconds").alias("host_conntrack_stale_seconds"), c("table_max").alias("host_conntrack_max"), c("utilization").alias("host_conntrack_utilization"),
    ))


def list_health(f: Fleet) -> DataFrame:
    names, s = F.array(*map(F.lit, catalogue.LISTS)), c("s_suppkey")
    loads = f.table("supplier").select(
        F.get(names, (s % 5).cast("int")).alias("list"), s.alias("ts"), (s % 4 != 0).alias("ok"), (s / 100).alias("duration_s"), (s % 13).alias("entries")
    )
    return threat.list_health(loads).select(
        F.lit("h0").alias("host_id"), F.timestamp_seconds(F.lit(START)).alias("snapshot_ts"), "list", c("last_success").alias("refresh_last_success_timestamp_seconds"),
        c("duration_s").alias("refresh_duration_seconds"), c("errors").alias("refresh_errors_total"), "entries",
    )


def listed(f: Fleet) -> DataFrame:
    rows = threat.host_listed(f.host_ips, f.threat_ips, f.threat_cidrs)
    return rows.select("host_id", F.timestamp_seconds(F.lit(START)).alias("snapshot_ts"), "list", addr.show(c("ip")).alias("ip"), F.lit(1).alias("host_threat_provider_ip_listed"))


def machines(f: Fleet) -> DataFrame:
    rows = f.cpu.select(*KEY, "vcpus", "cpu_percent").join(f.mem.select(*KEY, "swap_in", "swap_out", "major_faults"), KEY)
    return stamped(rows.select(
        *KEY, F.lit(1).alias("instance_info"), F.lit(1).alias("instance_state_code"), c("cpu_percent").alias("instance_cpu_vcpu_percent"),
        c("vcpus").alias("instance_cpu_vcpu_count"), F.lit(4096).alias("instance_mem_allocated_mb"), (c("swap_in") % 6000).alias("instance_mem_used_mb"),
        (c("swap_in") * 1024).alias("instance_mem_swap_in_bytes_total"), (c("swap_out") * 1024).alias("instance_mem_swap_out_bytes_total"),
        c("major_faults").alias("instance_mem_major_faults_total"), (c("major_faults") * 2).alias("instance_mem_minor_faults_total"), (c("swap_in") / 1024).alias("instance_mem_rss_mb"),
    ))


def vcpus(f: Fleet) -> DataFrame:
    rows = f.counters.select(*KEY, "counter", F.explode(F.array(F.lit(0), F.lit(1))).alias("vcpu"))
    return stamped(rows.select(
        *KEY, "vcpu", (c("counter") * 7_000_000 / 1e9).alias("instance_cpu_steal_seconds_total"), (c("counter") * 3_000_000 / 1e9).alias("instance_cpu_wait_seconds_total")
    ))


def disks(f: Fleet) -> DataFrame:
    total = {"read": "rd", "write": "wr", "flush": "fl"}
    cells = [(c(f"{b}_bytes") / GB).alias(f"instance_disk_{a}_gbytes_total") for a, b in total.items() if a != "flush"]
    for a, b in total.items():
        cells += [
            c(f"{b}_reqs").alias(f"instance_disk_{a}_requests_total"), (c(f"{b}_ns") / 1e9).alias(f"instance_disk_{a}_seconds_total"),
            c(f"{b}_iops").alias(f"instance_disk_{a}_iops"), c(f"{b}_latency").alias(f"instance_disk_{a}_latency_seconds"),
        ]
    fixed = (F.lit(GB).alias("instance_disk_capacity_bytes"), F.lit(4096).alias("instance_disk_allocation_bytes"), F.lit(1).alias("instance_disk_info"))
    return stamped(f.disk.select(*KEY, "volume", "path", *cells, *fixed))


def nics(f: Fleet) -> DataFrame:
    rows = f.counters.select(*KEY, "user_id", "counter", F.explode(F.array(F.lit("tap0"), F.lit("tap1"))).alias("iface"))
    users = f.counters.select("instance", "user_id").distinct()
    known = users.select("instance", F.lit("tap0").alias("iface")).union(users.where("user_id % 3 = 0").select("instance", F.lit("tap1")))
    n = c("counter")
    cells = {
        "rx_gbytes": n * 1500 / GB, "tx_gbytes": n * 900 / GB, "rx_packets": n * 5, "tx_packets": n * 7, "rx_errors": n % 3, "tx_errors": n % 2, "rx_dropped": n, "tx_dropped": n * 2,
    }
    return stamped(rows.join(known, ["instance", "iface"], "left_semi").select(*KEY, "iface", *(v.alias(f"instance_net_{k}_total") for k, v in cells.items())))


def addresses(f: Fleet) -> DataFrame:
    return attribution.ip_flows(f.events, f.instance_ips, f.flows).select(
        "host_id", "snapshot_ts", "instance", addr.show(c("ip")).alias("ip"), c("flows_total").alias("instance_conntrack_ip_flows"),
        c("flows_in").alias("instance_conntrack_ip_flows_inbound"), c("flows_out").alias("instance_conntrack_ip_flows_outbound"),
    )


def behavior(f: Fleet) -> DataFrame:
    return f.features.select(
        "host_id", "snapshot_ts", "instance", addr.show(c("ip")).alias("ip"), "direction", "unique_remotes", "new_remotes", "flows",
        F.when(~c("remote_map_capped"), c("max_single_remote")).alias("max_flows_single_remote"), c("unique_ports").alias("unique_dst_ports"),
        c("new_ports").alias("new_dst_ports"), c("max_single_port").alias("max_flows_single_dst_port"), "bytes_per_flow", "packets_per_flow",
    )


#: Names under which the two hosts subscribe to the lists of the tables.
SUBSCRIBED = {"custom": ("customlist", "emergingthreats"), "relays": ("tor_relay", "tor_exit"), "drop": ("spamhaus", "spamhaus")}


def threats(f: Fleet) -> DataFrame:
    key = ["host_id", "snapshot_ts", "list", "instance"]
    rows = threat.hit_counts(f.routed, f.config).join(threat.contacts(f.routed, f.flows), key)
    name = F.coalesce(*(F.when(c("list") == k, F.when(c("host_id") == "h0", a).otherwise(b)) for k, (a, b) in SUBSCRIBED.items()))
    return rows.select("host_id", "snapshot_ts", "instance", name.alias("list"), c("contacts_total"), c("active").alias("active_flows"))


def severities(attention: DataFrame) -> DataFrame:
    """attention: the scores of queries._attention."""
    return attention.select(
        "host_id", "snapshot_ts", "instance", c("resource_score").alias("instance_resource_severity"), c("threat_score").alias("instance_threat_list_severity"),
        c("attention").alias("instance_attention_severity"), c("behavior_score").alias("instance_behavior_severity"),
        *(c(f"{a}_severity").alias(f"instance_resource_{a}_severity") for a in ("cpu", "mem", "disk", "net")),
    )


def frames(f: Fleet, attention: DataFrame) -> dict[str, DataFrame]:
    wide = {"hosts": hosts, "tables": tables, "list_health": list_health, "listed": listed, "machines": machines, "vcpus": vcpus, "disks": disks,
            "nics": nics, "addresses": addresses, "behavior": behavior, "threats": threats}
    return {name: build(f) for name, build in wide.items()} | {"severities": severities(attention)}


# ---- the same in SQL: group -> source, and an expression for each column ---------------------------

_OWN = "OVER (PARTITION BY host_id ORDER BY ts)"
_RUNNING = "(PARTITION BY host_id ORDER BY ts ROWS UNBOUNDED PRECEDING)"
_LIVE = "CASE WHEN dt > 0 AND inc > 0 THEN {} ELSE 0 END"
_RATE = "coalesce(inc * {}.0 / nullif(dt, 0), 0)"
_LIST = "CASE list " + " ".join(f"WHEN '{k}' THEN CASE WHEN host_id = 'h0' THEN '{a}' ELSE '{b}' END" for k, (a, b) in SUBSCRIBED.items()) + " END"
_CONTACTS = """SELECT r.*, n.no, lag(n.no) OVER (PARTITION BY r.host_id, r.list, r.instance, a_ip, a_port, b_ip, b_port, proto ORDER BY n.no) AS last
FROM routed r JOIN (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY ts) AS no FROM (SELECT DISTINCT host_id, ts FROM flows)) n ON n.host_id = r.host_id AND n.ts = r.ts"""
SQL: dict[str, tuple[str, tuple[str, ...]]] = {
    "hosts": (
        f"""SELECT h.*, g.* EXCLUDE (host_id) FROM (SELECT *, coalesce(CASE WHEN n > 0 AND before IS NOT NULL THEN (n - i) * 100.0 / n END, 0) AS cpu
            FROM (SELECT *, lag(n) {_OWN} AS before FROM (SELECT host_id, ts, count(*) AS n, sum(CASE WHEN rev_packets = 0 THEN 1 ELSE 0 END) AS i FROM flows GROUP BY host_id, ts))) h
            JOIN (SELECT host_id, count(DISTINCT instance) AS vms, sum(vcpus) AS vcpus, count(DISTINCT project) AS projects, count(*) AS disks, count(DISTINCT (instance, ip)) AS ips
                  FROM inst GROUP BY host_id) g ON g.host_id = h.host_id""",
        ("65536", "vms", "vcpus", "disks", "ips", "projects", "vcpus * 2", "cpu", "65536 - n", "65536 - n / 2"),
    ),
    "tables": (
        f"""SELECT *, ts - coalesce(lag(ts) {_OWN}, ts) AS cycle, max(CASE WHEN n % 3 <> 0 THEN ts END) {_OWN} AS good, sum(CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END) OVER {_RUNNING} AS failed,
            sum(n % 7) OVER {_RUNNING} AS parse FROM (SELECT host_id, ts, count(*) AS n FROM flows GROUP BY host_id, ts)""",
        ("failed", "cycle", "n", "failed", "CASE WHEN n % 3 <> 0 THEN 1 ELSE 0 END", "parse", "good", "coalesce(ts - good, -1)", f"{TABLE_MAX}", f"n / {TABLE_MAX}.0"),
    ),
    "list_health": (
        f"SELECT ({list(catalogue.LISTS)})[s_suppkey % 5 + 1] AS list, s_suppkey AS k, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey END AS good FROM supplier",
        ("max(good)", "max(k) / 100.0", "sum(CASE WHEN good IS NULL THEN 1 ELSE 0 END)", "max(good) % 13"),
    ),
    "listed": ("SELECT * FROM listed", ("1",)),
    "machines": (
        "SELECT * FROM lagged",
        ("1", "1", oracle_state.CPU.format(n=400000000), "vcpus", "4096", "counter * 5000 % 6000", "counter * 5000 * 1024", "counter * 700 * 1024", "counter * 60", "counter * 120",
         "counter * 5000 / 1024.0"),
    ),
    "vcpus": ("SELECT *, UNNEST([0, 1]) AS vcpu FROM counters", ("counter * 7 / 1000.0", "counter * 3 / 1000.0")),
    "disks": (
        "SELECT * FROM lagged",
        (f"counter * 122880.0 / {GB}", f"counter * 245760.0 / {GB}", "counter * 3", "counter * 2", "counter * 9 / 1000.0", "counter * 22 / 1000.0", "counter", "counter * 5 / 1000.0",
         f"{GB}", "4096", "1", _RATE.format(3), _RATE.format(2), _RATE.format(1), _LIVE.format(0.003), _LIVE.format(0.011), _LIVE.format(0.005)),
    ),
    "nics": (
        "SELECT * FROM (SELECT *, UNNEST(['tap0', 'tap1']) AS iface FROM counters) WHERE iface = 'tap0' OR user_id % 3 = 0",
        (f"counter * 1500.0 / {GB}", f"counter * 900.0 / {GB}", "counter * 5", "counter * 7", "counter % 3", "counter % 2", "counter", "counter * 2"),
    ),
    "addresses": (
        """SELECT i.*, s.ts, coalesce(e.a, 0) AS a, coalesce(e.b, 0) AS b FROM (SELECT DISTINCT host_id, instance, ip FROM inst) i
           JOIN (SELECT DISTINCT host_id, ts FROM flows) s ON s.host_id = i.host_id LEFT JOIN (SELECT host_id, ts, instance, ip, sum(CASE WHEN direction = 'inbound' THEN 1 ELSE 0 END) AS a,
           sum(CASE WHEN direction = 'outbound' THEN 1 ELSE 0 END) AS b FROM ev GROUP BY 1, 2, 3, 4) e ON e.host_id = i.host_id AND e.ts = s.ts AND e.instance = i.instance AND e.ip = i.ip""",
        ("a + b", "a", "b"),
    ),
    "behavior": (
        "SELECT * FROM featm",
        ("unique_remotes", "new_remotes", "flows", "CASE WHEN unique_remotes <= 32768 THEN max_single_remote END", "unique_ports", "new_ports", "max_single_port", "bytes_per_flow", "packets_per_flow"),
    ),
    "threats": (
        f"""SELECT {_LIST} AS list, active, sum(new) OVER (PARTITION BY host_id, name, instance ORDER BY ts) AS contacts FROM (
            SELECT host_id, list, list AS name, instance, ts, least(count(*), 5000) AS active, sum(CASE WHEN last IS NULL OR last <> no - 1 THEN 1 ELSE 0 END) AS new
            FROM ({_CONTACTS}) GROUP BY host_id, list, instance, ts)""",
        ("contacts", "active"),
    ),
    "severities": (
        "SELECT * FROM attend",
        ("resource", "threat", oracle_state.ATTENTION, "behavior", "cpu_severity", "mem_severity", "disk_severity", "net_severity"),
    ),
}


def _counted(group: str) -> str:
    names, (source, values) = catalogue.GROUPS[group][0], SQL[group]
    mark = next((m for m in ("list", "direction") if f"{{{m}}}" in names[0]), None)
    cells = ", ".join(f"CAST({v} AS DOUBLE)" for v in values)
    by = " GROUP BY list" if group == "list_health" else ""
    name = f"replace(f, '{{{mark}}}', mark)" if mark else "f"
    return (
        f"SELECT {name} AS metric, t AS type, v FROM (SELECT {mark or 'NULL'} AS mark, UNNEST({list(names)}) AS f, UNNEST({[catalogue.kind(n) for n in names]}) AS t, "
        f"UNNEST([{cells}]) AS v FROM ({source}) q{by}) WHERE v IS NOT NULL"
    )


#: Rows and exact total of each family.
TOTALS = (
    "SELECT metric, type, count(*) AS n, CAST(sum(CAST(round(v, 5) AS DECIMAL(28, 5))) AS BIGINT) AS total FROM ("
    + " UNION ALL ".join(map(_counted, catalogue.GROUPS))
    + ") GROUP BY metric, type"
)
