"""The catalogue of output metrics: which families each wide frame gives, and their long table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LISTS = ("spamhaus", "tor_exit", "tor_relay", "emergingthreats", "customlist")
DIRECTIONS = ("outbound", "inbound")

# Metric names. {list} and {direction} stand for a column of the frame.
HOSTS = (
    "host_mem_mb_total", "host_libvirt_active_vms", "host_cpu_active_vcpus", "host_active_disks", "host_active_fixed_ips",
    "host_active_projects", "host_cpu_threads", "host_cpu_usage_percent", "host_mem_free_mb", "host_mem_available_mb",
)
TABLES = (
    "host_collection_errors_total", "host_collection_cycle_lag_seconds", "host_conntrack_entries", "host_conntrack_read_errors_total",
    "host_conntrack_raw_ok", "host_conntrack_raw_parse_errors_total", "host_conntrack_last_success_timestamp_seconds",
    "host_conntrack_stale_seconds", "host_conntrack_max", "host_conntrack_utilization",
)
LIST_HEALTH = (
    "host_threat_{list}_refresh_last_success_timestamp_seconds", "host_threat_{list}_refresh_duration_seconds",
    "host_threat_{list}_refresh_errors_total", "host_threat_{list}_entries",
)
LISTED = ("host_threat_provider_ip_listed",)
MACHINES = (
    "instance_info", "instance_state_code", "instance_cpu_vcpu_percent", "instance_cpu_vcpu_count", "instance_mem_allocated_mb",
    "instance_mem_used_mb", "instance_mem_swap_in_bytes_total", "instance_mem_swap_out_bytes_total", "instance_mem_major_faults_total",
    "instance_mem_minor_faults_total", "instance_mem_rss_mb",
)
VCPUS = ("instance_cpu_steal_seconds_total", "instance_cpu_wait_seconds_total")
DISKS = (
    "instance_disk_read_gbytes_total", "instance_disk_write_gbytes_total", "instance_disk_read_requests_total", "instance_disk_write_requests_total",
    "instance_disk_read_seconds_total", "instance_disk_write_seconds_total", "instance_disk_flush_requests_total", "instance_disk_flush_seconds_total",
    "instance_disk_capacity_bytes", "instance_disk_allocation_bytes", "instance_disk_info", "instance_disk_read_iops", "instance_disk_write_iops",
    "instance_disk_flush_iops", "instance_disk_read_latency_seconds", "instance_disk_write_latency_seconds", "instance_disk_flush_latency_seconds",
)
NICS = (
    "instance_net_rx_gbytes_total", "instance_net_tx_gbytes_total", "instance_net_rx_packets_total", "instance_net_tx_packets_total",
    "instance_net_rx_errors_total", "instance_net_tx_errors_total", "instance_net_rx_dropped_total", "instance_net_tx_dropped_total",
)
ADDRESSES = ("instance_conntrack_ip_flows", "instance_conntrack_ip_flows_inbound", "instance_conntrack_ip_flows_outbound")
BEHAVIOR = (
    "instance_{direction}_unique_remotes", "instance_{direction}_new_remotes", "instance_{direction}_flows", "instance_{direction}_max_flows_single_remote",
    "instance_{direction}_unique_dst_ports", "instance_{direction}_new_dst_ports", "instance_{direction}_max_flows_single_dst_port",
    "instance_{direction}_bytes_per_flow", "instance_{direction}_packets_per_flow",
)
THREATS = ("instance_threat_{list}_contacts_total", "instance_threat_{list}_active_flows")
SEVERITIES = (
    "instance_resource_severity", "instance_threat_list_severity", "instance_attention_severity", "instance_behavior_severity",
    "instance_resource_cpu_severity", "instance_resource_mem_severity", "instance_resource_disk_severity", "instance_resource_net_severity",
)

#: Group -> its families and the labels of its frame.
GROUPS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "hosts": (HOSTS, ()), "tables": (TABLES, ()), "list_health": (LIST_HEALTH, ()), "listed": (LISTED, ("list", "ip")), "machines": (MACHINES, ("instance",)),
    "vcpus": (VCPUS, ("instance", "vcpu")), "disks": (DISKS, ("instance", "volume", "path")), "nics": (NICS, ("instance", "iface")),
    "addresses": (ADDRESSES, ("instance", "ip")), "behavior": (BEHAVIOR, ("instance", "ip")), "threats": (THREATS, ("instance",)), "severities": (SEVERITIES, ("instance",)),
}


def column(family: str) -> str:
    """The frame's column of a family: what stands behind its placeholder, or its whole name."""
    return family.rsplit("}_", 1)[-1]


def kind(family: str) -> str:
    return "counter" if family.endswith("_total") and not family.endswith("_mb_total") else "gauge"


def families() -> list[str]:
    """Every metric name."""
    fill = {"{list}": LISTS, "{direction}": DIRECTIONS}
    out = []
    for names, _ in GROUPS.values():
        for name in names:
            mark = next((m for m in fill if m in name), None)
            out += [name.replace(mark, x) for x in fill[mark]] if mark else [name]
    return out


def _name(family: str, prefix: str) -> Column:
    for mark in ("list", "direction"):
        if f"{{{mark}}}" in family:
            before, after = family.split(f"{{{mark}}}")
            return F.concat(F.lit(prefix + before), F.col(mark), F.lit(after))
    return F.lit(prefix + family)


def long_table(group: str, wide: DataFrame, ts: str = "snapshot_ts", prefix: str = "") -> DataFrame:
    """A group's frame (host_id, ts, its labels, a column a family) -> host_id, ts, metric, type, labels, value; nulls are not emitted.

    Values are rounded to 5 places.
    """
    names, labels = GROUPS[group]
    cells = [
        F.struct(_name(n, prefix).alias("metric"), F.lit(kind(n)).alias("type"), F.round(F.col(column(n)).cast("double"), 5).alias("value")) for n in names
    ]
    tags = F.create_map(*(x for n in labels for x in (F.lit(n), F.col(n).cast("string")))) if labels else F.create_map().cast("map<string,string>")
    rows = wide.select("host_id", F.col(ts).alias("ts"), tags.alias("labels"), F.explode(F.array(*cells)).alias("m"))
    return rows.select("host_id", "ts", "m.metric", "m.type", "labels", "m.value").where("value is not null")


def emit(frames: dict[str, DataFrame], prefix: str = "") -> DataFrame:
    """All metrics of the frames given, by group; each has snapshot_ts."""
    return reduce(DataFrame.unionByName, (long_table(g, frames[g], prefix=prefix) for g in GROUPS if g in frames))


def totals(rows: DataFrame) -> DataFrame:
    """Rows and exact total of each family of the long table; a total is as wide as the sum."""
    total = F.sum(F.col("value").cast("decimal(28, 5)"))
    return rows.groupBy("metric", "type").agg(F.count("*").alias("n"), F.round(total, 0).alias("total"))


def whole(rows: DataFrame, column: str) -> DataFrame:
    """A column of whole decimals as BIGINT where all of them fit, else as it is. rows are few and read twice."""
    widest = rows.agg(F.max(F.abs(column))).first()[0]
    return rows if widest is not None and widest >= 2**63 else rows.withColumn(column, F.col(column).cast("long"))
