"""Readers of inventory documents, statistics, zone maps, threat lists, ports and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..functions import ip as addr
from ..functions import scalars

UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
FLOW_SCHEMA = (
    "host_id string, snapshot_ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, proto int, zone int, "
    "fwd_packets long, fwd_bytes long, rev_packets long, rev_bytes long"
)


def flow_snapshots(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Flow files with text addresses, v4 and v6 alike; rows without both addresses go."""
    rows = spark.read.schema(FLOW_SCHEMA).format(kind).load(path)
    return addr.normalize_ips(rows, ["src_ip", "dst_ip"]).where("src_ip is not null and dst_ip is not null").fillna(0)


def union_families(v4: DataFrame, v6: DataFrame) -> DataFrame:
    return v4.unionByName(v6)


def partial_reads(loads: DataFrame) -> DataFrame:
    """loads: host_id, snapshot_ts, family, enabled, ok -> ok, partial or failed."""
    on = F.col("enabled")
    got = loads.where(on).groupBy("host_id", "snapshot_ts").agg(F.bool_and("ok").alias("_all"), F.bool_or("ok").alias("_any"))
    return got.select("host_id", "snapshot_ts", F.when(F.col("_all"), "ok").when(F.col("_any"), "partial").otherwise("failed").alias("status"))


# ---- inventory documents -------------------------------------------------------------

#: What is read of a domain document, by local names; attributes start with an underscore.
DOMAIN = """
name string, uuid string,
metadata struct<instance: struct<
  name: string, flavor: struct<memory: string, vcpus: string>, owner: struct<user: string, project: string>,
  ports: struct<port: array<struct<_uuid: string, ip: array<struct<_address: string, _ipVersion: string>>>>>>>,
devices struct<
  disk: array<struct<_type: string, _device: string, source: struct<_file: string, _name: string>, target: struct<_dev: string>>>,
  interface: array<struct<target: struct<_dev: string>>>>
"""


def parsed(docs: DataFrame) -> DataFrame:
    """docs (host_id, domain_name, xml) with the document as a struct ``d``; one that is no XML has none of its fields."""
    domain = F.from_xml("xml", DOMAIN, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    return docs.select("host_id", "domain_name", domain.alias("d")).withColumn("instance", F.trim("d.uuid"))


def _texts(array: str, of) -> Column:
    """Non-blank texts of an array of elements; without the element an empty array."""
    return F.filter(F.transform(F.coalesce(F.col(array), F.array()), lambda x: F.trim(of(x))), lambda t: t != "")


def inventory(docs: DataFrame) -> DataFrame:
    """docs: host_id, domain_name, xml -> one row each, with arrays of ports, disks and interfaces."""
    of, number = "d.metadata.instance", lambda c: F.trim(c).try_cast("int")
    disks = F.filter(F.coalesce(F.col("d.devices.disk"), F.array()), lambda x: x["_device"] == "disk")
    return parsed(docs).withColumn("disks", disks).select(
        "host_id", "domain_name", "instance",
        F.coalesce(F.nullif(F.trim(f"{of}.name"), F.lit("")), F.col("domain_name")).alias("server_name"),
        scalars.project_name(F.coalesce(F.trim(f"{of}.owner.project"), F.lit(""))).alias("project"),
        F.coalesce(F.trim(f"{of}.owner.user"), F.lit("")).alias("owner"),
        number(F.col(f"{of}.flavor.memory")).alias("mem_mb"), number(F.col(f"{of}.flavor.vcpus")).alias("vcpus"),
        _texts(f"{of}.ports.port", lambda x: x["_uuid"]).alias("port_uuids"),
        _texts("d.devices.interface", lambda x: x["target"]["_dev"]).alias("ifaces"),
        _texts("disks", lambda x: x["target"]["_dev"]).alias("disk_targets"),
    )


def inventory_ports(docs: DataFrame) -> DataFrame:
    """host_id, instance, port_uuid, ip (BINARY), family: blank ports and addresses are skipped, the version defaults to 4."""
    ports = parsed(docs).select("host_id", "instance", F.explode("d.metadata.instance.ports.port").alias("port"))
    ips = ports.select("host_id", "instance", F.trim("port._uuid").alias("port_uuid"), F.explode("port.ip").alias("at"))
    ips = ips.select(
        "host_id", "instance", "port_uuid", addr.parse(F.col("at._address")).alias("ip"),
        F.coalesce(F.nullif(F.trim("at._ipVersion"), F.lit("")), F.lit("4")).alias("family"),
    )
    return ips.where("port_uuid <> '' and ip is not null").distinct()


def inventory_disks(docs: DataFrame) -> DataFrame:
    """host_id, instance, path, disk_type, volume of every disk (no CD or floppy drives)."""
    disks = parsed(docs).select("host_id", "instance", F.explode("d.devices.disk").alias("disk")).where("disk._device = 'disk'")
    text = lambda c: F.trim(F.coalesce(F.col(f"disk.{c}"), F.lit("")))
    kind, volume = scalars.disk_type(text("_type"), text("source._file"), text("source._name"))
    return disks.select("host_id", "instance", text("target._dev").alias("path"), kind.alias("disk_type"), volume.alias("volume")).where("path <> ''")


def inventory_ifaces(docs: DataFrame) -> DataFrame:
    return inventory(docs).select("host_id", "instance", F.explode("ifaces").alias("iface")).distinct()


# ---- statistics ----------------------------------------------------------------------


def _fields(stats: DataFrame) -> DataFrame:
    parts = F.split("field", r"\.")
    value = F.when(F.lower("value") == "true", "1").when(F.lower("value") == "false", "0").otherwise(F.col("value"))
    return stats.withColumns({"_group": F.get(parts, 0), "_idx": F.expr("try_cast(get(split(field, '[.]'), 1) as int)"), "_name": F.array_join(F.slice(parts, 3, 9), "."), "_text": value}).withColumn(
        "_num", F.expr("try_cast(_text as bigint)")
    )


def _pivot(rows: DataFrame, key: list[str], names: dict[str, str]) -> DataFrame:
    """One conditional maximum for each named field: a single aggregate."""
    cells = [F.coalesce(F.max(F.when(F.col("_name") == f, F.col("_num"))), F.lit(0)).alias(c) for f, c in names.items()]
    return rows.groupBy(*key).agg(*cells, F.max(F.when(F.col("_name") == "name", F.col("_text"))).alias("name"))


def disk_samples(stats: DataFrame) -> DataFrame:
    """stats: host_id, instance, ts, field, value -> a row for each block device."""
    rows = _fields(stats).where("_group = 'block' and _idx is not null")
    names = {f"{k}.{n}": f"{k}_{c}" for k in ("rd", "wr", "fl") for n, c in (("reqs", "reqs"), ("bytes", "bytes"), ("times", "ns"))}
    out = _pivot(rows, ["host_id", "instance", "ts", "_idx"], names | {x: x for x in ("capacity", "allocation", "physical")})
    return out.withColumnRenamed("name", "path").withColumn("allocation", scalars.disk_allocation(F.col("allocation"), F.col("physical"))).drop("_idx")


def net_samples(stats: DataFrame) -> DataFrame:
    rows = _fields(stats).where("_group = 'net' and _idx is not null")
    names = {f"{d}.{n}": f"{d}_{c}" for d in ("rx", "tx") for n, c in (("bytes", "bytes"), ("pkts", "packets"), ("errs", "errors"), ("drop", "drops"))}
    return _pivot(rows, ["host_id", "instance", "ts", "_idx"], names).withColumnRenamed("name", "iface").drop("_idx")


def vcpu_samples(stats: DataFrame) -> DataFrame:
    rows = _fields(stats).where("_group = 'vcpu' and _idx is not null")
    return _pivot(rows, ["host_id", "instance", "ts", "_idx"], {x: x for x in ("state", "time", "wait", "delay")}).drop("name").withColumnRenamed("_idx", "vcpu")


def machine_samples(stats: DataFrame) -> DataFrame:
    """State, processor and memory counters, one row each."""
    fields = {
        "state.state": "state", "cpu.time": "cpu_ns", "cpu.user": "user_ns", "cpu.system": "system_ns", "balloon.current": "current_kib",
        "balloon.maximum": "maximum_kib", "balloon.usable": "usable_kib", "balloon.rss": "rss_kib", "balloon.swap_in": "swap_in",
        "balloon.swap_out": "swap_out", "balloon.major_fault": "major_faults", "balloon.minor_fault": "minor_faults",
    }
    rows = _fields(stats).where(F.col("field").isin(*fields))
    cells = [F.coalesce(F.max(F.when(F.col("field") == f, F.col("_num"))), F.lit(0)).alias(c) for f, c in fields.items()]
    return rows.groupBy("host_id", "instance", "ts").agg(*cells).withColumn("state_desc", scalars.state_desc(F.col("state")))


# ---- zone maps -----------------------------------------------------------------------


def _zone_lines(lines: DataFrame, ports: DataFrame) -> DataFrame:
    """lines: host_id, line_no, line; ports: host_id, port_uuid, instance, ip."""
    words = F.split(F.trim("line"), r"\s+")
    number = F.filter(words, lambda w: w.rlike("^[0-9]{1,9}$"))
    parsed = lines.select(
        "host_id", "line_no", F.get(F.filter(words, lambda w: w.rlike(UUID)), 0).alias("port_uuid"),
        F.get(F.filter(F.transform(number, lambda w: w.cast("int")), lambda z: z <= 65535), 0).alias("zone"),
    )
    known = ports.where(F.length("port_uuid") == 36).groupBy("host_id", "port_uuid").agg(F.min("instance").alias("instance"))
    return parsed.join(known, ["host_id", "port_uuid"], "left")


def zone_map(lines: DataFrame, ports: DataFrame) -> DataFrame:
    """Zone -> machine and its port's addresses: the last line wins, for the addresses the last that has any."""
    good = _zone_lines(lines, ports).where("zone is not null and instance is not null")
    owner = good.groupBy("host_id", "zone").agg(F.max_by("instance", "line_no").alias("instance"))
    with_ips = good.join(ports.select("host_id", "port_uuid").where("ip is not null").distinct(), ["host_id", "port_uuid"], "left_semi")
    port = with_ips.groupBy("host_id", "zone").agg(F.max_by("port_uuid", "line_no").alias("port_uuid"))
    ips = port.join(ports.select("host_id", "port_uuid", "ip"), ["host_id", "port_uuid"]).select("host_id", "zone", "ip").distinct()
    return owner.join(ips, ["host_id", "zone"], "left")


def zone_map_quality(lines: DataFrame, ports: DataFrame) -> DataFrame:
    c = F.col
    return _zone_lines(lines, ports).groupBy("host_id").agg(
        F.count("*").alias("lines_total"), F.count_if(c("port_uuid").isNull()).alias("no_uuid"),
        F.count_if(c("port_uuid").isNotNull() & c("zone").isNull()).alias("no_zone"),
        F.count_if(c("port_uuid").isNotNull() & c("zone").isNotNull() & c("instance").isNull()).alias("unknown_port"),
        F.count_if(c("zone").isNotNull() & c("instance").isNotNull()).alias("parsed"),
    )


# ---- threat lists --------------------------------------------------------------------


def threat_ips(lines: DataFrame) -> DataFrame:
    """lines: list, line -> list, ip. Comments, blanks, networks and what is no address go."""
    text = F.trim("line")
    rows = lines.where((text != "") & ~text.startswith("#")).select("list", addr.parse(text).alias("ip"))
    return rows.where("ip is not null").distinct()


def threat_relays(docs: DataFrame) -> DataFrame:
    """docs: list, json -> list, ip, from relays[].or_addresses[] with or without ports."""
    schema = "struct<relays:array<struct<or_addresses:array<string>>>>"
    rows = docs.select("list", F.explode(F.flatten(F.from_json("json", schema)["relays"]["or_addresses"])).alias("a"))
    bare = F.when(F.col("a").startswith("["), F.regexp_extract("a", r"^\[([^\]]*)\]", 1)).when(
        F.col("a").rlike("^[^:]*:[0-9]+$"), F.regexp_extract("a", "^([^:]*):", 1)
    ).otherwise(F.col("a"))
    return rows.select("list", addr.parse(bare).alias("ip")).where("ip is not null").distinct()


def threat_cidrs(lines: DataFrame) -> DataFrame:
    """lines: list, family, line ("network/len ; comment") -> list, family, prefix_len, network."""
    text = F.trim(F.get(F.split("line", ";"), 0))
    rows = lines.where((text != "") & ~text.startswith("#")).select(
        "list", "family", addr.parse(F.get(F.split(text, "/"), 0)).alias("network"), F.expr("try_cast(get(split(trim(get(split(line, ';'), 0)), '/'), 1) as int)").alias("prefix_len")
    )
    right = F.when(addr.is_v4_mapped(F.col("network")), (F.col("family") == 4) & F.col("prefix_len").between(0, 32)).otherwise(
        (F.col("family") == 6) & F.col("prefix_len").between(0, 128)
    )
    return rows.where(F.col("network").isNotNull() & right).distinct()


# ---- ports and rules -----------------------------------------------------------------


PORTS_DOCUMENT = "struct<behavior: struct<ports: struct<inbound_monitored: map<string,string>, outbound_monitored: map<string,string>>>>"


def ports_file(spark: SparkSession, path: str | None) -> tuple[DataFrame | None, str]:
    """A JSON document of ports -> direction, port, name, and whether it could be read: not_configured, missing, parse_error or read."""
    if not (path or "").strip():
        return None, "not_configured"
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return None, "missing"
    read = text.select(F.from_json("value", f"{PORTS_DOCUMENT[:-1]}, _corrupt_record: string>", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("d"))
    if not read.where("d is null or d._corrupt_record is not null").isEmpty():
        return None, "parse_error"
    side = lambda d: F.transform(F.map_entries(F.coalesce(F.col(f"d.behavior.ports.{d}_monitored"), F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lit(d).alias("direction"), e["key"].try_cast("int").alias("port"), e["value"].alias("name")))
    return read.select(F.inline(F.concat(side("inbound"), side("outbound")))), "read"


def monitored_ports(spark: SparkSession, config: DataFrame | None, builtin: dict[str, dict[int, str]], read: str = "not_configured") -> tuple[DataFrame, str, str]:
    """config: direction, port, name. A direction it gives replaces the built-in one; anything invalid brings all of those back.

    Also the status (read's own where there is no config) and what is in use: builtin, file or mixed.
    """
    rows = [(d, p, n) for d, ports in builtin.items() for p, n in ports.items()]
    own = spark.createDataFrame(rows, "direction string, port int, name string")
    if config is None:
        return own, read, "builtin"
    wrong = config.where("port is null or port not between 1 and 65535 or trim(coalesce(name, '')) = '' or direction not in ('inbound', 'outbound')")
    if config.isEmpty() or not wrong.isEmpty():
        return own, "invalid", "builtin"
    given = config.select("direction").distinct()
    using = "file" if given.count() == 2 else "mixed"  # two directions at most
    return config.select("direction", "port", F.trim("name").alias("name")).unionByName(own.join(given, "direction", "left_anti")), "loaded", using


def external_rules(rules: DataFrame, port_sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rules (the first 100, in order) and rejects. port_sets: port_set, ports array<int>."""
    c = F.col
    joined = rules.join(port_sets, "port_set", "left")
    ports = F.array_distinct(F.filter(F.coalesce("ports", F.array().cast("array<int>")), lambda p: p.between(1, 65535)))
    problem = (
        F.when(F.coalesce(F.trim("rule_id"), F.lit("")) == "", "no_id").when(F.coalesce(F.trim("kind"), F.lit("")) == "", "no_kind")
        .when(~c("direction").isin("inbound", "outbound", "any"), "direction").when(c("ports").isNull(), "port_set")
        .when(F.size(ports) == 0, "ports").when(~c("mode").isin("any", "dominant_remote", "dominant_port", "distributed", "mixed"), "mode")
    )
    checked = joined.withColumns({"ports": ports, "problem": problem})
    order = Window.orderBy("rule_order")  # a table of rules is small
    least = lambda n: F.greatest(c(n), F.lit(0)).alias(n)
    good = checked.where("problem is null").withColumn("nth", F.row_number().over(order)).where("nth <= 100").select(
        "rule_order", "rule_id", c("kind").alias("rule_kind"), F.coalesce(F.nullif(F.trim("reason"), F.lit("")), F.lit("external_rule_match")).alias("rule_reason"),
        c("direction").alias("rule_direction"), "ports", least("flows_min"), least("remotes_min"), least("unreplied_min"),
        c("mode").alias("rule_mode"), least("remote_share_min"), least("port_share_min"),
    )
    return good, checked.where("problem is not null")
