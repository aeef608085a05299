"""The readers, on documents and lines that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import ip as addr
from ..functions import scalars
from ..operators import classifier, deltas
from ..sources import ingest
from ..sources.builtin_ports import BUILTIN
from .queries import IDENT, query

UUID_SQL = "lpad(CAST({n} AS STRING), 8, '0') || '-0000-4000-8000-' || lpad(CAST({n} AS STRING), 12, '0')"


def uuid(n: str) -> Column:
    text = F.col(n).cast("string")
    return F.concat(F.lpad(text, 8, "0"), F.lit("-0000-4000-8000-"), F.lpad(text, 12, "0"))


def documents(f):
    """One domain document for each supplier: two ports, a disk, a CD drive and two interfaces."""
    s = f.table("supplier").withColumn("k", F.col("s_suppkey") % 250)
    number = lambda c: F.col(c).cast("string")
    xml = F.concat(
        F.lit("<domain><name>dom"), number("s_suppkey"), F.lit("</name><uuid>"), uuid("s_suppkey"), F.lit('</uuid><metadata><m:instance xmlns:m="urn:m"><m:name> '),
        F.when(F.col("s_suppkey") % 5 == 0, "").otherwise(F.col("s_name")), F.lit(" </m:name><m:flavor><m:memory>"), (F.col("k") * 16).cast("string"),
        F.lit("</m:memory><m:vcpus>"), (F.col("k") % 8 + 1).cast("string"), F.lit("</m:vcpus></m:flavor><m:owner><m:user>u</m:user><m:project>"),
        F.when(F.col("s_suppkey") % 7 == 0, "  ").otherwise(F.concat(F.lit("p"), number("s_nationkey"))), F.lit('</m:project></m:owner><m:ports><m:port uuid="'),
        uuid("s_suppkey"), F.lit('"><m:ip type="fixed" address="10.1.'), number("k"), F.lit('.7" ipVersion="4"/><m:ip type="fixed" address="fd00::'), number("k"),
        F.lit('" ipVersion="6"/></m:port><m:port uuid=""><m:ip address="10.9.9.9"/></m:port></m:ports></m:instance></metadata><devices>'
              '<disk type="network" device="disk"><source protocol="rbd" name="pool/vol-'), number("s_suppkey"),
        F.lit('"/><target dev="vda"/></disk><disk type="file" device="cdrom"><target dev="hda"/></disk>'
              '<interface type="bridge"><target dev="tap0"/></interface><interface type="bridge"><target dev="tap1"/></interface></devices></domain>'),
    )
    return s.select(F.lit("h0").alias("host_id"), F.concat(F.lit("dom"), number("s_suppkey")).alias("domain_name"), xml.alias("xml"))


@query(f"SELECT {UUID_SQL.format(n='s_suppkey')} AS instance, CASE WHEN s_suppkey % 5 = 0 THEN concat('dom', s_suppkey) ELSE s_name END AS server_name, CASE WHEN s_suppkey % 7 = 0 THEN 'unknown' ELSE concat('p', s_nationkey) END AS project, s_suppkey % 250 * 16 AS mem_mb, s_suppkey % 250 % 8 + 1 AS vcpus, 2 AS ifaces FROM supplier")
def ingest_inventory_xml(f):
    rows = ingest.inventory(documents(f))
    return rows.select("instance", "server_name", "project", "mem_mb", "vcpus", F.size("ifaces").alias("ifaces"))


@query(f"SELECT {UUID_SQL.format(n='s_suppkey')} AS port_uuid, '4' AS family, '10.1.' || (s_suppkey % 250) || '.7' AS address FROM supplier UNION ALL SELECT {UUID_SQL.format(n='s_suppkey')}, '6', 'fd00:0:0:0:0:0:0:' || ltrim(CAST(s_suppkey % 250 AS STRING), '0') || CASE WHEN s_suppkey % 250 = 0 THEN '0' ELSE '' END FROM supplier")
def ingest_inventory_ports(f):
    short = F.regexp_replace(F.regexp_replace(addr.show(F.col("ip")), r"\b0{1,3}", ""), r"^fd:", "fd00:")
    address = F.when(F.col("family") == "4", addr.show(F.col("ip"))).otherwise(short)
    return ingest.inventory_ports(documents(f)).select("port_uuid", "family", address.alias("address"))


@query(f"SELECT {UUID_SQL.format(n='s_suppkey')} AS instance, 'vda' AS path, 'pool' AS disk_type, concat('vol-', s_suppkey) AS volume FROM supplier")
def ingest_inventory_disks(f):
    return ingest.inventory_disks(documents(f)).select("instance", "path", "disk_type", "volume")


def stats(f):
    """Long field/value rows of each counter sample."""
    c = F.col("counter")
    fields = [
        ("state.state", F.lit("1")), ("cpu.time", (c * 9).cast("string")), ("balloon.current", F.lit("2048")), ("balloon.rss", F.lit("1024")),
        ("vcpu.0.delay", (c * 2).cast("string")), ("vcpu.1.delay", (c * 3).cast("string")), ("vcpu.x.delay", F.lit("77")),
        ("block.0.name", F.lit("vda")), ("block.0.rd.reqs", (c * 5).cast("string")), ("block.0.wr.bytes", (c * 6).cast("string")),
        ("block.0.allocation", F.lit("0")), ("block.0.physical", F.lit("4096")), ("net.0.name", F.lit("tap0")), ("net.0.rx.pkts", c.cast("string")),
        ("net.0.tx.drop", (c % 7).cast("string")), ("net.1.name", F.lit("ghost")), ("net.1.rx.pkts", F.lit("5")),
    ]
    rows = F.array(*(F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in fields))
    return f.counters.where("event_type <> 'view'").select("host_id", "instance", "ts", F.inline(rows))


_C = "(SELECT * FROM counters WHERE event_type <> 'view')"


@query(f"SELECT host_id, instance, ts, counter * 9 AS cpu_ns, 2048 AS current_kib, 1024 AS rss_kib, 'running' AS state_desc FROM {_C}")
def ingest_domain_stats(f):
    return ingest.machine_samples(stats(f)).select("host_id", "instance", "ts", "cpu_ns", "current_kib", "rss_kib", "state_desc")


@query(f"SELECT host_id, instance, ts, 'vda' AS path, counter * 5 AS rd_reqs, counter * 6 AS wr_bytes, 4096 AS allocation FROM {_C}")
def ingest_disk_stats(f):
    return ingest.disk_samples(stats(f)).select("host_id", "instance", "ts", "path", "rd_reqs", "wr_bytes", "allocation")


@query(f"SELECT host_id, instance, ts, counter * 5 AS steal_ns FROM {_C}")
def ingest_vcpu_stats(f):
    return deltas.vcpu_steal_wait(ingest.vcpu_samples(stats(f))).select("host_id", "instance", "ts", "steal_ns")


@query(f"SELECT host_id, instance, ts, counter AS packets, counter % 7 AS drops FROM {_C}")
def join_known_ifaces(f):
    known = f.counters.select("instance", F.lit("tap0").alias("iface")).distinct()
    return deltas.net_totals(ingest.net_samples(stats(f)), known).select("host_id", "instance", "ts", "packets", "drops")


@query(f"SELECT instance, ts, CASE WHEN user_id % 2 = 0 THEN 'ssd' ELSE 'unknown' END AS disk_type, count(*) AS n FROM {_C} GROUP BY 1, 2, 3")
def join_disk_metadata(f):
    disks = f.counters.where("user_id % 2 = 0").select("instance", F.lit("vda").alias("path"), F.lit("ssd").alias("disk_type"), F.lit("v").alias("volume")).distinct()
    return deltas.join_disk_metadata(ingest.disk_samples(stats(f)), disks).groupBy("instance", "ts", "disk_type").agg(F.count("*").alias("n"))


def zone_lines(f):
    """A line for each supplier: zones repeat, some lines lack the zone, the port, or name an unknown port."""
    s = F.col("s_suppkey")
    line = (
        F.when(s % 11 == 0, F.concat(F.lit("zone "), (s % 40).cast("string"))).when(s % 13 == 0, F.concat(uuid("s_suppkey"), F.lit(" none")))
        .otherwise(F.concat(uuid("s_suppkey"), F.lit("  "), (s % 40).cast("string")))
    )
    return f.table("supplier").select(F.lit("h0").alias("host_id"), s.alias("line_no"), line.alias("line"))


def zone_ports(f):
    s = f.table("supplier").where("s_suppkey % 17 <> 0")
    return s.select(F.lit("h0").alias("host_id"), uuid("s_suppkey").alias("port_uuid"), F.concat(F.lit("vm"), F.col("s_suppkey").cast("string")).alias("instance"),
                    F.when(F.col("s_suppkey") % 3 > 0, addr.from_long(F.col("s_suppkey") + 167772160)).alias("ip"))


_Z = "(SELECT s_suppkey % 40 AS zone, s_suppkey AS k FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 13 <> 0 AND s_suppkey % 17 <> 0)"


@query(f"SELECT o.zone, concat('vm', o.k) AS instance, i.k + 167772160 AS ip FROM (SELECT zone, max(k) AS k FROM {_Z} GROUP BY zone) o LEFT JOIN (SELECT zone, max(k) AS k FROM {_Z} WHERE k % 3 > 0 GROUP BY zone) i ON i.zone = o.zone")
def ingest_zone_map(f):
    return ingest.zone_map(zone_lines(f), zone_ports(f)).select("zone", "instance", "ip")


@query("SELECT 'h0' AS host_id, count(*) AS lines_total, sum(CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END) AS no_uuid, sum(CASE WHEN k % 11 <> 0 AND k % 13 = 0 THEN 1 ELSE 0 END) AS no_zone, sum(CASE WHEN k % 11 <> 0 AND k % 13 <> 0 AND k % 17 = 0 THEN 1 ELSE 0 END) AS unknown_port, sum(CASE WHEN k % 11 <> 0 AND k % 13 <> 0 AND k % 17 <> 0 THEN 1 ELSE 0 END) AS parsed FROM (SELECT s_suppkey AS k FROM supplier)")
def zone_map_quality(f):
    return ingest.zone_map_quality(zone_lines(f), zone_ports(f))


def list_lines(f):
    s = F.col("s_suppkey")
    address = F.concat_ws(".", F.lit("8"), F.lit("8"), F.expr("s_suppkey div 250 + 1").cast("string"), (s % 250).cast("string"))
    line = (
        F.when(s % 6 == 0, F.concat(F.lit("# "), address)).when(s % 6 == 1, F.concat(address, F.lit("%eth0"))).when(s % 6 == 2, F.concat(address, F.lit("/24")))
        .when(s % 6 == 3, F.concat(F.lit("  "), address, F.lit(" "))).when(s % 6 == 4, F.concat(F.lit("300."), address)).otherwise(F.concat(F.lit("2001:db8::"), F.hex(s)))
    )
    return f.table("supplier").select(F.lit("custom").alias("list"), line.alias("line"), s.alias("k"), address.alias("address"))


_ADDR = "8.8.' || (s_suppkey // 250 + 1) || '.' || (s_suppkey % 250)"


@query(f"SELECT 'custom' AS list, '{_ADDR} AS address, 1 AS v4 FROM supplier WHERE s_suppkey % 6 IN (1, 3) UNION ALL SELECT 'custom', '2001:0db8:0000:0000:0000:0000:0000:' || lpad(lower(hex(s_suppkey)), 4, '0'), 0 FROM supplier WHERE s_suppkey % 6 = 5")
def ingest_threat_ip_list(f):
    return ingest.threat_ips(list_lines(f)).select("list", addr.show(F.col("ip")).alias("address"), addr.is_v4_mapped(F.col("ip")).cast("int").alias("v4"))


@query(f"SELECT DISTINCT 'relays' AS list, '{_ADDR} AS address FROM supplier WHERE s_suppkey % 6 <> 4")
def ingest_threat_relay_json(f):
    a = F.col("address")
    text = F.when(F.col("k") % 2 == 0, F.concat(a, F.lit(":9001"))).otherwise(a)
    docs = list_lines(f).select(F.lit("relays").alias("list"), F.concat(F.lit('{"relays":[{"or_addresses":["'), F.when(F.col("k") % 6 == 4, "bad").otherwise(text), F.lit('"]}]}')).alias("json"))
    return ingest.threat_relays(docs).select("list", addr.show(F.col("ip")).alias("address"))


@query("SELECT list, prefix_len, count(*) AS networks FROM (SELECT DISTINCT 'drop' AS list, 16 + s_suppkey % 16 AS prefix_len, s_suppkey AS k FROM supplier WHERE s_suppkey % 5 > 1) GROUP BY list, prefix_len")
def ingest_threat_cidr_list(f):
    k = F.col("k")
    net = F.concat(F.col("address"), F.lit("/"), (16 + k % 16).cast("string"), F.lit(" ; SBL"), k.cast("string"))
    line = F.when(k % 5 == 0, F.concat(F.lit("; "), net)).when(k % 5 == 1, "2001:db8::/32 ; six").otherwise(net)
    lines = list_lines(f).select(F.lit("drop").alias("list"), F.lit(4).alias("family"), line.alias("line"))
    return ingest.threat_cidrs(lines).groupBy("list", "prefix_len").agg(F.count("*").alias("networks"))


@query("SELECT direction, count(*) AS ports, 'loaded' AS status, 'mixed' AS source FROM (SELECT 'inbound' AS direction, s_suppkey FROM supplier WHERE s_suppkey BETWEEN 1 AND 65535 UNION ALL SELECT * FROM (SELECT 'outbound' AS direction, UNNEST(range(50)) AS n)) GROUP BY direction")
def load_monitored_ports(f):
    config = f.table("supplier").select(F.lit("inbound").alias("direction"), F.col("s_suppkey").cast("int").alias("port"), F.col("s_name").alias("name")).where("port between 1 and 65535")
    ports, status, using = ingest.monitored_ports(f.spark, config, BUILTIN)
    return ports.groupBy("direction").agg(F.count("*").alias("ports")).withColumns({"status": F.lit(status), "source": F.lit(using)})


def rule_table(f):
    """Fifteen rules, some of them broken, from the first nations."""
    n = F.col("n_nationkey")
    return f.table("nation").where("n_nationkey < 15").select(
        n.alias("rule_order"), F.when(n % 7 == 6, "").otherwise(F.concat(F.lit("r"), n.cast("string"))).alias("rule_id"), F.concat(F.lit("kind"), n.cast("string")).alias("kind"),
        F.lit("").alias("reason"), F.when(n % 5 == 4, "sideways").when(n % 2 == 0, "outbound").otherwise("inbound").alias("direction"),
        F.when(n % 4 == 3, "none").otherwise(F.lit("web")).alias("port_set"), (n * 3 + 10).alias("flows_min"), (n + 5).alias("remotes_min"),
        F.lit(0.1).alias("unreplied_min"), F.lit("any").alias("mode"), F.lit(-1.0).alias("remote_share_min"), F.lit(0.0).alias("port_share_min"),
    )


def port_sets(f):
    return f.table("region").where("r_regionkey = 0").select(F.lit("web").alias("port_set"), F.expr("array(80, 443, 0, 80)").alias("ports"))


@query("SELECT n_nationkey AS rule_order, n_nationkey % 7 <> 6 AND n_nationkey % 5 <> 4 AND n_nationkey % 4 <> 3 AS valid FROM nation WHERE n_nationkey < 15")
def load_external_rules(f):
    good, bad = ingest.external_rules(rule_table(f), port_sets(f))
    return good.select("rule_order", F.lit(True).alias("valid")).union(bad.select("rule_order", F.lit(False)))


_R = "(SELECT n_nationkey AS o, CASE WHEN n_nationkey % 2 = 0 THEN 'outbound' ELSE 'inbound' END AS d FROM nation WHERE n_nationkey < 15 AND n_nationkey % 7 <> 6 AND n_nationkey % 5 <> 4 AND n_nationkey % 4 <> 3)"


@query(f"SELECT s.host_id, s.instance, s.ip, s.direction, s.ts, concat('r', min(r.o)) AS rule_id FROM featm s JOIN {_R} r ON r.d = s.direction AND s.flows >= r.o * 3 + 10 AND s.unique_remotes >= r.o + 5 AND s.unreplied_ratio >= 0.1 WHERE EXISTS (SELECT 1 FROM prt p WHERE p.host_id = s.host_id AND p.instance = s.instance AND p.ip = s.ip AND p.direction = s.direction AND p.ts = s.ts AND p.port IN (80, 443)) GROUP BY 1, 2, 3, 4, 5")
def match_external_rules(f):
    good, _ = ingest.external_rules(rule_table(f), port_sets(f))
    return classifier.match_external(f.features, f.ports, good).select(*IDENT, F.col("hit.rule_id").alias("rule_id"))


@query(f"SELECT c.host_id, c.instance, c.ip, c.direction, c.ts, coalesce(c.kind, concat('kind', m.o)) AS kind, coalesce(c.rule_id, concat('r', m.o)) AS rule_id, CASE WHEN c.kind IS NULL THEN 'external' ELSE 'internal' END AS source FROM cls c LEFT JOIN (SELECT s.host_id, s.instance, s.ip, s.direction, s.ts, min(r.o) AS o FROM featm s JOIN {_R} r ON r.d = s.direction AND s.flows >= r.o * 3 + 10 AND s.unique_remotes >= r.o + 5 AND s.unreplied_ratio >= 0.1 WHERE EXISTS (SELECT 1 FROM prt p WHERE p.host_id = s.host_id AND p.instance = s.instance AND p.ip = s.ip AND p.direction = s.direction AND p.ts = s.ts AND p.port IN (80, 443)) GROUP BY 1, 2, 3, 4, 5) m ON m.host_id = c.host_id AND m.instance = c.instance AND m.ip = c.ip AND m.direction = c.direction AND m.ts = c.ts WHERE coalesce(c.kind, concat('kind', m.o)) <> 'kind'")
def rule_external(f):
    """User rules behind all others."""
    good, _ = ingest.external_rules(rule_table(f), port_sets(f))
    rows = classifier.classify(f.scored, classifier.match_external(f.features, f.ports, good), f.config)
    return rows.where("kind is not null").select(*IDENT, "kind", "rule_id", "source")


@query("SELECT list, family, count(*) AS networks FROM (SELECT DISTINCT 'drop' AS list, s_suppkey % 2 * 2 + 4 AS family, s_suppkey AS k FROM supplier WHERE s_suppkey % 10 > 1) GROUP BY list, family")
def union_cidr_lists(f):
    """A list of both families, from one file of lines for each."""
    k = F.col("k")
    four = F.concat(F.col("address"), F.lit("/32 ; x"))
    six = F.concat(F.lit("2001:db8:"), F.hex(k), F.lit("::/48 ; x"))
    line = F.when(k % 10 < 2, F.lit("; none")).when(k % 2 == 0, four).otherwise(six)
    lines = list_lines(f).select(F.lit("drop").alias("list"), F.when(k % 2 == 0, 4).otherwise(6).alias("family"), line.alias("line"))
    both = ingest.threat_cidrs(lines.where("family = 4")).unionByName(ingest.threat_cidrs(lines.where("family = 6")))
    return both.groupBy("list", "family").agg(F.count("*").alias("networks"))


@query("SELECT o_orderpriority, CASE WHEN x THEN 'out' ELSE 'in' END AS contact, count(*) AS n FROM (SELECT o_orderpriority, o_custkey % 2 = 0 AS x FROM orders) GROUP BY 1, 2")
def parse_contact_direction(f):
    text = F.when(F.col("o_custkey") % 2 == 0, " Src ").otherwise(" inbound")
    return f.table("orders").groupBy("o_orderpriority", scalars.contact_direction(text).alias("contact")).agg(F.count("*").alias("n"))


@query("SELECT instance, round(CASE WHEN r THEN CASE WHEN u > 0 AND c >= u THEN c - u WHEN s > 0 THEN s ELSE c END / 1024.0 ELSE 0 END, 4) AS used, CASE WHEN s > 0 THEN s ELSE 7 END AS effective, count(*) AS n FROM (SELECT instance, step % 3 > 0 AS r, step % 900 AS c, step % 1100 AS u, step % 2 * 50 AS s FROM counters) GROUP BY 1, 2, 3")
def guest_memory(f):
    s = F.col("step")
    used = scalars.guest_used_mb(s % 3 > 0, s % 900, s % 1100, s % 2 * 50)
    return f.counters.groupBy("instance", F.round(used, 4).alias("used"), scalars.observed(F.lit(7), s % 2 * 50).alias("effective")).agg(F.count("*").alias("n"))
