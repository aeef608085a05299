"""The star-schema tables seen as fleet telemetry. The view texts run on Spark and, for the oracles, on DuckDB."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import IDENTITY, Config
from ..functions import ip as addr
from ..operators import attribution, classifier, deltas, features, folds, scoring, threat
from ..sources.builtin_ports import BUILTIN
from ..streaming.state import settings, shared

START = 1704067200  # the first snapshot; one every 15 s

INSTANCES = """
SELECT concat('h', CAST(n_nationkey % 2 AS STRING)) AS host_id, concat('vm', CAST(n_nationkey AS STRING)) AS instance, n_name AS server_name,
       concat('p', CAST(n_regionkey AS STRING)) AS project, concat('u', CAST(n_nationkey % 4 AS STRING)) AS owner,
       CAST(CASE WHEN n_nationkey < 4 THEN 167772161 + n_nationkey % 2 ELSE 167772416 + n_nationkey END AS BIGINT) AS ip,
       100 + n_nationkey AS zone, 1 + n_nationkey % 16 AS vcpus, 512 * (1 + n_nationkey % 32) AS mem_mb, 300 * (1 + n_nationkey % 40) AS used_mb
FROM nation WHERE n_nationkey < 20"""

FLOW_BASE = f"""
SELECT concat('vm', CAST(o.o_custkey % 20 AS STRING)) AS instance,
       CAST({START} + 15 * ((year(o.o_orderdate) - 1995) * 4 + quarter(o.o_orderdate) - 1) AS BIGINT) AS ts,
       l.l_linenumber % 3 = 0 AS inbound,
       CAST(CASE WHEN l.l_partkey % 97 = 0 THEN 2852039166 WHEN l.l_partkey % 101 = 0 THEN 3758096385
            WHEN l.l_partkey % 89 = 0 THEN 167772416 + 4 + l.l_suppkey % 16
            ELSE 134744072 + 7 * l.l_suppkey + l.l_partkey % 5 END AS BIGINT) AS remote_ip,
       CASE WHEN l.l_partkey % 499 = 0 THEN 179 WHEN l.l_partkey % 8 = 0 THEN 443 WHEN l.l_partkey % 8 = 1 THEN 80
            WHEN l.l_partkey % 8 = 2 THEN 22 WHEN l.l_partkey % 8 = 3 THEN 25 WHEN l.l_partkey % 8 = 4 THEN 53
            WHEN l.l_partkey % 8 = 5 THEN 3333 WHEN l.l_partkey % 8 = 6 THEN 0 ELSE 20000 + l.l_partkey % 50 END AS dst_port,
       CASE WHEN l.l_linenumber = 7 THEN 1 WHEN l.l_linenumber % 2 = 0 THEN 17 ELSE 6 END AS proto,
       1024 + l.l_partkey % 60000 AS src_port,
       CASE WHEN l.l_suppkey % 4 = 0 THEN 0 ELSE 100 + o.o_custkey % 20 END AS zone,
       CAST(floor(l.l_quantity) AS BIGINT) AS fwd_packets,
       CASE WHEN l.l_returnflag = 'R' THEN 0 ELSE CAST(floor(l.l_quantity) AS BIGINT) + 1 END AS rev_packets,
       CAST(floor(l.l_extendedprice) AS BIGINT) AS fwd_bytes,
       CASE WHEN l.l_returnflag = 'R' THEN 0 ELSE CAST(floor(l.l_extendedprice) AS BIGINT) END AS rev_bytes
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"""

FLOWS = """
SELECT i.host_id, f.ts, CASE WHEN f.inbound THEN f.remote_ip ELSE i.ip END AS src_ip, CASE WHEN f.inbound THEN i.ip ELSE f.remote_ip END AS dst_ip,
       f.src_port, f.dst_port, f.proto, f.zone, f.fwd_packets, f.fwd_bytes, f.rev_packets, f.rev_bytes
FROM flow_base f JOIN inst i ON f.instance = i.instance"""

HOST_IPS = """
SELECT concat('h', CAST(s_suppkey % 2 AS STRING)) AS host_id, concat('eth', CAST(s_suppkey % 3 AS STRING)) AS iface,
       CAST(134744072 + 7 * s_suppkey AS BIGINT) AS ip FROM supplier WHERE s_suppkey % 25 = 0"""

THREAT_IPS = """
SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'custom' ELSE 'relays' END AS list, CAST(134744072 + 7 * s_suppkey AS BIGINT) AS ip
FROM supplier WHERE s_suppkey % 7 = 0"""

THREAT_CIDRS = """
SELECT 'drop' AS list, 29 AS prefix_len, CAST((134744072 + 7 * s_suppkey) - (134744072 + 7 * s_suppkey) % 8 AS BIGINT) AS network
FROM supplier WHERE s_suppkey % 11 = 0
UNION ALL SELECT 'drop', 8, CAST(2852039166 - 2852039166 % 16777216 AS BIGINT) FROM supplier WHERE s_suppkey = 1"""

#: Cumulative counters with resets, one sample for each event of a user.
COUNTERS = """
SELECT concat('h', CAST(user_id % 2 AS STRING)) AS host_id, concat('m', CAST(user_id AS STRING)) AS instance, user_id, event_id, event_type, ts,
       CAST(sum(step) OVER (PARTITION BY user_id, epoch ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS counter,
       step, 1 + user_id % 8 AS vcpus
FROM (SELECT user_id, event_id, event_type, ts, CAST(floor(value * 100) AS BIGINT) AS step,
             sum(CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS epoch FROM events) e"""

#: Feature columns as a fleet with far more traffic would have them, so that the rules with high thresholds meet rows on either side of them.
LOUD = {
    "flows": "flows * 40", "dark_flows": "dark_flows * 8", "smtp_flows": "smtp_flows * 40", "stratum_flows": "stratum_flows * 2", "udp": "udp * 40",
    "icmp": "icmp * 40", "multicast": "multicast * 60", "unique_remotes": "CASE WHEN flows % 11 = 0 THEN CAST(floor(unique_remotes / 4) AS BIGINT) ELSE unique_remotes * 8 END", "new_remotes": "new_remotes * 8",
    "unique_ports": "CASE WHEN flows % 5 = 0 THEN least(unique_ports, 4) ELSE unique_ports * 4 END",
    "geneve_flows": "CASE WHEN flows % 7 = 0 THEN flows ELSE 0 END", "bgp_flows": "CASE WHEN flows % 5 = 0 THEN bgp_flows ELSE 0 END", "metadata_flows": "CASE WHEN flows % 2 = 0 THEN metadata_flows * 40 ELSE metadata_flows * 10 END",
    "metadata_unreplied_ratio": "CASE WHEN flows % 3 = 0 THEN 0.7 ELSE metadata_unreplied_ratio END", "infra_max_flows": "CASE WHEN flows % 3 = 0 AND infra_hits > 0 THEN flows * 20 ELSE infra_max_flows END",
    "top_port": "CASE WHEN flows % 11 = 0 THEN 3333 ELSE top_port END",
    "unreplied_ratio": "CASE WHEN flows % 3 = 0 THEN least(1, unreplied_ratio * 3) WHEN flows % 3 = 1 THEN unreplied_ratio / 4 ELSE unreplied_ratio END",
    "bytes_per_flow": "CASE WHEN flows % 2 = 0 THEN bytes_per_flow / 100 ELSE bytes_per_flow * 10 END",
    "mode": "CASE WHEN flows % 4 = 0 THEN 'dominant_remote' WHEN flows % 4 = 1 THEN 'dominant_port' ELSE mode END",
    "remote_share": "CASE WHEN flows % 4 = 0 THEN 0.95 ELSE remote_share END", "port_share": "CASE WHEN flows % 4 = 1 THEN 0.8 ELSE port_share END",
    "host_impact": "host_impact * 10", "signal": "least(1, signal * 2)",
}

#: Contact direction of each list.
CONTACT = {"custom": "any", "relays": "out", "drop": "in"}
TABLE_MAX = 500


class Fleet:
    """Lazy frames over one data directory."""

    #: Islands of presence; none where machines stay.
    islands: DataFrame | None = None

    def __init__(self, spark: SparkSession, sf_dir: str, config: Config = Config()):
        self.spark, self.sf_dir, self.config = spark, sf_dir, config

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """The view text with its table names bound to frames."""
        import re

        for name in frames:
            text = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)
        return self.spark.sql(text, **frames)

    @cached_property
    def instances(self) -> DataFrame:
        return self.sql(INSTANCES, nation=self.table("nation")).withColumn("ip", addr.from_long(F.col("ip")))

    @cached_property
    def zone_ips(self) -> DataFrame:
        return self.instances.select("host_id", "zone", "instance", "ip")

    @cached_property
    def instance_ips(self) -> DataFrame:
        return self.instances.select("host_id", "instance", "ip")

    @cached_property
    def flows(self) -> DataFrame:
        base = self.sql(FLOW_BASE, lineitem=self.table("lineitem"), orders=self.table("orders"))
        inst = self.sql(INSTANCES, nation=self.table("nation"))
        rows = self.sql(FLOWS, flow_base=base, inst=inst)
        rows = rows.withColumns({c: addr.from_long(F.col(c)) for c in ("src_ip", "dst_ip")}).withColumn("snapshot_ts", F.timestamp_seconds("ts")).drop("ts")
        return attribution.read_flows(rows)

    @cached_property
    def attributed(self) -> DataFrame:
        return attribution.attribute(self.flows, self.zone_ips, self.instance_ips)

    @cached_property
    def events(self) -> DataFrame:
        return attribution.identity_events(self.attributed, self.config.accounting)

    def written(self, name: str, rows: DataFrame) -> DataFrame:
        """rows from a table of their own in the shared folder: what several branches of a query read is made once, and its size is known."""
        folder = shared(self.spark)
        rows.write.parquet(f"{folder}/{name}")
        return self.spark.read.parquet(f"{folder}/{name}")

    def keep(self, *names: str) -> None:
        """Writes these frames, for a query that has many uses of them."""
        for name in names:
            self.__dict__[name] = self.written(name, getattr(self, name))

    @cached_property
    def seen(self) -> DataFrame:
        """Flow counts by remote, written once; all that the feature chain needs of the flows."""
        with settings(self.spark, **features.IN_ORDER):
            return self.written("seen", features.seen(self.events))

    @property
    def remotes(self) -> DataFrame:
        return self.seen.drop("ports") if "seen" in self.__dict__ else features.by_remote(self.events)

    @cached_property
    def ports_seen(self) -> DataFrame:
        """Flow counts by port, few beside those by remote; written once, as several steps read them."""
        return self.written("ports", features.ports_seen(self.seen))

    @property
    def ports(self) -> DataFrame:
        return self.ports_seen if "seen" in self.__dict__ else features.by_port(self.events)

    @cached_property
    def host_ips(self) -> DataFrame:
        return self.sql(HOST_IPS, supplier=self.table("supplier")).withColumn("ip", addr.from_long(F.col("ip")))

    @cached_property
    def monitored(self) -> DataFrame:
        rows = [(d, p, n) for d, ports in BUILTIN.items() for p, n in ports.items()]
        return self.spark.createDataFrame(rows, "direction string, port int, name string")

    @cached_property
    def table_max(self) -> DataFrame:
        return self.instances.select("host_id").distinct().withColumn("table_max", F.lit(TABLE_MAX))

    @cached_property
    def totals(self) -> DataFrame:
        return attribution.instance_flow_totals(self.attributed)

    @cached_property
    def features(self) -> DataFrame:
        """A row for each identity and snapshot, few beside the flows; written once, since scores, hits and rules each ask for them."""
        counts = self.written("counts", features.remote_counts(self.seen, self.host_ips))
        totals = features.totals_of(counts)
        rows = features.features_of(self.remotes, self.ports, self.host_ips, self.monitored, totals, self.table_max, self.config, self.islands, counts)
        return self.written("features", rows)

    @cached_property
    def scored(self) -> DataFrame:
        """Features with their averages, anomalies and signal."""
        return folds.flow_ewma(self.features, self.config)

    @cached_property
    def classified(self) -> DataFrame:
        return classifier.classify(self.scored, config=self.config)

    @cached_property
    def loud(self) -> DataFrame:
        """The scored features of the fleet with more traffic. What is observed keeps the columns from being written out once for each use in the rules."""
        return self.scored.withColumns({c: F.expr(sql) for c, sql in LOUD.items()}).observe("loud", F.count(F.lit(1)).alias("rows"))

    @cached_property
    def alerts(self) -> DataFrame:
        return scoring.score_alerts(self.classified, self.config)

    @cached_property
    def gated(self) -> DataFrame:
        return folds.emit_gate(self.alerts, self.config)

    @cached_property
    def threat_ips(self) -> DataFrame:
        return self.sql(THREAT_IPS, supplier=self.table("supplier")).withColumn("ip", addr.from_long(F.col("ip")))

    @cached_property
    def threat_cidrs(self) -> DataFrame:
        rows = self.sql(THREAT_CIDRS, supplier=self.table("supplier")).withColumn("network", addr.from_long(F.col("network")))
        return rows.withColumn("family", F.lit(4))

    @cached_property
    def routed(self) -> DataFrame:
        directions = self.spark.createDataFrame(list(CONTACT.items()), "list string, contact string")
        owned = attribution.owned(self.attributed)
        hits = threat.match_ips(owned, self.threat_ips).unionByName(threat.match_cidrs(owned, self.threat_cidrs).select("host_id", "snapshot_ts", "src_inst", "dst_inst", "pair", "side", "list"))
        return threat.route(hits, directions)

    @cached_property
    def counters(self) -> DataFrame:
        return self.sql(COUNTERS, events=self.table("events")).withColumn("ts", F.col("ts").cast("timestamp"))

    def counter_samples(self, **scale: int) -> DataFrame:
        """Counter columns as multiples of the one counter."""
        return self.counters.select("host_id", "instance", "ts", "vcpus", *((F.col("counter") * n).alias(c) for c, n in scale.items()))

    @cached_property
    def cpu(self) -> DataFrame:
        return deltas.cpu_usage(self.counter_samples(cpu_ns=400_000_000, steal_ns=30_000_000, wait_ns=9_000_000))

    @cached_property
    def disk(self) -> DataFrame:
        scale = {"rd_reqs": 3, "wr_reqs": 2, "fl_reqs": 1, "rd_bytes": 4096 * 30, "wr_bytes": 8192 * 30, "rd_ns": 9_000_000, "wr_ns": 22_000_000, "fl_ns": 5_000_000}
        rows = self.counter_samples(**scale).withColumns({"volume": F.lit("v1"), "path": F.lit("vda")})
        return deltas.disk_io(rows)

    @cached_property
    def mem(self) -> DataFrame:
        return deltas.mem_rates(self.counter_samples(swap_in=5000, swap_out=700, major_faults=60))

    @cached_property
    def net(self) -> DataFrame:
        return deltas.net_rates(self.counter_samples(packets=9000, drops=17))

    @cached_property
    def pressures(self) -> DataFrame:
        key = ["host_id", "instance", "ts"]
        cpu = scoring.cpu_pressure(self.cpu).select(*key, "vcpus", "cpu_p", "cpu_conf", "cpu_impact")
        mem = self.mem.withColumns({"mem_mb": F.lit(4096), "used_mb": (F.col("swap_in") % 6000).cast("double")})
        disk = scoring.disk_axis(deltas.disk_worst(self.disk))
        net = self.net.withColumns({"flows": F.col("packets") % 900, "table_max": F.lit(TABLE_MAX * 10)})
        out = cpu.join(scoring.mem_pressure(mem).select(*key, "mem_p", "mem_conf", "mem_impact"), key)
        out = out.join(disk.select(*key, "disk_p", "disk_conf", "disk_impact"), key)
        return out.join(scoring.net_pressure(net).select(*key, "net_p", "net_conf", "net_impact"), key)

    @cached_property
    def resources(self) -> DataFrame:
        return folds.resource_axes(self.pressures, self.config)

    @cached_property
    def machine_scores(self) -> DataFrame:
        """Resource scores by snapshot: sample k of a machine is taken as that of snapshot k; it is stopped where the event is a view."""
        first = Window.partitionBy("host_id", "instance").orderBy("ts")
        kinds = self.counters.select("host_id", "instance", "ts", (F.col("event_type") != "view").alias("running"))
        rows = self.resources.join(kinds, ["host_id", "instance", "ts"]).withColumn("n", F.row_number().over(first))
        return rows.select(
            "host_id", F.regexp_replace("instance", "^m", "vm").alias("instance"), F.timestamp_seconds(START + 15 * (F.col("n") - 1)).alias("snapshot_ts"),
            "overall", *(f"{a}_severity" for a in ("cpu", "mem", "disk", "net")), "running",
        )

    @cached_property
    def metrics(self) -> DataFrame:
        """One counter and one gauge for each machine, as the long metric table."""
        labels = F.create_map(F.lit("instance"), F.col("instance"), F.lit("project"), F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")), F.lit("kind"), F.col("event_type"))
        cells = [F.struct(F.lit(m).alias("metric"), F.lit(t).alias("type"), v.cast("double").alias("value")) for m, t, v in (
            ("work_total", "counter", F.col("counter")), ("load", "gauge", F.col("step")), ("requests_total", "counter", F.col("counter") * 3),
        )]
        return self.counters.select("host_id", "ts", labels.alias("labels"), F.explode(F.array(*cells)).alias("m")).select("host_id", "ts", "m.metric", "m.type", "labels", "m.value")


#: A machine is away from the inventory in every fifth cycle, each in another one.
AWAY_EVERY = 5


class ComingAndGoing(Fleet):
    """The fleet with machines that leave and return, and take their state with them."""

    @cached_property
    def cycles(self) -> DataFrame:
        """Each host's cycles, few; written once, as each use of them would read all flows."""
        return self.written("cycles", self.flows.select("host_id", "snapshot_ts").distinct())

    @cached_property
    def active(self) -> DataFrame:
        every = self.instances.select("host_id", "instance").join(self.cycles, "host_id")
        n = (F.unix_timestamp("snapshot_ts") - START) / 15 + F.substring("instance", 3, 9).cast("int")
        return every.where(n % AWAY_EVERY != 0)

    @cached_property
    def islands(self) -> DataFrame:
        return deltas.presence_islands(self.active, self.cycles, ["host_id", "instance"])

    @cached_property
    def absences(self) -> DataFrame:
        return deltas.absences(self.active, self.cycles)

    @cached_property
    def events(self) -> DataFrame:
        return attribution.identity_events(self.attributed, self.config.accounting).join(self.active, ["host_id", "instance", "snapshot_ts"], "left_semi")

    @cached_property
    def scored(self) -> DataFrame:
        rows = self.features.join(self.islands.select("host_id", "instance", "snapshot_ts", "island"), ["host_id", "instance", "snapshot_ts"])
        return folds.flow_ewma(rows, self.config, [*IDENTITY, "island"])

    @cached_property
    def alerts(self) -> DataFrame:
        return scoring.score_alerts(self.classified, self.config, [*IDENTITY, "island"])

    @cached_property
    def gated(self) -> DataFrame:
        return folds.emit_gate(self.alerts, self.config, [*IDENTITY, "island"])


def plain(df: DataFrame, *columns: str | Column, places: int = 4) -> DataFrame:
    """Columns as both engines give them: seconds for snapshots, BIGINT for addresses and integers, doubles of so many places."""
    df = df.select(*columns) if columns else df
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if name == "snapshot_ts":
            c, name = F.unix_timestamp(c), "ts"
        elif kind == "binary":
            c = addr.to_long(c)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind in ("double", "float"):
            c = F.round(c, places)
        out.append(c.alias(name))
    return df.select(*out)
