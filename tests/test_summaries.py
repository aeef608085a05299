"""Stored summaries, SQL functions, exactly-once outputs, versions and absences."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from vigil.functions import sql as sql_functions
from vigil.operators import deltas, folds, sketches
from vigil.plans import extended_queries
from vigil.plans.adapters import Fleet
from vigil.plans.queries import QUERIES
from vigil.sources.versions import VersionedLists
from vigil.streaming import arrivals, outputs, state

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(s):
    return T0 + timedelta(seconds=s)


def events(spark, per_snapshot):
    rows = [("h", "vm", bytearray(b"x"), "outbound", at(15 * k), bytearray(r.to_bytes(4))) for k, remotes in enumerate(per_snapshot) for r in remotes]
    return spark.createDataFrame(rows, "host_id string, instance string, ip binary, direction string, snapshot_ts timestamp, remote binary")


def test_heavy_hitters_stay_within_their_bound_with_far_more_remotes_than_items(spark):
    g, items = random.Random(4), 48
    heavy = [1] * 900 + [2] * 800 + [3] * 700 + [4] * 600 + [5] * 500
    snapshots = [g.sample(heavy, len(heavy)) + [g.randint(1000, 9000) for _ in range(1500)] for _ in range(4)]
    exact = Counter(x for s in snapshots for x in s)
    stored = sketches.remote_summaries(events(spark, snapshots), items)
    got = sketches.top(sketches.merged(stored, F.lit(0), items), 5).first()
    bound = sketches.error_bound(items) * got["flows"]
    assert got["snapshots"] == 4 and got["flows"] == sum(exact.values()) and len(exact) > 40 * items
    assert [int(t["item"], 16) for t in got["top"]] == [1, 2, 3, 4, 5]
    assert all(abs(t["count"] - exact[int(t["item"], 16)]) <= bound for t in got["top"])


def test_distinct_and_new_remotes_from_sketches(spark):
    first, second = list(range(0, 40_000)), list(range(30_000, 60_000))
    stored = sketches.remote_summaries(events(spark, [first, second]), lg_k=14)
    whole = sketches.distinct(sketches.merged(stored, F.lit(0))).first()["remotes"]
    assert abs(whole - 60_000) < 0.03 * 60_000
    halves = sketches.merged(stored, F.col("snapshot_ts") >= F.lit(at(15)))
    fresh = sketches.fresh(halves.where("span").drop("span"), halves.where("not span").drop("span"))
    assert abs(fresh.first()["new_remotes"] - 20_000) < 0.03 * 60_000
    none = halves.where("span").drop("span").limit(0)
    assert abs(sketches.fresh(halves.where("span").drop("span"), none).first()["new_remotes"] - 30_000) < 0.03 * 30_000


def test_sql_functions_are_put_in_line(spark, sf):
    plan = QUERIES["sql_function_report"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "is_private_v4", "severity_band("))


def test_sql_functions_say_what_the_columns_say(spark):
    sql_functions.register(spark)
    one = lambda text: spark.sql(f"SELECT {text}").first()[0]
    assert one("show_v4(134744072)") == "8.8.8.8" and one("is_private_v4(167772161)") and not one("is_private_v4(134744072)")
    assert one("in_network_v4(134744075, 134744072, 29)") and not one("in_network_v4(134744080, 134744072, 29)")
    assert one("flow_side(true, false)") == "out" and one("flow_side(false, true)") == "in" and one("flow_side(true, true)") == "any"
    for dt, tau in ((1.0, 10.0), (0.0, 10.0), (5.0, 0.0)):
        assert abs(one(f"ewma_alpha({dt}D, {tau}D)") - folds.alpha(dt, tau)) < 1e-12
    assert one("evidence_mode(0.7D, 0.1D)") == "dominant_remote" and one("severity_band(64.9D)") == "medium"
    assert one("(SELECT count(*) FROM monitored_ports_of('inbound') WHERE port = 22)") == 1
    assert one("(SELECT value FROM limits() WHERE name = 'remote_ceiling')") == 32768


def test_a_batch_that_is_run_again_replaces_itself_and_one_that_never_ended_is_not_read(spark, tmp_path):
    table = outputs.LedgerTable(spark, str(tmp_path / "t"))
    rows = lambda *values: spark.createDataFrame([(v, at(v)) for v in values], "v int, ts timestamp")
    table.write(rows(1, 2), 0, "ts")
    table.write(rows(3, 100_000), 1, "ts")
    table.write(rows(3, 100_000), 1, "ts")  # again
    enter, table.enter = table.enter, lambda batch: None
    table.write(rows(9), 2, "ts")  # never entered
    assert sorted(r["v"] for r in table.read().collect()) == [1, 2, 3, 100_000] and sorted(table.batches()) == [0, 1]
    table.enter = enter
    table.write(rows(10), 2, "ts")
    assert sorted(r["v"] for r in table.read().collect()) == [1, 2, 3, 10, 100_000]


def test_versions_are_those_of_the_last_good_load(spark, tmp_path):
    lists = VersionedLists(spark, str(tmp_path), keep_on_empty=True)
    of = lambda *ips: spark.createDataFrame([(i,) for i in ips], "ip long")

    def fails():
        raise OSError("no answer")

    assert lists.load("a", 1, lambda: of(1, 2)) and lists.load("b", 1, lambda: of(7))
    first = lists.pinned()
    assert not lists.load("a", 2, fails)
    lists.load("a", 3, lambda: of().limit(0))
    assert lists.pinned() == first == {"a": 1, "b": 1}
    lists.load("a", 4, lambda: of(3))
    assert lists.pinned() == {"a": 4, "b": 1}
    read = lambda pins: sorted(tuple(r) for r in lists.read(pins).select("list", "version", "ip").collect())
    assert read(first) == [("a", 1, 1), ("a", 1, 2), ("b", 1, 7)]  # a pin holds whatever is committed later
    assert read(lists.pinned()) == [("a", 4, 3), ("b", 1, 7)] and lists.read({}) is None


def test_absences_are_where_islands_end(spark):
    cycles = spark.createDataFrame([("h", at(15 * k)) for k in range(6)], "host_id string, snapshot_ts timestamp")
    active = spark.createDataFrame([("h", "a", at(15 * k)) for k in (0, 1, 3, 4, 5)] + [("h", "b", at(15 * k)) for k in (0, 1)], "host_id string, instance string, snapshot_ts timestamp")
    got = sorted((r["instance"], int((r["snapshot_ts"].replace(tzinfo=timezone.utc) - T0).total_seconds())) for r in deltas.absences(active, cycles).collect())
    assert got == [("a", 30), ("b", 30)]
    islands = deltas.presence_islands(active, cycles, ["host_id", "instance"])
    assert [r["island"] for r in islands.where("instance = 'a'").orderBy("snapshot_ts").collect()] == [0, 0, 1, 1, 1]


def test_new_remotes_start_anew_after_an_absence(spark, sf):
    from vigil.operators import features

    ident = ("h", "a", bytearray(b"x"), "outbound")
    remotes = spark.createDataFrame([(*ident, at(15 * k), bytearray(b"r")) for k in (0, 1, 3)], "host_id string, instance string, ip binary, direction string, snapshot_ts timestamp, remote binary")
    islands = spark.createDataFrame([("h", "a", at(0), 0), ("h", "a", at(15), 0), ("h", "a", at(45), 1)], "host_id string, instance string, snapshot_ts timestamp, island int")
    news = lambda i: [r["new_remotes"] for r in features.new_remotes(remotes, islands=i).orderBy("snapshot_ts").collect()]
    assert news(None) == [1, 0, 0] and news(islands) == [1, 0, 1]


def test_closed_snapshots_and_late_rows(spark):
    conf = extended_queries.ROCKS
    reads = spark.createDataFrame([("h", at(0), 4, 10, 0), ("h", at(0), 4, 10, 0), ("h", at(0), 6, 5, 1), ("h", at(15), 4, 7, 0), ("h", at(0), 6, 5, 2), ("h", at(9000), 4, 1, 2)], "host_id string, snapshot_ts timestamp, family int, flows long, n int")
    got = state.replay(reads, lambda s: arrivals.closed_snapshots(s), [F.col("n") == k for k in range(3)], "append", **conf).collect()
    assert sorted((int((r["snapshot_ts"].replace(tzinfo=timezone.utc) - T0).total_seconds()), r["flows"], r["status"]) for r in got) == [(0, 15, "ok"), (15, 7, "partial")]
    late = state.replay(reads, lambda s: arrivals.marked(s, ["host_id"], 60), [F.col("n") == 2, F.col("n") < 2], "append", **conf)
    counts = arrivals.late_counts(late, ["host_id"]).first()
    assert (counts["on_time"], counts["late"]) == (2, 4)


def test_pairs_sum_to_remotes_ports_and_totals(spark, sf):
    from vigil.operators import attribution, features

    f = Fleet(spark, sf)
    pairs = features.by_pair(f.events)
    same = lambda x, y: sorted(map(str, x.select(*y.columns).collect())) == sorted(map(str, y.collect()))
    assert same(features.remotes_of(pairs), features.by_remote(f.events)) and same(features.ports_of(pairs), features.by_port(f.events))
    assert same(features.totals_of(pairs), attribution.instance_flow_totals(f.attributed))
