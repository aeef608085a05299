"""What grows with the tables: groups of the streams, files of a micro-batch, counts beyond the ceiling, and what is read more than once."""

import glob
import math
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from vigil.config import Config
from vigil.operators import features
from vigil.plans.adapters import ComingAndGoing, Fleet
from vigil.streaming import behavior, state

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(s):
    return T0 + timedelta(seconds=s)


def test_contacts_have_a_state_for_each_bucket_not_for_each_pair(spark, tmp_path):
    rows = [("h", "drop", "vm1", at(15 * k), (p, 80)) for p in range(40) for k in ((0, 1, 3) if p % 2 else (0, 2, 3))]
    df = spark.createDataFrame(rows, "host_id string, list string, instance string, snapshot_ts timestamp, pair struct<a: int, b: int>")
    got, progress = [], []
    for k in range(2):  # two micro-batches: the state of the first is met by the second
        df.where(F.col("snapshot_ts") >= F.lit(at(30)) if k else F.col("snapshot_ts") < F.lit(at(30))).write.mode("append").parquet(str(tmp_path / "in"))
        stream = state.contact_state(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), buckets=2)
        q = stream.writeStream.outputMode("update").foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        q.awaitTermination()
        progress += [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    new = sorted((int((r["snapshot_ts"].replace(tzinfo=timezone.utc) - T0).total_seconds()) // 15, r["is_new"]) for r in got)
    assert new == sorted([(0, True)] * 40 + [(1, False)] * 20 + [(2, True)] * 20 + [(3, True)] * 20 + [(3, False)] * 20)
    assert max(progress) <= 2


def test_clocks_of_many_machines_are_those_of_each(spark):
    rows = [("h", f"m{m}", at(t * (m + 1)), n) for m in range(6) for n, t in enumerate((0, 1800, 3700, 3700 + 7300, 3700 + 7300 + 90000, 200000))]
    df = spark.createDataFrame(rows, "host_id string, instance string, snapshot_ts timestamp, n int")
    conf = {"spark__sql__streaming__stateStore__providerClass": behavior.ROCKS, "spark__sql__shuffle__partitions": "2"}
    run = lambda b: sorted(map(tuple, state.replay(df, lambda s: behavior.clocks(s, delay="30 days", buckets=b), [F.col("n") < 3, F.col("n") >= 3], "append", **conf).collect()))
    assert run(2) == run(0)


def test_a_micro_batch_may_have_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "shared", lambda _: str(tmp_path / "stream"))
    rows = spark.range(400).repartition(4).select(F.lit("h").alias("host_id"), F.timestamp_seconds(1704067200 + F.col("id")).alias("snapshot_ts"))
    with state.settings(spark, spark__sql__files__openCostInBytes="134217728"):  # one task for each file
        got = state.replay(rows, lambda s: s, [F.second("snapshot_ts") < 30, F.second("snapshot_ts") >= 30], "append")
    assert got.count() == 400 and len(glob.glob(str(tmp_path / "stream/in/*.parquet"))) > 2
    assert len(glob.glob(str(tmp_path / "stream/out/batch=*"))) == 2


def test_counts_beyond_the_ceiling_are_exact(spark, sf):
    f = Fleet(spark, sf, Config(remote_ceiling=3))
    rows = f.features.select("unique_remotes", "unique_remotes_saturated", "new_remotes", "new_remotes_saturated", "remote_share", "max_single_remote", "flows").collect()
    exact = sorted(r["count"] for r in f.remotes.groupBy("host_id", "instance", "ip", "direction", "snapshot_ts").count().collect())
    assert sorted(r["unique_remotes"] for r in rows) == exact and max(exact) > 3
    assert all(r["unique_remotes_saturated"] == (r["unique_remotes"] >= 3) and r["new_remotes_saturated"] == (r["new_remotes"] >= 3) for r in rows)
    assert all(abs(r["remote_share"] - r["max_single_remote"] / r["flows"]) < 1e-12 for r in rows)
    assert max(r["unique_remotes"] for r in features.capped(f.features, "unique_remotes", f.config).collect()) == 3


def test_features_are_made_once(spark, sf):
    """Whatever asks for the features of a fleet reads the same table, without the flows."""
    f = Fleet(spark, sf)
    plan = f.features.join(f.features.select("host_id").distinct(), "host_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "last_seen" not in plan


def test_folds_have_a_state_for_each_bucket_not_for_each_key(spark, tmp_path):
    from vigil.operators import folds

    rows = [(f"m{m}", at(t), t) for m in range(30) for t in (0, 10, 400 + m, 5000)] + [("end", at(30000), 30000)]
    df = spark.createDataFrame(rows, "instance string, ts timestamp, s int")

    @folds.reading("t")
    def count(held, row):
        held["n"] = held.get("n", 0) + 1
        return {"n": held["n"]}

    got, progress = [], []
    for low, high in ((0, 400), (400, 1000), (5000, 10000), (20000, 40000)):  # a key's 1,000 s have run out before its fourth row
        df.where(F.col("s").between(low, high - 1)).write.mode("append").parquet(str(tmp_path / "in"))
        stream = state.on_time(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts")
        q = state.stateful(stream, ["instance"], "ts", count, "n int", ttl_s=1000, buckets=3).writeStream.outputMode("update").foreachBatch(lambda b, _: got.extend(b.collect()))
        q = q.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        q.awaitTermination()
        progress += [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    assert sorted((r["instance"], r["s"], r["n"]) for r in got if r["s"] < 5000) == sorted((f"m{m}", t, n) for m in range(30) for n, t in enumerate((0, 10, 400 + m), 1))
    assert {r["n"] for r in got if r["s"] == 5000} == {4}  # data comes before the timer in a batch, as for a key by itself
    assert max(progress) <= 3 and progress[-1] == 1


def test_flows_by_remote_are_sorted_once(spark, sf):
    with state.settings(spark, **features.IN_ORDER):
        plan = features.seen(Fleet(spark, sf).events)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and plan.count("Sort [deal") == 1


def test_sketches_tell_how_far_off_they_may_be(spark):
    from vigil.operators import sketches

    ident = "h AS host_id, 'vm' AS instance, binary('x') AS ip, 'outbound' AS direction, timestamp_seconds(1704067200) AS snapshot_ts".replace("h AS", "'h' AS")
    rows = lambda low, high: spark.range(low, high).selectExpr(*ident.split(", "), "unhex(sha1(string(id))) AS remote")
    one = lambda low, high: sketches.merged(sketches.remote_summaries(rows(low, high), lg_theta=12).drop("heavy"), F.lit(0), lg_k=12).drop("span")
    off = lambda now, before: sketches.fresh(now, before, lg_k=12).first()["new_error"]
    before = one(0, 50_000)
    assert off(one(49_000, 51_000), before) > 0.03  # a small part of a set much larger than the sketch
    assert off(one(1000, 2500), one(0, 2000)) == 0
    assert 2 ** sketches.precision(0.03, 1 / 8) >= (5 / 0.03) ** 2 * 8 > 2 ** (sketches.precision(0.03, 1 / 8) - 1)


def test_remotes_are_summed_in_a_hash_table_in_one_pass(spark, sf):
    f = Fleet(spark, sf)
    plan = features.remote_counts(f.seen, f.host_ips)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    # of all that has a row for each remote, features read the leading ones only; ports and counts come from small tables
    made, write = [], f.written
    f.written = lambda name, rows: (made.append((name, rows._jdf.queryExecution().optimizedPlan().toString())), write(name, rows))[1]
    f.features  # noqa: B018
    assert [name for name, _ in made] == ["counts", "ports", "features"] or [name for name, _ in made] == ["ports", "counts", "features"]


def test_the_top_remote_is_the_least_of_those_with_most_flows(spark):
    snapshot = "h", "vm1", b"a" * 16, "outbound"
    rows = [(*snapshot, at(15 * k), bytes(15) + bytes([r]), n, 0, 0, 0, 0, 0) for k in range(2) for r, n in ((5, 3), (4, 3), (1, 2), (6, 1 + k))]
    names = "host_id string, instance string, ip binary, direction string, snapshot_ts timestamp, remote binary, " + ", ".join(f"{c} long" for c in features.COUNTS)
    remotes = spark.createDataFrame(rows, names)
    host_ips = spark.createDataFrame([("h", bytes(15) + b"\x09")], "host_id string, ip binary")
    counts = features.remote_counts(remotes, host_ips)
    most = counts.groupBy("host_id", "instance", "ip", "direction", "snapshot_ts").agg(F.max("max_single_remote").alias("max_single_remote"))
    assert [bytes(r["top_remote"])[-1] for r in features._tops(remotes, most).collect()] == [4, 4]
    assert sorted((r["last_seen"] is None, r["n"], r["flows"]) for r in counts.collect()) == [(False, 4, 10), (True, 4, 9)]


def test_cycles_of_the_hosts_are_read_from_the_flows_once(spark, sf):
    f = ComingAndGoing(spark, sf)
    for rows in (f.active, f.islands, f.absences):
        assert "lineitem" not in rows._jdf.queryExecution().optimizedPlan().toString() + str(rows.inputFiles())


def test_totals_of_families_outgrow_a_bigint(spark, sf, tmp_path):
    import duckdb

    from vigil.plans import metric_frames, oracle, queries

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem".split():
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    con.execute(f"COPY (SELECT * REPLACE (value * 20000 AS value) FROM '{sf}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for t in tmp_path.glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    got = {(r.metric, r.type): (r.n, int(r.total)) for r in queries.QUERIES["sink_metrics"](spark, str(tmp_path)).collect()}
    wide = oracle.with_tables(metric_frames.TOTALS.replace("AS BIGINT) AS total", "AS HUGEINT) AS total"))
    want = {(m, t): (n, total) for m, t, n, total in con.execute(wide).fetchall()}
    # that engine's round and its cast to decimal change some doubles of 5e15 and more by a few units, so the family that has them is summed in integers
    (n, exact), = con.execute(oracle.with_tables("SELECT count(*), sum(CAST(counter AS HUGEINT) * 5000 * 1024) FROM counters")).fetchall()
    want["instance_mem_swap_in_bytes_total", "counter"] = n, int(exact)
    assert got == want
    assert max(total for _, total in got.values()) > 2**63


def test_totals_are_whole_numbers_as_narrow_as_all_of_them_allow(spark):
    from vigil.operators import catalogue

    rows = lambda *values: catalogue.whole(catalogue.totals(spark.createDataFrame([("m", "gauge", float(v)) for v in values], "metric string, type string, value double")), "total")
    for values, kind in (((), "bigint"), ((1.25, 2.25), "bigint"), ((5e18, 5e18), "decimal(34,0)"), ((-5e18, -5e18), "decimal(34,0)"), ((9e18,), "bigint")):
        got = rows(*values)
        assert dict(got.dtypes)["total"] == kind
        assert [(r.n, int(r.total)) for r in got.collect()] == ([(len(values), math.floor(sum(values) + 0.5))] if values else [])
