"""Recurrences against plain loops, and streams against batches."""

import math
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from vigil.config import Config
from vigil.operators import folds, scoring
from vigil.plans.adapters import Fleet
from vigil.streaming import state

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(s):
    return T0 + timedelta(seconds=s)


def test_alpha():
    assert folds.alpha(1, 10) == 1 - math.exp(-0.1)
    assert folds.alpha(0, 10) == 1 and folds.alpha(1, 0) == 1


def feature(flows, remotes, ports, ratio, t):
    return {"t": t, "flows": flows, "unique_remotes": remotes, "unique_ports": ports, "unreplied_ratio": ratio, "bytes_per_flow": 0.0, "packets_per_flow": 0.0, "accounting": False}


def test_ewma_starts_at_the_first_value_and_fast_leads():
    step, s = folds.ewma_step(Config()), {}
    first = step(s, feature(10, 4, 3, 0.25, 0))
    assert first["flows_fast"] == first["flows_slow"] == 10 and first["signal"] == 0
    then = step(s, feature(40, 10, 8, 0.5, 60))
    assert then["flows_fast"] > then["flows_slow"] > 10 and 0 < then["signal"] <= 1
    assert step(s, feature(7, 1, 1, 0.1, 60 + 7201))["flows_slow"] == 7  # idle too long


def hit(t, kind="k", priority="P3", band="low", hits=3, required=3, remote="a", share=0.0):
    return {"t": t, "kind": kind, "priority": priority, "severity_band": band, "hits": hits, "required": required, "remote_share": share, "top_remote": remote, "port_share": 0.0, "top_port": 0}


def test_emit_gate():
    step, s = folds.emit_step(Config()), {}
    go = lambda r: (lambda o: (o["emitted"], o["emit_reason"], o["suppress_reason"]))(step(s, r))
    assert go(hit(0, hits=2)) == (False, None, "persistence_gate")
    assert go(hit(15)) == (True, "new_kind", None)
    assert go(hit(30)) == (False, None, None)
    assert go(hit(45, band="high")) == (False, None, "cooldown")
    assert go(hit(60, priority="P1", band="high")) == (True, "escalated", None)
    assert go(hit(75, priority="P1", band="high", remote="b", share=0.7)) == (False, None, "cooldown")
    assert go(hit(60 + 181, priority="P1", band="high", remote="b", share=0.7)) == (True, "changed", None)
    assert go(hit(241 + 3601, priority="P1", band="high")) == (True, "new_kind", None)  # its state was dropped


def test_resource_cap_and_streak():
    step, s = folds.resource_step(Config()), {}
    row = {"t": 0} | {f"{a}_{k}": 0.0 for a in ("cpu", "mem", "disk", "net") for k in ("p", "conf", "impact")}
    assert step(s, row)["overall"] == 0
    hot = row | {f"{a}_{k}": 1.0 for a in ("cpu", "mem", "disk", "net") for k in ("p", "conf", "impact")}
    s.clear()
    out = [step(s, hot | {"t": 15 * k}) for k in range(3)]
    assert out[0]["axes90"] == 4 and not out[0]["cap_active"] and out[0]["overall"] > 99.9 and out[2]["streak"] == 3
    assert out[0]["top_axis"] == "cpu"


def test_throttle_and_persistence(spark):
    rows = spark.createDataFrame([("a", at(s)) for s in (0, 100, 299, 300, 601)] + [("b", at(5))], "k string, ts timestamp")
    got = sorted((r["k"], int((r["ts"].replace(tzinfo=timezone.utc) - T0).total_seconds()), r["delivered"]) for r in folds.throttle(rows, ["k"]).collect())
    assert [d for _, _, d in got] == [True, False, False, True, True, True]
    ident = "h", "i", bytearray(16), "outbound", "k"
    rows = spark.createDataFrame([(*ident, at(s)) for s in (0, 15, 195, 376)], "host_id string, instance string, ip binary, direction string, kind string, snapshot_ts timestamp")
    assert [r["hits"] for r in scoring.persistence(rows).orderBy("snapshot_ts").collect()] == [1, 2, 3, 1]


def test_streams_equal_batches(spark, sf):
    f = Fleet(spark, sf)
    small = f.features.where("instance in ('vm1', 'vm7')")
    key = ["host_id", "instance", "ip", "direction", "snapshot_ts"]
    want = sorted(map(tuple, folds.flow_ewma(small).select(*key, F.round("signal", 9)).collect()))
    got = sorted(map(tuple, state.replay(small, state.behavior_state).select(*key, F.round("signal", 9)).collect()))
    assert got == want and got


def test_state_survives_micro_batches(spark, tmp_path):
    schema = "host_id string, instance string, snapshot_ts timestamp, instant double"
    step = lambda k: spark.createDataFrame([("h", "i", at(15 * k), 0.5 * (k % 2))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = []
    for k in range(4):
        step(k)
        stream = state.threat_state(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        keep = lambda rows, _: got.extend(r["intel_ewma"] for r in rows.collect())
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    want, e = [], None
    for k in range(4):
        x = 0.5 * (k % 2)
        e = x if e is None else e + 0.1 * (x - e)
        want.append(e)
    assert got == want


def history(spark, n=400):
    """A machine with a third of all rows and others with a few, with idle times over the limit and axes that only count where accounting is on."""
    import random

    g, rows = random.Random(5), []
    for machine in range(40):
        t = 0
        for _ in range(n if machine == 0 else n // 20):
            t += g.choice([15, 15, 15, 60, 900, 7200, 7201, 20000])
            bytes_ = g.choice([0.0, 100.0, 5000.0])
            rows.append(("h", f"vm{machine}", bytearray(16), "outbound", at(t), g.randint(1, 500), g.randint(1, 90), g.randint(0, 30), g.random(), bytes_, bytes_ / 70, g.random() < 0.8))
    columns = "host_id string, instance string, ip binary, direction string, snapshot_ts timestamp, flows int, unique_remotes int, unique_ports int, unreplied_ratio double, bytes_per_flow double, packets_per_flow double, accounting boolean"
    return spark.createDataFrame(rows, columns)


def test_slices_of_any_size_give_the_same_averages(spark):
    df = history(spark)
    names = [c.split()[0] for c in folds.EWMA_COLUMNS.split(", ")]
    key = ["instance", "snapshot_ts"]
    want = {tuple(r[k] for k in key): [r[n] for n in names] for r in folds.flow_ewma(df).collect()}
    for size in (30, 3600, 86400, 10**9):
        got = folds.flow_ewma_sliced(df, slice_s=size)
        assert got.columns == [*df.columns, *names]
        rows = {tuple(r[k] for k in key): [r[n] for n in names] for r in got.collect()}
        assert rows.keys() == want.keys()
        assert max(abs(a - b) / max(1.0, abs(a)) for k in want for a, b in zip(want[k], rows[k])) < 1e-9


def test_a_long_history_is_worked_on_by_several_tasks(spark):
    with state.settings(spark, spark__sql__adaptive__enabled="false"):  # else so few rows are put together again
        parts = folds.flow_ewma_sliced(history(spark), slice_s=86400).where("instance = 'vm0'").groupBy(F.spark_partition_id()).count().count()
    assert parts > 1
