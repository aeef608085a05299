"""The streaming behaviour chain: clocks, absence and micro-batches."""

from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigil.config import Config
from vigil.streaming import behavior, state

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


class FakeMap:
    def __init__(self):
        self.held = {}

    def exists(self):
        return bool(self.held)

    def containsKey(self, key):
        return key in self.held

    def getValue(self, key):
        return self.held.get(key)

    def updateValue(self, key, value):
        self.held[key] = value

    def removeKey(self, key):
        del self.held[key]

    def iterator(self):
        return iter(list(self.held.items()))

    def clear(self):
        self.held.clear()


class FakeValue:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class FakeHandle:
    def __init__(self):
        self.timers = set()

    def getMapState(self, *_):
        return FakeMap()

    def getValueState(self, *_):
        return FakeValue()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


@pytest.fixture
def alive(spark):
    p = behavior.Alive([])
    p.init(FakeHandle())
    return p


def test_each_clock_runs_out_alone(alive):
    """At its own time each state goes, and only that one; a timer is always set for the next."""
    alive.step(pd.DataFrame({"t": [0]}))
    assert alive.handle.timers == {3601_000}
    # a report is not renewed by a snapshot within its time, persistence and averages are
    alive.step(pd.DataFrame({"t": [1800]}))
    assert alive.sweep(3601) == {"averages": 0, "priors": 0, "persistence": 0, "reported": 1}
    assert alive.sweep(1800 + 3601) == {"averages": 0, "priors": 0, "persistence": 1, "reported": 0}
    assert alive.sweep(1800 + 7201) == {"averages": 1, "priors": 0, "persistence": 0, "reported": 0}
    assert alive.timer.get() == (1800 + 86401,)
    assert alive.sweep(1800 + 86401) == {"averages": 0, "priors": 1, "persistence": 0, "reported": 0}
    assert not alive.timer.exists()


def test_absence_takes_all_state(alive):
    alive.step(pd.DataFrame({"t": [0]}))
    alive.forget()
    assert alive.handle.timers == set() and not any(m.exists() for m in alive.maps.values())
    assert alive.step(pd.DataFrame({"t": [15]})).iloc[0].tolist() == [False] * 4


IP = bytes(15) + b"\x01"
SCHEMA = "host_id string, instance string, ip binary, direction string, snapshot_ts timestamp, present boolean, t long, remotes array<binary>, ports array<int>, accounting boolean, " + ", ".join(
    f"{a} double" for a in behavior.AXES
)


def row(t, remotes=(), ports=(), present=True, machine="vm1"):
    values = [10.0 + t / 100] * 6 if present else [None] * 6
    ip, direction = (IP, "outbound") if present else (None, None)
    return ("h", machine, ip, direction, T0 + timedelta(seconds=t), present, int(T0.timestamp()) + t, [bytes([r]) for r in remotes] if present else None, list(ports) if present else None, False if present else None, *values)


def test_priors_and_averages_over_micro_batches_and_an_absence(spark):
    rows = [row(0, [1, 2], [80]), row(15, [2, 3], [80, 81]), row(30, [2, 3]), row(45, present=False), row(60, [2, 3], [80]), row(75, [3, 4], [80]), row(75 + 86401, [3, 4], [80])]
    rows += [row(t, [9], [22], machine="vm2") for t in (0, 75, 75 + 86401)]
    df = spark.createDataFrame(rows, SCHEMA)
    n = F.col("t") - int(T0.timestamp())
    conf = {"spark__sql__streaming__stateStore__providerClass": behavior.ROCKS, "spark__sql__shuffle__partitions": "2"}
    got = state.replay(df, behavior.baselines, [n < 20, (n >= 20) & (n < 70), n >= 70], "append", **conf).where("present")
    own = sorted((r["t"] - int(T0.timestamp()), r["new_remotes"], r["new_ports"], r["flows_slow"] == r["flows"]) for r in got.where("instance = 'vm1'").collect())
    # the prior set is that of the snapshot before, the absence at 45 and a day without snapshots start all anew
    assert own == [(0, 2, 1, True), (15, 1, 1, False), (30, 0, 0, False), (60, 2, 1, True), (75, 1, 0, False), (86476, 2, 1, True)]
    other = sorted((r["t"] - int(T0.timestamp()), r["new_remotes"]) for r in got.where("instance = 'vm2'").collect())
    assert other == [(0, 1), (75, 0), (86476, 1)]


def test_reports_take_the_scores_of_the_nth_hit(spark):
    p = behavior.Reports([], Config())
    p.init(FakeHandle())
    frame = pd.DataFrame([
        {"ip": IP, "direction": "outbound", "t": 15 * k, "present": True, "kind": "k", "severity_band": "high", "remote_share": 0.0, "port_share": 0.0,
         "top_remote": None, "top_port": 0, "confidences": [40, 60, 80], "priorities": ["P3", "P3", "P2"]}
        for k in range(4)
    ])
    got = p.step(frame)
    assert got["hits"].tolist() == [1, 2, 3, 4] and got["confidence_score"].tolist() == [40, 60, 80, 80]
    assert got["emitted"].tolist() == [False, False, True, False] and got["emit_reason"].tolist() == [None, None, "new_kind", None]


def test_remotes_of_a_snapshot_are_one_value(spark):
    """Addresses lie one behind the other, whatever their last bytes, from the rows to the state."""
    remotes = [bytes([0, k // 256, k % 256]) + bytes(13) for k in range(70_000 // 256 * 4)]
    p = behavior.Baselines([], Config())
    p.init(FakeHandle())
    base = {"ip": IP, "direction": "outbound", "present": True, "ports": [80], "accounting": False, **dict.fromkeys(behavior.AXES, 1.0)}
    got = p.step(pd.DataFrame([base | {"t": 0, "remotes": b"".join(remotes)}, base | {"t": 15, "remotes": b"".join(reversed(remotes[5:])) + b"\1" * 16}]))
    assert got["new_remotes"].tolist() == [len(remotes), 1]
    (held,) = p.maps["priors"].held.values()
    assert isinstance(held[1], bytes) and len(held[1]) == 16 * (len(remotes) - 4)
    again = p.step(pd.DataFrame([base | {"t": 30, "remotes": b"".join(remotes)}]))
    assert again["new_remotes"].tolist() == [5]


def test_inputs_have_one_value_of_remotes(spark, sf):
    from vigil.plans.adapters import Fleet

    f = Fleet(spark, sf)
    rows = behavior.inputs(f.features, f.remotes, f.ports)
    assert dict(rows.dtypes)["remotes"] == "binary"
    assert rows.where(F.length("remotes") != 16 * F.col("unique_remotes")).count() == 0
