"""The behaviour chain over a stream of feature rows: prior sets and averages, rules, persistence and the emit gate.

Two stateful processors with SQL between them. The first holds, for each address and direction
of a machine, the averages of its features and the remotes and ports of its last snapshot; the
rules and scores are projections over what it gives; the second counts persistence by kind and
decides what is reported. State is kept by machine, so that a machine that leaves the active set
(a row with ``present`` false) takes all of its state with it.

Each kind of state has a clock of its own, in event time: averages end after ``ewma_ttl_s`` without
a snapshot, prior sets after ``prior_ttl_s``, persistence after ``persist_ttl_s``, and what was last reported
after ``emit_ttl_s`` since the last report. A step looks at the clock before it uses a state, and one
timer for each machine, set to its first clock, removes what has run out.

Prior sets are replaced whole with every snapshot, so one holds a snapshot's remotes as one value, not as many keys: the
addresses one behind the other, 16 bytes each, which are sorted and met as one array. It is as long as one address's part of its host's flow table.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructType

from ..config import DEFAULT, SNAPSHOT, Config
from ..operators import classifier, folds, scoring

MACHINE = ["host_id", "instance"]
AXES = [name for name, *_ in folds.AXES]
ADDRESS = "S16"  # as numpy has it; equal if all 16 bytes are
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Clocks(StatefulProcessor):
    """A processor whose states are maps with a time each, the first field of their values, and a time to live."""

    #: name -> key schema, value schema, seconds
    STATES: dict[str, tuple[str, str, float]] = {}
    handle: StatefulProcessorHandle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.maps = {name: handle.getMapState(name, key, value) for name, (key, value, _) in self.STATES.items()}
        self.timer = handle.getValueState("timer", "at long")

    def alive(self, name: str, key: tuple, now: int) -> tuple | None:
        """The value of a key, unless its clock has run out."""
        value = self.maps[name].getValue(key) if self.maps[name].containsKey(key) else None
        return value if value is not None and now - value[0] <= self.STATES[name][2] else None

    def wake(self, at: int | None) -> None:
        """One timer at the first clock."""
        held = self.timer.get() if self.timer.exists() else None
        if at is not None and (held is None or at < held[0]):
            if held is not None:
                self.handle.deleteTimer(held[0] * 1000)
            self.handle.registerTimer(at * 1000)
            self.timer.update((at,))

    def forget(self) -> None:
        """All of a machine's state goes."""
        for state in self.maps.values():
            if state.exists():
                state.clear()
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0] * 1000)
            self.timer.clear()

    def sweep(self, now: int) -> dict[str, int]:
        """Removes what has run out; how many of each state."""
        gone, due = {}, []
        for name, state in self.maps.items():
            ttl = int(self.STATES[name][2])
            each = list(state.iterator()) if state.exists() else []
            old = [key for key, value in each if now - value[0] > ttl]
            for key in old:
                state.removeKey(tuple(key))
            gone[name] = len(old)
            due += [value[0] + ttl + 1 for _, value in each if now - value[0] <= ttl]
        if self.timer.exists():
            self.timer.clear()
        self.wake(min(due, default=None))
        return gone

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.sweep(expiredTimerInfo.getExpiryTimeInMs() // 1000)
        return iter([])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("snapshot_ts", kind="stable").reset_index(drop=True)
        added = self.step(frame)
        yield pd.concat([frame.drop(columns=self.DROPPED), added], axis=1)[self.names]

    DROPPED: list[str] = []
    ADDED = ""

    def __init__(self, names: list[str], config: Config = DEFAULT):
        self.names, self.config = names, config
        self.added = [f.name for f in StructType.fromDDL(self.ADDED)]  # asked of Spark here, where there is a session

    def step(self, frame: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError


class Baselines(Clocks):
    """Prior sets and averages: what is new in a snapshot, and how far it is from what the machine usually does."""

    DROPPED = ["remotes", "ports"]
    ADDED = "new_remotes long, new_remotes_saturated boolean, new_ports long, " + folds.EWMA_COLUMNS

    def __init__(self, names: list[str], config: Config = DEFAULT):
        super().__init__(names, config)
        pairs = ", ".join(f"{a}_{k} double" for a in AXES for k in ("fast", "slow"))
        self.STATES = {
            "averages": ("ip binary, direction string", f"t long, {pairs}", config.ewma_ttl_s),
            "priors": ("ip binary, direction string", "t long, remotes binary, ports array<int>", config.prior_ttl_s),
        }

    def step(self, frame: pd.DataFrame) -> pd.DataFrame:
        average, out, due = folds.ewma_step(self.config), [], None
        held: dict[str, dict[tuple, tuple | None]] = {"averages": {}, "priors": {}}
        inputs = [frame[c].tolist() for c in ("ip", "direction", "t", "present", "remotes", "ports", "accounting", *AXES)]
        for ip, direction, t, present, remotes, ports, accounting, *axes in zip(*inputs):
            if not present:
                self.forget()
                held = {"averages": {}, "priors": {}}
                due = None
                out.append({})
                continue
            key = (bytes(ip), direction)
            if key not in held["averages"]:
                for name in held:
                    held[name][key] = self.alive(name, key, t)
            prior = held["priors"][key]
            fresh = prior is None or t - prior[0] > self.config.prior_ttl_s
            now_remotes, now_ports = np.unique(np.frombuffer(remotes, ADDRESS)), {int(x) for x in ports}
            n = len(now_remotes) - (0 if fresh else len(np.intersect1d(now_remotes, prior[1], assume_unique=True)))
            ceiling = self.config.remote_ceiling
            new = {"new_remotes": n, "new_remotes_saturated": n >= ceiling, "new_ports": len(now_ports if fresh else now_ports - prior[2])}
            held["priors"][key] = (t, now_remotes, now_ports)
            state = held["averages"][key] if isinstance(held["averages"][key], dict) else self.unpacked(held["averages"][key])
            out.append(new | average(state, {"t": t, "accounting": accounting, **dict(zip(AXES, axes))}))
            held["averages"][key] = state
            first = t + int(min(self.config.ewma_ttl_s, self.config.prior_ttl_s)) + 1
            due = first if due is None else min(due, first)
        for key, state in held["averages"].items():
            self.maps["averages"].updateValue(key, self.packed(state))
        for key, (t, remotes, ports) in held["priors"].items():
            self.maps["priors"].updateValue(key, (t, remotes.tobytes(), sorted(ports)))
        self.wake(due)
        return pd.DataFrame(out, columns=self.added)

    def alive(self, name: str, key: tuple, now: int) -> tuple | None:
        value = super().alive(name, key, now)
        return value if value is None or name != "priors" else (value[0], np.frombuffer(value[1], ADDRESS), set(value[2]))

    @staticmethod
    def packed(state: dict) -> tuple:
        return (state["t"], *(float(x) if x is not None else None for a in AXES for x in state.get(a, (None, None))))

    @staticmethod
    def unpacked(value: tuple | None) -> dict:
        if value is None:
            return {}
        pairs = {a: (value[1 + 2 * k], value[2 + 2 * k]) for k, a in enumerate(AXES)}
        return {"t": value[0]} | {a: p for a, p in pairs.items() if p[0] is not None}


class Reports(Clocks):
    """Persistence by kind, and whether a rule hit is reported."""

    ADDED = "hits long, required int, confidence_score int, priority string, emitted boolean, emit_reason string, suppress_reason string"

    def __init__(self, names: list[str], config: Config = DEFAULT):
        super().__init__(names, config)
        self.STATES = {
            "persistence": ("ip binary, direction string, kind string", "t long, hits long", config.persist_ttl_s),
            "reported": ("ip binary, direction string", "t long, kind string, priority string, band string, remote binary, port long", config.emit_ttl_s),
        }

    def step(self, frame: pd.DataFrame) -> pd.DataFrame:
        emit, out, due = folds.emit_step(self.config), [], None
        fields = ("kind", "priority", "band", "remote", "port")
        inputs = [frame[c].tolist() for c in ("ip", "direction", "t", "present", "kind", "severity_band", "remote_share", "port_share", "top_remote", "top_port", "confidences", "priorities")]
        for ip, direction, t, present, kind, band, remote_share, port_share, remote, port, confidences, priorities in zip(*inputs):
            if not present:
                self.forget()
                due = None
            if not present or kind is None:
                out.append({})
                continue
            key = (bytes(ip), direction)
            last = self.alive("persistence", (*key, kind), t)
            hits = last[1] + 1 if last is not None and t - last[0] <= self.config.persist_gap_s else 1
            self.maps["persistence"].updateValue((*key, kind), (t, hits))
            nth = min(hits, len(priorities)) - 1
            priority = priorities[nth]
            required = 2 if priority in ("P1", "P2") else 3
            was = self.alive("reported", key, t)
            state = {} if was is None else {"t": was[0], **dict(zip(fields, was[1:]))}
            row = {"t": t, "kind": kind, "priority": priority, "severity_band": band, "hits": hits, "required": required}
            remote = None if remote is None else bytes(remote)
            told = emit(state, row | {"remote_share": remote_share, "port_share": port_share, "top_remote": remote, "top_port": int(port or 0)})
            if told["emitted"]:
                self.maps["reported"].updateValue(key, (t, *(state[f] for f in fields)))
            out.append({"hits": hits, "required": required, "confidence_score": int(confidences[nth]), "priority": priority, **told})
            first = t + int(min(self.config.persist_ttl_s, self.config.emit_ttl_s)) + 1
            due = first if due is None else min(due, first)
        self.wake(due)
        added = pd.DataFrame(out, columns=self.added)
        return added.astype({"hits": "Int64", "required": "Int32", "confidence_score": "Int32", "emitted": "boolean"}).astype(object).where(added.notna(), None)


def _stage(stream: DataFrame, processor: type[Clocks], config: Config) -> DataFrame:
    own = [f for f in stream.schema.fields if f.name not in processor.DROPPED]
    schema = StructType([*own, *StructType.fromDDL(processor.ADDED).fields])
    run = processor([f.name for f in schema.fields], config)
    return stream.groupBy(*MACHINE).transformWithStateInPandas(run, schema, "Append", "EventTime", eventTimeColumnName="snapshot_ts")


def inputs(features: DataFrame, remotes: DataFrame, ports: DataFrame, absences: DataFrame | None = None) -> DataFrame:
    """Rows for the chain: features with the remotes (16 bytes each, in one value) and ports of the snapshot, and a row for each absence (host_id, instance, snapshot_ts)."""
    known = ["new_remotes", "new_remotes_saturated", "new_ports", *(c for c in features.columns if c.endswith(("_fast", "_slow", "_anomaly")) or c == "signal")]
    seen = remotes.groupBy(*SNAPSHOT).agg(F.listagg("remote").alias("remotes"))
    used = ports.groupBy(*SNAPSHOT).agg(F.collect_set(F.col("port").cast("int")).alias("ports"))
    rows = features.drop(*known).join(seen, SNAPSHOT).join(used, SNAPSHOT, "left").withColumn("ports", F.coalesce("ports", F.array().cast("array<int>")))
    rows = rows.withColumn("present", F.lit(True))
    if absences is not None:
        rows = rows.unionByName(absences.select(*MACHINE, "snapshot_ts").withColumn("present", F.lit(False)), allowMissingColumns=True)
    return rows.withColumn("t", F.unix_timestamp("snapshot_ts"))


def one_value(addresses: Column) -> Column:
    """An array of addresses, one behind the other; shorter ones are filled up in front."""
    filled = F.transform(addresses, lambda x: F.hex(F.lpad(x, 16, F.lit(bytearray(1)))))
    return F.unhex(F.array_join(filled, ""))


def baselines(stream: DataFrame, config: Config = DEFAULT, delay: str = "1 minute") -> DataFrame:
    """inputs() as a stream -> its rows with what is new and the averages. Remotes may be an array of addresses as well."""
    if stream.schema["remotes"].dataType != BinaryType():
        stream = stream.withColumn("remotes", one_value(F.col("remotes")))
    return _stage(stream.withWatermark("snapshot_ts", delay), Baselines, config)


def reports(stream: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """What baselines() gives -> every row with its rule hit, persistence and whether it is reported.

    The confidence of a hit depends on how often it came in a row, three times at most: the scores for
    one, two and three are told beforehand, and the processor takes one of them.
    """
    out = classifier.classify(stream, config=config)
    sev = scoring.alert_severity()
    conf = [scoring.alert_confidence(F.lit(float(n))) for n in (1, 2, 3)]
    out = out.withColumn("severity_score", F.when(F.col("kind").isNotNull(), sev))
    told = out.select(
        *SNAPSHOT, "t", "present", "new_remotes", "new_ports", "signal", "kind", "remote_share", "port_share", "top_remote", F.col("top_port").cast("long").alias("top_port"),
        "severity_score", scoring.severity_band(F.col("severity_score")).alias("severity_band"),
        F.array(*conf).alias("confidences"), F.array(*(scoring.priority(F.col("severity_score"), x) for x in conf)).alias("priorities"),
    )
    return _stage(told, Reports, config).where("present").drop("t", "present", "confidences", "priorities")


def chain(stream: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """inputs() as a stream -> every feature row with what is new, its signal, rule hit, persistence and report."""
    return reports(baselines(stream, config), config)


class Alive(Clocks):
    """Which of the four kinds of state a row finds alive, before it renews them; a report is renewed only when its clock has run out."""

    KINDS = ("averages", "priors", "persistence", "reported")
    ADDED = ", ".join(f"{k} boolean" for k in KINDS)

    def __init__(self, names: list[str], config: Config = DEFAULT):
        super().__init__(names, config)
        ttl = config.ewma_ttl_s, config.prior_ttl_s, config.persist_ttl_s, config.emit_ttl_s
        self.STATES = {k: ("name string", "t long", s) for k, s in zip(self.KINDS, ttl)}

    def step(self, frame: pd.DataFrame) -> pd.DataFrame:
        """State is read before the first row and written after the last: each call crosses over to the JVM."""
        times = frame["t"].tolist()
        held = {k: self.alive(k, (k,), times[0]) for k in self.KINDS}
        out: dict[str, list[bool]] = {k: [] for k in self.KINDS}
        for t in times:
            for k, (_, _, ttl) in self.STATES.items():
                found = held[k] is not None and t - held[k][0] <= ttl
                out[k].append(found)
                if k != "reported" or not found:
                    held[k] = (t,)
        for k, value in held.items():
            self.maps[k].updateValue((k,), value)
        self.wake(min(value[0] + int(self.STATES[k][2]) + 1 for k, value in held.items()))
        return pd.DataFrame(out, columns=self.added)


class AliveTogether(StatefulProcessor):
    """What Alive tells, for a bucket of machines at a time: one state holds the times of all of them, and one timer, set to the
    first clock of any, removes what has run out. Most machines have few rows in a batch, so that calls for each would cost more than their rows."""

    def __init__(self, names: list[str], config: Config = DEFAULT):
        self.names = names
        self.ttl = tuple(int(s) for _, _, s in Alive([], config).STATES.values())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("clocks", "machines binary, timer long")

    def read(self) -> tuple[dict[tuple, list], int | None]:
        value = self.held.get() if self.held.exists() else None
        return ({}, None) if value is None else (pickle.loads(value[0]), value[1])

    def write(self, machines: dict[tuple, list], timer: int | None) -> None:
        due = min((t + s + 1 for times in machines.values() for t, s in zip(times, self.ttl) if t is not None), default=None)
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer * 1000)
        if due is None:
            self.held.clear()
            return
        if timer != due:
            self.handle.registerTimer(due * 1000)
        self.held.update((pickle.dumps(machines), due))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("snapshot_ts", kind="stable").reset_index(drop=True)
        machines, timer = self.read()
        found: list[list[bool]] = [[] for _ in Alive.KINDS]
        for machine, t in zip(zip(frame["host_id"], frame["instance"]), frame["t"].tolist()):
            times = machines.setdefault(machine, [None] * len(Alive.KINDS))
            for k, (kind, ttl) in enumerate(zip(Alive.KINDS, self.ttl)):
                alive = times[k] is not None and t - times[k] <= ttl
                found[k].append(alive)
                if kind != "reported" or not alive:
                    times[k] = t
        self.write(machines, timer)
        yield frame.assign(**dict(zip(Alive.KINDS, found)))[self.names]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) // 1000
        machines, _ = self.read()  # its timer has just gone
        kept = {m: [t if t is not None and now - t <= s else None for t, s in zip(times, self.ttl)] for m, times in machines.items()}
        self.write({m: times for m, times in kept.items() if any(t is not None for t in times)}, None)
        return iter([])


def clocks(stream: DataFrame, config: Config = DEFAULT, delay: str = "1 minute", buckets: int = 256) -> DataFrame:
    """stream (host_id, instance, snapshot_ts) and which kinds of state each row finds alive; machines are dealt to buckets (0: each by itself)."""
    timed = stream.withColumn("t", F.unix_timestamp("snapshot_ts")).withWatermark("snapshot_ts", delay)
    if not buckets:
        return _stage(timed, Alive, config)
    schema = StructType([*timed.schema.fields, *StructType.fromDDL(Alive.ADDED).fields])
    run = AliveTogether([f.name for f in schema.fields], config)
    dealt = timed.withColumn("bucket", F.pmod(F.xxhash64(*MACHINE), F.lit(buckets))).groupBy("bucket")
    return dealt.transformWithStateInPandas(run, schema, "Append", "EventTime", eventTimeColumnName="snapshot_ts")
