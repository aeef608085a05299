"""Ordered folds: recurrences whose next step depends on the state.

Rows are dealt by key and sorted within partitions; a task keeps one key's state at a time
and streams through its rows, however many there are. The step functions are plain Python
and shared with the streaming operators; each names the columns that it reads, and no other
leaves the Arrow batch.

Averages are affine maps of the state before, so a key's history can also be cut into slices of time:
``flow_ewma_sliced`` composes the maps of each slice in parallel, carries the states over slices, and
then fills in the rows of all slices at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..config import DEFAULT, IDENTITY, Config


def fold(df: DataFrame, key: list[str], order: list[str], step: Callable[[dict, dict], dict], added: str, start: Callable[[dict], dict] = lambda row: {}) -> DataFrame:
    """df with the columns of ``step(state, row)``; a key's state is what ``start`` makes of its first row, empty as a rule."""
    new = StructType.fromDDL(added).fields
    schema = StructType([*df.schema.fields, *new])
    types = [(f.name, to_arrow_type(f.dataType)) for f in new]
    reads = getattr(step, "reads", tuple(df.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, {}
        for batch in batches:
            out = []
            keys = zip(*(batch.column(k).to_pylist() for k in key))
            rows = zip(*(batch.column(c).to_pylist() for c in reads))
            for own, values in zip(keys, rows):
                row = dict(zip(reads, values))
                if own != now:
                    now, state = own, start(row)
                out.append(step(state, row))
            columns = [pa.array([o[name] for o in out], kind) for name, kind in types]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *(name for name, _ in types)])

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


def reading(*columns: str):
    """Names the columns that a step reads."""

    def mark(step: Callable[[dict, dict], dict]) -> Callable[[dict, dict], dict]:
        step.reads = columns
        return step

    return mark


def alpha(dt: float, tau: float) -> float:
    return 1.0 if dt <= 0 or tau <= 0 else 1 - math.exp(-dt / tau)


def clamp(x: float) -> float:
    return min(1.0, max(0.0, x))


# axis: feature column, weight, least spread, floor of the spread, only where accounting is on
AXES = (
    ("flows", 0.25, 10.0, 0.001, False), ("unique_remotes", 0.20, 5.0, 0.001, False), ("unique_ports", 0.20, 5.0, 0.001, False),
    ("unreplied_ratio", 0.20, 0.05, 0.0001, False), ("bytes_per_flow", 0.10, 256.0, 0.001, True), ("packets_per_flow", 0.05, 2.0, 0.001, True),
)


def ewma_step(config: Config) -> Callable[[dict, dict], dict]:
    """Fast and slow averages of six axes, their anomalies after the update, and the signal."""

    @reading("t", "accounting", *(a[0] for a in AXES))
    def step(state: dict, row: dict) -> dict:
        now = row["t"]
        if "t" in state and now - state["t"] > config.ewma_ttl_s:
            state.clear()
        dt = max(1.0, now - state["t"]) if "t" in state else 0.0
        state["t"] = now
        fast, slow = alpha(dt, config.tau_fast_s), alpha(dt, config.tau_slow_s)
        out, signal = {}, 0.0
        for name, weight, spread, floor, acct in AXES:
            x, anomaly = float(row[name]), 0.0
            if not acct or (row["accounting"] and x > 0):
                f, s = state.get(name, (None, None))
                f, s = (x, x) if f is None else (f + fast * (x - f), s + slow * (x - s))
                state[name] = f, s
                anomaly = clamp(abs(x - s) / max(abs(f - s), spread / config.s, floor) / 6)
            out[f"{name}_fast"], out[f"{name}_slow"] = state.get(name, (0.0, 0.0))
            out[f"{name}_anomaly"] = anomaly
            signal += weight * anomaly
        signal = clamp(signal)
        out["signal"] = clamp(signal ** (1 / config.s)) if config.s != 1 else signal
        return out

    return step


EWMA_COLUMNS = ", ".join(f"{a[0]}_{k} double" for a in AXES for k in ("fast", "slow", "anomaly")) + ", signal double"


def flow_ewma(features: DataFrame, config: Config = DEFAULT, key: list[str] = IDENTITY) -> DataFrame:
    """key may add the island of presence, so that a machine that returns starts anew."""
    timed = features.withColumn("t", F.unix_timestamp("snapshot_ts"))
    return fold(timed, key, ["snapshot_ts"], ewma_step(config), EWMA_COLUMNS).drop("t")


def carried(config: Config) -> Callable[[dict, dict], dict]:
    """What the rows of a slice so far make of the averages before it, without knowing them.

    For each axis and speed a state v becomes a * v + b; where there was none, it becomes c (null: still none).
    ``before`` is the time of the last row before the slice.
    """

    @reading("t", "before", "accounting", *(a[0] for a in AXES))
    def step(state: dict, row: dict) -> dict:
        now, last = row["t"], state.get("t", row["before"])
        if last is not None and now - last > config.ewma_ttl_s:
            state["maps"] = {}
            state["reset"] = True
        state["t"] = now
        dt = max(1.0, now - last) if last is not None else 0.0
        maps = state.setdefault("maps", {})
        for name, _, _, _, acct in AXES:
            x = float(row[name])
            for speed, tau in (("fast", config.tau_fast_s), ("slow", config.tau_slow_s)):
                a, b, c = maps.get((name, speed), (0.0 if state.get("reset") else 1.0, 0.0, None))
                if not acct or (row["accounting"] and x > 0):
                    k = alpha(dt, tau)
                    if state.get("reset"):
                        a, b = 0.0, x if c is None else b + k * (x - b)
                    else:
                        a, b = a * (1 - k), b * (1 - k) + k * x
                    c = x if c is None else c + k * (x - c)
                maps[name, speed] = a, b, c
        return {f"{n}_{s}_{k}": v for (n, s), m in maps.items() for k, v in zip("abc", m)} | {"reset": bool(state.get("reset"))}

    return step


def flow_ewma_sliced(features: DataFrame, config: Config = DEFAULT, slice_s: int = 86400, key: list[str] = IDENTITY) -> DataFrame:
    """flow_ewma of the same rows, with each key's history cut into slices that are worked on side by side.

    One row for each key and slice is folded in order; everything that grows with the rows is dealt by key and slice.
    """
    pairs = [(n, s) for n, *_ in AXES for s in ("fast", "slow")]
    part = [*key, "slice"]
    timed = features.withColumn("t", F.unix_timestamp("snapshot_ts")).withColumn("slice", F.floor(F.col("t") / slice_s))
    in_order = Window.partitionBy(*key).orderBy("slice")  # a row for each slice
    ends = timed.groupBy(*part).agg(F.max("t").alias("last")).withColumn("before", F.lag("last").over(in_order)).drop("last")
    timed = timed.join(ends, part)
    added = ", ".join(f"{n}_{s}_{k} double" for n, s in pairs for k in "abc") + ", reset boolean"
    mapped = fold(timed.select(*part, "snapshot_ts", *(c for c in carried(config).reads)), part, ["snapshot_ts"], carried(config), added)
    names = [f"{n}_{s}_{k}" for n, s in pairs for k in "abc"]
    maps = mapped.groupBy(*part).agg(F.max_by(F.struct(*names, "reset"), "snapshot_ts").alias("m")).select(*part, "m.*")

    @reading("slice", "reset", *names)
    def over(state: dict, row: dict) -> dict:
        given = {f"{n}_{s}_in": state.get((n, s)) for n, s in pairs}
        for n, s in pairs:
            a, b, c = (row[f"{n}_{s}_{k}"] for k in "abc")
            v = state.get((n, s))
            state[n, s] = c if v is None or row["reset"] else a * v + b
        return given

    given = fold(maps, key, ["slice"], over, ", ".join(f"{n}_{s}_in double" for n, s in pairs)).drop(*names, "reset")
    rows = timed.join(given, part)
    step = ewma_step(config)

    def start(row: dict) -> dict:
        found = {n: (row[f"{n}_fast_in"], row[f"{n}_slow_in"]) for n, *_ in AXES if row[f"{n}_fast_in"] is not None}
        return found | ({} if row["before"] is None else {"t": row["before"]})

    @reading(*step.reads, "before", *(f"{n}_{s}_in" for n, s in pairs))
    def again(state: dict, row: dict) -> dict:
        return step(state, row)

    done = fold(rows, part, ["snapshot_ts"], again, EWMA_COLUMNS, start)
    return done.select(*features.columns, *(f.name for f in StructType.fromDDL(EWMA_COLUMNS)))


RESOURCE_AXES = (("cpu", 30.0, 120.0), ("mem", 45.0, 180.0), ("disk", 30.0, 180.0), ("net", 30.0, 120.0))
WEIGHTS = {"cpu": 0.25, "mem": 0.25, "disk": 0.30, "net": 0.20}


def resource_step(config: Config) -> Callable[[dict, dict], dict]:
    """Axis averages that rise faster than they fall, severities, their blend, and the cap at 95."""

    @reading("t", *(f"{a[0]}_{k}" for a in RESOURCE_AXES for k in ("p", "conf", "impact")))
    def step(state: dict, row: dict) -> dict:
        dt = row["t"] - state["t"] if "t" in state else 0
        dt = dt if 0 < dt < 300 else config.interval_s
        state["t"] = row["t"]
        out, severity = {}, {}
        for axis, rise, down in RESOURCE_AXES:
            p = clamp(row[f"{axis}_p"] * clamp(row[f"{axis}_conf"]))
            e = state.get(axis)
            e = p if e is None else clamp(e + alpha(dt, rise if p > e else down) * (p - e))
            state[axis] = out[f"{axis}_ewma"] = e
            severity[axis] = out[f"{axis}_severity"] = clamp(clamp(e) ** 2) * 100 * clamp(row[f"{axis}_impact"])
        raw = clamp(sum(WEIGHTS[a] * clamp(v / 100) ** 3 for a, v in severity.items()) ** (1 / 3)) * 100
        state["streak"] = streak = state.get("streak", 0) + 1 if raw >= 95 else 0
        n90 = sum(v >= 90 for v in severity.values())
        persisted = n90 < 2 and streak >= 3
        capped = raw > 95 and n90 < 2 and not persisted
        final = 95.0 if capped else raw
        top = max(severity, key=severity.get)  # the first of equals
        band = next((b for b in (85, 60, 30) if final >= b), 0)
        return out | {
            "overall_raw": raw, "overall": final, "axes90": n90, "streak": streak, "cap_active": capped,
            "persistence_triggered": persisted, "top_axis": top, "band": band,
        }

    return step


RESOURCE_COLUMNS = (
    ", ".join(f"{a}_ewma double, {a}_severity double" for a, _, _ in RESOURCE_AXES)
    + ", overall_raw double, overall double, axes90 int, streak int, cap_active boolean, persistence_triggered boolean, top_axis string, band int"
)


def resource_axes(pressures: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """pressures: host_id, instance, ts and p, conf, impact of the four axes; zeros for a stopped machine."""
    timed = pressures.withColumn("t", F.unix_timestamp("ts"))
    return fold(timed, ["host_id", "instance"], ["ts"], resource_step(config), RESOURCE_COLUMNS).drop("t")


def contact_step(config: Config) -> Callable[[dict, dict], dict]:
    """Whether a pair is a new contact: not seen in the interval before."""

    @reading("t")
    def step(state: dict, row: dict) -> dict:
        new = "t" not in state or row["t"] - state["t"] > config.interval_s
        state["t"] = row["t"]
        return {"is_new": new}

    return step


RANK = {"P4": 1, "P3": 2, "P2": 3, "P1": 4}


def emit_step(config: Config) -> Callable[[dict, dict], dict]:
    """Whether a rule hit is reported: persistence has been counted before (``hits``, ``required``)."""

    @reading("t", "kind", "priority", "severity_band", "hits", "required", "remote_share", "port_share", "top_remote", "top_port")
    def step(state: dict, row: dict) -> dict:
        now = row["t"]
        if "t" in state and now - state["t"] > config.emit_ttl_s:
            state.clear()
        last, emit, reason = state.get("t", 0), False, "new_kind"
        if row["hits"] >= row["required"]:
            rank = RANK[row["priority"]]
            if state.get("kind") != row["kind"]:
                emit = True
            elif state["priority"] != row["priority"]:
                emit, reason = True, "escalated" if rank > RANK[state["priority"]] else "band_cross"
            elif state["band"] != row["severity_band"]:
                emit, reason = True, "band_cross"
            elif row["remote_share"] >= 0.60 and row["top_remote"] and state["remote"] and state["remote"] != row["top_remote"]:
                emit, reason = True, "changed"
            elif row["port_share"] >= 0.60 and row["top_port"] and state["port"] and state["port"] != row["top_port"]:
                emit, reason = True, "changed"
            if emit and reason in ("changed", "band_cross") and now - last < config.cooldown_s:
                emit = False
            if not emit and rank >= RANK["P2"] and now - last >= config.heartbeat_s:
                emit, reason = True, "heartbeat"
        suppressed = None
        if row["hits"] < row["required"]:
            suppressed = "persistence_gate"
        elif not emit and reason in ("changed", "band_cross") and now - last < config.cooldown_s:
            suppressed = "cooldown"
        if emit:
            state.update(
                kind=row["kind"], priority=row["priority"], band=row["severity_band"], remote=row["top_remote"], port=row["top_port"], t=now
            )
        return {"emitted": emit, "emit_reason": reason if emit else None, "suppress_reason": suppressed}

    return step


def emit_gate(hits: DataFrame, config: Config = DEFAULT, key: list[str] = IDENTITY) -> DataFrame:
    timed = hits.withColumn("t", F.unix_timestamp("snapshot_ts"))
    return fold(timed, key, ["snapshot_ts"], emit_step(config), "emitted boolean, emit_reason string, suppress_reason string").drop("t")


def throttle_step(config: Config) -> Callable[[dict, dict], dict]:
    @reading("t")
    def step(state: dict, row: dict) -> dict:
        deliver = "t" not in state or row["t"] - state["t"] >= config.throttle_s
        if deliver:
            state["t"] = row["t"]
        return {"delivered": deliver}

    return step


def throttle(events: DataFrame, key: list[str], ts: str = "ts", config: Config = DEFAULT) -> DataFrame:
    """Marks the events that are delivered: none within the interval after the last delivered one of its key."""
    timed = events.withColumn("t", F.unix_timestamp(ts))
    return fold(timed, key, [ts], throttle_step(config), "delivered boolean").drop("t")


@reading("instant")
def intel_step(state: dict, row: dict) -> dict:
    e = row["instant"] if "e" not in state else state["e"] + 0.1 * (row["instant"] - state["e"])
    state["e"] = e
    return {"intel_ewma": e, "intel_combined": clamp(0.5 * row["instant"] + 0.5 * e)}


def threat_intel(signals: DataFrame) -> DataFrame:
    """signals: host_id, instance, snapshot_ts, instant (0-1)."""
    return fold(signals, ["host_id", "instance"], ["snapshot_ts"], intel_step, "intel_ewma double, intel_combined double")
