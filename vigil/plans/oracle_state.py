"""The recurrences in SQL: resource axes, emit gate, throttle and what follows from them, as recursive statements."""

from __future__ import annotations

from ..operators.folds import RESOURCE_AXES, WEIGHTS
from . import oracle
from .oracle import CTE, ID, same

#: Share of all vCPUs in percent, of a counter that grows by n times the one counter.
CPU = "least(100, coalesce(inc * {n}.0 / nullif(dt, 0) / 1e9 * 100 / vcpus, 0))"
_U, _S, _W = (CPU.format(n=n) for n in (400000000, 30000000, 9000000))
_PPS = "coalesce(inc * 9000.0 / nullif(dt, 0), 0)"
_ACTIVE = "coalesce(greatest(inc * 5 / nullif(dt, 0) / 100, inc * 368640 / nullif(dt, 0) / 10485760), 0)"


def _clamp(x: str) -> str:
    return f"least(1, greatest(0, {x}))"


_MEM = (
    f"greatest(CASE WHEN used > 0 THEN {_clamp('(least(used / 4096, 1.5) - 0.8) / 0.7')} ELSE 0 END, "
    f"{_clamp('(coalesce(inc * 5000.0 / nullif(dt, 0), 0) - 1024) / 15360')}, {_clamp('(coalesce(inc * 60.0 / nullif(dt, 0), 0) - 5) / 195')})"
)
_DISK = "CASE WHEN dt > 0 AND inc > 0 THEN 0.009 / (0.018 + 0.08 * 8192 / 983040.0) ELSE 0 END"
_NET = "CASE WHEN dt > 0 AND inc > 0 THEN log10(17.0 / 9000 / 0.0001) / 2 ELSE 0 END"
_PARTS = {  # pressure, confidence, impact
    "cpu": (f"greatest(least(1, ({_S} + {_W}) / 50), 0.3 * {_U} / 100)", "1", "ln(1 + vcpus) / ln(17)"),
    "mem": (_MEM, "CASE WHEN used > 0 THEN 1.0 ELSE 0.5 END", "ln(4097) / ln(32769)"),
    "disk": (_DISK, _ACTIVE, _ACTIVE),
    "net": (_NET, f"least(1, {_PPS} / 1000)", f"least(1, ln(1 + {_PPS}) / ln(20001))"),
}
_COLUMNS = ", ".join(
    f"CAST({_clamp(p)} AS DOUBLE) AS {a}_p, CAST({_clamp(c)} AS DOUBLE) AS {a}_conf, CAST({_clamp(i)} AS DOUBLE) AS {a}_impact" for a, (p, c, i) in _PARTS.items()
)
CTE["press"] = f"""
SELECT host_id, instance, ts, t, event_type, row_number() OVER (PARTITION BY host_id, instance ORDER BY ts) AS no, {_COLUMNS}
FROM (SELECT *, (counter * 5000 % 6000) * 1.0 AS used FROM lagged)"""
_DT = "CASE WHEN o.t - r.t > 0 AND o.t - r.t < 300 THEN o.t - r.t ELSE 15.0 END"


def _grow(axis: str, rise: float, down: float) -> str:
    p, e = f"o.{axis}_p * o.{axis}_conf", f"r.{axis}_e"
    return _clamp(f"{e} + (1 - exp(-({_DT}) / CASE WHEN {p} > {e} THEN {rise} ELSE {down} END)) * ({p} - {e})")


CTE["axes"] = f"""
SELECT host_id, instance, no, t, {', '.join(f'{a}_p * {a}_conf AS {a}_e' for a, _, _ in RESOURCE_AXES)} FROM press WHERE no = 1
UNION ALL SELECT o.host_id, o.instance, o.no, o.t, {', '.join(_grow(*a) for a in RESOURCE_AXES)}
FROM axes r JOIN press o ON o.host_id = r.host_id AND o.instance = r.instance AND o.no = r.no + 1"""
_AXES = [a for a, _, _ in RESOURCE_AXES]
CTE["severe"] = f"""
SELECT p.*, {', '.join(f'r.{a}_e AS {a}_ewma, power(r.{a}_e, 2) * 100 * p.{a}_impact AS {a}_severity' for a in _AXES)}
FROM press p JOIN axes r ON r.host_id = p.host_id AND r.instance = p.instance AND r.no = p.no"""
CTE["raws"] = f"""
SELECT *, {_clamp('power(' + ' + '.join(f'{WEIGHTS[a]} * power({a}_severity / 100, 3)' for a in _AXES) + ', 1 / 3.0)')} * 100 AS overall_raw,
       {' + '.join(f'CASE WHEN {a}_severity >= 90 THEN 1 ELSE 0 END' for a in _AXES)} AS axes90,
       CASE WHEN cpu_severity >= greatest(mem_severity, disk_severity, net_severity) THEN 'cpu' WHEN mem_severity >= greatest(disk_severity, net_severity) THEN 'mem'
            WHEN disk_severity >= net_severity THEN 'disk' ELSE 'net' END AS top_axis FROM severe"""
CTE["streaks"] = """
SELECT *, no - coalesce(max(CASE WHEN overall_raw < 95 THEN no END) OVER (PARTITION BY host_id, instance ORDER BY no), 0) AS streak FROM raws"""
CTE["caps"] = """
SELECT *, axes90 < 2 AND streak >= 3 AS persistence_triggered, overall_raw > 95 AND axes90 < 2 AND streak < 3 AS cap_active FROM streaks"""
CTE["res"] = """
SELECT *, CASE WHEN overall >= 85 THEN 85 WHEN overall >= 60 THEN 60 WHEN overall >= 30 THEN 30 ELSE 0 END AS band
FROM (SELECT *, CASE WHEN cap_active THEN 95.0 ELSE overall_raw END AS overall FROM caps)"""
_BEFORE = "OVER (PARTITION BY host_id, instance ORDER BY no)"
CTE["resev"] = f"""
SELECT * FROM (SELECT *, coalesce(band <> lag(band) {_BEFORE}, true) OR coalesce(top_axis <> lag(top_axis) {_BEFORE}, true)
                 OR coalesce(cap_active <> lag(cap_active) {_BEFORE}, cap_active) OR persistence_triggered AS changed FROM res) WHERE changed AND overall >= 30"""

_STATE = ("kind", "priority", "severity_band", "top_remote", "top_port")
CTE["waiting"] = f"""
SELECT {ID}, {', '.join(_STATE)}, remote_share, port_share, hits >= CASE WHEN priority IN ('P1', 'P2') THEN 2 ELSE 3 END AS ready,
       row_number() OVER (PARTITION BY host_id, instance, ip, direction ORDER BY ts) AS no FROM prio"""
CTE["gate"] = f"""
SELECT DISTINCT host_id, instance, ip, direction, CAST(0 AS BIGINT) AS no, CAST(NULL AS BIGINT) AS ts, CAST(NULL AS BIGINT) AS s_t,
       CAST(NULL AS VARCHAR) AS s_kind, CAST(NULL AS VARCHAR) AS s_priority, CAST(NULL AS VARCHAR) AS s_severity_band, CAST(NULL AS BIGINT) AS s_top_remote,
       CAST(NULL AS BIGINT) AS s_top_port, false AS emitted, CAST(NULL AS VARCHAR) AS emit_reason, CAST(NULL AS VARCHAR) AS suppress_reason FROM waiting
UNION ALL
SELECT host_id, instance, ip, direction, no, ts, CASE WHEN sends THEN ts WHEN alive THEN s_t END,
       {', '.join(f'CASE WHEN sends THEN {c} WHEN alive THEN s_{c} END' for c in _STATE)}, sends, CASE WHEN sends THEN cause END,
       CASE WHEN NOT ready THEN 'persistence_gate' WHEN held THEN 'cooldown' END
FROM (SELECT *, coalesce(cause IN ('changed', 'band_cross') AND ts - s_t < 180, false) AS held, ready AND cause IS NOT NULL AND NOT held AS sends
FROM (SELECT *, CASE WHEN NOT alive OR s_kind <> kind THEN 'new_kind' WHEN priority < s_priority THEN 'escalated' WHEN priority > s_priority THEN 'band_cross'
               WHEN s_severity_band <> severity_band THEN 'band_cross' WHEN remote_share >= 0.6 AND s_top_remote <> top_remote THEN 'changed'
               WHEN port_share >= 0.6 AND top_port > 0 AND s_top_port > 0 AND s_top_port <> top_port THEN 'changed' END AS cause
FROM (SELECT o.*, {', '.join(f's_{c}' for c in _STATE)}, s_t, coalesce(o.ts - s_t <= 3600, false) AS alive
FROM gate g JOIN waiting o ON o.host_id = g.host_id AND o.instance = g.instance AND o.ip = g.ip AND o.direction = g.direction AND o.no = g.no + 1)))"""
CTE["gated"] = f"""
SELECT p.*, CASE WHEN p.priority IN ('P1', 'P2') THEN 2 ELSE 3 END AS required, g.emitted, g.emit_reason, g.suppress_reason
FROM prio p JOIN gate g ON {same('p', 'g')}"""

CTE["notices"] = """
SELECT family, host_id, key, ts, count(*) AS events, row_number() OVER (PARTITION BY family, host_id, key ORDER BY ts) AS no FROM (
SELECT 'behavior' AS family, host_id, instance || '|' || kind AS key, ts FROM gated WHERE emitted
UNION ALL SELECT 'threat', host_id, list || '|' || instance || '|' || a_ip || '|' || b_ip, ts FROM routed
UNION ALL SELECT 'host', l.host_id, l.list || '|' || l.ip, s.ts FROM listed l JOIN (SELECT DISTINCT host_id, ts FROM flows) s ON s.host_id = l.host_id)
GROUP BY family, host_id, key, ts"""
CTE["listed"] = """
SELECT DISTINCT h.host_id, l.list, h.ip FROM host_ips h JOIN threat_ips l ON l.ip = h.ip
UNION SELECT DISTINCT h.host_id, c.list, h.ip FROM host_ips h JOIN threat_cidrs c ON h.ip BETWEEN c.network AND c.network + CAST(power(2, 32 - c.prefix_len) AS BIGINT) - 1"""
CTE["notices"] = CTE.pop("notices")  # after the listed addresses it reads
CTE["throttled"] = """
SELECT family, host_id, key, ts, no, events, ts AS sent, 1 AS delivered FROM notices WHERE no = 1
UNION ALL SELECT o.family, o.host_id, o.key, o.ts, o.no, o.events, CASE WHEN o.ts - r.sent >= 300 THEN o.ts ELSE r.sent END, CASE WHEN o.ts - r.sent >= 300 THEN 1 ELSE 0 END
FROM throttled r JOIN notices o ON o.family = r.family AND o.host_id = r.host_id AND o.key = r.key AND o.no = r.no + 1"""

SIGNAL = "greatest(least(1, greatest(0, least(1, log10(1 + 9 * s.host_impact)) + s.signal)), CASE p.priority WHEN 'P1' THEN 1.0 WHEN 'P2' THEN 0.7 WHEN 'P3' THEN 0.5 ELSE 0 END)"
CTE["behave"] = f"""
SELECT s.host_id, s.instance, s.ts, coalesce(max(CASE WHEN s.direction = 'outbound' THEN {SIGNAL} END), 0) AS o,
       coalesce(max(CASE WHEN s.direction = 'inbound' THEN {SIGNAL} END), 0) AS i FROM sig s LEFT JOIN prio p ON {same('s', 'p')} GROUP BY s.host_id, s.instance, s.ts"""
CTE["machine"] = """
SELECT host_id, 'vm' || substr(instance, 2) AS instance, 1704067200 + 15 * (no - 1) AS ts, overall, cpu_severity, mem_severity, disk_severity, net_severity,
       event_type <> 'view' AS running FROM res"""
CTE["attend"] = """
SELECT b.*, coalesce(m.running, false) AS running, CASE WHEN m.running THEN m.overall ELSE 0 END AS resource, (b.o + b.i) / 2 * 100 AS behavior,
       least(1, greatest(0, 0.5 * coalesce(t.instant, 0) + 0.5 * coalesce(t.e, 0))) * 100 AS threat, m.cpu_severity, m.mem_severity, m.disk_severity, m.net_severity
FROM behave b LEFT JOIN machine m ON m.host_id = b.host_id AND m.instance = b.instance AND m.ts = b.ts
LEFT JOIN intel t ON t.host_id = b.host_id AND t.instance = b.instance AND t.ts = b.ts"""
ATTENTION = "(CASE WHEN running THEN resource * 0.45 ELSE 0 END + behavior * 0.45 + threat * 0.10) / (CASE WHEN running THEN 1.0 ELSE 0.55 END)"


def address(x: str) -> str:
    return f"({x} // 16777216 || '.' || {x} // 65536 % 256 || '.' || {x} // 256 % 256 || '.' || {x} % 256)"


def fixed(x: str, places: int = 2) -> str:
    """x as text with that many places, halves away from zero."""
    return f"CAST(CAST(CAST({x} AS DECIMAL(18, 10)) AS DECIMAL(18, {places})) AS VARCHAR)"


_META = f"'flows_' || CAST(metadata_flows AS BIGINT) || '_unreplied_' || {fixed('metadata_unreplied_ratio')}"
_HOST = f"'host_table_impact_' || {fixed('host_impact * 100')} || '%'"
_UN = fixed("unreplied_ratio")
_ADMIN = f"top_port IN ({oracle.ADMIN_LIST})"
_MANY = "'many_ports_single_remote_ports_' || unique_ports"
_DOMINANT = f"'dominant_remote_share_' || {fixed('remote_share')}"
#: Reasons, in the order of oracle.RULES.
REASONS = {
    "restricted": ["'dst_port_179_seen'", "'dst_port_6081_seen'", _META, _META, "'traffic_to_host_or_link_local'", "'high_unreplied_local_flows'", "'traffic_to_infrastructure'"],
    "dark": [f"'unmonitored_flows_' || CAST(dark_flows AS BIGINT) || '_unreplied_' || {_UN}", "'unmonitored_flows_' || CAST(dark_flows AS BIGINT)"],
    "protocol": [
        f"'smtp_flows_' || CAST(smtp_flows AS BIGINT) || '_remotes_' || unique_remotes || '_unreplied_' || {_UN}",
        "'stratum_flows_' || CAST(stratum_flows AS BIGINT) || '_port_' || top_port || '_remotes_' || unique_remotes",
        f"'port_53_avg_bytes_' || {fixed('bytes_per_flow', 0)} || '_udp_' || CAST(udp AS BIGINT) || '_unreplied_' || {_UN}",
        f"'remotes_' || unique_remotes || '_unreplied_' || {_UN}",
    ],
    "scan": [f"'many_remotes_single_port_unreplied_ratio_' || {_UN}", _MANY, _DOMINANT, "'deviation_from_baseline'"],
    "attack": ["'rapid_new_remote_ips'", _MANY, _DOMINANT, "'udp_unreplied_spike_count_' || CAST(udp AS BIGINT)"],
    "exposure": [
        f"'admin_flows_' || CAST(admin_flows AS BIGINT) || '_admin_ratio_' || {fixed('admin_flows * 1.0 / flows')} || '_port_' || CASE WHEN {_ADMIN} THEN top_port ELSE 0 END"
        " || '_public_remotes_' || CAST(public_remotes AS BIGINT)"
    ],
    "capacity": ["'2x_configured_threshold_2000'", _HOST, _HOST, _HOST, "'low_throughput_high_count'", "'high_bytes_per_flow'", _HOST],
    "bands": [f"'signal_' || {fixed('signal')}"] * 4,
}


def _reason(family: str) -> str:
    return "CASE " + " ".join(f"WHEN {w} THEN {text}" for (w, _, _), text in zip(oracle.RULES[family], REASONS[family], strict=True)) + " END"


_CHOSEN = ", ".join(f"CASE WHEN k_{f} IS NOT NULL THEN {_reason(f)} END" for f in ("dark", "scan", "protocol", "attack", "exposure", "capacity", "bands"))
CTE["ends"] = f"""
SELECT {ID}, min(remote) AS sample_remote, min(CASE WHEN {oracle.PRIVATE} AND NOT {oracle.INFRA} THEN remote END) AS private_remote,
       min(CASE WHEN {oracle.INFRA} THEN remote END) AS infra_remote FROM marked GROUP BY {ID}"""
CTE["told"] = f"""
SELECT g.*, CASE WHEN k_restricted IS NOT NULL THEN {_reason('restricted')} WHEN synergy_physics THEN {_reason('dark')} || ' | ' || {_reason('protocol')}
       WHEN synergy_scan THEN {_reason('dark')} || ' | ' || {_reason('scan')} ELSE coalesce({_CHOSEN}) END AS reason,
       CASE WHEN direction = 'outbound' THEN ip ELSE e.sample_remote END AS src,
       CASE WHEN direction = 'inbound' THEN ip WHEN kind = 'lateral_probe_suspected' THEN coalesce(e.private_remote, e.sample_remote)
            WHEN kind = 'restricted_network_probe' THEN coalesce(e.infra_remote, e.sample_remote) ELSE e.sample_remote END AS dst
FROM gated g JOIN ends e USING ({ID}) WHERE emitted"""


def five(x: str) -> str:
    """Halves go up on both engines, also where a double lies just below one."""
    return f"round({x} + 1e-9, 5)"


ALERTS = f"""
SELECT host_id, instance, ts, {address('ip')} AS fixed_ip, kind, reason,
       'Alert: ' || kind || ' detected (Flows: ' || CAST(flows AS BIGINT) || ', Unreplied: ' || {fixed('unreplied_ratio * 100', 0)} || '%, Impact: ' || {fixed('host_impact * 100')} || '%)' AS detail,
       direction, rule_id, 'internal' AS source, synergy_scan, synergy_physics, 2000 AS threshold_flows, local_scan_hits, infra_hits, infra_max_flows,
       flows AS flows_current, unique_remotes, unique_remotes >= 32768 AS unique_remotes_saturated, new_remotes, new_remotes >= 32768 AS new_remotes_saturated,
       unique_ports, new_ports, top_port AS top_dst_port, {address('top_remote')} AS top_remote_ip, {five('remote_share')} AS top_remote_share,
       {five('port_share')} AS top_port_share, mode AS evidence_mode, hits AS persistence_hits, required AS persistence_required, emit_reason, severity_score,
       confidence_score, severity_band, priority, priority_basis, {five('unreplied_ratio')} AS unreplied_ratio, multicast, icmp, udp,
       {five('host_impact * 100')} AS host_impact_percent, {five('signal')} AS behavior_signal, true AS accounting, {five('bytes_per_flow')} AS bytes_per_flow,
       {five('packets_per_flow')} AS packets_per_flow, unique_remotes > 32768 AS remote_map_capped,
       CASE WHEN unique_remotes <= 32768 THEN max_single_remote END AS max_flows_single_remote, max_single_port AS max_flows_single_port,
       {address('src')} AS src_ip, {address('dst')} AS dst_ip FROM told"""


CTE["moments"] = """
SELECT host_id, instance, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY host_id, instance ORDER BY ts) AS no,
       CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(lag(ts) OVER (PARTITION BY host_id, instance ORDER BY ts))) AS BIGINT) AS gap FROM counters"""
CTE["renewals"] = """
SELECT host_id, instance, no, t AS sent, false AS reported FROM moments WHERE no = 1
UNION ALL SELECT m.host_id, m.instance, m.no, CASE WHEN m.t - r.sent <= 3600 THEN r.sent ELSE m.t END, m.t - r.sent <= 3600
FROM renewals r JOIN moments m ON m.host_id = r.host_id AND m.instance = r.instance AND m.no = r.no + 1"""
#: Which clocks still run when a machine is seen again.
CLOCKS = """
SELECT m.host_id, m.instance, m.t, coalesce(gap <= 7200, false) AS averages, coalesce(gap <= 86400, false) AS priors, coalesce(gap <= 3600, false) AS persistence, reported
FROM moments m JOIN renewals r ON r.host_id = m.host_id AND r.instance = m.instance AND r.no = m.no"""
