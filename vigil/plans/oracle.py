"""The queries in SQL, on the same views, for a second engine."""

from __future__ import annotations

from ..functions.scalars import ADMIN
from ..sources.builtin_ports import BUILTIN
from . import adapters as a

ID = "host_id, instance, ip, direction, ts"
J = " AND ".join(f"x.{c} = y.{c}" for c in ID.split(", "))


def same(x: str, y: str, names: str = ID) -> str:
    return " AND ".join(f"{x}.{c} = {y}.{c}" for c in names.split(", "))


PRIVATE = (
    "(remote BETWEEN 167772160 AND 184549375 OR remote BETWEEN 2886729728 AND 2887778303 OR remote BETWEEN 3232235520 AND 3232301055 OR {local})"
)
LOCAL = "(remote BETWEEN 2130706432 AND 2147483647 OR remote BETWEEN 2851995648 AND 2852061183 OR remote BETWEEN 3758096384 AND 4026531839 OR remote = 0)"
PRIVATE = PRIVATE.format(local=LOCAL)
INFRA = "(remote BETWEEN 2851995648 AND 2852061183 OR own)"
MONITORED = ", ".join(f"('{d}', {p})" for d, ports in BUILTIN.items() for p in ports)
ADMIN_LIST = ", ".join(map(str, ADMIN))

#: Common table expressions, each after those it needs.
CTE = {
    "inst": a.INSTANCES,
    "flow_base": a.FLOW_BASE,
    "flows": a.FLOWS,
    "host_ips": a.HOST_IPS,
    "uniq": "SELECT host_id, ip, min(instance) AS instance FROM inst GROUP BY host_id, ip HAVING count(DISTINCT instance) = 1",
    "attr": """
SELECT f.*, CASE WHEN zs.instance IS NOT NULL OR zd.instance IS NOT NULL THEN zs.instance ELSE us.instance END AS src_inst,
       CASE WHEN zs.instance IS NOT NULL OR zd.instance IS NOT NULL THEN zd.instance ELSE ud.instance END AS dst_inst,
       zs.instance AS zone_src, zd.instance AS zone_dst
FROM flows f LEFT JOIN inst zs ON zs.host_id = f.host_id AND zs.zone = f.zone AND zs.ip = f.src_ip
LEFT JOIN inst zd ON zd.host_id = f.host_id AND zd.zone = f.zone AND zd.ip = f.dst_ip
LEFT JOIN uniq us ON us.host_id = f.host_id AND us.ip = f.src_ip LEFT JOIN uniq ud ON ud.host_id = f.host_id AND ud.ip = f.dst_ip""",
    "ev": """
SELECT host_id, src_inst AS instance, src_ip AS ip, 'outbound' AS direction, ts, dst_ip AS remote, dst_port AS port, proto, rev_packets = 0 AS unreplied,
       fwd_bytes + rev_bytes AS bytes, fwd_packets + rev_packets AS packets FROM attr WHERE src_inst IS NOT NULL
UNION ALL
SELECT host_id, dst_inst, dst_ip, 'inbound', ts, src_ip, dst_port, proto, rev_packets = 0, fwd_bytes + rev_bytes, fwd_packets + rev_packets
FROM attr WHERE dst_inst IS NOT NULL AND (src_inst IS NULL OR src_inst <> dst_inst)""",
    "rem": f"""
SELECT {ID}, remote, count(*) AS flows, sum(CASE WHEN unreplied THEN 1 ELSE 0 END) AS unreplied, sum(bytes) AS bytes, sum(packets) AS packets,
       sum(CASE WHEN proto IN (1, 58) THEN 1 ELSE 0 END) AS icmp, sum(CASE WHEN proto = 17 THEN 1 ELSE 0 END) AS udp FROM ev GROUP BY {ID}, remote""",
    "prt": f"SELECT {ID}, port, count(*) AS flows FROM ev WHERE port > 0 GROUP BY {ID}, port",
    "stats": f"""
SELECT {ID}, sum(flows) AS flows, sum(unreplied) AS unreplied, sum(bytes) AS bytes, sum(packets) AS packets, sum(icmp) AS icmp, sum(udp) AS udp,
       sum(CASE WHEN remote BETWEEN 3758096384 AND 4026531839 THEN flows ELSE 0 END) AS multicast, count(*) AS unique_remotes,
       max(flows) AS max_single_remote FROM rem GROUP BY {ID}""",
    "top_remote": f"SELECT {ID}, remote AS top_remote, flows AS max_single_remote FROM (SELECT *, row_number() OVER (PARTITION BY {ID} ORDER BY flows DESC, remote) AS n FROM rem) WHERE n = 1",
    "top_port": f"SELECT {ID}, port AS top_port, flows AS max_single_port FROM (SELECT *, row_number() OVER (PARTITION BY {ID} ORDER BY flows DESC, port) AS n FROM prt) WHERE n = 1",
    "groups": f"""
SELECT {ID}, count(*) AS unique_ports, sum(CASE WHEN port = 179 THEN flows ELSE 0 END) AS bgp_flows, sum(CASE WHEN port = 6081 THEN flows ELSE 0 END) AS geneve_flows,
       sum(CASE WHEN port IN (25, 465, 587) THEN flows ELSE 0 END) AS smtp_flows, sum(CASE WHEN port IN (3333, 4444, 8333) THEN flows ELSE 0 END) AS stratum_flows,
       sum(CASE WHEN direction = 'inbound' AND port IN ({ADMIN_LIST}) THEN flows ELSE 0 END) AS admin_flows FROM prt GROUP BY {ID}""",
    "marked": "SELECT r.*, h.ip IS NOT NULL AS own FROM rem r LEFT JOIN (SELECT DISTINCT host_id, ip FROM host_ips) h ON h.host_id = r.host_id AND h.ip = r.remote",
    "policy": f"""
SELECT {ID}, sum(CASE WHEN NOT {PRIVATE} AND NOT {INFRA} THEN 1 ELSE 0 END) AS public_remotes,
       sum(CASE WHEN direction = 'outbound' AND remote = 2852039166 THEN flows ELSE 0 END) AS metadata_flows,
       coalesce(sum(CASE WHEN direction = 'outbound' AND remote = 2852039166 THEN unreplied END) * 1.0
                / nullif(sum(CASE WHEN direction = 'outbound' AND remote = 2852039166 THEN flows ELSE 0 END), 0), 0) AS metadata_unreplied_ratio,
       CASE WHEN sum(flows) > 10 THEN sum(CASE WHEN direction = 'outbound' AND {INFRA} THEN 1 ELSE 0 END) ELSE 0 END AS infra_hits,
       CASE WHEN sum(flows) > 10 THEN coalesce(max(CASE WHEN direction = 'outbound' AND {INFRA} THEN flows END), 0) ELSE 0 END AS infra_max_flows,
       CASE WHEN sum(flows) > 10 THEN sum(CASE WHEN direction = 'outbound' AND NOT {INFRA} AND {LOCAL} THEN 1 ELSE 0 END) ELSE 0 END AS local_scan_hits
FROM marked GROUP BY {ID}""",
    "monitored": f"SELECT * FROM (VALUES {MONITORED}) v(direction, port)",
    "darkp": "SELECT p.* FROM prt p LEFT JOIN monitored m ON m.direction = p.direction AND m.port = p.port WHERE m.port IS NULL",
    "dark": f"""
SELECT {ID}, sum(flows) AS dark_flows, count(*) AS dark_ports, max(flows) AS max_single_dark_port,
       min(CASE WHEN n = 1 THEN port END) AS top_dark_port
FROM (SELECT *, row_number() OVER (PARTITION BY {ID} ORDER BY flows DESC, port) AS n FROM darkp) GROUP BY {ID}""",
    "snaps": f"SELECT *, row_number() OVER (PARTITION BY host_id, instance, ip, direction ORDER BY ts) AS no FROM (SELECT DISTINCT {ID} FROM rem)",
    "newr": f"""
SELECT {ID}, sum(CASE WHEN last IS NULL OR last <> no - 1 THEN 1 ELSE 0 END) AS new_remotes FROM (
SELECT x.*, y.no, lag(y.no) OVER (PARTITION BY x.host_id, x.instance, x.ip, x.direction, x.remote ORDER BY y.no) AS last FROM rem x JOIN snaps y ON {J}) GROUP BY {ID}""",
    "newp": f"""
SELECT {ID}, sum(CASE WHEN last IS NULL OR last <> no - 1 THEN 1 ELSE 0 END) AS new_ports, count(*) AS ports FROM (
SELECT x.*, y.no, lag(y.no) OVER (PARTITION BY x.host_id, x.instance, x.ip, x.direction, x.port ORDER BY y.no) AS last FROM prt x JOIN snaps y ON {J}) GROUP BY {ID}""",
    "totals": """
SELECT host_id, ts, instance, count(*) AS flows FROM (SELECT host_id, ts, src_inst AS instance FROM attr WHERE src_inst IS NOT NULL
UNION ALL SELECT host_id, ts, dst_inst FROM attr WHERE dst_inst IS NOT NULL AND (src_inst IS NULL OR src_inst <> dst_inst)) GROUP BY host_id, ts, instance""",
    "feat": f"""
SELECT s.*, t.top_remote, p.public_remotes, p.metadata_flows, p.metadata_unreplied_ratio, p.infra_hits, p.infra_max_flows, p.local_scan_hits, n.new_remotes,
       coalesce(g.unique_ports, 0) AS unique_ports, coalesce(g.bgp_flows, 0) AS bgp_flows, coalesce(g.geneve_flows, 0) AS geneve_flows,
       coalesce(g.smtp_flows, 0) AS smtp_flows, coalesce(g.stratum_flows, 0) AS stratum_flows, coalesce(g.admin_flows, 0) AS admin_flows,
       coalesce(tp.top_port, 0) AS top_port, coalesce(tp.max_single_port, 0) AS max_single_port, coalesce(d.dark_flows, 0) AS dark_flows,
       coalesce(d.dark_ports, 0) AS dark_ports, coalesce(d.top_dark_port, 0) AS top_dark_port, coalesce(np.new_ports, 0) AS new_ports,
       s.unreplied * 1.0 / s.flows AS unreplied_ratio, s.bytes * 1.0 / s.flows AS bytes_per_flow, s.packets * 1.0 / s.flows AS packets_per_flow,
       o.flows * 1.0 / {a.TABLE_MAX} AS host_impact, s.max_single_remote * 1.0 / s.flows AS remote_share,
       coalesce(tp.max_single_port, 0) * 1.0 / s.flows AS port_share
FROM stats s JOIN top_remote t ON {same('s', 't')} JOIN policy p ON {same('s', 'p')} JOIN newr n ON {same('s', 'n')}
LEFT JOIN groups g ON {same('s', 'g')} LEFT JOIN top_port tp ON {same('s', 'tp')} LEFT JOIN dark d ON {same('s', 'd')} LEFT JOIN newp np ON {same('s', 'np')}
JOIN totals o ON o.host_id = s.host_id AND o.ts = s.ts AND o.instance = s.instance""",
    "featm": """
SELECT *, CASE WHEN remote_share >= 0.6 AND remote_share >= port_share THEN 'dominant_remote' WHEN port_share >= 0.6 AND port_share > remote_share THEN 'dominant_port'
          WHEN remote_share < 0.4 AND port_share < 0.4 THEN 'distributed' ELSE 'mixed' END AS mode FROM feat""",
}

AXES = (("flows", 0.25, 10), ("unique_remotes", 0.2, 5), ("unique_ports", 0.2, 5), ("unreplied_ratio", 0.2, 0.05), ("bytes_per_flow", 0.1, 256), ("packets_per_flow", 0.05, 2))
_ORDERED = "SELECT *, row_number() OVER (PARTITION BY host_id, instance, ip, direction ORDER BY ts) AS no FROM featm"
_FIRST = ", ".join(f"CAST({n} AS DOUBLE) AS {n}_fast, CAST({n} AS DOUBLE) AS {n}_slow" for n, _, _ in AXES)
_NEXT = ", ".join(
    f"e.{n}_fast + (1 - exp(-(o.ts - e.ts) / 180.0)) * (o.{n} - e.{n}_fast), e.{n}_slow + (1 - exp(-(o.ts - e.ts) / 7200.0)) * (o.{n} - e.{n}_slow)" for n, _, _ in AXES
)
_SIGNAL = " + ".join(
    f"{w} * least(1, greatest(0, abs(o.{n} - e.{n}_slow) / greatest(abs(e.{n}_fast - e.{n}_slow), {m}) / 6))" for n, w, m in AXES
)
CTE["ordered"] = _ORDERED
CTE["ewma"] = f"""
SELECT host_id, instance, ip, direction, ts, no, {_FIRST} FROM ordered WHERE no = 1
UNION ALL SELECT o.host_id, o.instance, o.ip, o.direction, o.ts, o.no, {_NEXT} FROM ewma e JOIN ordered o
  ON o.host_id = e.host_id AND o.instance = e.instance AND o.ip = e.ip AND o.direction = e.direction AND o.no = e.no + 1"""
CTE["sig"] = f"SELECT o.*, least(1, greatest(0, {_SIGNAL})) AS signal, {', '.join(f'e.{n}_fast, e.{n}_slow' for n, _, _ in AXES)} FROM ordered o JOIN ewma e ON {same('o', 'e')}"

_OUT, _IN = "direction = 'outbound'", "direction = 'inbound'"
_SCAN = f"{_OUT} AND flows >= 20 AND unreplied_ratio >= 0.6"
_ATT = f"{_IN} AND flows >= 20 AND unreplied_ratio >= 0.6"
_CAP = "host_impact > 0.1 AND flows > 200"
RULES = {
    "restricted": [
        (f"{_OUT} AND bgp_flows > 0", "'bgp_peering_attempt'", "restricted_bgp"),
        (f"{_OUT} AND geneve_flows > 0", "'geneve_underlay_attempt'", "restricted_geneve"),
        (f"{_OUT} AND metadata_flows >= 100", "'metadata_service_hammering'", "restricted_metadata_hammer"),
        (f"{_OUT} AND metadata_flows >= 30 AND metadata_unreplied_ratio >= 0.6", "'metadata_probe_suspected'", "restricted_metadata_probe"),
        (f"{_OUT} AND local_scan_hits > 0", "'restricted_network_probe'", "restricted_local_scan"),
        (f"{_OUT} AND infra_hits > 0 AND unreplied_ratio >= 0.8 AND infra_max_flows >= flows * 0.3", "'lateral_probe_suspected'", "restricted_lateral_probe"),
        (f"{_OUT} AND infra_hits > 0", "'restricted_network_probe'", "restricted_infra_probe"),
    ],
    "dark": [
        ("unreplied_ratio >= 0.8 AND dark_flows >= 20", f"CASE WHEN {_IN} THEN 'inbound_' ELSE '' END || 'darkspace_port_detected'", "darkspace_unreplied"),
        ("dark_flows >= 50", f"CASE WHEN {_IN} THEN 'inbound_' ELSE '' END || 'darkspace_port_detected'", "darkspace_total"),
    ],
    "protocol": [
        (f"{_OUT} AND smtp_flows >= 50 AND top_port IN (25, 465, 587) AND unique_remotes >= 20 AND unreplied_ratio >= 0.3 AND (mode = 'dominant_port' OR port_share >= 0.7)", "'smtp_spam_behavior_suspected'", "proto_smtp_spam"),
        (f"{_OUT} AND stratum_flows >= 2 AND top_port IN (3333, 4444, 8333) AND unique_remotes <= 10", "'outbound_stratum_mining_suspected'", "proto_stratum_mining"),
        (f"{_OUT} AND top_port = 53 AND udp > 10 AND bytes_per_flow > 3000 AND unreplied_ratio >= 0.6", "'outbound_dns_tunneling_suspected'", "proto_dns_tunnel"),
        (f"{_OUT} AND udp > 100 AND unreplied_ratio >= 0.9 AND unique_remotes >= 50", "'outbound_udp_fanout_suspected'", "proto_udp_fanout"),
    ],
    "scan": [
        (f"{_SCAN} AND mode = 'dominant_port' AND unique_remotes >= 20 AND top_port <> 0", "'outbound_horizontal_scan_suspected'", "legacy_scan"),
        (f"{_SCAN} AND mode = 'dominant_remote' AND unique_ports >= 20", "'outbound_vertical_scan_suspected'", "legacy_scan"),
        (f"{_SCAN} AND mode = 'dominant_remote' AND remote_share >= 0.9 AND flows >= 200", "'outbound_single_remote_flood'", "legacy_scan"),
        (f"{_SCAN} AND signal >= 0.8 AND unique_remotes >= 30", "'outbound_distributed_fanout_unreplied'", "legacy_scan"),
    ],
    "attack": [
        (f"{_ATT} AND new_remotes >= 20 AND unique_ports <= 4", "CASE WHEN mode = 'dominant_port' THEN 'inbound_service_spray_suspected' ELSE 'inbound_distributed_probe_suspected' END", "legacy_inbound_attack_patterns"),
        (f"{_ATT} AND mode = 'dominant_remote' AND unique_ports >= 10", "'inbound_single_remote_multiport_probe_suspected'", "legacy_inbound_attack_patterns"),
        (f"{_ATT} AND mode = 'dominant_remote' AND remote_share >= 0.9 AND flows >= 200", "'inbound_single_remote_flood'", "legacy_inbound_attack_patterns"),
        (f"{_ATT} AND udp >= 100 AND unreplied_ratio >= 0.9", "CASE WHEN mode = 'dominant_port' THEN 'inbound_udp_targeted_flood_suspected' ELSE 'inbound_udp_flood_suspected' END", "legacy_inbound_attack_patterns"),
    ],
    "exposure": [
        (f"{_IN} AND admin_flows > 0 AND public_remotes > 0 AND (top_port IN ({ADMIN_LIST}) OR admin_flows >= 0.5 * flows) AND (new_remotes >= 10 OR unique_remotes >= 20 OR unreplied_ratio >= 0.6)", "'inbound_admin_port_exposure_suspected'", "legacy_inbound_exposure"),
    ],
    "capacity": [
        ("flows > 4000", "'conntrack_flow_limit_exceeded'", "legacy_capacity_and_flood"),
        (f"{_CAP} AND icmp > 50", "'host_icmp_flood_suspected'", "legacy_capacity_and_flood"),
        (f"{_CAP} AND multicast > 50", "'host_multicast_storm_suspected'", "legacy_capacity_and_flood"),
        (f"{_CAP} AND {_IN}", "'inbound_conntrack_pressure'", "legacy_capacity_and_flood"),
        (f"{_CAP} AND unreplied_ratio < 0.2 AND ((bytes_per_flow > 0 AND bytes_per_flow < 1000) OR (packets_per_flow > 0 AND packets_per_flow < 10))", "'host_accumulating_stale_flows'", "legacy_capacity_and_flood"),
        (f"{_CAP} AND unreplied_ratio < 0.2 AND (bytes_per_flow > 100000 OR packets_per_flow > 100)", "'host_high_throughput_anomaly'", "legacy_capacity_and_flood"),
        (_CAP, "'host_conntrack_pressure'", "legacy_capacity_and_flood"),
    ],
    "bands": [
        (f"flows >= 10 AND signal >= {at}", f"direction || '_behavior_spike_{band}_suspected'", "legacy_ewma_bands")
        for band, at in (("critical", 0.9), ("high", 0.8), ("medium", 0.65), ("low", 0.5))
    ],
}


def _case(family: str, value) -> str:
    return "CASE " + " ".join(f"WHEN {w} THEN {value(k, r)}" for w, k, r in RULES[family]) + " END"


_KINDS = ", ".join(f"{_case(f, lambda k, r: k)} AS k_{f}, {_case(f, lambda k, r: repr(r))} AS r_{f}" for f in RULES)
CTE["cand"] = f"SELECT *, {_KINDS} FROM sig"
_BOTH = "k_restricted IS NULL AND k_dark IS NOT NULL AND"
_REST = ("dark", "scan", "protocol", "attack", "exposure", "capacity", "bands")


def _won(prefix: str, physics: str, scan: str) -> str:
    return (
        f"CASE WHEN k_restricted IS NOT NULL THEN {prefix}_restricted WHEN {_BOTH} k_protocol IS NOT NULL THEN '{physics}' "
        f"WHEN {_BOTH} k_scan IS NOT NULL THEN '{scan}' ELSE coalesce({', '.join(f'{prefix}_{f}' for f in _REST)}) END"
    )


CTE["cls"] = f"""
SELECT *, {_won('k', 'darkspace_plus_physics', 'darkspace_plus_scan')} AS kind, {_won('r', 'synergy_darkspace_plus_physics', 'synergy_darkspace_plus_scan')} AS rule_id,
       ({_BOTH} k_scan IS NOT NULL) AS synergy_scan, ({_BOTH} k_protocol IS NOT NULL) AS synergy_physics FROM cand"""
CTE["loudsig"] = f"SELECT * REPLACE ({', '.join(f'{sql} AS {c}' for c, sql in a.LOUD.items())}) FROM sig"
CTE["loudcand"] = CTE["cand"].replace("FROM sig", "FROM loudsig")
CTE["loudcls"] = CTE["cls"].replace("FROM cand", "FROM loudcand")
CTE["pers"] = """
SELECT *, row_number() OVER (PARTITION BY host_id, instance, ip, direction, kind, island ORDER BY ts) AS hits FROM (
SELECT *, sum(CASE WHEN ts - last > 180 THEN 1 ELSE 0 END) OVER (PARTITION BY host_id, instance, ip, direction, kind ORDER BY ts) AS island FROM (
SELECT *, lag(ts) OVER (PARTITION BY host_id, instance, ip, direction, kind ORDER BY ts) AS last FROM cls WHERE kind IS NOT NULL))"""
_SHARE = lambda n: f"least(1, {n} * 1.0 / flows) * 100"
CTE["sev"] = f"""
SELECT *, CAST(round(0.35 * least(1, round(host_impact * 100, 5) / 10) * 100 + 0.30 * least(1, log10(1.0 + flows) / 3) * 100 + 0.20 * unreplied_ratio * 100
  + 0.15 * greatest({_SHARE('infra_max_flows')}, {_SHARE('local_scan_hits')}, {_SHARE('metadata_flows')}, CASE WHEN bgp_flows > 0 OR geneve_flows > 0 THEN 100 ELSE 0 END,
                    CASE WHEN {_IN} THEN {_SHARE('admin_flows')} ELSE 0 END)) AS BIGINT) AS severity_score,
  0.55 * greatest(remote_share, port_share) * 100 + 0.20 * greatest(new_remotes * 1.0 / unique_remotes, coalesce(new_ports * 1.0 / nullif(unique_ports, 0), 0)) * 100
  + 0.25 * least(1, hits / 3.0) * 100 AS conf0 FROM pers"""
CTE["conf"] = """
SELECT *, CAST(round(least(100, greatest(CASE WHEN mode = 'distributed' AND greatest(remote_share, port_share) * 100 < 40 THEN conf0 * 0.85 ELSE conf0 END,
  CASE WHEN kind IN ('restricted_network_probe', 'lateral_probe_suspected') AND (infra_hits > 0 OR local_scan_hits > 0) THEN 70
       WHEN kind IN ('bgp_peering_attempt', 'geneve_underlay_attempt') THEN 80 WHEN kind IN ('metadata_probe_suspected', 'metadata_service_hammering') THEN 75 ELSE 0 END)
  + CASE WHEN synergy_scan THEN 15 ELSE 0 END + CASE WHEN synergy_physics THEN 25 ELSE 0 END)) AS BIGINT) AS confidence_score FROM sev"""
CTE["prio"] = """
SELECT *, CASE WHEN severity_score >= 85 THEN 'critical' WHEN severity_score >= 65 THEN 'high' WHEN severity_score >= 35 THEN 'medium' ELSE 'low' END AS severity_band,
  CASE WHEN severity_score >= 75 AND confidence_score >= 75 THEN 'P1' WHEN (severity_score >= 75 AND confidence_score >= 50) OR (severity_score >= 50 AND confidence_score >= 75) THEN 'P2'
       WHEN (severity_score >= 50 AND confidence_score >= 50) OR (severity_score >= 75 AND confidence_score >= 25) OR (severity_score >= 25 AND confidence_score >= 75) THEN 'P3'
       ELSE 'P4' END AS priority,
  CASE WHEN severity_score >= 75 AND confidence_score < 50 THEN 'severity' WHEN confidence_score >= 75 AND severity_score < 50 THEN 'confidence' ELSE 'mixed' END AS priority_basis FROM conf"""
CTE["threat_ips"] = a.THREAT_IPS
CTE["threat_cidrs"] = a.THREAT_CIDRS
CTE["tsides"] = """
SELECT *, CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN src_ip ELSE dst_ip END AS a_ip, CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN src_port ELSE dst_port END AS a_port,
       CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN dst_ip ELSE src_ip END AS b_ip, CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN dst_port ELSE src_port END AS b_port
FROM (SELECT *, 'src' AS side, src_ip AS ip FROM attr UNION ALL SELECT *, 'dst', dst_ip FROM attr) WHERE src_inst IS NOT NULL OR dst_inst IS NOT NULL"""
CTE["thits"] = """
SELECT t.*, l.list FROM tsides t JOIN (SELECT DISTINCT list, ip FROM threat_ips) l ON l.ip = t.ip
UNION ALL SELECT DISTINCT t.*, c.list FROM tsides t JOIN threat_cidrs c ON t.ip BETWEEN c.network AND c.network + CAST(power(2, 32 - c.prefix_len) AS BIGINT) - 1"""
CTE["routed"] = """
SELECT DISTINCT host_id, ts, list, instance, a_ip, a_port, b_ip, b_port, proto FROM (
SELECT *, src_inst AS instance FROM thits WHERE (list = 'relays' AND side = 'dst') OR list = 'custom'
UNION ALL SELECT *, dst_inst FROM thits WHERE (list = 'drop' AND side = 'src') OR list = 'custom') WHERE instance IS NOT NULL"""
CTE["tsig"] = """
SELECT *, row_number() OVER (PARTITION BY host_id, instance ORDER BY ts) AS no FROM (
SELECT host_id, ts, instance, 1 - exp(sum(ln(greatest(1 - least(1, active / 10.0), 1e-300)))) AS instant FROM (
SELECT host_id, ts, list, instance, least(count(*), 5000) AS active FROM routed GROUP BY host_id, ts, list, instance) GROUP BY host_id, ts, instance)"""
CTE["intel"] = """
SELECT host_id, instance, ts, no, instant, instant AS e FROM tsig WHERE no = 1
UNION ALL SELECT o.host_id, o.instance, o.ts, o.no, o.instant, i.e + 0.1 * (o.instant - i.e) FROM intel i JOIN tsig o ON o.host_id = i.host_id AND o.instance = i.instance AND o.no = i.no + 1"""
CTE["counters"] = a.COUNTERS
_LAG = "OVER (PARTITION BY host_id, instance ORDER BY ts, event_id)"
CTE["lagged"] = f"""
SELECT *, coalesce(epoch(ts) - epoch(lag(ts) {_LAG}), 0) AS dt, greatest(coalesce(counter - lag(counter) {_LAG}, 0), 0) AS inc,
       CASE WHEN lag(counter) {_LAG} IS NULL THEN 0 WHEN counter < lag(counter) {_LAG} THEN counter ELSE counter - lag(counter) {_LAG} END AS step2,
       CAST(floor(epoch(ts)) AS BIGINT) AS t FROM counters"""



def with_tables(sql: str) -> str:
    """The statement with the CTEs that it names, directly or not."""
    import re

    found: list[str] = []

    def need(text: str) -> None:
        for name in CTE:
            if re.search(rf"\b(?:FROM|JOIN) {name}\b", text) and name not in found:
                found.append(name)
                need(CTE[name])

    need(sql)
    order = [n for n in CTE if n in found]
    return _text(order, CTE, sql)


def coming_and_going(sql: str) -> str:
    """The same statement over machines that are away in every fifth cycle: an island of presence is an identity of its own, named in the instance."""
    n = f"((ts - {a.START}) // 15 + CAST(substr(instance, 3) AS BIGINT))"
    whole = with_tables(sql)
    here = f"SELECT * REPLACE (instance || '#' || CAST({n} // {a.AWAY_EVERY} AS VARCHAR) AS instance) FROM ({CTE['ev']}) WHERE {n} % {a.AWAY_EVERY} <> 0"
    return whole.replace(CTE["ev"], here).replace("o.instance = s.instance", "o.instance = split_part(s.instance, '#', 1)")


def _text(order: list[str], CTE: dict[str, str], sql: str) -> str:
    return ("WITH RECURSIVE " + ", ".join(f"{n} AS ({CTE[n]})" for n in order) + " " if order else "") + sql
