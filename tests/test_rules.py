"""One firing row and one just below for each rule, and the order of the rules."""

import pytest
from pyspark.sql import types as T

from vigil.config import Config, Scaler
from vigil.operators import classifier

BASE = {
    "host_id": "h", "instance": "i", "ip": bytearray(16), "snapshot_ts": None, "direction": "outbound", "flows": 10, "unreplied_ratio": 0.0,
    "unique_remotes": 1, "unique_ports": 1, "new_remotes": 0, "new_ports": 0, "top_port": 443, "bgp_flows": 0, "geneve_flows": 0, "smtp_flows": 0,
    "stratum_flows": 0, "admin_flows": 0, "metadata_flows": 0, "metadata_unreplied_ratio": 0.0, "infra_hits": 0, "infra_max_flows": 0,
    "local_scan_hits": 0, "public_remotes": 0, "dark_flows": 0, "multicast": 0, "icmp": 0, "udp": 0, "bytes_per_flow": 0.0, "packets_per_flow": 0.0,
    "host_impact": 0.0, "threshold_flows": 2000, "accounting": True, "remote_share": 0.5, "port_share": 0.5, "mode": "mixed", "signal": 0.0,
}
KINDS = {bytearray: T.BinaryType(), str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), type(None): T.TimestampType()}
SCHEMA = T.StructType([T.StructField(k, KINDS[type(v)]) for k, v in BASE.items()])
IN = {"direction": "inbound"}
SCAN = {"flows": 20, "unreplied_ratio": 0.6}
HOST = {"host_impact": 0.2, "flows": 201}

# what fires, what stays just below, the kind
CASES = [
    ({"bgp_flows": 1}, {"bgp_flows": 0}, "bgp_peering_attempt"),
    ({"geneve_flows": 1}, {"geneve_flows": 0}, "geneve_underlay_attempt"),
    ({"metadata_flows": 100}, {"metadata_flows": 99}, "metadata_service_hammering"),
    ({"metadata_flows": 30, "metadata_unreplied_ratio": 0.6}, {"metadata_flows": 30, "metadata_unreplied_ratio": 0.59}, "metadata_probe_suspected"),
    ({"local_scan_hits": 1}, {"local_scan_hits": 1, **IN}, "restricted_network_probe"),
    ({"infra_hits": 1, "unreplied_ratio": 0.8, "infra_max_flows": 3}, {"infra_hits": 0, "unreplied_ratio": 0.8, "infra_max_flows": 3}, "lateral_probe_suspected"),
    ({"infra_hits": 1}, {"infra_hits": 0}, "restricted_network_probe"),
    ({"dark_flows": 20, "unreplied_ratio": 0.8}, {"dark_flows": 19, "unreplied_ratio": 0.8}, "darkspace_port_detected"),
    ({"dark_flows": 50, **IN}, {"dark_flows": 49, **IN}, "inbound_darkspace_port_detected"),
    ({"smtp_flows": 50, "top_port": 25, "unique_remotes": 20, "unreplied_ratio": 0.3, "port_share": 0.7},
     {"smtp_flows": 50, "top_port": 25, "unique_remotes": 19, "unreplied_ratio": 0.3, "port_share": 0.7}, "smtp_spam_behavior_suspected"),
    ({"stratum_flows": 2, "top_port": 3333, "unique_remotes": 10}, {"stratum_flows": 2, "top_port": 3333, "unique_remotes": 11}, "outbound_stratum_mining_suspected"),
    ({"top_port": 53, "udp": 11, "bytes_per_flow": 3001.0, "unreplied_ratio": 0.6}, {"top_port": 53, "udp": 10, "bytes_per_flow": 3001.0, "unreplied_ratio": 0.6}, "outbound_dns_tunneling_suspected"),
    ({"udp": 101, "unreplied_ratio": 0.9, "unique_remotes": 50}, {"udp": 100, "unreplied_ratio": 0.9, "unique_remotes": 50}, "outbound_udp_fanout_suspected"),
    ({**SCAN, "mode": "dominant_port", "unique_remotes": 20}, {**SCAN, "mode": "dominant_port", "unique_remotes": 19}, "outbound_horizontal_scan_suspected"),
    ({**SCAN, "mode": "dominant_remote", "unique_ports": 20}, {**SCAN, "mode": "dominant_remote", "unique_ports": 19}, "outbound_vertical_scan_suspected"),
    ({**SCAN, "flows": 200, "mode": "dominant_remote", "remote_share": 0.9}, {**SCAN, "flows": 199, "mode": "dominant_remote", "remote_share": 0.9}, "outbound_single_remote_flood"),
    ({**SCAN, "signal": 0.8, "unique_remotes": 30}, {**SCAN, "flows": 9, "signal": 0.8, "unique_remotes": 30}, "outbound_distributed_fanout_unreplied"),
    ({**SCAN, **IN, "new_remotes": 20, "unique_ports": 4}, {**SCAN, **IN, "new_remotes": 20, "unique_ports": 5}, "inbound_distributed_probe_suspected"),
    ({**SCAN, **IN, "new_remotes": 20, "mode": "dominant_port"}, {**SCAN, **IN, "new_remotes": 19, "mode": "dominant_port"}, "inbound_service_spray_suspected"),
    ({**SCAN, **IN, "mode": "dominant_remote", "unique_ports": 10}, {**SCAN, **IN, "mode": "dominant_remote", "unique_ports": 9}, "inbound_single_remote_multiport_probe_suspected"),
    ({**SCAN, **IN, "flows": 200, "mode": "dominant_remote", "remote_share": 0.9}, {**SCAN, **IN, "flows": 200, "mode": "dominant_remote", "remote_share": 0.89}, "inbound_single_remote_flood"),
    ({**SCAN, **IN, "udp": 100, "unreplied_ratio": 0.9}, {**SCAN, **IN, "udp": 99, "unreplied_ratio": 0.9}, "inbound_udp_flood_suspected"),
    ({**IN, "admin_flows": 5, "public_remotes": 1, "top_port": 22, "new_remotes": 10}, {**IN, "admin_flows": 5, "public_remotes": 0, "top_port": 22, "new_remotes": 10}, "inbound_admin_port_exposure_suspected"),
    ({"flows": 4001}, {"flows": 4000}, "conntrack_flow_limit_exceeded"),
    ({**HOST, "icmp": 51}, {"flows": 201, "icmp": 51}, "host_icmp_flood_suspected"),
    ({**HOST, "multicast": 51}, {"flows": 201, "multicast": 51}, "host_multicast_storm_suspected"),
    ({**HOST, **IN}, {**HOST, **IN, "flows": 200}, "inbound_conntrack_pressure"),
    ({**HOST, "bytes_per_flow": 999.0}, {"flows": 201, "bytes_per_flow": 999.0}, "host_accumulating_stale_flows"),
    ({**HOST, "bytes_per_flow": 100001.0}, {"flows": 201, "bytes_per_flow": 100001.0}, "host_high_throughput_anomaly"),
    ({**HOST, "unreplied_ratio": 0.5}, {"host_impact": 0.1, "flows": 201, "unreplied_ratio": 0.5}, "host_conntrack_pressure"),
    ({"signal": 0.9}, {"signal": 0.9, "flows": 9}, "outbound_behavior_spike_critical_suspected"),
    ({"signal": 0.5, **IN}, {"signal": 0.49, **IN}, "inbound_behavior_spike_low_suspected"),
]


def kinds(spark, rows, config=Config()):
    frame = spark.createDataFrame([tuple((BASE | r).values()) for r in rows], SCHEMA).coalesce(1)
    return [(r["kind"], r["reason"], r["rule_id"]) for r in classifier.classify(frame, config=config).collect()]


def test_rules_fire_and_stay_quiet(spark):
    got = kinds(spark, [row for hit, miss, _ in CASES for row in (hit, miss)])
    for (hit, _, kind), fired, quiet in zip(CASES, got[::2], got[1::2]):
        assert fired[0] == kind, hit
        assert quiet[0] != kind, hit


def test_synergy_and_reasons(spark):
    dark = {"dark_flows": 50}
    got = kinds(spark, [
        {**dark, "stratum_flows": 2, "top_port": 3333}, {**dark, **SCAN, "mode": "dominant_remote", "unique_ports": 20},
        {**dark, "bgp_flows": 1}, {"metadata_flows": 120, "metadata_unreplied_ratio": 0.25},
    ])
    assert got[0] == ("darkspace_plus_physics", "unmonitored_flows_50 | stratum_flows_2_port_3333_remotes_1", "synergy_darkspace_plus_physics")
    assert got[1][0] == "darkspace_plus_scan"
    assert got[2][2] == "restricted_bgp"
    assert got[3][1] == "flows_120_unreplied_0.25"


def test_sensitivity_moves_thresholds(spark):
    assert kinds(spark, [{"metadata_flows": 50}], Config(sensitivity=2.0))[0][0] == "metadata_service_hammering"
    k = Scaler(2.0)
    assert (k.high(5), k.low(5), k.above(1.0), k.below(1.0), k.ratio(0.9), k.anomaly(0.02)) == (3, 10, 0.5, 2.0, 0.7, 0.05)


@pytest.mark.parametrize("s, want", [(0.0, 1.0), (99.0, 10.0), (0.01, 0.1)])
def test_sensitivity_is_clamped(s, want):
    assert Config(sensitivity=s).s == want
