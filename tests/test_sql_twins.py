"""Queries against their SQL on a second engine."""

import math

import pandas as pd
import pytest

from vigil.plans import extended_queries, ingest_queries  # noqa: F401
from vigil.plans.queries import ORACLE, QUERIES

CHOSEN = """scan_flow_snapshot join_flow_zone_attribution join_flow_unique_ip_fallback flow_to_identity_events agg_ip_flows agg_behavior_stats
alert_endpoints load_monitored_ports agg_top_remote agg_top_dst_port agg_port_groups agg_public_infra_local_metadata agg_darkspace agg_flow_ratios win_new_remotes win_new_dst_ports
win_cpu_usage win_disk_io win_threat_contacts_total first_match_rule score_alert_confidence score_behavior_signal score_threat_signal
join_threat_cidr agg_threat_hits join_host_ip_listed q_counter_rate q_counter_increase q_for_duration q_deriv q_count_having agg_project_showback
ingest_inventory_xml ingest_zone_map ingest_domain_stats ingest_threat_ip_list ingest_threat_cidr_list match_external_rules load_external_rules
win_alert_emit_gate win_event_throttle win_resource_cap_streak score_attention sink_alert_events rule_external stream_threat_contacts port_name
stream_snapshots rules_dark rule_flags_loud rule_synergy ingest_inventory_ports ingest_inventory_disks win_threat_intel_ewma agg_unique_remotes_saturated win_new_remotes_saturated agg_threat_hits_capped topk_threat_cap_met sensitivity_scalers
agg_top_remote_merged agg_unique_remotes_sketch sql_function_report stream_late_data stream_closed_snapshots threat_list_versions
sink_threat_events_stream sink_metrics_stream win_flow_ewma_sliced win_presence_state stream_behavior_state stream_ttl_timers""".split()


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, bool) or type(v).__name__ in ("bool", "bool_"):
            return str(bool(v))
        try:
            return repr(round(float(v) + 0.0, 5))
        except (TypeError, ValueError):
            return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
