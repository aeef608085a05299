"""Queries heavy in doubles against their SQL on a larger table, with the places that the queries give."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from vigil.plans import ingest_queries  # noqa: F401
from vigil.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def larger():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cells(df):
    df = df[sorted(df.columns)]
    plain = lambda v: str(list(v)) if isinstance(v, (list, np.ndarray)) else "null" if v is None or v is pd.NA or v != v else repr(float(v) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(plain(v if isinstance(v, (list, np.ndarray)) else getattr(v, "item", lambda: v)()) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", ["sink_alert_events", "agg_flow_ratios", "score_threat_signal", "win_resource_axis_ewma", "sink_resource_events"])
def test_same_rows_to_the_last_place(spark, larger, name):
    got, want = QUERIES[name](spark, SF).toPandas(), larger.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)
