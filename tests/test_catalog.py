"""Registered queries against the equivalent SQL. WARDLINE_ALL=1 runs every one of them."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from wardline.catalog import load_all  # noqa: E402
from tests.conftest import SF  # noqa: E402
from tools.check import TABLES, rows_of  # noqa: E402

ORACLE = entry.oracle_sql()
SOME = ("governed_alerts_strict", "crossing_streaks", "episodes", "aki_timeline", "sepsis_phenotype", "respiratory_score", "observation_mapping",
        "fact_admission", "bundle_envelopes", "icu_snapshot_scores", "cohort_metrics", "bootstrap_intervals", "leakage_check", "store_metrics",
        "feedback_categories", "draft_gate", "stream_governed_alerts")
NAMES = sorted(set(ORACLE) & set(load_all())) if os.environ.get("WARDLINE_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() == 15


def test_every_query_has_sql_and_ids():
    assert set(load_all()) <= set(entry.queries())
    assert set(load_all()) <= set(ORACLE)
    assert all(q.ids for q in load_all().values())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, got) == rows_of(names, want)
