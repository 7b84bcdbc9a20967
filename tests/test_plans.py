"""Physical plans: what is read, and how often rows move."""

import re

from wardline.operators import governance, latest
from wardline.plans import snapshots
from wardline.rules import load_bundle
from wardline.sources import projection as P


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"(?<!Reused)Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition|Exchange RoundRobin", plan(df)))


def test_one_exchange_from_records_to_governed_alerts(spark, sf):
    env = P.envelopes(spark, sf)
    shape = latest.Shape(False, False)
    assert exchanges(snapshots.snapshots(env, shape)) == 1
    rows = snapshots.alerts(env, shape=shape)
    keep = ["patient_id", "idempotency_key"]
    assert exchanges(governance.govern(rows, load_bundle("sepsis-sofa").governance, keep=keep, hot=False)) == 1


def test_scan_reads_only_needed_columns(spark, sf):
    from wardline.operators import text

    docs = P.table(spark, sf, "documents")
    scan = plan(text.leak_hits(docs, "text", ["doc_id"]))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in scan
    users = P.readings(spark, sf).where("event_type = 'purchase'").select("user_id")
    assert "EqualTo(event_type,purchase)" in plan(users)


def test_scores_stay_in_generated_code(spark, sf):
    from wardline.catalog import load_all

    df = load_all()["organ_component_points"].run(spark, sf)
    assert "BatchEvalPython" not in plan(df) and "*(1) Project" in plan(df)
