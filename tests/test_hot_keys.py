"""Every keyed job gives the same rows when its keys count as very large."""

import pytest
from pyspark.sql import functions as F

from wardline.catalog.cohort import BALANCED
from wardline.functions.scores import SOFA_COMPONENTS
from wardline.operators import asof, episodes, governance, latest, timeline
from wardline.operators.latest import Shape
from wardline.plans import cohort, snapshots, study
from wardline.rules import load_bundle
from wardline.sources import projection as P

PLAIN, HOT = Shape(False, False), Shape(True, False)


def same(a, b, columns=None):
    columns = columns or a.columns
    a, b = a.select(*columns), b.select(*columns)
    assert a.exceptAll(b).count() == 0
    assert b.exceptAll(a).count() == 0
    assert a.count() > 0


@pytest.fixture(scope="module")
def env(spark, sf):
    return P.envelopes(spark, sf)


def test_snapshots(env):
    cols = ["patient_id", "event_us", "idempotency_key", "scope", "encounter_now", "platelets", "gcs", "fio2", "map_mmhg"]
    same(snapshots.snapshots(env, PLAIN), snapshots.snapshots(env, HOT), cols)


def test_arrival_rules(env):
    slim = env.drop("resource")
    same(snapshots.arrived(slim, PLAIN)[0], snapshots.arrived(slim, HOT)[0], ["event_id", "ingest_us", "late"])


def test_long_spans_use_the_time_to_live(spark):
    hour = 3_600_000_000
    data = [("p", "a", h * hour, i) for i, h in enumerate((0, 1, 23, 24, 25, 47, 49))] + [("p", " ", 0, 90), ("p", " ", 1, 91)]
    df = spark.createDataFrame(data, "patient_id string, idempotency_key string, ingest_us long, event_id long")
    shape = latest.shape_of(df)
    assert shape.long_spans
    kept = sorted(r["event_id"] for r in latest.deduplicate(df, shape).collect())
    assert kept == [0, 3, 6, 90, 91]  # 24 h after the kept one counts as new; blank keys always do


def test_governance(env):
    g = load_bundle("sepsis-sofa", "0.2.0").governance
    rows = snapshots.alerts(env, shape=PLAIN)
    keep = ["patient_id", "idempotency_key"]
    same(governance.govern(rows, g, components=SOFA_COMPONENTS, keep=keep, hot=False),
         governance.govern(rows, g, components=SOFA_COMPONENTS, keep=keep, hot=True), [*keep, "reason", "routing", "crossings"])


def test_streaks(env):
    g = load_bundle("sepsis-sofa").governance
    rows = snapshots.alerts(env, shape=PLAIN).drop("scope", "encounter_now")
    a = latest.encounter_scope(rows, null_opens=True)
    same(a, latest.encounter_scope(rows, null_opens=True, hot=True), ["idempotency_key", "scope", "encounter_now"])
    cols = ["idempotency_key", "crossings", "first_us", "first_score"]
    same(governance.streaks(a, g), governance.streaks(a, g, hot=True), cols)


def test_episodes(spark, sf):
    from wardline.catalog.episodes import signals

    s = signals(spark, sf, PLAIN)
    same(episodes.arbitrate(s, hot=False), episodes.arbitrate(s, hot=True))
    same(episodes.arbitrate(s, hot=False), episodes.arbitrate(s, hot=False, in_order=False))


def test_kidney_timeline(spark, sf):
    rows = timeline.corrected(P.kidney_rows(spark, sf))
    cols = ["patient_id", "evidence_id", "status", "stage", "creatinine_stage", "urine_stage", "baseline_7d", "reference_48h", "criteria", "missing"]
    rates = [F.round(f"rate_{h}", 8).alias(f"r{h}") for h in (6, 12, 24)]
    plain, hot = timeline.evaluate(rows, hot=False), timeline.evaluate(rows, hot=True)
    same(plain.select(*cols, *rates), hot.select(*cols, *rates))


def test_kidney_timeline_with_equal_instants(spark):
    day = 24 * timeline.HOUR_US
    rows = [("p", i // 2 * day, f"Observation/{i}", "creatinine", v, None, None, None, None, None) for i, v in enumerate((1.0, 1.2, 2.4, 1.2, 3.1, 0.9, 1.0))]
    rows += [("p", 2 * day, "u1", "urine", None, 100.0, 24.0, None, False, None), ("p", 2 * day, "w1", "weight", None, None, None, None, None, 80.0),
             ("p", 2 * day, "u2", "urine", None, None, 13.0, None, True, None)]
    df = spark.createDataFrame(rows, "patient_id string, event_us long, evidence_id string, kind string, creatinine double, volume_ml double, duration_h double, "
                                     "ml_kg_h double, anuria boolean, weight_kg double")
    cols = ["evidence_id", "status", "stage", "creatinine_stage", "urine_stage", "baseline_7d", "reference_48h", "anuria_h", "criteria", "missing"]
    plain, hot = timeline.evaluate(df, hot=False), timeline.evaluate(df, hot=True)
    same(plain, hot, cols)
    assert len({tuple(r) for r in hot.where("kind = 'creatinine'").select("event_us", "stage", "baseline_7d").collect()}) == 4


def test_cohort(spark, sf):
    hours = P.hourly_stays(spark, sf)
    same(cohort.evaluate_hours(hours, BALANCED, hot=False), cohort.evaluate_hours(hours, BALANCED, hot=True))


def test_study(spark, sf):
    from wardline.catalog.study import timeline_rows

    t, _ = timeline_rows(spark, sf)
    cols = ["stay_id", "position", "score", "tier", "evidence_ids", "clock_us"]
    same(study.replayed(t, hot=False), study.replayed(t, hot=True), cols)


def test_asof(spark, sf):
    r = P.readings(spark, sf)
    left = P.medications(spark, sf).select("event_id", "patient_id", "start_us")
    right = r.where("code = '8478-0'").selectExpr("patient_id", "event_us AS at", "reading", "event_id AS t")
    args = (["patient_id"], "start_us", "at", ["reading", "at"])
    same(asof.asof_join(left, right, *args, tie="t", hot=False), asof.asof_join(left, right, *args, tie="t", hot=True))
    same(asof.asof_join(left, right, *args, forward=True, hot=False), asof.asof_join(left, right, *args, forward=True, hot=True))
    twice = right.union(right.selectExpr("patient_id", "at", "reading + 1 AS reading", "t + 100000000 AS t"))
    for forward in (False, True):
        same(asof.asof_join(left, twice, *args, tie="t", forward=forward, hot=False), asof.asof_join(left, twice, *args, tie="t", forward=forward, hot=True))


def test_threshold_switches_layout(env, monkeypatch):
    monkeypatch.setattr("wardline.operators.folds.HOT_ROWS", 10)
    assert latest.shape_of(env).hot
