"""Governance under rules that change: several bundles, updates that come to hold, are refused, or withdraw a bundle."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalog.base import ARRIVED, SCORED, governance_sql, query, tier_sql, uuid_sql
from wardline.catalog.streams import deliver
from wardline.functions.scores import SOFA_COMPONENTS
from wardline.operators import latest
from wardline.operators import rule_history as RH
from wardline.plans import snapshots as snap
from wardline.rules import Governance
from wardline.session import new_path
from wardline.sources import projection as P
from wardline.streaming import jobs as J

_H = 3_600_000_000
_GATED = dict(trajectory_persistence_minutes=0, min_crossings=1, baseline_enabled=False, refractory_minutes=90, page_gate_enabled=True, page_min_positive_components=2)
#: Updates by delivery: (bundle, version, hours after the first moment, withdrawn, threshold, knobs). The version 0.2.9 comes after a higher one and does not count.
DELIVERIES = (
    (("sepsis-sofa", "0.2.0", 0, False, 2, {}), ("icu-sofa", "0.3.0", 0, False, 2, _GATED)),
    (("sepsis-sofa", "0.10.0", 20, False, 2, _GATED), ("sepsis-sofa", "0.2.9", 26, False, 2, {"refractory_minutes": 1}), ("icu-sofa", "0.3.1", 22, True, 2, {}),
     ("icu-sofa", "0.4.0", 30, False, 4, {"min_crossings": 1, "trajectory_persistence_minutes": 0, "refractory_minutes": 15, "suppression_flags": ["already_on_sepsis_protocol"]})),
)
_REFUSED = ("{not json", json.dumps({"bundle_id": "sepsis-sofa", "version": "9.0.0", "available_time": "2024-01-01T00:00:00Z", "governance": {"no_such_knob": 1}}),
            json.dumps({"bundle_id": "sepsis-sofa", "version": "9.x", "available_time": "2024-01-01T00:00:00Z"}))


def update_lines(delivery: tuple) -> list[str]:
    return [json.dumps({"bundle_id": b, "version": v, "available_time": f"2024-01-{1 + h // 24:02d}T{h % 24:02d}:00:00Z", "withdrawn": w, "naive_threshold": n, "governance": knobs})
            for b, v, h, w, n, knobs in delivery] + list(_REFUSED)


def bundle_of() -> Column:
    """Each alert's bundle; one of them has no rules at all."""
    n = F.substring("idempotency_key", 4, 20).cast("long") % 4
    return F.when(n < 2, "sepsis-sofa").when(n == 2, "icu-sofa").otherwise("ward-sofa")


def _knob(value) -> str:
    if isinstance(value, tuple):
        return "[" + ", ".join(f"'{v}'" for v in value) + "]::VARCHAR[]"
    return str(value).lower() if isinstance(value, bool) else str(value)


def _updates_sql(deliveries: tuple) -> str:
    rows = []
    for b, v, h, w, n, knobs in (u for d in deliveries for u in d):
        settings = RH.governance_of(json.dumps({} if w else knobs))
        rows.append(f"('{b}', '{v}', {P.T0_US + h * _H}, {str(w).lower()}, {n}, " + ", ".join(_knob(getattr(settings, f.name)) for f in fields(Governance)) + ")")
    none = ", ".join(f"{_knob(getattr(Governance(), f.name))} AS d_{f.name}" for f in fields(Governance))
    return f"""upd(bundle, version, from_us, withdrawn, threshold, {', '.join('k_' + f.name for f in fields(Governance))}) AS (VALUES {', '.join(rows)}),
dflt AS (SELECT {none}),
u1 AS (SELECT *, split_part(version, '.', 1)::INT * 1000000 + split_part(version, '.', 2)::INT * 1000 + split_part(version, '.', 3)::INT AS v FROM upd),
u2 AS (SELECT *, max(v) OVER (PARTITION BY bundle ORDER BY from_us, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM u1),
u3 AS (SELECT *, lead(from_us) OVER w AS until_us, sum(withdrawn::INT) OVER w AS ended FROM u2 WHERE highest IS NULL OR v >= highest WINDOW w AS (PARTITION BY bundle ORDER BY from_us, v))"""


def ruled_sql(alerts: str, deliveries: tuple, components: tuple[str, ...], columns: str) -> str:
    """Governance of the CTE ``al`` that ``alerts`` ends with, each alert under the update of its bundle that holds at its time."""
    knobs = ", ".join(f"coalesce(u.k_{f.name}, d_{f.name}) AS k_{f.name}" for f in fields(Governance))
    return f"""WITH RECURSIVE {alerts}, {_updates_sql(deliveries)},
rl AS (SELECT a.*, CASE WHEN NOT u.withdrawn THEN u.version END AS rule_version, coalesce(CASE WHEN NOT u.withdrawn THEN u.threshold END, 2) AS threshold, coalesce(u.ended, 0) AS ended, {knobs}
  FROM al a LEFT JOIN u3 u ON u.bundle = a.bundle_id AND a.event_us >= u.from_us AND (u.until_us IS NULL OR a.event_us < u.until_us), dflt),
src AS (SELECT *, patient_id || '|' || bundle_id || '|' || ended AS pk, row_number() OVER (PARTITION BY patient_id, bundle_id, ended ORDER BY event_us, idempotency_key) AS rn,
  encounter_now AS enc, CASE WHEN list_contains(k_suppression_flags, context_flag) THEN context_flag END AS flag, positive_components AS positive, NULL::VARCHAR AS quality
  FROM (SELECT * REPLACE (CASE WHEN score < threshold THEN 'none' ELSE tier END AS tier) FROM rl)),
{governance_sql('src', None, components)}
SELECT s.patient_id, s.event_us, {columns} FROM gov g JOIN src s ON s.pk = g.pk AND s.rn = g.rn"""


RULED_SQL = ruled_sql(f"""{SCORED},
al AS (SELECT *, CASE WHEN event_id % 4 < 2 THEN 'sepsis-sofa' WHEN event_id % 4 = 2 THEN 'icu-sofa' ELSE 'ward-sofa' END AS bundle_id FROM scored WHERE completeness <> 'insufficient_data')""",
                      DELIVERIES, SOFA_COMPONENTS, "s.bundle_id AS rule_bundle_id, s.rule_version, s.tier, g.emit, g.reason, g.routing, g.crossings")


@query("ruled_alerts", "SRC-3 STR-9 JOI-1 STR-10 GOV-14", RULED_SQL)
def ruled_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts of three bundles, each governed by the update of its bundle that holds at its time."""
    env = P.envelopes(spark, sf)
    shape = latest.shape_of(env)
    alerts = snap.alerts(env, shape=shape).withColumn("rule_bundle_id", bundle_of())
    updates = RH.rule_updates(spark.createDataFrame([(x,) for d in DELIVERIES for x in update_lines(d)], "value string"))
    out = RH.govern_by_rules(alerts, updates, SOFA_COMPONENTS, keep=["patient_id", "event_us", "rule_bundle_id"], hot=shape.hot)
    return out.select("patient_id", "event_us", "rule_bundle_id", "rule_version", F.col("ruled_tier").alias("tier"), "emit", "reason", "routing", "crossings")


def ruled_pipeline(spark: SparkSession, sf: str, before: Callable, govern: Callable, deliveries: tuple, env: DataFrame | None = None) -> J.Pipeline:
    """Deliveries of records and of rules with a restart in between: each is read by ``before`` and governed by ``govern``."""
    work = new_path(spark, "ruled")
    pipeline, at = J.Pipeline(spark, f"{work}/incoming", work), iter(deliveries)

    def rules(p: J.Pipeline) -> None:
        spark.createDataFrame([(x,) for x in update_lines(next(at))], "value string").coalesce(1).write.mode("append").text(p.at("rules"))
        govern(p)

    deliver(spark, sf, pipeline, [before, rules], halves=len(deliveries), env=env)
    return pipeline


@query("stream_ruled_alerts", "SRC-3 STR-9 JOI-1 STR-10", RULED_SQL)
def stream_ruled_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """The same on streams: the rules change between two micro-batches, and the job restarts in between."""
    pipeline = ruled_pipeline(spark, sf, J.Pipeline.records_to_snapshots, lambda p: p.snapshots_to_ruled_alerts(bundle_of()), DELIVERIES)
    return pipeline.read("ruled").select("patient_id", "event_us", "rule_bundle_id", "rule_version", "tier", "emit", "reason", "routing", "crossings")


_KIDNEY = dict(baseline_lookback_hours=48, refractory_minutes=180, suppression_flags=["already_on_aki_protocol", "comfort_care", "esrd_on_dialysis"])
#: The gate comes with the second delivery.
KIDNEY_DELIVERIES = ((("aki-kdigo", "0.2.0", 0, False, 2, _KIDNEY | dict(trajectory_persistence_minutes=0, min_crossings=1)),),
                     (("aki-kdigo", "0.4.0", 20, False, 2, _KIDNEY | dict(trajectory_persistence_minutes=0, min_crossings=1, baseline_enabled=False, page_gate_enabled=True, page_min_positive_components=1)),))
_SO_FAR = "OVER (PARTITION BY patient_id, scope ORDER BY event_us, idempotency_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_KIDNEY_ALERTS = ARRIVED.replace("rd AS (", "plain AS (", 1).replace("env AS (", """rd AS (
  SELECT * FROM plain
  UNION ALL SELECT * REPLACE (event_us + 1 AS event_us, 'condition-' || event_id AS idempotency_key, 'N18.6' AS code, 'final' AS status, '' AS unit, NULL AS context_flag) FROM plain WHERE event_id % 61 = 7
  UNION ALL SELECT * REPLACE (event_us + 1 AS event_us, 'procedure-' || event_id AS idempotency_key, '302497006' AS code, 'final' AS status, '' AS unit, NULL AS context_flag) FROM plain WHERE event_id % 37 = 11),
env AS (""", 1) + f""",
k1 AS (SELECT *, last_value(encounter_id IGNORE NULLS) OVER (PARTITION BY patient_id ORDER BY event_us, idempotency_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS eb,
  last_value(encounter_id IGNORE NULLS) OVER (PARTITION BY patient_id ORDER BY event_us, idempotency_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS encounter_now FROM arr WHERE NOT late AND status = 'final'),
k2 AS (SELECT *, sum(CASE WHEN encounter_id <> eb THEN 1 ELSE 0 END) OVER (PARTITION BY patient_id ORDER BY event_us, idempotency_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS scope FROM k1),
k3 AS (SELECT *, code = '2160-0' AND unit <> 'bad' AS cr, bool_or(code = 'N18.6') {_SO_FAR} AS esrd, bool_or(code = '302497006') {_SO_FAR} AS rrt FROM k2),
k4 AS (SELECT *, min(reading) FILTER (cr) OVER (PARTITION BY patient_id, scope ORDER BY event_us, idempotency_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS older FROM k3),
k5 AS (SELECT *, coalesce(older, reading) AS base, least(older, reading) AS low FROM k4 WHERE cr AND (rrt OR NOT esrd)),
k6 AS (SELECT *, CASE WHEN reading >= 4 OR reading / base >= 3 THEN 3 WHEN reading / base >= 2 THEN 2 WHEN reading / base >= 1.5 OR reading - low >= 0.3 THEN 1 ELSE 0 END AS cr_stage FROM k5),
al AS (SELECT *, 'aki-kdigo' AS bundle_id, 2 * CASE WHEN rrt THEN 3 ELSE cr_stage END AS score, (cr_stage > 0)::INT AS positive_components,
  {tier_sql("2 * CASE WHEN rrt THEN 3 ELSE cr_stage END", "2", 4, 6)} AS tier FROM k6)"""
_ALERT_RAW = "s.patient_id || '|' || coalesce(s.encounter_now, '') || '|aki|' || s.score || '|' || (s.event_us // 1000) || '|' || coalesce(s.rule_version, '')"


@query("stream_kidney_alerts", "STR-8 AKI-9 STR-10 PRJ-18", ruled_sql(
    _KIDNEY_ALERTS, KIDNEY_DELIVERIES, (), f"'alert-' || {uuid_sql(_ALERT_RAW)} AS alert_id, s.rule_version, s.score, s.tier, g.emit, g.reason, g.routing"))
def stream_kidney_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Kidney alerts from the records to the decision: observations, conditions and procedures, alert ids, and governance whose rules change on the way."""
    pipeline = ruled_pipeline(spark, sf, J.Pipeline.records_to_kidney, J.Pipeline.kidney_to_ruled_alerts, KIDNEY_DELIVERIES, P.kidney_envelopes(spark, sf))
    return pipeline.read("ruled").select("patient_id", "event_us", "alert_id", "rule_version", "score", "tier", "emit", "reason", "routing")
