"""Governance decisions, streaks and late marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalog.base import SCORED, alert_source, governance_sql, joined, query
from wardline.functions.scores import SOFA_COMPONENTS
from wardline.operators import governance as G
from wardline.operators import latest
from wardline.plans import snapshots as snap
from wardline.rules import Governance, load_bundle
from wardline.sources import projection as P

ACTIVE = load_bundle("sepsis-sofa").governance
STRICT = load_bundle("sepsis-sofa", "0.2.0").governance
# Strict settings with every component-change gate and the quality gate switched on.
FULL = STRICT.patched(
    baseline_lookback_hours=1, trajectory_persistence_minutes=10, refractory_minutes=45,
    baseline_delta_threshold=1, page_gate_enabled=True, page_trajectory_persistence_minutes=15,
    page_min_positive_components=2, page_min_newly_worsened_components=1, page_min_component_delta=2,
    page_high_actionability_components=("cardiovascular", "coagulation", "renal"))
KEYED = ["patient_id", "event_us", "idempotency_key"]


def governed(spark: SparkSession, sf: str, g: Governance, shape: latest.Shape | None = None) -> DataFrame:
    env = P.envelopes(spark, sf)
    shape = shape or latest.shape_of(env)
    points = [f"p_{c}" for c in SOFA_COMPONENTS]
    rows = snap.alerts(env, shape=shape).select(
        *KEYED, "encounter_id", "score", "tier", "context_flags", "positive_components", *points, "alert_id",
        "ingest_us", "completeness", "indicator", "rule_bundle_id", "rule_version")
    return G.govern(rows, g, components=SOFA_COMPONENTS, hot=shape.hot)


def _decisions_sql(g: Governance, columns: str, where: str = "rn > 0") -> str:
    return (f"WITH RECURSIVE {SCORED}, {alert_source(g)}, {governance_sql('src', g, SOFA_COMPONENTS)} "
            f"SELECT {columns} FROM gov WHERE {where}")


DECISION_SQL = "pk AS patient_id, event_us, emit, reason, routing, crossings"


@query("governed_alerts", "GOV-1 GOV-2 GOV-3 GOV-4 GOV-5 GOV-7 GOV-8 GOV-10 GOV-11 GOV-14 STR-10",
       _decisions_sql(ACTIVE, DECISION_SQL))
def governed_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Decision for every alert under the active bundle."""
    return governed(spark, sf, ACTIVE).select("patient_id", "event_us", "emit", "reason", "routing", "crossings")


@query("governed_alerts_strict", "GOV-6 GOV-8 GOV-9 GOV-10 WIN-8", _decisions_sql(STRICT, DECISION_SQL))
def governed_strict(spark: SparkSession, sf: str) -> DataFrame:
    """Decision for every alert with baseline and persistence gates."""
    return governed(spark, sf, STRICT).select("patient_id", "event_us", "emit", "reason", "routing", "crossings")


@query("governed_alerts_component_gates", "GOV-11 GOV-13 AGG-25 SET-2", _decisions_sql(
    FULL, DECISION_SQL + ", worsened, biggest AS max_delta"))
def governed_full(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions with page gates on newly worsened components against the last emitted vector."""
    return governed(spark, sf, FULL).select(
        "patient_id", "event_us", "emit", "reason", "routing", "crossings",
        joined("newly_worsened").alias("worsened"), F.col("max_component_delta").alias("max_delta"))


@query("alert_reduction", "AGG-1 JOB-1", _decisions_sql(
    ACTIVE, "count(*) FILTER (tier <> 'none') AS naive, count(*) FILTER (emit) AS governed, "
    "count(*) FILTER (routing = 'interruptive') AS interruptive, "
    "CASE WHEN count(*) FILTER (tier <> 'none') = 0 THEN 0 ELSE round(count(*) FILTER (emit) / "
    "count(*) FILTER (tier <> 'none'), 9) END AS reduction"))
def alert_reduction(spark: SparkSession, sf: str) -> DataFrame:
    """Naive against governed alerts of the whole replay."""
    out = governed(spark, sf, ACTIVE).agg(
        F.count_if(F.col("tier") != "none").alias("naive"), F.count_if("emit").alias("governed"),
        F.count_if(F.col("routing") == "interruptive").alias("interruptive"))
    return out.withColumn("reduction", F.round(G.reduction_ratio(F.col("naive"), F.col("governed")), 9))


@query("arrival_order_governance", "GOV-1 WIN-6", f"""WITH RECURSIVE {SCORED},
{alert_source(ACTIVE, order='ingest_us, event_id')}, {governance_sql('src', ACTIVE, SOFA_COMPONENTS)}
SELECT pk AS patient_id, reason, count(*) AS n FROM gov WHERE rn > 0 GROUP BY ALL""")
def arrival_order(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts replayed in arrival order: out-of-order ones are refused without touching the state."""
    env = P.envelopes(spark, sf)
    shape = latest.shape_of(env)
    rows = snap.alerts(env, shape=shape)
    out = G.govern(rows, ACTIVE, order=("ingest_us", "event_id"), components=SOFA_COMPONENTS,
                   keep=["patient_id"], hot=shape.hot)
    return out.groupBy("patient_id", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("late_marks", "WIN-6 STR-6", f"""WITH {SCORED}
SELECT patient_id, count(*) AS n, count(*) FILTER (late) AS n_late, count(*) FILTER (ooo) AS n_out_of_order
FROM (SELECT *, coalesce(event_us < max(event_us) OVER (PARTITION BY patient_id ORDER BY ingest_us, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ooo FROM arr) GROUP BY patient_id""")
def late_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Late (beyond five minutes) and merely out-of-order arrivals per patient."""
    rows, shape = snap.arrived(P.envelopes(spark, sf).drop("resource"))
    rows = latest.mark_out_of_order(rows, "ooo", shape.hot)
    return rows.groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("late").alias("n_late"),
        F.count_if("ooo").alias("n_out_of_order"))


_STREAK_SQL = _decisions_sql(
    ACTIVE, "pk AS patient_id, event_us, crossings, first_us, first_score",
    "rn > 0 AND reason NOT IN ('below_threshold', 'late_out_of_order') AND reason NOT LIKE 'context:%'")


@query("crossing_streaks", "WIN-7 GOV-7", _STREAK_SQL)
def crossing_streaks(spark: SparkSession, sf: str) -> DataFrame:
    """Threshold-crossing streaks by windows: size, first time, first score."""
    from pyspark.sql import Window

    env = P.envelopes(spark, sf)
    shape = latest.shape_of(env)
    rows = snap.alerts(env, shape=shape)
    scoped = latest.encounter_scope(rows.drop("scope", "encounter_now"), null_opens=True, hot=shape.hot)
    w = Window.partitionBy("patient_id", "scope").orderBy("event_us", "idempotency_key").rowsBetween(
        Window.unboundedPreceding, 0)
    flag = F.min(G.suppressing_flag(ACTIVE, rows.columns)).over(w)
    shown = scoped.withColumn("_flag", flag).where(
        F.col("_flag").isNull() | (F.col("tier") == "none") | F.col("score").isNull())
    return G.streaks(shown, ACTIVE, hot=shape.hot).select("patient_id", "event_us", "crossings", "first_us", "first_score")


QUALITY = ACTIVE.patched(
    page_gate_enabled=False, quality_gate_enabled=True, quality_max_data_age_minutes=10, quality_require_critical_inputs=True,
    quality_require_trusted_source=True, quality_reject_ood=True)
_QUALITY_SQL = """CASE WHEN event_id % 13 > 10 THEN 'quality_stale' WHEN event_id % 7 = 0 THEN 'quality_invalid' WHEN event_id % 11 = 0 THEN 'quality_contradictory'
  WHEN event_id % 5 = 0 THEN 'quality_missing_critical' WHEN event_id % 17 = 2 THEN 'quality_untrusted_source' WHEN event_id % 19 = 0 THEN 'quality_ood' END"""


@query("governed_alerts_quality_gate", "GOV-12", f"WITH RECURSIVE {SCORED}, {alert_source(QUALITY).replace('NULL::VARCHAR AS quality', _QUALITY_SQL + ' AS quality')}, "
       f"{governance_sql('src', QUALITY, SOFA_COMPONENTS)} SELECT {DECISION_SQL} FROM gov WHERE rn > 0")
def governed_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Pages deferred because the data behind them is stale, invalid, contradictory, incomplete, untrusted or odd."""
    env = P.envelopes(spark, sf)
    shape = latest.shape_of(env)
    rows = snap.alerts(env, shape=shape).selectExpr(
        "*", "event_id % 13 AS data_age_minutes", "event_id % 7 = 0 AS invalid_observation", "event_id % 11 = 0 AS contradictory_observations",
        "if(event_id % 5 = 0, array('map'), cast(array() AS array<string>)) AS missing_critical_inputs",
        "if(event_id % 17 = 2, 'External', 'trusted') AS source_trust", "event_id % 19 = 0 AS out_of_distribution")
    return G.govern(rows, QUALITY, components=SOFA_COMPONENTS, keep=["patient_id"] + ["event_us"], hot=shape.hot).select(
        "patient_id", "event_us", "emit", "reason", "routing", "crossings")
