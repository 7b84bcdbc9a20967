"""Kidney timeline queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalog.base import READINGS, governance_sql, joined, query, tier_sql
from wardline.functions import scores
from wardline.operators import governance as G
from wardline.operators import timeline as TL
from wardline.rules import load_bundle
from wardline.sources import projection as P

H = "3600000000::BIGINT"


def _rates() -> str:
    out = []
    for h in (6, 12, 24):
        over = f"((u.event_us - greatest(u.event_us - (u.duration_h * 3600000000)::BIGINT, e.event_us - {h} * {H})) / 3600000000.0::DOUBLE)"
        f = f"FILTER (u.event_us > e.event_us - {h} * {H})"
        out.append(f"coalesce(sum({over}) {f}, 0) AS cov{h}, sum(u.volume_ml * least(1, {over} / u.duration_h)) {f} AS ml{h}")
    return ", ".join(out)


KIDNEY_TAIL = f""",
cr AS (SELECT patient_id, event_us, 'Observation/' || event_id AS evidence_id, reading AS v FROM rd
  WHERE status = 'final' AND code = '2160-0' AND unit <> 'bad'),
uo AS (SELECT patient_id, event_us, 'Observation/' || event_id AS evidence_id, raw_value * 4 AS volume_ml,
    (1 + event_id % 6)::DOUBLE AS duration_h FROM rd WHERE status = 'final' AND event_type IN ('signup', 'view')),
wt AS (SELECT patient_id, min(event_us) AS w_us, arg_min(50 + event_id % 50, event_us)::DOUBLE AS weight_kg FROM rd
  WHERE status = 'final' GROUP BY patient_id),
e0 AS (SELECT patient_id, event_us, evidence_id, 'creatinine' AS kind FROM cr
  UNION ALL SELECT patient_id, event_us, evidence_id, 'urine' FROM uo),
e1 AS (SELECT e.patient_id, e.event_us, e.evidence_id, e.kind, arg_max(c.v, {{'a': c.event_us, 'b': c.evidence_id}}) AS cur,
    arg_max(c.evidence_id, {{'a': c.event_us, 'b': c.evidence_id}}) AS cur_ev,
    min(c.v) FILTER (c.event_us >= e.event_us - 48 * {H}) AS ref48
  FROM e0 e LEFT JOIN cr c ON c.patient_id = e.patient_id AND c.event_us <= e.event_us GROUP BY ALL),
e2 AS (SELECT e.*, min(c.v) FILTER (c.evidence_id <> e.cur_ev) AS others, min(c.v) AS anyone
  FROM e1 e LEFT JOIN cr c ON c.patient_id = e.patient_id AND c.event_us BETWEEN e.event_us - 168 * {H} AND e.event_us
  GROUP BY ALL),
e3 AS (SELECT e.*, coalesce(e.others, e.anyone) AS base, w.weight_kg FROM e2 e
  LEFT JOIN wt w ON w.patient_id = e.patient_id AND w.w_us <= e.event_us),
e4 AS (SELECT e.*, {_rates()}, count(u.event_us) AS n_uo,
    (SELECT count(*) FROM uo x WHERE x.patient_id = e.patient_id AND x.event_us <= e.event_us) AS any_uo
  FROM e3 e LEFT JOIN uo u ON u.patient_id = e.patient_id AND u.event_us > e.event_us - 24 * {H} AND u.event_us <= e.event_us
  GROUP BY ALL),
e5 AS (SELECT *, """ + ", ".join(
    f"CASE WHEN ml{h} IS NOT NULL AND weight_kg > 0 AND cov{h} + 1e-9 >= {h} THEN ml{h} / (weight_kg * cov{h}) END AS rate_{h}"
    for h in (6, 12, 24)) + """ FROM e4),
e6 AS (SELECT *, CASE WHEN rate_24 < 0.3 THEN 3 WHEN rate_12 < 0.5 THEN 2 WHEN rate_6 < 0.5 THEN 1
    WHEN rate_6 IS NOT NULL OR rate_12 IS NOT NULL OR rate_24 IS NOT NULL THEN 0 END AS urine_stage,
    CASE WHEN cur IS NULL THEN NULL WHEN cur >= 4 OR cur / base >= 3 THEN 3 WHEN cur / base >= 2 THEN 2
      WHEN cur / base >= 1.5 OR cur - ref48 >= 0.3 THEN 1 ELSE 0 END AS creatinine_stage FROM e5),
e7 AS (SELECT *, CASE WHEN cur IS NULL AND urine_stage IS NULL THEN NULL
    ELSE greatest(coalesce(creatinine_stage, 0), coalesce(urine_stage, 0)) END AS stage FROM e6),
aki AS (SELECT *, CASE WHEN stage IS NULL THEN 'insufficient_data' ELSE 'scored' END AS status, stage * 2 AS score,
    array_to_string(list_filter([CASE WHEN cur >= 4 THEN 'cr_ge_4_0' END,
      CASE WHEN cur / base >= 3 THEN 'cr_ge_3_0x_baseline' WHEN cur / base >= 2 THEN 'cr_ge_2_0x_baseline'
        WHEN cur / base >= 1.5 THEN 'cr_ge_1_5x_baseline' END,
      CASE WHEN cur - ref48 >= 0.3 THEN 'delta_cr_ge_0_3_within_48h' END,
      CASE WHEN rate_24 < 0.3 THEN 'uo_lt_0_3_for_24h' WHEN rate_12 < 0.5 THEN 'uo_lt_0_5_for_12h'
        WHEN rate_6 < 0.5 THEN 'uo_lt_0_5_for_6h' END], lambda x: x IS NOT NULL), ',') AS criteria,
    array_to_string(list_filter([CASE WHEN stage IS NULL THEN 'creatinine' END,
      CASE WHEN n_uo > 0 AND weight_kg IS NULL THEN 'weight_kg' END,
      CASE WHEN urine_stage IS NULL AND any_uo > 0 THEN 'urine_output' END], lambda x: x IS NOT NULL), ',') AS missing
  FROM e7)"""
KIDNEY = READINGS + KIDNEY_TAIL


def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    return TL.with_score(TL.evaluate(TL.corrected(P.kidney_rows(spark, sf))))


@query("aki_timeline", "AKI-1 AKI-2 AKI-3 AKI-4 AKI-5 AKI-8 AKI-9 SCO-14", f"""WITH {KIDNEY}
SELECT patient_id, event_us, evidence_id, status, stage, creatinine_stage, urine_stage, round(cur, 6) AS current_creatinine,
  round(base, 6) AS baseline_7d, round(ref48, 6) AS reference_48h, weight_kg AS weight_now, score,
  {tier_sql('score', '2', 4, 6)} AS tier, criteria, missing FROM aki""")
def aki_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Kidney stage at every creatinine and urine observation."""
    return evaluated(spark, sf).select(
        "patient_id", "event_us", "evidence_id", "status", "stage", "creatinine_stage", "urine_stage",
        F.round("current_creatinine", 6).alias("current_creatinine"), F.round("baseline_7d", 6).alias("baseline_7d"),
        F.round("reference_48h", 6).alias("reference_48h"), "weight_now", "score", "tier",
        joined("criteria").alias("criteria"), joined("missing").alias("missing"))


@query("aki_urine_rates", "AKI-6 AKI-7", f"""WITH {KIDNEY}
SELECT patient_id, event_us, evidence_id, round(rate_6 + 1e-9, 6) AS rate_6, round(rate_12 + 1e-9, 6) AS rate_12,
  round(rate_24 + 1e-9, 6) AS rate_24, 0.0::DOUBLE AS anuria_h FROM aki""")
def aki_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Mean urine rate over trailing 6, 12 and 24 hours where the window is covered."""
    return evaluated(spark, sf).select(
        "patient_id", "event_us", "evidence_id", *[F.round(F.col(f"rate_{h}") + 1e-9, 6).alias(f"rate_{h}") for h in (6, 12, 24)],
        "anuria_h")


@query("aki_onset", "AKI-10", f"""WITH {KIDNEY}
SELECT patient_id, min(event_us) FILTER (stage >= 1) AS onset_us FROM aki GROUP BY patient_id""")
def aki_onset(spark: SparkSession, sf: str) -> DataFrame:
    """First time with a kidney stage, per patient."""
    return TL.onset(evaluated(spark, sf))


_POINT = READINGS + """,
pt AS (SELECT event_id, CASE WHEN code = '2160-0' THEN reading END AS cr, CASE WHEN k % 5 = 0 THEN NULL ELSE 0.5 + (k % 10) / 5.0::DOUBLE END AS base,
    CASE WHEN k % 3 = 0 THEN (k % 7) / 10.0::DOUBLE END AS rate, CASE WHEN k % 4 <> 0 THEN (k % 30)::DOUBLE END AS hours,
    k % 25 = 0 AS anuria FROM rd),
p0 AS (SELECT *, CASE WHEN cr IS NULL THEN NULL WHEN cr >= 4 THEN 3 WHEN base IS NULL OR base <= 0 THEN 0 WHEN cr / base >= 3 THEN 3
    WHEN cr / base >= 2 THEN 2 WHEN cr / base >= 1.5 OR cr - base >= 0.3 THEN 1 ELSE 0 END AS cr_stage,
    CASE WHEN anuria AND coalesce(hours, 0) >= 12 THEN 3 WHEN rate IS NULL OR hours IS NULL THEN NULL
      WHEN rate < 0.3 AND hours >= 24 THEN 3 WHEN rate < 0.5 AND hours >= 12 THEN 2 WHEN rate < 0.5 AND hours >= 6 THEN 1
      ELSE 0 END AS uo_stage FROM pt),
p1 AS (SELECT *, CASE WHEN cr_stage IS NOT NULL OR uo_stage IS NOT NULL THEN greatest(coalesce(cr_stage, 0), coalesce(uo_stage, 0)) END AS stage FROM p0)"""


@query("aki_point_score", "SCO-12 SCO-13 SCO-14", f"""WITH {_POINT}
SELECT event_id, cr_stage AS creatinine_stage, uo_stage AS urine_stage, stage, stage * 2 AS score,
  CASE WHEN stage IS NULL THEN 'insufficient_data' WHEN (cr IS NOT NULL AND (base IS NULL OR base <= 0)) OR (uo_stage IS NULL AND
    (rate IS NOT NULL OR hours IS NOT NULL OR anuria)) THEN 'partial' ELSE 'complete' END AS completeness,
  {tier_sql('stage * 2', '2', 4, 6)} AS tier FROM p1""")
def aki_point(spark: SparkSession, sf: str) -> DataFrame:
    """Single-point kidney score at every reading, from creatinine where it is one, baseline and urine."""
    r = P.readings(spark, sf).selectExpr(
        "event_id", "CASE WHEN code = '2160-0' THEN reading END AS creatinine", "CASE WHEN k % 5 <> 0 THEN 0.5D + (k % 10) / 5D END AS baseline_creatinine",
        "CASE WHEN k % 3 = 0 THEN (k % 7) / 10D END AS urine_ml_kg_h",
        "CASE WHEN k % 4 <> 0 THEN cast(k % 30 AS double) END AS urine_hours", "k % 25 = 0 AS anuria")
    return scores.aki_point(r).select("event_id", "creatinine_stage", "urine_stage", "stage", "score", "completeness", "tier")


@query("aki_scenario_replay", "JOB-2", f"""WITH {KIDNEY}
SELECT tier, count(*) AS n, count(*) FILTER (completeness = 'partial') AS n_partial FROM (
  SELECT {tier_sql('score', '2', 4, 6)} AS tier, CASE WHEN status <> 'scored' THEN 'insufficient_data'
    WHEN missing <> '' THEN 'partial' ELSE 'complete' END AS completeness FROM aki) GROUP BY tier""")
def aki_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Kidney alerts by tier over the whole history."""
    return evaluated(spark, sf).groupBy("tier").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("completeness") == "partial").alias("n_partial"))


AKI_RULES = load_bundle("aki-kdigo").governance
_FLAGS = ", ".join(f"'{f}'" for f in AKI_RULES.suppression_flags)


@query("kidney_governed_replay", "JOB-2 GOV-14 AGG-1", f"""WITH RECURSIVE {KIDNEY},
ksrc AS (SELECT a.patient_id AS pk, row_number() OVER (PARTITION BY a.patient_id ORDER BY a.event_us, a.evidence_id) AS rn, a.event_us, r.encounter_id AS enc, a.score,
    a.tier, CASE WHEN r.context_flag IN ({_FLAGS}) THEN r.context_flag END AS flag, (coalesce(creatinine_stage, 0) > 0)::INT + (coalesce(urine_stage, 0) > 0)::INT AS positive,
    NULL::VARCHAR AS quality
  FROM (SELECT *, {tier_sql('score', '2', 4, 6)} AS tier FROM aki) a JOIN rd r ON a.evidence_id = 'Observation/' || r.event_id WHERE a.tier <> 'none'),
{governance_sql('ksrc', AKI_RULES)}
SELECT coalesce(pk, 'all') AS scenario, count(*) AS naive, count(*) FILTER (emit) AS governed, count(*) FILTER (routing = 'interruptive') AS interruptive,
  count(*) FILTER (reason LIKE 'context:%') AS suppressed, round(count(*) FILTER (emit) / count(*), 9) AS reduction
FROM gov WHERE rn > 0 GROUP BY ROLLUP (pk)""")
def kidney_governed_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Kidney alerts of every patient's history before and after governance under the active bundle, and of all patients together."""
    said = P.readings(spark, sf).selectExpr(
        "concat('Observation/', event_id) AS evidence_id", "encounter_id", "if(context_flag IS NULL, cast(array() AS array<string>), array(context_flag)) AS context_flags")
    alerts = evaluated(spark, sf).where(F.col("tier") != "none").join(said, "evidence_id").withColumn(
        "positive_components", F.expr("int(coalesce(creatinine_stage, 0) > 0) + int(coalesce(urine_stage, 0) > 0)"))
    decided = G.govern(alerts, AKI_RULES, order=("event_us", "evidence_id"), keep=["patient_id"])
    out = decided.rollup("patient_id").agg(
        F.count(F.lit(1)).alias("naive"), F.count_if("emit").alias("governed"), F.count_if(F.col("routing") == "interruptive").alias("interruptive"),
        F.count_if(F.col("reason").startswith("context:")).alias("suppressed"))
    # An empty history has a row of totals too; it says nothing.
    return out.where("naive > 0").select(F.coalesce("patient_id", F.lit("all")).alias("scenario"), "naive", "governed", "interruptive", "suppressed",
                                         F.round(G.reduction_ratio(F.col("naive"), F.col("governed")), 9).alias("reduction"))
