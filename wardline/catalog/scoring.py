"""Scores: organ dysfunction, kidney, respiratory, haemodynamic, sepsis phenotype."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalog.base import SCORED, alert_id_sql, joined, query
from wardline.plans import snapshots as snap
from wardline.sources import projection as P

CURRENT_SQL = f"""WITH {SCORED}
SELECT patient_id, encounter_now AS encounter_id, event_us, score, completeness, tier, missing,
       {alert_id_sql('sofa-deterioration', '0.3.0')} AS alert_id
FROM scored WHERE completeness <> 'insufficient_data'
QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY event_us DESC, idempotency_key DESC) = 1"""


@query("current_score", "PRJ-18 FLT-1 SCO-9 SCO-10", CURRENT_SQL)
def current_score(spark: SparkSession, sf: str) -> DataFrame:
    """Current organ-dysfunction score, tier and alert id of every patient."""
    rows = snap.alerts(P.envelopes(spark, sf)).select(
        "patient_id", "encounter_id", "event_us", "idempotency_key", "score", "completeness", "tier",
        joined("missing_components").alias("missing"), "alert_id")
    last = F.max_by(F.struct(*rows.columns), F.struct("event_us", "idempotency_key")).alias("r")
    return rows.groupBy("patient_id").agg(last).select("r.*").drop("idempotency_key")


from wardline import ids  # noqa: E402
from wardline.catalog.base import MISSING, POSITIVE, PRESENT, READINGS, TOTAL, tier_sql, uuid_sql  # noqa: E402,F401
from wardline.functions import scores as S  # noqa: E402
from wardline.operators import asof, latest, signals as SG, timeline as TL  # noqa: E402
from wardline.rules import ACTIVE as ACTIVE_VERSIONS, BUNDLES, Indicators, load_bundle  # noqa: E402

# Inputs derived from an event row; the same text is valid in Spark SQL and DuckDB.
ORGAN_INPUTS = {
    "pao2_fio2": "CASE WHEN k % 11 = 0 THEN 50 + raw_value * 2 END",
    "spo2_fio2": "CASE WHEN k % 13 = 0 THEN 100 + raw_value * 3 END",
    "pao2": "CASE WHEN k % 5 = 0 THEN 40 + raw_value END",
    "spo2": "CASE WHEN k % 4 <> 0 THEN 70 + raw_value / 8 END",
    "fio2": "CASE WHEN k % 3 = 0 THEN (21 + k) / 100 WHEN k % 3 = 1 AND k % 7 = 0 THEN 0 / 1 END",
    "ventilated": "CASE WHEN k % 9 = 0 THEN true WHEN k % 9 = 1 THEN false END",
    "platelets": "CASE WHEN k % 6 <> 0 THEN 200 - raw_value END",
    "bilirubin": "CASE WHEN k % 7 <> 0 THEN raw_value / 10 END",
    "map_mmhg": "CASE WHEN k % 3 <> 0 THEN 110 - raw_value END",
    "agent": "CASE k % 12 WHEN 0 THEN 'Dobutamine' WHEN 1 THEN 'dopamine' WHEN 2 THEN 'norepinephrine' "
             "WHEN 3 THEN 'epinephrine' WHEN 4 THEN 'other' WHEN 5 THEN '' END",
    "dose": "CASE WHEN k % 2 = 0 THEN raw_value / 200 WHEN k % 5 = 1 THEN raw_value / 5 END",
    "on_pressor": "CASE WHEN k % 8 = 0 THEN true WHEN k % 8 = 1 THEN false END",
    "gcs": "CASE WHEN k % 5 <> 0 THEN 3 + k % 13 END",
    "creatinine": "CASE WHEN k % 4 = 1 THEN raw_value / 20 END",
    "urine_ml_day": "CASE WHEN k % 3 = 2 THEN raw_value * 10 END",
}
RESP_INPUTS = {
    **{c: ORGAN_INPUTS[c] for c in ("pao2_fio2", "spo2_fio2", "pao2", "spo2", "fio2", "ventilated")},
    "room_air": "CASE WHEN k % 7 = 1 THEN true WHEN k % 7 = 2 THEN false END",
    "respiratory_rate": "CASE WHEN k % 2 = 0 THEN 10 + raw_value / 2 END",
    "oxygen_device": "CASE k % 8 WHEN 0 THEN 'none' WHEN 1 THEN 'nasal_cannula' WHEN 2 THEN ' High_Flow ' "
                     "WHEN 3 THEN 'non_invasive' WHEN 4 THEN 'invasive' WHEN 5 THEN 'tent' WHEN 6 THEN 'face_mask' END",
    "abg_ph": "CASE WHEN k % 10 = 0 THEN 7 + raw_value / 100 END",
    "paco2": "CASE WHEN k % 10 IN (0, 1) THEN 30 + raw_value END",
}
HEMO_INPUTS = {
    "lactate": "CASE WHEN k % 3 <> 0 THEN raw_value / 15 END", "map_mmhg": "CASE WHEN k % 4 <> 0 THEN 100 - raw_value END",
    "on_pressor": ORGAN_INPUTS["on_pressor"],
}


def _inputs(spark: SparkSession, sf: str, inputs: dict[str, str]) -> DataFrame:
    return P.readings(spark, sf).selectExpr("event_id", "patient_id", "encounter_id", "event_us", "context_flag",
                                            *[f"{e} AS {n}" for n, e in inputs.items()])


def _inputs_sql(inputs: dict[str, str], name: str = "inp") -> str:
    return (f"{name} AS (SELECT event_id, patient_id, encounter_id, event_us, context_flag, "
            + ", ".join(f"{e} AS {n}" for n, e in inputs.items()) + " FROM rd)")


_ORGANS = f"""WITH {READINGS}, {_inputs_sql(ORGAN_INPUTS)},
r AS (SELECT *, coalesce(pao2_fio2, spo2_fio2, CASE WHEN fio2 > 0 THEN coalesce(pao2 / fio2, spo2 / fio2) END) AS ratio,
  nullif(lower(agent), '') AS a, coalesce(ventilated, false) AS vent FROM inp),
p AS (SELECT *, CASE WHEN ratio IS NULL THEN NULL WHEN ratio < 100 AND vent THEN 4 WHEN ratio < 200 AND vent THEN 3
    WHEN ratio < 300 THEN 2 WHEN ratio < 400 THEN 1 ELSE 0 END AS p_respiration,
  CASE WHEN platelets < 20 THEN 4 WHEN platelets < 50 THEN 3 WHEN platelets < 100 THEN 2 WHEN platelets < 150 THEN 1
    WHEN platelets >= 150 THEN 0 END AS p_coagulation,
  CASE WHEN bilirubin >= 12 THEN 4 WHEN bilirubin >= 6 THEN 3 WHEN bilirubin >= 2 THEN 2 WHEN bilirubin >= 1.2 THEN 1
    WHEN bilirubin < 1.2 THEN 0 END AS p_liver,
  CASE WHEN a = 'dobutamine' THEN 2 WHEN a = 'dopamine' AND dose IS NOT NULL THEN
      CASE WHEN dose > 15 THEN 4 WHEN dose > 5 THEN 3 ELSE 2 END
    WHEN a IN ('epinephrine','norepinephrine','other') AND dose IS NOT NULL THEN CASE WHEN dose > 0.1 THEN 4 ELSE 3 END
    WHEN coalesce(on_pressor, false) OR a IS NOT NULL THEN 3 WHEN map_mmhg < 70 THEN 1 WHEN map_mmhg >= 70 THEN 0 END
    AS p_cardiovascular,
  CASE WHEN gcs < 6 THEN 4 WHEN gcs <= 9 THEN 3 WHEN gcs <= 12 THEN 2 WHEN gcs <= 14 THEN 1 WHEN gcs = 15 THEN 0 END AS p_cns,
  greatest(CASE WHEN creatinine >= 5 THEN 4 WHEN creatinine >= 3.5 THEN 3 WHEN creatinine >= 2 THEN 2
      WHEN creatinine >= 1.2 THEN 1 WHEN creatinine < 1.2 THEN 0 END,
    CASE WHEN urine_ml_day < 200 THEN 4 WHEN urine_ml_day < 500 THEN 3 WHEN urine_ml_day >= 500 THEN 0 END) AS p_renal FROM r)"""


@query("organ_component_points", "SCO-1 SCO-2 SCO-3 SCO-4 SCO-5 SCO-6 SCO-7 SCO-8", f"""{_ORGANS}
SELECT event_id, p_respiration, p_coagulation, p_liver, p_cardiovascular, p_cns, p_renal FROM p""")
def organ_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points of all six organ components, with ventilation, vasopressor ladder and urine output."""
    return S.sofa_points(_inputs(spark, sf, ORGAN_INPUTS)).select("event_id", *[f"p_{c}" for c in S.SOFA_COMPONENTS])


@query("organ_totals", "SCO-9 SCO-10 PRJ-26 PRJ-25", f"""{_ORGANS}
SELECT event_id, CASE WHEN {PRESENT} >= 3 THEN {TOTAL} END AS score, CASE WHEN {PRESENT} < 3 THEN 'insufficient_data'
  WHEN {PRESENT} < 6 THEN 'partial' ELSE 'complete' END AS completeness, {MISSING} AS missing, {POSITIVE} AS positive_components,
  {tier_sql(f'(CASE WHEN {PRESENT} >= 3 THEN {TOTAL} END)')} AS tier,
  array_to_string(list_filter([{', '.join(f"'{c}=' || p_{c}" for c in S.SOFA_COMPONENTS)}], lambda x: x IS NOT NULL), ',') AS point_map
FROM p""")
def organ_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Total, completeness, missing components, tier and component map."""
    df = S.sofa_total(S.sofa_points(_inputs(spark, sf, ORGAN_INPUTS)))
    shown = F.filter(S.sofa_breakdown(), lambda c: c.points.isNotNull())
    as_map = F.map_from_entries(F.transform(shown, lambda c: F.struct(c["name"], c["points"])))
    return df.select("event_id", "score", "completeness", joined("missing_components").alias("missing"),
                     "positive_components", S.tier(F.col("score")).alias("tier"),
                     F.array_join(F.transform(F.map_entries(as_map), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
                     .alias("point_map"))


@query("thresholds_by_version", "SCO-11 JOI-1", f"""WITH {READINGS}, {_inputs_sql({'platelets': ORGAN_INPUTS['platelets'], 'k': 'k'})}
SELECT event_id, CASE WHEN k % 3 = 2 THEN 'fallback' ELSE CASE k % 3 WHEN 0 THEN '0.2.0' ELSE '9.0.0' END END AS rules_used,
  CASE WHEN platelets IS NULL THEN NULL
    WHEN k % 3 = 1 THEN CASE WHEN platelets < 40 THEN 4 WHEN platelets < 120 THEN 2 WHEN platelets >= 120 THEN 0 END
    ELSE CASE WHEN platelets < 20 THEN 4 WHEN platelets < 50 THEN 3 WHEN platelets < 100 THEN 2 WHEN platelets < 150 THEN 1
      WHEN platelets >= 150 THEN 0 END END AS points FROM inp""")
def thresholds_by_version(spark: SparkSession, sf: str) -> DataFrame:
    """Bands joined in from the rules table per row; an unknown bundle falls back to the defaults."""
    kind = "array<struct<points:int,op:string,limit:double>>"
    default = [tuple(b) for b in S.COAGULATION]
    rules = spark.createDataFrame(
        [("sepsis-sofa", "0.2.0", default), ("site-sofa", "9.0.0", [(4, "<", 40.0), (2, "<", 120.0), (0, ">=", 120.0)])],
        f"bundle_id string, rule_version string, bands {kind}")
    rows = _inputs(spark, sf, {"platelets": ORGAN_INPUTS["platelets"], "bundle_id":
                               "CASE k % 3 WHEN 0 THEN 'sepsis-sofa' WHEN 1 THEN 'site-sofa' ELSE 'not-installed' END"})
    fallback = F.array(*[F.struct(F.lit(p).alias("points"), F.lit(o).alias("op"), F.lit(x).alias("limit")) for p, o, x in default])
    # One row per bundle version: the size is set by the registry, not by the data.
    out = rows.join(F.broadcast(rules), "bundle_id", "left")
    return out.select("event_id", F.coalesce("rule_version", F.lit("fallback")).alias("rules_used"),
                      S.banded_by_row(F.col("platelets"), F.coalesce("bands", fallback)).alias("points"))


_RESP = f"""WITH {READINGS}, {_inputs_sql(RESP_INPUTS)},
f AS (SELECT *, coalesce(fio2, CASE WHEN room_air THEN 0.21::DOUBLE END) AS fx, coalesce(ventilated, false) AS vent,
  lower(trim(oxygen_device)) AS dev FROM inp),
r AS (SELECT *, coalesce(pao2_fio2, spo2_fio2, CASE WHEN fx > 0 THEN coalesce(pao2 / fx, spo2 / fx) END) AS ratio,
  CASE WHEN pao2_fio2 IS NOT NULL THEN 'pao2_fio2' WHEN spo2_fio2 IS NOT NULL THEN 'spo2_fio2'
    WHEN fx > 0 AND pao2 IS NOT NULL THEN 'pao2_mmhg/fio2' WHEN fx > 0 AND spo2 IS NOT NULL THEN 'spo2_percent/fio2' END AS src
  FROM f),
s AS (SELECT *, CASE WHEN ratio < 100 THEN 3 WHEN ratio < 200 THEN CASE WHEN vent THEN 3 ELSE 2 END WHEN ratio < 300 THEN 2
    WHEN ratio < 400 THEN 1 WHEN ratio IS NOT NULL THEN 0 END AS ox,
  CASE WHEN respiratory_rate >= 35 THEN 3 WHEN respiratory_rate >= 30 THEN 2 WHEN respiratory_rate >= 22 THEN 1
    WHEN respiratory_rate IS NOT NULL THEN 0 END AS rr,
  CASE WHEN vent THEN 3 ELSE CASE dev WHEN 'none' THEN 0 WHEN 'nasal_cannula' THEN 1 WHEN 'face_mask' THEN 1
    WHEN 'high_flow' THEN 2 WHEN 'non_invasive' THEN 2 WHEN 'invasive' THEN 3 END END AS sup,
  CASE WHEN abg_ph IS NULL AND paco2 IS NULL THEN NULL ELSE greatest(
    CASE WHEN abg_ph < 7.20 THEN 3 WHEN abg_ph < 7.25 THEN 2 WHEN abg_ph < 7.30 THEN 1 ELSE 0 END,
    CASE WHEN paco2 > 60 THEN 2 WHEN paco2 > 50 THEN 1 ELSE 0 END) END AS gas FROM r),
t AS (SELECT *, greatest(ox, rr, sup, gas) AS stage, array_to_string(list_filter([
    CASE WHEN ratio IS NULL AND (spo2 IS NOT NULL OR pao2 IS NOT NULL) THEN 'oxygenation' END,
    CASE WHEN sup IS NULL AND dev IS NOT NULL THEN 'oxygen_support' END], lambda x: x IS NOT NULL), ',') AS miss FROM s)"""


@query("respiratory_score", "SCO-15 SCO-16 SCO-17", f"""{_RESP}
SELECT event_id, ox AS oxygenation_stage, rr AS rate_stage, sup AS support_stage, gas AS blood_gas_stage, stage,
  stage * 2 AS score, {tier_sql('(stage * 2)', '2', 4, 6)} AS tier, src AS ratio_source, round(ratio, 6) AS ratio_used,
  CASE WHEN stage IS NULL AND miss = '' THEN 'oxygenation,respiratory_rate,oxygen_support' ELSE miss END AS missing,
  CASE WHEN stage IS NULL THEN 'insufficient_data' WHEN miss <> '' THEN 'partial' ELSE 'complete' END AS completeness,
  CASE WHEN stage IS NULL THEN '' ELSE array_to_string(list_filter([
    CASE WHEN ratio < 100 THEN 'ratio_lt_100:' WHEN ratio < 200 THEN 'ratio_lt_200:' WHEN ratio < 300 THEN 'ratio_lt_300:'
      WHEN ratio < 400 THEN 'ratio_lt_400:' WHEN ratio IS NOT NULL THEN 'ratio_ok:' END || src,
    CASE WHEN respiratory_rate >= 35 THEN 'rr_ge_35' WHEN respiratory_rate >= 30 THEN 'rr_ge_30'
      WHEN respiratory_rate >= 22 THEN 'rr_ge_22' WHEN respiratory_rate IS NOT NULL THEN 'rr_ok' END,
    CASE WHEN vent THEN 'mechanically_ventilated' WHEN sup > 0 THEN 'oxygen_device:' || dev END,
    CASE WHEN abg_ph < 7.20 THEN 'ph_lt_7_20' WHEN abg_ph < 7.25 THEN 'ph_lt_7_25' WHEN abg_ph < 7.30 THEN 'ph_lt_7_30' END,
    CASE WHEN paco2 > 60 THEN 'paco2_gt_60' WHEN paco2 > 50 THEN 'paco2_gt_50' END,
    CASE WHEN gas = 0 THEN 'abg_ok' END], lambda x: x IS NOT NULL), ',') END AS criteria FROM t""")
def respiratory_score(spark: SparkSession, sf: str) -> DataFrame:
    """Respiratory stage from oxygenation, rate, support and blood gas."""
    return S.respiratory(_inputs(spark, sf, RESP_INPUTS)).select(
        "event_id", "oxygenation_stage", "rate_stage", "support_stage", "blood_gas_stage", "stage", "score", "tier",
        "ratio_source", F.round("ratio_used", 6).alias("ratio_used"), joined("missing_components").alias("missing"),
        "completeness", joined("criteria_met").alias("criteria"))


_HEMO = f"""WITH {READINGS}, {_inputs_sql(HEMO_INPUTS)},
s AS (SELECT *, CASE WHEN lactate >= 4 THEN 3 WHEN lactate >= 2 THEN 2 WHEN lactate >= 1.5 THEN 1 WHEN lactate IS NOT NULL THEN 0 END AS ls,
  CASE WHEN map_mmhg < 55 THEN 3 WHEN map_mmhg < 65 THEN 2 WHEN map_mmhg < 70 THEN 1 WHEN map_mmhg IS NOT NULL THEN 0 END AS ms,
  CASE WHEN on_pressor THEN 2 WHEN on_pressor IS NOT NULL THEN 0 END AS vs FROM inp),
t AS (SELECT *, greatest(ls, ms, vs) AS stage FROM s)"""


@query("haemodynamic_score", "SCO-18", f"""{_HEMO}
SELECT event_id, stage, stage * 2 AS score, {tier_sql('(stage * 2)', '2', 4, 6)} AS tier,
  CASE WHEN stage IS NULL THEN 'insufficient_data' WHEN lactate IS NULL OR map_mmhg IS NULL THEN 'partial' ELSE 'complete' END
    AS completeness,
  array_to_string(list_filter([CASE WHEN lactate IS NULL THEN 'lactate' END,
    CASE WHEN map_mmhg IS NULL THEN 'mean_arterial_pressure' END], lambda x: x IS NOT NULL), ',') AS missing,
  array_to_string(list_filter([CASE ls WHEN 3 THEN 'lactate_ge_4' WHEN 2 THEN 'lactate_ge_2' WHEN 1 THEN 'lactate_ge_1_5' WHEN 0 THEN 'lactate_ok' END,
    CASE ms WHEN 3 THEN 'map_lt_55' WHEN 2 THEN 'map_lt_65' WHEN 1 THEN 'map_lt_70' WHEN 0 THEN 'map_ok' END,
    CASE vs WHEN 2 THEN 'on_vasopressor' WHEN 0 THEN 'vaso_off' END], lambda x: x IS NOT NULL), ',') AS criteria FROM t""")
def haemodynamic_score(spark: SparkSession, sf: str) -> DataFrame:
    """Shock surveillance stage from lactate, pressure and vasopressor use."""
    return S.haemodynamic(_inputs(spark, sf, HEMO_INPUTS)).select(
        "event_id", "stage", "score", "tier", "completeness", joined("missing_components").alias("missing"),
        joined("criteria_met").alias("criteria"))


def sepsis_rows(spark: SparkSession, sf: str) -> DataFrame:
    env = P.envelopes(spark, sf)
    shape = latest.shape_of(env)
    rows = snap.scored(env, shape=shape).select(
        "patient_id", F.col("encounter_now").alias("encounter_id"), "event_us", "idempotency_key",
        F.col("score").alias("current_sofa"), F.col("context_flags").alias("exclusion_flags"))
    base = rows.where(F.col("current_sofa").isNotNull()).groupBy("patient_id").agg(
        F.min_by("current_sofa", F.struct("event_us", "idempotency_key")).alias("baseline_sofa"))
    found = asof.infection_at(rows.join(base, "patient_id", "left"), P.infections(spark, sf), hot=shape.hot)
    return S.sepsis3(found)


SEPSIS = """,
inf AS (SELECT patient_id, event_us AS i_us, CASE k % 2 WHEN 0 THEN 'culture' ELSE 'antimicrobial' END AS kind,
  'Infection/' || event_id AS ev FROM rd WHERE k BETWEEN 90 AND 96),
bl AS (SELECT patient_id, arg_min(score, {'a': event_us, 'b': idempotency_key}) AS baseline_sofa FROM scored
  WHERE score IS NOT NULL GROUP BY patient_id),
s3 AS (SELECT s.patient_id, s.event_us, s.idempotency_key, s.encounter_now, s.score AS cur, b.baseline_sofa AS base, s.context_flag,
    min(i.i_us) AS infection_us, arg_min(i.kind, {'a': i.i_us, 'b': i.ev}) AS kind,
    s.patient_id IN (SELECT patient_id FROM inf) AS any_inf
  FROM scored s LEFT JOIN bl b USING (patient_id)
  LEFT JOIN inf i ON i.patient_id = s.patient_id AND s.event_us BETWEEN i.i_us - 86400000000 AND i.i_us + 86400000000 GROUP BY ALL),
sep AS (SELECT *, CASE WHEN context_flag IS NOT NULL THEN 'excluded'
    WHEN cur IS NULL OR base IS NULL OR (infection_us IS NULL AND NOT any_inf) THEN 'insufficient_data'
    WHEN infection_us IS NOT NULL AND cur - base >= 2 THEN 'met' ELSE 'not_met' END AS status FROM s3)"""


@query("sepsis_phenotype", "SCO-19 JOI-5", f"""WITH {SCORED}{SEPSIS}
SELECT patient_id, event_us, status, CASE WHEN status <> 'excluded' THEN cur - base END AS sofa_delta, infection_us,
  CASE WHEN status = 'excluded' THEN '' ELSE array_to_string(list_filter(['infection_' || kind,
    CASE WHEN cur - base >= 2 THEN 'acute_sofa_rise_ge_2' END], lambda x: x IS NOT NULL), ',') END AS criteria,
  CASE WHEN status = 'excluded' THEN 'exclusion_flag' ELSE array_to_string(list_filter([
    CASE WHEN infection_us IS NULL AND any_inf THEN 'infection_outside_window' END,
    CASE WHEN cur - base < 2 THEN 'acute_sofa_rise_ge_2' END,
    CASE WHEN cur - base < 2 AND base >= 2 THEN 'pre_existing_dysfunction_without_acute_rise' END], lambda x: x IS NOT NULL), ',') END
    AS failed,
  CASE WHEN status = 'excluded' THEN '' ELSE array_to_string(list_filter([CASE WHEN cur IS NULL THEN 'current_sofa' END,
    CASE WHEN base IS NULL THEN 'baseline_sofa' END,
    CASE WHEN infection_us IS NULL AND NOT any_inf THEN 'infection_suspicion' END], lambda x: x IS NOT NULL), ',') END AS missing
FROM sep""")
def sepsis_phenotype(spark: SparkSession, sf: str) -> DataFrame:
    """Infection suspicion within 24 hours and an acute score rise."""
    return sepsis_rows(spark, sf).select(
        "patient_id", "event_us", "status", "sofa_delta", "infection_us", joined("criteria_met").alias("criteria"),
        joined("criteria_failed").alias("failed"), joined("missing_inputs").alias("missing"))


def installed() -> Indicators:
    """The four shipped scorers under their score types."""
    reg = Indicators()
    reg.register("sofa", lambda df: S.sofa_total(S.sofa_points(df)).withColumn("tier", S.tier(F.col("score"))))
    reg.register("aki_kdigo", S.aki_point)
    reg.register("resp_hypoxemia", S.respiratory)
    reg.register("hemo_shock", S.haemodynamic)
    reg.check_active()
    return reg


AKI_INPUTS = {"creatinine": ORGAN_INPUTS["creatinine"], "baseline_creatinine": "CASE WHEN k % 5 <> 0 THEN 1 / 1 END",
              "urine_ml_kg_h": "CASE WHEN k % 3 = 0 THEN (k % 7) / 10 END",
              "urine_hours": "CASE WHEN k % 4 <> 0 THEN (k % 30) / 1 END", "anuria": "k % 25 = 0"}


@query("indicator_dispatch", "SCO-20 SET-1 AGG-23", f"""{_ORGANS},
i2 AS (SELECT {', '.join(f'{e} AS {n}' for n, e in {**AKI_INPUTS}.items())} FROM rd),
a AS (SELECT CASE WHEN creatinine IS NULL THEN NULL WHEN creatinine >= 4 THEN 3 WHEN baseline_creatinine IS NULL THEN 0
    WHEN creatinine >= 3 THEN 3 WHEN creatinine >= 2 THEN 2 WHEN creatinine >= 1.5 OR creatinine - 1 >= 0.3 THEN 1 ELSE 0 END AS c,
  CASE WHEN anuria AND coalesce(urine_hours, 0) >= 12 THEN 3 WHEN urine_ml_kg_h IS NULL OR urine_hours IS NULL THEN NULL
    WHEN urine_ml_kg_h < 0.3 AND urine_hours >= 24 THEN 3 WHEN urine_ml_kg_h < 0.5 AND urine_hours >= 12 THEN 2
    WHEN urine_ml_kg_h < 0.5 AND urine_hours >= 6 THEN 1 ELSE 0 END AS u FROM i2),
resp AS (SELECT tier FROM ({_RESP} SELECT {tier_sql('(stage * 2)', '2', 4, 6)} AS tier FROM t)),
hemo AS (SELECT tier FROM ({_HEMO} SELECT {tier_sql('(stage * 2)', '2', 4, 6)} AS tier FROM t))
SELECT indicator, version, tier, count(*) AS n FROM (
  SELECT 'sofa-deterioration' AS indicator, '0.3.0' AS version, {tier_sql(f'(CASE WHEN {PRESENT} >= 3 THEN {TOTAL} END)')} AS tier FROM p
  UNION ALL SELECT 'aki', '0.4.0', {tier_sql('(greatest(c, u) * 2)', '2', 4, 6)} FROM a
  UNION ALL SELECT 'respiratory-deterioration', '0.1.0', tier FROM resp
  UNION ALL SELECT 'hemodynamic-shock', '0.1.0', tier FROM hemo) GROUP BY ALL""")
def indicator_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """Every active bundle scored by the scorer installed for its type."""
    reg = installed()
    inputs = {"sofa": ORGAN_INPUTS, "aki_kdigo": AKI_INPUTS, "resp_hypoxemia": RESP_INPUTS, "hemo_shock": HEMO_INPUTS}
    out = None
    for bid in sorted(ACTIVE_VERSIONS):
        b = load_bundle(bid)
        rows = reg.score(b, _inputs(spark, sf, inputs[b.score_type])).select(
            F.lit(b.indicator).alias("indicator"), F.lit(b.version).alias("version"), "tier")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("indicator", "version", "tier").agg(F.count(F.lit(1)).alias("n"))


from wardline.catalog.kidney import KIDNEY_TAIL, evaluated  # noqa: E402

_AKI_ID = f"'alert-' || {uuid_sql(chr(39).join(['patient_id || ', '|', ' || ', '', ' || ', '|aki|', ' || score || ', '|', ' || (event_us // 1000) || ', '|0.4.0', '']))}"


@query("signal_contract", "PRJ-22 SET-1", f"""WITH {SCORED}{SEPSIS}{KIDNEY_TAIL}
SELECT {alert_id_sql('sofa-deterioration', '0.3.0')} AS signal_id, 'sofa-deterioration' AS signal_type, 'risk' AS signal_kind,
  patient_id, event_us, score::INT AS score, NULL::INT AS stage, completeness, tier AS severity, missing AS missing_inputs, 'open' AS resolution_state
FROM scored WHERE completeness <> 'insufficient_data'
UNION ALL SELECT {_AKI_ID}, 'aki', 'risk', patient_id, event_us, score, stage, CASE WHEN missing <> '' THEN 'partial' ELSE 'complete' END,
  {tier_sql('score', '2', 4, 6)}, missing, 'open' FROM aki WHERE status = 'scored'
UNION ALL SELECT 's3-' || patient_id || '-' || event_us, 'sepsis-3', 'phenotype', patient_id, event_us, (status = 'met')::INT, NULL,
  CASE WHEN status = 'insufficient_data' THEN 'insufficient_data' ELSE 'complete' END, CASE WHEN status = 'met' THEN 'urgent' ELSE 'none' END,
  CASE WHEN status = 'excluded' THEN '' ELSE array_to_string(list_filter([CASE WHEN cur IS NULL THEN 'current_sofa' END,
    CASE WHEN base IS NULL THEN 'baseline_sofa' END,
    CASE WHEN infection_us IS NULL AND NOT any_inf THEN 'infection_suspicion' END], lambda x: x IS NOT NULL), ',') END,
  CASE WHEN status = 'excluded' THEN 'suppressed' ELSE 'open' END FROM sep""")
def signal_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Organ dysfunction, kidney and sepsis signals under the shared contract."""
    sofa = snap.alerts(P.envelopes(spark, sf))
    aki = evaluated(spark, sf).where(F.col("status") == "scored").withColumn("encounter_id", F.lit(None).cast("string"))
    aki = aki.withColumn("alert_id", ids.alert_id(F.col("patient_id"), F.col("encounter_id"), F.lit("aki"), F.col("score"),
                                                  F.col("event_us"), F.lit("0.4.0"))).withColumnRenamed("missing", "missing_components")
    sep = sepsis_rows(spark, sf).withColumn("alert_id", F.concat_ws("-", F.lit("s3"), "patient_id", "event_us"))
    out = SG.from_score(sofa, "sofa-deterioration", "sepsis-sofa", "0.3.0").unionByName(
        SG.from_score(aki, "aki", "aki-kdigo", "0.4.0", ("creatinine_stage", "urine_stage"))).unionByName(
        SG.from_sepsis3(sep, F.lit("urgent")))
    return out.select("signal_id", "signal_type", "signal_kind", "patient_id", "event_us", "score", "stage", "completeness",
                      "severity", joined("missing_inputs").alias("missing_inputs"), "resolution_state")
