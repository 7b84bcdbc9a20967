"""Time joins and ICU snapshot scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalog.base import MISSING, PRESENT, READINGS, SCORED, TOTAL, alert_source, governance_sql, joined, query, tier_sql
from wardline.catalog.governance import ACTIVE, STRICT, governed
from wardline.functions.scores import SOFA_COMPONENTS
from wardline.operators import asof, latest
from wardline.plans import icu as ICU
from wardline.session import new_path
from wardline.sources import icu, projection as P

H24 = "86400000000::BIGINT"


def stays_of(spark: SparkSession, sf: str) -> DataFrame:
    """One stay per user, from the first to the last event."""
    return P.readings(spark, sf).groupBy("user_id").agg(
        F.min("event_us").alias("intime_us"), F.max("event_us").alias("outtime_us")).selectExpr(
        "user_id", "concat('s', user_id) AS subject_id", "concat('t', user_id) AS stay_id",
        "if(user_id % 5 = 0, '', concat('Encounter/', user_id, '-1')) AS hadm_id", "intime_us", "outtime_us")


_T = 'date_format(timestamp_micros({}), "yyyy-MM-dd HH:mm:ss.SSSSSS")'
_LAB_ITEM = """CASE code WHEN '777-3' THEN 51265 + (event_id % 2) * 439 WHEN '1975-2' THEN 50885 + (event_id % 2) * 2204
  WHEN '2160-0' THEN 50912 + (event_id % 2) * 1634 ELSE 1 END"""
_CHART_ITEM = """CASE code WHEN '8478-0' THEN 220052 WHEN '2708-6' THEN 220277 WHEN '3150-0' THEN 223835 WHEN '777-3' THEN 225678
  WHEN '9269-2' THEN CASE k % 3 WHEN 0 THEN 220739 WHEN 1 THEN 223900 ELSE 223901 END ELSE 2 END"""
_IS_LAB = "code IN ('777-3', '1975-2', '2160-0', '2708-6') AND NOT (code = '777-3' AND user_id % 7 = 0)"
_IS_CHART = "code IN ('8478-0', '2708-6', '3150-0', '9269-2', '1975-2') OR (code = '777-3' AND user_id % 7 = 0)"
_CHART_VALUE = "CASE WHEN code = '9269-2' THEN (1 + k % 5) / 1 ELSE reading END"
_PRESSOR = """CASE event_id % 6 WHEN 0 THEN 221906 WHEN 1 THEN 221289 WHEN 2 THEN 221662 WHEN 3 THEN 221653 WHEN 4 THEN 229617 ELSE 3 END"""


def write_icu_tables(spark: SparkSession, sf: str) -> str:
    """The projection as the five compressed CSV tables an ICU extract has."""
    path = new_path(spark, "icu")
    r = P.readings(spark, sf)
    at = _T.format("event_us") + " AS charttime"
    stays_of(spark, sf).selectExpr("subject_id", "hadm_id", "stay_id", _T.format("intime_us") + " AS intime",
                                   _T.format("outtime_us") + " AS outtime").write.csv(f"{path}/icustays", header=True, compression="gzip")
    r.where(_IS_LAB).selectExpr("concat('s', user_id) AS subject_id", "coalesce(encounter_id, '') AS hadm_id", f"{_LAB_ITEM} AS itemid", at,
                                "if(event_id % 37 = 0, 'n/a', cast(reading AS string)) AS valuenum", "event_id AS row_id").write.csv(
        f"{path}/labevents", header=True, compression="gzip")
    r.where(_IS_CHART).selectExpr("concat('t', user_id) AS stay_id", f"{_CHART_ITEM} AS itemid", at, f"{_CHART_VALUE} AS valuenum",
                                  "event_id AS row_id").write.csv(f"{path}/chartevents", header=True, compression="gzip")
    p = r.where("event_type = 'purchase'")
    p.selectExpr("concat('t', user_id) AS stay_id", f"{_PRESSOR} AS itemid", _T.format("event_us") + " AS starttime",
                 "if(event_id % 10 = 0, null, " + _T.format("event_us + (event_id % 240) * 60000000") + ") AS endtime",
                 "raw_value / 100 AS rate", "'mcg/kg/min' AS rateuom", "event_id AS row_id").write.csv(
        f"{path}/inputevents", header=True, compression="gzip")
    r.where("event_type = 'signup'").selectExpr("concat('t', user_id) AS stay_id", "if(event_id % 11 = 0, 4, 226559) AS itemid", at,
                                                "raw_value * 4 AS value").write.csv(f"{path}/outputevents", header=True, compression="gzip")
    return path


def icu_scored(spark: SparkSession, sf: str) -> DataFrame:
    path = write_icu_tables(spark, sf)
    stays = ICU.with_as_of(icu.read_icustays(spark, f"{path}/icustays"))
    return ICU.score_snapshots(ICU.snapshot_inputs(
        stays, icu.read_labs(spark, f"{path}/labevents", stays), icu.read_charts(spark, f"{path}/chartevents", stays),
        icu.read_infusions(spark, f"{path}/inputevents", stays), icu.read_urine(spark, f"{path}/outputevents", stays)))


_STAYS = READINGS + f""",
st AS (SELECT user_id, min(event_us) AS intime, max(event_us) AS outtime, least(min(event_us) + {H24}, max(event_us)) AS as_of,
  CASE WHEN user_id % 5 = 0 THEN '' ELSE 'Encounter/' || user_id || '-1' END AS hadm FROM rd GROUP BY user_id)"""


def _last(cond: str, name: str, value: str = "reading") -> str:
    return f"arg_max({value}, {{'a': event_us, 'b': event_id}}) FILTER ({cond}) AS {name}"


_ICU = _STAYS + f""",
lab AS (SELECT s.user_id, {_last("code = '777-3'", 'lp')}, {_last("code = '1975-2'", 'lb')}, {_last("code = '2160-0'", 'lc')},
    arg_min(reading, {{'a': event_us, 'b': event_id}}) FILTER (code = '2160-0' AND event_us < as_of AND event_us >= as_of - 604800000000::BIGINT) AS base
  FROM st s JOIN rd r USING (user_id) WHERE {_IS_LAB} AND event_us <= as_of AND event_id % 37 <> 0
    AND (hadm = '' OR encounter_id IS NULL OR encounter_id = hadm) GROUP BY s.user_id),
chart AS (SELECT s.user_id, {_last("code = '8478-0'", 'map_mmhg')}, {_last("code = '2708-6'", 'spo2')}, {_last("code = '3150-0'", 'pct')},
    {_last("code = '777-3' AND user_id % 7 = 0", 'cp')}, {_last("code = '9269-2' AND k % 3 = 0", 'e', '1 + k % 5')},
    {_last("code = '9269-2' AND k % 3 = 1", 'v', '1 + k % 5')}, {_last("code = '9269-2' AND k % 3 = 2", 'm', '1 + k % 5')}
  FROM st s JOIN rd r USING (user_id) WHERE event_us <= as_of GROUP BY s.user_id),
inf AS (SELECT s.user_id, event_id, raw_value / 100 AS dose, CASE event_id % 6 WHEN 0 THEN 'norepinephrine' WHEN 1 THEN 'epinephrine'
    WHEN 2 THEN 'dopamine' WHEN 3 THEN 'dobutamine' WHEN 4 THEN 'epinephrine' END AS agent
  FROM st s JOIN rd r USING (user_id) WHERE event_type = 'purchase' AND event_id % 6 <> 5 AND event_us <= as_of
    AND (event_id % 10 = 0 OR as_of <= event_us + (event_id % 240) * 60000000)),
prs AS (SELECT * FROM inf QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE agent WHEN 'norepinephrine' THEN 4
    WHEN 'epinephrine' THEN 4 WHEN 'dopamine' THEN 3 ELSE 2 END DESC, event_id) = 1),
uri AS (SELECT s.user_id, sum(raw_value * 4) AS urine_ml_day FROM st s JOIN rd r USING (user_id)
  WHERE event_type = 'signup' AND event_id % 11 <> 0 AND event_us BETWEEN as_of - {H24} AND as_of GROUP BY s.user_id)"""
_ICU_SCORED = _ICU + f""",
inp AS (SELECT st.*, CASE WHEN pct > 0 THEN spo2 / (pct / 100) END AS ratio, coalesce(lp, cp) AS platelets, lb AS bilirubin, map_mmhg, agent,
    dose, (e + v + m)::INT AS gcs, lc AS creatinine, urine_ml_day, base
  FROM st LEFT JOIN lab USING (user_id) LEFT JOIN chart USING (user_id) LEFT JOIN prs USING (user_id) LEFT JOIN uri USING (user_id)),
p AS (SELECT *, CASE WHEN ratio < 300 THEN 2 WHEN ratio < 400 THEN 1 WHEN ratio IS NOT NULL THEN 0 END AS p_respiration,
  CASE WHEN platelets < 20 THEN 4 WHEN platelets < 50 THEN 3 WHEN platelets < 100 THEN 2 WHEN platelets < 150 THEN 1 WHEN platelets >= 150 THEN 0 END AS p_coagulation,
  CASE WHEN bilirubin >= 12 THEN 4 WHEN bilirubin >= 6 THEN 3 WHEN bilirubin >= 2 THEN 2 WHEN bilirubin >= 1.2 THEN 1 WHEN bilirubin < 1.2 THEN 0 END AS p_liver,
  CASE agent WHEN 'dobutamine' THEN 2 WHEN 'dopamine' THEN CASE WHEN dose > 15 THEN 4 WHEN dose > 5 THEN 3 ELSE 2 END
    ELSE CASE WHEN agent IS NOT NULL THEN CASE WHEN dose > 0.1 THEN 4 ELSE 3 END WHEN map_mmhg < 70 THEN 1 WHEN map_mmhg >= 70 THEN 0 END END AS p_cardiovascular,
  CASE WHEN gcs < 6 THEN 4 WHEN gcs <= 9 THEN 3 WHEN gcs <= 12 THEN 2 WHEN gcs <= 14 THEN 1 WHEN gcs IS NOT NULL THEN 0 END AS p_cns,
  greatest(CASE WHEN creatinine >= 5 THEN 4 WHEN creatinine >= 3.5 THEN 3 WHEN creatinine >= 2 THEN 2 WHEN creatinine >= 1.2 THEN 1 WHEN creatinine < 1.2 THEN 0 END,
    CASE WHEN urine_ml_day < 200 THEN 4 WHEN urine_ml_day < 500 THEN 3 WHEN urine_ml_day >= 500 THEN 0 END) AS p_renal,
  CASE WHEN creatinine IS NULL THEN NULL WHEN creatinine >= 4 THEN 3 WHEN base IS NULL OR base <= 0 THEN 0 WHEN creatinine / base >= 3 THEN 3
    WHEN creatinine / base >= 2 THEN 2 WHEN creatinine / base >= 1.5 OR creatinine - base >= 0.3 THEN 1 ELSE 0 END AS aki_stage FROM inp),
z AS (SELECT *, CASE WHEN {PRESENT} >= 3 THEN {TOTAL} END AS sofa_score, {MISSING} AS sofa_missing,
    CASE WHEN {PRESENT} < 3 THEN 'insufficient_data' WHEN {PRESENT} < 6 THEN 'partial' ELSE 'complete' END AS sofa_completeness,
    CASE WHEN aki_stage IS NULL THEN 'insufficient_data' WHEN base IS NULL OR base <= 0 THEN 'partial' ELSE 'complete' END AS aki_completeness FROM p),
y AS (SELECT *, {tier_sql('sofa_score')} AS sofa_tier, {tier_sql('(aki_stage * 2)', '2', 4, 6)} AS aki_tier FROM z)"""


@query("icu_snapshot_scores", "JOI-2 JOI-3 JOI-4 JOI-6 JOI-7 JOI-8 JOB-12 SRC-7 SRC-8 SRC-9 SRC-10 SRC-11 FLT-10", f"""WITH {_ICU_SCORED}
SELECT 't' || user_id AS stay_id, as_of AS as_of_us, sofa_score, sofa_completeness, sofa_missing, sofa_tier, aki_stage, aki_completeness, aki_tier FROM y""")
def icu_snapshot_scores(spark: SparkSession, sf: str) -> DataFrame:
    """ICU tables read from compressed CSV and scored 24 hours after admission."""
    return icu_scored(spark, sf).select(
        "stay_id", "as_of_us", "sofa_score", "sofa_completeness", joined("sofa_missing_components").alias("sofa_missing"),
        "sofa_tier", "aki_stage", "aki_completeness", "aki_tier")


@query("icu_snapshot_totals", "AGG-23 JOB-12", f"""WITH {_ICU_SCORED}
SELECT count(*) AS stays_scored, count(*) FILTER (sofa_tier <> 'none') AS sofa_alertable, count(*) FILTER (aki_tier <> 'none') AS aki_alertable,
  count(*) FILTER (sofa_completeness = 'partial') AS sofa_partial, count(*) FILTER (aki_completeness = 'partial') AS aki_partial FROM y""")
def icu_snapshot_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Alertable and partial stays per indicator."""
    return ICU.totals(icu_scored(spark, sf))


@query("pressure_at_infusion", "JOI-2", f"""WITH {READINGS}
SELECT i.event_id, arg_max(r.reading, {{'a': r.event_us, 'b': r.event_id}}) AS map_mmhg, max(r.event_us) AS map_us
FROM rd i LEFT JOIN rd r ON r.patient_id = i.patient_id AND r.code = '8478-0' AND r.event_us <= i.event_us WHERE i.event_type = 'purchase' GROUP BY i.event_id""")
def pressure_at_infusion(spark: SparkSession, sf: str) -> DataFrame:
    """Latest pressure before every infusion start."""
    r = P.readings(spark, sf)
    left = P.medications(spark, sf).select("event_id", "patient_id", "start_us")
    right = r.where(F.col("code") == "8478-0").select(
        "patient_id", F.col("event_us").alias("map_us"), F.col("reading").alias("map_mmhg"), F.col("event_id").alias("t"))
    return asof.asof_join(left, right, ["patient_id"], "start_us", "map_us", ["map_mmhg", "map_us"], tie="t").select(
        "event_id", "map_mmhg", "map_us")


@query("active_infusions", "JOI-3", f"""WITH {_ICU}
SELECT 't' || st.user_id AS stay_id, agent, dose, CASE WHEN agent IS NOT NULL THEN true END AS on_pressor FROM st LEFT JOIN prs USING (user_id)""")
def active_infusions(spark: SparkSession, sf: str) -> DataFrame:
    """Infusion that decides the score at each stay's scoring time."""
    r = P.readings(spark, sf).where("event_type = 'purchase'").selectExpr(
        "event_id", "concat('t', user_id) AS stay_id", f"{_PRESSOR} AS itemid", "event_us AS start_us",
        "if(event_id % 10 = 0, null, event_us + (event_id % 240) * 60000000) AS end_us", "raw_value / 100 AS dose")
    running = r.where(F.col("itemid") != 3).withColumn("agent", icu.agent_of(F.col("itemid")))
    stays = ICU.with_as_of(stays_of(spark, sf)).select("stay_id", "as_of_us")
    return asof.pressor_at(stays, running, "stay_id").select("stay_id", "agent", "dose", "on_pressor")


@query("urine_last_day", "JOI-4", f"""WITH {_ICU} SELECT 't' || st.user_id AS stay_id, round(urine_ml_day, 6) AS urine_ml_day FROM st LEFT JOIN uri USING (user_id)""")
def urine_last_day(spark: SparkSession, sf: str) -> DataFrame:
    """Urine of the last 24 hours per stay, null when none was recorded."""
    rows = P.readings(spark, sf).where("event_type = 'signup' AND event_id % 11 <> 0").selectExpr(
        "concat('t', user_id) AS stay_id", "event_us", "raw_value * 4 AS ml")
    stays = ICU.with_as_of(stays_of(spark, sf)).select("stay_id", "as_of_us")
    return asof.trailing_sum(stays, rows, "stay_id", "ml", "u").select("stay_id", F.round("u", 6).alias("urine_ml_day"))


@query("decision_mismatches", "JOI-14", f"""WITH RECURSIVE {SCORED}, {alert_source(ACTIVE)}, {governance_sql('src', ACTIVE, SOFA_COMPONENTS, 'ga')},
{governance_sql('src', STRICT, SOFA_COMPONENTS, 'gb')}
SELECT a.reason AS reason_a, b.reason AS reason_b, count(*) AS n FROM ga a JOIN gb b ON a.pk = b.pk AND a.rn = b.rn
WHERE a.rn > 0 AND (a.emit <> b.emit OR a.reason <> b.reason OR a.routing <> b.routing) GROUP BY ALL""")
def decision_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions that differ between two rule versions."""
    shape = latest.shape_of(P.envelopes(spark, sf))
    keys, cols = ["patient_id", "idempotency_key"], ["emit", "reason", "routing"]
    a, b = governed(spark, sf, ACTIVE, shape), governed(spark, sf, STRICT, shape)
    return asof.mismatches(a, b, keys, cols).groupBy(
        F.col("expected.reason").alias("reason_a"), F.col("actual.reason").alias("reason_b")).agg(F.count(F.lit(1)).alias("n"))
