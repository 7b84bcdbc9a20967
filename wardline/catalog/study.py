"""Availability-ordered study queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalog.base import MISSING, POINTS, POSITIVE, PRESENT, READINGS, TOTAL, governance_sql, joined, query, tier_sql
from wardline.catalog.cohort import _KNOBS, _lit
from wardline.catalog.episodes import episode_sql
from wardline.plans import study as ST
from wardline.rules import ABLATIONS, SELECTION_CANDIDATES
from wardline.schemas import STAY_DOCUMENT
from wardline.operators import latest
from wardline.session import checkpointed, new_path
from wardline.sources import icu, projection as P

_STAY = "concat(user_id, '-', (event_us - 1704067200000000) div 43200000000, '-', event_id div 100000)"
_TXT = 'date_format(timestamp_micros({}), "yyyy-MM-dd HH:mm:ss.SSSSSS")'


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Stays of twelve hours as nested documents."""
    r = P.readings(spark, sf).withColumn("stay_id", F.expr(_STAY))
    item = "named_struct('itemid', cast({i} AS bigint), 'code', code, 'display', code, 'valuenum', reading, 'unit', unit, 'charttime', {c}{s}, 'evidence_id', concat('{p}/', event_id), 'status', status)"
    at = _TXT.format("event_us")
    lab = item.format(i="CASE WHEN code = '2160-0' THEN 50912 ELSE 1 END", c=at, s=f", 'storetime', if(event_id % 5 = 0, null, {_TXT.format('ingest_us')})", p="lab")
    chart = item.format(i="2", c=at, s="", p="chart")
    dx = (f"named_struct('code', concat('I', k), 'display', 'dx', 'onset', {at}, 'charttime', {at}, 'availability_time', "
          f"if(k % 20 = 19, {_TXT.format('event_us + 21600000000')}, null), 'storetime', cast(null AS string), 'evidence_id', concat('dx/', event_id), "
          "'status', 'final', 'is_discharge_diagnosis', event_id % 37 = 0 OR k = 99)")
    is_dx, is_lab = "k % 10 = 9", "code IN ('777-3', '1975-2', '2160-0')"
    return r.groupBy("stay_id", "user_id").agg(
        F.expr(f"collect_list(CASE WHEN NOT ({is_dx}) AND {is_lab} THEN {lab} END) AS labs"),
        F.expr(f"collect_list(CASE WHEN NOT ({is_dx}) AND NOT {is_lab} THEN {chart} END) AS charts"),
        F.expr(f"collect_list(CASE WHEN {is_dx} THEN {dx} END) AS conditions"),
        F.expr(_TXT.format("min(event_us)") + " AS intime"), F.expr(_TXT.format("max(event_us)") + " AS outtime"),
        F.expr("if(user_id % 2 = 0, " + _TXT.format("min(CASE WHEN k BETWEEN 90 AND 96 THEN event_us END)") + ", null) AS onset")).selectExpr(
        "stay_id", "cast(user_id AS string) AS subject_id", "stay_id AS hadm_id",
        "CASE user_id % 3 WHEN 0 THEN 'Train' WHEN 1 THEN 'validation' ELSE 'temporal-holdout' END AS split_id", "intime", "outtime",
        "named_struct('sepsis3_onset', onset) AS labels", "labs", "charts", "conditions")


def timeline_rows(spark: SparkSession, sf: str, files: bool = False) -> tuple[DataFrame, DataFrame]:
    docs = documents(spark, sf)
    if files:
        path = new_path(spark, "staydocs")
        docs.write.json(path)
        docs = spark.read.schema(STAY_DOCUMENT).json(path)
    t = icu.document_timeline(docs).withColumns({
        "event_us": F.unix_micros("event_time"), "available_us": F.unix_micros("availability_time")})
    hours = (F.unix_micros(F.to_timestamp("outtime")) - F.unix_micros(F.to_timestamp("intime"))) / 86_400_000_000.0
    stays = docs.select("stay_id", "split_id", F.unix_micros(F.to_timestamp("labels.sepsis3_onset")).alias("onset_us"),
                        F.greatest(hours, F.lit(1.0 / 24.0)).alias("patient_days"))
    return t, stays


TL = READINGS + """,
t0 AS (SELECT *, user_id || '-' || ((event_us - 1704067200000000) // 43200000000) || '-' || (event_id // 100000) AS stay_id,
  CASE WHEN k % 10 = 9 THEN 'condition' WHEN code IN ('777-3','1975-2','2160-0') THEN 'lab' ELSE 'chart' END AS kind FROM rd),
tl AS (SELECT *, CASE kind WHEN 'lab' THEN CASE WHEN event_id % 5 = 0 THEN event_us ELSE greatest(event_us, ingest_us) END
    WHEN 'condition' THEN CASE WHEN k % 20 = 19 THEN event_us + 21600000000 ELSE event_us END ELSE event_us END AS available_us,
  CASE kind WHEN 'condition' THEN 'dx/' ELSE kind || '/' END || event_id AS evidence_id, kind = 'condition' AND (event_id % 37 = 0 OR k = 99) AS discharge FROM t0)"""


def replay_sql(order: str = "available_us, event_us, evidence_id", clock: str = "available_us", p: str = "") -> str:
    w = f"(PARTITION BY stay_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    cols = (("777-3", "platelets", "coagulation"), ("1975-2", "bilirubin", "liver"), ("2160-0", "creatinine", "renal"), ("2708-6", "spo2", "respiration"),
            ("8478-0", "map_mmhg", "cardiovascular"), ("9269-2", "gcs0", "cns"))
    held = ", ".join(f"last_value(CASE WHEN kind <> 'condition' AND code = '{c}' THEN reading END IGNORE NULLS) OVER {w} AS {n}, "
                     f"last_value(CASE WHEN kind <> 'condition' AND code = '{c}' THEN evidence_id END IGNORE NULLS) OVER {w} AS e_{m}" for c, n, m in cols)
    return f""",
{p}r0 AS (SELECT *, {clock} AS clock_us, row_number() OVER (PARTITION BY stay_id ORDER BY {order}) AS position, {held}, NULL::DOUBLE AS fio2 FROM tl),
{p}r1 AS (SELECT *, trunc(gcs0)::INT AS gcs FROM {p}r0), {p}r2 AS (SELECT *, {POINTS} FROM {p}r1),
{p}rep AS (SELECT *, {MISSING} AS missing, {POSITIVE} AS positive, CASE WHEN {PRESENT} >= 1 THEN {TOTAL} END AS score,
  CASE WHEN {PRESENT} < 1 THEN 'insufficient_data' WHEN {PRESENT} < 6 THEN 'partial' ELSE 'complete' END AS completeness,
  {tier_sql(f'(CASE WHEN {PRESENT} >= 1 THEN {TOTAL} END)')} AS tier,
  list_filter([e_respiration, e_coagulation, e_liver, e_cardiovascular, e_cns, e_renal], lambda x: x IS NOT NULL) AS ev FROM {p}r2)"""


@query("stay_timeline", "SRC-12 PRJ-6 PRJ-7 SRT-1", f"""WITH {TL}
SELECT stay_id, kind, evidence_id, event_us, available_us, CASE WHEN kind <> 'condition' THEN round(reading, 6) END AS valuenum, discharge FROM tl""")
def stay_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Nested stay documents read from JSON as timeline facts with both clocks."""
    t, _ = timeline_rows(spark, sf, files=True)
    return t.select("stay_id", "kind", "evidence_id", "event_us", "available_us", F.round("valuenum", 6).alias("valuenum"),
                    F.col("is_discharge_diagnosis").alias("discharge"))


@query("timeline_envelopes", "PRJ-16", f"""WITH {TL}
SELECT 'Patient/' || user_id AS patient_id, 'Encounter/' || stay_id AS encounter_id, CASE kind WHEN 'condition' THEN 'Condition' ELSE 'Observation' END AS resource_type,
  replace(evidence_id, '/', '-') AS resource_id, event_us, available_us, evidence_id AS idempotency_key, CASE WHEN discharge THEN 'discharge_diagnosis' END AS category FROM tl""")
def timeline_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """Timeline facts as stream envelopes."""
    t, _ = timeline_rows(spark, sf)
    e = icu.timeline_envelopes(t, F.col("availability_time"))
    return e.select("patient_id", "encounter_id", "resource_type", F.col("resource.id").alias("resource_id"), F.unix_micros("event_time").alias("event_us"),
                    F.unix_micros("availability_time").alias("available_us"), "idempotency_key", F.col("resource.category").alias("category"))


@query("availability_replay", "JOB-7 FLT-5 PRJ-5", f"""WITH {TL}{replay_sql()}
SELECT stay_id, position, clock_us, score, tier, completeness, missing, array_to_string(ev, ',') AS evidence FROM rep WHERE len(ev) > 0""")
def availability_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Score after every fact in the order facts became known."""
    t, _ = timeline_rows(spark, sf)
    return ST.snapshots(ST.replayed(t)).select("stay_id", "position", "clock_us", "score", "tier", "completeness",
                                              joined("missing_components").alias("missing"), joined("evidence_ids").alias("evidence"))


@query("unmapped_observations", "AGG-24", f"""WITH {TL}
SELECT stay_id, count(*) FILTER (NOT discharge AND (kind = 'condition' OR code = '3150-0')) AS unmapped FROM tl GROUP BY stay_id""")
def unmapped(spark: SparkSession, sf: str) -> DataFrame:
    """Facts per stay that no scorer reads."""
    t, _ = timeline_rows(spark, sf)
    return ST.replayed(t).groupBy("stay_id").agg(F.count_if("unmapped").alias("unmapped"))


@query("leakage_check", "JOI-10", f"""WITH {TL}{replay_sql()}{replay_sql('event_us, evidence_id', 'event_us', 'x')},
u AS (SELECT 'availability' AS replay, stay_id, clock_us, unnest(ev) AS evidence_id FROM rep UNION ALL SELECT 'charted', stay_id, clock_us, unnest(ev) FROM xrep)
SELECT replay, 'not_yet_available' AS violation, count(*) AS n FROM u JOIN tl USING (stay_id, evidence_id) WHERE available_us > clock_us GROUP BY replay""")
def leakage_check(spark: SparkSession, sf: str) -> DataFrame:
    """Future evidence used by the availability replay (none) and by a replay in charted order."""
    t, _ = timeline_rows(spark, sf)
    good = ST.leakage(ST.snapshots(ST.replayed(t)), t).withColumn("replay", F.lit("availability"))
    bad = ST.leakage(ST.snapshots(ST.replayed(t, ("event_us", "evidence_id"))), t).withColumn("replay", F.lit("charted"))
    return good.unionByName(bad).groupBy("replay", "violation").agg(F.count(F.lit(1)).alias("n"))


H = "3600000000::BIGINT"
SIGNALS = TL + replay_sql() + f""",
crs AS (SELECT stay_id, position, event_us AS c_us, evidence_id AS c_ev, reading AS v FROM rep WHERE kind <> 'condition' AND code = '2160-0'),
k1 AS (SELECT r.stay_id, r.position, r.clock_us, arg_max(c.v, {{'a': c.c_us, 'b': c.c_ev}}) AS cur, arg_max(c.c_ev, {{'a': c.c_us, 'b': c.c_ev}}) AS cur_ev,
    min(c.v) FILTER (c.c_us >= r.clock_us - 48 * {H}) AS ref48 FROM rep r JOIN crs c ON c.stay_id = r.stay_id AND c.position <= r.position GROUP BY ALL),
k2 AS (SELECT k.*, min(c.v) FILTER (c.c_ev <> k.cur_ev) AS oth, min(c.v) AS anyv FROM k1 k LEFT JOIN crs c ON c.stay_id = k.stay_id AND c.position <= k.position
    AND c.c_us >= k.clock_us - 168 * {H} GROUP BY ALL),
k3 AS (SELECT *, coalesce(oth, anyv) AS base FROM k2),
kid AS (SELECT *, 2 * CASE WHEN cur >= 4 OR cur / base >= 3 THEN 3 WHEN cur / base >= 2 THEN 2 WHEN cur / base >= 1.5 OR cur - ref48 >= 0.3 THEN 1 ELSE 0 END AS score FROM k3),
sg AS (SELECT stay_id, position, 'sofa-deterioration' AS indicator, clock_us, score, tier, positive, '0' AS o FROM rep WHERE len(ev) > 0 AND tier <> 'none'
  UNION ALL SELECT stay_id, position, 'aki', clock_us, score, {tier_sql('score', '2', 4, 6)}, 1, '1' FROM kid WHERE score >= 2),
sgs AS (SELECT *, lpad(position::VARCHAR, 12, '0') || '-' || o || '-' || indicator || '-' || stay_id AS alert_id FROM sg)"""


def ablation_sql(candidates, stays_where: str = "true") -> str:
    gov = [c for c in candidates if c.governed]
    free = [c for c in candidates if not c.governed]
    values = ", ".join("('%s', %s)" % (c.candidate_id, ", ".join(_lit(getattr(c.governance, k)) for k in _KNOBS)) for c in gov)
    arb = ", ".join(f"'{c.candidate_id}'" for c in candidates if c.use_episodes)
    everything = "".join(f" UNION ALL SELECT stay_id, '{c.candidate_id}', indicator, alert_id, clock_us, tier, true, CASE WHEN tier IN ('urgent','critical') "
                         f"THEN 'interruptive' ELSE 'passive' END FROM sgs" for c in free)
    names = ", ".join(f"('{c.candidate_id}')" for c in candidates)
    return f"""WITH RECURSIVE {SIGNALS},
cand(config_id, {', '.join('k_' + k for k in _KNOBS)}) AS (VALUES {values}),
src AS (SELECT stay_id || '#' || config_id || '#' || indicator AS pk, row_number() OVER (PARTITION BY stay_id, config_id, indicator ORDER BY clock_us, alert_id) AS rn,
    clock_us AS event_us, 'Encounter/' || stay_id AS enc, score, tier, NULL::VARCHAR AS flag, positive, NULL::VARCHAR AS quality, alert_id, indicator,
    {', '.join('k_' + k for k in _KNOBS)} FROM sgs, cand),
{governance_sql('src', None)},
ab AS (SELECT split_part(g.pk, '#', 1) AS stay_id, split_part(g.pk, '#', 2) AS config_id, s.indicator, s.alert_id, g.event_us, g.tier, g.emit, g.routing
  FROM gov g JOIN src s ON s.pk = g.pk AND s.rn = g.rn{everything}),
sig AS (SELECT stay_id AS patient_id, config_id AS encounter_key, 'signal' AS event, alert_id AS signal_id, indicator AS signal_type, tier AS severity, routing, event_us, NULL::INT AS score
  FROM ab WHERE emit AND config_id IN ({arb})),
{episode_sql()},
epc AS (SELECT split_part(pk, '#', 1) AS stay_id, split_part(pk, '#', 2) AS config_id, max(no)::BIGINT AS episodes FROM ep WHERE rn > 0 GROUP BY ALL
  UNION ALL SELECT stay_id, config_id, count(*) FROM ab WHERE emit AND config_id NOT IN ({arb}) GROUP BY ALL),
st AS (SELECT stay_id, any_value(user_id) AS user_id, CASE any_value(user_id) % 3 WHEN 0 THEN 'development' WHEN 1 THEN 'calibration' ELSE 'test' END AS split,
    CASE WHEN any_value(user_id) % 2 = 0 THEN min(event_us) FILTER (k BETWEEN 90 AND 96) END AS onset,
    greatest((max(event_us) - min(event_us)) / 86400000000.0::DOUBLE, 1 / 24.0::DOUBLE) AS days FROM tl GROUP BY stay_id),
pt AS (SELECT stay_id, bool_or(completeness = 'partial') AS partial FROM rep WHERE len(ev) > 0 GROUP BY stay_id),
nv AS (SELECT s.stay_id, count(*) FILTER (indicator <> 'aki') AS naive_alerts, count(*) FILTER (indicator <> 'aki' AND tier IN ('urgent','critical')) AS naive_interruptive,
    bool_or(indicator <> 'aki' AND clock_us BETWEEN onset - 12 * {H} AND onset + 6 * {H}) AS naive_hit FROM sgs s JOIN st USING (stay_id) GROUP BY ALL),
gv AS (SELECT a.stay_id, a.config_id, count(*) AS governed_alerts, count(*) FILTER (routing = 'interruptive') AS interruptive_alerts,
    min(event_us) FILTER (event_us BETWEEN onset - 12 * {H} AND onset + 6 * {H}) AS governed_first,
    bool_or(routing = 'interruptive' AND event_us BETWEEN onset - 12 * {H} AND onset + 6 * {H}) AS page_hit FROM ab a JOIN st USING (stay_id) WHERE emit GROUP BY ALL),
rw AS (SELECT st.*, c.config_id, coalesce(naive_alerts, 0) AS naive_alerts, coalesce(naive_interruptive, 0) AS naive_interruptive, coalesce(naive_hit, false) AS naive_hit,
    coalesce(governed_alerts, 0) AS governed_alerts, coalesce(interruptive_alerts, 0) AS interruptive_alerts, governed_first, coalesce(page_hit, false) AS page_hit,
    coalesce(episodes, 0) AS episodes, coalesce(partial, false) AS partial
  FROM st JOIN (VALUES {names}) c(config_id) ON true LEFT JOIN nv USING (stay_id) LEFT JOIN gv USING (stay_id, config_id) LEFT JOIN epc USING (stay_id, config_id)
  LEFT JOIN pt USING (stay_id) WHERE {stays_where}),
s0 AS (SELECT config_id, count(*) AS stays, count(onset) AS labeled, count(*) FILTER (onset IS NOT NULL AND naive_hit) AS naive_found,
    count(*) FILTER (onset IS NOT NULL AND governed_first IS NOT NULL) AS governed_found, count(*) FILTER (onset IS NOT NULL AND page_hit) AS page_found,
    sum(naive_alerts)::BIGINT AS naive_alerts, sum(naive_interruptive)::BIGINT AS naive_interruptive, sum(governed_alerts)::BIGINT AS governed_alerts,
    sum(interruptive_alerts)::BIGINT AS interruptive_alerts, sum(episodes)::BIGINT AS episodes, count(*) FILTER (onset IS NULL AND episodes > 0) AS false_episodes,
    sum(days) AS patient_days, avg((onset - governed_first) / 3600000000.0::DOUBLE) AS mean_lead_hours, count(*) FILTER (partial) AS partial_stays FROM rw GROUP BY config_id),
sm AS (SELECT *, naive_found / nullif(labeled, 0) AS naive_sensitivity, governed_found / nullif(labeled, 0) AS governed_sensitivity, page_found / nullif(labeled, 0) AS interruptive_sensitivity,
    coalesce(interruptive_alerts / nullif(naive_interruptive, 0), interruptive_alerts / nullif(naive_alerts, 0)) AS interruptive_reduction,
    interruptive_alerts / nullif(page_found, 0) AS interruptive_nna, 100 * governed_alerts / patient_days AS alerts_per_100_days,
    100 * interruptive_alerts / patient_days AS pages_per_100_days, 100 * episodes / patient_days AS episodes_per_100_days FROM s0),
su AS (SELECT *, coalesce(governed_sensitivity >= naive_sensitivity - 0.10 OR governed_sensitivity >= 0.70, false) AS meets_pe1,
    coalesce(interruptive_reduction <= 0.25, false) AS meets_pe2 FROM sm)"""


def summary(spark: SparkSession, sf: str, candidates, split: str, command: str) -> DataFrame:
    t, stays = timeline_rows(spark, sf)
    stays = ST.on_split(stays, split, command)
    t = t.join(stays.select("stay_id"), "stay_id", "left_semi")
    hot = latest.is_hot(t, ["stay_id"], None)
    # Governance, episodes and the stay rows all read the signals; they are written once.
    signals = checkpointed(ST.study_signals(t, hot))
    ablation = checkpointed(ST.ablated(signals, candidates, hot))
    partial = ST.snapshots(ST.replayed(t, hot=hot)).groupBy("stay_id").agg(F.max(F.col("completeness") == "partial").alias("partial"))
    stays = stays.join(partial, "stay_id", "left").withColumn("partial", F.coalesce("partial", F.lit(False)))
    return ST.summarise(ST.stay_results(signals, ablation, ST.episode_counts(ablation, candidates, hot), stays, candidates))


_INTS = ("stays", "labeled", "naive_alerts", "naive_interruptive", "governed_alerts", "interruptive_alerts", "episodes", "false_episodes", "partial_stays")
_FLTS = ("naive_sensitivity", "governed_sensitivity", "interruptive_sensitivity", "interruptive_reduction", "interruptive_nna", "mean_lead_hours",
         "alerts_per_100_days", "pages_per_100_days", "episodes_per_100_days")


def _r(c: str):
    return F.round(F.col(c) + F.lit(1e-9), 5).alias(c)


def _rs(c: str) -> str:
    return f"round({c} + 1e-9, 5)::DOUBLE AS {c}"


@query("study_ablations", "JOB-8 JOB-9 AGG-10 AGG-27 SET-1 GOV-15", f"""{ablation_sql(ABLATIONS, "split = 'test'")}
SELECT config_id, {', '.join(_INTS)}, {', '.join(map(_rs, _FLTS))}, meets_pe1, meets_pe2 FROM su""")
def study_ablations(spark: SparkSession, sf: str) -> DataFrame:
    """Ten ablations on the locked test split, indicators governed independently."""
    return summary(spark, sf, ABLATIONS, "temporal-holdout", "locked_ablation_eval").select(
        "config_id", *_INTS, *[_r(c) for c in _FLTS], "meets_pe1", "meets_pe2")


@query("operating_point", "JOB-9 SRT-5 JOB-10", f"""{ablation_sql(SELECTION_CANDIDATES, "split = 'calibration'")}
SELECT config_id, meets_pe1, {_rs('interruptive_reduction')}, {_rs('governed_sensitivity')} FROM su
WHERE meets_pe1 OR NOT (SELECT bool_or(meets_pe1) FROM su)
ORDER BY coalesce(su.interruptive_reduction, 1), coalesce(su.interruptive_nna, 1e9), coalesce(su.governed_sensitivity, -1) DESC, config_id LIMIT 1""")
def operating_point(spark: SparkSession, sf: str) -> DataFrame:
    """Operating point chosen on the calibration split."""
    best = ST.pick_operating_point(summary(spark, sf, SELECTION_CANDIDATES, "val", "operating_point_selection"))
    return best.select("config_id", "meets_pe1", _r("interruptive_reduction"), _r("governed_sensitivity"))


@query("study_cohort_flow", "AGG-27 JOB-10", f"""WITH {TL}
SELECT CASE user_id % 3 WHEN 0 THEN 'development' WHEN 1 THEN 'calibration' ELSE 'test' END AS split, count(DISTINCT stay_id) AS stays,
  count(DISTINCT user_id) AS subjects, count(DISTINCT CASE WHEN user_id % 2 = 0 AND k BETWEEN 90 AND 96 THEN stay_id END) AS septic_stays FROM tl GROUP BY 1""")
def study_cohort_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Stays, subjects and labels per study split."""
    docs = documents(spark, sf)
    return docs.groupBy(ST.split_column(F.col("split_id")).alias("split")).agg(
        F.count(F.lit(1)).alias("stays"), F.countDistinct("subject_id").alias("subjects"), F.count("labels.sepsis3_onset").alias("septic_stays"))
