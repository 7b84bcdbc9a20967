"""Hourly cohort queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalog.base import POINTS, POSITIVE, PRESENT, READINGS, TOTAL, governance_sql, joined, query, tier_sql
from wardline.operators.skyline import on_skyline
from wardline.plans import cohort as C
from wardline.rules import PROFILES, profile, sweep_grid
from wardline.session import checkpointed, new_path
from wardline.sources import projection as P

SWEEP = sweep_grid()
RANKED = ("strict", "accuracy", "dual", "balanced")

_FILL = ", ".join(
    f"last_value(CASE WHEN {c} THEN {v} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY iculos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {n}"
    for c, v, n in (("code = '8478-0'", "reading", "map_mmhg"), ("code = '777-3'", "reading", "platelets"), ("code = '1975-2'", "reading", "bilirubin"),
                    ("code = '2160-0'", "reading", "creatinine"), ("code = '2708-6'", "reading", "o2sat"), ("code = '3150-0'", "reading / 100", "fio2"),
                    ("code = '9269-2' AND k % 2 = 0", "85 + reading", "sao2")))
HOURS = READINGS + f""",
h0 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_us, event_id) AS iculos FROM rd),
h1 AS (SELECT 'p' || user_id AS stay_id, iculos, min(CASE WHEN k >= 97 THEN iculos END) OVER (PARTITION BY user_id) AS onset, NULL::INT AS gcs, {_FILL} FROM h0),
h2 AS (SELECT *, coalesce(o2sat, sao2) AS spo2 FROM h1),
h3 AS (SELECT *, {POINTS} FROM h2),
hs AS (SELECT stay_id, iculos, onset, {PRESENT} AS n_present, {TOTAL} AS total, {POSITIVE} AS positive FROM h3)"""

_KNOBS = ("trajectory_persistence_minutes", "min_crossings", "baseline_enabled", "baseline_delta_threshold", "baseline_lookback_hours",
          "refractory_minutes", "resolution_gap_minutes", "page_gate_enabled", "page_min_crossings", "page_trajectory_persistence_minutes",
          "page_min_score_delta", "page_min_positive_components", "page_min_newly_worsened_components", "page_min_component_delta",
          "reject_late_out_of_order")


def _lit(v) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v)


def cohort_sql(candidates, where: str = "true") -> str:
    """Governed hours ``gh`` and stay rows ``sr`` of the candidates."""
    values = ", ".join("('%s', %d, %s)" % (c.candidate_id, c.min_components, ", ".join(_lit(getattr(c.governance, k)) for k in _KNOBS)) for c in candidates)
    ins = ", ".join(f"min(iculos) FILTER ({cond} AND iculos BETWEEN onset - {b} AND onset + {a}) AS {n}_in_m{b}_p{a}"
                    for n, cond in _LANES.items() for b, a in ((12, 6), (12, 12)))
    firsts = ", ".join(f"count(*) FILTER ({cond}) AS {n}_count, min(iculos) FILTER ({cond}) AS first_{n}, max(iculos) FILTER ({cond}) AS last_{n}"
                       for n, cond in _LANES.items())
    return f"""WITH RECURSIVE {HOURS},
cand(config_id, need, {', '.join('k_' + k for k in _KNOBS)}) AS (VALUES {values}),
src AS (SELECT stay_id || '#' || config_id AS pk, iculos AS rn, iculos * 3600000000::BIGINT AS event_us, 'Encounter/' || stay_id AS enc,
    CASE WHEN n_present >= need THEN total END AS score, {tier_sql('(CASE WHEN n_present >= need THEN total END)')} AS tier,
    NULL::VARCHAR AS flag, positive, NULL::VARCHAR AS quality, {', '.join('k_' + k for k in _KNOBS)} FROM hs, cand WHERE {where}),
{governance_sql('src', None)},
gh AS (SELECT split_part(pk, '#', 1) AS stay_id, split_part(pk, '#', 2) AS config_id, rn AS iculos, emit, reason, routing, tier, score FROM gov WHERE rn > 0),
on1 AS (SELECT DISTINCT stay_id, onset FROM hs),
sr AS (SELECT config_id, stay_id, any_value(onset) AS onset, count(*) AS hours, count(score) AS scored_hours, {firsts}, {ins},
    list_distinct(list(reason)) AS reasons, arg_max(reason, iculos) AS last_reason FROM gh JOIN on1 USING (stay_id) GROUP BY ALL)"""


_LANES = {"naive": "tier <> 'none'", "governed": "emit", "watch": "emit AND routing = 'passive'", "interruptive": "emit AND routing = 'interruptive'"}


def evaluated(spark: SparkSession, sf: str, candidates) -> DataFrame:
    return C.evaluate_hours(P.hourly_stays(spark, sf), candidates)


def rollup(spark: SparkSession, sf: str, candidates) -> DataFrame:
    return C.stay_rows(evaluated(spark, sf, candidates))


BALANCED, STRICTP = [profile("balanced")], [profile("strict")]


@query("cohort_stay_rows", "AGG-2 AGG-5 JOB-3 WIN-1 WIN-5", f"""{cohort_sql(BALANCED)}
SELECT stay_id, onset AS onset_iculos, hours, naive_count, governed_count, watch_count, interruptive_count, first_naive, first_governed, first_watch,
  first_interruptive, last_governed, governed_in_m12_p6, governed_in_m12_p12 FROM sr""")
def cohort_stay_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Alert counts and hours per stay and lane under the balanced profile."""
    return rollup(spark, sf, BALANCED).select(
        "stay_id", "onset_iculos", "hours", *[f"{n}_count" for n in C.LANES], *[f"first_{n}" for n in C.LANES], "last_governed",
        "governed_in_m12_p6", "governed_in_m12_p12")


_D = {n: f"(onset IS NOT NULL AND {n}_in_m12_p6 IS NOT NULL)" for n in ("naive", "governed", "interruptive")}


def _metrics_select(group: str = "config_id") -> str:
    tp = ", ".join(f"count(*) FILTER {d} AS {n}_tp, count(*) FILTER (onset IS NULL AND {n}_count > 0) AS {n}_fp, avg(onset - first_{n}) AS mean_lead_{n}"
                   for n, d in _D.items())
    return f"""m0 AS (SELECT {group}, count(*) AS stays, count(onset) AS sepsis_stays, sum(hours)::BIGINT AS patient_hours,
  {', '.join(f'sum({n}_count)::BIGINT AS {n}_alerts' for n in _LANES)}, {tp},
  coalesce(sum(governed_count) FILTER (onset IS NOT NULL), 0)::BIGINT AS governed_alerts_on_sepsis,
  coalesce(sum(interruptive_count) FILTER (onset IS NOT NULL), 0)::BIGINT AS interruptive_alerts_on_sepsis,
  avg(onset - governed_in_m12_p6) AS mean_lead_in_window, count(*) FILTER (first_governed <= onset + 6) AS grace6_governed_tp,
  count(*) FILTER (first_governed < onset) AS early_governed_tp, count(*) FILTER (onset IS NOT NULL AND governed_in_m12_p12 IS NOT NULL) AS pm12_governed_tp,
  {', '.join(f'quantile_cont(onset - governed_in_m12_p6, 0.{p}) AS lead_in_window_p{p}, quantile_cont(onset - first_governed, 0.{p}) AS lead_governed_p{p}' for p in (25, 50, 75))}
  FROM sr GROUP BY ALL),
mm AS (SELECT *, naive_tp / nullif(sepsis_stays, 0) AS naive_sensitivity, governed_tp / nullif(sepsis_stays, 0) AS governed_sensitivity,
  interruptive_tp / nullif(sepsis_stays, 0) AS interruptive_sensitivity, coalesce(governed_alerts / nullif(naive_alerts, 0), 0) AS alert_reduction_ratio,
  coalesce(interruptive_alerts / nullif(naive_alerts, 0), 0) AS interruptive_reduction_ratio, governed_alerts / (patient_hours / 24) AS governed_per_patient_day,
  interruptive_alerts / (patient_hours / 24) AS interruptive_per_patient_day, naive_alerts / nullif(naive_tp, 0) AS naive_nna,
  governed_alerts / nullif(governed_tp, 0) AS governed_nna, interruptive_alerts / nullif(interruptive_tp, 0) AS interruptive_nna,
  interruptive_alerts / nullif(governed_tp, 0) AS interruptive_nna_per_governed_tp, governed_tp / nullif(governed_tp + governed_fp, 0) AS governed_ppv_stay,
  interruptive_tp / nullif(interruptive_tp + interruptive_fp, 0) AS interruptive_ppv_stay, governed_alerts_on_sepsis / nullif(governed_alerts, 0) AS governed_ppv_event,
  interruptive_alerts_on_sepsis / nullif(interruptive_alerts, 0) AS interruptive_ppv_event FROM m0)"""


_COUNTS = ("stays", "sepsis_stays", "patient_hours", "naive_alerts", "governed_alerts", "watch_alerts", "interruptive_alerts", "naive_tp", "governed_tp",
           "interruptive_tp", "naive_fp", "governed_fp", "interruptive_fp", "grace6_governed_tp", "early_governed_tp", "pm12_governed_tp")
_REALS = ("naive_sensitivity", "governed_sensitivity", "interruptive_sensitivity", "alert_reduction_ratio", "interruptive_reduction_ratio",
          "governed_per_patient_day", "interruptive_per_patient_day", "naive_nna", "governed_nna", "interruptive_nna", "interruptive_nna_per_governed_tp",
          "governed_ppv_stay", "interruptive_ppv_stay", "governed_ppv_event", "interruptive_ppv_event", "mean_lead_in_window", "mean_lead_naive",
          "mean_lead_governed", "mean_lead_interruptive", "lead_in_window_p25", "lead_in_window_p50", "lead_in_window_p75", "lead_governed_p25",
          "lead_governed_p50", "lead_governed_p75")


def _r(c: str):
    return F.round(F.col(c) + F.lit(1e-9), 6).alias(c)


def _rs(c: str) -> str:
    return f"round({c} + 1e-9, 6)::DOUBLE AS {c}"


FIVE = [profile(p) for p in PROFILES]


@query("cohort_metrics", "AGG-3 AGG-4 JOB-3 GOV-15", f"""{cohort_sql(FIVE)}, {_metrics_select()}
SELECT config_id, {', '.join(_COUNTS)}, {', '.join(map(_rs, _REALS))} FROM mm""")
def cohort_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Detection, burden and lead time of all five profiles; hours are scored once."""
    return C.cohort_metrics(rollup(spark, sf, FIVE)).select("config_id", *_COUNTS, *[_r(c) for c in _REALS])


@query("cohort_timing", "AGG-6", f"""{cohort_sql(FIVE)}
SELECT config_id, CASE WHEN onset IS NULL THEN 'non_sepsis' WHEN governed_in_m12_p6 IS NOT NULL THEN 'in_window' WHEN first_governed IS NULL THEN 'missed'
  WHEN last_governed < onset - 12 THEN 'too_early' WHEN first_governed > onset + 6 THEN 'late' ELSE 'outside_window' END AS timing, count(*) AS n,
  sum(governed_in_m12_p6)::BIGINT AS first_hours FROM sr GROUP BY ALL""")
def cohort_timing(spark: SparkSession, sf: str) -> DataFrame:
    """Stays by where their alerts lie relative to the primary window."""
    return rollup(spark, sf, FIVE).groupBy("config_id", C.timing_class().alias("timing")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("governed_in_m12_p6").alias("first_hours"))


def _u(pred: str) -> str:
    d = "(iculos - 1 - (onset - 1 + 6))"
    return (f"CASE WHEN onset IS NOT NULL AND {d} > 3 THEN 0 WHEN onset IS NOT NULL AND {pred} THEN CASE WHEN {d} <= -6 THEN greatest({d} / 6.0::DOUBLE + 2, -0.05) "
            f"ELSE {d} / -9.0::DOUBLE + 1 / 3.0::DOUBLE END WHEN onset IS NOT NULL THEN CASE WHEN {d} <= -6 THEN 0 ELSE {d} * -2 / 9.0::DOUBLE - 4 / 3.0::DOUBLE END "
            f"WHEN {pred} THEN -0.05 ELSE 0 END")


@query("cohort_utility", "AGG-7 AGG-8 JOI-9", f"""{cohort_sql(FIVE)},
u AS (SELECT config_id, sum({_u('emit')}) AS observed, sum({_u('(iculos >= greatest(onset - 6, 1) AND iculos <= onset + 9)')}) AS best, sum({_u('false')}) AS inaction
  FROM gh JOIN on1 USING (stay_id) GROUP BY config_id)
SELECT config_id, {_rs('observed')}, {_rs('best')}, {_rs('inaction')}, round((observed - inaction) / (best - inaction) + 1e-9, 6)::DOUBLE AS normalised FROM u""")
def cohort_utility(spark: SparkSession, sf: str) -> DataFrame:
    """Time-dependent utility of the governed alerts of each profile."""
    hours = P.hourly_stays(spark, sf)
    names = F.array(*[F.lit(c.candidate_id) for c in FIVE])
    grid = hours.select("stay_id", "iculos", "sepsis_label", F.explode(names).alias("config_id"))
    pred = C.predictions(grid, C.evaluate_hours(hours, FIVE).where("emit"), ("config_id", "stay_id"))
    return C.utility(pred, keys=["config_id"]).select("config_id", *[_r(c) for c in ("observed", "best", "inaction", "normalised")])


_BOOT = ", ".join(f"('{m}', {m})" for m in C.BOOTSTRAP_METRICS)


@query("bootstrap_intervals", "AGG-9", f"""{cohort_sql(BALANCED)},
ix AS (SELECT *, row_number() OVER (ORDER BY stay_id) - 1 AS idx, count(*) OVER () AS n_all FROM sr),
dr AS (SELECT b.r AS replicate, ('0x' || substr(md5(b.r || '|' || ix.idx), 1, 15))::BIGINT % n_all AS idx FROM ix, range(1, 1001) b(r)),
sr2 AS (SELECT dr.replicate, s.* FROM dr JOIN ix s ON s.idx = dr.idx),
{_metrics_select('replicate').replace('FROM sr GROUP', 'FROM sr2 GROUP')},
long AS (SELECT metric, value FROM mm, LATERAL (VALUES {_BOOT}) v(metric, value) WHERE value IS NOT NULL)
SELECT metric, round(quantile_cont(value, 0.025) + 1e-9, 6)::DOUBLE AS low, round(quantile_cont(value, 0.975) + 1e-9, 6)::DOUBLE AS high,
  round(avg(value) + 1e-9, 6)::DOUBLE AS mean, count(*) AS n FROM long GROUP BY metric""")
def bootstrap_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Percentile intervals of twelve metrics over a thousand stay-level resamples."""
    return C.bootstrap_intervals(rollup(spark, sf, BALANCED)).select("metric", _r("low"), _r("high"), _r("mean"), "n")


@query("knob_sweep", "JOB-4 SRT-4", f"""{cohort_sql(SWEEP)}, {_metrics_select()},
g AS (SELECT *, config_id IN ({', '.join(f"'{c.candidate_id}'" for c in SWEEP if c.governance.page_gate_enabled)}) AS gated FROM mm),
b AS (SELECT *, CASE WHEN gated THEN interruptive_reduction_ratio ELSE alert_reduction_ratio END AS burden,
  coalesce(CASE WHEN gated THEN interruptive_nna ELSE governed_nna END, 1e9) AS nna,
  coalesce(governed_sensitivity >= 0.70 OR governed_sensitivity >= naive_sensitivity - 0.10, false) AS meets_primary FROM g)
SELECT config_id, meets_primary, burden <= 0.25 AS meets_coprimary, {_rs('burden')}, {_rs('nna')}, {_rs('governed_sensitivity')} FROM b""")
def knob_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """All 23 candidates, scored once and ranked."""
    m = C.ranked(C.cohort_metrics(rollup(spark, sf, SWEEP), percentiles=False), SWEEP)
    return m.select("config_id", "meets_primary", "meets_coprimary", _r("burden"), _r("nna"), _r("governed_sensitivity"))


_BURDEN_SQL = f"""{cohort_sql(SWEEP)}, {_metrics_select()},
b AS (SELECT *, CASE WHEN config_id IN ({', '.join(f"'{c.candidate_id}'" for c in SWEEP if c.governance.page_gate_enabled)}) THEN interruptive_reduction_ratio ELSE alert_reduction_ratio END AS burden FROM mm)"""


@query("operating_point_pareto", "AGG-27 SRT-4", f"""{_BURDEN_SQL}
SELECT config_id, {_rs('burden')}, {_rs('governed_sensitivity')}, NOT EXISTS (SELECT 1 FROM b o WHERE o.burden <= b.burden AND o.governed_sensitivity >= b.governed_sensitivity
  AND (o.burden < b.burden OR o.governed_sensitivity > b.governed_sensitivity)) AS on_front FROM b""")
def operating_point_pareto(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates by burden and sensitivity, and those that no other beats in both."""
    m = C.ranked(C.cohort_metrics(rollup(spark, sf, SWEEP), percentiles=False), SWEEP)
    return on_skyline(checkpointed(m.select("config_id", "burden", "governed_sensitivity")), "burden", "governed_sensitivity", "on_front").select(
        "config_id", _r("burden"), _r("governed_sensitivity"), "on_front")


@query("stay_front", "AGG-27", f"""{cohort_sql(BALANCED)}
SELECT stay_id, hours, governed_count, NOT EXISTS (SELECT 1 FROM sr o WHERE o.governed_count <= s.governed_count AND o.hours >= s.hours
  AND (o.governed_count < s.governed_count OR o.hours > s.hours)) AS on_front FROM sr s""")
def stay_front(spark: SparkSession, sf: str) -> DataFrame:
    """Stays by alerts and hours: the longest stays for how few alerts they had."""
    rows = checkpointed(rollup(spark, sf, BALANCED).select("stay_id", "hours", "governed_count"))
    return on_skyline(rows, "governed_count", "hours", "on_front")


@query("frozen_holdout", "JOB-5", f"""{cohort_sql(STRICTP, "CAST(substr(stay_id, 2) AS INT) % 2 = 1")}, {_metrics_select()}
SELECT config_id, stays, sepsis_stays, governed_alerts, governed_tp, {_rs('governed_sensitivity')} FROM mm""")
def frozen_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """A candidate frozen with its hash, read back, verified and run once on the hold-out stays."""
    path = new_path(spark, "frozen")
    C.freeze(spark, STRICTP[0], path)
    chosen = C.load_frozen(spark, path)
    hours = P.hourly_stays(spark, sf).where("cast(substring(stay_id, 2) AS int) % 2 = 1")
    return C.cohort_metrics(C.stay_rows(C.evaluate_hours(hours, [chosen]))).select(
        "config_id", "stays", "sepsis_stays", "governed_alerts", "governed_tp", _r("governed_sensitivity"))


_RANKED = [profile(p) for p in RANKED]
_MODE_SQL = {"window_m12_p6": "{n}_in_m12_p6 IS NOT NULL", "grace_0": "first_{n} <= onset", "grace_6": "first_{n} <= onset + 6",
             "grace_12": "first_{n} <= onset + 12", "early_only": "first_{n} < onset", "window_pm12": "{n}_in_m12_p12 IS NOT NULL"}


def _mode_union() -> str:
    return " UNION ALL ".join(
        f"SELECT '{m}' AS mode, config_id, count(onset) AS sepsis_stays, " + ", ".join(
            f"count(*) FILTER (onset IS NOT NULL AND {c.format(n=n)}) AS {n}_tp" for n in ("naive", "governed", "interruptive")) + " FROM sr GROUP BY config_id"
        for m, c in _MODE_SQL.items())


@query("definition_robustness", "JOB-6 AGG-26 AGG-5", f"""{cohort_sql(_RANKED)}, t AS ({_mode_union()})
SELECT mode, config_id, naive_tp, governed_tp, interruptive_tp, round(governed_tp / nullif(sepsis_stays, 0) + 1e-9, 6)::DOUBLE AS governed_sensitivity,
  row_number() OVER (PARTITION BY mode ORDER BY governed_tp / nullif(sepsis_stays, 0) DESC, config_id DESC) AS rank FROM t""")
def definition_robustness(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles under six detection definitions, ranked in each."""
    return C.robustness(rollup(spark, sf, _RANKED)).select(
        "mode", "config_id", "naive_tp", "governed_tp", "interruptive_tp", _r("governed_sensitivity"), "rank")


def _cause(words, extra: str) -> str:
    hit = " OR ".join(f"list_contains(reasons, '{w}') OR last_reason LIKE '%{w}%'" for w in words)
    return f"({hit}{extra})"


_CAUSES = "list_filter([" + ", ".join(
    f"CASE WHEN {_cause(w, ' OR scored_hours = 0' if c == 'missing_input' else ' OR governed_count > 0' if c == 'timing_window' else '')} THEN '{c}' END"
    for c, w in C.MISS_CAUSES.items()) + "], lambda x: x IS NOT NULL)"


@query("miss_attribution", "AGG-13", f"""{cohort_sql(STRICTP)},
a AS (SELECT stay_id, {_CAUSES} AS m FROM sr WHERE onset IS NOT NULL AND governed_in_m12_p6 IS NULL),
b AS (SELECT stay_id, CASE WHEN len(m) = 0 THEN ['timing_window'] ELSE m END AS m FROM a)
SELECT stay_id, m[1] AS primary_reason, array_to_string(m[2:], ',') AS contributing FROM b""")
def miss_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """Why septic stays were missed under the strict profile."""
    rows = rollup(spark, sf, STRICTP).where(F.col("sepsis") & F.col("governed_in_m12_p6").isNull())
    return C.attribute_misses(rows).select("stay_id", "primary_reason", joined("contributing").alias("contributing"))


@query("miss_table", "AGG-13", f"""{cohort_sql(STRICTP)},
a AS (SELECT stay_id, {_CAUSES} AS m FROM sr WHERE onset IS NOT NULL AND governed_in_m12_p6 IS NULL),
b AS (SELECT coalesce(m[1], 'timing_window') AS primary_reason FROM a)
SELECT primary_reason, count(*) AS n, round(count(*) / (SELECT count(*) FROM b), 4) AS rate FROM b GROUP BY primary_reason""")
def miss_table(spark: SparkSession, sf: str) -> DataFrame:
    """Missed stays by deciding cause."""
    rows = rollup(spark, sf, STRICTP).where(F.col("sepsis") & F.col("governed_in_m12_p6").isNull())
    return C.miss_table(C.attribute_misses(rows))
