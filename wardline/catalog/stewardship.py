"""Feedback, uncertainty, grounding and drift queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalog.base import READINGS, SCORED, joined, query
from wardline.functions.scores import SOFA_COMPONENTS
from wardline.operators import latest
from wardline.operators.quantiles import quantiles
from wardline.plans import snapshots as snap
from wardline.plans import stewardship as SW
from wardline.plans import study as ST
from wardline.plans import uncertainty as U
from wardline.sources import projection as P

_FB = {
    "text": """CASE k % 12 WHEN 0 THEN 'Team already aware, known to team' WHEN 1 THEN 'Antibiotics started, on protocol' WHEN 2 THEN 'Chronic baseline for ESRD'
      WHEN 3 THEN 'Wrong lab, unit error' WHEN 4 THEN 'Appropriate but not actionable' WHEN 5 THEN 'wrong team - not my patient' WHEN 6 THEN 'Duplicate, paged again'
      WHEN 7 THEN 'Good catch, HELPFUL' WHEN 8 THEN '   ' WHEN 9 THEN 'thanks' WHEN 10 THEN 'chronic artifact' ELSE 'repeated: already treated elsewhere' END""",
    "site_id": "CASE user_id % 3 WHEN 0 THEN 'north' WHEN 1 THEN 'south' END",
    "service": "CASE WHEN k % 2 = 0 THEN 'icu' WHEN k % 2 = 1 AND k % 3 = 0 THEN 'ward' END",
    "indicator": "CASE WHEN k % 5 < 3 THEN 'sofa-deterioration' ELSE 'aki' END",
    "rule_bundle_id": "CASE WHEN k % 5 < 3 THEN 'sepsis-sofa' WHEN k % 5 = 3 THEN 'aki-kdigo' END",
    "rule_version": "CASE WHEN k % 7 <> 0 THEN '0.3.0' END",
    "routing": "CASE k % 4 WHEN 0 THEN 'interruptive' WHEN 1 THEN 'passive' WHEN 2 THEN 'none' END",
    "ra": "CASE WHEN k % 11 <> 0 THEN k % 9 END", "rb": "CASE WHEN k % 13 <> 0 THEN CASE WHEN event_id % 2 = 0 THEN k % 9 ELSE CAST(floor(k / 2) AS INT) % 9 END END",
}
_CATS = list(SW.HINTS) + ["other"]


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    f = P.readings(spark, sf).selectExpr("event_id AS feedback_id", *[f"{e} AS {n}" for n, e in _FB.items()])
    names = F.array(*[F.lit(c) for c in _CATS])
    return f.withColumns({"reviewer_a": F.get(names, F.col("ra").cast("int")), "reviewer_b": F.get(names, F.col("rb").cast("int"))}).drop("ra", "rb")


_NHITS = ", ".join("(" + " + ".join(f"(contains(t, '{p}'))::INT" for p in ps) + f") AS h{i}" for i, ps in enumerate(SW.HINTS.values()))
_BEST = "greatest(" + ", ".join(f"h{i} * 100 - {i}" for i in range(len(SW.HINTS))) + ")"
_WHICH = "CASE " + " ".join(f"WHEN h{i} * 100 - {i} = b AND h{i} > 0 THEN '{c}'" for i, c in enumerate(SW.HINTS)) + " ELSE 'abstain' END"
FEEDBACK = READINGS + f""",
f0 AS (SELECT event_id AS feedback_id, {', '.join(f'{e} AS {n}' for n, e in _FB.items())} FROM rd),
f1 AS (SELECT *, lower(trim(text)) AS t, {_CATS}[ra + 1] AS reviewer_a, {_CATS}[rb + 1] AS reviewer_b FROM f0),
f2 AS (SELECT *, {_NHITS} FROM f1), f3 AS (SELECT *, {_BEST} AS b FROM f2),
fc AS (SELECT *, {_WHICH} AS category, CASE WHEN b > 0 THEN least(0.95::DOUBLE, 0.55::DOUBLE + 0.15::DOUBLE * ((b + 7) // 100 - 1)) ELSE 0 END AS confidence FROM f3)"""


@query("feedback_categories", "AGG-14", f"""WITH {FEEDBACK} SELECT feedback_id, category, round(confidence, 6)::DOUBLE AS confidence FROM fc""")
def feedback_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Category of every feedback text by hint phrases."""
    return SW.classify(feedback(spark, sf)).select("feedback_id", "category", F.round("confidence", 6).alias("confidence"))


@query("reviewer_agreement", "AGG-15 JOI-13 JOB-13", f"""WITH {FEEDBACK}
SELECT count(*) AS n_dual_reviewed, count(*) FILTER (reviewer_a = reviewer_b) AS n_agree, count(*) FILTER (reviewer_a = reviewer_b AND category = reviewer_a) AS n_right,
  round(count(*) FILTER (reviewer_a = reviewer_b) / count(*), 4)::DOUBLE AS reviewer_agreement,
  round(count(*) FILTER (reviewer_a = reviewer_b AND category = reviewer_a) / count(*) FILTER (reviewer_a = reviewer_b), 4)::DOUBLE AS classifier_accuracy
FROM fc WHERE reviewer_a IS NOT NULL AND reviewer_b IS NOT NULL""")
def reviewer_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement of two reviewers and of the classifier with their consensus."""
    f = feedback(spark, sf)
    return SW.agreement(f, SW.classify(f))


@query("feedback_counts", "AGG-16 JOB-13", f"""WITH {FEEDBACK},
g AS (SELECT category, coalesce(site_id, 'unknown') AS site, coalesce(service, 'unknown') AS service, indicator, coalesce(rule_bundle_id, '?') || '@' || coalesce(rule_version, '?') AS rule,
  coalesce(routing, 'unknown') AS routing FROM fc)
""" + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS n FROM g GROUP BY {d}" for d in ("category", "site", "service", "indicator", "rule", "routing")))
def feedback_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Feedback by category, site, service, indicator, rule and lane."""
    return SW.aggregate(SW.classify(feedback(spark, sf)))


_EXP = ", ".join(f"('{c}', '{t}', '{k}', '{d}')" for c, t, k, d in SW.EXPERIMENTS)


@query("experiment_proposals", "AGG-17 JOB-13", f"""WITH {FEEDBACK}, e(category, title, knob, proposed_delta) AS (VALUES {_EXP})
SELECT 'prop-' || category AS proposal_id, title, knob, proposed_delta, count(*) AS n_supporting, min(feedback_id) AS first_id, max(feedback_id) AS last_id
FROM fc JOIN e USING (category) GROUP BY ALL""")
def experiment_proposals(spark: SparkSession, sf: str) -> DataFrame:
    """Offline experiments suggested by actionable feedback."""
    return SW.proposals(SW.classify(feedback(spark, sf))).select("proposal_id", "title", "knob", "proposed_delta", "n_supporting", "first_id", "last_id")


# --- uncertainty --------------------------------------------------------------------------------

_ROUTE = "CASE tier WHEN 'critical' THEN 'interruptive' WHEN 'urgent' THEN CASE WHEN event_id % 3 = 0 THEN 'passive' ELSE 'interruptive' END WHEN 'watch' THEN 'passive' ELSE 'none' END"
_NOTE = "CASE event_id % 6 WHEN 0 THEN 'Chronic baseline' WHEN 1 THEN 'hemolyzed sample' WHEN 2 THEN 'on Pathway, treated' WHEN 3 THEN 'spurious, baseline?' END"


def cases(spark: SparkSession, sf: str) -> DataFrame:
    rows = snap.alerts(P.envelopes(spark, sf))
    sev = "CASE WHEN {p} >= 3 THEN 'critical' WHEN {p} = 2 THEN 'urgent' WHEN {p} = 1 THEN 'watch' ELSE 'none' END"
    parts = ", ".join(
        f"named_struct('name', '{c}', 'points', p_{c}, 'missing', p_{c} IS NULL, 'severity', {sev.format(p=f'p_{c}')}, 'evidence_ids', "
        f"if(p_{c} IS NULL OR event_id % 5 = 0, cast(array() AS array<string>), array(concat('{c}/', event_id))))" for c in SOFA_COMPONENTS)
    return rows.withColumns({"component_breakdown": F.expr(f"array({parts})"), "routing": F.expr(_ROUTE), "reviewer_note": F.expr(_NOTE),
                             "evidence_ids": F.expr("if(event_id % 7 = 0 OR event_id % 5 = 0, cast(array() AS array<string>), array(evidence_id))"),
                             "label_positive": F.expr("event_id % 4 = 0")})


_PTS = [f"p_{c}" for c in SOFA_COMPONENTS]
_HI, _LO = "greatest(" + ", ".join(f"least(coalesce({p}, 0), 3)" for p in _PTS) + ")", "least(" + ", ".join(f"least(coalesce({p}, 0), 3)" for p in _PTS) + ")"
CASES = SCORED + f""",
cs AS (SELECT *, {_ROUTE} AS routing, {_NOTE} AS note, event_id % 4 = 0 AS label_positive, list_filter([
    CASE WHEN score IN (2, 3) THEN 'near_threshold' END, CASE WHEN completeness = 'partial' THEN 'partial_completeness' END,
    CASE WHEN missing <> '' AND positive_components > 0 THEN 'conflicting_components' END, CASE WHEN {_HI} - {_LO} >= 2 THEN 'multi_signal_severity_spread' END,
    CASE WHEN tier = 'watch' AND score >= 2 THEN 'watch_with_rising_score' END], lambda x: x IS NOT NULL) AS rs,
    NOT (event_id % 7 = 0 OR event_id % 5 = 0) AS own_ev
  FROM scored WHERE completeness <> 'insufficient_data')"""


@query("uncertain_cases", "AGG-18", f"""WITH {CASES}
SELECT event_id, len(rs) > 0 AS eligible, CASE WHEN len(rs) > 0 THEN array_to_string(rs, ',') ELSE 'not_eligible' END AS reasons FROM cs""")
def uncertain_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Cases eligible for passive context, with reasons."""
    return U.eligibility(cases(spark, sf)).select("event_id", "eligible", joined("reasons").alias("reasons"))


@query("detection_subgroups", "AGG-19", f"""WITH {CASES}, sub AS (
  SELECT 'all' AS subgroup, * FROM cs UNION ALL SELECT 'eligible', * FROM cs WHERE len(rs) > 0 UNION ALL SELECT 'ineligible', * FROM cs WHERE len(rs) = 0
  UNION ALL SELECT 'partial_completeness', * FROM cs WHERE completeness = 'partial' UNION ALL SELECT 'interruptive', * FROM cs WHERE routing = 'interruptive'),
q AS (SELECT subgroup, count(*) AS n_cases, count(*) FILTER (label_positive) AS n_positive, count(*) FILTER (label_positive AND routing <> 'none') AS tp,
  count(*) FILTER (NOT label_positive AND routing <> 'none') AS fp, count(*) FILTER (label_positive AND routing = 'none') AS fn,
  count(*) FILTER (routing = 'interruptive') AS interruptive_burden FROM sub GROUP BY subgroup)
SELECT *, round(tp / nullif(n_positive, 0), 9)::DOUBLE AS sensitivity, round(tp / nullif(tp + fp, 0), 9)::DOUBLE AS ppv FROM q""")
def detection_subgroups(spark: SparkSession, sf: str) -> DataFrame:
    """Detection statistics overall and per subgroup."""
    e = U.eligibility(cases(spark, sf))
    out = U.detection_stats(e, {"all": F.lit(True), "eligible": F.col("eligible"), "ineligible": ~F.col("eligible"),
                                "partial_completeness": F.col("completeness") == "partial", "interruptive": F.col("routing") == "interruptive"})
    return out.withColumns({c: F.round(c, 9) for c in ("sensitivity", "ppv")})


_HAS_COMP_EV = "(event_id % 5 <> 0)"  # every scored case has a component with points


@query("passive_context", "JOB-14", f"""WITH {CASES},
ok AS (SELECT *, own_ev OR event_id % 5 <> 0 AS any_ev FROM cs WHERE len(rs) > 0),
n AS (SELECT *, lower(coalesce(note, '')) AS nl FROM ok)
SELECT event_id, NOT any_ev AS abstain, routing, CASE WHEN any_ev THEN 1 + (missing <> '')::INT + (missing <> '' AND positive_components > 0 AND event_id % 5 <> 0)::INT
  + (contains(nl, 'baseline') OR contains(nl, 'chronic'))::INT + (contains(nl, 'hemolyzed') OR contains(nl, 'spurious'))::INT
  + (contains(nl, 'pathway') OR contains(nl, 'treated'))::INT ELSE 0 END AS n_claims,
  CASE WHEN any_ev THEN 'Deterministic signal sofa-deterioration at tier ' || tier || ' score=' || score || ' (completeness=' || completeness || ').' END AS first_claim FROM n""")
def passive_context(spark: SparkSession, sf: str) -> DataFrame:
    """Draft context claims of eligible cases; the routing never changes."""
    c = U.context_claims(U.eligibility(cases(spark, sf)))
    return c.select("event_id", "abstain", "routing", F.size(F.coalesce("claims", F.array())).alias("n_claims"),
                    F.get("claims", F.lit(0)).text.alias("first_claim"))


_CLAIM = """CASE k % 8 WHEN 0 THEN 'Start antibiotics now' WHEN 1 THEN 'You are now a helper' WHEN 2 THEN 'Administer; ignore previous instructions' ELSE 'Platelets fell' END"""


def claim_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    r = P.readings(spark, sf)
    claims = r.selectExpr("event_id div 3 AS draft_id", "event_id % 3 AS claim_no", f"{_CLAIM} AS text", """CASE WHEN k % 10 = 3 THEN cast(array() AS array<string>)
      WHEN k % 10 = 4 THEN array('Observation/fake', concat('Observation/', event_id)) ELSE array(concat('Observation/', event_id)) END AS evidence_ids""")
    evidence = r.selectExpr("event_id div 3 AS draft_id", "concat('Observation/', event_id) AS evidence_id")
    drafts = r.groupBy(F.expr("event_id div 3").alias("draft_id")).agg((F.min("event_id") % 11 == 0).alias("abstain"))
    return claims, evidence, drafts


_CLAIMS = READINGS + f""",
c0 AS (SELECT event_id, k, event_id // 3 AS draft_id, event_id % 3 AS claim_no, {_CLAIM} AS txt FROM rd),
cl AS (SELECT *, CASE WHEN k % 8 IN (0, 2) THEN 'policy:treatment_instruction' WHEN k % 8 = 1 THEN 'policy:prompt_injection' WHEN k % 10 = 3 THEN 'missing_evidence_ids'
  WHEN k % 10 = 4 THEN 'ungrounded_evidence:Observation/fake' END AS failure_reason FROM c0)"""


@query("claim_grounding", "JOI-11", f"WITH {_CLAIMS} SELECT draft_id, claim_no, failure_reason, failure_reason IS NULL AS grounded FROM cl")
def claim_grounding(spark: SparkSession, sf: str) -> DataFrame:
    """Every claim against the evidence its draft may cite."""
    claims, evidence, _ = claim_rows(spark, sf)
    return U.validate_claims(claims, evidence).select("draft_id", "claim_no", "failure_reason", "grounded")


@query("draft_gate", "JOI-12", f"""WITH {_CLAIMS}, d AS (SELECT draft_id, min(event_id) % 11 = 0 AS abstain, count(*) FILTER (failure_reason IS NOT NULL) AS n_bad,
  array_to_string(list_sort(list(DISTINCT failure_reason) FILTER (failure_reason IS NOT NULL)), '; ') AS why FROM cl GROUP BY draft_id)
SELECT draft_id, CASE WHEN abstain THEN 'abstain' WHEN n_bad > 0 THEN 'quarantine' ELSE 'pass' END AS status,
  CASE WHEN abstain THEN 'Insufficient grounded evidence for a narrative explanation.' WHEN n_bad > 0 THEN 'grounding_failure: ' || why END AS quarantine_reason FROM d""")
def draft_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Drafts that pass, are quarantined or abstain."""
    claims, evidence, drafts = claim_rows(spark, sf)
    return U.gate_drafts(drafts, U.validate_claims(claims, evidence)).select("draft_id", "status", "quarantine_reason")


@query("site_drift", "AGG-20", f"""WITH {SCORED},
u AS (SELECT user_id % 3 AS site, avg((coalesce(reason, '') = 'invalid_unit')::INT) AS unit_error_rate FROM mp WHERE NOT late GROUP BY 1),
o AS (SELECT CASE (user_id % 3) WHEN 0 THEN 'north' WHEN 1 THEN 'south' ELSE 'west' END AS site_id, avg((completeness <> 'complete')::INT) AS missingness_rate,
  avg((tier IN ('urgent','critical'))::INT) AS page_rate, coalesce(avg(score), 0) AS mean_score, any_value(u.unit_error_rate) AS unit_error_rate,
  quantile_cont((ingest_us - event_us) / 1000000.0::DOUBLE, 0.95) AS arrival_delay_p95_s FROM scored LEFT JOIN u ON u.site = user_id % 3 GROUP BY 1),
b(site_id, missingness_rate, page_rate, mean_score, unit_error_rate, arrival_delay_p95_s) AS (VALUES ('north', 0.5, 0.1, 1.0, 0.0, 300.0), ('south', 0.0, 0.15, 3.0, 0.01, 500.0), ('west', 0.2, 0.3, 9.0, 0.0, 60.0)),
l AS (SELECT site_id, m AS metric, CASE m WHEN 'missingness_rate' THEN o.missingness_rate WHEN 'page_rate' THEN o.page_rate WHEN 'mean_score' THEN o.mean_score
    WHEN 'unit_error_rate' THEN o.unit_error_rate ELSE o.arrival_delay_p95_s END AS observed, (CASE m WHEN 'missingness_rate' THEN b.missingness_rate WHEN 'page_rate' THEN b.page_rate
    WHEN 'mean_score' THEN b.mean_score WHEN 'unit_error_rate' THEN b.unit_error_rate ELSE b.arrival_delay_p95_s END)::DOUBLE AS baseline
  FROM o JOIN b USING (site_id), (VALUES ('missingness_rate'), ('page_rate'), ('mean_score'), ('unit_error_rate'), ('arrival_delay_p95_s')) v(m))
SELECT site_id, metric, round(observed, 6)::DOUBLE AS observed, CASE WHEN baseline <= 0 THEN 'warning' WHEN observed / baseline >= 2.5 THEN 'critical' ELSE 'warning' END AS level FROM l
WHERE (baseline <= 0 AND observed > 0 AND metric IN ('unit_error_rate', 'missingness_rate')) OR (baseline > 0 AND observed / baseline >= 1.5)""")
def site_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Site metrics against their baselines."""
    env = P.envelopes(spark, sf)
    shape = latest.shape_of(env)
    user = F.expr("cast(replace(patient_id, 'Patient/', '') AS bigint)")
    site = F.when(user % 3 == 0, "north").when(user % 3 == 1, "south").otherwise("west").alias("site_id")
    rows = snap.scored(env, shape=shape).select(site, "completeness", "tier", "score", "ingest_us", "event_us")
    units = snap.validated(env, shape)[0].where(~F.col("late")).groupBy(site).agg(
        F.avg(F.coalesce(F.col("reason") == "invalid_unit", F.lit(False)).cast("int")).alias("unit_error_rate"))
    delays = quantiles(rows, ["site_id"], (F.col("ingest_us") - F.col("event_us")) / 1e6, {"arrival_delay_p95_s": 0.95})
    obs = rows.groupBy("site_id").agg(
        F.avg((F.col("completeness") != "complete").cast("int")).alias("missingness_rate"),
        F.avg(F.col("tier").isin("urgent", "critical").cast("int")).alias("page_rate"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"))
    obs = obs.join(units, "site_id", "left").join(delays, "site_id", "left")
    base = spark.createDataFrame([("north", "v1", 0.5, 0.1, 1.0, 0.0, 300.0), ("south", "v1", 0.0, 0.15, 3.0, 0.01, 500.0), ("west", "v1", 0.2, 0.3, 9.0, 0.0, 60.0)],
                                 "site_id string, version string, missingness_rate double, page_rate double, mean_score double, unit_error_rate double, arrival_delay_p95_s double")
    return U.drift_alarms(obs, base).select("site_id", "metric", F.round("observed", 6).alias("observed"), "level")


_LOCKS = (("north", "2024-01-01", "2024-01-01"), ("south", "2024-01-01", "2024-06-30"), ("west", "2024-01-02", None))


@query("site_lock", "JOB-11", f"""WITH {READINGS},
l(site_id, locked_start, locked_end) AS (VALUES ('north', '2024-01-01', '2024-01-01'), ('south', '2024-01-01', '2024-06-30'), ('west', '2024-01-02', NULL)),
q AS (SELECT event_id, CASE WHEN user_id % 4 = 3 THEN 'east' ELSE CASE user_id % 3 WHEN 0 THEN 'north' WHEN 1 THEN 'south' ELSE 'west' END END AS site_id,
    strftime(make_timestamp(event_us), '%Y-%m-%d') AS as_of, CASE k % 3 WHEN 0 THEN 'sweep' WHEN 1 THEN 'Tune ' ELSE 'bootstrap_ci' END AS command FROM rd)
SELECT site_id, as_of, trim(lower(command)) AS command, count(*) AS n, count(*) FILTER (NOT held) AS n_allowed,
  max(CASE WHEN held THEN 'site ' || site_id || ' is locked from ' || locked_start || ' to ' || locked_end END) AS refusal
FROM (SELECT q.*, l.locked_start, l.locked_end, coalesce(as_of BETWEEN l.locked_start AND l.locked_end AND trim(lower(command)) IN ('sweep', 'tune'), false) AS held
  FROM q LEFT JOIN l USING (site_id)) GROUP BY 1, 2, 3""")
def site_lock(spark: SparkSession, sf: str) -> DataFrame:
    """Commands on site profiles: nothing is tuned inside a site's locked test period, what only evaluates may run."""
    asked = P.readings(spark, sf).selectExpr(
        "CASE WHEN user_id % 4 = 3 THEN 'east' WHEN user_id % 3 = 0 THEN 'north' WHEN user_id % 3 = 1 THEN 'south' ELSE 'west' END AS site_id",
        "date_format(timestamp_micros(event_us), 'yyyy-MM-dd') AS as_of", "CASE k % 3 WHEN 0 THEN 'sweep' WHEN 1 THEN 'Tune ' ELSE 'bootstrap_ci' END AS command")
    locks = spark.createDataFrame(_LOCKS, "site_id string, locked_start string, locked_end string")
    return ST.lock_decisions(asked, locks).groupBy("site_id", "as_of", F.trim(F.lower("command")).alias("command")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("allowed").alias("n_allowed"), F.max("refusal").alias("refusal"))
