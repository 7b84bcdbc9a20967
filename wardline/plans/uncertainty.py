"""Uncertain cases: eligibility, passive context claims, grounding, detection statistics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR_THRESHOLD = (2, 3)
SEVERITY = {"none": 0, "watch": 1, "urgent": 2, "critical": 3}
# Closed vocabulary of mimics, and phrases no claim may contain.
MIMICS = {"chronic_baseline": ("baseline", "chronic", "esrd"), "measurement_artifact": ("artifact", "hemolyzed", "spurious"),
          "already_on_pathway": ("protocol", "pathway", "treated")}
TREATMENT_PHRASES = ("start antibiotics", "administer", "prescribe", "intubate", "give fluids", "treatment recommendation")
INJECTION_PHRASES = ("ignore previous instructions", "ignore all instructions", "system prompt", "disregard grounding", "you are now")


def eligibility(cases: DataFrame) -> DataFrame:
    """Add ``eligible`` and ``reasons``. Cases have score, tier, completeness, missing_components and a
    breakdown of (name, points, missing, severity, evidence_ids)."""
    score, tier = F.col("score"), F.lower(F.coalesce("tier", F.lit("none")))
    missing = F.size(F.coalesce("missing_components", F.array())) > 0
    positive = F.exists("component_breakdown", lambda c: ~c.missing & (F.coalesce(c.points, F.lit(0)) > 0))

    def rank(c: Column) -> Column:
        r = F.lit(0)
        for name, n in SEVERITY.items():
            r = F.when(F.lower(F.coalesce(c.severity, F.lit("none"))) == name, n).otherwise(r)
        return r

    ranks = F.transform("component_breakdown", rank)
    spread = (F.size("component_breakdown") >= 2) & (F.array_max(ranks) - F.array_min(ranks) >= 2)
    found = F.array_compact(F.array(
        F.when(score.isin(*NEAR_THRESHOLD), "near_threshold"),
        F.when((F.lower(F.coalesce("completeness", F.lit("partial"))) == "partial") | missing, "partial_completeness"),
        F.when(missing & positive, "conflicting_components"), F.when(spread, "multi_signal_severity_spread"),
        F.when((tier == "watch") & (score >= 2), "watch_with_rising_score")))
    return cases.withColumn("_r", found).withColumns({
        "eligible": F.size("_r") > 0,
        "reasons": F.when(F.size("_r") > 0, F.col("_r")).otherwise(F.array(F.lit("not_eligible")))}).drop("_r")


def allowed_evidence() -> Column:
    inner = F.flatten(F.transform("component_breakdown", lambda c: F.coalesce(c.evidence_ids, F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(F.coalesce("evidence_ids", F.array().cast("array<string>")), inner))


def context_claims(cases: DataFrame) -> DataFrame:
    """Draft claims of eligible cases; no evidence means abstaining. Routing is passed through untouched."""
    c = cases.where("eligible").withColumn("allowed", allowed_evidence())
    first = F.array(F.get("allowed", F.lit(0)))
    missing = F.array_join("missing_components", ", ")
    lacks = F.size("missing_components") > 0
    hot = F.filter("component_breakdown", lambda x: ~x.missing & (F.coalesce(x.points, F.lit(0)) > 0) & (F.size(x.evidence_ids) > 0))
    lead = F.get(hot, F.lit(0))
    text = lambda v: F.coalesce(v.cast("string"), F.lit("None"))

    def claim(body: Column, evidence: Column, kind: str) -> Column:
        return F.struct(body.alias("text"), evidence.alias("evidence_ids"), F.lit(kind).alias("kind"))

    note = F.lower(F.coalesce("reviewer_note", F.lit("")))
    claims = [
        claim(F.concat(F.lit("Deterministic signal "), F.coalesce("indicator", F.lit("unknown")), F.lit(" at tier "), text(F.col("tier")),
                       F.lit(" score="), text(F.col("score")), F.lit(" (completeness="), text(F.col("completeness")), F.lit(").")), first, "context"),
        F.when(lacks, claim(F.concat(F.lit("Missing inputs disclosed (not imputed): "), missing, F.lit(".")), first, "missing")),
        F.when(lacks & (F.size(hot) > 0), claim(F.concat(F.lit("Conflict band: "), lead["name"], F.lit(" is positive while "), missing,
                                                         F.lit(" remain missing.")), lead["evidence_ids"], "conflict")),
    ]
    for name, words in MIMICS.items():
        hit = F.lit(False)
        for word in words:
            hit = hit | note.contains(word)
        claims.append(F.when(hit, claim(F.lit(f"Possible mimic to consider (passive only): {name}."), first, "mimic")))
    return c.withColumns({"abstain": F.size("allowed") == 0,
                          "claims": F.when(F.size("allowed") > 0, F.array_compact(F.array(*claims)))})


def validate_claims(claims: DataFrame, evidence: DataFrame, keys: tuple[str, ...] = ("draft_id", "claim_no")) -> DataFrame:
    """Why a claim is not grounded, or null. ``evidence`` has the allowed (draft_id, evidence_id) rows."""
    cited = claims.select(*keys, F.explode("evidence_ids").alias("evidence_id"))
    unknown = cited.join(evidence.select(keys[0], "evidence_id"), [keys[0], "evidence_id"], "left_anti").groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set("evidence_id")), ",").alias("_unknown"))
    t = F.lower("text")

    def any_of(words) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | t.contains(w)
        return hit

    out = claims.join(unknown, list(keys), "left")
    reason = (
        F.when(any_of(TREATMENT_PHRASES), "policy:treatment_instruction").when(any_of(INJECTION_PHRASES), "policy:prompt_injection")
        .when(F.size(F.coalesce("evidence_ids", F.array())) == 0, "missing_evidence_ids")
        .when(F.col("_unknown").isNotNull(), F.concat(F.lit("ungrounded_evidence:"), F.col("_unknown"))))
    return out.withColumn("failure_reason", reason).withColumn("grounded", F.col("failure_reason").isNull()).drop("_unknown")


def gate_drafts(drafts: DataFrame, validated: DataFrame, fail_closed: bool = True) -> DataFrame:
    """Abstain, quarantine or pass every draft (``draft_id``, ``abstain``)."""
    per = validated.groupBy("draft_id").agg(
        F.count(F.lit(1)).alias("n_claims"), F.count_if(~F.col("grounded")).alias("n_bad"),
        F.array_join(F.array_sort(F.collect_set("failure_reason")), "; ").alias("_why"))
    out = drafts.join(per, "draft_id", "left").withColumns({
        "n_claims": F.coalesce("n_claims", F.lit(0)), "n_bad": F.coalesce("n_bad", F.lit(0))})
    empty = (F.col("n_claims") == 0) & F.lit(fail_closed)
    return out.withColumns({
        "status": F.when(F.col("abstain"), "abstain").when(F.col("n_bad") > 0, "quarantine").when(empty, "abstain").otherwise("pass"),
        "quarantine_reason": F.when(F.col("abstain") | empty & (F.col("n_bad") == 0), "Insufficient grounded evidence for a narrative explanation.")
        .when(F.col("n_bad") > 0, F.concat(F.lit("grounding_failure: "), F.col("_why")))}).drop("_why")


def detection_stats(cases: DataFrame, groups: Mapping[str, Column]) -> DataFrame:
    """Sensitivity, precision and burden per subgroup; a case may be in several."""
    names = F.array_compact(F.array(*[F.when(cond, F.lit(n)) for n, cond in groups.items()]))
    rows = cases.withColumn("subgroup", F.explode(names))
    fired, pos = F.col("routing").isin("interruptive", "passive"), F.col("label_positive")
    out = rows.groupBy("subgroup").agg(
        F.count(F.lit(1)).alias("n_cases"), F.count_if(pos).alias("n_positive"), F.count_if(pos & fired).alias("tp"),
        F.count_if(~pos & fired).alias("fp"), F.count_if(pos & ~F.coalesce(fired, F.lit(False))).alias("fn"),
        F.count_if(F.col("routing") == "interruptive").alias("interruptive_burden"))
    return out.withColumns({"sensitivity": F.try_divide("tp", "n_positive"), "ppv": F.try_divide("tp", F.col("tp") + F.col("fp"))})


DRIFT_METRICS = ("missingness_rate", "page_rate", "mean_score", "unit_error_rate", "arrival_delay_p95_s")
ZERO_BASELINE = ("unit_error_rate", "missingness_rate")


def drift_alarms(observed: DataFrame, baseline: DataFrame, keys: tuple[str, ...] = ("site_id",), warning: float = 1.5,
                 critical: float = 2.5) -> DataFrame:
    """Alarms of site metrics against their versioned baseline. Rules are never changed by an alarm."""
    pairs = ", ".join(f"'{m}', cast({m} AS double)" for m in DRIFT_METRICS)
    wide = f"stack({len(DRIFT_METRICS)}, {pairs})"
    o = observed.selectExpr(*keys, f"{wide} AS (metric, observed)")
    b = baseline.selectExpr(*keys, "version", f"{wide} AS (metric, baseline)")
    j = o.join(b, [*keys, "metric"])
    obs, base = F.coalesce("observed", F.lit(0.0)), F.col("baseline")
    level = F.when(base <= 0, F.when((obs > 0) & F.col("metric").isin(*ZERO_BASELINE), "warning")).when(
        obs / base >= critical, "critical").when(obs / base >= warning, "warning")
    return j.withColumn("level", level).where(F.col("level").isNotNull())
