"""Clinician feedback: classify, compare reviewers, aggregate, propose experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Feedback categories in deciding order, with the phrases that hint at them.
HINTS: dict[str, tuple[str, ...]] = {
    "already_recognized": ("already aware", "already recognized", "known to team", "team already"),
    "already_treated": ("already treated", "on protocol", "on sepsis pathway", "antibiotics started", "already on pressors"),
    "chronic_baseline": ("chronic", "baseline", "end stage", "esrd", "expected for"),
    "incorrect_input": ("wrong lab", "incorrect", "bad data", "artifact", "misdocumented", "unit error"),
    "appropriate_non_actionable": ("non-actionable", "not actionable", "appropriate but", "no change needed", "watch only"),
    "wrong_recipient": ("wrong team", "wrong recipient", "wrong service", "page medicine not", "not my patient"),
    "repeated_episode": ("duplicate", "repeated", "same episode", "already paged", "again"),
    "true_escalation": ("helpful", "true positive", "good catch", "useful page", "escalation warranted"),
}
# Experiment suggested by an actionable category.
EXPERIMENTS = (
    ("repeated_episode", "Increase episode page refractory", "page_refractory_minutes", "+30"),
    ("chronic_baseline", "Enable baseline delta gate", "baseline_enabled", "true"),
    ("already_treated", "Strengthen context suppression for active protocols", "suppression_flags", "already_on_sepsis_protocol"),
    ("incorrect_input", "Tighten unit/status validation before scoring", "validation_gate", "reject_invalid_units"),
    ("wrong_recipient", "Review routing recipient map (ops only)", "routing_directory", "site_service_review"),
)


def classify(feedback: DataFrame, text: str = "text") -> DataFrame:
    """Category with the most matching phrases, earlier category on a tie; abstains without a match."""
    hints = F.array(*[F.struct(F.lit(-i).alias("o"), F.lit(c).alias("category"), F.array(*map(F.lit, phrases)).alias("phrases"))
                      for i, (c, phrases) in enumerate(HINTS.items())])

    def best(t: Column) -> Column:
        def scored(c: Column) -> Column:
            hits = F.filter(c["phrases"], lambda p: t.contains(p))
            return F.struct(F.size(hits).alias("n"), c["o"].alias("o"), c["category"].alias("category"), hits.alias("hints"))
        return F.array_max(F.transform(hints, scored))

    def said(b: Column) -> Column:
        n = b["n"]
        return F.struct(
            F.when(n > 0, b["category"]).otherwise("abstain").alias("category"),
            F.when(n > 0, F.least(F.lit(0.95), F.lit(0.55) + F.lit(0.15) * (n - 1))).otherwise(0.0).alias("confidence"),
            F.when(n > 0, b["hints"]).otherwise(F.array().cast("array<string>")).alias("matched_hints"))

    # Each step goes through a list of one value, so that it is worked out once a row: as a plain column it is copied
    # into every place that names it, the lower-cased text once a phrase and the best category once a column.
    text_list = F.array(F.lower(F.trim(F.coalesce(text, F.lit("")))))
    found = F.transform(F.transform(text_list, best), said)
    return feedback.withColumn("_b", F.explode(found)).withColumns(
        {c: F.col(f"_b.{c}") for c in ("category", "confidence", "matched_hints")}).drop("_b")


def consensus() -> Column:
    """Label both reviewers agree on."""
    return F.when(F.col("reviewer_a") == F.col("reviewer_b"), F.col("reviewer_a"))


def agreement(feedback: DataFrame, predictions: DataFrame, key: str = "feedback_id") -> DataFrame:
    """Reviewer agreement, and classifier accuracy on the agreed labels."""
    rows = feedback.where(F.col("reviewer_a").isNotNull() & F.col("reviewer_b").isNotNull()).join(
        predictions.select(key, "category"), key, "left").withColumn("consensus", consensus())
    agreed = F.col("consensus").isNotNull()
    out = rows.agg(F.count(F.lit(1)).alias("n_dual_reviewed"), F.count_if(agreed).alias("n_agree"),
                   F.count_if(agreed & F.col("category").eqNullSafe(F.col("consensus"))).alias("n_right"))
    return out.withColumns({
        "reviewer_agreement": F.round(F.try_divide("n_agree", "n_dual_reviewed"), 4),
        "classifier_accuracy": F.round(F.try_divide("n_right", "n_agree"), 4)})


def aggregate(classified: DataFrame) -> DataFrame:
    """Counts by category, site, service, indicator, rule and lane, in one pass."""
    def known(c: str) -> Column:
        return F.coalesce(c, F.lit("unknown"))
    rule = F.concat(F.coalesce("rule_bundle_id", F.lit("?")), F.lit("@"), F.coalesce("rule_version", F.lit("?")))
    rows = classified.select("category", known("site_id").alias("site"), known("service").alias("service"),
                             known("indicator").alias("indicator"), rule.alias("rule"), known("routing").alias("routing"))
    cols = rows.columns
    out = rows.groupingSets([[F.col(c)] for c in cols], *[F.col(c) for c in cols]).agg(F.count(F.lit(1)).alias("n"))
    dim = F.lit(None).cast("string")
    for c in cols:
        dim = F.when(F.col(c).isNotNull(), c).otherwise(dim)
    return out.select(dim.alias("dimension"), F.coalesce(*cols).alias("value"), "n")


def proposals(classified: DataFrame, key: str = "feedback_id") -> DataFrame:
    """Experiments suggested by actionable feedback, with how much supports them.

    The supporting ids are rows of their own (:func:`proposal_support`), as there is no bound on their number.
    """
    spark = classified.sparkSession
    exp = spark.createDataFrame(list(EXPERIMENTS), "category string, title string, knob string, proposed_delta string")
    found = classified.groupBy("category").agg(F.count(F.lit(1)).alias("n_supporting"), F.min(key).alias("first_id"), F.max(key).alias("last_id"))
    return found.join(F.broadcast(exp), "category").withColumn("proposal_id", F.concat(F.lit("prop-"), "category"))


def proposal_support(classified: DataFrame, key: str = "feedback_id") -> DataFrame:
    return classified.where(F.col("category").isin([e[0] for e in EXPERIMENTS])).select(
        F.concat(F.lit("prop-"), "category").alias("proposal_id"), key)
