"""Snapshot scoring of ICU stays at a fixed time after admission."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import scores as S
from wardline.operators import asof
from wardline.sources import icu

HOUR_US = 3_600_000_000


def with_as_of(stays: DataFrame, hours: int = 24) -> DataFrame:
    """Scoring time: so many hours after admission, or discharge when the stay is shorter."""
    return stays.withColumn("as_of_us", F.least(F.col("intime_us") + hours * HOUR_US, F.col("outtime_us")))


def _concepts(items: dict[str, tuple[int, ...]], prefix: str) -> dict:
    return {f"{prefix}{n}": F.col("itemid").isin(*ids) for n, ids in items.items()}


def snapshot_inputs(stays: DataFrame, labs: DataFrame, charts: DataFrame, infusions: DataFrame,
                    urine: DataFrame) -> DataFrame:
    """Score inputs of every stay at its scoring time. Labs win over charted values."""
    own_labs = labs.join(stays.select("subject_id", "stay_id", "hadm_id"), "subject_id").where(
        asof.admission_matches(F.col("lab_hadm"), F.col("hadm_id")))
    out = asof.latest_before(stays, own_labs, "stay_id", _concepts(icu.LAB_ITEMS, "lab_"))
    out = asof.latest_before(out, charts, "stay_id", _concepts(icu.CHART_ITEMS, "chart_"))
    out = asof.pressor_at(out, infusions, "stay_id")
    out = asof.trailing_sum(out, urine, "stay_id", "ml", "urine_ml_day")
    out = asof.earliest_in_lookback(
        out, own_labs.where(F.col("itemid").isin(*icu.LAB_ITEMS["creatinine"])), "stay_id", "reading", "baseline_creatinine")
    pct = F.col("chart_fio2_percent")
    gcs = (F.col("chart_gcs_eye") + F.col("chart_gcs_verbal") + F.col("chart_gcs_motor")).cast("int")
    return out.select(
        "subject_id", "stay_id", "hadm_id", "as_of_us",
        F.when(pct > 0, F.col("chart_spo2") / (pct / F.lit(100.0))).alias("spo2_fio2"),
        F.coalesce("lab_platelets", "chart_platelets").alias("platelets"),
        F.coalesce("lab_bilirubin", "chart_bilirubin").alias("bilirubin"), F.col("chart_map_mmhg").alias("map_mmhg"),
        "on_pressor", "agent", "dose", gcs.alias("gcs"),
        F.coalesce("lab_creatinine", "chart_creatinine").alias("creatinine"), "urine_ml_day", "baseline_creatinine")


def score_snapshots(inputs: DataFrame) -> DataFrame:
    """Organ-dysfunction and kidney scores side by side."""
    sofa = S.sofa_total(S.sofa_points(inputs)).withColumn("tier", S.tier(F.col("score"), bands=None))
    sofa = sofa.select(*inputs.columns, *[F.col(c).alias(f"sofa_{c}") for c in
                                          ("score", "completeness", "missing_components", "tier")])
    none = F.lit(None)
    aki = S.aki_point(sofa.withColumns({
        "urine_ml_kg_h": none.cast("double"), "urine_hours": none.cast("double"), "anuria": none.cast("boolean")}))
    return aki.select("subject_id", "stay_id", "hadm_id", "as_of_us", "sofa_score", "sofa_completeness",
                      "sofa_missing_components", "sofa_tier", F.col("stage").alias("aki_stage"),
                      F.col("score").alias("aki_score"), F.col("completeness").alias("aki_completeness"),
                      F.col("tier").alias("aki_tier"))


def totals(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("stays_scored"), F.count_if(F.col("sofa_tier") != "none").alias("sofa_alertable"),
        F.count_if(F.col("aki_tier") != "none").alias("aki_alertable"),
        F.count_if(F.col("sofa_completeness") == "partial").alias("sofa_partial"),
        F.count_if(F.col("aki_completeness") == "partial").alias("aki_partial"))
