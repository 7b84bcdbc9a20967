"""From arriving records to scored snapshots and alerts: the shared front half of every job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline import ids
from wardline.functions import scores
from wardline.operators import latest, mapping
from wardline.rules import Bundle, load_bundle


def arrived(env: DataFrame, shape: latest.Shape | None = None) -> tuple[DataFrame, latest.Shape]:
    """Unique deliveries with their late mark."""
    shape = shape or latest.shape_of(env)
    return latest.mark_late(latest.deduplicate(env, shape), shape.hot), shape


def validated(env: DataFrame, shape: latest.Shape | None = None) -> tuple[DataFrame, latest.Shape]:
    """Unique records mapped to scorer inputs; late ones keep only their reason."""
    rows, shape = arrived(env, shape)
    mapped = mapping.map_observations(rows)
    late = F.col("late")
    return mapped.withColumns({
        "reason": F.when(late, "late_beyond_lateness").otherwise(F.col("reason")),
        "component": F.when(~late, F.col("component")),
    }), shape


def snapshots(env: DataFrame, shape: latest.Shape | None = None, hot_rows: bool | None = None) -> DataFrame:
    """Latest inputs per patient after every usable record."""
    rows, shape = validated(env, shape)
    return latest.latest_inputs(rows.drop("resource"), shape.hot)


def scored(env: DataFrame, bundle: Bundle | None = None, shape: latest.Shape | None = None) -> DataFrame:
    """Snapshots with component points, total, completeness and tier."""
    bundle = bundle or load_bundle("sepsis-sofa")
    rules = scores.SofaRules(min_components=bundle.min_components)
    out = scores.sofa_total(scores.sofa_points(snapshots(env, shape), rules), bundle.min_components)
    return out.withColumn("tier", scores.tier(F.col("score"), bundle.naive_threshold, bundle.bands))


def alerts(env: DataFrame, bundle: Bundle | None = None, shape: latest.Shape | None = None) -> DataFrame:
    """Scored snapshots as alerts. Tier ``none`` is forwarded, so that governance sees recovery."""
    bundle = bundle or load_bundle("sepsis-sofa")
    rows = scored(env, bundle, shape).where(F.col("completeness") != "insufficient_data")
    return rows.withColumns({
        "indicator": F.lit(bundle.indicator), "rule_bundle_id": F.lit(bundle.bundle_id),
        "rule_version": F.lit(bundle.version), "encounter_id": F.col("encounter_now"),
        "alert_id": ids.alert_id(F.col("patient_id"), F.col("encounter_now"), F.lit(bundle.indicator),
                                 F.col("score"), F.col("event_us"), F.lit(bundle.version)),
    })
