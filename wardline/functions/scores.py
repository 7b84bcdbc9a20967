"""Scores and stages as column expressions: everything here stays inside generated code."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOFA_COMPONENTS = ("respiration", "coagulation", "liver", "cardiovascular", "cns", "renal")

# Fixed values of the organ-dysfunction score: (points, comparison, limit), first match wins.
Band = tuple[int, str, float]
COAGULATION: tuple[Band, ...] = ((4, "<", 20.0), (3, "<", 50.0), (2, "<", 100.0), (1, "<", 150.0), (0, ">=", 150.0))
LIVER: tuple[Band, ...] = ((4, ">=", 12.0), (3, ">=", 6.0), (2, ">=", 2.0), (1, ">=", 1.2), (0, "<", 1.2))
CNS: tuple[Band, ...] = ((4, "<", 6.0), (3, "<=", 9.0), (2, "<=", 12.0), (1, "<=", 14.0), (0, "=", 15.0))
RENAL_CREATININE: tuple[Band, ...] = ((4, ">=", 5.0), (3, ">=", 3.5), (2, ">=", 2.0), (1, ">=", 1.2), (0, "<", 1.2))
RENAL_URINE: tuple[Band, ...] = ((4, "<", 200.0), (3, "<", 500.0), (0, ">=", 500.0))


@dataclass(frozen=True)
class SofaRules:
    """Cut-offs of one rule-bundle version."""

    ratio_limits: tuple[float, float, float, float] = (100.0, 200.0, 300.0, 400.0)
    map_below: float = 70.0
    map_points: int = 1
    dopamine_two: float = 5.0
    dopamine_three: float = 15.0
    adrenaline_three: float = 0.1
    pressor_unknown: int = 3
    coagulation: tuple[Band, ...] = COAGULATION
    liver: tuple[Band, ...] = LIVER
    cns: tuple[Band, ...] = CNS
    renal_creatinine: tuple[Band, ...] = RENAL_CREATININE
    renal_urine: tuple[Band, ...] = RENAL_URINE
    min_components: int = 3


def _holds(v: Column, op: str, limit) -> Column:
    lim = limit if isinstance(limit, Column) else F.lit(limit)
    return {"<": v < lim, "<=": v <= lim, ">=": v >= lim, ">": v > lim, "=": v == lim}[op]


def banded(v: Column, bands: Sequence[Band], otherwise: int | None = 0) -> Column:
    """Points of the first band that holds; null in, null out."""
    case = F.when(v.isNull(), F.lit(None).cast("int"))
    for points, op, limit in bands:
        case = case.when(_holds(v, op, limit), F.lit(points))
    return case.otherwise(F.lit(otherwise).cast("int"))


def banded_by_row(v: Column, bands: Column) -> Column:
    """As :func:`banded`, with the bands in an array column (points, op, limit) of the row."""
    def hit(b: Column) -> Column:
        return (
            F.when(b.op == "<", v < b.limit).when(b.op == "<=", v <= b.limit)
            .when(b.op == ">=", v >= b.limit).otherwise(v == b.limit)
        )
    matched = F.filter(bands, hit)
    return F.when(v.isNotNull(), F.coalesce(F.get(matched, F.lit(0)).points, F.lit(0)))


def resp_ratio(pao2_fio2: Column, spo2_fio2: Column, pao2: Column, spo2: Column, fio2: Column) -> Column:
    """Measured ratio first, then one built from a known oxygen fraction; room air is never assumed."""
    known = fio2 > 0
    return F.coalesce(pao2_fio2, spo2_fio2, F.when(known, pao2 / fio2), F.when(known, spo2 / fio2))


def respiration_points(ratio: Column, ventilated: Column, r: SofaRules = SofaRules()) -> Column:
    vent = F.coalesce(ventilated, F.lit(False))
    p4, p3, p2, p1 = r.ratio_limits
    return (
        F.when(ratio.isNull(), F.lit(None).cast("int"))
        .when((ratio < p4) & vent, 4).when((ratio < p3) & vent, 3)
        .when(ratio < p2, 2).when(ratio < p1, 1).otherwise(0)
    )


def pressor_points(agent: Column, dose: Column, on_pressor: Column, r: SofaRules = SofaRules()) -> Column:
    a = F.nullif(F.lower(agent), F.lit(""))
    dosed = dose.isNotNull()
    return (
        F.when(a == "dobutamine", 2)
        .when((a == "dopamine") & dosed,
              F.when(dose > r.dopamine_three, 4).when(dose > r.dopamine_two, 3).otherwise(2))
        .when(a.isin("epinephrine", "norepinephrine", "other") & dosed,
              F.when(dose > r.adrenaline_three, 4).otherwise(3))
        .when(F.coalesce(on_pressor, F.lit(False)) | a.isNotNull(), F.lit(r.pressor_unknown))
    )


def cardiovascular_points(map_mmhg: Column, agent: Column, dose: Column, on_pressor: Column,
                          r: SofaRules = SofaRules()) -> Column:
    """A pressor decides; otherwise pressure. Knowing only that no pressor runs is not a score."""
    by_map = F.when(map_mmhg < r.map_below, F.lit(r.map_points)).when(map_mmhg.isNotNull(), F.lit(0))
    return F.coalesce(pressor_points(agent, dose, on_pressor, r), by_map)


def renal_points(creatinine: Column, urine_ml_day: Column, r: SofaRules = SofaRules()) -> Column:
    return F.greatest(
        banded(creatinine, r.renal_creatinine, None), banded(urine_ml_day, r.renal_urine, None)
    )


_SOFA_INPUTS = {
    "pao2_fio2": "double", "spo2_fio2": "double", "pao2": "double", "spo2": "double", "fio2": "double",
    "ventilated": "boolean", "platelets": "double", "bilirubin": "double", "map_mmhg": "double",
    "agent": "string", "dose": "double", "on_pressor": "boolean", "gcs": "int", "creatinine": "double",
    "urine_ml_day": "double",
}


def sofa_points(df: DataFrame, r: SofaRules = SofaRules()) -> DataFrame:
    """Add the six component point columns ``p_*``; absent input columns count as unknown."""
    have = set(df.columns)

    def c(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast(_SOFA_INPUTS[name])

    ratio = resp_ratio(c("pao2_fio2"), c("spo2_fio2"), c("pao2"), c("spo2"), c("fio2"))
    return df.withColumns({
        "p_respiration": respiration_points(ratio, c("ventilated"), r),
        "p_coagulation": banded(c("platelets"), r.coagulation),
        "p_liver": banded(c("bilirubin"), r.liver),
        "p_cardiovascular": cardiovascular_points(c("map_mmhg"), c("agent"), c("dose"), c("on_pressor"), r),
        "p_cns": banded(c("gcs"), r.cns),
        "p_renal": renal_points(c("creatinine"), c("urine_ml_day"), r),
    })


def points(name: str) -> Column:
    return F.col(f"p_{name}")


def sofa_total(df: DataFrame, min_components: Column | int = 3) -> DataFrame:
    """Total, completeness, missing list and positive-component count from the point columns."""
    need = min_components if isinstance(min_components, Column) else F.lit(min_components)
    present = sum((points(c).isNotNull().cast("int") for c in SOFA_COMPONENTS), F.lit(0))
    total = sum((F.coalesce(points(c), F.lit(0)) for c in SOFA_COMPONENTS), F.lit(0))
    positive = sum(((F.coalesce(points(c), F.lit(0)) > 0).cast("int") for c in SOFA_COMPONENTS), F.lit(0))
    missing = F.array_compact(F.array(*[F.when(points(c).isNull(), F.lit(c)) for c in SOFA_COMPONENTS]))
    return df.withColumn("n_present", present).withColumns({
        "score": F.when(F.col("n_present") >= need, total),
        "completeness": F.when(F.col("n_present") < need, "insufficient_data")
        .when(F.col("n_present") < len(SOFA_COMPONENTS), "partial").otherwise("complete"),
        "missing_components": missing,
        "positive_components": positive,
    })


def sofa_breakdown() -> Column:
    """Component list of a scored row, in fixed order."""
    return F.array(*[
        F.struct(F.lit(c).alias("name"), points(c).alias("points"), points(c).isNull().alias("missing"))
        for c in SOFA_COMPONENTS
    ])


# Severity bands of the shipped bundles: (lowest score, highest score, tier).
SOFA_TIERS = ((2, 3, "watch"), (4, 6, "urgent"), (7, 24, "critical"))
STAGE_TIERS = ((2, 3, "watch"), (4, 5, "urgent"), (6, 24, "critical"))


def tier(score: Column, threshold: Column | int = 2,
         bands: Sequence[tuple[int, int, str]] | None = SOFA_TIERS) -> Column:
    """Severity tier; a score over the last band keeps its tier, a score in a gap has none."""
    low = threshold if isinstance(threshold, Column) else F.lit(threshold)
    case = F.when(score.isNull() | (score < low), "none")
    if not bands:
        return case.when(score >= 7, "critical").when(score >= 4, "urgent").otherwise("watch")
    for lo, hi, name in bands:
        case = case.when(score.between(lo, hi), name)
    return case.when(score > bands[-1][1], bands[-1][2]).otherwise("none")


def stage_tier(score: Column, threshold: int = 2) -> Column:
    return (
        F.when(score.isNull() | (score < threshold), "none")
        .when(score >= 6, "critical").when(score >= 4, "urgent").otherwise("watch")
    )


def stage_score(stage: Column) -> Column:
    """Stages 0-3 weigh 0, 2, 4, 6."""
    return (stage * 2).cast("int")


def known(*names_and_conditions: tuple[str, Column]) -> Column:
    """Names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in names_and_conditions]))


# --- kidney injury, single point ---------------------------------------------------------------

def creatinine_stage(creatinine: Column, baseline: Column) -> Column:
    usable = baseline > 0
    ratio, rise = creatinine / baseline, creatinine - baseline
    return (
        F.when(creatinine.isNull(), F.lit(None).cast("int"))
        .when(creatinine >= 4.0, 3)
        .when(F.coalesce(~usable, F.lit(True)), 0)
        .when(ratio >= 3.0, 3).when(ratio >= 2.0, 2).when((ratio >= 1.5) | (rise >= 0.3), 1).otherwise(0)
    )


def urine_stage(rate: Column, hours: Column, anuria: Column) -> Column:
    return (
        F.when(F.coalesce(anuria, F.lit(False)) & (F.coalesce(hours, F.lit(0.0)) >= 12), 3)
        .when(rate.isNull() | hours.isNull(), F.lit(None).cast("int"))
        .when((rate < 0.3) & (hours >= 24), 3).when((rate < 0.5) & (hours >= 12), 2)
        .when((rate < 0.5) & (hours >= 6), 1).otherwise(0)
    )


def aki_point(df: DataFrame) -> DataFrame:
    """Stage, score, completeness and tier from creatinine, baseline and urine columns."""
    cr, base = F.col("creatinine"), F.col("baseline_creatinine")
    rate, hours, anuria = F.col("urine_ml_kg_h"), F.col("urine_hours"), F.col("anuria")
    df = df.withColumns({
        "creatinine_stage": creatinine_stage(cr, base), "urine_stage": urine_stage(rate, hours, anuria),
    })
    no_base = cr.isNotNull() & F.coalesce(base <= 0, F.lit(True))
    half_urine = F.col("urine_stage").isNull() & (
        rate.isNotNull() | hours.isNotNull() | F.coalesce(anuria, F.lit(False)))
    nothing = cr.isNull() & F.col("urine_stage").isNull()
    return df.withColumns({
        "stage": F.when(~nothing, F.greatest("creatinine_stage", "urine_stage")),
        "missing_components": known(("creatinine", nothing), ("baseline_creatinine", no_base),
                                    ("urine_output", half_urine)),
    }).withColumns({
        "score": stage_score(F.col("stage")),
        "completeness": F.when(nothing, "insufficient_data")
        .when(F.size("missing_components") > 0, "partial").otherwise("complete"),
    }).withColumn("tier", stage_tier(F.col("score")))


# --- respiratory deterioration -----------------------------------------------------------------

DEVICE_STAGES = {"none": 0, "nasal_cannula": 1, "face_mask": 1, "high_flow": 2, "non_invasive": 2, "invasive": 3}


def respiratory(df: DataFrame) -> DataFrame:
    """Oxygenation, rate, support and blood-gas stages and their maximum."""
    c = F.col
    fio2 = F.coalesce(c("fio2"), F.when(c("room_air"), F.lit(0.21)))
    has = fio2 > 0
    df = df.withColumns({
        "ratio_used": F.coalesce(c("pao2_fio2"), c("spo2_fio2"), F.when(has, c("pao2") / fio2),
                                 F.when(has, c("spo2") / fio2)),
        "ratio_source": F.when(c("pao2_fio2").isNotNull(), "pao2_fio2")
        .when(c("spo2_fio2").isNotNull(), "spo2_fio2")
        .when(has & c("pao2").isNotNull(), "pao2_mmhg/fio2")
        .when(has & c("spo2").isNotNull(), "spo2_percent/fio2"),
    })
    ratio, vent = c("ratio_used"), F.coalesce(c("ventilated"), F.lit(False))
    rr, ph, co2 = c("respiratory_rate"), c("abg_ph"), c("paco2")
    device = F.lower(F.trim(c("oxygen_device")))
    by_device = F.lit(None).cast("int")
    for name, stage in DEVICE_STAGES.items():
        by_device = F.when(device == name, stage).otherwise(by_device)
    gas = F.greatest(
        F.when(ph < 7.20, 3).when(ph < 7.25, 2).when(ph < 7.30, 1).otherwise(0),
        F.when(co2 > 60, 2).when(co2 > 50, 1).otherwise(0),
    )
    df = df.withColumns({
        "oxygenation_stage": F.when(ratio < 100, 3).when(ratio < 200, F.when(vent, 3).otherwise(2))
        .when(ratio < 300, 2).when(ratio < 400, 1).when(ratio.isNotNull(), 0),
        "rate_stage": F.when(rr >= 35, 3).when(rr >= 30, 2).when(rr >= 22, 1).when(rr.isNotNull(), 0),
        "support_stage": F.when(vent, 3).otherwise(by_device),
        "blood_gas_stage": F.when(ph.isNotNull() | co2.isNotNull(), gas),
    })
    ox, sup, bg = c("oxygenation_stage"), c("support_stage"), c("blood_gas_stage")
    ratio_label = (
        F.when(ratio < 100, "ratio_lt_100:").when(ratio < 200, "ratio_lt_200:")
        .when(ratio < 300, "ratio_lt_300:").when(ratio < 400, "ratio_lt_400:")
        .when(ratio.isNotNull(), "ratio_ok:"))
    criteria = F.array_compact(F.array(
        F.concat(ratio_label, c("ratio_source")),
        F.when(rr >= 35, "rr_ge_35").when(rr >= 30, "rr_ge_30").when(rr >= 22, "rr_ge_22")
        .when(rr.isNotNull(), "rr_ok"),
        F.when(vent, "mechanically_ventilated").when(sup > 0, F.concat(F.lit("oxygen_device:"), device)),
        F.when(ph < 7.20, "ph_lt_7_20").when(ph < 7.25, "ph_lt_7_25").when(ph < 7.30, "ph_lt_7_30"),
        F.when(co2 > 60, "paco2_gt_60").when(co2 > 50, "paco2_gt_50"),
        F.when(bg == 0, "abg_ok"),
    ))
    return _combine(
        df, F.greatest("oxygenation_stage", "rate_stage", "support_stage", "blood_gas_stage"),
        known(("oxygenation", ratio.isNull() & (c("spo2").isNotNull() | c("pao2").isNotNull())),
              ("oxygen_support", sup.isNull() & device.isNotNull())),
        criteria, ("oxygenation", "respiratory_rate", "oxygen_support"),
    )


# --- haemodynamic ------------------------------------------------------------------------------

def haemodynamic(df: DataFrame) -> DataFrame:
    """Lactate, pressure and vasopressor stages and their maximum."""
    lac, mp, on = F.col("lactate"), F.col("map_mmhg"), F.col("on_pressor")
    df = df.withColumns({
        "lactate_stage": F.when(lac >= 4.0, 3).when(lac >= 2.0, 2).when(lac >= 1.5, 1).when(lac.isNotNull(), 0),
        "map_stage": F.when(mp < 55, 3).when(mp < 65, 2).when(mp < 70, 1).when(mp.isNotNull(), 0),
        "pressor_stage": F.when(on, 2).when(on.isNotNull(), 0),
    })
    criteria = F.array_compact(F.array(
        F.when(lac >= 4.0, "lactate_ge_4").when(lac >= 2.0, "lactate_ge_2").when(lac >= 1.5, "lactate_ge_1_5")
        .when(lac.isNotNull(), "lactate_ok"),
        F.when(mp < 55, "map_lt_55").when(mp < 65, "map_lt_65").when(mp < 70, "map_lt_70")
        .when(mp.isNotNull(), "map_ok"),
        F.when(on, "on_vasopressor").when(on.isNotNull(), "vaso_off"),
    ))
    return _combine(
        df, F.greatest("lactate_stage", "map_stage", "pressor_stage"),
        known(("lactate", lac.isNull()), ("mean_arterial_pressure", mp.isNull())), criteria,
        ("lactate", "mean_arterial_pressure"),
    )


def _combine(df: DataFrame, stage: Column, missing: Column, criteria: Column,
             all_missing: Sequence[str]) -> DataFrame:
    """Maximum stage with its score, completeness, criteria and tier."""
    none = F.col("stage").isNull()
    default = F.array(*[F.lit(m) for m in all_missing])
    return df.withColumn("stage", stage).withColumn("missing_components", missing).withColumns({
        "criteria_met": F.when(none, F.array().cast("array<string>")).otherwise(criteria),
        "missing_components": F.when(none & (F.size("missing_components") == 0), default)
        .otherwise(F.col("missing_components")),
        "score": stage_score(F.col("stage")),
        "completeness": F.when(none, "insufficient_data")
        .when(F.size("missing_components") > 0, "partial").otherwise("complete"),
    }).withColumn("tier", stage_tier(F.col("score")))


# --- sepsis phenotype --------------------------------------------------------------------------

SEPSIS_EXCLUSIONS = ("already_on_sepsis_protocol", "comfort_care")


def sepsis3(df: DataFrame) -> DataFrame:
    """Suspected infection plus an acute rise of two points.

    Needs ``current_sofa``, ``baseline_sofa``, ``infection_us`` / ``infection_kind`` of the earliest
    infection event whose window covers the row, ``has_infection_events`` and ``exclusion_flags``.
    """
    cur, base = F.col("current_sofa"), F.col("baseline_sofa")
    inf, any_inf = F.col("infection_us").isNotNull(), F.col("has_infection_events")
    df = df.withColumn("exclusions_applied", F.array_sort(F.array_intersect(
        F.col("exclusion_flags"), F.array(*[F.lit(x) for x in SEPSIS_EXCLUSIONS]))))
    out = F.size("exclusions_applied") > 0
    delta = cur - base
    rise = F.coalesce(delta >= 2, F.lit(False))
    lacking = cur.isNull() | base.isNull() | (~inf & ~any_inf)
    status = (
        F.when(out, "excluded").when(lacking, "insufficient_data")
        .when(inf & rise, "met").otherwise("not_met"))
    none = F.array().cast("array<string>")
    return df.withColumns({
        "status": status,
        "sofa_delta": F.when(~out, delta),
        "criteria_met": F.when(out, none).otherwise(F.array_compact(F.array(
            F.when(inf, F.concat(F.lit("infection_"), F.col("infection_kind"))),
            F.when(rise, "acute_sofa_rise_ge_2")))),
        "criteria_failed": F.when(out, F.array(F.lit("exclusion_flag"))).otherwise(F.array_compact(F.array(
            F.when(~inf & any_inf, "infection_outside_window"),
            F.when(delta < 2, "acute_sofa_rise_ge_2"),
            F.when((delta < 2) & (base >= 2), "pre_existing_dysfunction_without_acute_rise")))),
        "missing_inputs": F.when(out, none).otherwise(known(
            ("current_sofa", cur.isNull()), ("baseline_sofa", base.isNull()),
            ("infection_suspicion", ~inf & ~any_inf))),
    }).withColumn("met", F.col("status") == "met")
