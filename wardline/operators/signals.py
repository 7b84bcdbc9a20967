"""One signal contract for all indicators, so that everything downstream can treat them alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGNAL = T.StructType([
    T.StructField(n, t) for n, t in (
        ("signal_id", T.StringType()), ("signal_type", T.StringType()), ("signal_kind", T.StringType()),
        ("patient_id", T.StringType()), ("encounter_id", T.StringType()), ("event_us", T.LongType()),
        ("score", T.IntegerType()), ("stage", T.IntegerType()), ("completeness", T.StringType()),
        ("severity", T.StringType()), ("onset_us", T.LongType()), ("required_inputs", T.ArrayType(T.StringType())),
        ("missing_inputs", T.ArrayType(T.StringType())), ("exclusions", T.ArrayType(T.StringType())),
        ("criteria_met", T.ArrayType(T.StringType())), ("rule_bundle_id", T.StringType()),
        ("rule_version", T.StringType()), ("resolution_state", T.StringType()),
        ("extensions", T.MapType(T.StringType(), T.StringType())))])

# Inputs each indicator asks for.
REQUIRED = {
    "sofa-deterioration": ("respiration", "coagulation", "liver", "cardiovascular", "cns", "renal"),
    "aki": ("creatinine", "baseline_creatinine", "urine_output"),
    "respiratory-deterioration": ("oxygenation", "respiratory_rate", "oxygen_support", "blood_gas"),
    "sepsis-3": ("current_sofa", "baseline_sofa", "infection_suspicion"),
}


def _signal(df: DataFrame, given: dict[str, Column]) -> DataFrame:
    have = set(df.columns)
    empty = F.array().cast("array<string>")
    out = []
    for f in SIGNAL.fields:
        c = given.get(f.name)
        if c is None:
            c = F.col(f.name) if f.name in have else empty if isinstance(f.dataType, T.ArrayType) else F.lit(None)
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


def _required(kind: str) -> Column:
    return F.array(*[F.lit(x) for x in REQUIRED.get(kind, ())]).cast("array<string>")


def _extensions(df: DataFrame, names: Sequence[str]) -> Column:
    pairs = [x for n in names if n in df.columns for x in (F.lit(n), F.col(n).cast("string"))]
    return F.create_map(*pairs) if pairs else F.lit(None)


def from_score(df: DataFrame, signal_type: str, bundle_id: str, version: str,
               extensions: Sequence[str] = ()) -> DataFrame:
    """Scored rows of a risk indicator (organ dysfunction, kidney, respiratory, haemodynamic)."""
    return _signal(df, {
        "signal_id": F.col("alert_id"), "signal_type": F.lit(signal_type), "signal_kind": F.lit("risk"),
        "severity": F.col("tier"), "required_inputs": _required(signal_type),
        "missing_inputs": F.col("missing_components"), "rule_bundle_id": F.lit(bundle_id),
        "rule_version": F.lit(version), "resolution_state": F.lit("open"),
        "extensions": _extensions(df, extensions)})


def from_sepsis3(df: DataFrame, severity: Column, version: str = "1.0.0") -> DataFrame:
    """Phenotype rows; an exclusion is a suppressed signal."""
    return _signal(df, {
        "signal_id": F.col("alert_id"), "signal_type": F.lit("sepsis-3"), "signal_kind": F.lit("phenotype"),
        "score": F.col("met").cast("int"),
        "completeness": F.when(F.col("status") == "insufficient_data", "insufficient_data").otherwise("complete"),
        "severity": F.when(F.col("met"), severity).otherwise("none"), "onset_us": F.col("infection_us"),
        "required_inputs": _required("sepsis-3"), "exclusions": F.col("exclusions_applied"),
        "rule_bundle_id": F.lit("sepsis-3-phenotype"), "rule_version": F.lit(version),
        "resolution_state": F.when(F.col("status") == "excluded", "suppressed").otherwise("open"),
        "extensions": F.create_map(
            F.lit("phenotype_status"), F.col("status"), F.lit("sofa_delta"), F.col("sofa_delta").cast("string"),
            F.lit("criteria_failed"), F.array_join("criteria_failed", ","))})


def from_alert(df: DataFrame) -> DataFrame:
    """Stored alerts of any type; kind and resolution are inferred where they are not given."""
    have = set(df.columns)

    def c(name: str, default=None) -> Column:
        return F.col(name) if name in have else F.lit(default)

    kind = F.when(c("indicator").endswith("-3"), "phenotype").otherwise("risk")
    state = F.when(F.coalesce(c("suppressed", False), F.lit(False)), "suppressed").when(
        F.coalesce(c("acknowledged", False), F.lit(False)), "acknowledged").otherwise("open")
    return _signal(df, {
        "signal_id": F.col("alert_id"), "signal_type": F.coalesce(c("indicator"), F.lit("unknown")),
        "signal_kind": F.coalesce(c("signal_kind"), kind), "severity": F.coalesce(c("tier"), F.lit("none")),
        "completeness": F.coalesce(c("completeness"), F.lit("partial")),
        "resolution_state": F.coalesce(c("resolution_state"), state),
        "missing_inputs": c("missing_components") if "missing_components" in have else F.array(),
        "rule_bundle_id": F.coalesce(c("rule_bundle_id"), F.lit("unknown")),
        "rule_version": F.coalesce(c("rule_version"), F.lit("0.0.0"))})


def to_alert(signals: DataFrame) -> DataFrame:
    """Signals under the column names of the alert table."""
    names = {"signal_id": "alert_id", "signal_type": "indicator", "severity": "tier",
             "missing_inputs": "missing_components"}
    return signals.select(*[F.col(c).alias(names.get(c, c)) for c in signals.columns])
