"""Evidence ids as references, and order-sensitive content hashes of long histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators.latest import numbered

# Resource types an evidence id may name, and prefixes that hint at a type.
REFERENCE_TYPES = ("Observation", "Condition", "Procedure", "MedicationAdministration", "MedicationRequest",
                   "DiagnosticReport", "DocumentReference", "Encounter", "Patient", "Specimen", "ServiceRequest", "Device")
PREFIX_TYPES = {"dx": "Condition", "condition": "Condition", "note": "DocumentReference", "doc": "DocumentReference",
                "enc": "Encounter", "encounter": "Encounter", "med": "MedicationAdministration",
                "drug": "MedicationAdministration"}
REFERENCE = r"^([A-Za-z][A-Za-z0-9]+)/([A-Za-z0-9\-\.]{1,64})$"


def reference(evidence: Column) -> Column:
    """A typed reference, or an identifier with an inferred type when the id is not one."""
    raw = F.trim(evidence)
    kind = F.regexp_extract(raw, REFERENCE, 1)
    typed = kind.isin(*REFERENCE_TYPES)
    prefix = F.when(raw.contains("/"), F.lower(F.split(raw, "/")[0])).otherwise("")
    inferred = F.lit("Observation")
    for p, t in PREFIX_TYPES.items():
        inferred = F.when(prefix == p, t).otherwise(inferred)
    return F.when(raw != "", F.struct(
        F.when(typed, raw).alias("reference"), F.when(typed, kind).otherwise(inferred).alias("type"),
        F.when(~typed, raw).alias("identifier"), raw.alias("display")))


def references(evidence: Column, component_evidence: Column) -> Column:
    """Distinct references of an alert, its own evidence first."""
    trimmed = F.transform(F.concat(evidence, component_evidence), lambda e: F.trim(e))
    return F.transform(F.filter(F.array_distinct(trimmed), lambda e: e != ""), reference)


def patient_reference(patient: Column) -> Column:
    raw = F.trim(F.coalesce(patient, F.lit("")))
    return F.when(raw == "", "Patient/unknown").when(raw.startswith("Patient/"), raw).otherwise(
        F.concat(F.lit("Patient/"), raw))


def content_hash(rows: DataFrame, keys: Sequence[str], order: Sequence[str], line: Column, block: int = 1000,
                 hot: bool | None = None) -> DataFrame:
    """Hash of each key's ordered lines, as a tree of blocks.

    Lines are hashed ``block`` at a time and the block hashes again, until one is left, so no step ever
    holds more than ``block`` lines of a key.
    """
    keys = list(keys)
    level = numbered(rows.select(*keys, *order, line.alias("_line")), keys, order, "_n", hot).select(
        *keys, "_n", "_line")
    while True:
        level = level.groupBy(*keys, F.call_function("div", F.col("_n") - 1, F.lit(block)).alias("_b")).agg(
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))),
                                            lambda x: x["_line"]), "\n"), 256).alias("_line"))
        level = level.select(*keys, (F.col("_b") + 1).alias("_n"), "_line")
        most = level.agg(F.max("_n")).first()[0] or 1
        if most == 1:
            return level.select(*keys, F.col("_line").alias("content_hash"))
