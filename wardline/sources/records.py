"""Stream records, trusted facts and stored alerts parsed from JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline import ids
from wardline.functions.times import iso_time, stream_time, stream_time_reason
from wardline.schemas import ENVELOPE, TRUSTED_FACT

_BAD = "_malformed"


def parse_json(values: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Parse without losing anything: unreadable text ends up in ``_malformed``.

    Fields come out of a generator, below which no filter on them moves: it would parse the text again, once per field it names.
    """
    wide = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    parsed = F.from_json(column, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    return values.select(*values.columns, F.inline(F.array(parsed)))


def stream_records(values: DataFrame, column: str = "value") -> DataFrame:
    """Envelopes with parsed clocks and a dead-letter reason.

    A malformed record keeps a key derived from its content. A record without a patient or resource gets a reason of
    its own, and so reaches the dead letters.
    """
    rows = parse_json(values, ENVELOPE, column)
    bad = F.col(_BAD).isNotNull() | F.col(column).isNull()
    rows = rows.withColumns({
        "reason": F.when(bad, "malformed_json").when(F.col("patient_id").isNull() | F.col("resource").isNull(), "no_patient_or_resource").otherwise(
            stream_time_reason(F.col("event_time"), F.col("ingest_time"))),
        "idempotency_key": F.when(bad, F.concat(F.lit("parse-"), ids.name_uuid(F.coalesce(column, F.lit("")))))
        .otherwise(F.col("idempotency_key")),
        "event_us": F.unix_micros(stream_time(F.col("event_time"))),
        "context_flags": F.coalesce("context_flags", F.array().cast("array<string>")),
    })
    rows = rows.withColumn("ingest_us", F.when(
        F.trim(F.coalesce("ingest_time", F.lit(""))) == "", F.col("event_us")).otherwise(
        F.unix_micros(stream_time(F.col("ingest_time")))))
    return rows.drop(_BAD)


# Fixed values of the trusted-fact contract.
FACT_VERSION = "1.0.0"
FACT_TYPES = ("Observation", "Condition", "MedicationAdministration", "MedicationRequest", "Procedure", "Encounter",
              "Patient", "DiagnosticReport", "DocumentReference")
CHECKS = ("passed", "failed", "pending")


def trusted_facts(values: DataFrame, column: str = "value") -> DataFrame:
    """Parsed facts with ``parse_reason`` for unknown schemas and records that break the contract."""
    rows = parse_json(values, TRUSTED_FACT, column)
    e, s, v = F.col("extraction"), F.col("source"), F.col("validation")

    def empty(c):
        return F.coalesce(c, F.lit("")) == ""

    broken = (
        F.col(_BAD).isNotNull() | empty(F.col("event_id")) | empty(F.col("patient_id")) | empty(F.col("resource_type"))
        | empty(F.col("idempotency_key")) | iso_time(F.col("clinical_event_time")).isNull()
        | iso_time(F.col("availability_time")).isNull() | empty(s.system) | empty(s.resource_id) | empty(e.method)
        | ((e.method == "llm") & (empty(e.model) | empty(e.prompt_version)))
        | F.coalesce((e.confidence < 0) | (e.confidence > 1), F.lit(False)) | v.isNull())
    return rows.withColumn("parse_reason", F.when(
        ~F.coalesce(F.col("schema_version") == FACT_VERSION, F.lit(False)), "unknown_schema").when(
        broken, "schema_validation_error")).drop(_BAD)


def admit(facts: DataFrame, clock=None) -> DataFrame:
    """Ordered admission gate: ``outcome``, ``reason``, ``may_mutate_scoring``."""
    v = F.col("validation")
    review = F.coalesce(v.semantic_review, F.lit("not_required"))
    available = iso_time(F.col("availability_time"))
    now = F.coalesce(clock, available) if clock is not None else available
    status = F.lower(F.coalesce(F.col("resource").status, F.lit("")))
    cancelled = (status == "cancelled") | F.coalesce(
        F.lower(F.element_at("extensions", "cancelled")).isin("true", "1"), F.lit(False))
    trust = F.col("trust_status")
    checks = [
        (F.col("parse_reason").isNotNull(), "reject", F.col("parse_reason")),
        (~F.col("resource_type").isin(*FACT_TYPES), "reject", "unknown_resource_type"),
        (cancelled, "reject", "cancelled_tombstone"),
        (~v.provenance.eqNullSafe("passed"), "reject", "missing_or_failed_provenance_check"),
        (v.schema.eqNullSafe("failed") | v.terminology.eqNullSafe("failed"), "reject", "failed_validation"),
        (v.schema.eqNullSafe("pending") | v.terminology.eqNullSafe("pending"), "quarantine", "validation_pending"),
        (trust == "candidate", "quarantine", "candidate_not_trusted"),
        (trust.isin("quarantined", "rejected"), "reject", F.concat(F.lit("trust_status_"), trust)),
        (~trust.eqNullSafe("trusted"), "reject", "untrusted_status"),
        (~v.schema.eqNullSafe("passed") | ~v.terminology.eqNullSafe("passed"), "quarantine", "validation_incomplete"),
        (review == "failed", "reject", "semantic_review_failed"),
        (review == "pending", "quarantine", "semantic_review_pending"),
        ((F.col("extraction").method == "llm") & ~review.isin("passed", "not_required"), "quarantine",
         "llm_requires_semantic_review"),
        (available > now, "reject", "future_availability"),
    ]
    outcome, reason = F.lit("admit"), F.lit("trusted_validation_passed")
    for cond, out, why in reversed(checks):
        outcome = F.when(cond, out).otherwise(outcome)
        reason = F.when(cond, why).otherwise(reason)
    return facts.withColumns({"outcome": outcome, "reason": reason}).withColumn(
        "may_mutate_scoring", F.col("outcome") == "admit")


def admitted_envelopes(facts: DataFrame, ingest_time) -> DataFrame:
    """Admitted facts as stream envelopes. Documents are admitted but are not scored."""
    return facts.where(F.col("may_mutate_scoring") & (F.col("resource_type") != "DocumentReference")).select(
        "patient_id", "encounter_id", "resource_type", "resource",
        iso_time(F.col("clinical_event_time")).alias("event_time"), ingest_time.alias("ingest_time"),
        iso_time(F.col("availability_time")).alias("availability_time"), F.col("source.system").alias("source"),
        "idempotency_key",
        F.struct(F.concat(F.lit("trusted-fact-bridge/"), F.col("extraction.method")).alias("adapter"),
                 F.col("schema_version").alias("adapter_version"), F.col("source.resource_id").alias("raw_ref"))
        .alias("provenance"))


STORED_ALERT = T.StructType([T.StructField(n, t) for n, t in (
    ("alert_id", T.StringType()), ("patient_id", T.StringType()), ("encounter_id", T.StringType()),
    ("indicator", T.StringType()), ("event_time", T.StringType()), ("score", T.IntegerType()),
    ("completeness", T.StringType()), ("tier", T.StringType()), ("routing", T.StringType()),
    ("suppressed", T.BooleanType()), ("rule_bundle_id", T.StringType()), ("rule_version", T.StringType()),
    ("idempotency_key", T.StringType()))])


def alert_records(values: DataFrame, column: str = "value") -> DataFrame:
    """Alerts from JSON; without an id, a patient or a readable time there is no alert."""
    rows = parse_json(values, STORED_ALERT, column).drop(_BAD)
    rows = rows.withColumn("event_us", F.unix_micros(iso_time(F.col("event_time"))))
    return rows.where(F.col("alert_id").isNotNull() & F.col("patient_id").isNotNull() & F.col("event_us").isNotNull())
