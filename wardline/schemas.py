"""Fixed, versioned record layouts. Payloads that do not fit them go to the dead-letter output."""

from __future__ import annotations

from pyspark.sql import types as T


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_STR, _DBL, _INT, _LONG, _BOOL, _TS = (
    T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType(),
)

CODING = _s(("system", _STR), ("code", _STR), ("display", _STR))
CODEABLE = _s(("coding", T.ArrayType(CODING)), ("text", _STR))
QUANTITY = _s(("value", _DBL), ("unit", _STR), ("code", _STR))
REFERENCE = _s(("reference", _STR))
COMPONENT = _s(("code", CODEABLE), ("valueQuantity", QUANTITY), ("valueBoolean", _BOOL))

# The part of a clinical resource that the scorers read.
RESOURCE = _s(
    ("resourceType", _STR), ("id", _STR), ("status", _STR), ("code", CODEABLE),
    ("valueQuantity", QUANTITY), ("valueInteger", _INT), ("valueBoolean", _BOOL),
    ("interpretation", T.ArrayType(CODEABLE)), ("component", T.ArrayType(COMPONENT)),
    ("medicationCodeableConcept", CODEABLE), ("subject", REFERENCE), ("patient", REFERENCE),
    ("encounter", REFERENCE), ("effectiveDateTime", _STR), ("authoredOn", _STR),
    ("onsetDateTime", _STR), ("period", _s(("start", _STR))),
    ("meta", _s(("lastUpdated", _STR), ("versionId", _STR))), ("issued", _STR),
)

BUNDLE_FILE = T.StructType(
    list(RESOURCE.fields) + [T.StructField("entry", T.ArrayType(_s(("resource", RESOURCE))))]
)

# A stream record: one clinical fact with its clocks and origin. Times stay text until parsed.
ENVELOPE = _s(
    ("schema_version", _STR), ("patient_id", _STR), ("encounter_id", _STR), ("resource_type", _STR),
    ("resource", RESOURCE), ("event_time", _STR), ("ingest_time", _STR), ("availability_time", _STR),
    ("source", _STR), ("idempotency_key", _STR),
    ("provenance", _s(("adapter", _STR), ("adapter_version", _STR), ("raw_ref", _STR))),
    ("context_flags", T.ArrayType(_STR)),
)

TRUSTED_FACT = _s(
    ("schema_version", _STR), ("event_id", _STR), ("patient_id", _STR), ("encounter_id", _STR),
    ("resource_type", _STR), ("resource", RESOURCE), ("clinical_event_time", _STR),
    ("availability_time", _STR), ("trust_status", _STR),
    ("source", _s(("system", _STR), ("resource_id", _STR))),
    ("extraction", _s(("method", _STR), ("model", _STR), ("prompt_version", _STR), ("confidence", _DBL))),
    ("validation", _s(("schema", _STR), ("terminology", _STR), ("provenance", _STR), ("semantic_review", _STR))),
    ("idempotency_key", _STR), ("extensions", T.MapType(_STR, _STR)),
)

ALERT = _s(
    ("alert_id", _STR), ("patient_id", _STR), ("encounter_id", _STR), ("indicator", _STR),
    ("event_time", _TS), ("ingest_time", _TS), ("score", _INT), ("completeness", _STR), ("tier", _STR),
    ("routing", _STR), ("suppressed", _BOOL), ("suppression_reason", _STR),
    ("page_deferred_reason", _STR), ("positive_components", _INT),
    ("missing_components", T.ArrayType(_STR)), ("evidence_ids", T.ArrayType(_STR)),
    ("rule_bundle_id", _STR), ("rule_version", _STR),
)

DEAD_LETTER = _s(
    ("patient_id", _STR), ("encounter_id", _STR), ("event_time", _STR), ("ingest_time", _STR),
    ("idempotency_key", _STR), ("reason", _STR), ("resource_type", _STR), ("resource_id", _STR),
    ("code", _STR), ("unit", _STR), ("status", _STR),
)

# One ICU stay with its nested lab, chart and diagnosis lists.
STAY_DOCUMENT = _s(
    ("stay_id", _STR), ("subject_id", _STR), ("hadm_id", _STR), ("split_id", _STR),
    ("intime", _STR), ("outtime", _STR),
    ("labels", _s(("sepsis3_onset", _STR), ("aki_kdigo_stage_ge_1", _BOOL))),
    ("labs", T.ArrayType(_s(
        ("itemid", _LONG), ("code", _STR), ("display", _STR), ("valuenum", _DBL), ("unit", _STR),
        ("charttime", _STR), ("storetime", _STR), ("evidence_id", _STR), ("status", _STR)))),
    ("charts", T.ArrayType(_s(
        ("itemid", _LONG), ("code", _STR), ("display", _STR), ("valuenum", _DBL), ("unit", _STR),
        ("charttime", _STR), ("evidence_id", _STR), ("status", _STR)))),
    ("conditions", T.ArrayType(_s(
        ("code", _STR), ("display", _STR), ("onset", _STR), ("charttime", _STR),
        ("availability_time", _STR), ("storetime", _STR), ("evidence_id", _STR), ("status", _STR),
        ("is_discharge_diagnosis", _BOOL)))),
)
