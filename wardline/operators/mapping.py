"""Clinical resource -> scorer input, with a reason for every row that cannot be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USABLE_STATUS = ("final", "amended", "corrected", "preliminary")

# Observation code -> (component, input column).
CODES = {
    "777-3": ("coagulation", "platelets"), "1975-2": ("liver", "bilirubin"),
    "2160-0": ("renal", "creatinine"), "9269-2": ("cns", "gcs"), "2708-6": ("respiration", "spo2"),
    "8478-0": ("cardiovascular", "map_mmhg"), "2703-7": ("respiration", "pao2"),
    "3150-0": ("respiration", "fio2"),
}
# Units accepted per code, lower case; an empty string accepts a missing unit.
UNITS_ALLOWED = {
    "1975-2": ("mg/dl",), "2160-0": ("mg/dl",), "8478-0": ("mmhg", "mm[hg]"),
    "2703-7": ("mmhg", "mm[hg]"), "2708-6": ("%", "percent", ""),
}
PLATELET_UNITS = ("10*9/l", "10^9/l", "x10^9/l", "10*3/ul", "10^3/ul", "k/ul")
PLATELET_COUNT_UNITS = ("/ul", "ul", "1/ul")

FIELDS = ("platelets", "bilirubin", "creatinine", "gcs", "spo2", "map_mmhg", "pao2", "fio2")


def primary_code(code: Column) -> Column:
    """First coding that has a code."""
    return F.get(F.filter(code.coding, lambda c: c.code.isNotNull()), F.lit(0)).code


def numeric_value(resource: Column) -> Column:
    return F.coalesce(resource.valueQuantity.value, resource.valueInteger.cast("double"))


def value_unit(resource: Column) -> Column:
    return F.coalesce(resource.valueQuantity.unit, resource.valueQuantity.code)


def evidence_id(resource: Column) -> Column:
    """``type/id``, null when either is missing."""
    return F.concat(resource.resourceType, F.lit("/"), resource.id)


def unit_allowed(unit: Column, *allowed: str) -> Column:
    """Case-insensitive allow-list; a missing unit fails unless listed as an empty string."""
    return F.lower(F.trim(F.coalesce(unit, F.lit("")))).isin(*allowed)


def platelets_10e9(value: Column, unit: Column) -> Column:
    """Platelets in 10^9/L. A bare per-microlitre count must be over 1000 to be believed."""
    return F.when(unit_allowed(unit, *PLATELET_UNITS), value).when(
        unit_allowed(unit, *PLATELET_COUNT_UNITS) & (value > 1000), value / F.lit(1000.0))


def oxygen_fraction(value: Column) -> Column:
    """Percent over 1 becomes a fraction; only (0, 1] is valid."""
    frac = F.when(value > 1.0, value / F.lit(100.0)).otherwise(value)
    return F.when((frac > 0) & (frac <= 1.0), frac)


def truncated(value: Column) -> Column:
    return value.cast("int")


def map_observations(df: DataFrame) -> DataFrame:
    """Add ``code``, ``component``, one typed input column per field, ``evidence_id`` and ``reason``.

    ``reason`` is null for usable rows and for unknown codes, which are ignored without an error.
    """
    r = F.col("resource")
    df = df.withColumns({
        "code": primary_code(r.code), "value": numeric_value(r), "unit": value_unit(r),
        "status": r.status, "evidence_id": evidence_id(r),
    })
    code, value, unit, status = F.col("code"), F.col("value"), F.col("unit"), F.col("status")
    known_code = code.isin(*CODES)
    bad_unit = F.when(code == "777-3", platelets_10e9(value, unit).isNull())
    for c, allowed in UNITS_ALLOWED.items():
        bad_unit = bad_unit.when(code == c, ~unit_allowed(unit, *allowed))
    reason = (
        F.when(status.isNotNull() & ~F.lower(status).isin(*USABLE_STATUS),
               F.concat(F.lit("invalid_status:"), status))
        .when(code.isNull(), "missing_code")
        .when(known_code & value.isNull(), "missing_value")
        .when(bad_unit.otherwise(F.lit(False)), "invalid_unit")
        .when((code == "9269-2") & ~truncated(value).between(3, 15), "invalid_gcs_range")
        .when((code == "3150-0") & oxygen_fraction(value).isNull(), "invalid_fio2_range")
    )
    component = F.lit(None).cast("string")
    for c, (name, _) in CODES.items():
        component = F.when(code == c, name).otherwise(component)
    df = df.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    clean = {"platelets": platelets_10e9(value, unit), "gcs": truncated(value), "fio2": oxygen_fraction(value)}
    fields = {
        field: F.when(ok & (code == c), clean.get(field, value)) for c, (_, field) in CODES.items()
    }
    return df.withColumns({"component": F.when(ok, component), **fields})


def pressor_agent(text: Column) -> Column:
    """Vasopressor named in a medication text; the longer name is tested before the one it contains."""
    t = F.lower(text)
    return (
        F.when(t.contains("norepinephrine"), "norepinephrine").when(t.contains("epinephrine"), "epinephrine")
        .when(t.contains("dopamine"), "dopamine").when(t.contains("dobutamine"), "dobutamine")
        .when(t.contains("vasopressin") | t.contains("phenylephrine"), "other"))


def medication_text(resource: Column) -> Column:
    concept = resource.medicationCodeableConcept
    shown = F.get(F.filter(concept.coding, lambda c: c.display.isNotNull()), F.lit(0)).display
    return F.coalesce(concept.text, shown, F.lit(""))


def map_medications(df: DataFrame) -> DataFrame:
    agent = pressor_agent(medication_text(F.col("resource")))
    return df.withColumns({
        "component": F.when(agent.isNotNull(), "cardiovascular"), "agent": agent,
        "on_pressor": F.when(agent.isNotNull(), F.lit(True)), "evidence_id": evidence_id(F.col("resource")),
    })


# Kidney observation codes.
CREATININE_CODE, URINE_CODE, ANURIA_CODES, DURATION_CODE = (
    "2160-0", "9187-6", ("anuria", "urine-anuria"), "duration-hours")
# ICD-10 and SNOMED CT codes of end-stage renal disease, and of dialysis in its forms.
FAILURE_CODES = ("N18.6", "46177005")
REPLACEMENT_CODES = ("265764009", "302497006", "714749008", "71192002")


def component_with(resource: Column, code: str) -> Column:
    """First sub-observation with the code (case-insensitive)."""
    return F.get(F.filter(resource.component, lambda c: F.lower(primary_code(c.code)) == code.lower()), F.lit(0))


def map_kidney(df: DataFrame, urine_code: str = URINE_CODE, anuria_codes=ANURIA_CODES, failure_codes=FAILURE_CODES, replacement_codes=REPLACEMENT_CODES) -> DataFrame:
    """Facts for the kidney timeline, with reject reasons: creatinine, urine-rate and anuria observations, conditions that say end-stage renal disease and
    procedures that start renal replacement."""
    r = F.col("resource")
    code, value, unit, status = primary_code(r.code), r.valueQuantity.value, value_unit(r), r.status
    is_cr, is_uo = code == CREATININE_CODE, code == urine_code
    is_an = F.lower(code).isin(*[a.lower() for a in anuria_codes])
    measured = is_cr | is_uo
    reason = (
        F.when(status.isNotNull() & ~F.lower(status).isin(*USABLE_STATUS), F.concat(F.lit("invalid_status:"), status))
        .when(measured & value.isNull(), "missing_value")
        .when(is_cr & ~unit_allowed(unit, "mg/dl"), "invalid_unit")
        .when(is_uo & ~unit_allowed(unit, "ml/kg/h", "ml/kg/hr"), "invalid_unit"))
    flag = F.coalesce(*[component_with(r, a).valueBoolean for a in anuria_codes])
    hours = component_with(r, DURATION_CODE).valueQuantity.value
    df = df.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return df.withColumns({
        "kind": F.when(ok & is_cr, "creatinine").when(ok & (is_uo | is_an), "urine")
        .when(ok & (r.resourceType == "Condition") & code.isin(*failure_codes), "esrd").when(ok & (r.resourceType == "Procedure") & code.isin(*replacement_codes), "rrt"),
        "creatinine": F.when(ok & is_cr, value),
        "as_baseline": F.when(ok & is_cr, F.coalesce(
            F.lower(F.to_json(r.interpretation)).contains("baseline"), F.lit(False))),
        "ml_kg_h": F.when(ok & is_uo, value),
        "duration_h": F.when(ok & is_uo, hours).when(ok & is_an, F.coalesce(hours, value)),
        "anuria": F.when(ok & is_uo, flag).when(ok & is_an, F.coalesce(r.valueBoolean, F.lit(True))),
        "evidence_id": evidence_id(r),
    })
