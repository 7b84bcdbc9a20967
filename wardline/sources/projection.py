"""Clinical reading of the driver's ``events`` table.

The tables hold no clinical data, so every clinical query reads this deterministic projection of
``events``: no random or hash functions, every row used. Clocks are microseconds since the epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.session import use_utc

T0_US = 1_704_067_200_000_000  # 2024-01-01
MINUTE = 60_000_000
HOUR = 3_600_000_000

# Event type -> observation code.
UNITS = {"2160-0": "mg/dL", "777-3": "10*9/L", "1975-2": "mg/dL", "8478-0": "mmHg",
         "9269-2": "{score}", "2708-6": "%", "3150-0": "%"}


def div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# Observation code, reading and unit of an event, as SQL over (event_type, k, value, event_id).
_CODE = """CASE event_type WHEN 'click' THEN '2160-0' WHEN 'view' THEN '777-3' WHEN 'purchase' THEN '1975-2'
  WHEN 'signup' THEN '8478-0' ELSE CASE WHEN k < 34 THEN '9269-2' WHEN k < 67 THEN '2708-6' ELSE '3150-0' END END"""
_READING = """CASE code WHEN '2160-0' THEN 0.5D + value / 60D WHEN '777-3' THEN greatest(5D, 260D - 1.5D * value)
  WHEN '1975-2' THEN value / 30D WHEN '8478-0' THEN greatest(30D, 100D - value / 3D)
  WHEN '9269-2' THEN greatest(3D, 15D - cast(floor(value / 20D) AS double))
  WHEN '2708-6' THEN greatest(70D, 100D - value / 8D) ELSE least(100D, 21D + value / 3D) END"""
_UNIT = "CASE WHEN event_id % 23 = 0 THEN 'bad' " + " ".join(
    f"WHEN code = '{c}' THEN '{u}'" for c, u in UNITS.items()) + " END"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flat row per event: patient, encounter, clocks, code, value, unit, status, flag."""
    return (
        table(spark, sf_dir, "events")
        .selectExpr("event_id", "user_id", "event_type", "value", "cast(get_json_object(props, '$.k') AS int) AS k",
                    f"(unix_micros(cast(ts AS timestamp)) - {T0_US}) div 20 AS coff")
        .selectExpr("*", f"{_CODE} AS code")
        .selectExpr(
            "event_id", "user_id", "k", "event_type", "value AS raw_value",
            "concat('Patient/', user_id) AS patient_id",
            f"CASE WHEN event_id % 17 <> 0 THEN concat('Encounter/', user_id, '-', coff div {12 * HOUR}) END"
            " AS encounter_id",
            f"{T0_US} + coff AS event_us", f"{T0_US} + coff + (event_id % 13) * {MINUTE} AS ingest_us",
            "concat('ev-', event_id) AS idempotency_key", "code", f"{_READING} AS reading", f"{_UNIT} AS unit",
            "CASE WHEN event_id % 29 = 0 THEN 'entered-in-error' ELSE 'final' END AS status",
            "CASE k WHEN 0 THEN 'comfort_care' WHEN 1 THEN 'already_on_sepsis_protocol' END AS context_flag"))


def with_redeliveries(rows: DataFrame) -> DataFrame:
    """Every 31st event is delivered a second time, one minute later."""
    again = rows.where(F.col("event_id") % 31 == 0).withColumn("ingest_us", F.col("ingest_us") + MINUTE)
    return rows.unionByName(again)


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projection as stream records holding a nested Observation resource, with redeliveries."""
    resource = """named_struct('resourceType', 'Observation', 'id', cast(event_id AS string), 'status', status,
      'code', named_struct('coding', array(named_struct('system', 'http://loinc.org', 'code', code,
        'display', cast(null AS string))), 'text', cast(null AS string)),
      'valueQuantity', named_struct('value', reading, 'unit', unit, 'code', cast(null AS string)),
      'valueInteger', cast(null AS int), 'valueBoolean', cast(null AS boolean)) AS resource"""
    return with_redeliveries(readings(spark, sf_dir)).selectExpr(
        "event_id", "patient_id", "encounter_id", "'Observation' AS resource_type", resource, "event_us", "ingest_us",
        "idempotency_key", "if(context_flag IS NULL, cast(array() AS array<string>), array(context_flag)) AS context_flags")


def kidney_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``envelopes`` and, a microsecond after some of the readings, a condition that says end-stage renal disease or a procedure that starts dialysis."""
    r = readings(spark, sf_dir)
    facts = r.where("event_id % 61 = 7").selectExpr("*", "'Condition' AS kind", "'http://hl7.org/fhir/sid/icd-10' AS system", "'N18.6' AS fact").unionByName(
        r.where("event_id % 37 = 11").selectExpr("*", "'Procedure' AS kind", "'http://snomed.info/sct' AS system", "'302497006' AS fact"))
    resource = """named_struct('resourceType', kind, 'id', cast(event_id AS string), 'status', 'final',
      'code', named_struct('coding', array(named_struct('system', system, 'code', fact, 'display', cast(null AS string))), 'text', cast(null AS string)),
      'valueQuantity', named_struct('value', cast(null AS double), 'unit', cast(null AS string), 'code', cast(null AS string)),
      'valueInteger', cast(null AS int), 'valueBoolean', cast(null AS boolean)) AS resource"""
    return envelopes(spark, sf_dir).unionByName(facts.selectExpr(
        "event_id", "patient_id", "encounter_id", "kind AS resource_type", resource, "event_us + 1 AS event_us", "ingest_us",
        "concat(lower(kind), '-', event_id) AS idempotency_key", "cast(array() AS array<string>) AS context_flags"))


def medications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vasopressor infusions read from ``purchase`` rows: start, end, agent text and rate."""
    r = readings(spark, sf_dir).where(F.col("event_type") == "purchase")
    names = F.array(*[F.lit(x) for x in (
        "Norepinephrine 4 mg infusion", "EPINEPHrine drip", "DOPamine 400 mg",
        "Dobutamine infusion", "Vasopressin 20 units")])
    return r.select(
        "event_id", "user_id", "patient_id", "encounter_id", F.col("event_us").alias("start_us"),
        (F.col("event_us") + (F.col("event_id") % 240) * F.lit(MINUTE)).alias("end_us"),
        names[(F.col("event_id") % 5).cast("int")].alias("medication_text"),
        (F.col("raw_value") / F.lit(100.0)).alias("rate"), "idempotency_key", "event_us", "ingest_us",
    )


def kidney_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creatinine, urine volume and weight facts for the kidney timeline."""
    r = readings(spark, sf_dir).where(F.col("status") == "final")
    none_d, none_b = F.lit(None).cast("double"), F.lit(False)
    evidence = F.concat(F.lit("Observation/"), F.col("event_id").cast("string"))
    creatinine = r.where((F.col("code") == "2160-0") & (F.col("unit") != "bad")).select(
        "patient_id", "event_us", evidence.alias("evidence_id"), F.lit("creatinine").alias("kind"),
        F.col("reading").alias("creatinine"), none_d.alias("volume_ml"), none_d.alias("duration_h"),
        none_d.alias("ml_kg_h"), none_b.alias("anuria"), none_d.alias("weight_kg"), "status",
        F.col("ingest_us"))
    urine = r.where(F.col("event_type").isin("signup", "view")).select(
        "patient_id", "event_us", evidence.alias("evidence_id"), F.lit("urine").alias("kind"),
        none_d.alias("creatinine"), (F.col("raw_value") * F.lit(4.0)).alias("volume_ml"),
        (F.lit(1) + F.col("event_id") % 6).cast("double").alias("duration_h"),
        none_d.alias("ml_kg_h"), none_b.alias("anuria"), none_d.alias("weight_kg"), "status",
        F.col("ingest_us"))
    first = r.groupBy("patient_id").agg(F.min(F.struct("event_us", "event_id")).alias("f"))
    weight = first.select(
        "patient_id", F.col("f.event_us").alias("event_us"),
        F.concat(F.lit("Weight/"), F.col("f.event_id").cast("string")).alias("evidence_id"),
        F.lit("weight").alias("kind"), none_d.alias("creatinine"), none_d.alias("volume_ml"),
        none_d.alias("duration_h"), none_d.alias("ml_kg_h"), none_b.alias("anuria"),
        (F.lit(50) + F.col("f.event_id") % 50).cast("double").alias("weight_kg"),
        F.lit("final").alias("status"), F.col("f.event_us").alias("ingest_us"))
    return creatinine.unionByName(urine).unionByName(weight)


def infections(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir).where(F.col("k").between(90, 96))
    return r.select(
        "patient_id", F.col("event_us").alias("infection_us"),
        F.when(F.col("k") % 2 == 0, "culture").otherwise("antimicrobial").alias("kind"),
        F.concat(F.lit("Infection/"), F.col("event_id").cast("string")).alias("evidence_id"))


def hourly_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse hourly stay rows: one per event, hour number by event order within the user."""
    from wardline.operators.latest import numbered

    r = readings(spark, sf_dir)
    num = numbered(r.select("user_id", "event_us", "event_id", "k", "code", "reading"),
                   ["user_id"], ["event_us", "event_id"], "iculos")
    first = F.min(F.when(F.col("k") >= 97, F.col("iculos")))
    onset = num.groupBy("user_id").agg(first.alias("_onset"))

    def of(code: str, name: str) -> Column:
        return F.when(F.col("code") == code, F.col("reading")).alias(name)

    return num.join(onset, "user_id").select(
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("stay_id"), "iculos",
        F.when(F.col("iculos") >= F.col("_onset"), 1).otherwise(0).alias("sepsis_label"),
        of("8478-0", "map"), of("777-3", "platelets"), of("1975-2", "bilirubin"),
        of("2160-0", "creatinine"), of("2708-6", "o2sat"), of("3150-0", "fio2"),
        F.when((F.col("code") == "9269-2") & (F.col("k") % 2 == 0), F.lit(85.0) + F.col("reading"))
        .alias("sao2"))
