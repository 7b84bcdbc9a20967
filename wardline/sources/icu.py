"""ICU tables as compressed CSV, and nested stay documents as timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.times import lab_availability, table_time

# Item ids of the ICU tables, by concept.
LAB_ITEMS = {"creatinine": (50912, 52546), "platelets": (51265, 51704), "bilirubin": (50885, 53089)}
CHART_ITEMS = {"map_mmhg": (220052,), "spo2": (220277,), "fio2_percent": (223835,), "gcs_eye": (220739,),
               "gcs_verbal": (223900,), "gcs_motor": (223901,), "creatinine": (220615,), "bilirubin": (225690,),
               "platelets": (225678,)}
PRESSOR_ITEMS = {221906: "norepinephrine", 221289: "epinephrine", 229617: "epinephrine", 221662: "dopamine",
                 221653: "dobutamine"}
URINE_ITEMS = (226557, 226558, 226559, 226560, 226561, 226563, 226564, 226565, 226566, 226567, 226584, 226627,
               226631, 227489)


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a number that decides between equal times: the row id where there is one, else a hash of the whole row, which
    does not depend on how files are listed and split."""
    raw = spark.read.option("header", True).csv(path)
    row = F.expr("try_cast(row_id AS bigint)") if "row_id" in raw.columns else F.xxhash64(*raw.columns)
    return raw.withColumn("_row", row)


def _items(groups) -> list[int]:
    return sorted({i for g in groups.values() for i in g})


def _us(text: str) -> Column:
    return F.unix_micros(table_time(F.col(text)))


def _double(name: str) -> Column:
    return F.expr(f"try_cast({name} AS double)")


def read_icustays(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    stays = _csv(spark, path).select(
        "subject_id", F.coalesce("hadm_id", F.lit("")).alias("hadm_id"), "stay_id", _us("intime").alias("intime_us"),
        _us("outtime").alias("outtime_us"))
    return stays.orderBy("stay_id", "subject_id", "hadm_id").limit(limit) if limit else stays


def read_labs(spark: SparkSession, path: str, stays: DataFrame) -> DataFrame:
    """Lab values of the stays' subjects for the scored items; rows without a number are left out."""
    rows = _csv(spark, path).select(
        "subject_id", F.coalesce("hadm_id", F.lit("")).alias("lab_hadm"), F.col("itemid").cast("int").alias("itemid"),
        _us("charttime").alias("event_us"), _double("valuenum").alias("reading"), F.col("_row").alias("event_id"))
    return rows.where(F.col("itemid").isin(_items(LAB_ITEMS)) & F.col("reading").isNotNull()).join(
        stays.select("subject_id").distinct(), "subject_id", "left_semi")


def read_charts(spark: SparkSession, path: str, stays: DataFrame) -> DataFrame:
    rows = _csv(spark, path).select(
        "stay_id", F.col("itemid").cast("int").alias("itemid"), _us("charttime").alias("event_us"),
        _double("valuenum").alias("reading"), F.col("_row").alias("event_id"))
    return rows.where(F.col("itemid").isin(_items(CHART_ITEMS)) & F.col("reading").isNotNull()).join(
        stays.select("stay_id"), "stay_id", "left_semi")


def agent_of(itemid: Column) -> Column:
    case = F.lit("other")
    for item, agent in PRESSOR_ITEMS.items():
        case = F.when(itemid == item, agent).otherwise(case)
    return case


def read_infusions(spark: SparkSession, path: str, stays: DataFrame) -> DataFrame:
    rows = _csv(spark, path).select(
        "stay_id", F.col("itemid").cast("int").alias("itemid"), _us("starttime").alias("start_us"),
        _us("endtime").alias("end_us"), _double("rate").alias("dose"), "rateuom",
        F.col("_row").alias("event_id"))
    return rows.where(F.col("itemid").isin(list(PRESSOR_ITEMS))).withColumn("agent", agent_of(F.col("itemid"))).join(
        stays.select("stay_id"), "stay_id", "left_semi")


def read_urine(spark: SparkSession, path: str, stays: DataFrame) -> DataFrame:
    rows = _csv(spark, path).select(
        "stay_id", F.col("itemid").cast("int").alias("itemid"), _us("charttime").alias("event_us"),
        _double("value").alias("ml"))
    return rows.where(F.col("itemid").isin(list(URINE_ITEMS)) & F.col("ml").isNotNull()).join(
        stays.select("stay_id"), "stay_id", "left_semi")


def document_timeline(docs: DataFrame) -> DataFrame:
    """Stay documents as one row per fact, each with its clinical and its availability clock."""
    stay = ["stay_id", "subject_id", F.coalesce("hadm_id", F.lit("")).alias("hadm_id")]

    def part(column: str, kind: str, event: Column, available: Column, evidence: Column, value: bool) -> DataFrame:
        x = F.col("x")
        return docs.select(*stay, F.explode(column).alias("x")).select(
            "stay_id", "subject_id", "hadm_id", F.lit(kind).alias("kind"),
            (x.itemid if value else F.lit(None)).cast("long").alias("itemid"),
            (x.valuenum if value else F.lit(None)).cast("double").alias("valuenum"),
            (x.unit if value else F.lit(None)).cast("string").alias("unit"), event.alias("event_time"),
            F.coalesce(available, event).alias("availability_time"), evidence.alias("evidence_id"),
            x.code.alias("code"), x.display.alias("display"), F.coalesce(x.status, F.lit("final")).alias("status"),
            (F.lit(False) if value else F.coalesce(x.is_discharge_diagnosis, F.lit(False))).alias("is_discharge_diagnosis"),
        ).where(F.col("event_time").isNotNull())

    x = F.col("x")
    charted = table_time(x.charttime)
    onset = table_time(F.coalesce(x.onset, x.charttime))

    def default(prefix: str) -> Column:
        return F.coalesce(x.evidence_id, F.concat_ws("/", F.lit(prefix), x.itemid.cast("string"), x.charttime))

    labs = part("labs", "lab", charted, lab_availability(charted, table_time(x.storetime)), default("lab"), True)
    charts = part("charts", "chart", charted, charted, default("chart"), True)
    dx = part("conditions", "condition", onset, table_time(F.coalesce(x.availability_time, x.storetime)),
              F.coalesce(x.evidence_id, F.concat_ws("/", F.lit("condition"), x.code, onset.cast("string"))), False)
    return labs.unionByName(charts).unionByName(dx)


def timeline_envelopes(timeline: DataFrame, ingest_time: Column) -> DataFrame:
    """Timeline facts as stream envelopes in the order they became known."""
    dx = F.col("kind") == "condition"
    coding = F.when(F.col("code").isNotNull(), F.array(F.struct(
        F.when(dx, "http://hl7.org/fhir/sid/icd-10").otherwise("http://loinc.org").alias("system"), "code", "display")))
    resource = F.struct(
        F.when(dx, "Condition").otherwise("Observation").alias("resourceType"),
        F.replace(F.col("evidence_id"), F.lit("/"), F.lit("-")).alias("id"),
        F.when(~dx, F.col("status")).alias("status"),
        F.struct(coding.alias("coding"), F.when(F.col("code").isNull(), F.col("display")).alias("text")).alias("code"),
        F.when(~dx & F.col("valuenum").isNotNull(), F.struct(
            F.col("valuenum").alias("value"), "unit", F.col("unit").alias("code"))).alias("valueQuantity"),
        F.struct(F.concat(F.lit("Patient/"), "subject_id").alias("reference")).alias("subject"),
        F.when(dx & F.col("is_discharge_diagnosis"), "discharge_diagnosis").alias("category"))
    return timeline.select(
        F.concat(F.lit("Patient/"), "subject_id").alias("patient_id"),
        F.when(F.col("hadm_id") != "", F.concat(F.lit("Encounter/"), "hadm_id")).alias("encounter_id"),
        resource.resourceType.alias("resource_type"), resource.alias("resource"), "event_time",
        ingest_time.alias("ingest_time"), "availability_time", F.col("evidence_id").alias("idempotency_key"))
