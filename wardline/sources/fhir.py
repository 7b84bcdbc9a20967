"""Clinical bundles and resources as stream envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import ids
from wardline.functions.times import iso_time
from wardline.schemas import BUNDLE_FILE

SUPPORTED = ("Observation", "Condition", "MedicationAdministration", "MedicationRequest", "Procedure",
             "Encounter", "Patient", "DiagnosticReport")


def read_bundles(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Bundle files (one document per file, or one per line) and bare resources, one row per document."""
    docs = spark.read.schema(BUNDLE_FILE).option("multiLine", multi_line).json(path)
    return docs.withColumn("source_path", F.col("_metadata.file_path"))


def resources(docs: DataFrame) -> DataFrame:
    """One row per resource with the bundle's first patient as fallback."""
    is_bundle = F.col("resourceType") == "Bundle"
    bare = F.struct(*[F.col(f) for f in BUNDLE_FILE.fieldNames() if f != "entry"])
    patients = F.filter(F.col("entry"), lambda e: (e.resource.resourceType == "Patient") & e.resource.id.isNotNull())
    first = F.get(patients, F.lit(0)).resource.id
    own = F.when(F.col("resourceType") == "Patient", F.col("id"))
    inside = F.transform(F.col("entry"), lambda e: e.resource)
    listed = F.when(is_bundle, F.coalesce(inside, F.array())).when(F.col("resourceType").isNotNull(), F.array(bare))
    return docs.select(
        "source_path", F.concat(F.lit("Patient/"), F.coalesce(first, own)).alias("bundle_patient"),
        F.explode(listed).alias("resource")).where(F.col("resource").isNotNull())


def resource_time(r: Column, fallback: Column) -> Column:
    return F.coalesce(iso_time(r.effectiveDateTime), iso_time(r.authoredOn), iso_time(r.onsetDateTime),
                      iso_time(r.period.start), iso_time(r.meta.lastUpdated), fallback)


def patient_of(r: Column, bundle_patient: Column) -> Column:
    own = F.concat(F.lit("Patient/"), F.nullif(r.id, F.lit("")))
    ref = F.coalesce(r.subject.reference, r.patient.reference)
    return F.coalesce(F.when(r.resourceType == "Patient", own).otherwise(ref), bundle_patient)


def to_envelopes(res: DataFrame, ingest_time: Column, source: str = "fhir-bundle") -> DataFrame:
    """Stream envelopes; unsupported types and resources without a patient are left out."""
    r = F.col("resource")
    out = res.select(
        F.lit("1.0.0").alias("schema_version"), patient_of(r, F.col("bundle_patient")).alias("patient_id"),
        r.encounter.reference.alias("encounter_id"), r.resourceType.alias("resource_type"), "resource",
        resource_time(r, ingest_time).alias("event_time"), ingest_time.alias("ingest_time"),
        F.lit(None).cast("timestamp").alias("availability_time"), F.lit(source).alias("source"),
        ids.delivery_key(F.col("source_path"), r.resourceType, r.id, r.meta.versionId).alias("idempotency_key"),
        F.struct(F.lit("bundle-files").alias("adapter"), F.lit("1.0.0").alias("adapter_version"),
                 F.col("source_path").alias("raw_ref")).alias("provenance"))
    return out.where(F.col("resource_type").isin(*SUPPORTED) & F.col("patient_id").isNotNull())


def in_event_order(envelopes: DataFrame) -> DataFrame:
    return envelopes.orderBy("event_time", "patient_id", "idempotency_key")


def topic(resource_type: Column) -> Column:
    """Topic a resource travels on."""
    return F.when(resource_type == "Condition", "conditions").when(
        resource_type.isin("MedicationAdministration", "MedicationRequest"), "medications").otherwise("observations")


def write_topics(envelopes: DataFrame, path: str) -> None:
    """Envelopes as topic-shaped JSON lines, clustered by patient so a patient's order is kept."""
    rows = envelopes.select(topic(F.col("resource_type")).alias("topic"), F.col("patient_id").alias("key"),
                            F.to_json(F.struct(*envelopes.columns)).alias("value"))
    rows.write.mode("append").partitionBy("topic").json(path)
