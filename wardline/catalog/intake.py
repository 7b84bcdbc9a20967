"""Reading, parsing, mapping and admitting records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalog.base import ARRIVED, READINGS, SNAPSHOTS, query, uuid_sql
from wardline.functions import times
from wardline.operators import evidence, latest, mapping, text
from wardline.plans import snapshots as snap
from wardline.rules import bundle_table, newest_rules
from wardline.session import new_path
from wardline.sources import fhir, projection as P, records, stays

UTC0 = "1704067200000000"


def _text_table(spark: SparkSession, rows: DataFrame, label: str) -> DataFrame:
    """Write one JSON document per line to the shared folder and read the lines back."""
    path = new_path(spark, label)
    rows.select("value").write.text(path)
    return spark.read.text(path)


# --- observation mapping ------------------------------------------------------------------------

# Variants of unit, status, value and code that exercise every reject reason; valid in both dialects.
_V = {
    "v_code": "CASE WHEN k % 31 = 7 THEN NULL WHEN k % 31 = 8 THEN '0000-0' WHEN k % 31 = 9 THEN '2703-7' ELSE code END",
    "v_status": "CASE k % 12 WHEN 0 THEN 'amended' WHEN 1 THEN 'Corrected' WHEN 2 THEN 'cancelled' WHEN 3 THEN NULL ELSE status END",
    "v_unit": "CASE WHEN unit = 'bad' THEN 'bad' WHEN code = '777-3' THEN CASE k % 6 WHEN 0 THEN 'K/uL' WHEN 1 THEN '/uL' "
              "WHEN 2 THEN NULL WHEN 3 THEN ' 10^9/l ' ELSE unit END WHEN k % 9 = 4 THEN NULL WHEN k % 9 = 5 THEN lower(unit) "
              "WHEN code = '8478-0' AND k % 9 = 6 THEN 'mm[Hg]' ELSE unit END",
    "v_value": "CASE WHEN k % 13 = 5 THEN NULL WHEN code = '777-3' AND k % 2 = 1 THEN reading * 1000 "
               "WHEN code = '9269-2' AND k % 7 = 3 THEN reading + 12 WHEN code = '3150-0' AND k % 7 = 3 THEN 0 - reading "
               "WHEN code = '3150-0' AND k % 7 = 4 THEN reading / 100 ELSE reading END",
}
_MAPPED = f"""WITH {READINGS},
v0 AS (SELECT event_id, {', '.join(f'{e} AS {n}' for n, e in _V.items())} FROM rd),
v AS (SELECT *, lower(trim(coalesce(v_unit, ''))) AS u,
  CASE v_code WHEN '777-3' THEN 'coagulation' WHEN '1975-2' THEN 'liver' WHEN '2160-0' THEN 'renal' WHEN '9269-2' THEN 'cns'
    WHEN '8478-0' THEN 'cardiovascular' WHEN '2708-6' THEN 'respiration' WHEN '2703-7' THEN 'respiration'
    WHEN '3150-0' THEN 'respiration' END AS comp FROM v0),
pl AS (SELECT *, CASE WHEN u IN ('10*9/l','10^9/l','x10^9/l','10*3/ul','10^3/ul','k/ul') THEN v_value
    WHEN u IN ('/ul','ul','1/ul') AND v_value > 1000 THEN v_value / 1000 END AS plt,
    CASE WHEN v_value > 1 THEN v_value / 100 ELSE v_value END AS frac FROM v),
m AS (SELECT *, CASE
    WHEN v_status IS NOT NULL AND lower(v_status) NOT IN ('final','amended','corrected','preliminary') THEN 'invalid_status:' || v_status
    WHEN v_code IS NULL THEN 'missing_code' WHEN comp IS NULL THEN NULL WHEN v_value IS NULL THEN 'missing_value'
    WHEN v_code = '777-3' AND plt IS NULL THEN 'invalid_unit'
    WHEN v_code IN ('1975-2','2160-0') AND u <> 'mg/dl' THEN 'invalid_unit'
    WHEN v_code IN ('8478-0','2703-7') AND u NOT IN ('mmhg','mm[hg]') THEN 'invalid_unit'
    WHEN v_code = '2708-6' AND u NOT IN ('%','percent','') THEN 'invalid_unit'
    WHEN v_code = '9269-2' AND (trunc(v_value) < 3 OR trunc(v_value) > 15) THEN 'invalid_gcs_range'
    WHEN v_code = '3150-0' AND NOT (frac > 0 AND frac <= 1) THEN 'invalid_fio2_range' END AS reason FROM pl)"""


def _variants(spark: SparkSession, sf: str) -> DataFrame:
    r = P.readings(spark, sf).selectExpr("event_id", *[f"{e} AS {n}" for n, e in _V.items()])
    # The code sits in the second coding of every other record, behind one without a code.
    return r.selectExpr("event_id", """named_struct('resourceType', 'Observation', 'id', cast(event_id AS string), 'status', v_status,
      'code', named_struct('coding', if(event_id % 2 = 0, array(named_struct('system', 'x', 'code', cast(null AS string), 'display', ''),
        named_struct('system', 'http://loinc.org', 'code', v_code, 'display', '')),
        array(named_struct('system', 'http://loinc.org', 'code', v_code, 'display', ''))), 'text', ''),
      'valueQuantity', named_struct('value', v_value, 'unit', if(event_id % 3 = 0, cast(null AS string), v_unit), 'code', v_unit),
      'valueInteger', cast(null AS int)) AS resource""")


@query("observation_mapping", "PRJ-9 PRJ-10 PRJ-11 PRJ-12 PRJ-13 FLT-2 FLT-3 FLT-4", f"""{_MAPPED}
SELECT event_id, reason, CASE WHEN reason IS NULL THEN comp END AS component, 'Observation/' || event_id AS evidence_id,
  CASE WHEN reason IS NULL AND v_code = '777-3' THEN plt END AS platelets,
  CASE WHEN reason IS NULL AND v_code = '2160-0' THEN v_value END AS creatinine,
  CASE WHEN reason IS NULL AND v_code = '9269-2' THEN trunc(v_value)::INT END AS gcs,
  CASE WHEN reason IS NULL AND v_code = '3150-0' THEN frac END AS fio2,
  CASE WHEN reason IS NULL AND v_code = '2703-7' THEN v_value END AS pao2 FROM m""")
def observation_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Resources mapped to scorer inputs, every reject with its reason."""
    return mapping.map_observations(_variants(spark, sf)).select(
        "event_id", "reason", "component", "evidence_id", "platelets", "creatinine", "gcs", "fio2", "pao2")


@query("dead_letters", "SNK-2 FLT-1 FLT-2 FLT-3 FLT-4 STR-6", f"""WITH {ARRIVED}
SELECT reason, count(*) AS n, count(DISTINCT patient_id) AS n_patients FROM (
  SELECT patient_id, CASE WHEN late THEN 'late_beyond_lateness' ELSE reason END AS reason FROM mp) WHERE reason IS NOT NULL GROUP BY reason""")
def dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    """Rejected and late records by reason."""
    rows, _ = snap.validated(P.envelopes(spark, sf))
    return rows.where(F.col("reason").isNotNull()).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("patient_id").alias("n_patients"))


@query("medication_mapping", "PRJ-14 FLT-10", f"""WITH {READINGS}
SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'norepinephrine' WHEN 1 THEN 'epinephrine' WHEN 2 THEN 'dopamine' WHEN 3 THEN 'dobutamine'
  WHEN 4 THEN 'other' WHEN 5 THEN 'other' END AS agent, CASE WHEN event_id % 7 < 6 THEN true END AS on_pressor,
  'MedicationAdministration/' || event_id AS evidence_id FROM rd WHERE event_type = 'purchase'""")
def medication_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Vasopressor agent from medication text or coding display."""
    r = P.readings(spark, sf).where(F.col("event_type") == "purchase").selectExpr("event_id", """named_struct(
      'resourceType', 'MedicationAdministration', 'id', cast(event_id AS string),
      'medicationCodeableConcept', named_struct('text', CASE event_id % 7 WHEN 0 THEN 'NOREPINEPHRINE 8 mg' WHEN 1 THEN 'epinephrine'
        WHEN 2 THEN 'Dopamine 400' WHEN 4 THEN 'Vasopressin' WHEN 6 THEN 'Paracetamol' END,
        'coding', array(named_struct('code', 'x', 'display', CASE event_id % 7 WHEN 3 THEN 'DOBUTamine' WHEN 5 THEN 'phenylephrine' ELSE 'unused' END)))) AS resource""")
    return mapping.map_medications(r).select("event_id", "agent", "on_pressor", "evidence_id")


@query("kidney_mapping", "PRJ-15", f"""WITH {READINGS}, v AS (SELECT event_id, k, raw_value, k % 4 AS kind FROM rd)
SELECT event_id, CASE WHEN k % 10 = 9 THEN 'invalid_status:unknown' WHEN kind IN (0, 1) AND k % 10 = 8 THEN 'missing_value'
    WHEN kind IN (0, 1) AND k % 10 = 7 THEN 'invalid_unit' END AS reason,
  CASE WHEN k % 10 = 9 OR (kind IN (0, 1) AND k % 10 IN (7, 8)) OR kind = 3 THEN NULL WHEN kind = 0 THEN 'creatinine' ELSE 'urine' END AS kind,
  CASE WHEN kind = 0 AND k % 10 < 7 THEN raw_value / 20 END AS creatinine,
  CASE WHEN kind = 0 AND k % 10 < 7 THEN k % 3 = 0 END AS as_baseline,
  CASE WHEN kind = 1 AND k % 10 < 7 THEN raw_value / 50 END AS ml_kg_h,
  CASE WHEN (kind = 1 AND k % 10 < 7) OR (kind = 2 AND k % 10 <> 9) THEN (k % 24)::DOUBLE END AS duration_h,
  CASE WHEN kind = 1 AND k % 10 < 7 THEN k % 5 = 0 WHEN kind = 2 AND k % 10 <> 9 THEN true END AS anuria FROM v""")
def kidney_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Creatinine, urine rate and anuria observations with durations in sub-observations."""
    coding = "named_struct('coding', array(named_struct('system', '', 'code', {c}, 'display', '')), 'text', '')"
    empty_q = "cast(null AS struct<value:double,unit:string,code:string>)"
    r = P.readings(spark, sf).selectExpr("event_id", f"""named_struct('resourceType', 'Observation', 'id', cast(event_id AS string),
      'status', if(k % 10 = 9, 'unknown', 'final'),
      'code', {coding.format(c="CASE k % 4 WHEN 0 THEN '2160-0' WHEN 1 THEN '9187-6' WHEN 2 THEN 'Anuria' ELSE '1-1' END")},
      'valueQuantity', named_struct('value', CASE WHEN k % 4 = 2 OR k % 10 = 8 THEN null WHEN k % 4 = 0 THEN raw_value / 20D ELSE raw_value / 50D END,
        'unit', CASE WHEN k % 10 = 7 THEN 'mmol' WHEN k % 4 = 0 THEN 'MG/dL' ELSE 'mL/kg/hr' END, 'code', ''),
      'valueBoolean', cast(null AS boolean),
      'interpretation', array(named_struct('text', if(k % 3 = 0, 'Baseline value', 'x'))),
      'component', array(named_struct('code', {coding.format(c="'duration-hours'")}, 'valueQuantity', named_struct('value', cast(k % 24 AS double), 'unit', 'h', 'code', 'h'), 'valueBoolean', cast(null AS boolean)),
        named_struct('code', {coding.format(c="'urine-anuria'")}, 'valueQuantity', {empty_q}, 'valueBoolean', k % 5 = 0))) AS resource""")
    return mapping.map_kidney(r).select("event_id", "reason", "kind", "creatinine", "as_baseline", "ml_kg_h", "duration_h", "anuria")


# --- clocks, keys, hashes, versions -------------------------------------------------------------

@query("stream_clocks", "PRJ-5 PRJ-7 PRJ-8", f"""WITH {READINGS}, t AS (SELECT event_id, k % 8 AS v, (event_us // 1000000) * 1000 AS ms FROM rd)
SELECT event_id, CASE WHEN v IN (0, 6) THEN 0 WHEN v = 3 THEN ms - 7200000 WHEN v IN (4, 7) THEN NULL WHEN v = 5 THEN ms + 250 ELSE ms END AS event_ms,
  CASE WHEN v IN (4, 7) THEN 'invalid_timestamp' END AS reason,
  CASE WHEN v IN (0, 4, 6, 7) THEN NULL WHEN v = 3 THEN ms - 7200000 WHEN v = 5 THEN ms + 250 ELSE ms END AS table_ms,
  CASE WHEN v IN (0, 4, 6, 7) THEN ms + 60000 WHEN v = 3 THEN ms - 7200000 WHEN v = 5 THEN ms + 250 ELSE ms END AS available_ms FROM t""")
def stream_clocks(spark: SparkSession, sf: str) -> DataFrame:
    """Clock texts in eight forms, blank and broken ones included."""
    at = "timestamp_micros((event_us div 1000000) * 1000000)"
    r = P.readings(spark, sf).selectExpr("event_id", "event_us", f"""CASE k % 8 WHEN 0 THEN '' WHEN 1 THEN date_format({at}, "yyyy-MM-dd HH:mm:ss")
      WHEN 2 THEN date_format({at}, "yyyy-MM-dd'T'HH:mm:ss'Z'") WHEN 3 THEN concat(date_format({at}, "yyyy-MM-dd'T'HH:mm:ss"), '+02:00')
      WHEN 4 THEN 'not-a-time' WHEN 5 THEN concat(date_format({at}, "yyyy-MM-dd HH:mm:ss"), '.250') WHEN 7 THEN '2024-13-45 00:00:00' END AS t""")
    c = F.col("t")
    fallback = F.timestamp_micros(F.expr("(event_us div 1000000) * 1000000 + 60000000"))
    return r.select("event_id", F.unix_millis(times.stream_time(c)).alias("event_ms"),
                    times.stream_time_reason(c, F.lit("")).alias("reason"), F.unix_millis(times.table_time(c)).alias("table_ms"),
                    F.unix_millis(times.availability(times.table_time(c), fallback)).alias("available_ms"))


@query("lab_availability", "PRJ-6 SRT-1", f"""WITH {READINGS}
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_us WHEN event_id % 5 = 1 THEN event_us ELSE ingest_us END AS available_us,
  row_number() OVER (PARTITION BY patient_id ORDER BY CASE WHEN event_id % 5 < 2 THEN event_us ELSE ingest_us END, event_us,
    'Observation/' || event_id) AS position FROM rd""")
def lab_availability(spark: SparkSession, sf: str) -> DataFrame:
    """When a lab became known, and the order in which facts became known."""
    r = P.readings(spark, sf).selectExpr("event_id", "patient_id", "event_us", "concat('Observation/', event_id) AS evidence_id",
                                         "CASE event_id % 5 WHEN 0 THEN null WHEN 1 THEN event_us - 60000000 ELSE ingest_us END AS stored_us")
    r = r.withColumn("available_us", times.lab_availability(F.col("event_us"), F.col("stored_us")))
    return latest.numbered(r, ["patient_id"], ["available_us", "event_us", "evidence_id"], "position").select(
        "event_id", "available_us", "position")


@query("rule_versions", "PRJ-21 STR-9 SRC-3 SNK-7", f"""WITH {READINGS},
v AS (SELECT event_id, 'bundle-' || (user_id % 5) AS bundle_id, k % 3 AS a, k % 11 AS b, event_id % 13 AS c FROM rd),
w AS (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY a DESC, b DESC, c DESC, event_id DESC) AS rn FROM v)
SELECT bundle_id, a || '.' || b || '.' || c || '-rc+b7' AS version, event_id AS arrival FROM w WHERE rn = 1""")
def rule_versions(spark: SparkSession, sf: str) -> DataFrame:
    """State of the rules after a stream of updates: numeric version order, no silent rollback."""
    r = P.readings(spark, sf).selectExpr(
        "concat('bundle-', user_id % 5) AS bundle_id", "concat_ws('.', k % 3, k % 11, concat(event_id % 13, '-rc+b7')) AS version",
        "event_id AS arrival")
    return newest_rules(r)


@query("alert_rules_join", "JOI-1 SRC-13 GOV-14", f"""WITH {SNAPSHOTS},
b(bundle_id, version, refractory, gate) AS (VALUES ('sepsis-sofa','0.3.0',90,true), ('aki-kdigo','0.4.0',180,true),
  ('resp-deterioration','0.1.0',180,true), ('hemo-shock','0.1.0',60,true)),
a AS (SELECT *, CASE k % 5 WHEN 0 THEN 'sepsis-sofa' WHEN 1 THEN 'aki-kdigo' WHEN 2 THEN 'hemo-shock' WHEN 3 THEN 'resp-deterioration' ELSE 'gone' END AS bundle_id FROM snap)
SELECT a.bundle_id, coalesce(version, 'default') AS version, coalesce(refractory, 120) AS refractory, coalesce(gate, false) AS gate, count(*) AS n
FROM a LEFT JOIN b USING (bundle_id) GROUP BY ALL""")
def alert_rules_join(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots joined to the active rules, with defaults where a bundle is not active."""
    rows = snap.snapshots(P.envelopes(spark, sf))
    k = P.readings(spark, sf).select("event_id", F.col("k").alias("kk"))
    rows = rows.join(k, "event_id").withColumn("bundle_id", F.expr(
        "CASE kk % 5 WHEN 0 THEN 'sepsis-sofa' WHEN 1 THEN 'aki-kdigo' WHEN 2 THEN 'hemo-shock' WHEN 3 THEN 'resp-deterioration' ELSE 'gone' END"))
    rules = bundle_table(spark).where("active").select("bundle_id", "version", "refractory_minutes", "page_gate_enabled")
    # One row per installed bundle.
    return rows.join(F.broadcast(rules), "bundle_id", "left").groupBy(
        "bundle_id", F.coalesce("version", F.lit("default")).alias("version"),
        F.coalesce("refractory_minutes", F.lit(120)).alias("refractory"),
        F.coalesce("page_gate_enabled", F.lit(False)).alias("gate")).agg(F.count(F.lit(1)).alias("n"))


@query("timeline_hash", "PRJ-20", f"""WITH {READINGS},
l AS (SELECT patient_id, row_number() OVER (PARTITION BY patient_id ORDER BY event_us, idempotency_key) - 1 AS n,
  patient_id || '|' || idempotency_key || '|' || event_us || '|' || ingest_us || '|' || code AS line FROM rd),
b AS (SELECT patient_id, n // 16 AS b, sha256(string_agg(line, chr(10) ORDER BY n)) AS h FROM l GROUP BY ALL),
c AS (SELECT patient_id, b // 16 AS b2, sha256(string_agg(h, chr(10) ORDER BY b)) AS h FROM b GROUP BY ALL),
top AS (SELECT max(b2) AS m FROM c)
SELECT patient_id, CASE WHEN (SELECT m FROM top) = 0 THEN min(h) END AS content_hash FROM c GROUP BY patient_id""")
def timeline_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Order-sensitive hash of each patient's history, hashed in blocks of sixteen."""
    r = P.readings(spark, sf)
    line = F.concat_ws("|", "patient_id", "idempotency_key", "event_us", "ingest_us", "code")
    return evidence.content_hash(r, ["patient_id"], ["event_us", "idempotency_key"], line, block=16)


@query("evidence_references", "PRJ-23", f"""WITH {READINGS},
e AS (SELECT event_id, patient_id, CASE k % 8 WHEN 0 THEN 'Observation/' || event_id WHEN 1 THEN 'lab/plt-' || event_id WHEN 2 THEN 'dx/' || event_id
  WHEN 3 THEN 'note/' || event_id WHEN 4 THEN ' Condition/c' || event_id || ' ' WHEN 5 THEN 'med/' || event_id WHEN 6 THEN 'plain' ELSE 'Widget/' || event_id END AS raw, k FROM rd),
f AS (SELECT *, trim(raw) AS t FROM e)
SELECT event_id, patient_id, 2 AS n_refs, CASE WHEN k % 8 IN (0, 4) THEN t END AS reference,
  CASE k % 8 WHEN 2 THEN 'Condition' WHEN 3 THEN 'DocumentReference' WHEN 4 THEN 'Condition' WHEN 5 THEN 'MedicationAdministration' ELSE 'Observation' END AS type,
  CASE WHEN k % 8 NOT IN (0, 4) THEN t END AS identifier FROM f""")
def evidence_references(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence ids of alerts and their components as distinct references."""
    r = P.readings(spark, sf).selectExpr("event_id", "patient_id", """CASE k % 8 WHEN 0 THEN concat('Observation/', event_id)
      WHEN 1 THEN concat('lab/plt-', event_id) WHEN 2 THEN concat('dx/', event_id) WHEN 3 THEN concat('note/', event_id)
      WHEN 4 THEN concat(' Condition/c', event_id, ' ') WHEN 5 THEN concat('med/', event_id) WHEN 6 THEN 'plain' ELSE concat('Widget/', event_id) END AS raw""")
    refs = evidence.references(F.array(F.col("raw"), F.lit(" ")), F.array(F.trim("raw"), F.lit("chart/map-low")))
    return r.withColumn("refs", refs).select(
        "event_id", evidence.patient_reference(F.col("patient_id")).alias("patient_id"), F.size("refs").alias("n_refs"),
        F.col("refs")[0].reference.alias("reference"), F.col("refs")[0].type.alias("type"), F.col("refs")[0].identifier.alias("identifier"))


# --- files --------------------------------------------------------------------------------------

def _bundle_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Bundles of one user's events, at most 500 event numbers wide, one JSON document per line."""
    r = P.readings(spark, sf).selectExpr(
        "event_id", "user_id", "event_id div 500 AS part", """named_struct('resource', named_struct(
          'resourceType', CASE k % 10 WHEN 0 THEN 'Condition' WHEN 1 THEN 'MedicationRequest' WHEN 2 THEN 'CarePlan' ELSE 'Observation' END,
          'id', cast(event_id AS string), 'subject', if(k % 4 = 0, null, named_struct('reference', patient_id)),
          'encounter', if(encounter_id IS NULL, null, named_struct('reference', encounter_id)),
          'effectiveDateTime', if(k % 5 = 0, null, date_format(timestamp_micros(event_us div 1000000 * 1000000), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
          'period', if(k % 10 = 5, named_struct('start', date_format(timestamp_micros(event_us div 1000000 * 1000000 + 1000000), "yyyy-MM-dd'T'HH:mm:ss'Z'")), null),
          'meta', named_struct('versionId', if(k % 3 = 0, null, '2')))) AS e""")
    docs = r.groupBy("user_id", "part").agg(F.collect_list("e").alias("entries"))
    return docs.selectExpr("""to_json(named_struct('resourceType', 'Bundle', 'id', concat(user_id, '-', part), 'entry',
      concat(array(named_struct('resource', named_struct('resourceType', 'Patient', 'id', if(user_id % 2 = 0, cast(user_id AS string), null),
        'subject', cast(null AS struct<reference:string>), 'encounter', cast(null AS struct<reference:string>), 'effectiveDateTime', cast(null AS string),
        'period', cast(null AS struct<start:string>), 'meta', cast(null AS struct<versionId:string>)))), entries))) AS value""")


_INGEST = "timestamp_micros(1704067200000000)"


def bundle_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "bundles")
    _bundle_lines(spark, sf).write.text(path)
    docs = fhir.read_bundles(spark, path, multi_line=False).withColumn("source_path", F.concat(F.lit("bundles/"), "id"))
    return fhir.to_envelopes(fhir.resources(docs), F.expr(_INGEST))


_BUNDLES_SQL = f"""WITH {READINGS},
r AS (SELECT event_id::VARCHAR AS rid, user_id, 'bundles/' || user_id || '-' || (event_id // 500) AS path,
    CASE k % 10 WHEN 0 THEN 'Condition' WHEN 1 THEN 'MedicationRequest' WHEN 2 THEN 'CarePlan' ELSE 'Observation' END AS resource_type,
    CASE WHEN k % 4 = 0 THEN CASE WHEN user_id % 2 = 0 THEN 'Patient/' || user_id END ELSE patient_id END AS patient_id, encounter_id,
    CASE WHEN k % 5 <> 0 THEN event_us // 1000000 WHEN k % 10 = 5 THEN event_us // 1000000 + 1 ELSE 1704067200 END AS event_s,
    CASE WHEN k % 3 = 0 THEN '0' ELSE '2' END AS ver FROM rd
  UNION ALL SELECT DISTINCT user_id::VARCHAR, user_id, 'bundles/' || user_id || '-' || (event_id // 500), 'Patient', 'Patient/' || user_id, NULL, 1704067200, '0'
  FROM rd WHERE user_id % 2 = 0),
env AS (SELECT *, substr(sha256(path || '|' || resource_type || '|' || rid || '|' || ver), 1, 32) AS idempotency_key,
  CASE resource_type WHEN 'Condition' THEN 'conditions' WHEN 'MedicationRequest' THEN 'medications' ELSE 'observations' END AS topic
  FROM r WHERE resource_type <> 'CarePlan' AND patient_id IS NOT NULL)"""


@query("bundle_envelopes", "SRC-4 SRC-5 PRJ-1 PRJ-2 PRJ-3 PRJ-4", f"""{_BUNDLES_SQL}
SELECT patient_id, encounter_id, resource_type, event_s, idempotency_key, topic FROM env""")
def bundles(spark: SparkSession, sf: str) -> DataFrame:
    """Bundle files exploded into envelopes with clocks, references and delivery keys."""
    return fhir.in_event_order(bundle_envelopes(spark, sf)).select(
        "patient_id", "encounter_id", "resource_type", F.unix_seconds("event_time").alias("event_s"), "idempotency_key",
        fhir.topic(F.col("resource_type")).alias("topic"))


@query("topic_replay", "SNK-3 SRC-1", f"""{_BUNDLES_SQL}
SELECT topic, count(*) AS n, count(DISTINCT patient_id) AS n_patients, count(DISTINCT idempotency_key) AS n_keys FROM env GROUP BY topic""")
def topic_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Envelopes written to topics and read back as stream records."""
    path = new_path(spark, "topics")
    fhir.write_topics(bundle_envelopes(spark, sf), path)
    back = spark.read.schema("key string, value string, topic string").json(path)
    parsed = records.stream_records(back)
    return parsed.where(F.col("reason").isNull()).groupBy("topic").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("patient_id").alias("n_patients"),
        F.countDistinct("idempotency_key").alias("n_keys"))


_JSON_TEXT = """concat('{"patient_id":"', patient_id, '","event_time":"', CASE k % 9 WHEN 3 THEN '' WHEN 4 THEN 'soon' ELSE '2024-01-02T03:04:05Z' END,
  '","ingest_time":"', CASE k % 9 WHEN 5 THEN 'later' ELSE '' END, '","idempotency_key":"', idempotency_key, '","resource":{"resourceType":"Observation","id":"',
  event_id, '"}}')"""


@query("malformed_records", "SRC-1 SRC-2", f"""WITH {READINGS}, t AS (SELECT event_id, k, patient_id, idempotency_key, {_JSON_TEXT} AS j FROM rd),
v AS (SELECT *, CASE WHEN event_id % 19 = 0 THEN substr(j, 1, length(j) - 5) ELSE j END AS value FROM t)
SELECT CASE WHEN event_id % 19 = 0 THEN 'malformed_json' WHEN k % 9 = 4 THEN 'invalid_timestamp' WHEN k % 9 = 5 THEN 'invalid_ingest_timestamp' END AS reason,
  CASE WHEN event_id % 19 = 0 THEN 'parse-' || {uuid_sql('value')} ELSE idempotency_key END AS idempotency_key,
  CASE WHEN event_id % 19 = 0 OR k % 9 = 4 THEN NULL WHEN k % 9 = 3 THEN 0 ELSE 1704164645000000 END AS event_us FROM v""")
def malformed_records(spark: SparkSession, sf: str) -> DataFrame:
    """Stream records from text; unreadable ones keep a key made from their content."""
    r = P.readings(spark, sf).selectExpr("event_id", f"{_JSON_TEXT} AS j").selectExpr(
        "if(event_id % 19 = 0, substr(j, 1, length(j) - 5), j) AS value")
    out = records.stream_records(_text_table(spark, r, "records"))
    return out.select("reason", "idempotency_key", F.when(
        ~F.coalesce(F.col("reason") == "malformed_json", F.lit(False)), F.col("event_us")).alias("event_us"))


_FACT_TEXT = """concat('{"schema_version":"', CASE WHEN k = 2 THEN '9.9' ELSE '1.0.0' END, '","event_id":"e', event_id, '","patient_id":"', patient_id,
  '","resource_type":"', CASE WHEN k = 3 THEN 'Gadget' WHEN k % 20 = 4 THEN 'DocumentReference' ELSE 'Observation' END,
  '","resource":{"resourceType":"Observation","status":"', CASE WHEN k = 5 THEN 'cancelled' ELSE 'final' END, '"},"clinical_event_time":"2024-01-02T03:04:05Z","availability_time":"',
  CASE WHEN k = 6 THEN '2025-01-01T00:00:00Z' ELSE '2024-01-02T04:00:00Z' END, '","trust_status":"', CASE k % 10 WHEN 1 THEN 'candidate' WHEN 2 THEN 'quarantined' ELSE 'trusted' END,
  '","source":{"system":"ehr","resource_id":"', CASE WHEN k = 7 THEN '' ELSE 'r1' END, '"},"extraction":{"method":"', CASE WHEN k % 7 = 3 THEN 'llm' ELSE 'deterministic' END,
  '","model":"', CASE WHEN k % 14 = 3 THEN '' ELSE 'm' END, '","prompt_version":"p"},"validation":{"schema":"', CASE WHEN k = 18 THEN 'failed' WHEN k = 19 THEN 'pending' ELSE 'passed' END,
  '","terminology":"passed","provenance":"', CASE WHEN k = 20 THEN 'pending' ELSE 'passed' END, '","semantic_review":"',
  CASE k % 6 WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' WHEN 3 THEN 'not_required' ELSE 'passed' END, '"},"idempotency_key":"', idempotency_key, '"}')"""


@query("fact_admission", "SRC-14 FLT-6 PRJ-17", f"""WITH {READINGS},
g AS (SELECT *, CASE WHEN k = 2 THEN 'unknown_schema' WHEN k = 7 OR (k % 7 = 3 AND k % 14 = 3) THEN 'schema_validation_error'
  WHEN k = 3 THEN 'unknown_resource_type' WHEN k = 5 THEN 'cancelled_tombstone' WHEN k = 20 THEN 'missing_or_failed_provenance_check'
  WHEN k = 18 THEN 'failed_validation' WHEN k = 19 THEN 'validation_pending' WHEN k % 10 = 1 THEN 'candidate_not_trusted'
  WHEN k % 10 = 2 THEN 'trust_status_quarantined' WHEN k % 6 = 2 THEN 'semantic_review_failed' WHEN k % 6 = 1 THEN 'semantic_review_pending'
  WHEN k = 6 THEN 'future_availability' ELSE 'trusted_validation_passed' END AS reason FROM rd)
SELECT reason, CASE WHEN reason = 'trusted_validation_passed' THEN 'admit' WHEN reason IN ('validation_pending','candidate_not_trusted','semantic_review_pending')
  THEN 'quarantine' ELSE 'reject' END AS outcome, count(*) AS n, count(*) FILTER (reason = 'trusted_validation_passed' AND k % 20 <> 4) AS n_scored FROM g GROUP BY ALL""")
def fact_admission(spark: SparkSession, sf: str) -> DataFrame:
    """Trusted facts through the admission gate."""
    facts = records.trusted_facts(_text_table(spark, P.readings(spark, sf).selectExpr(f"{_FACT_TEXT} AS value"), "facts"))
    gated = records.admit(facts, clock=F.expr("timestamp'2024-06-01 00:00:00'"))
    scored = records.admitted_envelopes(gated, F.expr(_INGEST)).select("idempotency_key", F.lit(1).alias("scored"))
    return gated.select("reason", "outcome", "idempotency_key").join(scored, "idempotency_key", "left").groupBy("reason", "outcome").agg(
        F.count(F.lit(1)).alias("n"), F.count("scored").alias("n_scored"))


@query("note_extraction", "PRJ-24", f"""WITH {READINGS},
n AS (SELECT 'e' || event_id AS note_id, CASE k % 6 WHEN 0 THEN 'Platelet count of ' || floor(raw_value)::BIGINT || ' x10^9/L, total bilirubin: ' || k || '.5 mg/dL'
    WHEN 1 THEN 'creatinine = ' || k || ' mg/dL; GCS 1' || (k % 6) WHEN 2 THEN 'Mean arterial pressure of ' || k || ' mmHg. MAP 70 mmHg'
    WHEN 3 THEN '   ' WHEN 4 THEN 'stable, no new labs' ELSE 'bilirubin 3 umol/L and Glasgow Coma Scale: ' || (3 + k % 12) END AS txt FROM rd
  UNION ALL SELECT 'd' || doc_id, text FROM documents),
p(display, code, pat, unit) AS (VALUES
  ('Platelets','777-3','(?i)platelets?\\s*(?:count)?\\s*(?:of|=|:)?\\s*(\\d+(?:\\.\\d+)?)\\s*(x?10\\^?9/?[lL])?','10*9/L'),
  ('Bilirubin','1975-2','(?i)(?:total\\s+)?bilirubin\\s*(?:of|=|:)?\\s*(\\d+(?:\\.\\d+)?)\\s*mg/?dL','mg/dL'),
  ('Creatinine','2160-0','(?i)creatinine\\s*(?:of|=|:)?\\s*(\\d+(?:\\.\\d+)?)\\s*mg/?dL','mg/dL'),
  ('GCS','9269-2','(?i)(?:GCS|Glasgow\\s+Coma\\s+Scale)\\s*(?:of|=|:)?\\s*(\\d{{1,2}})',NULL),
  ('MAP','8478-0','(?i)(?:MAP|mean\\s+arterial\\s+pressure)\\s*(?:of|=|:)?\\s*(\\d+(?:\\.\\d+)?)\\s*mmHg','mmHg'))
SELECT note_id, display, code, unit, regexp_extract(txt, pat, 1)::DOUBLE AS value, strpos(txt, regexp_extract(txt, pat, 0)) - 1 AS span_start,
  regexp_extract(txt, pat, 0) AS span_text FROM n, p WHERE regexp_matches(txt, pat)""")
def note_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Measurements in notes and in all documents, with their spans."""
    notes = P.readings(spark, sf).selectExpr("concat('e', event_id) AS note_id", """CASE k % 6
      WHEN 0 THEN concat('Platelet count of ', cast(floor(raw_value) AS bigint), ' x10^9/L, total bilirubin: ', k, '.5 mg/dL')
      WHEN 1 THEN concat('creatinine = ', k, ' mg/dL; GCS 1', k % 6) WHEN 2 THEN concat('Mean arterial pressure of ', k, ' mmHg. MAP 70 mmHg')
      WHEN 3 THEN '   ' WHEN 4 THEN 'stable, no new labs' ELSE concat('bilirubin 3 umol/L and Glasgow Coma Scale: ', 3 + k % 12) END AS text""")
    docs = P.table(spark, sf, "documents").selectExpr("concat('d', doc_id) AS note_id", "text")
    found = text.note_observations(text.extract_notes(notes.unionByName(docs)), ["note_id"])
    return found.select("note_id", "display", "code", "unit", "value", "span_start", "span_text")


@query("identifier_leaks", "FLT-9", """WITH d AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN text || ' see hadm_id: ' || doc_id WHEN 1 THEN 'Data/MIMIC/x.csv ' || text
    WHEN 2 THEN text || ' https://physionet.org/files/mimiciv/ stay_id=7' ELSE text END AS txt FROM documents),
p(pattern) AS (VALUES ('(?i)\\bhadm_id\\s*[:=]\\s*\\d+'), ('(?i)\\bsubject_id\\s*[:=]\\s*\\d+'), ('(?i)\\bstay_id\\s*[:=]\\s*\\d+'),
  ('(?i)data/mimic[\\w\\-./]*'), ('(?i)physionet\\.org/files'), ('(?i)/files/mimiciv/'))
SELECT doc_id, pattern FROM d, p WHERE regexp_matches(txt, pattern)""")
def identifier_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Identifier patterns in all document texts."""
    d = P.table(spark, sf, "documents").selectExpr("doc_id", """CASE doc_id % 9 WHEN 0 THEN concat(text, ' see hadm_id: ', doc_id)
      WHEN 1 THEN concat('Data/MIMIC/x.csv ', text) WHEN 2 THEN concat(text, ' https://physionet.org/files/mimiciv/ stay_id=7') ELSE text END AS text""")
    return text.leak_hits(d, "text", ["doc_id"])


@query("latest_snapshot", "WIN-2 WIN-3 WIN-4 FLT-1", f"""WITH {SNAPSHOTS}
SELECT patient_id, event_us, encounter_now, scope, component, platelets, bilirubin, creatinine, gcs, spo2, map_mmhg, fio2 FROM snap""")
def latest_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Latest value of every input per patient and encounter after each record."""
    return snap.snapshots(P.envelopes(spark, sf)).select(
        "patient_id", "event_us", "encounter_now", "scope", "component", "platelets", "bilirubin", "creatinine", "gcs", "spo2",
        "map_mmhg", "fio2")


@query("component_evidence", "WIN-2", f"""WITH {SNAPSHOTS}
SELECT patient_id, scope, component, 'Observation/' || event_id AS evidence_id, min(event_us) AS since_us FROM snap GROUP BY ALL""")
def component_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of every component as rows with the time it first counted."""
    return latest.evidence_rows(snap.snapshots(P.envelopes(spark, sf)))


@query("unique_deliveries", "STR-2 SNK-5", f"""WITH {ARRIVED}
SELECT patient_id, count(*) AS n, (SELECT count(*) FROM env e WHERE e.patient_id = d.patient_id) AS n_delivered FROM ded d GROUP BY patient_id""")
def unique_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries per patient before and after duplicate removal."""
    env = P.envelopes(spark, sf).drop("resource")
    kept = latest.deduplicate(env).groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"))
    return kept.join(env.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_delivered")), "patient_id")


@query("stay_files", "SRC-6 WIN-1 WIN-5", f"""WITH {READINGS},
h0 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_us, event_id) AS iculos FROM rd),
h AS (SELECT 'p' || user_id AS stay_id, iculos, min(CASE WHEN k >= 97 THEN iculos END) OVER (PARTITION BY user_id) AS onset_iculos,
  """ + ", ".join(f"last_value(CASE WHEN {c} THEN {v} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY iculos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {n}"
                  for c, v, n in (("code = '8478-0'", "reading", "map_mmhg"), ("code = '777-3'", "reading", "platelets"), ("code = '1975-2'", "reading", "bilirubin"),
                                  ("code = '2160-0'", "reading", "creatinine"), ("code = '2708-6'", "reading", "o2sat"), ("code = '3150-0'", "reading", "fio2p"),
                                  ("code = '9269-2' AND k % 2 = 0", "85 + reading", "sao2"))) + """ FROM h0)
SELECT stay_id, iculos, onset_iculos, round(map_mmhg, 6) AS map_mmhg, round(platelets, 6) AS platelets, round(bilirubin, 6) AS bilirubin,
  round(creatinine, 6) AS creatinine, round(coalesce(o2sat, sao2), 6) AS spo2, round(fio2p / 100, 6) AS fio2 FROM h""")
def stay_files(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly stays written as pipe-separated files, read back and filled forward."""
    names = {v: k for k, v in stays.MEASURES.items()}
    hours = P.hourly_stays(spark, sf)
    out = hours.select(F.col("stay_id").alias("stay"), F.col("iculos").alias("ICULOS"), F.col("sepsis_label").alias("SepsisLabel"),
                       *[F.col(c).alias(n) for c, n in names.items()])
    path = new_path(spark, "stays")
    out.repartition("stay", F.expr("ICULOS div 100000")).write.option("sep", "|").option("header", True).option("nullValue", "NaN").csv(path)
    back = stays.read_stays(spark, path, stay_column="stay")
    return stays.score_inputs(stays.filled(back)).join(stays.onset_hour(back), "stay_id").select(
        "stay_id", "iculos", "onset_iculos", *[F.round(c, 6).alias(c) for c in
                                               ("map_mmhg", "platelets", "bilirubin", "creatinine", "spo2", "fio2")])
