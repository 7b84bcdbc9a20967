"""Alert table queries: upserts, lists, counts, switches, shadow mode, operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalog.base import SCORED, alert_id_sql, alert_source, governance_sql, query
from wardline.catalog.governance import ACTIVE, governed
from wardline.functions.scores import SOFA_COMPONENTS
from wardline.operators import store
from wardline.plans import snapshots as snap
from wardline.session import new_path
from wardline.sources import projection as P, records

# Emitted alerts as stored rows; every ninth event acknowledges its alert, some indicators are renamed.
STORED = f"""WITH RECURSIVE {SCORED}, {alert_source(ACTIVE)}, {governance_sql('src', ACTIVE, SOFA_COMPONENTS)},
al AS (
  SELECT {alert_id_sql('sofa-deterioration', '0.3.0', 's.encounter_now', 's.score').replace('patient_id', 's.patient_id').replace('(event_us', '(s.event_us')} AS alert_id,
    s.patient_id, s.encounter_now AS encounter_id, s.event_us, s.event_id, s.tier, s.completeness, s.score, CASE WHEN s.event_id % 23 = 5 THEN NULL ELSE g.routing END AS routing,
    CASE WHEN s.event_id % 3 = 0 THEN 'aki' ELSE 'sofa-deterioration' END AS indicator,
    CASE WHEN s.event_id % 3 = 0 THEN 'aki-kdigo' ELSE 'sepsis-sofa' END AS rule_bundle_id, s.event_id % 9 = 0 AS acknowledged
  FROM gov g JOIN src ON src.pk = g.pk AND src.rn = g.rn JOIN scored s ON s.patient_id = g.pk AND s.idempotency_key = src.idempotency_key
  WHERE g.emit)"""


def stored(spark: SparkSession, sf: str) -> DataFrame:
    return governed(spark, sf, ACTIVE).where("emit").selectExpr(
        "alert_id", "patient_id", "encounter_id", "event_us", "cast(substring(idempotency_key, 4) AS bigint) AS event_id", "tier", "completeness",
        "score", "if(cast(substring(idempotency_key, 4) AS bigint) % 23 = 5, null, routing) AS routing").selectExpr(
        "*", "if(event_id % 3 = 0, 'aki', 'sofa-deterioration') AS indicator", "if(event_id % 3 = 0, 'aki-kdigo', 'sepsis-sofa') AS rule_bundle_id",
        "event_id % 9 = 0 AS acknowledged", "cast(null AS string) AS page_deferred_reason", "false AS suppressed")


@query("alert_upsert", "SNK-1 SNK-4 SRC-15", f"""{STORED},
v AS (SELECT alert_id, event_id, event_us, acknowledged AS ack, tier FROM al)
SELECT alert_id, CASE WHEN event_id % 2 = 0 THEN 'revised' ELSE tier END AS tier, ack AS acknowledged,
  CASE WHEN ack THEN event_us END AS acknowledged_us, CASE WHEN ack THEN 'acknowledged' ELSE 'open' END AS resolution_state FROM v""")
def alert_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Stored alerts merged with a second delivery; acknowledgements survive, the newer tier wins."""
    first = stored(spark, sf).selectExpr(
        "alert_id", "event_id", "1 AS arrival", "tier", "acknowledged", "if(acknowledged, event_us, null) AS acknowledged_us",
        "cast(null AS string) AS acknowledge_note", "if(acknowledged, 'acknowledged', 'open') AS resolution_state")
    again = first.where("event_id % 2 = 0").selectExpr(
        "alert_id", "event_id", "2 AS arrival", "'revised' AS tier", "false AS acknowledged", "cast(null AS bigint) AS acknowledged_us",
        "cast(null AS string) AS acknowledge_note", "'open' AS resolution_state")
    return store.upsert_alerts(first, again).select("alert_id", "tier", "acknowledged", "acknowledged_us", "resolution_state")


@query("alert_json_ingest", "SRC-15 SNK-5 SNK-9", f"""{STORED}
SELECT count(*) AS n, count(DISTINCT patient_id) AS n_patients, sum(score)::BIGINT AS total_score FROM al WHERE event_id % 13 <> 0 AND event_id % 17 <> 1""")
def alert_json_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts as JSON delivered twice, some without a patient, some already processed: each counts once."""
    path = new_path(spark, "alerts")
    rows = stored(spark, sf).selectExpr(
        "alert_id", "if(event_id % 13 = 0, null, patient_id) AS patient_id", "score", "tier", "routing", "event_id",
        "date_format(timestamp_micros(event_us), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\") AS event_time", "concat('d-', event_id) AS idempotency_key")
    rows.drop("event_id").union(rows.drop("event_id")).write.json(path)
    parsed = records.alert_records(spark.read.text(path)).withColumn("arrival", F.monotonically_increasing_id())
    seen = rows.where("event_id % 17 = 1").select("idempotency_key")
    return store.new_deliveries(parsed, seen).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("patient_id").alias("n_patients"), F.sum("score").alias("total_score"))


@query("alert_retention", "SNK-6", f"""{STORED}
SELECT patient_id, count(*) AS n FROM al WHERE event_us >= 1704067200000000 + 3 * 86400000000::BIGINT - 2 * 86400000000::BIGINT GROUP BY patient_id""")
def alert_retention(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts left after a retention of two days."""
    return store.retained(stored(spark, sf), P.T0_US + 3 * 86_400_000_000, 2).groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"))


@query("rule_version_log", "SNK-7", f"""{STORED}
SELECT rule_bundle_id AS bundle_id, '0.' || (event_id % 4) AS version, min(event_us) AS activated_us,
  arg_max(CASE WHEN event_id % 5 = 0 THEN 'h' || event_id END, event_us) FILTER (event_id % 5 = 0) AS content_hash FROM al GROUP BY ALL""")
def rule_version_log(spark: SparkSession, sf: str) -> DataFrame:
    """First use of each rule version with its newest known hash."""
    e = stored(spark, sf).selectExpr("rule_bundle_id AS bundle_id", "concat('0.', event_id % 4) AS version", "event_us AS activated_us",
                                     "if(event_id % 5 = 0, concat('h', event_id), null) AS content_hash", "cast(null AS string) AS notes")
    return store.rule_log(e).drop("notes")


@query("newest_alerts", "SRT-2", f"""{STORED}
SELECT alert_id, patient_id, event_us, tier FROM al WHERE NOT acknowledged ORDER BY event_us DESC, alert_id LIMIT 200 OFFSET 50""")
def newest_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Second page of open alerts, newest first."""
    return store.newest_alerts(stored(spark, sf), 200, 50, include_acknowledged=False).select("alert_id", "patient_id", "event_us", "tier")


@query("patient_feed", "FLT-8", f"""{STORED},
vis AS (SELECT patient_id, CASE WHEN CAST(replace(patient_id, 'Patient/', '') AS INT) % 3 = 0 THEN max(encounter_id) END AS ve FROM al GROUP BY patient_id)
SELECT alert_id, CASE WHEN tier = 'critical' OR routing = 'interruptive' THEN 'critical' WHEN tier IN ('urgent', 'watch') THEN 'warning' ELSE 'info' END AS urgency
FROM al JOIN vis USING (patient_id) WHERE (ve IS NULL OR encounter_id IS NULL OR encounter_id = ve) AND (routing IS NULL OR routing <> 'none') AND NOT acknowledged""")
def patient_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts to show per visit with their urgency."""
    al = stored(spark, sf)
    visits = al.groupBy("patient_id").agg(F.max("encounter_id").alias("e")).selectExpr(
        "patient_id", "if(cast(replace(patient_id, 'Patient/', '') AS int) % 3 = 0, e, null) AS visit_encounter")
    return store.patient_feed(al, visits).select("alert_id", "urgency")


@query("store_metrics", "AGG-11", f"""{STORED}, m AS (SELECT tier, coalesce(routing, 'unset') AS routing, indicator, acknowledged FROM al)
SELECT CASE WHEN tier IS NOT NULL THEN 'tier' WHEN routing IS NOT NULL THEN 'routing' WHEN indicator IS NOT NULL THEN 'indicator' ELSE 'all' END AS dimension,
  coalesce(tier, routing, indicator, 'all') AS value, count(*) AS total, count(*) FILTER (acknowledged) AS acknowledged, count(*) FILTER (NOT acknowledged) AS open
FROM m GROUP BY GROUPING SETS ((tier), (routing), (indicator), ())""")
def store_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Alert totals by tier, routing, indicator and overall."""
    return store.store_metrics(stored(spark, sf))


SWITCHES = {"alerts_ingest": True, "interruptive_lane": False, "passive_lane": True, "indicators": {"aki": False}, "bundles": {"hemo-shock": False}}


@query("kill_switches", "FLT-7", f"""{STORED}
SELECT alert_id, CASE WHEN routing = 'interruptive' THEN 'passive' ELSE routing END AS routing,
  CASE WHEN routing = 'interruptive' THEN 'kill_switch_interruptive_lane' END AS page_deferred_reason FROM al WHERE indicator <> 'aki'""")
def kill_switches(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts with one indicator off and the interruptive lane off."""
    return store.apply_switches(stored(spark, sf), SWITCHES).select("alert_id", "routing", "page_deferred_reason")


@query("shadow_pages", "STR-12 AGG-21 SRT-6", f"""{STORED}
SELECT indicator, count(*) AS n_would_have_paged, min(event_us) AS first_us FROM al WHERE routing = 'interruptive' GROUP BY indicator""")
def shadow_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Shadow day report: pages that would have been sent, each delivered twice and recorded once."""
    al = stored(spark, sf)
    return store.would_have_paged(al.unionByName(al)).groupBy("indicator").agg(
        F.count(F.lit(1)).alias("n_would_have_paged"), F.min("event_us").alias("first_us"))


@query("recent_shadow_pages", "SRT-6", f"""{STORED}
SELECT alert_id, event_us FROM al WHERE routing = 'interruptive' ORDER BY event_us DESC, alert_id LIMIT 50""")
def recent_shadow_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Newest pages that would have been sent."""
    return store.newest_alerts(store.would_have_paged(stored(spark, sf)), 50).select("alert_id", "event_us")


@query("operations_status", "AGG-12", f"""{STORED}
SELECT (event_us - event_us % 3600000000) AS hour_us, count(*) AS alerts, round(count(*) FILTER (completeness = 'partial') / count(*), 9) AS partial_rate,
  count(*) > 40 AS volume_alarm FROM al GROUP BY 1""")
def operations_status(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts and partial scores per hour, with a volume alarm."""
    return store.hourly_rate(stored(spark, sf)).select(
        F.unix_micros("hour").alias("hour_us"), "alerts", F.round("partial_rate", 9).alias("partial_rate"),
        (F.col("alerts") > 40).alias("volume_alarm"))


_SITE = "CASE WHEN user_id % 9 = 0 THEN 'north' WHEN user_id % 2 = 0 THEN 'south' ELSE 'west' END"
HOURLY_LIMIT = 10.0


@query("operations_alarms", "AGG-12 FLT-7", f"""{STORED},
site AS (SELECT DISTINCT patient_id, {_SITE} AS site_id FROM rd),
vol AS (SELECT site_id, count(*) AS n, count(*) / greatest((max(event_us) - min(event_us)) / 3600000000.0::DOUBLE, 1) AS rate FROM al JOIN site USING (patient_id) GROUP BY 1),
dead AS (SELECT {_SITE} AS site_id, count(*) AS n FROM mp WHERE late OR reason IS NOT NULL GROUP BY 1),
sw AS (SELECT {_SITE} AS site_id, CASE WHEN k < 62 THEN 'alerts_ingest' ELSE 'interruptive_lane' END AS switch, arg_max(k % 2 = 1, {{'a': event_us, 'b': event_id}}) AS enabled
  FROM rd WHERE k BETWEEN 60 AND 63 GROUP BY ALL)
SELECT site_id, 'warning' AS severity, 'alert_volume_high' AS code, round(rate, 6) AS observed FROM vol WHERE rate > {HOURLY_LIMIT}
UNION ALL SELECT site_id, 'warning', 'dlq_nonempty', n::DOUBLE FROM dead WHERE n > 0
UNION ALL SELECT site_id, CASE switch WHEN 'alerts_ingest' THEN 'critical' ELSE 'warning' END, CASE switch WHEN 'alerts_ingest' THEN 'ingest_disabled' ELSE 'interruptive_disabled' END,
  0.0::DOUBLE FROM sw WHERE NOT enabled""")
def operations_alarms(spark: SparkSession, sf: str) -> DataFrame:
    """Alarms per site: alert volume, refused records, and switches that are off."""
    site = F.expr(_SITE.replace("user_id", "cast(replace(patient_id, 'Patient/', '') AS bigint)")).alias("site_id")
    updates = P.readings(spark, sf).where("k BETWEEN 60 AND 63").select(
        site, F.expr("if(k < 62, 'alerts_ingest', 'interruptive_lane')").alias("switch"), (F.col("k") % 2 == 1).alias("enabled"), F.col("event_us").alias("at_us"), "event_id")
    dead = snap.validated(P.envelopes(spark, sf))[0].where(F.col("reason").isNotNull()).select(site)
    alarms = store.operations_alarms(stored(spark, sf).select(site, "event_us"), dead, store.switch_states(updates), hourly_limit=HOURLY_LIMIT)
    return alarms.select("site_id", "severity", "code", F.round("observed", 6).alias("observed"))


@query("feedback_acknowledges", "EPI-9", f"""{STORED}
SELECT alert_id, tier, acknowledged OR event_id % 4 = 1 AS acknowledged, CASE WHEN acknowledged OR event_id % 4 = 1 THEN 'acknowledged' ELSE 'open' END AS resolution_state FROM al""")
def feedback_acknowledges(spark: SparkSession, sf: str) -> DataFrame:
    """Clinician feedback acknowledges alerts and changes nothing else."""
    al = stored(spark, sf).selectExpr("*", "cast(null AS bigint) AS acknowledged_us", "cast(null AS string) AS acknowledge_note",
                                      "if(acknowledged, 'acknowledged', 'open') AS resolution_state")
    fb = al.where("event_id % 4 = 1").selectExpr("alert_id", "event_us AS at_us", "'accepted' AS note")
    return store.acknowledge(al, fb).select("alert_id", "tier", "acknowledged", "resolution_state")
