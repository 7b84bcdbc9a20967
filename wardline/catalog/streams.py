"""Stream jobs run to completion over files; their results equal the batch jobs'."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalog.base import ARRIVED, SCORED, SNAPSHOTS, alert_source, governance_sql, query
from wardline.catalog.episodes import SIGNALS_SQL, episode_sql
from wardline.catalog.governance import ACTIVE
from wardline.functions.scores import SOFA_COMPONENTS
from wardline.session import new_path
from wardline.sources import projection as P
from wardline.streaming import jobs as J

_TXT = "date_format(timestamp_micros({}), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"


def record_lines(env: DataFrame) -> DataFrame:
    return env.selectExpr("ingest_us", f"""to_json(named_struct('schema_version', '1.0.0', 'patient_id', patient_id, 'encounter_id', encounter_id,
      'resource_type', resource_type, 'resource', resource, 'event_time', {_TXT.format('event_us')}, 'ingest_time', {_TXT.format('ingest_us')},
      'idempotency_key', idempotency_key, 'context_flags', context_flags)) AS value""")


def deliver(spark: SparkSession, sf: str, pipeline: J.Pipeline, stages, halves: int = 2, env: DataFrame | None = None) -> None:
    """Deliver the records (those of ``events`` if not given) in arrival order in pieces and run the stages after each, as restarts would.

    The last piece ends with one end-of-input marker per patient.
    """
    env = P.envelopes(spark, sf) if env is None else env
    lo, hi = env.agg(F.min("ingest_us"), F.max("ingest_us")).first()
    width = (hi - lo) // halves + 1
    lines = record_lines(env)
    ends = env.groupBy("patient_id").agg((F.max("event_us") + 3_600_000_000).alias("t")).selectExpr(
        f"to_json(named_struct('patient_id', patient_id, 'resource', named_struct('resourceType', 'Observation'), 'event_time', {_TXT.format('t')}, "
        f"'ingest_time', {_TXT.format(str(hi + 1))}, 'idempotency_key', concat('flush-', patient_id))) AS value")
    for i in range(halves):
        part = lines.where((F.col("ingest_us") >= lo + i * width) & (F.col("ingest_us") < lo + (i + 1) * width)).select("value")
        if i == halves - 1:
            part = part.unionByName(ends)
        part.write.mode("append").text(pipeline.incoming)
        for stage in stages:
            stage(pipeline)


def pipeline(spark: SparkSession, sf: str, stages, halves: int = 2) -> J.Pipeline:
    work = new_path(spark, "stream")
    p = J.Pipeline(spark, f"{work}/incoming", work)
    deliver(spark, sf, p, stages, halves)
    return p


S1, S2, S3 = J.Pipeline.records_to_snapshots, J.Pipeline.snapshots_to_alerts, J.Pipeline.alerts_to_episodes


@query("stream_snapshots", "SRC-1 STR-1 STR-2 STR-3 STR-4 STR-5 STR-7 STR-11", f"""WITH {SNAPSHOTS}
SELECT patient_id, event_us, encounter_now, scope, platelets, creatinine, gcs, map_mmhg FROM snap""")
def stream_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Records streamed through duplicate removal, reordering and merging, with a restart in between."""
    return pipeline(spark, sf, [S1]).read("snapshots").select(
        "patient_id", "event_us", "encounter_now", "scope", "platelets", "creatinine", "gcs", "map_mmhg")


@query("stream_dead_letters", "STR-6 SNK-2", f"""WITH {ARRIVED}
SELECT patient_id, idempotency_key, CASE WHEN late THEN 'late_beyond_lateness' ELSE reason END AS reason FROM mp WHERE late OR reason IS NOT NULL""")
def stream_dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    """Late and refused records of the stream."""
    return pipeline(spark, sf, [S1]).read("dead_letters").select("patient_id", "idempotency_key", "reason")


@query("stream_governed_alerts", "STR-10 STR-11 SNK-1", f"""WITH RECURSIVE {SCORED}, {alert_source(ACTIVE)}, {governance_sql('src', ACTIVE, SOFA_COMPONENTS)}
SELECT pk AS patient_id, event_us, emit, reason, routing FROM gov WHERE rn > 0""")
def stream_governed_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts governed as they stream, with a restart in between."""
    return pipeline(spark, sf, [S1, S2]).read("alerts").select("patient_id", "event_us", "emit", "reason", "routing")


@query("stream_episodes", "EPI-2 EPI-3 EPI-4 STR-10", f"""WITH RECURSIVE {SIGNALS_SQL.replace('sig AS (SELECT * FROM sofa_alerts UNION ALL SELECT * FROM pressure UNION ALL SELECT * FROM control)', 'sig AS (SELECT * FROM sofa_alerts)')},
{episode_sql()}
SELECT pk, event_us, signal_id, no AS episode_no, action, reason, status, pages AS page_count FROM ep WHERE rn > 0 AND action <> 'skip'""")
def stream_episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes over the stream of governed alerts."""
    return pipeline(spark, sf, [S1, S2, S3]).read("episodes").select(
        F.concat_ws("#", "patient_id", "encounter_key").alias("pk"), "event_us", "signal_id", "episode_no", "action", "reason", "status", "page_count")


@query("stream_kidney", "STR-8 PRJ-15 AKI-2 AKI-4", f"""WITH {ARRIVED},
u AS (SELECT * FROM arr WHERE NOT late AND status = 'final'),
v AS (SELECT *, last_value(encounter_id IGNORE NULLS) OVER (PARTITION BY patient_id ORDER BY event_us, idempotency_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS eb FROM u),
w AS (SELECT *, sum(CASE WHEN encounter_id <> eb THEN 1 ELSE 0 END) OVER (PARTITION BY patient_id ORDER BY event_us, idempotency_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS scope FROM v),
c AS (SELECT *, min(reading) OVER (PARTITION BY patient_id, scope ORDER BY event_us, idempotency_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS older,
  min(reading) OVER (PARTITION BY patient_id, scope ORDER BY event_us, idempotency_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ref48
  FROM w WHERE code = '2160-0' AND unit <> 'bad'),
d AS (SELECT *, coalesce(older, reading) AS base FROM c)
SELECT patient_id, event_us, CASE WHEN reading >= 4 OR reading / base >= 3 THEN 3 WHEN reading / base >= 2 THEN 2 WHEN reading / base >= 1.5 OR reading - ref48 >= 0.3 THEN 1 ELSE 0 END AS stage,
  round(base, 6) AS baseline_7d FROM d""")
def stream_kidney(spark: SparkSession, sf: str) -> DataFrame:
    """Kidney stage of every creatinine record as it streams; histories start anew with each encounter."""
    out = pipeline(spark, sf, [J.Pipeline.records_to_kidney]).read("kidney").where("reason IS NULL")
    return out.select("patient_id", "event_us", "stage", F.round("baseline_7d", 6).alias("baseline_7d"))
