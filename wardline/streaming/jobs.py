"""Stream jobs: records -> snapshots and dead letters -> governed alerts -> episodes.

Each job is one streaming query with its own checkpoint and reads what the one before it wrote, so every
stage restarts on its own. Spark's watermark is on the time a micro-batch reads its records: it only drives timers, and no
stamp in a record moves it or lies behind it, so a record that is late in event time or in arrival, by however much, is not
dropped but reaches the five-minute rule per patient and the dead letters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline import ids
from wardline.functions import scores as S
from wardline.operators import mapping
from wardline.operators.latest import SNAPSHOT_FIELDS
from wardline.operators.rule_history import rule_updates
from wardline.rules import Bundle, load_bundle
from wardline.sources import records
from wardline.streaming import processors as PR, ruled

WATERMARK = "1 hour"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def json_records(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of JSON lines from a folder."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return records.stream_records(reader.load(path))


def kafka_records(spark: SparkSession, servers: str, topics: str) -> DataFrame:
    """The same from Kafka topics, from the earliest offset. Needs the Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option(
        "startingOffsets", "earliest").load()
    return records.stream_records(raw.select(F.col("value").cast("string").alias("value")))


def _split_unreadable(recs: DataFrame) -> tuple[DataFrame, DataFrame]:
    return recs.where(F.col("reason").isNull()), recs.where(F.col("reason").isNotNull())


def _dead(rows: DataFrame, like: DataFrame) -> DataFrame:
    """Unreadable records in the column layout of the keyed output."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have and f.name not in ("encounter_now",) else F.lit(None)).cast(f.dataType).alias(f.name)
                         for f in like.schema])


def _with_clock(rows: DataFrame) -> DataFrame:
    return rows.withColumn("read_us", F.unix_micros(F.current_timestamp())).withColumn("read_ts", F.timestamp_micros("read_us")).withWatermark("read_ts", WATERMARK)


def _keyed(rows: DataFrame, keys: list[str], processor: PR.StatefulProcessor, output: T.StructType, time_mode: str = "None") -> DataFrame:
    """Rows through a keyed processor as one JSON value each; ``read_ts`` only drives the timers."""
    fields = [f for f in rows.schema if f.name != "read_ts"]
    doubles = [f.name for f in fields if isinstance(f.dataType, T.DoubleType)]
    clock = ["read_ts"] if time_mode == "EventTime" else []
    packed = rows.select(*keys, *clock, F.to_json(F.struct(*[f.name for f in fields]), {"ignoreNullFields": "false"}).alias("packed"))
    out = packed.groupBy(*keys).transformWithState(
        statefulProcessor=PR.Packed(processor, doubles, output), outputStructType=PR.PACKED, outputMode="Append", timeMode=time_mode)
    return out.select(F.from_json("packed", output).alias("r")).select("r.*")


def snapshot_stream(recs: DataFrame) -> DataFrame:
    """Snapshots of all patients and, with a reason, every record that was refused."""
    good, bad = _split_unreadable(recs)
    mapped = mapping.map_observations(good)
    for f, t in SNAPSHOT_FIELDS.items():
        if f not in mapped.columns:
            mapped = mapped.withColumn(f, F.lit(None).cast(t))
    flat = _with_clock(mapped.select(
        "patient_id", "encounter_id", "event_us", "ingest_us", "idempotency_key", "component", "reason",
        F.array_min("context_flags").alias("context_flag"), *SNAPSHOT_FIELDS))
    columns = [c for c in flat.columns if c != "read_ts"]
    out = _keyed(flat, ["patient_id"], PR.SnapshotProcessor(columns, PR.SNAPSHOT_OUT, PR.KeyBuckets), PR.SNAPSHOT_OUT, "EventTime")
    return out.unionByName(_dead(bad, out))


def kidney_stream(recs: DataFrame) -> DataFrame:
    """Kidney stage after every kidney record, refused records with their reason."""
    good, bad = _split_unreadable(recs)
    none = F.lit(None).cast("double")
    usable = ~F.coalesce(F.col("reason").startswith("invalid_status"), F.lit(False))
    mapped = mapping.map_kidney(good).withColumn("component", F.when(
        mapping.primary_code(F.col("resource").code).isNotNull() & usable, "kidney"))
    flat = _with_clock(mapped.select(
        "patient_id", "encounter_id", "event_us", "ingest_us", "idempotency_key", "component", "reason",
        F.array_min("context_flags").alias("context_flag"), "kind", "evidence_id", "creatinine", none.alias("volume_ml"), "duration_h",
        "ml_kg_h", "anuria", none.alias("weight_kg")))
    columns = [c for c in flat.columns if c != "read_ts"]
    out = _keyed(flat, ["patient_id"], PR.KidneyProcessor(columns, PR.KIDNEY_OUT, PR.KeyBuckets), PR.KIDNEY_OUT, "EventTime")
    return out.unionByName(_dead(bad, out))


def scored_stream(snapshots: DataFrame, bundle: Bundle) -> DataFrame:
    """Alerts from a stream of snapshots; tier ``none`` is forwarded for recovery."""
    rows = S.sofa_total(S.sofa_points(snapshots, S.SofaRules(min_components=bundle.min_components)), bundle.min_components)
    rows = rows.where(F.col("completeness") != "insufficient_data").withColumn(
        "tier", S.tier(F.col("score"), bundle.naive_threshold, bundle.bands))
    return rows.withColumns({
        "indicator": F.lit(bundle.indicator), "encounter_id": F.col("encounter_now"),
        "alert_id": ids.alert_id(F.col("patient_id"), F.col("encounter_now"), F.lit(bundle.indicator), F.col("score"),
                                 F.col("event_us"), F.lit(bundle.version))})


def kidney_alerts(kidney: DataFrame, bundle_id: str = "aki-kdigo") -> DataFrame:
    """Alerts from a stream of kidney stages, ready for governance: what is excluded or not scored gives none, tier ``none`` is forwarded for recovery."""
    rows = kidney.where(F.col("reason").isNull() & (F.col("status") == "scored")).withColumn("score", S.stage_score(F.col("stage")).cast("int"))
    return rows.select(
        "patient_id", F.col("encounter_now").alias("encounter_id"), "event_us", "idempotency_key", F.lit(None).cast("string").alias("alert_id"), F.lit("aki").alias("indicator"),
        F.lit(bundle_id).alias("rule_bundle_id"), "score", S.stage_tier(F.col("score")).alias("tier"),
        (F.coalesce((F.col("creatinine_stage") > 0).cast("int"), F.lit(0)) + F.coalesce((F.col("urine_stage") > 0).cast("int"), F.lit(0))).alias("positive_components"),
        F.when(F.col("context_flag").isNotNull(), F.array("context_flag")).alias("context_flags"))


def identified(decisions: DataFrame) -> DataFrame:
    """Decisions with the id of each alert; the version of the rules in force is part of it."""
    return decisions.withColumn("alert_id", ids.alert_id(
        F.col("patient_id"), F.col("encounter_id"), F.col("indicator"), F.col("score"), F.col("event_us"), F.coalesce("rule_version", F.lit(""))))


def governed_stream(alerts: DataFrame, bundle: Bundle) -> DataFrame:
    alerts = alerts.select("patient_id", "encounter_id", "event_us", "idempotency_key", "alert_id", "indicator", "score", "tier",
                           "context_flag", "positive_components", *[f"p_{c}" for c in S.SOFA_COMPONENTS])
    return _keyed(alerts, ["patient_id"], PR.GovernanceProcessor(alerts.columns, bundle.governance, S.SOFA_COMPONENTS), PR.GOVERNED_OUT)


def episode_stream(signals: DataFrame) -> DataFrame:
    return _keyed(signals, ["patient_id", "encounter_key"], PR.EpisodeProcessor(signals.columns), PR.EPISODE_OUT)


def run_available(stream: DataFrame, path: str, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process everything that is there now, then stop. Restarting goes on where it stopped."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    w = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = (w.foreachBatch(sink) if sink else w.format("parquet").option("path", path)).start()
    q.awaitTermination()


class Pipeline:
    """The chained jobs over one working folder."""

    def __init__(self, spark: SparkSession, incoming: str, work: str, bundle: Bundle | None = None) -> None:
        self.spark, self.incoming, self.work = spark, incoming, work
        self.bundle = bundle or load_bundle("sepsis-sofa")

    def at(self, name: str) -> str:
        return f"{self.work}/{name}"

    def records_to_snapshots(self) -> None:
        """One query, two outputs: each batch is split into snapshots and dead letters."""
        out, dead = self.at("snapshots"), self.at("dead_letters")

        def split(batch: DataFrame, batch_id: int) -> None:
            batch.persist()
            # A batch id is written once: a replayed batch overwrites its own folder.
            batch.where("reason IS NULL").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            batch.where("reason IS NOT NULL").select([f.name for f in PR.HEAD]).write.mode("overwrite").parquet(f"{dead}/batch={batch_id}")
            batch.unpersist()

        run_available(snapshot_stream(json_records(self.spark, self.incoming)), out, self.at("ck_snapshots"), split)

    def records_to_kidney(self) -> None:
        run_available(kidney_stream(json_records(self.spark, self.incoming)), self.at("kidney"), self.at("ck_kidney"))

    def snapshots_to_alerts(self) -> None:
        src = self.spark.readStream.schema(PR.SNAPSHOT_OUT).parquet(self.at("snapshots") + "/*")
        run_available(governed_stream(scored_stream(src, self.bundle), self.bundle), self.at("alerts"), self.at("ck_alerts"))

    def snapshots_to_ruled_alerts(self, bundle_of: Column) -> None:
        """Alerts governed by the updates that lie in the folder ``rules`` and arrive there; ``bundle_of`` names each alert's bundle."""
        src = self.spark.readStream.schema(PR.SNAPSHOT_OUT).parquet(self.at("snapshots") + "/*")
        alerts = scored_stream(src, self.bundle).withColumns({
            "rule_bundle_id": bundle_of, "context_flags": F.when(F.col("context_flag").isNotNull(), F.array("context_flag"))})
        updates = rule_updates(self.spark.readStream.format("text").load(self.at("rules")))
        run_available(ruled.governed_by_rules(alerts, updates, S.SOFA_COMPONENTS), self.at("ruled"), self.at("ck_ruled"))

    def kidney_to_ruled_alerts(self) -> None:
        """Kidney alerts governed by the updates in the folder ``rules``."""
        src = self.spark.readStream.schema(PR.KIDNEY_OUT).parquet(self.at("kidney"))
        updates = rule_updates(self.spark.readStream.format("text").load(self.at("rules")))
        run_available(identified(ruled.governed_by_rules(kidney_alerts(src), updates, ())), self.at("ruled"), self.at("ck_ruled"))

    def alerts_to_episodes(self) -> None:
        src = self.spark.readStream.schema(PR.GOVERNED_OUT).parquet(self.at("alerts")).where("emit").select(
            "patient_id", F.coalesce("encounter_id", F.lit("")).alias("encounter_key"), F.lit("signal").alias("event"),
            F.col("alert_id").alias("signal_id"), F.col("indicator").alias("signal_type"), F.col("tier").alias("severity"), "routing",
            F.lit(False).alias("suppressed"), "event_us")
        run_available(episode_stream(src), self.at("episodes"), self.at("ck_episodes"))

    def read(self, name: str) -> DataFrame:
        reader = self.spark.read
        return reader.option("basePath", self.at(name)).parquet(self.at(name) + "/*") if name in ("snapshots", "dead_letters") else reader.parquet(self.at(name))
