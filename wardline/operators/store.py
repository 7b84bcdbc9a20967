"""Alert table operations: upserts that keep acknowledgements, retention, logs, lists and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACK = ("acknowledged", "acknowledged_us", "acknowledge_note")


def upsert_alerts(existing: DataFrame, incoming: DataFrame, version: str = "arrival") -> DataFrame:
    """Latest record per alert id; an acknowledgement given to any earlier record stays."""
    both = existing.unionByName(incoming)
    row = F.struct(*both.columns)
    acked = F.coalesce("acknowledged", F.lit(False))
    out = both.groupBy("alert_id").agg(
        F.max_by(row, version).alias("r"),
        F.min_by(F.struct(*ACK), F.when(acked, F.col(version))).alias("a"))
    kept = {c: F.coalesce(F.col(f"a.{c}"), F.col(f"r.{c}")) for c in ACK}
    kept["resolution_state"] = F.when(F.col("a.acknowledged"), "acknowledged").otherwise(F.col("r.resolution_state"))
    return out.select(*[kept.get(c, F.col(f"r.{c}")).alias(c) for c in both.columns])


def new_deliveries(incoming: DataFrame, seen: DataFrame, key: str = "idempotency_key", version: str = "arrival") -> DataFrame:
    """First delivery of every key that was not processed before."""
    fresh = incoming.join(seen.select(key), key, "left_anti")
    return fresh.groupBy(key).agg(F.min_by(F.struct(*incoming.columns), version).alias("r")).select("r.*")


def retained(alerts: DataFrame, now_us: Column | int, days: int) -> DataFrame:
    """Alerts not older than so many days; with no retention everything stays."""
    if days <= 0:
        return alerts
    now = now_us if isinstance(now_us, Column) else F.lit(now_us)
    return alerts.where(F.col("event_us") >= now - F.lit(days * 86_400_000_000))


def rule_log(entries: DataFrame) -> DataFrame:
    """Rule versions in use: first activation kept, hash and notes from the newest entry that gave one."""
    def newest(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("activated_us"))).alias(c)
    return entries.groupBy("bundle_id", "version").agg(
        F.min("activated_us").alias("activated_us"), newest("content_hash"), newest("notes"))


def acknowledge(alerts: DataFrame, feedback: DataFrame) -> DataFrame:
    """Apply feedback to alerts. Scores, tiers and routing are never changed."""
    first = feedback.groupBy("alert_id").agg(
        F.min_by(F.struct(F.col("at_us"), F.col("note")), "at_us").alias("f"))
    hit = F.col("f").isNotNull() & ~F.coalesce("acknowledged", F.lit(False))
    new = {"acknowledged": F.when(hit, True).otherwise(F.col("acknowledged")),
           "acknowledged_us": F.when(hit, F.col("f.at_us")).otherwise(F.col("acknowledged_us")),
           "acknowledge_note": F.when(hit, F.col("f.note")).otherwise(F.col("acknowledge_note")),
           "resolution_state": F.when(hit, "acknowledged").otherwise(F.col("resolution_state"))}
    return alerts.join(first, "alert_id", "left").select(*[new.get(c, F.col(c)).alias(c) for c in alerts.columns])


def feedback_status(feedback: DataFrame, alerts: DataFrame) -> DataFrame:
    """What became of every feedback item."""
    known = alerts.select("alert_id", F.lit(True).alias("_known")).distinct()
    return feedback.join(known, "alert_id", "left").withColumn("status", F.when(
        F.col("alert_id").isNull(), "ignored").when(F.col("_known").isNull(), "not_found").otherwise("acknowledged")).drop("_known")


def newest_alerts(alerts: DataFrame, limit: int = 100, offset: int = 0, patient: str | None = None,
                  include_acknowledged: bool = True) -> DataFrame:
    """Page of alerts, newest first."""
    if limit < 1 or offset < 0:
        raise ValueError(f"a page begins at 0 or later and holds at least one row: limit {limit}, offset {offset}")
    if patient:
        alerts = alerts.where(F.col("patient_id") == patient)
    if not include_acknowledged:
        alerts = alerts.where(~F.coalesce("acknowledged", F.lit(False)))
    return alerts.orderBy(F.col("event_us").desc(), "alert_id").offset(offset).limit(limit)


def patient_feed(alerts: DataFrame, visits: DataFrame, include_acknowledged: bool = False) -> DataFrame:
    """Alerts to show for each visit (``patient_id``, optional ``visit_encounter``), with their urgency."""
    rows = alerts.join(visits, "patient_id").where(
        F.col("visit_encounter").isNull() | F.col("encounter_id").isNull() | (F.col("encounter_id") == F.col("visit_encounter")))
    rows = rows.where(~F.coalesce("suppressed", F.lit(False)) & ~F.col("routing").eqNullSafe("none"))
    if not include_acknowledged:
        rows = rows.where(~F.coalesce("acknowledged", F.lit(False)))
    return rows.withColumn("urgency", F.when((F.col("tier") == "critical") | F.col("routing").eqNullSafe("interruptive"), "critical")
                           .when(F.col("tier").isin("urgent", "watch"), "warning").otherwise("info"))


def store_metrics(alerts: DataFrame) -> DataFrame:
    """Totals by tier, by routing, by indicator and overall, in one pass."""
    rows = alerts.select("tier", F.coalesce("routing", F.lit("unset")).alias("routing"), "indicator",
                         F.coalesce("acknowledged", F.lit(False)).alias("acked"))
    grouped = rows.groupingSets([[F.col("tier")], [F.col("routing")], [F.col("indicator")], []],
                                F.col("tier"), F.col("routing"), F.col("indicator"))
    out = grouped.agg(F.count(F.lit(1)).alias("total"), F.count_if("acked").alias("acknowledged"))
    return out.select(
        F.when(F.col("tier").isNotNull(), "tier").when(F.col("routing").isNotNull(), "routing")
        .when(F.col("indicator").isNotNull(), "indicator").otherwise("all").alias("dimension"),
        F.coalesce("tier", "routing", "indicator", F.lit("all")).alias("value"), "total", "acknowledged",
        (F.col("total") - F.col("acknowledged")).alias("open"))


def apply_switches(alerts: DataFrame, switches: dict) -> DataFrame:
    """Operations switches: drop, or downgrade an interruptive alert when only the passive lane is on."""
    off_ind = [k for k, on in switches.get("indicators", {}).items() if not on]
    off_bun = [k for k, on in switches.get("bundles", {}).items() if not on]
    interruptive, passive = switches.get("interruptive_lane", True), switches.get("passive_lane", True)
    if not switches.get("alerts_ingest", True):
        return alerts.where(F.lit(False))
    kept = alerts.where(~F.col("indicator").isin(off_ind) & ~F.col("rule_bundle_id").isin(off_bun))
    route = F.lower(F.coalesce("routing", F.lit("")))
    down = (route == "interruptive") & F.lit(not interruptive)
    kept = kept.where(~(down & F.lit(not passive)) & ~((route == "passive") & F.lit(not passive)))
    return kept.withColumns({
        "routing": F.when(down, "passive").otherwise(F.col("routing")),
        "page_deferred_reason": F.when(down, "kill_switch_interruptive_lane").otherwise(F.col("page_deferred_reason"))})


def would_have_paged(alerts: DataFrame, key: str = "alert_id") -> DataFrame:
    """Shadow mode: interruptive alerts recorded once each and never delivered."""
    inter = alerts.where(F.lower("routing") == "interruptive")
    return inter.groupBy(key).agg(F.min_by(F.struct(*[c for c in alerts.columns if c != key]), "event_us").alias("r")).select(key, "r.*")


def hourly_rate(alerts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Alerts per hour of event time."""
    hour = F.window(F.timestamp_micros("event_us"), "1 hour").start.alias("hour")
    return alerts.groupBy(*keys, hour).agg(
        F.count(F.lit(1)).alias("alerts"),
        (F.count_if(F.col("completeness") == "partial") / F.count(F.lit(1))).alias("partial_rate"))


def switch_states(updates: DataFrame, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Each switch as its last update left it (``switch``, ``enabled``, ``at_us``, ``event_id``)."""
    return updates.groupBy(*keys, "switch").agg(F.max_by("enabled", F.struct("at_us", "event_id")).alias("enabled"))


def operations_alarms(alerts: DataFrame, dead_letters: DataFrame, switches: DataFrame, keys: Sequence[str] = ("site_id",),
                      hourly_limit: float = 500.0) -> DataFrame:
    """Alarms as rows: ``severity``, ``code`` and the ``observed`` figure.

    ``alert_volume_high`` compares alerts per hour, over the time they span but at least one hour, with the
    limit; ``dlq_nonempty`` counts refused records; ``ingest_disabled`` and ``interruptive_disabled`` are
    switches that are off (a switch nobody set is on). The three inputs are summed up by key before they meet.
    """
    none_n, none_t = F.lit(None).cast("bigint"), F.lit(None).cast("boolean")

    def summed(rows: DataFrame, **columns: Column) -> DataFrame:
        named = {"n": none_n, "first_us": none_n, "last_us": none_n, "dead": none_n, "ingest": none_t, "interruptive": none_t} | columns
        return rows.select(*keys, *[c.alias(name) for name, c in named.items()])

    volume = alerts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("event_us").alias("_a"), F.max("event_us").alias("_b"))
    refused = dead_letters.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    states = switches.groupBy(*keys).agg(
        F.min(F.when(F.col("switch") == "alerts_ingest", F.col("enabled"))).alias("_i"),
        F.min(F.when(F.col("switch") == "interruptive_lane", F.col("enabled"))).alias("_l"))
    all_rows = summed(volume, n=F.col("_n"), first_us=F.col("_a"), last_us=F.col("_b")).unionByName(
        summed(refused, dead=F.col("_n"))).unionByName(summed(states, ingest=F.col("_i"), interruptive=F.col("_l")))
    facts = all_rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("n", "first_us", "last_us", "dead", "ingest", "interruptive")])
    rate = F.col("n") / F.greatest((F.col("last_us") - F.col("first_us")) / 3_600_000_000, F.lit(1.0))

    def alarm(when: Column, severity: str, code: str, observed: Column) -> Column:
        return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), observed.cast("double").alias("observed")))

    raised = F.array_compact(F.array(
        alarm(rate > hourly_limit, "warning", "alert_volume_high", rate), alarm(~F.col("ingest"), "critical", "ingest_disabled", F.lit(0)),
        alarm(~F.col("interruptive"), "warning", "interruptive_disabled", F.lit(0)), alarm(F.col("dead") > 0, "warning", "dlq_nonempty", F.col("dead"))))
    return facts.select(*keys, F.explode(raised).alias("_alarm")).select(*keys, "_alarm.*")
