"""Episodes over governed alerts, pressure signals and acknowledge / resolve events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import ids
from wardline.catalog.base import SCORED, alert_id_sql, alert_source, governance_sql, joined, query, uuid_sql
from wardline.catalog.governance import ACTIVE, governed
from wardline.functions.scores import SOFA_COMPONENTS
from wardline.operators import episodes as EP
from wardline.operators import latest
from wardline.plans import snapshots as snap
from wardline.sources import projection as P


def signals(spark: SparkSession, sf: str, shape: latest.Shape | None = None) -> DataFrame:
    """Emitted organ-dysfunction alerts, low-pressure signals and control events."""
    env = P.envelopes(spark, sf)
    shape = shape or latest.shape_of(env)
    alerts = EP.signal_refs(governed(spark, sf, ACTIVE, shape).where("emit"))
    rows = snap.snapshots(env, shape).where(
        (F.col("component") == "cardiovascular") & (F.col("map_mmhg") < 65))
    score = F.when(F.col("map_mmhg") < 55, 6).otherwise(4)
    pressure = EP.signal_refs(rows.select(
        "patient_id", F.col("encounter_now").alias("encounter_id"), "event_us", score.alias("score"),
        F.when(F.col("map_mmhg") < 55, "critical").otherwise("urgent").alias("tier"),
        F.lit("hemodynamic-shock").alias("indicator"), F.lit("interruptive").alias("routing"),
        ids.alert_id(F.col("patient_id"), F.col("encounter_now"), F.lit("hemodynamic-shock"), score,
                     F.col("event_us"), F.lit("0.1.0")).alias("alert_id")))
    r = P.readings(spark, sf).where(F.col("k").isin(50, 51))
    control = EP.control_rows(r, F.when(F.col("k") == 50, "ack").otherwise("resolve"))
    return alerts.unionByName(pressure).unionByName(control)


def by_encounter(rows: DataFrame, shape: latest.Shape) -> DataFrame:
    """Signals or their steps in as many tasks as the records ask for; a very large key is dealt by the fold and the aggregates themselves."""
    return rows if shape.hot else latest.by_key(rows, ["patient_id", "encounter_key"], shape.rows)


def steps(spark: SparkSession, sf: str, shape: latest.Shape | None = None) -> DataFrame:
    # A patient yields at most three signals per record, so the records' size decides the layout.
    shape = shape or latest.shape_of(P.envelopes(spark, sf))
    return EP.arbitrate(by_encounter(signals(spark, sf, shape), shape), hot=shape.hot)


def summaries(spark: SparkSession, sf: str) -> DataFrame:
    shape = latest.shape_of(P.envelopes(spark, sf))
    return EP.summarise(by_encounter(steps(spark, sf, shape), shape))


_HSCORE = "(CASE WHEN map_mmhg < 55 THEN 6 ELSE 4 END)"
SIGNALS_SQL = f"""{SCORED}, {alert_source(ACTIVE)}, {governance_sql('src', ACTIVE, SOFA_COMPONENTS)},
sofa_alerts AS (
  SELECT s.patient_id, coalesce(s.encounter_now, '') AS encounter_key, 'signal' AS event,
    {alert_id_sql('sofa-deterioration', '0.3.0', 's.encounter_now', 's.score').replace('patient_id', 's.patient_id').replace('(event_us', '(s.event_us')} AS signal_id,
    'sofa-deterioration' AS signal_type, s.tier AS severity, g.routing, s.event_us, s.score
  FROM gov g JOIN src ON src.pk = g.pk AND src.rn = g.rn
  JOIN scored s ON s.patient_id = g.pk AND s.idempotency_key = src.idempotency_key WHERE g.emit),
pressure AS (
  SELECT patient_id, coalesce(encounter_now, '') AS encounter_key, 'signal' AS event,
    {alert_id_sql('hemodynamic-shock', '0.1.0', 'encounter_now', _HSCORE)} AS signal_id,
    'hemodynamic-shock' AS signal_type, CASE WHEN map_mmhg < 55 THEN 'critical' ELSE 'urgent' END AS severity,
    'interruptive' AS routing, event_us, {_HSCORE} AS score
  FROM snap WHERE component = 'cardiovascular' AND map_mmhg < 65),
control AS (
  SELECT patient_id, coalesce(encounter_id, '') AS encounter_key, CASE k WHEN 50 THEN 'ack' ELSE 'resolve' END AS event,
    '' AS signal_id, NULL::VARCHAR AS signal_type, NULL::VARCHAR AS severity, NULL::VARCHAR AS routing, event_us,
    NULL::INT AS score
  FROM rd WHERE k IN (50, 51)),
sig AS (SELECT * FROM sofa_alerts UNION ALL SELECT * FROM pressure UNION ALL SELECT * FROM control)"""


def episode_sql(source: str = "sig", name: str = "ep") -> str:
    rank = "(CASE {x} WHEN 'critical' THEN 3 WHEN 'urgent' THEN 2 WHEN 'watch' THEN 1 ELSE 0 END)"
    r_in, r_now = rank.format(x="severity"), rank.format(x="dsev")
    prio = ("(CASE signal_type WHEN 'sepsis-3' THEN 0 WHEN 'sofa-deterioration' THEN 1 WHEN 'aki' THEN 2 "
            "WHEN 'hemodynamic-shock' THEN 3 WHEN 'hypotension' THEN 4 WHEN 'respiratory-deterioration' THEN 5 ELSE 7 END)")
    return f"""
{name}_in AS (SELECT *, patient_id || '#' || encounter_key AS pk,
  row_number() OVER (PARTITION BY patient_id, encounter_key ORDER BY event_us, signal_id) AS rn FROM {source}),
{name} AS (
  SELECT DISTINCT pk, 0::BIGINT AS rn, 0 AS no, NULL::VARCHAR AS status, NULL::BIGINT AS opened, NULL::BIGINT AS updated,
    NULL::BIGINT AS resolved, NULL::BIGINT AS acked, NULL::BIGINT AS paged, NULL::VARCHAR AS dtype, 'none' AS dsev,
    7 AS dprio, NULL::BIGINT AS dtime, []::VARCHAR[] AS types, []::VARCHAR[] AS sids, 0 AS pages, 0 AS passives,
    NULL::VARCHAR AS action, NULL::VARCHAR AS reason, false AS closed, NULL::VARCHAR AS event, NULL::BIGINT AS event_us,
    NULL::VARCHAR AS signal_id
  FROM {name}_in
  UNION ALL
  SELECT pk, rn, no, status, opened, updated, resolved, acked,
    CASE WHEN action = 'page' THEN event_us ELSE paged END, dtype, dsev, dprio, dtime, types, sids,
    pages + (action = 'page')::INT, passives + (mode IN ('fresh','reopen','update') AND action <> 'page')::INT,
    action, reason, closed, event, event_us, signal_id
  FROM (
    SELECT * REPLACE (
      CASE mode WHEN 'ack' THEN 'acknowledged' WHEN 'resolve' THEN 'resolved' WHEN 'fresh' THEN 'open'
        WHEN 'reopen' THEN CASE WHEN action = 'page' AND escalated THEN 'escalated' ELSE 'reopened' END
        WHEN 'update' THEN CASE WHEN action = 'page' THEN CASE WHEN escalated THEN 'escalated' ELSE 'updated' END
          WHEN action = 'passive' AND status2 NOT IN ('escalated','acknowledged') THEN 'updated' ELSE status2 END
        ELSE status END AS status)
    FROM (
      SELECT *, CASE mode
          WHEN 'ack' THEN 'ack' WHEN 'resolve' THEN 'resolve' WHEN 'skip' THEN 'skip' WHEN 'dup' THEN 'none'
          WHEN 'fresh' THEN CASE WHEN actionable THEN 'page' ELSE 'passive' END
          WHEN 'reopen' THEN CASE WHEN actionable AND NOT quiet THEN 'page' ELSE 'passive' END
          ELSE CASE WHEN (actionable OR escalated) AND NOT quiet THEN 'page'
            WHEN visible OR escalated OR newdom THEN 'passive' ELSE 'none' END END AS action,
        CASE mode
          WHEN 'ack' THEN 'acknowledged' WHEN 'resolve' THEN 'resolved' WHEN 'dup' THEN 'duplicate_signal_id'
          WHEN 'fresh' THEN CASE WHEN actionable THEN 'new_episode_interruptive' ELSE 'new_episode_passive' END
          WHEN 'reopen' THEN CASE WHEN actionable AND NOT quiet THEN
              CASE WHEN escalated THEN 'reopened_escalated' ELSE 'reopened_with_actionable_signal' END
              ELSE 'reopened_passive_update' END
          WHEN 'update' THEN CASE WHEN (actionable OR escalated) AND NOT quiet THEN
              CASE WHEN escalated THEN 'severity_escalation'
                WHEN newdom AND actionable THEN 'new_actionable_supporting_or_dominant' ELSE 'new_actionable_signal' END
            WHEN visible OR escalated OR newdom THEN CASE WHEN actionable OR escalated
              THEN 'passive_update_within_page_refractory' ELSE 'passive_update' END
            ELSE 'non_actionable_or_suppressed' END END AS reason,
        CASE WHEN status = 'acknowledged' AND (escalated OR actionable) THEN 'escalated' ELSE status END AS status2
      FROM (
        SELECT * REPLACE (
            CASE WHEN adds AND takes THEN signal_type ELSE dtype END AS dtype,
            CASE WHEN adds AND takes THEN severity ELSE dsev END AS dsev,
            CASE WHEN adds AND takes THEN prio ELSE dprio END AS dprio,
            CASE WHEN adds AND takes THEN event_us ELSE dtime END AS dtime,
            CASE WHEN adds AND NOT list_contains(types, signal_type) THEN list_append(types, signal_type) ELSE types END AS types,
            CASE WHEN adds THEN list_append(sids, signal_id) ELSE sids END AS sids),
          adds AND takes AND sev_in > {r_now} AS escalated,
          adds AND takes AND dtype IS NOT NULL AND dtype <> signal_type AS newdom
        FROM (
          SELECT *, mode IN ('fresh','reopen','update') AS adds,
            dtype IS NULL OR sev_in > {r_now} OR (sev_in = {r_now} AND (prio < dprio OR (prio = dprio AND event_us > dtime))) AS takes
          FROM (
            SELECT pk, rn, event, event_us, signal_id, signal_type, severity, mode, closed, sev_in, prio, actionable, visible,
              no + (mode = 'fresh')::INT AS no, status,
              CASE WHEN mode = 'fresh' THEN event_us ELSE opened END AS opened,
              CASE WHEN mode = 'fresh' THEN event_us WHEN mode = 'skip' THEN updated ELSE greatest(updated, event_us) END AS updated,
              CASE mode WHEN 'fresh' THEN NULL WHEN 'reopen' THEN NULL WHEN 'resolve' THEN event_us ELSE resolved END AS resolved,
              CASE mode WHEN 'fresh' THEN NULL WHEN 'ack' THEN event_us ELSE acked END AS acked,
              CASE WHEN mode = 'fresh' THEN NULL ELSE paged END AS paged,
              CASE WHEN mode = 'fresh' THEN NULL ELSE dtype END AS dtype,
              CASE WHEN mode = 'fresh' THEN 'none' ELSE dsev END AS dsev,
              CASE WHEN mode = 'fresh' THEN 7 ELSE dprio END AS dprio, CASE WHEN mode = 'fresh' THEN NULL ELSE dtime END AS dtime,
              CASE WHEN mode = 'fresh' THEN []::VARCHAR[] ELSE types END AS types,
              CASE WHEN mode = 'fresh' THEN []::VARCHAR[] ELSE sids END AS sids,
              CASE WHEN mode = 'fresh' THEN 0 ELSE pages END AS pages, CASE WHEN mode = 'fresh' THEN 0 ELSE passives END AS passives,
              mode <> 'fresh' AND coalesce(event_us - paged < 3600000000::BIGINT, false) AS quiet
            FROM (
              SELECT *, CASE WHEN event <> 'signal' THEN CASE WHEN status IS NULL THEN 'skip' ELSE event END
                  WHEN status IS NULL THEN 'fresh'
                  WHEN status = 'resolved' THEN CASE WHEN event_us - resolved <= 1800000000::BIGINT AND (actionable OR visible)
                    THEN 'reopen' ELSE 'fresh' END
                  WHEN NOT (event_us BETWEEN opened - 7200000000::BIGINT AND updated + 7200000000::BIGINT) THEN 'fresh'
                  WHEN list_contains(sids, signal_id) THEN 'dup' ELSE 'update' END AS mode,
                event = 'signal' AND status IS NOT NULL AND status NOT IN ('resolved','acknowledged')
                  AND NOT (event_us BETWEEN opened - 7200000000::BIGINT AND updated + 7200000000::BIGINT) AS closed
              FROM (
                SELECT s.pk, s.rn, s.event, s.event_us, s.signal_id, s.signal_type, s.severity, {r_in} AS sev_in, {prio} AS prio,
                  ({r_in} >= 2 OR coalesce(s.routing = 'interruptive', false)) AS actionable,
                  ({r_in} >= 1 OR coalesce(s.routing = 'passive', false)) AS visible,
                  e.no, e.status, e.opened, e.updated, e.resolved, e.acked, e.paged, e.dtype, e.dsev, e.dprio, e.dtime,
                  e.types, e.sids, e.pages, e.passives
                FROM {name} e JOIN {name}_in s ON s.pk = e.pk AND s.rn = e.rn + 1))))))))"""


_STEPS = f"WITH RECURSIVE {SIGNALS_SQL}, {episode_sql()}"


@query("episode_steps", "EPI-1 EPI-2 EPI-3 EPI-4 EPI-5 EPI-6", f"""{_STEPS}
SELECT pk, event_us, signal_id, no AS episode_no, action, reason, status, dtype AS dominant_type,
  dsev AS dominant_severity, pages AS page_count, passives AS passive_count,
  array_to_string(list_filter(types, lambda x: x <> dtype), ',') AS supporting
FROM ep WHERE rn > 0 AND action <> 'skip'""")
def episode_steps(spark: SparkSession, sf: str) -> DataFrame:
    """What every signal did: page, passive update, duplicate, acknowledge, resolve."""
    return steps(spark, sf).select(
        F.concat_ws("#", "patient_id", "encounter_key").alias("pk"), "event_us", "signal_id", "episode_no", "action",
        "reason", "status", "dominant_type", "dominant_severity", "page_count", "passive_count",
        joined("supporting_types").alias("supporting"))


_EPISODES = f"""{_STEPS},
closers AS (SELECT pk, no - 1 AS no FROM ep WHERE closed),
eps AS (
  SELECT e.pk, e.no, min(e.event_us) FILTER (e.event = 'signal') AS opened_us,
    arg_min(e.signal_id, {{'a': e.event_us, 'b': e.signal_id}}) FILTER (e.event = 'signal') AS first_signal,
    count(*) FILTER (e.event = 'signal' AND reason <> 'duplicate_signal_id') AS n_signals,
    CASE WHEN bool_or(c.no IS NOT NULL) THEN 'resolved' ELSE arg_max(status, rn) END AS status,
    CASE WHEN bool_or(c.no IS NOT NULL) THEN arg_max(updated, rn) ELSE max(resolved) FILTER (rn = last_rn) END AS resolved_us,
    arg_max(updated, rn) AS updated_us, arg_max(dtype, rn) AS dominant_type, arg_max(dsev, rn) AS dominant_severity,
    arg_max(pages, rn) AS page_count, arg_max(passives, rn) AS passive_count, arg_max(action, rn) AS last_action,
    arg_max(reason, rn) AS last_reason
  FROM (SELECT *, max(rn) OVER (PARTITION BY pk, no) AS last_rn FROM ep WHERE rn > 0 AND action <> 'skip') e
  LEFT JOIN closers c ON c.pk = e.pk AND c.no = e.no GROUP BY e.pk, e.no)"""
_EPISODE_ID = "'episode-' || " + uuid_sql(
    "split_part(pk, '#', 1) || '|' || split_part(pk, '#', 2) || '|' || (opened_us // 1000) || '|' || first_signal")


@query("episodes", "EPI-2 EPI-7 EPI-8 PRJ-19 SRT-3 WIN-9", f"""{_EPISODES}
SELECT pk, no AS episode_no, {_EPISODE_ID} AS episode_id, opened_us, n_signals, status, resolved_us, updated_us,
  dominant_type, dominant_severity, page_count, passive_count FROM eps""")
def episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes with identity, dominant signal, pages and resolution."""
    out = summaries(spark, sf)
    return out.select(
        F.concat_ws("#", "patient_id", "encounter_key").alias("pk"), "episode_no", "episode_id", "opened_us",
        "n_signals", "status", "resolved_us", "updated_us", "dominant_type", "dominant_severity", "page_count",
        "passive_count")


@query("episode_context", "EPI-10", f"""{_EPISODES}
SELECT {_EPISODE_ID} AS episode_id, CASE
  WHEN page_count > 0 AND dominant_severity IN ('urgent', 'critical') THEN 'Interruptive: dominant ' || dominant_type ||
    ' at ' || dominant_severity || '; page_count=' || page_count || '; last_action=' || last_action || ':' || last_reason || '.'
  WHEN passive_count > 0 OR dominant_severity = 'watch' THEN
    'Passive: visible episode without repeat interruptive page; passive_updates=' || passive_count || '; last_action=' ||
    last_action || ':' || last_reason || '.'
  ELSE 'Routing none/open: status=' || status || '; severity=' || dominant_severity || '.' END AS rationale,
  sha256(pk || '|' || no || '|' || status || '|' || coalesce(dominant_type, '') || '|' || dominant_severity || '|' ||
    page_count || '|' || passive_count || '|' || last_action || '|' || last_reason) AS snapshot_hash
FROM eps""")
def episode_context(spark: SparkSession, sf: str) -> DataFrame:
    """Routing rationale and a stable content hash of every episode."""
    out = summaries(spark, sf)
    text = F.concat_ws("|", F.concat_ws("#", "patient_id", "encounter_key"), "episode_no", "status",
                       F.coalesce("dominant_type", F.lit("")), "dominant_severity", "page_count", "passive_count",
                       "last_action", "last_reason")
    return out.select("episode_id", EP.routing_rationale().alias("rationale"), F.sha2(text, 256).alias("snapshot_hash"))


@query("episode_volume", "AGG-22", f"""{_STEPS}
SELECT count(*) FILTER (event = 'signal') AS naive, (SELECT count(*) FROM sig WHERE routing = 'passive') AS passive,
  (SELECT count(*) FROM sig WHERE routing = 'interruptive') AS interruptive,
  count(*) FILTER (action = 'page') AS episode_pages,
  round(count(*) FILTER (action = 'page') / count(*) FILTER (event = 'signal'), 3) AS reduction
FROM ep WHERE rn > 0 AND action <> 'skip'""")
def episode_volume(spark: SparkSession, sf: str) -> DataFrame:
    """Every signal as a page, governed lanes, and episode pages side by side."""
    sig = F.col("event") == "signal"
    out = steps(spark, sf).agg(
        F.count_if(sig).alias("naive"), F.count_if(F.col("routing") == "passive").alias("passive"),
        F.count_if(F.col("routing") == "interruptive").alias("interruptive"),
        F.count_if("should_page").alias("episode_pages"))
    return out.withColumn("reduction", F.when(F.col("naive") > 0, F.round(F.col("episode_pages") / F.col("naive"), 3)))


@query("episode_dominant_signal", "WIN-9 EPI-8", f"""WITH RECURSIVE {SIGNALS_SQL}
SELECT patient_id, encounter_key, signal_type, severity, signal_id FROM sig WHERE event = 'signal'
QUALIFY row_number() OVER (PARTITION BY patient_id, encounter_key ORDER BY
  CASE severity WHEN 'critical' THEN 0 WHEN 'urgent' THEN 1 WHEN 'watch' THEN 2 ELSE 3 END,
  CASE signal_type WHEN 'sofa-deterioration' THEN 1 ELSE 3 END, event_us DESC, signal_id) = 1""")
def episode_dominant(spark: SparkSession, sf: str) -> DataFrame:
    """Dominant signal of each encounter."""
    return signals(spark, sf).where(F.col("event") == "signal").groupBy("patient_id", "encounter_key").agg(
        EP.dominant_of().alias("d")).select("patient_id", "encounter_key", F.col("d.type").alias("signal_type"),
                                            F.col("d.severity").alias("severity"),
                                            F.col("d.signal_id").alias("signal_id"))


@query("episode_audit", "EPI-7 SNK-8", f"""{_STEPS},
ends AS (SELECT pk, no, max(updated) AS at_us FROM ep WHERE rn > 0 AND action <> 'skip' GROUP BY pk, no)
SELECT pk, no AS episode_no, event_us AS at_us, action, reason FROM ep WHERE rn > 0 AND action <> 'skip'
UNION ALL SELECT e.pk, e.no, e.at_us, 'resolve', 'episode_window_elapsed' FROM ep c JOIN ends e ON e.pk = c.pk AND e.no = c.no - 1
WHERE c.closed""")
def episode_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Audit entries of all episodes."""
    out = EP.audit_log(steps(spark, sf))
    return out.select(F.concat_ws("#", "patient_id", "encounter_key").alias("pk"), "episode_no", "at_us", "action", "reason")


# What a signal names: the reading of its moment and the panel of its hour, which other signals of that hour name too; some name nothing.
_EVIDENCE = "CASE WHEN event_us % 7 = 3 THEN {none} ELSE {array}(concat('Observation/', event_us), concat('Panel/', {hour})) END"
_NAMED = f"""{_STEPS},
named AS (SELECT e.pk, e.no, e.rn, e.signal_id, i.signal_type, i.score, {_EVIDENCE.format(none='[]::VARCHAR[]', array='list_value', hour='i.event_us // 3600000000').replace('event_us %', 'i.event_us %').replace(' event_us)', ' i.event_us)')} AS evidence
  FROM ep e JOIN ep_in i ON i.pk = e.pk AND i.rn = e.rn WHERE e.rn > 0 AND e.action <> 'skip' AND e.event = 'signal' AND e.reason <> 'duplicate_signal_id')"""


def named_steps(spark: SparkSession, sf: str, shape: latest.Shape | None = None) -> DataFrame:
    shape = shape or latest.shape_of(P.envelopes(spark, sf))
    evidence = F.expr(_EVIDENCE.format(none="cast(array() AS array<string>)", array="array", hour="event_us div 3600000000"))
    named = signals(spark, sf, shape).withColumn("evidence_ids", F.when(F.col("event") == "signal", evidence))
    return EP.arbitrate(by_encounter(named, shape), hot=shape.hot)


def told_by_episode(spark: SparkSession, sf: str) -> DataFrame:
    shape = latest.shape_of(P.envelopes(spark, sf))
    return by_encounter(named_steps(spark, sf, shape), shape)


_PK = "concat_ws('#', patient_id, encounter_key) AS pk"


@query("episode_evidence", "EPI-8", f"""{_NAMED}
SELECT pk, no AS episode_no, evidence_id, min(rn) AS first_step, count(*) AS n_signals FROM (SELECT pk, no, rn, unnest(evidence) AS evidence_id FROM named) GROUP BY ALL""")
def episode_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of every episode: the union over its signals."""
    return EP.evidence_union(told_by_episode(spark, sf)).selectExpr(_PK, "episode_no", "evidence_id", "first_step", "n_signals")


@query("episode_missing_evidence", "EPI-10", f"""{_NAMED}
SELECT pk, no AS episode_no, signal_type || ':' || signal_id || ':no_evidence' AS missing_input FROM named WHERE len(evidence) = 0""")
def episode_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of every episode that name no evidence, as its context discloses them."""
    return EP.missing_evidence(named_steps(spark, sf)).selectExpr(_PK, "episode_no", "missing_input")


@query("episode_disclosure", "EPI-10", f"""{_NAMED},
dom AS (SELECT pk, no, arg_max(dtype, rn) AS dtype FROM ep WHERE rn > 0 AND action <> 'skip' GROUP BY ALL)
SELECT d.pk, d.no AS episode_no, count(n.rn) AS n_signals, count(*) FILTER (len(n.evidence) = 0) AS n_missing,
  CASE WHEN count(*) FILTER (len(n.evidence) = 0) > 0 THEN 'partial' ELSE 'complete' END AS completeness,
  arg_min(n.score, n.rn) FILTER (n.signal_type = d.dtype) AS score
FROM dom d LEFT JOIN named n ON n.pk = d.pk AND n.no = d.no GROUP BY d.pk, d.no""")
def episode_disclosure(spark: SparkSession, sf: str) -> DataFrame:
    """How complete every episode's context is, and the score it shows."""
    return EP.disclosures(told_by_episode(spark, sf)).selectExpr(_PK, "episode_no", "n_signals", "n_missing", "completeness", "score")
