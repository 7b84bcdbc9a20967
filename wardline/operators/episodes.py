"""Episodes: correlated signals of one encounter become one thing to page about."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline import ids
from wardline.operators.folds import ordered_fold

MINUTE_US = 60_000_000
# Severity ranks and the order that breaks ties between equally severe signals.
SEVERITY = {"none": 0, "watch": 1, "urgent": 2, "critical": 3}
SIGNAL_PRIORITY = ("sepsis-3", "sofa-deterioration", "aki", "hemodynamic-shock", "hypotension",
                   "respiratory-deterioration")


@dataclass(frozen=True)
class EpisodeRules:
    window_minutes: int = 120
    page_refractory_minutes: int = 60
    reopen_after_resolve_minutes: int = 30
    priority: tuple[str, ...] = SIGNAL_PRIORITY


STEP = T.StructType([
    T.StructField("step_no", T.LongType()),
    T.StructField("episode_no", T.IntegerType()),
    T.StructField("action", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("should_page", T.BooleanType()),
    T.StructField("status", T.StringType()),
    T.StructField("dominant_type", T.StringType()),
    T.StructField("dominant_severity", T.StringType()),
    T.StructField("supporting_types", T.ArrayType(T.StringType())),
    T.StructField("page_count", T.IntegerType()),
    T.StructField("passive_count", T.IntegerType()),
    T.StructField("updated_us", T.LongType()),
    T.StructField("resolved_us", T.LongType()),
    T.StructField("acknowledged_us", T.LongType()),
    T.StructField("closed_previous", T.BooleanType()),
])


def episode_start() -> dict:
    return {"step": 0, "no": 0, "status": None}


def _open(s: dict, at: int) -> None:
    s.update(no=s["no"] + 1, status="open", opened=at, updated=at, resolved=None, acked=None, paged=None,
             best=None, dominant=None, severity="none", types={}, ids={}, pages=0, passives=0)


def _add(s: dict, r: EpisodeRules, sid: str, kind: str, tier: str, at: int, suppressed: bool, in_order: bool) -> None:
    s["ids"][sid] = at
    s["opened"] = min(s["opened"], at)
    s["updated"] = max(s["updated"], at)
    if suppressed:
        return
    rank = r.priority.index(kind) if kind in r.priority else len(r.priority) + 1
    key = (-SEVERITY.get(tier, 0), rank, -at, at, sid)
    if s["best"] is None or key < s["best"]:
        s["best"], s["dominant"], s["severity"] = key, kind, tier
    if kind not in s["types"] or (at, sid) < s["types"][kind]:
        s["types"][kind] = (at, sid)


def episode_one(s: dict, r: EpisodeRules, in_order: bool, event: str, sid: str | None, kind: str | None,
                tier: str | None, routing: str | None, suppressed: bool, at: int):
    """Fold one signal or control event (``ack`` / ``resolve``) into the key's active episode."""
    s["step"] += 1
    closed = False
    if event != "signal":
        if s["status"] is None:
            return None
        s["updated"] = max(s["updated"], at)
        if event == "ack":
            s["status"], s["acked"] = "acknowledged", at
            action, reason = "ack", "acknowledged"
        else:
            s["status"], s["resolved"] = "resolved", at
            action, reason = "resolve", "resolved"
        return _out(s, action, reason, closed)
    tier = (tier or "none").lower()
    actionable = not suppressed and (SEVERITY.get(tier, 0) >= 2 or routing == "interruptive")
    visible = not suppressed and (SEVERITY.get(tier, 0) >= 1 or routing == "passive")

    reopen = False
    if s["status"] == "resolved":
        reopen = at - s["resolved"] <= r.reopen_after_resolve_minutes * MINUTE_US and (actionable or visible)
        fresh = not reopen
    elif s["status"] is None:
        fresh = True
    else:
        edge = r.window_minutes * MINUTE_US
        fresh = not s["opened"] - edge <= at <= s["updated"] + edge
        closed = fresh and s["status"] != "acknowledged"
    if fresh:
        _open(s, at)
        _add(s, r, sid, kind, tier, at, suppressed, in_order)
        if actionable:
            s["pages"], s["paged"] = 1, at
            return _out(s, "page", "new_episode_interruptive", closed)
        s["passives"] = 1
        return _out(s, "passive", "new_episode_passive", closed)

    quiet = s["paged"] is not None and at - s["paged"] < r.page_refractory_minutes * MINUTE_US
    before, dominant = SEVERITY.get(s["severity"], 0), s["dominant"]
    if reopen:
        _add(s, r, sid, kind, tier, at, suppressed, in_order)
        s["status"], s["resolved"] = "reopened", None
        escalated = SEVERITY.get(s["severity"], 0) > before
        if actionable and not quiet:
            s["pages"], s["paged"] = s["pages"] + 1, at
            if escalated:
                s["status"] = "escalated"
            return _out(s, "page", "reopened_escalated" if escalated else "reopened_with_actionable_signal", closed)
        s["passives"] += 1
        return _out(s, "passive", "reopened_passive_update", closed)

    if sid in s["ids"]:
        s["updated"] = max(s["updated"], at)
        return _out(s, "none", "duplicate_signal_id", closed)
    _add(s, r, sid, kind, tier, at, suppressed, in_order)
    escalated = SEVERITY.get(s["severity"], 0) > before
    new_dominant = dominant is not None and s["dominant"] != dominant
    if s["status"] == "acknowledged" and (escalated or actionable):
        s["status"] = "escalated"
    worth = actionable or escalated
    if worth and not quiet:
        s["status"] = "escalated" if escalated else "updated"
        s["pages"], s["paged"] = s["pages"] + 1, at
        reason = ("severity_escalation" if escalated else "new_actionable_supporting_or_dominant"
                  if new_dominant and actionable else "new_actionable_signal")
        return _out(s, "page", reason, closed)
    s["passives"] += 1
    if visible or escalated or new_dominant:
        if s["status"] not in ("escalated", "acknowledged"):
            s["status"] = "updated"
        return _out(s, "passive", "passive_update_within_page_refractory" if worth else "passive_update", closed)
    return _out(s, "none", "non_actionable_or_suppressed", closed)


def _out(s: dict, action: str, reason: str, closed: bool):
    supporting = [k for k, _ in sorted(s["types"].items(), key=lambda kv: kv[1]) if k != s["dominant"]]
    return (s["step"], s["no"], action, reason, action == "page", s["status"], s["dominant"], s["severity"],
            supporting, s["pages"], s["passives"], s["updated"], s["resolved"], s["acked"], closed)


def signal_refs(alerts: DataFrame) -> DataFrame:
    """Alerts as episode input; the evidence they name (``evidence_ids``) goes along."""
    have = set(alerts.columns)
    evidence = ["evidence_ids"] if "evidence_ids" in have else []

    def c(name: str, kind: str, default=None) -> Column:
        return F.col(name) if name in have else F.lit(default).cast(kind)

    return alerts.select(
        "patient_id", F.coalesce("encounter_id", F.lit("")).alias("encounter_key"),
        F.lit("signal").alias("event"), F.col("alert_id").alias("signal_id"),
        F.coalesce(c("indicator", "string"), F.lit("unknown")).alias("signal_type"),
        F.coalesce(c("tier", "string"), F.lit("none")).alias("severity"), c("routing", "string").alias("routing"),
        F.coalesce(c("suppressed", "boolean"), F.lit(False)).alias("suppressed"), "event_us",
        c("score", "int").alias("score"), *evidence)


def control_rows(df: DataFrame, event: Column) -> DataFrame:
    """Acknowledge and resolve events as episode input."""
    none = F.lit(None).cast("string")
    return df.select(
        "patient_id", F.coalesce("encounter_id", F.lit("")).alias("encounter_key"), event.alias("event"),
        F.lit("").alias("signal_id"), none.alias("signal_type"), none.alias("severity"), none.alias("routing"),
        F.lit(False).alias("suppressed"), "event_us", F.lit(None).cast("int").alias("score"))


def arbitrate(signals: DataFrame, rules: EpisodeRules = EpisodeRules(),
              keys: Sequence[str] = ("patient_id", "encounter_key"),
              order: Sequence[str] = ("event_us", "signal_id"), in_order: bool = True,
              hot: bool | None = None) -> DataFrame:
    """One row per signal: the episode it joined and what that did.

    ``in_order`` says that ``order`` is event order; with any other order all signal ids of the open
    episode are remembered, to recognise a late duplicate.
    """
    inputs = ["event", "signal_id", "signal_type", "severity", "routing", "suppressed", "event_us"]

    def step(s, row):
        return s, episode_one(s, rules, in_order, *row)

    return ordered_fold(signals, keys, order, inputs, step, episode_start, STEP, keep=signals.columns, hot=hot)


def summarise(steps: DataFrame, keys: Sequence[str] = ("patient_id", "encounter_key")) -> DataFrame:
    """Episodes: identity from the earliest signal, state after the last step, pages, resolution."""
    # A step that closes the episode before it also says so of that one, so the closings need no join.
    told = steps.withColumn("_before", F.explode(
        F.when(F.col("closed_previous"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    own = ~F.col("_before")
    is_signal = own & (F.col("event") == "signal")
    last = F.struct("status", "dominant_type", "dominant_severity", "supporting_types", "page_count",
                    "passive_count", "updated_us", "resolved_us", "acknowledged_us", "action", "reason")
    out = told.withColumn("episode_no", F.col("episode_no") - F.col("_before").cast("int")).groupBy(*keys, "episode_no").agg(
        F.min(F.when(is_signal, F.struct("event_us", "signal_id"))).alias("_first"),
        F.max_by(last, F.when(own, F.col("step_no"))).alias("l"),
        F.count_if(is_signal & (F.col("reason") != "duplicate_signal_id")).alias("n_signals"),
        F.max("_before").alias("_elapsed")).where(F.col("l").isNotNull())
    elapsed = F.col("_elapsed")
    return out.select(
        *keys, "episode_no",
        ids.episode_id(F.col("patient_id"), F.col("encounter_key"), F.col("_first.event_us"),
                       F.col("_first.signal_id")).alias("episode_id"),
        F.col("_first.event_us").alias("opened_us"), "n_signals",
        F.when(elapsed, "resolved").otherwise(F.col("l.status")).alias("status"),
        F.when(elapsed, F.col("l.updated_us")).otherwise(F.col("l.resolved_us")).alias("resolved_us"),
        F.col("l.updated_us").alias("updated_us"), F.col("l.acknowledged_us").alias("acknowledged_us"),
        F.col("l.dominant_type").alias("dominant_type"), F.col("l.dominant_severity").alias("dominant_severity"),
        F.col("l.supporting_types").alias("supporting_types"), F.col("l.page_count").alias("page_count"),
        F.col("l.passive_count").alias("passive_count"), F.col("l.action").alias("last_action"),
        F.col("l.reason").alias("last_reason"))


def _own_signals(steps: DataFrame) -> DataFrame:
    """Signals that joined an episode: no control events, no signal told twice."""
    return steps.where((F.col("event") == "signal") & (F.col("reason") != "duplicate_signal_id"))


def evidence_union(steps: DataFrame, keys: Sequence[str] = ("patient_id", "encounter_key")) -> DataFrame:
    """Evidence of each episode as rows: every id once, where it first came up and how many signals name it.

    Suppressed signals count too. ``first_step`` and ``place`` (in that signal's list) give the order of the union;
    as rows an episode's evidence may grow without a growing value. Null ids are left out.
    """
    rows = _own_signals(steps).select(*keys, "episode_no", "step_no", F.posexplode("evidence_ids").alias("place", "evidence_id"))
    once = rows.where(F.col("evidence_id").isNotNull()).groupBy(*keys, "episode_no", "evidence_id").agg(
        F.min(F.struct("step_no", "place")).alias("f"), F.countDistinct("step_no").alias("n_signals"))
    return once.select(*keys, "episode_no", "evidence_id", F.col("f.step_no").alias("first_step"), F.col("f.place").alias("place"), "n_signals")


def _bare() -> Column:
    return F.coalesce(F.size(F.array_compact("evidence_ids")), F.lit(0)) <= 0


def missing_evidence(steps: DataFrame, keys: Sequence[str] = ("patient_id", "encounter_key")) -> DataFrame:
    """What an episode's context has to disclose: one entry per signal that names no evidence."""
    entry = F.concat_ws(":", "signal_type", "signal_id", F.lit("no_evidence"))
    return _own_signals(steps).where(_bare()).select(*keys, "episode_no", "step_no", entry.alias("missing_input"))


def disclosures(steps: DataFrame, keys: Sequence[str] = ("patient_id", "encounter_key")) -> DataFrame:
    """One row per episode: signals, signals without evidence, completeness, and the score of the first signal of the dominant type."""
    own = (F.col("event") == "signal") & (F.col("reason") != "duplicate_signal_id")
    by_type = steps.groupBy(*keys, "episode_no", "signal_type").agg(
        F.min(F.when(own, F.struct("step_no", "score"))).alias("first"), F.max(F.struct("step_no", "dominant_type")).alias("last"),
        F.count_if(own).alias("signals"), F.count_if(own & _bare()).alias("bare"))
    # One entry per signal type.
    out = by_type.groupBy(*keys, "episode_no").agg(
        F.sum("signals").alias("n_signals"), F.sum("bare").alias("n_missing"), F.max("last").alias("last"),
        F.collect_list(F.struct("signal_type", F.col("first.score").alias("score"))).alias("scores"))
    dominant = F.filter("scores", lambda x: x["signal_type"] == F.col("last.dominant_type"))
    return out.select(*keys, "episode_no", "n_signals", "n_missing", F.when(F.col("n_missing") > 0, "partial").otherwise("complete").alias("completeness"),
                      F.get(dominant, F.lit(0))["score"].alias("score"))


def audit_log(steps: DataFrame, keys: Sequence[str] = ("patient_id", "encounter_key")) -> DataFrame:
    """Audit entries as rows, the elapsed-window closings included."""
    entries = steps.select(*keys, "episode_no", F.col("event_us").alias("at_us"), "action", "status", "reason",
                           F.nullif("signal_id", F.lit("")).alias("signal_id"))
    # A step that closes the episode before it also says so of that one, so the closings need no join.
    own = F.struct("episode_no", "updated_us", F.lit(False).alias("elapsed"))
    before = F.struct((F.col("episode_no") - 1).alias("episode_no"), F.lit(None).cast("long").alias("updated_us"), F.lit(True).alias("elapsed"))
    told = steps.select(*keys, F.inline(F.when(F.col("closed_previous"), F.array(own, before)).otherwise(F.array(own))))
    closings = told.groupBy(*keys, "episode_no").agg(F.max("updated_us").alias("at_us"), F.max("elapsed").alias("elapsed")).where("elapsed").select(
        *keys, "episode_no", "at_us", F.lit("resolve").alias("action"), F.lit("resolved").alias("status"),
        F.lit("episode_window_elapsed").alias("reason"), F.lit(None).cast("string").alias("signal_id"))
    return entries.unionByName(closings)


def dominant_of(signal_type: str = "signal_type", severity: str = "severity", at: str = "event_us",
                sid: str = "signal_id", priority: Sequence[str] = SIGNAL_PRIORITY) -> Column:
    """Aggregate: the dominant signal of a group of unsuppressed signals."""
    rank, prio = F.lit(0), F.lit(len(priority) + 1)
    for name, n in SEVERITY.items():
        rank = F.when(F.lower(F.col(severity)) == name, n).otherwise(rank)
    for i, name in enumerate(priority):
        prio = F.when(F.col(signal_type) == name, i).otherwise(prio)
    return F.min_by(F.struct(F.col(signal_type).alias("type"), F.col(severity).alias("severity"),
                             F.col(sid).alias("signal_id")),
                    F.struct(-rank, prio, -F.col(at), F.col(sid)))


def routing_rationale() -> Column:
    """Sentence that explains an episode's routing."""
    tail = F.concat(F.lit("last_action="), F.col("last_action"), F.lit(":"), F.col("last_reason"), F.lit("."))
    pages = F.col("page_count").cast("string")
    return (
        F.when((F.col("page_count") > 0) & F.col("dominant_severity").isin("urgent", "critical"), F.concat(
            F.lit("Interruptive: dominant "), F.col("dominant_type"), F.lit(" at "), F.col("dominant_severity"),
            F.lit("; page_count="), pages, F.lit("; "), tail))
        .when((F.col("passive_count") > 0) | (F.col("dominant_severity") == "watch"), F.concat(
            F.lit("Passive: visible episode without repeat interruptive page; passive_updates="),
            F.col("passive_count").cast("string"), F.lit("; "), tail))
        .otherwise(F.concat(F.lit("Routing none/open: status="), F.col("status"), F.lit("; severity="),
                            F.col("dominant_severity"), F.lit("."))))
