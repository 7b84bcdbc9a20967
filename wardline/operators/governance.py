"""Alert governance: which scores are worth emitting, and which of those may interrupt someone."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.operators.folds import ordered_fold
from wardline.rules import Governance

MINUTE_US = 60_000_000

DECISION = T.StructType([
    T.StructField("emit", T.BooleanType()),
    T.StructField("reason", T.StringType()),
    T.StructField("routing", T.StringType()),
    T.StructField("page_deferred_reason", T.StringType()),
    T.StructField("crossings", T.IntegerType()),
    T.StructField("persisted_us", T.LongType()),
    T.StructField("newly_worsened", T.ArrayType(T.StringType())),
    T.StructField("max_component_delta", T.IntegerType()),
])

# Position of each part of the state; a plain list keeps the step fast and easy to store.
_SEEN, _ENC, _FLAG, _N, _FIRST, _LAST, _FIRST_SCORE, _BASE, _BASE_AT, _EMITTED, _VECTOR = range(11)


def governance_start() -> list:
    return [None, None, None, 0, None, None, None, None, None, None, {}]


def _page_defer(g: Governance, st: list, score: int, persisted: int, positive, worsened, biggest):
    if not g.page_gate_enabled:
        return None
    if st[_N] < g.page_min_crossings:
        return "page_crossings"
    if persisted < g.page_trajectory_persistence_minutes * MINUTE_US:
        return "page_persistence"
    if g.page_min_score_delta > 0 and score - st[_FIRST_SCORE] < g.page_min_score_delta:
        return "page_not_rising"
    if g.page_min_positive_components > 0 and (positive is None or positive < g.page_min_positive_components):
        return "page_components"
    if len(worsened) < g.page_min_newly_worsened_components:
        return "page_component_delta"
    if g.page_min_component_delta > 0 and biggest < g.page_min_component_delta:
        return "page_component_delta_min"
    wanted = g.page_high_actionability_components
    if wanted and not set(worsened) & set(wanted):
        return "page_high_actionability"
    return None


def govern_one(st: list, g: Governance, event_us: int, encounter: str | None, score: int | None, tier: str,
               flag: str | None, positive: int | None, points: dict[str, int], quality: str | None):
    """Decide one alert and advance the state. ``flag`` is its smallest suppressing context flag."""
    if g.reject_late_out_of_order and st[_SEEN] is not None and event_us < st[_SEEN]:
        return False, "late_out_of_order", "none", None, 0, 0, None, None
    if st[_SEEN] is None or event_us > st[_SEEN]:
        st[_SEEN] = event_us
    encounter = (encounter or "").strip()
    if encounter and encounter != st[_ENC]:
        st[1:] = governance_start()[1:]
        st[_ENC] = encounter
    if flag is not None and (st[_FLAG] is None or flag < st[_FLAG]):
        st[_FLAG] = flag
    if score is None or tier == "none":
        st[_N], st[_FIRST], st[_LAST], st[_FIRST_SCORE] = 0, None, None, None
        return False, "below_threshold", "none", None, 0, 0, None, None
    if st[_FLAG] is not None:
        return False, f"context:{st[_FLAG]}", "none", None, st[_N], 0, None, None
    if (g.baseline_enabled and st[_BASE_AT] is not None
            and event_us - st[_BASE_AT] > g.baseline_lookback_hours * 60 * MINUTE_US):
        st[_BASE] = st[_BASE_AT] = None
    if st[_LAST] is not None and event_us - st[_LAST] > g.resolution_gap_minutes * MINUTE_US:
        st[_N], st[_FIRST], st[_LAST], st[_FIRST_SCORE] = 0, None, None, None
    if st[_LAST] != event_us:
        if st[_FIRST] is None:
            st[_FIRST], st[_FIRST_SCORE], st[_N] = event_us, score, 1
        else:
            st[_N] += 1
        st[_LAST] = event_us
    persisted = event_us - st[_FIRST]
    n = st[_N]
    if n < g.min_crossings or persisted < g.trajectory_persistence_minutes * MINUTE_US:
        return False, "trajectory_not_met", "none", None, n, persisted, None, None
    if g.baseline_enabled:
        if st[_BASE] is None:
            st[_BASE], st[_BASE_AT] = score, event_us
            return False, "baseline_init", "none", None, n, persisted, None, None
        if score - st[_BASE] < g.baseline_delta_threshold:
            return False, "below_baseline_delta", "none", None, n, persisted, None, None
    if st[_EMITTED] is not None and event_us - st[_EMITTED] < g.refractory_minutes * MINUTE_US:
        return False, "refractory", "none", None, n, persisted, None, None

    deltas = {name: p - st[_VECTOR].get(name, 0) for name, p in points.items()}
    worsened = sorted(name for name, d in deltas.items() if d > 0)
    biggest = max(deltas.values(), default=0)
    deferred = _page_defer(g, st, score, persisted, positive, worsened, biggest) or quality
    reason, routing = "pass", "none"
    if tier in g.interruptive_tiers:
        routing = "passive" if deferred else "interruptive"
        if deferred:
            reason = f"pass_watch:{deferred}"
    else:
        deferred = None
        if tier in g.passive_tiers:
            routing = "passive"
    st[_EMITTED] = event_us
    if points:
        st[_VECTOR] = dict(points)
    return True, reason, routing, deferred, n, persisted, worsened, biggest


def quality_defer(g: Governance, columns: Sequence[str]) -> Column:
    """Why the data behind an alert is not good enough to page on; null when it is."""
    none = F.lit(None).cast("string")
    if not g.quality_gate_enabled:
        return none
    have = set(columns)

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False)) if name in have else F.lit(False)

    case = F.when(F.lit(False), none)
    if g.quality_max_data_age_minutes > 0 and "data_age_minutes" in have:
        case = case.when(F.col("data_age_minutes") > g.quality_max_data_age_minutes, "quality_stale")
    if g.quality_reject_invalid:
        case = case.when(flag("invalid_observation"), "quality_invalid")
    if g.quality_reject_contradictory:
        case = case.when(flag("contradictory_observations"), "quality_contradictory")
    if g.quality_require_critical_inputs and "missing_critical_inputs" in have:
        case = case.when(F.size(F.coalesce("missing_critical_inputs", F.array())) > 0, "quality_missing_critical")
    if g.quality_require_trusted_source and "source_trust" in have:
        case = case.when(F.lower(F.coalesce("source_trust", F.lit("trusted"))) != "trusted",
                         "quality_untrusted_source")
    if g.quality_reject_ood:
        case = case.when(flag("out_of_distribution"), "quality_ood")
    return case


def suppressing_flag(g: Governance, columns: Sequence[str]) -> Column:
    """Smallest context flag of the row that suppresses alerts."""
    if "context_flags" not in columns or not g.suppression_flags:
        return F.lit(None).cast("string")
    return F.array_min(F.array_intersect("context_flags", F.array(*[F.lit(x) for x in g.suppression_flags])))


def govern(alerts: DataFrame, config: Governance | Mapping[str, Governance],
           keys: Sequence[str] = ("patient_id",), order: Sequence[str] = ("event_us", "idempotency_key"),
           components: Sequence[str] = (), keep: Sequence[str] | None = None,
           hot: bool | None = None, spread: bool = False) -> DataFrame:
    """Run governance over alerts, including those with tier ``none`` (they end a streak).

    With several configurations, the rows carry ``config_id`` and it is one of the keys. ``components``
    names point columns ``p_<name>`` for the component-change gates.
    """
    configs = dict(config) if isinstance(config, Mapping) else {None: config}
    flag, quality = F.lit(None).cast("string"), F.lit(None).cast("string")
    for cid, g in configs.items():
        f, q = suppressing_flag(g, alerts.columns), quality_defer(g, alerts.columns)
        if cid is None:
            flag, quality = f, q
        else:
            here = F.col("config_id") == cid
            flag, quality = F.when(here, f).otherwise(flag), F.when(here, q).otherwise(quality)
    keep = list(alerts.columns if keep is None else keep)
    have_positive = "positive_components" in alerts.columns
    ready = alerts.withColumns({"_flag": flag, "_quality": quality}).withColumn(
        "_positive", F.col("positive_components") if have_positive else F.lit(None).cast("int"))
    many = None not in configs
    inputs = ["event_us", "encounter_id", "score", "tier", "_flag", "_positive", "_quality"]
    inputs += ["config_id"] if many else []
    names = list(components)
    inputs += [f"p_{c}" for c in names]
    only = configs.get(None)

    def step(st, row):
        event_us, enc, score, tier, flag, positive, quality, *rest = row
        g = configs[rest.pop(0)] if many else only
        points = {c: p for c, p in zip(names, rest) if p is not None}
        return st, govern_one(st, g, event_us, enc, score, tier, flag, positive, points, quality)

    return ordered_fold(ready, keys, order, inputs, step, governance_start, DECISION, keep=keep, hot=hot, spread=spread)


def streaks(alerts: DataFrame, g: Governance, keys: Sequence[str] = ("patient_id",),
            order: Sequence[str] = ("event_us", "idempotency_key"), hot: bool = False) -> DataFrame:
    """Crossing streaks: first time and score, count of distinct times.

    Rows carry ``scope`` and hold no context-suppressed rows. ``hot`` folds instead of using windows, for
    keys of any size.
    """
    if hot:
        gap_us = g.resolution_gap_minutes * MINUTE_US

        def step(s, row):
            scope, at, score, tier = row
            if score is None or tier == "none":
                return (scope, 0, None, None, None), None
            if s[0] != scope or s[1] == 0 or at - s[4] > gap_us:
                s = (scope, 1, at, score, at)
            else:
                s = (scope, s[1] + (at != s[4]), s[2], s[3], at)
            return s, (s[1], s[2], s[3])

        out = T.StructType([T.StructField("crossings", T.IntegerType()), T.StructField("first_us", T.LongType()),
                            T.StructField("first_score", T.IntegerType())])
        return ordered_fold(alerts, keys, order, ["scope", "event_us", "score", "tier"], step, lambda: (None, 0, None, None, None),
                            out, keep=alerts.columns, hot=True)
    w = Window.partitionBy(*keys, "scope").orderBy(*order)
    below = (F.col("tier") == "none") | F.col("score").isNull()
    segmented = alerts.withColumn(
        "_seg", F.sum(below.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(~below)
    ws = Window.partitionBy(*keys, "scope", "_seg").orderBy(*order)
    before = F.lag("event_us").over(ws)
    gap = F.coalesce(F.col("event_us") - before > g.resolution_gap_minutes * MINUTE_US, F.lit(True))
    marked = segmented.withColumn("_new", gap.cast("int")).withColumn(
        "_moved", F.coalesce(F.col("event_us") != before, F.lit(True)).cast("int")).withColumn(
        "streak", F.sum("_new").over(ws.rowsBetween(Window.unboundedPreceding, 0)))
    wk = Window.partitionBy(*keys, "scope", "_seg", "streak").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    return marked.withColumns({
        "crossings": F.sum(F.when(F.col("_new") == 1, 1).otherwise(F.col("_moved"))).over(wk).cast("int"),
        "first_us": F.first("event_us").over(wk), "first_score": F.first("score").over(wk),
    }).drop("_new", "_moved")


def component_deltas(current: Column, prior: Column) -> Column:
    """Change per component against a prior vector (absent counts as 0); only current components."""
    return F.map_filter(
        F.map_zip_with(current, F.coalesce(prior, F.create_map().cast("map<string,int>")),
                       lambda k, a, b: F.when(a.isNotNull(), a - F.coalesce(b, F.lit(0)))),
        lambda k, d: d.isNotNull())


def newly_worsened(deltas: Column) -> Column:
    return F.array_sort(F.map_keys(F.map_filter(deltas, lambda k, d: d > 0)))


def reduction_ratio(naive: Column, governed: Column) -> Column:
    return F.when(naive == 0, 0.0).otherwise(governed / naive)
