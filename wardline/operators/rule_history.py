"""Rules as data: updates of rule bundles, which of them count, and governance under the rules that hold at each alert's time.

An update names a bundle and version, the moment from which it holds, and its governance knobs as a JSON object; it may withdraw the bundle
instead. Of a bundle's updates, in the order in which they come to hold, one counts unless its version is below one that counted before, so nothing rolls
back silently. An alert is governed by the update of its bundle that holds at its event time, and by the default settings where there is none or the
bundle is withdrawn. State belongs to a patient and bundle; it outlives a change of settings and ends when the bundle is withdrawn.

``RuleBook`` (one process) and ``holding`` (tables) say the same; the stream uses the first, batch jobs the second.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterable, Sequence
from dataclasses import fields
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.times import iso_time
from wardline.ids import semver, semver_key
from wardline.operators.folds import ordered_fold
from wardline.operators.governance import DECISION, govern_one, governance_start
from wardline.rules import Governance
from wardline.sources.records import parse_json

DEFAULT_THRESHOLD = 2
UPDATE = T.StructType([T.StructField(n, t) for n, t in (
    ("bundle_id", T.StringType()), ("version", T.StringType()), ("available_time", T.StringType()), ("withdrawn", T.BooleanType()),
    ("naive_threshold", T.IntegerType()), ("governance", T.StringType()))])
_KNOBS = {f.name for f in fields(Governance)}
#: What a decision carries besides: the bundle's version in force, null for default settings, and the tier after the bundle's threshold.
RULED = T.StructType([*DECISION.fields, T.StructField("rule_version", T.StringType()), T.StructField("ruled_tier", T.StringType())])


def rule_updates(values: DataFrame, column: str = "value") -> DataFrame:
    """Updates from JSON text: bundle_id, version, from_us, withdrawn, naive_threshold, knobs and ``reason``, null for updates that can be used.

    Refused are texts that are no JSON, updates without a bundle or a readable moment, versions that are not three numbers, and knobs that do not exist.
    """
    rows = parse_json(values, UPDATE, column)
    knobs = F.from_json("governance", "map<string,string>")
    unknown = F.size(F.array_except(F.map_keys(knobs), F.array(*[F.lit(k) for k in sorted(_KNOBS)])))
    from_us = F.unix_micros(iso_time(F.col("available_time")))
    reason = (
        F.when(F.col("_malformed").isNotNull() | F.col(column).isNull(), "malformed_json").when(F.trim(F.coalesce("bundle_id", F.lit(""))) == "", "no_bundle")
        .when(from_us.isNull(), "invalid_timestamp").when(~F.coalesce(F.regexp_like(F.trim("version"), F.lit(r"^\d{1,9}\.\d{1,9}\.\d{1,9}([-+].*)?$")), F.lit(False)), "invalid_version")
        .when(F.col("governance").isNotNull() & (knobs.isNull() | (unknown > 0)), "unknown_knobs"))
    return rows.select("bundle_id", "version", from_us.alias("from_us"), F.coalesce("withdrawn", F.lit(False)).alias("withdrawn"),
                       F.coalesce("naive_threshold", F.lit(DEFAULT_THRESHOLD)).alias("naive_threshold"), F.coalesce("governance", F.lit("{}")).alias("knobs"), reason.alias("reason"))


@lru_cache(maxsize=4096)
def governance_of(knobs: str | None) -> Governance:
    """Settings from a JSON object of knobs; what it leaves out, and no object, are the defaults."""
    given = json.loads(knobs) if knobs else {}
    return Governance().patched(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


class RuleBook:
    """Which update of a bundle holds at a time. ``updates``: (bundle, version, from_us, withdrawn, threshold, knobs), in any order, repeats allowed."""

    def __init__(self, updates: Iterable[tuple]) -> None:
        self.moments: dict[str, list[int]] = {}
        self.held: dict[str, list[tuple]] = {}
        newest: dict[str, tuple] = {}
        ends: dict[str, int] = {}
        for bundle, version, at, withdrawn, threshold, knobs in sorted(set(updates), key=lambda u: (u[2], semver_key(u[1]), *u[3:], u[1])):
            key = semver_key(version)
            if bundle in newest and key < newest[bundle]:
                continue
            newest[bundle] = key
            ends[bundle] = ends.get(bundle, 0) + bool(withdrawn)
            self.moments.setdefault(bundle, []).append(at)
            self.held.setdefault(bundle, []).append((None if withdrawn else version, threshold, knobs, ends[bundle]))

    def at(self, bundle: str, time_us: int) -> tuple[str | None, int, Governance, int]:
        """(version, threshold, settings, how often the bundle has been withdrawn); version null where the defaults hold."""
        k = bisect_right(self.moments.get(bundle, []), time_us)
        version, threshold, knobs, ended = self.held[bundle][k - 1] if k else (None, DEFAULT_THRESHOLD, None, 0)
        return (version, threshold, governance_of(knobs), ended) if version is not None else (None, DEFAULT_THRESHOLD, governance_of(None), ended)

    def withdrawals(self) -> list[tuple[str, int]]:
        return [(b, at) for b, moments in self.moments.items() for at, held in zip(moments, self.held[b]) if held[0] is None]


def holding(updates: DataFrame) -> DataFrame:
    """The updates that count with the time span in which each holds: until_us null for the last; ``ended``: withdrawals of the bundle so far."""
    v = semver(F.col("version"))
    # one bundle's updates: as many as it has versions
    own = Window.partitionBy("bundle_id").orderBy("from_us", "v", "withdrawn", "naive_threshold", "knobs", "version")
    before = F.max("v").over(own.rowsBetween(Window.unboundedPreceding, -1))
    counted = updates.where("reason IS NULL").drop("reason").distinct().withColumn("v", v).withColumn("highest", before).where("highest IS NULL OR v >= highest")
    # of several from one moment the last holds
    counted = counted.withColumn("until_us", F.lead("from_us").over(own)).withColumn("ended", F.sum(F.col("withdrawn").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return counted.where("until_us IS NULL OR until_us > from_us").drop("v", "highest")


def with_rules(alerts: DataFrame, updates: DataFrame) -> DataFrame:
    """``alerts`` (rule_bundle_id, event_us, ...) with what holds for each: rule_version, rule_threshold, rule_knobs (null for the defaults) and rule_ended."""
    held = holding(updates).select(
        F.col("bundle_id").alias("_b"), F.col("from_us").alias("_from"), F.col("until_us").alias("_until"), F.when(~F.col("withdrawn"), F.col("version")).alias("rule_version"),
        F.when(~F.col("withdrawn"), F.col("naive_threshold")).alias("rule_threshold"), F.when(~F.col("withdrawn"), F.col("knobs")).alias("rule_knobs"), F.col("ended").alias("rule_ended"))
    met = (F.col("rule_bundle_id") == F.col("_b")) & (F.col("event_us") >= F.col("_from")) & (F.col("_until").isNull() | (F.col("event_us") < F.col("_until")))
    return alerts.drop("rule_version").join(held, met, "left").drop("_b", "_from", "_until").withColumns({
        "rule_threshold": F.coalesce("rule_threshold", F.lit(DEFAULT_THRESHOLD)), "rule_ended": F.coalesce("rule_ended", F.lit(0)).cast("int")})


def decide(state: list, g: Governance, version: str | None, threshold: int, event_us: int, encounter: str | None, score: int | None, tier: str, flags: Sequence[str] | None,
           positive: int | None, points: dict[str, int]) -> tuple:
    """One alert under the settings that hold for it; advances ``state``."""
    if score is None or score < threshold:
        tier = "none"
    flag = min((f for f in flags or () if f in g.suppression_flags), default=None)
    return (*govern_one(state, g, event_us, encounter, score, tier, flag, positive, points, None), version, tier)


def govern_by_rules(alerts: DataFrame, updates: DataFrame, components: Sequence[str] = (), keep: Sequence[str] | None = None, hot: bool | None = None,
                    order: Sequence[str] = ("event_us", "idempotency_key")) -> DataFrame:
    """Decisions for ``alerts`` under the rules that hold at each one's time."""
    names = list(components)
    rows = with_rules(alerts, updates)
    inputs = ["rule_version", "rule_threshold", "rule_knobs", "event_us", "encounter_id", "score", "tier", "context_flags", "positive_components", *[f"p_{c}" for c in names]]

    def step(state, row):
        version, threshold, knobs, event_us, encounter, score, tier, flags, positive, *points = row
        known = {c: p for c, p in zip(names, points) if p is not None}
        return state, decide(state, governance_of(knobs), version, threshold, event_us, encounter, score, tier, flags, positive, known)

    return ordered_fold(rows, ["patient_id", "rule_bundle_id", "rule_ended"], order, inputs, step, governance_start, RULED,
                        keep=[c for c in (keep or alerts.columns) if c not in ("rule_version",)], hot=hot)


def group_of(key: Column, groups: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")
