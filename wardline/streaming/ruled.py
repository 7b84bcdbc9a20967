"""Governance on a stream whose rules change while it runs.

Alerts and rule updates are one keyed stream. Its key is a group of patients, one of a fixed number; every rule update is handed to every group, and every group
keeps the updates it was handed next to the states of its patients and bundles. So an update is state like any other: it is replayed from the checkpoint, and after a restart the
same alerts meet the same rules. An update holds from the moment it names, whichever micro-batch brings it; alerts that were decided before it
came stay as they were decided.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardline.operators.governance import governance_start
from wardline.operators.latest import LATENESS_US
from wardline.operators.rule_history import RuleBook, decide, group_of

GROUPS = 64
"""Patient groups. Fixed for the life of a checkpoint; as many tasks as that can govern at once."""
GRACE_US = 12 * 3_600_000_000
"""States of a withdrawn bundle are removed once the group's newest alert is this much later."""

_BYTES = T.StructType([T.StructField("v", T.BinaryType())])
_LONG = T.StructType([T.StructField("v", T.LongType())])
_OWNER = T.StructType([T.StructField("bundle", T.StringType()), T.StructField("patient", T.StringType())])
ALERT_COLUMNS = ("patient_id", "encounter_id", "event_us", "idempotency_key", "alert_id", "indicator", "rule_bundle_id", "score", "tier", "positive_components")
RULE_COLUMNS = ("bundle_id", "version", "from_us", "withdrawn", "naive_threshold", "knobs")
RULED_OUT = T.StructType([T.StructField(n, t) for n, t in (
    ("patient_id", T.StringType()), ("encounter_id", T.StringType()), ("event_us", T.LongType()), ("idempotency_key", T.StringType()), ("alert_id", T.StringType()),
    ("indicator", T.StringType()), ("rule_bundle_id", T.StringType()), ("rule_version", T.StringType()), ("score", T.IntegerType()), ("tier", T.StringType()),
    ("emit", T.BooleanType()), ("reason", T.StringType()), ("routing", T.StringType()), ("page_deferred_reason", T.StringType()), ("crossings", T.IntegerType()))])


class RuledGovernance(StatefulProcessor):
    """One group's updates, and a governance state for each of its patients and bundles."""

    def __init__(self, columns: list[str], components: tuple[str, ...], grace_us: int = GRACE_US) -> None:
        self.columns, self.components, self.grace_us = columns, components, grace_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.updates = handle.getValueState("updates", _BYTES)
        self.swept = handle.getValueState("swept", _BYTES)
        self.newest = handle.getValueState("newest", _LONG)
        self.states = handle.getMapState("states", _OWNER, _BYTES)

    def close(self) -> None:
        pass

    @staticmethod
    def _held(state, empty: Any) -> Any:
        return pickle.loads(bytes(state.get()[0])) if state.exists() else empty

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known, alerts, fresh = self._held(self.updates, set()), [], set()
        for r in rows:
            row = dict(zip(self.columns, r))
            if row["bundle_id"] is not None:
                fresh.add(tuple(row[c] for c in RULE_COLUMNS))
            else:
                alerts.append(row)
        if fresh - known:
            known |= fresh
            self.updates.update((pickle.dumps(known),))
        book = RuleBook(known)
        alerts.sort(key=lambda r: (r["rule_bundle_id"], r["patient_id"], r["event_us"], r["idempotency_key"] or ""))
        owner, state = None, None
        for r in alerts:
            version, threshold, settings, ended = book.at(r["rule_bundle_id"], r["event_us"])
            if owner != (r["rule_bundle_id"], r["patient_id"]):
                self._store(owner, state)
                owner = (r["rule_bundle_id"], r["patient_id"])
                state = pickle.loads(bytes(self.states.getValue(owner)[0])) if self.states.containsKey(owner) else (ended, governance_start())
            if state[0] != ended:
                state = (ended, governance_start())
            points = {c: r[f"p_{c}"] for c in self.components if r[f"p_{c}"] is not None}
            emit, reason, routing, deferred, n, *_, tier = decide(
                state[1], settings, version, threshold, r["event_us"], r["encounter_id"], r["score"], r["tier"], r["context_flags"], r["positive_components"], points)
            yield Row(*RULED_OUT.fieldNames())(
                r["patient_id"], r["encounter_id"], r["event_us"], r["idempotency_key"], r["alert_id"], r["indicator"], r["rule_bundle_id"], version, r["score"], tier, emit, reason,
                routing, deferred, n)
        self._store(owner, state)
        if alerts:
            self._sweep(book, max(r["event_us"] for r in alerts))

    def _store(self, owner: tuple | None, state: Any) -> None:
        if owner is not None:
            self.states.updateValue(owner, (pickle.dumps(state),))

    def _sweep(self, book: RuleBook, latest: int) -> None:
        """Remove what a withdrawal ended, once a withdrawal."""
        newest = max(latest, self.newest.get()[0] if self.newest.exists() else latest)
        self.newest.update((newest,))
        done = self._held(self.swept, set())
        due = {(b, at) for b, at in book.withdrawals() if at + LATENESS_US + self.grace_us <= newest} - done
        if not due:
            return
        bundles = {b for b, _ in due}
        for (bundle, patient), value in [(tuple(k), v) for k, v in self.states.iterator()]:
            if bundle in bundles and pickle.loads(bytes(value[0]))[0] < book.at(bundle, newest)[3]:
                self.states.removeKey((bundle, patient))
        self.swept.update((pickle.dumps(done | due),))


def governed_by_rules(alerts: DataFrame, updates: DataFrame, components: tuple[str, ...], groups: int = GROUPS, grace_us: int = GRACE_US) -> DataFrame:
    """Decisions on a stream of ``alerts`` (ALERT_COLUMNS, context_flags and p_ columns) under a stream of rule ``updates``."""
    points = [f"p_{c}" for c in components]
    rows = alerts.select(group_of(F.col("patient_id"), groups).alias("grp"), *ALERT_COLUMNS, "context_flags", *points)
    rules = updates.where("reason IS NULL").select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), *RULE_COLUMNS)
    both = rows.unionByName(rules, allowMissingColumns=True)
    return both.groupBy("grp").transformWithState(
        statefulProcessor=RuledGovernance(both.columns, components, grace_us), outputStructType=RULED_OUT, outputMode="Append", timeMode="None")
