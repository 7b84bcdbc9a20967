"""Keyed stream operators. They run the same step functions as the batch folds."""

from __future__ import annotations

import json
import pickle
import zlib
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardline.operators import timeline
from wardline.operators.episodes import EpisodeRules, episode_one, episode_start
from wardline.operators.governance import govern_one, governance_start
from wardline.operators.latest import DAY_US, LATENESS_US, SNAPSHOT_FIELDS, snapshot_start, snapshot_step
from wardline.rules import Governance

_BYTES = T.StructType([T.StructField("v", T.BinaryType())])
_KEY = T.StructType([T.StructField("k", T.StringType())])
_BUCKET = T.StructType([T.StructField("bucket", T.LongType())])
_AT = T.StructType([T.StructField("at", T.LongType())])
_PIECE = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("piece", T.LongType())])

PENDING_US = 10_000_000
"""Event time of one bucket of waiting records; what waits spans at most the lateness, so some thirty buckets."""
SEEN_US = 3_600_000_000
"""Arrival time of one bucket of delivery keys (some twenty-five are kept); keys in buckets by hash are kept for so much longer than their time to live."""
SEEN_KEYS = 128
"""Delivery keys of one bucket, on average."""

FLUSH_PREFIX = "flush-"
"""Delivery keys with this prefix mark the end of input: they only move the patient's clock."""


PACKED = T.StructType([T.StructField("packed", T.StringType())])


class Packed(StatefulProcessor):
    """A processor whose rows come and go as JSON in the last column.

    PySpark takes every value of every input row out of Arrow by itself and makes a record batch per key of the
    outputs, which costs more than the work on a row; so there is one value a row. ``doubles`` names the columns where a quoted word is a number.
    """

    def __init__(self, inner: StatefulProcessor, doubles: list[str], output: T.StructType) -> None:
        self.inner, self.doubles, self.names = inner, doubles, output.fieldNames()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.inner.init(handle)

    def close(self) -> None:
        self.inner.close()

    def _unpack(self, text: str) -> tuple:
        row = json.loads(text)
        if 'NaN"' in text or 'Infinity"' in text:
            row |= {c: float(row[c]) for c in self.doubles if isinstance(row[c], str)}
        return tuple(row[c] for c in self.inner.columns)

    def _pack(self, rows: Iterator[Row]) -> Iterator[Row]:
        made = Row("packed")
        for r in rows:
            yield made(json.dumps({n: v for n, v in zip(self.names, r) if v is not None}))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        return self._pack(self.inner.handleInputRows(key, (self._unpack(r[-1]) for r in rows), timerValues))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        return self._pack(self.inner.handleExpiredTimer(key, timerValues, expiredTimerInfo))


class _Pickled:
    """One picklable object in a value state."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, start: Callable[[], Any]) -> None:
        self._state, self._start = handle.getValueState(name, _BYTES), start

    def get(self, known: bool | None = None) -> Any:
        """``known`` says whether a value was set, where the caller keeps that."""
        there = self._state.exists() if known is None else known
        return pickle.loads(bytes(self._state.get()[0])) if there else self._start()

    def set(self, value: Any) -> None:
        self._state.update((pickle.dumps(value),))


class _Buckets:
    """Items of one key by time, as pieces in a map state; how many pieces each bucket has is kept by the caller (``counts``).

    A batch writes one piece per bucket it adds to and reads the buckets it takes; the others stay untouched,
    whatever they hold.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str, width_us: int) -> None:
        self._pieces = handle.getMapState(f"{name}_pieces", _PIECE, _BYTES)
        self.width = width_us

    def add(self, counts: dict[int, int], items: list[tuple[int, Any]]) -> None:
        """Keep (time, item) pairs."""
        parts: dict[int, list[tuple[int, Any]]] = {}
        for at, item in items:
            parts.setdefault(at // self.width, []).append((at, item))
        for bucket, part in parts.items():
            n = counts.get(bucket, 0)
            self._pieces.updateValue((bucket, n), (pickle.dumps(part),))
            counts[bucket] = n + 1

    def take(self, counts: dict[int, int], until: int, whole: bool = False) -> list[Any]:
        """Remove and return the items at or before ``until``; with ``whole``, only buckets that end there."""
        out = []
        for bucket in [b for b in counts if ((b + 1) * self.width - 1 if whole else b * self.width) <= until]:
            later = []
            for n in range(counts.pop(bucket)):
                for at, item in pickle.loads(bytes(self._pieces.getValue((bucket, n))[0])):
                    if at <= until:
                        out.append(item)
                    else:
                        later.append((at, item))
                self._pieces.removeKey((bucket, n))
            if later:
                self._pieces.updateValue((bucket, 0), (pickle.dumps(later),))
                counts[bucket] = 1
        return out


class KeyEntries:
    """Delivery keys of one patient, an entry each, looked up one by one and forgotten by whole buckets of arrival time.

    For triggers that bring a record or two of a patient: nothing but their keys is read.
    """

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", _KEY, _AT)
        self.arrivals = _Buckets(handle, "arrivals", SEEN_US)

    @staticmethod
    def start() -> dict[int, int]:
        return {}

    def _known(self, key: str, now: int) -> bool:
        return self.seen.containsKey((key,)) and now - self.seen.getValue((key,))[0] < DAY_US

    def accept(self, counts: dict[int, int], arrivals: list[tuple[str, int]]) -> list[bool]:
        """For each (key, time) in order of arrival whether the key was not accepted within its time to live."""
        fresh = []
        for key, now in arrivals:
            fresh.append(not self._known(key, now))
            if fresh[-1]:
                self.seen.updateValue((key,), (now,))
        self.arrivals.add(counts, [(now, key) for (key, now), ok in zip(arrivals, fresh) if ok])
        last = max((now for _, now in arrivals), default=0)
        for key in self.arrivals.take(counts, last - DAY_US, whole=True):  # a key that came again since is kept
            if self.seen.containsKey((key,)) and not self._known(key, last):
                self.seen.removeKey((key,))
        return fresh


class KeyBuckets:
    """Delivery keys of one patient and when each was accepted, in buckets by hash (linear hashing).

    For triggers that bring many records of a patient: one read and one write per bucket, not several per key. A bucket is split or merged at a time as keys come and go, so a bucket stays small, a batch touches no more
    buckets than it brings keys, and a short history is one value. Old keys go when their bucket is touched; every batch
    also visits the next bucket in turn, so all are. ``size`` is the caller's: buckets, keys, next in turn.
    """

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getMapState("keys", _BUCKET, _BYTES)

    @staticmethod
    def start() -> list[int]:
        return [0, 0, 0]

    def _get(self, bucket: int) -> dict[str, int]:
        return pickle.loads(bytes(self._state.getValue((bucket,))[0]))

    def _set(self, bucket: int, held: dict[str, int]) -> None:
        self._state.updateValue((bucket,), (pickle.dumps(held),))

    @staticmethod
    def _place(key: str, buckets: int) -> int:
        h, level = zlib.crc32(key.encode()), 1 << (buckets.bit_length() - 1)
        at = h & (2 * level - 1)
        return at if at < buckets else h & (level - 1)

    def _grow(self, size: list[int], wanted: int) -> None:
        for new in range(size[0], wanted):
            size[0] = new + 1
            if new == 0:
                self._set(0, {})
                continue
            old = new - (1 << (new.bit_length() - 1))
            held = self._get(old) if size[1] else {}
            moved = {k: at for k, at in held.items() if self._place(k, new + 1) == new}
            if moved or not held:
                self._set(old, {k: at for k, at in held.items() if k not in moved})
            self._set(new, moved)

    def _shrink(self, size: list[int], most: int) -> None:
        while size[0] > 1 and size[1] < size[0] * SEEN_KEYS // 4 and most > 0:
            size[0], most = size[0] - 1, most - 1
            last = size[0]
            self._set(last - (1 << (last.bit_length() - 1)), self._get(last - (1 << (last.bit_length() - 1))) | self._get(last))
            self._state.removeKey((last,))
        size[2] %= max(size[0], 1)

    def accept(self, size: list[int], arrivals: list[tuple[str, int]]) -> list[bool]:
        if not arrivals:
            return []
        self._grow(size, -(-(size[1] + len(arrivals)) // SEEN_KEYS))
        parts: dict[int, list[int]] = {}
        for i, (key, _) in enumerate(arrivals):
            parts.setdefault(self._place(key, size[0]), []).append(i)
        old = max(at for _, at in arrivals) - DAY_US - SEEN_US
        fresh = [False] * len(arrivals)
        for bucket in dict.fromkeys([*parts, size[2]]):
            held = self._get(bucket)
            before, changed = len(held), False
            for i in parts.get(bucket, ()):
                key, now = arrivals[i]
                if key not in held or now - held[key] >= DAY_US:
                    held[key], fresh[i], changed = now, True, True
            kept = {k: at for k, at in held.items() if at > old}
            size[1] += len(kept) - before
            if changed or len(kept) < before:
                self._set(bucket, kept)
        size[2] += 1
        self._shrink(size, len(arrivals))
        return fresh


class RecordProcessor(StatefulProcessor):
    """Arrival rules of one patient: duplicate removal, lateness, event-time reordering, then a step.

    ``apply(state, row) -> (state, output tuple or None)`` gets rows in event order. Late rows come out
    with reason ``late_beyond_lateness``; rows with a reason of their own come out with it and never
    reach the step.

    A batch touches what it brings and what is due. Waiting records lie in buckets of event time, delivery keys
    as ``keys`` says, and a batch sets one timer. Every call to the state store is a round trip to the JVM, so what is small and always
    needed (clock, what waits where, number of keys) is one value, ``head``.
    """

    def __init__(self, columns: list[str], output: T.StructType, keys: type[KeyEntries] | type[KeyBuckets] = KeyEntries) -> None:
        self.key_layout = keys
        self.columns, self.row = columns, Row(*output.fieldNames())

    def start(self) -> Any:
        raise NotImplementedError

    def apply(self, state: Any, row: dict) -> tuple[Any, tuple | None]:
        raise NotImplementedError

    def refused(self, state: Any, row: dict) -> Any:
        """State after a row that was refused; most leave it alone."""
        return state

    def packed(self, state: Any) -> Any:
        """The state as plain values, for the state store."""
        return state

    def unpacked(self, held: Any) -> Any:
        return held

    def blank(self) -> tuple:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = _Pickled(handle, "head", lambda: {"newest": None, "flushed": 0, "waiting": {}, "keys": self.key_layout.start(), "stepped": False})
        self.keys = self.key_layout(handle)
        self.pending = _Buckets(handle, "pending", PENDING_US)
        self.waits = handle.getMapState("waits", _AT, _AT)
        self.state = _Pickled(handle, "state", lambda: self.packed(self.start()))

    def close(self) -> None:
        pass

    def _unique(self, head: dict, arrived: list[dict]) -> list[dict]:
        """Rows in order of arrival without deliveries told before; blank keys are never duplicates."""
        named = [i for i, r in enumerate(arrived) if (r["idempotency_key"] or "").strip()]
        fresh = self.keys.accept(head["keys"], [(arrived[i]["idempotency_key"], arrived[i]["ingest_us"]) for i in named])
        copies = {i for i, ok in zip(named, fresh) if not ok}
        return [r for i, r in enumerate(arrived) if i not in copies]

    def _out(self, row: dict, reason: str | None, values: tuple | None) -> Row:
        head = (row["patient_id"], row["encounter_id"], row["event_us"], row["ingest_us"], row["idempotency_key"],
                row["component"], row["context_flag"], reason)
        return self.row(*head, *(values if values is not None else self.blank()))

    def _flush(self, head: dict, extra: list[dict]) -> Iterator[Row]:
        ready = extra + self.pending.take(head["waiting"], head["flushed"])
        if not ready:
            return
        ready.sort(key=lambda r: (r["event_us"], r["idempotency_key"] or ""))
        state = self.unpacked(self.state.get(head["stepped"]))
        for row in ready:
            if (row["idempotency_key"] or "").startswith(FLUSH_PREFIX):
                continue
            if row["reason"] is not None:
                state = self.refused(state, row)
                yield self._out(row, row["reason"], None)
                continue
            state, values = self.apply(state, row)
            if values is not None:
                yield self._out(row, None, values)
        self.state.set(self.packed(state))
        head["stepped"] = True

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        head = self.head.get()
        newest, flushed = head["newest"], head["flushed"]
        arrived = sorted((dict(zip(self.columns, r)) for r in rows), key=lambda r: (r["ingest_us"], r["event_us"], r["idempotency_key"] or ""))
        waiting: list[dict] = []
        for row in self._unique(head, arrived):
            at = row["event_us"]
            if newest is None or at > newest:
                newest = at
                flushed = max(flushed, at - LATENESS_US)
            if at < flushed:
                yield self._out(row, "late_beyond_lateness", None)
            else:
                waiting.append(row)
        ready = [r for r in waiting if r["event_us"] <= flushed]
        held = [r for r in waiting if r["event_us"] > flushed]
        head["newest"], head["flushed"] = newest, flushed
        yield from self._flush(head, ready)
        if held:
            self.pending.add(head["waiting"], [(r["event_us"], r) for r in held])
            # A lone last event still comes out once the reading clock has passed its lateness.
            timer = (max(r["read_us"] for r in held) + LATENESS_US) // 1000
            until = max(r["event_us"] for r in held)
            if self.waits.containsKey((timer,)):
                until = max(until, self.waits.getValue((timer,))[0])
            self.waits.updateValue((timer,), (until,))
            self.handle.registerTimer(timer)
        self.head.set(head)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        timer = expiredTimerInfo.getExpiryTimeInMs()
        if not self.waits.containsKey((timer,)):
            return
        head = self.head.get()
        head["flushed"] = max(head["flushed"], self.waits.getValue((timer,))[0])
        self.waits.removeKey((timer,))
        yield from self._flush(head, [])
        self.head.set(head)


HEAD = [T.StructField(n, t) for n, t in (
    ("patient_id", T.StringType()), ("encounter_id", T.StringType()), ("event_us", T.LongType()), ("ingest_us", T.LongType()),
    ("idempotency_key", T.StringType()), ("component", T.StringType()), ("context_flag", T.StringType()), ("reason", T.StringType()))]
SNAPSHOT_OUT = T.StructType(HEAD + [T.StructField("encounter_now", T.StringType()), T.StructField("scope", T.LongType())]
                            + [T.StructField(n, t) for n, t in SNAPSHOT_FIELDS.items()])
KIDNEY_OUT = T.StructType(HEAD + [T.StructField("encounter_now", T.StringType())] + list(timeline.RESULT.fields))


class SnapshotProcessor(RecordProcessor):
    """Latest inputs per patient after every usable record."""

    def start(self):
        return snapshot_start(len(SNAPSHOT_FIELDS))()

    def blank(self):
        return (None, None) + (None,) * len(SNAPSHOT_FIELDS)

    def apply(self, state, row):
        if row["component"] is None:
            return state, None
        step = snapshot_step(len(SNAPSHOT_FIELDS))
        return step(state, (row["encounter_id"], row["component"], row["event_us"], row["ingest_us"],
                            *[row[f] for f in SNAPSHOT_FIELDS]))


class KidneyProcessor(RecordProcessor):
    """Kidney stage after every creatinine or urine record; a new encounter starts a new history."""

    def start(self):
        return (None, timeline.History())

    def packed(self, state):
        return state[0], state[1].facts()

    def unpacked(self, held):
        return held[0], timeline.History(held[1])

    def blank(self):
        return (None,) * (1 + len(timeline.RESULT.fields))

    def refused(self, state, row):
        # Any coded observation of usable status moves the encounter, even when its value is refused.
        now, s = state
        encounter = (row["encounter_id"] or "").strip() or None
        if row["component"] is None or encounter is None:
            return state
        return encounter, (timeline.History() if now is not None and encounter != now else s)

    def apply(self, state, row):
        now, s = self.refused(state, row)
        if row["kind"] is None:
            return (now, s), None
        s.add(row["kind"], row["event_us"], row["evidence_id"], row["creatinine"], row["volume_ml"], row["duration_h"], row["ml_kg_h"], row["anuria"], row["weight_kg"],
              row["kind"] == "esrd", row["kind"] == "rrt")
        return (now, s), (now, *s.result(row["event_us"])) if row["kind"] in ("creatinine", "urine") else None


GOVERNED_OUT = T.StructType([T.StructField(n, t) for n, t in (
    ("patient_id", T.StringType()), ("encounter_id", T.StringType()), ("event_us", T.LongType()), ("idempotency_key", T.StringType()),
    ("alert_id", T.StringType()), ("indicator", T.StringType()), ("score", T.IntegerType()), ("tier", T.StringType()),
    ("emit", T.BooleanType()), ("reason", T.StringType()), ("routing", T.StringType()), ("page_deferred_reason", T.StringType()),
    ("crossings", T.IntegerType()))])


class GovernanceProcessor(StatefulProcessor):
    """Governance of one patient's alerts as they come."""

    def __init__(self, columns: list[str], rules: Governance, components: tuple[str, ...]) -> None:
        self.columns, self.rules, self.components = columns, rules, components

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = _Pickled(handle, "governance", governance_start)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        st = self.state.get()
        for r in sorted((dict(zip(self.columns, r)) for r in rows), key=lambda r: (r["event_us"], r["idempotency_key"])):
            points = {c: r[f"p_{c}"] for c in self.components if r[f"p_{c}"] is not None}
            flag = r["context_flag"] if r["context_flag"] in self.rules.suppression_flags else None
            emit, reason, routing, deferred, n, *_ = govern_one(
                st, self.rules, r["event_us"], r["encounter_id"], r["score"], r["tier"], flag, r["positive_components"], points, None)
            yield Row(*GOVERNED_OUT.fieldNames())(
                r["patient_id"], r["encounter_id"], r["event_us"], r["idempotency_key"], r["alert_id"], r["indicator"], r["score"], r["tier"], emit, reason, routing, deferred, n)
        self.state.set(st)


EPISODE_OUT = T.StructType([T.StructField(n, t) for n, t in (
    ("patient_id", T.StringType()), ("encounter_key", T.StringType()), ("signal_id", T.StringType()), ("event_us", T.LongType()),
    ("step_no", T.LongType()), ("episode_no", T.IntegerType()), ("action", T.StringType()), ("reason", T.StringType()),
    ("status", T.StringType()), ("page_count", T.IntegerType()))])


class EpisodeProcessor(StatefulProcessor):
    """Episodes of one encounter in arrival order."""

    def __init__(self, columns: list[str], rules: EpisodeRules = EpisodeRules()) -> None:
        self.columns, self.rules = columns, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = _Pickled(handle, "episode", episode_start)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        s = self.state.get()
        for r in sorted((dict(zip(self.columns, r)) for r in rows), key=lambda r: (r["event_us"], r["signal_id"])):
            out = episode_one(s, self.rules, False, r["event"], r["signal_id"], r["signal_type"], r["severity"], r["routing"],
                              r["suppressed"], r["event_us"])
            if out is not None:
                yield Row(*EPISODE_OUT.fieldNames())(
                    r["patient_id"], r["encounter_key"], r["signal_id"], r["event_us"], out[0], out[1], out[2], out[3], out[5], out[9])
        self.state.set(s)
