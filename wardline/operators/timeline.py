"""Kidney timeline: stage from the creatinine, urine and weight history at every observation.

One ``History`` per key takes the rows in order, in tables and on streams. Minima over two and seven days are monotone queues; what urine flowed in a trailing
window is what its segments hold less what they had given before the window began, kept as running sums of whole numbers, which do not drift. So a row costs
the same however long the history is. Only a rate that comes within ``NEAR`` of a limit is counted again from the window's segments, as fractions of the decimal
numbers they were given in: a rate of exactly 0.5 is not below 0.5. A history keeps seven days of creatinine and two of urine; queues and sums are rebuilt from them when a history is stored and read again, or
corrected. Every row of an instant is taken in before any row of it is judged.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Sequence
from fractions import Fraction
from heapq import heappop, heappush
from math import isfinite, nextafter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.scores import known, stage_score, stage_tier
from wardline.operators.folds import HOT_ROWS, largest_key, ordered_fold

HOUR_US = 3_600_000_000
IGNORED_STATUS = ("entered-in-error", "cancelled", "unknown")
WINDOWS_H = (6, 12, 24)
URINE_LIMITS = ((3, 24, 0.3), (2, 12, 0.5), (1, 6, 0.5))  # stage, hours, ml/kg/h below which it holds
NEAR = 1e-9
UNIT = 1 << 80  # parts of a ml in the running sums

RESULT = T.StructType([
    T.StructField("status", T.StringType()), T.StructField("stage", T.IntegerType()),
    T.StructField("creatinine_stage", T.IntegerType()), T.StructField("urine_stage", T.IntegerType()),
    T.StructField("current_creatinine", T.DoubleType()), T.StructField("baseline_7d", T.DoubleType()),
    T.StructField("reference_48h", T.DoubleType()), T.StructField("weight_now", T.DoubleType()),
    T.StructField("rate_6", T.DoubleType()), T.StructField("rate_12", T.DoubleType()),
    T.StructField("rate_24", T.DoubleType()), T.StructField("anuria_h", T.DoubleType()),
    T.StructField("criteria", T.ArrayType(T.StringType())), T.StructField("missing", T.ArrayType(T.StringType())),
])


def corrected(rows: DataFrame, keys: Sequence[str] = ("patient_id",)) -> DataFrame:
    """A later report of the same evidence replaces the earlier one; unusable reports are ignored."""
    usable = rows.where(
        ~((F.col("kind") == "creatinine") & F.lower(F.coalesce("status", F.lit("final"))).isin(*IGNORED_STATUS))
        & ~((F.col("kind") == "weight") & (F.col("weight_kg") <= 0)))
    return usable.groupBy(*keys, "kind", "evidence_id").agg(
        F.max_by(F.struct(*rows.columns), F.struct("ingest_us", "event_us")).alias("r")).select("r.*")


def _with_flags(rows: DataFrame) -> DataFrame:
    for name in ("esrd", "rrt"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(False))
    return rows


_INPUTS = ["kind", "event_us", "evidence_id", "creatinine", "volume_ml", "duration_h", "ml_kg_h", "anuria", "weight_kg", "esrd", "rrt"]


def evaluate(rows: DataFrame, keys: Sequence[str] = ("patient_id",), hot: bool | None = None) -> DataFrame:
    """Stage at every creatinine and urine observation, from the history up to its time."""
    rows = _with_flags(rows)
    if hot is None:
        hot = largest_key(rows, keys) > HOT_ROWS
    # the rows of an instant: few, whatever the key holds
    instant = Window.partitionBy(*keys, "event_us") if hot else Window.partitionBy(*keys).orderBy("event_us").rangeBetween(Window.currentRow, Window.currentRow)
    kept = [c for c in rows.columns if c not in RESULT.fieldNames()]
    together = rows.withColumn("_instant", F.collect_list(F.struct(*_INPUTS)).over(instant))

    def step(history, row):
        at, kind, members = row
        if history.seen != at:
            for m in members:
                history.add(*(m[c] for c in _INPUTS))
            history.seen, history.found = at, None
        if kind not in ("creatinine", "urine"):
            return history, None
        if history.found is None:
            history.found = history.result(at)
        return history, history.found

    return ordered_fold(together, list(keys), ["event_us", "evidence_id"], ["event_us", "kind", "_instant"], step, History, RESULT, keep=kept, hot=hot, pack=History.facts, unpack=History)


def with_score(evaluated: DataFrame) -> DataFrame:
    """Score, tier and completeness of evaluated rows."""
    return evaluated.withColumn("score", stage_score(F.col("stage"))).withColumns({
        "tier": stage_tier(F.col("score")),
        "completeness": F.when(F.col("status") != "scored", "insufficient_data")
        .when(F.size("missing") > 0, "partial").otherwise("complete"),
    })


def onset(evaluated: DataFrame, keys: Sequence[str] = ("patient_id",)) -> DataFrame:
    """First observation time with a stage, per key."""
    return evaluated.groupBy(*keys).agg(F.min(F.when(F.col("stage") >= 1, F.col("event_us"))).alias("onset_us"))


class _Low:
    """The least value of a trailing window: values that a later one undercuts are forgotten, so the first is the least."""

    def __init__(self, hours: int) -> None:
        self.width, self.queue = hours * HOUR_US, deque()

    def add(self, at: int, value: float) -> None:
        while self.queue and self.queue[-1][1] >= value:
            self.queue.pop()
        self.queue.append((at, value))

    def least(self, now: int) -> float | None:
        while self.queue and self.queue[0][0] < now - self.width:
            self.queue.popleft()
        return self.queue[0][1] if self.queue else None


class _Flow:
    """What flowed in a trailing window, of amounts that each flowed evenly over a span up to their end."""

    def __init__(self, hours: int) -> None:
        self.width, self.order, self.origin = hours * HOUR_US, 0, None
        self.live, self.ahead = deque(), []  # items by end; items that begin inside the window, by begin
        self.span = self.cut = self.cut_from = 0
        self.amount = self.slope = self.past = 0  # in parts of a ml

    def add(self, end: int, span: int, amount: float) -> None:
        if span <= 0:
            return
        self.origin = end if self.origin is None else self.origin
        self.order += 1
        above, below = amount.as_integer_ratio()
        parts = above * UNIT // below
        item = [end - span, self.order, end, span, parts, False]
        self.live.append(item)
        heappush(self.ahead, item)
        self.span += span
        self.amount += parts

    def within(self, now: int) -> tuple[int, float]:
        """(time covered, amount) of the window that ends now."""
        edge = now - self.width
        while self.live and self.live[0][2] <= edge:
            begin, _, end, span, amount, crossing = self.live.popleft()
            self.span -= span
            self.amount -= amount
            if crossing:
                self._cross(begin, amount // span, -1)
        while self.ahead and self.ahead[0][0] < edge:
            item = heappop(self.ahead)
            if item[2] > edge:
                item[5] = True
                self._cross(item[0], item[4] // item[3], 1)
        if not self.live:
            return 0, 0.0
        return self.span - (self.cut * edge - self.cut_from), (self.amount - (self.slope * (edge - self.origin) - self.past)) / UNIT

    def _cross(self, begin: int, density: int, sign: int) -> None:
        """An item begins, or ceases, to lie across the window's edge."""
        self.cut += sign
        self.cut_from += sign * begin
        self.slope += sign * density
        self.past += sign * density * (begin - self.origin)


class History:
    """A key's facts up to now, and the stage they give."""

    CREATININE_H, URINE_H = 168, 48

    def __init__(self, facts: str | None = None) -> None:
        held = json.loads(facts) if facts else {}
        self.samples = deque(tuple(x) for x in held.get("samples", ()))  # (time, evidence, value), seven days and the newest
        self.urine = deque(tuple(x) for x in held.get("urine", ()))  # (time, ml, hours, ml/kg/h, evidence, anuria), two days
        self.weight = tuple(held["weight"]) if held.get("weight") else None
        self.odd, self.esrd, self.rrt, self.seen = (held.get(k, d) for k, d in (("odd", False), ("esrd", False), ("rrt", False), ("seen", None)))
        self.found = None
        self._rebuild()

    def facts(self) -> str:
        """What the history holds, as text; equal histories have equal facts."""
        return json.dumps({"samples": list(self.samples), "urine": list(self.urine), "weight": self.weight, "odd": self.odd, "esrd": self.esrd, "rrt": self.rrt, "seen": self.seen})

    def _rebuild(self) -> None:
        self.two_days, self.before = _Low(48), _Low(self.CREATININE_H)
        self.evidence = set()
        own, self.samples = sorted(self.samples), deque()
        for at, eid, value in own:
            self._sample(at, eid, value)
        self.volumes, self.rates = {h: _Flow(h) for h in WINDOWS_H}, {h: _Flow(h) for h in WINDOWS_H}
        self.last = dict.fromkeys(("any", "volume", "rate", "half"), 0)  # when the last segment of a sort ended
        self.anuria_us, self.urine_evidence = 0, set()
        own, self.urine = sorted(self.urine, key=lambda u: u[0]), deque()
        for u in own:
            self._segment(*u)

    def add(self, kind: str, at: int, eid: str, creatinine=None, ml=None, hours=None, rate=None, anuria=None, weight=None, esrd=False, rrt=False) -> None:
        self.esrd, self.rrt = self.esrd or bool(esrd), self.rrt or bool(rrt)
        while len(self.samples) > 1 and self.samples[0][0] < at - self.CREATININE_H * HOUR_US:
            self.evidence.discard(self.samples.popleft()[1])
        while self.urine and self.urine[0][0] < at - self.URINE_H * HOUR_US:
            self._forget(self.urine.popleft())
        if kind == "creatinine" and creatinine is not None and creatinine > 0:
            if eid in self.evidence or self.samples and at < self.samples[-1][0]:  # a correction, or out of order
                self.samples = deque([*(x for x in self.samples if x[1] != eid), (at, eid, creatinine)])
                self._rebuild()
            else:
                self._sample(at, eid, creatinine)
        elif kind == "urine":
            ml, rate = (x if x is not None and isfinite(x) else None for x in (ml, rate))
            self.odd = self.odd or (not anuria and (rate is None) != (hours is None))
            segment = (at, ml, hours, rate, eid, bool(anuria))
            if eid in self.urine_evidence or self.urine and at < self.urine[-1][0]:
                self.urine = deque([*(u for u in self.urine if u[4] != eid), segment])
                self._rebuild()
            else:
                self._segment(*segment)
        elif kind == "weight" and weight is not None and weight > 0:
            self.weight = max(self.weight or (at, eid, weight), (at, eid, weight))

    def _sample(self, at: int, eid: str, value: float) -> None:
        self.two_days.add(at, value)
        self.evidence.add(eid)
        newest = self.samples[-1] if self.samples else None
        if newest is None or (at, eid) > newest[:2]:
            if newest:  # what was the newest counts for the baseline from now on
                self.before.add(newest[0], newest[2])
            self.samples.append((at, eid, value))
        else:
            self.before.add(at, value)
            self.samples.insert(len(self.samples) - 1, (at, eid, value))

    def _segment(self, at: int, ml, hours, rate, eid: str, anuria: bool) -> None:
        self.urine.append((at, ml, hours, rate, eid, anuria))
        self.urine_evidence.add(eid)
        span = round(hours * HOUR_US) if hours else 0
        self.anuria_us += span if anuria else 0
        for sort, given in (("any", True), ("volume", ml is not None), ("rate", rate is not None and bool(hours)), ("half", (rate is None) != (hours is None))):
            if given:
                self.last[sort] = at
        for h in WINDOWS_H:
            if ml is not None:
                self.volumes[h].add(at, span, ml)
            if rate is not None:
                self.rates[h].add(at, span, rate * span / HOUR_US)

    def _forget(self, segment: tuple) -> None:
        _, _, hours, _, eid, anuria = segment
        self.urine_evidence.discard(eid)
        self.anuria_us -= round(hours * HOUR_US) if anuria and hours else 0

    def _urine_rate(self, now: int, hours: int, lacking: set[str]) -> float | None:
        """Mean ml/kg/h over a window that is covered; what stands in the way goes to ``lacking``."""
        edge = now - hours * HOUR_US
        volume, per_kg = self.volumes[hours].within(now), self.rates[hours].within(now)
        by_volume = self.last["volume"] > edge
        if by_volume:
            covered, amount = volume
            if self.weight is None:
                lacking.add("weight_kg")
                return None
            amount /= self.weight[2]
        else:
            covered, amount = per_kg
            if self.last["rate"] <= edge and self.last["half"] > edge:
                lacking.add("urine_output")
        # a window counts as covered with a few microseconds missing
        if not covered or covered + 4 < hours * HOUR_US:
            return None
        rate = amount * HOUR_US / covered
        limit = next(limit for _, h, limit in URINE_LIMITS if h == hours)
        return rate if abs(rate - limit) > NEAR else self._exact_rate(edge, by_volume, limit)

    def _exact_rate(self, edge: int, by_volume: bool, limit: float) -> float:
        """Mean ml/kg/h since ``edge`` from the segments themselves; below ``limit`` only if the exact rate is."""
        amount, covered = Fraction(0), 0
        for at, ml, hours, per_kg, _, _ in reversed(self.urine):
            if at <= edge:
                break
            span = round(hours * HOUR_US) if hours else 0
            if span <= 0 or (ml if by_volume else per_kg) is None:
                continue
            inside = min(span, at - edge)
            covered += inside
            amount += Fraction(str(ml)) * inside / span if by_volume else Fraction(str(per_kg)) * inside / HOUR_US
        exact = amount * HOUR_US / (covered * (Fraction(str(self.weight[2])) if by_volume else 1))
        rate, bound = float(exact), Fraction(str(limit))
        return nextafter(limit, 0) if exact < bound and rate >= limit else max(rate, limit) if exact >= bound else rate

    def _urine_stage(self, now: int, rates: dict[int, float | None]) -> tuple[int | None, str | None]:
        if self.anuria_us >= 12 * HOUR_US:
            return 3, "anuria_ge_12h"
        for stage, hours, limit in URINE_LIMITS:
            if rates[hours] is not None and rates[hours] < limit:
                return stage, f"uo_lt_{str(limit).replace('.', '_')}_for_{hours}h"
        return (0, None) if any(r is not None for r in rates.values()) else (None, None)

    def _creatinine(self, now: int) -> tuple[float | None, float | None, float | None]:
        """Current value, least other value of seven days (the current one if it is alone), least of two days."""
        if not self.samples:
            return None, None, None
        at, _, value = self.samples[-1]
        other = self.before.least(now)
        own = value if at >= now - self.CREATININE_H * HOUR_US else None
        return value, own if other is None else other, self.two_days.least(now)

    def result(self, now: int) -> tuple:
        """The row of ``RESULT`` at ``now``, the time of the last fact or later."""
        kg = self.weight[2] if self.weight else None
        if self.esrd and not self.rrt:
            return "excluded", None, None, None, None, None, None, kg, None, None, None, 0.0, ["exclusion_esrd"], ["esrd_exclusion"]
        while self.urine and self.urine[0][0] < now - self.URINE_H * HOUR_US:
            self._forget(self.urine.popleft())
        value, base, low = self._creatinine(now)
        lacking: set[str] = set()
        rates = {h: self._urine_rate(now, h, lacking) for h in WINDOWS_H}
        urine, urine_label = self._urine_stage(now, rates)
        labels, kidney = [], None
        if value is not None:
            ratio = value / base if base else 0.0
            steps = [(3, "cr_ge_4_0")] if value >= 4.0 else []
            steps += [next(((s, f"cr_ge_{s_}x_baseline") for s, limit, s_ in ((3, 3.0, "3_0"), (2, 2.0, "2_0"), (1, 1.5, "1_5")) if ratio >= limit), (0, ""))]
            steps += [(1, "delta_cr_ge_0_3_within_48h")] if low is not None and value - low >= 0.3 else []
            kidney, labels = max(s for s, _ in steps), [label for _, label in steps if label]
        labels += [urine_label] if urine_label else []
        labels += ["rrt"] if self.rrt else []
        if urine is None and self.odd:
            lacking.add("urine_output")
        stages = [s for s in (kidney, urine, 3 if self.rrt else None) if s is not None]
        missing = [*(() if stages else ("creatinine",)), *(m for m in ("weight_kg", "urine_output") if m in lacking)]
        return ("scored" if stages else "insufficient_data", max(stages) if stages else None, kidney, urine, value, base, low, kg, rates[6], rates[12], rates[24],
                self.anuria_us / HOUR_US, labels, missing)
