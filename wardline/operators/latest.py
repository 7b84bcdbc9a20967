"""Arrival rules and the latest-value snapshot per patient.

Each operator has a window form, used while no key is larger than ``HOT_ROWS`` rows, and an ordered
fold for larger keys. Both give the same rows; ``hot=None`` measures which one is needed.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.operators import folds
from wardline.operators.folds import Summary, largest_key, ordered_fold

DAY_US = 24 * 3_600_000_000
LATENESS_US = 5 * 60_000_000
TASK_ROWS = 200_000


class Shape(NamedTuple):
    """What decides the physical form of a keyed job."""

    hot: bool
    long_spans: bool
    rows: int = 0  # of all patients; 0: not measured


def shape_of(df: DataFrame, ttl_us: int = DAY_US) -> Shape:
    """Measure the largest patient and whether any delivery key recurs after its time to live."""
    per_key = df.groupBy("patient_id", "idempotency_key").agg(
        F.count(F.lit(1)).alias("n"), (F.max("ingest_us") - F.min("ingest_us")).alias("span"))
    blank = F.trim(F.coalesce("idempotency_key", F.lit(""))) == ""
    per_patient = per_key.groupBy("patient_id").agg(
        F.sum("n").alias("n"), F.max(F.when(~blank, F.col("span"))).alias("span"))
    row = per_patient.agg(F.max("n").alias("n"), F.max("span").alias("span"), F.sum("n").alias("rows")).first()
    return Shape((row["n"] or 0) > folds.HOT_ROWS, (row["span"] or 0) >= ttl_us, row["rows"] or 0)


def by_key(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """One exchange on the keys for all that rides on it.

    Several sorts hold a task's rows at a time, so the number of tasks grows with the rows. A number given here
    is not coalesced afterwards.
    """
    wanted = -(-rows // TASK_ROWS)
    return df.repartition(wanted, *keys) if wanted > df.sparkSession.sparkContext.defaultParallelism else df.repartition(*keys)


def by_patient(df: DataFrame, rows: int) -> DataFrame:
    return by_key(df, ["patient_id"], rows)


def is_hot(df: DataFrame, keys: Sequence[str], hot: bool | None) -> bool:
    return largest_key(df, keys) > folds.HOT_ROWS if hot is None else hot


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str,
             hot: bool | None = None) -> DataFrame:
    """Row number within the key."""
    if not is_hot(df, keys, hot):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = T.StructType([T.StructField(name, T.IntegerType())])
    return ordered_fold(df, keys, order, [], lambda s, _: (s + 1, (s + 1,)), lambda: 0, out, keep=df.columns, hot=True,
                        summary=Summary(lambda: 0, lambda n, _: n + 1, lambda s, n: s + n))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str,
                hot: bool | None = None) -> DataFrame:
    """Sum of a whole-number column over the key's rows up to and with this one."""
    if not is_hot(df, keys, hot):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(column).over(w))

    def add(s, row):
        return s + (row[0] or 0)

    return ordered_fold(df, keys, order, [column], lambda s, row: (add(s, row), (add(s, row),)), lambda: 0,
                        T.StructType([T.StructField(name, T.LongType())]), keep=df.columns, hot=True,
                        summary=Summary(lambda: 0, add, lambda s, n: s + n))


def forward_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
                 hot: bool | None = None) -> DataFrame:
    """Carry the last known value of each column forward within the key."""
    columns = list(columns)
    if not is_hot(df, keys, hot):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})

    def onto(state, row):
        return tuple(v if v is not None else s for v, s in zip(row, state))

    def step(state, row):
        state = onto(state, row)
        return state, state

    def nothing():
        return (None,) * len(columns)

    kept = [c for c in df.columns if c not in columns]
    out = T.StructType([df.schema[c] for c in columns])
    return ordered_fold(df, keys, order, columns, step, nothing, out, keep=kept, hot=True,
                        summary=Summary(nothing, onto, onto)).select(*df.columns)


def deduplicate(df: DataFrame, shape: Shape | None = None, ttl_us: int = DAY_US) -> DataFrame:
    """Drop a delivery whose key was accepted less than ``ttl_us`` earlier (by arrival clock).

    Blank keys are never duplicates.
    """
    shape = shape or shape_of(df, ttl_us)
    blank = F.trim(F.coalesce("idempotency_key", F.lit(""))) == ""
    order = ["ingest_us", "event_id"]
    if shape.long_spans:
        def step(kept_at, row):
            if kept_at is not None and row[0] - kept_at < ttl_us:
                return kept_at, None
            return row[0], ()

        fresh = ordered_fold(df.where(~blank), ["patient_id", "idempotency_key"], order, ["ingest_us"],
                             step, lambda: None, T.StructType([]), keep=df.columns)
        return fresh.unionByName(df.where(blank))
    if not shape.hot:
        w = Window.partitionBy("patient_id", "idempotency_key").orderBy(*order)
        return by_patient(df, shape.rows).withColumn("_copy", F.row_number().over(w)).where(
            blank | (F.col("_copy") == 1)).drop("_copy")
    first = df.where(~blank).groupBy("patient_id", "idempotency_key").agg(
        F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")).select("_row.*")
    return first.unionByName(df.where(blank))


def mark_late(df: DataFrame, hot: bool | None = None, lateness_us: int = LATENESS_US) -> DataFrame:
    """Add ``late``: older than the patient's newest earlier arrival by more than the lateness."""
    order = ["ingest_us", "event_id"]
    if not is_hot(df, ["patient_id"], hot):
        w = Window.partitionBy("patient_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        newest = F.max("event_us").over(w)
        return df.withColumn("late", F.coalesce(F.col("event_us") < newest - F.lit(lateness_us), F.lit(False)))

    def newer(a, b):
        return b if a is None else a if b is None else max(a, b)

    def step(newest, row):
        late = newest is not None and row[0] < newest - lateness_us
        return newer(newest, row[0]), (late,)

    return ordered_fold(df, ["patient_id"], order, ["event_us"], step, lambda: None,
                        T.StructType([T.StructField("late", T.BooleanType())]), keep=df.columns, hot=True,
                        summary=Summary(lambda: None, lambda s, row: newer(s, row[0]), newer))


def mark_out_of_order(df: DataFrame, name: str = "out_of_order", hot: bool | None = None) -> DataFrame:
    """Add a flag: an earlier arrival of the patient already had a later event time."""
    before = df.columns
    return mark_late(df.withColumnRenamed("late", "_late"), hot, 0).withColumnRenamed("late", name).withColumnRenamed(
        "_late", "late").select(*before, name)


def encounter_scope(df: DataFrame, order: Sequence[str] = ("event_us", "idempotency_key"),
                    keys: Sequence[str] = ("patient_id",), null_opens: bool = False, hot: bool = False) -> DataFrame:
    """Add ``scope`` (counts encounter changes) and ``encounter_now`` (sticky encounter).

    A row without an encounter stays in the current scope. ``null_opens`` makes the step from "no
    encounter yet" to a named one a change too, as governance wants it.
    """
    if hot:
        def step(state, row):
            now, scope = state
            named = (row[0] or "").strip() or None
            if named is not None and named != now:
                scope += now is not None or null_opens
                now = named
            return (now, scope), (now, scope)

        def add(s, row):  # first and last encounter of the stretch, changes between them
            first, last, changes = s
            named = (row[0] or "").strip() or None
            if named is None:
                return s
            return (named, named, 0) if first is None else (first, named, changes + (named != last))

        def after(state, s):
            (now, scope), (first, last, changes) = state, s
            if first is None:
                return state
            return last, scope + changes + (first != now and (now is not None or null_opens))

        out = T.StructType([T.StructField("encounter_now", T.StringType()), T.StructField("scope", T.LongType())])
        return ordered_fold(df, keys, order, ["encounter_id"], step, lambda: (None, 0), out, keep=df.columns, hot=True,
                            summary=Summary(lambda: (None, None, 0), add, after))
    named = F.nullif(F.trim("encounter_id"), F.lit(""))
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.last(named, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    first_named = named.isNotNull() & before.isNull() if null_opens else F.lit(False)
    changed = first_named | F.coalesce(named != before, F.lit(False))
    return df.withColumn("_changed", changed.cast("int")).withColumns({
        "encounter_now": F.last(named, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "scope": F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0)),
    }).drop("_changed")


SNAPSHOT_FIELDS = {
    "platelets": T.DoubleType(), "bilirubin": T.DoubleType(), "creatinine": T.DoubleType(),
    "gcs": T.IntegerType(), "spo2": T.DoubleType(), "map_mmhg": T.DoubleType(), "pao2": T.DoubleType(),
    "fio2": T.DoubleType(), "on_pressor": T.BooleanType(), "agent": T.StringType(),
}


def snapshot_step(fields: int):
    """Field-wise merge of one update into the patient's snapshot.

    State: encounter, scope number, merged fields, per component (event, ingest) of its last update.
    """

    def step(state, row):
        encounter, component, event_us, ingest_us, *values = row
        now, scope, merged, clocks = state
        encounter = (encounter or "").strip() or None
        if encounter is not None:
            if now is not None and encounter != now:
                scope, merged, clocks = scope + 1, (None,) * fields, {}
            now = encounter
        seen = clocks.get(component)
        if seen is not None and (event_us, ingest_us) < seen:
            return (now, scope, merged, clocks), None
        merged = tuple(v if v is not None else m for v, m in zip(values, merged))
        clocks = {**clocks, component: (event_us, ingest_us)}
        return (now, scope, merged, clocks), (now, scope, *merged)

    return step


def snapshot_start(fields: int):
    return lambda: (None, 0, (None,) * fields, {})


def snapshot_summary(fields: int) -> Summary:
    """What a stretch of updates does to any snapshot before it.

    Of each component it keeps the newest clock and, per field, the last value that no earlier update of the
    stretch made stale, with its clock and place: it counts if the snapshot's own clock is not newer. ``joint``
    is the part that may meet the snapshot's encounter, ``own`` the part since the stretch last named one.
    """

    def put(part, at, row):
        _, component, event_us, ingest_us, *values = row
        newest, kept = part.get(component, (None, {}))
        clock = (event_us, ingest_us)
        if newest is None or clock >= newest:
            part[component] = (clock, kept | {i: (at, clock, v) for i, v in enumerate(values) if v is not None})

    def add(s, row):
        named = (row[0] or "").strip() or None
        if named is not None:
            if s["first"] is None:
                s["first"] = named
            elif named != s["last"]:
                s["changes"] += 1
                s["joint"], s["own"] = None, {}
            s["last"] = named
        s["at"] += 1
        if s["joint"] is not None:
            put(s["joint"], s["at"], row)
        if s["first"] is not None:
            put(s["own"], s["at"], row)
        return s

    def onto(merged, clocks, part):
        best = {}
        for component, (newest, kept) in part.items():
            seen = clocks.get(component)
            for i, (at, clock, v) in kept.items():
                if (seen is None or clock >= seen) and (i not in best or at > best[i][0]):
                    best[i] = (at, v)
        fresh = {c: newest for c, (newest, _) in part.items() if c not in clocks or newest > clocks[c]}
        return tuple(best[i][1] if i in best else m for i, m in enumerate(merged)), {**clocks, **fresh}

    def after(state, s):
        now, scope, merged, clocks = state
        if s["first"] is None:
            return now, scope, *onto(merged, clocks, s["joint"])
        turned = now is not None and s["first"] != now
        if turned or s["changes"]:
            return s["last"], scope + turned + s["changes"], *onto((None,) * fields, {}, s["own"])
        return s["last"], scope, *onto(merged, clocks, s["joint"])

    return Summary(lambda: {"first": None, "last": None, "changes": 0, "at": 0, "joint": {}, "own": {}}, add, after)


def latest_inputs(mapped: DataFrame, hot: bool | None = None) -> DataFrame:
    """Latest value of every input per patient and encounter, one row per applied update.

    Rows without a usable component are left out first, so they never change the encounter. An update
    older than what its component already holds is ignored.
    """
    fields = [f for f in SNAPSHOT_FIELDS if f in mapped.columns]
    rows = mapped.where(F.col("component").isNotNull())
    order = ["event_us", "idempotency_key"]
    keep = [c for c in rows.columns if c not in fields]
    if is_hot(rows, ["patient_id"], hot):
        out = T.StructType(
            [T.StructField("encounter_now", T.StringType()), T.StructField("scope", T.LongType())]
            + [T.StructField(f, SNAPSHOT_FIELDS[f]) for f in fields])
        return ordered_fold(
            rows, ["patient_id"], order, ["encounter_id", "component", "event_us", "ingest_us", *fields],
            snapshot_step(len(fields)), snapshot_start(len(fields)), out, keep=keep, hot=True, summary=snapshot_summary(len(fields)))
    scoped = encounter_scope(rows, order)
    clock = F.struct("event_us", "ingest_us")
    before = Window.partitionBy("patient_id", "scope", "component").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    fresh = scoped.withColumn("_newest", F.max(clock).over(before)).where(
        F.col("_newest").isNull() | (clock >= F.col("_newest"))).drop("_newest")
    w = Window.partitionBy("patient_id", "scope").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return fresh.withColumns({f: F.last(f, ignorenulls=True).over(w) for f in fields})


def evidence_rows(mapped: DataFrame) -> DataFrame:
    """Evidence of each component as rows with the time it first counted.

    An alert's evidence is the rows of its patient and scope with ``since_us`` up to the alert. Keeping
    it as rows avoids arrays that grow with the length of a stay.
    """
    return mapped.where(F.col("evidence_id").isNotNull()).groupBy(
        "patient_id", "scope", "component", "evidence_id").agg(F.min("event_us").alias("since_us"))
