"""Time joins: latest value before a time, active intervals, trailing sums, next event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.operators import folds
from wardline.operators.folds import largest_key, ordered_fold

HOUR_US = 3_600_000_000


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
              columns: Sequence[str], tie: str | None = None, forward: bool = False,
              hot: bool | None = None) -> DataFrame:
    """Attach to every left row the right row nearest in time, at or before it (or at or after it).

    Both sides are laid out as one ordered stream per key, so the work is linear in their rows and no
    pairs are formed. Of right rows at the same time the one with the largest ``tie`` wins (the smallest
    when looking forward).
    """
    sign = -1 if forward else 1
    payload = F.struct(*[F.col(c) for c in columns])
    tie_col = F.col(tie) if tie else F.lit(0)
    first_cols = left.columns
    r = right.select(*keys, (F.col(right_time) * sign).alias("_t"), F.lit(0).alias("_side"),
                     tie_col.alias("_tie"), payload.alias("_right"), F.lit(None).cast(left.schema).alias("_left"))
    l = left.select(*keys, (F.col(left_time) * sign).alias("_t"), F.lit(1).alias("_side"),
                    F.lit(None).cast(r.schema["_tie"].dataType).alias("_tie"),
                    F.lit(None).cast(r.schema["_right"].dataType).alias("_right"),
                    F.struct(*[F.col(c) for c in first_cols]).alias("_left"))
    both = r.unionByName(l)
    if hot is None:
        hot = largest_key(both, keys) > folds.HOT_ROWS
    if hot:
        seen_schema = T.StructType([T.StructField("_seen", r.schema["_right"].dataType)])

        def step(seen, row):
            side, at, value = row
            if side:
                return seen, (seen[1] if seen else None,)
            # ties come in rising order: the last one holds, looking forward the first one
            return (seen if forward and seen and seen[0] == at else (at, value)), None

        joined = ordered_fold(both, keys, ["_t", "_side", "_tie"], ["_side", "_t", "_right"], step, lambda: None,
                              seen_schema, keep=["_left"], hot=True)
    else:
        by_tie = F.col("_tie").desc() if forward else F.col("_tie").asc()
        w = Window.partitionBy(*keys).orderBy(F.col("_t"), F.col("_side"), by_tie).rowsBetween(
            Window.unboundedPreceding, 0)
        joined = both.withColumn("_seen", F.last("_right", ignorenulls=True).over(w)).where(F.col("_side") == 1)
    return joined.select(*[F.col(f"_left.{c}").alias(c) for c in first_cols],
                         *[F.col(f"_seen.{c}").alias(c) for c in columns])


def latest_before(stays: DataFrame, rows: DataFrame, key: str, concepts: dict[str, Column], as_of: str = "as_of_us",
                  time: str = "event_us", tie: str = "event_id", value: str = "reading") -> DataFrame:
    """Latest value per concept at each stay's time; among equal times the last row wins.

    There is one time per stay, so this is a join followed by an aggregate that combines map-side; a
    very large stay is split by the skew join.
    """
    at = F.struct(F.col(time), F.col(tie))
    hits = rows.join(stays.select(key, as_of), key).where(F.col(time) <= F.col(as_of))
    found = hits.groupBy(key).agg(*[
        F.max_by(F.when(c, F.col(value)), F.when(c, at)).alias(n) for n, c in concepts.items()])
    return stays.join(found, key, "left")


# Which running vasopressor decides the score.
AGENT_PRIORITY = {"norepinephrine": 4, "epinephrine": 4, "dopamine": 3, "dobutamine": 2, "other": 1}


def pressor_at(stays: DataFrame, infusions: DataFrame, key: str, as_of: str = "as_of_us", start: str = "start_us",
               end: str = "end_us", tie: str = "event_id") -> DataFrame:
    """The running infusion that decides the score, per stay; an open infusion runs on."""
    rank = F.lit(0)
    for agent, p in AGENT_PRIORITY.items():
        rank = F.when(F.col("agent") == agent, p).otherwise(rank)
    running = infusions.join(stays.select(key, as_of), key).where(
        (F.col(start) <= F.col(as_of)) & (F.col(as_of) <= F.coalesce(F.col(end), F.col(as_of))))
    best = running.groupBy(key).agg(
        F.max_by(F.struct("agent", "dose"), F.struct(rank, -F.col(tie))).alias("_p"))
    return stays.join(best, key, "left").select(
        *stays.columns, F.when(F.col("_p").isNotNull(), F.lit(True)).alias("on_pressor"),
        F.col("_p.agent").alias("agent"), F.col("_p.dose").alias("dose"))


def trailing_sum(stays: DataFrame, rows: DataFrame, key: str, value: str, name: str, hours: int = 24,
                 as_of: str = "as_of_us", time: str = "event_us") -> DataFrame:
    """Sum over the closed window before each stay's time; null when the window is empty."""
    hits = rows.join(stays.select(key, as_of), key).where(
        F.col(time).between(F.col(as_of) - hours * HOUR_US, F.col(as_of)))
    return stays.join(hits.groupBy(key).agg(F.sum(value).alias(name)), key, "left")


def earliest_in_lookback(stays: DataFrame, rows: DataFrame, key: str, value: str, name: str, hours: int = 168,
                         as_of: str = "as_of_us", time: str = "event_us", tie: str = "event_id") -> DataFrame:
    """Earliest value in the window before each stay's time, the time itself excluded."""
    hits = rows.join(stays.select(key, as_of), key).where(
        (F.col(time) < F.col(as_of)) & (F.col(time) >= F.col(as_of) - hours * HOUR_US))
    first = hits.groupBy(key).agg(F.min_by(F.col(value), F.struct(time, tie)).alias(name))
    return stays.join(first, key, "left")


def infection_at(rows: DataFrame, infections: DataFrame, keys: Sequence[str] = ("patient_id",), time: str = "event_us",
                 before_h: int = 24, after_h: int = 24, hot: bool | None = None) -> DataFrame:
    """Earliest infection event whose suspicion window covers the row, and whether there is any at all.

    The earliest covering event is the first one not older than ``after_h`` before the row, which makes
    this a forward as-of join instead of a range join over pairs.
    """
    first = infections.groupBy(*keys, "infection_us").agg(
        F.min_by("kind", "evidence_id").alias("infection_kind"), F.min("evidence_id").alias("infection_evidence"))
    shifted = rows.withColumn("_from", F.col(time) - after_h * HOUR_US)
    found = asof_join(shifted, first, keys, "_from", "infection_us",
                      ["infection_us", "infection_kind", "infection_evidence"], forward=True, hot=hot)
    ok = F.col("infection_us") - before_h * HOUR_US <= F.col(time)
    any_event = infections.select(*keys).distinct().withColumn("_any", F.lit(True))
    return found.join(any_event, list(keys), "left").select(
        *rows.columns, *[F.when(ok, F.col(c)).alias(c) for c in
                         ("infection_us", "infection_kind", "infection_evidence")],
        F.coalesce("_any", F.lit(False)).alias("has_infection_events"))


def admission_matches(lab_hadm: Column, stay_hadm: Column) -> Column:
    """A lab belongs to the stay when admissions agree or either is blank."""
    lab, stay = F.coalesce(lab_hadm, F.lit("")), F.coalesce(stay_hadm, F.lit(""))
    return (stay == "") | (lab == "") | (lab == stay)


def mismatches(expected: DataFrame, actual: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows where the two sides differ, null-safe, and rows that only one side has."""
    e = expected.select(*keys, F.struct(*columns).alias("expected"))
    a = actual.select(*keys, F.struct(*columns).alias("actual"))
    return e.join(a, list(keys), "full_outer").where(~F.col("expected").eqNullSafe(F.col("actual")))
