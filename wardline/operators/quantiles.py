"""Exact percentiles by counted values, with no key's values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators.latest import running_sum
from wardline.session import checkpointed


def quantiles(rows: DataFrame, keys: Sequence[str], value: Column, probabilities: dict[str, float], hot: bool | None = None) -> DataFrame:
    """One row per key with its percentiles, linear between neighbouring values; nulls do not count.

    ``probabilities`` maps column names to shares from 0 to 1. Equal values are counted map-side and written down
    once; their running totals give every value's places in the sorted sequence, so a percentile is the one or
    two values whose places it names. A key with very many distinct values is numbered across partitions
    (``running_sum``). Keys without a value have no row; null is a key like any other.
    """
    keys = list(keys)
    v, n, upto, total = "_value", "_count", "_upto", "_total"
    counted = checkpointed(rows.select(*keys, value.cast("double").alias(v)).where(F.col(v).isNotNull()).groupBy(*keys, v).agg(F.count(F.lit(1)).alias(n)))
    places = running_sum(counted, keys, [v], n, upto, hot)
    totals = counted.groupBy(*keys).agg(F.sum(n).alias(total))
    renamed = [f"_k{i}" for i in range(len(keys))]
    placed = places.join(totals.toDF(*renamed, total), [F.col(k).eqNullSafe(F.col(r)) for k, r in zip(keys, renamed)])

    def at(place: Column) -> Column:
        """The value at a place of the sorted sequence, counted from 0."""
        return F.max(F.when((F.col(upto) - F.col(n) <= place) & (place < F.col(upto)), F.col(v)))

    picks, out = [], []
    for i, (name, p) in enumerate(probabilities.items()):
        place = F.lit(p) * (F.col(total) - 1)
        picks += [at(F.floor(place)).alias(f"_low{i}"), at(F.ceil(place)).alias(f"_high{i}")]
        place, low, high = F.lit(p) * (F.col("_n") - 1), F.col(f"_low{i}"), F.col(f"_high{i}")
        out.append(F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high).alias(name))
    return placed.groupBy(*keys).agg(F.max(total).alias("_n"), *picks).select(*keys, *out)
