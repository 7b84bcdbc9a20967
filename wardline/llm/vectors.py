"""Embedding rows as packed blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """Not null, not empty, no null and only finite components."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & ~odd, F.lit(False))


def by_dimension(batches: Iterator[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """All rows (id, components) of a partition, by length: ids and a matrix in double precision. The partition's size bounds it."""
    kept: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.cumsum(lengths) - lengths
        for d in np.unique(lengths):
            own = np.flatnonzero(lengths == d)
            kept.setdefault(int(d), []).append((ids[own], flat[starts[own][:, None] + np.arange(d)]))
    return {d: (np.concatenate([x[0] for x in rows]), np.concatenate([x[1] for x in rows])) for d, rows in kept.items()}


def dealt(rows: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Rows in as many even partitions as keep each at about ``most``, and how many there are."""
    parts = max(1, -(-rows.count() // most))
    return rows.repartition(parts), parts
