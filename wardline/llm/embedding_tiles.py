"""Embedding near-duplicates by int8 tile products with error bounds.

Unit vectors are stored with one byte per component and a scale of their own. The length e of what rounding took away is known per vector, so
for two vectors the true cosine differs from that of the codes by at most e1 + e2 + 3 e1 e2. A product of two tiles of codes (exact in single
precision, as sums of byte products stay below 2^24) leaves the pairs that may reach the threshold; only those are computed in double
precision. A pair of tiles gives each vector's number of links and its component inside the pair, never the pairs, so groups of
copies of any size add one row per vector and tile pair.

Every vector is compared with every other one, tile by tile: work grows with the square of the rows, the rows moved with the square of
the number of tiles. No task holds more than two tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, saved
from .components import components, merge_labels
from .vectors import by_dimension, dealt, usable

TILE_ROWS = 8192
STRIP_ROWS = 256
EXACT_DIMENSIONS = 1024  # of byte products that single precision adds without rounding
_TILE = pa.schema([("tile", pa.int32()), ("d", pa.int32()), ("ids", pa.binary()), ("units", pa.binary()), ("codes", pa.binary()), ("scales", pa.binary()), ("errors", pa.binary())])
_LINKED = pa.schema([("vec_id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales and error lengths of unit vectors."""
    scales = np.abs(units).max(axis=1) / 127
    codes = np.rint(units / scales[:, None]).astype(np.int8)
    errors = np.linalg.norm(units - codes * scales[:, None], axis=1) * (1 + 1e-9) + 1e-12
    return codes, scales, errors


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tile = TaskContext.get().partitionId()
    for d, (ids, x) in by_dimension(batches).items():
        big = np.abs(x).max(axis=1)
        ids, x = ids[big > 0], x[big > 0] / big[big > 0, None]  # no over- or underflow in the norm
        if not len(ids):
            continue
        units = x / np.linalg.norm(x, axis=1)[:, None]
        codes, scales, errors = quantised(units)
        yield batches_of({"tile": [tile], "d": [d], "ids": [ids.astype("<i8").tobytes()], "units": [units.tobytes()], "codes": [codes.tobytes()],
                          "scales": [scales.tobytes()], "errors": [errors.tobytes()]}, _TILE)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.shape[1] <= EXACT_DIMENSIONS:
        return a.astype(np.float32) @ b.astype(np.float32).T
    return sum(_products(a[:, k:k + EXACT_DIMENSIONS], b[:, k:k + EXACT_DIMENSIONS]).astype(np.float64) for k in range(0, a.shape[1], EXACT_DIMENSIONS))


def linked_pairs(left: tuple, right: tuple, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of left and right with cosine >= threshold, by strips; of a tile with itself each pair once."""
    (_, u, q, s, e), (_, v, p, t, f) = left, right
    p32 = p.astype(np.float32) if q.shape[1] <= EXACT_DIMENSIONS else None
    for at in range(0, len(q), STRIP_ROWS):
        rows = slice(at, at + STRIP_ROWS)
        codes = q[rows].astype(np.float32) @ p32.T if p32 is not None else _products(q[rows], p)
        least = threshold - 1e-6 - e[rows] - f.max() * (1 + 3 * e[rows])
        # below any pair's own bound; where it is not positive, divide by the smallest scales instead
        floor = np.where(least > 0, least / (s[rows] * t.max()), least / (s[rows] * t.min()))
        i, j = np.nonzero(codes >= floor[:, None])
        if same:
            up = j > i + at
            i, j = i[up], j[up]
        maybe = codes[i, j] * s[rows][i] * t[j] >= threshold - 1e-6 - e[rows][i] - f[j] - 3 * e[rows][i] * f[j]
        i, j = i[maybe], j[maybe]
        if len(i) > codes.size // 32:
            sure = (u[rows] @ v.T)[i, j] >= threshold
        else:
            sure = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", u[rows][i[k:k + 8192]], v[j[k:k + 8192]]) >= threshold for k in range(0, len(i), 8192))])
        yield i[sure] + at, j[sure]


def _opened(d: int, *blobs: bytes) -> tuple:
    ids, units, codes, scales, errors = blobs
    return np.frombuffer(ids, "<i8"), np.frombuffer(units).reshape(-1, d), np.frombuffer(codes, np.int8).reshape(-1, d), np.frombuffer(scales), np.frombuffer(errors)


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                i, j, d, *blobs = (batch.column(k)[row].as_py() for k in range(13))
                left = _opened(d, *blobs[:5])
                right = left if i == j else _opened(d, *blobs[5:])
                ids = left[0] if i == j else np.concatenate([left[0], right[0]])
                shift = 0 if i == j else len(left[0])
                order = np.argsort(ids, kind="stable")
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                n, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
                for a, b in linked_pairs(left, right, threshold, i == j):
                    b = b + shift
                    other = ids[a] != ids[b]
                    a, b = a[other], b[other]
                    n += np.bincount(a, minlength=len(n)) + np.bincount(b, minlength=len(n))
                    label = merge_labels(label, place[a], place[b])
                has = np.flatnonzero(n)
                yield batches_of({"vec_id": ids[has], "n": n[has], "root": ids[order][label[place[has]]]}, _LINKED)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, tile_rows: int = TILE_ROWS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; so do vectors of different lengths.
    Rows that repeat a vec_id are one member: their links add up and links to itself don't count. A null vec_id keeps its row with no
    links and a null component. No vectors give no rows; other columns are not read.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("x"))
    good, tiles = dealt(rows.where(usable(F.col("x")) & F.col("vec_id").isNotNull()), tile_rows)
    packed = saved(good.mapInArrow(_tiles, "tile int, d int, ids binary, units binary, codes binary, scales binary, errors binary"), "embedding-tiles")
    data = ["ids", "units", "codes", "scales", "errors"]
    left = packed.select(F.col("tile").alias("i"), F.explode(F.sequence("tile", F.lit(tiles - 1))).alias("j"), "d", *data)
    right = packed.select(F.explode(F.sequence(F.lit(0), F.col("tile"))).alias("i"), F.col("tile").alias("j"), "d", *[F.col(c).alias(f"{c}_r") for c in data])
    # of a tile with itself the second copy stays at home
    right = right.select("i", "j", "d", *[F.when(F.col("i") < F.col("j"), F.col(f"{c}_r")).alias(f"{c}_r") for c in data])
    linked = saved(left.join(right, ["i", "j", "d"]).mapInArrow(_compare(threshold), "vec_id long, n long, root long"), "embedding-links")
    counts = linked.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    roots = components(linked.select("vec_id", "root")).withColumnRenamed("node", "vec_id")
    out = rows.select("vec_id").join(counts.join(roots, "vec_id", "left"), "vec_id", "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
