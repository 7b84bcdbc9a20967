"""Connected components of a link table, without a graph on the driver.

Links are dealt into parts of at most ``part_links``; each part shrinks to a star per component (union-find, memory bounded by the
part). One part is the answer; more parts go through rounds of large-star and small-star, each a combining minimum and a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

PART_LINKS = 500_000
_PAIR = pa.schema([("node", pa.int64()), ("root", pa.int64())])


class Forest:
    """Union-find in which a set's root is its smallest member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = up.setdefault(x, x)
        while up[top] != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def stars(self) -> pa.RecordBatch:
        nodes = [x for x in self.up if self.root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([self.root(x) for x in nodes], pa.int64())], schema=_PAIR)


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a and b: each a member's place, at the end the smallest one of its set."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.link(a, b)
    yield forest.stars()


def _both(links: DataFrame) -> DataFrame:
    return links.union(links.select(F.col("root").alias("node"), F.col("node").alias("root")))


def _least(links: DataFrame) -> DataFrame:
    """Each link with the least of its node's neighbours and the node itself."""
    least = links.groupBy("node").agg(F.min("root").alias("m")).select("node", F.least("m", "node").alias("m"))
    return links.join(least, "node")


def components(links: DataFrame, part_links: int = PART_LINKS) -> DataFrame:
    """(node long, root long): every node with at least one link and the smallest node it reaches.

    ``links``: two long columns, any order of ends; rows with a null end and links of a node to itself are ignored; repeats are fine.
    An empty table gives an empty one.
    """
    a, b = links.columns[:2]
    pairs = saved(links.select(F.col(a).cast("long").alias("node"), F.col(b).cast("long").alias("root")).where("node <> root"), "links")
    parts = -(-pairs.count() // part_links)
    stars = pairs.repartition(max(1, parts)).mapInArrow(_stars, "node long, root long")
    if parts > 1:
        stars = saved(stars, "stars")
        before = None
        while True:
            big = _least(_both(stars)).where("root > node").select(F.col("root").alias("node"), F.col("m").alias("root"))
            low = _least(big.where("node <> root").distinct())
            stars = saved(low.select(F.col("root").alias("node"), F.col("m").alias("root")).union(low.select("node", F.col("m").alias("root"))).where("node <> root").distinct(), "stars")
            now = stars.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
            if now == before:
                break
            before = now
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
