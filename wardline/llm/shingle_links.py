"""Documents whose sets of word shingles have a Jaccard similarity of at least a threshold: what SimHash blocks are too narrow for.

Candidates have a key in common and meet in its bucket; they are verified on the whole sets. Keys of long sets come from min-wise samples: under
each of ``SAMPLES`` orders of the shingle hashes the ``TAKEN`` least ones are a key. Two sets of similarity 0.8 can share none, most of all small ones.

So pairs with a set of up to ``SHORT`` shingles get exact keys, and so do documents that something else brings together (``groups``): inside a group
each set's rarest shingles are its keys, as many as two alike sets must share one of. No pair is lost, and a shingle that most members have pairs out nothing.

A bucket's members are first compared with one of them, its centre, in streams of bounded length, so groups of near copies cost one comparison a member.
Only buckets that still hold unlinked members are compared in full, in cells of two blocks of bounded size that give links, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, gathered, saved, short_batches, tidied
from .components import components, merge_labels
from .simhash import SEED, shingle_hashes

SAMPLES, TAKEN = 20, 3
SHORT = 96  # shingles; up to here the exact keys are no more than the samples would be
STAR_ROWS = 1000  # members a task compares with one centre
SALT_ROWS = 512  # members of a key that meet what is known of the key in one task
BLOCK_HASHES = 200_000  # hashes in a block of a cell; a larger set is a block of its own
_ODD = np.array([xxhash.xxh64_intdigest(bytes([i]), SEED) | 1 for i in range(SAMPLES)], np.uint64)[:, None]
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_SKETCH = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("keys", pa.list_(pa.int64()))])
_SET = pa.schema([("node", pa.int64()), ("hashes", pa.list_(pa.int64()))])


def shingle_set(text: str | None, words: int, seed: int = SEED) -> np.ndarray:
    """The different shingle hashes, ascending."""
    parts = list(shingle_hashes(text, words, seed))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def set_name(hashes: np.ndarray) -> int:
    """Equal sets have one name: 64 bits, signed."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).astype(np.int64))


def sample_keys(hashes: np.ndarray) -> list[int]:
    """One key an order; none for short sets, whose keys are exact."""
    if len(hashes) <= SHORT:
        return []
    least = np.zeros((SAMPLES, 0), np.uint64)
    for at in range(0, len(hashes), 1 << 14):
        least = np.concatenate([least, hashes[None, at:at + (1 << 14)] * _ODD], axis=1)
        least = np.partition(least, TAKEN - 1, axis=1)[:, :TAKEN] if least.shape[1] > TAKEN else least
    least = np.sort(least, axis=1)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least)], np.uint64).view(np.int64).tolist()


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, keys = [], [], []
            for text in batch.column(1):
                hashes = shingle_set(text.as_py(), words)
                names.append(set_name(hashes))
                sizes.append(len(hashes))
                keys.append(sample_keys(hashes))
            yield batches_of({"doc_id": batch.column(0), "node": names, "size": sizes, "keys": keys}, _SKETCH)

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), words) for t in batch.column(0)]
            yield batches_of({"node": [set_name(s) for s in sets], "hashes": [s.view(np.int64) for s in sets]}, _SET)

    return run


def _alike(shared, a, b, similarity: float):
    return shared >= similarity * (a + b - shared)


def _star(similarity: float):
    """Rows sorted by centre, part and side: the centre's own set (side 0), then its members'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            links = []
            for centre, part, side, node, hashes in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4)):
                values = hashes.values.to_numpy()
                if side == 0:
                    at, own = (centre, part), values
                elif at == (centre, part):
                    n, m = len(own), len(values)
                    if min(n, m) >= similarity * max(n, m) and _alike(len(np.intersect1d(own, values, assume_unique=True)), n, m, similarity):
                        links.append((centre, node))
            yield batches_of({"a": [a for a, _ in links], "b": [b for _, b in links]}, _LINK)

    return run


def _linked(nodes: list[int], sides: list[int], sets: list[np.ndarray], similarity: float) -> pa.RecordBatch:
    sizes = np.array([len(s) for s in sets])
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(place, kind="stable")]
    counts = np.bincount(place, minlength=len(values))
    starts, ends = np.cumsum(counts) - counts, np.cumsum(sizes)
    label, sides = np.arange(len(sets)), np.array(sides)
    for i in range(len(sets)):
        mine = place[ends[i] - sizes[i]:ends[i]]
        shared = np.bincount(owner[gathered(starts[mine], counts[mine])], minlength=len(sets))
        near = np.flatnonzero(_alike(shared, sizes[i], sizes, similarity) & (np.arange(len(sets)) > i) & ((sides[i] == 2) | (sides != sides[i])))
        label = merge_labels(label, np.full(len(near), i), near)
    moved = np.flatnonzero(label != np.arange(len(label)))
    nodes = np.array(nodes, np.int64)
    return batches_of({"a": nodes[label[moved]], "b": nodes[moved]}, _LINK)


def _cells(similarity: float):
    """Rows sorted by cell: key, left, right, side (0: left block, 1: right, 2: both), node, hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nodes, sides, sets = None, [], [], []
        for batch in batches:
            for *cell, side, node, hashes in zip(*(c.to_pylist() for c in batch.columns[:5]), batch.column(5)):
                if last is not None and cell != last:
                    yield _linked(nodes, sides, sets, similarity)
                    nodes, sides, sets = [], [], []
                last = cell
                nodes.append(node)
                sides.append(side)
                sets.append(hashes.values.to_numpy())
        if nodes:
            yield _linked(nodes, sides, sets, similarity)

    return run


def _blocked(members: DataFrame) -> DataFrame:
    """A row of each member (key, node, blocks) per cell it belongs to."""
    rows = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("key", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
                       F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"), "node")


def _met(buckets: DataFrame) -> DataFrame:
    """The rows (key, node, size) of keys that several nodes have, with the key's centre and number of members."""
    return buckets.join(buckets.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("members")).where("members > 1"), "key")


def rare_keys(members: DataFrame, similarity: float) -> DataFrame:
    """(key, node, size) of ``members`` (group, node, size, hashes; a node once a group): two sets of a group that are alike have a key in common.

    Of n shingles, ordered from the group's rarest to its most frequent one, alike sets can't differ in all of the first n - ceil(similarity * n) + 1.
    """
    each = saved(members.select("group", "node", "size", F.explode("hashes").alias("shingle")), "group-shingles")
    often = each.groupBy("group", "shingle").agg(F.count("*").alias("often"))
    placed = each.join(often, ["group", "shingle"]).withColumn("place", F.row_number().over(Window.partitionBy("group", "node").orderBy("often", "shingle")))
    first = F.col("size") - F.ceil(F.col("size") * similarity - 1e-6) + 1
    return placed.where((F.col("place") <= first) & (F.col("often") > 1)).select(F.xxhash64("group", "shingle").alias("key"), "node", "size")


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text",
                      star_rows: int = STAR_ROWS, block_hashes: int = BLOCK_HASHES, groups: DataFrame | None = None) -> DataFrame:
    """(doc_id, component_id), one row per row of ``docs`` with a doc_id; component_id is the smallest doc_id reachable over documents whose
    sets of ``words``-word shingles are at least ``similarity`` alike (0.8 or more), itself included.

    Words and case are read as the fingerprints read them. Texts of fewer words are one shingle; null, empty and wordless texts are the
    empty set and alike. Repeated rows are repeated; rows without doc_id give none; other columns are not read; no documents give no rows.
    ``groups`` (doc_id, group; both long): documents of a group are compared whatever their samples are, and linked only if they are alike.
    """
    if similarity < 0.8:
        raise ValueError("the samples are laid out for similarities of 0.8 and more")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    found = saved(short_batches(rows).mapInArrow(tidied(_sketches(words)), "doc_id long, node long, size long, keys array<long>"), "shingle-sketches")
    nodes = saved(found.groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.first("size").alias("size"), F.first("keys").alias("keys")), "shingle-nodes")
    met = saved(_met(nodes.select(F.explode("keys").alias("key"), "node", "size")), "shingle-buckets")
    # fewer than four shingles reach 0.8 with no other set
    grouped = nodes.where((F.col("size") > TAKEN) & (F.col("size") <= SHORT / similarity + 1e-6)).select(F.lit(0).cast("long").alias("group"), "node", "size")
    if groups is not None:
        member = found.where(F.col("size") > TAKEN).select("doc_id", "node", "size").distinct().join(groups.select("doc_id", "group").distinct(), "doc_id").select("group", "node", "size").distinct()
        grouped = grouped.union(member.join(member.groupBy("group").count().where("count > 1"), "group", "left_semi")).distinct()
    grouped = saved(grouped, "shingle-groups")

    chosen = nodes.join(met.select("node").union(grouped.select("node")).distinct(), "node", "left_semi").select(F.col("first_doc").alias("doc_id")).distinct()
    sets = saved(short_batches(rows.join(chosen, "doc_id", "left_semi").select("text")).mapInArrow(tidied(_sets(words)), "node long, hashes array<long>"), "shingle-sets")

    own = sets.join(grouped.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    met = saved(met.unionByName(_met(saved(rare_keys(grouped.join(own, "node"), similarity), "group-keys"))), "shingle-buckets")

    pairs = saved(met.where("node <> centre").select("centre", "node").distinct(), "shingle-pairs")
    centres = pairs.groupBy("centre").agg(F.ceil(F.count("*") / star_rows).cast("int").alias("parts"))
    members = pairs.join(centres, "centre").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).join(sets, "node")
    heads = centres.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("node", F.col("centre")).join(sets, "node")
    stars = heads.select("centre", "part", F.lit(0).alias("side"), "node", "hashes").unionByName(members.select("centre", "part", F.lit(1).alias("side"), "node", "hashes"))
    links = saved(stars.repartition("centre", "part").sortWithinPartitions("centre", "part", "side").mapInArrow(tidied(_star(similarity)), "a long, b long"), "shingle-links")

    labelled = met.where("members > 2").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.sum("size") / block_hashes).cast("int").alias("blocks"), F.max("members").alias("members")).where("low < high")
    # a crowded key's members are spread before the join; most keys have one part
    parts = F.ceil(F.col("members") / SALT_ROWS).cast("int")
    salted = met.withColumn("salt", F.pmod(F.xxhash64("node"), parts).cast("int"))
    spread = mixed.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("members")
    cells = _blocked(salted.join(spread, ["key", "salt"]).select("key", "node", "blocks")).join(sets, "node").select("key", "left", "right", "side", "node", "hashes")
    cell = ["key", "left", "right"]
    more = cells.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(tidied(_cells(similarity)), "a long, b long")

    roots = components(links.unionByName(more))
    labelled = nodes.join(roots, "node", "left").select("node", "first_doc", F.coalesce("root", "node").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    return found.select("doc_id", "node").join(labelled.join(smallest, "root").select("node", "component_id"), "node").select("doc_id", "component_id")
