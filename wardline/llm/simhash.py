"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are cut into ``BLOCKS`` blocks. Two that differ in at most d bits agree on at least BLOCKS - d blocks, so each fingerprint is
indexed under every choice of that many blocks, joined with itself on them, and verified by the Hamming distance. Only different
fingerprints are joined; texts that share one are a class already.

A choice of blocks that very many fingerprints share is not paired out by a join: its fingerprints are compared in cells, each of two
blocks of bounded size, which give a link per fingerprint and what it reaches in the cell, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, saved, short_batches, tidied
from .components import components, merge_labels

BITS, BLOCKS = 64, 4
WORDS, DISTANCE, SEED = 3, 2, 42
CROWD = 256  # members beyond which a bucket is compared in cells instead of by a join
CELL_ROWS = 2048
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_PRINT = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def shingle_hashes(text: str | None, words: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, repeats included, some at a time; nothing without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return
    if len(parts) < words:
        shingles = [b" ".join(parts)]
    else:
        shingles = list(map(b" ".join, zip(*(parts[i:] for i in range(words)))))
    for at in range(0, len(shingles), 1 << 15):
        yield np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles[at:at + (1 << 15)]), "<u8")


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned; 0 without words. A bit is set if more than half of the shingles' hashes have it."""
    total, count = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, words, seed):
        # eight bytes of counts at a time: sums of up to 255 bits fit a byte of each lane
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
        count += len(hashes)
    return int.from_bytes(np.packbits(total * 2 > count, bitorder="little").tobytes(), "little")


def _prints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), words, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield batches_of({"doc_id": batch.column(0), "fp": prints.view(np.int64)}, _PRINT)

    return run


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def block_masks(distance: int, blocks: int = BLOCKS) -> list[int]:
    """The mask of every choice of blocks that agree."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return [_mask([bit for i in agree for bit in range(edges[i], edges[i + 1])]) for agree in combinations(range(blocks), blocks - distance)]


def _cells(distance: int):
    """Rows sorted by cell: choice, key, left, right, side (0: left block, 1: right, 2: both), fp."""

    def linked(prints: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(prints)
        prints, sides = prints[order], sides[order]
        label, bits = np.arange(len(prints)), prints.view(np.uint64)
        for at in range(0, len(prints), 256):
            i, j = np.nonzero(np.bitwise_count(bits[at:at + 256, None] ^ bits[None, :]) <= distance)
            i += at
            wanted = (i < j) & ((sides[i] == 2) | (sides[i] != sides[j]))
            label = merge_labels(label, i[wanted], j[wanted])
        moved = np.flatnonzero(label != np.arange(len(label)))
        return prints[label[moved]], prints[moved]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, prints, sides = None, [], []
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            cell = np.stack([c.astype(np.int64) for c in columns[:4]], axis=1)
            new = np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1
            for begin, end in zip([0, *new], [*new, len(cell)]):
                if begin == end:
                    continue
                if last is not None and (cell[begin] != last).any():
                    a, b = linked(np.concatenate(prints), np.concatenate(sides))
                    yield batches_of({"a": a, "b": b}, _LINK)
                    prints, sides = [], []
                last = cell[begin]
                prints.append(columns[5][begin:end])
                sides.append(columns[4][begin:end])
        if prints:
            a, b = linked(np.concatenate(prints), np.concatenate(sides))
            yield batches_of({"a": a, "b": b}, _LINK)

    return run


def near_links(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, crowd: int = CROWD, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b) links of distinct values of the long column ``fp`` that are at most ``distance`` bits apart: all such pairs of quiet buckets,
    and enough in crowded ones to connect what is connected."""
    masks = block_masks(distance, blocks)
    keyed = saved(prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "key")), "simhash-keys")
    crowded = saved(keyed.groupBy("choice", "key").count().where(F.col("count") > crowd), "simhash-crowds")
    calm = keyed.join(crowded, ["choice", "key"], "left_anti")
    left, right = calm.select("choice", "key", F.col("fp").alias("a")), calm.select("choice", "key", F.col("fp").alias("b"))
    pairs = left.join(right, ["choice", "key"]).where(F.col("a") < F.col("b")).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")
    loud = keyed.join(crowded, ["choice", "key"]).withColumn("n", F.ceil(F.col("count") / cell_rows).cast("int"))
    loud = loud.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cells = loud.select("choice", "key", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
                        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"), "fp")
    cell = ["choice", "key", "left", "right"]
    return pairs.unionByName(cells.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(_cells(distance), "a long, b long"))


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, blocks: int = BLOCKS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    component_id is the smallest doc_id reachable over fingerprints at most ``distance`` bits apart, itself included. Null, empty and
    wordless texts have fingerprint zero and are linked like any other. Repeated rows are repeated; a row with a null doc_id keeps its
    fingerprint and its component's id. Other columns are not read; no documents give no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    prints = saved(short_batches(rows).mapInArrow(tidied(_prints(words, seed)), "doc_id long, fp long"), "fingerprints")
    classes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "fingerprint-classes")
    roots = components(near_links(classes, distance, blocks)).withColumnRenamed("node", "fp")
    labelled = classes.join(roots, "fp", "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    labelled = saved(labelled.join(smallest, "root").select("fp", "component_id"), "fingerprint-components")
    return prints.join(labelled, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
