"""Line dedup by a segment-partition edit join.

Lines are near if turning one into the other takes few insertions, deletions and substitutions: two where both have 32 characters or more, one from 16
on; shorter lines only if equal. With at most t edits one of t + 1 segments of the shorter line stands unharmed in the longer one, shifted by
t characters at most. So every line is indexed under its segments and probes, for each length that can be near, the substrings that a
segment may have become (a substring of the i-th segment can be shifted by at most i edits to its left, and by what the edits right of it and the
difference in length allow). Lines that share a key are verified by a banded bit-parallel simulation of the edits.

The keys of all lines move once, as pairs of hashes; lines come along only where a key has two different lines. A key with many lines is
compared in cells of bounded size, and a pair is counted in the cell of its first shared key only, so pairs never leave a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, bit_marks, fresh, is_marked, saved, short_batches, tidied
from .components import components

EDITS = ((32, 2), (16, 1))  # characters from which so many edits are near
CELL_ROWS = 512
FILTER_BITS = 23
SLICE_CHARS = 1_000_000
_LAST = (1 << 63) - 1
_BASE, _MIX = 0x100000001B3, 0x9E3779B97F4A7C15
_KEYS = pa.schema([("key", pa.int64()), ("line", pa.int64())])
_LINES = pa.schema([("line", pa.int64()), ("text", pa.string())])
_LINKS = pa.schema([("line", pa.int64()), ("n", pa.int64()), ("root", pa.int64()), ("best", pa.int64())])


def edits_of(length: int) -> int:
    return next((t for least, t in EDITS if length >= least), 0)


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """Begin and size of edits + 1 nearly equal segments, the longer ones last."""
    size, longer = divmod(length, edits + 1)
    sizes = [size] * (edits + 1 - longer) + [size + 1] * longer
    return [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]


def shifts(edits: int, i: int, difference: int) -> range:
    """How far segment i (from 0) of a line may lie to the right in a line that is ``difference`` longer, if segments before it are harmed."""
    rest = edits - i
    return range(max(-i, difference - rest), min(i, difference + rest) + 1)


def near(a: str, b: str, edits: int) -> bool:
    """Whether at most ``edits`` edits turn a into b. Bit d of reached[e]: with e edits, what is read of a is d - edits longer than of b."""
    if abs(len(a) - len(b)) > edits:
        return False
    low, high = 0, min(len(a), len(b))
    while low < high:  # equal begins need no band
        half = (low + high + 1) // 2
        low, high = (half, high) if a[low:half] == b[low:half] else (low, half - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        half = (low + high + 1) // 2
        low, high = (half, high) if a[len(a) - half:len(a) - low] == b[len(b) - half:len(b) - low] else (low, half - 1)
    a, b = a[:len(a) - low], b[:len(b) - low]
    if not a or not b:
        return len(a) + len(b) <= edits
    band = (1 << (2 * edits + 1)) - 1
    reached = [1 << edits]
    for _ in range(edits):
        reached.append(reached[-1] | (reached[-1] << 1))
    for j, char in enumerate(b):
        same = 0
        for d in range(max(0, edits - j), min(2 * edits + 1, len(a) - j + edits)):
            if a[j + d - edits] == char:
                same |= 1 << d
        new = [reached[0] & same]
        for e in range(1, edits + 1):
            new.append(((reached[e] & same) | reached[e - 1] | (reached[e - 1] >> 1) | (new[e - 1] << 1)) & band)
        reached = new
        if not reached[edits]:
            return False
    at = len(a) - len(b) + edits
    return any(r >> at & 1 for r in reached)


def line_hash(line: str) -> int:
    value = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


class Plans:
    """For a length: which (begin, size, i, l) of its substrings are keys, as index (own length) and as probe."""

    def __init__(self) -> None:
        self.made: dict[int, np.ndarray] = {}

    def of(self, length: int) -> np.ndarray:
        if length not in self.made:
            rows = []
            for short in range(max(0, length - EDITS[0][1]), length + 1):
                t = edits_of(short)
                if t and length - short <= t:
                    for i, (begin, size) in enumerate(segments(short, t)):
                        rows += [(begin + s, size, i, short, s == 0 and short == length) for s in shifts(t, i, length - short) if 0 <= begin + s <= length - size]
            self.made[length] = np.array(rows, np.int64).reshape(-1, 5)
        return self.made[length]


class Keys:
    """Keys of many lines at once, by prefix hashes."""

    def __init__(self) -> None:
        self.plans = Plans()
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            self.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE, np.uint64))])
            self.inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))])

    def of(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all lines one after another, and how many each has. An index key equals the probe that finds it."""
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        lengths = np.fromiter(map(len, lines), np.int64, len(lines))
        starts = np.cumsum(lengths) - lengths
        self._grow(len(codes) + 1)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * self.powers[: len(codes)])])
        plans = [self.plans.of(n) for n in lengths.tolist()]
        counts = np.fromiter(map(len, plans), np.int64, len(plans))
        if not counts.sum():
            return np.zeros(0, np.int64), counts
        plan = np.concatenate(plans)
        begin = np.repeat(starts, counts) + plan[:, 0]
        own = (prefix[begin + plan[:, 1]] - prefix[begin]) * self.inverse[begin]
        mixed = (own ^ (plan[:, 3].astype(np.uint64) * np.uint64(64) + plan[:, 2].astype(np.uint64)) * np.uint64(_MIX)) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        return mixed.view(np.int64), counts

    def indexed(self, line: str) -> np.ndarray:
        """Which keys of a line are of its own segments."""
        return self.plans.of(len(line))[:, 4].astype(bool)


def _line_slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[str]]:
    """Lines that aren't blank, in lists of bounded size; a very long line is alone."""
    held: list[str] = []
    size = 0
    for batch in batches:
        for text in batch.column(column):
            for line in (text.as_py() or "").split("\n"):
                if not line or line.isspace():
                    continue
                held.append(line)
                size += len(line)
                if size >= SLICE_CHARS:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, met = Keys(), set()
    for lines in _line_slices(batches, 0):
        fresh = {}
        for line in lines:
            h = line_hash(line)
            if h not in met:
                fresh[h] = line
        if len(met) > 500_000:
            met.clear()
        met.update(fresh)
        if fresh:
            own, counts = keys.of(list(fresh.values()))
            yield batches_of({"key": own, "line": np.repeat(np.fromiter(fresh, np.int64, len(fresh)), counts)}, _KEYS)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key and line: the different lines of keys that have two or more."""
    last_key = last_line = last_first = None
    told = False  # whether the key's first line has been passed on
    for batch in batches:
        key, line = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        before_key = np.concatenate([[key[0] if last_key is None else last_key], key[:-1]])
        before_line = np.concatenate([[line[0] if last_line is None else last_line], line[:-1]])
        same = key == before_key
        if last_key is None:
            same[0] = False
        other = same & (line != before_line)  # a further line of the key
        first = ~same
        group = np.cumsum(first)
        crowded = np.bincount(group[other], minlength=group[-1] + 1) > 0
        out_key, out_line = [key[other], key[first & crowded[group]]], [line[other], line[first & crowded[group]]]
        if last_key is not None and crowded[0] and not told:
            out_key.append(np.array([last_key]))
            out_line.append(np.array([last_first]))
        told = bool(crowded[group[-1]]) or (group[-1] == 0 and told)
        if group[-1] > 0:
            last_first = line[np.flatnonzero(first)[-1]]
        last_key, last_line = key[-1], line[-1]
        yield batches_of({"key": np.concatenate(out_key), "line": np.concatenate(out_line)}, _KEYS)


def _texts_of(marks: bytes):
    """Lines whose hash is marked; marks of other lines may let more through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines in _line_slices(batches, 0):
            own = {line_hash(line): line for line in lines}
            hashes = np.fromiter(own, np.int64, len(own))
            keep = is_marked(hashes, marks)
            yield batches_of({"line": hashes[keep], "text": [t for t, k in zip(own.values(), keep.tolist()) if k]}, _LINES)

    return run


def _profile(lines: list[str]) -> np.ndarray:
    """Counts of characters in 32 classes: an edit changes two of them by one at most."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(lines)), np.fromiter(map(len, lines), np.int64, len(lines)))
    return np.bincount(row * 32 + (codes & 31), minlength=32 * len(lines)).reshape(-1, 32).astype(np.int32)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside cells: rows sorted by cell, with key, side (0: first block, 1: second, 2: both), line number, text and rank. ``best``: the least rank near a line."""
    keys = Keys()
    last, members = None, []
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def keys_of(number: int, text: str) -> tuple[np.ndarray, np.ndarray]:
        if number not in known:
            if len(known) > 50_000:
                known.clear()
            known[number] = (keys.of([text])[0], keys.indexed(text))
        return known[number]

    def compare() -> pa.RecordBatch | None:
        key = last[0]
        numbers, texts, sides = [m[0] for m in members], [m[1] for m in members], np.array([m[2] for m in members])
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        profile = _profile(texts)
        n, up = np.zeros(len(members), np.int64), list(range(len(members)))
        ranks = [m[3] for m in members]
        best = [_LAST] * len(members)

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for i in range(len(members) - 1):
            # each pair of a cell once: both in a cell of one block, one of each in a cell of two
            rest = np.arange(i + 1, len(members))
            rest = rest[(sides[rest] == 2) | (sides[rest] != sides[i])]
            short = np.minimum(lengths[rest], lengths[i])
            most = np.where(short >= EDITS[0][0], EDITS[0][1], np.where(short >= EDITS[1][0], EDITS[1][1], 0))
            rest = rest[(np.abs(lengths[rest] - lengths[i]) <= most) & (np.abs(profile[rest] - profile[i]).sum(axis=1) <= 2 * most)]
            for j in rest.tolist():
                a, b = (i, j) if (lengths[i], numbers[i]) <= (lengths[j], numbers[j]) else (j, i)
                if not near(texts[a], texts[b], edits_of(int(lengths[a]))):
                    continue
                (ka, own_a), (kb, own_b) = keys_of(numbers[a], texts[a]), keys_of(numbers[b], texts[b])
                common = set(ka[own_a].tolist()) & set(kb.tolist())
                if lengths[a] == lengths[b]:
                    common |= set(kb[own_b].tolist()) & set(ka.tolist())
                if min(common) == key:
                    n[a] += 1
                    n[b] += 1
                    best[a], best[b] = min(best[a], ranks[b]), min(best[b], ranks[a])
                    up[max(root(a), root(b), key=numbers.__getitem__)] = min(root(a), root(b), key=numbers.__getitem__)
        has = np.flatnonzero(n)
        if len(has):
            return batches_of({"line": [numbers[i] for i in has], "n": n[has], "root": [numbers[root(i)] for i in has], "best": [best[i] for i in has]}, _LINKS)
        return None

    for batch in batches:
        for key, left, right, side, number, text, rank in zip(*(c.to_pylist() for c in batch.columns)):
            if (key, left, right) != last:
                if len(members) > 1 and (out := compare()):
                    yield out
                last, members = (key, left, right), []
            members.append((number, text, side, rank))
    if len(members) > 1 and (out := compare()):
        yield out


def near_links(docs: DataFrame, staying: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(number, line, text, rank): the lines that may be near another one, and (line, n, root, best): per cell, how many links each has, its component and
    the least rank among the lines near it.

    ``docs``: one text column. Ranks are a fixed shuffle of the lines; those of lines in ``staying`` (line) are negative, so they come first.
    """
    keyed = short_batches(docs).mapInArrow(tidied(_key_rows), "key long, line long").repartition("key").sortWithinPartitions("key", "line")
    shared = saved(keyed.mapInArrow(_shared, "key long, line long"), "line-keys")
    texts = docs.mapInArrow(tidied(_texts_of(bit_marks(shared, "line", FILTER_BITS))), "line long, text string").groupBy("line", "text").agg(F.lit(1).alias("one"))
    texts = texts.join(shared.select("line").distinct(), "line", "left_semi")
    rank = F.xxhash64("text").bitwiseAND(F.lit(_LAST - 1))
    if staying is not None:
        texts = texts.join(staying.select("line", F.lit(True).alias("stays")), "line", "left")
        rank = F.when(F.col("stays"), -1 - rank).otherwise(rank)
    texts = saved(texts.select(F.monotonically_increasing_id().alias("number"), "line", "text", rank.alias("rank")), "line-texts")
    sizes = shared.groupBy("key").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("blocks"))
    member = shared.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = member.select("key", "line", "block", other.alias("other")).select(
        "key", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"), "line")
    rows = cells.join(texts, "line").select("key", "left", "right", "side", "number", "text", "rank").repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")
    return texts, saved(rows.mapInArrow(tidied(_linked), "line long, n long, root long, best long"), "line-links")


def near_staying(docs: DataFrame) -> DataFrame:
    """(h): md5 of the lines that go, each near a line that stays. ``docs``: one text column.

    Lines are ranked by a shuffle. In a round every line whose rank is the least among the lines near it stays, and a line goes if the least rank near it is that of a line
    that stays; the others, few after a round or two, meet again together with the lines that stay. In the end no two lines that stay are near each other. A shuffle
    needs about as many rounds as a table of lines has digits, however long the chains of near lines are.
    """
    lines, staying, gone = docs, None, []
    while True:
        texts, links = near_links(lines, staying)
        least = links.groupBy(F.col("line").alias("number")).agg(F.min("best").alias("best"))
        met = texts.join(least, "number").withColumn("stays", (F.col("rank") < 0) | (F.col("rank") < F.col("best")))
        met = saved(met.select("line", "text", "rank", "best", "stays"), "line-round")
        ranks = met.where("stays").select(F.col("rank").alias("best")).distinct()
        goes = met.where("not stays").join(ranks, "best", "left_semi")
        gone.append(saved(goes.select("line", F.unhex(F.md5("text")).alias("h")), "lines-gone"))
        open_ = met.where("not stays").join(gone[-1].select("line"), "line", "left_anti")
        if open_.isEmpty():
            break
        # only a line that stays and is near an open one matters further, and it is among those that were met
        kept = met.where("stays")
        lines, staying = saved(open_.select("text").unionByName(kept.select("text")), "lines-open"), kept.select("line")
    out = gone[0]
    for more in gone[1:]:
        out = out.unionByName(more)
    return out.select("h")


def _occurrences(docs: DataFrame) -> DataFrame:
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.regexp_like("line", F.lit(r"\S")))
    return lines.select("doc_id", "th", "line_no", F.unhex(F.md5("line")).alias("h"))


def line_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, class_doc, class_line, n_links, kept): one row per line that isn't blank.

    A class is what lines reach over near lines; it is named by its first line in order of (doc_id, line number), which alone is kept. n_links: the
    number of other different lines near this one. Null and empty texts have no lines; documents without doc_id are left out, as
    the order gives them no place; of rows that repeat a doc_id, lines with the same number are one place. Other columns are not read.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    places = saved(_occurrences(docs), "line-places")
    first = places.groupBy("h").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    texts, links = near_links(docs.select("text"))
    counts = links.groupBy(F.col("line").alias("number")).agg(F.sum("n").alias("n_links"))
    roots = components(links.select("line", "root")).withColumnRenamed("node", "number")
    linked = texts.select("number", F.unhex(F.md5("text")).alias("h")).join(counts, "number").join(roots, "number").join(first, "h")
    linked = saved(linked.select("h", "root", "first", "n_links"), "line-classes")
    named = linked.join(linked.groupBy("root").agg(F.min("first").alias("class")), "root").select("h", "class", "n_links")
    classes = first.join(named, "h", "left").select("h", F.coalesce("class", "first").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = places.join(saved(classes, "line-names"), "h")
    return out.select("doc_id", "line_no", F.col("class.doc_id").alias("class_doc"), F.col("class.line_no").alias("class_line"), "n_links",
                      (F.struct("doc_id", "line_no") == F.col("class")).alias("kept"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without repeated lines; all rows and columns stay, a null text stays null, blank lines stay.

    Of equal lines the first in order of doc_id, text and line number stays. Of different lines that are near each other one goes only if it is near one that stays, so of a family of
    lines that differ a little from one to the next, like numbered ones, as many stay as are not near each other. Which ones is a fixed shuffle of the texts. Rows without doc_id keep all
    lines; rows that repeat a doc_id and text lose the same lines. The columns of ``docs`` may have any names.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    places = saved(_occurrences(own), "line-places")
    at = F.struct("doc_id", "th", "line_no")
    near_gone = saved(near_staying(own.select("text")).distinct(), "lines-near").withColumn("near", F.lit(True))
    first = saved(places.groupBy("h").agg(F.min(at).alias("first"), F.count("*").alias("n")).join(near_gone, "h", "left").where("near or n > 1"), "lines-first")
    lost = places.join(first, "h").where(F.col("near") | (at != F.col("first")))
    # a row of digits, 1 for each line that goes; made before the join, so once a text
    numbers = F.sort_array(F.collect_set("line_no"))
    digits = F.transform(F.col("numbers"), lambda n, i: F.concat(F.repeat(F.lit("0"), n - F.when(i > 0, F.col("numbers")[i - 1] + 1).otherwise(0)), F.lit("1")))
    d, t, g = fresh(docs, 3)
    gone = lost.groupBy("doc_id", "th").agg(numbers.alias("numbers")).select(F.col("doc_id").alias(d), F.col("th").alias(t), F.array_join(digits, "").cast("binary").alias(g))
    joined = docs.join(saved(gone, "lines-lost"), (F.col(doc_id).cast("long") == F.col(d)) & (F.xxhash64(F.col(text)) == F.col(t)), "left")
    kept = F.filter(F.split(F.col(text), "\n"), lambda _, i: F.substring(F.col(g), i + 1, F.lit(1)) != F.lit(bytearray(b"1")))
    return joined.withColumn(text, F.when(F.col(g).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).select(*docs.columns)
