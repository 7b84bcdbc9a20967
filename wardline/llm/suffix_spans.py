"""Repeated passages by suffix arrays, built in two stages.

A passage is a string of ``LENGTH`` bytes that starts at two places or more, in one document or several; every byte of every such passage is
removed. Places that cannot matter are put aside first: the smallest hash among the ``GRAM``-byte strings of a passage is its anchor, so
equal passages have equal anchors, and passages in a row with one anchor make a segment. Only anchors met twice are looked at. Equal
segments are one string with a multiplicity; where an anchor has different segments, these are cut out and suffix-sorted, an anchor's
segments together in one shard of bounded size.

Inside a shard the suffixes that are smaller than their successors are sorted directly (by as many bytes as a passage has), the others are
induced: going through the buckets of first bytes in order, each suffix puts the one before it at the head of its bucket. Neighbours
in the array with a common prefix of a passage's length are repeats. An anchor with too many different segments for a shard is decided by the
digests of its passages instead, counted by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, bit_marks, is_marked, saved, short_batches, slices, tidied

LENGTH, GRAM = 200, 40
SHARD_BYTES = 400_000
CROWD = 16_000  # different segments of one anchor that a shard takes
BLOCK_BYTES = 1 << 21  # of one long document at a time
BATCH_CHARS = 600_000
SORT_ROWS = 50_000  # suffixes that are laid out in full at a time
_BASE = 0x100000001B3
_ANCHORS = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("at", pa.int64()), ("size", pa.int32())])
_CUT = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("kinds", pa.int64()), ("bytes", pa.binary())])
_RANGES = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("ranges", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])
_RANGES_SQL = "anchor long, seg long, ranges array<struct<a:int,b:int>>"
_TEXT = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("text", pa.string()), ("n_bytes", pa.int64()), ("sha", pa.string())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


class Hashes:
    """Hashes of any substring of a buffer, from its prefixes."""

    powers, inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray) -> None:
        n = len(data) + 1
        if len(Hashes.powers) < n:
            Hashes.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE, np.uint64))])
            Hashes.inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))])
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * Hashes.powers[: len(data)])])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        own = (self.prefix[end] - self.prefix[begin]) * Hashes.inverse[begin]
        own = (own ^ (own >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return own ^ (own >> np.uint64(29))


def anchored(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, begin, end, anchor hash, segment hash) of all segments of texts in one buffer of less than 2^24 bytes."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none
    hashes = Hashes(data)
    n = len(data) - GRAM + 1
    places = np.arange(n)
    low = np.uint64((1 << 24) - 1)
    grams = hashes.of(places, places + GRAM)
    least = (grams & ~low) | places.astype(np.uint64)  # the leftmost of equals is the smallest
    span, reach = LENGTH - GRAM + 1, 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[: len(least) - (span - reach)], least[span - reach:])  # windows at 0 .. len(data) - LENGTH
    anchor = (least & low).astype(np.int64)
    text = np.repeat(np.arange(len(starts)), ends - starts)
    windows = np.flatnonzero(text[: len(least)] == text[LENGTH - 1:])
    if not len(windows):
        return none, none, none, none, none
    own, at = text[windows], anchor[windows]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (own[1:] != own[:-1])]))
    last = np.append(first[1:] - 1, len(windows) - 1)
    begin, end = windows[first], windows[last] + LENGTH
    return own[first], begin, end, grams[at[first]].view(np.int64), hashes.of(begin, end).view(np.int64)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, ths, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
        for a, b in slices(texts, BATCH_CHARS):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts[a:b]]
            whole = np.frombuffer(b"".join(raw), np.uint8)
            sizes = np.fromiter(map(len, raw), np.int64, b - a)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            if len(whole) < 1 << 22:
                parts = [(0, whole, starts, ends, None)]
            else:  # long texts by blocks that share LENGTH - 1 bytes, so every window is in one of them
                parts = [(s, whole[s:min(s + BLOCK_BYTES + LENGTH - 1, e)], np.array([0]), np.array([min(BLOCK_BYTES + LENGTH - 1, e - s)]), i)
                         for i, (x, e) in enumerate(zip(starts.tolist(), ends.tolist())) for s in range(x, e, BLOCK_BYTES)]
            for shift, data, s, e, owner in parts:
                own, begin, end, anchor, seg = anchored(data, s, e)
                if owner is not None:
                    own = np.full(len(own), owner)
                take = pa.array(own + a)
                yield batches_of({"anchor": anchor, "seg": seg, "doc_id": docs.take(take), "th": ths.take(take), "at": begin + shift - starts[own], "size": end - begin}, _ANCHORS)


def _sorted_directly(padded: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Places in order of the ``depth`` bytes that follow: by the first eight, then runs of equal ones in full."""
    head = np.zeros(len(places), np.uint64)
    for i in range(8):
        head = (head << np.uint64(8)) | padded[places + i]
    order = np.argsort(head, kind="stable")
    places, head = places[order], head[order]
    first = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]])) if len(head) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(head))
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)
    tied = ends - first > 1
    first, ends = first[tied], ends[tied]
    at = 0
    while at < len(first):
        # whole runs, as many as fit; what lies between them stays in place, as it differs in the first eight bytes
        to = max(at + 1, int(np.searchsorted(ends, first[at] + SORT_ROWS, side="right")))
        a, b = first[at], ends[to - 1]
        own = np.ascontiguousarray(rows[places[a:b]]).view(f"S{depth}").ravel()
        places[a:b] = places[a:b][np.argsort(own, kind="stable")]
        at = to
    return places


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """All places of ``data``, in order of at least the ``depth`` bytes that follow; data ends with ``depth`` zero bytes."""
    n = len(data)
    change = np.append(data[1:] != data[:-1], True)
    next_change = np.minimum.accumulate(np.where(change, np.arange(n), n)[::-1])[::-1]
    small = np.append(data, 0)[next_change] < np.append(data, 0)[np.minimum(next_change + 1, n)]
    small[next_change == n - 1] = False  # greater than the empty suffix, which induces the last place
    own = np.flatnonzero(small)
    padded = np.concatenate([data, np.zeros(max(depth, 8), np.uint8)])
    direct = _sorted_directly(padded, own, depth)
    bound = np.searchsorted(data[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[data[-1]].append(np.array([n - 1]))
    out = []
    for byte in range(256):
        large, wave = [], np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        while len(wave):  # those that induce in their own bucket
            large.append(wave)
            before = wave[wave > 0] - 1
            wave = before[data[before] == byte]
        bucket = np.concatenate([*large, direct[bound[byte]:bound[byte + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[data[before] > byte]
        if len(before):
            to = data[before]
            order = np.argsort(to, kind="stable")
            before, to = before[order], to[order]
            cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])).tolist()
            for i, j in zip(cuts, [*cuts[1:], len(to)]):
                waiting[to[i]].append(before[i:j])
    return np.concatenate(out)


def repeated_windows(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, the places of windows of ``length`` bytes that stand at another place of any of the segments too."""
    data = np.frombuffer(b"".join(s + b"\0" for s in segments) + b"\0" * length, np.uint8)
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    starts = np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(np.arange(len(segments)), sizes + 1)
    array = suffix_array(data, length)
    array = array[array < len(owner)]
    whole = array + length <= (starts + sizes)[owner[array]]
    array = array[whole]
    rows = np.lib.stride_tricks.sliding_window_view(data, length)
    same = np.concatenate([np.zeros(0, bool), *((rows[array[i:i + 20_000]] == rows[array[i + 1:i + 20_001]][: len(array[i:i + 20_000])] if i + 20_000 < len(array) else rows[array[i:-1]] == rows[array[i + 1:]]).all(axis=1) for i in range(0, len(array) - 1, 20_000))])
    hit = np.zeros(len(array), bool)
    hit[1:] |= same
    hit[:-1] |= same
    found = np.sort(array[hit])
    cut = np.searchsorted(found, starts)
    return [found[i:j] - s for i, j, s in zip(cut, [*cut[1:], len(found)], starts)]


def merged(places: np.ndarray, length: int) -> list[dict[str, int]]:
    """Ranges covered by windows at sorted places."""
    if not len(places):
        return []
    first = np.concatenate([[True], places[1:] > places[:-1] + length])
    last = np.append(np.flatnonzero(first)[1:] - 1, len(places) - 1)
    return [{"a": int(a), "b": int(b)} for a, b in zip(places[first], places[last] + length)]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor; a shard ends where an anchor does."""
    held: list[tuple[int, int, bytes]] = []
    size, last = 0, None

    def flush() -> pa.RecordBatch:
        found = repeated_windows([x[2] for x in held])
        rows = [(a, s, merged(w, LENGTH)) for (a, s, _), w in zip(held, found) if len(w)]
        held.clear()
        return batches_of({"anchor": [r[0] for r in rows], "seg": [r[1] for r in rows], "ranges": [r[2] for r in rows]}, _RANGES)

    for batch in batches:
        for anchor, seg, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if anchor != last and size >= SHARD_BYTES:
                yield flush()
                size = 0
            held.append((anchor, seg, data))
            size += len(data)
            last = anchor
    if held:
        yield flush()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("place", pa.int32()), ("digest", pa.binary())])
    for batch in batches:
        for anchor, seg, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
            n = len(data) - LENGTH + 1
            yield batches_of({"anchor": [anchor] * n, "seg": [seg] * n, "place": range(n), "digest": [hashlib.blake2b(data[i:i + LENGTH], digest_size=16).digest() for i in range(n)]}, schema)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ranges = [merged(np.sort(np.array(p)), LENGTH) for p in batch.column(2).to_pylist()]
        yield batches_of({"anchor": batch.column(0), "seg": batch.column(1), "ranges": ranges}, _RANGES)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(w["anchor"], w["seg"], w["kinds"], data[w["at"]:w["at"] + w["size"]])
                for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for data in [text.encode("utf-8", "surrogatepass")] for w in wanted]
        yield batches_of(dict(zip(_CUT.names, zip(*rows))) if rows else {n: [] for n in _CUT.names}, _CUT)


def _marked_texts(marks: bytes, digest: bool):
    """Texts that may be wanted; with ``digest`` also the others, as what is left of them: all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = is_marked(batch.column(1).to_numpy(), marks)
            if not digest:
                batch = batch.filter(pa.array(wanted))
                yield batches_of({"doc_id": batch.column(0), "th": batch.column(1), "text": batch.column(2), "n_bytes": pa.nulls(batch.num_rows, pa.int64()), "sha": pa.nulls(batch.num_rows, pa.string())}, _TEXT)
                continue
            sizes, shas, texts = [], [], batch.column(2).to_pylist()
            for text, w in zip(texts, wanted.tolist()):
                data = (text or "").encode("utf-8", "surrogatepass")
                sizes.append(len(data))
                shas.append(None if w else hashlib.sha256(data).hexdigest())
            kept = [t if w else None for t, w in zip(texts, wanted.tolist())]
            yield batches_of({"doc_id": batch.column(0), "th": batch.column(1), "text": kept, "n_bytes": sizes, "sha": shas}, _TEXT)

    return run


def spans_of(found: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs covered by ranges of segments; runs that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted((x["at"] + r["a"], x["at"] + r["b"]) for x in found or () for r in x["ranges"]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {n: [] for n in _OUT.names}
        for doc, text, size, sha, found in zip(*(c.to_pylist() for c in batch.columns)):
            spans = spans_of(found)
            if sha is None:
                data, at, digest = (text or "").encode("utf-8", "surrogatepass"), 0, hashlib.sha256()
                for a, b in spans:
                    digest.update(data[at:a])
                    at = b
                digest.update(data[at:])
                sha = digest.hexdigest()
            for name, value in zip(_OUT.names, (doc, size, sum(b - a for a, b in spans), len(spans), sha)):
                rows[name].append(value)
        yield batches_of(rows, _OUT)


def repeated_ranges(rows: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, th, found): per document with any, its segments' starts and the ranges in them to remove. rows: doc_id, th, text."""
    met = saved(short_batches(rows).mapInArrow(tidied(_anchors), "anchor long, seg long, doc_id long, th long, at long, size int"), "anchors")
    twice = saved(met.groupBy("anchor").count().where("count > 1").select("anchor"), "anchors-twice")
    marks = bit_marks(twice, "anchor", 24)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(is_marked(batch.column(0).to_numpy(), marks)))

    places = saved(met.mapInArrow(likely, met.schema).join(twice, "anchor"), "anchor-places")
    segs = places.groupBy("anchor", "seg").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "at", "size")).alias("one"))
    segs = saved(segs, "segments")
    kinds = segs.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    open_segs = segs.join(kinds, "anchor").select("anchor", "seg", "kinds", "n", "one.*")
    wanted = saved(open_segs.groupBy("doc_id", "th").agg(F.collect_list(F.struct("anchor", "seg", "kinds", "at", "size")).alias("wanted")), "segments-wanted")
    texts = rows.mapInArrow(tidied(_marked_texts(bit_marks(wanted, "th", 23), False)), "doc_id long, th long, text string, n_bytes long, sha string").select("doc_id", "th", "text")
    texts = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["th"] == wanted["th"])).select("text", "wanted")
    cut = texts.mapInArrow(tidied(_cut), "anchor long, seg long, kinds long, bytes binary")
    # rows that repeat a document cut the same segment each
    cut = saved(cut, "segments-cut").dropDuplicates(["anchor", "seg"])
    sorted_ranges = cut.where(F.col("kinds") <= crowd).select("anchor", "seg", "bytes").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(tidied(_shards), _RANGES_SQL)
    windows = cut.where(F.col("kinds") > crowd).select("anchor", "seg", "bytes").mapInArrow(_digests, "anchor long, seg long, place int, digest binary")
    more = windows.groupBy("digest").count().where("count > 1").select("digest")
    counted = windows.join(more, "digest").groupBy("anchor", "seg").agg(F.collect_list("place").alias("places")).mapInArrow(_ranges, _RANGES_SQL)
    whole = segs.where("n > 1").select("anchor", "seg", F.array(F.struct(F.lit(0).alias("a"), F.col("one.size").alias("b"))).alias("ranges"))
    ranges = sorted_ranges.unionByName(counted).join(segs.where("n > 1").select("anchor", "seg"), ["anchor", "seg"], "left_anti").unionByName(whole)
    return places.join(saved(ranges, "segment-ranges"), ["anchor", "seg"]).groupBy("doc_id", "th").agg(F.collect_list(F.struct("at", "ranges")).alias("found"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of ``docs``.

    Null and empty texts have 0 bytes. Texts shorter than a passage keep all. Rows that repeat a doc_id are documents of their own; equal rows lose
    the same bytes. A null doc_id stays null. No documents give no rows; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    found = saved(repeated_ranges(rows, crowd), "found-spans")
    texts = rows.mapInArrow(tidied(_marked_texts(bit_marks(found, "th", 23), True)), "doc_id long, th long, text string, n_bytes long, sha string")
    joined = texts.join(found, texts["doc_id"].eqNullSafe(found["doc_id"]) & (texts["th"] == found["th"]), "left")
    return joined.select(texts["doc_id"], "text", "n_bytes", "sha", "found").mapInArrow(tidied(_removed), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
