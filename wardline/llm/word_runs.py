"""Maximal periodic runs of words, from suffix-tree extensions of Lyndon roots.

A run is a stretch whose words repeat with its smallest period, that neither neighbour continues. Every run holds, at each word where there is
room for one, a Lyndon root: the longest Lyndon word from there, in the order of words or in its reverse. Those end where the next smaller, or
next greater, suffix begins. So each position gives two candidates (i, j) with period j - i; how far the period goes on past j and back before i are
two longest common extensions, in constant time from Ukkonen trees of the words and of their reversal.

Runs of at least LEAST words, and two periods, consist of repeated GRAMs of words in every place. So before any tree is built, numpy marks what repeated
grams of a text cover, then of each covered stretch on its own, until nothing falls away. Only stretches that are left go to the trees. The marks come from
64-bit hashes, whose collisions can only leave more; the trees take the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, tidied
from .suffix_tree import SuffixTree

LEAST = 12  # words of the shortest run
BATCH_CHARS = 4_000_000
RUN = "struct<start: long, length: long, period: long>"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = 0x9E3779B97F4A7C15  # odd, so that it has an inverse in 64 bits


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of ``data`` and the byte at which it begins: polynomials of the bytes, as differences of one running sum."""
    raw = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[raw], [True]))))
    begin, end = edges[::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_ODD, len(raw)), out=sums[1:])
    back = _powers(pow(_ODD, -1, 1 << 64), len(raw) + 1)
    return _mixed((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64)), begin


def _covered(words: np.ndarray, owner: np.ndarray, gram: int) -> np.ndarray:
    """Which words lie in a gram that its owner, a stretch of consecutive words, holds more than once."""
    n = len(words)
    marks = np.zeros(n, bool)
    if n < gram:
        return marks
    grams = words[: n - gram + 1].copy()
    for k in range(1, gram):
        grams = _mixed(grams * np.uint64(3) + words[k: n - gram + 1 + k])
    inside = np.flatnonzero(owner[: n - gram + 1] == owner[gram - 1:])
    keys = _mixed(grams[inside] + owner[inside].astype(np.uint64) * np.uint64(_ODD))
    order = np.argsort(keys, kind="stable")
    equal = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    again = np.zeros(n + 1, np.int64)
    hit = np.zeros(len(keys), bool)
    hit[order[equal]] = hit[order[equal + 1]] = True
    again[inside[hit]] += 1
    np.subtract.at(again, inside[hit] + gram, 1)
    return np.cumsum(again[:n]) > 0


def stretches(words: np.ndarray, owner: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches of ``words`` (hashes), each within one owner, that together hold every run of at least ``least`` words."""
    gram, at = max(1, least // 2), np.arange(len(words))
    while len(at):
        marks = _covered(words[at], owner, gram)
        kept = at[marks]
        fresh = np.ones(len(kept), bool)
        fresh[1:] = (np.diff(kept) > 1) | (np.diff(owner[marks]) != 0)
        piece = np.cumsum(fresh)
        sizes = np.bincount(piece, minlength=1)
        long = sizes[piece] >= least
        same = len(at) == np.count_nonzero(long)
        at, owner = kept[long], piece[long]
        if same:
            break
    if not len(at):
        return []
    edges = np.flatnonzero(np.diff(owner)) + 1
    return list(zip(at[np.concatenate(([0], edges))].tolist(), (at[np.concatenate((edges - 1, [len(at) - 1]))] + 1).tolist()))


def _next_below(rank: list[int]) -> np.ndarray:
    """The next position whose rank is smaller; the end, where there is none."""
    out, open_ = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while open_ and rank[open_[-1]] > r:
            out[open_.pop()] = i
        open_.append(i)
    return np.array(out, np.int64)


def runs(symbols: list[int], least: int = LEAST) -> np.ndarray:
    """All (start, length, period) with length >= max(least, 2 * period) of a list of positive integers, by start, then period."""
    n = len(symbols)
    if n < max(2, least):
        return np.zeros((0, 3), np.int64)
    ahead, behind = SuffixTree(symbols), SuffixTree(symbols[::-1])
    rank, i = ahead.place[:n], np.arange(n)
    smaller, greater = _next_below(rank.tolist()), _next_below((-rank).tolist())
    ends = greater < n  # up to the end only the first order's words are Lyndon; it alone finds the runs that reach the end
    i, j = np.concatenate((i, i[ends])), np.concatenate((smaller, greater[ends]))
    stop = j + ahead.extensions(i, j)
    start = i - behind.extensions(n - i, n - j)  # n - i stands before i in the reversal
    found = np.stack((start, stop - start, j - i), axis=1)
    found = found[(found[:, 1] >= 2 * found[:, 2]) & (found[:, 1] >= least)]
    found = np.unique(found, axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _found(texts: list[str | None], least: int) -> Iterator[tuple[np.ndarray, str]]:
    """Per text its runs and what is left of it."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    words, begin = _word_hashes(b" ".join(parts))
    ends = np.cumsum([len(p) + 1 for p in parts])
    owner = np.searchsorted(ends, begin, side="right")
    offset = np.searchsorted(owner, np.arange(len(parts)))
    found: dict[int, list[tuple[int, int]]] = {}
    for a, b in stretches(words, owner, least):
        k = int(owner[a])
        found.setdefault(k, []).append((a - int(offset[k]), b - int(offset[k])))
    for k, part in enumerate(parts):
        own, all_runs = part.split(), []
        for a, b in found.get(k, ()):
            known: dict[bytes, int] = {}
            got = runs([known.setdefault(w, len(known) + 1) for w in own[a:b]], least)
            got[:, 0] += a
            all_runs.append(got)
        got = np.concatenate(all_runs) if all_runs else np.zeros((0, 3), np.int64)
        if len(got):
            got = got[np.lexsort((got[:, 2], got[:, 0]))]
            drop = np.zeros(len(own) + 1, np.int64)
            np.add.at(drop, got[:, 0] + got[:, 2], 1)
            np.add.at(drop, got[:, 0] + got[:, 1], -1)
            own = [own[x] for x in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
        yield got, b" ".join(own).decode("utf-8", "surrogatepass")


def _run(least: int, carried: int):
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(carried)
            sizes = [len(t) if t is not None else 0 for t in texts.to_pylist()]
            for a, b in slices(sizes, BATCH_CHARS):
                found, collapsed = zip(*_found(texts.slice(a, b - a).to_pylist(), least))
                flat = np.concatenate(found)
                offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, x])) for x in range(3)], fields=list(run_type))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(x).slice(a, b - a) for x in range(carried)), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(collapsed, pa.string())],
                    names=[*batch.schema.names[:carried], "runs", "collapsed"])

    return run


def periodic_runs(rows: DataFrame, text: Column, kept: dict[str, Column], least: int = LEAST) -> DataFrame:
    """Per row what ``kept`` names, ``runs`` (an array of start, length and period in words, by start, then period) and ``collapsed``, the text's words joined
    by one space, without those that some run holds after its first period.

    Words are what stands between white space (space, tab to carriage return). Null, empty and wordless texts have no runs and collapse to an empty text.
    Rows stand alone: repeated ones and null ids are treated like any other; an empty table gives no rows. Columns not named are not read.
    A text's words are held by one task, and trees only over its repetitive stretches.
    """
    chosen = rows.select(*(c.alias(f"k{i}") for i, c in enumerate(kept.values())), text.cast("string").alias("text"))
    types = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(chosen.schema.fields[:-1]))
    out = chosen.mapInArrow(tidied(_run(least, len(kept))), f"{types}, runs array<{RUN}>, collapsed string" if kept else f"runs array<{RUN}>, collapsed string")
    return out.toDF(*kept, "runs", "collapsed")


def dominant(found: Column) -> Column:
    """The run with the greatest length, then the smallest start and period; null without runs."""
    best = F.array_max(F.transform(found, lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.when(best.isNotNull(), F.struct((-best["s"]).alias("start"), best["l"].alias("length"), (-best["p"]).alias("period")))


def listing(found: Column) -> Column:
    """``start,length,period`` of every run, a line each."""
    return F.array_join(F.transform(found, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
