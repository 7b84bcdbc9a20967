"""Suffix trees and periodic runs against plain searches."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardline.llm import queries, word_runs
from wardline.llm.suffix_tree import SuffixTree

COLUMNS = "doc_id long, text string, lang string, runs string, k0 int, collapsed int, n int, words string"


def plain_runs(words, least):
    """Every period by itself: stretches whose words equal those a period further on."""
    n, out = len(words), []
    for period in range(1, n // 2 + 1):
        i = 0
        while i + period < n:
            j = i
            while j + period < n and words[j] == words[j + period]:
                j += 1
            length = j + period - i
            if j > i and length >= max(least, 2 * period) and not any(words[i:i + length - d] == words[i + d:i + length] for d in range(1, period)):
                out.append((i, length, period))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def wanted(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words, 12)
    gone = {x for s, length, p in runs for x in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for x, w in enumerate(words) if x not in gone).encode()).hexdigest())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60), st.integers(0, 10 ** 6))
def test_extensions(symbols, seed):
    tree, n = SuffixTree(symbols), len(symbols)
    assert np.argsort(tree.place).tolist() == sorted(range(n + 1), key=lambda i: symbols[i:])
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, n + 1, 50), rng.integers(0, n + 1, 50)
    a, b = a[a != b], b[a != b]
    if len(a):
        want = [next((k for k in range(n + 1) if max(i, j) + k >= n or symbols[i + k] != symbols[j + k]), 0) for i, j in zip(a.tolist(), b.tolist())]
        assert tree.extensions(a, b).tolist() == want


def looped(rng, n, kinds, loops):
    words = [int(x) for x in rng.integers(1, kinds + 1, n)]
    for _ in range(loops):
        a, p = int(rng.integers(0, n)), int(rng.integers(1, 9))
        for i in range(a + p, min(n, a + int(rng.integers(5, 50)))):
            words[i] = words[i - p]
    return words


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs(least):
    rng = np.random.default_rng(least)
    for _ in range(300):
        words = looped(rng, int(rng.integers(1, 90)), int(rng.choice([1, 2, 4, 40])), int(rng.integers(0, 4)))
        assert [tuple(r) for r in word_runs.runs(words, least).tolist()] == plain_runs(words, max(2, least))


def test_long_runs_in_linear_space():
    assert word_runs.runs([1] * 100_000).tolist() == [[0, 100_000, 1]]
    block = random.Random(1).sample(range(1, 5000), 3000)
    assert word_runs.runs([7000] + block * 9 + block[:100]).tolist() == [[1, 27_100, 3000]]


def texts():
    rng = np.random.default_rng(9)
    out = [None, "", " \t\n", "one", "a b " * 6, "a b " * 5 + "a", "x " * 12, "x " * 11, "漢 字\x0b" * 30, "no\xa0break no\xa0break " * 10, "w\x1cw w\x85w " * 9, "x " * 40_000]
    out += [" ".join(f"w{x}" for x in looped(rng, int(rng.integers(1, 400)), int(rng.choice([2, 5, 90])), int(rng.integers(0, 6)))) for _ in range(150)]
    return out + ["the same line of eight words repeats here\n" * k for k in range(1, 6)]


def test_query(spark, tmp_path):
    rows = [(i, t, "en", "r", 1, 2, 3, "w") for i, t in enumerate(texts())]
    rows += [rows[4], rows[4], (None, "z " * 30, None, None, None, None, None, None), (4, "another text " * 7, "en", None, 1, 1, 1, "x"), (-10, texts()[40], "en", None, 1, 1, 1, "x")]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    small = {(r[0], r[1]): wanted(*r[:2]) for r in rows if r[0] != 11}
    assert [r for r in got if r[0] != 11] == sorted((small[r[0], r[1]] for r in rows if r[0] != 11), key=repr)
    assert [r[:6] for r in got if r[0] == 11] == [(11, 1, 0, 40_000, 1, 40_000_000)]


def test_tables_without_rows_and_kept_columns(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert word_runs.periodic_runs(none, F.col("text"), {"doc_id": F.col("doc_id")}).collect() == []
    one = spark.createDataFrame([(1, "a b c " * 5, "en", "r", 7, 2, 3, "w")], COLUMNS)
    row = word_runs.periodic_runs(one, F.col("text"), {"words": F.col("words"), "k0": F.col("k0")}).first()
    assert (row["words"], row["k0"], row["collapsed"], [tuple(r) for r in row["runs"]]) == ("w", 7, "a b c", [(0, 15, 3)])
