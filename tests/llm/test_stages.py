"""What the pipeline's stages keep: lines that nothing near stands for, code-switched texts, and columns of any name."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import distance, edited
from wardline.llm import language_crf, line_edits, mixing, near_copies

ODD = ["_0", "_1", "_2", "_3", "_4", "_gone", "_gone_doc", "_gone_text", "_d", "_s", "_t", "_copies", "_copy", "h", "th", "line_no", "number", "node", "root", "part", "near", "first"]


def near(a, b):
    t = line_edits.edits_of(min(len(a), len(b)))
    return a != b and abs(len(a) - len(b)) <= t and distance(a, b) <= t


def lines_of(df):
    return [x for r in df.collect() for x in (r["text"] or "").split("\n") if x.strip()]


@pytest.mark.parametrize("cell", [64])
def test_a_line_goes_only_if_near_one_that_stays(spark, cell, monkeypatch):
    monkeypatch.setattr(line_edits, "CELL_ROWS", cell)
    numbered = [f"Invoice number {i:05d} was paid in full by the customer" for i in range(400)]
    rng, chain = np.random.default_rng(3), ["a chain of lines, each of them one or two edits from the last"]
    for _ in range(30):
        chain.append(edited(rng, chain[-1], 2))
    texts = [*numbered, *chain, "tiny", "tiny", "a line on its own that nothing is like"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    kept = lines_of(line_edits.without_repeats(df))
    assert len(kept) == len(set(kept)) and set(kept) <= set(texts) and {"tiny", "a line on its own that nothing is like"} <= set(kept)
    assert all(any(near(t, k) for k in kept) for t in set(texts) - set(kept))  # what went is near what stays
    assert not any(near(a, b) for i, a in enumerate(kept) for b in kept[:i])  # and nothing that stays is near another
    assert sum(k.startswith("Invoice") for k in kept) >= 4
    assert sorted(lines_of(line_edits.without_repeats(df.repartition(2)))) == sorted(kept)


def test_equal_lines_within_long_documents(spark):
    words = [f"line {i} of a long document with many short lines" for i in range(3000)]
    rows = [(1, "\n".join(words)), (2, "\n".join([*words[::-1], "", "new"])), (3, None), (4, ""), (None, words[0])]
    got = {r["doc_id"]: r["text"] for r in line_edits.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] == "\nnew" and got[3] is None and got[4] == "" and got[None] == words[0]
    assert set(got[1].split("\n")) <= set(words)


def test_code_switched_texts_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    by_lang = {}
    for r in sorted(docs.where("text is not null and lang is not null").collect()):
        by_lang.setdefault(r["lang"], []).extend(r["text"].split()[:40])
    mixed = " ".join(" ".join(w[:120]) for w in by_lang.values())
    assert len(by_lang) == 4
    extra = spark.createDataFrame([(10**6, mixed, None, None, 1), (10**6 + 1, "... 123 --", None, None, 1), (10**6 + 2, None, None, None, 1)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    kept = {r["doc_id"] for r in language_crf.accepted(docs.unionByName(extra)).select("doc_id").collect()}
    assert 10**6 in kept and not {10**6 + 1, 10**6 + 2} & kept
    clean = {r["doc_id"] for r in docs.collect() if r["text"] and any(map(str.isalpha, r["text"]))}
    assert clean <= kept


def test_columns_of_any_name(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(i, f"{text} {i}\n{text}", "en", f"s{i % 3}", *(f"keep {i} {c}" for c in ODD)) for i in range(9)]
    rows += [rows[0], (None, text, None, None, *["x"] * len(ODD))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in ODD))
    for stage in (line_edits.without_repeats, near_copies.without_copies, mixing.repeated, language_crf.accepted):
        out = stage(docs)
        assert out.columns == docs.columns, stage
        found = {r["doc_id"]: r for r in out.collect()}
        assert found and all(r[c] == f"keep {d} {c}" for d, r in found.items() if d is not None for c in ODD), stage
        assert stage(docs.where(F.lit(False))).collect() == []
