"""The pipeline's stages, each against a plain version of what it decides on its own input."""

import re

import duckdb
import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_near_copies import wanted
from tests.llm.test_operators import plain, rows
from wardline.llm.common import saved


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = saved(stage(spark, before, sf), "test-stage")
        old, new = before.collect(), after.collect()
        if k < 4:
            assert after.columns == columns
        if name.startswith("language"):
            assert {r["doc_id"] for r in new} == {r["doc_id"] for r in old if r["text"] and any(map(str.isalpha, r["text"]))}
        elif name.startswith("line"):
            assert [r["doc_id"] for r in sorted(new)] == [r["doc_id"] for r in sorted(old)]
            lines = [x for r in new for x in r["text"].split("\n") if x.strip()]
            assert len(lines) == len(set(lines)) and set(lines) <= {x for r in old for x in r["text"].split("\n")}
        elif name.startswith("SimHash"):
            groups = wanted([(r["doc_id"], r["text"]) for r in old])
            assert sorted(r["doc_id"] for r in new) == sorted(d for d, c in groups.items() if d == c)
        elif name.startswith("mixing"):
            assert {r["doc_id"] for r in new} <= {r["doc_id"] for r in old}
            assert sum(len(r["text"].split()) for r in new) <= sum(len(r["text"].split()) for r in old)
        else:
            tk = plain("byte_bpe_50k.json")
            ids = {r["doc_id"]: np.array(tk.encode(r["text"], add_special_tokens=False).ids, "<u2") for r in old}
            assert len(new) == len(old) and all(bytes(r["ids"]) == ids[r["doc_id"]].tobytes() for r in new)
        before = after


def test_queries_match_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in entry.oracle_sql().items():
        if re.match(r"op\d", name):
            df, want = entry.queries()[name](spark, sf), con.execute(sql)
            names = [d[0] for d in want.description]
            assert sorted(df.columns) == sorted(names)
            assert rows(df.select(*names)) == sorted(want.fetchall(), key=repr), name
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in entry.queries() if n.startswith("op") and n[2].isdigit()} and "pipeline" in entry.queries()
