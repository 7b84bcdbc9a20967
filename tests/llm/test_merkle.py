"""The Merkle manifest against a plain tree."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from wardline.llm import merkle, queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, grp string, idx int, own int, path string, hash string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(r, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def beside(levels, i):
    for level in levels[:-1]:
        run = i // 8 * 8
        yield "".join(level[run:i]), "".join(level[i + 1:run + 8])
        i //= 8


def wanted(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    trees = {}
    for lang, members in groups.items():
        members.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
        trees[lang] = levels_of([leaf_of(r, r["text"]) for r in members])
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    top, out = levels_of([trees[k][-1][0] for k in langs]), []
    for lang, members in groups.items():
        for i, r in enumerate(members):
            path, text = [*beside(trees[lang], i), *beside(top, langs.index(lang))], r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf_of(r, text)
            for left, right in path:
                node = digest(left + node + right)
            out.append((r["doc_id"], trees[lang][0][i], trees[lang][-1][0], top[-1][0], digest("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def tables():
    texts = [None, "", "A", "a", "Él Å ñandú", "漢字" * 400, "MiXed " * 20_000]
    odd = [(i, texts[i % 7], [None, "en", "é", "e", "z", "\U0001F600"][i % 6], None if i % 5 == 0 else "s", i, "g", 1, 2, "p", "h") for i in range(23)]
    odd += [odd[3], odd[3], (None, "x", "en", "s", 1, *odd[0][5:]), (None, "X", "en", "s", 1, *odd[0][5:]), (3, "another", odd[3][2], "s", None, *odd[0][5:]), (-4, "Less", "en", "s", 0, *odd[0][5:])]
    many = [(i, f"Text {i}", "en" if i % 50 else "xx", "s", i, "g", 1, 2, "p", "h") for i in range(4700)]  # two steps of blocks, and a last block that is not full
    groups = [(i, "T", f"lang{i // 2}", "s", i, "g", 1, 2, "p", "h") for i in range(1400)]  # the tree of groups has two steps
    return {"odd": odd, "one": odd[1:2], "nine": many[1:10], "block": many[1:513], "many": many, "groups": groups}


@pytest.mark.parametrize("name", ["odd", "one", "nine", "block", "many", "groups"])
def test_manifest(spark, tmp_path, name):
    docs = spark.createDataFrame(tables()[name], COLUMNS).repartition(5)
    path = str(tmp_path / "documents.parquet")
    docs.write.parquet(path)
    got = sorted((tuple(r) for r in queries.op11_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)
    assert got == wanted([r.asDict() for r in docs.collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert sorted(con.execute(queries.oracle_sql()["op11_merkle_manifest"]).fetchall(), key=repr) == got


def test_manifest_of_nothing(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op11_merkle_manifest(spark, str(tmp_path)).collect() == []


def test_paths_prove_their_leaf_and_no_other(spark):
    docs = spark.createDataFrame(tables()["nine"], COLUMNS)
    made = merkle.manifest(docs, [F.col("text")], group=F.lit(None).cast("string"), order=F.col("doc_id"), kept={"idx": F.col("doc_id"), "path": F.col("text")})
    root = made.root.first()["hash"]
    assert made.subroots.first()["hash"] == root
    found = made.paths.toDF("own_idx", "own_text", "leaf", "subroot", "root", "path").select("leaf", "root", merkle.folded(F.col("leaf"), F.col("path")).alias("f"), merkle.folded(F.sha2("leaf", 256), F.col("path")).alias("g"))
    assert all(r["f"] == r["root"] == root != r["g"] for r in found.collect())
