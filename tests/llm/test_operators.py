"""The ten operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and odd columns."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wardline.llm import chunk_bpe, components, embedding_tiles, kd_search, language_crf, line_edits, mixing, simhash, suffix_spans, token_files, url_rules
from wardline.llm.encoders import load_tokenizer
from wardline.llm.queries import RULES, tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, part int, taken long"
LONG = " ".join(f"word{i % 977} und  más {i}" for i in range(9000))
TEXTS = [None, "", " ", "...", "Hello world, it's fine.", "Hello world, it's fine.", "don't <|endoftext|> stop", "漢字" * 300, "tab\tand\x85odd\x1c white\xa0space", LONG, LONG[:-5] + "x",
         "a line that is long enough to be near\nshort\nanother line of some length here", "a line that is long enougth to be near\nshort\nsomething else entirely, unlike the rest"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "de", (None, "s1", "é", "s2")[i % 4], None, "x", 1, 2) for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "no id", None, None, None, None, None, None), (4, "same id, other text", "en", "s1", 1, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file(name))


def test_token_files(docs, none, spark, tmp_path):
    want, at, tk = [], 0, plain("word_bpe_49k.json")
    own = sorted(((r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").collect()), key=lambda x: (x[0], x[1] is not None, x[1]))
    for d, t in own:
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert rows(token_files.packed_documents(docs, tokenizer_file("word_bpe_49k.json"))) == sorted(want, key=repr)
    assert rows(token_files.packed_documents(none, tokenizer_file("word_bpe_49k.json"))) == []


@pytest.mark.parametrize("bits", [1, 5, 11, 16, 17, 20])
def test_packing_round_trip_and_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 3 * token_files.GRAIN + 77).astype(np.uint32)
    data = token_files.pack(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8)
    for a, b in ((0, len(ids)), (5, 6), (token_files.GRAIN - 3, token_files.GRAIN + 9), (2 * token_files.GRAIN, len(ids))):
        assert (token_files.unpack(data, bits, a, b) == ids[a:b]).all()


def test_chunk_bpe(docs, none):
    tk, want = plain("byte_bpe_50k.json"), []
    for r in docs.collect():
        ids = tk.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows(chunk_bpe.encoded_documents(docs, tokenizer_file("byte_bpe_50k.json"))) == sorted(want, key=repr)
    assert rows(chunk_bpe.encoded_documents(none, tokenizer_file("byte_bpe_50k.json"))) == []


def test_chunk_joins_agree_with_the_library():
    rng = np.random.default_rng(5)
    parts = ["a", "the", "x'", " ", "  ", "\n", "\t", "é", "ß", "漢字", "123", "!!", "<|endoftext|>", "'re", "\x1c", "\x85", "é", "\u3000", "🎉"]
    spec = open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8").read()
    encoder, tk = chunk_bpe.ChunkEncoder(spec, chunk_limit=50), load_tokenizer(spec)
    for _ in range(60):
        texts = ["".join(rng.choice(parts, rng.choice([0, 1, 5, 300, 900]))) for _ in range(8)] + ["字" * int(rng.integers(500)), "y" * int(rng.integers(900))]
        ids, counts = encoder.encode(texts)
        want = [e.ids for e in tk.encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_url_rules(spark):
    hosts = ["net", "example.net", "a.example.net", "xexample.net", "Example.COM", "b.c.example.com", "org", "x.org", "", "a..net", "[::1]"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en", "/en/", "/en/x?y", "/de/#z", "/fr/q", "?/en/", "//")] + [None, "", "net/", "ftp://net/a://b"]
    pages = spark.createDataFrame([(i // 2, u, "h", "r") for i, u in enumerate(urls)], "page_id int, url string, host string, rule string")
    rules = spark.createDataFrame([*RULES, ("example.net", "", "block"), ("net", "/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    known = {(h, p): v for h, p, v in [*RULES, ("example.net", "", "block")]}

    def judge(i, u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
        host, path = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
        fit = [(len(h + p), len(h), h + p, v) for (h, p), v in known.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (i, host, path, max(fit)[2] if fit else None, max(fit)[3] if fit else "allow")

    assert rows(url_rules.judged(pages, rules)) == sorted((judge(i // 2, u) for i, u in enumerate(urls)), key=repr)
    assert rows(url_rules.judged(pages.limit(0), rules)) == []
    assert {r["verdict"] for r in url_rules.judged(pages, rules.limit(0)).collect()} == {"allow"}


def vectors(spark, n=300, d=7):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, d))
    x[100:200] = x[5] * rng.uniform(0.5, 2, (100, 1)) + rng.normal(size=(100, d)) * 0.02
    x[200:230] = x[7]
    found = [(i, v.tolist(), "k") for i, v in enumerate(x)]
    odd = [(1000, None, "k"), (1020, [], "k"), (1001, [0.0] * d, "k"), (1002, [float("nan")] * d, "k"), (1003, [None] * d, "k"), (1004, [1.0], "k"), (1005, [float("inf")] + [0.0] * (d - 1), "k")]
    return spark.createDataFrame(found + odd, "vec_id long, embedding array<double>, label string"), dict((i, v) for i, v, _ in found)


@pytest.mark.parametrize("tile_rows", [64, 8192])
def test_embedding_tiles(spark, tile_rows):
    df, good = vectors(spark)
    ids = sorted(good)
    unit = np.array([good[i] for i in ids])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    label = components.merge_labels(np.arange(len(ids)), *np.nonzero(near))
    want = {i: (int(near[k].sum()), int(label[k]), bool(label[k] == k)) for k, i in enumerate(ids)}
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_tiles.near_duplicates(df, tile_rows=tile_rows).collect()}
    assert got == want | {i: (0, i, True) for i in (1000, 1001, 1002, 1003, 1004, 1005, 1020)}
    assert sum(x[0] for x in want.values()) > 5000
    assert embedding_tiles.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("shard_rows", [50, 8192])
def test_kd_search(spark, shard_rows):
    df, good = vectors(spark)
    good = good | {1004: [1.0]}
    code = {i: [int(np.floor(64 * x)) for x in v] for i, v in good.items()}
    want = []
    for q in sorted(i for i in code if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(code[q], v)), i) for i, v in code.items() if i != q and len(v) == len(code[q]))[:20]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert rows(kd_search.top_k(df, shard_rows=shard_rows, query_rows=7)) == sorted(want, key=repr)
    assert kd_search.top_k(df.limit(0)).collect() == []


def test_mixing(docs, none):
    got = mixing.mixed(docs).collect()
    assert len(got) == docs.count() and rows(mixing.mixed(docs.repartition(5))) == rows(mixing.mixed(docs))
    sizes = {r["source"]: r["source_size"] for r in got}
    assert abs(sum({r["source"]: r["target"] for r in got}.values()) - sum(sizes.values())) < 1e-6
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        assert r["target"] <= 3 * r["source_size"] + 1e-9
    assert sum(r["taken"] for r in got) <= sum(r["size"] for r in got)
    assert mixing.mixed(none).collect() == []
    repeated = Counter((r["doc_id"], r["text"]) for r in mixing.repeated(docs).collect())
    assert mixing.repeated(docs).columns == docs.columns and sum(len(t.split()) * n for (_, t), n in repeated.items()) >= sum(r["taken"] for r in got)


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        before = row
    return before[-1]


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at, kind = int(rng.integers(0, len(out) + 1)), int(rng.integers(3))
        if kind == 0:
            out.insert(at, str(rng.choice(list("abz"))))
        elif at < len(out):
            out[at:at + 1] = [] if kind == 1 else [str(rng.choice(list("abz")))]
    return "".join(out)


def test_near_and_keys_miss_nothing():
    rng, keys = np.random.default_rng(1), line_edits.Keys()
    for _ in range(1500):
        a = "".join(rng.choice(list("ab"), rng.integers(0, 14)))
        b = edited(rng, a, int(rng.integers(0, 5)))
        for t in (0, 1, 2, 3):
            assert line_edits.near(a, b, t) == (distance(a, b) <= t)
        a, = ("".join(rng.choice(list("abcdef"), rng.choice([16, 17, 31, 32, 33, 47]))),)
        a, b = sorted((a, edited(rng, a, int(rng.integers(1, 3)))), key=len)
        if distance(a, b) <= line_edits.edits_of(len(a)):
            assert set(keys.of([a])[0][keys.indexed(a)].tolist()) & set(keys.of([b])[0].tolist())


@pytest.mark.parametrize("cell", [3, 512])
def test_line_classes(spark, docs, none, cell, monkeypatch):
    monkeypatch.setattr(line_edits, "CELL_ROWS", cell)
    rng = np.random.default_rng(4)
    base = ["the quick brown fox jumps over the lazy dog again", "short line of words", "tiny", "a quite different line about nothing much at all"]
    made = [(100 + i, "\n".join([*(edited(rng, str(rng.choice(base)), int(rng.integers(0, 3))) for _ in range(4)), "", "tiny"]), "x") for i in range(25)]
    df = docs.select("doc_id", "text", "lang").where("length(text) < 1000 or text is null").union(spark.createDataFrame(made, "doc_id long, text string, lang string"))
    lines = sorted({(r["doc_id"], i, t) for r in df.collect() if r["doc_id"] is not None for i, t in enumerate((r["text"] or "").split("\n")) if t and not t.isspace()})
    first = {}
    for d, i, t in lines:
        first.setdefault(t, (d, i))
    own = sorted(first)
    near = np.array([[a != b and distance(a, b) <= line_edits.edits_of(min(len(a), len(b))) and abs(len(a) - len(b)) <= 2 for b in own] for a in own])
    label = components.merge_labels(np.arange(len(own)), *np.nonzero(near))
    name = {k: min(first[own[j]] for j in np.flatnonzero(label == k)) for k in set(label.tolist())}
    at = {t: i for i, t in enumerate(own)}
    want = {(d, i, *name[label[at[t]]], int(near[at[t]].sum()), (d, i) == name[label[at[t]]]) for d, i, t in lines}
    got = {tuple(r) for r in line_edits.line_classes(df).collect()}
    assert got == want and near.sum() > 100
    assert line_edits.line_classes(none).collect() == []
    kept = {(r["doc_id"], r["text"]) for r in line_edits.without_repeats(df).collect()}
    assert len(kept) <= df.count() and (0, None) in kept


@pytest.mark.parametrize("crowd,cell", [(256, 2048), (2, 8)])
def test_simhash(spark, docs, none, crowd, cell):
    prints = {}
    for r in docs.collect():
        w = (r["text"] or "").encode().lower().split()
        shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
        bits = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
        prints[r["doc_id"], r["text"]] = format(sum(1 << b for b in range(64) if bits[b] * 2 > len(shingles)), "016x")
    got = simhash.near_duplicates(docs).collect()
    assert sorted(r["fingerprint"] for r in got) == sorted(prints[r["doc_id"], r["text"]] for r in docs.collect())
    assert {r["component_id"] for r in got if r["doc_id"] in (0, 1, 2)} == {0}
    assert simhash.near_duplicates(none).collect() == []
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 62, 40)
    values = np.unique(np.concatenate([values, values[0] ^ (np.int64(1) << rng.integers(0, 62, 60)), values[0] ^ (np.int64(1) << rng.integers(0, 62, 60)) ^ (np.int64(1) << rng.integers(0, 62, 60))]))
    i, j = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= 2)
    label = components.merge_labels(np.arange(len(values)), i, j)
    links = simhash.near_links(spark.createDataFrame([(int(v),) for v in values], "fp long"), crowd=crowd, cell_rows=cell).collect()
    place = {int(v): k for k, v in enumerate(values)}
    assert all(bin(r["a"] ^ r["b"]).count("1") <= 2 or crowd == 2 for r in links)
    mine = components.merge_labels(np.arange(len(values)), np.array([place[r["a"]] for r in links]), np.array([place[r["b"]] for r in links]))
    assert (mine == label).all()


def test_components_over_several_parts(spark):
    rng = np.random.default_rng(8)
    pairs = rng.integers(0, 400, (350, 2))
    label = components.merge_labels(np.arange(400), pairs[:, 0], pairs[:, 1])
    got = dict(tuple(r) for r in components.components(spark.createDataFrame([(int(a), int(b)) for a, b in pairs] + [(None, 1)], "a long, b long"), part_links=40).collect())
    assert got == {i: int(label[i]) for i in set(pairs[pairs[:, 0] != pairs[:, 1]].ravel().tolist())}


def test_language_held_out(spark, sf, docs, none):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    got = language_crf.languages(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert got.count() > 30 and got.where("lang = lang_pred").count() >= 0.97 * got.count()
    odd = {r["doc_id"]: r for r in language_crf.languages(docs).collect()}
    assert all((odd[i]["lang_pred"], odd[i]["score"]) == ("und", 0.0) for i in (0, 1, 2, 3)) and not odd[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in odd.values()) and language_crf.languages(none).collect() == []
    assert {r["lang_pred"] for r in language_crf.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = language_crf.accepted(table)
    assert kept.columns == table.columns and kept.count() >= 0.98 * table.count()


def test_forward_backward_is_exact():
    rng, k = np.random.default_rng(0), 3
    emit, switch, first = rng.uniform(0.1, 1, (5, k)), rng.uniform(0.1, 1, (k, k)), rng.uniform(0.1, 1, k)
    at, lengths = rng.integers(0, 5, 6), np.array([2, 4])
    got, followed = language_crf.forward_backward(lengths, at, emit, switch, first, pairs=True)
    want, pairs, begin = np.zeros((6, k)), np.zeros((k, k)), 0
    for n in lengths:
        total, own, both = 0.0, np.zeros((n, k)), np.zeros((k, k))
        for path in np.ndindex(*[k] * n):
            p = first[path[0]] * np.prod([emit[at[begin + t], x] for t, x in enumerate(path)]) * np.prod([switch[a, b] for a, b in zip(path, path[1:])])
            total += p
            for t, x in enumerate(path):
                own[t, x] += p
            for a, b in zip(path, path[1:]):
                both[a, b] += p
        want[begin:begin + n], begin = own / total, begin + n
        pairs += both / total
    assert np.allclose(got, want) and np.allclose(followed, pairs)


@pytest.mark.parametrize("letters", [1, 2, 4, 250])
def test_suffix_array(letters):
    rng = np.random.default_rng(letters)
    data = np.concatenate([rng.integers(1, letters + 1, 1500).astype(np.uint8), np.zeros(20, np.uint8)])
    array, raw = suffix_spans.suffix_array(data, 20), data.tobytes() + bytes(40)
    heads = [raw[i:i + 20] for i in array]
    assert sorted(array.tolist()) == list(range(len(data))) and heads == sorted(heads)


@pytest.mark.parametrize("crowd", [1, 16_000])
def test_suffix_spans(spark, docs, none, crowd):
    rng = np.random.default_rng(6)
    passage = "".join(rng.choice(list("abc é"), 700))
    made = [(200 + i, edited(rng, passage, i % 3) * (1 + i % 2) + str(i), "x") for i in range(12)]
    df = docs.select("doc_id", "text", "lang").where("length(text) < 5000 or text is null").union(spark.createDataFrame(made, "doc_id long, text string, lang string"))
    own = [(r["doc_id"], (r["text"] or "").encode()) for r in df.collect()]
    seen = Counter(b[i:i + 200] for _, b in own for i in range(len(b) - 199))
    want = []
    for d, b in own:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        runs = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        want.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    assert rows(suffix_spans.without_repeats(df, crowd=crowd)) == sorted(want, key=repr)
    assert suffix_spans.without_repeats(none).collect() == []


def test_long_texts_are_anchored_by_blocks():
    text = "".join(np.random.default_rng(9).choice(list("abcdef"), 4_300_000))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "th": [2], "text": [text]})
    covered = sorted((a, a + n - 199) for b in suffix_spans._anchors(iter([batch])) for a, n in zip(b["at"].to_pylist(), b["size"].to_pylist()))
    assert covered[0][0] == 0 and covered[-1][1] == len(text) - 199 and all(x[1] == y[0] for x, y in zip(covered, covered[1:]))
