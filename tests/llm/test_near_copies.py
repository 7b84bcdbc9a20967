"""Shingle similarity and the pipeline's near-duplicate stage against brute force."""

import random

import numpy as np
import pytest

from wardline.llm import near_copies, shingle_links, simhash
from wardline.llm.components import merge_labels

DOCS = "doc_id long, text string, node string, size string, keys int, root string"


def shingles(text, words=5):
    parts = (text or "").lower().split()
    return {" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def wanted(docs, distance=None, similarity=0.8):
    """The smallest doc_id of each document's group, by comparing all pairs."""
    docs = sorted(docs)
    sets = [shingles(t) for _, t in docs]
    prints = np.array([simhash.fingerprint(t, 5) for _, t in docs], np.uint64)
    label = np.arange(len(docs))
    for i, a in enumerate(sets):
        near = [j for j in range(i + 1, len(docs)) if docs[i][0] == docs[j][0] or a == sets[j] or len(a & sets[j]) >= similarity * len(a | sets[j])
                or distance is not None and int(np.bitwise_count(prints[i] ^ prints[j])) <= distance]
        label = merge_labels(label, np.full(len(near), i), np.array(near, int))
    return {d: docs[label[k]][0] for k, (d, _) in enumerate(docs)}


def corpus(seed):
    rnd = random.Random(seed)
    fresh = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    texts, passage = [None, "", " \n", "one", "ONE", "two words", "a b c d e", "a b c d e f", "a b c d e f g h", "a b c d e f g h i"], fresh(120)
    for n in (8, 30, 200):
        for _ in range(6):  # chains of edits: the ends are farther apart than neighbours
            words = fresh(n)
            for _ in range(8):
                texts.append(" ".join(words))
                words = list(words)
                for _ in range(max(1, n // 60)):
                    words[rnd.randrange(n)] = f"x{rnd.randrange(10**6)}"
    for k in range(120):  # one passage and something of their own: they meet often, and few are alike
        texts.append(" ".join(passage + fresh(rnd.choice((10, 25, 40, 60)))))
    long = fresh(20_000)
    texts += [" ".join(long), " ".join(long[:-900] + fresh(900)), " ".join(long[:9000])]
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("star_rows, block_hashes", [(1000, 200_000), (3, 2_000)])
def test_similar_documents(spark, star_rows, block_hashes):
    docs = corpus(star_rows)
    rows = [(d, t, "n", "s", 1, "r") for d, t in docs]
    rows += [rows[7], rows[7], (None, "no id", None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = [tuple(r) for r in shingle_links.similar_documents(df, star_rows=star_rows, block_hashes=block_hashes).collect()]
    want = wanted(docs)
    assert len(got) == len(docs) + 2 and dict(got) == want
    assert any(len(shingles(docs[d][1]) & shingles(docs[c][1])) < 0.8 * len(shingles(docs[d][1]) | shingles(docs[c][1])) for d, c in want.items())
    assert shingle_links.similar_documents(spark.createDataFrame([], DOCS)).collect() == []


def test_without_copies(spark):
    docs = corpus(5)
    rows = [(d, t, None, None, None, "r") for d, t in docs] + [(None, docs[3][1], None, None, None, None), (None, None, None, None, None, None)]
    df = spark.createDataFrame([*rows, rows[3]], DOCS).repartition(4)
    got = near_copies.without_copies(df)
    want = wanted(docs, distance=2)
    assert got.columns == df.columns
    kept = sorted(r["doc_id"] for r in got.where("doc_id is not null").collect())
    assert kept == sorted([d for d, c in want.items() if c == d] + [d for d in [3] if want[3] == 3])
    assert got.where("doc_id is null").count() == 2
    assert near_copies.without_copies(spark.createDataFrame([], DOCS)).collect() == []


def test_similarity_below_the_samples(spark):
    with pytest.raises(ValueError):
        shingle_links.similar_documents(spark.createDataFrame([], DOCS), similarity=0.5)


def dominated(seed):
    """Texts in which one run makes up over half of the shingles: equal fingerprints, mostly different words."""
    rnd = random.Random(seed)
    fresh = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    texts = [f"{'- ' * 400}{' '.join(fresh(n))}" for n in [3, 8, 30, 60, 60, 60]]
    words = fresh(100)
    for at in (50, 5, 95):
        texts.append(f"{'- ' * 500}{' '.join(words)}")
        words = [*words[:at], "changed", *words[at + 1:]]
    texts += [f"{'- ' * 600}{texts[3][800:]}", f"{'0 ' * 300}{' '.join(fresh(40))}", f"{'0 ' * 300}{' '.join(fresh(40))}"]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_fingerprints_are_candidates_only(spark):
    docs = dominated(1)
    got = near_copies.without_copies(spark.createDataFrame([(d, t, None, None, None, None) for d, t in docs], DOCS).repartition(3))
    want = wanted(docs)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(d for d, c in want.items() if c == d)
    assert len(set(want.values())) == len(docs) - 3 and len(set(wanted(docs, distance=2).values())) == 2


def test_rare_keys(spark):
    rnd = random.Random(3)
    sets = []
    for n in (4, 5, 6, 9, 10, 15, 35, 80):
        for _ in range(6):
            first = [1, *rnd.sample(range(2, 10**6), n - 1)]
            sets.append(sorted(first))
            for cut in range(1, n // 9 + 2):
                sets += [sorted(first[cut:]), sorted(first[:-cut]), sorted([*first[cut:], *rnd.sample(range(10**6, 10**7), cut)])]
    rows = [(g, 2 * k + g, len(s), s) for k, s in enumerate(sets) for g in (0, 1)]
    keys = {}
    for r in shingle_links.rare_keys(spark.createDataFrame(rows, "group long, node long, size long, hashes array<long>"), 0.8).collect():
        keys.setdefault(r["node"], set()).add(r["key"])
    group = [(node, set(h)) for g, node, _, h in rows if g]
    alike = [(a, b) for i, (a, s) in enumerate(group) for b, t in group[:i] if s != t and len(s & t) >= 0.8 * len(s | t)]
    assert len(alike) > 50 and all(keys.get(a, set()) & keys.get(b, set()) for a, b in alike)


def test_short_pair_without_a_common_sample(spark):
    text = " ".join(f"{c}892" for c in "abcdefgh")  # four shingles, five with one more word; none of the 20 samples was equal
    got = shingle_links.similar_documents(spark.createDataFrame([(1, text, None, None, None, None), (2, text + " i892", None, None, None, None)], DOCS))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1)]
