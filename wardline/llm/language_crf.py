"""Language of texts by a linear-chain conditional random field over words.

Every word of a text gets a language: emission weights of its affixes, character n-grams, the word itself and the languages whose lexicon
holds it, and learned weights of going from one language to the next, so that code-switched texts are labelled span by span.
Forward-backward gives each word's posterior; a text's language is the one with the greatest sum over its words, its score the mean.

The model is fitted on spans of at most ``DOCS_PER_LANGUAGE`` labelled texts per language, drawn by hash; spans of different texts are
strung together so that switches occur in training. Everything else sees all words of all texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, gathered, short_batches, tidied

UNKNOWN = "und"
DOCS_PER_LANGUAGE, SPANS_PER_DOC, SPAN_WORDS = 150, 12, 20  # bounds of the training sample
SPANS_PER_SEQUENCE, EPOCHS, RATE, BATCH, L2 = 3, 4, 0.3, 128, 1e-4
FEATURE_BITS = 16
BATCH_WORDS = 250_000
MEMORY_WORDS = 300_000
_WORD = re.compile(r"[^\W\d_]+")
_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def words_of(text: str | None) -> list[str]:
    """Lower-cased words; none if the text is null or has no letter."""
    if not text or not any(map(str.isalpha, text)):
        return []
    return _WORD.findall(text.lower())


class Features:
    """Hashed features of many words at once, as flat ids and counts per word."""

    def __init__(self, words: list[str]) -> None:
        framed = [f"\x02{w}\x03" for w in words]
        self.codes = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.lengths = np.fromiter(map(len, framed), np.int64, len(words))
        self.starts = np.cumsum(self.lengths) - self.lengths

    @staticmethod
    def _slot(values: np.ndarray, kind: int) -> np.ndarray:
        mixed = (values + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)

    def _grams(self, n: int) -> np.ndarray:
        h = np.zeros(len(self.codes) - n + 1, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + self.codes[i:i + len(h)]
        return h

    def word_hashes(self) -> np.ndarray:
        power = np.cumprod(np.full(int(self.lengths.max(initial=1)), 0x100000001B3, np.uint64))
        place = np.arange(len(self.codes)) - np.repeat(self.starts, self.lengths)
        return np.add.reduceat(self.codes * power[place], self.starts) if len(self.starts) else np.zeros(0, np.uint64)

    def runs(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(flat ids, counts): all pairs and triples of characters, begins and ends of up to four, the word."""
        one = np.ones(len(self.lengths), np.int64)
        out = []
        for n in (2, 3):
            counts = self.lengths - n + 1
            out.append((self._slot(self._grams(n), n)[gathered(self.starts, counts)], counts))
        four = self._slot(self._grams(4), 4) if len(self.codes) >= 4 else np.zeros(1, np.int64)
        begin = four[np.minimum(self.starts, len(four) - 1)]
        end = four[np.maximum(np.minimum(self.starts + self.lengths - 4, len(four) - 1), 0)] ^ 1
        long = self.lengths >= 4
        out += [(np.where(long, begin, 0), one), (np.where(long, end, 1), one), (self._slot(self.word_hashes(), 9), one)]
        return out


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # features x languages
    lexicon_weights: np.ndarray  # lexicons x languages
    switch: np.ndarray  # from x to
    first: np.ndarray
    lexicons: list[np.ndarray]  # sorted word hashes

    def in_lexicons(self, features: Features) -> np.ndarray:
        hashes = features.word_hashes()
        return np.stack([np.isin(hashes, x, assume_unique=False) for x in self.lexicons], axis=1).astype(np.float32)

    def emissions(self, words: list[str]) -> np.ndarray:
        features = Features(words)
        out = self.in_lexicons(features) @ self.lexicon_weights
        for flat, counts in features.runs():
            rows = self.weights[flat]
            out += rows if len(flat) == len(counts) else np.add.reduceat(rows, np.cumsum(counts) - counts, axis=0)
        return out


def forward_backward(lengths: np.ndarray, at: np.ndarray, emit: np.ndarray, switch: np.ndarray, first: np.ndarray, pairs: bool = False):
    """Posteriors of every word, sequence after sequence. ``at``: each word's row in ``emit``, the probabilities' positive factors.
    ``pairs``: also the expected number of times each language follows each."""
    order = np.argsort(-lengths, kind="stable")
    starts, longest = (np.cumsum(lengths) - lengths)[order], int(lengths.max(initial=0))
    active = np.searchsorted(-lengths[order], -np.arange(longest), side="left")  # sequences longer than t
    alpha = np.empty((len(at), len(first)), emit.dtype)
    for t in range(longest):
        m = active[t]
        a = emit[at[starts[:m] + t]] * (first if t == 0 else a[:m] @ switch)
        a /= a.sum(axis=1, keepdims=True)
        alpha[starts[:m] + t] = a
    b, followed = np.ones((len(lengths), len(first)), emit.dtype), np.zeros(switch.shape)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        rows = starts[:m] + t
        posterior = alpha[rows] * b[:m]
        alpha[rows] = posterior / posterior.sum(axis=1, keepdims=True)
        if t:
            ahead = emit[at[rows]] * b[:m]
            before = ahead @ switch.T
            if pairs:
                joint = alpha[rows - 1][:, :, None] * switch * ahead[:, None, :]
                followed += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b[:m] = before / before.sum(axis=1, keepdims=True)
    return (alpha, followed) if pairs else alpha


def _positive(emissions: np.ndarray) -> np.ndarray:
    """Factors of up to 1; no language is ruled out by one word."""
    return np.exp(np.maximum(emissions - emissions.max(axis=1, keepdims=True), -30)).astype(np.float32)


def fit(spans: list[tuple[str, list[str]]], seed: int = 7) -> Model | None:
    """A model from (language, words) spans; None without any."""
    spans = sorted(s for s in spans if s[1])
    languages = sorted({lang for lang, _ in spans})
    if not languages:
        return None
    k, code = len(languages), {x: i for i, x in enumerate(languages)}
    vocabulary = sorted({w for _, words in spans for w in words})
    index = {w: i for i, w in enumerate(vocabulary)}
    features = Features(vocabulary)
    hashes = features.word_hashes()
    seen = np.zeros((len(vocabulary), k), np.int64)
    for lang, words in spans:
        np.add.at(seen[:, code[lang]], [index[w] for w in words], 1)
    model = Model(languages, np.zeros((1 << FEATURE_BITS, k), np.float32), np.zeros((k, k), np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32),
                  [np.sort(hashes[seen[:, i] >= 2]) for i in range(k)])
    lexical, runs = model.in_lexicons(features), features.runs()
    rng = np.random.default_rng(seed)
    squares = {name: np.full_like(getattr(model, name), 1e-6) for name in ("weights", "lexicon_weights", "switch", "first")}

    def step(name: str, gradient: np.ndarray) -> None:
        squares[name] += gradient**2
        getattr(model, name)[...] -= RATE * gradient / np.sqrt(squares[name])

    for _ in range(EPOCHS):
        shuffled = rng.permutation(len(spans))
        sequences = [shuffled[i:i + SPANS_PER_SEQUENCE] for i in range(0, len(shuffled), SPANS_PER_SEQUENCE)]
        for begin in range(0, len(sequences), BATCH):
            chosen = sequences[begin:begin + BATCH]
            at = np.fromiter((index[w] for s in chosen for i in s for w in spans[i][1]), np.int64)
            gold = np.concatenate([np.full(len(spans[i][1]), code[spans[i][0]]) for s in chosen for i in s])
            lengths = np.array([sum(len(spans[i][1]) for i in s) for s in chosen])
            used, place = np.unique(at, return_inverse=True)
            scores = lexical[used] @ model.lexicon_weights
            own = []
            for flat, counts in runs:
                slots = flat[gathered((np.cumsum(counts) - counts)[used], counts[used])]
                own.append((slots, counts[used]))
                scores += np.add.reduceat(model.weights[slots], np.cumsum(counts[used]) - counts[used], axis=0)
            emit = _positive(scores)
            switch, first = np.exp(model.switch), np.exp(model.first)
            posterior, followed = forward_backward(lengths, place, emit, switch, first, pairs=True)
            inner = np.ones(len(at), bool)
            inner[np.cumsum(lengths) - lengths] = False
            here = np.flatnonzero(inner)
            observed = np.zeros((k, k))
            np.add.at(observed, (gold[here - 1], gold[here]), 1)
            error = posterior.copy()
            error[np.arange(len(at)), gold] -= 1
            by_word = np.stack([np.bincount(place, error[:, i], minlength=len(used)) for i in range(k)], axis=1).astype(np.float32) / len(chosen)
            gradient = np.zeros_like(model.weights)
            for slots, counts in own:
                spread = np.repeat(by_word, counts, axis=0)
                for i in range(k):
                    gradient[:, i] += np.bincount(slots, spread[:, i], minlength=1 << FEATURE_BITS)
            starts = np.cumsum(lengths) - lengths
            step("weights", gradient + L2 * model.weights)
            step("lexicon_weights", lexical[used].T @ by_word + L2 * model.lexicon_weights)
            step("switch", ((followed - observed) / len(chosen)).astype(np.float32) + L2 * model.switch)
            step("first", error[starts].mean(axis=0) + L2 * model.first)
    return model


class Labeller:
    """Applies a model; words met before keep their emissions, until the memory is full and starts anew."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.index: dict[str, int] = {}
        self.emit = np.zeros((0, len(model.languages)), np.float32)
        self.switch, self.first = np.exp(model.switch).astype(np.float32), np.exp(model.first).astype(np.float32)

    def label(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Mean posterior of every language, and the mean over words of the greatest posterior, for texts with at least one word each."""
        flat = [w for words in texts for w in words]
        new = [w for w in dict.fromkeys(flat) if w not in self.index]
        if new:
            if len(self.index) + len(new) > MEMORY_WORDS and self.index:
                self.index, self.emit = {}, self.emit[:0]
                new = list(dict.fromkeys(flat))
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.emit = np.concatenate([self.emit, *(_positive(self.model.emissions(new[i:i + 50_000])) for i in range(0, len(new), 50_000))])
        at = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        posterior = forward_backward(lengths, at, self.emit, self.switch, self.first).astype(np.float64)
        starts = np.cumsum(lengths) - lengths
        return np.add.reduceat(posterior, starts, axis=0) / lengths[:, None], np.add.reduceat(posterior.max(axis=1), starts) / lengths


def _predict(model: Model | None, text: int, keep=None):
    """``keep``: instead of predictions, the rows whose (language, mean over words of the greatest posterior) it accepts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model) if model else None
        for batch in batches:
            texts = batch.column(text)
            best, score, sure = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows, [0.0] * batch.num_rows
            sizes = pa.compute.fill_null(pa.compute.utf8_length(texts), 0).to_numpy(zero_copy_only=False) if labeller else np.zeros(batch.num_rows)
            group: list[tuple[int, list[str]]] = []
            held = 0

            def flush() -> None:
                for (i, _), mean, each in zip(group, *labeller.label([words for _, words in group])):
                    top, sure[i] = int(np.argmax(mean)), float(each)
                    best[i], score[i] = model.languages[top], float(min(1.0, max(0.0, mean[top])))
                group.clear()

            for i in np.argsort(sizes, kind="stable").tolist() if labeller else ():  # like lengths together
                if words := words_of(texts[i].as_py()):
                    if group and held + len(words) > BATCH_WORDS:
                        flush()
                        held = 0
                    group.append((i, words))
                    held += len(words)
            if group:
                flush()
            if keep:
                yield batch.filter(pa.array([keep(*x) for x in zip(best, sure)], pa.bool_()))
            else:
                yield batches_of({"doc_id": batch.column(0), "lang_pred": best, "score": score}, _OUT)

    return run


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string()))])
    for batch in batches:
        langs, spans = [], []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text)
            # evenly over the whole text
            for begin in sorted({round(i * max(0, len(words) - SPAN_WORDS) / max(1, SPANS_PER_DOC - 1)) for i in range(SPANS_PER_DOC)}) if words else ():
                langs.append(lang)
                spans.append(words[begin:begin + SPAN_WORDS])
        yield batches_of({"lang": langs, "words": spans}, schema)


def learned(rows: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Model | None:
    """A model from (key, lang, text) rows; about docs_per_language of each language, drawn by a hash of the key, reach the driver, as spans."""
    known = rows.where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return None
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, docs_per_language / n)))])
    drawn = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("language sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.where(drawn < share[F.col("lang")]).orderBy(F.xxhash64(F.col("key").cast("string"), F.lit("order")), "key").limit(2 * docs_per_language * len(counts))
    return fit([(r["lang"], list(r["words"])) for r in sample.select("lang", "text").mapInArrow(_spans, "lang string, words array<string>").collect()])


def _model(docs: DataFrame, doc_id: str, text: str, lang: str) -> Model | None:
    learn = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1
    return learned(docs.where(learn).select(F.col(doc_id).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")))


def languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of ``docs``.

    Learns from rows with a language whose crc32(doc_id as text) mod 3 is not 1. Null texts and those without a letter are ``und`` with
    score 0, as are all if there is nothing to learn from. A null doc_id is neither learned from nor held out. Repeated rows are repeated; no rows
    give no rows; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    model = _model(docs, doc_id, text, lang)
    # the model goes along with the function: a fixed number of weights per language
    out = short_batches(rows).mapInArrow(tidied(_predict(model, 1)), "doc_id long, lang_pred string, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least: float = 0.5, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose words are, on average, labelled with a learned language with a posterior of at least ``least``. All columns stay as they are.

    It is each word's own best language that counts, so a text that switches between learned languages stays however many they are. Texts that are null or have no letter go, and so do all
    if there is nothing to learn from. Each row is judged by its text alone: repeated rows, rows without doc_id or language, and languages that tie (the word's posterior is what counts, whichever
    of them has it) are no special case.
    """
    model = _model(docs, doc_id, text, lang)
    return short_batches(docs).mapInArrow(tidied(_predict(model, docs.columns.index(text), lambda language, sure: language != UNKNOWN and sure >= least)), docs.schema)
