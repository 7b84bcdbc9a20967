"""Encoding with memory: a text's pieces that were met before are not encoded again."""

from __future__ import annotations

import itertools
import json
import os
import re
import sys
import types

import numpy as np

from .common import gathered

JOINED = 500  # pieces that one call encodes, with the separator's id between them
_ENDS = ".,;:!?"


def load_tokenizer(spec: str):
    """A tokenizer from the text of its JSON file, single-threaded, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def kept_by_worker(name: str, spec: str, make):
    """What ``make`` gives, once per Python worker: later tasks of the worker go on with the same memory."""
    store = sys.modules.setdefault("_encoder_memory", types.ModuleType("_encoder_memory")).__dict__.setdefault("made", {})
    if (name, spec) not in store:
        store[name, spec] = make()
    return store[name, spec]


class Memory:
    """Ids of keys, kept in one flat array. When full it keeps the keys that came up again since it was last full, if they are few."""

    def __init__(self, encode, limit: int) -> None:
        self.encode, self.limit = encode, limit
        self._fill([], np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _fill(self, keys: list, flat: np.ndarray, counts: np.ndarray) -> None:
        self.index = dict(zip(keys, range(len(keys))))
        self.flat, self.counts = flat, counts
        self.starts = np.cumsum(counts) - counts
        self.hits = np.zeros(len(keys), np.int64)

    def _shrink(self) -> None:
        again = self.hits > 1
        if again.sum() > self.limit // 2:
            again[:] = False
        keys = list(itertools.compress(self.index, again.tolist()))
        self._fill(keys, self.flat[gathered(self.starts[again], self.counts[again])], self.counts[again])

    @staticmethod
    def _once(keys: list, missing: np.ndarray, different: bool) -> list:
        own = [keys[i] for i in missing.tolist()]
        return own if different else list(dict.fromkeys(own))

    def places(self, keys: list, different: bool = False) -> np.ndarray:
        """``different``: no key comes twice."""
        at = np.fromiter(map(self.index.get, keys, itertools.repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = self._once(keys, missing, different)
            if self.index and len(self.index) + len(new) > self.limit:
                self._shrink()
                at = np.fromiter(map(self.index.get, keys, itertools.repeat(-1)), np.int64, len(keys))
                missing = np.flatnonzero(at < 0)
                new = self._once(keys, missing, different)
            ids, counts = self.encode(new)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
            self.counts, self.flat = np.concatenate([self.counts, counts]), np.concatenate([self.flat, ids])
            self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int64)])
            if different:
                at[missing] = np.arange(len(self.index) - len(new), len(self.index))
            else:
                at[missing] = np.fromiter(map(self.index.__getitem__, [keys[i] for i in missing.tolist()]), np.int64, len(missing))
        self.hits += np.bincount(at, minlength=len(self.hits))
        return at

    def ids(self, keys: list, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All keys' ids one after another, and how many each has; ``use``: of these places of ``keys``, all different, instead."""
        at = self.places(keys, use is not None)
        at = at if use is None else at[use]
        counts = self.counts[at]
        return self.flat[gathered(self.starts[at], counts)], counts


def plain_spec(spec: str) -> str:
    """The tokenizer without what has nothing to do in a word of ASCII letters, after a space or not: normalizers and the split into words."""
    parsed = json.loads(spec)
    parsed["normalizer"] = None
    steps = parsed["pre_tokenizer"].get("pretokenizers", [parsed["pre_tokenizer"]])
    parsed["pre_tokenizer"] = next(dict(x, use_regex=False) for x in steps if x["type"] == "ByteLevel")
    return json.dumps(parsed)


def stem_memory(tokenizer, spec: str, limit: int) -> Memory:
    """Strings in bulk: many are joined by a special token, which the tokenizer takes out before anything else, and told apart by its id."""
    special = next((t["content"] for t in json.loads(spec).get("added_tokens", ()) if t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"])), None)
    mark = tokenizer.token_to_id(special) if special else None
    plain, plain_word = load_tokenizer(plain_spec(spec)), re.compile("[a-z]+|(?!.)" if '"Lowercase"' in spec else " ?[A-Za-z]+|(?!.)").fullmatch

    def encode_by(using, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        groups = [stems[i:i + JOINED] for i in range(0, len(stems), JOINED)]
        whole = [special is not None and special[:2] not in "".join(g) for g in groups]
        batch = [x for g, w in zip(groups, whole) for x in ([special.join(g)] if w else g)]
        coded = iter(using.encode_batch_fast(batch, add_special_tokens=False))
        for g, w in zip(groups, whole):
            if w:
                own = np.array(next(coded).ids, np.uint32)
                cuts = np.flatnonzero(own == mark)
                counts.append(np.diff(np.concatenate([[-1], cuts, [len(own)]])) - 1)
                ids.append(own[own != mark])
            else:
                own = [next(coded).ids for _ in g]
                counts.append(np.fromiter(map(len, own), np.int64, len(own)))
                ids.extend(np.array(x, np.uint32) for x in own)
        return np.concatenate(ids), np.concatenate(counts)

    def encode(stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        is_plain = np.fromiter((plain_word(s) is not None for s in stems), bool, len(stems))
        first, second = (encode_by(t, list(itertools.compress(stems, x.tolist()))) for t, x in ((plain, is_plain), (tokenizer, ~is_plain)))
        counts, starts = np.empty(len(stems), np.int64), np.empty(len(stems), np.int64)
        for (ids, own), x, shift in ((first, is_plain, 0), (second, ~is_plain, len(first[0]))):
            counts[x], starts[x] = own, np.cumsum(own) - own + shift
        return np.concatenate([first[0], second[0]])[gathered(starts, counts)], counts

    return Memory(encode, limit)


def piece_memory(tokenizer, spec: str, limit: int = 500_000) -> Memory:
    """Pieces of text. A closing mark after an ASCII letter is a word of its own to the tokenizer, so pieces that differ in it share a stem; so do
    ASCII pieces that differ in case, if the tokenizer lower-cases (not with a special token's begin, which it looks for before that)."""
    stems = stem_memory(tokenizer, spec, limit)
    lower = '"Lowercase"' in spec
    flat, counts = stems.encode(list(_ENDS))
    splits = bool((counts == 1).all())
    end_id = dict(zip(_ENDS, flat.tolist())) if splits else {}

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        keys, ends = [], np.full(len(pieces), -1, np.int64)
        for i, p in enumerate(pieces):
            if splits and p[-1:] in end_id and p[-2:-1].isascii() and p[-2:-1].isalpha():
                ends[i] = end_id[p[-1]]
                p = p[:-1]
            keys.append(p.lower() if lower and p.isascii() and "<|" not in p else p)
        ids, counts = stems.ids(keys)
        has = ends >= 0
        return np.insert(ids, np.cumsum(counts)[has], ends[has].astype(np.uint32)), counts + has

    return Memory(encode, limit)


def sums(counts: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of counts; groups: how many counts each has, none included."""
    total = np.concatenate([[0], np.cumsum(counts)])
    ends = np.cumsum(groups)
    return total[ends] - total[ends - groups]
