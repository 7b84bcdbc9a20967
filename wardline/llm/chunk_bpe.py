"""Byte-level BPE by chunks that documents share.

A rolling hash of the last ``WINDOW`` bytes cuts texts where its top bits are zero, so equal passages get equal chunks wherever they
stand. A chunk is encoded once and its ids are reused wherever it comes up again in the rows a worker reads. Cuts fall anywhere, also inside
words, so each join is repaired: the stretch between the nearest safe places around the cut is encoded anew, and the ids of both chunks
are kept only outside it. Kept and new ids must cover the text byte for byte; where they don't, the stretch grows by doubling until they
agree, up to the whole text. A place is safe where a printable ASCII character is followed by a space or line feed: no match of the
tokenizer's word pattern goes across it, and what follows is matched alike whatever stands before.

Chunks are shared within a Python worker, not across the cluster: sending ids through a shuffle moves more bytes than the texts have, and
encoding a chunk again in another worker costs less than that.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, gathered, short_batches, slices, tidied
from .encoders import Memory, kept_by_worker, load_tokenizer, piece_memory, sums

WINDOW = 16
MASK_BITS = 8  # a chunk in 256 bytes on average
BATCH_CHARS = 1_000_000
_PIECE = re.compile("[ \n]*[^ \n]+|[ \n]+")
_UNSAFE = re.compile("[^\n -~¡-ɏ]")  # beyond printable Latin, also other white space: such a chunk is one piece
_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.binary())])


def _byte_of_char() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Decoder:
    """Bytes of ids by table look-up."""

    def __init__(self, spec: str) -> None:
        parsed, byte = json.loads(spec), _byte_of_char()
        tokens = dict(parsed["model"]["vocab"]) | {t["content"]: t["id"] for t in parsed["added_tokens"]}
        words = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            words[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(words), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return self.flat[gathered(self.starts[ids], self.lengths[ids])].tobytes()


def cut_places(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where chunks begin: every text's start, and where the hash of the bytes before says so, moved on to a whole character."""
    cuts = np.zeros(len(data) + 1, bool)
    if len(data) > WINDOW:
        h = np.zeros(len(data) - WINDOW + 1, np.uint32)
        for i in range(WINDOW):
            h = h * np.uint32(0x01000193) + data[i:i + len(h)]
        h *= np.uint32(0x9E3779B1)
        cuts[WINDOW:] = h >> np.uint32(32 - MASK_BITS) == 0
    near = gathered(starts, np.minimum(WINDOW, ends - starts))
    cuts[near] = False  # the window would reach into the text before
    places = np.flatnonzero(cuts[:-1])
    for _ in range(3):
        places = places + ((data[places] & 0xC0) == 0x80)
        places = places[places < len(data)]
    cuts[:] = False
    cuts[places] = True
    cuts[starts[ends > starts]] = True
    return np.flatnonzero(cuts[:-1])


class ChunkEncoder:
    def __init__(self, spec: str, chunk_limit: int = 40_000) -> None:
        self.pieces = piece_memory(load_tokenizer(spec), spec, limit=300_000)
        self.chunks = Memory(self._encode_chunks, chunk_limit)
        self.decoder = Decoder(spec)

    def _encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for chunk in chunks:
            text = chunk.decode()
            parts.append([text] if _UNSAFE.search(text) else _PIECE.findall(text))
        ids, counts = self.pieces.ids([p for x in parts for p in x])
        return ids, sums(counts, np.fromiter(map(len, parts), np.int64, len(parts)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and each text's number of ids."""
        raw = [t.encode() for t in texts]
        whole = b"".join(raw)
        data = np.frombuffer(whole, np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        cuts = cut_places(data, starts, ends)
        bounds = np.append(cuts, len(data)).tolist()
        ids, counts = self.chunks.ids([whole[a:b] for a, b in zip(bounds, bounds[1:])])
        begin = np.cumsum(self.decoder.lengths[ids]) - self.decoder.lengths[ids]
        end = begin + self.decoder.lengths[ids]
        is_safe = np.zeros(len(data) + 1, bool)
        is_safe[1:-1] = (data[:-1] >= 0x21) & (data[:-1] <= 0x7E) & ((data[1:] == 32) | (data[1:] == 10))
        is_safe[starts] = is_safe[ends] = True
        safe = np.flatnonzero(is_safe)
        is_start = np.zeros(len(data) + 1, bool)
        is_start[starts] = True
        joins = cuts[~is_start[cuts]]
        reach = np.ones(len(joins), np.int64)
        owner = np.searchsorted(ends, joins, side="right")
        while True:
            at = np.searchsorted(safe, joins)
            exact = safe[at] == joins
            low = np.maximum(safe[np.maximum(at - reach + (exact & (reach == 1)), 0)], starts[owner])
            high = np.minimum(safe[np.minimum(at + reach - 1, len(safe) - 1)], ends[owner])
            if len(joins):  # overlapping stretches become one; those that only touch may be of two texts
                top = np.maximum.accumulate(high)
                first = np.append(True, low[1:] >= top[:-1])
                lows, highs = low[first], top[np.append(np.flatnonzero(first)[1:] - 1, len(top) - 1)]
            else:
                lows = highs = np.zeros(0, np.int64)
            real = highs > lows
            lows, highs = lows[real], highs[real]
            k = np.searchsorted(lows, end, side="left") - 1  # the last stretch that begins before the token ends
            kept = (k < 0) | (begin >= np.append(highs, 0)[k]) if len(lows) else np.ones(len(ids), bool)
            covered = np.bincount(np.searchsorted(ends, begin[kept], side="right"), weights=(end - begin)[kept], minlength=len(texts)).astype(np.int64)
            covered += np.bincount(np.searchsorted(ends, lows, side="right"), weights=highs - lows, minlength=len(texts)).astype(np.int64)
            bad = covered != sizes
            if not bad.any():
                break
            reach[bad[owner]] = np.minimum(reach[bad[owner]] * 2, len(safe))
        fresh, fresh_counts = self._encode_chunks([whole[a:b] for a, b in zip(lows.tolist(), highs.tolist())])
        places = np.concatenate([begin[kept], np.repeat(lows, fresh_counts)])
        order = np.argsort(places, kind="stable")
        out = np.concatenate([ids[kept], fresh])[order]
        return out, np.bincount(np.searchsorted(ends, places, side="right"), minlength=len(texts))


def _run(spec: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_by_worker("chunks", spec, lambda: ChunkEncoder(spec))
        kind = "<u2" if len(encoder.decoder.lengths) <= 1 << 16 else "<u4"
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts, BATCH_CHARS):
                ids, counts = encoder.encode([t or "" for t in texts[a:b]])
                ends, coded, decoded = np.cumsum(counts).tolist(), [], []
                packed: list[bytes | None] = []
                for e, n in zip(ends, counts.tolist()):
                    own = ids[e - n:e]
                    coded.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    packed.append(own.astype(kind).tobytes() if with_ids else None)
                    decoded.append(hashlib.sha256(encoder.decoder.bytes_of(own).decode("utf-8", "replace").encode()).hexdigest())
                yield batches_of({"doc_id": docs.slice(a, b - a), "n_tokens": counts, "ids_sha256": coded, "decoded_sha256": decoded, "ids": packed}, _OUT)

    return run


def encoded_documents(docs: DataFrame, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per row of ``docs``; ``with_ids``: also the ids, little-endian, of two
    bytes each where the vocabulary fits, else of four.

    Null and empty texts have no ids. Repeated rows are repeated, a null doc_id stays null; other columns are not read. No row moves:
    the only work is the scan's.
    """
    spec = Path(tokenizer_file).read_text(encoding="utf-8")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = short_batches(rows).mapInArrow(tidied(_run(spec, with_ids)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary")
    return out if with_ids else out.drop("ids")
