"""Token ids as fixed-width bit-packed files.

Each id takes the fewest bits that hold every id of the vocabulary. Files are Parquet containers written by Spark, one per range of
doc_id, whose rows are blocks of whole documents: packed ids, document ids and lengths. Inside a block every ``GRAIN`` ids start on a byte
(offset ``k * GRAIN * bits / 8``), so any grain unpacks alone with numpy; ``first_doc`` and ``last_doc`` let a reader skip blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.session import new_path

from .common import batches_of, short_batches, slices
from .encoders import kept_by_worker, load_tokenizer, piece_memory, sums

GRAIN = 4096  # ids; a multiple of 8, so a grain fills whole bytes at any width
BLOCK_IDS = 1 << 18
BATCH_CHARS = 8_000_000
_BLOCK = "part int, block int, first_doc long, last_doc long, start_in_part long, bits int, n_ids long, ids binary, docs binary, lengths binary"
_BLOCK_ARROW = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("start_in_part", pa.int64()), ("bits", pa.int32()),
    ("n_ids", pa.int64()), ("ids", pa.binary()), ("docs", pa.binary()), ("lengths", pa.binary())])


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as a little-endian stream of ``bits`` each."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    out = []
    for at in range(0, len(ids), GRAIN):
        grid = (ids[at:at + GRAIN, None].astype(np.uint32) >> np.arange(bits, dtype=np.uint32)) & 1
        out.append(np.packbits(grid.astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(data: bytes, bits: int, begin: int, end: int) -> np.ndarray:
    """Ids begin to end - 1 of a block; reads only the grains that hold them."""
    first, n = begin // GRAIN, end - begin
    chunk = np.frombuffer(data, np.uint8, offset=first * GRAIN * bits // 8)[: -(-(end - first * GRAIN) * bits // 8)]
    if bits == 16:
        ids = chunk.view("<u2").astype(np.uint32)
    else:
        grid = np.unpackbits(chunk, bitorder="little")[: (end - first * GRAIN) * bits].reshape(-1, bits)
        ids = grid.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))
    return ids[begin - first * GRAIN:][:n]


def split(texts: pa.Array, lower: bool) -> pa.Array:
    """Pieces between spaces and line feeds, which the tokenizer drops and no token reaches across. A-Z are put in lower case where the tokenizer does so,
    but not in texts that may hold a special token, which it looks for first."""
    if lower:
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
    return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")


def _blocks(spec: str, end_id: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = kept_by_worker("pieces", spec, lambda: piece_memory(load_tokenizer(spec), spec))
        lower = '"Lowercase"' in spec
        part = TaskContext.get().partitionId()
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        block = start = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start
            docs, lengths, ids = (np.concatenate(x) for x in zip(*kept))
            row = {"part": [part], "block": [block], "first_doc": [int(docs[0])], "last_doc": [int(docs[-1])], "start_in_part": [start], "bits": [bits], "n_ids": [len(ids)],
                   "ids": [pack(ids, bits)], "docs": [docs.astype("<i8").tobytes()], "lengths": [lengths.astype("<i8").tobytes()]}
            block, start = block + 1, start + len(ids)
            kept.clear()
            return batches_of(row, _BLOCK_ARROW)

        for batch in batches:
            docs, sizes = batch.column(0).to_numpy(zero_copy_only=False), pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for a, b in slices(sizes.tolist(), BATCH_CHARS):
                pieces = split(pc.fill_null(batch.column(1).slice(a, b - a), ""), lower)
                coded = pieces.flatten().dictionary_encode()
                ids, counts = memory.ids(coded.dictionary.to_pylist(), coded.indices.to_numpy())
                lengths = sums(counts, pieces.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
                ids = np.insert(ids, np.cumsum(lengths), end_id)
                kept.append((docs[a:b], lengths + 1, ids))
                if sum(len(x[2]) for x in kept) >= BLOCK_IDS:
                    yield flush()
        if kept:
            yield flush()

    return run


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode and pack every document, in ascending doc_id order (equal ids: by text), into files under ``path``.

    A null text is empty and gets only the end id. Rows without doc_id are left out, as the order gives them no place. An empty table
    gives files without blocks. Other columns are not read. Only for tokenizers that drop white space and join nothing across it.
    """
    spec = Path(tokenizer_file).read_text(encoding="utf-8")
    bits = width(max(load_tokenizer(spec).get_vocab_size(with_added_tokens=True), end_id + 1))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    ranged = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    short_batches(ranged).mapInArrow(_blocks(spec, end_id, bits), _BLOCK).write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for row in range(batch.num_rows):
            begin, bits, n, data, docs, lengths = (batch.column(i)[row].as_py() for i in range(6))
            docs, lengths = np.frombuffer(docs, "<i8"), np.frombuffer(lengths, "<i8")
            ids, ends = unpack(data, bits, 0, n).astype("<u4"), np.cumsum(lengths)
            crc = [zlib.crc32(ids[e - k:e]) for e, k in zip(ends.tolist(), lengths.tolist())]
            yield batches_of({"doc_id": docs, "start": begin + ends - lengths, "n_tokens": lengths, "ids_crc32": crc}, schema)


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    blocks = spark.read.schema(_BLOCK).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row per file, whatever the documents hold: small enough for one task and a broadcast
    starts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = blocks.join(F.broadcast(starts), "part").select((F.col("before") + F.col("start_in_part")).alias("start"), "bits", "n_ids", "ids", "docs", "lengths")
    return placed.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def packed_documents(docs: DataFrame, tokenizer_file: str, end_id: int = 1) -> DataFrame:
    path = new_path(docs.sparkSession, "llm-token-files")
    write(docs, path, tokenizer_file, end_id)
    return read(docs.sparkSession, path)
