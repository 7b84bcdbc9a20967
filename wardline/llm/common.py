"""Helpers the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.session import new_path

#: What separates words in the contracts: space, tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, n: int) -> list[str]:
    """``n`` names that no column of ``df`` has."""
    have = {c.lower() for c in df.columns}
    return list(islice((name for k in count() if (name := f"_{k}") not in have), n))


def short_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """The same rows; from now on the session hands Python this many at a time. Texts are long, and the usual 10,000 would be held several
    times over on both sides."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    return df


def saved(df: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage, survives lost executors, and Spark knows its size."""
    path = new_path(df.sparkSession, f"llm-{label}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + counts[i] - 1 of all i, one after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def slices(texts: list[str | None] | list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts, or of texts' lengths, of about ``most`` characters; a longer text is a run of its own."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        n = text if isinstance(text, int) else len(text or "")
        if size and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def batches_of(rows: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], type=f.type) for f in schema], schema=schema)


def bit_marks(df: DataFrame, column: str, bits: int) -> bytes:
    """Marks of the low bits of a long column: 2^bits bits, however many rows there are. Tells which rows elsewhere surely have no partner."""
    places = df.select(F.col(column).bitwiseAND(F.lit((1 << bits) - 1)).alias("p"))
    words = places.groupBy(F.expr("shiftright(p, 6) AS w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 AS int))) AS bits"))
    marks, rows = np.zeros(1 << (bits - 6), np.int64), words.toArrow()
    marks[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return marks.tobytes()


def is_marked(values: np.ndarray, marks: bytes) -> np.ndarray:
    words = np.frombuffer(marks, np.uint64)
    place = values.astype(np.int64).view(np.uint64) & np.uint64(len(words) * 64 - 1)
    return (words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def tidied(run):
    """``run``, a function of Arrow batches, after which the Python worker gives its free memory back instead of holding it while idle."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes
        import gc

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped
