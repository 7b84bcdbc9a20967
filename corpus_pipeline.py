"""From raw documents to token ids: language ID, line dedup, near-dedup, source mixing, BPE.

Each stage is written as Parquet in the shared folder and read again by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import chunk_bpe, language_crf, line_edits, mixing, near_copies
from wardline.llm.common import saved, table
from wardline.llm.queries import tokenizer_file


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_crf.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_edits.without_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.without_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chunk_bpe.encoded_documents(docs, tokenizer_file("byte_bpe_50k.json"), with_ids=True)


STAGES = [("language ID", language), ("line dedup", lines), ("SimHash near-dedup", copies), ("mixing sources to target weights", mix), ("BPE encoding and decoding", tokens)]

#: SQL can express neither the trained language model nor the tokenizer; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "stage-" + "-".join(name.lower().split()))
    return STAGES[-1][1](spark, docs, sf_dir)
