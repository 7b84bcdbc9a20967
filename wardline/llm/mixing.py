"""Mixing sources to target weights by weighted fair queueing.

Every source's documents stand in a shuffled order (by a hash of doc_id). A document's virtual finish time is its source's words up to and
including it over the source's target, and each pass over a source goes on counting. All copies are range-sorted by finish time, which
interleaves the sources in proportion to their targets, and the sorted line is cut where the total budget is used up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, saved

MAX_PASSES = 3
WEIGHTS = (1, 2, 3)
BUCKET_ROWS = 1024  # rows that one running sum covers; sums of buckets carry on from there


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, n, target) from (source, source_size, n): weights in code point order, the whole budget shared by them, no
    target above MAX_PASSES times its source; what is above is shared again by weight.

    With sources in order of cap / weight, the capped ones are a prefix: the shortest after which the level, the rest of the budget per
    weight, is at most the next source's cap / weight. One row per source is all this sees.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(ordered) - 1) % len(WEIGHTS) + 1)
    rows = sizes.select("source", "source_size", "n", weight.cast("long").alias("weight"), (F.col("source_size") * MAX_PASSES).alias("cap"))
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    up_to, everything = by_need.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    rows = rows.select("*", F.sum("source_size").over(everything).alias("budget"), F.coalesce(F.sum("cap").over(up_to), F.lit(0)).alias("given"),
                       F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing)).alias("open"))
    rows = rows.withColumn("level", (F.col("budget") - F.col("given")) / F.col("open"))
    level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    return rows.select("source", "source_size", "n", F.when(F.col("cap") / F.col("weight") >= level, F.col("weight") * level).otherwise(F.col("cap").cast("double")).alias("target"), "budget")


def ordered_documents(docs: DataFrame, seed: str, doc_id: str, text: str, source: str) -> DataFrame:
    """One row per document with its size, its source's size and target, and the words of its source up to and including it."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.col(text)).alias("th"))
    rows = rows.withColumn("h", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed))))
    rows = saved(rows, "mix-sizes")
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    same = F.col("r.source").eqNullSafe(F.col("g.source"))
    placed = rows.alias("r").join(goals.alias("g"), same).select("r.*", "source_size", "target", "budget", "n")
    share = F.conv(F.substring("h", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    placed = placed.withColumn("bucket", F.floor(share * F.ceil(F.col("n") / BUCKET_ROWS)))
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "th")
    placed = placed.select("*", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)).alias("so_far"), F.row_number().over(within).alias("place"))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.select("source", "bucket", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    on = F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.bucket") == F.col("s.bucket"))
    return placed.alias("p").join(sums.alias("s"), on).select(
        "p.doc_id", "p.source", "p.bucket", "place", "th", "size", "source_size", "target", "budget", (F.col("before") + F.col("so_far")).alias("cum"))


def line_up(documents: DataFrame) -> DataFrame:
    """Every copy of every document that may be needed, range-sorted by finish time; ``part`` is the place of its range."""
    passes = F.least(F.lit(MAX_PASSES), F.greatest(F.lit(1), F.ceil(F.col("target") / F.col("source_size")).cast("int")))
    copies = documents.withColumn("pass", F.explode(F.sequence(F.lit(0), F.coalesce(passes, F.lit(1)) - 1)))
    finish = F.coalesce((F.col("pass") * F.col("source_size") + F.col("cum")) / F.when(F.col("target") > 0, F.col("target")), F.lit(0.0))
    return copies.withColumn("finish", finish).repartitionByRange("finish", "source", "bucket", "place", "pass").withColumn("part", F.spark_partition_id())


def mixed(docs: DataFrame, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, th): one row per row of ``docs``; ``taken`` is its size times its copies in the mix.

    A null text has size 0; null is a source of its own, the last; texts of size 0 take no budget and are never taken. Equal doc_ids stand
    next to each other in the shuffled order, the smaller first. The first copy that would exceed the budget ends the mix. No documents
    give no rows; other columns are not read.
    """
    line = saved(line_up(ordered_documents(docs, seed, doc_id, text, source)), "mix-line")
    parts = line.groupBy("part").agg(F.sum("size").alias("words"), F.max("budget").alias("budget"))
    # one row per partition of the sorted table
    parts = parts.select("part", "words", "budget", (F.sum("words").over(Window.orderBy("part")) - F.col("words")).alias("before"))
    cut = parts.where("before + words > budget").agg(F.min_by(F.struct("part", (F.col("budget") - F.col("before")).alias("left")), "part").alias("c")).first()["c"]
    part, left = (cut["part"], cut["left"]) if cut else (2**31 - 1, 0)
    key = ["finish", "source", "bucket", "place", "pass"]
    running = line.where(F.col("part") == part).withColumn("run", F.sum("size").over(Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)))
    first_out = running.where(F.col("run") > left).agg(F.min(F.struct(*key)).alias("k")).first()["k"]
    if first_out is None:
        taken = F.lit(True)
    else:
        at = F.struct(*[F.lit(first_out[k]).cast(dict(line.dtypes)[k]).alias(k) for k in key])
        taken = (F.col("part") < part) | ((F.col("part") == part) & (F.struct(*key) < at))
    return (
        line.groupBy("source", "bucket", "place", "doc_id", "size", "source_size", "target", "th").agg(F.sum(F.when(taken, F.col("size")).otherwise(0)).alias("taken"))
        .select("doc_id", "source", "size", "source_size", "target", "taken", "th"))


def repeated(docs: DataFrame, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it; all columns stay. Rows that repeat a doc_id, source and text come as often
    each as the one of them that comes most. The columns of ``docs`` may have any names."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    copies = mixed(sized, seed).where("taken > 0").groupBy("doc_id", "source", "th").agg(F.max(F.col("taken") / F.col("size")).cast("int").alias("copies"))
    d, s, t, c, each = fresh(docs, 5)
    copies = saved(copies.select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("th").alias(t), F.col("copies").alias(c)), "mix-copies")
    joined = docs.join(copies, F.col(doc_id).eqNullSafe(F.col(d)) & F.col(source).eqNullSafe(F.col(s)) & (F.xxhash64(F.col(text)) == F.col(t)))
    return joined.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(c)))).select(*docs.columns)
