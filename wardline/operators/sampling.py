"""Dense row numbers and repeatable resampling without pulling rows to one place."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.session import checkpointed

BROADCAST_ROWS = 100_000
DRAWS_A_PARTITION = 4_000_000


def dense_index(df: DataFrame, order: Sequence[str], name: str = "idx") -> tuple[DataFrame, int]:
    """Number all rows 0..n-1 in ``order``; returns the rows and their count.

    Rows are range-partitioned and numbered inside their partition; only the partition sizes meet on the
    driver.
    """
    placed = checkpointed(df.repartitionByRange(*order).withColumn("_chunk", F.spark_partition_id()))
    sizes = {r["_chunk"]: r["count"] for r in placed.groupBy("_chunk").count().collect()}
    chunks = sorted(sizes)
    starts = dict(zip(chunks, accumulate([0] + [sizes[c] for c in chunks][:-1])))
    offsets = df.sparkSession.createDataFrame(
        [(c, starts[c]) for c in chunks] or [(0, 0)], "_chunk int, _start long")  # one row per partition
    w = Window.partitionBy("_chunk").orderBy(*order)
    out = placed.withColumn("_n", F.row_number().over(w)).join(F.broadcast(offsets), "_chunk").withColumn(
        name, F.col("_start") + F.col("_n") - 1)
    return out.drop("_chunk", "_n", "_start"), sum(sizes.values())


def draw(replicate: Column, slot: Column, n: int) -> Column:
    """Repeatable pseudo-random index in 0..n-1 for one slot of one replicate."""
    digits = F.substring(F.md5(F.concat_ws("|", replicate.cast("string"), slot.cast("string"))), 1, 15)  # 60 bits
    return F.conv(digits, 16, 10).cast("bigint") % F.lit(n)


def resampled(rows: DataFrame, order: Sequence[str], replicates: int) -> DataFrame:
    """Every replicate's draw with replacement: one row per slot of a replicate, the row drawn for it.

    There are ``replicates`` draws for every row, so the slots are dealt over partitions by the number of draws
    and not by that of the rows, and nothing is counted or sorted before the rows meet their draws.
    """
    indexed, n = dense_index(rows, order)
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n * replicates // DRAWS_A_PARTITION))
    slots = rows.sparkSession.range(0, n, 1, min(parts, max(n, 1))).select(
        F.col("id").alias("slot"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    drawn = slots.select("replicate", draw(F.col("replicate"), F.col("slot"), max(n, 1)).alias("idx"))
    if n <= BROADCAST_ROWS:
        return drawn.join(F.broadcast(indexed), "idx")
    return drawn.repartition(parts, "idx").join(indexed.repartition(parts, "idx").hint("shuffle_hash"), "idx")
