"""Skyline of two measures: the rows that no other row beats in both.

A row is beaten by one that costs no more and gains no less, and is better in one of the two. Each input partition first drops what its own rows
beat, so little is shuffled. What is left is sorted by cost over the cluster: a cost's best gain counts if it is above every gain at a lower cost, which is a running maximum; partitions pass on one
number each. No row is compared with all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.session import checkpointed


def _front(cost: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((-gain, cost))
    cost, gain = cost[order], gain[order]
    best = np.maximum.accumulate(np.concatenate(([-np.inf], gain[:-1]))) if len(gain) else gain
    keep = gain > best
    return cost[keep], gain[keep]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cost, gain = np.zeros(0), np.zeros(0)
    for batch in batches:
        own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cost, gain = _front(np.concatenate((cost, own[0])), np.concatenate((gain, own[1])))
    yield pa.RecordBatch.from_arrays([pa.array(cost), pa.array(gain)], names=["cost", "gain"])


def on_skyline(rows: DataFrame, least: str, most: str, flag: str = "on_skyline") -> DataFrame:
    """``rows`` with ``flag``: whether no other row beats it, where ``least`` is to be small and ``most`` large.

    Equal rows do not beat each other. A row whose measures are null or not a number is on no skyline and beats none. An empty table gives no rows.
    """
    cost, gain = F.col(least).cast("double"), F.col(most).cast("double")
    usable = cost.isNotNull() & gain.isNotNull() & ~F.isnan(cost) & ~F.isnan(gain)
    points = rows.where(usable).select(cost.alias("cost"), gain.alias("gain")).mapInArrow(_local, "cost double, gain double")
    best = points.groupBy("cost").agg(F.max("gain").alias("gain"))
    placed = checkpointed(best.repartitionByRange("cost").withColumn("part", F.spark_partition_id()))
    tops = placed.groupBy("part").agg(F.max("gain").alias("top"))
    # one row per partition
    carried = tops.select("part", F.max("top").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    own = F.max("gain").over(Window.partitionBy("part").orderBy("cost").rowsBetween(Window.unboundedPreceding, -1))
    front = placed.withColumn("own", own).join(F.broadcast(carried), "part").where(F.coalesce(F.col("gain") > F.greatest("own", "carried"), F.lit(True)))
    front = front.select(F.col("cost").alias("_cost"), F.col("gain").alias("_gain"), F.lit(True).alias("_on"))
    met = rows.join(front, usable & (cost == F.col("_cost")) & (gain == F.col("_gain")), "left")
    return met.withColumn(flag, F.coalesce("_on", F.lit(False))).drop("_cost", "_gain", "_on")
