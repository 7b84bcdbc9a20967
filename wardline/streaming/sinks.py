"""Table sinks for ``foreachBatch``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators import store


def alert_table(path: str) -> Callable[[DataFrame, int], None]:
    """Alert table kept by alert id; acknowledgements survive and a replayed batch changes nothing.

    Every batch writes a new version next to the old one and then points to it, so readers never see a
    half-written table and a lost executor only repeats its own tasks.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumns({
            "arrival": F.lit(batch_id), "acknowledged": F.lit(False), "acknowledged_us": F.lit(None).cast("long"),
            "acknowledge_note": F.lit(None).cast("string"), "resolution_state": F.lit("open")})
        before = latest_version(spark, path, below=batch_id)
        rows = new if before is None else None
        if before is None:
            rows = new.groupBy("alert_id").agg(F.max_by(F.struct(*new.columns), "event_us").alias("r")).select("r.*")
        else:
            rows = store.upsert_alerts(spark.read.parquet(before), new)
        rows.write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return write


def latest_version(spark, path: str, below: int | None = None) -> str | None:
    """Folder of the newest complete version of the table."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    found = []
    for s in fs.listStatus(root):
        name = s.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")):
            n = int(name[2:])
            if below is None or n < below:
                found.append(n)
    return f"{path}/v={max(found)}" if found else None
