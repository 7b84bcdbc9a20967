from pyspark.sql import functions as F

from wardline.session import new_path
from wardline.streaming import sinks


def test_alert_table_keeps_acknowledgements_and_survives_replays(spark):
    path = new_path(spark, "alert-table")
    write = sinks.alert_table(path)
    rows = lambda d: spark.createDataFrame(d, "alert_id string, event_us long, tier string")
    write(rows([("a", 1, "watch"), ("b", 2, "urgent")]), 0)
    acked = spark.read.parquet(sinks.latest_version(spark, path)).withColumn("acknowledged", F.col("alert_id") == "a")
    acked.write.parquet(f"{path}/v=1")
    for _ in range(2):  # a batch that is run again changes nothing
        write(rows([("a", 1, "critical"), ("c", 3, "watch")]), 2)
    out = {r["alert_id"]: (r["tier"], r["acknowledged"]) for r in spark.read.parquet(sinks.latest_version(spark, path)).collect()}
    assert out == {"a": ("critical", True), "b": ("urgent", False), "c": ("watch", False)}


def test_checkpoint_folder_of_the_session_is_used(spark):
    from wardline.session import checkpointed, shared_dir

    assert shared_dir(spark) == shared_dir(spark)
    assert checkpointed(spark.range(10)).count() == 10
    assert spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()
