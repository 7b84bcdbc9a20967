"""What must not depend on size or be passed over in silence."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from wardline.operators import sampling, store
from wardline.session import shared_dir
from wardline.sources import records


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: conf)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=context, conf=conf))


def test_pages_are_not_clamped(spark):
    df = spark.range(1500).selectExpr("id AS event_us", "cast(id AS string) AS alert_id", "'p' AS patient_id", "false AS acknowledged")
    assert store.newest_alerts(df, 1200).count() == 1200
    with pytest.raises(ValueError):
        store.newest_alerts(df, 0)


def test_draws_reach_beyond_28_bits(spark):
    n = 1 << 40
    drawn = spark.range(400).select(sampling.draw(F.lit(1), F.col("id"), n).alias("x")).agg(F.max("x"), F.min("x")).first()
    assert n > drawn[0] > 1 << 36 and drawn[1] >= 0


def test_records_without_patient_or_resource_get_a_reason(spark):
    lines = spark.createDataFrame([('{"patient_id": "p", "event_time": "2024-01-01T00:00:00Z"}',), ("{",)], "value string")
    assert sorted(r["reason"] for r in records.stream_records(lines).collect()) == ["malformed_json", "no_patient_or_resource"]
