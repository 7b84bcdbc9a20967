"""Session helpers: time zone, the shared scratch area and reliable checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def use_utc(spark: SparkSession) -> SparkSession:
    """All event clocks are UTC; timestamps without a zone are read as UTC."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    On a cluster this is what ``spark.checkpoint.dir`` names, and it has to be set. Only a local session without it,
    as in tests, gets a fresh local folder, which is removed when the process ends.
    """
    named = spark.sparkContext.getConf().get(CHECKPOINT_CONF) or spark.conf.get(CHECKPOINT_CONF, None)
    if not named:
        named = spark.conf.get("wardline.local.scratch", None)
        if not named:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise ValueError(f"set spark.checkpoint.dir to a folder all executors of {master} share")
            named = tempfile.mkdtemp(prefix="wardline-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
            spark.conf.set("wardline.local.scratch", named)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, label: str) -> str:
    """A path nobody else uses, inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/wardline/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and cut the lineage; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
