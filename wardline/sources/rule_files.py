"""Rule bundles kept as files: ``<bundle>.v<version>.json``, checked against their content, and an activation list."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = r"^([A-Za-z0-9_-]+)\.v([0-9A-Za-z.+-]+)\.json$"
VERSION = r"^[0-9]+\.[0-9]+\.[0-9]+([-+].*)?$"
REQUIRED = ("bundle_id", "version", "indicator", "score")
_BODY = "struct<bundle_id: string, version: string, indicator: string, score: struct<type: string>, _bad: string>"


def read_rule_files(spark: SparkSession, path: str) -> DataFrame:
    """``name`` and ``body`` of every file below a folder. A bundle is a page of settings, so a file is one value.

    Spark lists no empty files: they have no row, and activating one finds nothing.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), F.col("value").alias("body"))


def read_activation(spark: SparkSession, path: str) -> DataFrame:
    """``bundle_id`` and ``version`` from a manifest ``{"active": {bundle: version}}``; without the map there is no row."""
    text = spark.read.text(path, wholetext=True)
    active = F.from_json("value", "struct<active: map<string, string>>")["active"]
    return text.select(F.explode(active).alias("bundle_id", "version"))


def checked_bundles(files: DataFrame, scorers: Iterable[str]) -> DataFrame:
    """``files`` with the bundle and version of the name, the content's fields, and the first ``error`` (null: usable).

    Errors, in this order: ``file_name``, ``duplicate_version`` (a bundle's version in several files, none of
    which is used), ``malformed``, ``missing:<field>``, ``bad_version``, ``bundle_mismatch``, ``version_mismatch``
    (name against content), ``no_score_type``, ``unknown_scorer``.
    """
    body = F.from_json("body", _BODY, {"columnNameOfCorruptRecord": "_bad"})
    rows = files.withColumn("_c", body).withColumns({
        "file_bundle": F.nullif(F.regexp_extract("name", NAME, 1), F.lit("")), "file_version": F.nullif(F.regexp_extract("name", NAME, 2), F.lit(""))})
    twice = rows.where(F.col("file_bundle").isNotNull()).groupBy("file_bundle", "file_version").count().where("count > 1").drop("count").withColumn("_twice", F.lit(True))
    c = F.col("_c")
    error = F.when(F.col("file_bundle").isNull(), "file_name").when(F.col("_twice"), "duplicate_version").when(
        c.isNull() | c["_bad"].isNotNull() | F.coalesce(F.trim("body") == "", F.lit(True)), "malformed")
    for field in REQUIRED:
        error = error.when(c[field].isNull(), f"missing:{field}")
    error = (error.when(~c["version"].rlike(VERSION), "bad_version").when(c["bundle_id"] != F.col("file_bundle"), "bundle_mismatch")
             .when(c["version"] != F.col("file_version"), "version_mismatch")
             .when(F.coalesce(c["score"]["type"], F.lit("")) == "", "no_score_type").when(~c["score"]["type"].isin(*scorers), "unknown_scorer"))
    return rows.join(twice, ["file_bundle", "file_version"], "left").select(
        *files.columns, "file_bundle", "file_version", c["indicator"].alias("indicator"), c["score"]["type"].alias("score_type"), error.alias("error"))


def activation_report(checked: DataFrame, activation: DataFrame) -> DataFrame:
    """Each active version (``bundle_id``, ``version``): ``ok``, the error of its file, or ``not_found``. Newest is never guessed."""
    found = checked.where(F.col("file_bundle").isNotNull()).groupBy(
        F.col("file_bundle").alias("bundle_id"), F.col("file_version").alias("version")).agg(F.min(F.coalesce("error", F.lit("ok"))).alias("_verdict"))
    return activation.join(found, ["bundle_id", "version"], "left").select("bundle_id", "version", F.coalesce("_verdict", F.lit("not_found")).alias("verdict"))
