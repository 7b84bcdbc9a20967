"""Hourly stay files: pipe-separated, one stay per file with its id in the path, or many stays per file with the id in a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators.latest import forward_fill
from wardline.operators.mapping import oxygen_fraction

# Columns of the hourly files that are scored.
MEASURES = {"MAP": "map", "Platelets": "platelets", "Bilirubin_total": "bilirubin", "Creatinine": "creatinine",
            "O2Sat": "o2sat", "SaO2": "sao2", "FiO2": "fio2"}
FILLED = tuple(MEASURES.values())


def read_stays(spark: SparkSession, path: str, set_name: str | None = None,
               stay_pattern: str = r"([^/]+)\.psv(\.gz)?$", stay_column: str | None = None) -> DataFrame:
    """Hourly rows of all stays below ``path``, or of one set directory.

    The stay id is what ``stay_pattern`` finds in the path, or ``stay_column`` where a file holds many stays: a file
    per stay costs some hundredths of a second for listing and opening it, whatever it holds.
    """
    root = f"{path.rstrip('/')}/{set_name}" if set_name else path
    raw = spark.read.option("sep", "|").option("header", True).option("nullValue", "NaN").option(
        "recursiveFileLookup", True).csv(root)
    if "SepsisLabel" not in raw.columns:
        raise ValueError(f"no SepsisLabel column in {root}")

    def number(name: str):
        c = F.expr(f"try_cast(`{name}` AS double)") if name in raw.columns else F.lit(None).cast("double")
        return F.when(~F.isnan(c), c)

    hour = F.coalesce(number("ICULOS"), number("Hour")).cast("int")
    return raw.select(
        (F.col(stay_column) if stay_column else F.regexp_extract("_metadata.file_path", stay_pattern, 1)).alias("stay_id"), hour.alias("iculos"),
        F.coalesce(number("SepsisLabel"), F.lit(0.0)).cast("int").alias("sepsis_label"),
        *[number(src).alias(dst) for src, dst in MEASURES.items()])


def filled(hours: DataFrame, hot: bool | None = None) -> DataFrame:
    """Carry the last measured values forward within the stay."""
    return forward_fill(hours, ["stay_id"], ["iculos"], FILLED, hot)


def score_inputs(hours: DataFrame) -> DataFrame:
    """Filled hours under the scorer's input names. Ventilation is never assumed."""
    return hours.select(
        "stay_id", "iculos", "sepsis_label", F.col("map").alias("map_mmhg"), "platelets", "bilirubin", "creatinine",
        F.coalesce("o2sat", "sao2").alias("spo2"), oxygen_fraction(F.col("fio2")).alias("fio2"),
        F.lit(False).alias("ventilated"))


def onset_hour(hours: DataFrame) -> DataFrame:
    return hours.groupBy("stay_id").agg(F.min(F.when(F.col("sepsis_label") == 1, F.col("iculos"))).alias("onset_iculos"))
