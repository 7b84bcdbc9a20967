"""Rule bundle files and their activation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalog.base import READINGS, query
from wardline.sources import projection as P
from wardline.sources import rule_files as RF

SCORERS = ("sofa", "aki_kdigo", "resp_hypoxemia", "hemo_shock")
# One file per event; four events share a bundle, the first and the last of them sometimes its version.
_NAME = "CASE WHEN k % 13 = 9 THEN concat('notes-', event_id, '.txt') ELSE concat('b', {group}, '.v1.', event_id % 3, '.0.json') END"
_BODY = """CASE k % 13 WHEN 0 THEN '{{"bundle_id": "b' WHEN 1 THEN '{{"version":"1.0.0","indicator":"x","score":{{"type":"sofa"}}}}' WHEN 2 THEN concat('{{"bundle_id":"b', {group}, '","indicator":"x","score":{{}}}}')
  WHEN 3 THEN concat('{{"bundle_id":"b', {group}, '","version":"1.', event_id % 3, '.0","score":{{"type":"sofa"}}}}') WHEN 4 THEN concat('{{"bundle_id":"b', {group}, '","version":"1.', event_id % 3, '.0","indicator":"x"}}')
  ELSE concat('{{"bundle_id":"', CASE WHEN k % 13 = 10 THEN 'other' ELSE concat('b', {group}) END, '","version":"', CASE k % 13 WHEN 5 THEN 'one.two' WHEN 6 THEN '9.9.9' ELSE concat('1.', event_id % 3, '.0') END,
    '","indicator":"x","score":{{"type":"', CASE k % 13 WHEN 7 THEN '' WHEN 8 THEN 'oracle' ELSE 'hemo_shock' END, '"}}}}') END"""
_SQL = f"""WITH {READINGS},
files AS (SELECT event_id, {_NAME.format(group='event_id // 4')} AS name, {_BODY.format(group='event_id // 4')} AS body FROM rd),
parts AS (SELECT *, regexp_extract(name, '{RF.NAME}', 1) AS fb, regexp_extract(name, '{RF.NAME}', 2) AS fv, CASE WHEN json_valid(body) THEN body ELSE '{{}}' END AS j FROM files),
checked AS (SELECT *, CASE WHEN fb = '' THEN 'file_name' WHEN count(*) OVER (PARTITION BY fb, fv) > 1 THEN 'duplicate_version' WHEN NOT json_valid(body) THEN 'malformed'
  WHEN (j->'bundle_id') IS NULL THEN 'missing:bundle_id' WHEN (j->'version') IS NULL THEN 'missing:version' WHEN (j->'indicator') IS NULL THEN 'missing:indicator' WHEN (j->'score') IS NULL THEN 'missing:score'
  WHEN NOT regexp_matches((j->>'version'), '{RF.VERSION}') THEN 'bad_version' WHEN (j->>'bundle_id') <> fb THEN 'bundle_mismatch' WHEN (j->>'version') <> fv THEN 'version_mismatch'
  WHEN coalesce((j->'score'->>'type'), '') = '' THEN 'no_score_type' WHEN (j->'score'->>'type') NOT IN {SCORERS} THEN 'unknown_scorer' END AS error FROM parts)"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    return P.readings(spark, sf).selectExpr(
        "event_id", f"{_NAME.format(group='event_id div 4')} AS name", f"{_BODY.format(group='event_id div 4')} AS body")


@query("rule_file_checks", "SRC-13", f"""{_SQL}
SELECT event_id, name, error FROM checked""")
def rule_file_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Bundle files with what is wrong with them: name against content, versions, fields, scorers."""
    return RF.checked_bundles(files(spark, sf), SCORERS).select("event_id", "name", "error")


@query("rule_activation", "SRC-13", f"""{_SQL},
act AS (SELECT 'b' || event_id AS bundle_id, '1.' || (event_id % 4) || '.0' AS version FROM rd)
SELECT a.bundle_id, a.version, coalesce(min(CASE WHEN c.fb IS NOT NULL THEN coalesce(c.error, 'ok') END), 'not_found') AS verdict
FROM act a LEFT JOIN checked c ON c.fb = a.bundle_id AND c.fv = a.version GROUP BY 1, 2""")
def rule_activation(spark: SparkSession, sf: str) -> DataFrame:
    """Whether every activated version has a usable file."""
    active = P.readings(spark, sf).select(F.concat(F.lit("b"), "event_id").alias("bundle_id"), F.concat(F.lit("1."), F.col("event_id") % 4, F.lit(".0")).alias("version"))
    return RF.activation_report(RF.checked_bundles(files(spark, sf), SCORERS), active)
