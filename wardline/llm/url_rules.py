"""URL rules by a sorted sweep, in DataFrame functions only.

A rule (host, path) fits its host, all hosts below it, and paths that begin with its own. The canonical key is the host with its labels
reversed, ``/`` and the path, so the URLs under a rule are one interval of keys: from the rule's key to that key followed by byte FF, which no
UTF-8 text holds. A URL is looked up once for each of its host's ancestors (no more labels than the longest rule has). Rule starts, rule
ends and look-ups are range-sorted together; going along, the last start or end seen tells what is on top of the stack of open rules: a
start its own rule, an end the rule around it. What is open where a partition begins comes from one row per partition before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("/"), path).cast("binary")


def stacked(rules: DataFrame) -> DataFrame:
    """Start and end events of rules with what is open after each. Of equal rules with two verdicts, block holds."""
    own = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    labels = F.split("host", r"\.", -1)
    own = own.select(_key(labels, F.col("path")).alias("k"), F.struct(
        (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict").alias("top"))
    shorter = own.select("k", F.explode(F.sequence(F.lit(1), F.length("k"))).alias("n")).where(F.col("n") < F.length("k")).select("k", F.substring("k", F.lit(1), F.col("n")).alias("p"))
    around = shorter.join(own.select(F.col("k").alias("p"), F.col("top").alias("outer")), "p").groupBy("k").agg(F.max_by("outer", F.length("p")).alias("outer"))
    return own.select("k", F.lit(0).alias("kind"), F.struct("top").alias("event")).unionByName(
        own.join(around, "k", "left").select(F.concat("k", F.lit(bytearray(b"\xff"))).alias("k"), F.lit(0).alias("kind"), F.struct(F.col("outer").alias("top")).alias("event")))


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    ``rules``: host, path, verdict. The longest fitting rule wins (of equal lengths the one with the longer host); no rule: null and
    ``default``. A null URL or one without ``://`` has an empty host and path and fits no rule. Repeated rows stay; no pages give no rows,
    no rules give ``default`` for all; other columns are not read.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    deepest = rules.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0] or 0
    labels = F.split("host", r"\.", -1)
    n = F.size("labels")
    probes = (
        rows.select("host", "path").distinct().withColumn("labels", labels)
        .withColumn("depth", F.explode(F.sequence(F.lit(1), F.least(n, F.lit(max(1, deepest))))))
        .select("host", "path", _key(F.slice("labels", n - F.col("depth") + 1, F.col("depth")), F.col("path")).alias("k"), F.lit(1).alias("kind")))
    swept = probes.unionByName(stacked(rules), allowMissingColumns=True)
    swept = saved(swept.repartitionByRange("k", "kind", "host", "path").withColumn("part", F.spark_partition_id()), "url-sweep")
    along = Window.partitionBy("part").orderBy("k", "kind")
    last = swept.where("event is not null").groupBy("part").agg(F.max_by("event", "k").alias("event"))
    # one row per partition of the sorted table, whatever it holds
    parts = swept.select("part").distinct().join(last, "part", "left")
    carried = parts.select("part", F.last("event", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    tops = swept.withColumn("seen", F.last("event", ignorenulls=True).over(along)).where("kind = 1").join(F.broadcast(carried), "part")
    tops = tops.select("host", "path", F.coalesce("seen", "carried")["top"].alias("top"))
    best = tops.groupBy("host", "path").agg(F.max("top").alias("top"))
    return rows.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("top")["rule"].alias("rule"), F.coalesce(F.col("top")["verdict"], F.lit(default)).alias("verdict"))
