"""Tables that last: keyed tables in copy-on-write buckets, retention that refolds only what it touched, and an audit log whose entries are chained.

Both are folders of Parquet and a small commit file per version. A commit file is created once and never overwritten, so of two writers one wins, a writer that dies before it leaves the
version before readable, and a batch that is run again finds its commit and does nothing. Data files are never changed.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.operators import store
from wardline.session import checkpointed

BUCKETS = 64


class Commits:
    """Numbered JSON files in a folder; a number is written once."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        self.files = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        if not self.files.exists(self.path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(self.path(self.folder))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def read(self, number: int) -> dict | None:
        """What a commit holds; None for one that was not written to its end."""
        text = self.spark.read.text(f"{self.folder}/{number}.json", wholetext=True).collect()
        try:
            return json.loads(text[0][0]) if text else None
        except json.JSONDecodeError:
            return None

    def newest(self, below: int | None = None) -> tuple[int, dict] | None:
        for n in reversed(self.numbers()):
            if (below is None or n < below) and (held := self.read(n)) is not None:
                return n, held
        return None

    def write(self, number: int, held: dict) -> bool:
        """Whether this writer wrote it. A file cut off by a lost writer is replaced."""
        at = self.path(f"{self.folder}/{number}.json")
        if self.files.exists(at) and self.read(number) is not None:
            return False
        aside = self.path(f"{self.folder}/{number}.{uuid.uuid4().hex}.tmp")
        out = self.files.create(aside, False)
        out.write(bytearray(json.dumps(held, sort_keys=True).encode()))
        out.close()
        if self.files.exists(at) and self.read(number) is None:
            self.files.delete(at, False)
        return bool(self.files.rename(aside, at))


@dataclass
class BucketTable:
    """Rows in buckets by a hash of ``keys``. A version names a folder for each bucket; a write makes new folders for the buckets it touches and takes the others over.

    ``clock``: a long column whose least value per bucket is kept in the version, so that a reader of old rows skips buckets without any.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: Sequence[str]
    clock: str
    buckets: int = BUCKETS

    @property
    def commits(self) -> Commits:
        return Commits(self.spark, f"{self.path}/versions")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def version(self, below: int | None = None) -> tuple[int, dict]:
        return self.commits.newest(below) or (-1, {})

    def read(self, held: dict | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """The newest version, or the one ``held`` describes; ``only`` so many of its buckets."""
        held = self.version()[1] if held is None else held
        folders = [b["folder"] for n, b in held.items() if only is None or int(n) in set(only)]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())  # at most as many as there are buckets

    def replace(self, number: int, rows: DataFrame, touched: Sequence[int], before: dict) -> bool:
        """Version ``number``: ``rows`` are all rows of the ``touched`` buckets, the others stay as in ``before``."""
        folder = f"{self.path}/data/{number}-{uuid.uuid4().hex}"
        rows = rows.select(*self.schema.fieldNames()).withColumn("bucket", self.bucket())
        rows.repartition("bucket").write.partitionBy("bucket").parquet(folder)
        written = self.spark.read.parquet(folder).groupBy("bucket").agg(F.min(self.clock).alias("least"), F.count("*").alias("rows")).collect() if self._has_rows(folder) else []
        held = {n: b for n, b in before.items() if int(n) not in set(touched)}
        held |= {str(r["bucket"]): {"folder": f"{folder}/bucket={r['bucket']}", "least": r["least"], "rows": r["rows"]} for r in written}
        return self.commits.write(number, held)

    def _has_rows(self, folder: str) -> bool:
        commits = self.commits
        return any(s.getPath().getName().startswith("bucket=") for s in commits.files.listStatus(commits.path(folder)))

    def merge(self, number: int, batch: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Version ``number`` from a batch: reads and writes only the buckets that the batch's keys fall into. Done before: nothing happens."""
        if number in self.commits.numbers() and self.commits.read(number) is not None:
            return False
        before = self.version(below=number)[1]
        touched = self.touched(batch)
        return self.replace(number, merged(self.read(before, touched), batch), touched, before)

    def vacuum(self, keep_versions: int = 2, older_than_s: float = 3600) -> int:
        """Remove versions but the newest, and data folders that no version left names and that nobody wrote to for a while; how many folders went."""
        commits = self.commits
        numbers = commits.numbers()
        for n in numbers[: max(0, len(numbers) - keep_versions)]:
            commits.files.delete(commits.path(f"{commits.folder}/{n}.json"), False)
        used = {b["folder"].rsplit("/", 1)[0].rsplit("/", 1)[1] for n in commits.numbers() for b in (commits.read(n) or {}).values()}
        gone = 0
        root = commits.path(f"{self.path}/data")
        for s in commits.files.listStatus(root) if commits.files.exists(root) else ():
            if s.getPath().getName() not in used and s.getModificationTime() / 1000 < time.time() - older_than_s:
                commits.files.delete(s.getPath(), True)
                gone += 1
        return gone


def upsert(table: BucketTable, batch: DataFrame, batch_id: int) -> bool:
    """Alerts of a batch into the table, by alert id; acknowledgements stay."""
    return table.merge(batch_id, batch, store.upsert_alerts)


def retain(alerts: BucketTable, folded: BucketTable, number: int, cutoff_us: int, keys: Sequence[str], fold: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
    """Version ``number`` of both tables without alerts before ``cutoff_us``: what was folded from them is folded again for the keys that lost any.

    Only buckets with rows that old are read. ``alerts`` and ``folded`` have the same buckets, by columns of ``keys``; ``fold`` is given all alerts left of the keys it is to fold.
    """
    _, before = alerts.version(below=number)
    _, folded_before = folded.version(below=number)
    due = [int(n) for n, b in before.items() if b["least"] < cutoff_us]
    if not due:
        alerts.commits.write(number, before)
        folded.commits.write(number, folded_before)
        return {"buckets": 0, "keys": 0}
    rows = alerts.read(before, due)
    lost = rows.where(F.col(alerts.clock) < cutoff_us).select(*keys).distinct()
    kept = rows.where(F.col(alerts.clock) >= cutoff_us)
    again = fold(_having(kept, lost, keys, "left_semi"))
    others = _having(folded.read(folded_before, due), lost, keys, "left_anti")
    folded.replace(number, others.unionByName(again.select(*folded.schema.fieldNames())), due, folded_before)
    alerts.replace(number, kept, due, before)  # last: until then a run again starts from the same alerts
    return {"buckets": len(due), "keys": lost.count()}


def _having(rows: DataFrame, wanted: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    other = wanted.select(*[F.col(k).alias(f"_w{i}") for i, k in enumerate(keys)])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_w{i}"))
    return rows.join(other, on, how)


def _chain(names: Sequence[str], seed: str):
    """Rows sorted by part and seq: each gets the hash of its text and of the hash before it in its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = link = None
        for batch in batches:
            links = []
            for own, text in zip(batch.column(names.index("part")).to_pylist(), batch.column(names.index("entry")).to_pylist()):
                if own != part:
                    part, link = own, hashlib.sha256(f"{seed}|{own}".encode()).hexdigest()
                link = hashlib.sha256(f"{link}|{text}".encode()).hexdigest()
                links.append(link)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(links, pa.string())], names=[*batch.schema.names, "link"])

    return run


@dataclass
class AuditLog:
    """An append-only log. Each epoch's entries lie in sorted parts; within a part every entry's link hashes the one before, a part begins from the epoch before, and the
    epoch's own link hashes the ends of its parts. So no entry can be changed, dropped or put in later without every later link being wrong."""

    spark: SparkSession
    path: str
    part_rows: int = 100_000

    @property
    def commits(self) -> Commits:
        return Commits(self.spark, f"{self.path}/epochs")

    @staticmethod
    def _sealed(before: str, epoch: int, ends: Sequence[tuple[int, str, int]]) -> str:
        return hashlib.sha256(json.dumps([before, epoch, [list(e) for e in sorted(ends)]]).encode()).hexdigest()

    def append(self, epoch: int, entries: DataFrame, order: Sequence[str]) -> bool:
        """Entries of one batch, in ``order``. An epoch that is there already stays as it is; epochs come in ascending order."""
        numbers = self.commits.numbers()
        if numbers and (max(numbers) > epoch or epoch in numbers and self.commits.read(epoch) is not None):
            return False
        last = self.commits.newest(below=epoch)
        before = last[1]["link"] if last else ""
        columns = entries.columns
        text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
        written = checkpointed(entries.select(*order, text.alias("entry")))  # counted, sampled and sorted: what gives the entries runs once
        parts = max(1, -(-written.count() // self.part_rows))
        rows = written.repartitionByRange(parts, *order, "entry").sortWithinPartitions(*order, "entry")
        rows = rows.select("entry", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("seq"))
        folder = f"{self.path}/data/{epoch}-{uuid.uuid4().hex}"
        rows.mapInArrow(_chain(["entry", "part", "seq"], before), "entry string, part int, seq long, link string").write.parquet(folder)
        ends = self.spark.read.parquet(folder).groupBy("part").agg(F.max_by("link", "seq").alias("link"), F.count("*").alias("n")).collect()  # one row per part
        ends = [(r["part"], r["link"], r["n"]) for r in ends]
        return self.commits.write(epoch, {"folder": folder, "before": before, "ends": ends, "link": self._sealed(before, epoch, ends), "schema": entries.schema.jsonValue()})

    def read(self) -> DataFrame | None:
        """Entries with their epoch, part, seq and link; None for an empty log."""
        out = None
        for n in self.commits.numbers():
            if held := self.commits.read(n):
                rows = self.spark.read.parquet(held["folder"]).withColumn("e", F.from_json("entry", T.StructType.fromJson(held["schema"]))).select(F.lit(n).alias("epoch"), "part", "seq", "link", "e.*")
                out = rows if out is None else out.unionByName(rows)
        return out

    def broken(self) -> list[int]:
        """Epochs whose entries, parts or place in the chain are not what was sealed."""
        wrong, before = [], ""
        for n in self.commits.numbers():
            held = self.commits.read(n)
            if held is None:
                continue
            ends = [tuple(e) for e in held["ends"]]
            rows = self.spark.read.parquet(held["folder"]).select("entry", "part", "seq", F.col("link").alias("told")).repartition("part").sortWithinPartitions("part", "seq")
            again = rows.mapInArrow(_chain(["entry", "part", "seq", "told"], held["before"]), "entry string, part int, seq long, told string, link string")
            seen = again.groupBy("part").agg(F.max_by("link", "seq").alias("link"), F.count("*").alias("n"), F.count_if(F.col("told") != F.col("link")).alias("off"), F.max("seq").alias("last")).collect()
            good = held["before"] == before and held["link"] == self._sealed(before, n, ends) and all(r["off"] == 0 and r["last"] == r["n"] - 1 for r in seen)
            if not good or sorted((r["part"], r["link"], r["n"]) for r in seen) != sorted(ends):
                wrong.append(n)
            before = held["link"]
        return wrong
