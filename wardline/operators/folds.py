"""Ordered folds: row-by-row state machines over keyed, ordered rows.

Some decisions (refractory periods, baselines, episodes) depend on the previous decision and
cannot be written as a window. ``ordered_fold`` runs such a step function over each key in order
without ever holding a key's rows in memory. It has two layouts:

* *clustered* - every key in one partition, sorted; rows stream through Python in Arrow batches
  and only the state of the current key is alive. Used while the largest key has at most
  ``hot_rows`` rows, which is measured first.
* *ranged* - when a key is larger than that, rows are range-partitioned on (key, order), so a hot
  key spreads over as many partitions as its size asks for. Each partition starts from the state
  its predecessor ended with. A step that says what a stretch of rows does to any state (``Summary``:
  counts, sums, maxima, last values) needs one pass for that, and a prefix over the partitions' summaries.
  For other steps the states are found by running all partitions at once from a guess and re-running
  only the partitions whose guess turned out wrong: exact for any step function, one or two rounds for
  those that forget old rows, up to one round per partition of a key for those that do not. The driver
  holds one state per partition and no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wardline.session import checkpointed

HOT_ROWS = 1_000_000
CHUNK_ROWS = 2_000_000

Step = Callable[[Any, tuple], tuple[Any, tuple | None]]


class Summary(NamedTuple):
    """What a stretch of one key's rows does to a state that comes before it.

    ``add(summary, row)`` takes a row in, ``after(state, summary)`` is the state behind the stretch. A summary
    has a bounded size, whatever the number of rows.
    """

    start: Callable[[], Any]
    add: Callable[[Any, tuple], Any]
    after: Callable[[Any, Any], Any]


def largest_key(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the most frequent key; only the key columns are read and counts are combined map-side."""
    row = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return int(row["n"] or 0)


def _partitions(df: DataFrame, wanted: int | None) -> int:
    spark = df.sparkSession
    return wanted or max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )


def _rows(batch: pa.RecordBatch, names: Sequence[str]) -> Iterator[tuple]:
    index = batch.schema.get_field_index
    return zip(*[batch.column(index(n)).to_pylist() for n in names])


def _to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def _with_kept(batch: pa.RecordBatch, keep: Sequence[str], at: list[int], emitted: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Outputs behind the ``keep`` columns of their rows (``at``), which never become Python values."""
    index = batch.schema.get_field_index
    kept = [batch.column(index(n)) for n in keep]
    if len(at) < batch.num_rows:
        kept = [c.take(pa.array(at, pa.int64())) for c in kept]
    kept = [c if c.type == f.type else pa.array(c.to_pylist(), type=f.type) for c, f in zip(kept, schema)]
    fields = list(schema)[len(keep):]
    made = list(zip(*emitted)) if emitted else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([*kept, *[pa.array(c, type=f.type) for c, f in zip(made, fields)]], schema=schema)


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    inputs: Sequence[str],
    step: Step,
    start: Callable[[], Any],
    output: T.StructType,
    keep: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
    hot: bool | None = None,
    partitions: int | None = None,
    spread: bool = False,
    pack: Callable[[Any], Any] | None = None,
    unpack: Callable[[Any], Any] | None = None,
    summary: Summary | None = None,
) -> DataFrame:
    """Fold ``step`` over every key in order and return its outputs.

    ``step(state, row)`` gets the ``inputs`` of a row and returns the next state and the output
    tuple (or ``None`` for no output). ``keep`` columns are passed through in front of it. ``hot``
    says whether a key is over ``hot_rows``; when not given it is counted. ``spread`` gives the fold its
    own exchange on the keys: worth it when the rows were multiplied after the last one, as every task
    would otherwise fold many times what it read. ``pack`` and ``unpack`` turn a state into plain values and back
    where it goes from one partition to the next. ``summary`` makes the number of jobs over a very large key
    independent of how many partitions it fills.
    """
    keys, order, inputs, keep = list(keys), list(order), list(inputs), list(keep)
    columns = list(dict.fromkeys([*keys, *order, *inputs, *keep]))
    df = df.select(*columns)
    out_schema = T.StructType([df.schema[c] for c in keep] + list(output.fields))
    arrow_out = to_arrow_schema(out_schema)
    if hot is None:
        hot = largest_key(df, keys) > hot_rows
    if not hot:
        if spread:
            df = df.repartition(_partitions(df, partitions), *keys)
        return _clustered(df, keys, order, inputs, step, start, out_schema, arrow_out, keep)
    return _ranged(df, keys, order, inputs, step, start, out_schema, arrow_out, keep, partitions, pack or _same, unpack or _same, summary)


def _clustered(df, keys, order, inputs, step, start, out_schema, arrow_out, keep):
    # row_number asks for the key clustering and the sort; where the rows already lie that way
    # no exchange is added. It also marks where a new key begins.
    w = Window.partitionBy(*keys).orderBy(*order)
    placed = df.withColumn("_rn", F.row_number().over(w))

    def run(batches):
        state = None
        for batch in batches:
            at, out = [], []
            for i, (rn, *vals) in enumerate(_rows(batch, ["_rn", *inputs])):
                if rn == 1:
                    state = start()
                state, emitted = step(state, tuple(vals))
                if emitted is not None:
                    at.append(i)
                    out.append(emitted)
            if at:
                yield _with_kept(batch, keep, at, out, arrow_out)

    return placed.mapInArrow(run, out_schema)


_TAIL = T.StructType(
    [T.StructField("chunk", T.IntegerType()), T.StructField("state", T.BinaryType())]
)


def _same(state):
    return state


def _ranged(df, keys, order, inputs, step, start, out_schema, arrow_out, keep, partitions, pack, unpack, summary):
    n = partitions or max(_partitions(df, None), -(-df.count() // CHUNK_ROWS))
    # Range bounds are sampled, so the placement is written down before anything relies on it.
    placed = checkpointed(
        df.repartitionByRange(n, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_chunk", F.spark_partition_id())
    )
    key = F.struct(*[F.col(k) for k in keys])
    ends = placed.groupBy("_chunk").agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    bounds = {  # one row per partition
        r["_chunk"]: (tuple(r["_first"]), tuple(r["_last"])) for r in ends.collect()
    }
    chunks = sorted(bounds)
    before = {  # partitions that begin in the middle of a key
        c: p for p, c in zip(chunks, chunks[1:]) if bounds[p][1] == bounds[c][0]
    }
    whole = {c for c in chunks if bounds[c][0] == bounds[c][1]}
    # Only the last key of a partition can run on into the next one.
    last_rows = placed.join(F.broadcast(ends.select("_chunk", "_last")), "_chunk").where(
        key.eqNullSafe(F.col("_last"))
    ).drop("_last")

    n_keys = len(keys)
    tail_schema = to_arrow_schema(_TAIL)

    def tails(carry: dict[int, bytes]):
        def run(batches):
            chunk = state = None
            for batch in batches:
                for c, *vals in _rows(batch, ["_chunk", *inputs]):
                    if chunk is None:
                        chunk = c
                        state = unpack(pickle.loads(carry[c])) if c in carry else start()
                    state, _ = step(state, tuple(vals))
            if chunk is not None:
                yield _to_batch([(chunk, pickle.dumps(pack(state)))], tail_schema)

        return run

    def summaries(batches):
        chunk, held = None, summary.start() if summary else None
        for batch in batches:
            for chunk, *vals in _rows(batch, ["_chunk", *inputs]):
                held = summary.add(held, tuple(vals))
        if chunk is not None:
            yield _to_batch([(chunk, pickle.dumps(held))], tail_schema)

    carry: dict[int, bytes] = {}
    todo = sorted(set(before.values()))
    ended: dict[int, bytes] = {}
    if summary and todo:
        part = last_rows.where(F.col("_chunk").isin(todo))
        stretch = {r["chunk"]: pickle.loads(bytes(r["state"])) for r in part.mapInArrow(summaries, _TAIL).collect()}  # one per partition
        for c in todo:  # in the partitions' order, so a continued key's state is known before it is passed on
            state = unpack(pickle.loads(ended[before[c]])) if c in whole and c in before else start()
            ended[c] = pickle.dumps(pack(summary.after(state, stretch[c])))
        carry, todo = {c: ended[p] for c, p in before.items()}, []
    while todo:
        part = last_rows.where(F.col("_chunk").isin(todo))
        known = {c: carry[c] for c in todo if c in carry and c in whole}
        for r in part.mapInArrow(tails(known), _TAIL).collect():  # one state per partition
            ended[r["chunk"]] = bytes(r["state"])
        wrong = {c for c, p in before.items() if carry.get(c) != ended[p]}
        carry = {c: ended[p] for c, p in before.items()}
        # A partition holding nothing but the continued key passes the correction on.
        todo = sorted(c for c in wrong if c in whole and c in set(before.values()))

    def emit(batches):
        last = state = None
        for batch in batches:
            at, out = [], []
            for i, (c, *vals) in enumerate(_rows(batch, ["_chunk", *keys, *inputs])):
                now = tuple(vals[:n_keys])
                if now != last:
                    state = unpack(pickle.loads(carry[c])) if last is None and c in carry else start()
                    last = now
                state, emitted = step(state, tuple(vals[n_keys:]))
                if emitted is not None:
                    at.append(i)
                    out.append(emitted)
            if at:
                yield _with_kept(batch, keep, at, out, arrow_out)

    return placed.mapInArrow(emit, out_schema)
