"""The ranged layout of a fold gives exactly what the clustered one gives."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.operators import latest
from wardline.operators.folds import Summary, largest_key, ordered_fold
from wardline.operators.quantiles import quantiles

OUT = T.StructType([T.StructField("out", T.LongType())])


def greedy(last, row):
    """Refractory: accept a value at least 7 after the last accepted one."""
    if last is None or row[0] - last >= 7:
        return row[0], (row[0],)
    return last, None


def total(s, row):
    """Never forgets: every partition depends on all before it."""
    return s + row[0], (s + row[0],)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [("hot", t) for t in rng.sample(range(40_000), 3000)]
    data += [(f"k{i % 40}", t) for i, t in enumerate(rng.sample(range(50_000), 2000))]
    data += [(None, 5), (None, 9), (None, 13)]
    return spark.createDataFrame(data, "k string, t long").repartition(5).cache()


@pytest.mark.parametrize("step,start", [(greedy, lambda: None), (total, lambda: 0)])
@pytest.mark.parametrize("partitions", [3, 16])
def test_ranged_equals_clustered(rows, step, start, partitions):
    args = (["k"], ["t"], ["t"], step, start, OUT)
    plain = ordered_fold(rows, *args, keep=["k", "t"], hot=False)
    split = ordered_fold(rows, *args, keep=["k", "t"], hot=True, partitions=partitions)
    key = lambda r: (r["k"] or "", r["t"])
    assert sorted(plain.collect(), key=key) == sorted(split.collect(), key=key)


def test_hot_key_spreads_over_partitions(rows):
    split = ordered_fold(rows, ["k"], ["t"], ["t"], total, lambda: 0, OUT, keep=["k"], hot=True, partitions=16)
    parts = split.where("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts >= 6


def test_all_one_key(spark):
    df = spark.range(0, 1000).selectExpr("'x' AS k", "id AS t")
    split = ordered_fold(df, ["k"], ["t"], ["t"], total, lambda: 0, OUT, hot=True, partitions=9)
    assert max(r["out"] for r in split.collect()) == sum(range(1000))
    assert largest_key(df, ["k"]) == 1000


def test_empty(spark):
    df = spark.createDataFrame([], "k string, t long")
    for hot in (False, True):
        assert ordered_fold(df, ["k"], ["t"], ["t"], total, lambda: 0, OUT, hot=hot).count() == 0


def test_summary_stands_for_its_rows():
    """The state behind a stretch follows from the state before it and the stretch's summary alone."""
    rng = random.Random(3)
    fields = 3
    step, start, summary = latest.snapshot_step(fields), latest.snapshot_start(fields), latest.snapshot_summary(fields)

    def row():
        component = rng.choice("ab")
        values = [rng.choice([None, rng.randrange(9)]) if (component == "a") == (i < 2) else None for i in range(fields)]
        return (rng.choice([None, None, " ", "e1", "e2"]), component, rng.randrange(4), rng.randrange(4), *values)

    for _ in range(3000):
        state, held = start(), summary.start()
        for r in [row() for _ in range(rng.randrange(6))]:
            state, _ = step(state, r)
        wanted = state
        for r in [row() for _ in range(rng.randrange(7))]:
            wanted, _ = step(wanted, r)
            held = summary.add(held, r)
        assert summary.after(state, held) == wanted


@pytest.mark.parametrize("null_opens", [False, True])
def test_summarised_folds_equal_windows(spark, null_opens):
    rng = random.Random(11)
    data = [(rng.choice(["hot", "hot", "hot", "k", None]), n, rng.choice([None, None, " ", "a", "b"]), rng.choice([None, n, -n])) for n in range(1500)]
    df = spark.createDataFrame(data, "k string, t long, encounter_id string, v long").repartition(4)

    def rows(d):
        return sorted(map(repr, d.select(sorted(d.columns)).collect()))

    for run in (lambda hot: latest.numbered(df, ["k"], ["t"], "n", hot), lambda hot: latest.forward_fill(df, ["k"], ["t"], ["v", "encounter_id"], hot),
                lambda hot: latest.running_sum(df.fillna(0, "v"), ["k"], ["t"], "v", "s", hot),
                lambda hot: latest.encounter_scope(df, ["t"], ["k"], null_opens, hot)):
        assert rows(run(True)) == rows(run(False))


def test_jobs_do_not_grow_with_partitions(spark):
    """A fold that never forgets takes as many jobs over twenty partitions of one key as over three."""
    df = spark.range(0, 4000).selectExpr("'x' AS k", "id AS t")
    summed = Summary(lambda: 0, lambda s, row: s + row[0], lambda s, n: s + n)

    def jobs(partitions, summary):
        group = f"fold-{partitions}-{summary is None}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            out = ordered_fold(df, ["k"], ["t"], ["t"], total, lambda: 0, OUT, hot=True, partitions=partitions, summary=summary)
            assert max(r["out"] for r in out.collect()) == sum(range(4000))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(20, summed) == jobs(3, summed) < jobs(20, None)


@pytest.mark.parametrize("hot", [False, True])
def test_quantiles_equal_percentile(spark, hot):
    rng = random.Random(5)
    data = [(rng.choice(["a", "a", "b", None]), rng.choice([None, rng.random(), float(rng.randrange(5))])) for _ in range(900)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(data, "k string, x double").repartition(4)
    names = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    wanted = df.where("x IS NOT NULL").groupBy("k").agg(*[F.percentile("x", p).alias(n) for n, p in names.items()])
    got = {r["k"]: r for r in quantiles(df, ["k"], F.col("x"), names, hot).collect()}
    assert len(got) == 4
    for r in wanted.collect():
        assert [got[r["k"]][n] for n in names] == pytest.approx([r[n] for n in names], abs=1e-12)
    assert quantiles(df.where("false"), ["k"], F.col("x"), names, hot).count() == 0
