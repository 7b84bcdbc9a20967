"""Steps whose tasks have to stay the same size as the input grows."""

import pickle
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.test_stream_clock import COLUMNS, Handle, Map
from wardline.operators import latest, sampling
from wardline.catalog import episodes, load_all
from wardline.plans import stewardship
from wardline.sources import records, stays
from wardline.streaming import jobs, processors as PR
from wardline.streaming.tables import AuditLog


def test_draws_are_dealt_by_their_number(spark, monkeypatch):
    rows = spark.range(300).select(F.format_string("p%05d", "id").alias("stay_id"), (F.col("id") % 7).alias("x"))
    monkeypatch.setattr(sampling, "DRAWS_A_PARTITION", 1000)
    found = []
    for limit in (1000, 10):  # broadcast, and both sides shuffled
        monkeypatch.setattr(sampling, "BROADCAST_ROWS", limit)
        out = sampling.resampled(rows, ["stay_id"], 50)
        per_task = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(per_task) == 15_000 and max(per_task) <= 2_500
        found.append(sorted((r["replicate"], r["x"], r["n"]) for r in out.groupBy("replicate", "x").agg(F.count(F.lit(1)).alias("n")).collect()))
    assert found[0] == found[1]


def test_the_patient_exchange_grows_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(latest, "TASK_ROWS", 500)
    env = spark.range(20_000).select(
        F.concat(F.lit("Patient/"), F.col("id") % 2000).alias("patient_id"), F.concat(F.lit("ev-"), F.col("id") % 18_000).alias("idempotency_key"),
        F.col("id").alias("event_id"), (F.col("id") * 1000).alias("event_us"), (F.col("id") * 1000).alias("ingest_us"))
    shape = latest.shape_of(env)
    assert shape == (False, False, 20_000)
    rows = latest.mark_late(latest.deduplicate(env, shape), shape.hot)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 18_000 and max(sizes) < 1_500
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_a_feedback_text_is_classified_once(spark):
    rows = spark.createDataFrame([(1, " Wrong lab, chronic BASELINE"), (2, None), (3, "good catch, again"), (4, "thanks")], "feedback_id long, text string")
    out = stewardship.classify(rows)
    plan = out.groupBy("category").agg(F.min("feedback_id"), F.max("confidence"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
    found = {r["feedback_id"]: (r["category"], round(r["confidence"], 2), r["matched_hints"]) for r in out.collect()}
    assert found == {1: ("chronic_baseline", 0.7, ["chronic", "baseline"]), 2: ("abstain", 0.0, []), 3: ("repeated_episode", 0.55, ["again"]), 4: ("abstain", 0.0, [])}


def test_appending_to_the_audit_log_runs_its_entries_once(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    entries = spark.range(100).mapInArrow(counted, "id long")
    log = AuditLog(spark, str(tmp_path), part_rows=40)
    assert log.append(0, entries, ["id"]) and log.read().count() == 100 and log.broken() == []
    assert runs.value == 100


def test_stays_share_files(spark, sf, monkeypatch):
    seen = []
    read = stays.read_stays

    def counted(spark, path, *args, **kwargs):
        seen.append(len(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path).select("path").collect()))
        return read(spark, path, *args, **kwargs)

    monkeypatch.setattr(stays, "read_stays", counted)
    out = load_all()["stay_files"].run(spark, sf)
    assert out.select("stay_id").distinct().count() > seen[0] > 0


def test_a_stay_is_named_by_its_file_or_by_a_column(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "s1.psv").write_text("MAP|ICULOS|SepsisLabel\n70|1|0\nNaN|2|1\n")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "many.psv").write_text("stay|MAP|ICULOS|SepsisLabel\ns1|70|1|0\ns2|NaN|2|1\n")
    by_file = stays.read_stays(spark, str(tmp_path), "a").orderBy("iculos").select("stay_id", "iculos", "sepsis_label", "map").collect()
    assert [tuple(r) for r in by_file] == [("s1", 1, 0, 70.0), ("s1", 2, 1, None)]
    by_column = stays.read_stays(spark, str(tmp_path), "b", stay_column="stay").orderBy("iculos").select("stay_id", "iculos", "sepsis_label", "map").collect()
    assert [tuple(r) for r in by_column] == [("s1", 1, 0, 70.0), ("s2", 2, 1, None)]


def key_stream(batches, keys, step_us):
    """Batches of (key, arrival time) whose keys come again sooner or later; the first one comes within hours."""
    chance, now = random.Random(7), 0
    for i, n in enumerate(batches):
        batch = []
        for _ in range(n):
            now += chance.randrange(step_us if i else 60 * 10**6)
            batch.append((f"ev-{chance.randrange(keys)}", now))
        yield batch


@pytest.mark.parametrize("batches, keys, step_us", [([3, 200, 1, 40] * 6, 900, 60 * 10**6), ([400] + [5] * 60, 500, 6 * 3600 * 10**6)])
def test_keys_in_buckets_decide_as_keys_by_themselves(monkeypatch, batches, keys, step_us):
    monkeypatch.setattr(PR, "SEEN_KEYS", 8)
    each, buckets = Handle(), Handle()
    single, shared = PR.KeyEntries(each), PR.KeyBuckets(buckets)
    a, b, most = single.start(), shared.start(), 0
    for batch in key_stream(batches, keys, step_us):
        assert single.accept(a, batch) == shared.accept(b, batch)
        held = {k: pickle.loads(v[0]) for k, v in buckets.maps["keys"].items()}
        assert set(held) == {(n,) for n in range(b[0])} and sum(map(len, held.values())) == b[1]
        assert all(PR.KeyBuckets._place(k, b[0]) == n for (n,), part in held.items() for k in part)
        most = max(most, b[0])
    assert most > 4
    if step_us > 3600 * 10**6:  # long after the first batch its keys are gone, and so are most buckets
        assert b[1] < 60 and b[0] < most


def test_a_batch_asks_for_delivery_keys_by_the_bucket():
    processor = PR.SnapshotProcessor(COLUMNS, PR.SNAPSHOT_OUT, PR.KeyBuckets)
    processor.init(Handle())
    for day in (0, 2):  # the second batch also forgets the keys of the first
        rows = [("a", None, at, (day * 86_400 + n) * 10**6, f"ev-{day}-{n}", None, "refused", None, 1) for n, at in enumerate(range(day * 10**9 + 1, day * 10**9 + 61))]
        Map.touched = 0
        assert list(processor.handleInputRows(("a",), iter(rows + rows), None)) == [] or day
        assert Map.touched < 20


def test_a_stream_record_is_parsed_once(spark):
    for part in jobs._split_unreadable(records.stream_records(spark.range(3).selectExpr("cast(id AS string) AS value"))):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert plan.count("from_json(") == 1


def test_rows_packed_as_json_come_back_unchanged(spark):
    schema = T.StructType([T.StructField(n, t) for n, t in (
        ("k", T.StringType()), ("i", T.LongType()), ("x", T.DoubleType()), ("n", T.IntegerType()), ("f", T.BooleanType()), ("t", T.StringType()))])
    numbers = [0.1 + 0.2, 1e300, 5e-324, -0.0, 1e7, 123456789.123456789, float("nan"), float("inf"), float("-inf"), None]
    rows = [("p", 2**62 + n, x, n, n % 2 == 0, ['"NaN"', "Infinity", "é中\U0001f600\n\\", "", None][n % 5]) for n, x in enumerate(numbers)] + [(None,) * 6]

    class Through:
        columns = schema.fieldNames()

        def handleInputRows(self, key, rows, timer_values):
            return map(tuple, rows)

    texts = spark.createDataFrame(rows, schema).select(F.to_json(F.struct(*schema.fieldNames()), {"ignoreNullFields": "false"}).alias("packed")).collect()
    packed = PR.Packed(Through(), ["x"], schema)
    assert repr([packed._unpack(r["packed"]) for r in texts]) == repr(rows)
    out = spark.createDataFrame([tuple(r) for r in packed.handleInputRows(("p",), iter(texts), None)], PR.PACKED)
    back = out.select(F.from_json("packed", schema).alias("r")).select("r.*").collect()
    assert repr([tuple(r) for r in back]) == repr(rows)


def test_the_encounter_exchange_grows_with_the_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(latest, "TASK_ROWS", 50)
    shape = latest.Shape(False, False, 1_100)
    out = episodes.EP.audit_log(episodes.EP.arbitrate(episodes.by_encounter(episodes.signals(spark, sf, shape), shape), hot=False))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression [patient_id") == plan.count(", 22\n") > 0
    assert out.where("reason = 'episode_window_elapsed'").count() > 0


@pytest.mark.parametrize("name", ["episode_context", "episode_evidence", "episode_disclosure"])
def test_episodes_are_summed_up_in_as_many_tasks_as_the_rows_ask_for(spark, sf, monkeypatch, name):
    monkeypatch.setattr(latest, "TASK_ROWS", 50)
    monkeypatch.setattr(latest, "shape_of", lambda df: latest.Shape(False, False, 1_100))
    out = load_all()[name].run(spark, sf)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # Patients of both kinds of signals, encounters, episodes.
    assert "MergeJoin" not in plan and "HashJoin" not in plan and plan.count("Exchange hashpartitioning(") == plan.count(", 22), REPARTITION_BY_NUM") == 4


def test_an_episode_closed_by_the_next_one_is_resolved(spark):
    hour = 3_600_000_000
    rows = [("p", "e", "signal", f"s{n}", "aki", "urgent", "interruptive", False, at) for n, at in enumerate((0, hour, 4 * hour, 9 * hour))]
    signals = spark.createDataFrame(rows, "patient_id string, encounter_key string, event string, signal_id string, signal_type string, severity string, routing string, suppressed boolean, event_us long")
    steps = episodes.EP.arbitrate(signals, hot=False)
    found = episodes.EP.summarise(steps).orderBy("episode_no").select("episode_no", "opened_us", "n_signals", "status", "resolved_us", "updated_us").collect()
    assert [tuple(r) for r in found] == [(1, 0, 2, "resolved", hour, hour), (2, 4 * hour, 1, "resolved", 4 * hour, 4 * hour), (3, 9 * hour, 1, "open", None, 9 * hour)]
    # A step whose episode before is not among the rows tells of its own only.
    assert [r["episode_no"] for r in episodes.EP.summarise(steps.where("episode_no = 2")).collect()] == [2]
