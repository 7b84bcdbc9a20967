"""Tables that last: what a write touches, what a lost writer leaves, retention against a full rebuild, and a log that shows every change."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from wardline.streaming.tables import AuditLog, BucketTable, retain, upsert

ALERT = "alert_id string, patient_id string, event_us long, arrival int, tier string, acknowledged boolean, acknowledged_us long, acknowledge_note string, resolution_state string"


def alerts(spark, rows):
    return spark.createDataFrame([(a, p, t, n, tier, bool(ack), t if ack else None, None, "acknowledged" if ack else "open") for a, p, t, n, tier, ack in rows], ALERT)


def table(spark, path, buckets=8):
    return BucketTable(spark, str(path), alerts(spark, [("a", "p", 1, 0, "x", 0)]).schema, ["patient_id"], "event_us", buckets)


def found(t):
    return {r["alert_id"]: (r["tier"], r["acknowledged"]) for r in t.read().collect()}


def test_a_batch_writes_its_buckets_only(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().count() == 0
    assert upsert(t, alerts(spark, [(f"a{i}", f"p{i}", i, 0, "watch", i == 3) for i in range(40)]), 0)
    before = t.version()[1]
    assert upsert(t, alerts(spark, [("a3", "p3", 3, 1, "critical", 0), ("new", "p3", 50, 1, "urgent", 0)]), 1)
    after = t.version()[1]
    assert sum(after[n] != before[n] for n in before) == 1 and sum(b["rows"] for b in after.values()) == 41
    assert len(glob.glob(f"{tmp_path}/data/1-*/bucket=*")) == 1
    assert found(t)["a3"] == ("critical", True) and found(t)["new"] == ("urgent", False) and found(t)["a4"] == ("watch", False)
    assert not upsert(t, alerts(spark, [("a3", "p3", 3, 2, "none", 0)]), 1)  # the same batch again
    assert found(t)["a3"] == ("critical", True)


def test_lost_writers_leave_the_version_before(spark, tmp_path):
    t = table(spark, tmp_path)
    upsert(t, alerts(spark, [("a", "p", 1, 0, "watch", 0), ("b", "q", 2, 0, "watch", 0)]), 0)
    os.makedirs(f"{tmp_path}/data/1-lost/bucket=0")  # died before its commit
    with open(f"{tmp_path}/versions/1.json", "w") as f:  # or while it wrote it
        f.write('{"3": {"fold')
    assert found(t) == {"a": ("watch", False), "b": ("watch", False)}
    assert upsert(t, alerts(spark, [("a", "p", 1, 1, "urgent", 0)]), 1)
    assert found(t) == {"a": ("urgent", False), "b": ("watch", False)}


def test_old_versions_go_by_age(spark, tmp_path):
    t = table(spark, tmp_path, 2)
    for n in range(4):
        upsert(t, alerts(spark, [("a", "p", 1, n, f"t{n}", 0), ("b", "q", 2, n, f"t{n}", 0)]), n)
    assert t.vacuum(keep_versions=1, older_than_s=3600) == 0
    upsert(t, alerts(spark, [("a", "p", 1, 9, "t9", 0)]), 9)
    assert t.vacuum(keep_versions=1, older_than_s=0) >= 3
    assert found(t)["a"][0] == "t9" and found(t)["b"][0] == "t3"


@pytest.mark.parametrize("cutoff", [0, 30, 1000])
def test_retention_folds_again_what_lost_rows(spark, tmp_path, cutoff):
    rows = [(f"a{i}", f"p{i % 25}", 10 * (i % 25) + i // 25, 0, "watch", 0) for i in range(100)]
    t = table(spark, tmp_path / "alerts")
    folds = []

    def fold(df):
        folds.append(sorted(r[0] for r in df.select("patient_id").distinct().collect()))
        return df.groupBy("patient_id").agg(F.min("event_us").alias("event_us"), F.count("*").alias("n"))

    upsert(t, alerts(spark, rows), 0)
    first = fold(t.read())
    f = BucketTable(spark, str(tmp_path / "folded"), first.schema, ["patient_id"], "event_us", 8)
    f.merge(0, first, lambda _, new: new)
    held = t.version()[1]
    unread = [b["folder"] for b in held.values() if b["least"] >= cutoff]
    hidden = {d: d + "-hidden" for d in unread} if unread and len(unread) < len(held) else {}
    for a, b in hidden.items():  # reading them would fail
        os.rename(a.removeprefix("file:"), b)
    del folds[:]
    did = retain(t, f, 1, cutoff, ["patient_id"], fold)
    for a, b in hidden.items():
        os.rename(b, a.removeprefix("file:"))
    lost = sorted({p for _, p, at, *_ in rows if at < cutoff})
    assert did["keys"] == len(lost) and (not folds or set(folds[0]) <= set(lost))
    want = {}
    for _, p, at, *_ in rows:
        if at >= cutoff:
            want.setdefault(p, []).append(at)
    assert {r["patient_id"]: (r["event_us"], r["n"]) for r in f.read().collect()} == {p: (min(x), len(x)) for p, x in want.items()}
    assert t.read().count() == sum(map(len, want.values()))


def entries(spark, n, start=0):
    return spark.createDataFrame([(i, f"entry {i}", None if i % 3 else "why") for i in range(start, start + n)], "at long, what string, reason string")


def test_audit_log(spark, tmp_path):
    log = AuditLog(spark, str(tmp_path), part_rows=40)
    assert log.read() is None and log.broken() == []
    assert log.append(0, entries(spark, 100), ["at"]) and log.append(3, entries(spark, 50, 100), ["at"]) and log.append(4, entries(spark, 0), ["at"])
    assert not log.append(3, entries(spark, 50, 100), ["at"]) and not log.append(1, entries(spark, 5), ["at"])
    assert log.broken() == [] and sorted(r["at"] for r in log.read().collect()) == list(range(150))
    assert log.read().select("part").distinct().count() > 1
    for epoch, change in ((0, lambda df: df.withColumn("entry", F.replace("entry", F.lit("entry 7\""), F.lit("entry 8\"")))), (3, lambda df: df.where("seq <> 1"))):
        copy = AuditLog(spark, str(tmp_path / f"copy{epoch}"))
        for n in (0, 3, 4):
            held = log.commits.read(n)
            if n == epoch:
                change(spark.read.parquet(held["folder"])).write.parquet(f"{copy.path}/data/changed")
                held["folder"] = f"{copy.path}/data/changed"
            copy.commits.write(n, held)
        assert copy.broken() == [epoch]
    dropped = AuditLog(spark, str(tmp_path / "dropped"))  # an epoch left out
    for n in (0, 4):
        dropped.commits.write(n, log.commits.read(n))
    assert dropped.broken() == [4]
    forged = log.commits.read(3) | {"ends": []}
    assert not log.commits.write(3, forged) and json.dumps(log.commits.read(3)["ends"]) != "[]"
