"""No stamp in a record decides whether Spark drops it."""

import json

import pytest

from wardline.streaming import jobs as J
from wardline.streaming import processors as PR


def line(patient, hour, key, ingest=""):
    code = {"coding": [{"system": "http://loinc.org", "code": "2160-0"}]}
    return json.dumps({"patient_id": patient, "event_time": f"2024-01-02T{hour:02}:00:00Z", "ingest_time": ingest, "idempotency_key": key, "resource": {
        "resourceType": "Observation", "id": key, "status": "final", "code": code, "valueQuantity": {"value": 1.0, "unit": "mg/dL"}}})


#: The second batch is five hours late in event time, and in arrival where it is stamped; a stamp of the first one lies in the future.
FIRST = [line("a", 12, "a12"), line("b", 12, "b12", "2024-01-02T12:00:00Z"), line("f", 12, "f12", "2999-01-01T00:00:00Z")]
SECOND = [line("a", 7, "a07"), line("b", 7, "b07", "2024-01-02T07:00:00Z"), line("c", 7, "c07"), line("d", 7, "d07", "2024-01-02T07:00:00Z"),
          *[line(p, 23, f"flush-{p}") for p in "abcdf"]]


@pytest.mark.parametrize("stream", [J.snapshot_stream, J.kidney_stream])
def test_late_records_of_a_later_batch(spark, tmp_path, stream):
    incoming, out = tmp_path / "in", str(tmp_path / "out")
    incoming.mkdir()
    for n, batch in enumerate((FIRST, SECOND)):
        (incoming / f"{n}.txt").write_text("\n".join(batch) + "\n")
        J.run_available(stream(J.json_records(spark, str(incoming))), out, str(tmp_path / "ck"))
    got = {r["idempotency_key"]: r["reason"] for r in spark.read.parquet(out).collect()}
    assert got == {"a12": None, "b12": None, "f12": None, "a07": "late_beyond_lateness", "b07": "late_beyond_lateness", "c07": None, "d07": None}


class Map(dict):
    """Map state that counts what is read and written, and refuses to be walked."""

    touched = 0

    def containsKey(self, k):
        Map.touched += 1
        return k in self

    def getValue(self, k):
        Map.touched += 1
        return self[k]

    def updateValue(self, k, v):
        Map.touched += 1
        self[k] = v

    def removeKey(self, k):
        Map.touched += 1
        self.pop(k, None)

    def iterator(self):
        raise AssertionError("the whole state is walked")


class Value:
    kept = None
    exists, get = lambda self: self.kept is not None, lambda self: self.kept

    def update(self, v):
        self.kept = v


class Handle:
    def __init__(self):
        self.timers, self.maps = [], {}

    def getValueState(self, *a):
        return Value()

    def getMapState(self, name, *a):
        return self.maps.setdefault(name, Map())

    def registerTimer(self, ms):
        self.timers.append(ms)


class Expired:
    def __init__(self, ms):
        self.getExpiryTimeInMs = lambda: ms


COLUMNS = ["patient_id", "encounter_id", "event_us", "ingest_us", "idempotency_key", "component", "reason", "context_flag", "read_us"]


def started():
    """A processor on counted state; its rows are refused ones, so that no step runs."""
    processor, handle = PR.SnapshotProcessor(COLUMNS, PR.SNAPSHOT_OUT), Handle()
    processor.init(handle)

    def batch(*rows, read_us=0):
        """Rows are (event second, arrival second, delivery key)."""
        given = [("a", None, at * 10**6, seen * 10**6, key, None, "refused", None, read_us) for at, seen, key in rows]
        return [(r["idempotency_key"], r["reason"]) for r in processor.handleInputRows(("a",), iter(given), None)]

    return processor, handle, batch


def test_lone_record_waits_by_the_reading_clock():
    """The timer is five minutes after reading, not after a stamp, and the record comes out when it expires."""
    processor, handle, batch = started()
    assert batch((12, 10**9, "k"), read_us=7_000_123) == [] and handle.timers == [307_000]
    assert [r["idempotency_key"] for r in processor.handleExpiredTimer(("a",), None, Expired(307_000))] == ["k"]
    assert list(processor.handleExpiredTimer(("a",), None, Expired(307_000))) == [] and not handle.maps["pending_pieces"] and not handle.maps["waits"]


def test_records_come_out_in_event_order_when_due():
    _, handle, batch = started()
    assert batch((1000, 1, "e"), (995, 2, "c"), (997, 3, "d"), read_us=1) == []
    assert batch((990, 4, "b"), (600, 5, "late"), read_us=2) == [("late", "late_beyond_lateness")]
    assert batch((1296, 6, "x"), read_us=3) == [("b", "refused"), ("c", "refused")]
    assert batch((1700, 7, "y"), read_us=4) == [("d", "refused"), ("e", "refused"), ("x", "refused")]
    assert len(handle.maps["pending_pieces"]) == 1


def test_equal_stamps_are_all_kept():
    """Records without a delivery key and with equal stamps are different records."""
    _, _, batch = started()
    assert batch((10, 1, None), (10, 1, None), read_us=1) == []
    assert batch((10, 1, None), read_us=2) == []
    assert batch((400, 2, "z"), read_us=3) == [(None, "refused")] * 3


@pytest.mark.parametrize("waiting", [10, 3000])
def test_a_batch_touches_what_is_due_only(waiting):
    """State reads and writes of a batch do not grow with what waits and what was delivered."""
    _, _, batch = started()
    batch(*[(1000 + n % 200, 10, f"w{n}") for n in range(waiting)], read_us=1)
    Map.touched = 0
    assert batch((1100, 20, "more"), read_us=2) == []
    assert batch((1101, 21, "w3"), read_us=3) == []
    assert Map.touched < 20


def test_delivery_keys_are_forgotten_after_a_day():
    _, handle, batch = started()
    hour = 3600
    batch((1, 0, "old"), (2, 23 * hour, "new"), read_us=1)
    assert batch((3, 23 * hour, "old"), read_us=2) == [] and set(handle.maps["seen"]) == {("old",), ("new",)}
    batch((4, 25 * hour, "next"), read_us=3)
    assert set(handle.maps["seen"]) == {("new",), ("next",)}
    assert batch((5, 26 * hour, "old"), (400, 26 * hour, "end"), read_us=4) == [(k, "refused") for k in ("old", "new", "next", "old")]
