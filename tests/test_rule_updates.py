"""Rules as data: which updates count, the two forms of the same history, and governance on a stream whose rules change."""

import json
import random

import pytest

from wardline.functions.scores import SOFA_COMPONENTS
from wardline.operators import rule_history as RH
from wardline.rules import RuleError
from wardline.streaming import jobs as J
from wardline.streaming import ruled

T0 = 1_704_067_200_000_000
MINUTE = 60_000_000


def text(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def test_refused_updates(spark):
    good = {"bundle_id": "b", "version": "1.2.3", "available_time": "2024-01-01T00:00:00Z"}
    lines = [json.dumps(good), json.dumps(good | {"governance": {"min_crossings": 1}}), "{", None, json.dumps(good | {"bundle_id": " "}), json.dumps(good | {"available_time": "soon"}),
             json.dumps(good | {"version": "1.2"}), json.dumps(good | {"version": "1.2.3-rc+b"}), json.dumps(good | {"governance": {"nothing": 1}})]
    got = [r["reason"] for r in RH.rule_updates(text(spark, lines)).collect()]
    assert got == [None, None, "malformed_json", "malformed_json", "no_bundle", "invalid_timestamp", "invalid_version", None, "unknown_knobs"]
    with pytest.raises(RuleError):
        RH.governance_of('{"nothing": 1}')


def test_both_forms_hold_alike(spark):
    rng = random.Random(4)
    updates = [(f"b{rng.randrange(4)}", f"0.{rng.randrange(12)}.{rng.randrange(3)}", T0 + rng.randrange(40) * MINUTE, rng.random() < 0.25, rng.randrange(1, 4), json.dumps({"min_crossings": rng.randrange(5)}))
               for _ in range(60)]
    updates += updates[:5]
    table = spark.createDataFrame([(*u, None) for u in updates], "bundle_id string, version string, from_us long, withdrawn boolean, naive_threshold int, knobs string, reason string")
    moments = [(f"b{b}", T0 + m * MINUTE + d) for b in range(5) for m in range(-1, 41) for d in (0, 7)]
    alerts = spark.createDataFrame(moments, "rule_bundle_id string, event_us long")
    book = RH.RuleBook(updates)
    for r in RH.with_rules(alerts, table).collect():
        version, threshold, settings, ended = book.at(r["rule_bundle_id"], r["event_us"])
        assert (r["rule_version"], r["rule_threshold"], RH.governance_of(r["rule_knobs"]), r["rule_ended"]) == (version, threshold, settings, ended)
    assert RH.with_rules(alerts, table).count() == len(moments)


def alert(patient, minute, bundle="b", score=5):
    return json.dumps({"patient_id": patient, "event_us": T0 + minute * MINUTE, "idempotency_key": f"k-{patient}-{minute}", "rule_bundle_id": bundle, "score": score, "tier": "urgent"})


def run(spark, work, alerts, rules, groups=3, grace=0):
    schema = "patient_id string, event_us long, idempotency_key string, rule_bundle_id string, score int, tier string"
    spark.createDataFrame([(x,) for x in alerts], "value string").coalesce(1).write.mode("append").text(f"{work}/alerts")
    spark.createDataFrame([(x,) for x in rules], "value string").coalesce(1).write.mode("append").text(f"{work}/rules")
    rows = spark.readStream.schema(schema).json(f"{work}/alerts").selectExpr(
        "*", "cast(null AS string) AS encounter_id", "cast(null AS string) AS alert_id", "'i' AS indicator", "1 AS positive_components", "cast(null AS array<string>) AS context_flags",
        *[f"cast(null AS int) AS p_{c}" for c in SOFA_COMPONENTS])
    updates = RH.rule_updates(spark.readStream.format("text").load(f"{work}/rules"))
    J.run_available(ruled.governed_by_rules(rows, updates, SOFA_COMPONENTS, groups, grace), f"{work}/out", f"{work}/ck")
    return {(r["patient_id"], (r["event_us"] - T0) // MINUTE): (r["rule_version"], r["reason"]) for r in spark.read.parquet(f"{work}/out").collect()}


def rule(version, minute, withdrawn=False, **knobs):
    return json.dumps({"bundle_id": "b", "version": version, "available_time": f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z", "withdrawn": withdrawn, "governance": knobs})


def test_rules_change_between_batches_and_restarts(spark, tmp_path):
    fast = dict(min_crossings=1, trajectory_persistence_minutes=0, baseline_enabled=False)
    first = run(spark, tmp_path, [alert(p, m) for p in "xyz" for m in (0, 1)], [rule("1.0.0", 0, refractory_minutes=30, **fast)])
    assert first == {(p, m): ("1.0.0", "pass" if m == 0 else "refractory") for p in "xyz" for m in (0, 1)}
    # delivered together: a rule that holds from minute 10 on, one of a lower version, one that comes to hold later, and a withdrawal
    second = run(spark, tmp_path, [alert(p, m) for p in "xyz" for m in (5, 12, 40, 200, 400)] + [alert("x", 6, "other")],
                 [rule("1.1.0", 10, refractory_minutes=1, **fast), rule("1.0.9", 11, refractory_minutes=500, **fast), rule("1.2.0", 300, withdrawn=True), "{bad"])
    for p in "xyz":
        # the state outlives the change of settings: minute 12 is past the new refractory time since minute 0
        assert [second[p, m] for m in (5, 12, 40, 200)] == [("1.0.0", "refractory"), ("1.1.0", "pass"), ("1.1.0", "pass"), ("1.1.0", "pass")]
        assert second[p, 400] == (None, "trajectory_not_met")  # withdrawn: default settings, a fresh state
    assert second["x", 6] == (None, "trajectory_not_met")
    third = run(spark, tmp_path, [alert("x", 440)], [rule("2.0.0", 420, **fast)])
    assert third["x", 440] == ("2.0.0", "pass") and {k: v for k, v in third.items() if k != ("x", 440)} == second


class Maps:
    """State in memory behind the handle's calls."""

    def __init__(self):
        self.held = {}

    def getValueState(self, name, *_):
        return Value(self.held.setdefault(name, {}))

    def getMapState(self, name, *_):
        return Map(self.held.setdefault(name, {}))


class Value:
    def __init__(self, held):
        self.held = held

    def exists(self):
        return "v" in self.held

    def get(self):
        return self.held["v"]

    def update(self, v):
        self.held["v"] = v


class Map:
    def __init__(self, held):
        self.held = held

    def containsKey(self, k):
        return k in self.held

    def getValue(self, k):
        return self.held[k]

    def updateValue(self, k, v):
        self.held[k] = v

    def removeKey(self, k):
        self.held.pop(k)

    def iterator(self):
        return iter(list(self.held.items()))


def test_withdrawn_states_are_removed():
    columns = ["grp", *ruled.ALERT_COLUMNS, "context_flags", *[f"p_{c}" for c in SOFA_COMPONENTS], *ruled.RULE_COLUMNS]
    row = lambda **v: tuple(v.get(c) for c in columns)
    op, maps = ruled.RuledGovernance(columns, SOFA_COMPONENTS, grace_us=10 * MINUTE), Maps()
    op.init(maps)
    send = lambda rows: list(op.handleInputRows((0,), iter(rows), None))
    update = lambda v, m, w: row(bundle_id="b", version=v, from_us=T0 + m * MINUTE, withdrawn=w, naive_threshold=2, knobs="{}")
    at = lambda p, m, b: row(patient_id=p, event_us=T0 + m * MINUTE, idempotency_key="k", rule_bundle_id=b, score=3, tier="watch")
    send([update("1.0.0", 0, False)] + [at(f"p{i}", 1, "b") for i in range(5)] + [at("p0", 1, "c")])
    assert len(maps.held["states"]) == 6
    send([update("1.0.1", 5, True), at("p0", 6, "b")])
    assert len(maps.held["states"]) == 6  # others may still be on their way
    send([at("p9", 25, "c")])
    assert set(maps.held["states"]) == {("b", "p0"), ("c", "p0"), ("c", "p9")}  # p0 came after the withdrawal and counts anew
