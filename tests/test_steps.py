"""Edge cases of the step functions that batch and stream jobs share."""

import itertools
import random

import pytest

from wardline.operators.episodes import EpisodeRules, episode_one, episode_start
from wardline.operators.governance import govern_one, governance_start
from wardline.operators.timeline import History
from wardline.rules import Governance

M, H = 60_000_000, 3_600_000_000
OPEN = Governance(trajectory_persistence_minutes=0, min_crossings=1, baseline_enabled=False, refractory_minutes=0)


def run(g, alerts):
    """alerts: (minute, score, tier[, encounter[, flag[, positive[, points]]]])"""
    st, out = governance_start(), []
    for a in alerts:
        minute, score, tier, enc, flag, positive, points = (*a, *(None,) * (7 - len(a)))
        r = govern_one(st, g, minute * M, enc, score, tier, flag, positive, points or {}, None)
        out.append(r[1] if r[1] != "pass" else r[2])
    return out


def test_late_rows_leave_the_state_alone():
    assert run(OPEN, [(10, 4, "urgent"), (5, 9, "critical"), (10, 4, "urgent")]) == ["interruptive", "late_out_of_order", "interruptive"]
    # Accepted when the late check is off, but a step back in time has not persisted.
    assert run(OPEN.patched(reject_late_out_of_order=False), [(10, 4, "urgent"), (5, 9, "critical")])[1] == "trajectory_not_met"


def test_late_clock_survives_a_new_encounter():
    assert run(OPEN, [(10, 4, "urgent", "A"), (5, 4, "urgent", "B")])[1] == "late_out_of_order"


def test_refractory_is_strict():
    g = OPEN.patched(refractory_minutes=60)
    assert run(g, [(0, 4, "urgent"), (59, 4, "urgent"), (60, 4, "urgent")]) == ["interruptive", "refractory", "interruptive"]


def test_gap_resets_only_beyond_the_limit():
    g = OPEN.patched(min_crossings=2)
    assert run(g, [(0, 4, "urgent"), (60, 4, "urgent")])[1] == "interruptive"
    assert run(g, [(0, 4, "urgent"), (61, 4, "urgent")])[1] == "trajectory_not_met"


def test_crossings_count_distinct_times():
    g = OPEN.patched(min_crossings=2)
    assert run(g, [(0, 4, "urgent"), (0, 5, "urgent"), (1, 5, "urgent")]) == ["trajectory_not_met"] * 2 + ["interruptive"]


def test_tier_none_ends_the_streak_even_under_a_flag():
    g = OPEN.patched(min_crossings=2)
    assert run(g, [(0, 4, "urgent"), (10, 0, "none"), (20, 4, "urgent")]) == ["trajectory_not_met", "below_threshold", "trajectory_not_met"]


def test_baseline_starts_expires_and_asks_for_a_rise():
    g = OPEN.patched(baseline_enabled=True, baseline_lookback_hours=1)
    assert run(g, [(0, 4, "urgent"), (10, 5, "urgent"), (60, 6, "urgent"), (61, 6, "urgent")]) == [
        "baseline_init", "below_baseline_delta", "interruptive", "baseline_init"]


def test_flags_stick_to_the_encounter_and_the_smallest_is_named():
    rows = [(0, 4, "urgent", "A", "comfort_care"), (1, 4, "urgent", "A"), (2, 4, "urgent", "A", "already_on_sepsis_protocol"), (3, 4, "urgent", "B")]
    assert run(OPEN, rows) == ["context:comfort_care", "context:comfort_care", "context:already_on_sepsis_protocol", "interruptive"]


def test_first_named_encounter_clears_what_came_before():
    assert run(OPEN, [(0, 4, "urgent", None, "comfort_care"), (1, 4, "urgent", "A")])[1] == "interruptive"


def test_page_gate_defers_to_the_watch_lane():
    g = OPEN.patched(page_gate_enabled=True, page_min_crossings=2, page_trajectory_persistence_minutes=30, page_min_score_delta=1,
                     page_min_positive_components=2)
    rows = [(0, 4, "urgent", "A", None, 3), (20, 5, "urgent", "A", None, 3), (40, 4, "urgent", "A", None, 3), (50, 5, "urgent", "A", None, 1),
            (55, 5, "urgent", "A", None, 2)]
    assert run(g, rows) == ["pass_watch:page_crossings", "pass_watch:page_persistence", "pass_watch:page_not_rising",
                            "pass_watch:page_components", "interruptive"]
    assert run(g, [(0, 2, "watch")]) == ["passive"]


def test_component_gates_compare_with_the_last_emitted_vector():
    g = OPEN.patched(page_gate_enabled=True, page_min_crossings=1, page_trajectory_persistence_minutes=0, page_min_score_delta=0,
                     page_min_newly_worsened_components=1, page_min_component_delta=2, page_high_actionability_components=("renal",))
    rows = [(0, 4, "urgent", "A", None, None, {"renal": 3, "cns": 1}), (10, 4, "urgent", "A", None, None, {"renal": 3, "cns": 1}),
            (20, 5, "urgent", "A", None, None, {"renal": 4, "cns": 1}), (30, 7, "urgent", "A", None, None, {"renal": 4, "cns": 3})]
    assert run(g, rows) == ["interruptive", "pass_watch:page_component_delta", "pass_watch:page_component_delta_min",
                            "pass_watch:page_high_actionability"]


def episodes(events, rules=EpisodeRules(), in_order=True):
    """events: (minute, id, type, tier[, routing]) or (minute, 'ack' | 'resolve')"""
    s, out = episode_start(), []
    for e in events:
        if len(e) == 2:
            out.append(episode_one(s, rules, in_order, e[1], "", None, None, None, False, e[0] * M))
        else:
            out.append(episode_one(s, rules, in_order, "signal", e[1], e[2], e[3], e[4] if len(e) > 4 else None, False, e[0] * M))
    return out


def test_three_signals_one_page():
    out = episodes([(0, "a", "aki", "urgent"), (5, "b", "sofa-deterioration", "urgent"), (9, "c", "hypotension", "urgent")])
    assert [o[2] for o in out] == ["page", "passive", "passive"]
    assert out[-1][6] == "sofa-deterioration" and out[-1][8] == ["aki", "hypotension"]


def test_escalation_inside_the_refractory_stays_passive():
    out = episodes([(0, "a", "aki", "urgent"), (10, "b", "aki", "critical"), (70, "c", "aki", "critical")])
    assert [o[3] for o in out] == ["new_episode_interruptive", "passive_update_within_page_refractory", "new_actionable_signal"]


def test_window_elapses_and_opens_anew():
    out = episodes([(0, "a", "aki", "watch"), (120, "b", "aki", "watch"), (241, "c", "aki", "watch")])
    assert [o[1] for o in out] == [1, 1, 2] and [o[14] for o in out] == [False, False, True]


def test_reopen_after_resolve():
    near = episodes([(0, "a", "aki", "watch"), (10, "resolve"), (40, "b", "aki", "urgent")])
    far = episodes([(0, "a", "aki", "watch"), (10, "resolve"), (41, "b", "aki", "urgent")])
    assert (near[2][1], near[2][3]) == (1, "reopened_escalated") and far[2][1] == 2


def test_acknowledged_episode_escalates_on_an_actionable_signal():
    out = episodes([(0, "a", "aki", "watch"), (5, "ack"), (10, "b", "aki", "watch"), (20, "c", "aki", "urgent")])
    assert [o[5] for o in out] == ["open", "acknowledged", "acknowledged", "escalated"]


def test_duplicate_signal_changes_nothing():
    out = episodes([(0, "a", "aki", "urgent"), (0, "a", "aki", "urgent")])
    assert out[1][2:4] == ("none", "duplicate_signal_id") and out[1][9] == 1


def test_opener_does_not_depend_on_arrival_order():
    events = [(0, "a", "aki", "watch"), (30, "b", "aki", "urgent"), (60, "c", "hypotension", "watch")]
    for order in itertools.permutations(events):
        s = episode_start()
        for e in order:
            episode_one(s, EpisodeRules(), False, "signal", e[1], e[2], e[3], None, False, e[0] * M)
        assert s["no"] == 1 and s["opened"] == 0 and s["updated"] == 60 * M and s["dominant"] == "aki"


def kidney(rows, at=None):
    s, t = History(), 0
    for kind, hour, eid, value in rows:
        t = round(hour * H)
        cr = value if kind == "creatinine" else None
        ml, d, rate, an = value if kind == "urine" else (None,) * 4
        s.add(kind, t, eid, cr, ml, d, rate, an, value if kind == "weight" else None, kind == "esrd", kind == "rrt")
    return dict(zip(("status", "stage", "cr", "uo", "cur", "base", "ref", "w", "r6", "r12", "r24", "an", "criteria", "missing"),
                    s.result(t if at is None else round(at * H))))


@pytest.mark.parametrize("later,stage", [(1.29, 0), (1.31, 1)])
def test_absolute_rise_within_two_days(later, stage):
    assert kidney([("creatinine", 0, "a", 1.0), ("creatinine", 24, "b", later)])["stage"] == stage


def test_baseline_outside_a_week_is_not_used():
    r = kidney([("creatinine", 0, "a", 1.0), ("creatinine", 169, "b", 2.5)])
    assert (r["base"], r["stage"]) == (2.5, 0)


def test_corrected_lab_replaces():
    r = kidney([("creatinine", 0, "a", 1.0), ("creatinine", 5, "b", 3.5), ("creatinine", 5, "b", 1.1)])
    assert (r["cur"], r["stage"]) == (1.1, 0)


def test_urine_needs_weight_and_coverage():
    urine = [("urine", h, f"u{h}", (20.0, 1.0, None, False)) for h in range(1, 7)]
    assert kidney(urine)["missing"] == ["creatinine", "weight_kg", "urine_output"]
    r = kidney([("weight", 0, "w", 80.0), *urine])
    assert round(r["r6"], 4) == 0.25 and r["r12"] is None and r["criteria"] == ["uo_lt_0_5_for_6h"]
    assert kidney([("weight", 0, "w", 80.0), *urine[:5]])["r6"] is None


def test_rates_given_per_weight_and_anuria():
    assert kidney([("urine", 12, "u", (None, 12.0, 0.4, False))])["uo"] == 2
    assert kidney([("urine", 12, "u", (None, 12.0, None, True))])["criteria"] == ["anuria_ge_12h"]


def test_renal_failure_and_replacement_therapy():
    assert kidney([("creatinine", 0, "a", 9.0), ("esrd", 1, "f", None)])["status"] == "excluded"
    r = kidney([("esrd", 0, "f", None), ("rrt", 1, "g", None)])
    assert (r["status"], r["stage"], r["criteria"]) == ("scored", 3, ["rrt"])


def test_governance_is_a_function_of_event_order():
    rng = random.Random(3)
    rows = [(t, rng.randint(0, 9), None) for t in sorted(rng.sample(range(500), 60))]
    rows = [(t, s, "none" if s < 2 else "watch" if s < 4 else "urgent" if s < 7 else "critical") for t, s, _ in rows]
    assert run(Governance(), rows) == run(Governance(), sorted(rows, key=lambda r: r[0]))
