"""Availability-ordered replay of ICU stays: leakage-safe scores, ablations, cohort summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions import scores as S
from wardline.operators import episodes as EP
from wardline.operators import latest, timeline
from wardline.operators.folds import ordered_fold
from wardline.operators.governance import govern
from wardline.rules import Candidate, RuleError

HOUR_US = 3_600_000_000
# Observation codes the replay scores.
REPLAY_CODES = {"777-3": ("coagulation", "platelets"), "1975-2": ("liver", "bilirubin"), "2160-0": ("renal", "creatinine"),
                "2708-6": ("respiration", "spo2"), "8478-0": ("cardiovascular", "map_mmhg"), "9269-2": ("cns", "gcs")}
CREATININE_ITEMS = (50912, 52546, 220615)
ORDER = ("available_us", "event_us", "evidence_id")


def is_creatinine() -> Column:
    return (F.col("code") == "2160-0") | F.coalesce(F.col("itemid").isin(*CREATININE_ITEMS), F.lit(False))


def replayed(rows: DataFrame, order: Sequence[str] = ORDER, hot: bool | None = None) -> DataFrame:
    """Score after every fact as it becomes known.

    A component holds its last fact. Discharge diagnoses are never features; facts of other codes count
    as unmapped. ``clock_us`` is the time the fact became known in the given order.
    """
    usable = ~F.col("is_discharge_diagnosis")
    held = {}
    for code, (name, _) in REPLAY_CODES.items():
        here = (F.col("code") == code) if name != "renal" else is_creatinine() & F.col("valuenum").isNotNull()
        held[f"_{name}"] = F.when(usable & here, F.struct(F.col("valuenum").alias("v"), F.col("evidence_id").alias("e")))
    mapped = F.col("code").isin(*REPLAY_CODES) | is_creatinine()
    marked = rows.withColumns({**held, "unmapped": usable & ~F.coalesce(mapped, F.lit(False))})
    filled = latest.forward_fill(marked, ["stay_id"], list(order), list(held), hot)
    filled = latest.numbered(filled, ["stay_id"], list(order), "position", hot)
    values = {field: F.col(f"_{name}.v") for name, field in REPLAY_CODES.values()}
    values["gcs"] = values["gcs"].cast("int")
    evidence = F.array_compact(F.array(*[F.col(f"_{c}.e") for c in S.SOFA_COMPONENTS]))
    out = filled.withColumns({**values, "evidence_ids": evidence, "clock_us": F.col(order[0])}).drop(*held)
    scored = S.sofa_total(S.sofa_points(out), 1)
    return scored.withColumn("tier", S.tier(F.col("score"), bands=None))


def snapshots(replay: DataFrame) -> DataFrame:
    """Rows that have anything to score."""
    return replay.where(F.size("evidence_ids") > 0)


def leakage(snaps: DataFrame, rows: DataFrame) -> DataFrame:
    """Evidence a snapshot may not have used: unknown, not yet available, or a discharge diagnosis."""
    used = snaps.select("stay_id", "position", "clock_us", F.explode("evidence_ids").alias("evidence_id"))
    facts = rows.select("stay_id", "evidence_id", F.col("available_us").alias("_at"), "is_discharge_diagnosis",
                        F.lit(True).alias("_known"))
    checked = used.join(facts, ["stay_id", "evidence_id"], "left")
    return checked.withColumn("violation", F.when(F.col("_known").isNull(), "unknown_evidence").when(
        F.col("_at") > F.col("clock_us"), "not_yet_available").when(
        F.col("is_discharge_diagnosis"), "discharge_diagnosis")).where(F.col("violation").isNotNull()).drop("_known", "_at")


def kidney_replay(rows: DataFrame, order: Sequence[str] = ORDER, hot: bool | None = None) -> DataFrame:
    """Kidney stage after every fact once a creatinine is known, evaluated at the availability clock."""
    out = T.StructType([T.StructField("stage", T.IntegerType()), T.StructField("kidney_status", T.StringType())])

    def step(s, row):
        creatinine, value, event_us, evidence, clock = row
        if creatinine and value is not None:
            s.add("creatinine", event_us, evidence, value)
        if not s.samples:
            return s, (None, None)
        result = s.result(clock)
        return s, (result[1], result[0])

    marked = rows.withColumn("_cr", is_creatinine() & ~F.col("is_discharge_diagnosis"))
    folded = ordered_fold(marked, ["stay_id"], list(order), ["_cr", "valuenum", "event_us", "evidence_id", order[0]], step,
                          timeline.History, out, keep=["stay_id", "event_us", "evidence_id", order[0]], hot=hot, pack=timeline.History.facts, unpack=timeline.History)
    return folded.withColumn("score", S.stage_score(F.col("stage"))).withColumns({
        "tier": S.stage_tier(F.col("score")), "clock_us": F.col(order[0])})


def study_signals(rows: DataFrame, hot: bool | None = None) -> DataFrame:
    """Both indicators' alerts in replay order: organ dysfunction before kidney at the same fact."""
    sofa = snapshots(replayed(rows, hot=hot)).where(F.col("tier") != "none").select(
        "stay_id", "position", F.lit("sofa-deterioration").alias("indicator"), "clock_us", "score", "tier", "positive_components",
        (F.col("completeness") == "partial").alias("partial"))
    where = latest.numbered(rows.select("stay_id", *ORDER), ["stay_id"], list(ORDER), "position", hot).select("stay_id", "evidence_id", "position")
    kidney = kidney_replay(rows, hot=hot).where((F.col("kidney_status") == "scored") & (F.col("tier") != "none")).join(
        where, ["stay_id", "evidence_id"])
    kidney = kidney.select("stay_id", "position", F.lit("aki").alias("indicator"), "clock_us", "score", "tier",
                           F.lit(1).alias("positive_components"), F.lit(False).alias("partial"))
    both = sofa.unionByName(kidney)
    signal = F.concat_ws("-", F.lpad(F.col("position").cast("string"), 12, "0"),
                         F.when(F.col("indicator") == "aki", "1").otherwise("0"), "indicator", "stay_id")
    return both.withColumns({"alert_id": signal, "event_us": F.col("clock_us"), "encounter_id": F.concat(F.lit("Encounter/"), "stay_id")})


def ablated(signals: DataFrame, candidates: Sequence[Candidate], hot: bool | None = None) -> DataFrame:
    """Signals governed per stay, indicator and candidate; the ungoverned candidate lets everything through."""
    governed = [c for c in candidates if c.governed]
    free = [c for c in candidates if not c.governed]
    cols = ["stay_id", "indicator", "config_id", "alert_id", "event_us", "score", "tier"]
    # The candidate list is a fixed study setting.
    rows = signals.withColumn("config_id", F.explode(F.array(*[F.lit(c.candidate_id) for c in governed])))
    out = govern(rows, {c.candidate_id: c.governance for c in governed}, keys=("stay_id", "indicator", "config_id"),
                 order=("event_us", "alert_id"), keep=cols, hot=hot, spread=True).select(*cols, "emit", "routing")
    for c in free:
        out = out.unionByName(signals.withColumn("config_id", F.lit(c.candidate_id)).select(
            *cols, F.lit(True).alias("emit"),
            F.when(F.col("tier").isin("urgent", "critical"), "interruptive").otherwise("passive").alias("routing")))
    return out


def episode_counts(ablation: DataFrame, candidates: Sequence[Candidate], hot: bool | None = None) -> DataFrame:
    """Episodes per stay and candidate; without arbitration every emitted alert is its own episode."""
    arbitrated = [c.candidate_id for c in candidates if c.use_episodes]
    emitted = ablation.where("emit")
    refs = EP.signal_refs(emitted.where(F.col("config_id").isin(arbitrated)).select(
        F.col("stay_id").alias("patient_id"), F.col("config_id").alias("encounter_id"), "alert_id", "indicator", "tier", "routing", "event_us"))
    steps = EP.arbitrate(refs, hot=hot)
    with_arb = steps.groupBy(F.col("patient_id").alias("stay_id"), F.col("encounter_key").alias("config_id")).agg(
        F.max("episode_no").cast("long").alias("episodes"))
    alone = emitted.where(~F.col("config_id").isin(arbitrated)).groupBy("stay_id", "config_id").agg(F.count(F.lit(1)).alias("episodes"))
    return with_arb.unionByName(alone)


def stay_results(signals: DataFrame, ablation: DataFrame, episodes: DataFrame, stays: DataFrame,
                 candidates: Sequence[Candidate], before_h: int = 12, after_h: int = 6) -> DataFrame:
    """One row per stay and candidate. ``stays`` has stay_id, split_id, onset_us, patient_days, partial."""
    onset = F.col("onset_us")
    lo, hi = onset - before_h * HOUR_US, onset + after_h * HOUR_US
    s = signals.join(stays.select("stay_id", "onset_us"), "stay_id")
    sofa = F.col("indicator") == "sofa-deterioration"
    inside = F.col("event_us").between(lo, hi)
    naive = s.groupBy("stay_id").agg(
        F.count_if(sofa).alias("naive_alerts"), F.count_if(sofa & F.col("tier").isin("urgent", "critical")).alias("naive_interruptive"),
        F.max(sofa & inside).alias("naive_hit"))
    a = ablation.join(stays.select("stay_id", "onset_us"), "stay_id").where("emit")
    page = F.col("routing") == "interruptive"
    gov = a.groupBy("stay_id", "config_id").agg(
        F.count(F.lit(1)).alias("governed_alerts"), F.count_if(page).alias("interruptive_alerts"),
        F.min(F.when(inside, F.col("event_us"))).alias("governed_first"), F.max(page & inside).alias("page_hit"))
    grid = stays.withColumn("config_id", F.explode(F.array(*[F.lit(c.candidate_id) for c in candidates])))
    out = grid.join(naive, "stay_id", "left").join(gov, ["stay_id", "config_id"], "left").join(episodes, ["stay_id", "config_id"], "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("naive_alerts", "naive_interruptive", "governed_alerts", "interruptive_alerts", "episodes")}
    no = {c: F.coalesce(c, F.lit(False)) for c in ("naive_hit", "page_hit")}
    return out.withColumns({**zero, **no})


def summarise(rows: DataFrame, keys: Sequence[str] = ("config_id",)) -> DataFrame:
    """Cohort summary with burden per 100 patient days and both endpoint flags."""
    pos = F.col("onset_us").isNotNull()
    found = F.col("governed_first").isNotNull()
    lead = F.when(pos, (F.col("onset_us") - F.col("governed_first")) / float(HOUR_US))
    m = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("stays"), F.count_if(pos).alias("labeled"), F.count_if(pos & F.col("naive_hit")).alias("naive_found"),
        F.count_if(pos & found).alias("governed_found"), F.count_if(pos & F.col("page_hit")).alias("page_found"),
        F.sum("naive_alerts").alias("naive_alerts"), F.sum("naive_interruptive").alias("naive_interruptive"),
        F.sum("governed_alerts").alias("governed_alerts"), F.sum("interruptive_alerts").alias("interruptive_alerts"),
        F.sum("episodes").alias("episodes"), F.count_if(~pos & (F.col("episodes") > 0)).alias("false_episodes"),
        F.sum("patient_days").alias("patient_days"), F.avg(lead).alias("mean_lead_hours"), F.count_if("partial").alias("partial_stays"))
    c = F.col

    def ratio(a: str, b: str) -> Column:
        return F.when(c(b) > 0, c(a) / c(b))

    m = m.withColumns({
        "naive_sensitivity": ratio("naive_found", "labeled"), "governed_sensitivity": ratio("governed_found", "labeled"),
        "interruptive_sensitivity": ratio("page_found", "labeled"),
        "interruptive_reduction": F.coalesce(ratio("interruptive_alerts", "naive_interruptive"), ratio("interruptive_alerts", "naive_alerts")),
        "interruptive_nna": ratio("interruptive_alerts", "page_found"),
        **{f"{n}_per_100_days": F.when(c("patient_days") > 0, 100.0 * c(col) / c("patient_days")) for n, col in (
            ("alerts", "governed_alerts"), ("pages", "interruptive_alerts"), ("episodes", "episodes"))}})
    return m.withColumns({
        "meets_pe1": F.coalesce((c("governed_sensitivity") >= c("naive_sensitivity") - 0.10) | (c("governed_sensitivity") >= 0.70), F.lit(False)),
        "meets_pe2": F.coalesce(c("interruptive_reduction") <= 0.25, F.lit(False))})


def pick_operating_point(summary: DataFrame) -> DataFrame:
    """Least burden among the candidates that meet the primary endpoint, or among all when none does."""
    from pyspark.sql import Window

    # One row per candidate: the list is a fixed study setting.
    any_ok = F.max("meets_pe1").over(Window.partitionBy(F.lit(1)))
    pool = summary.withColumn("_any", any_ok).where(F.col("meets_pe1") | ~F.col("_any")).drop("_any")
    return pool.orderBy(F.coalesce("interruptive_reduction", F.lit(1.0)), F.coalesce("interruptive_nna", F.lit(1e9)),
                        F.coalesce("governed_sensitivity", F.lit(-1.0)).desc(), "config_id").limit(1)


# Fixed values of the study protocol: split aliases and what may run on which split.
SPLIT_ALIASES = {
    "test": ("test", "holdout", "temporal_holdout", "locked_holdout", "set_test", "mimic_test"),
    "development": ("dev", "develop", "train", "training", "development"),
    "calibration": ("cal", "calib", "validation", "val", "calibration"),
}
TUNING = frozenset({"sweep", "tune", "grid_search", "threshold_search", "operating_point_selection", "ablation_design", "feature_debug"})
ALLOWED = {
    "development": frozenset({"sweep", "ablation_design", "feature_debug"}),
    "calibration": frozenset({"operating_point_selection", "threshold_choice", "report_dev_metrics"}),
    "test": frozenset({"locked_primary_eval", "locked_ablation_eval", "bootstrap_ci"}),
}


def split_name(raw: str) -> str:
    text = (raw or "").strip().lower().replace("-", "_")
    return next((k for k, names in SPLIT_ALIASES.items() if text in names), text)


def split_column(raw: Column) -> Column:
    text = F.replace(F.lower(F.trim(F.coalesce(raw, F.lit("")))), F.lit("-"), F.lit("_"))
    case = text
    for name, aliases in SPLIT_ALIASES.items():
        case = F.when(text.isin(*aliases), name).otherwise(case)
    return case


def allow(split: str, command: str) -> str:
    """Name of the split when the command may run on it; tuning never runs on the test split."""
    name, cmd = split_name(split), (command or "").strip().lower()
    if name not in ALLOWED:
        raise RuleError(f"unknown study split {split!r}")
    if cmd in TUNING and cmd not in ALLOWED[name]:
        raise RuleError(f"{command!r} is not allowed on split {name!r}")
    return name


def on_split(rows: DataFrame, split: str, command: str) -> DataFrame:
    """Rows of one split, refused before any job starts when the command may not see it."""
    return rows.where(split_column(F.col("split_id")) == allow(split, command))


def not_locked(as_of: str, locked_start: str | None, locked_end: str | None, site: str = "") -> None:
    """A site profile is not tuned inside its locked test period."""
    if locked_start and locked_end and locked_start <= as_of <= locked_end:
        raise RuleError(f"site {site!r} is locked from {locked_start} to {locked_end}")


def lock_decisions(requests: DataFrame, locks: DataFrame) -> DataFrame:
    """``requests`` (``site_id``, ``as_of`` date, ``command``) with ``allowed`` and the ``refusal``.

    Tuning is refused from the first to the last day of a site's locked test period (``locks``: ``site_id``,
    ``locked_start``, ``locked_end``); a period without both ends locks nothing, nor does a site without one.
    Other commands may run. The data form of ``not_locked``.
    """
    period = locks.select(F.col("site_id").alias("_site"), F.col("locked_start").alias("_from"), F.col("locked_end").alias("_to"))
    inside = F.col("as_of").between(F.col("_from"), F.col("_to")) & F.trim(F.lower("command")).isin(*sorted(TUNING))
    held = F.coalesce(inside, F.lit(False))
    return requests.join(period, F.col("site_id") == F.col("_site"), "left").withColumns({
        "allowed": ~held,
        "refusal": F.when(held, F.concat(F.lit("site "), F.col("site_id"), F.lit(" is locked from "), F.col("_from"), F.lit(" to "), F.col("_to")))}).drop("_site", "_from", "_to")
