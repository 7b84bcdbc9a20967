"""Registry and the SQL building blocks shared by the oracle statements."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None):
    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, tuple(ids.split()), fn, sql)
        return fn

    return add


# The clinical reading of ``events``, one row per event.
READINGS = """
base AS (
  SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         (epoch_us(ts) - 1704067200000000) // 20 AS coff
  FROM events),
coded AS (
  SELECT *, CASE event_type WHEN 'click' THEN '2160-0' WHEN 'view' THEN '777-3' WHEN 'purchase' THEN '1975-2'
    WHEN 'signup' THEN '8478-0' ELSE CASE WHEN k < 34 THEN '9269-2' WHEN k < 67 THEN '2708-6' ELSE '3150-0' END
    END AS code
  FROM base),
rd AS (
  SELECT event_id, user_id, k, event_type, value AS raw_value, 'Patient/' || user_id AS patient_id,
    CASE WHEN event_id % 17 = 0 THEN NULL
         ELSE 'Encounter/' || user_id || '-' || (coff // 43200000000) END AS encounter_id,
    1704067200000000 + coff AS event_us,
    1704067200000000 + coff + (event_id % 13) * 60000000::BIGINT AS ingest_us,
    'ev-' || event_id AS idempotency_key, code,
    CASE code WHEN '2160-0' THEN 0.5::DOUBLE + value / 60 WHEN '777-3' THEN greatest(5::DOUBLE, 260 - 1.5::DOUBLE * value)
      WHEN '1975-2' THEN value / 30 WHEN '8478-0' THEN greatest(30::DOUBLE, 100 - value / 3)
      WHEN '9269-2' THEN greatest(3::DOUBLE, 15 - floor(value / 20))
      WHEN '2708-6' THEN greatest(70::DOUBLE, 100 - value / 8)
      ELSE least(100::DOUBLE, 21 + value / 3) END AS reading,
    CASE WHEN event_id % 23 = 0 THEN 'bad' ELSE
      CASE code WHEN '2160-0' THEN 'mg/dL' WHEN '777-3' THEN '10*9/L' WHEN '1975-2' THEN 'mg/dL'
      WHEN '8478-0' THEN 'mmHg' WHEN '9269-2' THEN '{score}' ELSE '%' END END AS unit,
    CASE WHEN event_id % 29 = 0 THEN 'entered-in-error' ELSE 'final' END AS status,
    CASE k WHEN 0 THEN 'comfort_care' WHEN 1 THEN 'already_on_sepsis_protocol' END AS context_flag
  FROM coded)"""

# Redeliveries, duplicate removal, lateness by arrival order, validation.
ARRIVED = READINGS + """,
env AS (
  SELECT * FROM rd
  UNION ALL SELECT * REPLACE (ingest_us + 60000000 AS ingest_us) FROM rd WHERE event_id % 31 = 0),
ded AS (
  SELECT * FROM env
  QUALIFY row_number() OVER (PARTITION BY patient_id, idempotency_key ORDER BY ingest_us, event_id) = 1),
arr AS (
  SELECT *, coalesce(event_us < max(event_us) OVER (PARTITION BY patient_id ORDER BY ingest_us, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 300000000, false) AS late
  FROM ded),
mp AS (
  SELECT *, CASE WHEN status <> 'final' THEN 'invalid_status:' || status
      WHEN unit = 'bad' AND code NOT IN ('9269-2', '3150-0') THEN 'invalid_unit'
      WHEN code = '9269-2' AND (trunc(reading) < 3 OR trunc(reading) > 15) THEN 'invalid_gcs_range'
      WHEN code = '3150-0' AND NOT (reading > 0 AND reading <= 100) THEN 'invalid_fio2_range' END AS reason,
    CASE code WHEN '777-3' THEN 'coagulation' WHEN '1975-2' THEN 'liver' WHEN '2160-0' THEN 'renal'
      WHEN '9269-2' THEN 'cns' WHEN '8478-0' THEN 'cardiovascular' ELSE 'respiration' END AS component
  FROM arr)"""

_FIELD = "last_value(CASE WHEN code = '{c}' THEN {v} END IGNORE NULLS) OVER w AS {n}"
# Latest value of every input per patient and encounter scope.
SNAPSHOTS = ARRIVED + """,
usable AS (SELECT * FROM mp WHERE NOT late AND reason IS NULL),
enc1 AS (
  SELECT *, last_value(encounter_id IGNORE NULLS) OVER (PARTITION BY patient_id ORDER BY event_us, idempotency_key
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS enc_before,
    last_value(encounter_id IGNORE NULLS) OVER (PARTITION BY patient_id ORDER BY event_us, idempotency_key
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS encounter_now
  FROM usable),
enc2 AS (
  SELECT *, sum(CASE WHEN encounter_id <> enc_before THEN 1 ELSE 0 END) OVER (PARTITION BY patient_id
      ORDER BY event_us, idempotency_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS scope
  FROM enc1),
snap AS (
  SELECT *, """ + ",\n    ".join(
    _FIELD.format(c=c, v=v, n=n) for c, v, n in (
        ("777-3", "reading", "platelets"), ("1975-2", "reading", "bilirubin"), ("2160-0", "reading", "creatinine"),
        ("9269-2", "trunc(reading)::INT", "gcs"), ("2708-6", "reading", "spo2"), ("8478-0", "reading", "map_mmhg"),
        ("3150-0", "CASE WHEN reading > 1 THEN reading / 100 ELSE reading END", "fio2"))) + """
  FROM enc2
  WINDOW w AS (PARTITION BY patient_id, scope ORDER BY event_us, idempotency_key
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

POINTS = """
    CASE WHEN spo2 IS NULL OR fio2 IS NULL OR fio2 <= 0 THEN NULL WHEN spo2 / fio2 < 300 THEN 2
         WHEN spo2 / fio2 < 400 THEN 1 ELSE 0 END AS p_respiration,
    CASE WHEN platelets < 20 THEN 4 WHEN platelets < 50 THEN 3 WHEN platelets < 100 THEN 2
         WHEN platelets < 150 THEN 1 WHEN platelets >= 150 THEN 0 END AS p_coagulation,
    CASE WHEN bilirubin >= 12 THEN 4 WHEN bilirubin >= 6 THEN 3 WHEN bilirubin >= 2 THEN 2
         WHEN bilirubin >= 1.2 THEN 1 WHEN bilirubin < 1.2 THEN 0 END AS p_liver,
    CASE WHEN map_mmhg < 70 THEN 1 WHEN map_mmhg >= 70 THEN 0 END AS p_cardiovascular,
    CASE WHEN gcs < 6 THEN 4 WHEN gcs <= 9 THEN 3 WHEN gcs <= 12 THEN 2 WHEN gcs <= 14 THEN 1
         WHEN gcs = 15 THEN 0 END AS p_cns,
    CASE WHEN creatinine >= 5 THEN 4 WHEN creatinine >= 3.5 THEN 3 WHEN creatinine >= 2 THEN 2
         WHEN creatinine >= 1.2 THEN 1 WHEN creatinine < 1.2 THEN 0 END AS p_renal"""

_NAMES = ("respiration", "coagulation", "liver", "cardiovascular", "cns", "renal")
PRESENT = " + ".join(f"(p_{n} IS NOT NULL)::INT" for n in _NAMES)
TOTAL = " + ".join(f"coalesce(p_{n}, 0)" for n in _NAMES)
POSITIVE = " + ".join(f"(coalesce(p_{n}, 0) > 0)::INT" for n in _NAMES)
MISSING = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN p_{n} IS NULL THEN '{n}' END" for n in _NAMES) + "], lambda x: x IS NOT NULL), ',')"


def tier_sql(score: str, low: str = "2", urgent: int = 4, critical: int = 7) -> str:
    return (f"CASE WHEN {score} IS NULL OR {score} < {low} THEN 'none' WHEN {score} >= {critical} THEN 'critical' "
            f"WHEN {score} >= {urgent} THEN 'urgent' ELSE 'watch' END")


SCORED = SNAPSHOTS + f""",
pts AS (SELECT *, {POINTS} FROM snap),
tot AS (
  SELECT *, {PRESENT} AS n_present, {POSITIVE} AS positive_components, {MISSING} AS missing,
    CASE WHEN {PRESENT} >= 3 THEN {TOTAL} END AS score,
    CASE WHEN {PRESENT} < 3 THEN 'insufficient_data' WHEN {PRESENT} < 6 THEN 'partial' ELSE 'complete' END
      AS completeness
  FROM pts),
scored AS (SELECT *, {tier_sql('score')} AS tier FROM tot)"""


def uuid_sql(raw: str) -> str:
    h = f"md5({raw})"
    return (f"(substr({h},1,8) || '-' || substr({h},9,4) || '-3' || substr({h},14,3) || '-' || "
            f"translate(substr({h},17,1),'0123456789abcdef','89ab89ab89ab89ab') || substr({h},18,3) || '-' || "
            f"substr({h},21,12))")


def alert_id_sql(indicator: str, version: str, enc: str = "encounter_now", score: str = "score") -> str:
    raw = (f"patient_id || '|' || coalesce({enc}, '') || '|{indicator}|' || coalesce({score}::VARCHAR, 'null') "
           f"|| '|' || (event_us // 1000) || '|{version}'")
    return f"'alert-' || {uuid_sql(raw)}"


def joined(column) -> "Column":  # noqa: F821
    from pyspark.sql import functions as F

    return F.array_join(column, ",")


def _sql_literal(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v)


def governance_sql(source: str, g=None, components: tuple[str, ...] = (), name: str = "gov",
                   extra: str = "") -> str:
    """Recursive statement that walks every key of ``source`` row by row.

    ``source`` has pk, rn (1..), event_us, enc, score, tier, flag, positive, quality and ``p_*`` columns;
    with ``g`` None the knobs are columns of ``source`` as well. ``extra`` are more columns to carry out.
    """
    def kn(n: str) -> str:
        return f"k_{n}" if g is None else _sql_literal(getattr(g, n))

    vec = "".join(f", v_{c}" for c in components)
    vec0 = "".join(f", NULL::INT AS v_{c}" for c in components)
    vec2 = "".join(f", CASE WHEN chg THEN NULL ELSE v_{c} END AS v_{c}" for c in components)
    vec6 = "".join(f", CASE WHEN emit THEN (CASE WHEN any_points THEN p_{c} ELSE v_{c} END) ELSE v_{c} END AS v_{c}"
                   for c in components)
    any_points = " OR ".join(f"p_{c} IS NOT NULL" for c in components) or "false"
    worse = ("array_to_string(list_sort(list_filter([" + ", ".join(
        f"CASE WHEN p_{c} - coalesce(v_{c}, 0) > 0 THEN '{c}' END" for c in components)
        + "], lambda x: x IS NOT NULL)), ',')") if components else "''"
    n_worse = " + ".join(f"(coalesce(p_{c} - coalesce(v_{c}, 0), 0) > 0)::INT" for c in components) or "0"
    biggest = ("coalesce(greatest(" + ", ".join(f"p_{c} - coalesce(v_{c}, 0)" for c in components) + "), 0)"
               ) if components else "0"
    high = () if g is None else g.page_high_actionability_components
    high_hit = " OR ".join(f"coalesce(p_{c} - coalesce(v_{c}, 0), 0) > 0" for c in high) or "true"
    pcols = "".join(f", p_{c}" for c in components)
    knobs = ""
    if g is None:
        knobs = "".join(f", k_{n}" for n in (
            "trajectory_persistence_minutes", "min_crossings", "baseline_enabled", "baseline_delta_threshold",
            "baseline_lookback_hours", "refractory_minutes", "resolution_gap_minutes", "page_gate_enabled",
            "page_min_crossings", "page_trajectory_persistence_minutes", "page_min_score_delta",
            "page_min_positive_components", "page_min_newly_worsened_components", "page_min_component_delta",
            "reject_late_out_of_order"))
    return f"""
{name} AS (
  SELECT DISTINCT pk, 0::BIGINT AS rn, NULL::BIGINT AS event_us, NULL::BIGINT AS seen, NULL::VARCHAR AS enc,
    NULL::VARCHAR AS flag, 0 AS n, NULL::BIGINT AS first_us, NULL::BIGINT AS last_us, NULL::INT AS first_score,
    NULL::INT AS base, NULL::BIGINT AS base_at, NULL::BIGINT AS emitted{vec0}, false AS emit,
    NULL::VARCHAR AS reason, NULL::VARCHAR AS routing, NULL::VARCHAR AS worsened, NULL::INT AS biggest,
    0 AS crossings, NULL::VARCHAR AS tier, NULL::INT AS score
  FROM {source}
  UNION ALL
  SELECT pk, rn, event_us, seen, enc, flag, n, first_us, last_us, first_score, base, base_at,
    CASE WHEN emit THEN event_us ELSE emitted END{vec6}, emit, reason,
    CASE WHEN NOT emit THEN 'none' WHEN tier IN ('urgent','critical')
      THEN CASE WHEN reason = 'pass' THEN 'interruptive' ELSE 'passive' END
      WHEN tier = 'watch' THEN 'passive' ELSE 'none' END,
    CASE WHEN emit THEN worsened END, CASE WHEN emit THEN biggest END,
    CASE WHEN reason IN ('late_out_of_order', 'below_threshold') THEN 0 ELSE n END, tier, score
  FROM (
    SELECT *, reason LIKE 'pass%' AS emit
    FROM (
      SELECT * REPLACE (CASE WHEN verdict = 'baseline_init' THEN score ELSE base END AS base,
                        CASE WHEN verdict = 'baseline_init' THEN event_us ELSE base_at END AS base_at),
        CASE WHEN verdict <> 'pass' OR tier NOT IN ('urgent','critical') THEN verdict
          WHEN {kn('page_gate_enabled')} AND n < {kn('page_min_crossings')} THEN 'pass_watch:page_crossings'
          WHEN {kn('page_gate_enabled')} AND event_us - first_us < {kn('page_trajectory_persistence_minutes')} * 60000000::BIGINT
            THEN 'pass_watch:page_persistence'
          WHEN {kn('page_gate_enabled')} AND {kn('page_min_score_delta')} > 0
            AND score - first_score < {kn('page_min_score_delta')} THEN 'pass_watch:page_not_rising'
          WHEN {kn('page_gate_enabled')} AND {kn('page_min_positive_components')} > 0
            AND coalesce(positive, -1) < {kn('page_min_positive_components')} THEN 'pass_watch:page_components'
          WHEN {kn('page_gate_enabled')} AND n_worse < {kn('page_min_newly_worsened_components')}
            THEN 'pass_watch:page_component_delta'
          WHEN {kn('page_gate_enabled')} AND {kn('page_min_component_delta')} > 0
            AND biggest < {kn('page_min_component_delta')} THEN 'pass_watch:page_component_delta_min'
          WHEN {kn('page_gate_enabled')} AND NOT ({high_hit}) THEN 'pass_watch:page_high_actionability'
          WHEN quality IS NOT NULL THEN 'pass_watch:' || quality
          ELSE verdict END AS reason
      FROM (
        SELECT *, CASE
            WHEN kind = 'late' THEN 'late_out_of_order' WHEN kind = 'none' THEN 'below_threshold'
            WHEN kind = 'ctx' THEN 'context:' || flag
            WHEN n < {kn('min_crossings')} OR event_us - first_us < {kn('trajectory_persistence_minutes')} * 60000000::BIGINT
              THEN 'trajectory_not_met'
            WHEN {kn('baseline_enabled')} AND base IS NULL THEN 'baseline_init'
            WHEN {kn('baseline_enabled')} AND score - base < {kn('baseline_delta_threshold')} THEN 'below_baseline_delta'
            WHEN emitted IS NOT NULL AND event_us - emitted < {kn('refractory_minutes')} * 60000000::BIGINT THEN 'refractory'
            ELSE 'pass' END AS verdict, {n_worse} AS n_worse, {biggest} AS biggest, {worse} AS worsened,
          ({any_points}) AS any_points
        FROM (
          SELECT * REPLACE (
            CASE WHEN kind = 'none' OR (kind = 'go' AND gap) THEN (kind = 'go')::INT
                 WHEN kind = 'go' AND first_us IS NULL THEN 1
                 WHEN kind = 'go' AND last_us <> event_us THEN n + 1 ELSE n END AS n,
            CASE WHEN kind = 'none' THEN NULL WHEN kind = 'go' AND (gap OR first_us IS NULL) THEN event_us
                 ELSE first_us END AS first_us,
            CASE WHEN kind = 'none' THEN NULL WHEN kind = 'go' AND (gap OR first_us IS NULL) THEN score
                 ELSE first_score END AS first_score,
            CASE WHEN kind = 'none' THEN NULL WHEN kind = 'go' THEN event_us ELSE last_us END AS last_us,
            CASE WHEN kind = 'go' AND expired THEN NULL ELSE base END AS base,
            CASE WHEN kind = 'go' AND expired THEN NULL ELSE base_at END AS base_at)
          FROM (
            SELECT *, CASE WHEN late THEN 'late' WHEN tier = 'none' OR score IS NULL THEN 'none'
                WHEN flag IS NOT NULL THEN 'ctx' ELSE 'go' END AS kind,
              coalesce(event_us - last_us > {kn('resolution_gap_minutes')} * 60000000::BIGINT, false) AS gap,
              coalesce({kn('baseline_enabled')} AND event_us - base_at > {kn('baseline_lookback_hours')} * 3600000000::BIGINT, false)
                AS expired
            FROM (
              SELECT pk, rn, event_us, score, tier, positive, quality{pcols}{knobs}{extra}, late,
                CASE WHEN late THEN seen ELSE greatest(coalesce(seen, event_us), event_us) END AS seen,
                CASE WHEN chg THEN enc_in ELSE enc END AS enc,
                CASE WHEN late THEN flag WHEN chg THEN flag_in WHEN flag IS NULL THEN flag_in
                     WHEN flag_in IS NULL THEN flag WHEN flag_in < flag THEN flag_in ELSE flag END AS flag,
                CASE WHEN chg THEN 0 ELSE n END AS n, CASE WHEN chg THEN NULL ELSE first_us END AS first_us,
                CASE WHEN chg THEN NULL ELSE last_us END AS last_us,
                CASE WHEN chg THEN NULL ELSE first_score END AS first_score,
                CASE WHEN chg THEN NULL ELSE base END AS base, CASE WHEN chg THEN NULL ELSE base_at END AS base_at,
                CASE WHEN chg THEN NULL ELSE emitted END AS emitted{vec2}
              FROM (
                SELECT *, NOT late AND enc_in IS NOT NULL AND enc_in <> coalesce(enc, '') AS chg
                FROM (
                  SELECT s.pk, s.rn, s.event_us, s.enc AS enc_in, s.score, s.tier, s.flag AS flag_in, s.positive,
                    s.quality{pcols}{knobs}{extra}, g.seen, g.enc, g.flag, g.n, g.first_us, g.last_us,
                    g.first_score, g.base, g.base_at, g.emitted{vec},
                    coalesce({kn('reject_late_out_of_order')} AND s.event_us < g.seen, false) AS late
                  FROM {name} g JOIN {source} s ON s.pk = g.pk AND s.rn = g.rn + 1))))))))
)"""


# Alerts of the active bundle in event order, ready for the recursion.
def alert_source(g, components: tuple[str, ...] = _NAMES, name: str = "src", where: str = "true",
                 order: str = "event_us, idempotency_key") -> str:
    flags = ", ".join(f"'{f}'" for f in g.suppression_flags) or "NULL"
    cols = "".join(f", p_{c}" for c in components)
    return f"""
{name} AS (
  SELECT patient_id AS pk, row_number() OVER (PARTITION BY patient_id ORDER BY {order}) AS rn, event_us,
    encounter_now AS enc, score, tier, CASE WHEN context_flag IN ({flags}) THEN context_flag END AS flag,
    positive_components AS positive, NULL::VARCHAR AS quality{cols}, idempotency_key, ingest_us, completeness
  FROM scored WHERE completeness <> 'insufficient_data' AND {where})"""
