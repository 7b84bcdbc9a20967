"""Tables that last: bucketed alerts, retention with a rebuild of what it touched, and the chained audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalog import episodes as E
from wardline.catalog import records as R
from wardline.catalog.base import REGISTRY, query
from wardline.operators import episodes as EP
from wardline.session import checkpointed, new_path
from wardline.sources import projection as P
from wardline.streaming.tables import AuditLog, BucketTable, retain, upsert

_HOUR = 3_600_000_000
CUTOFF_US, HALF_US = P.T0_US + 6 * _HOUR, P.T0_US + 18 * _HOUR
PAIR = ["patient_id", "encounter_key"]


@query("alert_table_buckets", "SNK-4 SNK-1 SNK-5", REGISTRY["alert_upsert"].sql)
def alert_table_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Two deliveries into a bucketed alert table, the second one twice; acknowledgements survive, the newer tier wins."""
    first = R.stored(spark, sf).selectExpr(
        "alert_id", "patient_id", "event_us", "event_id", "1 AS arrival", "tier", "acknowledged", "if(acknowledged, event_us, null) AS acknowledged_us",
        "cast(null AS string) AS acknowledge_note", "if(acknowledged, 'acknowledged', 'open') AS resolution_state")
    again = first.where("event_id % 2 = 0").withColumns({
        "arrival": F.lit(2), "tier": F.lit("revised"), "acknowledged": F.lit(False), "acknowledged_us": F.lit(None).cast("long"), "resolution_state": F.lit("open")})
    table = BucketTable(spark, new_path(spark, "alert-buckets"), first.schema, ["patient_id"], "event_us", buckets=16)
    for batch_id, batch in ((0, first), (1, again), (1, again)):
        upsert(table, batch, batch_id)
    return table.read().select("alert_id", "tier", "acknowledged", "acknowledged_us", "resolution_state")


_LEFT_SQL = E._EPISODES.replace("sig AS (SELECT * FROM sofa_alerts", f"sig AS (SELECT * FROM all_sig WHERE event_us >= {CUTOFF_US}), all_sig AS (SELECT * FROM sofa_alerts")


def _ordered_ctes(sql: str) -> str:
    """``all_sig`` goes before ``sig``, which reads it."""
    head, rest = sql.split("sig AS (SELECT * FROM all_sig", 1)
    own, rest = rest.split("), all_sig AS (", 1)
    body, tail = rest.split(")", 1)
    return f"{head}all_sig AS ({body}),\nsig AS (SELECT * FROM all_sig{own}){tail}"


@query("retention_rebuild", "SNK-6 EPI-7", f"""{_ordered_ctes(_LEFT_SQL)}
SELECT pk, no AS episode_no, {E._EPISODE_ID} AS episode_id, opened_us, n_signals, status, dominant_type, dominant_severity, page_count, passive_count FROM eps""")
def retention_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes after a retention that takes the signals of the first six hours: only encounters that lost a signal are folded again."""
    columns = [*PAIR, "episode_no", "episode_id", "opened_us", "n_signals", "status", "dominant_type", "dominant_severity", "page_count", "passive_count"]

    def fold(rows: DataFrame) -> DataFrame:
        return EP.summarise(EP.arbitrate(rows)).select(*columns)

    signals = E.signals(spark, sf)
    work = new_path(spark, "retention")
    alerts = BucketTable(spark, f"{work}/signals", signals.schema, PAIR, "event_us")
    alerts.merge(0, signals, lambda _, new: new)
    episodes = fold(alerts.read())
    folded = BucketTable(spark, f"{work}/episodes", episodes.schema, PAIR, "opened_us")
    folded.merge(0, episodes, lambda _, new: new)
    retain(alerts, folded, 1, CUTOFF_US, PAIR, fold)
    return folded.read().select(F.concat_ws("#", *PAIR).alias("pk"), *columns[2:])


@query("audit_chain", "SNK-8", f"""SELECT *, CASE WHEN at_us < {HALF_US} THEN 0 ELSE 1 END::INT AS epoch, true AS intact FROM ({REGISTRY["episode_audit"].sql})""")
def audit_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Audit entries appended in two epochs, both of them again after that, and whether the chain over all entries holds."""
    entries = checkpointed(E.episode_audit(spark, sf))  # every epoch takes its part of them
    log = AuditLog(spark, new_path(spark, "audit"), part_rows=1000)
    order = ["at_us", "pk", "episode_no"]
    early = F.col("at_us") < HALF_US
    for epoch, part in ((0, entries.where(early)), (1, entries.where(~early)), (1, entries.where(~early)), (0, entries)):
        log.append(epoch, part, order)
    return log.read().select("pk", "episode_no", "at_us", "action", "reason", "epoch", (~F.col("epoch").isin(log.broken())).alias("intact"))
