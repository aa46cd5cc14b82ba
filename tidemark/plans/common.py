"""Inputs that several registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.storage import scratch  # noqa: F401

NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now():
    return F.lit(NOW).cast("timestamp")


#: Schedule states by user, out of the event stream; the same text on both engines.
STATES_SQL = """
    SELECT user_id AS id, user_id % 12 AS set_id,
           max(CASE WHEN event_type = 'view' AND user_id % 11 <> 0 THEN ts END) AS last_visited_at,
           CAST(count(*) AS DOUBLE) / CAST(15 + user_id % 90 AS DOUBLE) AS rate,
           sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) > 15 AS any_at_cap,
           max(CASE WHEN event_type = 'click' AND user_id % 5 = 0 THEN ts END) AS refresh_requested_at,
           max(CASE WHEN event_type = 'purchase' AND user_id % 4 = 1 THEN ts END) AS near_miss_at,
           max(CASE WHEN event_type = 'error' AND user_id % 6 = 2 THEN ts + INTERVAL '3' DAY END) AS quarantined_until,
           max(CASE WHEN event_type = 'signup' AND user_id % 13 = 3 THEN ts END) AS delisted_at,
           min(CASE WHEN event_type = 'signup' AND user_id % 7 = 4 THEN ts END) AS gone_at,
           CAST(NULL AS TIMESTAMP) AS not_a_card_at,
           max(CASE WHEN event_type = 'click' AND user_id % 14 = 4 THEN ts END) AS delisted_probed_at
    FROM {events} GROUP BY user_id
"""


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(STATES_SQL, events=table(spark, sf_dir, "events"))
    return rows.select(*[F.col(c).cast("timestamp") if c.endswith(("_at", "_until")) else F.col(c) for c in rows.columns])


#: As SQL: the states with the staleness in days, due days and living flag.
STATES = f"""
    s AS ({STATES_SQL.format(events="events")}),
    d AS (SELECT *, CAST(epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_visited_at) AS DOUBLE) / 86400000000.0 AS staleness,
                 delisted_at IS NULL AND gone_at IS NULL AND not_a_card_at IS NULL AS living FROM s),
    t AS (SELECT *, CASE WHEN rate > 0 THEN least(30.0 / rate * CASE WHEN rate >= 1 THEN 0.3 ELSE 0.5 END,
                        CASE WHEN rate >= 2 THEN 1.5 WHEN rate >= 1 THEN 3.0 ELSE 1e300 END)
                        / CASE WHEN near_miss_at IS NULL THEN 1 ELSE 2 END END AS due_days FROM d),
    u AS (SELECT *, coalesce(staleness >= due_days, false) AS due,
                 living AND (quarantined_until IS NULL OR quarantined_until < TIMESTAMP '{NOW}') AS ok FROM t),
    v AS (SELECT *, CASE WHEN staleness IS NULL THEN CASE WHEN refresh_requested_at IS NULL THEN 2500000.0 ELSE 2750000.0 END
                         WHEN due THEN 3000000.0 + staleness * rate
                         WHEN refresh_requested_at IS NOT NULL THEN 2750000.0 + staleness
                         WHEN any_at_cap THEN 2000000.0 + staleness
                         WHEN staleness >= 30 THEN 1000000.0 + staleness
                         ELSE staleness * (1 + rate) END AS score FROM u)"""
