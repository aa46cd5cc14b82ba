"""Queries that run a stream to its end and return what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import folds, verdicts
from tidemark.plans.common import scratch, table
from tidemark.plans.schedule import ORACLES as _SCHEDULE
from tidemark.streaming import visits


def _in_rounds(spark: SparkSession, rows: DataFrame, rounds: int, number, name: str, run) -> None:
    """Writes the rows of each round to a folder and lets ``run`` stream what is new there: a micro-batch a round."""
    path = scratch(spark, name)
    for r in range(rounds):
        rows.filter(number == r).write.mode("append").parquet(path)
        run(spark.readStream.schema(rows.schema).parquet(path))


def _days(at: str, days: int):
    """The number of a row's stretch of so many days."""
    return F.floor(F.datediff(at, F.lit("2024-01-01")) / days)


def _keep(out: visits.BatchTable):
    def sink(batch: DataFrame, number: int) -> None:
        out.write(batch, number)
        out.commit(number)

    return sink


def stream_dedup_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("source"), F.col("value").cast("bigint").alias("source_id"), "event_id", "ts")
    out, state = visits.BatchTable(spark, scratch(spark, "stream-dedup-out"), rows.schema), scratch(spark, "stream-dedup-state")
    append = visits.append_new(out, ["source", "source_id"], ["ts", "event_id"])
    _in_rounds(spark, rows, 4, _days("ts", 8), "stream-dedup", lambda stream: visits.replay(stream, append, state))
    return out.read().select("source", "source_id")


def stream_aimd(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "signup", "limited").when(F.col("event_type") == "click", "slow").otherwise("ok")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", kind.alias("kind"))
    schema = visits.fold_schema(rows.schema, folds.Backoff())
    out, state = visits.BatchTable(spark, scratch(spark, "stream-aimd-out"), schema), scratch(spark, "stream-aimd-state")
    _in_rounds(spark, rows, 4, _days("ts", 8), "stream-aimd", lambda stream: visits.replay(visits.fold_stream(stream, folds.Backoff(), "user_id", ["ts", "event_id"], "kind"), _keep(out), state))
    return out.read().select("event_id", F.round("delay", 6).alias("delay"), "failures", "paused")


def request_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as requests: those of a user within six hours share a flight, over micro-batches of ten days."""
    requests = table(spark, sf_dir, "events").filter("event_type = 'click'").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    first = F.lit("2024-01-01").cast("timestamp")
    number = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(first)) / (10 * 86_400))
    state, out = scratch(spark, "flights-state"), None

    def run(stream: DataFrame) -> None:
        nonlocal out
        flown = visits.single_flights(stream.withWatermark("ts", "0 seconds"), "user_id", "ts", "event_id", 6 * 3600)
        out = out or visits.BatchTable(spark, scratch(spark, "flights"), flown.schema)

        def sink(batch: DataFrame, n: int) -> None:
            out.write(batch, n)
            out.commit(n)

        visits.replay(flown, sink, state)

    _in_rounds(spark, requests, 4, number, "requests", run)
    return out.read().select("event_id", "user_id", F.col("flight").cast("bigint").alias("flight"), "served", "coalesced")


def recovered_pulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with an error, taken every third day: 1 while in the set, one 0 after leaving it, over five micro-batches."""
    sweep = F.floor(F.datediff("ts", F.lit("2024-01-01")) / 3).cast("int")
    events = table(spark, sf_dir, "events").select(sweep.alias("sweep"), F.when(F.col("event_type") == "error", F.col("user_id")).alias("user_id"))
    # Of every fifth sweep nobody is in the set, but it was taken.
    sets = events.select("sweep", F.when(F.col("sweep") % 5 != 4, F.col("user_id")).alias("user_id")).distinct()
    out = visits.BatchTable(spark, scratch(spark, "pulse"), spark.createDataFrame([], "sweep int, user_id bigint, value int").schema)
    state = scratch(spark, "pulse-state")
    _in_rounds(spark, sets, 5, F.floor(F.col("sweep") / 2), "sets", lambda stream: visits.replay(stream, visits.pulse_sink(out, "sweep", "user_id"), state))
    return out.read().filter("value is not null")


def gone_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as redirects, those at the bench threshold as suspects: verdicts under a quota of ten in any 24 hours, over six
    micro-batches of five days."""
    i = F.col("event_id")
    visits_ = table(spark, sf_dir, "events").filter("event_type = 'error'").select(
        i.alias("id"), F.col("ts").cast("timestamp").alias("at"), (F.col("user_id") % 25).alias("set_id"), F.lit("/old").alias("failing_url"), F.when(i % 10 == 0, "/new").otherwise("/old").alias("url"),
        F.when(i % 7 == 0, F.col("ts").cast("timestamp")).alias("last_seen_at"), F.when(i % 9 == 4, 404).otherwise(302).alias("status"),
    )
    streaks = table(spark, sf_dir, "events").filter("event_id % 3 > 0").select(i.alias("id"), (i % 5).cast("int").alias("failure_streak"))
    suspects = verdicts.missing_suspects(visits_, streaks, "id").drop("status")
    walks = table(spark, sf_dir, "nation").filter("n_nationkey <> 3").select(F.col("n_nationkey").alias("set_id"), (F.col("n_nationkey") % 4 != 1).alias("completed"), (F.col("n_nationkey") % 6).alias("seen"))
    schema = spark.createDataFrame([], "id bigint, at timestamp, verdict string").schema
    out, state = visits.BatchTable(spark, scratch(spark, "gone"), schema), scratch(spark, "gone-state")
    number = F.floor(F.datediff("at", F.lit("2024-01-01")) / 5)
    _in_rounds(spark, suspects, 6, number, "suspects", lambda stream: visits.replay(stream, visits.gone_sink(out, walks), state))
    return out.read().select("id", "verdict")


QUERIES = {f.__name__: f for f in (stream_dedup_append, stream_aimd, request_stream, recovered_pulse, gone_stream)}
ORACLES = {
    "stream_dedup_append": "SELECT DISTINCT user_id % 40 AS source, CAST(trunc(value) AS BIGINT) AS source_id FROM events",
    "stream_aimd": _SCHEDULE["aimd_delay"],
    "request_stream": """WITH RECURSIVE e AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click'),
        f AS (SELECT user_id, min(ts) AS began FROM e GROUP BY user_id UNION ALL SELECT e.user_id, min(e.ts) FROM f JOIN e ON e.user_id = f.user_id AND e.ts >= f.began + INTERVAL '6' HOUR GROUP BY e.user_id, f.began),
        m AS (SELECT e.*, began FROM e ASOF JOIN (SELECT DISTINCT * FROM f) f ON e.user_id = f.user_id AND e.ts >= f.began),
        n AS (SELECT *, row_number() OVER (PARTITION BY user_id, began ORDER BY ts, event_id::VARCHAR)::INT AS served FROM m)
        SELECT event_id, user_id, first_value(event_id) OVER (PARTITION BY user_id, began ORDER BY served) AS flight, served, served > 1 AS coalesced FROM n""",
    "recovered_pulse": """WITH s AS (SELECT DISTINCT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 3 AS sweep, event_type, user_id FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-31'),
        i AS (SELECT DISTINCT sweep, user_id FROM s WHERE event_type = 'error' AND sweep % 5 <> 4), t AS (SELECT sweep, lead(sweep) OVER (ORDER BY sweep) AS following FROM (SELECT DISTINCT sweep FROM s))
        SELECT sweep::INT AS sweep, user_id, 1 AS value FROM i
        UNION ALL SELECT following::INT, user_id, 0 FROM i JOIN t USING (sweep) WHERE following IS NOT NULL AND NOT EXISTS (SELECT 1 FROM i j WHERE j.sweep = following AND j.user_id = i.user_id)""",
    "gone_stream": """WITH RECURSIVE v AS (SELECT event_id AS id, ts AS tm, user_id % 25 AS set_id, event_id % 10 = 0 AS healed, event_id % 7 = 0 AS listed FROM events
             WHERE event_type = 'error' AND event_id % 9 <> 4 AND event_id % 3 > 0 AND event_id % 5 >= 2),
        j AS (SELECT v.*, CASE WHEN healed THEN 'healed' WHEN n_nationkey IS NULL OR n_nationkey = 3 OR n_nationkey % 4 = 1 OR n_nationkey % 6 = 0 OR listed THEN 'no_verdict' ELSE 'gone' END AS verdict FROM v LEFT JOIN nation ON n_nationkey = set_id),
        c AS (SELECT id, tm, row_number() OVER (ORDER BY tm, id) AS k FROM j WHERE verdict = 'gone'),
        q AS (SELECT k, id, [tm] AS held, true AS let FROM c WHERE k = 1
              UNION ALL SELECT c.k, c.id, CASE WHEN len(list_filter(held, lambda x: x > c.tm - INTERVAL '1' DAY)) < 10 THEN list_append(list_filter(held, lambda x: x > c.tm - INTERVAL '1' DAY), c.tm) ELSE held END,
                               len(list_filter(held, lambda x: x > c.tm - INTERVAL '1' DAY)) < 10 FROM q JOIN c ON c.k = q.k + 1)
        SELECT j.id, CASE WHEN verdict = 'gone' AND NOT q.let THEN 'no_verdict' ELSE verdict END AS verdict FROM j LEFT JOIN q USING (id)""",
}
