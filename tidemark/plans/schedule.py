"""Queries over schedule states and per-key state machines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import folds, schedule
from tidemark.plans.common import NOW, STATES, now, states, table


def priority_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.with_score(states(spark, sf_dir), now()).select("id", F.round("score", 6).alias("score"))


def _pool(spark, sf_dir):
    return schedule.candidate_pool(states(spark, sf_dir), now(), stalest=40, tier=10)


def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pool(spark, sf_dir).select("id", "branch", "place")


def visit_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.visit_choice(_pool(spark, sf_dir), now())


def burn_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.burn_due_keys(states(spark, sf_dir), now()).select("id", F.round("staleness", 6).alias("staleness"))


def at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.at_risk_keys(states(spark, sf_dir), now(), 0.1).select("id", F.round("staleness", 6).alias("staleness"))


def benched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.benched(states(spark, sf_dir), now()).select("id")


def gone_probe_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.gone_probes(states(spark, sf_dir), now()).select("id")


def set_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.hottest_siblings(states(spark, sf_dir), "set_id", 3).select("set_id", "id", "place")


def set_contagion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = states(spark, sf_dir)
    return schedule.stamp_contagion(s, s.filter("id % 40 = 1"), "set_id", now(), 2).filter(F.col("refresh_requested_at") == now()).select("id", "set_id")


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.corpus_stats(states(spark, sf_dir), now(), 0.1)


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    kind = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "signup", "limited").when(F.col("event_type") == "click", "slow").otherwise("ok")
    return e.select("event_id", "user_id", "ts", kind.alias("kind"), seconds.alias("seconds"))


def aimd_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.fold(_events(spark, sf_dir).drop("seconds"), folds.Backoff(), ["user_id"], ["ts", "event_id"], "kind").select("event_id", F.round("delay", 6).alias("delay"), "failures", "paused")


def alert_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = _events(spark, sf_dir).filter("kind = 'fail'")
    return folds.fold(errors, folds.Cooldown(2 * 86_400.0), ["user_id"], ["ts", "event_id"], "kind", "seconds").select("event_id", "emitted")


def bench_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.fold(_events(spark, sf_dir), folds.BenchSlot(86_400.0), ["user_id"], ["ts", "event_id"], "kind", "seconds").select("event_id", "open", "failures")


def quarantine_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return folds.quarantine_state(e, ["user_id"], "ts", [F.col("ts"), F.col("event_id")], F.col("event_type").isin("error", "click")).withColumn("streak", F.col("streak").cast("bigint"))


def same_key_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 2).alias("key"), "event_type")
    out = folds.same_key_breaker(e, "key", ["ts", "event_id"], F.col("event_type").isin("error", "click"))
    return out.filter("run > 0").select("event_id", "key", "run", "tripped")


QUERIES = {f.__name__: f for f in (priority_score, candidate_pool, visit_choice, burn_due, at_risk, benched, gone_probe_due, set_siblings, set_contagion, corpus_stats, aimd_delay, alert_cooldown, bench_slot, quarantine_state, same_key_breaker)}

_POOL = f"""{STATES},
    b0 AS (SELECT id, 0 AS branch, row_number() OVER (ORDER BY last_visited_at ASC NULLS LAST, id) AS place FROM v WHERE ok QUALIFY place <= 40),
    b1 AS (SELECT id, 1 AS branch, row_number() OVER (ORDER BY last_visited_at ASC NULLS LAST, id) AS place FROM v WHERE ok AND any_at_cap QUALIFY place <= 10),
    b2 AS (SELECT id, 2 AS branch, row_number() OVER (ORDER BY staleness * rate DESC, id) AS place FROM v WHERE ok AND due QUALIFY place <= 10),
    b3 AS (SELECT id, 3 AS branch, row_number() OVER (ORDER BY refresh_requested_at, id) AS place FROM v WHERE ok AND refresh_requested_at IS NOT NULL QUALIFY place <= 10),
    w AS (SELECT * FROM (FROM b0 UNION ALL FROM b1 UNION ALL FROM b2 UNION ALL FROM b3) QUALIFY row_number() OVER (PARTITION BY id ORDER BY branch, place) = 1)"""
_SEQ = """e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'limited' WHEN 'click' THEN 'slow' ELSE 'ok' END AS kind,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events {where})"""

ORACLES = {
    "priority_score": f"WITH {STATES} SELECT id, round(score, 6) AS score FROM v",
    "candidate_pool": f"WITH {_POOL} SELECT id, branch, CAST(place AS INT) AS place FROM w",
    "visit_choice": f"""WITH {_POOL}, x AS (SELECT id, score FROM w JOIN v USING (id) ORDER BY score DESC, branch, place LIMIT 1)
        SELECT CASE WHEN score < 2500000 THEN 'prefer_unvisited' ELSE 'scored' END AS kind, id FROM x""",
    "burn_due": f"WITH {STATES} SELECT id, round(staleness, 6) AS staleness FROM v WHERE due",
    "at_risk": f"WITH {STATES} SELECT id, round(staleness, 6) AS staleness FROM v WHERE living AND rate > 0 AND staleness * rate > 30 * 0.1",
    "benched": f"WITH {STATES} SELECT id FROM v WHERE living AND quarantined_until >= TIMESTAMP '{NOW}' ORDER BY quarantined_until, id LIMIT 50",
    "gone_probe_due": f"""WITH {STATES} SELECT id FROM v WHERE gone_at IS NOT NULL AND CASE WHEN delisted_probed_at IS NULL OR delisted_probed_at < gone_at
        THEN TIMESTAMP '{NOW}' - gone_at >= INTERVAL 1 DAY ELSE TIMESTAMP '{NOW}' - delisted_probed_at >= least(delisted_probed_at - gone_at, INTERVAL 30 DAY) END""",
    "set_siblings": f"""WITH {STATES} SELECT set_id, id, CAST(row_number() OVER (PARTITION BY set_id ORDER BY rate DESC, id) AS INT) AS place FROM v
        WHERE living AND rate > 0 AND refresh_requested_at IS NULL QUALIFY place <= 3""",
    "set_contagion": f"""WITH {STATES} SELECT DISTINCT v.id, v.set_id FROM v JOIN (SELECT id AS edge, set_id FROM v WHERE id % 40 = 1) USING (set_id)
        WHERE living AND rate > 0 AND refresh_requested_at IS NULL AND v.id <> edge QUALIFY row_number() OVER (PARTITION BY edge ORDER BY rate DESC, v.id) <= 2""",
    "corpus_stats": f"""WITH {STATES} SELECT count(*) AS corpus, count(last_visited_at) AS visited, count(*) FILTER (WHERE living AND last_visited_at IS NULL) AS pending,
        count(*) FILTER (WHERE living AND any_at_cap) AS at_cap, count(*) FILTER (WHERE living AND quarantined_until >= TIMESTAMP '{NOW}') AS quarantined,
        count(delisted_at) AS delisted, count(gone_at) AS gone, count(refresh_requested_at) AS asks, count(*) FILTER (WHERE living AND rate > 0 AND staleness * rate > 3.0) AS at_risk,
        least(min(last_visited_at) FILTER (WHERE living), min(refresh_requested_at) FILTER (WHERE living)) AS longest_wait_since FROM v""",
    "aimd_delay": f"""WITH RECURSIVE {_SEQ.format(where="")},
        f AS (SELECT user_id, 0::BIGINT AS k, 300.0::DOUBLE AS delay, true AS starting, 0 AS failures, NULL::BIGINT AS event_id FROM (SELECT DISTINCT user_id FROM e)
              UNION ALL SELECT e.user_id, e.k,
                CASE kind WHEN 'ok' THEN greatest(10.0, CASE WHEN starting THEN least(delay * 0.5, delay - 5) ELSE delay - 5 END) WHEN 'limited' THEN 300.0 ELSE least(2 * delay, 300.0) END,
                starting AND kind = 'ok', CASE kind WHEN 'ok' THEN 0 WHEN 'slow' THEN failures ELSE failures + 1 END, e.event_id
              FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
        SELECT event_id, round(delay, 6) AS delay, failures, failures >= 3 AS paused FROM f WHERE k > 0""",
    "alert_cooldown": f"""WITH RECURSIVE {_SEQ.format(where="WHERE event_type = 'error'")},
        f AS (SELECT user_id, k, event_id, true AS emitted, t AS last FROM e WHERE k = 1
              UNION ALL SELECT e.user_id, e.k, e.event_id, t - last >= 172800, CASE WHEN t - last >= 172800 THEN t ELSE last END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
        SELECT event_id, emitted FROM f""",
    "bench_slot": f"""WITH RECURSIVE {_SEQ.format(where="")},
        f AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, true AS open, NULL::DOUBLE AS last, 0 AS n FROM (SELECT DISTINCT user_id FROM e)
              UNION ALL SELECT user_id, k, event_id, o, CASE WHEN NOT o THEN last WHEN kind = 'fail' THEN t END, CASE WHEN NOT o THEN n WHEN kind = 'fail' THEN n + 1 ELSE 0 END FROM
              (SELECT e.user_id, e.k, e.event_id, e.t, e.kind, last, n, last IS NULL OR t - last >= 86400.0 * power(2, least(n - 1, 5)) AS o FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1))
        SELECT event_id, open, n AS failures FROM f WHERE k > 0""",
    "quarantine_state": """WITH e AS (SELECT *, event_type IN ('error', 'click') AS bad, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        l AS (SELECT user_id, max(ts) AS ts, max(k) - coalesce(max(k) FILTER (WHERE NOT bad), 0) AS streak FROM e GROUP BY user_id)
        SELECT user_id, ts, streak, CASE WHEN streak >= 3 THEN least(power(2, least(streak - 3, 5)), 30.0) END AS sentence_days, streak = 3 AS joined FROM l""",
    "same_key_breaker": """WITH e AS (SELECT event_id, ts, user_id % 2 AS key, event_type IN ('error', 'click') AS bad FROM events),
        n AS (SELECT *, coalesce(bad AND lag(bad) OVER w AND key = lag(key) OVER w, false) AS same FROM e WINDOW w AS (ORDER BY ts, event_id)),
        i AS (SELECT *, count(*) FILTER (WHERE NOT same) OVER (ORDER BY ts, event_id) AS island FROM n),
        r AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY ts, event_id) AS run FROM i)
        SELECT event_id, key, run, run >= 3 AS tripped FROM r WHERE bad""",
}
