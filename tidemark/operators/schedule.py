"""Who is visited next: eligibility, bounded candidate pools, scores, choices and contagion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timing import Bands, at_risk, burn_due, days_between, gone_probe_due, priority_score

TOMBSTONES = ("delisted_at", "not_a_card_at", "gone_at")


def is_living(tombstones: tuple[str, ...] = TOMBSTONES) -> Column:
    out = F.lit(True)
    for c in tombstones:
        out = out & F.col(c).isNull()
    return out


def eligible(states: DataFrame, now: Column) -> DataFrame:
    return states.filter(is_living() & (F.col("quarantined_until").isNull() | (F.col("quarantined_until") < now)))


def benched(states: DataFrame, now: Column, take: int = 50) -> DataFrame:
    """Living keys still in quarantine, the next to come back first."""
    return states.filter(is_living() & (F.col("quarantined_until") >= now)).orderBy("quarantined_until", "id").limit(take)


def with_staleness(states: DataFrame, now: Column) -> DataFrame:
    return states.withColumn("staleness", days_between(F.col("last_visited_at"), now))


def with_score(states: DataFrame, now: Column, bands: Bands = Bands()) -> DataFrame:
    s = with_staleness(states, now)
    return s.withColumn("score", priority_score(F.col("staleness"), F.col("rate"), F.col("any_at_cap"), F.col("refresh_requested_at").isNotNull(), F.col("near_miss_at").isNotNull(), bands))


def burn_due_keys(states: DataFrame, now: Column, bands: Bands = Bands()) -> DataFrame:
    s = with_staleness(states, now)
    return s.filter(burn_due(F.col("staleness"), F.col("rate"), F.col("near_miss_at").isNotNull(), bands))


def at_risk_keys(states: DataFrame, now: Column, fraction: float, bands: Bands = Bands()) -> DataFrame:
    return with_staleness(states.filter(is_living()), now).filter(at_risk(F.col("staleness"), F.col("rate"), fraction, bands))


def candidate_pool(states: DataFrame, now: Column, bands: Bands = Bands(), stalest: int = 500, tier: int = 50) -> DataFrame:
    """The union of four bounded windows, each key once, in the order of first occurrence (``branch, place``).

    Each window is a top-k, so no branch sorts or moves the whole table."""
    ok = eligible(states, now)
    oldest = [F.asc_nulls_last("last_visited_at"), F.asc("id")]
    hottest = [F.desc("__heat"), F.asc("id")]
    due = burn_due_keys(ok, now, bands).withColumn("__heat", F.col("staleness") * F.col("rate"))
    windows = [
        (ok, oldest, stalest),
        (ok.filter("any_at_cap"), oldest, tier),
        (due, hottest, tier),
        (ok.filter("refresh_requested_at is not null"), [F.asc("refresh_requested_at"), F.asc("id")], tier),
    ]
    out = None
    for branch, (rows, order, take) in enumerate(windows):
        # The top-k comes first; only its rows are numbered.
        top = rows.orderBy(*order).limit(take).withColumn("branch", F.lit(branch))
        placed = top.withColumn("place", F.row_number().over(Window.partitionBy("branch").orderBy(*order))).select(*states.columns, "branch", "place")
        out = placed if out is None else out.unionByName(placed)
    first = Window.partitionBy("id").orderBy("branch", "place")
    return out.withColumn("__k", F.row_number().over(first)).filter("__k = 1").drop("__k")


def visit_choice(pool: DataFrame, now: Column, bands: Bands = Bands(), bench_retry: int | None = None, unvisited_score: float = 2_500_000.0) -> DataFrame:
    """One row ``kind, id``: a bench retry wins; else the best score, unless unvisited keys outrank it."""
    if bench_retry is not None:
        return pool.sparkSession.createDataFrame([("retry_benched", bench_retry)], "kind string, id bigint")
    best = with_score(pool, now, bands).agg(F.max("score").alias("score"), F.max_by("id", F.struct("score", -F.col("branch"), -F.col("place"))).alias("id"))
    prefer = F.coalesce(F.col("score") < unvisited_score, F.lit(True))
    return best.select(F.when(prefer, "prefer_unvisited").otherwise("scored").alias("kind"), "id")


def hottest_siblings(states: DataFrame, group: str, take: int = 25) -> DataFrame:
    """The hottest living keys of each group with a rate and no pending request, with their ``place``.

    Top lists are taken in slices of a group first, so that no task sorts a whole large group."""
    ok = states.filter(is_living() & (F.col("rate") > 0) & F.col("refresh_requested_at").isNull())
    order = [F.desc("rate"), F.asc("id")]
    sliced = ok.withColumn("__slice", F.pmod(F.xxhash64("id"), F.lit(32)))
    part = Window.partitionBy(group, "__slice").orderBy(*order)
    whole = Window.partitionBy(group).orderBy(*order)
    kept = sliced.withColumn("__k", F.row_number().over(part)).filter(F.col("__k") <= take)
    return kept.withColumn("place", F.row_number().over(whole)).filter(F.col("place") <= take).drop("__k", "__slice")


def stamp_contagion(states: DataFrame, edges: DataFrame, group: str, now: Column, take: int = 25) -> DataFrame:
    """``states`` where the hottest siblings of keys that just reached their cap have a request stamped."""
    hit = hottest_siblings(states, group, take + 1).join(edges.select(F.col("id").alias("__edge"), group), group).filter("id <> __edge")
    again = Window.partitionBy("__edge").orderBy(F.desc("rate"), "id")
    stamped = hit.withColumn("__k", F.row_number().over(again)).filter(F.col("__k") <= take).select("id").distinct().withColumn("__hit", F.lit(True))
    return states.join(stamped, "id", "left").withColumn("refresh_requested_at", F.when(F.col("__hit"), now).otherwise(F.col("refresh_requested_at"))).select(*states.columns)


def gone_probes(states: DataFrame, now: Column) -> DataFrame:
    return states.filter(gone_probe_due(F.col("gone_at"), F.col("delisted_probed_at"), now))


def first_probe(states: DataFrame, now: Column) -> DataFrame:
    """The one key to probe: never probed first, then the longest unprobed."""
    return gone_probes(states, now).orderBy(F.col("delisted_probed_at").isNotNull(), "delisted_probed_at", "id").limit(1)


def corpus_stats(states: DataFrame, now: Column, fraction: float, bands: Bands = Bands()) -> DataFrame:
    """All gauges in one pass."""
    s = with_staleness(states, now)
    living = is_living()
    return s.agg(
        F.count(F.lit(1)).alias("corpus"),
        F.count_if(F.col("last_visited_at").isNotNull()).alias("visited"),
        F.count_if(living & F.col("last_visited_at").isNull()).alias("pending"),
        F.count_if(living & F.col("any_at_cap")).alias("at_cap"),
        F.count_if(living & (F.col("quarantined_until") >= now)).alias("quarantined"),
        F.count_if(F.col("delisted_at").isNotNull()).alias("delisted"),
        F.count_if(F.col("gone_at").isNotNull()).alias("gone"),
        F.count_if(F.col("refresh_requested_at").isNotNull()).alias("asks"),
        F.count_if(living & at_risk(F.col("staleness"), F.col("rate"), fraction, bands)).alias("at_risk"),
        F.least(F.min(F.when(living, F.col("last_visited_at"))), F.min(F.when(living, F.col("refresh_requested_at")))).alias("longest_wait_since"),
    )
