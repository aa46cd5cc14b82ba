"""What a visit does to its key's state, verdicts on missing keys, and the lists of what is still to be done.

All take tables and ``now`` as a column; nothing is read from a clock. Joins are on the key; every list that is cut
is a top-k before any numbering.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def living() -> Column:
    return F.col("delisted_at").isNull() & F.col("gone_at").isNull() & F.col("not_a_card_at").isNull()


def apply_visits(states: DataFrame, visits: DataFrame, now: Column, near_margin: int = 8, key: str = "id") -> DataFrame:
    """``states`` after successful ``visits(key, rate, at_cap, margin, image_hash)``, one for each key, with
    ``newly_at_cap``: at cap now and not before.

    What a visit judges is assigned, not accumulated, so a calm visit clears the flags: the near miss (a narrowest
    margin above zero and up to ``near_margin``; zero is the loss itself), the failure streak, the quarantine, the
    machine's gone verdict and a pending request. The delisting, an operator's word, stays; so does a known image.
    Keys without a visit keep their state.
    """
    v = visits.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in ("rate", "at_cap", "margin", "image_hash")], F.lit(True).alias("__seen"))
    seen = F.coalesce("__seen", F.lit(False))
    near = (F.col("__margin") > 0) & (F.col("__margin") <= near_margin)
    none = F.lit(None)
    new = {
        "last_visited_at": now, "last_seen_at": now, "rate": F.col("__rate"), "any_at_cap": F.col("__at_cap"), "near_miss_at": F.when(near, now),
        "image_hash": F.coalesce("image_hash", "__image_hash"), "failure_streak": F.lit(0), "quarantined_until": none, "gone_at": none, "refresh_requested_at": none,
    }
    kinds = {f.name: f.dataType for f in states.schema}
    cols = [F.when(seen, new[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in states.columns]
    edge = seen & F.coalesce("__at_cap", F.lit(False)) & ~F.coalesce("any_at_cap", F.lit(False))
    return states.join(v, key, "left").select(*cols, edge.alias("newly_at_cap"))


def gone_candidates(missing: DataFrame, walks: DataFrame, now: Column | None = None) -> DataFrame:
    """``missing`` with ``verdict`` before any quota: healed, no_verdict or gone. Whether a walk still lists a key is judged at
    ``now``, or at each row's own ``at``."""
    proved = F.coalesce("completed", F.lit(False)) & (F.coalesce("seen", F.lit(0)) > 0)
    listed = F.coalesce(F.col("last_seen_at") >= (F.col("at") if now is None else now), F.lit(False))
    verdict = F.when(~F.col("url").eqNullSafe(F.col("failing_url")), "healed").when(~proved | listed, "no_verdict").otherwise("gone")
    return missing.join(walks, "set_id", "left").select(*missing.columns, verdict.alias("verdict"))


def gone_verdicts(missing: DataFrame, walks: DataFrame, now: Column, gone_today: int = 0, most_a_day: int = 25) -> DataFrame:
    """``id, verdict`` for ``missing(id, set_id, failing_url, url, last_seen_at)``: keys whose page is away, as they
    are after ``walks(set_id, completed, seen)`` of their sets.

    A new address heals. An unfinished or empty walk proves nothing, nor does one that still lists the key. Else the key
    is gone, until ``most_a_day`` verdicts of a day are used up, in the order of ids; beyond that there is none. Where the
    day's count is to be carried from batch to batch, see ``streaming.visits.gone_sink``.
    """
    judged = gone_candidates(missing, walks, now).select("id", "verdict")
    first = judged.filter("verdict = 'gone'").orderBy("id").limit(max(0, most_a_day - gone_today)).select(F.col("id").alias("__id"))
    braked = judged.join(F.broadcast(first), F.col("id") == F.col("__id"), "left")  # at most most_a_day rows
    return braked.select("id", F.when((F.col("verdict") == "gone") & F.col("__id").isNull(), "no_verdict").otherwise(F.col("verdict")).alias("verdict"))


def missing_suspects(visits: DataFrame, streaks: DataFrame, key: str, threshold: int = 3) -> DataFrame:
    """Visits answered by a redirect whose strike would bench the key: ``visits(key, status, ...)`` with
    ``streaks(key, failure_streak)`` before them; an unknown key has none."""
    counted = visits.join(streaks.select(key, "failure_streak"), key, "left")
    redirected = (F.col("status") >= 300) & (F.col("status") < 400)
    return counted.filter(redirected & (F.coalesce("failure_streak", F.lit(0)) + 1 >= threshold)).drop("failure_streak")


def within_quota(candidates: DataFrame, at: str, order: list[str], before: list, most: int, seconds: float) -> list:
    """The order values of the candidates that a rolling quota lets through: one passes if fewer than ``most`` passed in the
    ``seconds`` before it; one that passed just so long ago no longer counts. ``order`` is total and begins with ``at``, a
    timestamp; ``before`` are the times of the last ones that passed.

    A pass frees its place at a time that is known at once, so the next ``most`` passes are the first candidates after
    the last ``most`` freed times. Each round asks for at most ``most`` candidates from each of these on, and settles
    ``most`` passes; rounds are in proportion to passes, not to candidates, and only passes and their rivals are seen here.
    """
    span = datetime.timedelta(seconds=seconds)
    passed, held = [], sorted(before)[-most:]
    last: tuple | None = None
    columns = F.struct(*order)
    while True:
        freed = [None] * (most - len(held)) + [t + span for t in held]
        after = candidates if last is None else candidates.filter(columns > F.struct(*[F.lit(v).cast(candidates.schema[c].dataType).alias(c) for c, v in zip(order, last)]))
        rivals = None
        for t in sorted({t for t in freed if t is not None}):
            part = after.filter(F.col(at) >= F.lit(t)).select(*order).orderBy(*order).limit(most)
            rivals = part if rivals is None else rivals.unionByName(part)
        if None in freed:
            part = after.select(*order).orderBy(*order).limit(most)
            rivals = part if rivals is None else rivals.unionByName(part)
        rows = sorted({tuple(r) for r in rivals.collect()})  # at most most * most rows
        settled = 0
        for t in freed:
            best = next((r for r in rows if (last is None or r > last) and (t is None or r[0] >= t)), None)
            if best is None:
                break
            passed.append(best)
            held.append(best[0])
            last = best
            settled += 1
        held = held[-most:]
        if settled < len(freed):
            return passed


def delisted_probe(states: DataFrame, now: Column, days: int = 1, most: int = 1) -> DataFrame:
    """Delisted keys to be asked again: never asked first, then the longest not asked."""
    due = F.col("delisted_probed_at").isNull() | (F.col("delisted_probed_at") < now - F.make_dt_interval(F.lit(days)))
    return states.filter(F.col("delisted_at").isNotNull() & due).orderBy(F.asc_nulls_first("delisted_probed_at"), "id").limit(most)


def pending_images(states: DataFrame, most: int = 50) -> DataFrame:
    """Living keys whose image is known and not fetched yet, by id."""
    return states.filter(living() & F.col("image_hash").isNotNull() & F.col("image_fetched_at").isNull()).orderBy("id").limit(most)


def pending_walks(sets: DataFrame, excluded: DataFrame, now: Column, days: int) -> DataFrame:
    """Sets never walked or not for ``days``, without the ``excluded(slug)``; their order is never walked, then stalest."""
    due = F.col("last_walked_at").isNull() | (F.col("last_walked_at") < now - F.make_dt_interval(F.lit(days)))
    return sets.filter(due).join(excluded.select("slug"), "slug", "left_anti").orderBy(F.asc_nulls_first("last_walked_at"), "id")


def first_unvisited(states: DataFrame) -> DataFrame:
    """The living key with the least id that was never visited."""
    return states.filter(living() & F.col("last_visited_at").isNull()).orderBy("id").limit(1)


def one_flight(requests: DataFrame, key: str, order: str) -> DataFrame:
    """Requests of one key that wait together become one visit: the first, with how many it serves."""
    return requests.groupBy(key).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("served"))


def pending_worksheet(keys: DataFrame, details: DataFrame, pending: int, key: str = "id") -> DataFrame:
    """Keys without a detail row that is past ``pending``: the status belongs to the join, not to a filter after it."""
    return keys.join(details.filter(F.col("match_status") != pending).select(key), key, "left_anti")


def tag_listing(items: DataFrame, links: DataFrame, names: DataFrame, separator: str = " · ") -> DataFrame:
    """``items(id, ...)`` with the names of their ``links(id, tag)``, joined in the order of tags; null if there is none."""
    joined = links.join(names, "tag").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("tag", "name"))).alias("x"))
    return items.join(joined.select("id", F.array_join("x.name", separator).alias("tags")), "id", "left")


def sample_rows(rows: DataFrame, most: int, seed: int, key: str = "id") -> DataFrame:
    """A repeatable random sample: the first by a hash of seed and key."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(most)


def canary(facts: DataFrame, tiers: list[str], deep_tier: str, least_months: int = 60, least_buckets: int = 3) -> DataFrame:
    """``id, failures`` of pages known to be rich. An empty list is a pass.

    ``facts(id, chart map<string, array>, has_population, sale_tiers array)``, and where they are known ``status``, the
    HTTP status of a page that wasn't fetched, ``drift``, why it couldn't be read, and ``latest array<struct<tier, cents>>``,
    its newest prices in the order of ``tiers``. A page that has a status or drift fails by that alone. Else each absent
    tier is named, as are a history that is too short, an absent census, too few tiers with sales, and each two
    neighbouring tiers, of those with a price that isn't zero, of which the higher one costs less."""
    absent = F.array_except(F.lit(tiers), F.map_keys("chart"))
    months = F.size(F.col("chart")[deep_tier])
    checks = [
        F.when(F.size(absent) > 0, F.concat(F.lit("no series for "), F.array_join(absent, ", "))),
        F.when(F.map_contains_key("chart", deep_tier) & (months < least_months), F.concat(F.lit(f"{deep_tier} goes back "), months.cast("string"), F.lit(" months"))),
        F.when(~F.col("has_population"), F.lit("no census")),
        F.when(F.size(F.array_distinct("sale_tiers")) < least_buckets, F.lit(f"sales in under {least_buckets} tiers")),
    ]
    failures = F.array_compact(F.array(*checks))
    if "latest" in facts.columns:
        priced = F.filter("latest", lambda p: F.coalesce(p["cents"], F.lit(0)) > 0)
        pairs = F.filter(F.arrays_zip(priced.alias("low"), F.slice(priced, 2, F.greatest(F.size(priced), F.lit(1))).alias("high")), lambda x: x["high"]["cents"] < x["low"]["cents"])
        text = lambda x: F.concat(x["tier"], F.lit(" "), x["cents"].cast("string"))
        failures = F.concat(failures, F.transform(pairs, lambda x: F.concat(text(x["low"]), F.lit(" above "), text(x["high"]))))
    if "drift" in facts.columns:
        failures = F.when(F.col("drift").isNotNull(), F.array(F.concat(F.lit("unreadable: "), F.col("drift")))).otherwise(failures)
    if "status" in facts.columns:
        failures = F.when(F.col("status").isNotNull(), F.array(F.concat(F.lit("status "), F.col("status").cast("string")))).otherwise(failures)
    return facts.select("id", failures.alias("failures"))


def page_canary(judged: DataFrame, key: str, tiers: list[str], deep_tier: str, status: Column | None = None, **least: int) -> DataFrame:
    """The canary over judged pages (``sources.visit_page``): what their one parse gave is all it looks at. The newest price of a
    tier is the last of its series."""
    points = F.coalesce("page.chart", F.array().cast("array<struct<tier:string,ms:bigint,cents:int>>"))
    series = lambda t: F.filter(points, lambda p: p["tier"] == t)
    entries = F.filter(F.array(*[F.struct(F.lit(t).alias("tier"), series(t).alias("points")) for t in tiers]), lambda e: F.size(e["points"]) > 0)
    facts = judged.select(
        F.col(key).alias("id"), F.map_from_entries(entries).alias("chart"), F.col("page.census").isNotNull().alias("has_population"), F.coalesce(F.col("page.sales.tier"), F.array().cast("array<string>")).alias("sale_tiers"),
        F.when(F.col("verdict") != "ok", F.col("reason")).alias("drift"), (F.lit(None).cast("int") if status is None else status).alias("status"),
        F.transform(entries, lambda e: F.struct(e["tier"].alias("tier"), F.element_at(e["points"], -1)["cents"].alias("cents"))).alias("latest"),
    )
    return canary(facts, tiers, deep_tier, **least)


OUTCOMES = {"parsed": 0, "http_error": 1, "parse_failed": 2, "not_a_card": 3}


def outcome_tag(code: Column) -> Column:
    """The name of an outcome, ``unknown`` for any other code."""
    out = F.lit("unknown")
    for name, n in OUTCOMES.items():
        out = F.when(code == n, name).otherwise(out)
    return out


def observed(rows: DataFrame, name: str, **measures: Column):
    """``rows`` that count and gauge themselves while they are written, and the ``Observation`` to read afterwards."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return rows.observe(seen, *[c.alias(k) for k, c in measures.items()]), seen
