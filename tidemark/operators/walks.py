"""Listings that come in pages, each with a hidden form that names the next one: walks, their verdicts, what they list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import written

#: The cursor of a listing's first page.
FIRST = ""


def walk_steps(listings: DataFrame, pages: DataFrame, key: str, cursor: str, following: str, most: int = 20) -> DataFrame:
    """``key, cursor, step`` of the pages that a walk of each listing asks for, at most ``most`` of them, from step 0.

    ``pages(key, cursor, following)`` says what page each one names next, null at the end. Steps are doubled: knowing the
    page after every 2^k steps, each round reaches twice as far, so a walk of 20 pages is five rounds of two joins on
    ``(key, cursor)``, however many pages a listing has. A circle is walked until ``most``."""
    hops = written(pages.filter(F.col(following).isNotNull()).groupBy(key, cursor).agg(F.min(following).alias("__to")), "walk-hops")
    steps = listings.select(key).distinct().select(key, F.lit(FIRST).alias(cursor), F.lit(0).alias("step"))
    reach = 1
    while reach < most:
        onward = steps.join(hops, [key, cursor]).select(key, F.col("__to").alias(cursor), (F.col("step") + reach).alias("step")).filter(F.col("step") < most)
        steps = written(steps.unionByName(onward), "walk-steps")
        reach *= 2
        if reach < most:
            further = hops.select(key, F.col(cursor).alias("__to"), F.col("__to").alias("__beyond"))
            hops = written(hops.join(further, [key, "__to"]).select(key, cursor, F.col("__beyond").alias("__to")), "walk-hops")
    return steps


def walk_verdicts(steps: DataFrame, pages: DataFrame, key: str, cursor: str, following: str, drift: str, products: str, most: int = 20) -> DataFrame:
    """``key, outcome, completed, pages, seen``: how each walk ended, how many pages it read and rows it saw.

    ``pages`` also has ``drift``, the reason why a page can't be read, and ``products``, the number of its rows. A walk that
    asks for a page that isn't there, or reads one that is drift, is left incomplete; one that still names a next
    page after ``most`` pages is a runaway, abandoned. Only a walk to a page that names no next one is completed."""
    met = steps.join(pages.select(key, cursor, following, drift, F.col(products).alias("__n"), F.lit(True).alias("__there")), [key, cursor], "left")
    sound = F.col("__there").isNotNull() & F.col(drift).isNull()
    ends = met.groupBy(key).agg(
        F.max_by(F.struct("__there", drift, following, "step"), "step").alias("last"), F.count_if(sound).alias("pages"), F.coalesce(F.sum(F.when(sound, F.col("__n"))), F.lit(0)).alias("seen")
    )
    last = F.col("last")
    outcome = F.when(last["__there"].isNull(), "missing page").when(last[drift].isNotNull(), "drift").when(last[following].isNull(), "completed").when(last["step"] == most - 1, "runaway").otherwise("missing page")
    return ends.select(key, outcome.alias("outcome"), (outcome == "completed").alias("completed"), "pages", F.col("seen").cast("bigint").alias("seen"))


def walked_rows(steps: DataFrame, pages: DataFrame, key: str, cursor: str, rows: str, row_key: str) -> DataFrame:
    """``key`` and the fields of the array ``rows`` of all pages met, one for each ``row_key``: as the last page of the walk
    says it, as each page overwrites what an earlier one said."""
    met = steps.join(pages.select(key, cursor, rows), [key, cursor]).select(key, "step", F.posexplode(rows).alias("__pos", "__row"))
    found = met.select(key, "step", "__pos", "__row.*")
    fields = [c for c in found.columns if c not in (key, "step", "__pos", row_key)]
    last = found.groupBy(key, row_key).agg(F.max_by(F.struct(*fields), F.struct("step", "__pos")).alias("__row"))
    return last.select(key, row_key, "__row.*")
