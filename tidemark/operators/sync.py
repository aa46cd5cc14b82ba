"""Current-state tables kept in step with a source: inserts, updates, unchanged rows, tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scd1_actions(existing: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, action``: inserted, updated, unchanged or missing, with nulls compared as values. Arrays that are sets
    should be sorted by the caller."""
    old = existing.select(key, F.struct(*columns).alias("__old"))
    new = source.select(key, F.struct(*columns).alias("__new"))
    both = old.join(new, key, "full_outer")
    action = F.when(F.col("__old").isNull(), "inserted").when(F.col("__new").isNull(), "missing").when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged").otherwise("updated")
    return both.select(key, action.alias("action"))


def scd1_apply(existing: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The table after the sync: rows of the source win, rows that it lacks stay."""
    new = source.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__new"))
    both = existing.select(key, *columns).join(new, key, "full_outer")
    return both.select(key, *[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def catalog_upsert(existing: DataFrame, seen: DataFrame, key: str, update: list[str], now: Column) -> DataFrame:
    """Listing rows merged into a catalog: known keys get new values and ``last_seen_at``, new ones ``first_seen_at`` too."""
    new = seen.select(key, *[F.col(c).alias(f"__{c}") for c in update], F.lit(True).alias("__seen"))
    both = existing.select(key, *update, "first_seen_at", "last_seen_at").join(new, key, "full_outer")
    on = F.col("__seen").isNotNull()
    return both.select(
        key,
        *[F.when(on, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in update],
        F.coalesce("first_seen_at", now).alias("first_seen_at"),
        F.when(on, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
    )


def tally(actions: DataFrame, by: list[str]) -> DataFrame:
    return actions.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def details_for_all(groups: DataFrame, found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Exactly one row for each group: matched with its details, or pending with nulls."""
    hit = found.select(key, *columns, F.lit(True).alias("__hit"))
    out = groups.select(key).distinct().join(hit, key, "left")
    return out.select(key, F.when(F.col("__hit"), "matched").otherwise("pending").alias("match_status"), *columns)


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b)))


def same_map(a: Column, b: Column) -> Column:
    return F.array_sort(F.map_entries(a)).eqNullSafe(F.array_sort(F.map_entries(b)))


def recovered(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys that left a set between two snapshots."""
    return before.select(key).distinct().join(after.select(key), key, "left_anti")


def membership_pulse(rows: DataFrame, at: str, key: str) -> DataFrame:
    """``at, key, value`` of a set that is taken whole at certain times: 1 for each member at each time, and one 0 at the
    next time for each that left.

    ``rows(at, key)``; a row with a null key says that the set was taken, so that empty sets count as well. Times are
    few, members may be many: one shuffle by key, and a member's times are matched against the next time taken."""
    taken = rows.select(at).distinct()
    following = taken.select(at, F.lead(at).over(Window.orderBy(at)).alias("__next"))
    members = rows.filter(F.col(key).isNotNull()).select(at, key).distinct()
    seen = members.join(F.broadcast(following), at).withColumn("__then", F.lead(at).over(Window.partitionBy(key).orderBy(at)))
    left = seen.filter(F.col("__next").isNotNull() & ~F.coalesce(F.col("__then") == F.col("__next"), F.lit(False)))
    return members.select(at, key, F.lit(1).alias("value")).unionByName(left.select(F.col("__next").alias(at), key, F.lit(0).alias("value")))
