"""Append-only, change-aware histories: latest values, change-only rows, deduplicated appends, upserts, deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, keys: list[str], at: str, value: str, tiebreak: str | None = None) -> DataFrame:
    """``keys, value, at`` of each key's newest row; of equal times the greatest tiebreak. Combines before it shuffles."""
    order = F.struct(*[F.col(c) for c in (at, tiebreak) if c])
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.max(at).alias(at))


def last_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The whole first row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def change_only_plan(new: DataFrame, latest: DataFrame, keys: list[str], value: str, default=0) -> DataFrame:
    """Rows of ``new`` whose value differs from the last known one; an unknown one counts as ``default``."""
    known = latest.select(*keys, F.col(value).alias("__last"))
    changed = F.coalesce(F.col("__last"), F.lit(default)) != F.col(value)
    return new.join(known, keys, "left").filter(changed).drop("__last")


def change_only_history(df: DataFrame, keys: list[str], at: str, value: str, default=0) -> DataFrame:
    """Of a full series of observations, those that a change-only history would have kept."""
    w = Window.partitionBy(*keys).orderBy(at)
    return df.withColumn("__last", F.lag(value, 1, default).over(w)).filter(F.col(value) != F.col("__last")).drop("__last")


def delta_history(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Adds the change since the key's previous observation, null on the first."""
    w = Window.partitionBy(*keys).orderBy(at)
    return df.withColumn("delta", F.col(value) - F.lag(value).over(w))


def dedup_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each natural key, the first in a total order; twins collapse before the shuffle."""
    cols = [c for c in df.columns if c not in keys]
    names = [f"__o{i}" for i in range(len(order))]
    packed = df.select("*", *[c.alias(n) for c, n in zip(order, names)])
    best = packed.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*names)).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def dedup_append(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows of ``new`` to append: one for each key that ``existing`` doesn't hold, whoever holds it."""
    return dedup_rows(new, keys, order).join(existing.select(*keys).distinct(), keys, "left_anti")


def upsert_actions(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, action``: inserted or touched, once for each key that arrives."""
    held = existing.select(*keys).distinct().withColumn("__held", F.lit(True))
    return new.select(*keys).distinct().join(held, keys, "left").select(*keys, F.when(F.col("__held"), "touched").otherwise("inserted").alias("action"))


def verdict_changes(new: DataFrame, latest: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Verdicts that differ from the latest stored one in any field, nulls compared as values."""
    stored = latest.select(key, F.struct(*fields).alias("__stored"))
    return new.join(stored, key, "left").filter(~F.struct(*fields).eqNullSafe(F.col("__stored"))).drop("__stored")


def verdict_log(new: DataFrame, log: DataFrame, key: str, fields: list[str], at: str, order: str) -> DataFrame:
    """The rows of ``new`` to append to a log of verdicts: those that differ in any field from their key's latest in the log.

    ``new(key, fields, at, version)`` carries what it was judged by, which is kept but not compared: the same verdict by
    another version of a catalog is no change. ``order`` is the log's column of time; combined before it is shuffled."""
    latest = log.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("__last")).select(key, "__last.*")
    return verdict_changes(new, latest, key, fields)


def apply_overrides(rows: DataFrame, overrides: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the columns of a small table of manual overrides, which win."""
    manual = overrides.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__manual"))
    joined = rows.join(manual, key, "left")
    return joined.withColumns({c: F.when(F.col("__manual"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).select(*rows.columns)
