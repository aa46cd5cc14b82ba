"""Value-integrity rules over histories: capped pages, monotonicity, restatement, failure spikes, invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cap_classification(rows: DataFrame, keys: list[str], stream: str, position: str, price: str, day: str, row_id: list[str], full_page: int = 30, run_gap: int = 1000, run_rows: int = 3, partitions: int | None = None) -> DataFrame:
    """``keys, rows, run_rows, price_rows, day_rows, cap_class``.

    Distinct rows; under ``full_page`` of them *recomposed*; *bulk* if runs of consecutive positions (gaps up to
    ``run_gap``, at least ``run_rows`` long) hold half of them, or one price and one day each do; else *organic*.
    A task holds its rows several times, in the order of each window: ``partitions`` is for tables so large that Spark's own
    number of tasks leaves each with too many."""
    # One exchange by key; what comes after it, distinct rows and windows, stays with it.
    distinct = rows.select(*keys, stream, position, price, day, *row_id).repartition(*([partitions] if partitions else []), *keys).dropDuplicates([*keys, *row_id, price, day])
    w = Window.partitionBy(*keys, stream).orderBy(position, *row_id, price, day)
    placed = F.col(position).isNotNull()
    new = placed & F.coalesce(F.col(position) - F.lag(position).over(w) > run_gap, F.lit(True))
    runs = distinct.withColumn("__new", new.cast("int")).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    counted = lambda *by: F.count(F.lit(1)).over(Window.partitionBy(*keys, *by))
    sized = runs.select(*keys, placed.alias("__placed"), counted(stream, "__run", placed).alias("__in_run"), counted(price).alias("__price"), counted(day).alias("__day"))
    in_runs = F.coalesce(F.sum(F.when(F.col("__placed") & (F.col("__in_run") >= run_rows), 1)), F.lit(0))
    out = sized.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), in_runs.alias("run_rows"), F.max("__price").alias("price_rows"), F.max("__day").alias("day_rows"))
    bulk = (2 * F.col("run_rows") >= F.col("rows")) | ((2 * F.col("price_rows") >= F.col("rows")) & (2 * F.col("day_rows") >= F.col("rows")))
    return out.withColumn("cap_class", F.when(F.col("rows") < full_page, "recomposed").when(bulk, "bulk").otherwise("organic"))


def monotonicity_violations(latest: DataFrame, keys: list[str], tier: str, value: str) -> DataFrame:
    """Neighbouring tiers, of those with a value that isn't zero, where the higher one has the lower value."""
    w = Window.partitionBy(*keys).orderBy(tier)
    kept = latest.filter(F.coalesce(F.col(value), F.lit(0)) != 0)
    pairs = kept.select(*keys, F.lag(tier).over(w).alias("lower_tier"), F.col(tier).alias("upper_tier"), F.lag(value).over(w).alias("lower_value"), F.col(value).alias("upper_value"))
    return pairs.filter("upper_value < lower_value")


def restatement(previous: Column, current: Column, least_lost: int = 2, lost_share: float = 0.2, spike_from: int = 10, spike_times: int = 10) -> Column:
    """``decrease``: at least ``least_lost`` and a share lost; ``spike``: more than ``spike_times`` of a count that wasn't small."""
    lost = previous - current
    return F.when((lost >= least_lost) & (lost >= previous * lost_share), "decrease").when((previous >= spike_from) & (current > previous * spike_times), "spike")


def failure_spike(visits: DataFrame, at: list[Column], failed: Column, last: int = 100, least: int = 20, threshold: float = 0.25) -> DataFrame:
    """``samples, failures, share, spike`` of the newest visits: strictly above the threshold, given enough samples."""
    recent = visits.withColumn("__failed", failed).orderBy(*at).limit(last)
    share = F.col("failures") / F.nullif(F.col("samples"), F.lit(0))
    out = recent.agg(F.count(F.lit(1)).alias("samples"), F.count_if("__failed").alias("failures"))
    return out.select("samples", "failures", share.alias("share"), ((F.col("samples") >= least) & F.coalesce(share > threshold, F.lit(False))).alias("spike"))


def rolling_brake(events: DataFrame, at: str, now: Column, days: int = 1, most: int = 10) -> DataFrame:
    """``stops, braked``: events in the last days, and whether they reach the brake."""
    stops = events.agg(F.count_if(F.col(at) > now - F.make_dt_interval(F.lit(days))).alias("stops"))
    return stops.withColumn("braked", F.col("stops") >= most)


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str, name: str) -> DataFrame:
    """``name, violations``: rows without their parent."""
    held = parents.select(F.col(parent_key).alias(child_key)).distinct()
    return children.join(held, child_key, "left_anti").agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("name"), "violations")


def duplicate_keys(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    again = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return again.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("name"), "violations")
