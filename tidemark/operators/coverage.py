"""Did a page that shows only its newest rows roll between two visits? Overlaps, rates, gaps and cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.history import last_rows


def batches(df: DataFrame, keys: list[str], at: str, day: str) -> DataFrame:
    """One row for each capture of a key: rows written, oldest and newest day."""
    return df.groupBy(*keys, at).agg(F.count(F.lit(1)).alias("rows_written"), F.min(day).alias("batch_oldest"), F.max(day).alias("batch_newest"))


def gap_candidates(df: DataFrame, keys: list[str], at: str, day: str, bucket: str, open_bucket: str, floor: int = 30) -> DataFrame:
    """Captures after a key's first, with what was known before and the page's estimated cap.

    All windows share one partitioning and order, so the batches are shuffled once."""
    w = Window.partitionBy(*keys).orderBy(at)
    whole = Window.partitionBy(*keys)
    seq = batches(df, keys, at, day).select(
        "*",
        F.row_number().over(w).alias("seq"),
        F.max("rows_written").over(whole).alias("est_page_cap"),
        F.max("batch_newest").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("last_known"),
        F.lag(at).over(w).alias("prev_visit"),
    )
    cap = F.when(F.col(bucket) == open_bucket, F.greatest("est_page_cap", F.lit(floor))).otherwise(floor)
    return seq.filter("seq > 1").withColumn("page_cap", cap.cast("bigint"))


def gap_verdict() -> Column:
    full = F.col("rows_written") >= F.col("page_cap")
    return F.when(full & (F.col("batch_oldest") > F.col("last_known")), "GAP").when(full & (F.col("batch_oldest") == F.col("last_known")), "BOUNDARY").when(full, "FULL").otherwise("OK")


def gap_audit(df: DataFrame, keys: list[str], at: str, day: str, bucket: str, open_bucket: str, floor: int = 30) -> DataFrame:
    return gap_candidates(df, keys, at, day, bucket, open_bucket, floor).withColumn("verdict", gap_verdict())


def gap_report(candidates: DataFrame, key: str, at: str, names: DataFrame, groups: DataFrame) -> DataFrame:
    """The full captures with the names of their key and group, in the order of verdict, key and capture.

    ``names(key, name, group_id)`` and ``groups(group_id, group_name)``: a key that has no name, or whose group isn't known,
    isn't reported. ``blind_from`` and ``blind_to`` bound the days that may be lost; a page that shows a day already known
    reached back, and lost nothing."""
    reached = F.col("batch_oldest") <= F.col("last_known")
    full = candidates.filter(F.col("rows_written") >= F.col("page_cap")).join(names, key).join(groups, "group_id")
    verdict = F.when(reached, "reached back").otherwise("GAP")
    out = full.withColumn("verdict", verdict).withColumn("visit_gap_days", F.round(F.datediff(F.col(at), F.col("prev_visit")).cast("double"), 2))
    rest = [c for c in candidates.columns if c not in (key, at, "rows_written", "page_cap", "last_known", "batch_oldest", "batch_newest", "prev_visit", "seq", "est_page_cap")]
    return out.orderBy("verdict", key, at, *rest).select(key, "name", "group_name", *rest, at, F.col("rows_written").alias("new_rows"), "page_cap", F.col("last_known").alias("blind_from"), F.col("batch_oldest").alias("blind_to"), "visit_gap_days", "verdict")


def cut_list(candidates: DataFrame, key: str, at: str, exclusions: DataFrame | None = None) -> DataFrame:
    """``key, cut_at``: the first day after each key's latest gap. ``exclusions(key, batch_oldest)`` stay uncut."""
    gaps = candidates.filter((F.col("rows_written") >= F.col("page_cap")) & (F.col("batch_oldest") > F.col("last_known")))
    if exclusions is not None:
        gaps = gaps.join(exclusions, [key, "batch_oldest"], "left_anti")
    return last_rows(gaps, [key], [F.desc(at), F.desc("batch_oldest")]).select(key, F.col("batch_oldest").alias("cut_at"))


def cut_plan(df: DataFrame, cuts: DataFrame, key: str, day: str) -> DataFrame:
    """``key, cut_at, to_delete, to_keep``: both counts in one pass."""
    counts = df.join(cuts, key).groupBy(key, "cut_at").agg(F.count_if(F.col(day) < F.col("cut_at")).alias("to_delete"), F.count_if(F.col(day) >= F.col("cut_at")).alias("to_keep"))
    return cuts.join(counts.drop("cut_at"), key, "left").na.fill(0, ["to_delete", "to_keep"])


def after_cut(df: DataFrame, cuts: DataFrame, key: str, day: str) -> DataFrame:
    """What stays: keys without a cut in full, others from their cut on."""
    return df.join(cuts, key, "left").filter(F.col("cut_at").isNull() | (F.col(day) >= F.col("cut_at"))).drop("cut_at")


def execute_cut(df: DataFrame, cuts: DataFrame, key: str, day: str, rollback_path: str, out_path: str) -> tuple[int, int]:
    """Exports the rows to be cut as CSV, writes what stays, and refuses if the counts disagree."""
    gone = df.join(cuts, key).filter(F.col(day) < F.col("cut_at")).drop("cut_at")
    gone.write.option("header", True).csv(rollback_path)
    after_cut(df, cuts, key, day).write.parquet(out_path)
    spark = df.sparkSession
    exported = spark.read.option("header", True).csv(rollback_path).count()
    removed = df.count() - spark.read.parquet(out_path).count()
    if exported != removed:
        raise RuntimeError(f"removed {removed} rows but exported {exported}; keep the original")
    return exported, removed


def overlap(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, held_before, newly_written`` from row counts before and after a write; newly written is never negative."""
    b = before.groupBy(*keys).agg(F.count(F.lit(1)).alias("held_before"))
    a = after.groupBy(*keys).agg(F.count(F.lit(1)).alias("__after"))
    joined = b.join(a, keys, "full_outer").na.fill(0, ["held_before", "__after"])
    return joined.select(*keys, "held_before", F.greatest(F.col("__after") - F.col("held_before"), F.lit(0)).alias("newly_written"))


def at_cap(held: Column, newly: Column, distinct_on_page: Column) -> Column:
    """Nothing of what was held is on the page any more."""
    return (held > 0) & (newly >= distinct_on_page)


def page_margins(page: DataFrame, overlaps: DataFrame, keys: list[str], bucket: str, natural_key: list[str], position: str) -> DataFrame:
    """Each bucket on the page: distinct rows, first position, overlap."""
    seen = page.groupBy(*keys, bucket).agg(F.countDistinct(F.struct(*natural_key)).alias("distinct_on_page"), F.min(position).alias("first_pos"))
    return seen.join(overlaps, [*keys, bucket], "left").na.fill(0, ["held_before", "newly_written"])


def at_cap_buckets(margins: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """``keys, bucket``: each key's first bucket, in page order, that is at its cap."""
    hit = margins.filter(at_cap(F.col("held_before"), F.col("newly_written"), F.col("distinct_on_page")))
    return hit.groupBy(*keys).agg(F.min_by(bucket, F.struct("first_pos", bucket)).alias(bucket))


def narrowest_margin(margins: DataFrame, keys: list[str], bucket: str, full_page: int = 30) -> DataFrame:
    """``keys, bucket, margin``: fewest held rows left on a full page; the first in page order of equals."""
    margin = F.col("distinct_on_page") - F.col("newly_written")
    ok = margins.filter((F.col("held_before") > 0) & (F.col("distinct_on_page") >= full_page)).withColumn("margin", margin)
    return ok.groupBy(*keys).agg(F.min_by(bucket, F.struct("margin", "first_pos", bucket)).alias(bucket), F.min("margin").alias("margin"))


def burst_rate(df: DataFrame, key: str, bucket: str, day: str, today: Column, order: list[str], window_days: int = 30, least_k: int = 3) -> DataFrame:
    """``key, rate``: the hottest bucket's pace. A bucket's pace is the greater of its rows in the window per
    day and, for each k of at least ``least_k``, k rows over the days back to the k-th newest (at least one)."""
    recent = df.filter(F.col(day) > F.date_sub(today, window_days))
    w = Window.partitionBy(key, bucket).orderBy(F.desc(day), *[F.col(c) for c in order])
    ranked = recent.select(key, bucket, day, F.row_number().over(w).alias("__k"))
    pace = F.when(F.col("__k") >= least_k, F.col("__k") / F.greatest(F.datediff(today, F.col(day)), F.lit(1)))
    rates = ranked.groupBy(key, bucket).agg((F.count(F.lit(1)) / window_days).alias("__flat"), F.max(pace).alias("__burst"))
    hottest = rates.groupBy(key).agg(F.max(F.greatest("__flat", "__burst")).alias("rate"))
    return df.select(key).distinct().join(hottest, key, "left").select(key, F.coalesce("rate", F.lit(0.0)).alias("rate"))
