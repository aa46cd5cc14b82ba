"""Per-key state machines as left folds over time-ordered events.

The batch form folds each key's ordered events in one group, batch by batch of an
Arrow stream, so a long history never sits in memory at once; the stream form keeps
the same state between micro-batches. Both call the same ``step``. Machines that
need no fold (streaks) are windows; the breaker, one global order, is a segmented scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timing import sentence_days
from tidemark.storage import written


@dataclass
class Backoff:
    """Additive-increase, multiplicative-decrease pacing with a slow start."""

    floor: float = 10.0
    ceiling: float = 300.0
    less: float = 5.0
    slow_start: float = 0.5
    pause_after: int = 3

    FIELDS = "delay double, failures int, paused boolean"

    def initial(self) -> dict:
        return {"delay": self.ceiling, "starting": True, "failures": 0}

    def step(self, s: dict, kind: str, seconds: float | None = None) -> tuple:
        """``kind``: ok, slow, fail or limited; ``seconds``: a Retry-After."""
        if kind == "ok":
            less = s["delay"] - self.less
            s["delay"] = max(self.floor, min(s["delay"] * self.slow_start, less) if s["starting"] else less)
            s["failures"] = 0
        else:
            s["starting"] = False
            s["delay"] = self.ceiling if kind == "limited" else min(2 * s["delay"], self.ceiling)
            if seconds is not None:
                s["delay"] = max(s["delay"], seconds)
            s["failures"] += kind != "slow"
        return s["delay"], s["failures"], s["failures"] >= self.pause_after


@dataclass
class Cooldown:
    """Emits unless less than the window has passed since the last emitted event."""

    seconds: float = 6 * 3600.0

    FIELDS = "emitted boolean"

    def initial(self) -> dict:
        return {"last": None}

    def step(self, s: dict, kind: str, seconds: float | None = None) -> tuple:
        """``seconds``: the event's time."""
        emit = s["last"] is None or seconds - s["last"] >= self.seconds
        if emit:
            s["last"] = seconds
        return (emit,)


@dataclass
class BenchSlot:
    """Open unless within interval * 2^min(n - 1, 5) of the last failed retry."""

    seconds: float = 3600.0

    FIELDS = "open boolean, failures int"

    def initial(self) -> dict:
        return {"last": None, "n": 0}

    def step(self, s: dict, kind: str, seconds: float | None = None) -> tuple:
        is_open = s["last"] is None or seconds - s["last"] >= self.seconds * 2 ** min(s["n"] - 1, 5)
        if is_open:
            if kind == "fail":
                s["last"], s["n"] = seconds, s["n"] + 1
            else:
                s["last"], s["n"] = None, 0
        return is_open, s["n"]


def fold(events: DataFrame, machine, keys: list[str], order: list[str], kind: str, seconds: str | None = None) -> DataFrame:
    """``events`` with the machine's fields after each event of its key.

    One shuffle; keys are sorted within partitions and folded as a stream of batches."""
    fields = machine.FIELDS
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            rows = []
            key_rows = batch[keys].itertuples(index=False, name=None)
            times = batch[seconds] if seconds else [None] * len(batch)
            for key, k, t in zip(key_rows, batch[kind], times):
                if key != current:
                    current, state = key, machine.initial()
                rows.append(machine.step(state, k, None if t is None or t != t else float(t)))
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    return events.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, f"{schema}, {fields}")


def failure_streak(events: DataFrame, keys: list[str], order: list[Column], failed: Column) -> DataFrame:
    """Adds ``streak``: failures since the key's last success, up to and with this event."""
    w = Window.partitionBy(*keys).orderBy(*order)
    e = events.withColumn("__fail", failed.cast("int"))
    e = e.withColumn("__island", F.sum(1 - F.col("__fail")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy(*keys, "__island").orderBy(*order)
    return e.withColumn("streak", F.sum("__fail").over(island.rowsBetween(Window.unboundedPreceding, 0))).drop("__fail", "__island")


def quarantine_state(events: DataFrame, keys: list[str], at: str, order: list[Column], failed: Column) -> DataFrame:
    """Each key's newest event: ``streak``, ``sentence_days`` and whether it just joined the bench."""
    streaks = failure_streak(events, keys, order, failed).withColumn("sentence_days", sentence_days(F.col("streak")))
    cols = ["streak", "sentence_days"]
    latest = streaks.groupBy(*keys).agg(F.max_by(F.struct(at, *cols), F.struct(*order)).alias("s"))
    return latest.select(*keys, "s.*").withColumn("joined", F.col("streak") == 3)


def same_key_breaker(events: DataFrame, key: str, order: list[str], failed: Column, threshold: int = 3, slices: int | None = None) -> DataFrame:
    """Adds ``run`` and ``tripped``: consecutive failures of one key over all events in one global order, reset by any
    success of any key.

    A segmented scan. Events are dealt into slices of the order by range; each slice counts its runs alone. A table with one
    row for each slice says how its last run goes on: only slices that are one run from end to end hand on the run they were
    given, so the lengths to carry are sums over islands of such slices. They are added to the first run of the next
    slice. The order must be total; a null ``failed`` is a success, a null key is a key. ``slices`` is the number of
    ranges, by default Spark's; the carried table, as many rows, is the only thing that one task sees whole.
    """
    bad = F.coalesce(failed, F.lit(False))
    parts = events.withColumn("__bad", bad)
    parts = parts.repartitionByRange(slices, *order) if slices else parts.repartitionByRange(*order)
    # Ranges are sampled, so they are written down before anything is counted by them.
    e = written(parts.withColumn("__slice", F.spark_partition_id()), "breaker-slices")
    w = Window.partitionBy("__slice").orderBy(*order)
    same = F.coalesce(F.lag("__bad").over(w) & F.col("__bad") & F.lag(key).over(w).eqNullSafe(F.col(key)), F.lit(False))
    e = e.withColumn("__island", F.sum((~same).cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("__slice", "__island").orderBy(*order)
    e = e.withColumn("__run", F.when(F.col("__bad"), F.row_number().over(inside)).otherwise(0).cast("bigint"))
    at = F.struct(*order)
    ends = e.groupBy("__slice").agg(
        F.max("__island").alias("islands"), F.min_by("__bad", at).alias("first_bad"), F.min_by(F.struct(key), at).alias("first_key"),
        F.max_by("__run", at).alias("last_run"), F.max_by("__bad", at).alias("last_bad"), F.max_by(F.struct(key), at).alias("last_key"),
    )
    line = Window.orderBy("__slice")
    goes_on = F.coalesce(F.lag("last_bad").over(line) & F.col("first_bad") & F.lag("last_key").over(line).eqNullSafe(F.col("first_key")), F.lit(False))
    ends = ends.withColumn("goes_on", goes_on)
    ends = ends.withColumn("chain", F.sum((~(F.col("goes_on") & (F.col("islands") == 1))).cast("bigint")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    # A slice of one run that goes on adds its length to the chain; any other starts a chain with its own last run.
    ends = ends.withColumn("carried_out", F.sum("last_run").over(Window.partitionBy("chain").orderBy("__slice").rowsBetween(Window.unboundedPreceding, 0)))
    carried = ends.select("__slice", F.when(F.col("goes_on"), F.lag("carried_out").over(line)).otherwise(0).alias("__carried"))
    out = e.join(carried, "__slice")
    run = F.col("__run") + F.when((F.col("__island") == 1) & F.col("__bad"), F.col("__carried")).otherwise(0)
    return out.withColumn("run", run).withColumn("tripped", F.col("run") >= threshold).select(*events.columns, "run", "tripped")
