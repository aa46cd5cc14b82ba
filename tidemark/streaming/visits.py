"""The visit pipeline as a stream: deduplicated appends, change-only history, per-key machines.

A micro-batch is one transaction: each output is written below its own batch
folder, and a marker that names the batch comes last. Readers take marked batches only,
so a batch that fails half-way and is run again leaves no trace of its first try.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tidemark.operators.coverage import at_cap_buckets, overlap, page_margins
from tidemark.operators.history import change_only_plan, dedup_append, latest_by_key
from tidemark.operators.sync import membership_pulse
from tidemark.operators.verdicts import gone_candidates, within_quota
from tidemark.sources.detail import utc_day
from tidemark.sources.visit_page import Layout, census_facts, judged_pages


class BatchTable:
    """Append-only output of micro-batches in one folder, read through its markers.

    Tables that are committed together share the folder of markers. Both folders exist from the start: batch -1 is empty."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, committed: str | None = None):
        self.spark, self.path, self.schema, self.committed = spark, path, schema, committed or f"{path}/committed"
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/rows/batch=-1")
        spark.createDataFrame([], "batch bigint").write.mode("ignore").parquet(f"{self.committed}/marker=-1")

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")

    def commit(self, batch: int) -> None:
        self.spark.range(1).select(F.lit(batch).cast("bigint").alias("batch")).coalesce(1).write.mode("overwrite").parquet(f"{self.committed}/marker={batch}")

    def written(self, batch: int) -> DataFrame:
        """Rows of a batch, committed or not."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows/batch={batch}")

    def read(self, before: int | None = None) -> DataFrame:
        """Rows of committed batches; none before the first. A batch reads those ``before`` it: it may come again after
        its own marker, and must then find the table as it was."""
        done = self.spark.read.schema("batch bigint").parquet(self.committed).select("batch").distinct()
        rows = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{self.path}/rows")
        if before is not None:
            rows, done = rows.filter(F.col("batch") < before), done.filter(F.col("batch") < before)
        return rows.join(done, "batch", "left_semi").drop("batch")

    def newest(self, before: int) -> DataFrame:
        """Rows of the newest committed batch before one; no other batch is read."""
        last = self.spark.read.schema("batch bigint").parquet(self.committed).filter(F.col("batch") < before).agg(F.max("batch")).first()[0]
        return self.written(-1 if last is None else last)


class VisitStore:
    """The outputs of visits, each an append-only table, committed by one marker for all."""

    SCHEMAS = {
        "prices": "{key} bigint, {at} timestamp, tier string, month date, cents int",
        "census": "{key} bigint, {at} timestamp, grader string, grade int, population int",
        "sales": "{key} bigint, {at} timestamp, source string, source_id string, sold_on date, tier string, cents int, listed_cents int, title string",
        "visits": "{key} bigint, {at} timestamp, verdict string, reason string, image string, title string, links int, new_prices bigint, new_cells bigint, new_sales bigint, at_cap boolean",
    }

    def __init__(self, spark: SparkSession, path: str, key: str, at: str):
        self.key, self.at = key, at
        schema = lambda text: spark.createDataFrame([], text.format(key=key, at=at)).schema
        self.tables = {name: BatchTable(spark, f"{path}/{name}", schema(text), f"{path}/committed") for name, text in self.SCHEMAS.items()}

    def __getitem__(self, name: str) -> BatchTable:
        return self.tables[name]

    def commit(self, batch: int) -> None:
        self.tables["visits"].commit(batch)


def visit_sink(store: VisitStore, layout: Layout, html: str = "html") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each page is parsed once, its verdict decides, and all outputs are committed together.

    Prices and census cells are kept where they change (an unknown one counts as 0), sales once for ever by their natural
    key, and every page leaves a visit with what it added. ``at_cap`` says that of some tier nothing that was held before
    is on the page any more. Pages that are drift or rejected leave a visit with its reason and nothing else. Of points of
    one month the last counts. A page may be in a batch several times; its captures are taken in the order of time, but
    ``at_cap`` is judged for them together.
    """
    key, at = store.key, store.at

    def run(batch: DataFrame, number: int) -> None:
        judged = judged_pages(batch.select(key, at, html), layout, html).persist()
        try:
            points = judged.filter("verdict = 'ok'").select(key, at, F.posexplode("page.chart").alias("pos", "p"))
            points = points.groupBy(key, at, F.col("p.tier").alias("tier"), utc_day(F.col("p.ms")).alias("month")).agg(F.max_by("p.cents", "pos").alias("cents"))
            store["prices"].write(changes(points, store["prices"].read(number), [key, "tier", "month"], at, "cents"), number)
            store["census"].write(changes(census_facts(judged, key, at), store["census"].read(number), [key, "grader", "grade"], at, "population"), number)
            held = store["sales"].read(number)
            on_page = judged.filter("verdict = 'ok'").select(key, at, F.posexplode("page.sales").alias("pos", "s")).select(key, at, "pos", "s.*")
            store["sales"].write(dedup_append(held, on_page, ["source", "source_id"], [F.col(c) for c in (at, key, "pos")]), number)
            # What the append met is the evidence, so it is read back before the marker is set.
            new = {name: store[name].written(number) for name in ("prices", "census", "sales")}
            before = held.join(on_page.select(key).distinct(), key, "left_semi")
            margins = page_margins(on_page, overlap(before, before.unionByName(new["sales"]), [key, "tier"]), [key], "tier", ["source", "source_id"], "pos")
            capped = at_cap_buckets(margins, [key], "tier").select(key, F.lit(True).alias("at_cap"))
            visits = judged.select(key, at, "verdict", "reason", "page.image", "page.title", "page.links").join(capped, key, "left").na.fill(False, ["at_cap"])
            for name, column in (("prices", "new_prices"), ("census", "new_cells"), ("sales", "new_sales")):
                visits = visits.join(new[name].groupBy(key, at).agg(F.count(F.lit(1)).alias(column)), [key, at], "left").na.fill(0, [column])
            store["visits"].write(visits, number)
            store.commit(number)
        finally:
            judged.unpersist()

    return run


def changes(new: DataFrame, held: DataFrame, keys: list[str], at: str, value: str, default=0) -> DataFrame:
    """Rows of ``new`` whose value isn't the one before: the key's earlier row of ``new``, or the newest one held."""
    latest = latest_by_key(held, keys, at, value).join(new.select(*keys).distinct(), keys, "left_semi")
    rows = new.select(*keys, at, value).withColumn("__new", F.lit(True)).unionByName(latest.select(*keys, at, value).withColumn("__new", F.lit(False)))
    w = Window.partitionBy(*keys).orderBy("__new", at)
    return rows.withColumn("__last", F.lag(value, 1, default).over(w)).filter(F.col("__new") & (F.col("__last") != F.col(value))).drop("__new", "__last")


def append_new(table: BatchTable, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends rows whose natural key the table doesn't hold, ever."""

    def run(batch: DataFrame, number: int) -> None:
        new = dedup_append(table.read(number), batch, keys, [F.col(c) for c in order])
        table.write(new, number)
        table.commit(number)

    return run


def append_changes(table: BatchTable, keys: list[str], at: str, value: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends each key's newest value of a batch if it differs from the last kept one."""

    def run(batch: DataFrame, number: int) -> None:
        newest = latest_by_key(batch, keys, at, value)
        table.write(change_only_plan(newest, latest_by_key(table.read(number), keys, at, value), keys, value), number)
        table.commit(number)

    return run


def replay(source: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs a stream over all that its source holds now, and ends."""
    writer: DataStreamWriter = source.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.start()
    query.awaitTermination()


def in_order(batches: Iterator[pd.DataFrame], order: list[str]) -> dict[str, np.ndarray]:
    """A key's rows of a micro-batch, sorted, as columns. Keys are many and their rows few, so what counts is the cost of a
    call: one ``lexsort`` over arrays, and frames are only put together where there are several."""
    frames = list(batches)
    rows = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
    columns = {c: rows[c].to_numpy() for c in rows.columns}
    if any(columns[c].dtype == object for c in order):  # texts, or nulls among them
        at = rows.reset_index(drop=True).sort_values(order).index.to_numpy()
    else:
        at = np.lexsort([columns[c] for c in reversed(order)])
    return {c: v[at] for c, v in columns.items()}


def with_columns(rows: dict[str, np.ndarray], names: list[str], values: list[tuple]) -> pd.DataFrame:
    """``rows`` and, after their columns, the values of each row."""
    return pd.DataFrame({**rows, **dict(zip(names, map(list, zip(*values))))}, copy=False)


def fold_schema(events: T.StructType, machine) -> T.StructType:
    """The events' fields and the machine's after them."""
    return T.StructType([*events.fields, *T.StructType.fromDDL(machine.FIELDS).fields])


def fold_stream(events: DataFrame, machine, key: str, order: list[str], kind: str, seconds: str | None = None) -> DataFrame:
    """The stream form of :func:`tidemark.operators.folds.fold`: the same ``step``, its state kept between batches.

    Events of a key must come in order across micro-batches; within one they are sorted."""
    names = [f.split()[0] for f in machine.FIELDS.split(", ")]
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields) + ", " + machine.FIELDS

    def run(key_value, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        import json

        held = json.loads(state.get[0]) if state.exists else machine.initial()
        rows = in_order(batches, order)
        got = [machine.step(held, k, None if t is None or t != t else float(t)) for k, t in zip(rows[kind].tolist(), rows[seconds].tolist() if seconds else [None] * len(rows[kind]))]
        state.update((json.dumps(held),))
        yield with_columns(rows, names, got)

    return events.groupBy(key).applyInPandasWithState(run, out_schema, "state string", "append", "NoTimeout")


def pulse_sink(table: BatchTable, at: str, key: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: sets taken whole become pulses, 1 for each member and one 0 for each that has left.

    The state is the newest set of the table itself: of batches before, only the newest is read.
    ``table(at, key, value)`` keeps a row with a null key for each time, so that an empty set is remembered too. Times must
    come in order across batches; a batch may hold several, and times that were taken before are ignored."""

    def run(batch: DataFrame, number: int) -> None:
        held = table.newest(number)
        last = held.agg(F.max(at)).first()[0]  # one value
        before = held.filter(F.col(at) == F.lit(last)).filter("value = 1 or value is null").select(at, key)
        new = batch.select(at, key) if last is None else batch.select(at, key).filter(F.col(at) > F.lit(last))
        if new.isEmpty():
            return  # nothing was taken, so the newest batch still holds the state
        pulses = membership_pulse(before.unionByName(new), at, key).join(new.select(at).distinct(), at, "left_semi")
        taken = new.select(at).distinct().select(at, F.lit(None).cast(table.schema[key].dataType).alias(key), F.lit(None).cast("int").alias("value"))
        table.write(pulses.unionByName(taken), number)
        table.commit(number)

    return run


FLIGHT = "flight string, served int, coalesced boolean"


def single_flights(requests: DataFrame, key: str, at: str, request: str, seconds: float) -> DataFrame:
    """A stream of requests, each with the flight that serves it: the first of a key opens a flight of so many
    seconds, requests within it ride along (``coalesced``), the next one opens another.

    State by key is the open flight, kept between micro-batches. A timer at its end, in event time, drops it; whether a
    request rides along is decided by its own time, so a late timer changes nothing. ``served`` counts the flight's
    requests so far. ``requests`` needs a watermark on ``at``; a key's requests come in order across batches, and
    within one they are sorted. A request exactly at the end opens a new flight.
    """
    columns = [key, at, request]
    schema = ", ".join(f"`{c}` {requests.schema[c].dataType.simpleString()}" for c in columns) + ", " + FLIGHT

    def run(key_value, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = in_order(batches, [at, request])
        flight, ends, served = state.get if state.exists else (None, 0, 0)
        out = []
        # Whole microseconds since 1970.
        for name, t in zip(map(str, rows[request].tolist()), rows[at].astype("datetime64[us]").astype("int64").tolist()):
            rides = flight is not None and t < ends
            if not rides:
                flight, ends, served = name, t + int(seconds * 1_000_000), 0
            served += 1
            out.append((flight, served, rides))
        state.update((flight, ends, served))
        state.setTimeoutTimestamp(max(ends // 1_000 + 1, state.getCurrentWatermarkMs() + 1))
        yield with_columns(rows, ["flight", "served", "coalesced"], out)

    return requests.select(*columns).groupBy(key).applyInPandasWithState(run, schema, "flight string, ends bigint, served int", "append", "EventTimeTimeout")


def gone_sink(table: BatchTable, walks: DataFrame, most: int = 10, seconds: float = 86_400) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: suspects of the micro-batch, in order, become verdicts under a rolling quota.

    ``suspects(id, at, set_id, failing_url, url, last_seen_at)`` are keys whose page is away, ``walks(set_id, completed, seen)``
    the walks that followed. A new address heals; without a finished, non-empty walk, or where the walk still lists the key,
    there is no verdict; else the key is gone, but for ``most`` in any ``seconds`` before, over all batches, beyond which there
    is none. The state is the table of verdicts itself: its last ``most`` gone ones. Batches come in the order of time; of
    suspects at one time the smaller id is first."""

    def run(batch: DataFrame, number: int) -> None:
        judged = gone_candidates(batch, walks).persist()
        try:
            held = table.read(number).filter("verdict = 'gone'").orderBy(F.desc("at"), F.desc("id")).limit(most).select("at").collect()
            passed = within_quota(judged.filter("verdict = 'gone'"), "at", ["at", "id"], [r["at"] for r in held], most, seconds)
            # As many as a quota allows in the time of a batch.
            let = batch.sparkSession.createDataFrame([(*p, True) for p in passed], T.StructType([judged.schema["at"], judged.schema["id"], T.StructField("__let", T.BooleanType())]))
            out = judged.join(let, ["at", "id"], "left")
            verdict = F.when((F.col("verdict") == "gone") & F.col("__let").isNull(), "no_verdict").otherwise(F.col("verdict"))
            table.write(out.withColumn("verdict", verdict), number)
            table.commit(number)
        finally:
            judged.unpersist()

    return run
