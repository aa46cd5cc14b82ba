import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import folds, sync, verdicts
from tidemark.streaming import visits


def runs(events, threshold=3):
    key, run, out = None, 0, {}
    for i, k, bad in events:
        run = (run + 1 if k == key and run else 1) if bad else 0
        key = k
        out[i] = (run, run >= threshold)
    return out


@pytest.mark.parametrize("share, keys", [(0.97, 1), (0.9, 2), (0.5, 3)])
def test_breaker_is_one_global_order(spark, share, keys):
    """Few keys and many failures: runs go over slices, and whole slices are one run."""
    rnd = random.Random(int(100 * share))
    events = [(i, rnd.choice([None, "a", "b"][-keys:]), rnd.random() < share) for i in range(240)]
    df = spark.createDataFrame([(i, k, b if b or i % 7 else None, "clash") for i, k, b in events], "id bigint, k string, bad boolean, run string").drop("run").repartition(5)
    for slices in (1, 7, 60):
        got = folds.same_key_breaker(df, "k", ["id"], F.col("bad"), slices=slices)
        assert {r["id"]: (r["run"], r["tripped"]) for r in got.collect()} == runs(events)
    assert folds.same_key_breaker(df.limit(0), "k", ["id"], F.col("bad")).count() == 0


def test_breaker_counts_over_many_slices_of_one_run(spark):
    df = spark.range(300).select("id", F.lit(7).alias("k"), (F.col("id") != 250).alias("bad"))
    got = {r["id"]: r["run"] for r in folds.same_key_breaker(df, "k", ["id"], F.col("bad"), slices=50).collect()}
    assert got == {i: i + 1 if i < 250 else i - 250 for i in range(300)}


def test_pulses_remember_empty_sets_and_replays(spark, tmp_path):
    schema = spark.createDataFrame([], "at int, k string, value int").schema
    table = visits.BatchTable(spark, str(tmp_path / "p"), schema)
    sink = visits.pulse_sink(table, "at", "k")
    batch = lambda *rows: spark.createDataFrame(rows, "at int, k string")
    sink(batch((1, "a"), (1, "b"), (1, "b"), (1, None)), 0)
    sink(batch((2, "b"), (3, None), (4, "b"), (4, None)), 1)
    sink(batch((2, "b"), (3, None), (4, "b"), (4, None)), 1)  # again
    sink(batch((4, "x")), 2)  # a time that was taken before
    sink(batch((5, None)), 3)
    sink(batch((6, "a")), 4)
    got = sorted((r["at"], r["k"], r["value"]) for r in table.read().filter("value is not null").collect())
    assert got == [(1, "a", 1), (1, "b", 1), (2, "a", 0), (2, "b", 1), (3, "b", 0), (4, "b", 1), (5, "b", 0), (6, "a", 1)]


def test_pulse_of_one_table(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, "a")], "at int, k string")
    assert sorted(tuple(r) for r in sync.membership_pulse(rows, "at", "k").collect()) == [(1, "a", 1), (2, "a", 0), (3, "a", 1), (4, "a", 1)]


def test_flights_end_by_their_own_time_and_go_on_over_batches(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    batches = [[(1, "k", 0), (2, "k", 9), (3, "j", 9), (4, "k", 9)], [(5, "k", 9.999999), (6, "k", 10), (7, "j", 19)], [(8, "k", 500), (9, "j", 500)], [(10, "k", 509), (11, "i", 900)]]
    schema = "id bigint, k string, at timestamp"
    out = None
    for n, rows in enumerate(batches):
        spark.createDataFrame([(i, k, at(s)) for i, k, s in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withWatermark("at", "0 seconds")
        flown = visits.single_flights(stream, "k", "at", "id", 10)
        out = out or visits.BatchTable(spark, str(tmp_path / "out"), flown.schema)

        def sink(batch, number):
            out.write(batch, number)
            out.commit(number)

        visits.replay(flown, sink, str(tmp_path / "state"))
    got = {r["id"]: (r["flight"], r["served"], r["coalesced"]) for r in out.read().collect()}
    assert got == {
        1: ("1", 1, False), 2: ("1", 2, True), 4: ("1", 3, True), 5: ("1", 4, True), 6: ("6", 1, False), 3: ("3", 1, False), 7: ("7", 1, False),
        8: ("8", 1, False), 9: ("9", 1, False), 10: ("8", 2, True), 11: ("11", 1, False),
    }


@pytest.mark.parametrize("most", [1, 3, 10])
def test_rolling_quota_is_greedy_in_one_order(spark, most):
    rnd = random.Random(most)
    start = datetime.datetime(2024, 1, 1)
    rows = sorted((start + datetime.timedelta(seconds=rnd.randrange(0, 400)), i) for i in range(60))
    rows += [(rows[0][0] + datetime.timedelta(seconds=50), 100), (rows[-1][0], 101)]
    rows.sort()
    before, passed = [start - datetime.timedelta(seconds=s) for s in (20, 49, 50, 51)], []
    for at, i in rows:
        recent = [t for t in [*before, *[p[0] for p in passed]] if t > at - datetime.timedelta(seconds=50)]
        if len(recent) < most:
            passed.append((at, i))
    df = spark.createDataFrame(rows, "at timestamp, id bigint").repartition(3)
    assert verdicts.within_quota(df, "at", ["at", "id"], before, most, 50) == passed
    assert verdicts.within_quota(df.limit(0), "at", ["at", "id"], [], most, 50) == []
