"""Small rules that no registered query reaches, each with its boundary values."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text, timing
from tidemark.operators import history, sync, top
from tidemark.sources import documents, pages


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_text_rules(spark):
    df = spark.createDataFrame([(1, "/game/a", "a", ["x" * 30, "b"]), (2, "/game/../a", "b", []), (3, "/other", "a", None), (4, "/game/" + "y" * 600, "b", ["é"] * 10)], "id int, url string, code string, labels array<string>")
    got = df.select("id", text.safe_path(F.col("url"), "/game/").alias("safe"), text.lookup(F.col("code"), {"a": "one", "b": "two"}, "code").alias("found"), text.clip_labels(F.col("labels")).alias("clipped"))
    assert rows(got) == [(1, True, "one", "x" * 24 + "…, b"), (2, False, "two", ""), (3, False, "one", None), (4, False, "two", ", ".join(["é"] * 8))]
    with pytest.raises(Exception, match="unknown code: c"):
        spark.createDataFrame([("c",)], "code string").select(text.lookup(F.col("code"), {"a": "one"}, "code")).collect()
    at = spark.createDataFrame([("v3", "2024-05-06 01:00:00"), (None, "2024-05-06 01:00:00")], "tag string, at string").select(text.version_tag(F.col("tag"), F.col("at").cast("timestamp")).alias("v"))
    assert rows(at) == [("api-2024-05-06",), ("v3",)]
    days = spark.createDataFrame([(0,), (86_399_999,), (86_400_000,), (-1,)], "ms bigint").select(text.epoch_ms_date(F.col("ms")))
    assert rows(days) == [(datetime.date(1969, 12, 31),), (datetime.date(1970, 1, 1),), (datetime.date(1970, 1, 1),), (datetime.date(1970, 1, 2),)]


def test_intake_answers(spark):
    flags = spark.createDataFrame([(1, False, True, True, True, True), (2, True, True, True, True, True), (3, True, False, True, True, True), (4, True, False, False, True, True), (5, True, False, False, False, True), (6, True, False, False, False, False)], "id int, known boolean, odd boolean, delisted boolean, gone boolean, pending boolean")
    outcome = timing.intake_outcome(*[F.col(c) for c in ("known", "odd", "delisted", "gone", "pending")])
    assert rows(flags.select("id", outcome.alias("o"), timing.intake_status(outcome).alias("s"))) == [(1, "unknown", 404), (2, "not_a_card", 410), (3, "delisted", 410), (4, "gone", 410), (5, "already_pending", 200), (6, "accepted", 202)]


def test_sets_maps_overrides_and_verdicts(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"], ["b", "a"], {"x": 1, "y": 2}, {"y": 2, "x": 1}), (2, ["a"], ["a", "b"], {"x": 1}, {"x": 2}), (3, None, None, None, None), (4, [], None, {}, None)], "id int, a array<string>, b array<string>, m map<string,int>, n map<string,int>")
    assert rows(df.select("id", sync.same_set(F.col("a"), F.col("b")), sync.same_map(F.col("m"), F.col("n")))) == [(1, True, True), (2, False, False), (3, True, True), (4, False, False)]
    before, after = (spark.createDataFrame([(k,) for k in ks], "k string") for ks in (["a", "b", "b"], ["b", "c"]))
    assert rows(sync.recovered(before, after, "k")) == [("a",)]
    table = spark.createDataFrame([(1, "x", 1), (2, "y", 2)], "id int, name string, n int")
    manual = spark.createDataFrame([(2, None, 9)], "id int, name string, n int")
    assert sorted(((r["id"], r["name"], r["n"]) for r in history.apply_overrides(table, manual, "id", ["name", "n"]).collect())) == [(1, "x", 1), (2, None, 9)]
    new = spark.createDataFrame([(1, "ok", None, "v2"), (2, "ok", 5, "v2"), (3, "no", None, "v2")], "id int, status string, n int, version string")
    log = spark.createDataFrame([(1, "no", 4, "v0", 1), (1, "ok", None, "v1", 2), (2, "ok", 4, "v1", 2)], "id int, status string, n int, version string, run int")
    assert [(r["id"], r["version"]) for r in history.verdict_log(new, log, "id", ["status", "n"], "run", "run").orderBy("id").collect()] == [(2, "v2"), (3, "v2")]


def test_files_to_fetch_scans_and_archives(spark, tmp_path):
    listed = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    held = spark.createDataFrame([("a", ["x"]), ("b", []), ("d", None)], "k string, content array<string>")
    assert rows(documents.to_fetch(listed, held, "k", "content")) == [("b",), ("c",), ("d",)]
    spark.createDataFrame([(1, "a", 2.0)], "id int, name string, extra double").write.parquet(str(tmp_path / "t"))
    scanned = documents.scan(spark, str(tmp_path / "t"), "name string, absent int")
    assert scanned.columns == ["name", "absent"] and rows(scanned) == [("a", None)]
    seen = spark.createDataFrame([(3, "h1", "late"), (1, "h1", "early"), (2, "h2", "known"), (4, None, "none")], "page int, hash string, body string")
    known = spark.createDataFrame([("h2",)], "hash string")
    assert [(r["hash"], r["page"], r["body"]) for r in pages.archive_new(seen.filter("hash is not null"), known, "hash", "page").collect()] == [("h1", 1, "early")]


def test_first_rows_of_each_group(spark):
    data = [(g, (i * 7) % 50 if i % 9 else None, i) for i in range(200) for g in ("a", None)] + [("b", 1 << 60, 1), ("b", (1 << 60) + 1, 2)]
    df = spark.createDataFrame(data, "g string, k bigint, place bigint").withColumnRenamed("place", "i").repartition(5)
    expected = []
    for g in ("a", None, "b"):
        mine = sorted(((k is not None, k, i) for x, k, i in data if x == g), key=lambda r: (r[0], r[1] or 0, r[2]))[:4]
        expected += [(g, k, i, n + 1) for n, (_, k, i) in enumerate(mine)]
    for room in (1, 100_000):
        got = [tuple(r) for r in top.first_of_each(df, "g", ["k", "i"], 4, room).collect()]
        assert sorted(got, key=str) == sorted(expected, key=str)
    assert top.first_of_each(df.limit(0), "g", ["k"], 4).count() == 0
    assert [(r["g"], r["n"], r["place"]) for r in top.most_frequent(df.filter("g is not null"), "g", 1).collect()] == [("a", 200, 1)]
