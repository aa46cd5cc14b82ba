"""Boundary values of the scalar rules and state machines."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text, timing
from tidemark.operators import folds, integrity


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "out"), [("053", "53"), ("000", "0"), ("0", "0"), ("TG04", "TG4"), ("swsh062", "SWSH62"), ("100", "100"), ("a0b00c", "A0B0C")])
def test_canonical_number(spark, raw, out):
    assert one(spark, text.canonical_number(F.lit(raw))) == out


@pytest.mark.parametrize(
    ("raw", "cents", "drift"),
    [("$1,234.56", 123456, False), ("", None, False), (" ", None, False), (" $5 ", 500, False), ("$1.2.3", None, True), ("99999999.99", None, True), ("21474836.47", 2147483647, False), ("0.005", 0, False), ("0.015", 2, False), ("-1", None, True), (None, None, False)],
)
def test_money(spark, raw, cents, drift):
    got = one(spark, text.money_to_cents(F.lit(raw).cast("string")))
    assert (got["cents"], got["drift"]) == (cents, drift)


@pytest.mark.parametrize(
    ("raw", "base", "tags", "number"),
    [("Pika [Holo] #025/165", "Pika", ["Holo"], "025/165"), ("Pika [open #4", "Pika [open", [], "4"), ("A # B #", "A # B #", [], None), ("A #x y", "A #x y", [], None), ("  two   words # 7 ", "two words", [], "7"), ("#-1", "#-1", [], None)],
)
def test_name_parts(spark, raw, base, tags, number):
    got = one(spark, text.name_parts(F.lit(raw)))
    assert (got["base"], got["tags"], got["number"]) == (base, tags, number)


def test_titles_and_names(spark):
    assert one(spark, text.title_normalize(F.lit("Flabébé [x] – ‘Q’ ♀  #12"))) == "flabebe - 'q' ♀"
    assert one(spark, text.name_fold(F.lit("  Éa–b ポケ "))) == "EA B"
    assert one(spark, text.group_name(F.lit("Maker X & Y"), "maker")) == "X AND Y"
    assert one(spark, text.strip_count(F.lit("PSA 10 (30)"))) == "PSA 10"
    assert one(spark, text.strip_count(F.lit(" (30)"))) == " (30)"
    assert one(spark, text.capitalise_segments(F.lit("rough-TERRAIN"))) == "Rough-Terrain"
    assert one(spark, text.trailing_id(F.lit("https://x/y/67/"))) == 67
    assert one(spark, text.roman_suffix(F.lit("generation-iv"))) == 4
    with pytest.raises(Exception, match="no numeral"):
        one(spark, text.roman_suffix(F.lit("generation-abc")))
    got = one(spark, text.split_id(F.lit("ebay-1-2")))
    assert (got["source"], got["id"]) == ("ebay", "1-2")
    assert one(spark, text.stream_position(F.lit("77-12")))["position"] == 12
    assert one(spark, text.stream_position(F.lit("x12")))["position"] is None
    assert one(spark, text.strict_date(F.lit("2024-02-30"))) is None


@pytest.mark.parametrize(
    ("rate", "near", "days"),
    [(0.99, False, 30 / 0.99 * 0.5), (1.0, False, 3.0), (1.99, False, 3.0), (2.0, False, 1.5), (2.0, True, 0.75), (20.0, False, 0.45), (0.0, False, None), (None, True, None)],
)
def test_due_bands(spark, rate, near, days):
    got = one(spark, timing.due_after_days(F.lit(rate).cast("double"), F.lit(near)))
    assert got == (None if days is None else pytest.approx(days))


@pytest.mark.parametrize(("streak", "days"), [(2, None), (3, 1), (4, 2), (7, 16), (8, 30), (50, 30)])
def test_sentence(spark, streak, days):
    assert one(spark, timing.sentence_days(F.lit(streak))) == days


@pytest.mark.parametrize(("status", "key", "image", "limited"), [(299, False, False, False), (300, True, False, False), (404, True, True, False), (429, False, False, True), (499, True, True, False), (500, False, False, False), (503, False, False, True)])
def test_status_classes(spark, status, key, image, limited):
    c = F.lit(status)
    assert (one(spark, timing.key_attributable(c)), one(spark, timing.give_up(c)), one(spark, timing.rate_limited(c))) == (key, image, limited)


@pytest.mark.parametrize(
    ("staleness", "rate", "cap", "asked", "score"),
    [(None, None, False, False, 2_500_000), (None, None, True, True, 2_750_000), (4.0, 2.0, False, True, 3_000_008), (1.0, 0.5, True, True, 2_750_001), (1.0, 0.5, True, False, 2_000_001), (30.0, None, False, False, 1_000_030), (2.0, 0.5, False, False, 3.0)],
)
def test_score(spark, staleness, rate, cap, asked, score):
    d = lambda v: F.lit(v).cast("double")
    assert one(spark, timing.priority_score(d(staleness), d(rate), F.lit(cap), F.lit(asked), F.lit(False))) == score


@pytest.mark.parametrize(("before", "now", "out"), [(250, 249, None), (32, 30, None), (6, 5, None), (10, 7, "decrease"), (100, 80, "decrease"), (397, 99246, "spike"), (3, 40, None), (None, 5, None)])
def test_restatement(spark, before, now, out):
    assert one(spark, integrity.restatement(F.lit(before).cast("int"), F.lit(now))) == out


def test_backoff_machine():
    m = folds.Backoff()
    s = m.initial()
    assert [m.step(s, "ok")[0] for _ in range(5)] == [150, 75, 37.5, 18.75, 10]
    assert m.step(s, "slow") == (20, 0, False)
    assert m.step(s, "fail")[:2] == (40, 1)
    assert m.step(s, "ok")[:2] == (35, 0)  # no slow start after trouble
    assert m.step(s, "limited", 400)[0] == 400
    m.step(s, "fail")
    assert m.step(s, "fail")[2] is True


def test_suppressed_alerts_do_not_move_the_clock():
    m = folds.Cooldown(10)
    s = m.initial()
    assert [m.step(s, "fail", t)[0] for t in (0, 6, 9.9, 10, 19, 20)] == [True, False, False, True, False, True]


def test_bench_slot_doubles():
    m = folds.BenchSlot(10)
    s = m.initial()
    assert [m.step(s, "fail", t)[0] for t in (0, 9, 10, 29, 30)] == [True, False, True, False, True]


def test_cap_classes(spark):
    def classify(rows):
        df = spark.createDataFrame(rows, "key int, stream string, position bigint, cents int, day int, row_id string")
        return integrity.cap_classification(df, ["key"], "stream", "position", "cents", "day", ["row_id"]).first()["cap_class"]

    run = [(1, "", 1000 * i, i, i, f"a{i}") for i in range(30)]
    assert classify(run[:29]) == "recomposed"
    assert classify(run) == "bulk"
    assert classify([(1, "", 1001 * i, i, i, f"a{i}") for i in range(30)]) == "organic"
    assert classify([(1, None, None, 5, 7, f"a{i}") for i in range(30)]) == "bulk"
    assert classify(run * 2) == "bulk"
