from pyspark.sql import functions as F

from tidemark.operators import verdicts
from tidemark.sources import detail


def test_listing_rules(spark):
    pages = [
        ("ok", '<table><tr id="product-7"><td class="title"><a href="/game/a"> A &amp; <b>B</b> </a></td></tr></table><form class="js-next-page"><input type="hidden" name="cursor" value="9"><input name="x" value="1"></form>'),
        ("far", '<tr id="product-7"><td class="title"><a href="https://x/game/a">A</a></td></tr>'),
        ("up", '<tr id="product-7"><td class="title"><a href="/game/../a">A</a></td></tr>'),
        ("bare", '<tr id="product-7"><td><a href="/game/a">A</a></td></tr>'),
        ("word", '<tr id="product-x"><td class="title"><a href="/game/a">A</a></td></tr>'),
        ("tier", '<div class="tier-odd"><tr data-sale="1" data-cents="5"></tr></div>'),
        ("near", '<div class="tier-nine"><div class="tier-ten"><tr data-sale="1" data-cents="5"></tr></div><tr data-sale="2"></tr></div><tr data-sale="3" data-cents="x"></tr>'),
        ("none", None),
    ]
    r = spark.createDataFrame(pages, "id string, html string").select("id", detail.listing(F.col("html"), tiers=("nine", "ten", "raw"), default_tier="raw").alias("r")).collect()
    got = {x["id"]: x["r"] for x in r}
    assert [tuple(p) for p in got["ok"]["products"]] == [(7, "/game/a", "A & B")] and got["ok"]["next"] == {"cursor": "9"} and got["ok"]["reason"] is None
    assert all(got[k]["reason"] and got[k]["products"] is None for k in ("far", "up", "bare", "word", "tier"))
    assert "invalid literal" in got["near"]["reason"] and got["none"]["products"] == [] and got["none"]["next"] is None


def test_first_links_and_samples(spark):
    links = spark.createDataFrame([(1, "a", "second", 2), (1, "a", "first", 1), (1, "b", "x", 3)], "page int, slug string, name string, pos int")
    assert sorted((r["slug"], r["name"]) for r in detail.first_links(links, "page", "slug", "name", "pos").collect()) == [("a", "first"), ("b", "x")]
    rows = spark.range(500)
    one, again = ([r["id"] for r in verdicts.sample_rows(rows.repartition(n), 100, 7).collect()] for n in (3, 5))
    assert one == again and len(set(one)) == 100 and one != [r["id"] for r in verdicts.sample_rows(rows, 100, 8).collect()]


def test_measures_are_read_after_the_write(spark):
    rows, seen = verdicts.observed(spark.range(10), "m", n=F.count(F.lit(1)), most=F.max("id"))
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"n": 10, "most": 9}


def test_a_calm_visit_clears_the_flags(spark):
    cols = "id int, last_visited_at timestamp, last_seen_at timestamp, rate double, any_at_cap boolean, near_miss_at timestamp, image_hash string, failure_streak int, quarantined_until timestamp, gone_at timestamp, refresh_requested_at timestamp, delisted_at timestamp"
    then = F.lit("2024-01-01").cast("timestamp")
    states = spark.createDataFrame([(i, None, None, 1.0, i == 2, None, None, 3, None, None, None, None) for i in (1, 2, 3)], cols)
    for c in ("near_miss_at", "quarantined_until", "gone_at", "refresh_requested_at", "delisted_at"):
        states = states.withColumn(c, then)
    visits = spark.createDataFrame([(1, 0.5, True, 0, "h"), (2, 0.5, True, 8, None)], "id int, rate double, at_cap boolean, margin int, image_hash string")
    now = F.lit("2024-02-01").cast("timestamp")
    got = {r["id"]: r for r in verdicts.apply_visits(states, visits, now).collect()}
    assert got[1]["newly_at_cap"] and not got[2]["newly_at_cap"] and not got[3]["newly_at_cap"]
    assert got[1]["near_miss_at"] is None and got[2]["near_miss_at"].month == 2 and got[3]["near_miss_at"].month == 1
    assert all(got[i][c] is None for i in (1, 2) for c in ("gone_at", "quarantined_until", "refresh_requested_at")) and got[1]["delisted_at"] and got[3]["gone_at"] and got[3]["failure_streak"] == 3
