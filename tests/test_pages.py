import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.oracle import compare
from tidemark.plans import catalogue
from tidemark.sources import detail, markup, pages, visit_page
from tidemark.streaming import visits

LAYOUT = visit_page.Layout(
    series={"used": "Raw", "cib": "Seven", "graded": "Nine"}, graders=("psa", "cgc"), sources=("bay", "house"), known_labels=("Raw", "Nine", "Grade 9.5"), image=r"images\.example\.com/([a-z0-9]+)/"
)
MONTH = 1_704_067_200_000  # 2024-01-01T00:00Z


def row(key="bay-1", date="2024-01-05", price="$1,234.50", listed="", title="A title", more=""):
    cell = f'<td class="numeric listed-price"><span class="js-price">{listed}</span></td>' if listed else ""
    return f'<tr id="{key}"><td class="date">{date}<td class="title"><a href="/x">{title}</a>{cell}<td class="numeric"><span class="js-price">{price}</span>{more}'


def page(chart=f'{{"used": [[{MONTH}, 120]]}}', census='{"psa": [1, 2]}', currency="USD", options=("used:Raw (3)", "grade-nine:Nine (1)"), genre="Trading Card", rows="", wrapped="", tail=""):
    select = "".join(f'<option value="{o.split(":")[0] and LAYOUT.tier_prefix + o.split(":")[0]}">{o.split(":")[1]}' for o in options)
    return (
        "<!DOCTYPE html><html><head><title> T </title>"
        + (f"<script>page.chart_data = {chart};</script>" if chart is not None else "")
        + (f"<script>page.pop_data = {census};</script>" if census is not None else "")
        + f'</head><body><a id="dropdown_selected_currency"> {currency} </a><img src="https://images.example.com/ab12/60.jpg">'
        + (f'<select id="completed-auctions-condition"><option value="">all{select}</select>' if options else "")
        + (f'<table><tr><td itemprop="genre"> {genre} </td></table>' if genre is not None else "")
        + (f'<table class="hoverable-rows sortable">{rows}</table>' if rows else "")
        + wrapped
        + tail
        + "</body></html>"
    )


def judge(spark, pages):
    df = spark.createDataFrame(list(pages.items()), "id string, html string")
    return {r["id"]: r for r in visit_page.judged_pages(df, LAYOUT).collect()}


def test_a_sound_page_gives_all_its_facts(spark):
    inner = f'<div class="completed-auctions-grade-nine extra"><div><table class="sortable hoverable-rows">{row("house-a-b", listed="$9", price="5.005", title="x" * 600)}</table></div></div>'
    html = page(rows=row() + row("bay-2", price=" 7. ", title=" &amp; <b>B</b> "), wrapped=inner)
    df = spark.createDataFrame([(1, html)], "id int, html string")
    judged = visit_page.judged_pages(df, LAYOUT)
    got = judged.first()
    assert (got["verdict"], got["reason"], got["page"]["image"], got["page"]["title"]) == ("ok", None, "ab12", "T")
    assert [tuple(r) for r in visit_page.price_facts(judged, "id").collect()] == [(1, "Raw", datetime.date(2024, 1, 1), 120)]
    assert [tuple(r) for r in visit_page.census_facts(judged, "id").collect()] == [(1, "psa", 1, 1), (1, "psa", 2, 2)]
    sales = [tuple(r) for r in visit_page.sale_facts(judged, "id").collect()]
    day = datetime.date(2024, 1, 5)
    assert sales == [(1, "bay", "1", day, "Raw", 123450, None, "A title"), (1, "bay", "2", day, "Raw", 700, None, "& B"), (1, "house", "a-b", day, "Nine", 500, 900, "x" * 500)]


def test_each_trouble_is_drift_with_its_reason(spark):
    bad = {
        "no chart": page(chart=None), "unknown series: odd": page(chart='{"odd": []}'), "page.chart_data: no object follows": page(chart="1", census=None, options=(), genre=None).replace("{", ""),
        "page.chart_data: the object never closes": "<script>page.chart_data = {", "page.chart_data: not valid JSON": page(chart="{used: 1}"),
        "series used: not a list": page(chart='{"used": 3}'), "series used: a point is not two whole numbers": page(chart='{"used": [[1]]}'), "page.pop_data: not valid JSON": page(census="{broken}"),
        "unknown graders: abc,bgs": page(census='{"bgs": [1], "psa": [1], "abc": []}'), "grader psa: not a list of whole numbers": page(census='{"psa": [1.5]}'),
        "no currency": page().replace("dropdown_selected_currency", "x"), "currency EUR": page(currency="EUR"), "unknown conditions": page(options=("used:Loose", "cib:Complete")),
        "sales without a condition selector": page(options=(), rows=row()), "condition completed-auctions-used twice": page(options=("used:Raw", "used:Nine"), rows=row()),
        "no condition for tier completed-auctions-odd": page(wrapped=f'<p class="completed-auctions-odd"><span><table class="hoverable-rows sortable">{row()}</table></span>'.replace("<p", "<div")),
        "unknown marketplace shop": page(rows=row("shop-1")), "sale of bay: id too long": page(rows=row("bay-" + "1" * 65)), "tier label too long": page(options=("used:" + "x" * 33, "grade-nine:Nine"), rows=row()),
        "sale bay-1: no date": page(rows=row().replace('"date"', '"day"')), "sale bay-1: not a date": page(rows=row(date="2024-02-30")), "sale bay-1: no price": page(rows=row(price=" \xa0 ")),
        "sale bay-1: not an amount": page(rows=row(price="-5")), "sale bay-1: an amount too large": page(rows=row(price="99999999999")),
    }
    got = judge(spark, bad)
    assert {k: r["reason"] for k, r in got.items()} == {k: k for k in bad} and {r["verdict"] for r in got.values()} == {"drift"}
    more = judge(spark, {
        "game": page(options=("used:Loose", "cib:Complete"), genre="Arcade"), "quiet": page(options=(), genre="Arcade"), "unsold": page(options=(), genre=None),
        "first": page(chart=None, currency="EUR", census="{"), "null": None, "empty": "", "nan": page(chart='{"used": [[NaN, 1]]}'), "bool": page(chart='{"used": [[1, true]]}'), "far": page(chart='{"used": [[9999999999999999, 1]]}'),
    })
    assert {k: (r["verdict"], r["reason"]) for k, r in more.items()} == {
        "game": ("rejected", "not of the kind"), "quiet": ("rejected", "not of the kind"), "unsold": ("ok", None), "first": ("drift", "no chart"), "null": ("drift", "no chart"), "empty": ("drift", "no chart"),
        "nan": ("drift", "page.chart_data: not valid JSON"), "bool": ("drift", "series used: a point is not two whole numbers"), "far": ("drift", "series used: a point has no day"),
    }


def test_rows_without_end_tags_and_nested_tables():
    tree = markup.parse('<table class="t"><tr id=1><td class=a>one<td>two<tr id=2><td><table><tr id=3><td>in</table>after<tr id=4></table><p>x<div>y</b></div>')
    table = tree.find("table", "t")
    rows = {e.attrs["id"]: e for e in table.find_all("tr")}
    assert list(rows) == ["1", "2", "3", "4"] and rows["1"].text == "onetwo" and rows["2"].text == "inafter"
    assert [a.tag for a in rows["3"].ancestors()][:4] == ["table", "td", "tr", "table"] and rows["4"].parent is table
    assert tree.find("div").parent is tree and markup.parse("").text == "" and markup.parse("</td>a<br/>b").text == "ab"


def test_charts_and_censuses_of_any_shape(spark):
    texts = ["{broken", '{"psa":"x"}', '{"psa":[1.5]}', "[]", '{"psa":[1,null]}', '{"cgc":[]}', "{}", None, '{"psa":[2147483648]}']
    got = [r["p"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(detail.population(F.col("t"), ["psa", "cgc"]).alias("p")).collect()]
    assert [x["reason"] is not None for x in got] == [True, True, True, True, True, False, False, False, True]
    assert [None if x["counts"] is None else (list(x["counts"]["psa"]), list(x["counts"]["cgc"])) for x in got][5:8] == [([], []), ([], []), None]
    charts = [(1, f'{{"a":[[{MONTH},5]]}}'), (2, f'{{"a":[[{MONTH}]]}}'), (3, f'{{"a":[[{MONTH},null]]}}'), (4, "{x"), (5, None), (6, '{"a":[]}'), (7, '{"b":[],"c":[]}')]
    df = spark.createDataFrame(charts, "id int, chart string")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        rows = sorted((r["id"], r["tier"], r["day"], r["cents"], r["reason"]) for r in detail.chart_rows(df, "id", "chart", {"a": "A"}).collect())
        assert rows[0] == (1, "A", datetime.date(2024, 1, 1), 5, None)
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5, 7] and [r[4] for r in rows[3:]] == ["chart: not valid JSON", "no chart", "unknown series: b,c"]
    spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("text, expected", [("$1,234.56", 123456), (" 5 ", 500), (".5", 50), ("0.125", 12), ("0.135", 14), ("", None), ("\xa0", None), ("$", None), ("1" * 60, "drift"), ("1e3", "drift"), ("+1", "drift"), (".", "drift")])
def test_cents(text, expected):
    try:
        assert visit_page.cents(text, "x") == expected
    except visit_page.Drift:
        assert expected == "drift"


def test_a_failed_visit_leaves_nothing_and_its_replay_all(spark, tmp_path):
    html = page(rows=row() + row("bay-2", price="7"))
    captures = spark.createDataFrame([(1, "2024-01-01", html), (2, "2024-01-01", page(chart=None)), (1, "2024-01-02", html.replace(", 120]", ", 130]"))], "id bigint, at string, html string").withColumn("at", F.col("at").cast("timestamp"))
    store = visits.VisitStore(spark, str(tmp_path / "s"), "id", "at")
    sink, whole = visits.visit_sink(store, LAYOUT), store["visits"].write

    def breaks(rows, batch):
        whole(rows, batch)
        raise OSError("disk full")

    store["visits"].write = breaks
    with pytest.raises(OSError, match="disk full"):
        sink(captures, 0)
    assert all(t.read().count() == 0 for t in store.tables.values()) and store["sales"].written(0).count() == 2
    store["visits"].write = whole
    sink(captures, 0)
    sink(captures, 0)  # a batch may come again after its marker, too
    counts = {name: t.read().count() for name, t in store.tables.items()}
    assert counts == {"prices": 2, "census": 2, "sales": 2, "visits": 3}
    got = {(r["id"], r["at"].day): (r["verdict"], r["reason"], r["new_prices"], r["new_cells"], r["new_sales"]) for r in store["visits"].read().collect()}
    assert got == {(1, 1): ("ok", None, 1, 2, 2), (1, 2): ("ok", None, 1, 0, 0), (2, 1): ("drift", "no chart", 0, 0, 0)}
    rolled = page(rows=row("bay-3") + row("bay-4"))
    sink(spark.createDataFrame([(1, "2024-01-03", rolled)], "id bigint, at string, html string").withColumn("at", F.col("at").cast("timestamp")), 1)
    last = store["visits"].read().filter("at = timestamp'2024-01-03'").first()
    assert last["at_cap"] and last["new_sales"] == 2 and last["new_prices"] == 1  # back to 120


def test_only_the_references_that_pages_write(spark):
    html = "<title>a &amp; b &quot;&#39; &lt &amp</title><article><a href='/x?a=1&amp;b&copy'>&eacute; &notit;</a><script>page = {\"k\": \"1 && 2 &amp;\"}</script></article>&am"
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    script = 'page = {"k": "1 && 2 &amp;"}'
    for names, title, link, text in ((None, "a & b \"' < &", "/x?a=1&b\u00a9", "\u00e9 \u00acit;"), (("amp",), "a & b &quot;&#39; &lt &amp", "/x?a=1&b&copy", "&eacute; &notit;")):
        got, tree = pages.page_facts(df, references=names).first(), markup.parse(html, names)
        assert (got["title"], list(got["links"]), got["script"]) == (title, [link], script)
        assert (tree.find("title").text, tree.find("a").text, tree.find("a").attrs["href"], tree.find("script").text) == (title, text, link, script)


@pytest.mark.parametrize("name", ["page_facts", "page_visits"])
def test_titles_with_other_and_with_cut_references_equal_the_sql(spark, tmp_path, name):
    """Titles cut to a length end in pieces of references; the SQL reads ``&amp;`` alone."""
    titles = ["a &amp; b", "cut &amp", "cut &am", "token = &quot;77", "&#x27;q&#x27; &lt;b&gt; &amp;lt;", "&amp;amp;", "A &copy"]
    rows = [(i, f"https://h/{i}", f'<!DOCTYPE html><html><head><title>{t}</title></head><body><article><a href="/a">x</a></article></body></html>') for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    compare(catalogue.queries()[name](spark, str(tmp_path)), con, catalogue.oracle_sql()[name])
