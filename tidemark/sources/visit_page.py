"""A whole detail page in one parse: chart, census, currency, kind, sales and image, with the verdict first.

One Arrow-batched function reads a page into a struct of raw parts, each with its own trouble; the verdict is Column
code over them, in the order in which a page is judged: chart, census, currency, kind, sales. A page with trouble has a
reason and no facts at all. What isn't known is drift, never a guess: so is any error nobody foresaw. ``rejected`` is a
page that is sound but not of the kind.
"""

from __future__ import annotations

import datetime
import decimal
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.sources import markup
from tidemark.sources.detail import kind_verdict, utc_day
from tidemark.sources.slices import each_slice
from tidemark.sources.strict_json import INT_MAX, Drift, inline_object, read_census, read_chart

@dataclass(frozen=True)
class Layout:
    """Where a page keeps its parts, and the words it may use."""

    series: dict[str, str]
    graders: tuple[str, ...]
    sources: tuple[str, ...]
    known_labels: tuple[str, ...]
    image: str
    kind_word: str = "card"
    currency: str = "USD"
    chart_marker: str = "page.chart_data"
    census_marker: str = "page.pop_data"
    currency_id: str = "dropdown_selected_currency"
    condition_id: str = "completed-auctions-condition"
    tier_prefix: str = "completed-auctions-"
    default_tier: str = "completed-auctions-used"
    sales_classes: tuple[str, ...] = ("hoverable-rows", "sortable")
    longest_source_id: int = 64
    longest_tier: int = 32
    longest_title: int = 500
    #: Character references that pages write; all of the standard's where none are named.
    references: tuple[str, ...] | None = None


def cents(text: str | None, what: str) -> int | None:
    """Cents of ``$1,234.56``; null where the text is blank."""
    bare = (text or "").strip().strip("\xa0").lstrip("$").replace(",", "")
    if not bare.strip():
        return None
    if not re.fullmatch(r"[0-9]+\.?[0-9]*|\.[0-9]+", bare):
        raise Drift(f"{what}: not an amount")
    got = int((decimal.Decimal(bare) * 100).quantize(decimal.Decimal(1), decimal.ROUND_HALF_EVEN)) if len(bare) < 40 else INT_MAX + 1
    if got > INT_MAX:
        raise Drift(f"{what}: an amount too large")
    return got


def _without_count(label: str) -> str:
    label = label.strip()
    at = label.rfind(" (")
    return label[:at] if at > 0 else label


def read_labels(page: markup.Element, layout: Layout) -> list[tuple[str, str]]:
    select = page.find("select", id=layout.condition_id)
    return [(o.attrs["value"], _without_count(o.text)) for o in (select.find_all("option") if select else ()) if o.attrs.get("value", "").strip()]


def read_sales(page: markup.Element, layout: Layout) -> list[dict]:
    """Sales of all tables, in document order, each with the label of the nearest ancestor that names a tier."""
    tables = list(page.find_all("table", *layout.sales_classes))
    if not tables:
        return []
    if page.find("select", id=layout.condition_id) is None or page.find("select", id=layout.condition_id).find("option") is None:
        raise Drift("sales without a condition selector")
    labels: dict[str, str] = {}
    for value, label in read_labels(page, layout):
        if value in labels:
            raise Drift(f"condition {value} twice")
        labels[value] = label
    out = []
    for table in tables:
        token = next((c for a in table.ancestors() for c in a.classes if c.startswith(layout.tier_prefix)), layout.default_tier)
        if token not in labels:
            raise Drift(f"no condition for tier {token}")
        out += [_sale(row, labels[token], layout) for row in table.find_all("tr") if "id" in row.attrs]
    return out


def _sale(row: markup.Element, tier: str, layout: Layout) -> dict:
    key = row.attrs["id"]
    at = key.find("-")
    source = key[:at] if at > 0 else key
    if source not in layout.sources:
        raise Drift(f"unknown marketplace {source}")
    if len(key) - at - 1 > layout.longest_source_id:
        raise Drift(f"sale of {source}: id too long")
    if len(tier) > layout.longest_tier:
        raise Drift("tier label too long")
    day = row.find("td", "date")
    if day is None:
        raise Drift(f"sale {key}: no date")
    day = day.text.strip()
    try:
        sold = datetime.datetime.strptime(day, "%Y-%m-%d").date() if re.fullmatch("[0-9]{4}-[0-9]{2}-[0-9]{2}", day) else None
    except ValueError:
        sold = None
    if sold is None:
        raise Drift(f"sale {key}: not a date")
    price = next((s for cell in row.find_all("td", "numeric", without="listed-price") for s in cell.find_all("span", "js-price")), None)
    if price is None or (got := cents(price.text, f"sale {key}")) is None:
        raise Drift(f"sale {key}: no price")
    listed, title = row.find("td", "listed-price"), next((a for cell in row.find_all("td", "title") for a in cell.find_all("a")), None)
    return {
        "source": source, "source_id": key[at + 1 :], "sold_on": sold, "tier": tier, "cents": got,
        "listed_cents": cents(listed.text if listed else None, f"sale {key}"), "title": (title.text if title else "").strip()[: layout.longest_title],
    }


SALE = "source string, source_id string, sold_on date, tier string, cents int, listed_cents int, title string"
_STRINGS = T.ArrayType(T.StringType())
PARTS = T.StructType([
    T.StructField("chart", T.ArrayType(T.StructType([T.StructField("tier", T.StringType()), T.StructField("ms", T.LongType()), T.StructField("cents", T.IntegerType())]))),
    T.StructField("chart_drift", T.StringType()),
    T.StructField("census", T.ArrayType(T.StructType([T.StructField("grader", T.StringType()), T.StructField("grade", T.IntegerType()), T.StructField("population", T.IntegerType())]))),
    T.StructField("census_drift", T.StringType()),
    T.StructField("currency", T.StringType()), T.StructField("labels", _STRINGS), T.StructField("genre", T.StringType()),
    T.StructField("sales", T.ArrayType(T.StructType([
        T.StructField("source", T.StringType()), T.StructField("source_id", T.StringType()), T.StructField("sold_on", T.DateType()), T.StructField("tier", T.StringType()),
        T.StructField("cents", T.IntegerType()), T.StructField("listed_cents", T.IntegerType()), T.StructField("title", T.StringType()),
    ]))),
    T.StructField("sales_drift", T.StringType()), T.StructField("image", T.StringType()), T.StructField("title", T.StringType()), T.StructField("links", T.IntegerType()),
    T.StructField("tags", _STRINGS), T.StructField("drift", T.StringType()),
])


def _tried(read):
    """A part and the trouble with it."""
    try:
        return read(), None
    except Drift as e:
        return None, str(e)


def read_parts(html: str, layout: Layout) -> dict:
    chart, chart_drift = _tried(lambda: read_chart(inline_object(html, layout.chart_marker), layout.series))
    census, census_drift = _tried(lambda: read_census(inline_object(html, layout.census_marker), layout.graders))
    page = markup.parse(html, layout.references)
    currency, genre, title = page.find("", id=layout.currency_id), page.find("td", itemprop="genre"), page.find("title")
    sales, sales_drift = _tried(lambda: read_sales(page, layout))
    image = re.search(layout.image, html)
    return {
        "chart": None if chart is None else [dict(zip(("tier", "ms", "cents"), p)) for p in chart], "chart_drift": chart_drift,
        "census": None if census is None else [{"grader": g, "grade": i + 1, "population": n} for g, ns in census.items() for i, n in enumerate(ns)], "census_drift": census_drift,
        "currency": currency.text.strip() if currency else None, "labels": [" ".join(label.split()) for _, label in read_labels(page, layout)], "genre": genre.text.strip() if genre else None,
        "sales": sales, "sales_drift": sales_drift, "image": image[1] if image else None, "title": title.text.strip() if title else None,
        "links": sum(1 for e in page.find_all("a") if "href" in e.attrs), "tags": sorted({e.tag for e in page.walk()}), "drift": None,
    }


def page_parts(html: Column, layout: Layout) -> Column:
    """The raw parts of each page; an error nobody foresaw is drift and leaves all other fields null."""

    kind = to_arrow_type(PARTS)

    def one(text: str | None) -> dict:
        try:
            return read_parts(text or "", layout)
        except Exception as e:  # any parser error is drift, not a failed job
            return dict.fromkeys(PARTS.names) | {"drift": f"{type(e).__name__}: {e}"}

    @F.arrow_udf(PARTS)
    def read(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return each_slice(pages, one, kind)

    return read(html)


def judged_pages(pages: DataFrame, layout: Layout, html: str = "html") -> DataFrame:
    """``pages`` without their HTML, with ``verdict`` (ok, drift or rejected), ``reason`` and ``page``, the parts."""
    p = pages.withColumn("page", page_parts(F.col(html), layout))
    kind = kind_verdict(F.col("page.labels"), F.col("page.genre"), list(layout.known_labels), layout.kind_word)
    reason = F.coalesce(
        "page.drift", "page.chart_drift", "page.census_drift",
        F.when(F.col("page.currency").isNull(), "no currency").when(F.col("page.currency") != layout.currency, F.concat(F.lit("currency "), F.col("page.currency"))),
        F.when(kind == "drift", "unknown conditions").when(kind == "rejected", "not of the kind"), "page.sales_drift",
    )
    verdict = F.when(reason.isNull(), "ok").when(reason == "not of the kind", "rejected").otherwise("drift")
    return p.select(*[c for c in pages.columns if c != html], verdict.alias("verdict"), reason.alias("reason"), "page")


def price_facts(judged: DataFrame, *carried: str) -> DataFrame:
    """``carried, tier, month, cents``: points of sound pages by UTC day, whatever the session's time zone."""
    p = judged.filter("verdict = 'ok'").select(*carried, F.explode("page.chart").alias("p"))
    return p.select(*carried, F.col("p.tier").alias("tier"), utc_day(F.col("p.ms")).alias("month"), F.col("p.cents").alias("cents"))


def census_facts(judged: DataFrame, *carried: str) -> DataFrame:
    return judged.filter("verdict = 'ok'").select(*carried, F.inline("page.census"))


def sale_facts(judged: DataFrame, *carried: str) -> DataFrame:
    return judged.filter("verdict = 'ok'").select(*carried, F.inline("page.sales"))
