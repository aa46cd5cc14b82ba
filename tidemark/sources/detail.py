"""Typed facts out of detail and listing pages: charts, populations, kinds, sales and product rows.

Series, graders, labels and selectors are parameters. What isn't known is drift and gives a reason, never a guess.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.sources import markup
from tidemark.sources.slices import each_slice
from tidemark.sources.strict_json import Drift, read_census, read_chart, strict_object

_POINTS = T.ArrayType(T.StructType([T.StructField("tier", T.StringType()), T.StructField("ms", T.LongType()), T.StructField("cents", T.IntegerType())]))
_LISTS = T.MapType(T.StringType(), T.ArrayType(T.IntegerType()))


def _read(function, out: T.DataType):
    """A UDF of JSON text that gives what ``function`` reads, and the reason where it is drift."""

    @F.pandas_udf(T.StructType([T.StructField("got", out), T.StructField("reason", T.StringType())]))
    def read(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            try:
                rows.append((function(text), None))
            except Drift as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["got", "reason"])

    return read


def utc_day(ms: Column) -> Column:
    """The UTC day of epoch milliseconds, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(ms / F.lit(86_400_000)).cast("int"))


def chart_rows(pages: DataFrame, key: str, chart_json: str, series: dict[str, str]) -> DataFrame:
    """``key, tier, day, cents, reason``: a JSON object of series of ``[epoch milliseconds, cents]`` as rows.

    A page whose chart isn't there, isn't JSON, has an unknown series or a point that isn't two whole numbers is drift:
    one row with the reason and no facts. Days are UTC days."""
    names = [f.name for f in _POINTS.elementType.fields]
    read = _read(lambda t: [dict(zip(names, p)) for p in read_chart(None if t is None else strict_object(t, "chart"), series)], _POINTS)
    p = pages.select(F.col(key), read(F.col(chart_json)).alias("c"))
    good = p.select(key, F.explode("c.got").alias("p")).select(key, "p.tier", utc_day(F.col("p.ms")).alias("day"), F.col("p.cents").cast("bigint").alias("cents"), F.lit(None).cast("string").alias("reason"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("tier", "string"), ("day", "date"), ("cents", "bigint"))]
    return good.unionByName(p.filter("c.reason is not null").select(key, *none, "c.reason"))


def population(json: Column, graders: list[str]) -> Column:
    """``struct(counts, reason)`` of a census object: null counts where there is none, an empty array for a grader that
    is missing, a reason for one that is unknown and for what isn't an object of lists of whole numbers."""
    p = _read(lambda t: read_census(None if t is None else strict_object(t, "census"), graders), _LISTS)(json)
    counts = F.struct(*[p["got"][g].alias(g) for g in graders])
    return F.struct(F.when(p["got"].isNotNull(), counts).alias("counts"), p["reason"].alias("reason"))


def kind_verdict(labels: Column, genre: Column, known: list[str], word: str) -> Column:
    """``ok``, ``drift`` or ``rejected``. Labels are the first witness: a known one acquits; unknown ones are drift where the
    genre says ``word`` and a conviction where it doesn't. Without labels only a genre that says something else convicts."""
    says = F.coalesce(F.contains(F.lower(genre), F.lit(word)), F.lit(False))
    silent = F.coalesce(genre, F.lit("")) == ""
    some = F.size(F.coalesce(labels, F.array().cast("array<string>"))) > 0
    return F.when(some & F.arrays_overlap(labels, F.lit(known)), "ok").when(some & says, "drift").when(some, "rejected").when(silent | says, "ok").otherwise("rejected")


def zipped_rows(rows: DataFrame, key: str, *arrays: str) -> DataFrame:
    """Parallel arrays as rows, one for each position; shorter arrays are filled with nulls."""
    return rows.select(key, F.inline(F.arrays_zip(*arrays)))


class _Rows(HTMLParser):
    """Product rows, the hidden fields of the form for more, and sales below the nearest element that names a tier."""

    def __init__(self, row_prefix: str, tier_prefix: str):
        super().__init__()
        self.row_prefix, self.tier_prefix = row_prefix, tier_prefix
        self.products: list[dict] = []
        self.sales: list[dict] = []
        self.next: dict[str, str] | None = None
        self.open: list[tuple[str, dict[str, str], list[str]]] = []
        self.text: dict | None = None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        classes = a.get("class", "").split()
        if tag in ("input", "br", "img", "meta", "link", "hr"):
            if tag == "input" and a.get("type") == "hidden" and "name" in a and any(t == "form" and "js-next-page" in c for t, _, c in self.open):
                self.next[a["name"]] = a.get("value", "")
            return
        if tag == "form" and "js-next-page" in classes and self.next is None:
            self.next = {}
        if tag == "tr" and a.get("id", "").startswith(self.row_prefix):
            self.products.append({"id": a["id"][len(self.row_prefix) :], "href": None, "name": ""})
        elif tag == "tr" and "data-sale" in a:
            tiers = [c[len(self.tier_prefix) :] for _, _, cs in reversed(self.open) for c in cs if c.startswith(self.tier_prefix)]
            self.sales.append({"sale": a["data-sale"], "tier": tiers[0] if tiers else None, "cents": a.get("data-cents")})
        elif tag == "a" and self.products and self.products[-1]["href"] is None and any(t == "td" and "title" in c for t, _, c in self.open):
            self.products[-1]["href"], self.text = a.get("href", ""), self.products[-1]
        self.open.append((tag, a, classes))

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.open):
            while self.open.pop()[0] != tag:
                pass
        if tag == "a":
            self.text = None

    def handle_data(self, data):
        if self.text is not None:
            self.text["name"] += data


LISTING = "products array<struct<id: bigint, href: string, name: string>>, sales array<struct<sale: string, tier: string, cents: bigint>>, next map<string, string>, reason string"


def listing(html: Column, row_prefix: str = "product-", link_prefix: str = "/game/", tier_prefix: str = "tier-", tiers: tuple[str, ...] = (), default_tier: str = "", longest_href: int = 500) -> Column:
    """A page's product rows, its sales by tier and its form for more, or a ``reason`` why it is drift: a row without a
    title link, a link that isn't below ``link_prefix`` or climbs out, an id that isn't a number, a tier not known."""

    kind = to_arrow_type(T.StructType.fromDDL(LISTING))

    def one(text: str | None) -> dict:
        r, reason = _Rows(row_prefix, tier_prefix), None
        try:
            r.feed(text or "")
            r.close()
            for p in r.products:
                if not p["href"]:
                    reason = f"row {p['id']} has no title link"
                elif not p["href"].startswith(link_prefix) or ".." in p["href"] or len(p["href"]) > longest_href:
                    reason = f"row {p['id']} links outside {link_prefix}"
                elif not p["id"].isascii() or not p["id"].isdigit():
                    reason = f"row id {p['id']} is not a number"
                p["name"] = p["name"].strip()
            for s in r.sales:
                s["tier"] = s["tier"] or default_tier
                if tiers and s["tier"] not in tiers:
                    reason = f"unknown tier {s['tier']}"
                s["cents"] = int(s["cents"]) if s["cents"] else None
            if reason is None:
                for p in r.products:
                    p["id"] = int(p["id"])
        except Exception as e:  # any parser error is drift, not a failed job
            reason = f"{type(e).__name__}: {e}"
        return {"reason": reason} if reason is not None else {"products": r.products, "sales": r.sales, "next": None if r.next is None else list(r.next.items())}

    @F.arrow_udf(LISTING)
    def read(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return each_slice(pages, one, kind)

    return read(html)


def first_links(links: DataFrame, key: str, slug: str, name: str, position: str) -> DataFrame:
    """Of links to one slug on a page the first keeps its name."""
    return links.groupBy(key, slug).agg(F.min_by(name, position).alias(name), F.min(position).alias(position))


def block_links(html: Column, block: str, prefix: str) -> Column:
    """``struct(links array<struct<slug, name>>, reason)`` of a category page: its links below ``prefix`` within the element
    whose id is ``block``, in document order; a slug that repeats keeps its first name. The rest of the page may link to
    the same places and isn't looked at; a page without the block is drift. Slugs are kept as they are written, but for
    character references."""

    @F.pandas_udf(T.StructType([T.StructField("links", T.ArrayType(T.StructType([T.StructField("slug", T.StringType()), T.StructField("name", T.StringType())]))), T.StructField("reason", T.StringType())]))
    def read(pages: pd.Series) -> pd.DataFrame:
        out = []
        for text in pages:
            try:
                part = markup.parse(text or "").find("", id=block)
                if part is None:
                    out.append((None, f"no block {block}"))
                    continue
                links: dict[str, str] = {}
                for a in part.find_all("a"):
                    if a.attrs.get("href", "").startswith(prefix):
                        links.setdefault(a.attrs["href"][len(prefix) :], a.text.strip())
                out.append(([{"slug": k, "name": v} for k, v in links.items()], None))
            except Exception as e:  # any parser error is drift, not a failed job
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["links", "reason"])

    return read(html)
