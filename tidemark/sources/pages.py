"""Semi-structured pages to typed facts, with strict drift rejection; fingerprints of their structure.

HTML needs a parser, so one Arrow-batched function turns a page into a struct of raw
fields; everything after that is Column code.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.markup import only_references


class _Reader(HTMLParser):
    """Title, link targets, paragraphs, script texts and tag names of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.links, self.tags, self.scripts, self.labels = None, [], {}, [], []
        self._in: str | None = None
        self._label: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        self.tags[tag] = self.tags.get(tag, 0) + 1
        if tag == "a" and attrs.get("href") is not None:
            self.links.append(attrs["href"])
        if tag in ("title", "script"):
            self._in = tag
        if tag == "li":
            self._label = []

    def handle_endtag(self, tag):
        if tag == self._in:
            self._in = None
        if tag == "li" and self._label is not None:
            self.labels.append("".join(self._label).strip())
            self._label = None

    def handle_data(self, data):
        if self._in == "title":
            self.title = (self.title or "") + data
        elif self._in == "script":
            self.scripts.append(data)
        elif self._label is not None:
            self._label.append(data)


_STRINGS = T.ArrayType(T.StringType())
RAW = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("links", _STRINGS), T.StructField("labels", _STRINGS),
    T.StructField("tags", T.MapType(T.StringType(), T.IntegerType())), T.StructField("script", T.StringType()), T.StructField("error", T.StringType()),
])


def read_page(html: Column, references: tuple[str, ...] | None = None) -> Column:
    @F.pandas_udf(RAW)
    def read(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for text in pages:
            r = _Reader()
            error = None
            try:
                r.feed(only_references(text or "", references))
                r.close()
            except Exception as e:  # any parser error is drift, not a failed job
                error = f"{type(e).__name__}: {e}"
            rows.append((r.title, r.links, r.labels, r.tags, "\n".join(r.scripts), error))
        return pd.DataFrame(rows, columns=RAW.names)

    return read(html)


def balanced_object(text: str | None, marker: str) -> str | None:
    """The text from the first ``{`` after a marker to the brace that closes it; braces in strings count too."""
    at = (text or "").find(marker)
    start = text.find("{", at + len(marker)) if at >= 0 else -1
    depth = 0
    for i in range(start, len(text or "")) if start >= 0 else ():
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return text[start : i + 1]
    return None


def inline_json(script: Column, marker: str) -> Column:
    @F.pandas_udf(T.StringType())
    def extract(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: balanced_object(t, marker))

    return extract(script)


def page_facts(pages: DataFrame, html: str = "html", known_tags: tuple[str, ...] | None = None, references: tuple[str, ...] | None = None) -> DataFrame:
    """``pages`` with ``verdict`` (ok, drift or rejected), ``reason`` and the facts.

    An error or a page without a title is drift; so is a tag outside the known vocabulary; a page without an
    article isn't of the kind and is rejected. ``references`` names the character references that pages write, if not all."""
    p = pages.withColumn("page", read_page(F.col(html), references))
    unknown = F.array_except(F.map_keys("page.tags"), F.lit(list(known_tags))) if known_tags else F.array().cast("array<string>")
    no_title = F.coalesce(F.trim("page.title"), F.lit("")) == ""
    reason = (
        F.when(F.col("page.error").isNotNull(), F.col("page.error"))
        .when(no_title, "no title")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown tags: "), F.array_join(F.array_sort(unknown), ",")))
        .when(F.col("page.tags")["article"].isNull(), "no article")
    )
    verdict = F.when(reason.isNull(), "ok").when(reason == "no article", "rejected").otherwise("drift")
    return p.select(*[c for c in pages.columns if c != html], verdict.alias("verdict"), reason.alias("reason"), F.col("page.title").alias("title"), F.col("page.links").alias("links"), F.col("page.labels").alias("labels"), F.col("page.tags").alias("tags"), F.col("page.script").alias("script"))


def sorted_names(names: Column) -> Column:
    return F.array_sort(F.array_distinct(names))


def fingerprint(buckets: dict[str, Column]) -> Column:
    """``struct(names, hash)``: canonical JSON of sorted name lists by bucket, and its SHA-256."""
    names = F.to_json(F.struct(*[sorted_names(c).alias(b) for b, c in sorted(buckets.items())]))
    return F.struct(names.alias("names"), F.sha2(names, 256).alias("hash"))


def vocabulary(buckets: dict[str, Column]) -> Column:
    """Names qualified by their bucket."""
    return F.flatten(F.array(*[_qualified(b, c) for b, c in sorted(buckets.items())]))


def _qualified(bucket: str, names: Column) -> Column:
    return F.transform(sorted_names(names), lambda x: F.concat(F.lit(f"{bucket}:"), x))


def novelty(pages: DataFrame, order: str, names: str) -> DataFrame:
    """``order, fresh``: names that no earlier page had, for pages other than the first of all.

    A name's first page is one aggregation; nothing depends on an order of tasks."""
    seen = pages.select(order, F.explode(names).alias("name"))
    first = seen.groupBy("name").agg(F.min(order).alias(order))
    fresh = first.groupBy(order).agg(F.array_sort(F.collect_list("name")).alias("fresh"))
    start = pages.agg(F.min(order).alias("__start"))
    return fresh.join(F.broadcast(start), F.col(order) > F.col("__start")).drop("__start")


def archive_new(pages: DataFrame, known: DataFrame, hash_: str, order: str) -> DataFrame:
    """The first page of each fingerprint that isn't known yet."""
    cols = [c for c in pages.columns if c != hash_]
    first = pages.groupBy(hash_).agg(F.min_by(F.struct(*cols), order).alias("__row")).select(hash_, "__row.*")
    return first.join(known.select(hash_), hash_, "left_anti")


def next_cursor(labels_form: Column) -> Column:
    """A listing is complete when its hidden form names no further cursor."""
    return F.nullif(F.trim(labels_form), F.lit(""))
