"""Dictionary tagging with consumption, and the sync of links that it gives."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import title_normalize

#: Marks of gender count as letters of a name.
GLYPHS = "♀♂"
USED = "\0"


def _inside(c: str) -> bool:
    return unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" or c in GLYPHS


class Dictionary:
    """Names by length, longest first, then in ordinal order; scanned with an index of their first characters."""

    def __init__(self, names: list[tuple[str, int]], boundaries: bool = True):
        self.boundaries = boundaries
        self.names = sorted({(n, i) for n, i in names if n}, key=lambda x: (-len(x[0]), x[0], x[1]))
        self.heads: dict[str, list[int]] = {}
        for k, (n, _) in enumerate(self.names):
            self.heads.setdefault(n[:2], []).append(k)

    def tag(self, text: str) -> list[int]:
        """Ids in the order in which names are accepted. A match is consumed, so that shorter names
        within it don't count; with boundaries it must not stand within a word."""
        present = {k for i in range(len(text)) for w in (1, 2) for k in self.heads.get(text[i : i + w], ()) if text.startswith(self.names[k][0], i)}
        found: list[int] = []
        for k in sorted(present):
            name, id_ = self.names[k]
            at = text.find(name)
            while at >= 0:
                end = at + len(name)
                free = not self.boundaries or ((at == 0 or not _inside(text[at - 1])) and (end == len(text) or not _inside(text[end])))
                if free:
                    text = text[:at] + USED * len(name) + text[end:]
                    if id_ not in found:
                        found.append(id_)
                at = text.find(name, at + 1 if self.boundaries or not free else end)
        return found


def load_dictionary(names: DataFrame, name: str, id_: str, boundaries: bool = True, most: int = 500_000) -> Dictionary:
    """The dictionary of a bounded table; a larger one is refused rather than broadcast."""
    rows = names.select(title_normalize(F.col(name)).alias("n") if boundaries else F.col(name).alias("n"), F.col(id_).cast("int").alias("i")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a dictionary of more than {most} names must be split")
    return Dictionary([(r["n"], r["i"]) for r in rows], boundaries)


def tag_titles(titles: DataFrame, dictionary: Dictionary, key: str, title: str, denied: Column | None = None, most: int = 3) -> DataFrame:
    """``key, status, ids``: none, tagged (up to ``most`` names) or quarantined. ``denied`` tests the column ``__title``."""
    held = titles.sparkSession.sparkContext.broadcast(dictionary)
    rows = titles.select(F.col(key).alias("key"), F.coalesce(title_normalize(F.col(title)), F.lit("")).alias("__title"))
    rows = rows.withColumn("__denied", denied if denied is not None else F.lit(False))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = held.value
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "ids": [[] if no else d.tag(t) for t, no in zip(batch["__title"], batch["__denied"])]})

    kind = rows.schema["key"].dataType.simpleString()
    tagged = rows.mapInPandas(run, f"key {kind}, ids array<int>")
    status = F.when(F.size("ids") == 0, "none").when(F.size("ids") <= most, "tagged").otherwise("quarantined")
    return tagged.select(F.col("key").alias(key), status.alias("status"), "ids")


def work_set(titles: DataFrame, state: DataFrame, key: str, title: str) -> DataFrame:
    """Titles without a machine's tag, or whose stored title drifted; manual tags stay out. Filtered before any Python runs."""
    held = state.select(key, "method", "tagged_name", F.lit(True).alias("__held"))
    stale = F.col("__held").isNull() | ((F.col("method") == "machine") & ~F.col("tagged_name").eqNullSafe(F.col(title)))
    return titles.join(held, key, "left").filter(stale).select(*titles.columns)


def link_diff(desired: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, action``: links to add, and machine-made ones to delete; manual links are never touched."""
    add = desired.select(*keys).distinct().join(existing.select(*keys), keys, "left_anti").withColumn("action", F.lit("add"))
    stale = existing.filter("method = 'machine'").select(*keys).distinct().join(desired.select(*keys), keys, "left_anti").withColumn("action", F.lit("delete"))
    return add.unionByName(stale)


def tagging_sweep(titles: DataFrame, state: DataFrame, links: DataFrame, dictionary: Dictionary, key: str, title: str, entity: str, denied: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """New verdicts of the work set, and the changes of its links."""
    work = work_set(titles, state, key, title)
    verdicts = tag_titles(work, dictionary, key, title, denied)
    desired = verdicts.filter("status = 'tagged'").select(key, F.explode("ids").alias(entity))
    mine = links.join(work.select(key), key, "left_semi")
    return verdicts, link_diff(desired, mine, [key, entity])
