"""Spelling variants: words one edit apart, by an even-partition pigeonhole join.

* *Words*: each task folds its texts into a bounded table of words and counts, flushed when full; Spark adds them up.
* *Segments*: a word of length l is cut evenly in two. One edit touches one half only, so of two near words the other
  half of the shorter one occurs in the longer one: at the same place on the left, and shifted by the difference of
  lengths (0 or 1) on the right. A word is indexed by both segments of its own length and probes, as the equal or
  one-longer word, with substrings at these places for its own length and for one less.
* *Hot segments*: a common segment (of short words above all) would make all pairs of its words. Where a segment has
  more than ``pairs_a_key`` pairs, its words are cut again: what lies outside the segment has the edit, so it is
  cut evenly in two once more, and one of its halves must match as well. Keys so grow from both ends until few words
  share them or the edit's place is all that is left, where all pairs of a key are near. So candidates stay in
  proportion to words and near pairs, and none is lost.
* *Verification*: candidates are made distinct and held to an edit distance of exactly one (Spark's ``levenshtein``).
* *Groups*: each word's form is its near word of largest count, if that is ``ratio`` times its own; roots are found by
  doubling: each round every word takes its root's root.

Null texts hold no words; a null id counts as an empty one (it is part of the corruption rule of ``corrupt``). Rows
that repeat count each; an empty table gives an empty result; other columns are ignored, whatever their names. Words
are compared by code points, and ties go to the smallest word in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

WORD = re.compile("[A-Za-zÀ-ÿ]+")
_LOW = {c: c + 32 for c in range(65, 91)}
#: A text is read in pieces of about this many characters, cut where no word is.
PIECE = 1 << 20


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        # No word is cut: the piece ends where its last word begins, or where a word longer than it ends.
        while end > at and WORD.match(text[end - 1]):
            end -= 1
        if end == at:
            end = WORD.match(text, at).end()
        yield text[at:end]
        at = end
    yield text[at:]


def corrupt(divisor: int) -> Callable[[str], Callable[[str], str]]:
    """For an id, a function of a lower-cased run: where ``divisor`` divides the CRC-32 of ``id:run``, one code point is
    deleted. It makes the misspellings of a corpus that has none of its own."""

    def of(key: str) -> Callable[[str], str]:
        start = zlib.crc32(f"{key}:".encode())

        def change(run: str) -> str:
            h = zlib.crc32(run.encode(), start)
            if h % divisor:
                return run
            at = h % len(run)
            return run[:at] + run[at + 1 :]

        return change

    return of


def _counts(least: int, change, room: int):
    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"word": list(held), "n": list(held.values())})
            held.clear()
            return out

        for batch in batches:
            for key, text in zip(batch["id"], batch["text"]):
                alter = change(key or "") if change else None
                for piece in _pieces(text or ""):
                    for run, n in Counter(WORD.findall(piece)).items():
                        if len(run) >= least:  # a run is never shorter than what becomes of it
                            run = run if run.islower() else run.translate(_LOW)
                            word = alter(run) if alter else run
                            if len(word) >= least:
                                held[word] += n
                    if len(held) >= room:
                        yield flush()
        if held:
            yield flush()

    return counts


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5, change=None, room: int = 200_000) -> DataFrame:
    """``word, n`` of words of enough code points and occurrences. ``change`` is a function of the id as text that gives
    a function of words, or None; ``room`` is the size of a task's table."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInPandas(_counts(least_length, change, room), "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _cut(keys: DataFrame) -> DataFrame:
    """``word, base, longer, lo, hi`` -> the same with either half of ``[lo, hi)`` matched.

    A key stands for a word of length ``base`` whose edit lies in ``[lo, hi)``: the text before ``lo`` and from ``hi`` on
    is the key. A word that is one ``longer`` has one more character between them.
    """
    size = F.col("hi") - F.col("lo")
    # A single character still to match leaves nothing but the place of the inserted one, on either side of it.
    mid = F.col("lo") + F.greatest(F.lit(1), F.floor(size / 2).cast("int"))
    left = keys.select("word", "base", "longer", F.when(size == 1, F.col("hi")).otherwise(mid).alias("lo"), "hi")
    right = keys.select("word", "base", "longer", "lo", F.when(size == 1, F.col("lo")).otherwise(mid).alias("hi"))
    return left.unionByName(right)


def _keyed(keys: DataFrame) -> DataFrame:
    after = F.col("hi") + F.col("longer") + 1
    return keys.select("*", F.substring("word", F.lit(1), F.col("lo")).alias("before"), F.substring("word", after, F.lit((1 << 31) - 1)).alias("after"))


_KEY = ["base", "lo", "hi", "before", "after"]


def near_pairs(words: DataFrame, pairs_a_key: int = 256) -> DataFrame:
    """``words(word)``, distinct -> ``a, b``: each two words exactly one inserted, deleted or replaced code point apart,
    once for each pair, ``a`` the smaller one."""
    length = F.char_length("word")
    whole = lambda longer: words.select("word", (length - longer).alias("base"), F.lit(longer).alias("longer"), F.lit(0).alias("lo"), (length - longer).alias("hi")).filter("base > 0")
    first = whole(0).unionByName(whole(1))
    # One character can't be cut: all words of one are near, and they are no more than the alphabet has letters.
    open_keys, candidates = _cut(first.filter("base > 1")).unionByName(first.filter("base = 1")), None
    while True:
        keyed = materialize(_keyed(open_keys), "spelling-keys")
        sizes = keyed.groupBy(*_KEY).agg(F.sum(1 - F.col("longer")).alias("same"), F.sum("longer").alias("more"))
        sizes = sizes.filter("same > 0 and same + more > 1").withColumn("pairs", F.col("same") * (F.col("same") - 1) / 2 + F.col("same") * F.col("more"))
        # All pairs of a key are near where no place is left; where one is, those of words of one length are.
        place = F.col("hi") - F.col("lo")
        join = F.when((F.col("pairs") <= pairs_a_key) | (place == 0) | ((place == 1) & (F.col("more") == 0)), "all").when(place == 1, "same").otherwise("none")
        sizes = materialize(sizes.select(*_KEY, join.alias("join")), "spelling-sizes")
        members = keyed.join(sizes.select(*_KEY, "join"), _KEY)
        short = members.filter("join <> 'none' and longer = 0")
        left = short.select(*_KEY, F.col("word").alias("a"), "join")
        right = members.filter("join = 'all' or (join = 'same' and longer = 0)").select(*_KEY, F.col("word").alias("b"), "longer")
        met = left.join(right, _KEY).filter("(longer = 1 or a < b)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        met = materialize(met.filter(F.levenshtein("a", "b", 1) == 1), "spelling-pairs")
        candidates = met if candidates is None else candidates.unionByName(met)
        if sizes.filter("join <> 'all'").isEmpty():
            return candidates.distinct()
        open_keys = _cut(members.filter("join <> 'all'").select("word", "base", "longer", "lo", "hi"))


def roots(forms: DataFrame) -> DataFrame:
    """``forms(word, form)`` -> ``word, root``: where following forms ends. Forms make no circle, as their counts grow."""
    found = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = found.join(found.select(F.col("word").alias("root"), F.col("root").alias("beyond")), "root", "left")
        found = materialize(further.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-roots")
        if found.filter("moved").isEmpty():
            return found.select("word", "root")
        found = found.select("word", "root")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5, ratio: int = 5, change=None, pairs_a_key: int = 256) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word."""
    words = materialize(word_counts(docs, id_col, text_col, least_length, least_count, change), "spelling-words")
    pairs = materialize(near_pairs(words.select("word"), pairs_a_key), "spelling-near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(words.select(F.col("word").alias("b"), "n"), "b")
    best = near.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("n"), F.col("b").alias("form"))).alias("top"))
    rows = words.join(best, "word", "left").withColumn("top_n", -F.col("top.col1"))
    enough = F.col("top_n") >= ratio * F.col("n")
    rows = materialize(rows.select("word", F.when(enough, F.col("top.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(enough, F.col("top_n")).alias("form_n")), "spelling-forms")
    found = roots(rows.filter("form is not null"))
    return rows.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
