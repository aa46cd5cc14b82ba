"""Fill-in-the-middle rows over an index of distinct texts.

* *Distinct texts*: rows are grouped by the SHA-256 of their text; a group keeps the set of its contents, combined
  before it is shuffled, so that copies travel once for each task. A group with two contents would be a collision:
  it ends the job, it is never mixed up.
* *Join back*: the ids of a digest meet its text; ids alone travel for it, so texts are shuffled once. Groups of more
  than ``rows_a_copy`` rows get a copy of their text for every so many rows, and the rows are dealt over the copies.
* *Boundaries once*: of each distinct text (and each further copy) the ends of its tokens are computed once and kept as
  an Elias-Fano list (low bits packed, high bits unary, a directory of ones for each 512 bits), some five bits a token.
  Each row selects its two seeded cuts from the list by rank, without unpacking it, and Spark puts the pieces together.

A token is a run of other characters with the white space (blank, 09-0D) before it, or white space at the end.
Null texts count as empty; an empty text, or one that holds a sentinel already, stays as it is (form ``plain``).
A null id seeds as an empty string. Rows that share id and text give equal rows, one for each; rows that share an id
alone share the seed. An empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import materialize, skew_join, text_or_empty

_HEAD = struct.Struct("<QQB")
_BLOCK = 512
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class EliasFano:
    """A non-decreasing list of integers in few bits, read by rank."""

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        n, top = len(values), int(values[-1]) if len(values) else 0
        low = max(0, (top // n).bit_length() - 1) if n else 0
        v = values.astype(np.uint64)
        high = np.zeros(-(-(n + (top >> low) + 1) // _BLOCK) * _BLOCK, np.uint8)
        high[((v >> np.uint64(low)) + np.arange(n, dtype=np.uint64)).astype(np.int64)] = 1
        ones = np.concatenate(([0], np.cumsum(high.reshape(-1, _BLOCK).sum(axis=1, dtype=np.int64))))[:-1]
        bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return _HEAD.pack(n, len(ones), low) + ones.astype("<i8").tobytes() + np.packbits(high, bitorder="little").tobytes() + np.packbits(bits.ravel(), bitorder="little").tobytes()

    def __init__(self, data: bytes):
        self.data = data
        self.n, blocks, self.low = _HEAD.unpack_from(data)
        self.ones = np.frombuffer(data, "<i8", blocks, _HEAD.size)
        self.at = _HEAD.size + 8 * blocks
        self.lows = self.at + blocks * _BLOCK // 8

    def __getitem__(self, i: int) -> int:
        b = int(np.searchsorted(self.ones, i, "right")) - 1
        block = np.unpackbits(np.frombuffer(self.data, np.uint8, _BLOCK // 8, self.at + b * _BLOCK // 8), bitorder="little")
        place = b * _BLOCK + int(np.flatnonzero(block)[i - int(self.ones[b])])
        first = i * self.low
        piece = int.from_bytes(self.data[self.lows + first // 8 : self.lows + (first + self.low + 7) // 8], "little")
        return ((place - i) << self.low) | (piece >> first % 8 & (1 << self.low) - 1)


def token_ends(text: str) -> np.ndarray:
    """Code-point offsets at which the tokens of a text end."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    white = (points == 32) | (points - np.uint32(9) < 5)
    ends = np.flatnonzero(~white & np.append(white[1:], True)) + 1
    return np.append(ends, len(points)) if len(points) and white[-1] else ends


_LONGS = T.ArrayType(T.LongType())


@F.pandas_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("a", _LONGS), T.StructField("b", _LONGS)]))
def seeded_cuts(texts: pd.Series, firsts: pd.Series, seconds: pd.Series) -> pd.DataFrame:
    """The number of tokens of each text, and for each of its rows the offsets of the two cuts that two numbers choose."""
    out = []
    for text, h1, h2 in zip(texts, firsts, seconds):
        ends = EliasFano(EliasFano.encode(token_ends(text)))
        ranks = np.sort(np.stack([h1, h2]) % (ends.n + 1), axis=0)
        out.append((ends.n, *[[ends[k - 1] if k else 0 for k in row] for row in ranks.tolist()]))
    return pd.DataFrame(out, columns=["n", "a", "b"])


def distinct_texts(rows: DataFrame) -> DataFrame:
    """``rows(digest, text)`` -> one row for each digest, its text verified to be the only one."""
    sets = rows.groupBy("digest").agg(F.collect_set("text").alias("texts"))
    collision = F.raise_error(F.lit("two different texts share a digest")).cast("string")
    return sets.select("digest", F.when(F.size("texts") == 1, F.col("texts")[0]).otherwise(collision).alias("text"))


def _members(keys: DataFrame, by: list[str]) -> DataFrame:
    """The ids of each group, nulls too; groups are bounded."""
    return keys.groupBy(*by).agg(F.collect_list(F.struct("id")).alias("ids"))


def _seeds(seed: int, key: Column) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80, rows_a_copy: int = 256, digest=lambda text: F.unhex(F.sha2(text, 256))) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output`` for each row of ``docs``.

    ``rate`` of a hundred rows are transformed, ``spm_rate`` of a hundred of those with the suffix first.
    """
    text = text_or_empty(text_col)
    keys = materialize(docs.select(F.col(id_col).alias("id"), digest(text).alias("digest")), "fim-keys").withColumn("place", F.monotonically_increasing_id())
    index = distinct_texts(docs.select(digest(text).alias("digest"), text.alias("text")))
    heavy = materialize(keys.groupBy("digest").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > rows_a_copy), "fim-heavy")
    if heavy.isEmpty():
        met = _members(keys, ["digest"]).join(index, "digest")
    else:
        marked = skew_join(keys, heavy, ["digest"], "rows")
        copies = lambda: F.ceil(F.col("rows") / rows_a_copy).cast("bigint")
        wide = index.join(heavy, "digest").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), copies() - 1)))
        dealt = marked.filter("rows is not null").withColumn("copy", F.pmod("place", copies()))
        met = _members(marked.filter("rows is null"), ["digest"]).join(index, "digest").select("ids", "text")
        met = met.unionByName(_members(dealt, ["digest", "copy"]).join(wide, ["digest", "copy"]).select("ids", "text"))
    # Python between an exchange and a join would cost the texts a second exchange, so lists come after the join.
    first, second = F.transform("ids", lambda x: _seeds(seed, x["id"])[0]), F.transform("ids", lambda x: _seeds(seed, x["id"])[1])
    met = met.withColumn("cuts", seeded_cuts("text", first, second)).select("text", F.col("cuts.n").alias("n"), F.explode(F.arrays_zip(F.col("ids.id").alias("id"), F.col("cuts.a").alias("a"), F.col("cuts.b").alias("b"))).alias("row")).select("text", "n", "row.*")
    h = _seeds(seed, F.col("id"))
    held = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("text") == "") | held | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    rows = met.withColumn("form", form)
    a, b = F.col("a").cast("int"), F.col("b").cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), a), F.substring("text", a + 1, b - a), F.substring("text", b + 1, F.lit((1 << 31) - 1))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", spm).otherwise(psm)
    cut = F.col("form") != "plain"
    return rows.select(F.col("id").alias(id_col), "n", "form", F.when(cut, F.col("a")).alias("prefix_chars"), F.when(cut, F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text before the transformation. A transformed text holds each sentinel once, as texts that hold one stay plain."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
