import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.oracle import compare, connect
from tidemark.llm import queries as Q
from tidemark.llm.fill_in_middle import EliasFano, fill_in_middle, restore, token_ends

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(i, t, seed=42):
    t = t or ""
    units = TOKEN.findall(t)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return i, len(units), "plain", None, None, t
    if h[3] % 100 < 80:
        return i, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_query_equals_its_sql(spark, sf):
    compare(Q.op12_fill_in_middle(spark, sf), connect(sf), Q.oracle_sql()["op12_fill_in_middle"])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=400))
def test_elias_fano_reads_every_rank(values):
    values = sorted(values)
    got = EliasFano(EliasFano.encode(np.array(values, np.int64)))
    assert got.n == len(values) and [got[i] for i in range(len(values))] == values


def test_elias_fano_is_short_and_directed():
    ends = np.cumsum(np.random.default_rng(3).integers(1, 12, 200_000))
    data = EliasFano.encode(ends)
    assert len(data) < 0.75 * len(ends)
    got = EliasFano(data)
    assert [got[i] for i in range(0, len(ends), 997)] == ends[::997].tolist()


@settings(max_examples=150, deadline=None)
@given(st.text(" \t\r\n\x0b\x0c\x1c\x85 ab<PSM>é😀", max_size=40))
def test_token_ends(text):
    assert token_ends(text).tolist() == [m.end() for m in TOKEN.finditer(text)]


@pytest.mark.parametrize("rows_a_copy", [1, 3, 256])
def test_copies_ties_and_odd_rows(spark, rows_a_copy):
    long = "word  piece\n" * 40_000
    texts = [None, "", " ", "\n\n", "one", " a b ", "é 😀 x", "x<P>y z", "ends < and <S", "<M", "P> q <", long]
    rows = [(i, t, "c") for i, t in enumerate(texts * 3)] + [(100 + i, "the same text, again and again", "c") for i in range(40)]
    rows += [(7, "shared id", "d"), (7, "shared id", "d"), (7, "another text", "e"), (None, "no id here", "f"), (None, None, "g")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, digest string").withColumn("n", F.lit(1)).withColumn("list", F.lit(2)).withColumn("rows", F.lit(3))
    out = fill_in_middle(df, rows_a_copy=rows_a_copy)
    got = out.withColumn("back", restore(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((brute(i, t) for i, t, _ in rows), key=key)
    assert sorted(r["back"] for r in got) == sorted(t or "" for _, t, _ in rows)
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}
    assert fill_in_middle(df.limit(0), rows_a_copy=rows_a_copy).count() == 0


def test_two_texts_of_one_digest_end_the_job(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "cd")], "doc_id bigint, text string")
    weak = lambda text: F.length(text).cast("string").cast("binary")
    with pytest.raises(Exception, match="share a digest"):
        fill_in_middle(df, digest=weak).collect()
    assert fill_in_middle(df.filter("doc_id > 1"), digest=weak).count() == 2
