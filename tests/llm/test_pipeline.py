import re

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_near_duplicates import brute_components, brute_leaks
from tidemark.llm import queries as Q


def brute_pipeline(rows, items, rejected):
    rows = [(i, t) for i, t in rows if i not in rejected]
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    last = {}
    for i, t in sorted(rows):
        last[low(t)] = i
    rows = [(i, t) for i, t in rows if last[low(t)] == i]
    component = brute_components(rows)
    rows = [(i, t) for i, t in rows if component[i][1] == i]
    return {i for i, t in rows if not brute_leaks(t, items)}


def test_pipeline_equals_brute_force(spark, sf):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.known_language(spark, docs, sf).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    expected = brute_pipeline(rows, items, {i for i, _ in rows} - kept)
    got = {r["doc_id"]: list(r["token_ids"]) for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == expected and 0 < len(expected) < len(rows)
    library = Tokenizer.from_file(Q.tokenizer("word_bpe_49k.json"))
    library.no_truncation()
    assert all(got[i] == library.encode(t, add_special_tokens=False).ids for i, t in rows if i in got)


def test_stages_keep_the_columns_and_odd_rows(spark, sf):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (None, "the and of with that from this", "en", "s", 1), (3, "", None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert out.filter("doc_id is null").count() == 1, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0
    assert [s[0] for s in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]


COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def kept(spark, stage, rows):
    docs = spark.createDataFrame([(i, t, None, "s", k) for k, (i, t) in enumerate(rows)], COLUMNS)
    return sorted(((r["doc_id"], r["text"]) for r in stage(spark, docs, "").collect()), key=str)


def test_rows_that_share_an_id_are_kept_or_dropped_one_by_one(spark):
    equal, similar = corpus_pipeline.one_of_equals, corpus_pipeline.one_of_similar
    assert kept(spark, equal, [(None, "a"), (4, "A"), (None, "b")]) == [(4, "A"), (None, "b")]
    assert kept(spark, equal, [(7, "a"), (7, "a")]) == [(7, "a")]
    assert kept(spark, equal, [(9, "c"), (9, "b"), (10, "b")]) == [(10, "b"), (9, "c")]
    a, b = "one two three four five six", "p q r s t u v"
    assert kept(spark, similar, [(None, a), (4, a), (None, b)]) == [(4, a), (None, b)]
    assert kept(spark, similar, [(7, a), (7, a), (8, None)]) == [(7, a), (8, None)]
    assert kept(spark, similar, [(9, a), (9, b), (10, b + " ")]) == [(9, a), (9, b)]


def test_no_label_drops_no_text(spark):
    assert kept(spark, corpus_pipeline.known_language, [(1, "some words"), (None, "12"), (2, None), (2, "\u00e9")]) == [(1, "some words"), (2, "\u00e9")]


def test_stages_carry_columns_of_any_name_and_type(spark, sf):
    """Names that stages use themselves, a map and a name with a dot; ids that are shared and rows that repeat."""
    a = "the words of this one are here and there"
    rows = [(1, a, "en", {"k": 2}, "n", "i", 5.0, "r"), (1, a, "en", {"k": 1}, "n", "i", 5.0, "r"), (2, a, "en", None, "n", "j", 6.0, "r"), (2, "other words than those of this one, all of them", None, {}, None, None, None, None)]
    rows += [(50 + k, f"{a} {k} " + "x y z " * k, "en", {}, "n", "i", 0.0, "r") for k in range(4)]
    schema = "doc_id bigint, text string, lang string, node map<string,int>, __id string, __row string, score double, `a.b` string"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        got = {str(r) for r in out.collect()}
        assert got and got <= {str(r) for r in docs.collect()}, name
        if name == "exact dedup":
            assert out.count() == len(rows) - 2 and out.filter("doc_id = 1").count() == 0
        if name == "n-gram Jaccard join":
            assert [r["node"] for r in out.filter(F.col("text") == a).collect()] == [{"k": 1}]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == len(rows)
