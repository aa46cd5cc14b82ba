import hashlib

import pytest
from pyspark.sql import functions as F

from tests.oracle import compare, connect
from tidemark.llm import queries as Q
from tidemark.llm.exact_dedup import DigestIndex, exact_dedup
from tidemark.llm.sharding import HASH_BITS, extendible_directory, shard_rows

DOCS = "doc_id bigint, text string"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    compare(Q.queries()[name](spark, sf), connect(sf), Q.oracle_sql()[name])


def brute_dedup(rows, keep):
    end = max if keep == "largest" else min
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    return sorted((i, end(groups[low(t)]), len(groups[low(t)]), i == end(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows)


ROWS = [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 200_000), (8, "X" * 200_000), (9, "only"), (9, "only")]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("bits", [None, 1, 0])
def test_exact_dedup(spark, keep, bits):
    """Digests cut to one bit or none collide; byte verification must still tell texts apart."""
    digest = {} if bits is None else {"digest": lambda c: F.unhex(F.concat(F.lit("0"), F.substring(F.sha2(c, 256), 1, 1))) if bits else F.unhex(F.lit("00"))}
    df = spark.createDataFrame(ROWS, DOCS).withColumn("keep_id", F.lit("clash")).withColumn("digest", F.lit(0))
    got = exact_dedup(df, keep=keep, memtable_rows=2, **digest)
    assert sorted(tuple(r) for r in got.collect()) == brute_dedup(ROWS, keep)


def test_exact_dedup_empty_and_null_ids(spark):
    assert exact_dedup(spark.createDataFrame([], DOCS)).count() == 0
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup(spark.createDataFrame([(None, "a"), (3, "a"), (None, "b")], DOCS), keep="largest").filter("kept or doc_id is not null or keep_id is null").collect()}
    assert got == {3: 3, None: None}


def test_index_runs_are_sorted_and_compaction_merges(spark):
    index = DigestIndex(spark, memtable_rows=5)
    rows = spark.range(40).select("id", F.unhex(F.sha2((F.col("id") % 10).cast("string"), 256)).alias("digest")).coalesce(1)
    index.add(rows, "id", "digest")
    index.add(rows.withColumn("id", F.col("id") + 100), "id", "digest")
    merged = index.compact()
    assert merged.count() == 10
    assert {(r["lo_id"] % 10, r["hi_id"] - 130 - r["lo_id"], r["n"]) for r in merged.collect()} == {(i, 0, 8) for i in range(10)}
    runs = spark.read.parquet(f"{index.path}/level0")
    assert runs.count() > 10 and runs.select("run").distinct().count() > 1


def test_shards_fit_and_only_oversized_buckets_split(spark):
    rows = [(i, "x" * (i % 50)) for i in range(3000)] + [(5000, "y" * 5000), (5001, None), (5002, "")]
    got = shard_rows(spark.createDataFrame(rows, DOCS), 1000, window=3)
    assert got.count() == len(rows)
    sizes = got.groupBy("shard_id", "depth").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")).collect()
    assert all(s["b"] <= 1000 or s["n"] == 1 for s in sizes)
    # No two sibling shards would fit together.
    by = {s["shard_id"]: s for s in sizes}
    for s in sizes:
        d, p = s["shard_id"].split("-")
        other = by.get(f"{d}-{int(p, 16) ^ 1:x}")
        assert other is None or other["b"] + s["b"] > 1000
    assert len({s["depth"] for s in sizes}) > 1


def test_equal_rows_still_split(spark):
    got = shard_rows(spark.createDataFrame([(1, "z" * 10)] * 500, DOCS), 100, window=12)
    assert got.groupBy("shard_id").agg(F.sum("n_bytes").alias("b")).agg(F.max("b")).first()[0] <= 100
    assert got.count() == 500


def test_no_rows_no_shards(spark):
    assert shard_rows(spark.createDataFrame([], DOCS), 10).count() == 0
    directory, unsplit = extendible_directory(spark.createDataFrame([], "h bigint, bytes bigint"), 10)
    assert directory.count() == 0 and unsplit is None and HASH_BITS == 60
