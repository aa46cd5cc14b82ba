"""Exact deduplication over a log-structured merge index of text digests.

* *Memtable and flush*: each task folds its rows into a bounded table
  ``digest -> (least id, greatest id, count)``; a full table is flushed as one run
  sorted by digest. Runs are Parquet files with min/max statistics and Bloom
  filters on the digest. Folding first means that a group of copies which holds a
  third of the corpus costs a handful of rows for each task.
* *Compaction*: all runs merge into one level, hash-partitioned and sorted by digest
  within each partition, one entry for each digest. Entries keep the least and the greatest
  identifier, so either end can be the row that stays.
* *Hits*: rows whose digest occurs more than once are compared byte by byte with
  the text of the row that stays. Rows that differ from it in spite of an equal
  digest leave the group and are grouped by their whole text. The heaviest digests reach
  their rows by broadcast, and the hits of a group are dealt over as many tasks as its size asks for.

Nulls: a null text counts as empty; a null id never becomes the kept id unless the
group has no other. Rows repeated with the same id count separately and share their
verdict. An empty table gives an empty result. Columns other than id and text are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii, materialize, shared_path, skew_join, text_or_empty

RUN_SCHEMA = "run string, digest binary, lo_id bigint, hi_id bigint, n bigint"
#: Hits that are compared with one copy of the text that stays.
HITS_A_SALT = 512
_BLOOM = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "1000000"}


def _flush_runs(memtable_rows: int, added: int):
    def flush(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, number, table = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            rows = batch.assign(hi_id=batch["lo_id"], n=1)
            table = rows if table is None else pd.concat([table, rows], ignore_index=True)
            table = table.groupby("digest", sort=True, as_index=False).agg(lo_id=("lo_id", "min"), hi_id=("hi_id", "max"), n=("n", "sum"))
            if len(table) >= memtable_rows:
                yield table.assign(run=f"{added}-{part}-{number}")[["run", "digest", "lo_id", "hi_id", "n"]]
                number, table = number + 1, None
        if table is not None and len(table):
            yield table.assign(run=f"{added}-{part}-{number}")[["run", "digest", "lo_id", "hi_id", "n"]]

    return flush


class DigestIndex:
    """Levels of sorted digest runs in the shared folder."""

    def __init__(self, spark, memtable_rows: int = 200_000):
        self.spark, self.memtable_rows, self.added = spark, memtable_rows, 0
        self.path = shared_path(spark, "digest-index")

    def add(self, rows: DataFrame, id_col: str, digest_col: str) -> None:
        """Flushes the rows of ``rows`` as level-0 runs; may be called again for later batches."""
        runs = rows.select(F.col(digest_col).alias("digest"), F.col(id_col).cast("bigint").alias("lo_id")).mapInPandas(_flush_runs(self.memtable_rows, self.added), RUN_SCHEMA)
        runs.write.mode("append").options(**_BLOOM).parquet(f"{self.path}/level0")
        self.added += 1

    def compact(self) -> DataFrame:
        """Merges all runs into level 1: one entry for each digest, sorted by digest."""
        runs = self.spark.read.schema(RUN_SCHEMA).parquet(f"{self.path}/level0")
        merged = runs.groupBy("digest").agg(F.min("lo_id").alias("lo_id"), F.max("hi_id").alias("hi_id"), F.sum("n").alias("n"))
        merged.sortWithinPartitions("digest").write.mode("overwrite").options(**_BLOOM).parquet(f"{self.path}/level1")
        return self.entries()

    def entries(self) -> DataFrame:
        return self.spark.read.schema("digest binary, lo_id bigint, hi_id bigint, n bigint").parquet(f"{self.path}/level1")


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    fold_case: bool = True,
    digest=sha256_digest,
    memtable_rows: int = 200_000,
) -> DataFrame:
    """One row for each row of ``docs``: ``id, keep_id, group_size, kept, text_sha256``.

    ``keep`` names the identifier that stays, ``smallest`` or ``largest``;
    ``digest`` maps the normalised text to a binary digest. Memory: a memtable for
    each task. Shuffles: the runs, once; the texts, once; the texts of hits, once.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), (lower_ascii(text) if fold_case else text).alias("body")).withColumn("digest", digest(F.col("body")))

    index = DigestIndex(docs.sparkSession, memtable_rows)
    index.add(rows.select("id", "digest"), "id", "digest")
    keep_id = F.col("hi_id" if keep == "largest" else "lo_id")
    entries = index.compact().select("digest", keep_id.alias("keep_id"), "n")

    # Texts travel once; only those of hits are written.
    hit = F.col("n") > 1
    probed = materialize(
        skew_join(rows, entries, ["digest"], "n").select("id", "digest", "keep_id", "n", F.when(hit, F.col("body")).alias("body"), F.sha2(F.col("body"), 256).alias("text_sha256"), F.when(hit, F.monotonically_increasing_id()).alias("dealt")),
        "dedup-probed",
    )
    # A group's hits are salted by its size, and the text they are compared with is there once for each salt.
    salts = F.ceil(F.col("n") / HITS_A_SALT).cast("bigint")
    keepers = probed.filter(hit & F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("body").alias("keeper_body"), F.max("n").alias("n"))
    keepers = keepers.select("digest", "keeper_body", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("salt"))
    hits = probed.filter(hit).withColumn("salt", F.pmod("dealt", salts))
    verified = materialize(
        hits.join(keepers, ["digest", "salt"]).select("id", "digest", "keep_id", "n", "text_sha256", (F.col("body") == F.col("keeper_body")).alias("same"), F.when(F.col("body") != F.col("keeper_body"), F.col("body")).alias("body")),
        "dedup-verified",
    )
    same = verified.filter("same")
    out = probed.filter(~hit).select("id", "keep_id", F.col("n").alias("group_size"), "text_sha256")
    other = verified.filter("not same")
    if other.isEmpty():
        return _shape(out.unionByName(same.withColumnRenamed("n", "group_size").select(*out.columns)), id_col)

    end = F.max if keep == "largest" else F.min
    lost = other.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
    sizes = entries.filter(hit).join(lost, "digest", "left").select("digest", (F.col("n") - F.coalesce("lost", F.lit(0))).alias("group_size"))
    regrouped = other.groupBy("digest", "body").agg(end("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return _shape(
        out.unionByName(skew_join(same, sizes, ["digest"], "group_size").select(*out.columns)).unionByName(other.drop("keep_id").join(regrouped, ["digest", "body"]).select(*out.columns)),
        id_col,
    )


def _shape(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("bigint").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
