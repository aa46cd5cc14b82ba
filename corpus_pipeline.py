"""From raw documents to token ids in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept;
its result is written as Parquet and read again as the next one's documents. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import encode_documents
from tidemark.llm.common import has_map, lower_ascii, materialize, skew_join, table, text_or_empty, with_nodes
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.jaccard_join import similarity_classes
from tidemark.llm.language_id import predict_language, train_language_model
from tidemark.llm.queries import tokenizer


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and the whole row as one column, so that no name of the documents' own columns can clash.
    ``__first`` orders rows by all columns, those that have no order by their JSON; ``__spread`` is a hash of id and text."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    order = [F.to_json(F.struct(c)) if has_map(f.dataType) else c for c, f in zip(own, docs.schema.fields)]
    return docs.select("doc_id", "text", F.struct(*own).alias("__row"), F.struct(*[c.alias(f"c{k}") for k, c in enumerate(order)]).alias("__first"), F.xxhash64("doc_id", "text").alias("__spread"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what language identification rejects: no text, no letter, or a score hardly above chance.

    Each row is judged alone, so repeated rows and shared or null ids stay as they are; long texts are read whole. Where
    no row has a label there is no model to reject anything, and only rows without a letter go. An empty table stays empty.
    """
    model = train_language_model(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    scored = predict_language(_packed(docs).select("text", "__row"), model, out=("lang", "score", "rejected"))
    return scored.filter(~F.col("rejected")).select("__row.*")


def _one_each(rows: DataFrame, key: list[str]) -> DataFrame:
    """The documents of one row of each key: the first by all its columns. Keys that occur once, nearly all, aren't shuffled by their texts."""
    rows = rows.select(*key, "__row", "__first", "__spread")
    repeated = materialize(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__rows")).filter("__rows > 1"), "repeated-keys")
    if repeated.isEmpty():
        return rows.select("__row.*")
    marked = skew_join(rows, repeated, key, "__rows")
    rest = marked.filter("__rows is not null").groupBy(*key).agg(F.min_by("__row", "__first").alias("__row"))
    return marked.filter("__rows is null").select("__row").unionByName(rest.select("__row")).select("__row.*")


def one_of_equals(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of texts that are equal but for the case of A-Z: the one with the largest id.

    A null text equals an empty one; a null id orders before all others. Of rows with one id and equal texts the first by
    all columns stays; rows with one id and different texts are different documents. Other columns may have any name and
    type; those that have no order count by their JSON.
    """
    kept = exact_dedup(docs, keep="largest").filter("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    keyed = _packed(docs).withColumn("__id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("__sha", F.sha2(lower_ascii(text_or_empty("text")), 256))
    return _one_each(keyed.join(kept, ["__id", "__sha"], "left_semi"), ["__id", "__sha"])


#: Stands for a null id in joins.
NO_ID = -(1 << 63)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each group linked by a 5-gram Jaccard similarity of 0.75 or more.

    A null id orders after all others. Rows without words are linked with nothing and stay. Rows that share an id are
    different documents, unless their texts are equal too; of those the first by all columns stays.
    """
    kept = materialize(similarity_classes(docs).filter("kept").select("node").distinct(), "similar-kept")
    nodes, shared = with_nodes(_packed(docs), "doc_id", F.encode(text_or_empty("text"), "UTF-8"), keep=["__row", "__first", "__spread"])
    rows = nodes.join(kept, "node", "left_semi")
    return _one_each(rows, ["node"]) if shared else rows.select("__row.*")


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark.

    Each row is judged alone by its whole text, so repeated rows and shared or null ids stay as they are. Null and empty
    texts hold nothing and stay, as does every row if the benchmark is empty.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with their digests.

    One row for each row, repeated ones and null ids too; a null or empty text has no tokens. The codec remembers fewer
    words than alone, as workers of earlier stages still hold memory.
    """
    return encode_documents(docs, tokenizer("word_bpe_49k.json"), cache_words=20_000)


STAGES = [
    ("language ID", known_language),
    ("exact dedup", one_of_equals),
    ("n-gram Jaccard join", one_of_similar),
    ("benchmark decontamination", no_benchmark),
    ("BPE encoding and decoding", token_ids),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.split()[0]}")
    return docs
