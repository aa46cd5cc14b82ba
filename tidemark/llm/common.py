"""Helpers shared by the training-data operators.

Tables that cut lineage are written below ``spark.checkpoint.dir``, the folder
that driver and executors share. Only where that setting is unset (tests on one
machine) a temporary folder of this machine is used.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_local_base: str | None = None


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the folder all machines of the cluster share."""
    global _local_base
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if _local_base is None:
            _local_base = tempfile.mkdtemp(prefix="tidemark-")
        base = _local_base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch while tables are written: texts can be long, and a batch stands in memory several times.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Python stages that run inside get batches of at most so many rows."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(min(rows, int(before)) if before and int(before) > 0 else rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH)
        else:
            spark.conf.set(_BATCH, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage is cut, and a
    lost executor costs at most the tasks that ran on it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def lower_ascii(col: Column) -> Column:
    """Lower-cases A-Z only; every other character stays as it is."""
    return F.translate(col, _UPPER, _UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def has_map(kind: T.DataType) -> bool:
    """Whether values of a type can be neither hashed nor ordered."""
    return any(word in kind.simpleString() for word in ("map<", "variant"))


def skew_join(rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str, heaviest: int = 1_000) -> DataFrame:
    """Left join with a lookup that has one row for each key, where a few keys may hold most of the rows.

    The ``heaviest`` keys by ``weight`` (a column of the lookup, dropped from the result unless it is all there is)
    are broadcast, a bounded list; their rows don't travel by that key, so no task gets them all. All other keys
    meet by shuffle.
    """
    values = [c for c in lookup.columns if c not in keys]
    side = lambda df, mark: df.select(*[F.col(k).alias(f"__{k}{mark}") for k in keys], *[F.col(v).alias(f"__{v}{mark}") for v in values], F.lit(True).alias(f"__met{mark}"))
    heavy = F.broadcast(side(lookup.orderBy(F.desc(weight), *keys).limit(heaviest), 1))
    out = rows.join(heavy, [F.col(k) == F.col(f"__{k}1") for k in keys], "left")
    # Rows met already get a key of their own, by which they are spread.
    spare = F.xxhash64(*[F.col(c) for c in rows.columns if c not in keys and not has_map(rows.schema[c].dataType)] or [F.lit(0)])
    for k in keys:
        kind = rows.schema[k].dataType
        out = out.withColumn(f"__{k}0", F.when(F.col("__met1"), spare.cast("string").cast(kind) if kind.simpleString() == "binary" else spare.cast(kind)).otherwise(F.col(k)))
    out = out.join(side(lookup, 2), [F.col(f"__{k}0") == F.col(f"__{k}2") for k in keys], "left")
    picked = [F.when(F.col("__met1"), F.col(f"__{v}1")).otherwise(F.col(f"__{v}2")).alias(v) for v in values]
    return out.select(*rows.columns, *picked)


def with_nodes(docs: DataFrame, id_col: str, body: Column, keep: list[str] | None = None) -> tuple[DataFrame, bool]:
    """``node, id, body`` (or ``node`` and the columns ``keep``) for each row, and whether any id is null or shared.

    A node names a row's document and takes its id where that is the id of one row only. Rows that share an id, or
    have none, get a number from a hash of id and body below all plausible ids; only equal rows share it.
    """
    rows = docs.select(*(keep or []), F.col(id_col).cast("bigint").alias("__id"), body.alias("__body"))
    out = keep or [F.col("__id").alias("id"), F.col("__body").alias("body")]
    shared = materialize(rows.groupBy("__id").agg(F.count(F.lit(1)).alias("__rows")).filter("__rows > 1 or __id is null"), "shared-ids")
    if shared.isEmpty():
        return rows.select(F.col("__id").alias("node"), *out), False
    marked = skew_join(rows, shared.filter("__id is not null"), ["__id"], "__rows")
    own = F.xxhash64("__id", "__body").bitwiseAND(F.lit((1 << 62) - 1)) - F.lit(1 << 62) - F.lit(1 << 61)
    node = F.when(F.col("__rows").isNotNull() | F.col("__id").isNull(), own).otherwise(F.col("__id"))
    return marked.select(node.alias("node"), *out), True
