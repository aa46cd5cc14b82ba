"""Sharding by extendible hashing, with DataFrame operations only.

Every row has a hash; the directory is indexed by leading hash bits. A bucket that
holds more bytes than a shard may is split on the next bit, others stay as they
are, so a shard is a bit prefix and shards differ in depth.

The splits are found without moving rows: one aggregation counts bytes by the
first ``window`` bits, and a prefix of any shorter length is a sum of those cells.
The local depth of a cell is the first depth at which its prefix fits. Cells that
are still too large are counted again on the next ``window`` bits, only them.
Counts are combined before they are shuffled, and the directory is a table, never
collected; it has a row for each shard, not for each row of input.

The hash covers the key and the text, so that a hot key spreads. Rows that are
equal in both can't be told apart by any hash of theirs: for them the hash
goes on with a hash of the row's position in a written copy of just those rows.
A single row larger than the limit gets a shard of its own.

Null keys and texts hash and count as empty; an empty table has no shards; other
columns are carried by none of the steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, text_or_empty

#: Bits of a hash; 60 of them are used, as 15 hexadecimal digits of an MD5.
HASH_BITS = 60


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the key's MD5 as a non-negative long."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def _local_depths(cells: DataFrame, limit: int, low: int, high: int) -> DataFrame:
    """``cells(prefix, bytes, rows)`` at ``high`` bits -> the same with ``depth``: the first of
    ``low..high`` at which the prefix fits the limit or has one row; null if none does."""
    at = cells.select("prefix", "bytes", "rows", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("d")).withColumn("p", F.expr(f"shiftright(prefix, {high} - d)"))
    fits = at.groupBy("d", "p").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r")).filter((F.col("b") <= limit) | (F.col("r") == 1))
    found = at.join(fits, ["d", "p"]).groupBy("prefix").agg(F.min("d").alias("depth"))
    return cells.join(found, "prefix", "left")


def extendible_directory(rows: DataFrame, limit: int, window: int = 12) -> tuple[DataFrame, DataFrame | None]:
    """``rows(h, bytes)`` -> the directory ``(window_bits, prefix, depth)`` of cells, and the
    cells (as prefixes of all bits) whose equal hashes no bit can split, or None."""
    low, open_rows, parts = 0, rows, []
    while True:
        high = min(low + window, HASH_BITS)
        cells = open_rows.groupBy(F.shiftright("h", HASH_BITS - high).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        found = materialize(_local_depths(cells, limit, low if low == 0 else low + 1, high), "shard-cells")
        parts.append(found.filter("depth is not null").select(F.lit(high).alias("bits"), "prefix", "depth"))
        too_large = found.filter("depth is null").select("prefix")
        if too_large.isEmpty():
            unsplit = None
            break
        if high == HASH_BITS:
            unsplit = too_large
            break
        open_rows = open_rows.join(too_large, F.shiftright("h", HASH_BITS - high) == F.col("prefix"), "left_semi")
        low = high
    directory = parts[0]
    for part in parts[1:]:
        directory = directory.unionByName(part)
    return directory, unsplit


def shard_rows(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", window: int = 12) -> DataFrame:
    """One row for each row of ``docs``: ``id, n_bytes, shard_id, depth``.

    ``shard_id`` is the depth and the hash prefix in hexadecimal (``d-prefix``); shards
    of rows that are wholly equal have a second such part. ``limit`` is in bytes of text.
    """
    text = text_or_empty(text_col)
    rows = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            F.octet_length(text).cast("bigint").alias("bytes"),
            hash_bits(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text))).alias("h"),
        ),
        "shard-rows",
    )
    directory, unsplit = extendible_directory(rows, limit, window)
    out = None
    windows = [r["bits"] for r in directory.select("bits").distinct().orderBy("bits").collect()]
    for bits in windows:
        part = directory.filter(F.col("bits") == bits).select("prefix", "depth")
        got = rows.join(part, F.shiftright("h", HASH_BITS - bits) == F.col("prefix")).select("id", "bytes", _name(F.col("depth"), F.expr(f"shiftright(h, {HASH_BITS} - depth)")).alias("shard_id"), "depth")
        out = got if out is None else out.unionByName(got)
    if unsplit is not None:
        equal = materialize(rows.join(unsplit, F.col("h") == F.col("prefix"), "left_semi"), "shard-equal").withColumn("position", F.monotonically_increasing_id())
        again = materialize(equal.select("id", "bytes", F.col("h").alias("h0"), hash_bits(F.concat_ws(":", F.col("h").cast("string"), F.col("position").cast("string"))).alias("h")), "shard-positions")
        for got in _split_again(again, limit, window):
            out = got if out is None else out.unionByName(got)
    if out is None:
        out = rows.select("id", "bytes", F.lit(None).cast("string").alias("shard_id"), F.lit(0).alias("depth"))
    return out.select(F.col("id").alias(id_col), F.col("bytes").alias("n_bytes"), "shard_id", F.col("depth").cast("int").alias("depth"))


def _split_again(rows: DataFrame, limit: int, window: int) -> list[DataFrame]:
    directory, _ = extendible_directory(rows, limit, window)
    out = []
    for bits in [r["bits"] for r in directory.select("bits").distinct().orderBy("bits").collect()]:
        part = directory.filter(F.col("bits") == bits).select("prefix", "depth")
        name = F.concat(_name(F.lit(HASH_BITS), F.col("h0")), F.lit("+"), _name(F.col("depth"), F.expr(f"shiftright(h, {HASH_BITS} - depth)")))
        out.append(rows.join(part, F.shiftright("h", HASH_BITS - bits) == F.col("prefix")).select("id", "bytes", name.alias("shard_id"), (F.col("depth") + HASH_BITS).alias("depth")))
    return out


def _name(depth: Column, prefix: Column) -> Column:
    return F.concat(depth.cast("string"), F.lit("-"), F.lower(F.hex(prefix)))
