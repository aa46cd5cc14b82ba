"""Bounded reports of large tables: the first rows of each group, and the groups with the most."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of_each(rows: DataFrame, group: str, order: list[str], most: int, room: int = 100_000) -> DataFrame:
    """``rows`` with ``place``: the first ``most`` rows of each group in an order, nulls first.

    Each task keeps at most ``most`` rows of a group, batch by batch, so no group is sorted as a whole and little is
    shuffled; only what tasks kept is ranked. Where groups are many, a task's table is emptied at ``room`` rows and begun
    anew, which costs rows, not results. A null group is a group."""
    columns = rows.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, schema = None, None
        for batch in batches:
            schema = batch.schema
            # Arrow's own types: nulls among whole numbers don't make them floats.
            both = pa.Table.from_batches([batch]).to_pandas(types_mapper=pd.ArrowDtype)
            both = both if held is None else pd.concat([held, both], ignore_index=True)
            both = both.sort_values([group, *order], na_position="first", kind="stable", ignore_index=True)
            held = both[both.groupby(group, dropna=False, sort=False).cumcount() < most]
            if len(held) >= room:
                yield from pa.Table.from_pandas(held, schema, preserve_index=False).to_batches()
                held = None
        if held is not None:
            yield from pa.Table.from_pandas(held, schema, preserve_index=False).to_batches()

    kept = rows.mapInArrow(keep, rows.schema)
    w = Window.partitionBy(group).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return kept.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select(*columns, "place")


def most_frequent(rows: DataFrame, group: str, most: int) -> DataFrame:
    """``group, n, place`` of the groups with the most rows, ties by name. Counts are combined before they are shuffled, and only
    ``most`` of them are ranked."""
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), group).limit(most)
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), group)))


def coverage_report(verdicts: DataFrame, shelf: str, group: str, status: str, sample: Column, key: str, most_groups: int = 20, most_samples: int = 50) -> DataFrame:
    """``section, place, name, n, total``: how well members are resolved.

    * ``confirmed``: for all and for each shelf, confirmed members of those that have a number;
    * ``not found``: the groups with the most numbers that no catalog knows;
    * every other status: its first members by ``key``, with ``sample`` as their line.
    """
    numbered = F.col(status) != "no_number"
    shares = verdicts.rollup(shelf).agg(F.count_if(F.col(status) == "confirmed").alias("n"), F.count_if(numbered).alias("total"))
    shares = shares.select(F.lit("confirmed").alias("section"), F.lit(None).cast("int").alias("place"), F.coalesce(shelf, F.lit("all")).alias("name"), "n", "total")
    none = F.lit(None).cast("bigint")
    lost = most_frequent(verdicts.filter(F.col(status) == "number_not_found"), group, most_groups).select(F.lit("not found").alias("section"), "place", F.col(group).alias("name"), "n", none.alias("total"))
    lines = first_of_each(verdicts.filter(~F.col(status).isin("confirmed", "number_not_found")).select(F.col(status).alias("section"), F.col(key).alias("key"), sample.alias("name")), "section", ["key"], most_samples)
    return shares.unionByName(lost).unionByName(lines.select("section", "place", "name", none.alias("n"), none.alias("total")))
