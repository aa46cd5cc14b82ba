"""Connected components of an edge table by contraction.

In each round every node takes its least neighbour as parent, parents are followed to
their roots, and the edges are rewritten between roots; what is left joins different
roots and shrinks quickly. All steps are joins and aggregations; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, skew_join


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(id, component)`` for each node of an edge; the
    component is its least id. Loops and repeated edges are allowed; nulls are ignored."""
    edges = edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = materialize(edges.distinct(), "cc-edges")
    labels = None
    while not edges.isEmpty():
        # a < b: each b has a smaller neighbour; the others are roots of this round.
        parents = materialize(edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent")), "cc-parents")
        while True:
            up = parents.select(F.col("id").alias("parent"), F.col("parent").alias("grand"))
            jumped = parents.join(up, "parent", "left")
            parents = materialize(jumped.select("id", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")), "cc-parents")
            if parents.filter("moved").isEmpty():
                break
        found = parents.select("id", F.col("parent").alias("component"))
        if labels is None:
            # Every b is in it; an a that no b chose as its least neighbour is a root as well.
            roots = edges.select(F.col("a").alias("id")).distinct().join(found, "id", "left_anti")
            labels = found.unionByName(roots.withColumn("component", F.col("id")))
        else:
            moved = labels.join(found.select(F.col("id").alias("component"), F.col("component").alias("root")), "component", "left")
            labels = moved.select("id", F.coalesce("root", "component").alias("component"))
        labels = materialize(labels, "cc-labels")
        to_root = lambda side: found.select(F.col("id").alias(side), F.col("component").alias(f"{side}_root"))
        edges = (
            edges.join(to_root("a"), "a", "left")
            .join(to_root("b"), "b", "left")
            .select(F.coalesce("a_root", "a").alias("x"), F.coalesce("b_root", "b").alias("y"))
            .filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        )
        edges = materialize(edges.distinct(), "cc-edges")
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels


def extended_components(labels: DataFrame, more: DataFrame) -> DataFrame:
    """``labels(id, component)`` of a graph after the edges ``more(a, b)`` came to it. Only edges between
    different components are followed; nodes that ``labels`` lacks are components of their own before."""
    roots = more.select("a", "b")
    for side in ("a", "b"):
        roots = roots.join(labels.select(F.col("id").alias(side), F.col("component").alias(f"c{side}")), side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    moved = connected_components(roots.filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    if moved.isEmpty():
        return labels
    # One component may hold most of the nodes, so its rows don't travel by it.
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    roots = moved.select(F.col("id").alias("component"), F.col("component").alias("root")).join(sizes, "component")
    old = skew_join(labels, materialize(roots, "cc-roots"), ["component"], "members").select("id", F.coalesce("root", "component").alias("component"))
    return materialize(old.unionByName(moved.join(labels.select("id"), "id", "left_anti")), "cc-labels")
