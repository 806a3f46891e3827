"""Connected components of links that are rows of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.tables import stage


def _sums(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 30))).first()
    return tuple(row)


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node, component``: each linked node and the smallest node it is connected with.

    ``links`` has two number columns ``a, b``; loops, repeats and either order are
    allowed, nulls link nothing. Large and small stars in turn: every node hands
    its neighbours to the smallest of them until all hang on one. Neighbourhoods
    are joined and summed, never collected; each round is a written table.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stage(edges, name)
    before = _sums(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Large star: neighbours above a node go to the smallest around it.
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.filter("a <> b").distinct(), name)
        # Small star: a node and its neighbours below go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        edges = stage(small.filter("a <> b").distinct(), name)
        now = _sums(edges)
        if now == before:
            break
        before = now
    tops = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)


def add_components(rows: DataFrame, links: DataFrame, node: str, name: str = "components") -> DataFrame:
    """Adds ``component_id``: the smallest node connected with the row's, or its own."""
    found = components(links, name).select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    joined = rows.join(found, F.col(node) == F.col("_node"), "left")
    return joined.select(*rows.columns, F.coalesce("_component", node).alias("component_id"))
