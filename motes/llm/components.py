"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motes.llm.common import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(links: DataFrame) -> DataFrame:
    """Every neighbour listed under ``a`` is linked to the smallest of ``a`` and its neighbours.

    The minima are written first: both sides of the join are then plain shuffles, so AQE can split
    the rows of a hub over tasks.
    """
    low = written(links.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")))
    near = links.join(low, "a").select(F.col("b").alias("v"), "low")
    return near.union(low.select(F.col("a").alias("v"), "low")).where("v != low")


def _edges(df: DataFrame) -> DataFrame:
    return df.select(F.greatest("v", "low").alias("a"), F.least("v", "low").alias("b")).distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge (a, b); the component is its smallest node.

    Self-links are ignored.  Both operations keep the components; they are repeated until every
    edge leads from a node to the smallest node of its component.
    """
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(now)
    while before[0]:
        # Large star: the larger neighbours of each node; small star: the smaller ones.
        both = written(_both(now))
        low = written(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")))
        now = written(_edges(both.where("b > a").join(low, "a").select(F.col("b").alias("v"), "low")
                             .union(low.select(F.col("a").alias("v"), "low")).where("v != low")))
        now = written(_edges(_star(now)))
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
