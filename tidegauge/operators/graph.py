"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.session import materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row ``(node, label)`` per node that has an edge; the label is the smallest node of its component.

    Alternating large-star and small-star steps: every node hands its larger, then its smaller neighbours to the
    smallest node it sees. The edges settle into one star per component after a number of rounds that grows with
    the logarithm of the component, whatever the order of the node ids; the loop ends when a round changes nothing.
    Minima are combined before each shuffle, so a node with very many edges costs one row per task.
    """
    current = materialise(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    before = _state(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(smallest, "a").select(F.inline(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
            .where("a <> b").distinct())
        current = materialise(small)
        after = _state(current)
        if after == before:
            break
        before = after
    members = current.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return members.unionByName(members.select(F.col("label").alias("node"), "label").distinct())
