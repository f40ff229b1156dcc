"""Connected components of an edge table, in Spark: alternating large and small stars until nothing moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.common import materialise


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) from edges (a, b): component is the smallest node that can be reached.

    A smallest node of a component is not listed, nor is a node without edges: they are their own.
    Each round is written to the shared folder; a node of very many edges is aggregated before it is
    shuffled, and its joins are of one row to many, which Spark splits where they are skewed.
    """
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        # Large star: neighbours larger than u move to the smallest of u and its neighbours.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: u and its smaller neighbours move to the smallest of them.
        large = materialise(large.where("u <> v").distinct(), "large")
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(root.withColumnRenamed("m", "v")).distinct(), "small")
        before, mark = mark, _mark(e)
        if mark == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
