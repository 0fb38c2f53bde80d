"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlens.llm.common import materialize

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of longs to (node, component): the least node that each node reaches.

    Nodes without an edge to another node do not appear. Every round is written to the shared folder. The minima of a
    round are written before they are joined, so that the join reads two plain shuffles and adaptive execution can
    split the rows of a node with very many neighbours.
    """
    star = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    for _ in range(MAX_ROUNDS):
        mark = star.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if mark == before:
            return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = mark
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
