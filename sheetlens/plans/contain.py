"""Which texts hold which others, by an index of their grams instead of comparing all with all.

A text that holds another has all grams of three letters that the other has. So each target goes to the one of its grams
that the fewest texts of its group have, and meets these texts by equality of group and gram; the texts themselves decide. A
target that is shorter is a gram of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlens.plans.graph import stored

GRAM = 3


def _grams(text: Column, size: Column | int) -> Column:
    size = size if isinstance(size, Column) else F.lit(size)
    last = F.length(text) - size + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, size)))).otherwise(F.array().cast("array<string>"))


def holding(holders: DataFrame, targets: DataFrame, keys: list[str], text: str, target: str) -> DataFrame:
    """Pairs of different (keys, ``text``, ``target``): values of ``holders`` with equal keys that hold the value of ``targets``.
    Every text holds an empty target; null holds nothing and is held by none."""
    h = holders.select(*keys, text).where(F.col(text).isNotNull()).distinct()
    own = stored(targets.select(*keys, target).where(F.col(target).isNotNull()).distinct())
    t = own.where(F.col(target) != "").withColumn("_size", F.least(F.length(target), F.lit(GRAM)))
    asked = stored(t.select(*keys, target, F.explode(_grams(F.col(target), F.col("_size"))).alias("_gram")))
    sizes = [r["_size"] for r in t.select("_size").distinct().collect()]  # GRAM at most
    each = F.array_distinct(F.flatten(F.array(*[_grams(F.col(text), k) for k in sizes]))) if sizes else F.array().cast("array<string>")
    posts = h.select(*keys, text, F.explode(each).alias("_gram"))
    posts = stored(posts.join(asked.select(*keys, "_gram").distinct(), [*keys, "_gram"], "left_semi"))
    often = posts.groupBy(*keys, "_gram").agg(F.count("*").alias("_n"))
    rare = asked.hint("merge").join(often, [*keys, "_gram"], "left").groupBy(*keys, target).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_r"))
    rare = rare.where("_r.n > 0").select(*keys, target, F.col("_r._gram").alias("_gram"))
    met = posts.hint("merge").join(rare, [*keys, "_gram"]).where(F.contains(text, target)).select(*keys, text, target)
    return met.unionByName(h.hint("merge").join(own.where(F.col(target) == ""), keys).select(*keys, text, target))


def either_way(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Pairs of different (keys, ``a``, ``b``) of which one holds the other."""
    one = holding(left, right, keys, a, b)
    return one.unionByName(holding(right, left, keys, b, a).select(*keys, a, b)).distinct()
