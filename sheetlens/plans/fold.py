"""Ordered folds: batches that depend on the order of a group's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(df: DataFrame, keys: list[str], order: str, size: str, cap: float, most: int, alone_over: float | None = None) -> DataFrame:
    """Batches in order, filled up to ``cap`` and ``most`` items: keys, order, size, batch. An item over ``alone_over`` (or
    over ``cap``) has a batch to itself."""
    limit = cap if alone_over is None else alone_over
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("double").alias("s"))))
    start = F.struct(
        F.lit(0).alias("batch"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(False).alias("closed"),
        F.array().cast("array<struct<o:bigint,s:double,batch:int>>").alias("out"),
    )

    def step(acc: Column, x: Column) -> Column:
        big = x["s"] > limit
        new = (acc["n"] > 0) & (big | acc["closed"] | (acc["sum"] + x["s"] > cap) | (acc["n"] >= most))
        batch = acc["batch"] + new.cast("int")
        return F.struct(
            batch.alias("batch"),
            F.when(new, x["s"]).otherwise(acc["sum"] + x["s"]).alias("sum"),
            F.when(new, F.lit(1)).otherwise(acc["n"] + 1).alias("n"),
            big.alias("closed"),
            F.array_append(
                acc["out"], F.struct(x["o"].cast("bigint").alias("o"), x["s"].alias("s"), batch.alias("batch"))
            ).alias("out"),
        )

    folded = F.aggregate("items", start, step, lambda acc: acc["out"])
    out = df.groupBy(*keys).agg(items.alias("items")).select(*keys, F.explode(folded).alias("x"))
    return out.select(*keys, F.col("x.o").alias(order), F.col("x.s").alias(size), F.col("x.batch").alias("batch"))
