"""Greedy choices that depend on an order, made in rounds over pairs instead of as a fold over a whole group.

Only rows that are in a pair with another take part. Pairs fall into connected parts; a part of up to PART rows is settled
in one step, as a fold over its own rows and pairs. Larger parts go by rounds: what is sure now is decided for all of them
at once, and what is left falls into parts again. The result is that of going through the rows one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlens.plans.graph import connected, stored

#: Rows of a connected part that is settled as one group. Rounds between two searches for parts, and rounds altogether.
PART, ROUNDS, MAX_ROUNDS = 1000, 4, 10_000


def _parts(pairs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``pairs`` (keys, a, b, ...) of small parts with their part, of large parts, and the parts of nodes (keys, node, part)."""
    found = connected(pairs.select(*keys, "a", "b"), keys).withColumnRenamed("component", "part")
    small = stored(found.groupBy(*keys, "part").agg(F.count("*").alias("n")).where(F.col("n") <= PART).select(*keys, "part"))
    tagged = pairs.join(found.withColumnRenamed("node", "a"), [*keys, "a"])
    few = stored(tagged.join(small, [*keys, "part"], "left_semi"))
    many = stored(tagged.join(small, [*keys, "part"], "left_anti").drop("part"))
    return few, many, found


def rejected(clashes: DataFrame, keys: list[str]) -> DataFrame:
    """Of items with an order, of which each is kept unless it clashes with one kept before, those that aren't kept: (keys,
    node). ``clashes`` has the pairs (keys, a, b) of the order's values, a before b."""
    left = stored(clashes.select(*keys, "a", "b").distinct())
    out, rounds = None, 0

    def add(more: DataFrame) -> None:
        nonlocal out
        out = more if out is None else out.unionByName(more)

    while not left.isEmpty():
        few, left, _ = _parts(left, keys)
        # A part as a fold: an item is kept if none of those before it that it clashes with is.
        before = few.groupBy(*keys, "part", F.col("b").alias("node")).agg(F.collect_set("a").alias("before"))
        items = before.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("node", "before"))).alias("items"))
        gone = F.aggregate(
            "items", F.array().cast("array<bigint>"),
            # All but the rejected ones of those before are kept.
            lambda acc, x: F.when(F.size(F.array_except(x["before"], acc)) > 0, F.array_append(acc, x["node"])).otherwise(acc),
        )
        add(stored(items.select(*keys, F.explode(gone).alias("node"))))
        for _ in range(ROUNDS):
            if left.isEmpty():
                break
            # Kept: whoever has none before it. Rejected: whoever clashes with one of these.
            first = left.select(*keys, F.col("a").alias("node")).distinct().join(left.select(*keys, F.col("b").alias("node")), [*keys, "node"], "left_anti")
            first = stored(first)
            lost = stored(left.join(first.withColumnRenamed("node", "a"), [*keys, "a"], "left_semi").select(*keys, F.col("b").alias("node")).distinct())
            add(lost)
            done = first.unionByName(lost)
            left = left.join(done.withColumnRenamed("node", "a"), [*keys, "a"], "left_anti").join(done.withColumnRenamed("node", "b"), [*keys, "b"], "left_anti")
            left, rounds = stored(left), rounds + 1
        if rounds > MAX_ROUNDS:
            raise RuntimeError(f"items are left after {rounds} rounds")
    return out if out is not None else clashes.select(*keys, F.col("a").alias("node")).where("false")


def greedy_match(candidates: DataFrame, keys: list[str], claim: str, target: str, score: str) -> DataFrame:
    """One-to-one matching: claims, in order, take their best-scoring target that none before took.

    ``candidates`` has a row per possible pair. Ties go to the smaller target; a claim without a free target gets none. In
    a large part each claim asks for its best free target, and a target that the earliest of all claims for it asks for is
    taken: no claim before could want it. The earliest claim of all is always served, so each round makes progress.
    """
    at = F.struct((-F.col("s")).alias("neg"), "t")
    left = candidates.select(*keys, F.col(claim).cast("long").alias("c"), F.col(target).cast("long").alias("t"), F.col(score).cast("double").alias("s"))
    left = stored(left.groupBy(*keys, "c", "t").agg(F.max("s").alias("s")))
    out, rounds = None, 0

    def add(more: DataFrame) -> None:
        nonlocal out
        out = more if out is None else out.unionByName(more)

    while not left.isEmpty():
        # Claims and targets are the two kinds of nodes of the parts.
        edges = left.select(*keys, (2 * F.col("c")).alias("a"), (2 * F.col("t") + 1).alias("b"), "c", "t", "s")
        few, left, _ = _parts(edges, keys)
        left = stored(left.drop("a", "b"))
        options = few.groupBy(*keys, "part", "c").agg(F.array_sort(F.collect_list(at)).alias("options"))
        claims = options.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("c", "options"))).alias("claims"))
        free = lambda acc, x: F.get(F.filter(x["options"], lambda o: ~F.array_contains(acc["taken"], o["t"])), F.lit(0))
        start = F.struct(F.array().cast("array<bigint>").alias("taken"), F.array().cast("array<struct<c:bigint,t:bigint,s:double>>").alias("made"))
        made = F.aggregate(
            "claims", start,
            lambda acc, x: F.when(free(acc, x).isNull(), acc).otherwise(F.struct(
                F.array_append(acc["taken"], free(acc, x)["t"]).alias("taken"),
                F.array_append(acc["made"], F.struct(x["c"].alias("c"), free(acc, x)["t"].alias("t"), (-free(acc, x)["neg"]).alias("s"))).alias("made"),
            )), lambda acc: acc["made"],
        )
        add(stored(claims.select(*keys, F.explode(made).alias("m")).select(*keys, "m.*")))
        for _ in range(ROUNDS):
            if left.isEmpty():
                break
            best = left.groupBy(*keys, "c").agg(F.min(at).alias("o")).select(*keys, "c", F.col("o.t").alias("t"), (-F.col("o.neg")).alias("s"))
            early = left.groupBy(*keys, "t").agg(F.min("c").alias("c"))
            won = stored(best.join(early, [*keys, "t", "c"]).select(*keys, "c", "t", "s"))
            add(won)
            left = stored(left.join(won.select(*keys, "c"), [*keys, "c"], "left_anti").join(won.select(*keys, "t"), [*keys, "t"], "left_anti"))
            rounds += 1
        if rounds > MAX_ROUNDS:
            raise RuntimeError(f"claims are left after {rounds} rounds")
    if out is None:
        out = left.select(*keys, "c", "t", "s")
    return out.select(*keys, F.col("c").alias(claim), F.col("t").alias(target), F.col("s").alias(score))
