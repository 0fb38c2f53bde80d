"""Containment by grams against comparing all with all."""

import random

import pytest
from pyspark.sql import functions as F

from sheetlens.operators import legend, reports
from sheetlens.plans.contain import either_way, holding


@pytest.mark.parametrize("alphabet", ["ab", "abcdeé日 "])
def test_holding_equals_all_pairs(spark, alphabet):
    rng = random.Random(len(alphabet))
    word = lambda most: "".join(rng.choices(alphabet, k=rng.randrange(0, most)))
    a = {(rng.randrange(3), word(14)) for _ in range(80)} | {(9, "only here")} | {(0, None)}
    b = {(rng.randrange(3), word(6)) for _ in range(60)} | {(0, None), (8, "x")}
    left, right = spark.createDataFrame(sorted(a, key=str), "page long, a string"), spark.createDataFrame(sorted(b, key=str), "page long, b string")
    want = {(p, x, y) for p, x in a for q, y in b if p == q and x is not None and y is not None and y in x}
    got = holding(left, right, ["page"], "a", "b").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    want |= {(p, x, y) for p, x in a for q, y in b if p == q and x is not None and y is not None and x in y}
    assert sorted(map(tuple, either_way(left, right, ["page"], "a", "b").collect())) == sorted(want)
    assert holding(left, right.where("false"), ["page"], "a", "b").collect() == []


def test_one_rare_gram_leads_to_the_texts(spark):
    """A thousand names that share all but a number: each target meets a few of them, not all."""
    names = spark.range(1000).select(F.lit(1).cast("long").alias("page"), F.concat(F.lit("layer wall "), F.col("id").cast("string")).alias("a"))
    one = names.select("page", F.col("a").alias("b"))
    want = sum(str(y) in str(x) and str(x).startswith(str(y)) for x in range(1000) for y in range(1000))
    assert holding(names, one, ["page"], "a", "b").count() == want


def test_layers_without_a_name(spark):
    lines = spark.createDataFrame([(1, 1, None), (1, 2, "A"), (1, 3, ""), (2, 1, "A"), (3, 1, None)], "page long, line_idx long, layer string")
    maps = spark.createDataFrame([(1, "", "Empty", 1), (1, "A-1", "Long", 2), (3, "B", "No", 1)], "page long, map_layer string, category string, map_ord long")
    got = {(r.page, r.line_idx): r.category for r in reports.category_of_layer(lines, maps).collect()}
    assert got == {(1, 1): "Empty", (1, 2): "Long", (1, 3): "Empty", (2, 1): "Auto-detected"}


def test_known_names_fall_back_to_the_first(spark):
    answers = spark.createDataFrame([(1, "FENCE"), (1, "gate post"), (1, "zzz"), (2, "any")], "document long, name string")
    known = spark.createDataFrame([(1, "Wall", 0), (1, "fence", 1), (1, "Gate", 2)], "document long, known string, known_ord long")
    got = {(r.document, r.name): r.known for r in legend.known_names(answers, known, True).collect()}
    assert got == {(1, "FENCE"): "fence", (1, "gate post"): "Gate", (1, "zzz"): "Wall"}
    assert legend.known_names(answers, known).count() == 2
