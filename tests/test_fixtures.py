"""The views of the given tables keep odd values as they are."""

import datetime as dt
import random

from sheetlens.sources import fixtures as fx

SCHEMA = """l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double,
    l_returnflag string, l_linestatus string, l_shipdate timestamp"""


def test_rows_dealt_by_supplier_are_the_same(spark):
    rng, rows = random.Random(1), []
    pick = lambda usual, *odd: rng.choice([usual] * 6 + list(odd))
    for k in range(600):
        day = dt.datetime(1995, 3, 1) + dt.timedelta(days=k)
        rows.append((k, pick(k % 9, None, -5, 2**40), k % 3, pick(3, None, -1, 16, 2**31 - 1), pick(17.0, None, 0.5, -2.0, 1e300, float("inf")), pick(84197.04, None, -0.01, 1.15, 1 / 3, 1e18, 2.0**27),
            pick(0.1, None, 1.28, 1.27, 0.015), pick(0.07, None, -0.07), pick("N", None, "", "NN", "\u00e9", "\x00"), pick("O", None, "  "), pick(day, None, day + dt.timedelta(seconds=1), dt.datetime(1969, 12, 31), dt.datetime(2200, 1, 1))))
    li = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(repr, fx.by_supplier(li).collect())) == sorted(map(repr, li.collect()))
