"""Greedy choices in rounds against going through the rows one by one."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sheetlens.operators import evaluation, legend
from sheetlens.plans import greedy

BOX = "page long, ord long, x0 double, y0 double, x1 double, y1 double"


def kept_brute(pairs, nodes):
    before, kept = defaultdict(set), set()
    for p, a, b in pairs:
        before[p, b].add((p, a))
    for n in sorted(nodes):
        if not before[n] & kept:
            kept.add(n)
    return kept


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0) * max(h, 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union > 0 else 0.0


def matched_brute(rows):
    options = defaultdict(list)
    for p, c, t, s in rows:
        options[p, c].append((-s, t))
    taken, out = set(), set()
    for p, c in sorted(options):
        for neg, t in sorted(options[p, c]):
            if (p, t) not in taken:
                taken.add((p, t))
                out.add((p, c, t, -neg))
                break
    return out


@pytest.mark.parametrize("part", [1000, 8])
def test_rejected_equals_one_by_one(spark, monkeypatch, part):
    monkeypatch.setattr(greedy, "PART", part)
    rng = random.Random(part)
    pairs = {(p, *sorted(rng.sample(range(60), 2))) for p in range(2) for _ in range(60)}
    pairs |= {(7, k, k + 1) for k in range(10)} | {(8, 0, k) for k in range(1, 30)}
    nodes = {(p, n) for p, a, b in pairs for n in (a, b)}
    got = greedy.rejected(spark.createDataFrame(sorted(pairs), "page long, a long, b long"), ["page"])
    assert {(r.page, r.node) for r in got.collect()} == nodes - kept_brute(pairs, nodes)
    assert got.count() == len({(r.page, r.node) for r in got.collect()})


def test_a_chain_of_a_thousand(spark):
    pairs = [(1, k, k + 1) for k in range(1000)]
    got = greedy.rejected(spark.createDataFrame(pairs, "page long, a long, b long"), ["page"])
    assert sorted(r.node for r in got.collect()) == list(range(1, 1001, 2))
    assert greedy.rejected(spark.createDataFrame([], "page long, a long, b long"), ["page"]).count() == 0


@pytest.mark.parametrize("part", [1000, 6])
def test_matching_equals_one_by_one(spark, monkeypatch, part):
    monkeypatch.setattr(greedy, "PART", part)
    rng = random.Random(part)
    rows = {(p, rng.randrange(30), rng.randrange(30)): rng.choice([0.5, 0.5, 0.7, 1.0]) for p in range(2) for _ in range(60)}
    rows |= {(9, k, k - 1): 0.9 for k in range(1, 8)} | {(9, k, k): 0.5 for k in range(8)}  # each wants what the one before has
    rows |= {(10, k, 0): 1.0 for k in range(10)}  # all want one
    rows = [(*k, v) for k, v in rows.items()]
    got = greedy.greedy_match(spark.createDataFrame(rows, "page long, p long, q long, s double"), ["page"], "p", "q", "s")
    assert {tuple(r) for r in got.collect()} == matched_brute(rows)
    assert greedy.greedy_match(got.where("false"), ["page"], "p", "q", "s").collect() == []


def test_distinct_boxes_equal_one_by_one(spark):
    rng = random.Random(3)
    rows = []
    for k in range(250):
        x, y, w = rng.randrange(0, 120, 4), rng.randrange(0, 60, 4), rng.choice([0, 20, 24, 200])
        rows.append((k % 2, k, float(x), float(y), float(x + w), float(y + 20)))
    want = []
    for r in rows:
        if all(k[0] != r[0] or iou(k[2:], r[2:]) < 0.4 for k in want):
            want.append(r)
    got = legend.distinct_boxes(spark.createDataFrame(rows, BOX), ["page"], "ord", 0.4)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    near = []
    for r in rows:
        if all(k[0] != r[0] or abs(k[2] - r[2]) >= 12 or abs(k[3] - r[3]) >= 12 for k in near):
            near.append(r)
    got = legend.apart(spark.createDataFrame(rows, BOX), ["page"], "ord", "x0", "y0", 12.0)
    assert sorted((r.page, r.ord) for r in got.collect()) == sorted(r[:2] for r in near)


def test_twenty_thousand_boxes_on_one_page(spark):
    n = 20_000
    i = spark.range(n).select(F.lit(1).cast("long").alias("page"), F.col("id").alias("ord"), (F.rand(1) * 3000).alias("x0"), (F.rand(2) * 3000).alias("y0"))
    boxes = i.select("*", (F.col("x0") + 40).alias("x1"), (F.col("y0") + 40).alias("y1"))
    rows = [tuple(r) for r in boxes.orderBy("ord").collect()]
    cells, want = defaultdict(list), set()
    for _, k, *b in rows:
        at = int(b[0] // 40), int(b[1] // 40)
        if all(iou(o, b) < 0.5 for dx in (-1, 0, 1) for dy in (-1, 0, 1) for o in cells[at[0] + dx, at[1] + dy]):
            cells[at].append(b)
            want.add(k)
    got = {r.ord for r in legend.distinct_boxes(spark.createDataFrame(rows, boxes.schema), ["page"], "ord", 0.5).collect()}
    assert got == want and 10_000 < len(want) < n


def test_box_matches_take_the_best_free_box(spark):
    pred = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 1.0, 0.0, 11.0, 10.0), (1, 3, 50.0, 0.0, 60.0, 10.0)], "page long, pred_id long, px0 double, py0 double, px1 double, py1 double")
    gold = spark.createDataFrame([(1, 1, 1.0, 0.0, 11.0, 10.0), (1, 2, 0.0, 5.0, 10.0, 15.0)], "page long, gold_id long, gx0 double, gy0 double, gx1 double, gy1 double")
    assert sorted((r.pred_id, r.gold_id) for r in evaluation.box_matches(pred, gold).collect()) == [(1, 1), (2, 2)]
