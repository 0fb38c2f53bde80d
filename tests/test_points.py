"""Lines near boxes and points against brute force: each pair once, with nothing to compare afterwards."""

import math
import random

from pyspark.sql import functions as F

from sheetlens.functions import geometry as g
from sheetlens.operators import lines
from sheetlens.plans import spatial

LINE = "page long, line_idx long, x0 double, y0 double, x1 double, y1 double, length_pts double, layer string"
BOX = "page long, item long, bx0 double, by0 double, bx1 double, by1 double"


def sample(spark, n=150):
    rng = random.Random(3)
    at = lambda: (rng.uniform(-400, 900), rng.uniform(-400, 900))
    rows = [(k % 2, k, *a, *(b := at() if k % 9 == 0 else (a[0] + rng.uniform(-90, 90), a[1] + rng.uniform(-90, 90))), math.dist(a, b), "L") for k in range(n) for a in [at()]]
    boxes = []
    for k in range(40):
        x, y = at()
        # Boxes of one item that overlap, repeated ones, and a large one.
        boxes += [(k % 2, k // 2, x, y, x + 20, y + 10), (k % 2, k // 2, x + 5, y, x + (900 if k == 7 else 30), y + 10)] + [(k % 2, k // 2, x, y, x + 20, y + 10)] * (k % 3)
    return rows, spark.createDataFrame(rows, LINE), boxes, spark.createDataFrame(boxes, BOX)


def test_pairs_come_once(spark):
    rows, frame, boxes, box_frame = sample(spark)
    inside = lambda x, y, b: b[2] - 40 <= x <= b[4] + 40 and b[3] - 40 <= y <= b[5] + 40
    want = sorted({(r[0], r[1], b[1]) for r in rows for b in boxes if r[0] == b[0] and (inside(r[2], r[3], b) or inside(r[4], r[5], b))})
    got = lines.near_box(frame, box_frame, g.box("b"), ["item"], 40.0)
    assert sorted((r.page, r.line_idx, r.item) for r in got.collect()) == want
    assert not got._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")  # pairs aren't shuffled again
    any_box = sorted({w[:2] for w in want})
    assert sorted((r.page, r.line_idx) for r in lines.near_box(frame, box_frame, g.box("b"), [], 40.0).collect()) == any_box
    assert sorted((r.page, r.line_idx) for r in lines.in_boxes(frame, box_frame, g.box("b"), 40.0).collect()) == any_box
    ends = lambda r: (r[2:4], r[4:6], ((r[2] + r[4]) / 2, (r[3] + r[5]) / 2))
    want = sorted({(r[0], r[1], b[1]) for r in rows for b in boxes if r[0] == b[0] and any(math.dist(e, b[2:4]) <= 70 for e in ends(r))})
    got = lines.near_point(frame, box_frame, "bx0", "by0", ["item"], 70.0, True)
    assert sorted((r.page, r.line_idx, r.item) for r in got.collect()) == want


def test_lines_take_few_cells(spark):
    """The boxes are widened, not the lines: a line has a row for each cell of its points, not for all around them."""
    _, frame, _, _ = sample(spark)
    assert spatial.cells_of_points(frame, [(F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y1"))], 300.0).count() < 2 * 150


def test_dimension_lines_bring_the_lines_columns(spark):
    """So that a page's measure needs no second join of all its lines."""
    _, frame, _, _ = sample(spark)
    dims = spark.createDataFrame([(0, 1, 100.0, 100.0, 12.0), (1, 2, 300.0, 500.0, 7.0)], "page long, dim_id long, dx double, dy double, value_ft double")
    plain = lines.dimension_lines(frame, dims, 360.0, 900.0, None)
    more = lines.dimension_lines(frame, dims, 360.0, 900.0, None, ("length_pts", "x0", "y1"))
    want = plain.join(frame, ["page", "line_idx"]).select(*plain.columns, "length_pts", "x0", "y1")
    assert more.count() == 2 and sorted(more.collect()) == sorted(want.collect())
