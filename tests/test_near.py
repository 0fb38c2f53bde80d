"""Components of lines by place and direction against brute force, and how many links they take."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sheetlens.functions import geometry as g
from sheetlens.operators import lines, voting
from sheetlens.plans import near
from sheetlens.plans.graph import stored

LINE = "page long, line_idx long, x0 double, y0 double, x1 double, y1 double, length_pts double, layer string"


def frame(spark, rows):
    return spark.createDataFrame([(p, i, float(a), float(b), float(c), float(d), math.hypot(c - a, d - b), "L") for p, i, a, b, c, d in rows], LINE)


def runs_brute(rows, far, turn=None):
    root = {(p, i): (p, i) for p, i, *_ in rows}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for m, (p, i, *a) in enumerate(rows):
        for q, j, *b in rows[:m]:
            if p != q:
                continue
            close = any(math.dist(s, e) < far for s in (a[:2], a[2:]) for e in (b[:2], b[2:]))
            if close and turn is not None:
                one, two = (math.degrees(math.atan2(v[3] - v[1], v[2] - v[0])) for v in (a, b))
                diff = abs(one - two) % 180
                close = diff < turn or 180 - diff < turn
            if close:
                x, y = sorted((find((p, i)), find((q, j))))
                root[y] = x
    return {k: find(k)[1] for k in root}


def as_dict(df):
    return {(r.page, r.line_idx): r.run for r in df.collect()}


def crowd(rng, n, spots, spread, turns):
    rows = []
    for i in range(n):
        x, y = rng.choice(spots)
        x, y = x + rng.uniform(-spread, spread), y + rng.uniform(-spread, spread)
        a, length = math.radians(rng.choice(turns) + rng.choice([0, 180])), rng.uniform(0, 60)
        rows.append((rng.randrange(2), i, x, y, x + length * math.cos(a), y + length * math.sin(a)))
    return rows


@pytest.mark.parametrize("far, turn, exact, seed", [(10.0, 15.0, 1, 1), (30.0, 8.0, 64, 2), (4.0, None, 1, 3), (25.0, 91.0, 64, 4)])
def test_runs_equal_brute_force(spark, monkeypatch, far, turn, exact, seed):
    monkeypatch.setattr(near, "EXACT", exact)
    rng = random.Random(seed)
    rows = crowd(rng, 160, [(0, 0), (40, 5), (-30, -80), (400, 300)], 25, [0, 7, 14.9, 15.1, 90, 172, 178])
    rows += [(0, 900 + k, 1000 + far * k, 0, 1000 + far * k, 0) for k in range(4)]  # lines of no length, exactly as far apart
    rows += [(1, 950 + k, 2000 + 0.999 * far * k, 0, 2000 + 0.999 * far * k, 50) for k in range(5)]
    assert as_dict(lines.runs(frame(spark, rows), far, degrees=turn)) == runs_brute(rows, far, turn)


def test_chains_turn_within_the_angle(spark):
    """Each line turns a little against the one before: the border of the angle decides, at 0 and 180 degrees too."""
    rows = []
    for p, step in enumerate((14.0, 15.0, 16.0, 45.0)):
        rows += [(p, k, 0, 0, 50 * math.cos(math.radians(step * k)), 50 * math.sin(math.radians(step * k))) for k in range(13)]
    assert as_dict(voting.clusters(frame(spark, rows), 5.0, 15.0)) == runs_brute(rows, 5.0, 15.0)


def test_links_are_in_proportion_to_the_lines(spark):
    """24,000 parallel lines in two spots, of which only the very nearest ends are within the distance."""
    n = 24_000
    i = spark.range(n)
    x = F.when(F.col("id") % 2 == 0, F.rand(1) * 9).otherwise(38.95 + F.rand(2) * 0.5)
    many = i.select(F.lit(0).cast("long").alias("page"), F.col("id").alias("line_idx"), x.alias("x0"), (F.rand(3) * 9).alias("y0"))
    many = many.withColumns({"x1": F.col("x0") + 300, "y1": F.col("y0") + F.rand(4), "length_pts": F.lit(300.0), "layer": F.lit("L")})
    many = stored(many)
    ends = lines.endpoints(many.withColumn("deg", g.angle(g.box()))).withColumnRenamed("line_idx", "node")
    places = ends.withColumns({"far": F.lit(30.0), "turn": F.lit(15.0), "way": F.pmod("deg", F.lit(180.0))})
    links, unsure = near.first_links(places, ["page"])
    assert links.count() <= 2 * 2 * n and unsure.count() <= 1000
    assert set(as_dict(lines.runs(many, 30.0, degrees=15.0)).values()) == {0}
    apart = many.withColumn("x0", F.when(F.col("line_idx") % 2 == 1, F.col("x0") + 0.06).otherwise(F.col("x0"))).withColumn("x1", F.col("x0") + 300)
    assert as_dict(lines.runs(apart, 30.0, degrees=15.0)) == {(0, k): k % 2 for k in range(n)}


def test_free_lines_are_clustered_anew(spark):
    """Two arms that only a claimed line connects: once it's taken, they are clusters of their own."""
    arm = lambda k, x: (0, k, x, 0.0, x + 9, 0.0)
    rows = [arm(k, 10 * k) for k in range(5)] + [(0, 5, 50, 0, 50, 40)] + [(0, 6 + k, 50 + 10 * k, 44, 59 + 10 * k, 44) for k in range(5)]
    with_runs = frame(spark, rows).withColumn("run", F.when(F.col("line_idx") == 5, 5).otherwise(0).cast("long"))
    seeds = spark.createDataFrame([(0, 1, 5)], "page long, inst_ord long, run long")
    claimed = spark.createDataFrame([(0, 1, 1)], "page long, inst_ord long, lines long")
    got = voting.unclaimed_regions(with_runs, seeds, claimed, 25.0, 20.0, (3, 20.0, 3.0)).orderBy("run").collect()
    assert [(r.run, r.lines) for r in got] == [(0, 5), (6, 5)]


def test_sweep_sets_do_not_mix(spark):
    rows = crowd(random.Random(4), 120, [(0, 0), (60, 60)], 30, [0, 20, 90])
    sets = [(5.0, 10.0), (12.0, 25.0)]
    gold = spark.createDataFrame([(0, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 50.0, 50.0, 70.0, 70.0)], "page long, gold_id long, gx0 double, gy0 double, gx1 double, gy1 double")
    got = {(r.distance, r.degrees): r.regions for r in voting.sweep(frame(spark, rows), gold, sets).collect()}
    for far, turn in sets:
        shapes = voting.fence_like(voting.cluster_shapes(voting.clusters(frame(spark, rows), far, turn)), 2, 20.0, 1.0)
        assert got[far, turn] == shapes.count()
