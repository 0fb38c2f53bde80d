"""Which line is nearest to a point."""

from sheetlens.operators import lines

LINE = "page long, line_idx long, x0 double, y0 double, x1 double, y1 double, length_pts double, layer string"


def test_lines_through_a_point_are_equally_near(spark):
    """By shares of the length a point on a line can seem to lie off it; of two lines through it the first counts, as in SQL."""
    rows = [(0, 0, 0.0, 5.0, 22.0, 5.0, 22.0, "L"), (0, 1, 15.0, 0.0, 15.0, 8.0, 8.0, "L"), (0, 2, 15.0, 5.0, 15.0, 8.0, 3.0, "L")]
    points = spark.createDataFrame([(0, 9, 15.0, 5.0)], "page long, point long, px_ double, py_ double")
    got = lines.nearest_line(spark.createDataFrame(rows, LINE), points, "px_", "py_", "point", 50.0).collect()
    assert [(r.line_idx, r.dist) for r in got] == [(0, 0.0)]
