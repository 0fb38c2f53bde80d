"""Column expressions on points, boxes and line segments. A page's y axis points down; units are points (1/72 inch)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SCALE = 360.0
#: Sheet sizes in inches, in order of preference.
SHEET_SIZES = (
    ("ARCH A", 9.0, 12.0),
    ("ARCH B", 12.0, 18.0),
    ("ARCH C", 18.0, 24.0),
    ("ARCH D", 24.0, 36.0),
    ("ARCH E", 36.0, 48.0),
    ("ANSI A (Letter)", 8.5, 11.0),
    ("ANSI B (Tabloid)", 11.0, 17.0),
    ("ANSI C", 17.0, 22.0),
    ("ANSI D", 22.0, 34.0),
)
Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{n}") for n in ("x0", "y0", "x1", "y1"))  # type: ignore[return-value]


def rotated_point(x: Column, y: Column, rotation: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """A MediaBox point (of a box ``width`` x ``height``) on the displayed page."""
    return (
        F.when(rotation == 90, height - y).when(rotation == 180, width - x).when(rotation == 270, y).otherwise(x),
        F.when(rotation == 90, x).when(rotation == 180, height - y).when(rotation == 270, width - x).otherwise(y),
    )


def unrotated_point(x: Column, y: Column, rotation: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """The inverse of ``rotated_point``."""
    return (
        F.when(rotation == 90, y).when(rotation == 180, width - x).when(rotation == 270, width - y).otherwise(x),
        F.when(rotation == 90, height - x).when(rotation == 180, height - y).when(rotation == 270, x).otherwise(y),
    )


def rotated_box(b: Box, rotation: Column, width: Column, height: Column, inverse: bool = False) -> Box:
    """Both corners rotated, smaller coordinates first."""
    turn = unrotated_point if inverse else rotated_point
    ax, ay = turn(b[0], b[1], rotation, width, height)
    bx, by = turn(b[2], b[3], rotation, width, height)
    return F.least(ax, bx), F.least(ay, by), F.greatest(ax, bx), F.greatest(ay, by)


def area(b: Box) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def overlap_area(a: Box, b: Box) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    inter = overlap_area(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def overlap_of_smaller(a: Box, b: Box) -> Column:
    least = F.least(area(a), area(b))
    return F.when(least > 0, overlap_area(a, b) / least).otherwise(F.lit(0.0))


def overlap_of_own(a: Box, b: Box) -> Column:
    return F.when(area(a) > 0, overlap_area(a, b) / area(a)).otherwise(F.lit(0.0))


def center(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def point_in_box(x: Column, y: Column, b: Box, margin: float = 0.0) -> Column:
    return x.between(b[0] - margin, b[2] + margin) & y.between(b[1] - margin, b[3] + margin)


def boxes_touch(a: Box, b: Box) -> Column:
    """Strict overlap."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def length(b: Box) -> Column:
    return distance(*b)


def angle(b: Box) -> Column:
    return F.degrees(F.atan2(b[3] - b[1], b[2] - b[0]))


def segment_distance(px: Column, py: Column, b: Box) -> Column:
    """From a point to the nearest point of the segment; a segment of no length is its point."""
    dx, dy = b[2] - b[0], b[3] - b[1]
    norm = dx * dx + dy * dy
    t = F.when(norm > 0, ((px - b[0]) * dx + (py - b[1]) * dy) / norm).otherwise(F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    # Along an axis the nearest point is exact, so that equal distances are equal.
    held = lambda p, lo, hi: F.greatest(F.least(lo, hi), F.least(F.greatest(lo, hi), p))
    along = (dx == 0) | (dy == 0)
    near_x = F.when(along, held(px, b[0], b[2])).otherwise(F.when(t == 1, b[2]).otherwise(b[0] + t * dx))
    near_y = F.when(along, held(py, b[1], b[3])).otherwise(F.when(t == 1, b[3]).otherwise(b[1] + t * dy))
    return distance(px, py, near_x, near_y)


def scale_or_default(scale: Column) -> Column:
    """Real inches per drawing inch; 360 (one inch to thirty feet) where the scale is missing or not positive."""
    s = scale.try_cast("double")
    return F.when(s > 0, s).otherwise(F.lit(DEFAULT_SCALE))


def points_per_foot(scale: Column) -> Column:
    return F.lit(864.0) / scale_or_default(scale)


def feet(points: Column, scale: Column) -> Column:
    return points / points_per_foot(scale)


def sheet_size(width: Column, height: Column) -> Column:
    """The first standard sheet that a page (in points) has: struct of name and factor; null if none."""
    w, h, out = width / 72.0, height / 72.0, None
    for name, a, b in SHEET_SIZES:
        rw, rh = w / a, h / b
        as_is = (F.abs(w - a) < 0.5) & (F.abs(h - b) < 0.5)
        turned = (F.abs(w - b) < 0.5) & (F.abs(h - a) < 0.5)
        scaled = (F.abs(rw - rh) < 0.05) & (rw > 0.3) & (rw < 3.0)
        of = lambda n, f: F.struct(n.alias("sheet"), f.alias("factor"))
        for cond, value in (
            (as_is, of(F.lit(name), F.lit(1.0))),
            (turned, of(F.lit(f"{name} (portrait)"), F.lit(1.0))),
            (scaled, of(F.concat(F.lit(f"{name} (scaled "), F.format_string("%.1f", rw * 100), F.lit("%)")), rw)),
        ):
            out = F.when(cond, value) if out is None else out.when(cond, value)
    return out
