"""Range joins as equality joins on grid cells.

Rows of one side are put into every cell that their box, widened by the margin, touches; rows of the other side into the
cells that theirs touches. Cells meet by equality together with the page key, then an exact test decides. A pair that
meets in several cells is kept in the one that holds the upper left corner of the common part.

Grids come in levels, each WIDEST times as coarse as the one before. A box lies on the finest level on which it takes at
most WIDEST + 1 cells per axis, so that a large box isn't spread over very many cells; two boxes meet on the coarser of
their levels. Only levels that occur are looked at.

Joins on cells are always shuffled: rows by cells are many more than Spark counts on, and to send them to all tasks would put
them into the driver first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlens.functions.geometry import Box

#: Cells per axis that one box may take; a larger box lies on a coarser grid.
WIDEST = 64
#: Coarser grids than the given one; beyond, the coarsest holds all.
LEVELS = 4
#: The least side of a cell where points of many items meet few boxes.
WIDE = 300.0


def _size(b: Box, margin: Column | float) -> Column:
    return F.greatest(b[2] - b[0], b[3] - b[1], F.lit(0.0)) + 2 * margin


def _level(b: Box, margin: Column | float, cell: float) -> Column:
    return sum((F.when(_size(b, margin) > cell * WIDEST ** (k + 1), 1).otherwise(0) for k in range(LEVELS)), F.lit(0))


def _cells(df: DataFrame, b: Box, margin: Column | float, cell: float, name: str, levels: list[int]) -> DataFrame:
    """``df`` once for each cell on its own level and on all coarser ``levels``."""
    own = df.withColumn("_own", _level(b, margin, cell))
    out = own.withColumn("_level", F.explode(F.filter(F.lit(levels), lambda k: k >= F.col("_own"))))
    width = F.lit(float(cell)) * F.pow(F.lit(float(WIDEST)), F.col("_level"))
    lo = [F.floor((c - margin) / width) for c in b[:2]]
    hi = [F.floor((c + margin) / width) for c in b[2:]]
    return (
        out.withColumn(f"{name}_lx", lo[0])
        .withColumn(f"{name}_ly", lo[1])
        .withColumn("_cx", F.explode(F.sequence(lo[0], F.greatest(lo[0], hi[0]))))
        .withColumn("_cy", F.explode(F.sequence(lo[1], F.greatest(lo[1], hi[1]))))
        .withColumnRenamed("_own", f"{name}_own")
    )


def grid_join(
    left: DataFrame,
    right: DataFrame,
    left_box: Box,
    right_box: Box,
    exact: Column,
    keys: list[str],
    margin: float = 0.0,
    cell: float = 50.0,
    how: str = "inner",
    large: bool = False,
) -> DataFrame:
    """Pairs of ``left`` and ``right`` with equal ``keys`` whose boxes come within ``margin`` and that meet ``exact``.

    Column names must differ but for ``keys``. ``how`` is inner, left_semi or left_anti; for the latter two ``left`` rows
    come back once, told apart by all their columns. ``large`` says that boxes may be much larger than ``cell``: then all
    levels of grids are used.
    """
    if how != "inner":
        names = left.columns
        hit = grid_join(left, right, left_box, right_box, exact, keys, margin, cell, large=large).select(*names).distinct()
        cond = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in names]
        return left.alias("l").join(hit.alias("r"), cond, how)
    if not large:
        return _on_one_grid(left, right, left_box, right_box, exact, keys, margin, cell)
    levels = list(range(LEVELS + 1))
    a = _cells(left, left_box, margin, cell, "_a", levels)
    b = _cells(right, right_box, 0.0, cell, "_b", levels)
    met = a.hint("merge").join(b, [*keys, "_level", "_cx", "_cy"]).where(exact)
    first = (F.col("_cx") == F.greatest("_a_lx", "_b_lx")) & (F.col("_cy") == F.greatest("_a_ly", "_b_ly"))
    met = met.where(first & (F.col("_level") == F.greatest("_a_own", "_b_own")))
    return met.drop("_level", "_cx", "_cy", "_a_lx", "_a_ly", "_b_lx", "_b_ly", "_a_own", "_b_own")


def _on_one_grid(left: DataFrame, right: DataFrame, left_box: Box, right_box: Box, exact: Column, keys: list[str], margin: float, cell: float) -> DataFrame:
    def cells(df: DataFrame, b: Box, m: float, name: str) -> DataFrame:
        lo = [F.floor((c - m) / cell) for c in b[:2]]
        hi = [F.floor((c + m) / cell) for c in b[2:]]
        return (
            df.withColumn(f"{name}_lx", lo[0])
            .withColumn(f"{name}_ly", lo[1])
            .withColumn("_cx", F.explode(F.sequence(lo[0], F.greatest(lo[0], hi[0]))))
            .withColumn("_cy", F.explode(F.sequence(lo[1], F.greatest(lo[1], hi[1]))))
        )

    met = cells(left, left_box, margin, "_a").hint("merge").join(cells(right, right_box, 0.0, "_b"), [*keys, "_cx", "_cy"]).where(exact)
    first = (F.col("_cx") == F.greatest("_a_lx", "_b_lx")) & (F.col("_cy") == F.greatest("_a_ly", "_b_ly"))
    return met.where(first).drop("_cx", "_cy", "_a_lx", "_a_ly", "_b_lx", "_b_ly")


def cells_of_points(items: DataFrame, points: list[tuple[Column, Column]], cell: float) -> DataFrame:
    """``items`` once for each cell (_cx, _cy) that has one of their ``points``."""
    places = F.array_distinct(F.array(*[F.struct(F.floor(x / cell).alias("x"), F.floor(y / cell).alias("y")) for x, y in points]))
    return items.withColumn("_c", F.explode(places)).select(*items.columns, F.col("_c.x").alias("_cx"), F.col("_c.y").alias("_cy"))


def points_join(
    items: DataFrame, points: list[tuple[Column, Column]], boxes: DataFrame, box: Box, hit: Callable[[Column, Column], Column], keys: list[str], margin: float
) -> DataFrame:
    """Pairs of ``items``, each with several ``points``, and ``boxes`` with equal ``keys`` of which a point is a ``hit``, once
    each. A hit must lie within ``margin`` of the box.

    Cells are wide, as boxes are few against the items: an item goes to the cells of its points, mostly one, and the boxes
    alone to all cells that they may be hit in. A pair counts in the cell of its first point that is a hit, so that nothing is
    compared or shuffled afterwards.
    """
    cell = max(2 * margin, WIDE)
    at = lambda c: F.floor(c / cell)
    own = cells_of_points(items, points, cell)
    lo, hi = [at(c - margin) for c in box[:2]], [at(c + margin) for c in box[2:]]
    wide = boxes.withColumn("_cx", F.explode(F.sequence(lo[0], F.greatest(lo[0], hi[0])))).withColumn("_cy", F.explode(F.sequence(lo[1], F.greatest(lo[1], hi[1]))))
    first = F.lit(False)
    for x, y in reversed(points):
        first = F.when(hit(x, y), (at(x) == F.col("_cx")) & (at(y) == F.col("_cy"))).otherwise(first)
    return own.hint("merge").join(wide, [*keys, "_cx", "_cy"]).where(first).drop("_cx", "_cy")
