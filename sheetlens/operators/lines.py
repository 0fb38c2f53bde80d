"""Measuring vector lines: near indicators, in selections, on layers, in connected runs, beside dimension texts.

A page's lines have the columns page, line_idx, x0, y0, x1, y1 (endpoints), length_pts, layer.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetlens.functions import geometry as g
from sheetlens.plans.graph import stored
from sheetlens.plans.near import near_components
from sheetlens.plans.spatial import WIDE, grid_join, points_join

#: Words in the names of layers that matter, and the limits beyond which a page isn't measured.
LAYER_WORDS = ("FENC", "WALL", "BARRIER", "GUARD", "RAIL", "GATE", "PERIM", "BNDY", "BOUND")
MORE_LAYER_WORDS = (*LAYER_WORDS, "PROP", "ESMT")
MAX_FIGURES, MAX_LAYERS, MAX_LINES, MAX_PAGE_LINES = 12, 200, 5000, 15000
_LINE = ("page", "line_idx")


def endpoints(lines: DataFrame, midpoint: bool = False) -> DataFrame:
    """A row per end of each line (with ``midpoint``, also its middle): the line's columns, px, py."""
    ends = [F.struct(F.col("x0").alias("px"), F.col("y0").alias("py")), F.struct(F.col("x1").alias("px"), F.col("y1").alias("py"))]
    if midpoint:
        mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
        ends.append(F.struct(mx.alias("px"), my.alias("py")))
    return lines.withColumn("_e", F.explode(F.array(*ends))).select(*lines.columns, "_e.px", "_e.py")


def totals(lines: DataFrame, keys: list[str], scale: Column | float = 1.0) -> DataFrame:
    """Segments and total length per ``keys``: points, inches, scaled inches, feet."""
    pts = F.sum("length_pts")
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    out = lines.groupBy(*keys).agg(F.count("*").alias("segments"), pts.alias("total_pts"), F.first(s).alias("_s"))
    inches = F.col("total_pts") / 72
    return out.select(
        *keys, "segments", "total_pts", inches.alias("total_inches"), (inches * F.col("_s")).alias("scaled_inches"),
        (inches * F.col("_s") / 12).alias("total_feet"),
    )


def layer_counts(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines per layer; a missing layer is named None."""
    return lines.groupBy(*keys, F.coalesce("layer", F.lit("None")).alias("layer")).agg(F.count("*").alias("lines"))


def layer_names(lines: DataFrame, keys: list[str]) -> DataFrame:
    return lines.where("layer <> ''").select(*keys, "layer").distinct()


def with_layer_words(lines: DataFrame, words: tuple[str, ...] = LAYER_WORDS) -> DataFrame:
    return lines.where(F.upper("layer").rlike("|".join(words)))


def layer_word_counts(lines: DataFrame, words: tuple[str, ...] = MORE_LAYER_WORDS) -> DataFrame:
    """Per word: layers that hold it, lines and length on them."""
    one = lines.withColumn("word", F.explode(F.array(*[F.lit(w) for w in words]))).where(F.contains(F.upper("layer"), F.col("word")))
    return one.groupBy("word").agg(
        F.countDistinct("layer").alias("layers"), F.count("*").alias("lines"), F.sum("length_pts").alias("total_pts")
    )


def on_layers(lines: DataFrame, layers: DataFrame) -> DataFrame:
    """Lines on the given layers (page, layer)."""
    return lines.join(layers, ["page", "layer"], "left_semi")


def _points(midpoint: bool) -> list[tuple[Column, Column]]:
    """The ends of a line, with ``midpoint`` also its middle."""
    x0, y0, x1, y1 = g.box()
    return [(x0, y0), (x1, y1), *([((x0 + x1) / 2, (y0 + y1) / 2)] if midpoint else [])]


def _once(df: DataFrame, names: list[str], box: list[str], hit: Callable[..., Column], midpoint: bool) -> tuple[DataFrame, Callable[[Column, Column], Column]]:
    """``df`` as page, ``names`` and ``box``, and the test whether a point hits one; of several boxes of the same ``names``, which
    are rare, a line counts for the first that it hits."""
    one = F.array_sort(F.collect_set(F.struct(*[F.col(c).cast("double").alias(c) for c in box])))
    df = df.groupBy("page", *names).agg(one.alias("_all")).select("page", *names, F.posexplode("_all").alias("_n", "_b"), "_all")
    df = df.select("page", *names, *[F.col(f"_b.{c}").alias(c) for c in box], F.when(F.col("_n") > 0, F.slice("_all", F.lit(1), F.col("_n"))).alias("_before"))
    any_hit = lambda b: reduce(lambda u, v: u | v, [hit(x, y, *[b[c] for c in box]) for x, y in _points(midpoint)])
    new = F.col("_before").isNull() | ~F.exists("_before", any_hit)
    return df, lambda x, y: hit(x, y, *[F.col(c) for c in box]) & new


def near_box(lines: DataFrame, boxes: DataFrame, box: g.Box, keep: list[str], margin: float) -> DataFrame:
    """Pairs of lines and ``boxes`` (page, its columns) with an end in the box widened by ``margin``, once per pair. Without
    columns to ``keep``, the lines with an end in any."""
    corners = [f"_k{c}" for c in ("x0", "y0", "x1", "y1")]
    inside = lambda x, y, *b: g.point_in_box(x, y, b, margin)
    own = boxes.select("page", *keep, *[c.alias(n) for c, n in zip(box, corners)])
    if keep:
        own, hit = _once(own, keep, corners, inside, False)
    else:
        own, hit = own.distinct(), lambda x, y: inside(x, y, *[F.col(c) for c in corners])
    line = lines.select(*_LINE, "x0", "y0", "x1", "y1", "length_pts", "layer")
    met = points_join(line, _points(False), own, tuple(F.col(c) for c in corners), hit, ["page"], margin)
    return met.select(*_LINE, "length_pts", "layer", *keep) if keep else met.groupBy(*_LINE).agg(F.first("length_pts").alias("length_pts"), F.first("layer").alias("layer"))


def in_boxes(lines: DataFrame, boxes: DataFrame, box: g.Box, margin: float = 50.0) -> DataFrame:
    """Lines with an end in any box widened by ``margin``."""
    corners = tuple(F.col(f"_k{c}") for c in ("x0", "y0", "x1", "y1"))
    own = boxes.select("page", *[c.alias(f"_k{n}") for c, n in zip(box, ("x0", "y0", "x1", "y1"))]).distinct()
    met = points_join(lines, _points(False), own, corners, lambda x, y: g.point_in_box(x, y, corners, margin), ["page"], margin)
    return met.groupBy(*_LINE).agg(*[F.first(c).alias(c) for c in lines.columns if c not in _LINE]).select(*lines.columns)


def near_point(lines: DataFrame, points: DataFrame, x: str, y: str, keep: list[str], radius: float, midpoint: bool = False) -> DataFrame:
    """Pairs of lines and ``points`` with an end (with ``midpoint``, or the middle) at most ``radius`` away, once per pair."""
    near = lambda px, py, kx, ky: g.distance(px, py, kx, ky) <= radius
    own, hit = _once(points.select("page", *keep, F.col(x).alias("_kx"), F.col(y).alias("_ky")), keep, ["_kx", "_ky"], near, midpoint)
    line = lines.select(*_LINE, "x0", "y0", "x1", "y1", "length_pts", "layer")
    at = (F.col("_kx"), F.col("_ky"), F.col("_kx"), F.col("_ky"))
    return points_join(line, _points(midpoint), own, at, hit, ["page"], radius).select(*_LINE, "length_pts", "layer", *keep)


def in_selection(lines: DataFrame, selection: DataFrame, both: bool = False) -> DataFrame:
    """Lines with one end (or ``both``) in the page's selection (page, sx0, sy0, sx1, sy1), whatever its corners' order."""
    box = (F.least("sx0", "sx1"), F.least("sy0", "sy1"), F.greatest("sx0", "sx1"), F.greatest("sy0", "sy1"))
    a = g.point_in_box(F.col("x0"), F.col("y0"), box)
    b = g.point_in_box(F.col("x1"), F.col("y1"), box)
    return lines.join(selection, "page").where(a & b if both else a | b)


def selection_measure(lines: DataFrame, selection: DataFrame, scale: float, least: float = 5.0) -> DataFrame:
    return totals(in_selection(lines, selection).where(F.col("length_pts") >= least), ["page", "layer"], scale)


def nearest_line(lines: DataFrame, points: DataFrame, x: str, y: str, point_id: str, radius: float) -> DataFrame:
    """Per point the line nearest by distance to the segment, at most ``radius`` away; ties go to the lower index."""
    box = (F.least("x0", "x1"), F.least("y0", "y1"), F.greatest("x0", "x1"), F.greatest("y0", "y1"))
    at = (F.col(x), F.col(y), F.col(x), F.col(y))
    d = g.segment_distance(F.col(x), F.col(y), g.box())
    met = grid_join(points, lines, at, box, d <= radius, ["page"], radius, max(2 * radius, WIDE)).withColumn("dist", d)
    return met.groupBy("page", point_id).agg(F.min(F.struct("dist", "line_idx")).alias("m")).select(
        "page", point_id, F.col("m.line_idx").alias("line_idx"), F.col("m.dist").alias("dist")
    )


def runs(
    lines: DataFrame, tolerance: Column | float = 2.0, keys: tuple[str, ...] = ("page",), degrees: Column | float | None = None
) -> DataFrame:
    """``lines`` with run: the least line_idx of the lines that ends closer than ``tolerance`` connect, within ``keys``; with
    ``degrees`` only ends of lines whose directions differ by less. Both may be columns that are constant within ``keys``.

    Any number of ends in one spot gives as many links: see ``plans.near``.
    """
    way = lines if degrees is None else lines.withColumn("deg", g.angle(g.box()))
    ends = endpoints(way).withColumnRenamed("line_idx", "node")
    found = near_components(ends, list(keys), tolerance, degrees).withColumnsRenamed({"node": "line_idx", "component": "run"})
    return lines.hint("merge").join(found, [*keys, "line_idx"], "left").withColumn("run", F.coalesce("run", "line_idx"))


def run_from(with_runs: DataFrame, seeds: DataFrame) -> DataFrame:
    """All lines of the runs of ``seeds`` (page, line_idx)."""
    own = with_runs.hint("merge").join(seeds, ["page", "line_idx"], "left_semi").select("page", "run").distinct()
    return with_runs.hint("merge").join(own, ["page", "run"], "left_semi")


def layer_measures(with_runs: DataFrame, scale: float, top: int = 10) -> DataFrame:
    """Per page and layer: segments, feet, number of runs, and the ``top`` longest runs' points."""
    per = with_runs.groupBy("page", "layer", "run").agg(F.count("*").alias("n"), F.sum("length_pts").alias("pts"))
    rank = F.row_number().over(Window.partitionBy("page", "layer").orderBy(F.desc("pts"), "run"))
    ranked = per.withColumn("rank", rank)
    return ranked.groupBy("page", "layer").agg(
        F.sum("n").alias("segments"),
        (F.sum("pts") / 72 * scale / 12).alias("feet"),
        F.count("*").alias("runs"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "pts")))), lambda s: s["pts"]
        ).alias("top_runs"),
    )


def indicator_measures(pairs: DataFrame, scale: float) -> DataFrame:
    """Per page and indicator over ``near_box`` pairs with item: items that have lines, segments, feet, points. A line
    counts once for each item."""
    per = pairs.groupBy("page", "indicator", "item").agg(F.count("*").alias("n"), F.sum("length_pts").alias("pts"))
    return per.groupBy("page", "indicator").agg(
        F.count("*").alias("items"), F.sum("n").alias("segments"),
        (F.sum("pts") / 72 * scale / 12).alias("feet"), F.sum("pts").alias("total_pts"),
    )


def length_histogram(lines: DataFrame, keys: list[str]) -> DataFrame:
    pts = F.col("length_pts")
    bands = {"under_10": pts < 10, "to_50": (pts >= 10) & (pts < 50), "to_100": (pts >= 50) & (pts < 100), "from_100": pts >= 100}
    out = lines.groupBy(*keys).agg(F.count("*").alias("lines"), *[F.count_if(c).alias(n) for n, c in bands.items()])
    return out.withColumns({f"{n}_pct": F.round(100 * F.col(n) / F.col("lines"), 1) for n in bands})


def skip_reasons(pages: DataFrame) -> DataFrame:
    """``pages`` (counts of instances, figures, layers, lines, page_lines) with skip_reason; null where nothing forbids it.

    ``lines`` are those on telling layers. The limit for all lines of a page holds only where it has no such layer, as
    only then they are all looked at.
    """
    reason = (
        F.when(F.col("instances") == 0, "no instances")
        .when(F.col("figures") > MAX_FIGURES, "too many figures")
        .when(F.col("layers") > MAX_LAYERS, "too many layers")
        .when(F.col("lines") > MAX_LINES, "too many lines")
        .when((F.col("lines") == 0) & (F.col("page_lines") > MAX_PAGE_LINES), "too many lines on the page")
    )
    return pages.withColumn("skip_reason", reason)


def page_counts(lines: DataFrame, instances: DataFrame, chunks: DataFrame, words: tuple[str, ...] = LAYER_WORDS) -> DataFrame:
    """Per page: page_lines, lines (on layers that hold one of ``words``), layers, instances, figures."""
    telling = F.coalesce(F.upper("layer").rlike("|".join(words)), F.lit(False))
    a = lines.groupBy("page").agg(
        F.count("*").alias("page_lines"), F.countDistinct("layer").alias("layers"), F.count_if(telling).alias("lines")
    )
    b = instances.groupBy("page").agg(F.count("*").alias("instances"))
    c = chunks.groupBy("page").agg(F.count_if(F.col("chunk_type") == "figure").alias("figures"))
    return a.join(b, "page", "left").join(c, "page", "left").na.fill(0)


def large_figures(chunks: DataFrame, least: float = 100.0) -> DataFrame:
    return chunks.where((F.col("cx1") - F.col("cx0") > least) & (F.col("cy1") - F.col("cy0") > least))


def dimension_candidates(texts: DataFrame, low: float = 2.0, high: float = 500.0) -> DataFrame:
    """Texts that begin with a number of feet in range: ``texts`` with value_ft. Whatever follows the number is ignored."""
    v = F.regexp_substr("text", F.lit(r"^[0-9]+(\.[0-9]*)?")).try_cast("double")
    return texts.withColumn("value_ft", v).where(F.col("value_ft").between(low, high))


def dimension_lines(lines: DataFrame, dims: DataFrame, scale: float, radius: float = 150.0, worst: float | None = 1.0, more: tuple[str, ...] = ()) -> DataFrame:
    """Per dimension (page, dim_id, dx, dy, value_ft) the line whose length and place fit best: length error as a share
    of what is expected, plus 0.3 of the distance as a share of ``radius``. Scores of ``worst`` or more are left out. With
    ``more`` these columns of the line come along."""
    line = lines.where("length_pts >= 5").select(*dict.fromkeys((*_LINE, "length_pts", "x0", "y0", "x1", "y1", *more)))
    own = dims.select("page", "dim_id", "value_ft", "dx", "dy").distinct()
    away = lambda x, y: g.distance(x, y, F.col("dx"), F.col("dy"))
    at = (F.col("dx"), F.col("dy"), F.col("dx"), F.col("dy"))
    met = points_join(line, _points(True), own, at, lambda x, y: away(x, y) <= radius, ["page"], radius)
    met = met.withColumn("dist", F.least(*[away(x, y) for x, y in _points(True)]))
    expected = F.col("value_ft") * 12 / scale * 72
    score = F.abs(F.col("length_pts") - expected) / expected + F.col("dist") / radius * 0.3
    best = met.withColumn("score", score).groupBy("page", "dim_id", "value_ft").agg(F.min(F.struct("score", "line_idx", "length_pts", *[c for c in more if c != "length_pts"])).alias("m"))
    actual = F.col("m.length_pts") / 72 * scale / 12
    out = best.select(
        "page", "dim_id", "value_ft", F.col("m.line_idx").alias("line_idx"), F.col("m.score").alias("score"), actual.alias("actual_ft"),
        (F.abs(actual - F.col("value_ft")) / F.col("value_ft") * 100).alias("error_pct"), *[F.col(f"m.{c}").alias(c) for c in more],
    )
    return out if worst is None else out.where(F.col("score") < worst)


def _rounded_ends(df: DataFrame) -> list[Column]:
    return [F.bround(c, 1) for c in ("x0", "y0", "x1", "y1")]


def match_by_ends(found: DataFrame, lines: DataFrame) -> DataFrame:
    """``found`` (page, found_id, x0..y1) to the first line with the same ends to one decimal, in either direction."""
    names = ("e0", "e1", "e2", "e3")
    a = lines.select("page", "line_idx", *[c.alias(n) for c, n in zip(_rounded_ends(lines), names)])
    b = lines.select("page", "line_idx", *[c.alias(n) for c, n in zip(_rounded_ends(lines), ("e2", "e3", "e0", "e1"))])
    both = a.unionByName(b).groupBy("page", *names).agg(F.min("line_idx").alias("line_idx"))
    f = found.select("page", "found_id", *[c.alias(n) for c, n in zip(_rounded_ends(found), names)])
    return f.join(both, ["page", *names]).select("page", "found_id", "line_idx")


def match_by_distance(found: DataFrame, lines: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """``found`` to the line whose pair of ends is nearest, in either direction, both ends taken together under
    ``tolerance``."""
    f = found.select("page", "found_id", *[F.col(c).alias(f"f{c}") for c in ("x0", "y0", "x1", "y1")])
    fb, lb = g.box("f"), g.box()
    d1 = g.distance(fb[0], fb[1], lb[0], lb[1]) + g.distance(fb[2], fb[3], lb[2], lb[3])
    d2 = g.distance(fb[0], fb[1], lb[2], lb[3]) + g.distance(fb[2], fb[3], lb[0], lb[1])
    ends = endpoints(lines)
    met = grid_join(f, ends, (fb[0], fb[1], fb[0], fb[1]), (F.col("px"), F.col("py"), F.col("px"), F.col("py")), F.least(d1, d2) < tolerance, ["page"], tolerance, 10.0)
    best = met.withColumn("d", F.least(d1, d2)).groupBy("page", "found_id").agg(F.min(F.struct("d", "line_idx")).alias("m"))
    return best.select("page", "found_id", F.col("m.line_idx").alias("line_idx"), F.col("m.d").alias("dist"))


def not_already_in(found: DataFrame, final: DataFrame) -> DataFrame:
    """``found`` without lines whose ends to one decimal are in ``final``, and without repeats; the lowest found_id stays."""
    names = ("e0", "e1", "e2", "e3")
    f = found.withColumns(dict(zip(names, _rounded_ends(found))))
    have = final.select("page", *[c.alias(n) for c, n in zip(_rounded_ends(final), names)])
    new = f.join(have, ["page", *names], "left_anti")
    return new.groupBy("page", *names).agg(F.min("found_id").alias("found_id")).select("page", "found_id")


def page_measure(
    lines: DataFrame,
    instances: DataFrame,
    figures: DataFrame,
    scale: float,
    dims: DataFrame | None = None,
    margin: float = 80.0,
    words: tuple[str, ...] = LAYER_WORDS,
) -> DataFrame:
    """The whole flow per page: skipped pages out; lines of telling layers in figures if there are any, else lines by
    length near instances; per page method (layers, proximity), segments and lengths. With ``dims`` (as for
    ``dimension_lines``) their lines that aren't counted yet come as a method of their own, dimensions.

    ``figures`` has cx0..cy1, ``instances`` ix0..iy1.
    """
    ok = skip_reasons(page_counts(lines, instances, figures, words)).where("skip_reason is null").select("page")
    own = lines.join(ok, "page", "left_semi")
    named = with_layer_words(own, words)
    figs = large_figures(figures.where("chunk_type = 'figure'"))
    ends = ["page", "line_idx", "length_pts", "x0", "y0", "x1", "y1"]
    by_layer = in_boxes(named.select(*ends), figs, g.box("c")).withColumn("method", F.lit("layers"))
    rest = own.join(named.select("page").distinct(), "page", "left_anti").where("length_pts between 10 and 200")
    by_place = in_boxes(rest.select(*ends), instances, g.box("i"), margin).withColumn("method", F.lit("proximity"))
    counted = by_layer.unionByName(by_place)
    if dims is not None:
        counted = stored(counted)  # measured, and compared with what dimensions find
    out = totals(counted, ["page", "method"], scale)
    if dims is None:
        return out
    best = dimension_lines(own, dims.join(ok, "page", "left_semi"), scale, more=("length_pts", "x0", "y0", "x1", "y1"))
    found = best.select(*ends).distinct().withColumnRenamed("line_idx", "found_id")
    more = found.join(not_already_in(found, counted), ["page", "found_id"], "left_semi")
    return out.unionByName(totals(more.withColumn("method", F.lit("dimensions")), ["page", "method"], scale))


def page_measure_totals(measures: DataFrame) -> DataFrame:
    """Per page over ``page_measure``: method (layers if it has any), segments and feet of it, and those of dimensions."""
    is_dim = F.col("method") == "dimensions"
    return measures.groupBy("page").agg(
        F.min(F.when(~is_dim, F.col("method"))).alias("method"),
        F.coalesce(F.sum(F.when(~is_dim, F.col("segments"))), F.lit(0)).alias("segments"),
        F.coalesce(F.sum(F.when(~is_dim, F.col("total_feet"))), F.lit(0.0)).alias("total_feet"),
        F.coalesce(F.sum(F.when(is_dim, F.col("segments"))), F.lit(0)).alias("dimension_segments"),
        F.coalesce(F.sum(F.when(is_dim, F.col("total_feet"))), F.lit(0.0)).alias("dimension_feet"),
    )


def nearby_total(lines: DataFrame, dims: DataFrame, radius: float = 150.0, up: float = 100.0) -> DataFrame:
    """Per dimension (page, dim_id, dx, dy) the length of all lines with an end or middle at most ``radius`` from the point
    ``up`` above it."""
    moved = dims.withColumn("dy", F.col("dy") - up)
    met = near_point(lines, moved, "dx", "dy", ["dim_id"], radius, midpoint=True)
    return met.groupBy("page", "dim_id").agg(F.count("*").alias("lines"), F.sum("length_pts").alias("total_pts"))


def run_at_point(lines: DataFrame, points: DataFrame, x: str, y: str, point_id: str, radius: float = 50.0, tolerance: float = 5.0) -> DataFrame:
    """Per point the run of its nearest line: lines and length."""
    from_line = nearest_line(lines, points, x, y, point_id, radius)
    with_runs = runs(lines, tolerance)
    own = from_line.hint("merge").join(with_runs.select("page", "line_idx", "run"), ["page", "line_idx"])
    sizes = with_runs.groupBy("page", "run").agg(F.count("*").alias("lines"), F.sum("length_pts").alias("total_pts"))
    return own.hint("merge").join(sizes, ["page", "run"]).select("page", point_id, "run", "lines", "total_pts")
