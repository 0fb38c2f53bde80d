"""Lengths by category: per page, per document, as numbered export rows and sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetlens.functions import geometry as g
from sheetlens.plans.contain import either_way
from sheetlens.plans.graph import stored

FALLBACK, PALETTE_SIZE, MIN_LINE_PTS, MAX_ASSIGNED = "Auto-detected", 8, 10.0, 5000


def category_of_layer(lines: DataFrame, layer_map: DataFrame, by: tuple[str, ...] = ("page",)) -> DataFrame:
    """``lines`` with category by the ``layer_map`` (``by``, map_layer, category, map_ord) of their page or document: exact
    name, else the first name that holds or is held by the layer. Unmatched lines go; where there is no map at all, lines
    are Auto-detected.

    Layers, not lines, are matched, and only with names of their own page or document.
    """
    by = list(by)
    names = stored(lines.select(*by, F.coalesce("layer", F.lit("")).alias("layer")).distinct())
    exact = F.col("layer") == F.col("map_layer")
    pairs = either_way(names.where("layer <> ''"), layer_map.where("map_layer <> ''"), by, "layer", "map_layer")
    same = names.where("layer = ''").select(*by, "layer", F.lit("").alias("map_layer"))
    met = pairs.unionByName(same).join(layer_map, [*by, "map_layer"])
    best = met.groupBy(*by, "layer").agg(F.min(F.struct((~exact).alias("far"), "map_ord", "category")).alias("m"))
    best = best.select(*by, "layer", F.col("m.category").alias("_category"))
    mapped = layer_map.select(*by).distinct().withColumn("_mapped", F.lit(True))
    out = lines.withColumn("layer", F.coalesce("layer", F.lit(""))).join(mapped, by, "left").join(best, [*by, "layer"], "left")
    out = out.withColumn("category", F.when(F.col("_mapped").isNull(), FALLBACK).otherwise(F.col("_category")))
    return out.where("category is not null").select(*lines.columns, "category")


def page_scales(scale: DataFrame) -> DataFrame:
    """page, document and scale: override, verified, text, then 360."""
    have = [c for c in ("scale_override", "verified_scale", "text_scale") if c in scale.columns]
    return scale.select("page", "document", g.scale_or_default(F.coalesce(*have)).alias("scale"))


def page_category_totals(auto: DataFrame, scales: DataFrame, edits: DataFrame | None = None) -> DataFrame:
    """Per document, page and category: pts (1 decimal), ft (2 decimals, from unrounded points), automatic and manual lines.

    ``auto`` has page, category, length_pts. ``edits`` has the same and manual (boolean); a page with edits counts these
    alone.
    """
    rows = auto.select("page", "category", "length_pts", F.lit(False).alias("manual"))
    if edits is not None:
        rows = rows.join(edits.select("page").distinct(), "page", "left_anti").unionByName(
            edits.select("page", "category", "length_pts", "manual")
        )
    per = rows.groupBy("page", "category").agg(
        F.sum("length_pts").alias("raw"), F.count_if(~F.col("manual")).alias("auto_lines"), F.count_if("manual").alias("manual_lines")
    )
    ft = F.bround(F.col("raw") / g.points_per_foot(F.col("scale")), 2)
    return per.join(scales, "page").select(
        "document", "page", "category", F.bround("raw", 1).alias("pts"), ft.alias("ft"), "auto_lines", "manual_lines"
    )


def document_category_totals(per_page: DataFrame) -> DataFrame:
    """Sums of the rounded page values per document and category, with page counts."""
    return per_page.groupBy("document", "category").agg(
        F.bround(F.sum("pts"), 1).alias("pts"), F.bround(F.sum("ft"), 2).alias("ft"), F.count("*").alias("pages"),
        F.sum("auto_lines").alias("auto_lines"), F.sum("manual_lines").alias("manual_lines"),
    )


def page_category_matrix(per_page: DataFrame, categories: list[str]) -> DataFrame:
    """Feet per page (rows) and category (columns)."""
    return per_page.groupBy("document", "page").pivot("category", categories).agg(F.sum("ft"))


def numbered_lines(assigned: DataFrame, drawn: DataFrame, least: float = MIN_LINE_PTS) -> DataFrame:
    """Export rows per page: assigned automatic lines by index, then drawn lines as saved, without those under ``least``
    points, numbered from 1. ``assigned``: page, line_idx, category, length_pts; ``drawn``: page, ord, category, length_pts."""
    a = assigned.select("page", F.lit("auto").alias("source"), F.lit(0).alias("rank"), F.col("line_idx").alias("ord"), "category", "length_pts")
    d = drawn.select(
        "page", F.lit("user").alias("source"), F.lit(1).alias("rank"), F.col("ord"), F.coalesce(F.nullif("category", F.lit("")), F.lit("Unknown")).alias("category"), "length_pts"
    )
    number = F.row_number().over(Window.partitionBy("page").orderBy("rank", "ord"))
    return a.unionByName(d).where(F.col("length_pts") >= least).select("page", number.alias("number"), "source", "ord", "category", "length_pts")


def export_rows(numbered: DataFrame, scales: DataFrame) -> DataFrame:
    ft = F.bround(g.feet(F.col("length_pts"), F.col("scale")), 2)
    return numbered.join(scales, "page").select("document", "page", "number", "category", "source", ft.alias("ft"), F.bround("length_pts", 1).alias("pts"), "scale")


#: The fields of a specification that a report of measurements shows.
SPEC_FIELDS = ("height", "post_type", "post_spacing", "material", "gauge", "mesh_size", "detail_page", "full_details")


def measurement_rows(rows: DataFrame, places: DataFrame, specs: DataFrame, named: DataFrame) -> DataFrame:
    """``export_rows`` as a report shows them: page from one, number, category, type, feet, points, scale, the middle of the
    line and the fields of its category's specification (empty where it has none).

    ``places``: page, source, ord, number, x0..y1 of the lines; ``named``: document, category, name as ``lookup_specs`` gives
    them; ``specs``: document, name, fields (map).
    """
    mid = lambda a, b: F.bround((F.col(a) + F.col(b)) / 2, 1)
    at = places.select("page", "number", mid("x0", "x1").alias("mid_x"), mid("y0", "y1").alias("mid_y"))
    spec = named.join(specs, ["document", "name"]).select("document", "category", "fields")
    out = rows.join(at, ["page", "number"], "left").join(spec, ["document", "category"], "left")
    kind = F.when(F.col("source") == "user", "Manual").otherwise("Auto")
    return out.select(
        "document", (F.col("page") + 1).alias("page_number"), "number", "category", kind.alias("type"), "ft", "pts", "scale", "mid_x", "mid_y",
        *[F.coalesce(F.col("fields")[k], F.lit("")).alias(k) for k in SPEC_FIELDS],
    )


def category_sheet(rows: DataFrame) -> DataFrame:
    """Per category the sum of the rows' rounded feet, rounded again, and their number."""
    return rows.groupBy("category").agg(F.bround(F.sum("ft"), 2).alias("ft"), F.count("*").alias("lines"))


def with_grand_total(rows: DataFrame) -> DataFrame:
    """TOTAL per category and GRAND TOTAL."""
    out = rows.rollup("category").agg(F.bround(F.sum("ft"), 2).alias("ft"), F.count("*").alias("lines"), F.grouping_id().alias("gid"))
    label = F.when(F.col("gid") == 1, "GRAND TOTAL").otherwise(F.concat(F.lit("TOTAL "), F.col("category")))
    return out.select(label.alias("label"), "ft", "lines")


def category_colors(legend: DataFrame, keys: list[str]) -> DataFrame:
    """Categories named ``indicator: keyword`` in order of first use; the colour is the position modulo 8."""
    name = F.when(F.coalesce("indicator", F.lit("")) != "", F.concat_ws(": ", "indicator", "keyword")).otherwise(F.col("keyword"))
    first = legend.where("keyword <> ''").withColumn("category", name).groupBy(*keys, "category").agg(F.min("leg_ord").alias("first"))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("first")) - 1
    return first.withColumn("position", at).select(*keys, "category", "position", (F.col("position") % PALETTE_SIZE).alias("color"))


def lookup_specs(categories: DataFrame, specs: DataFrame, by: tuple[str, ...] = ("document",)) -> DataFrame:
    """Each category's spec (``by``, name, spec_ord) in its own document: exact, then case-insensitive, then containing
    either way; first in order."""
    by = list(by)
    a, b = categories.withColumn("_a", F.lower("category")), specs.withColumn("_b", F.lower("name"))
    rank = F.when(F.col("category") == F.col("name"), 0).when(F.col("_a") == F.col("_b"), 1).otherwise(2)
    met = a.join(either_way(a, b, by, "_a", "_b"), [*by, "_a"]).join(b, [*by, "_b"]).withColumn("rank", rank)
    best = met.groupBy(*by, "category").agg(F.min(F.struct("rank", "spec_ord", "name")).alias("m"))
    return best.select(*by, "category", F.col("m.name").alias("name"))


def export_assignments(edits: DataFrame, lines: DataFrame, most: int = MAX_ASSIGNED) -> DataFrame:
    """Edits (page, idx string, category) that name an existing line, at most ``most`` a page by index."""
    e = edits.withColumn("line_idx", F.col("idx").try_cast("bigint")).where("line_idx >= 0")
    met = e.join(lines.select("page", "line_idx", "length_pts"), ["page", "line_idx"])
    rank = F.row_number().over(Window.partitionBy("page").orderBy("line_idx"))
    return met.withColumn("rank", rank).where(F.col("rank") <= most).select("page", "line_idx", "category", "length_pts")


def layer_overview(lines: DataFrame) -> DataFrame:
    """Per page and layer: lines, length and the category that most of them have; ties go to the one whose line comes first."""
    per = lines.groupBy("page", "layer", "category").agg(
        F.count("*").alias("n"), F.sum("length_pts").alias("pts"), F.min("line_idx").alias("at")
    )
    first = F.min(F.struct((-F.col("n")).alias("neg"), "at", "category"))
    return per.groupBy("page", "layer").agg(F.sum("n").alias("lines"), F.sum("pts").alias("pts"), first.alias("f")).select(
        "page", "layer", "lines", "pts", F.col("f.category").alias("category")
    )


def page_note(rows: DataFrame, dense: int = 150) -> DataFrame:
    """labelled, dense, skipped or no lines, per page with counts (lines, skipped)."""
    note = F.when(F.col("skipped"), "skipped").when(F.col("lines") == 0, "no lines").when(F.col("lines") <= dense, "labelled").otherwise("dense")
    return rows.withColumn("note", note)


def document_total(pages: DataFrame) -> DataFrame:
    """Feet per document: a page's proximity total, else its layer total, else nothing."""
    return pages.groupBy("document").agg(F.bround(F.sum(F.coalesce("proximity_ft", "layer_ft", F.lit(0.0))), 2).alias("ft"))


def spec_sheet(specs: DataFrame) -> DataFrame:
    """One row per element and filled field of ``specs`` (name, fields map)."""
    return specs.select("name", F.explode("fields").alias("field", "value")).where("value <> ''")


def filter_parameters(suggested: DataFrame) -> DataFrame:
    """Suggested proximity (10 to 200, 80 if missing) and least length (20 to 150, 50 if missing) within their limits."""
    clamp = lambda c, lo, hi, d: F.coalesce(F.greatest(F.least(c, F.lit(hi)), F.lit(lo)), F.lit(d))
    return suggested.withColumns(
        {"proximity": clamp(F.col("proximity"), 10.0, 200.0, 80.0), "least_length": clamp(F.col("least_length"), 20.0, 150.0, 50.0)}
    )
