"""What users save per page: categories, assignments, drawn lines, overrides; sound parts, rejects and export state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlens.functions import geometry as g

MAX_CATEGORIES, MAX_DRAWN = 50, 2000
#: page, categories, line_assignments, user_drawn_lines, scale_override, min_line_pts
STATE = (
    "page long, categories map<string,struct<indicator:string,keyword:string,color:array<double>>>, line_assignments map<string,string>, "
    "user_drawn_lines array<struct<start:array<double>,end:array<double>,category:string>>, scale_override string, min_line_pts string"
)


def rejected(states: DataFrame) -> DataFrame:
    """Pages whose state is refused, with the reason."""
    reason = F.when(F.size("categories") > MAX_CATEGORIES, "too many categories").when(F.size("user_drawn_lines") > MAX_DRAWN, "too many drawn lines")
    return states.withColumn("reason", reason).where("reason is not null").select("page", "reason")


def accepted(states: DataFrame) -> DataFrame:
    return states.join(rejected(states), "page", "left_anti")


def categories(states: DataFrame) -> DataFrame:
    """Named categories; a colour that isn't three numbers from 0 to 255 becomes green."""
    c = accepted(states).select("page", F.explode("categories").alias("name", "c")).where(F.trim("name") != "")
    ok = (F.size("c.color") == 3) & F.forall("c.color", lambda v: v.between(0, 255))
    color = F.when(ok, F.transform("c.color", lambda v: v.cast("int"))).otherwise(F.array(F.lit(0), F.lit(255), F.lit(0)))
    return c.select("page", F.trim("name").alias("name"), F.trim(F.coalesce("c.indicator", F.lit(""))).alias("indicator"), F.trim(F.coalesce(F.nullif("c.keyword", F.lit("")), "name")).alias("keyword"), color.alias("color"))


def assignments(states: DataFrame) -> DataFrame:
    """Assignments with a whole-number key and a category."""
    a = accepted(states).select("page", F.explode("line_assignments").alias("idx", "category"))
    return a.select("page", F.trim("idx").try_cast("bigint").alias("line_idx"), F.trim("category").alias("category")).where("line_idx is not null AND category <> ''")


def drawn_lines(states: DataFrame) -> DataFrame:
    """Drawn lines with two ends and a category, in saved order."""
    d = accepted(states).select("page", F.posexplode("user_drawn_lines").alias("ord", "d"))
    ok = (F.size("d.start") == 2) & (F.size("d.end") == 2) & (F.coalesce(F.trim("d.category"), F.lit("")) != "")
    at = lambda end, i: F.get(F.col(f"d.{end}"), F.lit(i))
    box = (at("start", 0), at("start", 1), at("end", 0), at("end", 1))
    return d.where(ok).select("page", F.col("ord").cast("long").alias("ord"), *[c.alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"))], F.trim("d.category").alias("category"), g.length(box).alias("length_pts"))


def overrides(states: DataFrame) -> DataFrame:
    def number(name: str, least: Column) -> Column:
        v = F.col(name).try_cast("double")
        return F.when(v >= least if name == "min_line_pts" else v > least, v).alias(name)

    return accepted(states).select("page", number("scale_override", F.lit(0.0)), number("min_line_pts", F.lit(0.0)))


def export_state(states: DataFrame, auto: DataFrame, lines: DataFrame, skipped: DataFrame) -> DataFrame:
    """Rows to export: a page with saved assignments or drawn lines gives these alone, any other its automatic lines unless
    it's skipped. ``auto``: page, line_idx, category, length_pts; ``lines``: page, line_idx, length_pts; ``skipped``: page."""
    a = assignments(states).join(lines.select("page", "line_idx", "length_pts"), ["page", "line_idx"])
    a = a.select("page", F.lit("auto").alias("source"), F.col("line_idx").alias("ord"), "category", "length_pts")
    d = drawn_lines(states).select("page", F.lit("user").alias("source"), "ord", "category", "length_pts")
    own = assignments(states).select("page").unionByName(drawn_lines(states).select("page")).distinct()
    rest = auto.join(own, "page", "left_anti").join(skipped, "page", "left_anti")
    return a.unionByName(d).unionByName(rest.select("page", F.lit("auto").alias("source"), F.col("line_idx").alias("ord"), "category", "length_pts"))


def page_scales(states: DataFrame, scales: DataFrame) -> DataFrame:
    """``scales`` (page, document and maybe verified_scale, text_scale) with scale_override, the users' own, for
    ``reports.page_scales``."""
    return scales.join(overrides(states).select("page", "scale_override"), "page", "left")


def drawable(pages: DataFrame, *items: DataFrame) -> DataFrame:
    """Pages that any of ``items`` (page, x0..y1) has a whole box or line on."""
    keys = None
    for df in items:
        one = df.where("x0 is not null AND y0 is not null AND x1 is not null AND y1 is not null").select("page")
        keys = one if keys is None else keys.unionByName(one)
    return pages.join(keys.distinct(), "page", "left_semi")


def layer_assigned(lines: DataFrame, layer: str, category: str) -> DataFrame:
    """``lines`` with one layer's category replaced."""
    return lines.withColumn("category", F.when(F.col("layer") == layer, category).otherwise(F.col("category")))
