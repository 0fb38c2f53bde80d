"""Extracted drawing data as tables: text spans, words, image readings, vector drawings, annotations, trade profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetlens.functions import geometry as g

#: One page of extracted text: blocks of lines of spans, in MediaBox coordinates.
TEXT_PAGES = (
    "doc_id long, page_idx int, rotation int, mediabox_w double, mediabox_h double, "
    "blocks array<struct<lines:array<struct<bbox:array<double>,spans:array<struct<text:string>>>>>>"
)
#: One page of words keyed by its number.
WORD_PAGES = "map<string,struct<text:string,words:array<struct<text:string,x0:double,y0:double,x1:double,y1:double,block_no:int,line_no:int,word_no:int>>>>"
READING = "struct<text:string,vertices:array<struct<x:double,y:double>>>"
#: What an image reader gives for a page, vertices as shares of its size.
READINGS = f"doc_id long, page_idx int, paragraphs array<{READING}>, tokens array<{READING}>"
DRAWINGS = (
    "page long, rotation int, mediabox_w double, mediabox_h double, "
    "drawings array<struct<layer:string,color:array<double>,width:double,dashes:string,items:array<struct<kind:string,x0:double,y0:double,x1:double,y1:double>>>>"
)
#: Annotations that are drawn, not said.
VISUAL_ONLY = ("Highlight", "Underline", "Squiggly", "StrikeOut", "Ink", "Line", "Square", "Circle", "Polygon", "PolyLine", "Stamp")
#: What marks a page as relevant to a trade.
FENCE_KEYWORDS = (
    "fence", "fencing", "gate", "barrier", "guardrail", "post", "mesh", "panel", "chain link", "masonry", "fence details", "canopy shading",
    "adot specifications", "mag specifications", "rail", "railing", "bollards", "handrails", "wall", "cmu", "operator", "davis", "bacon",
    "davis-bacon", "davis – bacon", "buy america", "american", "dug out", "door schedule",
)
ELECTRICAL_KEYWORDS = (
    "one line", "one-line", "single line", "single-line", "one line diagram", "available power", "loads", "load schedule", "cable schedule",
    "wire schedule", "conduit schedule", "outlets", "receptacles", "lights", "lighting", "luminaire", "panel schedule", "panelboard schedule",
    "panelboard", "feeder", "circuit", "breaker", "switchgear", "transformer", "grounding",
)
TRADES = {"fence": (FENCE_KEYWORDS, True), "electrical": (ELECTRICAL_KEYWORDS, False)}
DEFAULT_TRADE = "fence"


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def native_lines(pages: DataFrame) -> DataFrame:
    """Text lines of TEXT_PAGES on the displayed page: spans joined by a space, empty lines left out."""
    b = pages.select("doc_id", "page_idx", "rotation", "mediabox_w", "mediabox_h", F.posexplode("blocks").alias("block", "b"))
    l = b.select("doc_id", "page_idx", "rotation", "mediabox_w", "mediabox_h", "block", F.posexplode("b.lines").alias("line", "l"))
    text = F.trim(F.array_join(F.col("l.spans.text"), " "))
    raw = tuple(F.get(F.col("l.bbox"), F.lit(i)) for i in range(4))
    x0, y0, x1, y1 = g.rotated_box(raw, F.col("rotation"), F.col("mediabox_w"), F.col("mediabox_h"))
    return l.select(
        "doc_id", "page_idx", "block", "line", text.alias("text"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"),
        F.lit("pdf_native").alias("source"),
    ).where("text <> ''")


def word_table(files: DataFrame) -> DataFrame:
    """Words of pages keyed by number: ``files`` (doc_id, pages WORD_PAGES)."""
    p = files.select("doc_id", F.explode("pages").alias("page_num", "p"))
    return p.select("doc_id", F.col("page_num").cast("int").alias("page_num"), F.explode("p.words").alias("w")).select("doc_id", "page_num", "w.*")


def page_counts(files: DataFrame) -> DataFrame:
    p = files.select("doc_id", F.explode("pages").alias("page_num", "p"))
    return p.select("doc_id", F.col("page_num").cast("int").alias("page_num"), F.length("p.text").alias("chars"), F.size("p.words").alias("words"))


def _readings(pages: DataFrame, column: str, source: str) -> DataFrame:
    r = pages.select("doc_id", "page_idx", "width", "height", F.posexplode(column).alias("ord", "r"))
    xs, ys = (F.filter(F.col(f"r.vertices.{c}"), lambda v: v.isNotNull()) for c in ("x", "y"))
    w, h = F.col("width"), F.col("height")
    return r.where((F.trim("r.text") != "") & (F.size(xs) > 0) & (F.size(ys) > 0)).select(
        "doc_id", "page_idx", "ord", F.trim("r.text").alias("text"), (F.array_min(xs) * w).alias("x0"), (F.array_min(ys) * h).alias("y0"),
        (F.array_max(xs) * w).alias("x1"), (F.array_max(ys) * h).alias("y1"), F.lit(source).alias("source"),
    )


def read_boxes(readings: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes of READINGS on their pages (width, height): all paragraphs; of tokens the first at each rounded place with
    each text, unless a paragraph is the same."""
    r = readings.join(pages.select("doc_id", "page_idx", "width", "height"), ["doc_id", "page_idx"])
    paragraphs, tokens = _readings(r, "paragraphs", "ocr_paragraph"), _readings(r, "tokens", "ocr_token")
    keyed = lambda df: df.withColumns({"rx": F.bround("x0", 0), "ry": F.bround("y0", 0)})
    keys = ["doc_id", "page_idx", "rx", "ry", "text"]
    new = keyed(tokens).join(keyed(paragraphs).select(*keys).distinct(), keys, "left_anti")
    first = new.groupBy(*keys).agg(F.min_by(F.struct("ord", "x0", "y0", "x1", "y1", "source"), "ord").alias("t"))
    return paragraphs.unionByName(first.select("doc_id", "page_idx", "text", "t.*"))


def vector_lines(pages: DataFrame) -> DataFrame:
    """Line segments of DRAWINGS on the displayed page, numbered in order of drawing."""
    d = pages.select("page", "rotation", "mediabox_w", "mediabox_h", F.posexplode("drawings").alias("d_ord", "d"))
    i = d.select("page", "rotation", "mediabox_w", "mediabox_h", "d_ord", "d.layer", "d.color", "d.width", "d.dashes", F.posexplode("d.items").alias("i_ord", "i"))
    i = i.where("i.kind = 'l'")
    turn = lambda x, y: g.rotated_point(F.col(x), F.col(y), F.col("rotation"), F.col("mediabox_w"), F.col("mediabox_h"))
    (x0, y0), (x1, y1) = turn("i.x0", "i.y0"), turn("i.x1", "i.y1")
    per = i.groupBy("page", "d_ord").agg(F.count("*").alias("n"))
    from pyspark.sql.window import Window

    before = F.coalesce(F.sum("n").over(Window.partitionBy("page").orderBy("d_ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.row_number().over(Window.partitionBy("page", "d_ord").orderBy("i_ord")) - 1
    out = i.withColumn("at", at).join(per.select("page", "d_ord", before.alias("before")), ["page", "d_ord"])
    return out.select(
        "page", (F.col("before") + F.col("at")).alias("line_idx"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"),
        g.distance(x0, y0, x1, y1).alias("length_pts"), F.coalesce("layer", F.lit("")).alias("layer"), "color", "width", "dashes",
    )


def text_annotations(annotations: DataFrame, visual: tuple[str, ...] = VISUAL_ONLY) -> DataFrame:
    """Annotations (annot_type, content, box) with text, as text items."""
    a = annotations.where(~F.col("annot_type").isin(*visual) & (F.coalesce(F.trim("content"), F.lit("")) != ""))
    return a.select("doc_id", "page_idx", F.trim("content").alias("text"), "x0", "y0", "x1", "y1", F.lit("annotation").alias("source"))


def profile_keywords(spark: SparkSession, trades: dict | None = None) -> DataFrame:
    """trade, keyword, kw_ord, supports_measurement."""
    rows = [(t, k, i, m) for t, (ks, m) in (trades or TRADES).items() for i, k in enumerate(ks)]
    return spark.createDataFrame(rows, "trade string, keyword string, kw_ord int, supports_measurement boolean")


def with_profile(df: DataFrame, profiles: DataFrame, default: str = DEFAULT_TRADE) -> DataFrame:
    """``df`` with trade replaced by the default where it's missing or unknown."""
    known = profiles.select(F.col("trade").alias("_known")).distinct()
    j = df.join(known, F.col("trade") == F.col("_known"), "left")
    return j.withColumn("trade", F.coalesce("_known", F.lit(default))).drop("_known")
