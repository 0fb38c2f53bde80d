"""Layout: chunks of a page, tokens inside them, text lines from boxes, merging of two readings of one page.

Tokens have the columns page, tok_ord, text, tx0, ty0, tx1, ty1; chunks page, chunk_ord, chunk_type, chunk_text, cx0..cy1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetlens.functions import geometry as g
from sheetlens.functions import text as t
from sheetlens.plans.spatial import grid_join

LEGEND_WORDS = "legend|keynote|abbreviation|symbols"


def page_chunks(responses: DataFrame, pages: DataFrame) -> DataFrame:
    """Chunks of layout answers (response_id, doc_id, chunks) on their pages (doc_id, page_idx, width, height): page numbers
    from zero or one are told apart per answer, boxes scaled to the page, text is text or else markdown."""
    c = responses.select("response_id", "doc_id", F.explode("chunks").alias("c")).select(
        "response_id", "doc_id", "c.id", "c.type", "c.text", "c.markdown", F.explode("c.grounding").alias("gr")
    )
    base = F.when(F.min("gr.page").over(Window.partitionBy("response_id")) >= 1, 1).otherwise(0)
    c = c.withColumn("page_idx", (F.col("gr.page") - base).cast("int"))
    b = F.col("gr.box")
    return c.join(pages.select("doc_id", "page_idx", "width", "height"), ["doc_id", "page_idx"]).select(
        "doc_id", "page_idx", "id", "type", F.coalesce(F.nullif("text", F.lit("")), "markdown", F.lit("")).alias("text"),
        (b["left"] * F.col("width")).alias("x0"), (b["top"] * F.col("height")).alias("y0"),
        (b["right"] * F.col("width")).alias("x1"), (b["bottom"] * F.col("height")).alias("y1"),
    )


def segmented(chunks: DataFrame) -> DataFrame:
    """Figure chunks whose first 200 characters have no legend word are figures, all others legend."""
    legend = F.lower(F.substring("chunk_text", 1, 200)).rlike(LEGEND_WORDS)
    return chunks.withColumn("segment", F.when((F.col("chunk_type") == "figure") & ~legend, "figure").otherwise("legend"))


#: Chunk types that are drawings, and words that tell a legend in the whole text.
DRAWINGS, WHOLE_TEXT_WORDS = ("figure", "architectural_drawing"), "legend|keynote"


def segmented_three(chunks: DataFrame) -> DataFrame:
    """By an earlier rule, on the whole text: drawings without a legend word are figures, what else has a type or a legend
    word is legend, and chunks without a type and such a word are other."""
    kind = F.lower(F.coalesce("chunk_type", F.lit("")))
    legend = F.lower(F.coalesce("chunk_text", F.lit(""))).rlike(WHOLE_TEXT_WORDS)
    segment = F.when(legend, "legend").when(kind.isin(*DRAWINGS), "figure").when(kind != "", "legend").otherwise("other")
    return chunks.withColumn("segment", segment)


def split_words(blocks: DataFrame) -> DataFrame:
    """Blocks (page, ord, text, x0..y1) as words, each with a share of the width by its length."""
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
    w = blocks.select("page", "ord", "x0", "y0", "x1", "y1", words.alias("words"))
    total = F.greatest(F.aggregate("words", F.lit(0), lambda s, x: s + F.length(x)), F.lit(1))
    w = w.withColumn("total", total).select("page", "ord", "x0", "y0", "x1", "y1", "total", "words", F.posexplode("words").alias("k", "text"))
    before = F.aggregate(F.slice("words", F.lit(1), F.col("k")), F.lit(0), lambda s, x: s + F.length(x))
    at = lambda n: F.col("x0") + n / F.col("total") * (F.col("x1") - F.col("x0"))
    return w.select(
        "page", "ord", "k", "text", at(before).alias("tx0"), F.col("y0").alias("ty0"), at(before + F.length("text")).alias("tx1"), F.col("y1").alias("ty1")
    )


def merged_tokens(native: DataFrame, read: DataFrame) -> DataFrame:
    """All native tokens and those read from the image that aren't at the same rounded place with the same text; of these
    the first of equal ones."""
    key = lambda df: df.withColumns({"rx": F.bround("tx0", 0), "ry": F.bround("ty0", 0)})
    new = key(read).join(key(native).select("page", "rx", "ry", "text").distinct(), ["page", "rx", "ry", "text"], "left_anti")
    first = new.groupBy("page", "rx", "ry", "text").agg(F.min_by(F.struct("tok_ord", "tx0", "ty0", "tx1", "ty1"), "tok_ord").alias("t"))
    cols = ["page", "tok_ord", "text", "tx0", "ty0", "tx1", "ty1"]
    return native.select(*cols).unionByName(first.select("page", "text", "t.*").select(*cols))


def tokens_in(tokens: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pairs of tokens and chunks that hold their centre, borders included; once for each such chunk."""
    x, y = g.center(g.box("t"))
    return grid_join(tokens, chunks, (x, y, x, y), g.box("c"), g.point_in_box(x, y, g.box("c")), ["page"], 0.0, 100.0)


def smallest_chunk(tokens: DataFrame, chunks: DataFrame) -> DataFrame:
    met = tokens_in(tokens, chunks).withColumn("a", g.area(g.box("c")))
    return met.groupBy("page", "tok_ord").agg(F.min(F.struct("a", "chunk_ord")).alias("m")).select("page", "tok_ord", F.col("m.chunk_ord").alias("chunk_ord"))


def overlapping(tokens: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pairs that overlap, with the share of the token and of the chunk that they have in common."""
    a, b = g.box("t"), g.box("c")
    met = grid_join(tokens, chunks, a, b, g.boxes_touch(a, b), ["page"], 0.0, 100.0)
    return met.withColumns({"token_overlap": g.overlap_of_own(a, b), "chunk_overlap": g.overlap_of_own(b, a), "iou": g.iou(a, b)})


def best_chunk(tokens: DataFrame, chunks: DataFrame, least: float = 0.1) -> DataFrame:
    """Every token with the chunk of the best score, null where none overlaps enough: twice IoU, one if the token lies
    inside, half the token's and 0.3 of the chunk's overlap."""
    met = overlapping(tokens, chunks).where(F.col("token_overlap") >= least)
    x, y = g.center(g.box("t"))
    inside = g.point_in_box(x, y, g.box("c")).cast("int")
    score = 2 * F.col("iou") + inside + 0.5 * F.col("token_overlap") + 0.3 * F.col("chunk_overlap")
    best = met.withColumn("score", score).groupBy("page", "tok_ord").agg(
        F.min(F.struct((-F.col("score")).alias("neg"), "chunk_ord", "chunk_type", "token_overlap", "iou", inside.alias("inside"))).alias("m")
    )
    best = best.select("page", "tok_ord", (-F.col("m.neg")).alias("score"), "m.chunk_ord", "m.chunk_type", "m.token_overlap", "m.iou", "m.inside")
    return tokens.join(best, ["page", "tok_ord"], "left")


def tag_quality(tagged: DataFrame) -> DataFrame:
    return tagged.where("chunk_type is not null").groupBy("chunk_type").agg(
        F.count("*").alias("tokens"), F.round(F.avg("token_overlap"), 4).alias("overlap"), F.round(F.avg("iou"), 6).alias("iou"),
        F.round(100 * F.avg("inside"), 2).alias("inside_pct"),
    )


#: Tags with less overlap of the token or a smaller IoU are doubtful.
DOUBTFUL_OVERLAP, DOUBTFUL_IOU = 0.3, 0.2


def doubtful_tags(tagged: DataFrame) -> DataFrame:
    """Tagged tokens (of ``best_chunk``) whose tag is doubtful: little overlap, a small IoU, or the token's centre outside."""
    weak = (F.col("token_overlap") < DOUBTFUL_OVERLAP) | (F.col("iou") < DOUBTFUL_IOU) | (F.col("inside") == 0)
    return tagged.where(F.col("chunk_type").isNotNull() & weak)


def merged_readings(pdf: DataFrame, read: DataFrame, overlap: float = 0.3, alike: float = 0.7) -> DataFrame:
    """Two readings (page, tok_ord, text, box) as one: a read token joins the first pdf token that it overlaps and
    resembles enough; a pdf token takes the union box and the longest text of those that join it; the rest stay."""
    r = read.select("page", F.col("tok_ord").alias("r_ord"), F.col("text").alias("r_text"), *[F.col(f"t{c}").alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")])
    a, b = g.box("t"), g.box("r")
    met = grid_join(pdf, r, a, b, g.boxes_touch(a, b), ["page"], 0.0, 60.0)
    met = met.where((g.overlap_of_smaller(a, b) >= overlap) & (t.similarity(F.col("text"), F.col("r_text")) >= alike))
    used = met.groupBy("page", "r_ord").agg(F.min("tok_ord").alias("tok_ord"))
    joined = used.join(r, ["page", "r_ord"])
    per = joined.groupBy("page", "tok_ord").agg(
        F.min("rx0").alias("mx0"), F.min("ry0").alias("my0"), F.max("rx1").alias("mx1"), F.max("ry1").alias("my1"),
        F.min(F.struct((-F.length("r_text")).alias("n"), "r_ord", "r_text")).alias("long"),
    )
    p = pdf.join(per, ["page", "tok_ord"], "left")
    longer = F.coalesce(-F.col("long.n") > F.length("text"), F.lit(False))
    p = p.select(
        "page", F.lit("pdf").alias("source"), "tok_ord", F.when(longer, F.col("long.r_text")).otherwise(F.col("text")).alias("text"),
        F.least("tx0", "mx0").alias("x0"), F.least("ty0", "my0").alias("y0"), F.greatest("tx1", "mx1").alias("x1"), F.greatest("ty1", "my1").alias("y1"),
        F.col("mx0").isNotNull().alias("merged"),
    )
    rest = r.join(used, ["page", "r_ord"], "left_anti")
    rest = rest.select("page", F.lit("ocr").alias("source"), F.col("r_ord").alias("tok_ord"), F.col("r_text").alias("text"), F.col("rx0").alias("x0"), F.col("ry0").alias("y0"), F.col("rx1").alias("x1"), F.col("ry1").alias("y1"), F.lit(False).alias("merged"))
    return p.unionByName(rest)


def without_repeats(read: DataFrame, have: DataFrame, overlap: float = 0.3, alike: float = 0.8) -> DataFrame:
    """``read`` tokens without those whose text is among ``have`` on the page, or that overlap a similar one."""
    new = read.join(have.select("page", "text").distinct(), ["page", "text"], "left_anti")
    h = have.select("page", F.col("text").alias("h_text"), *[F.col(f"t{c}").alias(f"h{c}") for c in ("x0", "y0", "x1", "y1")])
    a, b = g.box("t"), g.box("h")
    near = g.boxes_touch(a, b) & (g.overlap_of_smaller(a, b) > overlap) & (t.letter_similarity(F.col("text"), F.col("h_text")) > alike)
    hit = grid_join(new, h, a, b, near, ["page"], 0.0, 60.0).select("page", "tok_ord").distinct()
    return new.join(hit, ["page", "tok_ord"], "left_anti")


def text_rows(tokens: DataFrame, gap: float = 5.0) -> DataFrame:
    """Tokens with line_no: in order of y and x, a new line where y jumps by more than ``gap``."""
    w = Window.partitionBy("page").orderBy("ty0", "tx0", "tok_ord")
    jump = F.coalesce((F.col("ty0") - F.lag("ty0").over(w)) > gap, F.lit(False)).cast("int")
    return tokens.withColumn("_j", jump).withColumn("line_no", F.sum("_j").over(w)).drop("_j")


def row_text(rows: DataFrame) -> DataFrame:
    """Text and box of each line of ``text_rows``."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("tx0", "tok_ord", "text"))), lambda s: s["text"])
    return rows.groupBy("page", "line_no").agg(
        F.array_join(said, " ").alias("text"), F.min("tx0").alias("x0"), F.min("ty0").alias("y0"), F.max("tx1").alias("x1"), F.max("ty1").alias("y1")
    )


def chunk_text(tokens: DataFrame, chunks: DataFrame) -> DataFrame:
    """The text of each chunk: its tokens' texts in order."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("tok_ord", "text"))), lambda s: s["text"])
    return tokens_in(tokens, chunks).groupBy("page", "chunk_ord").agg(F.array_join(said, " ").alias("text"))


def region_text(read: DataFrame, words: DataFrame, chunks: DataFrame) -> DataFrame:
    """The text of each legend chunk: first what was read from the image inside it, then the native words, each in order."""
    legend = segmented(chunks).where("segment = 'legend'").drop("segment")
    both = read.withColumn("_rank", F.lit(0)).unionByName(words.withColumn("_rank", F.lit(1)))
    said = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "tok_ord", "text"))), lambda s: s["text"])
    return tokens_in(both, legend).groupBy("page", "chunk_ord").agg(F.array_join(said, " ").alias("text"))


def item_sizes(tokens: DataFrame) -> DataFrame:
    x, y = g.center(g.box("t"))
    return tokens.select("page", "tok_ord", "text", (F.col("tx1") - F.col("tx0")).alias("width"), (F.col("ty1") - F.col("ty0")).alias("height"), x.alias("cx"), y.alias("cy"), g.area(g.box("t")).alias("area"))
