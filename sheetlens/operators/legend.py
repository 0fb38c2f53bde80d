"""Legends and indicators: where entries stand, which tokens are instances, names from model answers against known ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetlens.functions import geometry as g
from sheetlens.functions import text as t
from sheetlens.plans.contain import either_way, holding
from sheetlens.plans.graph import stored
from sheetlens.plans.greedy import rejected
from sheetlens.plans.spatial import grid_join

#: What stands for no indicator.
EMPTY_MARKS = ("", ".", "-", "*", "•", "·", "(bullet point)", "bullet point")
LEGEND_MARGIN, NEAR, SAME_BOX = 20.0, 30.0, 5.0


def cleaned(entries: DataFrame) -> DataFrame:
    """Entries without those whose indicator is their keyword or a heading; of equal indicator and keyword (any case) the
    longest description, then the first."""
    e = entries.where((F.col("indicator") != F.col("keyword")) & (F.lower("indicator") != "indicator code"))
    w = Window.partitionBy("page", "indicator", F.upper("keyword")).orderBy(F.desc(F.length(F.coalesce("description", F.lit("")))), "leg_ord")
    return e.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def with_quality_gate(entries: DataFrame, figure_entries: DataFrame, read_lines: DataFrame, least: int = 3, most: int = 50) -> DataFrame:
    """Pages with fewer than ``least`` good entries also use those found in figures, and if that isn't enough the first
    ``most`` lines with a keyword."""
    good = ~F.trim("indicator").isin(*EMPTY_MARKS)
    enough = entries.groupBy("page").agg(F.count_if(good).alias("n")).where(F.col("n") >= least).select("page")
    more = figure_entries.join(enough, "page", "left_anti")
    both = entries.unionByName(more, allowMissingColumns=True)
    then = both.groupBy("page").agg(F.count_if(good).alias("n")).where(F.col("n") >= least).select("page")
    first = read_lines.withColumn("_r", F.row_number().over(Window.partitionBy("page").orderBy("leg_ord"))).where(F.col("_r") <= most)
    return both.unionByName(first.drop("_r").join(then, "page", "left_anti"), allowMissingColumns=True)


def wanted_keys(legend: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Spellings by which tokens name an indicator: key, indicator, rank (as is, in brackets, without signs, dotted).

    ``by`` are further columns that tell legends apart, such as the document.
    """
    by = by or []
    ind = F.trim("indicator")
    l = legend.where(ind != "").select(*by, ind.alias("indicator")).distinct()
    plain = F.regexp_replace("indicator", r"[^\p{L}\p{N}_]", "")
    ok = (plain != "") & (plain != F.col("indicator")) & ~plain.rlike("^[0-9]+$")
    key = lambda k, r, c=None: F.when(F.lit(True) if c is None else c, F.struct(k.alias("key"), F.lit(r).alias("rank")))
    bracket = lambda x, a, b: F.concat(F.lit(a), x, F.lit(b))
    x = F.col("indicator")
    keys = F.array_compact(
        F.array(
            key(x, 0), key(bracket(x, "(", ")"), 1), key(bracket(x, "[", "]"), 1),
            key(plain, 2, ok), key(bracket(plain, "(", ")"), 2, ok), key(bracket(plain, "[", "]"), 2, ok),
        )
    )
    return l.select(*by, "indicator", F.explode(keys).alias("k")).select(*by, "indicator", "k.key", "k.rank")


def matched_tokens(tokens: DataFrame, legend: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Tokens that name an indicator: exact, in brackets, without signs, then by dotted number; ties by name."""
    by = by or []
    own = tokens.withColumn("key", F.trim("text")).where("key <> ''")
    a = own.join(wanted_keys(legend, by), [*by, "key"])
    norm = legend.select(*by, F.trim("indicator").alias("indicator"), t.dotted(F.trim("indicator")).alias("key"), F.lit(3).alias("rank")).distinct()
    b = own.withColumn("key", t.dotted(t.bare(F.col("text")))).join(norm, [*by, "key"])
    met = a.select(*tokens.columns, "indicator", "rank").unionByName(b.select(*tokens.columns, "indicator", "rank"))
    return met.groupBy(*tokens.columns).agg(F.min(F.struct("rank", "indicator")).alias("m")).select(*tokens.columns, F.col("m.indicator").alias("indicator"))


def outside_legend(tokens: DataFrame, legend_boxes: DataFrame, margin: float = LEGEND_MARGIN) -> DataFrame:
    """Tokens whose centre isn't in a legend box (page, lx0..ly1) widened by ``margin``."""
    x, y = g.center(g.box("t"))
    hit = grid_join(tokens, legend_boxes, (x, y, x, y), g.box("l"), g.point_in_box(x, y, g.box("l"), margin), ["page"], margin, 100.0)
    return tokens.join(hit.select("page", "tok_ord").distinct(), ["page", "tok_ord"], "left_anti")


def _first_kept(items: DataFrame, keys: list[str], order: str, box: tuple[Column, ...], margin: float, cell: float, clash: Column) -> DataFrame:
    """``items`` (keys, order, columns) that clash with none kept before, in order. ``clash`` is the test on the columns of
    two items, with the prefixes k_ (the earlier one) and i_. Equal items must clash: only the first of them goes further."""
    same = [c for c in items.columns if c not in (*keys, order)]
    own = stored(items.groupBy(*keys, *same).agg(F.min(order).alias(order)))
    side = lambda p: own.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in (order, *same)])
    at = lambda p: tuple(F.col(f"{p}_{c}") for c in box)
    later = F.col(f"k_{order}") < F.col(f"i_{order}")
    met = grid_join(side("k"), side("i"), at("k"), at("i"), later & clash, keys, margin, cell, large=True)
    gone = rejected(met.select(*keys, F.col(f"k_{order}").cast("long").alias("a"), F.col(f"i_{order}").cast("long").alias("b")), keys)
    gone = gone.select(*keys, F.col("node").cast(items.schema[order].dataType).alias(order))
    return own.join(gone, [*keys, order], "left_anti").select(*items.columns)


def apart(items: DataFrame, keys: list[str], order: str, x: str, y: str, near: float = NEAR) -> DataFrame:
    """Of the items of one indicator, in order, those not within ``near`` (both axes) of one kept before."""
    close = (F.abs(F.col(f"k_{x}") - F.col(f"i_{x}")) < near) & (F.abs(F.col(f"k_{y}") - F.col(f"i_{y}")) < near)
    items, placed = items.select(*keys, order, x, y), F.col(x).isNotNull() & F.col(y).isNotNull()
    return _first_kept(items.where(placed), keys, order, (x, y, x, y), near, near, close).unionByName(items.where(~placed))


def distinct_boxes(boxes: DataFrame, keys: list[str], order: str, least: float = 0.85) -> DataFrame:
    """Boxes x0..y1, in order, that have an IoU under ``least`` with all kept before. A box without an area has none with any."""
    of = lambda p: tuple(F.col(f"{p}_{c}") for c in ("x0", "y0", "x1", "y1"))
    boxes = boxes.select(*keys, order, "x0", "y0", "x1", "y1")
    solid = F.coalesce((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")), F.lit(False))
    kept = _first_kept(boxes.where(solid), keys, order, ("x0", "y0", "x1", "y1"), 0.0, 50.0, g.iou(of("k"), of("i")) >= least)
    return kept.unionByName(boxes.where(~solid))


def located(entries: DataFrame, lines: DataFrame, target: Column, margin: float = 15.0, page_wide: float = 5000.0) -> DataFrame:
    """Each entry's first line (page, source_rank, ord, text, x0..y1) whose letters and digits hold the target's, inside
    the entry's chunk (cx0..cy1) or anywhere if the chunk is wider than ``page_wide``: entry's leg_ord and the box."""
    e = entries.withColumn("_t", t.alnum_lower(target)).where("_t <> ''").select("page", "leg_ord", "_t", "cx0", "cy0", "cx1", "cy1")
    x, y = g.center(g.box())
    inside = (F.col("cx1") > page_wide) | g.point_in_box(x, y, g.box("c"), margin)
    said = lines.withColumn("_n", t.alnum_lower(F.col("text")))
    # Shuffled: entries and lines of all pages are much larger in memory than the files they come from.
    met = e.hint("merge").join(holding(said, e, ["page"], "_n", "_t"), ["page", "_t"]).hint("merge").join(said, ["page", "_n"]).where(inside)
    best = met.groupBy("page", "leg_ord").agg(F.min(F.struct("source_rank", "ord", "x0", "y0", "x1", "y1")).alias("m"))
    return best.select("page", "leg_ord", "m.x0", "m.y0", "m.x1", "m.y1")


def located_entries(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """Description boxes: by full text, else its first four words, else page-wide by full text. attempt tells which."""
    words = F.array_join(F.slice(F.split("description", r"\s+"), 1, 4), " ")
    wide = entries.withColumn("cx1", F.lit(9999.0))
    whole = F.col("description")
    tries = [located(entries, lines, whole), located(entries, lines, words), located(wide, lines, whole)]
    out = None
    for i, found in enumerate(tries):
        one = found.withColumn("attempt", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("page", "leg_ord").agg(F.min(F.struct("attempt", "x0", "y0", "x1", "y1")).alias("m")).select("page", "leg_ord", "m.*")


def located_indicators(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """Indicator boxes: in the entry's chunk, else page-wide."""
    wide = located(entries.withColumn("cx1", F.lit(9999.0)), lines, F.col("indicator")).withColumn("attempt", F.lit(1))
    both = located(entries, lines, F.col("indicator")).withColumn("attempt", F.lit(0)).unionByName(wide)
    return both.groupBy("page", "leg_ord").agg(F.min(F.struct("attempt", "x0", "y0", "x1", "y1")).alias("m")).select("page", "leg_ord", "m.*")


def without_own_description(indicator_boxes: DataFrame, description_boxes: DataFrame, near: float = SAME_BOX) -> DataFrame:
    """Indicator boxes that aren't within ``near`` of their entry's description box."""
    d = description_boxes.select("page", "leg_ord", F.col("x0").alias("dx0"), F.col("y0").alias("dy0"))
    same = (F.abs(F.col("x0") - F.col("dx0")) < near) & (F.abs(F.col("y0") - F.col("dy0")) < near)
    return indicator_boxes.join(d, ["page", "leg_ord"], "left").where(~F.coalesce(same, F.lit(False))).drop("dx0", "dy0")


def row_matches(rows: DataFrame, targets: list[str]) -> DataFrame:
    """Text lines (page, line_no, words: ordered array of text and box) where neighbouring words together are the target,
    whatever their number, or else a word holds it: box of the words that match.

    Only letters and digits count, so words without any are passed over. Every word that is left gives a letter or digit at
    least, so no run is longer than the target.
    """
    norm = lambda c: t.alnum_lower(c)
    wanted = ["".join(ch for ch in target.lower() if ch.isascii() and ch.isalnum()) for target in targets]
    told = F.filter(F.transform("words", lambda w: F.struct(norm(w["text"]).alias("n"), w.alias("w"))), lambda x: x["n"] != "")
    r = rows.select("page", "line_no", told.alias("told"))
    pairs = F.array(*[F.struct(F.lit(i).alias("target"), F.lit(w).alias("want")) for i, w in enumerate(wanted) if w])
    r = r.select("page", "line_no", "told", F.explode(pairs).alias("t")).select("page", "line_no", "told", "t.*")
    r = r.where(F.contains(F.array_join(F.transform("told", lambda x: x["n"]), ""), F.col("want")))
    n = F.size("told")
    run = lambda a: F.filter(
        F.transform(F.sequence(F.lit(1), F.least(F.length("want"), n - a + 1)), lambda k: F.slice("told", a, k)),
        lambda s: F.array_join(F.transform(s, lambda x: x["n"]), "") == F.col("want"),
    )
    hits = F.flatten(F.transform(F.sequence(F.lit(1), n), run))
    one = F.filter("told", lambda x: F.contains(x["n"], F.col("want")))
    r = r.withColumn("hit", F.get(hits, F.lit(0))).withColumn("one", one)
    r = r.withColumn("_w", F.when(F.col("hit").isNotNull(), F.col("hit")).when(F.size("one") > 0, F.col("one"))).where("_w is not null")
    low = lambda f: F.array_min(F.transform("_w", lambda x: x["w"][f]))
    high = lambda f: F.array_max(F.transform("_w", lambda x: x["w"][f]))
    return r.select("page", "line_no", "target", low("x0").alias("x0"), low("y0").alias("y0"), high("x1").alias("x1"), high("y1").alias("y1"))


def phrase_tokens(tokens: DataFrame, phrase: str, regions: DataFrame | None = None) -> DataFrame:
    """Places where neighbouring tokens of a page, in order, are the words of ``phrase``: box, without repeats at two
    decimals. With ``regions`` (page, rx0..ry1) only tokens with their centre in one count."""
    words = phrase.lower().split()
    if regions is not None:
        x, y = g.center(g.box("t"))
        tokens = grid_join(tokens, regions, (x, y, x, y), g.box("r"), g.point_in_box(x, y, g.box("r")), ["page"], 0.0, 100.0, "left_semi", large=True)
    w = Window.partitionBy("page").orderBy("tok_ord")
    nth = lambda c, i: F.lead(c, i).over(w) if i else F.col(c)
    same = F.lit(True)
    for i, word in enumerate(words):
        same = same & (F.lower(F.regexp_replace(nth("text", i), r"[^\p{L}\p{N}_]", "")) == word)
    fold = lambda f, c: f(*[nth(c, i) for i in range(len(words))]) if len(words) > 1 else F.col(c)
    box = {"x0": fold(F.least, "tx0"), "y0": fold(F.least, "ty0"), "x1": fold(F.greatest, "tx1"), "y1": fold(F.greatest, "ty1")}
    hit = tokens.select("page", same.alias("hit"), *[F.round(c, 2).alias(n) for n, c in box.items()])
    return hit.where("hit").drop("hit").distinct()


def indicator_words(read: DataFrame, words: DataFrame, indicator: str) -> DataFrame:
    """Tokens that hold ``indicator`` as a whole word, those read from the image first and the native ones only on pages
    where no such is found: page, source, box, without repeats at two decimals."""
    edge = r"[\p{L}\p{N}_]"
    pattern = rf"(?<!{edge})\Q{indicator}\E(?!{edge})"
    box = [F.round(f"t{c}", 2).alias(c) for c in ("x0", "y0", "x1", "y1")]
    of = lambda df, s: df.where(F.col("text").rlike(pattern)).select("page", F.lit(s).alias("source"), *box).distinct()
    first = of(read, "ocr")
    return first.unionByName(of(words, "words").join(first.select("page").distinct(), "page", "left_anti"))


def spans(lines: DataFrame, phrases: list[str]) -> DataFrame:
    """Keyword spans on lines (page, line_no, words array<string>): start, end. Longer phrases take their words first, and
    no word belongs to two spans."""
    lists = sorted((p.lower().split() for p in phrases), key=lambda p: (-len(p), p))
    start = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, p: Column) -> Column:
        size = p["n"]
        fits = F.slice(F.col("words"), p["at"], size) == p["words"]
        end = p["at"] + size - 1
        free = ~F.exists(acc, lambda s: (s["start"] <= end) & (p["at"] <= s["end"]))
        return F.when(fits & free, F.array_append(acc, F.struct(p["at"].alias("start"), end.alias("end")))).otherwise(acc)

    def places(p: list[str]) -> Column:
        last = F.greatest(F.size("words") - len(p) + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda at: F.struct(at.alias("at"), F.lit(len(p)).alias("n"), F.lit(p).alias("words")))

    tries = F.flatten(F.array(*[places(p) for p in lists]))
    return lines.select("page", "line_no", F.explode(F.aggregate(tries, start, step)).alias("s")).select("page", "line_no", "s.start", "s.end")


def widened_spans(found: DataFrame, lines: DataFrame, context: int = 2) -> DataFrame:
    n = lines.select("page", "line_no", F.size("words").alias("n"))
    return found.join(n, ["page", "line_no"]).select(
        "page", "line_no", F.greatest(F.col("start") - context, F.lit(1)).alias("start"), F.least(F.col("end") + context, F.col("n")).alias("end")
    )


def span_boxes(found: DataFrame, tokens: DataFrame, pad: float = 1.0, most_height: float = 1.6, gap: float = 0.9, most_width: float = 200.0) -> DataFrame:
    """Boxes of spans (page, line_no, start, end) over their line's tokens (page, line_no, k from one, text, tx0..ty1).

    A span is cut where the space between two tokens is wider than 2.5 * ``gap`` median letters of the line, and again
    before a token that would make a part wider than ``most_width`` in token widths. A part's box is that of its tokens,
    at most ``most_height`` median heights high around its middle, widened by ``pad``: page, line_no, start, part, text, box.
    """
    line = ["page", "line_no"]
    letters = (F.col("tx1") - F.col("tx0")) / F.length("text")
    medians = tokens.groupBy(*line).agg(
        F.coalesce(F.median(F.when(F.length("text") > 0, letters)), F.lit(8.0)).alias("letter"),
        F.median(F.greatest(F.lit(1.0), F.col("ty1") - F.col("ty0"))).alias("high"),
    )
    t = tokens.withColumn("before", F.lag("tx1").over(Window.partitionBy(*line).orderBy("k")))
    t = found.join(t, line).where("k BETWEEN start AND end").join(medians, line)
    span = Window.partitionBy(*line, "start", "end").orderBy("k")
    cut = (F.col("k") > F.col("start")) & (F.col("tx0") - F.col("before") > gap * 2.5 * F.col("letter"))
    t = t.withColumn("seg", F.sum(cut.cast("int")).over(span))
    item = F.struct("k", "text", *[F.col(f"t{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])
    keys = [*line, "start", "end", "seg"]
    per = t.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"), F.first("high").alias("high"))  # a span's tokens
    width = lambda a: F.array_max(F.transform(a, lambda x: x["x1"])) - F.array_min(F.transform(a, lambda x: x["x0"]))
    start = F.struct(F.lit(0).alias("part"), F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("parts"))

    def step(acc: Column, x: Column) -> Column:
        w = x["x1"] - x["x0"]
        new = (F.size(acc["parts"]) > 0) & (acc["sum"] + w > most_width)
        part = acc["part"] + new.cast("int")
        return F.struct(part.alias("part"), F.when(new, w).otherwise(acc["sum"] + w).alias("sum"), F.array_append(acc["parts"], part).alias("parts"))

    parts = F.when(width(F.col("items")) > most_width, F.aggregate("items", start, step, lambda a: a["parts"])).otherwise(F.transform("items", lambda x: F.lit(0)))
    one = per.withColumn("z", F.explode(F.arrays_zip(F.col("items").alias("x"), parts.alias("part")))).select(*keys, "high", "z.part", "z.x")
    box = one.groupBy(*keys, "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x.k", "x.text"))), lambda s: s["text"]), " ").alias("text"),
        F.min("x.x0").alias("x0"), F.min("x.y0").alias("y0"), F.max("x.x1").alias("x1"), F.max("x.y1").alias("y1"), F.first("high").alias("high"),
    )
    half = F.least(F.col("y1") - F.col("y0"), most_height * F.col("high")) / 2
    mid = (F.col("y0") + F.col("y1")) / 2
    number = F.row_number().over(Window.partitionBy(*line, "start").orderBy("seg", "part")) - 1
    return box.select(*line, "start", number.alias("part"), "text", (F.col("x0") - pad).alias("x0"), (mid - half - pad).alias("y0"), (F.col("x1") + pad).alias("x1"), (mid + half + pad).alias("y1"))


def known_layers(answers: DataFrame, layers: DataFrame) -> DataFrame:
    """Layer names from answers (page, name): those that exist, else those that hold or are held by the name."""
    a, b = answers.withColumn("_a", F.upper("name")), layers.withColumn("_b", F.upper("layer"))
    j = a.join(either_way(a, b, ["page"], "_a", "_b"), ["page", "_a"]).join(b, ["page", "_b"])
    met = j.withColumn("exact", F.col("name") == F.col("layer"))
    has = met.where("exact").select("page", "name").distinct().withColumn("has", F.lit(True))
    out = met.join(has, ["page", "name"], "left").where(F.col("exact") | F.col("has").isNull())
    return out.select("page", "layer").distinct()


def known_names(answers: DataFrame, known: DataFrame, fallback_first: bool = False, by: tuple[str, ...] = ("document",)) -> DataFrame:
    """Answers (``by``, name) to the known names (``by``, known, known_ord) of their own document or page: equal in any
    case, else containing either way, else with ``fallback_first`` the first known name, else none."""
    by = list(by)
    own = answers.select(*by, "name").distinct()
    a, b = own.withColumn("_a", F.lower("name")), known.withColumn("_b", F.lower("known"))
    met = a.join(either_way(a, b, by, "_a", "_b"), [*by, "_a"]).join(b, [*by, "_b"])
    best = met.groupBy(*by, "name").agg(F.min(F.struct((F.col("_a") != F.col("_b")).alias("part"), "known_ord", "known")).alias("m"))
    best = best.select(*by, "name", F.col("m.known").alias("known"))
    if not fallback_first:
        return best
    first = known.groupBy(*by).agg(F.min(F.struct("known_ord", "known")).alias("f")).select(*by, F.col("f.known").alias("_first"))
    out = own.join(best, [*by, "name"], "left").join(first, by)  # a row for each group
    return out.select(*by, "name", F.coalesce("known", "_first").alias("known"))
