"""How good detections are against gold annotations: boxes, pages, lengths, regions, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlens.functions import geometry as g
from sheetlens.plans.greedy import greedy_match
from sheetlens.plans.spatial import grid_join


def gold_boxes(csv: DataFrame) -> DataFrame:
    """Highlight and ink annotations (page, content, bbox text, type_name) with a sound box."""
    b = F.from_json("bbox", "array<double>")
    ok = csv.where(F.col("type_name").isin("Highlight", "Ink")).withColumn("b", b).where(F.size("b") == 4)
    return ok.select(F.col("page").cast("int").alias("page"), "content", *[F.get("b", F.lit(i)).alias(f"g{n}") for i, n in enumerate(("x0", "y0", "x1", "y1"))])


def gold_measures(csv: DataFrame) -> DataFrame:
    """Numeric contents between 0 and 1000 are lengths in feet; of the rest those that name an element, with its code."""
    v = F.col("content").try_cast("double")
    length = F.when((v > 0) & (v < 1000), v)
    named = F.upper("content").rlike("GATE|FENCE|WALL|0113|040[123]")
    code = F.when(F.get(F.split("content", " "), F.lit(0)).rlike("^[03]"), F.get(F.split("content", " "), F.lit(0)))
    return csv.withColumn("length_ft", length).where(length.isNotNull() | named).withColumn("code", F.when(length.isNull(), code))


def content_class(content: Column) -> Column:
    """code (up to ten characters with a digit), description (more than ten) or mixed."""
    n = F.length(F.trim(content))
    return F.when((n <= 10) & content.rlike("[0-9]"), "code").when(n > 10, "description").otherwise("mixed")


def candidates(pred: DataFrame, gold: DataFrame, least: float = 0.1) -> DataFrame:
    a, b = g.box("p"), g.box("g")
    met = grid_join(pred, gold, a, b, g.boxes_touch(a, b), ["page"], 0.0, 100.0)
    return met.withColumn("iou", g.iou(a, b)).where(F.col("iou") >= least).select("page", "pred_id", "gold_id", "iou")


def box_matches(pred: DataFrame, gold: DataFrame, least: float = 0.1) -> DataFrame:
    """One-to-one: predictions in order take the free gold box of the best IoU."""
    return greedy_match(candidates(pred, gold, least), ["page"], "pred_id", "gold_id", "iou")


def _scores(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    nothing = (tp + fp + fn) == 0
    p = F.when(nothing, 1.0).otherwise(F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)))
    r = F.when(nothing, 1.0).otherwise(F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)))
    return {"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))}


def box_metrics(pred: DataFrame, gold: DataFrame, least: float = 0.1) -> DataFrame:
    """Per page tp, fp, fn, precision, recall, f1, avg_iou; a page empty on both sides scores one. page null: all pages."""
    m = box_matches(pred, gold, least).groupBy("page").agg(F.count("*").alias("tp"), F.sum("iou").alias("iou_sum"))
    n = pred.groupBy("page").agg(F.count("*").alias("preds")).join(gold.groupBy("page").agg(F.count("*").alias("golds")), "page", "full")
    per = n.join(m, "page", "left").na.fill(0)
    both = per.rollup("page").agg(F.sum("tp").alias("tp"), F.sum("preds").alias("preds"), F.sum("golds").alias("golds"), F.sum("iou_sum").alias("iou_sum"))
    out = both.withColumns({"fp": F.col("preds") - F.col("tp"), "fn": F.col("golds") - F.col("tp")})
    out = out.withColumns(_scores(F.col("tp"), F.col("fp"), F.col("fn")))
    return out.withColumn("avg_iou", F.coalesce(F.try_divide("iou_sum", "tp"), F.lit(0.0))).drop("iou_sum", "preds", "golds")


def page_confusion(flags: DataFrame) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 and accuracy per document and over all (document null). ``flags`` holds the
    whole universe of pages: document, page_idx, is_gt, is_pred."""
    a, b = F.col("is_gt"), F.col("is_pred")
    counts = {"tp": a & b, "fp": ~a & b, "fn": a & ~b, "tn": ~a & ~b}
    out = flags.rollup("document").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    out = out.withColumns(_scores(F.col("tp"), F.col("fp"), F.col("fn")))
    return out.withColumn("accuracy", F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def retrieval_confusion(flags: DataFrame) -> DataFrame:
    """``page_confusion``'s counts and scores beside those of the text alone (text_found in place of is_pred), and the pages
    read by each method, per document and over all (document null). ``flags``: document, page_idx, is_gt, is_pred, text_found,
    method. A score without anything to divide by is 0."""
    a, b, c = F.col("is_gt"), F.col("is_pred"), F.col("text_found")
    counts = {"tp": a & b, "fp": ~a & b, "fn": a & ~b, "tn": ~a & ~b, "tp_text": a & c, "fp_text": ~a & c, "fn_text": a & ~c}
    counts |= {f"{m}_pages": F.col("method") == m for m in ("comprehensive", "fallback")}
    out = flags.rollup("document").agg(F.count("*").alias("total_pages"), *[F.count_if(x).alias(n) for n, x in counts.items()])
    share = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    for end in ("", "_text"):
        tp, fp, fn = (F.col(f"{n}{end}") for n in ("tp", "fp", "fn"))
        p, r = share(tp, tp + fp), share(tp, tp + fn)
        out = out.withColumns({f"precision{end}": p, f"recall{end}": r, f"f1{end}": share(2 * p * r, p + r)})
    return out.withColumn("accuracy", share(F.col("tp") + F.col("tn"), F.col("total_pages")))


def page_sets(flags: DataFrame) -> DataFrame:
    """Pages found, wrongly found and missed."""
    gt, pr = flags.where("is_gt").select("document", "page_idx"), flags.where("is_pred").select("document", "page_idx")
    sets = {"found": gt.intersect(pr), "wrong": pr.subtract(gt), "missed": gt.subtract(pr)}
    out = None
    for name, df in sets.items():
        one = df.withColumn("kind", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def region_matches(regions: DataFrame, gold: DataFrame, margin: float = 100.0) -> DataFrame:
    """One-to-one: regions (page, region, bx0..by1) in order take the first free gold box whose centre lies in them,
    widened by ``margin``."""
    x, y = g.center(g.box("g"))
    met = grid_join(gold, regions, (x, y, x, y), g.box("b"), g.point_in_box(x, y, g.box("b"), margin), ["page"], margin, 150.0)
    met = met.select("page", "region", "gold_id").distinct().withColumn("score", F.lit(1.0))
    return greedy_match(met, ["page"], "region", "gold_id", "score")


def length_accuracy(found_ft: Column, gold_ft: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(found_ft - gold_ft) / gold_ft)


def detection_metrics(regions: DataFrame, gold: DataFrame, margin: float = 100.0) -> DataFrame:
    """Per page: region precision and recall (one-to-one matches), length accuracy and error of the totals.

    ``regions``: page, region, length_ft, bx0..by1; ``gold``: page, gold_id, length_ft, gx0..gy1; gold without a length is
    left out. Without gold a page scores zero.
    """
    sound = gold.where("length_ft is not null")
    m = region_matches(regions, sound, margin).groupBy("page").agg(F.count("*").alias("matched"))
    d = regions.groupBy("page").agg(F.count("*").alias("regions"), F.sum("length_ft").alias("found_ft"))
    n = sound.groupBy("page").agg(F.count("*").alias("golds"), F.sum("length_ft").alias("gold_ft"))
    out = d.join(n, "page", "full").join(m, "page", "left").na.fill(0)
    share = lambda of: F.coalesce(F.try_divide("matched", of), F.lit(0.0))
    known = F.col("gold_ft") > 0
    acc = F.when(known, length_accuracy(F.col("found_ft"), F.col("gold_ft"))).otherwise(0.0)
    err = F.when(known, F.abs(F.col("found_ft") - F.col("gold_ft")) / F.col("gold_ft") * 100).otherwise(0.0)
    return out.select(
        "page", "regions", "golds", "matched", share("regions").alias("precision"), share("golds").alias("recall"),
        acc.alias("length_accuracy"), err.alias("length_error_pct"),
    )


def found_metrics(regions: DataFrame, gold: DataFrame, margin: float = 100.0) -> DataFrame:
    """Per method and page of ``regions`` (method, page, region, length_ft, bx0..by1): how many ``gold`` boxes with a length
    have their centre in any region, widened by ``margin`` (one region may hold several), recall, and length accuracy and
    error of the totals. Every method is held against all gold, also on pages where it found nothing."""
    sound = gold.where("length_ft is not null")
    x, y = g.center(g.box("g"))
    inside = g.point_in_box(x, y, g.box("b"), margin)
    hit = grid_join(sound.select("page", "gold_id", "gx0", "gy0", "gx1", "gy1"), regions.drop("length_ft"), (x, y, x, y), g.box("b"), inside, ["page"], margin, 150.0, large=True)
    hits = hit.groupBy("method", "page").agg(F.countDistinct("gold_id").alias("matched"))
    found = regions.groupBy("method", "page").agg(F.count("*").alias("regions"), F.sum("length_ft").alias("found_ft"))
    n = sound.groupBy("page").agg(F.count("*").alias("golds"), F.sum("length_ft").alias("gold_ft"))
    methods = regions.select("method").distinct()  # a few names
    every = n.select("page").unionByName(regions.select("page")).distinct().crossJoin(F.broadcast(methods))
    out = every.join(n, "page", "left").join(found, ["method", "page"], "left").join(hits, ["method", "page"], "left").na.fill(0)
    error = F.abs(F.col("found_ft") - F.col("gold_ft")) / F.col("gold_ft") * 100
    known = F.col("gold_ft") > 0
    return out.select(
        "method", "page", "regions", "golds", "matched", F.coalesce(F.try_divide("matched", "golds"), F.lit(0.0)).alias("recall"),
        F.when(known, F.greatest(F.lit(0.0), 1 - error / 100)).otherwise(0.0).alias("length_accuracy"), F.when(known, error).otherwise(0.0).alias("length_error_pct"),
    )


def method_metrics(results: DataFrame) -> DataFrame:
    """Mean accuracy, error and recall per method; best marks the highest mean accuracy. ``results``: method, found_ft,
    gold_ft, matched, golds."""
    acc = length_accuracy(F.col("found_ft"), F.col("gold_ft"))
    err = F.abs(F.col("found_ft") - F.col("gold_ft")) / F.col("gold_ft") * 100
    per = results.groupBy("method").agg(F.avg(acc).alias("accuracy"), F.avg(err).alias("error_pct"), F.avg(F.try_divide("matched", "golds")).alias("recall"))
    best = per.agg(F.max_by("method", F.struct("accuracy", "method")).alias("best"))
    return per.crossJoin(best).select("method", "accuracy", "error_pct", "recall", (F.col("method") == F.col("best")).alias("best"))


def best_source_item(gold: DataFrame, items: DataFrame, least: float = 0.3) -> DataFrame:
    """Per gold box and source the item (item_id, source, sx0..sy1) of the best IoU, ties by id."""
    a, b = g.box("g"), g.box("s")
    met = grid_join(gold, items, a, b, g.boxes_touch(a, b), ["page"], 0.0, 100.0).withColumn("iou", g.iou(a, b)).where(F.col("iou") >= least)
    best = met.groupBy("page", "gold_id", "source").agg(F.min(F.struct((-F.col("iou")).alias("neg"), "item_id")).alias("m"))
    return best.select("page", "gold_id", "source", F.col("m.item_id").alias("item_id"), (-F.col("m.neg")).alias("iou"))


def coverage(gold: DataFrame, matches: DataFrame) -> DataFrame:
    """Per source: gold boxes, matches, average IoU, share matched, and the different codes among what was matched.

    ``gold``: page, gold_id and content, whose short contents with a digit are codes; ``matches``: page, gold_id, source, iou.
    """
    n = gold.agg(F.count("*").alias("golds"))  # one row
    code = F.when(content_class(F.col("content")) == "code", F.trim("content")).alias("code")
    met = matches.join(gold.select("page", "gold_id", code), ["page", "gold_id"])
    per = met.groupBy("source").agg(F.count("*").alias("matched"), F.round(F.avg("iou"), 6).alias("avg_iou"), F.countDistinct("code").alias("codes"))
    return per.crossJoin(n).withColumn("coverage", F.round(F.col("matched") / F.col("golds"), 6))
