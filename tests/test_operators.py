"""Operators on small literal cases."""

import math

import pytest
from pyspark.sql import functions as F

from sheetlens.functions import geometry as g
from sheetlens.functions import scale as sc
from sheetlens.functions import text as t
from sheetlens.operators import evaluation, layout, legend, lines, pages, records, reports, voting
from sheetlens.plans.fold import packed
from sheetlens.plans.graph import connected
from sheetlens.plans.spatial import grid_join

LINE = "page long, line_idx long, x0 double, y0 double, x1 double, y1 double, length_pts double, layer string"


def line_table(spark, rows):
    made = [(1, i, *map(float, r[:4]), math.dist(r[:2], r[2:4]), r[4] if len(r) > 4 else "A") for i, r in enumerate(rows)]
    return spark.createDataFrame(made, LINE)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_lengths_and_segments(spark):
    box = lambda *v: tuple(F.lit(float(x)) for x in v)
    r = one(
        spark, g.length(box(0, 0, 3, 4)).alias("a"), g.segment_distance(F.lit(5.0), F.lit(5.0), box(0, 0, 10, 0)).alias("b"),
        g.segment_distance(F.lit(3.0), F.lit(4.0), box(0, 0, 0, 0)).alias("c"), g.points_per_foot(F.lit(360.0)).alias("d"),
        g.points_per_foot(F.lit(None)).alias("e"), g.points_per_foot(F.lit(-1.0)).alias("f"),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (5.0, 5.0, 5.0, 2.4, 2.4, 2.4)


@pytest.mark.parametrize("rotation", [0, 90, 180, 270])
def test_rotation_has_an_inverse(spark, rotation):
    w, h, r = F.lit(100.0), F.lit(200.0), F.lit(rotation)
    x, y = g.rotated_point(F.lit(10.0), F.lit(20.0), r, w, h)
    bx, by = g.unrotated_point(x, y, r, w, h)
    got = one(spark, x.alias("x"), y.alias("y"), bx.alias("bx"), by.alias("by"))
    assert (got.bx, got.by) == (10.0, 20.0)
    assert (got.x, got.y) == {0: (10, 20), 90: (180, 10), 180: (90, 180), 270: (20, 90)}[rotation]


def test_boxes(spark):
    a, b = tuple(F.lit(float(x)) for x in (0, 0, 10, 10)), tuple(F.lit(float(x)) for x in (5, 0, 15, 10))
    r = one(spark, g.iou(a, b).alias("iou"), g.overlap_of_smaller(a, b).alias("s"), g.overlap_of_own(a, b).alias("o"))
    assert (round(r.iou, 6), r.s, r.o) == (0.333333, 0.5, 0.5)


def test_totals_at_scale_thirty(spark):
    r = lines.totals(line_table(spark, [(0, 0, 10, 0, "A"), (0, 0, 20, 0, "B")]), ["page"], 30.0).first()
    assert (r.segments, r.total_pts) == (2, 30.0)
    assert (round(r.total_inches, 9), round(r.scaled_inches, 9), round(r.total_feet, 9)) == (round(30 / 72, 9), 12.5, round(12.5 / 12, 9))


def test_runs_connect_close_ends(spark):
    df = line_table(spark, [(0, 0, 10, 0), (10, 0, 20, 0), (50, 50, 60, 50)])
    assert sorted(r["count"] for r in lines.runs(df, 1.0).groupBy("run").count().collect()) == [1, 2]
    apart = line_table(spark, [(0, 0, 10, 0), (12, 0, 20, 0)])
    assert lines.runs(apart, 2.0).select("run").distinct().count() == 2  # strictly closer
    assert lines.runs(apart, 2.1).select("run").distinct().count() == 1


def test_components_in_groups(spark):
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(40)] + [(2, 5, 6), (2, 6, 9), (2, 20, 21)], "k long, a long, b long")
    got = {(r.k, r.node): r.component for r in connected(edges, ["k"]).collect()}
    assert all(got[1, i] == 0 for i in range(41))
    assert (got[2, 9], got[2, 21]) == (5, 20)


@pytest.mark.parametrize(
    "text, want",
    [("1:100", None), ("SCALE: 1:100", 100.0), ("SCALE: 1/8\" = 1'-0\"", 96.0), ("SCALE: 1\" = 30'-0\"", 360.0), ("1\" = 20'", 240.0), ("garbage", None), ("", None)],
)
def test_scales(spark, text, want):
    r = one(spark, sc.scale_from_text(F.lit(text)).alias("s")).s
    assert (r.scale if r else None) == want


def test_old_scale_order(spark):
    of = lambda s: one(spark, sc.scale_in_old_order(F.lit(s)).alias("s")).s
    assert (of("1:100"), of("SCALE: 1/8\" = 1'-0\""), of("1\" = 30'"), of("x")) == (100.0, 8.0, 360.0, None)


def test_text_forms(spark):
    r = one(
        spark, t.dotted(F.lit("02.03")).alias("a"), t.dotted(F.lit("0.A1.00")).alias("b"), t.bare(F.lit("([2.9])")).alias("c"),
        t.alnum_lower(F.lit("F-1 (b)")).alias("d"), t.confusable(F.lit("O I l B S")).alias("e"), t.similarity(F.lit("gate"), F.lit("Gates")).alias("f"),
        t.has_keyword(F.lit("two Gates."), "gate").alias("g"), t.has_keyword(F.lit("aggregate"), "gate").alias("h"), t.has_keyword(F.lit("égate"), "gate").alias("i"),
        t.snippet(F.lit("abc fence def"), "fence", 2).alias("j"),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i, r.j) == ("2.3", "0.A1.0", "2.9", "f1b", "01185", 0.8, True, False, False, "c fence d")
    rows = spark.createDataFrame([("Chain-Link",), (" screen wall ",), ("rail posts",), ("gate",), ("",), (None,)], "keyword string")
    got = [r.s for r in rows.select(t.spellings(F.col("keyword")).alias("s")).collect()]
    assert got[:2] == [["chain link", "chain-link"], ["screen wall", "screen walls", "screen-wall", "screen-walls", "screenwall"]]
    assert got[2:] == [["rail post", "rail posts", "rail-post", "rail-posts", "railposts"], ["gate"], [], []]
    codes = spark.range(1).select(t.code_spellings().alias("c")).first().c
    assert len(codes) == len(set(codes)) == 171 and {"f-1", "fn19", "fe 7"} < set(codes)


def test_grid_join_equals_brute_force(spark):
    rows = [(i % 3, i, (i * 37 % 200) * 1.0, (i * 53 % 200) * 1.0, 5.0 + i % 60, 3.0 + i % 17) for i in range(90)]
    a = spark.createDataFrame([(p, i, x, y, x + w, y + h) for p, i, x, y, w, h in rows], "page long, aid long, ax0 double, ay0 double, ax1 double, ay1 double")
    b = a.withColumnsRenamed({c: c.replace("a", "b", 1) for c in ("aid", "ax0", "ay0", "ax1", "ay1")})
    box = lambda s: tuple(F.col(f"{s}{c}") for c in ("x0", "y0", "x1", "y1"))
    exact = g.boxes_touch(box("a"), box("b")) & (F.col("aid") < F.col("bid"))
    for cell in (10.0, 70.0):
        got = grid_join(a, b, box("a"), box("b"), exact, ["page"], 0.0, cell)
        want = a.join(b, "page").where(exact)
        key = lambda df: sorted((r.aid, r.bid) for r in df.collect())
        assert key(got) == key(want)
    hit = {r.aid for r in a.join(b, "page").where(exact).collect()}
    assert {r.aid for r in grid_join(a, b, box("a"), box("b"), exact, ["page"], how="left_semi").collect()} == hit
    assert {r.aid for r in grid_join(a, b, box("a"), box("b"), exact, ["page"], how="left_anti").collect()} == {r[1] for r in rows} - hit


def test_ordered_folds(spark):
    sizes = spark.createDataFrame([(1, i, float(s)) for i, s in enumerate([4, 4, 4, 30, 1, 1, 1, 1])], "d long, o long, s double")
    assert [r.batch for r in packed(sizes, ["d"], "o", "s", 10.0, 3, 20.0).orderBy("o").collect()] == [0, 0, 1, 2, 3, 3, 3, 4]


def test_numbering(spark):
    auto = spark.createDataFrame([(1, 0, "A", 100.0), (1, 1, "C", 5.0), (1, 10, "B", 50.0), (1, 2, "D", 60.0)], "page long, line_idx long, category string, length_pts double")
    drawn = spark.createDataFrame([(1, 0, "W", 3.0), (1, 1, "", 40.0)], "page long, ord long, category string, length_pts double")
    got = reports.numbered_lines(auto, drawn).orderBy("number").collect()
    assert [(r.number, r.source, r.category) for r in got] == [(1, "auto", "A"), (2, "auto", "D"), (3, "auto", "B"), (4, "user", "Unknown")]


def test_export_takes_known_indices_up_to_the_cap(spark):
    df = line_table(spark, [(0, 0, 20, 0)] * 30)
    edits = spark.createDataFrame([(1, "not-an-int", "A"), (1, "99", "A"), (1, "-1", "A")] + [(1, str(i), "A") for i in range(30)], "page long, idx string, category string")
    assert [r.line_idx for r in reports.export_assignments(edits, df, 20).orderBy("line_idx").collect()] == list(range(20))


def test_unmapped_lines_are_auto_detected_only_without_a_map(spark):
    one = line_table(spark, [(0, 0, 20, 0, "X"), (0, 0, 20, 0, "FENCE-1")])
    df = one.unionByName(one.withColumn("page", F.lit(2).cast("long"))).unionByName(one.withColumn("page", F.lit(3).cast("long")))
    maps = spark.createDataFrame([(1, "FENCE", "Fence", 0), (2, "the X and more", "Wall", 0), (2, "FENCE-1", "Gate", 1)], "page long, map_layer string, category string, map_ord long")
    got = {(r.page, r.layer): r.category for r in reports.category_of_layer(df, maps).collect()}
    assert got == {(1, "FENCE-1"): "Fence", (2, "X"): "Wall", (2, "FENCE-1"): "Gate", (3, "X"): "Auto-detected", (3, "FENCE-1"): "Auto-detected"}
    assert {r.category for r in reports.category_of_layer(one, maps.where("false")).collect()} == {"Auto-detected"}
    assert "Cartesian" not in plan(reports.category_of_layer(df, maps)) and "NestedLoop" not in plan(reports.category_of_layer(df, maps))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_votes_need_enough_and_a_name(spark):
    one = line_table(spark, [(0, 0, 10, 0, "L")] * 3 + [(500, 500, 510, 500, "BARRIER-9")])
    df = one.unionByName(one.withColumn("page", F.lit(2).cast("long")))
    inst = spark.createDataFrame([(p, p, "F-1", 0.0, 0.0, 10.0, 10.0) for p in (1, 2)], "page long, inst_ord long, indicator string, ix0 double, iy0 double, ix1 double, iy1 double")
    rows = [(1, "F-1", "CHAIN LINK", 0), (1, "F-2", "Barrier rail", 1), (2, "F-1", "WOOD", 0), (2, "F-3", "barrier gate", 1), (2, "F-4", "low barrier", 2)]
    leg = spark.createDataFrame(rows, "page long, indicator string, keyword string, leg_ord long")
    got = {(r.page, r.layer): (r.category, r.decided_by) for r in voting.layer_votes(df, inst, leg).collect()}
    assert got == {
        (1, "L"): ("F-1: CHAIN LINK", "indicator-vote"), (1, "BARRIER-9"): ("F-2: Barrier rail", "layer-token"),
        (2, "L"): ("F-1: WOOD", "indicator-vote"), (2, "BARRIER-9"): (None, "none"),
    }
    by_doc = voting.layer_votes(df.withColumn("document", F.col("page") * 10), inst, leg.withColumnRenamed("page", "document").withColumn("document", F.col("document") * 10), by=("document",))
    assert {(r.page, r.layer): (r.category, r.decided_by) for r in by_doc.collect()} == got


def test_limits_count_telling_lines_where_there_are_some(spark):
    n = lambda page, layer, count: spark.range(count).select(F.lit(page).cast("long").alias("page"), F.lit(layer).alias("layer"))
    parts = [n(1, "x", 6000), n(2, "FENCE", 3), n(2, "x", 16000), n(3, "x", 15001), n(4, "wall", 5001)]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    inst = spark.createDataFrame([(p,) for p in (1, 2, 3, 4)], "page long")
    chunks = spark.createDataFrame([(1, "figure")], "page long, chunk_type string")
    got = {r.page: r.skip_reason for r in lines.skip_reasons(lines.page_counts(df, inst, chunks)).collect()}
    assert got == {1: None, 2: None, 3: "too many lines on the page", 4: "too many lines"}


def test_crowded_ends_give_few_links(spark):
    rows = [(0.1 * (i % 5), 0.1 * (i // 5 % 5), 100 + 10 * i, 50.0) for i in range(150)]
    df = line_table(spark, rows)
    got = lines.runs(df, 2.0).select("run").distinct().collect()
    assert len(got) == 1
    rng = __import__("random").Random(5)
    spread = [(rng.uniform(0, 40), rng.uniform(0, 40), rng.uniform(0, 40), rng.uniform(0, 40)) for _ in range(60)]
    found = {r.line_idx: r.run for r in lines.runs(line_table(spark, spread), 2.5).collect()}
    ends = [((a, b), (c, d)) for a, b, c, d in spread]
    want = list(range(60))
    moved = True
    while moved:
        moved = False
        for i in range(60):
            for j in range(60):
                if want[j] < want[i] and any(((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5 < 2.5 for p in ends[i] for q in ends[j]):
                    want[i], moved = want[j], True
    assert [found[i] for i in range(60)] == want


@pytest.mark.parametrize("sketch, reach", [(2000, 0.01), (8, 1e-5)])
def test_ranks_equal_sorting(spark, monkeypatch, sketch, reach):
    """With a good sketch, and with one that's wrong about most ranks."""
    import random

    monkeypatch.setattr(records, "SKETCH", sketch)
    monkeypatch.setattr(records, "REACH", reach)
    rng = random.Random(3)
    rows = [(k, float(rng.randint(0, 30)) if rng.random() < 0.9 else None, None) for k in "abc" for _ in range(rng.randint(1, 200))] + [("d", None, None)]
    rows += [("e", rng.gauss(0, 5), rng.random()) for _ in range(3000)] + [(None, 7.0, float(n)) for n in range(1001)]
    df = spark.createDataFrame(rows, "k string, v double, w double")
    got = records.nearest_ranks(df, ["k"], {"p50": ("v", 50), "p95": ("v", 95), "w99": ("w", 99.5), "w0": ("w", 0)}).collect()
    at = lambda own, p: own[round(p / 100 * (len(own) - 1))] if own else None
    for r in got:
        v, w = (sorted(x[c] for x in rows if x[0] == r.k and x[c] is not None) for c in (1, 2))
        assert tuple(r)[1:] == (at(v, 50), at(v, 95), at(w, 99.5), at(w, 0))
    assert len(got) == 5



def test_large_boxes_lie_on_coarser_grids(spark):
    rows = [(1, i, (i * 37 % 300) * 1.0, (i * 53 % 300) * 1.0, [3.0, 90.0, 5000.0, 400_000.0][i % 4]) for i in range(40)]
    a = spark.createDataFrame([(p, i, x, y, x + w, y + w) for p, i, x, y, w in rows], "page long, aid long, ax0 double, ay0 double, ax1 double, ay1 double")
    b = a.withColumnsRenamed({c: c.replace("a", "b", 1) for c in ("aid", "ax0", "ay0", "ax1", "ay1")})
    box = lambda s: tuple(F.col(f"{s}{c}") for c in ("x0", "y0", "x1", "y1"))
    touch = g.boxes_touch(box("a"), box("b"))
    key = lambda df: sorted((r.aid, r.bid) for r in df.collect())
    assert key(grid_join(a, b, box("a"), box("b"), touch, ["page"], 0.0, 1.0, large=True)) == key(a.join(b, "page").where(touch))


def test_span_boxes_split_on_gaps_and_width(spark):
    tok = [(1, 0, k + 1, x, at, 0.0, at + w, 10.0) for k, (x, at, w) in enumerate([("chain", 0.0, 50.0), ("link", 55.0, 40.0), ("far", 300.0, 30.0), ("wide", 335.0, 150.0), ("more", 490.0, 100.0)])]
    t_ = spark.createDataFrame(tok, "page long, line_no long, k int, text string, tx0 double, ty0 double, tx1 double, ty1 double")
    found = spark.createDataFrame([(1, 0, 1, 5)], "page long, line_no long, start int, end int")
    got = legend.span_boxes(found, t_, pad=0.0).orderBy("part").collect()
    assert [(r.text, r.x0, r.x1, r.y0, r.y1) for r in got] == [("chain link", 0.0, 95.0, 0.0, 10.0), ("far wide", 300.0, 485.0, 0.0, 10.0), ("more", 490.0, 590.0, 0.0, 10.0)]


def test_folders_are_shared_off_one_machine(spark):
    from sheetlens.plans.graph import shared_dir

    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        shared_dir(Session())
    Session.conf = Conf({"spark.master": "local[2]"})
    assert shared_dir(Session()).startswith("file://")


def test_clusters_keep_directions_apart(spark):
    df = line_table(spark, [(0, 0, 100, 0), (100, 1, 200, 1), (200, 2, 200, 100)])
    shapes = voting.cluster_shapes(voting.clusters(df, 5.0, 15.0)).orderBy("run").collect()
    assert [(r.lines, r.orientation) for r in shapes] == [(2, "horizontal"), (1, "vertical")]


def test_page_rules(spark):
    kw = spark.createDataFrame([(1, 0, []), (1, 1, ["fence"]), (1, 2, ["with"]), (1, 3, ["with"])], "doc_id long, page_idx int, keywords array<string>")
    s = spark.createDataFrame([(1, 0, True, 0.9), (1, 2, False, 0.9), (1, 3, False, 0.4)], "doc_id long, page_idx int, is_relevant boolean, confidence double")
    got = {r.page_idx: (r.relevant, r.method) for r in pages.decide(kw, s, ["fence"]).collect()}
    assert got == {0: (False, "no_keywords"), 1: (True, "high_signal"), 2: (False, "score"), 3: (True, "keyword_only")}
    got = {r.page_idx: r.relevant for r in pages.decide(kw, s, [], "any_keyword").collect()}
    assert got == {0: True, 1: True, 2: True, 3: True}
    with pytest.raises(ValueError):
        pages.decide(kw, s, [], "other")


def test_model_answers_are_found_in_noise(spark):
    said = ['Sure!\n[{"id": "a", "v": "x"}, {"id": "", "v": "y"}] done', "nothing", 'ok {"results": [{"id": "b", "v": "z"}]}.', '{"results": [{"id": 1']
    df = spark.createDataFrame(list(enumerate(said)), "page long, response string")
    assert sorted((r.page, r.id, r.v) for r in pages.model_rows(df, "id string, v string").collect()) == [(0, "a", "x"), (2, "b", "z")]
    assert {r.page: r.n for r in pages.model_object(spark.createDataFrame([(1, 'x {"n": 4} y')], "page long, response string"), "n int").collect()} == {1: 4}


def test_layout_answers_start_at_zero_or_one(spark):
    rows = [(1, 7, [{"id": "a", "type": "figure", "text": "", "markdown": "m", "grounding": [{"page": 1, "box": {"left": 0.0, "top": 0.5, "right": 1.0, "bottom": 1.0}}]}])]
    schema = "response_id long, doc_id long, chunks array<struct<id:string,type:string,text:string,markdown:string,grounding:array<struct<page:int,box:struct<left:double,top:double,right:double,bottom:double>>>>>"
    p = spark.createDataFrame([(7, 0, 100.0, 200.0)], "doc_id long, page_idx int, width double, height double")
    (r,) = layout.page_chunks(spark.createDataFrame(rows, schema), p).collect()
    assert (r.page_idx, r.text, r.x0, r.y0, r.x1, r.y1) == (0, "m", 0.0, 100.0, 100.0, 200.0)


def test_words_share_a_block_by_length(spark):
    b = spark.createDataFrame([(1, 0, "ab  cdef", 0.0, 0.0, 60.0, 10.0)], "page long, ord long, text string, x0 double, y0 double, x1 double, y1 double")
    assert [(r.text, r.tx0, r.tx1) for r in layout.split_words(b).orderBy("k").collect()] == [("ab", 0.0, 20.0), ("cdef", 20.0, 60.0)]


TOKEN = "page long, tok_ord long, text string, tx0 double, ty0 double, tx1 double, ty1 double"


def test_readings_merge_and_keep_the_rest(spark):
    pdf = spark.createDataFrame([(1, 0, "gat", 0.0, 0.0, 10.0, 10.0), (1, 1, "far", 500.0, 0.0, 510.0, 10.0)], TOKEN)
    read = spark.createDataFrame([(1, 0, "gate", 1.0, 0.0, 12.0, 10.0), (1, 1, "new", 90.0, 90.0, 99.0, 99.0)], TOKEN)
    got = {(r.source, r.text): (r.x0, r.x1, r.merged) for r in layout.merged_readings(pdf, read).collect()}
    assert got == {("pdf", "gate"): (0.0, 12.0, True), ("pdf", "far"): (500.0, 510.0, False), ("ocr", "new"): (90.0, 99.0, False)}


def test_indicators(spark):
    leg = spark.createDataFrame([("2.09", 0), ("F-1", 1), ("(20)", 2)], "indicator string, leg_ord long")
    tok = spark.createDataFrame([(1, i, x, 0.0, 0.0, 1.0, 1.0) for i, x in enumerate(["2.9", "[F-1]", "F1", "20", "(20)", "180", "02.09"])], TOKEN)
    got = {r.text: r.indicator for r in legend.matched_tokens(tok, leg).collect()}
    assert got == {"2.9": "2.09", "[F-1]": "F-1", "F1": "F-1", "(20)": "(20)", "02.09": "2.09"}


def test_phrases_and_spans(spark):
    tok = spark.createDataFrame([(1, i, x, i * 10.0, 0.0, i * 10.0 + 8, 5.0) for i, x in enumerate(["the", "Chain", "link,", "chain"])], TOKEN)
    assert [(r.x0, r.x1) for r in legend.phrase_tokens(tok, "chain link").collect()] == [(10.0, 28.0)]
    ln = spark.createDataFrame([(1, 0, ["chain", "link", "gate", "chain"])], "page long, line_no long, words array<string>")
    found = legend.spans(ln, ["chain", "chain link", "gate"])
    assert sorted((r.start, r.end) for r in found.collect()) == [(1, 2), (3, 3), (4, 4)]
    assert sorted((r.start, r.end) for r in legend.widened_spans(found, ln, 1).collect()) == [(1, 3), (2, 4), (3, 4)]


def test_names_from_answers(spark):
    known = spark.createDataFrame([(1, "Chain Link", 0), (1, "Wood Fence", 1), (2, "Steel Gate", 0)], "document long, known string, known_ord long")
    ans = spark.createDataFrame([(d, n) for d in (1, 2) for n in ("chain link", "wood", "steel")], "document long, name string")
    got = {(r.document, r.name): r.known for r in legend.known_names(ans, known, True).collect()}
    assert got == {(1, "chain link"): "Chain Link", (1, "wood"): "Wood Fence", (1, "steel"): "Chain Link", (2, "chain link"): "Steel Gate", (2, "wood"): "Steel Gate", (2, "steel"): "Steel Gate"}
    assert legend.known_names(ans, known).count() == 3


def test_evaluation(spark):
    csv = spark.createDataFrame([("1", "a", "[0, 0, 10, 10]", "Highlight"), ("1", "b", "[0, 0]", "Ink"), ("1", "c", "[0, 0, 1, 1]", "Text")], "page string, content string, bbox string, type_name string")
    assert [(r.content, r.gx1) for r in evaluation.gold_boxes(csv).collect()] == [("a", 10.0)]
    gold = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 50.0, 0.0, 60.0, 10.0)], "page long, gold_id long, gx0 double, gy0 double, gx1 double, gy1 double")
    pred = spark.createDataFrame([(1, 1, 1.0, 0.0, 11.0, 10.0), (1, 2, 0.0, 0.0, 10.0, 10.0)], "page long, pred_id long, px0 double, py0 double, px1 double, py1 double")
    r = evaluation.box_metrics(pred, gold).where("page = 1").first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall) == (1, 1, 1, 0.5, 0.5)


def test_registry_rules(spark):
    jobs = spark.createDataFrame([(1, "running", 0, 5), (2, "running", 2, 6), (3, "queued", 0, 4)], "job_id long, status string, requeue_count int, queue_position long")
    got = {r.job_id: (r.status, r.requeue_count, r.queue_position) for r in records.after_restart(jobs).collect()}
    assert got == {1: ("queued", 1, 3), 2: ("failed", 2, 6), 3: ("queued", 0, 4)}
    assert records.params_hash({"b": 2, "a": 1}) == records.params_hash({"a": 1, "b": 2}) != records.params_hash({"a": 1, "b": 3})
    assert one(spark, records.within_phase(F.lit("phase2"), F.lit(54.0)).alias("a")).a == 50.0
    dirty = spark.createDataFrame([("a\x00b", [("c\x00",)], {"k": "\x00"}, None)], "a string, b array<struct<x:string>>, c map<string,string>, d struct<y:string>")
    r = records.json_safe(dirty).first()
    assert (r.a, r.b[0].x, r.c["k"], r.d) == ("ab", "c", "", None)
