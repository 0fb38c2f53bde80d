"""The registered queries over whole tables, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetlens.functions import geometry as g
from sheetlens.functions import scale as sc
from sheetlens.functions import text as t
from sheetlens.operators import evaluation, layout, legend, lines, pages, records, reports, voting
from sheetlens.sources import fixtures as fx
from sheetlens.sources.fixtures_sql import over

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WORDS = [k for k, _ in fx.KEYWORDS]
_EDGE = r"[^\p{L}\p{N}_]"
_HAS = {k: f"regexp_matches(lower(text), '(^|{_EDGE}){k}(?:s|es|ing)?($|{_EDGE})')" for k in WORDS}


def query(sql: str | None = None, **ctes: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = over(sql, **ctes)
        return f

    return add


# Lengths by category

MAPPED = """SELECT v.page, v.line_idx, v.length_pts, v.layer, CASE WHEN p.mapped IS NULL THEN 'Auto-detected' ELSE m.category END AS category
    FROM fx_vlines v LEFT JOIN (SELECT DISTINCT page, true AS mapped FROM fx_layer_map) p ON p.page = v.page LEFT JOIN (
    SELECT l.page, l.layer, arg_min(category, (CASE WHEN layer = map_layer THEN 0 ELSE 1000 END) + map_ord) AS category
    FROM (SELECT DISTINCT page, layer FROM fx_vlines) l JOIN fx_layer_map m ON m.page = l.page
    WHERE layer = map_layer OR contains(layer, map_layer) OR contains(map_layer, layer) GROUP BY l.page, l.layer) m
    ON m.page = v.page AND m.layer = v.layer WHERE p.mapped IS NULL OR m.category IS NOT NULL"""
SCALED = "SELECT page, document, coalesce(verified_scale, 360.0) AS scale FROM fx_scale"
PER_PAGE = """SELECT s.document, m.page, m.category, round_even(sum(m.length_pts), 1) AS pts,
    round_even(sum(m.length_pts) / (864.0 / any_value(s.scale)), 2) AS ft, count(*) AS auto_lines, 0::BIGINT AS manual_lines
    FROM mapped m JOIN scaled s USING (page) GROUP BY s.document, m.page, m.category"""


def _mapped(spark, d):
    return reports.category_of_layer(fx.vlines(spark, d), fx.layer_map(spark, d))


def _scales(spark, d):
    return reports.page_scales(fx.scale(spark, d))


def _per_page(spark, d):
    return reports.page_category_totals(_mapped(spark, d), _scales(spark, d))


@query("SELECT page, line_idx, category FROM mapped", mapped=MAPPED)
def line_categories(spark, d):
    return _mapped(spark, d).select("page", "line_idx", "category")


@query("SELECT * FROM per_page", mapped=MAPPED, scaled=SCALED, per_page=PER_PAGE)
def page_category_feet(spark, d):
    return _per_page(spark, d)


@query(
    """SELECT document, category, round_even(sum(pts), 1) AS pts, round_even(sum(ft), 2) AS ft, count(*) AS pages,
    sum(auto_lines)::BIGINT AS auto_lines, sum(manual_lines)::BIGINT AS manual_lines FROM per_page GROUP BY document, category""",
    mapped=MAPPED, scaled=SCALED, per_page=PER_PAGE,
)
def document_category_feet(spark, d):
    return reports.document_category_totals(_per_page(spark, d))


@query(
    """SELECT document, page, sum(CASE WHEN category = 'Auto-detected' THEN ft END) AS "Auto-detected",
    sum(CASE WHEN category = 'F-5: IRAQ' THEN ft END) AS "F-5: IRAQ" FROM per_page GROUP BY document, page""",
    mapped=MAPPED, scaled=SCALED, per_page=PER_PAGE,
)
def page_category_matrix(spark, d):
    return reports.page_category_matrix(_per_page(spark, d), ["Auto-detected", "F-5: IRAQ"])


#: Pages of suppliers in credit have all their lines assigned by hand; those on one layer were drawn.
EDITS = """SELECT page, line_idx, CASE WHEN length_pts < 100 THEN 'Chain Link' ELSE 'Wood' END AS category, length_pts, layer = 'R-F' AS manual
    FROM fx_vlines JOIN supplier ON s_suppkey = page WHERE s_acctbal >= 0"""


def _edits(spark, d):
    credit = fx.read(spark, d, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("page"))
    v = fx.vlines(spark, d).join(credit, "page")
    return v.select("page", "line_idx", F.when(F.col("length_pts") < 100, "Chain Link").otherwise("Wood").alias("category"), "length_pts", (F.col("layer") == "R-F").alias("manual"))


@query(
    """SELECT s.document, r.page, r.category, round_even(sum(r.length_pts), 1) AS pts, round_even(sum(r.length_pts) / (864.0 / any_value(s.scale)), 2) AS ft,
    count(*) FILTER (NOT r.manual) AS auto_lines, count(*) FILTER (r.manual) AS manual_lines FROM (
    SELECT page, category, length_pts, false AS manual FROM mapped WHERE page NOT IN (SELECT page FROM edits)
    UNION ALL SELECT page, category, length_pts, manual FROM edits) r JOIN scaled s USING (page) GROUP BY s.document, r.page, r.category""",
    mapped=MAPPED, scaled=SCALED, edits=EDITS,
)
def page_category_feet_with_edits(spark, d):
    return reports.page_category_totals(_mapped(spark, d), _scales(spark, d), _edits(spark, d))


NUMBERED = """SELECT page, row_number() OVER (PARTITION BY page ORDER BY rank, ord) AS number, source, ord, category, length_pts FROM (
    SELECT page, 'auto' AS source, 0 AS rank, line_idx AS ord, category, length_pts FROM mapped UNION ALL
    SELECT page, 'user', 1, line_idx, category, length_pts FROM edits WHERE manual) WHERE length_pts >= 10"""


def _numbered(spark, d):
    drawn = _edits(spark, d).where("manual").select("page", F.col("line_idx").alias("ord"), "category", "length_pts")
    return reports.numbered_lines(_mapped(spark, d), drawn)


@query("SELECT page, number, source, ord, category, length_pts FROM numbered", mapped=MAPPED, edits=EDITS, numbered=NUMBERED)
def numbered_export_lines(spark, d):
    return _numbered(spark, d)


EXPORT = """SELECT document, page, number, category, source, round_even(length_pts / (864.0 / scale), 2) AS ft, round_even(length_pts, 1) AS pts,
    scale FROM numbered JOIN scaled USING (page)"""
_EXPORT = {"mapped": MAPPED, "edits": EDITS, "numbered": NUMBERED, "scaled": SCALED, "rows_": EXPORT}


@query("SELECT * FROM rows_", **_EXPORT)
def export_rows(spark, d):
    return reports.export_rows(_numbered(spark, d), _scales(spark, d))


@query("SELECT category, round_even(sum(ft), 2) AS ft, count(*) AS lines FROM rows_ GROUP BY category", **_EXPORT)
def category_sheet(spark, d):
    return reports.category_sheet(export_rows(spark, d))


@query(
    """SELECT CASE WHEN grouping(category) = 1 THEN 'GRAND TOTAL' ELSE 'TOTAL ' || category END AS label, round_even(sum(ft), 2) AS ft,
    count(*) AS lines FROM rows_ GROUP BY ROLLUP (category)""",
    **_EXPORT,
)
def grand_totals(spark, d):
    return reports.with_grand_total(export_rows(spark, d))


@query("""SELECT page, category, position, position % 8 AS color FROM (SELECT page, indicator || ': ' || keyword AS category, row_number() OVER
    (PARTITION BY page ORDER BY leg_ord) - 1 AS position FROM fx_page_legend)""")
def category_colors(spark, d):
    return reports.category_colors(fx.page_legend(spark, d), ["page"])


SPECS = """SELECT c_custkey AS document, CASE (c_custkey + i) % 4 WHEN 0 THEN 'urgent' WHEN 1 THEN '3-MEDIUM' WHEN 2 THEN 'high' ELSE '4-Not Specified' END AS name,
    i::INT AS spec_ord FROM customer, range(3) r(i)"""
NAMED = """SELECT document, category, arg_min(name, rank * 10 + spec_ord) AS name FROM (SELECT c.document, category, name, spec_ord, CASE WHEN category = name THEN 0
    WHEN lower(category) = lower(name) THEN 1 WHEN contains(lower(category), lower(name)) OR contains(lower(name), lower(category)) THEN 2 END AS rank
    FROM (SELECT DISTINCT o_custkey AS document, o_orderpriority AS category FROM orders) c JOIN specs s ON s.document = c.document) WHERE rank IS NOT NULL
    GROUP BY document, category"""


def _specs(spark, d):
    k = (F.col("document") + F.col("spec_ord")) % 4
    c = fx.read(spark, d, "customer").select(F.col("c_custkey").alias("document"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("spec_ord"))
    return c.select("document", F.when(k == 0, "urgent").when(k == 1, "3-MEDIUM").when(k == 2, "high").otherwise("4-Not Specified").alias("name"), "spec_ord")


@query("SELECT document, category, name FROM named", specs=SPECS, named=NAMED)
def category_specs(spark, d):
    cats = fx.read(spark, d, "orders").select(F.col("o_custkey").alias("document"), F.col("o_orderpriority").alias("category")).distinct()
    return reports.lookup_specs(cats, _specs(spark, d))


@query("""SELECT document, name, arg_min(known, rank * 100 + known_ord) AS known FROM (SELECT a.document, a.name, k.known, k.known_ord, CASE WHEN lower(a.name) = lower(known) THEN 0
    WHEN contains(lower(a.name), lower(known)) OR contains(lower(known), lower(a.name)) THEN 1 ELSE 2 END AS rank FROM (SELECT DISTINCT o_custkey AS document, o_orderpriority AS name FROM orders) a
    JOIN (SELECT document, name AS known, spec_ord AS known_ord FROM specs) k ON k.document = a.document) GROUP BY document, name""", specs=SPECS)
def known_categories(spark, d):
    known = _specs(spark, d).select("document", F.col("name").alias("known"), F.col("spec_ord").alias("known_ord"))
    answers = fx.read(spark, d, "orders").select(F.col("o_custkey").alias("document"), F.col("o_orderpriority").alias("name"))
    return legend.known_names(answers, known, fallback_first=True)


@query("""SELECT page, layer, sum(n)::BIGINT AS lines, sum(pts) AS pts, arg_min(category, -n * 1000000 + first_line) AS category FROM (
    SELECT page, layer, category, count(*) AS n, sum(length_pts) AS pts, min(line_idx) AS first_line FROM tagged GROUP BY page, layer, category) GROUP BY page, layer""",
    tagged="SELECT page, line_idx, layer, length_pts, CASE line_idx % 2 WHEN 0 THEN 'Wood' ELSE 'Chain Link' END AS category FROM fx_vlines",
)
def layer_overview(spark, d):
    v = fx.vlines(spark, d).withColumn("category", F.when(F.col("line_idx") % 2 == 0, "Wood").otherwise("Chain Link"))
    return reports.layer_overview(v)


# Pages put together to ever larger sheets, so that all limits are met: sheet n holds pages 2^n - 1 to 2^(n+1) - 2.
SHEET = "floor(log2({} + 1))::BIGINT"


@query(f"""SELECT page, line_idx, category, length_pts FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY line_idx) AS r FROM (
    SELECT {SHEET.format("v.page")} AS page, v.page * 100000 + v.line_idx AS line_idx, layer AS category, length_pts FROM fx_vlines v)) WHERE r <= 5000""")
def capped_assignments(spark, d):
    """Every line of a sheet has an assignment; those beyond the cap and one that is no number are left out."""
    sheet = F.floor(F.log2(F.col("page") + 1))
    v = fx.vlines(spark, d).withColumn("line_idx", F.col("page") * 100000 + F.col("line_idx")).withColumn("page", sheet)
    e = v.select("page", F.col("line_idx").cast("string").alias("idx"), F.col("layer").alias("category"))
    bad = e.limit(1).select("page", F.lit("not-an-int").alias("idx"), "category")
    return reports.export_assignments(e.unionByName(bad), v)


# Lines

NEAR80 = """SELECT DISTINCT v.page, v.line_idx, v.length_pts, v.layer, i.inst_ord, i.indicator FROM fx_vlines v JOIN fx_instances i USING (page)
    WHERE (v.x0 BETWEEN ix0 - 80 AND ix1 + 80 AND v.y0 BETWEEN iy0 - 80 AND iy1 + 80)
    OR (v.x1 BETWEEN ix0 - 80 AND ix1 + 80 AND v.y1 BETWEEN iy0 - 80 AND iy1 + 80)"""


def _near80(spark, d):
    return lines.near_box(fx.vlines(spark, d), fx.instances(spark, d), g.box("i"), ["inst_ord", "indicator"], 80.0)


@query("SELECT page, line_idx, inst_ord FROM near80", near80=NEAR80)
def lines_near_instances(spark, d):
    return _near80(spark, d).select("page", "line_idx", "inst_ord")


@query("""SELECT page, indicator, count(*) AS items, sum(n)::BIGINT AS segments, sum(pts) / 72 * 360 / 12 AS feet, sum(pts) AS total_pts FROM (
    SELECT page, indicator, inst_ord, count(*) AS n, sum(length_pts) AS pts FROM near80 GROUP BY page, indicator, inst_ord) GROUP BY page, indicator""", near80=NEAR80)
def indicator_measures(spark, d):
    return lines.indicator_measures(_near80(spark, d).withColumnRenamed("inst_ord", "item"), 360.0)


@query("""SELECT DISTINCT v.page, v.line_idx, i.inst_ord FROM fx_vlines v JOIN fx_instances i USING (page) WHERE
    sqrt((x0 - ix0) ** 2 + (y0 - iy0) ** 2) <= 60 OR sqrt((x1 - ix0) ** 2 + (y1 - iy0) ** 2) <= 60
    OR sqrt(((x0 + x1) / 2 - ix0) ** 2 + ((y0 + y1) / 2 - iy0) ** 2) <= 60""")
def lines_near_points(spark, d):
    return lines.near_point(fx.vlines(spark, d), fx.instances(spark, d), "ix0", "iy0", ["inst_ord"], 60.0, True).select("page", "line_idx", "inst_ord")


@query("""SELECT page, inst_ord, line_idx FROM (SELECT *, row_number() OVER (PARTITION BY page, inst_ord ORDER BY dist, line_idx) AS r FROM (
    SELECT page, inst_ord, line_idx, sqrt((ix0 - greatest(least(ix0, x1), x0)) ** 2 + (iy0 - greatest(least(iy0, y1), y0)) ** 2) AS dist
    FROM fx_vlines JOIN fx_instances USING (page)) WHERE dist <= 50) WHERE r = 1""")
def nearest_lines(spark, d):
    return lines.nearest_line(fx.vlines(spark, d), fx.instances(spark, d), "ix0", "iy0", "inst_ord", 50.0).select("page", "inst_ord", "line_idx")


@query("""SELECT page, layer, count(*) AS segments, sum(length_pts) AS total_pts, sum(length_pts) / 72 AS total_inches, sum(length_pts) / 72 * 360 AS scaled_inches,
    sum(length_pts) / 72 * 360 / 12 AS total_feet FROM fx_vlines WHERE ((x0 BETWEEN 100 AND 400 AND y0 BETWEEN 200 AND 600) OR
    (x1 BETWEEN 100 AND 400 AND y1 BETWEEN 200 AND 600)) AND length_pts >= 5 GROUP BY page, layer""")
def selection_measures(spark, d):
    sel = fx.read(spark, d, "supplier").select(F.col("s_suppkey").alias("page"), F.lit(400.0).alias("sx0"), F.lit(200.0).alias("sy0"), F.lit(100.0).alias("sx1"), F.lit(600.0).alias("sy1"))
    return lines.selection_measure(fx.vlines(spark, d), sel, 360.0)


@query("""SELECT page, count(*) AS segments, sum(length_pts) AS total_pts, sum(length_pts) / 72 AS total_inches, sum(length_pts) / 72 * 30 AS scaled_inches,
    sum(length_pts) / 72 * 30 / 12 AS total_feet FROM fx_vlines GROUP BY page""")
def length_totals(spark, d):
    return lines.totals(fx.vlines(spark, d), ["page"], 30.0)


@query("SELECT page, layer, count(*) AS lines FROM fx_vlines GROUP BY page, layer")
def layer_counts(spark, d):
    return lines.layer_counts(fx.vlines(spark, d), ["page"])


@query("""SELECT page, count(*) AS lines, count(*) FILTER (length_pts < 10) AS under_10, count(*) FILTER (length_pts >= 10 AND length_pts < 50) AS to_50,
    count(*) FILTER (length_pts >= 50 AND length_pts < 100) AS to_100, count(*) FILTER (length_pts >= 100) AS from_100,
    round(100 * count(*) FILTER (length_pts < 10) / count(*), 1) AS under_10_pct, round(100 * count(*) FILTER (length_pts >= 10 AND length_pts < 50) / count(*), 1) AS to_50_pct,
    round(100 * count(*) FILTER (length_pts >= 50 AND length_pts < 100) / count(*), 1) AS to_100_pct, round(100 * count(*) FILTER (length_pts >= 100) / count(*), 1) AS from_100_pct
    FROM fx_vlines GROUP BY page""")
def length_histogram(spark, d):
    return lines.length_histogram(fx.vlines(spark, d), ["page"])


RUN_EDGES = """SELECT DISTINCT a.page, a.line_idx AS a, b.line_idx AS b FROM ends a JOIN ends b ON a.page = b.page AND a.layer = b.layer AND a.line_idx <> b.line_idx
    AND abs(a.px - b.px) < 2 AND abs(a.py - b.py) < 2 AND sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2) < 2"""
ENDS = "SELECT page, layer, line_idx, x0 AS px, y0 AS py FROM fx_vlines UNION ALL SELECT page, layer, line_idx, x1, y1 FROM fx_vlines"


@query("""SELECT v.page, v.line_idx, least(v.line_idx, coalesce(min(r.node), v.line_idx)) AS run FROM fx_vlines v LEFT JOIN reach r
    ON r.page = v.page AND r.start = v.line_idx GROUP BY v.page, v.line_idx""", ends=ENDS, edges=RUN_EDGES)
def connected_runs(spark, d):
    return lines.runs(fx.vlines(spark, d), 2.0, ("page", "layer")).select("page", "line_idx", "run")


ORACLES["connected_runs"] = ORACLES["connected_runs"].replace("WITH ", "WITH RECURSIVE ", 1).replace(
    ") SELECT v.page",
    """), reach AS (SELECT page, a AS start, b AS node FROM edges UNION SELECT r.page, r.start, e.b FROM reach r JOIN edges e
    ON e.page = r.page AND e.a = r.node) SELECT v.page""",
)


def with_reach(edges: str, **ctes: str) -> dict[str, str]:
    """CTEs that end in ``reached`` (page, line_idx, run) over ``edges`` (page, a, b), both ways round, of fx_vlines."""
    reach = "SELECT page, a AS start, b AS node FROM edges UNION SELECT r.page, r.start, e.b FROM reach r JOIN edges e ON e.page = r.page AND e.a = r.node"
    reached = """SELECT v.page, v.line_idx, v.layer, v.length_pts, v.x0, v.y0, v.x1, v.y1, least(v.line_idx, coalesce(min(r.node), v.line_idx)) AS run FROM fx_vlines v
        LEFT JOIN reach r ON r.page = v.page AND r.start = v.line_idx
        GROUP BY v.page, v.line_idx, v.layer, v.length_pts, v.x0, v.y0, v.x1, v.y1"""
    return {**ctes, "edges": edges, "reach": reach, "reached": reached}


def near_ends(far: float, more: str = "") -> str:
    return f"""SELECT DISTINCT a.page, a.line_idx AS a, b.line_idx AS b FROM ends a JOIN ends b ON a.page = b.page AND a.line_idx <> b.line_idx
        AND abs(a.px - b.px) < {far} AND sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2) < {far} {more}"""


@query("""SELECT page, layer, sum(n)::BIGINT AS segments, sum(pts) / 72 * 360 / 12 AS feet, count(*) AS runs, array_to_string(list(pts::BIGINT ORDER BY pts DESC, run)[1:10], ',') AS top_runs
    FROM (SELECT page, layer, run, count(*) AS n, sum(length_pts) AS pts FROM reached GROUP BY page, layer, run) GROUP BY page, layer""",
    **with_reach(near_ends(2, "AND a.layer = b.layer"), ends=ENDS))
def layer_run_measures(spark, d):
    m = lines.layer_measures(lines.runs(fx.vlines(spark, d), 2.0, ("page", "layer")), 360.0)
    return m.withColumn("top_runs", F.array_join(F.col("top_runs").cast("array<bigint>"), ","))


@query("""SELECT r.page, r.line_idx, r.run FROM reached r WHERE (r.page, r.run) IN (SELECT s.page, s.run FROM reached s JOIN fx_instances i ON i.page = s.page AND i.inst_ord % 1000 = s.line_idx)""",
    **with_reach(near_ends(5), ends=ENDS))
def runs_from_seeds(spark, d):
    seeds = fx.instances(spark, d).select("page", (F.col("inst_ord") % 1000).alias("line_idx"))
    return lines.run_from(lines.runs(fx.vlines(spark, d), 5.0), seeds).select("page", "line_idx", "run")


_WORDS_SQL = " OR ".join(f"contains(upper(layer), '{w}')" for w in lines.LAYER_WORDS)


@query(f"SELECT page, count(DISTINCT layer) AS layers, count(*) AS lines FROM fx_telling_vlines WHERE {_WORDS_SQL} GROUP BY page")
def telling_layers(spark, d):
    v = lines.with_layer_words(fx.telling_vlines(spark, d))
    return v.groupBy("page").agg(F.countDistinct("layer").alias("layers"), F.count("*").alias("lines"))


@query("SELECT word, count(DISTINCT layer) AS layers, count(*) AS lines, sum(length_pts) AS total_pts FROM fx_telling_vlines JOIN (VALUES " + ", ".join(f"('{w}')" for w in lines.MORE_LAYER_WORDS) + """) w(word)
    ON contains(upper(layer), word) GROUP BY word""")
def layer_word_counts(spark, d):
    return lines.layer_word_counts(fx.telling_vlines(spark, d))


@query("""SELECT v.page, v.line_idx FROM fx_vlines v WHERE EXISTS (SELECT 1 FROM fx_chunks c WHERE c.page = v.page AND chunk_type = 'figure' AND
    ((x0 BETWEEN cx0 - 50 AND cx1 + 50 AND y0 BETWEEN cy0 - 50 AND cy1 + 50) OR (x1 BETWEEN cx0 - 50 AND cx1 + 50 AND y1 BETWEEN cy0 - 50 AND cy1 + 50)))""")
def lines_in_figures(spark, d):
    figs = fx.chunks(spark, d).where("chunk_type = 'figure'")
    return lines.in_boxes(fx.vlines(spark, d), figs, g.box("c")).select("page", "line_idx")


DIMS = "SELECT page, inst_ord AS dim_id, ix0 AS dx, iy0 AS dy, (10 + inst_ord % 60)::DOUBLE AS value_ft FROM fx_instances"


@query("""SELECT page, dim_id, value_ft, line_idx, length_pts / 72 * 360 / 12 AS actual_ft FROM (SELECT *, row_number() OVER (PARTITION BY page, dim_id ORDER BY score, line_idx) AS r
    FROM (SELECT page, dim_id, value_ft, line_idx, length_pts, abs(length_pts - value_ft * 12 / 360 * 72) / (value_ft * 12 / 360 * 72) + dist / 150 * 0.3 AS score FROM (
    SELECT d.*, line_idx, length_pts, least(sqrt((x0 - dx) ** 2 + (y0 - dy) ** 2), sqrt((x1 - dx) ** 2 + (y1 - dy) ** 2),
    sqrt(((x0 + x1) / 2 - dx) ** 2 + ((y0 + y1) / 2 - dy) ** 2)) AS dist FROM dims d JOIN fx_vlines v USING (page) WHERE length_pts >= 5) WHERE dist <= 150))
    WHERE r = 1 AND score < 1.0""", dims=DIMS)
def dimension_lines(spark, d):
    dims = fx.instances(spark, d).select("page", F.col("inst_ord").alias("dim_id"), F.col("ix0").alias("dx"), F.col("iy0").alias("dy"), (10.0 + F.col("inst_ord") % 60).alias("value_ft"))
    return lines.dimension_lines(fx.vlines(spark, d), dims, 360.0).select("page", "dim_id", "value_ft", "line_idx", "actual_ft")


FOUND = "SELECT page, line_idx AS found_id, x1 AS x0, y1 AS y0, x0 AS x1, y0 AS y1 FROM fx_vlines"


def _found(spark, d):
    return fx.vlines(spark, d).select("page", F.col("line_idx").alias("found_id"), F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("x0").alias("x1"), F.col("y0").alias("y1"))


@query("""SELECT f.page, f.found_id, min(v.line_idx) AS line_idx FROM found f JOIN fx_vlines v ON f.page = v.page AND ((f.x0 = v.x0 AND f.y0 = v.y0 AND f.x1 = v.x1 AND f.y1 = v.y1)
    OR (f.x0 = v.x1 AND f.y0 = v.y1 AND f.x1 = v.x0 AND f.y1 = v.y0)) GROUP BY f.page, f.found_id""", found=FOUND)
def lines_by_ends(spark, d):
    return lines.match_by_ends(_found(spark, d), fx.vlines(spark, d))


@query("""SELECT page, found_id, line_idx FROM (SELECT f.page, f.found_id, v.line_idx, row_number() OVER (PARTITION BY f.page, f.found_id ORDER BY
    least(sqrt((f.x0 - v.x0) ** 2 + (f.y0 - v.y0) ** 2) + sqrt((f.x1 - v.x1) ** 2 + (f.y1 - v.y1) ** 2), sqrt((f.x0 - v.x1) ** 2 + (f.y0 - v.y1) ** 2) + sqrt((f.x1 - v.x0) ** 2 + (f.y1 - v.y0) ** 2)), v.line_idx) AS r,
    least(sqrt((f.x0 - v.x0) ** 2 + (f.y0 - v.y0) ** 2) + sqrt((f.x1 - v.x1) ** 2 + (f.y1 - v.y1) ** 2), sqrt((f.x0 - v.x1) ** 2 + (f.y0 - v.y1) ** 2) + sqrt((f.x1 - v.x0) ** 2 + (f.y1 - v.y0) ** 2)) AS dist
    FROM found f JOIN fx_vlines v USING (page)) WHERE r = 1 AND dist < 2""", found=FOUND)
def lines_by_distance(spark, d):
    return lines.match_by_distance(_found(spark, d), fx.vlines(spark, d)).select("page", "found_id", "line_idx")


@query("""SELECT page, min(found_id) AS found_id FROM found f WHERE NOT EXISTS (SELECT 1 FROM fx_vlines v WHERE v.page = f.page AND v.layer = 'A-F' AND v.x0 = f.x1 AND v.y0 = f.y1
    AND v.x1 = f.x0 AND v.y1 = f.y0) GROUP BY page, x0, y0, x1, y1""", found=FOUND)
def new_dimension_lines(spark, d):
    v = fx.vlines(spark, d).where("layer = 'A-F'")
    final = v.select("page", F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("x0").alias("x1"), F.col("y0").alias("y1"))
    return lines.not_already_in(_found(spark, d), final)


SHEETS = f"""SELECT sheet AS page, CASE WHEN sheet = 2 THEN layer || x0 WHEN sheet % 2 = 1 AND layer < 'N-P' THEN layer || ' Fence' ELSE layer END AS layer
    FROM (SELECT {SHEET.format("page")} AS sheet, layer, x0::INT AS x0 FROM fx_vlines)"""


@query(f"""SELECT l.page, page_lines, layers, lines, coalesce(instances, 0) AS instances, coalesce(figures, 0) AS figures, CASE WHEN coalesce(instances, 0) = 0 THEN 'no instances'
    WHEN figures > 12 THEN 'too many figures' WHEN layers > 200 THEN 'too many layers' WHEN lines > 5000 THEN 'too many lines'
    WHEN lines = 0 AND page_lines > 15000 THEN 'too many lines on the page' END AS skip_reason FROM (
    SELECT page, count(*) AS page_lines, count(DISTINCT layer) AS layers, count(*) FILTER ({_WORDS_SQL}) AS lines FROM sheets GROUP BY page) l
    LEFT JOIN (SELECT {SHEET.format("page")} AS page, count(*) AS instances FROM fx_instances WHERE {SHEET.format("page")} <> 1 GROUP BY 1) i ON i.page = l.page
    LEFT JOIN (SELECT {SHEET.format("page")} AS page, count(*) FILTER (chunk_type = 'figure') AS figures FROM fx_chunks WHERE {SHEET.format("page")} = 3 OR page + 1 = 2 ** {SHEET.format("page")}
    GROUP BY 1) c ON c.page = l.page""", sheets=SHEETS)
def skip_guards(spark, d):
    sheet = F.floor(F.log2(F.col("page") + 1))
    name = F.when(F.col("page") == 2, F.concat("layer", F.col("x0").cast("int").cast("string")))
    name = name.when((F.col("page") % 2 == 1) & (F.col("layer") < "N-P"), F.concat("layer", F.lit(" Fence"))).otherwise(F.col("layer"))
    v = fx.vlines(spark, d).withColumn("page", sheet).withColumn("layer", name)
    i = fx.instances(spark, d).withColumn("page", sheet).where("page <> 1")
    c = fx.chunks(spark, d).withColumn("sheet", sheet).where("sheet = 3 OR page + 1 = power(2, sheet)").withColumn("page", F.col("sheet"))
    return lines.skip_reasons(lines.page_counts(v, i, c)).select("page", "page_lines", "layers", "lines", "instances", "figures", "skip_reason")


DIM_FOUND = """SELECT page, dim_id, line_idx FROM (SELECT *, row_number() OVER (PARTITION BY page, dim_id ORDER BY score, line_idx) AS r
    FROM (SELECT page, dim_id, line_idx, abs(length_pts - value_ft * 12 / 360 * 72) / (value_ft * 12 / 360 * 72) + dist / 150 * 0.3 AS score FROM (
    SELECT d.*, line_idx, length_pts, least(sqrt((x0 - dx) ** 2 + (y0 - dy) ** 2), sqrt((x1 - dx) ** 2 + (y1 - dy) ** 2),
    sqrt(((x0 + x1) / 2 - dx) ** 2 + ((y0 + y1) / 2 - dy) ** 2)) AS dist FROM dims d JOIN fx_telling_vlines v USING (page) WHERE length_pts >= 5) WHERE dist <= 150))
    WHERE r = 1 AND score < 1.0"""
COUNTED = f"""SELECT v.page, v.line_idx, v.length_pts, x0, y0, x1, y1, 'layers' AS method FROM fx_telling_vlines v WHERE ({_WORDS_SQL}) AND EXISTS (SELECT 1 FROM fx_chunks c WHERE c.page = v.page
    AND chunk_type = 'figure' AND ((x0 BETWEEN cx0 - 50 AND cx1 + 50 AND y0 BETWEEN cy0 - 50 AND cy1 + 50) OR (x1 BETWEEN cx0 - 50 AND cx1 + 50 AND y1 BETWEEN cy0 - 50 AND cy1 + 50)))
    UNION ALL SELECT v.page, v.line_idx, v.length_pts, x0, y0, x1, y1, 'proximity' FROM fx_telling_vlines v WHERE length_pts BETWEEN 10 AND 200 AND v.page NOT IN (
    SELECT page FROM fx_telling_vlines WHERE {_WORDS_SQL}) AND EXISTS (SELECT 1 FROM fx_instances i WHERE i.page = v.page AND ((x0 BETWEEN ix0 - 80 AND ix1 + 80
    AND y0 BETWEEN iy0 - 80 AND iy1 + 80) OR (x1 BETWEEN ix0 - 80 AND ix1 + 80 AND y1 BETWEEN iy0 - 80 AND iy1 + 80)))"""
MORE_DIMS = """SELECT page, any_value(length_pts) AS length_pts, 'dimensions' AS method FROM (SELECT DISTINCT v.page, v.line_idx, v.x0, v.y0, v.x1, v.y1, v.length_pts FROM fx_telling_vlines v
    JOIN dim_found f ON f.page = v.page AND f.line_idx = v.line_idx) x WHERE NOT EXISTS (SELECT 1 FROM counted c WHERE c.page = x.page AND c.x0 = x.x0 AND c.y0 = x.y0 AND c.x1 = x.x1
    AND c.y1 = x.y1) GROUP BY page, x0, y0, x1, y1"""
PAGE_MEASURES = """SELECT page, method, count(*) AS segments, sum(length_pts) AS total_pts, sum(length_pts) / 72 AS total_inches, sum(length_pts) / 72 * 360 AS scaled_inches,
    sum(length_pts) / 72 * 360 / 12 AS total_feet FROM (SELECT page, length_pts, method FROM counted UNION ALL SELECT page, length_pts, method FROM more_dims)
    WHERE page IN (SELECT page FROM fx_instances) GROUP BY page, method"""
_FLOW = {"dims": DIMS, "dim_found": DIM_FOUND, "counted": COUNTED, "more_dims": MORE_DIMS, "measures": PAGE_MEASURES}


def _dims(spark, d):
    return fx.instances(spark, d).select("page", F.col("inst_ord").alias("dim_id"), F.col("ix0").alias("dx"), F.col("iy0").alias("dy"), (10.0 + F.col("inst_ord") % 60).alias("value_ft"))


@query("SELECT * FROM measures", **_FLOW)
def page_measures(spark, d):
    return lines.page_measure(fx.telling_vlines(spark, d), fx.instances(spark, d), fx.chunks(spark, d), 360.0, _dims(spark, d))


@query("""SELECT page, min(method) FILTER (method <> 'dimensions') AS method, coalesce(sum(segments) FILTER (method <> 'dimensions'), 0)::BIGINT AS segments,
    coalesce(sum(total_feet) FILTER (method <> 'dimensions'), 0) AS total_feet, coalesce(sum(segments) FILTER (method = 'dimensions'), 0)::BIGINT AS dimension_segments,
    coalesce(sum(total_feet) FILTER (method = 'dimensions'), 0) AS dimension_feet FROM measures GROUP BY page""", **_FLOW)
def page_measure_totals(spark, d):
    return lines.page_measure_totals(page_measures(spark, d))


# Votes and clusters

NEAREST = """SELECT page, line_idx, layer, indicator FROM (SELECT v.page, v.line_idx, v.layer, i.indicator, row_number() OVER (PARTITION BY v.page, v.line_idx ORDER BY
    (((ix0 + ix1) / 2 - (x0 + x1) / 2) ** 2 + ((iy0 + iy1) / 2 - (y0 + y1) / 2) ** 2), i.inst_ord) AS r FROM fx_named_vlines v JOIN fx_instances i USING (page)
    WHERE ((ix0 + ix1) / 2 - (x0 + x1) / 2) ** 2 + ((iy0 + iy1) / 2 - (y0 + y1) / 2) ** 2 < 6400) WHERE r = 1"""
BY_TOKEN = r"""SELECT page, layer, min(cat) AS by_token FROM (SELECT DISTINCT l.page, l.layer, t.cat FROM (SELECT DISTINCT page, layer FROM fx_named_vlines) l JOIN (
    SELECT page, indicator || ': ' || keyword AS cat, regexp_replace(unnest(string_split(upper(keyword), ' ')), '[^\p{L}\p{N}]', '', 'g') AS token FROM fx_page_legend) t ON t.page = l.page
    WHERE length(token) >= 5 AND contains(upper(layer), token)) GROUP BY page, layer HAVING count(*) = 1"""
VOTES = """SELECT s.page, s.layer, w.indicator, coalesce(w.votes, 0) AS votes, coalesce(w.total_votes, 0)::BIGINT AS total_votes, s.line_count,
    round_even(coalesce(w.total_votes, 0) / s.line_count, 3) AS participation, CASE WHEN ok THEN w.indicator || ': ' || g.keyword ELSE by_token END AS category,
    CASE WHEN ok THEN 'indicator-vote' WHEN by_token IS NOT NULL THEN 'layer-token' ELSE 'none' END AS decided_by
    FROM (SELECT page, layer, count(*) AS line_count FROM fx_named_vlines GROUP BY page, layer) s LEFT JOIN (
    SELECT *, row_number() OVER (PARTITION BY page, layer ORDER BY votes DESC, first_line) AS r, sum(votes) OVER (PARTITION BY page, layer) AS total_votes FROM (
    SELECT page, layer, indicator, count(*) AS votes, min(line_idx) AS first_line FROM nearest GROUP BY page, layer, indicator)) w
    ON w.page = s.page AND w.layer = s.layer AND w.r = 1 LEFT JOIN fx_page_legend g ON g.page = s.page AND g.indicator = w.indicator
    LEFT JOIN by_token b ON b.page = s.page AND b.layer = s.layer,
    LATERAL (SELECT coalesce(w.votes >= 3 AND w.votes / w.total_votes >= 0.5 AND w.total_votes / s.line_count >= 0.05, false) AS ok)"""
_VOTED = {"nearest": NEAREST, "by_token": BY_TOKEN, "votes": VOTES}


def _votes(spark, d):
    return voting.layer_votes(fx.named_vlines(spark, d), fx.instances(spark, d), fx.page_legend(spark, d))


@query("SELECT page, line_idx, indicator FROM nearest", nearest=NEAREST)
def nearest_indicators(spark, d):
    return voting.nearest_indicator(fx.named_vlines(spark, d), fx.instances(spark, d)).select("page", "line_idx", "indicator")


@query("SELECT * FROM votes", **_VOTED)
def layer_votes(spark, d):
    return _votes(spark, d)


@query("""SELECT page, coalesce(sum(line_count) FILTER (decided_by = 'indicator-vote'), 0)::BIGINT AS by_indicator,
    coalesce(sum(line_count) FILTER (decided_by = 'layer-token'), 0)::BIGINT AS by_layer,
    coalesce(sum(line_count) FILTER (decided_by = 'none'), 0)::BIGINT AS unassigned, sum(line_count)::BIGINT AS total, count(*) AS layers, count(category) AS layers_assigned
    FROM votes GROUP BY page""", **_VOTED)
def vote_stats(spark, d):
    return voting.vote_stats(_votes(spark, d))


@query("""SELECT v.page, v.line_idx, w.category FROM fx_named_vlines v JOIN votes w USING (page, layer) WHERE w.category IS NOT NULL""", **_VOTED)
def voted_assignments(spark, d):
    return voting.assignments(fx.named_vlines(spark, d), _votes(spark, d))


DIRECTED = """SELECT page, layer, line_idx, x0 AS px, y0 AS py, y0 = y1 AS flat FROM fx_vlines UNION ALL SELECT page, layer, line_idx, x1, y1, y0 = y1 FROM fx_vlines"""
SHAPES = """SELECT page, run, lines, pts, bx0, by0, bx1, by1, greatest(w, h) / (least(w, h) + 0.01) AS aspect, CASE WHEN w > 3 * h THEN 'horizontal' WHEN h > 3 * w THEN 'vertical'
    ELSE 'mixed' END AS orientation FROM (SELECT *, bx1 - bx0 AS w, by1 - by0 AS h FROM (SELECT page, run, count(*) AS lines, sum(length_pts) AS pts, min(least(x0, x1)) AS bx0,
    min(least(y0, y1)) AS by0, max(greatest(x0, x1)) AS bx1, max(greatest(y0, y1)) AS by1 FROM reached GROUP BY page, run))"""


def with_clusters(far: float, name: str = "", lines: str = "fx_vlines") -> dict[str, str]:
    """CTEs that end in shapes, the clusters of ``lines`` (level or upright ones) by ends closer than ``far``; least labels
    spread over the edges until none changes."""
    comps = f"""SELECT page, line_idx, line_idx FROM {lines} UNION (SELECT e.page, e.b, min(c.run) FROM comps{name} c JOIN edges{name} e ON e.page = c.page AND e.a = c.node
        JOIN recurring.comps{name} r ON r.page = e.page AND r.node = e.b WHERE c.run < r.run GROUP BY e.page, e.b)"""
    return {
        f"ends{name}": DIRECTED.replace("fx_vlines", lines), f"edges{name}": near_ends(far, "AND a.flat = b.flat").replace("FROM ends a JOIN ends b", f"FROM ends{name} a JOIN ends{name} b"),
        f"comps{name}(page, node, run) USING KEY (page, node)": comps,
        f"reached{name}": f"SELECT v.*, c.run FROM {lines} v JOIN comps{name} c ON c.page = v.page AND c.node = v.line_idx", f"shapes{name}": SHAPES.replace("FROM reached", f"FROM reached{name}"),
    }


@query("SELECT * FROM shapes WHERE lines >= 3 AND pts >= 100 AND aspect >= 3", **with_clusters(30))
def cluster_regions(spark, d):
    return voting.fence_like(voting.cluster_shapes(voting.clusters(fx.vlines(spark, d))))


@query("""SELECT s.page, s.run, arg_min(indicator, inst_ord) AS indicator FROM shapes s JOIN fx_instances i ON i.page = s.page AND sqrt(((bx0 + bx1) / 2 - (ix0 + ix1) / 2) ** 2
    + ((by0 + by1) / 2 - (iy0 + iy1) / 2) ** 2) <= 100 GROUP BY s.page, s.run""", **with_clusters(8))
def clusters_near_indicators(spark, d):
    return voting.clusters_near(voting.cluster_shapes(voting.clusters(fx.vlines(spark, d), 8.0, 15.0)), fx.instances(spark, d))


_PRESETS = {name: (f"_{name}", *values) for name, values in voting.PRESETS.items()}


@query(" UNION ALL ".join(f"SELECT *, '{name}' AS method FROM shapes{k} WHERE lines >= {n} AND pts >= {pts} AND aspect >= {aspect}" for name, (k, _, _, n, pts, aspect) in _PRESETS.items()),
    **{c: t_ for k, far, *_ in _PRESETS.values() for c, t_ in with_clusters(far, k).items()})
def preset_regions(spark, d):
    """The three fixed presets; lines are level or upright, so that their angles don't tell them apart."""
    return voting.preset_regions(fx.vlines(spark, d))


FIRST = """SELECT page, line_idx, min(inst_ord) AS inst_ord FROM fx_vlines JOIN fx_instances USING (page) WHERE
    sqrt((x0 - (ix0 + ix1) / 2) ** 2 + (y0 - (iy0 + iy1) / 2) ** 2) <= 150 OR sqrt((x1 - (ix0 + ix1) / 2) ** 2 + (y1 - (iy0 + iy1) / 2) ** 2) <= 150
    OR sqrt(((x0 + x1) / 2 - (ix0 + ix1) / 2) ** 2 + ((y0 + y1) / 2 - (iy0 + iy1) / 2) ** 2) <= 150 GROUP BY page, line_idx"""
CLAIMS = """SELECT page, inst_ord, list(struct_pack(run := run, n := n) ORDER BY run) AS runs, row_number() OVER (PARTITION BY page ORDER BY inst_ord) AS seq FROM (
    SELECT DISTINCT f.page, f.inst_ord, r.run, z.n FROM first_lines f JOIN reached r ON r.page = f.page AND r.line_idx = f.line_idx JOIN (
    SELECT page, run, count(*) AS n FROM reached GROUP BY page, run) z ON z.page = r.page AND z.run = r.run) GROUP BY page, inst_ord"""
WALK = """SELECT page, 0::BIGINT AS seq, []::BIGINT[] AS taken, NULL::BIGINT AS inst_ord, 0::BIGINT AS lines FROM claims GROUP BY page UNION ALL
    SELECT c.page, c.seq, CASE WHEN n >= 3 THEN list_concat(w.taken, list_transform(free, lambda x: x.run)) ELSE w.taken END, c.inst_ord, CASE WHEN n >= 3 THEN n ELSE 0 END
    FROM walk w JOIN claims c ON c.page = w.page AND c.seq = w.seq + 1, LATERAL (SELECT list_filter(c.runs, lambda x: NOT list_contains(w.taken, x.run)) AS free) a,
    LATERAL (SELECT coalesce(list_sum(list_transform(free, lambda x: x.n)), 0)::BIGINT AS n) b"""
_CLAIMED = {**with_reach(near_ends(6), ends=ENDS), "first_lines": FIRST, "claims": CLAIMS, "walk": WALK}


def _claimed(spark, d):
    v = lines.runs(fx.vlines(spark, d), 6.0)
    first = voting.first_indicator_lines(fx.vlines(spark, d), fx.instances(spark, d))
    seeds = first.join(v.select("page", "line_idx", "run"), ["page", "line_idx"]).select("page", "inst_ord", "run")
    return v, seeds, voting.indicator_regions(v, seeds)


@query("SELECT page, inst_ord, lines FROM walk WHERE lines > 0", **_CLAIMED)
def indicator_regions(spark, d):
    return _claimed(spark, d)[2]


FREE = """SELECT page, line_idx, layer, length_pts, x0, y0, x1, y1 FROM reached r WHERE NOT EXISTS (SELECT 1 FROM walk w JOIN claims c ON c.page = w.page
    AND c.inst_ord = w.inst_ord AND w.lines > 0 WHERE w.page = r.page AND list_contains(list_transform(c.runs, lambda x: x.run), r.run))"""


@query("SELECT page, run, lines, pts FROM shapes_free WHERE lines >= 4 AND pts >= 200 AND aspect >= 1.5", **_CLAIMED, free=FREE, **with_clusters(25, "_free", "free"))
def unclaimed_regions(spark, d):
    return voting.unclaimed_regions(*_claimed(spark, d), 25.0, 20.0, (4, 200.0, 1.5)).select("page", "run", "lines", "pts")


@query("SELECT * FROM first_lines", first_lines=FIRST)
def first_indicator_lines(spark, d):
    return voting.first_indicator_lines(fx.vlines(spark, d), fx.instances(spark, d)).select("page", "line_idx", "inst_ord")


# Page text

HITS = "SELECT doc_id, page_idx, ord, text, k AS keyword FROM fx_lines, (VALUES " + ", ".join(f"('{k}')" for k in WORDS) + ") w(k) WHERE CASE k " + " ".join(
    f"WHEN '{k}' THEN {p}" for k, p in _HAS.items()
) + " END"
PAGE_KW = "SELECT doc_id, page_idx, text, list_filter([" + ", ".join(f"CASE WHEN {p} THEN '{k}' END" for k, p in _HAS.items()) + """], lambda x: x IS NOT NULL) AS keywords
    FROM (SELECT doc_id, page_idx, string_agg(text, ' ' ORDER BY ord) AS text FROM fx_lines GROUP BY doc_id, page_idx)"""


@query("SELECT doc_id, page_idx, ord, keyword FROM hits", hits=HITS)
def keyword_lines(spark, d):
    return pages.keyword_lines(fx.lines(spark, d), WORDS).select("doc_id", "page_idx", "ord", "keyword")


def _page_keywords(spark, d):
    return pages.page_keywords(fx.lines(spark, d), WORDS)


@query("SELECT doc_id, page_idx, len(keywords) > 0 AS has_keywords, array_to_string(keywords, ',') AS keywords, length(text) AS text_length FROM kw", kw=PAGE_KW)
def page_keywords(spark, d):
    return _page_keywords(spark, d).withColumn("keywords", F.array_join("keywords", ","))


_SCORE = "(SELECT doc_id, page_idx, arg_max(is_relevant, confidence * 10 + is_relevant::INT) AS is_relevant, max(confidence) AS confidence FROM fx_scores GROUP BY doc_id, page_idx)"


@query(f"""SELECT k.doc_id, k.page_idx, CASE WHEN len(keywords) = 0 THEN false WHEN list_has_any(keywords, ['license', 'fence']) THEN true
    WHEN coalesce(confidence >= 0.5, false) THEN coalesce(is_relevant, false) ELSE true END AS relevant,
    CASE WHEN len(keywords) = 0 THEN 'no_keywords' WHEN list_has_any(keywords, ['license', 'fence']) THEN 'high_signal'
    WHEN coalesce(confidence >= 0.5, false) THEN 'score' ELSE 'keyword_only' END AS method, len(keywords)::INT AS keyword_count
    FROM kw k LEFT JOIN {_SCORE} s USING (doc_id, page_idx)""", kw=PAGE_KW)
def page_decisions(spark, d):
    return pages.decide(_page_keywords(spark, d), fx.scores(spark, d), [k for k, high in fx.KEYWORDS if high])


@query(f"""SELECT k.doc_id, k.page_idx, CASE WHEN len(keywords) > 0 THEN true ELSE coalesce(is_relevant, false) END AS relevant,
    CASE WHEN len(keywords) > 0 THEN 'keyword' WHEN confidence IS NOT NULL THEN 'score' ELSE 'none' END AS method, len(keywords)::INT AS keyword_count
    FROM kw k LEFT JOIN {_SCORE} s USING (doc_id, page_idx)""", kw=PAGE_KW)
def page_decisions_any_keyword(spark, d):
    return pages.decide(_page_keywords(spark, d), fx.scores(spark, d), [], "any_keyword")


#: White space at the ends, as the SQL of queries writes it.
WHITE_SQL = " || ".join(f"chr({ord(c)})" for c in t.WHITE)
#: Every text cut to about the length that decides, with white space of several kinds around it.
SHORT = r"SELECT doc_id, page_idx, chr(9) || substr(replace(text, chr(10), ' '), 1, (46 + page_key % 8)::INT) || chr(13) || chr(10) || chr(160) AS text FROM fx_pages"


def _short(spark, d):
    short = F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(1), (46 + F.col("page_key") % 8).cast("int"))
    return fx.pages(spark, d).select("doc_id", "page_idx", F.concat(F.lit("\t"), short, F.lit("\r\n\xa0")).alias("text"))


@query(f"SELECT doc_id, page_idx, text FROM short WHERE length(trim(text, {WHITE_SQL})) < 50", short=SHORT)
def pages_to_read(spark, d):
    return pages.needs_reading(_short(spark, d))


SICK = """SELECT doc_id, CASE WHEN page_key % 13 = 5 THEN -1 ELSE page_idx END AS page_idx, page_key, text, CASE WHEN page_key % 11 = 3 THEN 0 ELSE width END AS width, height,
    CASE page_key % 5 WHEN 1 THEN NULL WHEN 2 THEN false ELSE true END AS contents FROM fx_pages"""


def _sick(spark, d):
    p, k = fx.pages(spark, d), F.col("page_key")
    contents = F.when(k % 5 == 2, False).when(k % 5 != 1, True)
    p = p.withColumn("contents", contents).withColumn("width", F.when(k % 11 == 3, 0.0).otherwise(F.col("width")))
    return p.withColumn("page_idx", F.when(k % 13 == 5, -1).otherwise(F.col("page_idx")))


@query("""SELECT doc_id, page_key, reason IS NULL AS ok, reason FROM (SELECT doc_id, page_key, CASE WHEN page_idx < 0 THEN 'page index out of range' WHEN width <= 0 THEN 'no size'
    WHEN NOT coalesce(contents, false) THEN 'no contents' END AS reason FROM sick)""", sick=SICK)
def page_health(spark, d):
    return pages.health(_sick(spark, d)).select("doc_id", "page_key", "ok", "reason")


@query(f"""SELECT page_key FROM (SELECT page_key, page_idx, width, contents, CASE WHEN page_key % 3 = 0 THEN chr(9) || chr(10) ELSE text END AS text FROM sick)
    WHERE page_idx >= 0 AND width > 0 AND contents AND length(trim(text, {WHITE_SQL})) < 50""", sick=SICK)
def scanned_pages(spark, d):
    """Healthy pages to read as images: every third has contents but no text."""
    scanned = _sick(spark, d).withColumn("text", F.when(F.col("page_key") % 3 == 0, F.lit("\t\n")).otherwise(F.col("text")))
    return pages.needs_reading(pages.split_broken(pages.health(scanned))[0]).select("page_key")


@query("SELECT page_key, CASE WHEN page_idx < 0 THEN 'page index out of range' WHEN width <= 0 THEN 'no size' ELSE 'no contents' END AS reason FROM sick WHERE page_idx < 0 OR width <= 0 OR NOT coalesce(contents, false)", sick=SICK)
def broken_pages(spark, d):
    return pages.split_broken(pages.health(_sick(spark, d)))[1].select("page_key", "reason")


@query(f"""SELECT doc_id, page_idx, ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_idx, has ORDER BY ord) AS r FROM (
    SELECT doc_id, 0 AS page_idx, page_idx * 100000 + ord AS ord, {' OR '.join(_HAS.values())} AS has FROM fx_lines)) WHERE has OR r <= 50""")
def keyword_lines_first(spark, d):
    """A document's lines as those of one page, so that it has more than the limit."""
    whole = fx.lines(spark, d).withColumn("ord", F.col("page_idx") * 100000 + F.col("ord")).withColumn("page_idx", F.lit(0))
    return pages.keyword_first(whole, WORDS).select("doc_id", "page_idx", "ord")


@query("""SELECT doc_id // 8 AS doc_id, (doc_id % 8 * 8 + page_idx)::INT AS page_idx, (row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id % 8 * 8 + page_idx) - 1) // 10 AS batch,
    substr(text, 1, 1200) AS excerpt, array_to_string(keywords[1:8], ',') AS keywords FROM kw""", kw=PAGE_KW)  # fmt: skip
def model_batches(spark, d):
    """Eight documents as one, so that it takes several batches."""
    texts = pages.page_text(fx.lines(spark, d)).join(_page_keywords(spark, d).select("doc_id", "page_idx", "keywords"), ["doc_id", "page_idx"])
    texts = texts.withColumn("page_idx", (F.col("doc_id") % 8 * 8 + F.col("page_idx")).cast("int")).withColumn("doc_id", F.floor(F.col("doc_id") / 8))
    return pages.model_batches(texts).withColumn("keywords", F.array_join("keywords", ","))


@query("SELECT doc_id, substr(string_agg(substr(text, 1, 6000), chr(10) ORDER BY page_idx), 1, 20000) AS corpus FROM fx_pages GROUP BY doc_id")
def spec_corpus(spark, d):
    return pages.spec_corpus(fx.pages(spark, d))


_AT = lambda k: f"instr(lower(text), '{k}')"


@query(f"""SELECT doc_id, page_idx, CASE {' '.join(f"WHEN {_AT(k)} > 0 THEN substr(text, greatest({_AT(k)} - 50, 1), {_AT(k)} - greatest({_AT(k)} - 50, 1) + {50 + len(k)})" for k in WORDS)} END AS snippet
    FROM fx_pages WHERE {' OR '.join(f"{_AT(k)} > 0" for k in WORDS)}""")
def keyword_snippets(spark, d):
    return pages.snippets(fx.pages(spark, d), WORDS)


@query("""SELECT doc_id, page_idx, CASE rotation WHEN 90 THEN 792 - y0 WHEN 180 THEN 612 - x0 WHEN 270 THEN y0 ELSE x0 END AS rx,
    CASE rotation WHEN 90 THEN x0 WHEN 180 THEN 792 - y0 WHEN 270 THEN 612 - x0 ELSE y0 END AS ry, ord FROM fx_lines JOIN fx_pages USING (doc_id, page_idx)""")
def rotated_lines(spark, d):
    p = fx.pages(spark, d).select("doc_id", "page_idx", "rotation", "width", "height")
    j = fx.lines(spark, d).join(p, ["doc_id", "page_idx"])
    x, y = g.rotated_point(F.col("x0"), F.col("y0"), F.col("rotation"), F.col("width"), F.col("height"))
    return j.select("doc_id", "page_idx", "ord", x.alias("rx"), y.alias("ry"))


@query("""SELECT p_partkey AS id, CASE WHEN k = 0 THEN n * 12.0 WHEN k = 1 THEN d / 1.0 * 12 WHEN k = 2 THEN n * 12.0 ELSE n * 1.0 END::DOUBLE AS scale,
    CASE k WHEN 0 THEN 'feet' WHEN 1 THEN 'fraction' WHEN 2 THEN 'bare feet' ELSE 'ratio' END AS kind, CASE k WHEN 2 THEN 'medium' ELSE 'high' END AS confidence
    FROM (SELECT p_partkey, p_partkey % 4 AS k, 10 + p_partkey % 50 AS n, 2 + p_partkey % 15 AS d FROM part)""")
def scales_from_text(spark, d):
    k, n, m = F.col("p_partkey") % 4, (10 + F.col("p_partkey") % 50).cast("string"), (2 + F.col("p_partkey") % 15).cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("sheet 3 SCALE: 1\" = "), n, F.lit("'-0\""))).when(k == 1, F.concat(F.lit("see 1/"), m, F.lit("\" = 1'-0\"")))
        .when(k == 2, F.concat(F.lit("drawn 1\" = "), n, F.lit("'"))).otherwise(F.concat(F.lit("scale 1:"), n))
    )
    s = sc.scale_from_text(text)
    return fx.read(spark, d, "part").select(F.col("p_partkey").alias("id"), s.alias("s")).select("id", "s.scale", "s.kind", "s.confidence")


# Layout and legend

TOKENS = "SELECT page, inst_ord AS tok_ord, indicator AS text, ix0 AS tx0, iy0 AS ty0, ix1 AS tx1, iy1 AS ty1 FROM fx_instances"


def _tokens(spark, d):
    return fx.instances(spark, d).select("page", F.col("inst_ord").alias("tok_ord"), F.col("indicator").alias("text"), *[F.col(f"i{c}").alias(f"t{c}") for c in ("x0", "y0", "x1", "y1")])


@query("""SELECT page, chunk_ord, CASE WHEN chunk_type = 'figure' AND NOT contains(chunk_text, 'LEGEND') THEN 'figure' ELSE 'legend' END AS segment FROM fx_chunks""")
def chunk_segments(spark, d):
    return layout.segmented(fx.chunks(spark, d)).select("page", "chunk_ord", "segment")


@query("""SELECT page, tok_ord, chunk_ord FROM tokens JOIN fx_chunks USING (page) WHERE (tx0 + tx1) / 2 BETWEEN cx0 AND cx1 AND (ty0 + ty1) / 2 BETWEEN cy0 AND cy1""", tokens=TOKENS)
def tokens_in_chunks(spark, d):
    return layout.tokens_in(_tokens(spark, d), fx.chunks(spark, d)).select("page", "tok_ord", "chunk_ord")


@query("""SELECT page, chunk_ord, string_agg(text, ' ' ORDER BY tok_ord) AS text FROM tokens JOIN fx_chunks USING (page) WHERE (tx0 + tx1) / 2 BETWEEN cx0 AND cx1
    AND (ty0 + ty1) / 2 BETWEEN cy0 AND cy1 GROUP BY page, chunk_ord""", tokens=TOKENS)
def chunk_texts(spark, d):
    return layout.chunk_text(_tokens(spark, d), fx.chunks(spark, d))


NESTED = """SELECT page, chunk_ord, cx0, cy0, cx1, cy1 FROM fx_chunks UNION ALL SELECT page, 9, 0, 0, 612, 792 FROM fx_chunks WHERE chunk_ord = 0 UNION ALL
    SELECT page, chunk_ord + 10, cx0 + 50 + page % 9, cy0 + 50, cx1 - 60, cy1 - 70 FROM fx_chunks"""


@query("""SELECT page, tok_ord, arg_min(chunk_ord, (cx1 - cx0) * (cy1 - cy0) * 100 + chunk_ord) AS chunk_ord FROM tokens JOIN nested USING (page) WHERE (tx0 + tx1) / 2 BETWEEN cx0 AND cx1
    AND (ty0 + ty1) / 2 BETWEEN cy0 AND cy1 GROUP BY page, tok_ord""", tokens=TOKENS, nested=NESTED)
def smallest_chunks(spark, d):
    c = fx.chunks(spark, d).select("page", "chunk_ord", *[f"c{k}" for k in ("x0", "y0", "x1", "y1")])
    whole = c.where("chunk_ord = 0").select("page", F.lit(9).cast("long").alias("chunk_ord"), *[F.lit(float(v)).alias(n) for n, v in (("cx0", 0), ("cy0", 0), ("cx1", 612), ("cy1", 792))])
    inner = c.select("page", (F.col("chunk_ord") + 10).alias("chunk_ord"), (F.col("cx0") + 50 + F.col("page") % 9).alias("cx0"), (F.col("cy0") + 50).alias("cy0"), (F.col("cx1") - 60).alias("cx1"), (F.col("cy1") - 70).alias("cy1"))
    return layout.smallest_chunk(_tokens(spark, d), c.unionByName(whole).unionByName(inner))


OVERLAP = """SELECT page, tok_ord, chunk_ord, chunk_type, i / ((tx1 - tx0) * (ty1 - ty0)) AS token_overlap, i / (306.0 * 396) AS chunk_overlap,
    i / ((tx1 - tx0) * (ty1 - ty0) + 306.0 * 396 - i) AS iou, ((tx0 + tx1) / 2 BETWEEN cx0 AND cx1 AND (ty0 + ty1) / 2 BETWEEN cy0 AND cy1)::INT AS inside FROM (
    SELECT *, (least(tx1, cx1) - greatest(tx0, cx0)) * (least(ty1, cy1) - greatest(ty0, cy0)) AS i FROM tokens JOIN fx_chunks USING (page)
    WHERE tx0 < cx1 AND cx0 < tx1 AND ty0 < cy1 AND cy0 < ty1)"""
TAGGED = """SELECT page, tok_ord, chunk_ord, chunk_type, token_overlap, iou, inside FROM (SELECT *, row_number() OVER (PARTITION BY page, tok_ord
    ORDER BY 2 * iou + inside + 0.5 * token_overlap + 0.3 * chunk_overlap DESC, chunk_ord) AS r FROM overlap WHERE token_overlap >= 0.1) WHERE r = 1"""


@query("SELECT t.page, t.tok_ord, g.chunk_ord, g.chunk_type FROM tokens t LEFT JOIN tagged g USING (page, tok_ord)", tokens=TOKENS, overlap=OVERLAP, tagged=TAGGED)
def token_tags(spark, d):
    return layout.best_chunk(_tokens(spark, d), fx.chunks(spark, d)).select("page", "tok_ord", "chunk_ord", "chunk_type")


@query("""SELECT chunk_type, count(*) AS tokens, round(avg(token_overlap), 4) AS overlap, round(avg(iou), 6) AS iou, round(100 * avg(inside), 2) AS inside_pct FROM tagged GROUP BY chunk_type""",
    tokens=TOKENS, overlap=OVERLAP, tagged=TAGGED)
def tag_quality(spark, d):
    return layout.tag_quality(layout.best_chunk(_tokens(spark, d), fx.chunks(spark, d)))


@query("""SELECT page, tok_ord, sum(j) OVER (PARTITION BY page ORDER BY ty0, tx0, tok_ord)::BIGINT AS line_no FROM (SELECT *, coalesce(ty0 - lag(ty0) OVER
    (PARTITION BY page ORDER BY ty0, tx0, tok_ord) > 5, false)::INT AS j FROM tokens)""", tokens=TOKENS)
def token_rows(spark, d):
    return layout.text_rows(_tokens(spark, d)).select("page", "tok_ord", "line_no")


READ = """SELECT page, tok_ord, CASE tok_ord % 4 WHEN 1 THEN lower(text) WHEN 2 THEN text || 'x' ELSE text END AS text, tx0 + tok_ord % 3 * 4 AS tx0, ty0, tx1 + tok_ord % 3 * 4 AS tx1, ty1 FROM tokens"""


def _read_tokens(spark, d):
    k, n = F.col("tok_ord") % 3 * 4, F.col("tok_ord") % 4
    text = F.when(n == 1, F.lower("text")).when(n == 2, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return _tokens(spark, d).withColumn("text", text).withColumn("tx0", F.col("tx0") + k).withColumn("tx1", F.col("tx1") + k)


@query("""SELECT page, tok_ord, text, tx0 FROM tokens UNION ALL SELECT page, min(tok_ord), text, min_by(tx0, tok_ord) FROM read_ r WHERE NOT EXISTS (SELECT 1 FROM tokens t WHERE t.page = r.page
    AND round_even(t.tx0, 0) = round_even(r.tx0, 0) AND round_even(t.ty0, 0) = round_even(r.ty0, 0) AND t.text = r.text) GROUP BY page, round_even(tx0, 0), round_even(ty0, 0), text""", tokens=TOKENS, read_=READ)
def merged_tokens(spark, d):
    return layout.merged_tokens(_tokens(spark, d), _read_tokens(spark, d)).select("page", "tok_ord", "text", "tx0")


HAVE = "SELECT page, tok_ord, CASE tok_ord % 5 WHEN 0 THEN text WHEN 1 THEN 'zzzz' ELSE text || '?' END AS text, tx0, ty0, tx1, ty1 FROM tokens"


@query("""SELECT r.page, r.tok_ord FROM read_ r WHERE NOT EXISTS (SELECT 1 FROM have p WHERE p.page = r.page AND p.text = r.text) AND NOT EXISTS (SELECT 1 FROM have p WHERE p.page = r.page
    AND p.tx0 < r.tx1 AND r.tx0 < p.tx1 AND p.ty0 < r.ty1 AND r.ty0 < p.ty1 AND (least(p.tx1, r.tx1) - greatest(p.tx0, r.tx0)) * (least(p.ty1, r.ty1) - greatest(p.ty0, r.ty0)) / 200 > 0.3
    AND len(list_intersect(list_distinct(string_split(lower(p.text), '')), list_distinct(string_split(lower(r.text), '')))) / greatest(len(list_distinct(string_split(lower(p.text), ''))),
    len(list_distinct(string_split(lower(r.text), '')))) > 0.7)""", tokens=TOKENS, read_=READ, have=HAVE)
def tokens_without_repeats(spark, d):
    have = _tokens(spark, d).withColumn("text", F.when(F.col("tok_ord") % 5 == 0, F.col("text")).when(F.col("tok_ord") % 5 == 1, "zzzz").otherwise(F.concat("text", F.lit("?"))))
    return layout.without_repeats(_read_tokens(spark, d), have, 0.3, 0.7).select("page", "tok_ord")


_OVER = "(least(p.tx1, r.tx1) - greatest(p.tx0, r.tx0)) * (least(p.ty1, r.ty1) - greatest(p.ty0, r.ty0))"
_CHARS = "list_distinct(string_split(lower(trim({})), ''))"
_SIM = f"""CASE WHEN lower(trim(p.text)) = lower(trim(r.text)) THEN 1.0 WHEN contains(lower(trim(p.text)), lower(trim(r.text))) OR contains(lower(trim(r.text)), lower(trim(p.text))) THEN 0.8
    ELSE len(list_intersect({_CHARS.format("p.text")}, {_CHARS.format("r.text")})) / len(list_distinct(list_concat({_CHARS.format("p.text")}, {_CHARS.format("r.text")}))) END"""
USED = f"""SELECT r.page, r.tok_ord AS r_ord, min(p.tok_ord) AS tok_ord FROM tokens p JOIN read_ r ON r.page = p.page AND p.tx0 < r.tx1 AND r.tx0 < p.tx1 AND p.ty0 < r.ty1 AND r.ty0 < p.ty1
    WHERE {_OVER} / least((p.tx1 - p.tx0) * (p.ty1 - p.ty0), (r.tx1 - r.tx0) * (r.ty1 - r.ty0)) >= 0.3 AND {_SIM} >= 0.7 GROUP BY r.page, r.tok_ord"""


@query("""SELECT p.page, 'pdf' AS source, p.tok_ord, CASE WHEN coalesce(length(j.said) > length(p.text), false) THEN j.said ELSE p.text END AS text, least(p.tx0, j.mx0) AS x0, least(p.ty0, j.my0) AS y0,
    greatest(p.tx1, j.mx1) AS x1, greatest(p.ty1, j.my1) AS y1, j.page IS NOT NULL AS merged FROM tokens p LEFT JOIN (SELECT u.page, u.tok_ord, min(r.tx0) AS mx0, min(r.ty0) AS my0,
    max(r.tx1) AS mx1, max(r.ty1) AS my1, arg_min(r.text, -length(r.text) * 1000000000 + u.r_ord) AS said FROM used u JOIN read_ r ON r.page = u.page AND r.tok_ord = u.r_ord GROUP BY u.page, u.tok_ord) j
    ON j.page = p.page AND j.tok_ord = p.tok_ord UNION ALL SELECT r.page, 'ocr', r.tok_ord, r.text, r.tx0, r.ty0, r.tx1, r.ty1, false FROM read_ r WHERE (r.page, r.tok_ord) NOT IN (
    SELECT page, r_ord FROM used)""", tokens=TOKENS, read_=READ, used=USED)
def merged_readings(spark, d):
    return layout.merged_readings(_tokens(spark, d), _read_tokens(spark, d))


@query("SELECT page, tok_ord, (tx1 - tx0) AS width, (ty1 - ty0) AS height, (tx0 + tx1) / 2 AS cx, (ty0 + ty1) / 2 AS cy, (tx1 - tx0) * (ty1 - ty0) AS area, text FROM tokens", tokens=TOKENS)
def item_sizes(spark, d):
    return layout.item_sizes(_tokens(spark, d))


CODES = """SELECT page, inst_ord AS tok_ord, CASE WHEN k % 2 = 0 THEN 'F-' || k ELSE '0' || k || '.0' || k % 7 END AS code, CASE WHEN k % 2 = 0 THEN CASE f WHEN 0 THEN 'F-' || k WHEN 1 THEN '(F-' || k || ')'
    WHEN 2 THEN '[F' || k || ']' WHEN 3 THEN ' F' || k ELSE 'F--' || k END ELSE CASE f WHEN 0 THEN '0' || k || '.0' || k % 7 WHEN 1 THEN k || '.' || k % 7 WHEN 2 THEN '(00' || k || '.' || k % 7 || ')'
    WHEN 3 THEN '[' || k || '.00' || k % 7 || ']' ELSE k || ' ' || k % 7 END END AS text, f FROM (SELECT page, inst_ord, substr(indicator, 3)::BIGINT AS k, inst_ord % 5 AS f FROM fx_instances)"""


@query("SELECT page, tok_ord, code AS indicator FROM codes WHERE f < 4", codes=CODES)
def matched_indicators(spark, d):
    k, f = F.substring("indicator", 3, F.lit(9)).cast("long"), F.col("inst_ord") % 5
    code = lambda k: F.when(k % 2 == 0, F.concat(F.lit("F-"), k)).otherwise(F.concat(F.lit("0"), k, F.lit(".0"), k % 7))
    c = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    even = F.when(f == 0, c("F-", k)).when(f == 1, c("(F-", k, ")")).when(f == 2, c("[F", k, "]")).when(f == 3, c(" F", k)).otherwise(c("F--", k))
    odd = F.when(f == 0, code(k)).when(f == 1, c(k, ".", k % 7)).when(f == 2, c("(00", k, ".", k % 7, ")")).when(f == 3, c("[", k, ".00", k % 7, "]")).otherwise(c(k, " ", k % 7))
    i = fx.instances(spark, d)
    tokens = i.select("page", F.col("inst_ord").alias("tok_ord"), F.when(k % 2 == 0, even).otherwise(odd).alias("text"))
    own = fx.page_legend(spark, d).withColumn("indicator", code(F.col("leg_ord")))
    return legend.matched_tokens(tokens, own, ["page"]).select("page", "tok_ord", "indicator")


@query("""SELECT page, tok_ord FROM tokens t WHERE NOT EXISTS (SELECT 1 FROM fx_chunks c WHERE c.page = t.page AND contains(chunk_text, 'LEGEND') AND (tx0 + tx1) / 2 BETWEEN cx0 - 20 AND cx1 + 20
    AND (ty0 + ty1) / 2 BETWEEN cy0 - 20 AND cy1 + 20)""", tokens=TOKENS)
def tokens_outside_legend(spark, d):
    boxes = fx.chunks(spark, d).where(F.contains("chunk_text", F.lit("LEGEND"))).select("page", *[F.col(f"c{c}").alias(f"l{c}") for c in ("x0", "y0", "x1", "y1")])
    return legend.outside_legend(_tokens(spark, d), boxes).select("page", "tok_ord")


KEEP_FIRST = "CASE WHEN len(list_filter(a, lambda k: {clash})) > 0 THEN a ELSE list_concat(a, x) END"


@query(f"""SELECT page, indicator, k.tok_ord, k.cx, k.cy FROM (SELECT page, text AS indicator, unnest(list_reduce(list([struct_pack(tok_ord := tok_ord, cx := (tx0 + tx1) / 2, cy := (ty0 + ty1) / 2)]
    ORDER BY tok_ord), lambda a, x: {KEEP_FIRST.format(clash="abs(k.cx - x[1].cx) < 120 AND abs(k.cy - x[1].cy) < 120")})) AS k FROM tokens GROUP BY page, text)""", tokens=TOKENS)
def instances_apart(spark, d):
    x, y = g.center(g.box("t"))
    items = _tokens(spark, d).select("page", F.col("text").alias("indicator"), "tok_ord", x.alias("cx"), y.alias("cy"))
    return legend.apart(items, ["page", "indicator"], "tok_ord", "cx", "cy", 120.0)


_IOU = "greatest(least(k.x1, x[1].x1) - greatest(k.x0, x[1].x0), 0) * greatest(least(k.y1, x[1].y1) - greatest(k.y0, x[1].y0), 0)"


@query(f"""SELECT page, k.tok_ord, k.x0, k.y0, k.x1, k.y1 FROM (SELECT page, unnest(list_reduce(list([struct_pack(tok_ord := tok_ord, x0 := tx0 - 40, y0 := ty0 - 40, x1 := tx1 + 40, y1 := ty1 + 40)]
    ORDER BY tok_ord), lambda a, x: {KEEP_FIRST.format(clash=f"({_IOU}) / (18000 - ({_IOU})) >= 0.2")})) AS k FROM tokens GROUP BY page)""", tokens=TOKENS)
def distinct_boxes(spark, d):
    b = _tokens(spark, d).select("page", "tok_ord", *[(F.col(f"t{c}") + m).alias(c) for c, m in (("x0", -40), ("y0", -40), ("x1", 40), ("y1", 40))])
    return legend.distinct_boxes(b, ["page"], "tok_ord", 0.2)


ENTRIES = """SELECT page, indicator, keyword, 'about ' || keyword AS description, leg_ord FROM fx_page_legend UNION ALL SELECT page, indicator, lower(keyword), '', leg_ord FROM fx_page_legend
    UNION ALL SELECT page, keyword, keyword, 'no code', leg_ord FROM fx_page_legend UNION ALL SELECT page, 'Indicator Code', keyword, 'a heading', leg_ord FROM fx_page_legend"""


@query("""SELECT page, indicator, keyword, leg_ord FROM (SELECT *, row_number() OVER (PARTITION BY page, indicator, upper(keyword) ORDER BY length(description) DESC, leg_ord) AS r
    FROM entries WHERE indicator <> keyword AND lower(indicator) <> 'indicator code') WHERE r = 1""", entries=ENTRIES)
def cleaned_legend(spark, d):
    l = fx.page_legend(spark, d).withColumn("description", F.concat(F.lit("about "), "keyword"))
    more = [l.withColumn("keyword", F.lower("keyword")).withColumn("description", F.lit("")), l.withColumn("indicator", F.col("keyword")), l.withColumn("indicator", F.lit("Indicator Code"))]
    for m in more:
        l = l.unionByName(m)
    return legend.cleaned(l).select("page", "indicator", "keyword", "leg_ord")


# Evaluation


@query("""SELECT page, pred_id, gold_id FROM fx_pred JOIN fx_gold USING (page) WHERE px0 < gx1 AND gx0 < px1 AND py0 < gy1 AND gy0 < py1 AND
    ((least(px1, gx1) - greatest(px0, gx0)) * (least(py1, gy1) - greatest(py0, gy0))) / (400 - (least(px1, gx1) - greatest(px0, gx0)) * (least(py1, gy1) - greatest(py0, gy0))) >= 0.1""")
def box_candidates(spark, d):
    return evaluation.candidates(fx.pred(spark, d), fx.gold(spark, d)).select("page", "pred_id", "gold_id")


BOXES = """SELECT page, pred_id, gold_id, i / (400 - i) AS iou FROM (SELECT page, pred_id, gold_id, (least(px1, gx1) - greatest(px0, gx0)) * (least(py1, gy1) - greatest(py0, gy0)) AS i
    FROM fx_pred JOIN fx_gold USING (page) WHERE px0 < gx1 AND gx0 < px1 AND py0 < gy1 AND gy0 < py1) WHERE i / (400 - i) >= 0.1"""
OPTIONS = """SELECT page, pred_id, list(struct_pack(iou := iou, gold_id := gold_id) ORDER BY -iou, gold_id) AS options, row_number() OVER (PARTITION BY page ORDER BY pred_id) AS seq
    FROM boxes GROUP BY page, pred_id"""
MATCHED = """SELECT page, 0::BIGINT AS seq, []::BIGINT[] AS used, NULL::BIGINT AS pred_id, NULL::STRUCT(iou DOUBLE, gold_id BIGINT) AS pick FROM options_ GROUP BY page UNION ALL
    SELECT o.page, o.seq, CASE WHEN free IS NULL THEN m.used ELSE list_append(m.used, free.gold_id) END, o.pred_id, free FROM matched m JOIN options_ o ON o.page = m.page AND o.seq = m.seq + 1,
    LATERAL (SELECT list_filter(o.options, lambda x: NOT list_contains(m.used, x.gold_id))[1] AS free) f"""
_MATCH = {"boxes": BOXES, "options_": OPTIONS, "matched": MATCHED}


@query("SELECT page, pred_id, pick.gold_id AS gold_id, pick.iou AS iou FROM matched WHERE pick IS NOT NULL", **_MATCH)
def box_matches(spark, d):
    return evaluation.box_matches(fx.pred(spark, d), fx.gold(spark, d))


_PRF = """CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE coalesce(tp / nullif(tp + fp, 0), 0.0) END::DOUBLE AS precision, CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE coalesce(tp / nullif(tp + fn, 0), 0.0) END::DOUBLE AS recall,
    CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0) END::DOUBLE AS f1"""


@query(f"""SELECT page, tp, fp, fn, {_PRF}, coalesce(iou_sum / nullif(tp, 0), 0.0) AS avg_iou FROM (SELECT page, sum(tp)::BIGINT AS tp, (sum(preds) - sum(tp))::BIGINT AS fp, (sum(golds) - sum(tp))::BIGINT AS fn,
    sum(iou_sum) AS iou_sum FROM (SELECT coalesce(p.page, g.page) AS page, coalesce(preds, 0) AS preds, coalesce(golds, 0) AS golds, coalesce(tp, 0) AS tp, coalesce(iou_sum, 0) AS iou_sum FROM (
    SELECT page, count(*) AS preds FROM fx_pred GROUP BY page) p FULL JOIN (SELECT page, count(*) AS golds FROM fx_gold GROUP BY page) g ON g.page = p.page LEFT JOIN (SELECT page, count(*) AS tp,
    sum(pick.iou) AS iou_sum FROM matched WHERE pick IS NOT NULL GROUP BY page) m ON m.page = coalesce(p.page, g.page)) GROUP BY ROLLUP (page))""", **_MATCH)
def box_metrics(spark, d):
    return evaluation.box_metrics(fx.pred(spark, d), fx.gold(spark, d))


@query("""SELECT document, tp, fp, fn, tn, CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE coalesce(tp / nullif(tp + fp, 0), 0.0) END::DOUBLE AS precision,
    CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE coalesce(tp / nullif(tp + fn, 0), 0.0) END::DOUBLE AS recall,
    CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE coalesce(2.0 * coalesce(tp / nullif(tp + fp, 0), 0.0) * coalesce(tp / nullif(tp + fn, 0), 0.0) / nullif(coalesce(tp / nullif(tp + fp, 0), 0.0) + coalesce(tp / nullif(tp + fn, 0), 0.0), 0), 0.0) END::DOUBLE AS f1,
    (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM (SELECT document, count(*) FILTER (is_gt AND is_pred) AS tp, count(*) FILTER (NOT is_gt AND is_pred) AS fp,
    count(*) FILTER (is_gt AND NOT is_pred) AS fn, count(*) FILTER (NOT is_gt AND NOT is_pred) AS tn FROM fx_page_flags GROUP BY ROLLUP (document))""")
def page_confusion(spark, d):
    return evaluation.page_confusion(fx.page_flags(spark, d))


@query("""SELECT DISTINCT document, page_idx, CASE WHEN is_gt AND is_pred THEN 'found' WHEN is_pred THEN 'wrong' ELSE 'missed' END AS kind FROM fx_page_flags WHERE is_gt OR is_pred""")
def page_sets(spark, d):
    return evaluation.page_sets(fx.page_flags(spark, d))


@query("""SELECT page, gold_id, source, item_id FROM (SELECT page, gold_id, 'pdf' AS source, pred_id AS item_id, row_number() OVER (PARTITION BY page, gold_id ORDER BY iou DESC, pred_id) AS r FROM (
    SELECT *, i / (400 - i) AS iou FROM (SELECT page, gold_id, pred_id, (least(px1, gx1) - greatest(px0, gx0)) * (least(py1, gy1) - greatest(py0, gy0)) AS i
    FROM fx_pred JOIN fx_gold USING (page) WHERE px0 < gx1 AND gx0 < px1 AND py0 < gy1 AND gy0 < py1)) WHERE iou >= 0.3) WHERE r = 1""")
def best_source_items(spark, d):
    items = fx.pred(spark, d).select("page", F.lit("pdf").alias("source"), F.col("pred_id").alias("item_id"), *[F.col(f"p{c}").alias(f"s{c}") for c in ("x0", "y0", "x1", "y1")])
    return evaluation.best_source_item(fx.gold(spark, d), items).select("page", "gold_id", "source", "item_id")


@query("""SELECT p_partkey AS id, CASE WHEN length(trim(p_type)) <= 10 AND regexp_matches(p_type, '[0-9]') THEN 'code' WHEN length(trim(p_type)) > 10 THEN 'description' ELSE 'mixed' END AS kind
    FROM (SELECT p_partkey, 'item ' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN ' of the second kind' ELSE '' END AS p_type FROM part)""")
def content_classes(spark, d):
    k = F.col("p_partkey")
    c = F.concat(F.lit("item "), k.cast("string"), F.when(k % 2 == 0, " of the second kind").otherwise(""))
    return fx.read(spark, d, "part").select(k.alias("id"), evaluation.content_class(c).alias("kind"))


# Records

NOW = "2025-01-01 00:00:00"


@query("""SELECT document, job_id, user_id, status, created_at, trade FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY created_at DESC, job_id DESC) AS r FROM fx_jobs) WHERE r = 1""")
def latest_jobs(spark, d):
    return records.latest(fx.jobs(spark, d), ["document"], "created_at", "job_id").select("document", "job_id", "user_id", "status", "created_at", "trade")


@query("""SELECT document, trade, job_id, created_at, row_number() OVER (PARTITION BY document ORDER BY (trade <> '1-URGENT')::INT, trade) AS position FROM (
    SELECT *, row_number() OVER (PARTITION BY document, trade ORDER BY created_at DESC, job_id DESC) AS r FROM fx_jobs WHERE status = 'completed') WHERE r = 1""")
def document_modes(spark, d):
    return records.modes(fx.jobs(spark, d), "1-URGENT")


@query("SELECT job_id, user_id, created_at, row_number() OVER (ORDER BY created_at, job_id) AS position FROM fx_jobs WHERE status = 'queued'")
def queue_positions(spark, d):
    return records.queue_positions(fx.jobs(spark, d))


@query("""SELECT user_id, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'completed') AS completed FROM fx_jobs GROUP BY user_id""")
def job_counts(spark, d):
    return records.job_counts(fx.jobs(spark, d))


@query("SELECT job_id FROM fx_jobs j WHERE status = 'completed' AND created_at < TIMESTAMP '1998-06-15 11:00:00' AND job_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def orphaned_jobs(spark, d):
    results = fx.read(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("job_id"))
    return records.orphans(fx.jobs(spark, d), results, F.lit("1998-06-15 12:00:00").cast("timestamp")).select("job_id")


@query("""SELECT job_id, CASE WHEN status = 'running' THEN CASE WHEN job_id % 5 >= 2 THEN 'failed' ELSE 'queued' END ELSE status END AS status,
    CASE WHEN status = 'running' AND job_id % 5 < 2 THEN job_id % 5 + 1 ELSE job_id % 5 END AS requeue_count,
    CASE WHEN status = 'running' AND job_id % 5 < 2 THEN (SELECT min(job_id) FROM fx_jobs WHERE status = 'queued') - 1 ELSE job_id END AS queue_position FROM fx_jobs""")
def jobs_after_restart(spark, d):
    j = fx.jobs(spark, d).withColumn("requeue_count", F.col("job_id") % 5).withColumn("queue_position", F.col("job_id"))
    return records.after_restart(j)


def _rank(value: str, p: int, where: str = "true") -> str:
    own = f"FILTER ({value} IS NOT NULL AND {where})"
    return f"(list_sort(list({value}) {own}))[round_even({p / 100} * (count(*) {own} - 1), 0)::BIGINT + 1]"


@query(f"""SELECT label, count(*) AS n, round(sum(cpu_s), 6) AS cpu_sum, {_rank("wall_s", 50)} AS wall_p50, {_rank("wall_s", 95)} AS wall_p95, {_rank("rss_delta_mb", 95)} AS rss_delta_p95,
    {_rank("peak_rss_mb", 95)} AS peak_rss_p95 FROM fx_telemetry WHERE kind = 'timed' GROUP BY label""")
def timed_report(spark, d):
    return records.timed_report(fx.telemetry(spark, d), ["label"])


@query(f"""SELECT label, count(*) AS n, {_rank("coalesce(rss_mb, 0)", 50)} AS rss_p50, {_rank("coalesce(rss_mb, 0)", 95)} AS rss_p95, max(coalesce(rss_mb, 0)) AS rss_max
    FROM fx_telemetry WHERE kind = 'checkpoint' GROUP BY label""")
def checkpoint_report(spark, d):
    return records.checkpoint_report(fx.telemetry(spark, d))


@query("SELECT label, round(avg(rss_mb), 6) AS mean, max(rss_mb) AS most, count(rss_mb) AS n FROM fx_telemetry WHERE kind = 'checkpoint' GROUP BY label")
def checkpoint_memory(spark, d):
    return records.checkpoint_memory(fx.telemetry(spark, d))


@query("SELECT label, count(*) AS n FROM fx_telemetry WHERE kind = 'event' GROUP BY label")
def event_counts(spark, d):
    return records.event_counts(fx.telemetry(spark, d))


@query("SELECT count(*) AS records, count(DISTINCT session) AS sessions, count(DISTINCT label) AS labels FROM fx_telemetry")
def headline_counts(spark, d):
    return records.headline(fx.telemetry(spark, d))


@query("SELECT user_id, count(*) AS runs, sum(tokens_in)::BIGINT AS tokens, max(ts) AS last_seen FROM fx_spend GROUP BY user_id ORDER BY runs DESC, user_id LIMIT 50")
def user_activity(spark, d):
    return records.user_activity(fx.spend(spark, d))


@query("""SELECT user_id, count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in, coalesce(sum(tokens_out), 0)::BIGINT AS tokens_out, round(coalesce(sum(cost_usd), 0), 4) AS cost_usd FROM fx_spend WHERE epoch(date_trunc('second', ts)) >= epoch(date_trunc('second', (SELECT max(ts) FROM fx_spend))) - 86400 GROUP BY user_id""")
def rolling_spend(spark, d):
    s = fx.spend(spark, d)
    last = s.agg(F.max("ts")).first()[0]  # one value
    return records.rolling_spend(s, F.lit(last))


@query("""SELECT time_bucket(INTERVAL '300 seconds', ts) AS start, count(*) AS records, count(*) FILTER (wall_s > 50) AS problems FROM fx_telemetry GROUP BY 1""")
def heartbeats(spark, d):
    from sheetlens.streaming import live

    return live.heartbeats(fx.telemetry(spark, d), bad=F.col("wall_s") > 50).select("start", "records", "problems")


@query("""SELECT event_id, label, session FROM (SELECT *, lag(bucket) OVER (PARTITION BY session ORDER BY ts, event_id) AS before FROM (SELECT *, floor(wall_s / 10) AS bucket FROM fx_telemetry))
    WHERE before IS NULL OR bucket <> before""")
def progress_changes(spark, d):
    from sheetlens.streaming import live

    e = fx.telemetry(spark, d).withColumn("job_id", F.col("session")).withColumn("pct", F.floor(F.col("wall_s") / 10)).withColumn("status", F.lit("running"))
    return live.progress_changes(e).select("event_id", "label", "session")


NUMBERED_PAGES = "SELECT doc_id, page_idx, length(text)::DOUBLE AS bytes, row_number() OVER (PARTITION BY doc_id ORDER BY page_idx) AS seq FROM fx_pages"
BATCHES = """SELECT doc_id, 0::BIGINT AS seq, NULL::INT AS page_idx, 0::DOUBLE AS bytes, 0::INT AS batch, 0::DOUBLE AS total, 0 AS n, false AS closed FROM numbered GROUP BY doc_id UNION ALL
    SELECT p.doc_id, p.seq, p.page_idx, p.bytes, b.batch + fresh::INT, CASE WHEN fresh THEN p.bytes ELSE b.total + p.bytes END, CASE WHEN fresh THEN 1 ELSE b.n + 1 END, p.bytes > 5000
    FROM batches b JOIN numbered p ON p.doc_id = b.doc_id AND p.seq = b.seq + 1, LATERAL (SELECT b.n > 0 AND (p.bytes > 5000 OR b.closed OR b.total + p.bytes > 6000 OR b.n >= 3) AS fresh) f"""


@query("SELECT doc_id, page_idx, bytes, batch FROM batches WHERE seq > 0", numbered=NUMBERED_PAGES, batches=BATCHES)
def page_batches(spark, d):
    from sheetlens.plans.fold import packed

    p = fx.pages(spark, d).select("doc_id", F.col("page_idx").cast("long").alias("page_idx"), F.length("text").alias("bytes"))
    return packed(p, ["doc_id"], "page_idx", "bytes", 6000.0, 3, 5000.0)


@query("""SELECT d.doc_id, d.page_idx, s.doc_id IS NOT NULL AS covered FROM fx_pages d LEFT JOIN (SELECT DISTINCT doc_id, page_idx FROM fx_scores) s USING (doc_id, page_idx)""")
def phase_coverage(spark, d):
    return records.covered(fx.pages(spark, d).select("doc_id", "page_idx"), fx.scores(spark, d), ["doc_id", "page_idx"])


@query("SELECT doc_id, page_idx, length(text) > 800 AS truncated, CASE WHEN length(text) > 800 THEN substr(text, 1, 800) || '…' ELSE text END AS text FROM fx_pages")
def slim_pages(spark, d):
    return records.slim(fx.pages(spark, d).select("doc_id", "page_idx", "text"))


@query("""SELECT page, sheet FROM (SELECT s_suppkey AS page, CASE s_suppkey % 3 WHEN 0 THEN 'ARCH D (portrait)' WHEN 1 THEN 'ARCH A (scaled 94.4%)' ELSE NULL END AS sheet FROM supplier)""")
def sheet_sizes(spark, d):
    k = F.col("s_suppkey") % 3
    w = F.when(k == 0, 36 * 72.0).when(k == 1, 8.5 * 72).otherwise(100.0)
    h = F.when(k == 0, 24 * 72.0).when(k == 1, 11 * 72.0).otherwise(5000.0)
    return fx.read(spark, d, "supplier").select(F.col("s_suppkey").alias("page"), g.sheet_size(w, h)["sheet"].alias("sheet"))


@query(rf"""SELECT doc_id, page_idx, ord, lower(regexp_replace(text, '[^0-9a-zA-Z]', '', 'g')) AS norm, lower(translate(regexp_replace(text, '\s+', '', 'g'), 'OoIlBS', '001185')) AS confusable,
    lower(trim(regexp_replace(text, '[-\s]+', ' ', 'g'), {WHITE_SQL})) AS plain, upper(replace(regexp_replace(text, '[^\p{{L}}\p{{N}}_\s]', '', 'g'), 'ß', 'SS')) AS upper_ FROM fx_lines""")
def normal_forms(spark, d):
    x = F.col("text")
    return fx.lines(spark, d).select(
        "doc_id", "page_idx", "ord", t.alnum_lower(x).alias("norm"), t.confusable(x).alias("confusable"), t.plain_spaces(x).alias("plain"), t.upper_no_signs(x).alias("upper_")
    )


# Edits, remaining measures


@query("""SELECT e.page, e.source, e.ord, e.category, e.length_pts FROM (SELECT page, 'auto' AS source, line_idx AS ord, category, length_pts FROM edits
    UNION ALL SELECT page, 'auto', line_idx, category, length_pts FROM mapped WHERE page NOT IN (SELECT page FROM edits) AND page % 4 <> 1) e""", mapped=MAPPED, edits=EDITS)
def export_states(spark, d):
    from sheetlens.operators import edits

    e = _edits(spark, d).groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct(F.col("line_idx").cast("string"), "category"))).alias("line_assignments"))
    none = {"categories": "map<string,struct<indicator:string,keyword:string,color:array<double>>>", "scale_override": "string", "min_line_pts": "string"}
    none["user_drawn_lines"] = "array<struct<start:array<double>,end:array<double>,category:string>>"
    states = e.select("*", *[F.lit(None).cast(t_).alias(n) for n, t_ in none.items()])
    skipped = fx.read(spark, d, "supplier").select(F.col("s_suppkey").alias("page")).where("page % 4 = 1")
    return edits.export_state(states, _mapped(spark, d), fx.vlines(spark, d), skipped)


@query("""SELECT page, dim_id, count(*) AS lines, sum(length_pts) AS total_pts FROM dims JOIN fx_vlines USING (page) WHERE sqrt((x0 - dx) ** 2 + (y0 - dy + 100) ** 2) <= 150
    OR sqrt((x1 - dx) ** 2 + (y1 - dy + 100) ** 2) <= 150 OR sqrt(((x0 + x1) / 2 - dx) ** 2 + ((y0 + y1) / 2 - dy + 100) ** 2) <= 150 GROUP BY page, dim_id""", dims=DIMS)
def nearby_totals(spark, d):
    dims = fx.instances(spark, d).select("page", F.col("inst_ord").alias("dim_id"), F.col("ix0").alias("dx"), F.col("iy0").alias("dy"))
    return lines.nearby_total(fx.vlines(spark, d), dims)


@query("""SELECT n.page, n.inst_ord, r.run, z.lines, z.total_pts FROM (SELECT page, inst_ord, line_idx FROM (SELECT *, row_number() OVER (PARTITION BY page, inst_ord ORDER BY dist, line_idx) AS r FROM (
    SELECT page, inst_ord, line_idx, sqrt((ix0 - greatest(least(ix0, x1), x0)) ** 2 + (iy0 - greatest(least(iy0, y1), y0)) ** 2) AS dist FROM fx_vlines JOIN fx_instances USING (page))
    WHERE dist <= 50) WHERE r = 1) n JOIN reached r ON r.page = n.page AND r.line_idx = n.line_idx JOIN (SELECT page, run, count(*) AS lines, sum(length_pts) AS total_pts FROM reached
    GROUP BY page, run) z ON z.page = r.page AND z.run = r.run""", **with_reach(near_ends(5), ends=ENDS))
def runs_at_instances(spark, d):
    return lines.run_at_point(fx.vlines(spark, d), fx.instances(spark, d), "ix0", "iy0", "inst_ord")


@query(f"""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(relevant, 0) AS relevant, coalesce(other, 0) AS other, coalesce(broken, 0) AS broken FROM (SELECT doc_id, count(*) FILTER (yes) AS relevant,
    count(*) FILTER (NOT yes) AS other FROM (SELECT k.doc_id, len(keywords) > 0 OR coalesce(is_relevant, false) AS yes FROM kw k LEFT JOIN {_SCORE} s USING (doc_id, page_idx)) GROUP BY doc_id) a
    FULL JOIN (SELECT doc_id, count(*) AS broken FROM sick WHERE page_idx < 0 OR width <= 0 OR NOT coalesce(contents, false) GROUP BY doc_id) b ON b.doc_id = a.doc_id""", kw=PAGE_KW, sick=SICK)
def page_count_report(spark, d):
    decided = pages.decide(_page_keywords(spark, d), fx.scores(spark, d), [], "any_keyword")
    return pages.page_counts(decided, pages.split_broken(pages.health(_sick(spark, d)))[1])


@query("""SELECT document, array_to_string(list_sort(list(page) FILTER (NOT broken AND relevant)), ',') AS relevant, array_to_string(list_sort(list(page) FILTER (NOT broken AND NOT relevant)), ',') AS other,
    array_to_string(list_sort(list(page) FILTER (broken)), ',') AS broken, arg_min(trade, page) FILTER (trade IS NOT NULL) AS trade FROM (SELECT s_suppkey // 8 AS document, s_suppkey AS page,
    s_acctbal > 3000 AS relevant, s_nationkey % 4 = 1 AS broken, CASE WHEN s_nationkey % 3 > 0 THEN 'trade ' || s_nationkey END AS trade FROM supplier) GROUP BY document""")
def document_results(spark, d):
    k = F.col("s_suppkey")
    p = fx.read(spark, d, "supplier").select(F.floor(k / 8).alias("document"), k.alias("page"), (F.col("s_acctbal") > 3000).alias("relevant"), (F.col("s_nationkey") % 4 == 1).alias("broken"),
        F.when(F.col("s_nationkey") % 3 > 0, F.concat(F.lit("trade "), F.col("s_nationkey").cast("string"))).alias("trade"))
    r, lists = records.document_result(p), ("relevant", "other", "broken")
    return r.select("document", *[F.when(F.size(c) > 0, F.array_join(c, ",")).alias(c) for c in lists], "trade")


from sheetlens import queries_more  # noqa: E402, F401  the queries on readers, model answers and records
