"""Registered queries on readers, layout answers, model answers, edits, detections and operational records.

Where a reader takes nested input, the query builds it from a given table first, so all of the table passes the reader.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetlens.functions import geometry as g
from sheetlens.functions import scale as sc
from sheetlens.functions import text as t
from sheetlens.operators import edits, evaluation, layout, legend, lines, pages, records, reports, voting
from sheetlens.plans import keyed
from sheetlens.plans.graph import shared_dir
from sheetlens.queries import EDITS, MAPPED, NUMBERED, OVERLAP, SCALED, SPECS, TAGGED, TOKENS, WHITE_SQL, WORDS, _edits, _numbered, _scales, _specs, _tokens, export_rows, query
from sheetlens.sources import fixtures as fx
from sheetlens.sources import readers
from sheetlens.streaming import live

# Readers


def _text_pages(spark, d):
    """Documents as extracted text: a block for each text, a line for each of its lines, spans of its two halves."""
    p = fx.pages(spark, d)
    span = lambda c: F.struct(c.alias("text"))
    line = lambda x, i: F.struct(
        F.array(F.lit(36.0), 36.0 + 12 * i, 36.0 + 5 * F.length(x), 46.0 + 12 * i).alias("bbox"), F.array(span(x), span(F.lit(""))).alias("spans")
    )
    block = F.struct(F.transform(F.split("text", "\n"), line).alias("lines"))
    return p.select("doc_id", "page_idx", "rotation", F.col("width").alias("mediabox_w"), F.col("height").alias("mediabox_h"), F.array(block).alias("blocks"))


@query("""SELECT doc_id, page_idx, ord, text, CASE rotation WHEN 90 THEN 792 - y1 WHEN 180 THEN 612 - x1 WHEN 270 THEN y0 ELSE x0 END AS x0, CASE rotation WHEN 90 THEN x0 WHEN 180 THEN 792 - y1
    WHEN 270 THEN 612 - x1 ELSE y0 END AS y0, source FROM (SELECT l.doc_id, l.page_idx, ord, l.text, rotation, 36.0::DOUBLE AS x0, 36.0::DOUBLE + 12 * ord AS y0, 36.0::DOUBLE + 5 * length(raw) AS x1, 46.0::DOUBLE + 12 * ord AS y1, source
    FROM fx_lines l JOIN fx_pages p USING (doc_id, page_idx) JOIN fx_raw r USING (doc_id, page_idx, ord))""")
def native_lines(spark, d):
    out = readers.native_lines(_text_pages(spark, d))
    return out.select("doc_id", "page_idx", F.col("line").cast("long").alias("ord"), "text", "x0", "y0", "source")


def _word_files(spark, d):
    """Documents of eight pages each, pages as a map from their number to text and words."""
    p = fx.pages(spark, d).where("page_idx >= 0")
    word = lambda w, i: F.struct(
        w.alias("text"), i.cast("double").alias("x0"), F.lit(0.0).alias("y0"), (i + F.length(w)).cast("double").alias("x1"), F.lit(9.0).alias("y1"), F.lit(0).alias("block_no"), F.lit(0).alias("line_no"), i.alias("word_no")
    )
    words = F.transform(F.filter(F.split("text", " "), lambda w: w != ""), word)
    page = F.struct((F.col("page_idx") + 1).cast("string").alias("key"), F.struct("text", words.alias("words")).alias("value"))
    return p.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(page)).alias("pages"))  # a document's pages


@query("""SELECT doc_id, page_idx + 1 AS page_num, word_no, text, x1 FROM (SELECT doc_id, page_idx, i::INT - 1 AS word_no, words[i] AS text, (i - 1 + length(words[i]))::DOUBLE AS x1 FROM (
    SELECT doc_id, page_idx, words, unnest(range(1, len(words) + 1)) AS i FROM (SELECT doc_id, page_idx, list_filter(string_split(text, ' '), lambda x: x <> '') AS words FROM fx_pages)))""")
def word_table(spark, d):
    return readers.word_table(_word_files(spark, d)).select("doc_id", "page_num", "word_no", "text", "x1")


@query("SELECT doc_id, page_idx + 1 AS page_num, length(text) AS chars, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS words FROM fx_pages")
def page_word_counts(spark, d):
    return readers.page_counts(_word_files(spark, d))


@query("""SELECT * FROM (WITH r AS (SELECT page, tok_ord, text, tx0, ty0, tx1, ty1 FROM tokens), p AS (SELECT * FROM r WHERE tok_ord % 3 <> 1), k AS (SELECT page, min(tok_ord) AS tok_ord, text, arg_min(tx0, tok_ord) AS tx0,
    arg_min(ty1, tok_ord) AS ty1 FROM r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.page = r.page AND p.text = r.text AND p.tx0 = r.tx0 AND p.ty0 = r.ty0) GROUP BY page, text, tx0, ty0)
    SELECT page AS doc_id, tok_ord AS ord, text, tx0 AS x0, ty1 AS y1, 'ocr_paragraph' AS source FROM p UNION ALL SELECT page, tok_ord, text, tx0, ty1, 'ocr_token' FROM k)""", tokens=TOKENS)
def image_boxes(spark, d):
    """Readings with corners as shares of the page: two in three tokens are paragraphs, all are tokens."""
    vertex = lambda x, y: F.struct((F.col(x) / 1024).alias("x"), (F.col(y) / 1024).alias("y"))
    corners = F.array(vertex("tx0", "ty0"), vertex("tx1", "ty0"), vertex("tx1", "ty1"), F.struct(F.lit(None).cast("double").alias("x"), (F.col("ty1") / 1024).alias("y")))
    r = _tokens(spark, d).withColumn("r", F.struct(F.col("text"), corners.alias("vertices")))
    own = r.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("tok_ord", "r"))).alias("a"))  # a page's tokens
    is_par = lambda x: x["tok_ord"] % 3 != 1
    pick = lambda keep: F.transform(F.filter("a", keep), lambda x: x["r"])
    readings = own.select(F.col("page").alias("doc_id"), F.lit(0).alias("page_idx"), pick(is_par).alias("paragraphs"), pick(lambda x: F.lit(True)).alias("tokens"))
    size = own.select(F.col("page").alias("doc_id"), F.lit(0).alias("page_idx"), F.lit(1024.0).alias("width"), F.lit(1024.0).alias("height"))
    out = readers.read_boxes(readings, size)
    ids = own.select(F.col("page").alias("doc_id"), F.transform("a", lambda x: x["tok_ord"]).alias("all"), F.transform(F.filter("a", is_par), lambda x: x["tok_ord"]).alias("pars"))
    at = F.when(F.col("source") == "ocr_paragraph", F.get("pars", F.col("ord"))).otherwise(F.get("all", F.col("ord")))
    return out.join(ids, "doc_id").select("doc_id", at.alias("ord"), "text", "x0", "y1", "source")


@query("""SELECT page AS doc_id, chunk_ord AS id, chunk_type AS type, CASE WHEN chunk_ord = 0 THEN '' WHEN chunk_ord = 1 THEN 'md' ELSE chunk_text END AS text, cx0 AS x0, cy0 AS y0, cx1 AS x1, cy1 AS y1 FROM fx_chunks""")
def layout_chunks(spark, d):
    c = fx.chunks(spark, d)
    share = lambda col, size: F.col(col) / size
    box = F.struct(share("cx0", 612.0).alias("left"), share("cy0", 792.0).alias("top"), share("cx1", 612.0).alias("right"), share("cy1", 792.0).alias("bottom"))
    page = (F.col("page") % 2).cast("int")  # odd pages' answers count pages from one
    k = F.col("chunk_ord")
    text = F.when(k <= 1, "").otherwise(F.col("chunk_text"))
    one = F.struct(k.alias("id"), F.col("chunk_type").alias("type"), text.alias("text"), F.when(k == 1, "md").alias("markdown"), F.array(F.struct(page.alias("page"), box.alias("box"))).alias("grounding"))
    r = c.groupBy("page").agg(F.collect_list(one).alias("chunks")).select(F.col("page").alias("response_id"), F.col("page").alias("doc_id"), "chunks")
    sizes = r.select("doc_id", F.lit(0).alias("page_idx"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    return layout.page_chunks(r, sizes).select("doc_id", "id", "type", "text", *[F.round(c_, 6).alias(c_) for c_ in ("x0", "y0", "x1", "y1")])


#: Lines of all kinds of white space among those of the pages.
BLANKS = r"SELECT doc_id, page_idx, chr(9) || chr(10) || text || chr(13) || chr(10) || chr(160) || chr(13) || chr(10) || ' x' || chr(9) AS text FROM fx_pages"


@query(f"""SELECT doc_id, page_idx, ord::BIGINT AS ord, text, 0.0::DOUBLE AS x0, 'text' AS source FROM (SELECT doc_id, page_idx, unnest(string_split(text, chr(10))) AS text,
    unnest(range(len(string_split(text, chr(10))))) AS ord FROM blanks) WHERE trim(text, {WHITE_SQL}) <> ''""", blanks=BLANKS)  # fmt: skip
def plain_text_lines(spark, d):
    p = fx.pages(spark, d).withColumn("text", F.concat(F.lit("\t\n"), "text", F.lit("\r\n\xa0\r\n x\t")))
    return pages.text_lines(p, "text").select("doc_id", "page_idx", F.col("ord").cast("long").alias("ord"), "text", "x0", "source")


@query("""SELECT page, line_idx, CASE page % 4 WHEN 1 THEN 792 - y0 WHEN 2 THEN 612 - x0 WHEN 3 THEN y0 ELSE x0 END AS x0, CASE page % 4 WHEN 1 THEN x1 WHEN 2 THEN 792 - y1 WHEN 3 THEN 612 - x1 ELSE y1 END AS y1,
    length_pts, CASE WHEN layer = 'A-F' THEN '' ELSE layer END AS layer FROM fx_vlines""")
def vector_lines(spark, d):
    """Lines as drawings of up to seven items, curves between them."""
    v = fx.vlines(spark, d).withColumn("group", F.floor(F.col("line_idx") / 7))
    item = lambda kind: F.struct(F.lit(kind).alias("kind"), "x0", "y0", "x1", "y1")
    per = v.groupBy("page", "group").agg(F.array_sort(F.collect_list(F.struct("line_idx", F.array(item("c"), item("l")).alias("i"), "layer"))).alias("a"))  # seven at most
    none = lambda kind: F.lit(None).cast(kind)
    one = lambda x: F.struct(F.nullif(x["layer"], F.lit("A-F")).alias("layer"), none("array<double>").alias("color"), none("double").alias("width"), none("string").alias("dashes"), x["i"].alias("items"))
    drawn = per.select("page", "group", F.transform("a", one).alias("ds"))
    whole = drawn.groupBy("page").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("group", "ds"))), lambda x: x["ds"])).alias("drawings"))  # a page's lines
    table = whole.select("page", (90 * (F.col("page") % 4)).cast("int").alias("rotation"), F.lit(612.0).alias("mediabox_w"), F.lit(792.0).alias("mediabox_h"), "drawings")
    return readers.vector_lines(table).select("page", "line_idx", "x0", "y1", "length_pts", "layer")


def _as_files(spark, df, path: str, by: str | None = None):
    """``df`` as JSON lines, with blank and broken lines between them."""
    text = df.select(*([by] if by else []), F.explode(F.array(F.to_json(F.struct(*[c for c in df.columns if c != by])), F.lit(""), F.lit('{"ts": 1, "kind"'))).alias("value"))
    w = text.write
    (w.partitionBy(by) if by else w).text(path)


@query("""SELECT epoch_us(ts)::DOUBLE / 1000000 AS ts, kind, label, wall_s, cpu_s FROM fx_telemetry""")
def telemetry_lines(spark, d):
    path = shared_dir(spark)
    ts = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1_000_000
    _as_files(spark, fx.telemetry(spark, d).select(ts.alias("ts"), "kind", "label", "wall_s", "cpu_s"), path)
    return records.json_lines(spark, path, records.TELEMETRY).select("ts", "kind", "label", "wall_s", "cpu_s")


def _day_files(spark, d):
    """Telemetry as a folder of files for each day, named after it."""
    path = shared_dir(spark)
    ts = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1_000_000
    _as_files(spark, fx.telemetry(spark, d).select(F.to_date("ts").alias("day"), ts.alias("ts"), F.col("event_id").alias("pid"), "kind", "label"), path, "day")
    return path


@query("SELECT event_id, label FROM fx_telemetry WHERE CAST(ts AS DATE) IN (SELECT DISTINCT CAST(ts AS DATE) FROM fx_telemetry ORDER BY 1 DESC LIMIT 3)")
def latest_days(spark, d):
    files = records.day_files(spark, _day_files(spark, d), days=3)
    return records.day_records(spark, files).select(F.col("pid").alias("event_id"), "label")


@query("SELECT event_id, label FROM fx_telemetry WHERE CAST(ts AS DATE) = DATE '2024-01-02'")
def records_of_day(spark, d):
    files = records.day_files(spark, _day_files(spark, d), "2024-01-02")
    return records.day_records(spark, files).select(F.col("pid").alias("event_id"), "label")


@query("""SELECT records, sessions, labels, true AS sessions_close, true AS labels_close FROM (SELECT count(*) AS records, count(DISTINCT session) AS sessions, count(DISTINCT label) AS labels
    FROM fx_telemetry WHERE CAST(ts AS DATE) >= DATE '2024-01-03')""")
def headline_of_days(spark, d):
    """Counts of a span of days from kept daily sketches, beside the exact ones; they are off by less than four standard errors."""
    t = fx.telemetry(spark, d)
    path = shared_dir(spark)
    records.daily_sketches(t).write.parquet(path)
    near = records.headline_of_days(spark.read.parquet(path), "2024-01-03")
    exact = records.headline(t.where(F.to_date("ts") >= F.lit("2024-01-03").cast("date")))
    both = near.toDF("records", "s", "l").join(exact, "records")
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.ceil(4 * 0.0081 * F.col(b))
    return both.select("records", "sessions", "labels", close("s", "sessions").alias("sessions_close"), close("l", "labels").alias("labels_close"))


def _phases(spark, d):
    j = fx.jobs(spark, d)
    return j.select(F.col("document").cast("string").alias("sha"), F.col("status").alias("phase"), F.col("trade").alias("params"), F.col("job_id").alias("page"), F.col("created_at").cast("timestamp").alias("stored_at"))


def _phase_store(spark, d):
    """All phases, stored in two changes, of which the second repeats a part of the first."""
    path, p = shared_dir(spark), _phases(spark, d)
    records.store_phases(p.where("stored_at < '1996-01-01'"), path)
    records.store_phases(p.where("stored_at >= '1995-01-01'"), path)
    return path, p.schema


@query("SELECT document::VARCHAR AS sha, status AS phase, job_id AS page FROM fx_jobs WHERE document <> 7")
def phase_store_purged(spark, d):
    path, schema = _phase_store(spark, d)
    records.purge_document(spark, path, schema, "7")
    return keyed.kept(spark, path, schema).select("sha", "phase", "page")


@query("SELECT document::VARCHAR AS sha, status AS phase, job_id AS page FROM fx_jobs WHERE created_at >= TIMESTAMP '1995-07-01 00:00:00'")
def phase_store_swept(spark, d):
    path, schema = _phase_store(spark, d)
    records.sweep_expired(spark, path, schema, F.lit("1998-01-01 00:00:00").cast("timestamp"), 915 * 86400)
    return keyed.kept(spark, path, schema).select("sha", "phase", "page")


def _batches(spark, rows, when: str, path: str):
    """``rows`` as the input of a stream, in two batches before and after ``when``."""
    for part in (rows.where(f"NOT ({when})"), rows.where(when)):
        part.write.mode("append").parquet(path)
        yield spark.readStream.schema(rows.schema).parquet(path)


@query("SELECT user_id, arg_max(job_id, (created_at, job_id)) AS job_id, max(created_at) AS created_at FROM fx_jobs GROUP BY user_id")
def latest_results_of_stream(spark, d):
    """The latest job of each user, kept in a table by a stream of two batches."""
    base, rows = shared_dir(spark), fx.jobs(spark, d).select("user_id", "job_id", "created_at", "status")
    for stream in _batches(spark, rows, "created_at >= '1995-01-01'", f"{base}/in"):
        live.keep_latest(stream, f"{base}/table", f"{base}/log", ["user_id"], "created_at", "job_id").awaitTermination()
    return live.kept_table(spark, f"{base}/table", rows.schema).select("user_id", "job_id", "created_at")


@query("""SELECT event_id, session FROM (SELECT *, lag(bucket) OVER (PARTITION BY session ORDER BY ts, event_id) AS before FROM (SELECT *, floor(wall_s / 10) AS bucket FROM fx_telemetry))
    WHERE before IS NULL OR bucket <> before""")
def progress_feed_of_stream(spark, d):
    """Changes of progress that a stream of two batches gives, with the last event of each job as its state."""
    base, t_ = shared_dir(spark), fx.telemetry(spark, d)
    rows = t_.select(F.col("session").alias("job_id"), "event_id", "ts", F.floor(F.col("wall_s") / 10).alias("pct"), F.lit("running").alias("status"))
    for stream in _batches(spark, rows, "ts >= '2024-01-10'", f"{base}/in"):
        live.progress_feed(stream, f"{base}/state", f"{base}/out", f"{base}/log").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id", F.col("job_id").alias("session"))


# Keywords


_SPELL = """SELECT DISTINCT lower(p_name) AS k, string_split(lower(p_name), ' ') AS w FROM part UNION SELECT DISTINCT lower(o_orderpriority), string_split(lower(o_orderpriority), ' ') FROM orders"""
_TURNED = "array_to_string(w[1:len(w) - 1], ' ') || ' ' || CASE WHEN ends_with(w[-1], 's') THEN left(w[-1], length(w[-1]) - 1) ELSE w[-1] || 's' END"


@query(f"""SELECT DISTINCT k AS keyword, unnest(list_concat([k, replace(k, '-', ' '), replace(k, ' ', '-')], CASE WHEN len(w) >= 2 THEN [{_TURNED}, replace({_TURNED}, ' ', '-')] ELSE [] END,
    CASE WHEN len(w) = 2 THEN [array_to_string(w, '')] ELSE [] END)) AS form FROM spell UNION SELECT f, f FROM (SELECT s || g || n AS f FROM (VALUES ('f'), ('fn'), ('fe')) a(s), (VALUES ('-'), (''), (' ')) b(g), range(1, 20) c(n))""", spell=_SPELL)  # fmt: skip
def keyword_forms(spark, d):
    names = fx.read(spark, d, "part").select(F.lower("p_name").alias("keyword")).union(fx.read(spark, d, "orders").select(F.lower("o_orderpriority")))
    return pages.keyword_forms(names.distinct(), codes=True)


@query(r"""SELECT DISTINCT l.doc_id, l.page_idx, l.ord, k.word AS keyword FROM (SELECT DISTINCT doc_id, page_idx, ord, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM fx_lines) l
    JOIN (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM benchmark) k ON l.w = k.word OR l.w = k.word || 's' OR l.w = k.word || 'es' OR l.w = k.word || 'ing'""")
def dictionary_hits(spark, d):
    """Every word of the benchmark table as a keyword: thousands of them, in one pass over the lines."""
    words = fx.read(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))).alias("keyword")).distinct()
    return pages.dictionary_hits(fx.lines(spark, d).select("doc_id", "page_idx", "ord", "text"), words.withColumn("form", F.col("keyword")), ["doc_id", "page_idx", "ord"])


@query("""SELECT page, chunk_ord, (row_number() OVER (PARTITION BY page ORDER BY chunk_ord) - 1) // 6 AS batch, substr(said, 1, 4000) AS excerpt FROM (
    SELECT doc_id AS page, page_idx * 100000 + ord AS chunk_ord, repeat(text || ' ', 20) AS said FROM fx_lines)""")
def chunk_batches(spark, d):
    """Lines, each repeated, as a document's chunks, so that texts are cut and a page takes several batches."""
    c = fx.lines(spark, d).select(F.col("doc_id").alias("page"), (F.col("page_idx") * 100000 + F.col("ord")).alias("chunk_ord"), F.repeat(F.concat("text", F.lit(" ")), 20).alias("chunk_text"))
    return pages.chunk_batches(c)


@query("""SELECT document, total_pages, tp, fp, fn, tn, tp_text, fp_text, fn_text, comprehensive_pages, fallback_pages, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1,
    precision_text, recall_text, coalesce(2 * precision_text * recall_text / nullif(precision_text + recall_text, 0), 0) AS f1_text, (tp + tn) / total_pages AS accuracy FROM (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
    coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(tp_text / nullif(tp_text + fp_text, 0), 0) AS precision_text, coalesce(tp_text / nullif(tp_text + fn_text, 0), 0) AS recall_text FROM (SELECT document, count(*) AS total_pages,
    count(*) FILTER (is_gt AND is_pred) AS tp, count(*) FILTER (NOT is_gt AND is_pred) AS fp, count(*) FILTER (is_gt AND NOT is_pred) AS fn, count(*) FILTER (NOT is_gt AND NOT is_pred) AS tn,
    count(*) FILTER (is_gt AND found) AS tp_text, count(*) FILTER (NOT is_gt AND found) AS fp_text, count(*) FILTER (is_gt AND NOT found) AS fn_text, count(*) FILTER (m = 1) AS comprehensive_pages, count(*) FILTER (m = 2) AS fallback_pages
    FROM (SELECT *, page_idx % 2 = 0 AS found, (document + page_idx) % 3 AS m FROM fx_page_flags) GROUP BY ROLLUP (document)))""")
def retrieval_confusion(spark, d):
    m = (F.col("document") + F.col("page_idx")) % 3
    f = fx.page_flags(spark, d).withColumns({"text_found": F.col("page_idx") % 2 == 0, "method": F.when(m == 1, "comprehensive").when(m == 2, "fallback")})
    return evaluation.retrieval_confusion(f)


@query("""SELECT page, tok_ord, chunk_ord, chunk_type FROM tagged WHERE token_overlap < 0.3 OR iou < 0.2 OR inside = 0""", tokens=TOKENS, overlap=OVERLAP, tagged=TAGGED)
def doubtful_tags(spark, d):
    return layout.doubtful_tags(layout.best_chunk(_tokens(spark, d), fx.chunks(spark, d))).select("page", "tok_ord", "chunk_ord", "chunk_type")


@query("""SELECT page, line_no, string_agg(text, ' ' ORDER BY tx0, tok_ord) AS text, min(tx0) AS x0, min(ty0) AS y0, max(tx1) AS x1, max(ty1) AS y1 FROM (
    SELECT *, sum(j) OVER (PARTITION BY page ORDER BY ty0, tx0, tok_ord)::BIGINT AS line_no FROM (SELECT *, coalesce(ty0 - lag(ty0) OVER (PARTITION BY page ORDER BY ty0, tx0, tok_ord) > 5, false)::INT AS j FROM tokens)) GROUP BY page, line_no""", tokens=TOKENS)  # fmt: skip
def row_texts(spark, d):
    return layout.row_text(layout.text_rows(_tokens(spark, d)))


@query("SELECT DISTINCT page, layer FROM fx_named_vlines WHERE layer <> ''")
def layer_names(spark, d):
    return lines.layer_names(fx.named_vlines(spark, d), ["page"])


_OPERATIONAL = """SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS user_id, NULL::VARCHAR AS original_filename, NULL::VARCHAR AS storage_path, CASE WHEN o_orderstatus = 'O' THEN 'uploaded' ELSE o_orderstatus END AS status,
    CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::INT END AS total_pages, o_orderdate AS created_at, NULL::VARCHAR AS pdf_hash FROM orders"""


@query(_OPERATIONAL)
def operational_documents(spark, d):
    """Rows with a missing status, page numbers that are none, a column too many and some too few."""
    o = fx.read(spark, d, "orders")
    pages_ = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).otherwise("n/a")
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("status"), pages_.alias("total_pages"),
                    F.col("o_orderdate").alias("created_at"), F.lit(1).alias("extra"))
    return records.operational_table(rows, "documents")


@query("""SELECT l_orderkey::VARCHAR || '-' || l_linenumber AS id, l_orderkey::VARCHAR AS document_id, NULL::VARCHAR AS job_id, l_linenumber::INT AS page_number, CASE WHEN l_returnflag = 'N' THEN false ELSE l_returnflag = 'A' END AS is_fence_page,
    '{"q":' || l_quantity::INT || '}' AS result_json, l_shipdate::TIMESTAMP AS created_at, NULL::TIMESTAMP AS updated_at FROM lineitem""")
def operational_page_results(spark, d):
    li = fx.read(spark, d, "lineitem")
    rows = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_number"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "A").alias("is_fence_page"),
                     F.concat(F.lit('{"q":'), F.col("l_quantity").cast("int").cast("string"), F.lit("}")).alias("result_json"), F.col("l_shipdate").alias("created_at"))
    return records.operational_table(rows, "page_results")


@query("SELECT ts, user_id::VARCHAR AS user_id, provider, tokens_in, cost_usd FROM fx_spend")
def spend_lines(spark, d):
    path = shared_dir(spark)
    s = fx.spend(spark, d).select((F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1_000_000).alias("ts"), F.col("user_id").cast("string").alias("user_id"), "provider", "tokens_in", "cost_usd")
    _as_files(spark, s, path)
    return records.spend_records(spark, path).select("ts", "user_id", "provider", "tokens_in", "cost_usd")


GOLD_CSV = """SELECT page, inst_ord, CASE inst_ord % 6 WHEN 0 THEN (inst_ord % 1500)::VARCHAR WHEN 1 THEN 'Gate ' || inst_ord WHEN 2 THEN '0401 fence' WHEN 3 THEN 'note ' || inst_ord
    WHEN 4 THEN '12.5' ELSE '3' || inst_ord || ' wall' END AS content, ix0, iy0, ix1, iy1, CASE inst_ord % 5 WHEN 0 THEN 'Highlight' WHEN 1 THEN 'Ink' WHEN 2 THEN 'Square' ELSE 'Text' END AS type_name FROM fx_instances"""


def _gold_csv(spark, d):
    k = F.col("inst_ord")
    c = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    content = F.when(k % 6 == 0, (k % 1500).cast("string")).when(k % 6 == 1, c("Gate ", k)).when(k % 6 == 2, "0401 fence").when(k % 6 == 3, c("note ", k)).when(k % 6 == 4, "12.5").otherwise(c("3", k, " wall"))
    kind = F.when(k % 5 == 0, "Highlight").when(k % 5 == 1, "Ink").when(k % 5 == 2, "Square").otherwise("Text")
    box = F.when(k % 7 == 3, c("[", F.col("ix0"), "]")).otherwise(c("[", F.col("ix0"), ", ", F.col("iy0"), ", ", F.col("ix1"), ", ", F.col("iy1"), "]"))
    return fx.instances(spark, d).select("page", "inst_ord", content.alias("content"), box.alias("bbox"), kind.alias("type_name"))


@query("SELECT page::INT AS page, content, ix0 AS gx0, iy0 AS gy0, ix1 AS gx1, iy1 AS gy1 FROM gold_csv WHERE type_name IN ('Highlight', 'Ink') AND inst_ord % 7 <> 3", gold_csv=GOLD_CSV)
def gold_boxes(spark, d):
    return evaluation.gold_boxes(_gold_csv(spark, d))


@query("""SELECT page, inst_ord, length_ft, CASE WHEN length_ft IS NULL AND regexp_matches(content, '^[03]') THEN string_split(content, ' ')[1] END AS code FROM (SELECT *, CASE WHEN TRY_CAST(content AS DOUBLE) > 0
    AND TRY_CAST(content AS DOUBLE) < 1000 THEN TRY_CAST(content AS DOUBLE) END AS length_ft FROM gold_csv) WHERE length_ft IS NOT NULL OR regexp_matches(upper(content), 'GATE|FENCE|WALL|0113|040[123]')""", gold_csv=GOLD_CSV)
def gold_measures(spark, d):
    return evaluation.gold_measures(_gold_csv(spark, d)).select("page", "inst_ord", "length_ft", "code")


@query("SELECT job_id, CASE WHEN trade = '1-URGENT' THEN 'electrical' ELSE 'fence' END AS trade FROM fx_jobs")
def job_trades(spark, d):
    trade = F.when(F.col("trade") == "1-URGENT", "electrical").when(F.col("trade") == "2-HIGH", "fence").when(F.col("trade") == "3-MEDIUM", "plumbing")
    return readers.with_profile(fx.jobs(spark, d).withColumn("trade", trade), readers.profile_keywords(spark)).select("job_id", "trade")


@query("SELECT page AS page_idx, inst_ord, trim(content) AS text, ix0 AS x0, 'annotation' AS source FROM gold_csv WHERE type_name = 'Text'", gold_csv=GOLD_CSV)
def text_annotations(spark, d):
    a = _gold_csv(spark, d).join(fx.instances(spark, d).select("inst_ord", F.col("ix0").alias("x0"), F.col("iy0").alias("y0"), F.col("ix1").alias("x1"), F.col("iy1").alias("y1")), "inst_ord")
    a = a.select(F.col("inst_ord").alias("doc_id"), F.col("page").alias("page_idx"), F.col("type_name").alias("annot_type"), F.concat(F.lit(" "), "content").alias("content"), "x0", "y0", "x1", "y1")
    blank = a.withColumn("content", F.lit("  "))
    return readers.text_annotations(a.unionByName(blank)).select("page_idx", F.col("doc_id").alias("inst_ord"), "text", "x0", "source")


# Reports


@query("""SELECT r.document, r.page + 1 AS page_number, r.number, r.category, CASE r.source WHEN 'user' THEN 'Manual' ELSE 'Auto' END AS type, r.ft, r.pts, r.scale, round_even((v.x0 + v.x1) / 2, 1) AS mid_x,
    round_even((v.y0 + v.y1) / 2, 1) AS mid_y, CASE WHEN n.name IS NULL THEN '' ELSE n.name || ' high' END AS height, '' AS post_type, '' AS post_spacing, CASE WHEN n.name IS NULL THEN '' ELSE 'of ' || n.document END AS material,
    '' AS gauge, '' AS mesh_size, '' AS detail_page, '' AS full_details FROM (SELECT document, page, number, category, source, ord, round_even(length_pts / (864.0 / scale), 2) AS ft, round_even(length_pts, 1) AS pts, scale
    FROM numbered JOIN scaled USING (page)) r JOIN fx_vlines v ON v.page = r.page AND v.line_idx = r.ord LEFT JOIN named_cats n ON n.document = r.document AND n.category = r.category""",
    mapped=MAPPED, edits=EDITS, numbered=NUMBERED, scaled=SCALED,
    named_cats="SELECT DISTINCT document, category, CASE WHEN contains(category, 'A') THEN 'Auto-DETECTED' ELSE 'w' END AS name FROM mapped JOIN scaled USING (page) WHERE category = 'Auto-detected' UNION ALL SELECT DISTINCT document, category, 'wood' FROM edits JOIN scaled USING (page) WHERE category = 'Wood'")
def measurement_rows(spark, d):
    rows = export_rows(spark, d)
    v = fx.vlines(spark, d).select("page", F.col("line_idx").alias("ord"), "x0", "y0", "x1", "y1")
    places = _numbered(spark, d).join(v, ["page", "ord"])
    docs = _scales(spark, d).select("document").distinct()
    spec = docs.select("document", F.explode(F.array(F.lit("Auto-DETECTED"), F.lit("wood"))).alias("name"))
    specs = spec.withColumn("fields", F.create_map(F.lit("height"), F.concat("name", F.lit(" high")), F.lit("material"), F.concat(F.lit("of "), F.col("document").cast("string")), F.lit("colour"), F.lit("green")))
    cats = rows.select("document", "category").distinct()
    named = reports.lookup_specs(cats, spec.withColumn("spec_ord", F.lit(0)))
    return reports.measurement_rows(rows, places, specs, named)


@query("SELECT document, name, field, value FROM (SELECT document, name, 'n' || spec_ord AS field, CASE WHEN spec_ord = 1 THEN '' ELSE upper(name) END AS value FROM specs) WHERE value <> ''", specs=SPECS)
def spec_sheet(spark, d):
    s = _specs(spark, d).withColumn("fields", F.create_map(F.concat(F.lit("n"), "spec_ord"), F.when(F.col("spec_ord") == 1, "").otherwise(F.upper("name")), F.lit("none"), F.lit("")))
    s = s.withColumn("name", F.concat_ws("/", "document", "name"))
    out = reports.spec_sheet(s)
    return out.select(F.get(F.split("name", "/"), F.lit(0)).cast("long").alias("document"), F.get(F.split("name", "/"), F.lit(1)).alias("name"), "field", "value")


@query("SELECT document, arg_max(job_id, (epoch(created_at)::BIGINT * 10000000 + job_id)) AS job_id, arg_max(status, (epoch(created_at)::BIGINT * 10000000 + job_id)) AS status FROM fx_jobs GROUP BY document")
def upserted_results(spark, d):
    return records.upserted(fx.jobs(spark, d), ["document"], "created_at", "job_id").select("document", "job_id", "status")


@query("""SELECT doc_id, page_idx, 'a' || text AS plain, 'b' || text AS nested, 'c' || text AS mapped, page_idx AS number FROM fx_pages""")
def clean_json(spark, d):
    p = fx.pages(spark, d)
    dirty = lambda a: F.concat(F.lit(f"{a}\x00"), "text")
    df = p.select("doc_id", "page_idx", dirty("a").alias("plain"), F.array(F.struct(dirty("b").alias("x"))).alias("nested"), F.create_map(F.lit("k"), dirty("c")).alias("mapped"), F.col("page_idx").alias("number"))
    out = records.json_safe(df)
    return out.select("doc_id", "page_idx", "plain", F.col("nested")[0]["x"].alias("nested"), F.col("mapped")["k"].alias("mapped"), "number")


@query("""SELECT doc_id, page_idx, length(text) > 800 AS cut, CASE WHEN length(text) > 800 THEN substr(text, 1, 800) || '…' ELSE text END AS text, page_idx * 2 AS feet, 'doc_id,page_idx,definitions,instances,measurements' AS columns FROM fx_pages""")
def slim_results(spark, d):
    p = fx.pages(spark, d)
    item = F.array(F.struct(F.col("text"), F.lit(1).alias("n")))
    m = F.struct((F.col("page_idx") * 2).alias("feet"), F.array(F.lit(1.0)).alias("all_fence_lines"))
    df = p.select("doc_id", "page_idx", item.alias("definitions"), item.alias("instances"), F.lit("raw").alias("ade_chunks"), F.lit("twice").alias("unified_measurements"), m.alias("measurements"))
    out = records.slim_result(df)
    i = F.col("instances")[0]
    return out.select("doc_id", "page_idx", i["text_truncated"].alias("cut"), i["text"].alias("text"), "measurements.feet", F.lit(",".join(out.columns)).alias("columns"))


@query("SELECT document, tp, fp FROM (SELECT document, count(*) FILTER (is_gt AND is_pred) AS tp, count(*) FILTER (NOT is_gt AND is_pred) AS fp FROM fx_page_flags GROUP BY document)")
def evaluation_files(spark, d):
    """Evaluation results written as CSV with a header and read back."""
    path = shared_dir(spark)
    evaluation.page_confusion(fx.page_flags(spark, d)).where("document is not null").select("document", "tp", "fp").write.option("header", True).csv(path)
    return spark.read.option("header", True).schema("document long, tp long, fp long").csv(path)


# Pages


#: Native text with white space around it, some of it empty; read text, empty or missing for some pages.
READ = r"""SELECT doc_id, page_idx, CASE WHEN page_key % 7 = 3 THEN '' WHEN page_key % 7 = 4 THEN NULL ELSE chr(9) || text || chr(10) END AS text,
    CASE page_idx % 4 WHEN 0 THEN 'read ' || page_idx || chr(10) WHEN 1 THEN '' WHEN 2 THEN chr(13) || chr(160) END AS said FROM fx_pages"""


@query(f"SELECT doc_id, page_idx, CASE WHEN coalesce(said, '') <> '' THEN trim(coalesce(text, '') || chr(10) || said, {WHITE_SQL}) ELSE text END AS text FROM two", two=READ)
def merged_page_texts(spark, d):
    p, k = fx.pages(spark, d), F.col("page_idx") % 4
    own = F.when(F.col("page_key") % 7 == 3, "").when(F.col("page_key") % 7 != 4, F.concat(F.lit("\t"), "text", F.lit("\n")))
    said = F.when(k == 0, F.concat(F.lit("read "), F.col("page_idx").cast("string"), F.lit("\n"))).when(k == 1, "").otherwise("\r\xa0")
    read = p.where(k < 3).select("doc_id", "page_idx", said.alias("text"))
    return pages.merged_text(p.select("doc_id", "page_idx", own.alias("text")), read)


@query("""SELECT doc_id, page_idx FROM (SELECT doc_id, page_idx, page_key % 11 AS matches, page_key % 83 AS tokens, CASE WHEN page_key % 5 <> 0 THEN (page_key % 17) / 200.0 END AS share FROM fx_pages)
    WHERE matches < 5 OR tokens < 40 OR coalesce(share, 0) >= 0.05""")
def sparse_pages(spark, d):
    """Matches, tokens and image share vary apart from each other, so that each of them decides on some pages."""
    k = F.col("page_key")
    p = fx.pages(spark, d).select("doc_id", "page_idx", (k % 11).alias("matches"), (k % 83).alias("tokens"), F.when(k % 5 != 0, k % 17 / 200.0).alias("image_share"))
    return pages.needs_reading(p, "sparse").select("doc_id", "page_idx")


@query("""SELECT page, chunk_ord, CASE WHEN contains(lower(said), 'legend') THEN 'legend' WHEN kind = 'figure' THEN 'figure' WHEN kind <> '' THEN 'legend' ELSE 'other' END AS segment FROM (
    SELECT page, chunk_ord, CASE WHEN (page + chunk_ord) % 5 = 1 THEN '' ELSE chunk_type END AS kind, repeat('x', 300) || chunk_text AS said FROM fx_chunks)""")
def chunk_segments_whole_text(spark, d):
    c = fx.chunks(spark, d).withColumn("chunk_text", F.concat(F.lit("x" * 300), "chunk_text"))
    c = c.withColumn("chunk_type", F.when((F.col("page") + F.col("chunk_ord")) % 5 != 1, F.col("chunk_type")))
    return layout.segmented_three(c).select("page", "chunk_ord", "segment")


GATE = """SELECT page, leg_ord, keyword, CASE WHEN (page + leg_ord) % 4 = 0 THEN '(bullet point)' WHEN (page + leg_ord) % 4 = 1 THEN ' - ' ELSE indicator END AS indicator FROM fx_page_legend"""


@query("""SELECT * FROM (WITH own AS (SELECT page, leg_ord, indicator, 'legend' AS pass FROM gate WHERE leg_ord % 3 = page % 3), fig AS (SELECT page, leg_ord, indicator, 'figure' AS pass FROM gate WHERE leg_ord % 3 = (page + 1) % 3),
    few AS (SELECT page FROM own WHERE trim(indicator) NOT IN ('', '.', '-', '*', '(bullet point)', 'bullet point') GROUP BY page HAVING count(*) >= 3), two AS (SELECT * FROM own UNION ALL SELECT * FROM fig WHERE page NOT IN (FROM few)),
    enough AS (SELECT page FROM two WHERE trim(indicator) NOT IN ('', '.', '-', '*', '(bullet point)', 'bullet point') GROUP BY page HAVING count(*) >= 3)
    SELECT page, leg_ord, indicator, pass FROM two UNION ALL SELECT page, leg_ord, indicator, 'ocr' FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY leg_ord) AS r FROM gate WHERE leg_ord % 3 = (page + 2) % 3
    AND page NOT IN (FROM enough)) WHERE r <= 2)""", gate=GATE)
def gated_legend(spark, d):
    k = (F.col("page") + F.col("leg_ord")) % 4
    e = fx.page_legend(spark, d).withColumn("indicator", F.when(k == 0, "(bullet point)").when(k == 1, " - ").otherwise(F.col("indicator"))).select("page", "leg_ord", "indicator")
    of = lambda n, s: e.where(F.col("leg_ord") % 3 == (F.col("page") + n) % 3).withColumn("pass", F.lit(s))
    return legend.with_quality_gate(of(0, "legend"), of(1, "figure"), of(2, "ocr"), 3, 2)


@query("SELECT doc_id, page_idx, k AS keyword FROM fx_pages, (VALUES " + ", ".join(f"('{k}')" for k in WORDS) + ") w(k) WHERE contains(lower(text), k)")
def keyword_mentions(spark, d):
    p = fx.pages(spark, d).withColumn("id", F.col("page_key"))
    return pages.keyword_mentions(p.unionByName(p), [*WORDS, WORDS[0]]).select("doc_id", "page_idx", "keyword")


ANSWERS = "SELECT c_custkey AS rid, c_custkey % 5 AS k, c_name AS name, c_nationkey AS n FROM customer"


@query("""SELECT rid, id, score FROM (SELECT rid, 'a' || rid AS id, n::DOUBLE AS score FROM answers WHERE k <= 2 UNION ALL SELECT rid, name, -1.0 FROM answers WHERE k <= 2)""", answers=ANSWERS)
def model_answers(spark, d):
    """Answers with an object or an array in them, with text around it, rows without an id, and answers without sound JSON."""
    c = fx.read(spark, d, "customer")
    k, rid = F.col("c_custkey") % 5, F.col("c_custkey").cast("string")
    rows = F.concat(F.lit('[{"id": "a'), rid, F.lit('", "score": '), F.col("c_nationkey").cast("string"), F.lit('}, {"id": " ", "score": 3}, {"score": 4}, {"id": "'), F.col("c_name"), F.lit('", "score": -1}]'))
    said = F.when(k == 0, F.concat(F.lit("Here it is:\n"), rows, F.lit("\nas asked"))).when(k == 1, F.concat(F.lit('```json\n{"results": '), rows, F.lit("}\n```")))
    said = said.when(k == 2, F.concat(F.lit('{"note": "x", "results": '), rows, F.lit("} done"))).when(k == 3, F.concat(F.lit("broken {"), rows)).otherwise("none")
    return pages.model_rows(c.select(F.col("c_custkey").alias("rid"), said.alias("response")), "id string, score double")


@query("SELECT p.doc_id, page_idx, coalesce(quality, -1)::INT AS answer FROM fx_pages p LEFT JOIN labels l ON l.doc_id = p.page_key")
def filled_answers(spark, d):
    asked = fx.pages(spark, d).select("doc_id", "page_idx", "page_key")
    answers = fx.read(spark, d, "labels").select(F.col("doc_id").alias("page_key"), F.col("quality").cast("int").alias("answer"))
    return pages.fill_missing(asked, answers, "page_key", "answer", F.lit(-1)).select("doc_id", "page_idx", "answer")


@query("""SELECT * FROM (WITH l AS (SELECT DISTINCT page, layer FROM fx_telling_vlines), a AS (SELECT page, name FROM (SELECT DISTINCT page FROM l), (VALUES ('A-F'), ('fence'), ('none'), ('the r-f layer')) n(name)),
    m AS (SELECT a.page, a.name, l.layer, a.name = l.layer AS exact FROM a JOIN l ON l.page = a.page WHERE contains(upper(l.layer), upper(a.name)) OR contains(upper(a.name), upper(l.layer)))
    SELECT DISTINCT page, layer FROM m WHERE exact OR (page, name) NOT IN (SELECT page, name FROM m WHERE exact))""")
def known_layers(spark, d):
    l = fx.telling_vlines(spark, d).select("page", "layer").distinct()
    a = l.select("page").distinct().select("page", F.explode(F.array(*[F.lit(n) for n in ("A-F", "fence", "none", "the r-f layer")])).alias("name"))
    return legend.known_layers(a, l)


@query("SELECT s_suppkey AS page, coalesce(greatest(least(CASE WHEN s_nationkey % 3 > 0 THEN s_acctbal / 40 END, 200), 10), 80) AS proximity, coalesce(greatest(least(CASE WHEN s_nationkey % 4 > 0 THEN s_acctbal / 50 END, 150), 20), 50) AS least_length FROM supplier")
def filter_parameters(spark, d):
    n = F.col("s_nationkey")
    s = fx.read(spark, d, "supplier").select(F.col("s_suppkey").alias("page"), F.when(n % 3 > 0, F.col("s_acctbal") / 40).alias("proximity"), F.when(n % 4 > 0, F.col("s_acctbal") / 50).alias("least_length"))
    return reports.filter_parameters(s)


@query("""SELECT page, lines, CASE WHEN skipped THEN 'skipped' WHEN lines = 0 THEN 'no lines' WHEN lines <= 150 THEN 'labelled' ELSE 'dense' END AS note FROM (SELECT s_suppkey AS page, coalesce(n, 0) AS lines, s_nationkey % 5 = 0 AS skipped
    FROM supplier LEFT JOIN (SELECT page, count(*) AS n FROM fx_vlines WHERE page % 4 <> 1 AND (page % 4 <> 2 OR length_pts < 40) GROUP BY page) v ON v.page = s_suppkey)""")
def page_notes(spark, d):
    v = fx.vlines(spark, d).where("page % 4 <> 1 AND (page % 4 <> 2 OR length_pts < 40)").groupBy("page").agg(F.count("*").alias("lines"))
    s = fx.read(spark, d, "supplier").select(F.col("s_suppkey").alias("page"), (F.col("s_nationkey") % 5 == 0).alias("skipped")).join(v, "page", "left").na.fill(0)
    return reports.page_note(s).select("page", "lines", "note")


# Legend


LOCATE = """SELECT g.page, leg_ord, keyword || ' WALL' AS description, CASE WHEN leg_ord % 3 = 0 THEN 300.0 ELSE 400.0 END AS cx0, 0.0 AS cy0, CASE WHEN leg_ord % 3 = 0 THEN 9999.0 ELSE 500.0 END AS cx1, 800.0 AS cy1 FROM fx_page_legend g"""
LOCATE_LINES = """SELECT page, leg_ord AS ord, leg_ord % 2 AS source_rank, CASE WHEN leg_ord % 4 = 1 THEN keyword || ' only' ELSE 'the ' || keyword || '-wall' END AS text, (leg_ord * 20)::DOUBLE AS x0, 10.0::DOUBLE AS y0, (leg_ord * 20 + 10)::DOUBLE AS x1, 20.0::DOUBLE AS y1 FROM fx_page_legend"""


@query(r"""SELECT page, leg_ord, x0, y0, x1, y1 FROM (SELECT e.page, e.leg_ord, l.x0, l.y0, l.x1, l.y1, row_number() OVER (PARTITION BY e.page, e.leg_ord ORDER BY source_rank, ord) AS r FROM entries e JOIN located_lines l ON l.page = e.page
    AND contains(lower(regexp_replace(l.text, '[^0-9a-zA-Z]', '', 'g')), lower(regexp_replace(e.description, '[^0-9a-zA-Z]', '', 'g'))) AND (cx1 > 5000 OR ((l.x0 + l.x1) / 2 BETWEEN cx0 - 15 AND cx1 + 15
    AND (l.y0 + l.y1) / 2 BETWEEN cy0 - 15 AND cy1 + 15))) WHERE r = 1""", entries=LOCATE, located_lines=LOCATE_LINES)
def located_texts(spark, d):
    return legend.located(*_locate(spark, d), F.col("description"))


def _locate(spark, d):
    k, p = F.col("leg_ord"), fx.page_legend(spark, d)
    wide = k % 3 == 0
    e = p.select("page", "leg_ord", "indicator", F.concat("keyword", F.lit(" WALL")).alias("description"), F.when(wide, 300.0).otherwise(400.0).alias("cx0"), F.lit(0.0).alias("cy0"), F.when(wide, 9999.0).otherwise(500.0).alias("cx1"), F.lit(800.0).alias("cy1"))
    text = F.when(k % 4 == 1, F.concat("keyword", F.lit(" only"))).otherwise(F.concat(F.lit("the "), "keyword", F.lit("-wall")))
    l = p.select("page", k.alias("ord"), (k % 2).alias("source_rank"), text.alias("text"), (k * 20).cast("double").alias("x0"), F.lit(10.0).alias("y0"), (k * 20 + 10).cast("double").alias("x1"), F.lit(20.0).alias("y1"))
    return e, l


@query(r"""SELECT * FROM (WITH hit AS (SELECT e.page, e.leg_ord, l.x0, source_rank, ord, (cx1 > 5000 OR ((l.x0 + l.x1) / 2 BETWEEN cx0 - 15 AND cx1 + 15 AND (l.y0 + l.y1) / 2 BETWEEN cy0 - 15 AND cy1 + 15)) AS inside FROM entries e JOIN located_lines l ON l.page = e.page
    AND contains(lower(regexp_replace(l.text, '[^0-9a-zA-Z]', '', 'g')), lower(regexp_replace(e.description, '[^0-9a-zA-Z]', '', 'g'))))
    SELECT page, leg_ord, attempt, x0 FROM (SELECT *, row_number() OVER (PARTITION BY page, leg_ord ORDER BY attempt, source_rank, ord) AS r FROM (SELECT *, CASE WHEN inside THEN 0 ELSE 2 END AS attempt FROM hit)) WHERE r = 1)""", entries=LOCATE, located_lines=LOCATE_LINES)
def located_entries(spark, d):
    return legend.located_entries(*_locate(spark, d)).select("page", "leg_ord", "attempt", "x0")


LOCATE_CODES = """SELECT g.page, leg_ord, indicator, CASE WHEN leg_ord % 3 = 0 THEN 9999.0 ELSE 500.0 END AS cx1 FROM fx_page_legend g"""
CODE_LINES = """SELECT page, leg_ord AS ord, leg_ord % 2 AS source_rank, 'see ' || replace(indicator, '-', ' ') AS text, (leg_ord * 40)::DOUBLE AS x0, (leg_ord * 40 + 10)::DOUBLE AS x1 FROM fx_page_legend"""


def _codes(spark, d):
    p, k = fx.page_legend(spark, d), F.col("leg_ord")
    e = p.select("page", "leg_ord", "indicator", F.lit(0.0).alias("cx0"), F.lit(0.0).alias("cy0"), F.when(k % 3 == 0, 9999.0).otherwise(500.0).alias("cx1"), F.lit(800.0).alias("cy1"))
    text = F.concat(F.lit("see "), F.replace("indicator", F.lit("-"), F.lit(" ")))
    return e, p.select("page", k.alias("ord"), (k % 2).alias("source_rank"), text.alias("text"), (k * 40).cast("double").alias("x0"), F.lit(10.0).alias("y0"), (k * 40 + 10).cast("double").alias("x1"), F.lit(20.0).alias("y1"))


_LOCATED_CODES = """SELECT page, leg_ord, attempt, x0 FROM (SELECT *, row_number() OVER (PARTITION BY page, leg_ord ORDER BY attempt, source_rank, ord) AS r FROM (
    SELECT e.page, e.leg_ord, l.x0, l.ord, l.source_rank, CASE WHEN cx1 > 5000 OR (l.x0 + l.x1) / 2 BETWEEN -15 AND cx1 + 15 THEN 0 ELSE 1 END AS attempt FROM codes e JOIN code_lines l ON l.page = e.page
    AND contains(lower(regexp_replace(l.text, '[^0-9a-zA-Z]', '', 'g')), lower(regexp_replace(e.indicator, '[^0-9a-zA-Z]', '', 'g'))))) WHERE r = 1"""
_CODE_CTES = {"codes": LOCATE_CODES, "code_lines": CODE_LINES, "located_codes": _LOCATED_CODES}


@query("SELECT page, leg_ord, attempt, x0 FROM located_codes", **_CODE_CTES)
def located_indicators(spark, d):
    return legend.located_indicators(*_codes(spark, d)).select("page", "leg_ord", "attempt", "x0")


@query("SELECT page, leg_ord, x0 FROM located_codes WHERE NOT (abs(x0 - (leg_ord * 40 + leg_ord % 10)) < 5)", **_CODE_CTES)
def indicators_without_description(spark, d):
    """Descriptions stand at a distance that grows with the entry's number, so that some are in the place of the indicator."""
    boxes = legend.located_indicators(*_codes(spark, d)).select("page", "leg_ord", "x0", "y0")
    k = F.col("leg_ord")
    text = fx.page_legend(spark, d).select("page", "leg_ord", (k * 40 + k % 10).cast("double").alias("x0"), F.lit(10.0).alias("y0"))
    return legend.without_own_description(boxes, text).select("page", "leg_ord", "x0")


@query("""SELECT page, line_no, target, min(x0)::DOUBLE AS x0, max(x1)::DOUBLE AS x1 FROM (SELECT page, leg_ord AS line_no, 0 AS target, 10.0 AS x0, 70.0 AS x1 FROM fx_page_legend WHERE leg_ord % 3 = 0 UNION ALL SELECT page, leg_ord, 0, 30.0, 40.0 FROM fx_page_legend WHERE leg_ord % 3 = 1
    UNION ALL SELECT page, leg_ord, 1, 80.0, 90.0 FROM fx_page_legend) GROUP BY page, line_no, target""")
def row_matches(spark, d):
    """Lines in which seven words together are the target, one word holds it, or neither."""
    k = F.col("leg_ord") % 3
    w = lambda i, s: F.struct((F.lit(s) if isinstance(s, str) else s).alias("text"), F.lit(10.0 * i).alias("x0"), F.lit(0.0).alias("y0"), F.lit(10.0 * i + 10).alias("x1"), F.lit(5.0).alias("y1"))
    name = F.lower(F.col("keyword"))
    long = F.array(w(0, "x"), w(1, "a"), w(2, "b-c"), w(3, "d"), w(4, "e"), w(5, "f"), w(6, "ghi"), w(7, "--"), w(8, name))
    words = F.when(k == 0, long).when(k == 1, F.array(w(0, "q"), w(3, "xABCDEFGHIx"), w(8, name))).otherwise(F.array(w(0, "abcdefgh"), w(8, name)))
    rows = fx.page_legend(spark, d).select("page", F.col("leg_ord").alias("line_no"), words.alias("words"))
    named = rows.select("page", "line_no", F.transform("words", lambda x: F.struct(F.when(x["x0"] == 80.0, "THE end").otherwise(x["text"]).alias("text"), x["x0"].alias("x0"), x["y0"].alias("y0"), x["x1"].alias("x1"), x["y1"].alias("y1"))).alias("words"))
    return legend.row_matches(named, ["ab cdef ghi", "The-End"]).select("page", "line_no", "target", "x0", "x1")


@query("""SELECT DISTINCT page, round(x0, 2) AS x0, round(y0, 2) AS y0, round(x1, 2) AS x1, round(y1, 2) AS y1 FROM (SELECT page, text, lead(text) OVER w AS after, least(tx0, lead(tx0) OVER w) AS x0, least(ty0, lead(ty0) OVER w) AS y0,
    greatest(tx1, lead(tx1) OVER w) AS x1, greatest(ty1, lead(ty1) OVER w) AS y1 FROM (SELECT * REPLACE (CASE tok_ord // 10 % 3 WHEN 0 THEN 'Post' ELSE '(hole)' END AS text) FROM tokens) WINDOW w AS (PARTITION BY page ORDER BY tok_ord))
    WHERE text = 'Post' AND after = '(hole)'""", tokens=TOKENS)
def phrase_tokens(spark, d):
    text = F.when(F.floor(F.col("tok_ord") / 10) % 3 == 0, "Post").otherwise("(hole)")
    return legend.phrase_tokens(_tokens(spark, d).withColumn("text", text), "post HOLE")


@query("""SELECT * FROM (WITH o AS (SELECT DISTINCT page, 'ocr' AS source, tx0 AS x0, ty0 AS y0 FROM tokens WHERE text = 'F-1' AND tok_ord % 2 = 0) SELECT * FROM o UNION ALL SELECT DISTINCT page, 'words', tx0, ty0 FROM tokens WHERE text = 'F-1' AND page NOT IN (SELECT page FROM o))""", tokens=TOKENS)
def indicator_words(spark, d):
    tk = _tokens(spark, d)
    read = tk.where("tok_ord % 2 = 0").withColumn("text", F.concat(F.lit("see ("), "text", F.lit(").")))
    return legend.indicator_words(read, tk, "F-1").select("page", "source", "x0", "y0")


KEYWORD_SPANS = """SELECT doc_id, ord AS line_no, start, "end" FROM (SELECT doc_id, ord, i AS start, i + 1 AS "end" FROM (SELECT doc_id, ord, w, unnest(range(1, len(w))) AS i FROM (SELECT page_key AS doc_id, ord, string_split(lower(l.text), ' ') AS w FROM fx_lines l JOIN fx_pages USING (doc_id, page_idx)))
    WHERE w[i] = 'the' AND w[i + 1] = 'that' UNION ALL SELECT doc_id, ord, i, i FROM (SELECT doc_id, ord, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT page_key AS doc_id, ord, string_split(lower(l.text), ' ') AS w FROM fx_lines l JOIN fx_pages USING (doc_id, page_idx)))
    WHERE w[i] = 'that' AND (i = 1 OR w[i - 1] <> 'the'))"""


@query("SELECT * FROM keyword_spans", keyword_spans=KEYWORD_SPANS)
def keyword_spans(spark, d):
    return legend.spans(_span_lines(spark, d), ["that", "the that"]).select(F.col("page").alias("doc_id"), "line_no", "start", "end")


@query("""SELECT k.doc_id, line_no, greatest(start - 2, 1) AS start, least("end" + 2, n)::BIGINT AS "end" FROM keyword_spans k JOIN (SELECT page_key AS doc_id, ord, len(string_split(lower(l.text), ' ')) AS n
    FROM fx_lines l JOIN fx_pages USING (doc_id, page_idx)) w ON w.doc_id = k.doc_id AND w.ord = k.line_no""", keyword_spans=KEYWORD_SPANS)  # fmt: skip
def widened_spans(spark, d):
    rows = _span_lines(spark, d)
    return legend.widened_spans(legend.spans(rows, ["that", "the that"]), rows).select(F.col("page").alias("doc_id"), "line_no", "start", "end")


def _span_lines(spark, d):
    p = fx.pages(spark, d).select("doc_id", "page_idx", "page_key")
    l = fx.lines(spark, d).join(p, ["doc_id", "page_idx"])
    return l.select(F.col("page_key").alias("page"), F.col("ord").alias("line_no"), F.split(F.lower("text"), " ").alias("words"))


# Lines and detections


@query("SELECT page, line_idx FROM fx_vlines WHERE (page, layer) IN (SELECT page, map_layer FROM fx_layer_map)")
def lines_on_layers(spark, d):
    layers = fx.layer_map(spark, d).select("page", F.col("map_layer").alias("layer"))
    return lines.on_layers(fx.vlines(spark, d), layers).select("page", "line_idx")


@query("SELECT page, chunk_ord FROM (SELECT page, chunk_ord, 306 - page % 250 AS w, 396 - page % 320 AS h FROM fx_chunks) WHERE w > 100 AND h > 100")
def large_figures(spark, d):
    c = fx.chunks(spark, d)
    c = c.withColumn("cx1", F.col("cx1") - F.col("page") % 250).withColumn("cy1", F.col("cy1") - F.col("page") % 320)
    return lines.large_figures(c).select("page", "chunk_ord")


@query("SELECT s_suppkey AS page FROM supplier WHERE s_suppkey IN (SELECT page FROM fx_vlines WHERE layer = 'R-F') OR s_suppkey IN (SELECT page FROM fx_instances WHERE inst_ord % 2 = 0)")
def drawable_pages(spark, d):
    p = fx.read(spark, d, "supplier").select(F.col("s_suppkey").alias("page"))
    i = fx.instances(spark, d).select("page", F.when(F.col("inst_ord") % 2 == 0, F.col("ix0")).alias("x0"), F.col("iy0").alias("y0"), F.col("ix1").alias("x1"), F.col("iy1").alias("y1"))
    return edits.drawable(p, i, fx.vlines(spark, d).where("layer = 'R-F'"))


def _states(spark, d):
    """Edits of each page as one saved state; some pages have too many categories, some parts are unsound."""
    i = fx.instances(spark, d)
    k = F.col("inst_ord")
    cat = F.struct(F.concat(F.lit("c"), k.cast("string")).alias("key"), F.struct(F.col("indicator"), F.lit("").alias("keyword"), F.when(k % 2 == 0, F.array(F.lit(1.0), F.lit(2.0), (k % 300).cast("double"))).alias("color")).alias("value"))
    line = F.struct(F.when(k % 3 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(k.cast("string")).alias("key"), F.when(k % 5 == 0, " ").otherwise("Wood").alias("value"))
    drawn = F.struct(F.array("ix0", "iy0").alias("start"), F.when(k % 4 != 0, F.array("ix1", "iy1")).alias("end"), F.when(k % 7 != 0, "Gate").alias("category"))
    s = i.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(k.alias("o"), cat.alias("c"), line.alias("l"), drawn.alias("d")))).alias("a"))  # a page's edits
    of = lambda f: F.transform("a", lambda x: x[f])
    many = F.flatten(F.transform("a", lambda x: F.transform(F.sequence(F.lit(1), F.lit(5)), lambda n: F.struct(F.concat(x["c"]["key"], F.lit("/"), n.cast("string")).alias("key"), x["c"]["value"].alias("value")))))
    number = F.when(F.col("page") % 3 == 0, "-5").when(F.col("page") % 3 == 1, "240").otherwise("much")
    return s.select("page", F.map_from_entries(F.when(F.col("page") % 3 == 0, many).otherwise(of("c"))).alias("categories"), F.map_from_entries(of("l")).alias("line_assignments"), of("d").alias("user_drawn_lines"), number.alias("scale_override"), number.alias("min_line_pts"))


SOUND = "SELECT page FROM fx_instances GROUP BY page HAVING count(*) * CASE page % 3 WHEN 0 THEN 5 ELSE 1 END <= 50"


@query("SELECT page, 'too many categories' AS reason FROM fx_instances GROUP BY page HAVING count(*) * CASE page % 3 WHEN 0 THEN 5 ELSE 1 END > 50")
def rejected_edits(spark, d):
    return edits.rejected(_states(spark, d))


@query("""SELECT page, 'c' || inst_ord AS name, indicator, 'c' || inst_ord AS keyword, CASE WHEN inst_ord % 2 = 0 AND inst_ord % 300 <= 255 THEN '1,2,' || inst_ord % 300 ELSE '0,255,0' END AS color FROM fx_instances WHERE page IN (FROM sound)""", sound=SOUND)
def edited_categories(spark, d):
    return edits.categories(_states(spark, d)).withColumn("color", F.array_join(F.col("color").cast("array<string>"), ","))


@query("SELECT page, inst_ord AS line_idx, 'Wood' AS category FROM fx_instances WHERE page IN (FROM sound) AND inst_ord % 3 <> 0 AND inst_ord % 5 <> 0", sound=SOUND)
def edited_assignments(spark, d):
    return edits.assignments(_states(spark, d))


@query("""SELECT page, ord, ix0 AS x0, iy1 AS y1, category, sqrt(500.0) AS length_pts FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY inst_ord) - 1 AS ord, 'Gate' AS category FROM fx_instances) WHERE page IN (FROM sound) AND inst_ord % 4 <> 0 AND inst_ord % 7 <> 0""", sound=SOUND)
def drawn_lines(spark, d):
    return edits.drawn_lines(_states(spark, d)).select("page", "ord", "x0", "y1", "category", "length_pts")


@query("SELECT s.page, document, CASE WHEN s.page % 3 = 1 AND s.page IN (FROM sound) THEN 240.0 ELSE coalesce(verified_scale, 360.0) END AS scale FROM fx_scale s", sound=SOUND)
def scales_with_overrides(spark, d):
    return reports.page_scales(edits.page_scales(_states(spark, d), fx.scale(spark, d)))


REGIONS = """SELECT page, min(inst_ord) AS region, (sum(inst_ord % 40))::DOUBLE AS length_ft, min(ix0) AS bx0, min(iy0) AS by0, max(ix1) AS bx1, max(iy1) AS by1 FROM fx_instances GROUP BY page, floor(ix0 / 150)"""
GOLDS = """SELECT page, inst_ord AS gold_id, CASE WHEN inst_ord % 3 > 0 THEN (inst_ord % 50)::DOUBLE END AS length_ft, ix0 AS gx0, iy0 AS gy0, ix1 AS gx1, iy1 AS gy1 FROM fx_instances"""
NEAR_GOLD = """SELECT page, region, list(gold_id ORDER BY gold_id) AS options, row_number() OVER (PARTITION BY page ORDER BY region) AS seq FROM (SELECT r.page, r.region, gold_id FROM regions r JOIN golds o ON o.page = r.page AND o.length_ft IS NOT NULL
    AND (gx0 + gx1) / 2 BETWEEN bx0 - 100 AND bx1 + 100 AND (gy0 + gy1) / 2 BETWEEN by0 - 100 AND by1 + 100) GROUP BY page, region"""
TAKEN = """SELECT page, 0::BIGINT AS seq, []::BIGINT[] AS used, NULL::BIGINT AS region, NULL::BIGINT AS gold_id FROM near_gold GROUP BY page UNION ALL SELECT o.page, o.seq, CASE WHEN free IS NULL THEN m.used ELSE list_append(m.used, free) END,
    o.region, free FROM taken m JOIN near_gold o ON o.page = m.page AND o.seq = m.seq + 1, LATERAL (SELECT list_filter(o.options, lambda x: NOT list_contains(m.used, x))[1] AS free) f"""
_REGIONS = {"regions": REGIONS, "golds": GOLDS, "near_gold": NEAR_GOLD, "taken": TAKEN}


def _regions(spark, d):
    i = fx.instances(spark, d)
    r = i.groupBy("page", F.floor(F.col("ix0") / 150).alias("q")).agg(
        F.min("inst_ord").alias("region"), F.sum(F.col("inst_ord") % 40).cast("double").alias("length_ft"), F.min("ix0").alias("bx0"), F.min("iy0").alias("by0"), F.max("ix1").alias("bx1"), F.max("iy1").alias("by1")
    )
    length = F.when(F.col("inst_ord") % 3 > 0, (F.col("inst_ord") % 50).cast("double"))
    gold = i.select("page", F.col("inst_ord").alias("gold_id"), length.alias("length_ft"), *[F.col(f"i{c}").alias(f"g{c}") for c in ("x0", "y0", "x1", "y1")])
    return r.drop("q"), gold


FOUND_BY = "SELECT 'all' AS method, * FROM regions UNION ALL SELECT 'long', * FROM regions WHERE length_ft >= 60"


@query("""SELECT method, page, coalesce(regions, 0) AS regions, coalesce(golds, 0) AS golds, coalesce(matched, 0) AS matched, coalesce(matched / nullif(golds, 0), 0.0) AS recall,
    CASE WHEN gold_ft > 0 THEN greatest(0.0, 1 - abs(coalesce(found_ft, 0) - gold_ft) / gold_ft) ELSE 0.0 END AS length_accuracy, CASE WHEN gold_ft > 0 THEN abs(coalesce(found_ft, 0) - gold_ft) / gold_ft * 100 ELSE 0.0 END AS length_error_pct
    FROM (SELECT DISTINCT page FROM (SELECT page FROM golds WHERE length_ft IS NOT NULL UNION SELECT page FROM found_by)) p CROSS JOIN (VALUES ('all'), ('long')) m(method)
    LEFT JOIN (SELECT page, count(*) AS golds, sum(length_ft) AS gold_ft FROM golds WHERE length_ft IS NOT NULL GROUP BY page) n USING (page)
    LEFT JOIN (SELECT method, page, count(*) AS regions, sum(length_ft) AS found_ft FROM found_by GROUP BY method, page) f USING (method, page)
    LEFT JOIN (SELECT method, o.page, count(DISTINCT gold_id) AS matched FROM golds o JOIN found_by r ON r.page = o.page AND o.length_ft IS NOT NULL AND (gx0 + gx1) / 2 BETWEEN bx0 - 100 AND bx1 + 100
    AND (gy0 + gy1) / 2 BETWEEN by0 - 100 AND by1 + 100 GROUP BY method, o.page) h USING (method, page)""", **_REGIONS, found_by=FOUND_BY)  # fmt: skip
def found_metrics(spark, d):
    r, gold = _regions(spark, d)
    both = r.withColumn("method", F.lit("all")).unionByName(r.where("length_ft >= 60").withColumn("method", F.lit("long")))
    return evaluation.found_metrics(both, gold)


@query("SELECT page, region, gold_id FROM taken WHERE gold_id IS NOT NULL", **_REGIONS)
def region_matches(spark, d):
    r, gold = _regions(spark, d)
    return evaluation.region_matches(r.drop("length_ft"), gold.where("length_ft is not null").drop("length_ft")).select("page", "region", "gold_id")


@query("""SELECT page, regions, golds, matched, coalesce(matched / nullif(regions, 0), 0.0) AS precision, coalesce(matched / nullif(golds, 0), 0.0) AS recall, CASE WHEN gold_ft > 0 THEN greatest(0.0, 1 - abs(found_ft - gold_ft) / gold_ft) ELSE 0.0 END AS length_accuracy,
    CASE WHEN gold_ft > 0 THEN abs(found_ft - gold_ft) / gold_ft * 100 ELSE 0.0 END AS length_error_pct FROM (SELECT coalesce(a.page, b.page) AS page, coalesce(regions, 0) AS regions, coalesce(golds, 0) AS golds, coalesce(matched, 0) AS matched, coalesce(found_ft, 0) AS found_ft,
    coalesce(gold_ft, 0) AS gold_ft FROM (SELECT page, count(*) AS regions, sum(length_ft) AS found_ft FROM regions GROUP BY page) a FULL JOIN (SELECT page, count(*) AS golds, sum(length_ft) AS gold_ft FROM golds WHERE length_ft IS NOT NULL GROUP BY page) b ON b.page = a.page
    LEFT JOIN (SELECT page, count(*) AS matched FROM taken WHERE gold_id IS NOT NULL GROUP BY page) m ON m.page = coalesce(a.page, b.page))""", **_REGIONS)
def detection_metrics(spark, d):
    r, gold = _regions(spark, d)
    return evaluation.detection_metrics(r, gold)


@query("""SELECT * FROM (WITH per AS (SELECT method, avg(greatest(0.0, 1 - abs(found - gold) / gold)) AS accuracy, avg(abs(found - gold) / gold * 100) AS error_pct, avg(matched / golds) AS recall FROM (SELECT o_orderpriority AS method, o_totalprice AS found, 90000.0 + o_custkey % 10 AS gold,
    (o_orderkey % 4)::DOUBLE AS matched, 4.0 AS golds FROM orders) GROUP BY method) SELECT method, round(accuracy, 9) AS accuracy, round(error_pct, 6) AS error_pct, recall, accuracy = (SELECT max(accuracy) FROM per) AS best FROM per)""")
def method_metrics(spark, d):
    o = fx.read(spark, d, "orders").select(F.col("o_orderpriority").alias("method"), F.col("o_totalprice").alias("found_ft"), (90000.0 + F.col("o_custkey") % 10).alias("gold_ft"), (F.col("o_orderkey") % 4).cast("double").alias("matched"), F.lit(4.0).alias("golds"))
    m = evaluation.method_metrics(o)
    return m.withColumn("accuracy", F.round("accuracy", 9)).withColumn("error_pct", F.round("error_pct", 6))


@query("""SELECT source, count(*) AS matched, round(avg(iou), 6) AS avg_iou, count(DISTINCT CASE WHEN length(content) <= 10 AND regexp_matches(content, '[0-9]') THEN content END) AS codes, round(count(*) / (SELECT count(*) FROM fx_gold), 6) AS coverage, (SELECT count(*) FROM fx_gold) AS golds
    FROM (SELECT b.source, b.iou, CASE gold_id % 3 WHEN 0 THEN 'F-' || gold_id % 17 WHEN 1 THEN 'no code' ELSE 'a long description ' || gold_id END AS content FROM (SELECT gold_id, 'pdf' AS source, max(iou) AS iou FROM (SELECT gold_id, i / (400 - i) AS iou FROM (SELECT gold_id,
    (least(px1, gx1) - greatest(px0, gx0)) * (least(py1, gy1) - greatest(py0, gy0)) AS i FROM fx_pred JOIN fx_gold USING (page) WHERE px0 < gx1 AND gx0 < px1 AND py0 < gy1 AND gy0 < py1)) WHERE iou >= 0.3 GROUP BY gold_id) b) GROUP BY source""")
def coverage_report(spark, d):
    k = F.col("gold_id")
    content = F.when(k % 3 == 0, F.concat(F.lit("F-"), (k % 17).cast("string"))).when(k % 3 == 1, "no code").otherwise(F.concat(F.lit("a long description "), k.cast("string")))
    gold = fx.gold(spark, d).withColumn("content", content)
    items = fx.pred(spark, d).select("page", F.lit("pdf").alias("source"), F.col("pred_id").alias("item_id"), *[F.col(f"p{c}").alias(f"s{c}") for c in ("x0", "y0", "x1", "y1")])
    return evaluation.coverage(gold, evaluation.best_source_item(fx.gold(spark, d), items))


SHARES = {"title": (0.7, 0.8, 1.0, 1.0), "legend": (0.7, 0.0, 1.0, 0.3), "drawing": (0.0, 0.0, 0.7, 0.8), "notes": (0.0, 0.8, 0.7, 1.0)}


@query("""SELECT page, CASE region WHEN 'title' THEN 428.4 WHEN 'legend' THEN 428.4 ELSE 0.0 END::DOUBLE AS rx0, CASE region WHEN 'legend' THEN 237.6 WHEN 'drawing' THEN 633.6 ELSE 792.0 END::DOUBLE AS ry1, region FROM (SELECT s_suppkey AS page FROM supplier), (VALUES ('title'), ('legend'), ('drawing'), ('notes')) r(region)""")
def page_regions(spark, d):
    p = fx.read(spark, d, "supplier").select(F.col("s_suppkey").alias("page"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    return voting.page_regions(p, SHARES).select("page", "region", F.round("rx0", 6).alias("rx0"), F.round("ry1", 6).alias("ry1"))


@query("""SELECT page, inst_ord AS line_no, indicator AS text, inst_ord AS line_idx, CASE WHEN contains(lower(indicator), 'f-12') THEN 'f-12' WHEN contains(lower(indicator), 'f-1') THEN 'f-1'
    WHEN contains(lower(indicator), '2') THEN '2' END AS keyword FROM fx_instances WHERE contains(lower(indicator), 'f-1') OR contains(indicator, '2')""")
def keyword_indicators(spark, d):
    """The first keyword of the list counts, not the longest or the first in the text."""
    i = fx.instances(spark, d).select("page", F.col("inst_ord").alias("line_no"), F.col("indicator").alias("text"), F.col("inst_ord").alias("line_idx"))
    return pages.first_keyword(i, ["f-12", "f-1", "2"]).select("page", "line_no", "text", "line_idx", "keyword")


@query("""SELECT page, k AS chunk_ord, string_agg(text, ' ' ORDER BY rank, tok_ord) AS text FROM (SELECT t.page, c.chunk_ord AS k, t.text, t.tok_ord, t.rank FROM (SELECT *, 1 AS rank FROM tokens UNION ALL SELECT page, tok_ord, 'read ' || text, tx0, ty0, tx1, ty1, 0 FROM tokens) t
    JOIN fx_chunks c ON c.page = t.page AND (tx0 + tx1) / 2 BETWEEN cx0 AND cx1 AND (ty0 + ty1) / 2 BETWEEN cy0 AND cy1 WHERE chunk_type <> 'figure' OR contains(chunk_text, 'LEGEND')) GROUP BY page, k""", tokens=TOKENS)
def region_texts(spark, d):
    tk = _tokens(spark, d)
    return layout.region_text(tk.withColumn("text", F.concat(F.lit("read "), "text")), tk, fx.chunks(spark, d))


@query("SELECT page, tok_ord, word, k FROM (SELECT page, inst_ord AS tok_ord, unnest(['post', 'and', indicator]) AS word, unnest([0, 1, 2]) AS k FROM fx_instances)")
def words_of_blocks(spark, d):
    i = fx.instances(spark, d).select("page", F.col("inst_ord").alias("ord"), F.concat(F.lit(" post  and "), "indicator").alias("text"), F.col("ix0").alias("x0"), F.col("iy0").alias("y0"), F.col("ix1").alias("x1"), F.col("iy1").alias("y1"))
    return layout.split_words(i).select("page", F.col("ord").alias("tok_ord"), F.col("text").alias("word"), "k")


@query("SELECT c_custkey AS id, (c_custkey % 30)::VARCHAR || '.' || (c_custkey % 7)::VARCHAR || '.A0' || (c_custkey % 9)::VARCHAR AS dotted FROM customer")
def dotted_codes(spark, d):
    k = F.col("c_custkey")
    code = F.concat(F.lit("00"), (k % 30).cast("string"), F.lit(".0"), (k % 7).cast("string"), F.lit(".A0"), (k % 9).cast("string"))
    return fx.read(spark, d, "customer").select(k.alias("id"), t.dotted(code).alias("dotted"))


@query("""SELECT p_partkey AS id, CASE k WHEN 0 THEN n * 12.0 WHEN 1 THEN n * 1.0 WHEN 2 THEN n * 1.0 WHEN 3 THEN n * 1.0 END::DOUBLE AS scale FROM (SELECT p_partkey, p_partkey % 5 AS k, 10 + p_partkey % 50 AS n FROM part)""")
def scales_in_old_order(spark, d):
    k, n = F.col("p_partkey") % 5, (10 + F.col("p_partkey") % 50).cast("string")
    c = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    text = F.when(k == 0, c('Scale: 1" = ', n, "'-0\"")).when(k == 1, c("1:", n)).when(k == 2, c('scale 1" = ', n, '"')).when(k == 3, c("1/", n, '" = 1\'')).otherwise(c("sheet ", n))
    return fx.read(spark, d, "part").select(F.col("p_partkey").alias("id"), sc.scale_in_old_order(text).alias("scale"))


@query("""SELECT p_size AS document, min(p_partkey) FILTER (p_partkey % 3 > 0) AS ord, arg_min(CASE p_partkey % 3 WHEN 1 THEN 120.0 + p_partkey % 5 * 12 ELSE 48.0 END::DOUBLE, p_partkey) FILTER (p_partkey % 3 > 0) AS scale, (min(p_partkey) FILTER (p_partkey % 3 > 0) * 2)::DOUBLE AS x0
    FROM part GROUP BY p_size HAVING count(*) FILTER (p_partkey % 3 > 0) > 0""")
def line_scales(spark, d):
    k = F.col("p_partkey")
    feet = F.concat(F.lit('see SCALE: 1" = '), (10 + k % 5).cast("string"), F.lit("'-0\""))
    text = F.when(k % 3 == 1, feet).when(k % 3 == 2, "1/4\" = 1'-0\"").otherwise("no notation 1:50")
    p = fx.read(spark, d, "part").select(F.col("p_size").alias("document"), k.alias("ord"), text.alias("text"), (k * 2).cast("double").alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1"))
    return sc.scale_of_lines(p, ["document"]).select("document", "ord", "scale", "x0")


# Records


def _documents(spark, d):
    c = fx.read(spark, d, "customer")
    created = F.timestamp_seconds(F.lit(900_000_000) + F.col("c_custkey") * 3600)
    return c.select(F.col("c_custkey").alias("document"), (F.col("c_nationkey") % 5).alias("user_id"), F.concat(F.lit("h"), (F.col("c_custkey") % 40).cast("string")).alias("pdf_hash"), created.alias("created_at"))


DOCUMENTS = "SELECT c_custkey AS document, c_nationkey % 5 AS user_id, 'h' || c_custkey % 40 AS pdf_hash, (TIMESTAMP '1998-07-09 16:00:00' + to_hours(c_custkey::INT)) AS created_at FROM customer"


@query("SELECT user_id, pdf_hash, max(document) AS document FROM documents_ GROUP BY user_id, pdf_hash", documents_=DOCUMENTS)
def same_uploads(spark, d):
    docs = _documents(spark, d)
    return records.same_upload(docs, docs.select("user_id", "pdf_hash").distinct()).select("user_id", "pdf_hash", "document")


@query("SELECT job_id FROM fx_jobs WHERE document IN (SELECT document FROM documents_ WHERE user_id = 3)", documents_=DOCUMENTS)
def owned_jobs(spark, d):
    return records.owned(fx.jobs(spark, d), _documents(spark, d), F.lit(3)).select("job_id")


LAST_JOB = """SELECT document, job_id, status FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY created_at DESC, job_id DESC) AS r FROM fx_jobs) WHERE r = 1"""


@query("SELECT d.document, l.job_id, l.status FROM documents_ d LEFT JOIN last_job l ON l.document = d.document", documents_=DOCUMENTS, last_job=LAST_JOB)
def documents_with_latest_job(spark, d):
    return records.documents_with_latest_job(_documents(spark, d), fx.jobs(spark, d)).select("document", "job_id", "status")


@query("SELECT document FROM documents_ ORDER BY created_at DESC, document DESC LIMIT 100", documents_=DOCUMENTS)
def newest_documents(spark, d):
    return records.newest(_documents(spark, d), "created_at", "document").select("document")


@query("""SELECT d.document, d.created_at, l.status, 'document' AS kind FROM documents_ d LEFT JOIN last_job l ON l.document = d.document UNION ALL SELECT job_id, created_at, status, 'job' FROM fx_jobs WHERE job_id NOT IN (SELECT l.job_id FROM documents_ d JOIN last_job l
    ON l.document = d.document)""", documents_=DOCUMENTS, last_job=LAST_JOB)
def fallback_documents(spark, d):
    return records.fallback_documents(_documents(spark, d), fx.jobs(spark, d)).drop("latest_job")


@query("""SELECT r.l_orderkey AS document, r.page, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END, l.job_id) AS job_id, CASE WHEN l_linenumber % 3 = 0 THEN 'electrical' ELSE 'fence' END AS trade FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS page FROM lineitem) r
    LEFT JOIN last_job l ON l.document = r.l_orderkey""", last_job=LAST_JOB)
def backfilled_results(spark, d):
    li, n = fx.read(spark, d, "lineitem"), F.col("l_linenumber")
    r = li.select(F.col("l_orderkey").alias("document"), F.col("l_suppkey").alias("page"), F.when(n % 2 == 0, F.col("l_partkey")).alias("job_id"), F.when(n % 3 == 0, '{"trade": "electrical"}').otherwise('{"x": 1}').alias("result_json"))
    return records.backfilled(r, fx.jobs(spark, d)).select("document", "page", "job_id", "trade")


def _lived(spark, d):
    j = fx.jobs(spark, d)
    status = F.when(F.col("status") == "completed", F.when(F.col("job_id") % 3 == 0, "failed").otherwise("completed")).otherwise(F.col("status"))
    return j.withColumn("status", status).withColumn("expires_at", F.col("created_at") + F.expr("INTERVAL 30 DAYS")).withColumn("completed_at", F.col("created_at") + F.expr("INTERVAL 1 DAY"))


LIVED = """SELECT job_id, created_at, CASE WHEN status = 'completed' AND job_id % 3 = 0 THEN 'failed' ELSE status END AS status FROM fx_jobs"""


@query("SELECT job_id FROM lived WHERE status IN ('queued', 'running') OR created_at + INTERVAL 30 DAY > TIMESTAMP '1998-01-01'", lived=LIVED)
def recent_jobs(spark, d):
    return records.recent_jobs(_lived(spark, d), F.lit("1998-01-01").cast("timestamp")).select("job_id")


@query("SELECT job_id FROM lived WHERE status IN ('queued', 'running')", lived=LIVED)
def active_jobs(spark, d):
    return records.active_jobs(_lived(spark, d)).select("job_id")


@query("SELECT job_id FROM lived WHERE status = 'failed' AND created_at + INTERVAL 1 DAY >= TIMESTAMP '1998-01-01'", lived=LIVED)
def failed_jobs(spark, d):
    return records.failed_since(_lived(spark, d), F.lit("1998-01-01").cast("timestamp")).select("job_id")


@query("SELECT job_id, CASE WHEN status = 'running' AND created_at < TIMESTAMP '1998-01-01' - INTERVAL 2 HOUR THEN 'failed' ELSE status END AS status FROM fx_jobs")
def stale_jobs(spark, d):
    return records.stale_failed(fx.jobs(spark, d), F.lit("1998-01-01").cast("timestamp")).select("job_id", "status")


def _runs(spark, d):
    s, e = fx.spend(spark, d), F.col("event_id")
    times = F.create_map(F.lit("1a"), (e % 50).cast("double"), F.lit("2"), (e % 70).cast("double"), F.lit("3"), F.when(e % 2 == 0, (e % 90).cast("double")))
    return s.withColumn("provider", F.when(e % 4 == 0, "run_summary").otherwise("model")).withColumn("phase_wall_s", F.map_filter(times, lambda _, v: v.isNotNull()))


LAST_RUNS = "SELECT * FROM fx_spend WHERE event_id % 4 = 0 ORDER BY ts DESC, user_id LIMIT 20"


@query("SELECT event_id, user_id, (event_id % 50)::DOUBLE AS phase_1a_s, NULL::DOUBLE AS phase_1b_s, (event_id % 70)::DOUBLE AS phase_2_s, (event_id % 90)::DOUBLE AS phase_3_s FROM last_runs", last_runs=LAST_RUNS)
def recent_runs(spark, d):
    return records.recent_runs(_runs(spark, d)).select("event_id", "user_id", "phase_1a_s", "phase_1b_s", "phase_2_s", "phase_3_s")


@query("""SELECT phase, round(avg(s), 6) AS mean, median(s) AS median, max(s) AS most, count(*) AS n FROM (SELECT unnest(['1a', '2', '3']) AS phase, unnest([event_id % 50, event_id % 70, event_id % 90])::DOUBLE AS s FROM last_runs) GROUP BY phase""", last_runs=LAST_RUNS)
def phase_stats(spark, d):
    runs = _runs(spark, d).where("provider = 'run_summary'").withColumn("run_id", -F.col("user_id"))
    return records.phase_stats(runs)


@query("""SELECT event_id AS job_id, CASE WHEN done >= 2 AND inside >= 1 THEN (20 - done) * inside / done * (1 + 7.0 / 30) WHEN u.usual IS NOT NULL THEN greatest(u.usual - elapsed, 0) WHEN pct >= 5 THEN greatest(elapsed / (pct / 100.0) - elapsed, 0) END AS eta_s,
    CASE WHEN done >= 2 AND inside >= 1 THEN 'live' WHEN u.usual IS NOT NULL THEN 'history' WHEN pct >= 5 THEN 'share' END AS source FROM (SELECT event_id, user_id, event_id % 4 AS done, (event_id % 13)::DOUBLE AS pct, 100.0 + event_id % 9 AS elapsed, (event_id % 5)::DOUBLE AS inside FROM fx_spend) j
    LEFT JOIN (SELECT user_id, list_sort(list(cost_usd))[len(list(cost_usd)) // 2 + 1] AS usual FROM (SELECT user_id, cost_usd, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, cost_usd DESC) AS r FROM fx_spend WHERE cost_usd > 0 AND user_id % 3 > 0) WHERE r <= 5 GROUP BY user_id) u ON u.user_id = j.user_id""")
def time_left(spark, d):
    s, e, now = fx.spend(spark, d), F.col("event_id"), F.lit("2025-01-01").cast("timestamp")
    ago = lambda n: F.timestamp_seconds(F.unix_timestamp(now) - n)
    jobs = s.select(e.alias("job_id"), F.col("user_id").alias("pdf_hash"), ago(100 + e % 9).alias("started_at"), ago(e % 5).alias("phase_started_at"), F.lit("phase3").alias("phase"), (e % 4).alias("done"), F.lit(20).alias("total"), (e % 13).cast("double").alias("pct"))
    history = s.where("user_id % 3 > 0").select(F.col("user_id").alias("pdf_hash"), "ts", F.col("cost_usd").alias("wall_s"))
    return records.eta(jobs, history, now)


@query("""SELECT doc_id, page_idx, count(*) AS runs, count(DISTINCT said) AS texts, count(DISTINCT vote) AS votes, count(DISTINCT said) = 1 AND count(DISTINCT vote) = 1 AS agree FROM (SELECT doc_id, page_idx, CASE WHEN page_key % 3 = r THEN text || 'x' ELSE text END AS said, page_key % 5 = r AS vote
    FROM fx_pages, range(2) n(r)) GROUP BY doc_id, page_idx""")
def run_agreement(spark, d):
    p = fx.pages(spark, d).withColumn("r", F.explode(F.array(F.lit(0), F.lit(1))))
    said = F.when(F.col("page_key") % 3 == F.col("r"), F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return pages.agreement(p.withColumn("text", said).withColumn("vote", F.col("page_key") % 5 == F.col("r")))


@query("SELECT document, round_even(sum(coalesce(CASE WHEN page % 3 = 0 THEN ft END, CASE WHEN page % 3 <= 1 THEN ft * 2 END, 0)), 2) AS ft FROM (SELECT page, page // 8 AS document, sum(length_pts) AS ft FROM fx_vlines GROUP BY page) GROUP BY document")
def document_feet(spark, d):
    v = fx.vlines(spark, d).groupBy("page").agg(F.sum("length_pts").alias("ft")).withColumn("document", F.floor(F.col("page") / 8))
    k = F.col("page") % 3
    return reports.document_total(v.select("document", F.when(k == 0, F.col("ft")).alias("proximity_ft"), F.when(k <= 1, F.col("ft") * 2).alias("layer_ft")))


@query("SELECT event_id, round(CASE event_id % 3 WHEN 0 THEN 100.0 * least(greatest(wall_s - 63, 0), 30) / 30 WHEN 1 THEN 100.0 * least(greatest(wall_s, 0), 8) / 8 ELSE 0.0 END::DOUBLE, 9) AS inside, strftime(to_timestamp(event_id * 1000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S+00:00') AS stamp FROM fx_telemetry")
def phase_progress(spark, d):
    e = F.col("event_id") % 3
    phase = F.when(e == 0, "phase3").when(e == 1, "init").otherwise("elsewhere")
    return fx.telemetry(spark, d).select("event_id", F.round(records.within_phase(phase, F.col("wall_s")), 9).alias("inside"), records.iso_time(F.col("event_id") * 1000).alias("stamp"))


@query("""SELECT user_id, date_trunc('hour', ts) + to_hours(1 + k::INT) AS "end", count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in, coalesce(sum(tokens_out), 0)::BIGINT AS tokens_out FROM (SELECT user_id, ts, tokens_in, tokens_out, unnest(range(0, 24)) AS k FROM fx_spend) GROUP BY ALL""")
def sliding_spend(spark, d):
    from sheetlens.streaming import live

    return live.rolling_spend(fx.spend(spark, d)).select("user_id", "end", "calls", "tokens_in", "tokens_out")


@query("""SELECT event_id, problem FROM (SELECT event_id, unnest(list_filter([CASE WHEN rss_mb > 6500 THEN 'high_rss' END, CASE WHEN kind = 'event' AND label = 'click' THEN 'slot_rejected' END, CASE WHEN kind = 'event' AND label = 'view' AND event_id % 4 > 0 THEN 'page_status' END,
    CASE WHEN kind = 'event' AND label = 'view' AND event_id % 5 = 0 THEN 'wrong_worker' END, CASE WHEN kind = 'event' AND label = 'error' THEN 'shard_timeout' END], lambda x: x IS NOT NULL)) AS problem FROM fx_telemetry)""")
def telemetry_problems(spark, d):
    e, label = F.col("event_id"), F.col("label")
    name = F.when(label == "click", "slot_rejected").when(label == "view", "phase3_page_done").when(label == "error", "legend_prebatch_shard_timeout").otherwise(label)
    status = F.when(e % 4 == 0, "ok").when(e % 4 == 1, "slow").otherwise("failed")
    r = fx.telemetry(spark, d).withColumns({"name": name, "status": status, "worker": F.when(e % 5 == 0, "thread").otherwise("subprocess")})
    return records.problems(r).select("event_id", "problem")


SWEEP = [(3.0, 15.0), (8.0, 15.0)]
# A parameter set has pages of its own: number * 1000000 + page.
SETS = "SELECT * FROM (VALUES (0, 3.0::DOUBLE, 15.0::DOUBLE), (1, 8.0::DOUBLE, 15.0::DOUBLE)) t(param, distance, degrees)"
SET_ENDS = """SELECT param * 1000000 + page AS page, line_idx, px, py, flat, distance FROM (SELECT page, line_idx, x0 AS px, y0 AS py, y0 = y1 AS flat FROM fx_vlines UNION ALL SELECT page, line_idx, x1, y1, y0 = y1 FROM fx_vlines), sets"""
SET_EDGES = """SELECT DISTINCT a.page, a.line_idx AS a, b.line_idx AS b FROM set_ends a JOIN set_ends b ON a.page = b.page AND a.flat = b.flat AND a.line_idx <> b.line_idx AND abs(a.px - b.px) < a.distance
    AND sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2) < a.distance"""
SET_REACH = "SELECT page, a AS start, b AS node FROM set_edges UNION SELECT r.page, r.start, e.b FROM set_reach r JOIN set_edges e ON e.page = r.page AND e.a = r.node"
SET_SHAPES = """SELECT param, page, run, bx0, by0, bx1, by1 FROM (SELECT param, page, run, count(*) AS n, sum(length_pts) AS pts, min(x0) AS bx0, min(y0) AS by0, max(x1) AS bx1, max(y1) AS by1 FROM (
    SELECT param, v.page, v.line_idx, v.length_pts, v.x0, v.y0, v.x1, v.y1, least(v.line_idx, coalesce(min(r.node), v.line_idx)) AS run FROM fx_vlines v CROSS JOIN sets LEFT JOIN set_reach r
    ON r.page = param * 1000000 + v.page AND r.start = v.line_idx GROUP BY param, v.page, v.line_idx, v.length_pts, v.x0, v.y0, v.x1, v.y1) GROUP BY param, page, run)
    WHERE n >= 2 AND pts >= 20 AND greatest(bx1 - bx0, by1 - by0) / (least(bx1 - bx0, by1 - by0) + 0.01) >= 1"""


@query("""SELECT distance, degrees, regions, hits, recall, row_number() OVER (ORDER BY recall DESC, regions, distance, degrees) AS rank FROM (SELECT distance, degrees, coalesce(regions, 0) AS regions, coalesce(hits, 0) AS hits,
    coalesce(hits, 0) / (SELECT count(*) FROM fx_gold) AS recall FROM sets t LEFT JOIN (SELECT param, count(*) AS regions FROM set_shapes GROUP BY param) r ON r.param = t.param LEFT JOIN (SELECT param, count(DISTINCT gold_id) AS hits
    FROM set_shapes s JOIN fx_gold o ON o.page = s.page AND (gx0 + gx1) / 2 BETWEEN bx0 - 100 AND bx1 + 100 AND (gy0 + gy1) / 2 BETWEEN by0 - 100 AND by1 + 100 GROUP BY param) h ON h.param = t.param)""",
    sets=SETS, set_ends=SET_ENDS, set_edges=SET_EDGES, set_reach=SET_REACH, set_shapes=SET_SHAPES)
def parameter_sweep(spark, d):
    return voting.sweep(fx.vlines(spark, d), fx.gold(spark, d), SWEEP)


@query("SELECT page, dim_id, line_idx FROM (SELECT page, dim_id, line_idx, row_number() OVER (PARTITION BY page, dim_id ORDER BY score, line_idx) AS r FROM (SELECT page, dim_id, line_idx, abs(length_pts - value_ft * 12 / 360 * 72) / (value_ft * 12 / 360 * 72) + dist / 150 * 0.3 AS score FROM (SELECT d.*, line_idx, length_pts, least(sqrt((x0 - dx) ** 2 + (y0 - dy) ** 2), sqrt((x1 - dx) ** 2 + (y1 - dy) ** 2), sqrt(((x0 + x1) / 2 - dx) ** 2 + ((y0 + y1) / 2 - dy) ** 2)) AS dist FROM (SELECT page, inst_ord AS dim_id, ix0 AS dx, iy0 AS dy, (3 + inst_ord % 400)::DOUBLE AS value_ft FROM fx_instances WHERE inst_ord % 3 > 0) d JOIN fx_vlines v USING (page) WHERE length_pts >= 5) WHERE dist <= 150)) WHERE r = 1")
def best_lines_of_gold(spark, d):
    """Texts that begin with a length, without a limit on the score."""
    k = F.col("inst_ord")
    text = F.when(k % 3 == 0, F.concat(F.lit("about "), (3 + k % 400).cast("string"))).otherwise(F.concat((3 + k % 400).cast("string"), F.lit("'-6\" LF")))
    i = fx.instances(spark, d).select("page", k.alias("dim_id"), F.col("ix0").alias("dx"), F.col("iy0").alias("dy"), text.alias("text"))
    dims = lines.dimension_candidates(i).drop("text")
    return lines.dimension_lines(fx.vlines(spark, d), dims, 360.0, worst=None).select("page", "dim_id", "line_idx")


@query("SELECT page, line_idx, CASE WHEN layer = 'A-F' THEN 'Wood' ELSE layer END AS category FROM fx_vlines")
def layer_assignments(spark, d):
    v = fx.vlines(spark, d).withColumn("category", F.col("layer"))
    return edits.layer_assigned(v, "A-F", "Wood").select("page", "line_idx", "category")
