"""The views of ``fixtures`` as SQL for DuckDB, and a helper that puts those a query needs in front of it."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "fx_pages": """SELECT doc_id // 8 AS doc_id, (doc_id % 8)::INT AS page_idx, doc_id AS page_key, coalesce(text, '') AS text,
        612.0::DOUBLE AS width, 792.0::DOUBLE AS height, (90 * (doc_id % 4))::INT AS rotation FROM documents""",
    "fx_raw": """SELECT doc_id, page_idx, unnest(string_split(text, chr(10))) AS raw,
        unnest(range(len(string_split(text, chr(10))))) AS ord FROM fx_pages""",
    "fx_lines": """SELECT doc_id, page_idx, ord::BIGINT AS ord, trim(raw) AS text, 36.0::DOUBLE AS x0, (36 + 12 * ord)::DOUBLE AS y0,
        (36 + 5 * length(trim(raw)))::DOUBLE AS x1, (46 + 12 * ord)::DOUBLE AS y1, 'pdf_native' AS source
        FROM fx_raw WHERE trim(raw) <> ''""",
    "fx_keywords": """SELECT * FROM (VALUES ('license', true, 0), ('with', false, 1), ('for', false, 2), ('was', false, 3),
        ('that', false, 4), ('fence', true, 5)) t(keyword, high, kw_ord)""",
    "fx_scores": """SELECT doc_id // 8 AS doc_id, (doc_id % 8)::INT AS page_idx, quality = 1 AS is_relevant,
        (0.3 + 0.4 * toxic)::DOUBLE AS confidence FROM labels""",
    "fx_vlines": """SELECT l_suppkey AS page, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_suppkey,
        l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS line_idx,
        (l_partkey % 612)::DOUBLE AS x0, (l_orderkey % 792)::DOUBLE AS y0,
        CASE WHEN l_linenumber % 2 = 1 THEN l_partkey % 612 + 4 * l_quantity ELSE l_partkey % 612 END::DOUBLE AS x1,
        CASE WHEN l_linenumber % 2 = 1 THEN l_orderkey % 792 ELSE l_orderkey % 792 + 4 * l_quantity END::DOUBLE AS y1,
        (4 * l_quantity)::DOUBLE AS length_pts, l_returnflag || '-' || l_linestatus AS layer FROM lineitem""",
    "fx_instances": """SELECT c_custkey % (SELECT count(*) FROM supplier) AS page, c_custkey AS inst_ord,
        'F-' || c_nationkey AS indicator, (37 * c_custkey % 592)::DOUBLE AS ix0, (53 * c_custkey % 782)::DOUBLE AS iy0,
        (37 * c_custkey % 592 + 20)::DOUBLE AS ix1, (53 * c_custkey % 782 + 10)::DOUBLE AS iy1 FROM customer""",
    "fx_legend": "SELECT 'F-' || n_nationkey AS indicator, n_name AS keyword, n_nationkey::BIGINT AS leg_ord FROM nation",
    "fx_categories": "SELECT indicator || ': ' || keyword AS category, leg_ord FROM fx_legend",
    "fx_page_legend": """SELECT DISTINCT i.page, i.indicator, n.n_name AS keyword, substr(i.indicator, 3)::BIGINT AS leg_ord FROM fx_instances i
        JOIN nation n ON n.n_nationkey = (substr(i.indicator, 3)::BIGINT + i.page) % 25""",
    "fx_named_vlines": """SELECT v.page, line_idx, x0, y0, x1, y1, length_pts, concat_ws(' ', layer, replace(n_name, '_', '')) AS layer FROM fx_vlines v
        LEFT JOIN nation n ON n.n_nationkey = (length_pts / 4 + page)::BIGINT % 60""",
    "fx_layer_map": """SELECT page, CASE leg_ord % 5 WHEN 0 THEN 'A-F' WHEN 1 THEN 'N' WHEN 2 THEN 'the R-F layer' WHEN 3 THEN 'N-O'
        ELSE 'none of them' END AS map_layer, indicator || ': ' || keyword AS category, leg_ord AS map_ord
        FROM fx_page_legend WHERE page % 7 <> 0""",
    "fx_telling_vlines": """SELECT page, line_idx, x0, y0, x1, y1, length_pts, CASE WHEN page % 3 = 0 THEN '' WHEN layer = 'A-F' THEN 'C-FENCE-'
        WHEN layer = 'R-F' AND page % 2 = 0 THEN 'x-Wall-' ELSE '' END || layer AS layer FROM fx_vlines""",
    "fx_scale": """SELECT s_suppkey AS page, s_suppkey // 8 AS document,
        CASE WHEN s_suppkey % 5 <> 0 THEN (120 * (1 + s_suppkey % 4))::DOUBLE END AS verified_scale FROM supplier""",
    "fx_chunks": """SELECT s_suppkey AS page, q::BIGINT AS chunk_ord, CASE WHEN q % 2 = 0 THEN 'figure' ELSE 'text' END AS chunk_type,
        CASE WHEN (s_suppkey + q) % 4 = 0 THEN 'LEGEND of symbols' ELSE 'plan view' END AS chunk_text,
        (306 * (q % 2))::DOUBLE AS cx0, (396 * (q // 2))::DOUBLE AS cy0, (306 * (q % 2) + 306)::DOUBLE AS cx1,
        (396 * (q // 2) + 396)::DOUBLE AS cy1 FROM supplier, range(4) r(q)""",
    "fx_gold": "SELECT page, inst_ord AS gold_id, ix0 AS gx0, iy0 AS gy0, ix1 AS gx1, iy1 AS gy1 FROM fx_instances",
    "fx_pred": """SELECT page, inst_ord AS pred_id, ix0 + inst_ord % 7 AS px0, iy0 + inst_ord % 5 AS py0, ix1 + inst_ord % 7 AS px1,
        iy1 + inst_ord % 5 AS py1 FROM fx_instances WHERE inst_ord % 11 <> 0""",
    "fx_jobs": """SELECT o_orderkey AS job_id, o_custkey AS user_id, o_orderkey // 3 AS document, CASE o_orderstatus WHEN 'F'
        THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'running' END AS status, o_orderdate AS created_at,
        o_orderpriority AS trade FROM orders""",
    "fx_telemetry": """SELECT event_id, ts, event_type AS label, value AS wall_s, user_id AS session, CASE event_id % 3 WHEN 0
        THEN 'timed' WHEN 1 THEN 'checkpoint' ELSE 'event' END AS kind, (event_id % 97)::DOUBLE AS cpu_s,
        CASE WHEN event_id % 5 <> 0 THEN (event_id % 89 - 40)::DOUBLE END AS rss_delta_mb, (1000 + event_id % 7001)::DOUBLE AS peak_rss_mb,
        CASE WHEN event_id % 4 <> 0 THEN (500 + event_id % 6500)::DOUBLE END AS rss_mb FROM events""",
    "fx_spend": """SELECT event_id, ts, user_id, event_type AS provider, event_id % 1000 AS tokens_in, value AS cost_usd,
        CASE WHEN event_id % 6 <> 0 THEN event_id * 7 % 500 END AS tokens_out
        FROM events""",
    "fx_page_flags": """SELECT doc_id // 8 AS document, (doc_id % 8)::INT AS page_idx, quality = 1 AS is_gt, toxic = 1 AS is_pred
        FROM labels""",
}


def over(sql: str, **more: str) -> str:
    """``sql`` with the views that it names, and those that these name, as common table expressions; ``more`` come last. A name
    of ``more`` may have a list of columns and a key behind it."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bfx_\w+", text)):
            if name not in need:
                visit(VIEWS[name])
                need.append(name)

    for text in (*more.values(), sql):
        visit(text)
    parts = [f"{n} AS ({VIEWS[n]})" for n in need] + [f"{n} AS ({t})" for n, t in more.items()]
    recursive = "RECURSIVE " if any(re.search(rf"\bUNION\b.*\b(FROM|JOIN) {re.match('[a-z_]+', n)[0]}\b", t, re.S) for n, t in more.items()) else ""
    return f"WITH {recursive}{', '.join(parts)} {sql}" if parts else sql
