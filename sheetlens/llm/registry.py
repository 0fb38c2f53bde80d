"""The registered queries of this subpackage and their SQL for DuckDB.

Every query reads its whole table. Keys are the names of the queries; ``ORACLES`` has those that SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetlens.llm import (
    chat,
    collocations,
    decontaminate,
    exact_dedup,
    fingerprints,
    licenses,
    mixing,
    packing,
    quality,
    simhash_dedup,
    spelling,
    toxicity,
    warc,
)
from sheetlens.llm.common import materialize, work_dir


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark)
    warc.write_archives(_read(spark, sf_dir, "pages"), path)
    records = materialize(warc.read_records(spark, path, payloads=False))  # without payloads, a few hundred bytes each
    return warc.page_digests(warc.captures(records))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.tree_paths(_read(spark, sf_dir, "documents")))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_likeness(_read(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_read(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "mix_topic", "mix_tokens", "mix_probability", "mix_gap", "mix_sampled")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, *quality.fit(docs, _read(spark, sf_dir, "labels")))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.digests(chat.windows(turns.unionByName(fixed)))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_read(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_license_scan": op2_license_scan,
    "op3_fingerprints": op3_fingerprints,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_mixing": op5_mixing,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_collocations": op11_collocations,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_decontamination": op13_decontamination,
}


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for control in (chat.OPEN, chat.CLOSE, chat.TEXT, chat.END_TEXT):
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


_CHAT_SQL = f"""
    WITH said AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    written AS (
        SELECT *, '{chat.OPEN}' || {_escaped("role")} || '{chat.TEXT}' || {_escaped("text")} || '{chat.END_TEXT}{chat.CLOSE}' AS body,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS n FROM said),
    sized AS (
        SELECT *, ceil(strlen(body) / 4)::BIGINT AS tok, length(body) AS chars, role = 'system' AND n = 0 AS first_system FROM written),
    summed AS (SELECT *, sum(tok) OVER (PARTITION BY conv_id ORDER BY n) - tok AS before FROM sized),
    heads AS (SELECT conv_id, tok AS sys_tok, chars AS sys_chars FROM summed WHERE first_system),
    placed AS (
        SELECT s.*, greatest({chat.BUDGET} - {chat.HISTORY} - coalesce(sys_tok, 0), {chat.BUDGET // 4})::BIGINT AS room,
               greatest(before - coalesce(sys_tok, 0), 0)::BIGINT AS p FROM summed s LEFT JOIN heads USING (conv_id)),
    dealt AS (
        SELECT *, 2 * (p // room) + ((p + greatest(tok, 1) - 1) // room > p // room AND p > p // room * room
               AND NOT first_system)::INT AS win FROM placed),
    wins AS (SELECT conv_id, win, min(p) AS start FROM dealt GROUP BY conv_id, win),
    history AS (
        SELECT d.conv_id, sum(d.chars) AS chars FROM dealt d JOIN wins w ON w.conv_id = d.conv_id AND NOT d.first_system
               AND d.p < w.start AND w.start <= d.p + {chat.HISTORY} GROUP BY d.conv_id),
    fixed AS (
        SELECT conv_id, sum(sys_chars) AS chars FROM heads JOIN wins USING (conv_id) WHERE win > 0 GROUP BY conv_id),
    whole AS (
        SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY n) AS turns,
               coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS chars
        FROM sized GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
           (w.chars + coalesce(h.chars, 0) + coalesce(f.chars, 0))::BIGINT AS formatted_chars
    FROM whole w LEFT JOIN history h USING (conv_id) LEFT JOIN fixed f USING (conv_id)"""

ORACLES: dict[str, str] = {
    "op1_warc": """
        WITH p AS (
            SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest,
                   strlen(coalesce(html, '')) AS size
            FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS keep FROM p)
        SELECT page_id, url, size AS payload_bytes, digest AS payload_digest,
               CASE WHEN size >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN size >= 1000 AND page_id <> keep THEN keep END AS refers_to
        FROM m""",
    "op4_exact_dedup": """
        WITH t AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
            FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
    "op10_chat_formatting": _CHAT_SQL,
    "op11_collocations": r"""
        WITH d AS (
            SELECT coalesce(lang, 'und') AS lang,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents),
        pieces AS (
            SELECT lang, regexp_extract_all(unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')), '[^ \t]+') AS w FROM d),
        total AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM pieces GROUP BY lang),
        places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
        grams AS (
            SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m, count(*) AS f
            FROM places, (SELECT unnest(range(1, 6)) AS m) WHERE i + m - 1 <= len(w) GROUP BY lang, phrase, m),
        often AS (SELECT * FROM grams WHERE f >= 100),
        cuts AS (
            SELECT c.lang, c.phrase, c.m, c.f AS a, k, string_split(c.phrase, ' ') AS w
            FROM often c, (SELECT unnest(range(1, 5)) AS k) WHERE k < c.m),
        scored AS (
            SELECT c.lang, c.phrase, c.m, c.a, c.k, x.f AS l, y.f AS r, t.n,
                   (1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS score
            FROM cuts c JOIN total t ON t.lang = c.lang
            JOIN often x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
            JOIN often y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:c.m], ' ')),
        lowest AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        kept AS (
            SELECT * FROM lowest p WHERE NOT EXISTS (
                SELECT 1 FROM often q WHERE q.lang = p.lang AND q.f = p.a AND q.m > p.m
                AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' ')))
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
               a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
        FROM kept QUALIFY rank <= 2000""",
    "op13_decontamination": r"""
        WITH words AS (
            SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        items AS (
            SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
        sized AS (SELECT item_id, w, least(len(w), 10) AS m FROM items WHERE len(w) > 0),
        starts AS (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM sized),
        windows AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS body FROM starts),
        lengths AS (SELECT DISTINCT m FROM windows),
        places AS (SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM words),
        spans AS (
            SELECT row, m, i, array_to_string(w[i:i + m - 1], ' ') AS body FROM places, lengths WHERE i + m - 1 <= len(w)),
        hits AS (SELECT DISTINCT row, i, s.m, item_id FROM spans s JOIN windows USING (m, body)),
        hit_words AS (
            SELECT row, count(DISTINCT p) AS n_hit
            FROM (SELECT row, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT row, i, m FROM hits)) GROUP BY row),
        hit_items AS (
            SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
            FROM (SELECT DISTINCT row, item_id FROM hits) GROUP BY row)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM words LEFT JOIN hit_words USING (row) LEFT JOIN hit_items USING (row)""",
}
