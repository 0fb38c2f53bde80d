"""Keyword dictionaries against one pattern after the other; shapes, batches and scores of pages."""

import random

from pyspark.sql import functions as F

from sheetlens.operators import evaluation, pages, records


def test_dictionary_equals_patterns(spark):
    rng = random.Random(2)
    words = ["gate", "chain", "link", "fence", "f", "1", "é", "post", "a_b"]
    gaps = [" ", "-", "  ", ", ", ". ", "\t", " (", ") "]
    texts = ["".join(rng.choice(words) + rng.choice(["", "", "s", "es", "ing", "x"]) + rng.choice(gaps) for _ in range(rng.randrange(0, 9))) for _ in range(150)]
    rows = [(1, k, k, x if rng.random() < 0.5 else x.upper()) for k, x in enumerate(texts)] + [(2, 0, 0, None), (2, 0, 1, ""), (2, 0, 2, "..."), (2, 0, 3, "gate")]
    lines = spark.createDataFrame(rows, "doc_id long, page_idx int, ord int, text string")
    keywords = ["gate", "chain link", "chain-link", "F-1", "é", "a_b", "post fence gate", "(gate", "link)", "fenc", "gates"]
    want = sorted((r.doc_id, r.ord, r.keyword) for r in pages.keyword_lines(lines, keywords).collect())
    forms = spark.createDataFrame([(k, k) for k in keywords], "keyword string, form string")
    got = pages.dictionary_hits(lines, forms)
    assert got.columns == [*lines.columns, "keyword"] and sorted((r.doc_id, r.ord, r.keyword) for r in got.collect()) == want and len(want) > 100
    assert pages.dictionary_hits(lines, forms.where("false")).collect() == []


def test_five_thousand_keywords(spark):
    keywords = [f"kw{k} part" if k % 3 else f"kw{k}" for k in range(5000)]
    texts = [f"see kw{k} parts, kw{k + 1} here" for k in range(0, 5000, 7)]
    lines = spark.createDataFrame([(1, 0, k, x) for k, x in enumerate(texts)], "doc_id long, page_idx int, ord int, text string")
    forms = pages.keyword_forms(spark.createDataFrame([(k,) for k in keywords], "keyword string"))
    got = {(r.ord, r.keyword) for r in pages.dictionary_hits(lines, forms).collect()}
    known, want = set(keywords), set()
    for i, k in enumerate(range(0, 5000, 7)):
        want |= {(i, w) for w in (f"kw{k}", f"kw{k} part", f"kw{k + 1}") if w in known}
    assert got == want


def test_forms_of_keywords(spark):
    df = spark.createDataFrame([("Chain Link",), ("gate",)], "keyword string")
    got = pages.keyword_forms(df).groupBy("keyword").agg(F.sort_array(F.collect_list("form")).alias("f"))
    assert {r.keyword: r.f for r in got.collect()} == {"Chain Link": ["chain link", "chain links", "chain-link", "chain-links", "chainlink"], "gate": ["gate"]}
    assert pages.keyword_forms(df.where("false"), codes=True).count() == 171


def test_chunks_without_a_text_take_no_place(spark):
    rows = [(1, k, None if k == 1 else " \t" if k == 2 else "x" * 10) for k in range(9)]
    got = pages.chunk_batches(spark.createDataFrame(rows, "page long, chunk_ord long, chunk_text string"), 4, 3).orderBy("chunk_ord").collect()
    assert [(r.chunk_ord, r.batch, r.excerpt) for r in got] == [(k, b, "xxxx") for k, b in zip((0, 3, 4, 5, 6, 7, 8), (0, 0, 0, 1, 1, 1, 2))]


def test_operational_shapes(spark):
    rows = spark.createDataFrame([("1", "x", None, "ten"), ("2", None, "done", "3")], "id string, extra string, status string, progress_percent string")
    got = records.operational_table(rows, "jobs")
    assert [(r.id, r.status, r.progress_percent, r.trade) for r in got.collect()] == [("1", "queued", 0, None), ("2", "done", 3, None)]
    for name, schema in records.OPERATIONAL.items():
        assert records.operational_table(rows, name).schema.fieldNames() == [c.split()[0] for c in schema.split(", ")]


def test_one_region_may_hold_several_boxes(spark):
    box = lambda p: f"{p}x0 double, {p}y0 double, {p}x1 double, {p}y1 double"
    regions = spark.createDataFrame([("m", 1, 1, 30.0, 0.0, 0.0, 100.0, 100.0), ("n", 2, 1, 5.0, 0.0, 0.0, 1.0, 1.0)], f"method string, page long, region long, length_ft double, {box('b')}")
    gold = [(1, 1, 10.0, 0.0, 0.0, 10.0, 10.0), (1, 2, 20.0, 90.0, 90.0, 99.0, 99.0), (1, 3, 30.0, 900.0, 900.0, 910.0, 910.0), (1, 4, None, 0.0, 0.0, 1.0, 1.0)]
    gold = spark.createDataFrame(gold, f"page long, gold_id long, length_ft double, {box('g')}")
    got = {(r.method, r.page): r for r in evaluation.found_metrics(regions, gold).collect()}
    assert len(got) == 4 and (got["m", 1].matched, got["m", 1].golds, got["m", 1].length_accuracy) == (2, 3, 0.5)
    assert (got["n", 1].matched, got["n", 1].length_error_pct, got["n", 2].recall) == (0, 100.0, 0.0)


def test_hits_carry_only_the_columns_asked_for(spark):
    """A hit is a row; with the line's text in each, hits take the square of the text. Lines that differ in the text alone are one."""
    lines = spark.createDataFrame([(1, "red doors and red door"), (1, "a red one"), (2, "-red- blue")], "ord long, text string")
    forms = spark.createDataFrame([("door", "door"), ("red", "red"), ("-red-", "-red-")], "keyword string, form string")
    hits = pages.dictionary_hits(lines, forms, ["ord"])
    assert hits.columns == ["ord", "keyword"]
    assert sorted(map(tuple, hits.collect())) == [(1, "door"), (1, "red"), (2, "-red-"), (2, "red")]
