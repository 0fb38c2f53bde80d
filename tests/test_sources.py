"""Readers of extracted data and saved edits on small literal cases."""

import json

from sheetlens.operators import edits
from sheetlens.sources import readers


def test_native_lines_turn_with_the_page(spark, tmp_path):
    page = {"doc_id": 1, "page_idx": 0, "rotation": 90, "mediabox_w": 100.0, "mediabox_h": 200.0,
            "blocks": [{"lines": [{"bbox": [10, 20, 30, 40], "spans": [{"text": "two"}, {"text": "gates"}]}, {"bbox": [0, 0, 1, 1], "spans": [{"text": " "}]}]}]}
    (tmp_path / "p.json").write_text(json.dumps(page))
    (r,) = readers.native_lines(readers.json_table(spark, str(tmp_path), readers.TEXT_PAGES)).collect()
    assert (r.text, r.x0, r.y0, r.x1, r.y1) == ("two gates", 160.0, 10.0, 180.0, 30.0)


def test_words_by_page_number(spark):
    rows = [(1, {"3": {"text": "a b", "words": [{"text": "a", "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0, "block_no": 0, "line_no": 0, "word_no": 0}]}})]
    f = spark.createDataFrame(rows, f"doc_id long, pages {readers.WORD_PAGES}")
    assert [(r.page_num, r.text) for r in readers.word_table(f).collect()] == [(3, "a")]
    assert [(r.chars, r.words) for r in readers.page_counts(f).collect()] == [(3, 1)]


def test_readings_keep_paragraphs_and_new_tokens(spark):
    at = lambda x, y: [{"x": x, "y": y}, {"x": x + 0.1, "y": y + 0.1}]
    rows = [(1, 0, [{"text": "gate", "vertices": at(0.1, 0.1)}, {"text": "gate", "vertices": at(0.1, 0.1)}, {"text": " ", "vertices": at(0.0, 0.0)}],
             [{"text": "gate", "vertices": at(0.101, 0.1)}, {"text": "post", "vertices": at(0.5, 0.5)}, {"text": "post", "vertices": at(0.5, 0.5)}, {"text": "none", "vertices": []}])]
    pages = spark.createDataFrame([(1, 0, 100.0, 200.0)], "doc_id long, page_idx int, width double, height double")
    got = readers.read_boxes(spark.createDataFrame(rows, readers.READINGS), pages).collect()
    assert sorted((r.source, r.text, r.y0) for r in got) == [("ocr_paragraph", "gate", 20.0), ("ocr_paragraph", "gate", 20.0), ("ocr_token", "post", 100.0)]


def test_drawn_segments_are_numbered(spark):
    seg = lambda k, x: {"kind": k, "x0": x, "y0": 0.0, "x1": x + 3.0, "y1": 4.0}
    draw = [{"layer": "L", "color": [0.0], "width": 1.0, "dashes": "", "items": [seg("l", 0.0), seg("re", 9.0), seg("l", 1.0)]}, {"layer": None, "color": None, "width": 0.0, "dashes": "", "items": [seg("l", 2.0)]}]
    got = readers.vector_lines(spark.createDataFrame([(1, 0, 100.0, 100.0, draw)], readers.DRAWINGS)).orderBy("line_idx").collect()
    assert [(r.line_idx, r.x0, r.length_pts, r.layer) for r in got] == [(0, 0.0, 5.0, "L"), (1, 1.0, 5.0, "L"), (2, 2.0, 5.0, "")]


def test_profiles_fall_back(spark):
    p = readers.profile_keywords(spark)
    df = spark.createDataFrame([(1, "electrical"), (2, "plumbing"), (3, None)], "id long, trade string")
    assert {r.id: r.trade for r in readers.with_profile(df, p).collect()} == {1: "electrical", 2: "fence", 3: "fence"}


def test_annotations_with_text(spark):
    df = spark.createDataFrame([(1, 0, "FreeText", " note ", 0.0, 0.0, 1.0, 1.0), (1, 0, "Ink", "x", 0.0, 0.0, 1.0, 1.0), (1, 0, "Text", None, 0.0, 0.0, 1.0, 1.0)], "doc_id long, page_idx int, annot_type string, content string, x0 double, y0 double, x1 double, y1 double")
    assert [r.text for r in readers.text_annotations(df).collect()] == ["note"]


def test_edits_are_cleaned(spark):
    good = {"A ": ("F-1", "", [1.0, 2.0, 3.0]), " ": ("", "", None), "B": (None, "wood", [1.0, 2.0, 300.0])}
    drawn = [([0.0, 0.0], [3.0, 4.0], "A"), ([0.0], [1.0, 1.0], "A"), ([0.0, 0.0], [1.0, 1.0], " ")]
    rows = [(1, good, {"2": "A", "x": "A", "10": " "}, drawn, "240", "-1"), (2, {f"c{i}": ("", "", None) for i in range(51)}, {"1": "A"}, [], "0", "5")]
    s = spark.createDataFrame(rows, edits.STATE)
    assert [(r.page, r.reason) for r in edits.rejected(s).collect()] == [(2, "too many categories")]
    assert {r.name: (r.keyword, r.color) for r in edits.categories(s).collect()} == {"A": ("A", [1, 2, 3]), "B": ("wood", [0, 255, 0])}
    assert [(r.line_idx, r.category) for r in edits.assignments(s).collect()] == [(2, "A")]
    assert [(r.ord, r.length_pts) for r in edits.drawn_lines(s).collect()] == [(0, 5.0)]
    assert [(r.scale_override, r.min_line_pts) for r in edits.overrides(s).collect()] == [(240.0, None)]


def test_pages_with_something_to_draw(spark):
    pages = spark.createDataFrame([(1,), (2,), (3,)], "page long")
    box = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, None, 0.0, 1.0, 1.0)], "page long, x0 double, y0 double, x1 double, y1 double")
    assert [r.page for r in edits.drawable(pages, box).collect()] == [1]
