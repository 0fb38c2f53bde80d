"""The live forms give what the batch forms give."""

import datetime
import json

from pyspark.sql import functions as F

from sheetlens.operators import records
from sheetlens.plans import keyed
from sheetlens.streaming import live

ROWS = [
    {"ts": 1000.0, "kind": "event", "name": "slot_rejected", "pid": 1}, {"ts": 1010.0, "kind": "checkpoint", "label": "a", "rss_mb": 7000.0},
    {"ts": 1500.0, "kind": "event", "name": "phase3_page_done", "status": "bad", "worker": "thread"}, {"ts": 2000.0, "kind": "timed", "label": "x", "wall_s": 1.5},
]


def follow(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join([json.dumps(ROWS[0]), "{broken", "", json.dumps(ROWS[1])]))
    (folder / "b.jsonl").write_text("\n".join(map(json.dumps, ROWS[2:])))
    return live.telemetry_stream(spark, str(folder), records.TELEMETRY), str(folder)


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_problems_follow_the_file(spark, tmp_path):
    stream, folder = follow(spark, tmp_path)
    got = sorted(r.problem for r in run(live.problem_stream(stream), "problems_seen").collect())
    batch = records.problems(records.json_lines(spark, folder, records.TELEMETRY))
    assert got == sorted(r.problem for r in batch.collect()) == ["high_rss", "page_status", "slot_rejected", "wrong_worker"]


def test_heartbeats_equal_batch(spark, tmp_path):
    stream, folder = follow(spark, tmp_path)
    got = run(live.heartbeats(stream), "beats_seen", "complete")
    batch = records.json_lines(spark, folder, records.TELEMETRY).withColumn("ts", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")))
    key = lambda df: sorted((r.start, r.records, r.problems) for r in df.collect())
    assert key(got) == key(live.heartbeats(batch)) and sum(x[1] for x in key(got)) == 4


def test_latest_rows_are_kept_over_batches(spark, tmp_path):
    src = tmp_path / "pages"
    schema = "document long, page long, v long, note string"
    for i, rows in enumerate([[(1, 1, 1, "stub"), (1, 2, 1, "stub")], [(1, 1, 2, "full")]]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(src))
        q = live.keep_latest(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "t"), str(tmp_path / "c"), ["document", "page"], "v", "note")
        q.awaitTermination(120)
    got = {r.page: r.note for r in live.kept_table(spark, str(tmp_path / "t"), schema).collect()}
    assert got == {1: "full", 2: "stub"}


def files(table):
    return {str(p): p.stat().st_mtime_ns for p in table.rglob("*.parquet")}


def test_batches_rewrite_their_own_parts_alone(spark, tmp_path):
    src, table = tmp_path / "pages", tmp_path / "t"
    schema = "document long, page long, v long, note string"
    seen = []
    for i in range(3):
        spark.createDataFrame([(1, 1, i, f"n{i}")] + ([(2, 7, 1, "once")] if not i else []), schema).write.mode("append").parquet(str(src))
        live.keep_latest(spark.readStream.schema(schema).parquet(str(src)), str(table), str(tmp_path / "c"), ["document", "page"], "v", "note", 16).awaitTermination(120)
        seen.append(files(table))
    assert len(seen[1].items() & seen[2].items()) == 1 and len(seen[2]) == 2
    assert {(r.document, r.note) for r in live.kept_table(spark, str(table), schema).collect()} == {(1, "n2"), (2, "once")}
    assert live.kept_table(spark, str(tmp_path / "none"), schema).count() == 0


def test_changes_that_are_made_again_change_nothing(spark, tmp_path):
    schema = "sha string, phase string, params string, page long, stored_at timestamp"
    t = lambda day: datetime.datetime(2024, 1, day)
    rows = [("a", "1", "p", 1, t(1)), ("a", "1", "p", 1, t(2)), ("a", "2", "p", None, t(1)), ("b", "1", "p", 1, t(3)), (None, "1", "p", 1, t(9))]
    path, df = str(tmp_path / "store"), spark.createDataFrame(rows, schema)
    key = lambda: sorted(map(str, keyed.kept(spark, path, schema).collect()))
    for _ in range(2):
        records.store_phases(df, path, 4)
    assert key() == sorted(str(spark.createDataFrame([r], schema).first()) for r in rows[1:])
    before = files(tmp_path / "store")
    records.purge_document(spark, path, schema, "a", 4)
    assert key() == sorted(str(spark.createDataFrame([r], schema).first()) for r in rows[3:])
    assert len(before.items() - files(tmp_path / "store").items()) == 1  # one part was overwritten
    records.purge_document(spark, path, schema, "no such", 4)
    now = F.lit("2024-01-10").cast("timestamp")
    records.sweep_expired(spark, path, schema, now, 5 * 86400)
    assert [r.sha for r in keyed.kept(spark, path, schema).collect()] == [None]
    records.sweep_expired(spark, path, schema, now, 0)
    assert keyed.kept(spark, path, schema).collect() == []
    records.store_phases(df, path, 4)
    assert len(key()) == 4


def test_rolling_spend_of_a_stream_equals_batch(spark, tmp_path):
    schema = "ts timestamp, user_id string, tokens_in long, tokens_out long, cost_usd double"
    rows = [(datetime.datetime(2024, 1, 1, h), u, h, None if h == 3 else 2 * h, 0.5) for h in range(6) for u in ("a", "b")]
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "in"))
    got = run(live.rolling_spend(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "spent", "complete")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(got) == key(live.rolling_spend(df)) and max(r.tokens_out for r in got.collect()) == 24


def test_only_the_asked_day_files_are_read(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-02", "2024-01-05"):
        (tmp_path / f"telemetry-{day}.jsonl").write_text(json.dumps({"ts": 1.0, "label": day}) + "\n{broken\n\n")
    (tmp_path / "notes.txt").write_text("no date")
    names = lambda **k: [p[-16:-6] for p in records.day_files(spark, str(tmp_path), **k)]
    assert names(days=2) == ["2024-01-02", "2024-01-05"] and names(days=0) == [] and len(names(days=9)) == 3
    assert names(date="2024-01-02") == ["2024-01-02"] and names(date="2020-01-01") == []
    assert len(names(date="all")) == 3 and names(today="2024-01-05") == ["2024-01-05"] and names() == []
    df = records.day_records(spark, records.day_files(spark, str(tmp_path), days=2))
    assert len(df.inputFiles()) == 2 and sorted(r.label for r in df.collect()) == ["2024-01-02", "2024-01-05"]
    assert records.day_records(spark, []).count() == 0 and records.day_files(spark, str(tmp_path / "none"), "all") == []


def test_progress_feed_equals_batch(spark, tmp_path):
    schema = "job_id long, event_id long, ts long, pct long, status string"
    rows = [(1, 1, 1, 5, "running"), (1, 2, 2, 5, "running"), (1, 3, 3, 9, "running"), (1, 4, 4, 9, "completed"), (2, 5, 1, 5, "running")]
    src = tmp_path / "events"
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(src))
        q = live.progress_feed(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "s"), str(tmp_path / "o"), str(tmp_path / "c"))
        q.awaitTermination(120)
    got = sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "o")).collect())
    assert got == sorted(r.event_id for r in live.progress_changes(spark.createDataFrame(rows, schema)).collect()) == [1, 3, 4, 5]
