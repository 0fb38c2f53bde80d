"""Operational records: jobs, documents, page results, telemetry and spend. Now is a parameter everywhere."""

from __future__ import annotations

import json
import re
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType
from pyspark.sql.window import Window

from sheetlens.plans import keyed
from sheetlens.plans.graph import stored

TELEMETRY = (
    "ts double, kind string, pid long, label string, name string, wall_s double, cpu_s double, rss_delta_mb double, "
    "peak_rss_mb double, rss_mb double, session_id string, status string, worker string, page_idx long"
)
SPEND = "ts double, user_id string, provider string, tokens_in long, tokens_out long, cost_usd double, phase_wall_s map<string,double>"
#: The shapes of the operational tables.
OPERATIONAL = {
    "documents": "id string, user_id string, original_filename string, storage_path string, status string, total_pages int, created_at timestamp, pdf_hash string",
    "jobs": "id string, document_id string, user_id string, status string, current_phase string, progress_percent int, error_message string, "
    "started_at timestamp, finished_at timestamp, created_at timestamp, phase_started_at timestamp, trade string",
    "page_results": "id string, document_id string, job_id string, page_number int, is_fence_page boolean, result_json string, created_at timestamp, updated_at timestamp",
    "artifacts": "id string, document_id string, job_id string, type string, storage_path string, created_at timestamp",
}
#: Values of columns that a row leaves out.
DEFAULTS = {("documents", "status"): "uploaded", ("jobs", "status"): "queued", ("jobs", "progress_percent"): 0, ("page_results", "is_fence_page"): False}
DAY, MAX_REQUEUES, STALE_S = 86_400, 2, 7200
#: Phases and the share of a run's progress that they take.
PHASES = {"init": (0, 8), "phase1a": (8, 15), "phase1b": (18, 30), "phase1c": (33, 45), "phase2": (48, 60), "phase3": (63, 93), "highlight": (93, 95), "details": (95, 99)}


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without blank and broken ones."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def operational_table(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` in the shape of the operational table ``name``: its columns in order and of its types, those that are missing
    or null by default where there is one, else null; values that don't fit are null; other columns go."""
    schema = rows.sparkSession.createDataFrame([], OPERATIONAL[name]).schema
    out = []
    for f in schema:
        own = F.col(f.name).try_cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
        default = DEFAULTS.get((name, f.name))
        out.append((own if default is None else F.coalesce(own, F.lit(default))).alias(f.name))
    return rows.select(*out)


def spend_records(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, SPEND).withColumn("ts", F.timestamp_micros(F.round(F.col("ts") * 1_000_000).cast("long")))


def day_files(spark: SparkSession, folder: str, date: str | None = None, days: int | None = None, today: str | None = None) -> list[str]:
    """The paths in ``folder`` whose name holds a date (yyyy-mm-dd), in order of the date: that of ``date`` ("all": every
    one), the ``days`` latest dates that have a file, or else those of ``today``. Only names are looked at, so that files
    of other days are never opened."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [str(f.getPath().toString()) for f in fs.listStatus(at)] if fs.exists(at) else []
    dated = sorted((m[0], n) for n in names if (m := re.search(r"\d{4}-\d{2}-\d{2}", n.rsplit("/", 1)[-1])))
    if days is not None:
        latest_ = sorted({d for d, _ in dated})[-days:] if days > 0 else []
        return [n for d, n in dated if d in latest_]
    if date == "all":
        return [n for _, n in dated]
    return [n for d, n in dated if d == (date or today)]


def day_records(spark: SparkSession, paths: list[str], schema: str = TELEMETRY) -> DataFrame:
    """The JSON lines of ``paths``, as ``day_files`` gives them; no paths give an empty table."""
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)


def latest(df: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """The latest row of each key; ties go to the larger ``tie``."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, tie)).alias("m"))
    return best.select(*keys, *[F.col(f"m.{c}").alias(c) for c in rest])


def documents_with_latest_job(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Documents (document, created_at) with the status of their latest job, if any."""
    last = latest(jobs.select("document", "job_id", "status", F.col("created_at").alias("job_created")), ["document"], "job_created", "job_id")
    return documents.join(last, "document", "left")


def newest(df: DataFrame, order: str, tie: str, n: int = 100) -> DataFrame:
    return df.orderBy(F.desc(order), F.desc(tie)).limit(n)


def same_upload(documents: DataFrame, uploads: DataFrame) -> DataFrame:
    """For each upload (user_id, pdf_hash) the latest document of the same user and hash."""
    return uploads.join(latest(documents, ["user_id", "pdf_hash"], "created_at", "document"), ["user_id", "pdf_hash"])


def owned(rows: DataFrame, documents: DataFrame, user: Column) -> DataFrame:
    """Rows of documents that belong to ``user``."""
    return rows.join(documents.where(F.col("user_id") == user).select("document"), "document", "left_semi")


def fallback_documents(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """``documents`` and the jobs that are no document's latest job, in the shape of documents, newest first: document,
    created_at, status, kind (document or job), latest_job."""
    known = documents_with_latest_job(documents, jobs)
    rest = jobs.join(known.where("job_id is not null").select("job_id"), "job_id", "left_anti")
    own = known.select("document", "created_at", "status", F.lit("document").alias("kind"), F.col("job_id").alias("latest_job"))
    more = rest.select(F.col("job_id").alias("document"), "created_at", "status", F.lit("job").alias("kind"), F.col("job_id").alias("latest_job"))
    return own.unionByName(more).orderBy(F.desc("created_at"), F.desc("document"), "kind")


def orphans(jobs: DataFrame, results: DataFrame, now: Column, age_s: int = 3600) -> DataFrame:
    """Completed jobs older than ``age_s`` without a stored result."""
    old = jobs.where((F.col("status") == "completed") & (F.unix_timestamp("created_at") < F.unix_timestamp(now) - age_s))
    return old.join(results.select("job_id").distinct(), "job_id", "left_anti")


def modes(jobs: DataFrame, default: str = "fence") -> DataFrame:
    """The latest completed job per document and trade; a missing trade is the default, which comes first."""
    done = jobs.where("status = 'completed'").withColumn("trade", F.coalesce("trade", F.lit(default)))
    out = latest(done.select("document", "trade", "job_id", "created_at"), ["document", "trade"], "created_at", "job_id")
    at = F.row_number().over(Window.partitionBy("document").orderBy((F.col("trade") != default).cast("int"), "trade"))
    return out.withColumn("position", at)


def backfilled(page_results: DataFrame, jobs: DataFrame, default: str = "fence") -> DataFrame:
    """Page results (document, page, job_id, result_json) with a missing job_id from the latest job and trade from JSON."""
    last = latest(jobs.select("document", F.col("job_id").alias("_job"), "created_at"), ["document"], "created_at", "_job")
    j = page_results.join(last.select("document", "_job"), "document", "left")
    trade = F.coalesce(F.get_json_object("result_json", "$.trade"), F.lit(default))
    return j.withColumn("job_id", F.coalesce("job_id", "_job")).withColumn("trade", trade).drop("_job")


def _cumulated(df: DataFrame, value: str, size: str, keys: list[str], ranges: int = 64) -> DataFrame:
    """``df`` with before: the sum of ``size`` over the rows of the same ``keys`` with a smaller ``value``.

    Values are dealt out in ranges of about equal numbers of rows, whatever they are; a range is summed by one task, and
    the ranges' sums by key, a row each, are put in front.
    """
    dealt = stored(df.repartitionByRange(ranges, value).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_part", *keys).agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = sums.select("_part", *keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inner = dealt.withColumn("_in", F.coalesce(F.sum(size).over(within), F.lit(0)))
    return inner.join(starts, ["_part", *keys]).withColumn("before", F.col("_start") + F.col("_in")).drop("_part", "_start", "_in")


def queue_positions(jobs: DataFrame) -> DataFrame:
    """Queued jobs in order of created_at, then job_id, with a position from one. No task has the whole queue."""
    q = jobs.where("status = 'queued'").select("job_id", "user_id", "created_at", F.struct("created_at", "job_id").alias("_at"), F.lit(1).alias("_one"))
    out = _cumulated(q, "_at", "_one", [])
    return out.select("job_id", "user_id", "created_at", (F.col("before") + 1).alias("position"))


def after_restart(jobs: DataFrame) -> DataFrame:
    """Running jobs go back to the front of the queue, those requeued too often fail: the next state of all jobs."""
    head = jobs.where("status = 'queued'").agg(F.min("queue_position").alias("head"))
    running, poison = F.col("status") == "running", F.col("requeue_count") >= MAX_REQUEUES
    return jobs.crossJoin(head).select(
        "job_id", F.when(running & poison, "failed").when(running, "queued").otherwise(F.col("status")).alias("status"),
        F.when(running & ~poison, F.col("requeue_count") + 1).otherwise(F.col("requeue_count")).alias("requeue_count"),
        F.when(running & ~poison, F.coalesce("head", F.lit(1)) - 1).otherwise(F.col("queue_position")).alias("queue_position"),
    )


def stale_failed(jobs: DataFrame, now: Column, age_s: int = STALE_S) -> DataFrame:
    stale = (F.col("status") == "running") & (F.unix_timestamp("created_at") < F.unix_timestamp(now) - age_s)
    return jobs.withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


#: States of a job that isn't done.
ACTIVE = ("queued", "running", "phases_ready")


def recent_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs that are active or expire (expires_at) after ``now``, newest first."""
    keep = F.col("status").isin(*ACTIVE) | (F.col("expires_at") > now)
    return jobs.where(keep).orderBy(F.desc("created_at"), F.desc("job_id"))


def active_jobs(jobs: DataFrame) -> DataFrame:
    """Queued and running jobs, newest first."""
    return jobs.where(F.col("status").isin("queued", "running")).orderBy(F.desc("created_at"), F.desc("job_id"))


def failed_since(jobs: DataFrame, since: Column) -> DataFrame:
    """Jobs that failed at ``since`` or later."""
    return jobs.where((F.col("status") == "failed") & (F.col("completed_at") >= since))


def job_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("user_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("queued", "running", "completed")])


#: Size of the sketches that bracket ranks, and how far from the wanted share the brackets reach on either side.
SKETCH, REACH = 2000, 0.01


def nearest_ranks(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Per ``keys`` the values of rank round(p/100 * (n-1)), half to even, from zero, for each name of ``wanted`` with its
    measure and p. Null values don't count; keys (null is one) without any value are left out, a measure without one is null.

    All measures go through together. A sketch for each key and measure says between which two values the rank lies; a
    second pass counts what is below them and sorts what lies between, about a fiftieth. Counts show whether the rank is
    there: where a sketch was wrong, all values are sorted.
    """
    measures = dict.fromkeys(m for m, _ in wanted.values())
    each = F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("v")) for m in measures])
    long = df.select(*keys, F.explode(each).alias("x")).select(*keys, "x.m", "x.v").where("v is not null")
    sketch = long.groupBy(*keys, "m").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("v", SKETCH).alias("s"))

    def bracket(name: str, measure: str, p: float) -> Column:
        rank = F.bround(F.lit(p) * (F.col("n") - 1), 0).cast("long")
        at = lambda share: F.kll_sketch_get_quantile_double("s", F.lit(share)) if 0 < share < 1 else F.lit(None).cast("double")
        own = F.struct(F.lit(name).alias("name"), rank.alias("rank"), at(p - REACH).alias("lo"), at(p + REACH).alias("hi"))
        return F.when(F.col("m") == measure, own)

    asked = F.array_compact(F.array(*[bracket(name, m, p / 100) for name, (m, p) in wanted.items()]))
    left = stored(sketch.select(*keys, "m", F.explode(asked).alias("w")).select(*keys, "m", "w.*"))
    found = None
    while True:
        own = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("m").alias("_m"), "name", "rank", "lo", "hi")
        cond = [F.col("m") == F.col("_m"), F.col("hi").isNull() | (F.col("v") <= F.col("hi"))] + [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        inside = F.when(F.col("lo").isNull() | (F.col("v") >= F.col("lo")), F.col("v")).alias("v")
        seen = long.join(own, cond).groupBy(*keys, "name", "rank", inside).agg(F.count("*").alias("n"))
        order = Window.partitionBy(*keys, "name").orderBy(F.asc_nulls_first("v"))
        seen = seen.withColumn("upto", F.sum("n").over(order)).where("v is not null and upto - n <= rank and rank < upto")
        hit = stored(seen.select(*keys, "name", "v"))
        found = hit if found is None else found.unionByName(hit)
        missed = left.alias("l").join(hit.alias("h"), [F.col(f"l.{k}").eqNullSafe(F.col(f"h.{k}")) for k in (*keys, "name")], "left_anti")
        left = stored(missed.withColumns({"lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double")}))
        if left.isEmpty():
            break
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in wanted])


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join in which null keys are equal."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    return left.join(right, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], "left").drop(*[f"_r_{k}" for k in keys])


def timed_report(records: DataFrame, keys: list[str]) -> DataFrame:
    """Per label of timed records: n, p50 and p95 of wall_s, sum of cpu_s, p95 of rss_delta_mb and of peak_rss_mb; the
    largest sum of cpu_s first. Values of a field that no record has are null."""
    t = records.where("kind = 'timed'")
    out = t.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.round(F.sum("cpu_s"), 6), F.lit(0.0)).alias("cpu_sum"))
    wanted = {"wall_p50": ("wall_s", 50), "wall_p95": ("wall_s", 95), "rss_delta_p95": ("rss_delta_mb", 95), "peak_rss_p95": ("peak_rss_mb", 95)}
    return _beside(out, nearest_ranks(t, keys, wanted), keys).orderBy(F.desc("cpu_sum"), *[F.desc(k) for k in keys])


def event_counts(records: DataFrame) -> DataFrame:
    return records.where("kind = 'event'").groupBy("label").agg(F.count("*").alias("n"))


def checkpoint_report(records: DataFrame) -> DataFrame:
    """Per checkpoint label: n and p50, p95, maximum of rss_mb (missing ones count as 0), in order of label."""
    c = records.where("kind = 'checkpoint'").select("label", F.coalesce("rss_mb", F.lit(0.0)).alias("rss_mb"))
    n = c.groupBy("label").agg(F.count("*").alias("n"), F.max("rss_mb").alias("rss_max"))
    return _beside(n, nearest_ranks(c, ["label"], {"rss_p50": ("rss_mb", 50), "rss_p95": ("rss_mb", 95)}), ["label"]).orderBy("label")


def checkpoint_memory(records: DataFrame) -> DataFrame:
    """Per checkpoint label: mean and maximum of rss_mb and how many records have it, the largest maximum first."""
    c = records.where("kind = 'checkpoint'")
    out = c.groupBy("label").agg(F.round(F.avg("rss_mb"), 6).alias("mean"), F.max("rss_mb").alias("most"), F.count("rss_mb").alias("n"))
    return out.orderBy(F.desc("most"), "label")


def headline(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("records"), F.countDistinct("session").alias("sessions"), F.countDistinct("label").alias("labels"))


def daily_sketches(records: DataFrame) -> DataFrame:
    """Per day of ``records`` (ts, session, label): the number of records and sketches of the sessions and labels, to be kept
    and merged over any span of days."""
    sketch = lambda c: F.hll_sketch_agg(F.col(c).cast("string"), 14)
    day = records.groupBy(F.to_date("ts").alias("day"))
    return day.agg(F.count("*").alias("records"), sketch("session").alias("sessions"), sketch("label").alias("labels"))


def headline_of_days(daily: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """``headline`` over days from ``first`` to ``last`` (each of them included, or open), from kept sketches. Distinct counts
    have a standard error of about 0.8 per cent."""
    span = daily
    if first is not None:
        span = span.where(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        span = span.where(F.col("day") <= F.lit(last).cast("date"))
    many = lambda c: F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(c)
    return span.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"), many("sessions"), many("labels"))


def user_activity(spend: DataFrame, n: int = 50) -> DataFrame:
    per = spend.groupBy("user_id").agg(F.count("*").alias("runs"), F.sum("tokens_in").alias("tokens"), F.max("ts").alias("last_seen"))
    return per.orderBy(F.desc("runs"), "user_id").limit(n)


def rolling_spend(spend: DataFrame, now: Column) -> DataFrame:
    """Per user over the 24 hours before ``now``: calls, tokens in and out, cost (4 decimals). Missing amounts count as none."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    live = spend.where(F.unix_timestamp("ts") >= F.unix_timestamp(now) - DAY)
    return live.groupBy("user_id").agg(F.count("*").alias("calls"), total("tokens_in").alias("tokens_in"), total("tokens_out").alias("tokens_out"), F.round(total("cost_usd"), 4).alias("cost_usd"))


def phase_stats(runs: DataFrame, n: int = 20) -> DataFrame:
    """Mean, median and maximum per phase over the ``n`` latest runs (run_id, ts, phase_wall_s map)."""
    last = runs.orderBy(F.desc("ts"), F.desc("run_id")).limit(n)
    one = last.select(F.explode("phase_wall_s").alias("phase", "s"))
    return one.groupBy("phase").agg(F.round(F.avg("s"), 6).alias("mean"), F.median("s").alias("median"), F.max("s").alias("most"), F.count("*").alias("n"))


#: Phases whose times a table of runs shows.
RUN_PHASES = ("1a", "1b", "1c", "2", "3")


def recent_runs(spend: DataFrame, n: int = 20, phases: tuple[str, ...] = RUN_PHASES) -> DataFrame:
    """The ``n`` latest summaries of runs, newest first, with the seconds of each phase as a column."""
    last = spend.where("provider = 'run_summary'").orderBy(F.desc("ts"), "user_id").limit(n)
    times = [F.col("phase_wall_s")[k].alias(f"phase_{k}_s") for k in phases]
    return last.select(*[c for c in last.columns if c != "phase_wall_s"], *times)


def eta(jobs: DataFrame, history: DataFrame, now: Column) -> DataFrame:
    """Seconds left and where they come from: the live rate of the phase, then the phases after it in proportion; else the
    upper middle of the last five runs of the same hash; else what the overall share done says, from 5 % on; else null.

    ``jobs``: job_id, pdf_hash, started_at, phase, phase_started_at, done and total (pages of the phase), pct (overall);
    ``history``: pdf_hash, ts, wall_s.
    """
    w = Window.partitionBy("pdf_hash").orderBy(F.desc("ts"), F.desc("wall_s"))
    last = history.where("wall_s > 0").withColumn("r", F.row_number().over(w)).where("r <= 5")
    mid = last.groupBy("pdf_hash").agg(F.array_sort(F.collect_list("wall_s")).alias("a"))  # five at most
    mid = mid.select("pdf_hash", F.get("a", F.floor(F.size("a") / 2).cast("int")).alias("usual"))
    since = lambda c: (F.unix_timestamp(now) - F.unix_timestamp(c)).cast("double")
    elapsed, inside = since("started_at"), since("phase_started_at")
    band = lambda k: F.coalesce(*[F.when(F.col("phase") == n, F.lit(float(b[k]))) for n, b in PHASES.items()])
    left = F.greatest(F.lit(0.0), (F.col("total") - F.col("done")) * inside / F.col("done"))
    later = left * F.greatest(F.lit(0.0), 100 - band(1)) / F.greatest(band(1) - band(0), F.lit(1e-6))
    live = F.when((F.col("done") >= 2) & (F.col("total") > 0) & (inside >= 1), left + later)
    rest = F.when(F.col("usual").isNotNull(), F.greatest(F.col("usual") - elapsed, F.lit(0.0)))
    share = F.when(F.col("pct") >= 5, F.greatest(elapsed / (F.col("pct") / 100) - elapsed, F.lit(0.0)))
    source = F.when(live.isNotNull(), "live").when(rest.isNotNull(), "history").when(share.isNotNull(), "share")
    return jobs.join(mid, "pdf_hash", "left").select("job_id", F.coalesce(live, rest, share).alias("eta_s"), source.alias("source"))


def within_phase(phase: Column, pct: Column) -> Column:
    out = F.lit(0.0)
    for name, (a, b) in PHASES.items():
        out = F.when(phase == name, F.greatest(F.lit(0.0), F.least(F.lit(100.0), (pct - a) / (b - a) * 100.0))).otherwise(out)
    return out


def upserted(rows: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """The last version of each key."""
    return latest(rows, keys, order, tie)


def _clean(c: Column, kind: DataType) -> Column:
    if isinstance(kind, StringType):
        return F.replace(c, F.lit("\x00"), F.lit(""))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _clean(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda _, v: _clean(v, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[_clean(c[f.name], f.dataType).alias(f.name) for f in kind]))
    return c


def json_safe(df: DataFrame) -> DataFrame:
    """``df`` without NUL characters in any text, at any depth of its arrays, maps (their values) and structs."""
    return df.select(*[_clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def slim(chunks: DataFrame, most: int = 800) -> DataFrame:
    """Long texts cut, with a flag."""
    long = F.length("text") > most
    return chunks.withColumn("truncated", long).withColumn("text", F.when(long, F.concat(F.substring("text", 1, most), F.lit("…"))).otherwise(F.col("text")))


def slim_result(pages: DataFrame, most: int = 800) -> DataFrame:
    """Page results without what a viewer doesn't show: the raw layout answer (ade_chunks), the second copy of measurements
    (unified_measurements), the vector lines inside measurements (all_fence_lines), and long texts of definitions and
    instances, which are cut and flagged."""

    def cut(c: Column) -> Column:
        def one(x: Column) -> Column:
            long = F.coalesce(F.length(x["text"]) > most, F.lit(False))
            text = F.when(long, F.concat(F.substring(x["text"], 1, most), F.lit("…"))).otherwise(x["text"])
            return x.withField("text", text).withField("text_truncated", long)

        return F.transform(c, one)

    out = pages.drop("ade_chunks", "unified_measurements")
    out = out.withColumns({n: cut(F.col(n)) for n in ("definitions", "instances") if n in out.columns})
    if "measurements" in out.columns and "all_fence_lines" in out.schema["measurements"].dataType.names:
        out = out.withColumn("measurements", F.col("measurements").dropFields("all_fence_lines"))
    return out


def iso_time(seconds: Column) -> Column:
    """Seconds since 1970 as ISO 8601 text in UTC; null stays null."""
    at = F.timestamp_micros((seconds * 1_000_000).cast("long"))
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def document_result(pages: DataFrame) -> DataFrame:
    """Per document the page lists (relevant, other, broken) and the trade first named. ``pages``: document, page,
    relevant, broken, trade."""
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("page"))))
    return pages.groupBy("document").agg(
        pick(F.col("relevant") & ~F.col("broken")).alias("relevant"), pick(~F.col("relevant") & ~F.col("broken")).alias("other"),
        pick(F.col("broken")).alias("broken"), F.min_by("trade", F.when(F.col("trade").isNotNull(), F.col("page"))).alias("trade"),
    )


def params_hash(params: dict) -> str:
    """Twelve hex digits that don't depend on the order of keys."""
    return sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:12]


def covered(wanted: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted keys with covered: whether the phase store has them."""
    have = store.select(*keys).distinct().withColumn("covered", F.lit(True))
    return wanted.join(have, keys, "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def problems(records: DataFrame, rss_limit: float = 6500.0, worker: str = "subprocess") -> DataFrame:
    """Problems in telemetry, one row each: the record's columns and problem. Works on batch and stream."""
    event = lambda n: (F.col("kind") == "event") & (F.col("name") == n)
    done = event("phase3_page_done")
    found = F.array_compact(
        F.array(
            F.when(F.col("rss_mb") > rss_limit, F.lit("high_rss")),
            F.when(event("slot_rejected"), F.lit("slot_rejected")),
            F.when(done & (F.coalesce("status", F.lit("")) != "") & (F.col("status") != "ok"), F.lit("page_status")),
            F.when(done & F.lit(worker == "subprocess") & (F.col("worker") == "thread"), F.lit("wrong_worker")),
            F.when(event("legend_prebatch_shard_timeout"), F.lit("shard_timeout")),
        )
    )
    return records.withColumn("problem", F.explode(found))


def store_phases(results: DataFrame, path: str, parts: int = keyed.PARTS) -> None:
    """Put ``results`` (sha, phase, params, page, stored_at, more) into the phase store under ``path``; of equal keys the
    latest stays. A document's rows lie in one part."""
    one = lambda both: latest(both, ["sha", "phase", "params", "page"], "stored_at", "stored_at")
    keyed.merged(results, path, ["sha"], one, parts)


def purge_document(spark: SparkSession, path: str, schema, sha: str, parts: int = keyed.PARTS) -> None:
    """Take one document's phases out of the store: its part alone is read and overwritten."""
    own = F.pmod(F.xxhash64(F.lit(sha)), F.lit(parts)).cast("int")
    keyed.removed(spark, path, schema, F.col("sha") == sha, own)


def sweep_expired(spark: SparkSession, path: str, schema, now: Column, keep_s: int) -> None:
    """Take out what was stored more than ``keep_s`` seconds before ``now``; parts without such rows stay as they are."""
    keyed.removed(spark, path, schema, F.unix_timestamp("stored_at") < F.unix_timestamp(now) - keep_s)
