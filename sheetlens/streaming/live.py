"""The live forms: telemetry problems, heartbeats, rolling spend, page results, progress.

Each takes a streaming (or batch) DataFrame with an event time ``ts`` and returns one; sinks are the caller's choice but
where a table is kept up to date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetlens.operators.records import latest, problems
from sheetlens.plans import keyed


def telemetry_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New JSON lines as they come, broken ones left out, with ts as a timestamp."""
    raw = spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return raw.withColumn("ts", F.timestamp_micros(F.round(F.col("ts") * 1_000_000).cast("long")))


def problem_stream(records: DataFrame, rss_limit: float = 6500.0) -> DataFrame:
    return problems(records, rss_limit).select("ts", "kind", "name", "problem")


def heartbeats(records: DataFrame, every: str = "300 seconds", late: str = "10 minutes", bad=None) -> DataFrame:
    """Per window: records and how many of them are bad. A quiet window says so truthfully."""
    cond = F.col("rss_mb") > 6500 if bad is None else bad
    per = records.withWatermark("ts", late).groupBy(F.window("ts", every)).agg(
        F.count("*").alias("records"), F.count_if(F.coalesce(cond, F.lit(False))).alias("problems")
    )
    return per.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "records", "problems")


def rolling_spend(records: DataFrame, length: str = "24 hours", step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Per user and sliding window: calls, tokens in and out, cost. Missing amounts count as none."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    per = records.withWatermark("ts", late).groupBy("user_id", F.window("ts", length, step)).agg(
        F.count("*").alias("calls"), total("tokens_in"), total("tokens_out"), total("cost_usd")
    )
    return per.select("user_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "calls", "tokens_in", "tokens_out", "cost_usd")


def kept_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table that ``keep_latest`` keeps under ``path``, empty where there is none."""
    return keyed.kept(spark, path, schema)


def keep_latest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, tie: str, parts: int = keyed.PARTS):
    """Keep a table of the latest row per key under ``path``; ``kept_table`` reads it. Returns the query.

    A batch overwrites those parts of the table that its keys fall in, all of them in one write. A batch that runs again
    after a failure gives the same table.
    """

    def merge(batch: DataFrame, _: int) -> None:
        keyed.merged(batch, path, keys, lambda both: latest(both, keys, order, tie), parts)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_changes(events: DataFrame) -> DataFrame:
    """Batch form: per job in order of ts, events where the percentage differs from the one before, or the job ends."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    before = F.lag("pct").over(w)
    return events.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("pct") != F.col("_b")) | F.col("status").isin("completed", "failed")).drop("_b")


def progress_feed(stream: DataFrame, state: str, out: str, checkpoint: str, parts: int = keyed.PARTS):
    """Stream form: changes are appended to ``out``; the last events of each job are kept under ``state``.

    Of each job the last event of its latest batch is kept, and the last one before that batch: a batch that runs again
    after a failure compares with the latter and gives the same changes.
    """

    def step(batch: DataFrame, n: int) -> None:
        new = batch.withColumn("_batch", F.lit(n).cast("long"))
        earlier = F.col("_batch") < n
        old = latest(keyed.beside(new, state, ["job_id"], parts).where(earlier), ["job_id"], "ts", "event_id")
        both = old.withColumn("_old", F.lit(True)).unionByName(new.withColumn("_old", F.lit(False)))
        changes = progress_changes(both.drop("_batch")).where("not _old").select(*batch.columns)
        changes.write.mode("overwrite").parquet(f"{out}/batch={n}")
        two = lambda rows: latest(rows.withColumn("_before", earlier), ["job_id", "_before"], "ts", "event_id")
        keyed.merged(new, state, ["job_id"], two, parts)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
