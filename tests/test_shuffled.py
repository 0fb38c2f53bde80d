"""What grows with the tables isn't sent to all tasks, however small Spark takes it to be."""

from pyspark.sql import functions as F

from sheetlens import queries
from sheetlens.plans import graph

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunks_by_cells_are_shuffled(spark):
    assert "Broadcast" not in plan(queries.QUERIES["smallest_chunks"](spark, SF))


def test_only_nations_are_sent_for_located_entries(spark):
    assert plan(queries.QUERIES["located_entries"](spark, SF)).count("BroadcastExchange") <= 9  # each of three attempts names nations three times


def test_tables_are_written_without_sending_a_side(spark):
    """The session's settings are the same afterwards."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before, seen = spark.conf.get(name), []
    one = spark.range(5).withColumn("x", F.lit(1))
    wrapped = one.join(spark.range(5), "id")
    write = type(wrapped.write).parquet
    try:
        type(wrapped.write).parquet = lambda self, path: (seen.append(spark.conf.get(name)), write(self, path))[1]
        assert graph.stored(wrapped).count() == 5
    finally:
        type(wrapped.write).parquet = write
    assert seen == ["-1"] and spark.conf.get(name) == before
