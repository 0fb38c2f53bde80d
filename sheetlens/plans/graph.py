"""Connected components within groups, by contraction; tables that cut the lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROUNDS = 100


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that the session names in ``spark.checkpoint.dir``. Where it's unset, a local folder does on
    one machine; on a cluster, whose executors don't share such a folder, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sheetlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/sheetlens/{uuid.uuid4().hex}"


#: While a table is written: its shuffle files go as soon as it's done, and no side of a join is sent to all tasks, since packed
#: files of repeated numbers are many times smaller than their rows in memory.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.autoBroadcastJoinThreshold": "-1"}


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: the lineage is cut and lost executors don't matter."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    before = {k: spark.conf.get(k, None) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def connected(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``edges`` (keys, a, b) to (keys, node, component), the least node that each node reaches; nodes without edges don't
    appear.

    In each round every node goes over to the one of its neighbours and itself that comes first in an order drawn for the
    round, and on from there to where that one goes; edges are then taken between where their ends have gone. As the order
    is drawn, whole neighbourhoods fall together whatever the numbers are: rounds grow with the logarithm of the longest
    way, and each has less to do than the one before. It fails if edges are left after MAX_ROUNDS.
    """
    both = edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both, ways = stored(both), []
    while not ways or not both.isEmpty():
        if len(ways) == MAX_ROUNDS:
            raise RuntimeError(f"edges are left after {MAX_ROUNDS} rounds")
        rank = lambda c: F.xxhash64(F.lit(len(ways)), c)  # noqa: E731, B023
        best = both.groupBy(*keys, "a").agg(F.min_by("b", rank("b")).alias("b"))
        up = best.select(*keys, "a", F.when(rank("a") < rank("b"), F.col("a")).otherwise(F.col("b")).alias("b"))
        way = stored(up.join(up.select(*keys, F.col("a").alias("b"), F.col("b").alias("to")), [*keys, "b"]).select(*keys, "a", "to"))
        ways.append(way)
        ends = both.join(way, [*keys, "a"]).select(*keys, F.col("to").alias("x"), F.col("b").alias("a")).join(way, [*keys, "a"])
        left = stored(ends.where("x <> to").select(*keys, F.col("x").alias("a"), F.col("to").alias("b")).distinct())
        release(both)
        both = left
    release(both)
    # From the last round back; later ones are small, so that some are joined at once.
    last = ways[-1]
    for k, way in enumerate(reversed(ways[:-1])):
        on = way.join(last.select(*keys, F.col("a").alias("to"), F.col("to").alias("end")), [*keys, "to"], "left")
        last = on.select(*keys, "a", F.coalesce("end", "to").alias("to"))
        if k % 4 == 3:
            last = stored(last)
    last = stored(last)
    least = last.groupBy(*keys, "to").agg(F.min("a").alias("component"))
    out = stored(last.join(least, [*keys, "to"]).select(*keys, F.col("a").alias("node"), "component"))
    release(last, *ways)
    return out
