"""Tables of keyed rows that are kept up to date by overwriting the partitions that a change falls in.

Keys are dealt into parts by a hash; a part is a partition of a Parquet table. A change reads the parts it touches, which
Spark prunes to, and writes them by one dynamic partition overwrite. A part that loses all its rows keeps a hole, a row that
readers leave out, so that it's overwritten too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetlens.plans.graph import stored

PARTS = 64
_PART, _HOLE = "_part", "_hole"


def part_of(keys: list[str], parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(at)


def _stored(spark: SparkSession, path: str, schema) -> DataFrame | None:
    if not _exists(spark, path):
        return None
    own = spark.createDataFrame([], schema).withColumn(_HOLE, F.lit(False)).withColumn(_PART, F.lit(0)).schema
    return spark.read.schema(own).parquet(path)


def kept(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of the table under ``path``; none where there is no table yet."""
    found = _stored(spark, path, schema)
    return spark.createDataFrame([], schema) if found is None else found.where(f"NOT {_HOLE}").drop(_HOLE, _PART)


def _overwrite(rows: DataFrame, touched: DataFrame, path: str) -> None:
    """Write ``rows`` (with their part) over the parts in ``touched`` (part)."""
    hole = touched.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != _PART], _PART)
    all_ = rows.withColumn(_HOLE, F.lit(False)).unionByName(hole.withColumn(_HOLE, F.lit(True)))
    # The files are read while they are replaced, so the new rows are complete before the first is dropped.
    done = stored(all_.repartition(_PART))
    done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_PART).parquet(path)


def _touched(rows: DataFrame, old: DataFrame | None, keys: list[str], parts: int) -> tuple[DataFrame, DataFrame | None]:
    """The parts that ``rows`` fall in, and what the table has in them."""
    touched = rows.select(part_of(keys, parts).alias(_PART)).distinct()  # ``parts`` rows at most
    if old is not None:
        old = old.where(f"NOT {_HOLE}").drop(_HOLE).join(F.broadcast(touched), _PART, "left_semi")
    return touched, old


def beside(new: DataFrame, path: str, keys: list[str], parts: int = PARTS) -> DataFrame:
    """The rows of the table under ``path`` in the parts that ``new`` falls in; none where there is no table yet."""
    spark = new.sparkSession
    _, old = _touched(new, _stored(spark, path, new.schema), keys, parts)
    return new.limit(0) if old is None else old.select(*new.columns)


def merged(new: DataFrame, path: str, keys: list[str], combine: Callable[[DataFrame], DataFrame], parts: int = PARTS) -> None:
    """Put ``new`` into the table under ``path``: ``combine`` makes one table of the old and the new rows of the touched parts.

    ``combine`` must give the same when rows that are there come once more; then a change that is made again after a
    failure leaves the same table.
    """
    touched, old = _touched(new, _stored(new.sparkSession, path, new.schema), keys, parts)
    both = new if old is None else old.select(*new.columns).unionByName(new)
    _overwrite(combine(both).select(*new.columns).withColumn(_PART, part_of(keys, parts)), touched, path)


def removed(spark: SparkSession, path: str, schema, gone: Column, only: Column | None = None) -> None:
    """Take the rows that meet ``gone`` out of the table under ``path``. ``only`` is the one part that has such rows, if
    that's known: other parts aren't read then."""
    found = _stored(spark, path, schema)
    if found is None:
        return
    rows = found.where(f"NOT {_HOLE}") if only is None else found.where(f"NOT {_HOLE}").where(F.col(_PART) == only)
    goes = F.coalesce(gone, F.lit(False))
    touched = stored(rows.where(goes).select(_PART).distinct())  # ``parts`` rows at most
    if touched.isEmpty():
        return
    rest = rows.where(~goes).drop(_HOLE).join(F.broadcast(touched), _PART, "left_semi")
    _overwrite(rest, touched, path)
