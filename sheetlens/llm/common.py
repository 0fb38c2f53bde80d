"""Shared helpers: durable intermediate tables, null-safe joins and row-identity filters."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlens.plans.graph import shared_dir as work_dir
from sheetlens.plans.graph import stored as materialize

__all__ = ["free_names", "gives_back", "keep_rows", "materialize", "safe_join", "work_dir"]


def safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equality join on ``keys`` in which null equals null; the keys appear once, from ``left``."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[f"_right_{k}"])
    return left.join(right, cond, how).drop(*[f"_right_{k}" for k in keys])


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted`` as names of helper columns, with so many underscores in front that none is a column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, SHA-256 of the text) is in ``kept``, each once.

    ``kept`` has the columns doc_id and raw_sha256 without repeats. Rows of ``docs`` that repeat both come out once;
    the extra step for this runs only where such repeats exist. All columns of ``docs`` come back in their order.
    """
    (own,) = free_names(docs, "sha")
    sha = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    key = docs.select("doc_id", sha.alias(own)).groupBy("doc_id", own).count()
    repeats = not key.where("count > 1").isEmpty()
    marked = docs.withColumn(own, sha)
    keep, keep_sha = free_names(marked, "keep", "keep_sha")
    right = kept.select(F.col("doc_id").alias(keep), F.col("raw_sha256").alias(keep_sha))
    cond = marked["doc_id"].eqNullSafe(right[keep]) & (marked[own] == right[keep_sha])
    out = marked.join(right, cond, "left_semi")
    if repeats:
        out = out.dropDuplicates(["doc_id", own])
    return out.select(*[out[c] for c in docs.columns])


def gives_back(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task``, a generator over batches, so that memory which it has held goes back to the system behind each batch and at
    its end. Python workers outlive their tasks: what one stage has held would count against the next."""

    @functools.wraps(task)
    def run(parts):
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

        def give() -> None:
            pyarrow.default_memory_pool().release_unused()
            if trim is not None:
                trim(0)

        for out in task(parts):
            yield out
            del out
            give()
        give()

    return run
