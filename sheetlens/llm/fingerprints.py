"""Document fingerprints: SimHash of weighted terms, and a search by permuted block tables.

Terms are pairs of neighbouring words; a term that occurs n times has the weight 1 + ln n. Each term's hash votes with its
weight for or against every bit, and the fingerprint is the sign of the sums.

The search cuts fingerprints into radius + 1 blocks and keeps one table per block, permuted so that this block leads: two
fingerprints that differ in at most ``radius`` bits agree on at least one whole block, so that an equality join on the
leading block finds every such pair.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructType
from pyspark.sql.window import Window
from xxhash import xxh3_128_digest

from sheetlens.llm.common import materialize

BITS, RADIUS = 256, 7
#: Rows whose doc_id divides by this ask the index for their neighbours.
QUERY_EVERY = 50
_SLICE = 400


def simhash(text: str | None) -> bytes:
    """The 256-bit fingerprint of ``text``. Without a pair of words its one word is the term; without words it's zero."""
    words = (text or "").lower().encode().split()
    terms = Counter(map(b" ".join, zip(words, words[1:]))) if len(words) > 1 else Counter(words)
    if not terms:
        return bytes(BITS // 8)
    weights = 1 + np.log(np.fromiter(terms.values(), np.float32, len(terms)))
    votes = np.zeros(BITS)
    keys = list(terms)
    for part in range(0, len(keys), 4096):  # the terms of a very long text in pieces
        digests = b"".join([xxh3_128_digest(t, 1) + xxh3_128_digest(t, 2) for t in keys[part : part + 4096]])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, BITS // 8), axis=1)
        votes += weights[part : part + 4096] @ bits.astype(np.float32)
    return np.packbits(2 * votes > weights.sum(dtype=np.float64)).tobytes()


@F.pandas_udf(BinaryType())
def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series([simhash(t) for t in part], dtype=object)


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many of ``following``, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fp", pa.binary()), ("edited_sha256", pa.string()),
        ("edited_fp", pa.binary()), ("next_fp", pa.binary()), ("part", pa.int32()), ("first_text", pa.string()),
        ("last_text", pa.string()),
    ]
)
_OUT_DDL = (
    "doc_id long, n_chars long, fp binary, edited_sha256 string, edited_fp binary, next_fp binary, part int, "
    "first_text string, last_text string"
)


def _against(text: str, following: str, next_fp: bytes) -> tuple[str, bytes, bytes]:
    new = edited(text, following)
    return hashlib.sha256(new.encode()).hexdigest(), simhash(new), next_fp


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in descending order; each waits for the one after it. The first and last text go along."""
    part, held, first = TaskContext.get().partitionId(), None, True
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            rows = []
            for r in batch.slice(at, _SLICE).to_pylist():
                text = r["text"]
                fp = simhash(text)
                if held is not None:
                    rows.append((*held[0], *_against(held[1], text, fp), part, held[2], None))
                held = ((r["doc_id"], len(text), fp), text, text if first else None)
                first = False
            if rows:
                yield _batch(rows)
    if held is not None:
        yield _batch([(*held[0], None, None, None, part, held[2], held[1])])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)


@F.pandas_udf(StructType().add("edited_sha256", StringType()).add("edited_fp", BinaryType()).add("next_fp", BinaryType()))
def _joined(text: pd.Series, following: pd.Series) -> pd.DataFrame:
    got = [_against(a, b, simhash(b)) for a, b in zip(text, following)]
    return pd.DataFrame(got, columns=["edited_sha256", "edited_fp", "next_fp"], dtype=object)


def edit_likeness(docs: DataFrame, ranges: int | None = None, radius: int = RADIUS, every: int = QUERY_EVERY) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_chars, its fingerprint, how like it is to two other texts, and how many rows
    the search finds near it.

    The next document is the one with the next smaller doc_id, for the last the one with the largest; rows with the same
    doc_id follow each other by their texts' hashes, null ids come last. The edited text is this text with its last
    floor(n_chars/2) code points replaced by the first as many of the next. Null text is empty, whose fingerprint is zero.
    One row alone is its own next. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex),
    near_edited, near_next (share of equal bits), n_within: for rows whose doc_id divides by ``every``, the number of other
    rows within ``radius`` bits, by the search in permuted block tables over all rows; null for rows that don't ask.

    Texts move once, into ``ranges`` ranges of doc_id (as many as the session's shuffle partitions), which are read in
    order. Where ranges meet, one text of each side is joined in a second, small step.
    """
    spark = docs.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie").desc()]
    walked = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    seen = materialize(walked.mapInArrow(_walk, _OUT_DDL))
    firsts = seen.where("first_text is not null").select(F.col("part").alias("next_part"), F.col("first_text").alias("following"))
    parts = firsts.select(F.col("next_part").alias("part"))  # a number for each range
    low = F.min("part").over(Window.partitionBy())
    after = F.coalesce(F.lead("part").over(Window.orderBy("part")), low)
    parts = parts.select("part", after.alias("next_part"))
    ends = seen.where("last_text is not null").select("doc_id", "n_chars", "fp", "part", "last_text")
    met = ends.join(parts, "part").join(firsts, "next_part").withColumn("x", _joined("last_text", "following"))
    out = seen.where("last_text is null").select("doc_id", "n_chars", "fp", "edited_sha256", "edited_fp", "next_fp")
    out = out.unionByName(met.select("doc_id", "n_chars", "fp", "x.edited_sha256", "x.edited_fp", "x.next_fp"))
    asks = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    found = neighbour_counts(seen.where(asks).select("fp"), seen.select("fp"), radius)
    # Only rows that ask look for their count; all others stay where they are.
    told = out.where(asks).join(found, "fp").select(*out.columns, (F.col("n") - 1).alias("n_within"))
    out = out.where(~asks).withColumn("n_within", F.lit(None).cast("long")).unionByName(told)
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.lower(F.hex("fp")).alias("fingerprint"),
        F.lower(F.hex("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "n_within",
    )


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two fingerprints, in eight words of 32 bits."""
    word = lambda c, i: F.conv(F.hex(F.substring(c, 4 * i + 1, F.lit(4))), 16, 10).cast("long")
    return sum((F.bit_count(word(a, i).bitwiseXOR(word(b, i))) for i in range(BITS // 32)), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    return 1 - distance(a, b) / F.lit(float(BITS))


def within_radius(queries: DataFrame, index: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs (query_id, id, bits) of ``queries`` and ``index`` (id, fp) at a distance of at most ``radius`` bits.

    Exact for every radius below the number of bytes (32). Equal fingerprints are looked up once: ids meet their
    fingerprint again after the search. Null fingerprints match nothing; an empty side gives an empty result.
    """
    met = _near(queries, index, radius)
    out = met.join(queries.select(F.col("id").alias("query_id"), F.col("fp").alias("q")), "q")
    return out.join(index.select("id", F.col("fp").alias("x")), "x").select("query_id", "id", "bits")


def _near(queries: DataFrame, index: DataFrame, radius: int) -> DataFrame:
    """Pairs (q, x, bits) of different fingerprints, or equal ones, within ``radius``, each once.

    A pair is kept in the first table in which its leads agree. Distances are judged inside the join, so a lead that very
    many fingerprints share gives rows for true pairs only; adaptive execution splits it.
    """
    size = BITS // 8
    if not 0 <= radius < size:
        raise ValueError(f"the radius is from 0 to {size - 1} bits")
    blocks = radius + 1
    cut = [size * i // blocks for i in range(blocks + 1)]
    lead = lambda fp, i: F.substring(fp, cut[i] + 1, F.lit(cut[i + 1] - cut[i]))

    def tables(df: DataFrame, name: str) -> DataFrame:
        own = df.where("fp is not null").select("fp").distinct()
        leads = F.array(*[lead(F.col("fp"), i) for i in range(blocks)])
        return own.select(F.col("fp").alias(name), F.posexplode(leads).alias("table", "lead"))

    q, x = F.col("q"), F.col("x")
    first = F.coalesce(*[F.when(lead(q, i) == lead(x, i), i) for i in range(blocks)])
    met = tables(queries, "q").join(tables(index, "x"), ["table", "lead"])
    return met.where((distance(q, x) <= radius) & (first == F.col("table"))).select("q", "x", distance(q, x).alias("bits"))


def neighbour_counts(asked: DataFrame, rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """For each fingerprint of ``asked`` (fp): fp and n, the number of ``rows`` (fp) within ``radius`` bits of it.

    Rows are counted per fingerprint first, so copies in any number aren't paired. Null fingerprints are left out.
    """
    points = materialize(rows.groupBy("fp").agg(F.count("*").alias("n")))
    met = _near(asked, points, radius).join(points.withColumnRenamed("fp", "x"), "x")
    return materialize(met.groupBy(F.col("q").alias("fp")).agg(F.sum("n").alias("n")))
