"""SimHash near-duplicates with covering locality-sensitive hashing.

A 64-bit fingerprint is the bitwise majority over the XXH64 values of a text's word shingles. To find every pair of
fingerprints at a Hamming distance of at most r, bit i gets the label phi(i) = i mod (2^(r+1) - 1) + 1, a non-zero vector
of r+1 bits. For each non-zero v of r+1 bits there is one table, whose mask holds the bits with odd phi(i) & v. The labels
of r differing bits leave at least one v orthogonal to all of them, and in that table both fingerprints have the same key:
no pair within the radius is missed, whatever the data.

Only connections count for the components, so a crowded bucket isn't expanded into pairs. Its members are linked through
the values next to them outside the mask: two fingerprints are within distance 2 exactly when a value within distance 1
of both exists, and at most 65 fingerprints lie that close to one value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from xxhash import xxh64_intdigest

from sheetlens.llm.common import gives_back, materialize
from sheetlens.llm.graph import components

SHINGLE_WORDS, SEED, RADIUS = 3, 42, 2
#: Members of a bucket that are compared with each other; a larger bucket goes through the values next to its members.
PAIRWISE = 32


def fingerprint(data: bytes, width: int = SHINGLE_WORDS) -> int:
    """The fingerprint of UTF-8 ``data``; bytes methods know A-Z and ASCII white space only, as the definition asks."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxh64_intdigest(b" ".join(words), SEED)  # one shingle is its own majority
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -width] + 1).tolist()]
    hashes = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], ">u8")
    counts = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 8192):  # the bits of a very long text in pieces
        counts += np.unpackbits(hashes[part : part + 8192].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0])


@F.pandas_udf(LongType())
@gives_back
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series(np.array([fingerprint((t or "").encode()) for t in part], np.uint64).view(np.int64))


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """One mask per table, as signed longs."""
    labels = 2 ** (radius + 1) - 1
    out = []
    for v in range(1, labels + 1):
        m = sum(1 << i for i in range(bits) if bin(((i % labels) + 1) & v).count("1") % 2)
        out.append(m - (1 << 64) if m >= 1 << 63 else m)
    return out


def links(points: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """Edges (a, b) that connect all ``points`` (fp, node; both unique) within distance 2 of each other.

    Each edge joins fingerprints within that distance. Buckets of up to ``pairwise`` members give their close pairs,
    larger ones a star around each neighbouring value, so edges stay in proportion to the points at any crowding.
    """
    table = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).alias("mask")) for i, m in enumerate(masks())])
    keyed = points.select("fp", "node", F.explode(table).alias("k")).select(
        F.col("k.t").alias("t"), F.col("fp").bitwiseAND(F.col("k.mask")).alias("key"), "k.mask", "fp", "node"
    )
    crowds = materialize(keyed.groupBy("t", "key").agg(F.count("*").alias("members")).where("members > 1"))
    member = materialize(keyed.join(crowds, ["t", "key"]))
    few = member.where(F.col("members") <= pairwise)
    x, y = few.select("t", "key", "fp", "node"), few.select("t", "key", F.col("fp").alias("fp2"), F.col("node").alias("node2"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= RADIUS
    near = x.join(y, ["t", "key"]).where((F.col("fp") < F.col("fp2")) & close)
    near = near.select(F.col("node").alias("a"), F.col("node2").alias("b"))
    # Flips of single bits outside the mask, and the value itself.
    bits = F.array(F.lit(0), *[F.lit(b - (1 << 64) if (b := 1 << i) >= 1 << 63 else b) for i in range(64)])
    outside = F.filter(bits, lambda b: b.bitwiseAND(F.col("mask")) == 0)
    around = member.where(F.col("members") > pairwise).select("node", "fp", F.explode(outside).alias("bit"))
    around = around.select("node", F.col("fp").bitwiseXOR(F.col("bit")).alias("value")).distinct()
    stars = around.groupBy("value").agg(F.collect_list("node").alias("nodes")).where(F.size("nodes") > 1)  # 65 at most
    stars = stars.select(F.array_min("nodes").alias("a"), F.explode("nodes").alias("b")).where("a <> b")
    return near.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at 2 or fewer differing bits; component_id is the smallest doc_id that a row reaches over links,
    itself included. Null text is empty; texts without words have fingerprint zero and link like any other. Rows with a
    null doc_id take part; a group that has no other ids gets component_id null. Repeated rows come out as often as
    they come in; an empty table gives an empty result; more columns of ``docs`` are ignored.
    """
    rows = materialize(docs.select("doc_id", _fingerprints(F.coalesce("text", F.lit(""))).alias("fp")))
    return linked(rows).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def linked(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, fp, more columns) with component (a number for each group) and component_id (its least doc_id)."""
    points = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    # Numbers in the order of the ids, and after them for fingerprints whose rows have none; an id can have several texts.
    order = [F.col("first_id").asc_nulls_last(), F.col("fp")]
    points = materialize(points.orderBy(*order).withColumn("node", F.monotonically_increasing_id()))
    comp = components(links(points.select("fp", "node")))
    found = points.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    roots = points.select(F.col("node").alias("component"), F.col("first_id").alias("component_id"))
    named = materialize(found.join(roots, "component").select("fp", "component", "component_id"))
    return rows.join(named, "fp")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates: doc_id, raw_sha256. It's the row with the smallest doc_id, then text hash;
    rows with a null doc_id come last."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = materialize(rows.select("doc_id", F.sha2("text", 256).alias("raw_sha256"), _fingerprints("text").alias("fp")))
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "raw_sha256")).alias("first")
    return linked(rows).groupBy("component").agg(first).select("first.doc_id", "first.raw_sha256")


def groups(docs: DataFrame) -> DataFrame:
    """Per different text of ``docs`` (doc_id, text) the number of its group of near-duplicates: raw_sha256, component."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = materialize(rows.select("doc_id", F.sha2("text", 256).alias("raw_sha256"), _fingerprints("text").alias("fp")))
    return linked(rows).select("raw_sha256", "component").distinct()
