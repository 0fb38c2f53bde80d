"""Exact duplicates by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes. All distinct blocks are numbered in the order of their 64-bit
hashes, and of their contents where hashes clash, so equal blocks, and no others, have equal integer names. Then adjacent names are paired, the distinct pairs are sorted and numbered in turn, and so on
until each document has one name. Two documents have equal (number of blocks, name) exactly when their texts are equal:
names are given to contents, never to hashes alone.

A block's 64-bit hash only says where to look: blocks travel once, as a distinct set, to find the hashes that more than
one content shares. For these, contents are compared and numbered apart. All other tables hold numbers only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetlens.llm.common import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLOCK_BYTES = 4096


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null is empty. Pure ASCII text takes the fast ``lower``."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, UPPER.lower()))


def _blocks(data: Column, block_bytes: int) -> Column:
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / F.lit(block_bytes))).cast("int")
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.substring(data, i * block_bytes + 1, F.lit(block_bytes)),
    )


def _numbered(keys: DataFrame, *cols: str) -> DataFrame:
    """Distinct ``keys`` in sorted order with increasing integer names; written, so that the names stay."""
    return materialize(keys.orderBy(*cols).withColumn("name", F.monotonically_increasing_id()))


def block_names(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): row, doc_id, text_sha256, raw_sha256, n_blocks, name.

    ``hash_bits`` below 64 makes hashes clash, to test that names do not.
    """

    def key(block: Column) -> Column:
        return F.shiftright(F.xxhash64(block), 64 - hash_bits) if hash_bits < 64 else F.xxhash64(block)

    text = F.coalesce(F.col("text"), F.lit(""))
    data = docs.select("doc_id", F.sha2(text, 256).alias("raw_sha256"), ascii_lower(F.col("text")).cast("binary").alias("data"))
    cut = data.select(
        "doc_id", "raw_sha256", F.sha2("data", 256).alias("text_sha256"), _blocks(F.col("data"), block_bytes).alias("blocks")
    )
    rows = materialize(
        cut.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "raw_sha256",
            "text_sha256",
            F.size("blocks").alias("n_blocks"),
            F.transform("blocks", key).alias("keys"),
        )
    )
    contents = cut.select(F.explode("blocks").alias("block")).select(key(F.col("block")).alias("key"), "block").distinct()
    keys = materialize(contents.groupBy("key").agg(F.count("*").alias("contents")))
    seq = rows.select("row", "n_blocks", F.posexplode("keys").alias("pos", "key"))
    clashing = keys.where("contents > 1").select("key")
    if not clashing.isEmpty():
        # The contents that share a key, numbered among themselves, are compared whole.
        apart = materialize(
            contents.join(clashing, "key", "left_semi").withColumn(
                "variant", F.row_number().over(Window.partitionBy("key").orderBy("block"))
            )
        )
        numbered = cut.withColumn("text_key", F.col("text_sha256")).select(
            "text_key", F.posexplode("blocks").alias("pos", "block")
        )
        numbered = numbered.withColumn("key", key(F.col("block"))).join(apart, ["key", "block"])
        found = numbered.select("text_key", "pos", "variant").distinct()
        seq = (
            seq.join(rows.select("row", F.col("text_sha256").alias("text_key")), "row")
            .join(found, ["text_key", "pos"], "left")
            .select("row", "n_blocks", "pos", "key", F.coalesce("variant", F.lit(1)).alias("variant"))
        )
    else:
        seq = seq.withColumn("variant", F.lit(1))
    names = _numbered(
        keys.select("key", F.explode(F.sequence(F.lit(1), F.col("contents").cast("int"))).alias("variant")), "key", "variant"
    )
    seq = materialize(seq.join(names, ["key", "variant"]).select("row", "n_blocks", "pos", "name"))
    most = rows.agg(F.max("n_blocks")).first()[0] or 1
    done, step = seq.where("n_blocks = 1").select("row", "n_blocks", "name"), 1
    seq = seq.where("n_blocks > 1")
    while step < most:
        pairs = materialize(
            seq.groupBy("row", "n_blocks", F.shiftright("pos", 1).alias("pos")).agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
            )
        )
        names = _numbered(pairs.select("a", "b").distinct(), "a", "b")
        seq = materialize(pairs.join(names, ["a", "b"]).select("row", "n_blocks", "pos", "name"))
        step *= 2
        done = done.unionByName(seq.where(F.col("n_blocks") <= step).select("row", "n_blocks", "name"))
        seq = seq.where(F.col("n_blocks") > step)
    return rows.select("row", "doc_id", "text_sha256", "raw_sha256").join(done, "row")


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, raw_sha256.

    Texts are equal when they are identical after lower-casing A-Z only. Of equal texts, the row with the largest doc_id
    stays; of repeated rows with that doc_id exactly one. Null text counts as empty; null doc_ids are smallest, and a
    group with no other id keeps one of its rows with keep_id null. An empty table gives an empty result; more columns
    of ``docs`` are ignored.
    """
    named = materialize(block_names(docs, block_bytes, hash_bits))
    best = F.max(F.struct("doc_id", (-F.col("row")).alias("row")))
    groups = materialize(named.groupBy("n_blocks", "name").agg(best.alias("best"), F.count("*").alias("group_size")))
    return named.join(groups, ["n_blocks", "name"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == -F.col("best.row")).alias("kept"),
        "text_sha256",
        "raw_sha256",
    )
