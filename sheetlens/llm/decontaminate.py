"""Benchmark decontamination by winnowing.

A window is WINDOW consecutive words of an item, or all words of a shorter item. For windows of m words, k-gram hashes are
taken with k = (m + 1) // 2, and of every m - k + 1 of them that follow one another the least is kept: m words that occur on
both sides leave the same least hash on both, so no shared window is missed. Kept hashes of documents meet those of the
items by equality. Where they meet, the hit is extended to the m words that belong to it, which are compared as text; only
these decide.

Words are runs of characters other than ASCII signs, with A-Z in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlens.llm.common import materialize

WINDOW = 10
#: Hashes of benchmark windows, and of texts to read again, up to which they are sent to all tasks (8 bytes each); more are
#: joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of ``text``; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def _upto(n: Column) -> Column:
    """0 to n - 1, nothing where n isn't positive."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def grams(hashed: str, length: int) -> Column:
    """The hash of every run of ``length`` of the word hashes in column ``hashed``."""
    if length == 1:
        return F.transform(hashed, lambda h: F.xxhash64(h))
    return F.transform(_upto(F.size(hashed) - (length - 1)), lambda i: F.xxhash64(*[F.get(hashed, i + d) for d in range(length)]))


def least(hashes: str, length: int) -> Column:
    """The least of every run of ``length`` of the column ``hashes``: one for each window, in order."""
    if length == 1:
        return F.col(hashes)
    return F.transform(_upto(F.size(hashes) - (length - 1)), lambda i: F.least(*[F.get(hashes, i + d) for d in range(length)]))


def with_minima(df: DataFrame, words: str, window: int, name: str) -> DataFrame:
    """``df`` with ``name``: the kept hash of every window of ``window`` of its ``words``; the window at place p gives the
    hash at place p. Arrays that lambdas look into are columns of their own, so that they are made once a row."""
    k = (window + 1) // 2
    df = df.withColumn("_hashed", F.transform(words, lambda w: F.xxhash64(w))).withColumn("_grams", grams("_hashed", k))
    return df.withColumn(name, least("_grams", window - k + 1)).drop("_hashed", "_grams")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``items`` (item_id, text) to their windows: item_id, m (words), body (the words, space-joined), h (the kept hash).

    Items without words have none; an item's repeated window comes once. An item of fewer words is one window, with the
    least hash of all its grams."""
    own = materialize(items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")))
    long = with_minima(own.where(F.size("w") >= window), "w", window, "h")
    bodies = F.transform(_upto(F.size("h")), lambda i: F.struct(F.array_join(F.slice("w", i + 1, window), " ").alias("body"), F.get("h", i).alias("h")))
    long = long.select("item_id", F.lit(window).alias("m"), F.explode(bodies).alias("x")).select("item_id", "m", "x.body", "x.h")
    short = own.where((F.size("w") > 0) & (F.size("w") < window)).withColumn("m", F.size("w"))
    short = short.withColumn("_hashed", F.transform("w", lambda w: F.xxhash64(w)))
    h = F.coalesce(*[F.when(F.floor((F.col("m") + 1) / 2) == k, F.array_min(grams("_hashed", k))) for k in range(1, (window + 1) // 2 + 1)])
    short = short.select("item_id", "m", F.array_join("w", " ").alias("body"), h.alias("h"))
    return long.unionByName(short).distinct()


def _sent(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is sent to all tasks, if it's small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit (words inside any occurrence of a window of ``items``),
    n_items (item_ids with occurring windows), items_sha256 (of these ids, sorted as texts, comma-joined), contaminated.

    Null and empty texts have no words. Rows come out as often as they come in, those with a null doc_id too; more columns
    are ignored, on both sides. Items that share an item_id count as one, a null item_id as an empty text; null and empty
    items match nothing. An empty table of documents gives an empty result, one of items leaves all documents clean.

    Equal texts are matched once. Windows that many items share meet a document once; items come in by classes of windows
    that belong to the same items.
    """
    text = F.coalesce("text", F.lit(""))
    found = item_windows(items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text"), window)
    found = materialize(found)
    # Windows of the same items, told by their number and two sums over the ids, are a class.
    members = [F.count("*"), F.sum(F.xxhash64("item_id").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("item_id", F.lit(1)))]
    bench = materialize(found.groupBy("m", "body", "h").agg(F.concat_ws(",", *members).alias("class")))
    prints = materialize(bench.select("m", "h").distinct())
    lengths = sorted(r["m"] for r in prints.select("m").distinct().collect())  # ``window`` rows at most

    own, kept = docs.select("doc_id", F.sha2(text, 256).alias("sha"), words_of(F.col("text")).alias("w")), []
    for m in lengths:
        own = with_minima(own, "w", m, f"h{m}")
        kept.append(F.transform(F.array_distinct(f"h{m}"), lambda h: F.struct(F.lit(m).alias("m"), h.alias("h"))))
    kept = F.concat(*kept) if kept else F.array().cast("array<struct<m:int,h:bigint>>")
    own = materialize(own.select("doc_id", "sha", F.size("w").cast("long").alias("n_words"), kept.alias("kept")))
    met = own.select("doc_id", "sha", F.explode("kept").alias("x")).join(_sent(prints.select(F.struct("m", "h").alias("x"))), "x")

    # Texts with a met hash are read again, once each; their windows with such hashes are compared as text.
    again = met.groupBy("sha").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id")).alias("f"), F.collect_set("x").alias("met"))
    again = materialize(again.select("sha", "f.doc_id", "met"))
    keys = again.select(F.xxhash64("doc_id", "sha").alias("k")).distinct()
    near = docs.select("doc_id", F.sha2(text, 256).alias("sha"), "text").withColumn("k", F.xxhash64("doc_id", "sha"))
    near = near.join(_sent(keys), "k", "left_semi").drop("k").dropDuplicates(["sha"])
    near = near.join(again.select("sha", "met"), "sha").select("sha", "met", words_of(F.col("text")).alias("w"))
    near = materialize(near)
    spans = None
    for m in lengths:
        of_m = F.transform(F.filter("met", lambda x: x["m"] == m), lambda x: x["h"])
        there = materialize(with_minima(near.select("sha", "w", of_m.alias("hs")).where(F.size("hs") > 0), "w", m, "h"))
        at = F.filter(_upto(F.size("h")), lambda i: F.array_contains(F.col("hs"), F.get("h", i)))
        bodies = F.transform(at, lambda i: F.struct(i.alias("at"), F.array_join(F.slice("w", i + 1, m), " ").alias("body")))
        part = there.select("sha", F.explode(bodies).alias("x")).select("sha", F.lit(m).alias("m"), "x.at", "x.body")
        spans = part if spans is None else spans.unionByName(part)
    if spans is None:
        spans = near.select("sha", F.lit(0).alias("m"), F.lit(0).alias("at"), F.lit("").alias("body"))
    hits = materialize(spans.join(bench.select("m", "body", "class"), ["m", "body"]).select("sha", "at", "m", "class"))
    # Of all windows of a text: places of its words, and classes, each once.
    places = F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("at"), F.col("at") + F.col("m") - 1))))
    words = hits.groupBy("sha").agg(F.size(places).cast("long").alias("n_hit"))
    ids_of = found.join(bench, ["m", "body", "h"]).select("class", "item_id").distinct()
    ids = hits.select("sha", "class").distinct().join(ids_of, "class").groupBy("sha").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    ids = ids.select("sha", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    facts = materialize(words.join(ids, "sha"))
    out = own.select("doc_id", "sha", "n_words").join(facts, "sha", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )
