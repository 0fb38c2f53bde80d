"""All pairs of texts whose word shingles are alike: an exact set-similarity join by prefixes.

Texts are sets of hashed shingles. In any one order of all shingles, two sets of Jaccard similarity t or more have a shingle
in common among the first n - ceil(t n) + 1 of either, so an equality join on these prefixes finds every such pair, and the
sets themselves decide. Common shingles come last in the order; that changes the work, not the pairs.

A covering search over 64-bit SimHash can't take this place: texts of similarity 0.8 differ by 10 bits or more, for which it
has 2^11 - 1 tables and more.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType
from xxhash import xxh64_intdigest

from sheetlens.llm.common import gives_back, materialize
from sheetlens.llm.graph import components

WIDTH, SIMILARITY, SEED = 5, 0.8, 42
#: Members of a bucket that are all compared with each other in the first round; it grows by GROWTH a round.
PAIRWISE, GROWTH = 16, 4
#: Pairs for each member of a bucket, on average, up to which all are compared.
ALL_PAIRS = 256
#: Members of a block of a large bucket; buckets are dealt out as pairs of blocks.
BLOCK = 512
#: Shingles that are moved to the end of the order: the most common ones of one in SAMPLE documents, from LEAST up.
COMMON, SAMPLE, LEAST = 100_000, 16, 3
#: Bits of the parity map of a set.
BITS = 2048
#: Longs of the map that is compared first, within large buckets: the whole one laid on itself.
FOLDED = 8
#: Nodes whose texts are looked up by a broadcast of their hashes (8 bytes each); more are joined by a shuffle.
BROADCAST_NODES = 1_000_000
_CACHE_WORDS = 100_000


_WORDS: dict[bytes, int] = {}
#: Odd multipliers, one per place of a word in a shingle.
_PLACES = np.array([xxh64_intdigest(bytes([i]), SEED) | 1 for i in range(64)], np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The different shingles of ``text`` as hashes in order; a text of fewer words is one shingle, one without words none.

    A shingle's hash is a sum of its words' hashes, each times an odd number that stands for its place.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.int64)
    if len(_WORDS) > _CACHE_WORDS:
        _WORDS.clear()
    for w in set(words):
        if w not in _WORDS:
            _WORDS[w] = xxh64_intdigest(w, SEED)
    own, width = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words)), min(width, len(words))
    last = len(words) - width + 1
    sums = own[:last] * _PLACES[0] + np.uint64(width)
    for k in range(1, width):
        sums += own[k : k + last] * _PLACES[k]
    return np.unique((sums ^ (sums >> np.uint64(29))).view(np.int64))


def parity(own: np.ndarray) -> bytes:
    """Of each of BITS classes of shingles, whether the set has an odd number. Two sets differ in as many shingles, at
    least, as their maps differ in bits."""
    return np.packbits(np.bincount(own & (BITS - 1), minlength=BITS).astype(np.uint8) & 1).tobytes()


def _prefixes(width: int, similarity: float, common: np.ndarray):
    """A function of texts to n (different shingles), the prefix and the parity map in longs; ``common`` has shingles in
    order of their hash, each with its place among the common ones."""

    @F.pandas_udf(StructType().add("n", LongType()).add("prefix", ArrayType(LongType())).add("map", ArrayType(LongType())))
    @gives_back
    def prefixes(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for text in part:
                own = shingles(text, width)
                size = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1 if len(own) else 0
                bits = np.frombuffer(parity(own), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common[:, 0], own), len(common) - 1)
                    place = np.where(common[at, 0] == own, common[at, 1], 0)
                    own = own[np.lexsort((own, place))]
                rows.append((len(own), own[:size], bits))
            yield pd.DataFrame(rows, columns=["n", "prefix", "map"])

    return prefixes


def _sets(width: int):
    @F.pandas_udf(ArrayType(LongType()))
    @gives_back
    def sets(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([shingles(t, width) for t in part], dtype=object)

    return sets


def _heads(many: DataFrame, seed: int) -> DataFrame:
    """Of each bucket of ``many`` (shingle, node, n) the shortest member, the longest and two by a hash: shingle, node2, n2."""
    size, hashed = F.struct("n", "node"), F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), "n", "node")
    some = many.groupBy("shingle").agg(F.min(size).alias("p"), F.max(size).alias("q"), F.min(hashed).alias("r"), F.max(hashed).alias("s"))
    heads = F.array("p", "q", F.struct("r.n", "r.node"), F.struct("s.n", "s.node"))
    heads = some.select("shingle", F.explode(F.array_distinct(heads)).alias("head"))
    return materialize(heads.select("shingle", F.col("head.node").alias("node2"), F.col("head.n").alias("n2")))


def _candidates(met: DataFrame, similarity: float, pairwise: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a, b) of ``met`` (shingle, node, n) to compare, and the part of ``met`` in buckets of more than ``pairwise``
    members, if there are such. These give pairs with four of their members only: the shortest, the longest and two by a hash.
    """
    buckets = materialize(met.groupBy("shingle").agg(F.count("*").alias("members")).where("members > 1"))
    alike = F.least("n", "n2") >= similarity * F.greatest("n", "n2") - 1e-9
    few = met.join(buckets.where(F.col("members") <= pairwise).select("shingle"), "shingle", "left_semi")
    x, y = few.select("shingle", "node", "n"), few.select("shingle", F.col("node").alias("node2"), F.col("n").alias("n2"))
    pairs = x.join(y, "shingle").where((F.col("node") < F.col("node2")) & alike).select("node", "node2")
    crowds = buckets.where(F.col("members") > pairwise).select("shingle")
    many = None
    if not crowds.isEmpty():
        many = materialize(met.join(crowds, "shingle", "left_semi"))
        heads = _heads(many, pairwise)
        star = many.join(heads, "shingle").where((F.col("node") != F.col("node2")) & alike)
        pairs = pairs.unionByName(star.select(F.least("node", "node2").alias("node"), F.greatest("node", "node2").alias("node2")))
    return materialize(pairs.distinct().toDF("a", "b")), many


def _may_be_alike(longs: int, similarity: float) -> Column:
    """Whether maps x and y of so many ``longs`` leave it open that sets of n and n2 shingles have the similarity."""
    differ = functools.reduce(Column.__add__, [F.bit_count(F.col("x")[i].bitwiseXOR(F.col("y")[i])) for i in range(longs)])
    return differ <= (1 - similarity) / (1 + similarity) * (F.col("n") + F.col("n2")) + 1e-6


def _alike(pairs: DataFrame, maps: DataFrame, sets_of, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) that have the similarity; ``maps`` (node, n, map) rule most of them out, and sets, which
    ``sets_of`` gives for a table of nodes, decide on the others."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    maps = materialize(maps.join(nodes, "node", "left_semi"))
    both = pairs.join(maps.toDF("a", "n", "x"), "a").join(maps.toDF("b", "n2", "y"), "b")
    pairs = materialize(both.where(_may_be_alike(BITS // 64, similarity)).select("a", "b"))
    sets = materialize(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return materialize(both.where(shared >= similarity * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b"))


def common_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """Shingles that many of a sample of ``texts`` (text) have, in order of their hash, with their count. Null and empty texts
    have none; repeated texts count as often as they come; an empty table gives an empty array."""
    some = texts.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    often = some.select(F.explode(_sets(width)("text")).alias("shingle")).groupBy("shingle").count()
    often = often.where(F.col("count") >= LEAST).orderBy(F.desc("count"), "shingle").limit(COMMON).toPandas()  # COMMON rows at most
    return often[["shingle", "count"]].sort_values("shingle").to_numpy(np.int64).reshape(-1, 2)


def _joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node, c: the least node of its component so far) after ``edges`` (a, b) have joined components."""
    ends = edges.join(labels.toDF("a", "x"), "a").join(labels.toDF("b", "y"), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    low = components(ends).toDF("c", "low")
    return materialize(labels.join(low, "c", "left").select("node", F.coalesce("low", "c").alias("c")))


def _across(many: DataFrame, similarity: float, most: int) -> tuple[DataFrame, DataFrame | None] | None:
    """Pairs (a, b) of ``many`` (shingle, node, n, map, c) that lie in different components c, to compare, and the part of
    ``many`` in buckets that aren't settled by them, if there are such. Nothing, if each bucket is one component by now.
    Pairs whose numbers of shingles or maps tell that they aren't alike are left out.

    Buckets with up to ``most`` pairs of members in different components give all of these; if all buckets together have
    ALL_PAIRS for each member or fewer, all do. Others give their members outside the largest component with four inside.
    """
    k, alike = F.col("k"), (F.least("n", "n2") >= similarity * F.greatest("n", "n2") - 1e-9) & _may_be_alike(FOLDED, similarity)
    buckets = many.groupBy("shingle", "c").agg(F.count("*").alias("k")).groupBy("shingle").agg(
        F.sum(k).alias("m"), F.max(F.struct("k", "c")).alias("top"), F.sum(k * k).alias("kk")
    )
    cross = F.expr("(m * m - kk) div 2").alias("cross")
    buckets = materialize(buckets.select("shingle", "m", F.col("top.c").alias("main"), cross).where("cross > 0"))
    total = buckets.agg(F.sum("m").alias("m"), F.sum("cross").alias("cross")).first()
    if not total["m"]:
        return None
    most = sys.maxsize if total["cross"] <= ALL_PAIRS * total["m"] else most
    many = materialize(many.join(buckets, "shingle").withColumn("blocks", F.expr(f"(m - 1) div {BLOCK} + 1")))
    # One of two members in different components is outside the largest one. Large buckets are dealt out as pairs of blocks.
    few, block = many.where(F.col("cross") <= most), F.pmod(F.xxhash64("node"), F.col("blocks"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    x = few.select("shingle", "node", "n", F.col("map").alias("x"), "c", (F.col("c") == F.col("main")).alias("inside"), block.alias("i"), each.alias("j"))
    y = few.where("c <> main").select("shingle", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("map").alias("y"), F.col("c").alias("c2"), each.alias("i"), block.alias("j"))
    once = (F.col("c") != F.col("c2")) & (F.col("inside") | (F.col("node") < F.col("node2")))
    pairs = x.join(y, ["shingle", "i", "j"]).where(once & alike).select("node", "node2")
    rest = many.where(F.col("cross") > most)
    if most == sys.maxsize or rest.isEmpty():
        rest = None
    else:
        inside = rest.where("c = main")
        heads = _heads(inside, most).join(inside.select("shingle", F.col("node").alias("node2"), F.col("map").alias("y")), ["shingle", "node2"])
        star = rest.where("c <> main").withColumnRenamed("map", "x").join(heads, "shingle").where(alike)
        pairs = pairs.unionByName(star.select("node", "node2"))
        rest = rest.select("shingle", "node", "n")
    pairs = pairs.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))
    return materialize(pairs.distinct()), rest


def representatives(
    docs: DataFrame, groups: DataFrame | None = None, width: int = WIDTH, similarity: float = SIMILARITY, pairwise: int = PAIRWISE
) -> DataFrame:
    """One row of ``docs`` (doc_id, text) for each component of texts that pairs of the ``similarity`` or more join: doc_id,
    raw_sha256. It's the first in the order of doc_id (null last), then text hash; equal texts count once.

    Texts of one group of ``groups`` (raw_sha256, component), if given, are joined too. Null text is empty; texts without
    words are like no other.

    Prefixes are dealt out by shingle once; only shingles that two texts or more have go on. The first round compares all
    members of small buckets, and those of large ones with a few of their members. A pair within one component can't change
    anything, so only members of large buckets that lie in different components by then are compared in the rounds that
    follow: with a few of the largest component, until all other pairs are in proportion to the members (ALL_PAIRS each) or
    within a limit that grows; then all of them. No pair across components is left out.
    """
    text = F.coalesce("text", F.lit(""))
    prefixes = _prefixes(width, similarity, common_shingles(docs, width))
    seen = docs.select("doc_id", F.sha2(text, 256).alias("raw_sha256"), F.xxhash64(text).alias("key"), prefixes("text").alias("p"))
    seen = materialize(seen.select(F.monotonically_increasing_id().alias("node"), "doc_id", "raw_sha256", "key", "p.*"))
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "node", "key")).alias("f")
    own = seen.groupBy("raw_sha256").agg(first).select("raw_sha256", "f.no_id", "f.doc_id", "f.node", "f.key")
    own = materialize(own)
    active = own.select("node")
    repeats = 2 * own.count() < seen.count()  # so many that it pays to leave them out before prefixes are dealt out
    sets = seen.join(active, "node", "left_semi") if repeats else seen
    member = sets.select(F.explode("prefix").alias("shingle"), "node", F.col("n").cast("int").alias("n"))
    shared = materialize(member.groupBy("shingle").agg(F.count("*").alias("members")).where("members > 1").select("shingle"))
    met = materialize(member.join(shared, "shingle", "left_semi").join(active, "node", "left_semi"))
    maps, longs = seen.select("node", "n", "map"), BITS // 64
    folds = [functools.reduce(Column.bitwiseXOR, [F.col("map")[j] for j in range(i, longs, FOLDED)]) for i in range(FOLDED)]
    folded = maps.select("node", F.array(*folds).alias("map"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        """Of the texts of ``nodes``, which are found by their hashes and told apart by their digests."""
        wanted = materialize(own.join(nodes, "node").select("node", "key", "raw_sha256"))
        keys = wanted.select("key").distinct()
        found = docs.select("text", F.xxhash64(text).alias("key"))
        found = found.join(F.broadcast(keys) if wanted.count() <= BROADCAST_NODES else keys, "key", "left_semi")
        found = found.select("text", F.sha2(text, 256).alias("raw_sha256")).join(wanted.select("node", "raw_sha256"), "raw_sha256")
        return found.select("node", _sets(width)("text").alias("own")).dropDuplicates(["node"])

    labels = active.withColumn("c", F.col("node"))
    if groups is not None:
        member_of = materialize(own.join(groups.select("raw_sha256", "component").distinct(), "raw_sha256").select("node", "component"))
        least = materialize(member_of.groupBy("component").agg(F.min("node").alias("c")))
        known = member_of.join(least, "component").select("node", F.col("c").alias("low"))
        labels = labels.join(known, "node", "left").select("node", F.coalesce("low", "c").alias("c"))
    labels = materialize(labels)
    pairs, many = _candidates(met, similarity, pairwise)
    labels = _joined(labels, _alike(pairs, maps, sets_of, similarity))
    while many is not None:
        step = _across(many.join(folded, "node").join(labels, "node"), similarity, pairwise * pairwise)
        if step is None:
            break
        pairs, many = step
        labels = _joined(labels, _alike(pairs, maps, sets_of, similarity))
        pairwise *= GROWTH
    order = F.struct("no_id", "doc_id", "raw_sha256")
    return own.join(labels, "node").groupBy("c").agg(F.min(order).alias("f")).select("f.doc_id", "f.raw_sha256")
