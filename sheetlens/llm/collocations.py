"""Phrase collocations of each language by best-first branch and bound.

A phrase of up to five words with count a scores 1000 a n / (l r) at its weakest cut into parts with counts l and r, where n is
the number of words. As a is at most the count of either part, no phrase with a first or last word of count f scores over
1000 n / f. So the words with the least counts (LEAST or more) open the frontier: all phrases whose first or last word is open
are counted, which includes every prefix and every suffix of a phrase with open ends, and every phrase that is longer by a word.
These counts give exact scores and tell which phrases survive. A language is settled once its TOP-th survivor scores more than
any phrase with an end that isn't open could; else more words are opened. So the work depends on the rare words at the
frontier, not on the phrases of common words.

Passes over the texts are told by bit maps of fixed size which words are frequent and open, and which pairs and triples of
words may be frequent: counters, summed over all texts, say so for all phrases that share a counter, and a phrase is counted
only if all pairs and triples in it may be. Bits let too many phrases through, never too few; exact counts of the phrases
themselves decide.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sheetlens.llm.common import gives_back, materialize

LEAST, LONGEST, TOP = 100, 5, 2000
#: Words that a language opens in the first round, and how many times as many in each further round.
OPEN, GROWTH = 4000, 8
#: Counters, and bits of a map (2 MB), as a power of two; bits of one piece of a map.
BITS, PIECE = 24, 16
#: Words of texts that are handled together, and phrases counted before partial counts are handed on.
TOKENS, _KEPT = 100_000, 150_000
#: Counts up to this are told apart when words are opened; above, it's 64 steps for each doubling.
FINE = 1024
_STOP = b"."
_SIGNS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + _STOP * 9)
_PLACES = np.array([xxh64_intdigest(bytes([i]), 7) | 1 for i in range(LONGEST)], np.uint64)


def tokens_of(text: str) -> list[bytes]:
    """The words of ``text`` in UTF-8, with a lone stop after each piece. Words have no stops in them."""
    return text.encode().translate(_SIGNS).replace(_STOP, b" . ").split()


def _chunks(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list[bytes]]]:
    """Words of one language at a time, some TOKENS of them; the texts of a batch in any order."""
    held: dict[str, list[bytes]] = {}
    for part in parts:
        for lang, text in zip(part["lang"], part["text"]):
            if text:
                own = held.setdefault(lang, [])
                own += tokens_of(text)
                own.append(_STOP)
                if len(own) > TOKENS:
                    yield lang, held.pop(lang)
    yield from held.items()


def _rows(found: dict[tuple, int], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(list(found.keys()), columns=names).assign(n=list(found.values()))
    return out.astype({**{k: object for k in names}, "n": "int64"})


def _summed(chunks: Iterator[tuple[str, Counter]]) -> Iterator[pd.DataFrame]:
    """(lang, counts of phrases) added up to rows lang, phrase, n."""
    held: dict[str, Counter] = {}
    for lang, counts in chunks:
        held.setdefault(lang, Counter()).update(counts)
        if sum(map(len, held.values())) > _KEPT:
            yield _rows({(g, p.decode()): n for g, own in held.items() for p, n in own.items()}, ["lang", "phrase"])
            held.clear()
    yield _rows({(g, p.decode()): n for g, own in held.items() for p, n in own.items()}, ["lang", "phrase"])


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, phrase (one word) and n of ``texts`` (lang, text)."""

    @gives_back
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each():
            for lang, words in _chunks(parts):
                own = Counter(words)
                own.pop(_STOP, None)
                yield lang, own

        yield from _summed(each())

    return texts.mapInPandas(count, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _word_hash(lang: str, word: bytes) -> int:
    return xxh64_intdigest(word, xxh64_intdigest(lang, 11))


def _slot(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes ^ (hashes >> np.uint64(29))) * _PLACES[0] >> np.uint64(64 - bits)


def bit_map(slots: DataFrame, bits: int) -> np.ndarray:
    """A map of 2^``bits`` bits with those in ``slots`` (slot) set; pieces of it are made in tasks."""
    own = min(PIECE, bits)

    def piece(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(1 << own, np.uint8)
        on[part["slot"].to_numpy() & ((1 << own) - 1)] = 1
        return pd.DataFrame({"piece": [keys[0]], "bits": [np.packbits(on).tobytes()]})

    made = slots.select(F.shiftright("slot", own).alias("piece"), "slot").distinct().groupBy("piece")
    out = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (own - 3)
    for r in made.applyInPandas(piece, "piece int, bits binary").collect():  # 2^(bits - PIECE) rows of 8 KB at most
        out[r["piece"] * size : (r["piece"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def word_map(words: DataFrame, bits: int) -> np.ndarray:
    """The bit map of ``words`` (lang, phrase)."""

    def slots(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = np.array([_word_hash(g, w.encode()) for g, w in zip(part["lang"], part["phrase"])], np.uint64)
            yield pd.DataFrame({"slot": _slot(found, bits).astype(np.int32)})

    return bit_map(words.select("lang", "phrase").mapInPandas(slots, "slot int"), bits)


def _has(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    at = slots.astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


class _Windows:
    """Which runs of words in a list are to be counted."""

    def __init__(self, frequent: np.ndarray, opened: np.ndarray) -> None:
        self.frequent, self.opened, self.known = frequent, opened, {}
        self.bits = (8 * len(frequent)).bit_length() - 1

    def of(self, lang: str, words: list[bytes]) -> None:
        known = self.known.setdefault(lang, {_STOP: 0})
        for w in set(words).difference(known):
            known[w] = _word_hash(lang, w)
        self.hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(known) > _KEPT:
            self.known.clear()
        slots, stop = _slot(self.hashes, self.bits), self.hashes == 0
        frequent = _has(self.frequent, slots) & ~stop
        opened = _has(self.opened, slots) & frequent
        # wanted[m][i]: the m words from i on are frequent, and the first or the last is open.
        self.wanted, run = {}, frequent
        for m in range(2, LONGEST + 1):
            run = run[: max(len(words) - m + 1, 0)] & frequent[m - 1 :]
            self.wanted[m] = run & (opened[: len(run)] | opened[m - 1 :])

    def slots(self, m: int) -> np.ndarray:
        n = max(len(self.hashes) - m + 1, 0)
        sums = np.full(n, m, np.uint64)
        for k in range(m):
            sums += self.hashes[k : k + n] * _PLACES[k]
        return _slot(sums, self.bits)

    def parts(self, m: int) -> np.ndarray:
        """Where runs of m words start that lie in a wanted run."""
        out = np.zeros(max(len(self.hashes) - m + 1, 0), bool)
        for size in range(m, LONGEST + 1):
            own = self.wanted[size]
            for shift in range(size - m + 1):
                out[shift : shift + len(own)] |= own
        return out


def _may_be_frequent(texts: DataFrame, frequent, opened, bits: int) -> list[np.ndarray]:
    """Bit maps of the pairs and triples in wanted runs whose counter has LEAST or more."""

    @gives_back
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows, held, size = _Windows(frequent.value, opened.value), [], 0

        def rows() -> pd.DataFrame:
            slot, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.int64), np.empty(0, np.int64))
            return pd.DataFrame({"m": (slot >> bits).astype(np.int32), "slot": (slot & ((1 << bits) - 1)).astype(np.int32), "n": n})

        for lang, words in _chunks(parts):
            windows.of(lang, words)
            for m in (2, 3):
                at = windows.slots(m)[windows.parts(m)].astype(np.int64)
                held.append(at + (m << bits))
                size += len(at)
            if size > 10 * _KEPT:
                yield rows()
                held.clear()
                size = 0
        yield rows()

    sums = texts.mapInPandas(count, "m int, slot int, n long").groupBy("m", "slot").agg(F.sum("n").alias("n"))
    sums = materialize(sums.where(F.col("n") >= LEAST).select("m", "slot"))
    return [bit_map(sums.where(F.col("m") == m).select("slot"), bits) for m in (2, 3)]


def phrase_counts(texts: DataFrame, frequent, opened, pairs, triples) -> DataFrame:
    """lang, phrase, m (words) and n of the phrases of 2 words or more that have an open end and occur LEAST times."""

    @gives_back
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows = _Windows(frequent.value, opened.value)

        def each():
            for lang, words in _chunks(parts):
                windows.of(lang, words)
                two, three = _has(pairs.value, windows.slots(2)), _has(triples.value, windows.slots(3))
                own: Counter[bytes] = Counter()
                for m, good in windows.wanted.items():
                    good = good.copy()
                    for part, size in ((two, 2), (three, 3)):
                        for k in range(m - size + 1):
                            good &= part[k : k + len(good)]
                    own.update(b" ".join(words[i : i + m]) for i in np.flatnonzero(good).tolist())
                yield lang, own

        yield from _summed(each())

    sums = texts.mapInPandas(count, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    sums = sums.where(F.col("n") >= LEAST).withColumn("m", F.size(F.split("phrase", " ")))
    return sums.select("lang", "phrase", "m", "n")


def scored(counts: DataFrame, words: DataFrame, inside: DataFrame, total: DataFrame) -> DataFrame:
    """The phrases of ``counts`` (lang, phrase, m, n) that have both ends in ``inside`` (lang, phrase: the open words) and
    survive: lang, phrase, a, l, r, n, score. ``words`` (lang, phrase, n) has the frequent words, ``total`` (lang, n) the
    numbers of all words."""
    known = words.select("lang", "phrase", "n").unionByName(counts.select("lang", "phrase", "n"))
    cut = F.transform(F.sequence(F.lit(1), F.col("m") - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice("w", F.lit(1), k), " ").alias("x"), F.array_join(F.slice("w", k + 1, F.col("m")), " ").alias("y")))
    ends = counts.withColumn("w", F.split("phrase", " ")).withColumns({"x": F.get("w", F.lit(0)), "y": F.get("w", F.col("m") - 1)})
    for end in ("x", "y"):
        ends = ends.join(inside.select("lang", F.col("phrase").alias(end)), ["lang", end], "left_semi")
    cuts = ends.select("lang", "phrase", "m", F.col("n").alias("a"), F.explode(cut).alias("c"))
    cuts = cuts.select("lang", "phrase", "m", "a", "c.k", "c.x", "c.y")
    both = cuts.join(known.select("lang", F.col("phrase").alias("x"), F.col("n").alias("l")), ["lang", "x"])
    both = both.join(known.select("lang", F.col("phrase").alias("y"), F.col("n").alias("r")), ["lang", "y"])
    big = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", (F.lit(1000).cast("decimal(4,0)") * big("a")).cast("decimal(22,0)") * big("n"), big("l") * big("r"))
    both = both.join(F.broadcast(total), "lang").withColumn("score", score)  # a row for each language
    low = both.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    low = low.select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score")
    # As often as a longer one by a word: the longer one has all its occurrences.
    w = F.split("phrase", " ")
    inner = F.array(F.array_join(F.slice(w, F.lit(1), F.col("m") - 1), " "), F.array_join(F.slice(w, F.lit(2), F.col("m") - 1), " "))
    within = counts.where("m > 2").select("lang", F.explode(inner).alias("phrase"), F.col("n").alias("a")).distinct()
    return low.join(within, ["lang", "phrase", "a"], "left_anti")


def _step(n: Column) -> Column:
    return F.when(n < FINE, n).otherwise(F.lit(FINE) + F.floor(F.log2(n / F.lit(float(FINE))) * 64)).cast("int")


def frontier(words: DataFrame, total: DataFrame, wanted: int) -> DataFrame:
    """For each language of ``words`` (lang, phrase, n) the last step of counts that opens its ``wanted`` rarest words or more,
    and the most that a phrase with another end could score, null if all are open: lang, last, bound."""
    from pyspark.sql import Window

    steps = words.groupBy("lang", _step(F.col("n")).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least"))
    order = Window.partitionBy("lang").orderBy("step")  # some thousands of steps at most
    steps = steps.withColumn("before", F.sum("words").over(order) - F.col("words"))
    shut = F.min(F.when(F.col("before") >= wanted, F.col("least"))).alias("shut")
    ends = steps.groupBy("lang").agg(F.max(F.when(F.col("before") < wanted, F.col("step"))).alias("last"), shut)
    return ends.join(F.broadcast(total), "lang").select("lang", "last", F.expr("1000 * n div shut").alias("bound"))


def mine(docs: DataFrame, top: int = TOP, opens: int = OPEN, bits: int = BITS) -> DataFrame:
    """The ``top`` phrases of each language of ``docs`` (lang, text): lang, rank, phrase, a, l, r, n, score.

    Texts are cut at ``.,;:!?`` and line breaks, and the pieces at spaces and tabs; A-Z count as lower case. Phrases have 2 to
    LONGEST words and occur LEAST times or more; the score is that of the weakest cut (ties: the first), in whole numbers.
    Phrases that always stand within one longer phrase are left out. The order is by score and count, descending, then by phrase.
    A null language is ``und``; null and empty texts have no words; repeated rows count as often as they come; an empty table
    gives an empty result; more columns are ignored.
    """
    texts = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text")
    words = materialize(word_counts(texts))
    total = materialize(words.groupBy("lang").agg(F.sum("n").alias("n")))
    words = materialize(words.where(F.col("n") >= LEAST))
    context = docs.sparkSession.sparkContext
    frequent = context.broadcast(word_map(words, bits))
    done, left = None, texts
    while True:
        ends = materialize(frontier(words, total, opens))
        inside = words.join(F.broadcast(ends), "lang").where(_step(F.col("n")) <= F.col("last"))  # a row for each language
        inside = materialize(inside.select("lang", "phrase"))
        opened = context.broadcast(word_map(inside, bits))
        pairs, triples = map(context.broadcast, _may_be_frequent(left, frequent, opened, bits))
        counts = materialize(phrase_counts(left, frequent, opened, pairs, triples))
        found = materialize(scored(counts, words, inside, total))
        over = found.join(F.broadcast(ends), "lang").where(F.col("score") > F.col("bound")).groupBy("lang").count()
        settled = ends.join(over, "lang", "left").where((F.col("count") >= top) | F.col("bound").isNull()).select("lang")
        settled = materialize(settled)
        own = found.join(F.broadcast(settled), "lang", "left_semi")
        done = own if done is None else done.unionByName(own)
        words = materialize(words.join(F.broadcast(settled), "lang", "left_anti"))
        if words.isEmpty():
            break
        left = left.join(F.broadcast(settled), "lang", "left_anti")
        opens = min(opens * GROWTH, sys.maxsize // GROWTH)
    return ranked(done, top)


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language with their rank; every task passes on ``top`` rows of a language at most."""
    from pyspark.sql import Window

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
