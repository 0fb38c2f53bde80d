"""Spelling variants: words that differ by a single edit, and the form that each belongs to.

Words are compared in tiles: the code points of a bucket's words stand in a padded matrix, aligned at the end, and whole
blocks of pairs are compared at once. Two words differ by one edit exactly when the lengths of their common prefix and their
common suffix together reach the longer length less one.

Which pairs share a bucket follows from where the edit lies. The longer length L is cut into PARTS parts; all other parts of
both words are the same, aligned at the start before the edit and at the end behind it. So a word goes to a bucket for each
part and each longer length it can have a partner for (its own, or one more), keyed by what it has outside that part. A pair
counts in the part in which its edit lies, once. Crowded buckets are dealt out as pairs of blocks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlens.llm.common import gives_back, materialize

LETTERS, OCCURRENCES, MODULUS, RATIO = 7, 2, 31, 10
PARTS = 3
#: Members of a block; a bucket of more is dealt out as pairs of blocks.
BLOCK = 512
#: Pairs compared at once, and words counted before partial counts are handed on.
PAIRS, _KEPT = 200_000, 200_000
_RUN = re.compile("[a-zÀ-ÿ]+")


def _altered(word: str, doc: int) -> str:
    """``word`` with the code point deleted that the checksum names, if it does; ``doc`` is the checksum of what is before it."""
    h = zlib.crc32(word.encode(), doc)
    return word if h % MODULUS else (word[: (k := h % len(word))] + word[k + 1 :])


def counted(docs: DataFrame) -> DataFrame:
    """word and n of ``docs`` (doc_id, text): partial counts of tasks, then sums. Null text has no words, a null doc_id counts
    as an empty text."""

    @gives_back
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[str] = Counter()
        for part in parts:
            for doc_id, text in zip(part["id"], part["text"]):
                if not text:
                    continue
                doc = zlib.crc32(f"{doc_id}:".encode())
                for word, n in Counter(_RUN.findall(text.encode().lower().decode())).items():
                    if len(word) >= LETTERS and len(word := _altered(word, doc)) >= LETTERS:
                        found[word] += n
                if len(found) > _KEPT:
                    yield pd.DataFrame({"word": list(found.keys()), "n": list(found.values())})
                    found.clear()
        yield pd.DataFrame({"word": list(found.keys()), "n": list(found.values())}).astype({"word": object, "n": "int64"})

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    return rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def bounds(length: Column, part: int) -> Column:
    """Where ``part`` of a word of ``length`` code points starts; the last part ends where the one after it would start."""
    return F.floor(length * part / PARTS).cast("int")


def buckets(words: DataFrame) -> DataFrame:
    """``words`` (id, word) to id, word, kind (longer length and part) and key (what is outside the part, hashed)."""
    size, out = F.length("word"), []
    for longer in (size, size + 1):
        for q in range(PARTS):
            head = F.substring("word", F.lit(1), bounds(longer, q))
            tail = longer - bounds(longer, q + 1)
            rest = F.when(tail > 0, F.expr("word").substr(size - tail + 1, tail)).otherwise(F.lit(""))
            kind = (longer * PARTS + q).cast("int")
            out.append(F.struct(kind.alias("kind"), F.xxhash64(kind, head, rest).alias("key")))
    return words.select("id", "word", F.explode(F.array(*out)).alias("b")).select("id", "word", "b.kind", "b.key")


def tiles(words: list[str], starts: np.ndarray, sizes: np.ndarray, left: np.ndarray, longer: np.ndarray, part: np.ndarray, pairs: int = PAIRS):
    """Pairs (i, j) of places in ``words`` that differ by one edit, which lies in the group's part.

    Group g has the words from starts[g] on, sizes[g] of them; its first left[g] are compared with the others, or all with
    each other where left[g] is 0. Groups are cut into slices of about ``pairs`` pairs.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    width = int(lengths.max())
    ends = np.frombuffer("".join(w.rjust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(-1, width)
    ends = np.ascontiguousarray(ends[:, ::-1])  # aligned at the end: column c is the c-th code point from behind
    heads = np.frombuffer("".join(w.ljust(width, "\1") for w in words).encode("utf-32-le"), np.uint32).reshape(-1, width)
    # Row r of a group meets the rows behind it in the group, or those of the other block.
    rows = np.concatenate([np.arange(s, s + (k or n)) for s, n, k in zip(starts, sizes, left)]) if len(starts) else np.empty(0, int)
    group = np.repeat(np.arange(len(starts)), np.where(left > 0, left, sizes))
    first = np.where(left[group] > 0, starts[group] + left[group], rows + 1)
    many = starts[group] + sizes[group] - first
    cuts = np.searchsorted(np.cumsum(many), np.arange(pairs, many.sum() + pairs, pairs), side="right")
    found, at = [], 0
    for cut in [*np.maximum.accumulate(cuts), len(rows)]:
        cut = min(max(int(cut), at + 1), len(rows))
        if at >= len(rows):
            break
        n = many[at:cut]
        i, g = np.repeat(rows[at:cut], n), np.repeat(group[at:cut], n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:cut], n)
        at = cut
        a, b, top = lengths[i], lengths[j], longer[g]
        fit = np.maximum(a, b) == top
        i, j, g, top = i[fit], j[fit], g[fit], top[fit]
        suffix = _run(ends, i, j, width)
        edit = top - 1 - suffix  # the place of the edit in the longer word, if there is one only
        lo, hi = top * part[g] // PARTS, top * (part[g] + 1) // PARTS
        fit = (edit >= lo) & (edit < hi)
        i, j, edit = i[fit], j[fit], edit[fit]
        fit = _run(heads, i, j, width) >= edit
        found.append((i[fit], j[fit]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int), np.empty(0, int))


def _run(matrix: np.ndarray, i: np.ndarray, j: np.ndarray, width: int) -> np.ndarray:
    """How many columns of rows ``i`` and ``j`` are the same from the first on. Padding of either side is unlike any letter
    and, as words differ, is reached by no run that counts."""
    differ = matrix[i] != matrix[j]
    return np.where(differ.any(1), differ.argmax(1), width)


def near_counts(members: DataFrame) -> DataFrame:
    """``members`` (id, word, kind, key, i, j: a pair of blocks, side: 1 in its second one) to id, n_near, best (the least id of
    those near)."""

    @gives_back
    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sizes, left = part["ids"].map(len).to_numpy(), part["m"].to_numpy(np.int64)
            ids = np.concatenate(part["ids"].tolist())
            words = [w for ws in part["words"] for w in ws]
            kind = part["kind"].to_numpy(np.int64)
            i, j = tiles(words, np.cumsum(sizes) - sizes, sizes, left, kind // PARTS, kind % PARTS, PAIRS)
            x, y = np.concatenate([ids[i], ids[j]]), np.concatenate([ids[j], ids[i]])
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            own, at, n = np.unique(x, return_index=True, return_counts=True)
            yield pd.DataFrame({"id": own, "n_near": n, "best": y[at]})

    # Words of the first block of a pair come first; m is their number where the blocks differ.
    group = members.groupBy("kind", "key", "i", "j").agg(
        F.sort_array(F.collect_list(F.struct((F.col("side") == 1).alias("second"), "id", "word"))).alias("x"),
        F.count_if((F.col("side") == 0) & (F.col("i") != F.col("j"))).alias("m"),
        F.count_if(F.col("side") == 1).alias("others"),
    )
    group = group.where((F.size("x") > 1) & ((F.col("i") == F.col("j")) | ((F.col("m") > 0) & (F.col("others") > 0))))
    group = group.select("kind", "m", F.col("x.id").alias("ids"), F.col("x.word").alias("words"))
    pairs = group.mapInPandas(compare, "id long, n_near long, best long")
    return pairs.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``words`` (id, word; both unique) to id, n_near and best for words that have one at a single edit's distance."""
    keyed = materialize(buckets(words))
    sizes = materialize(keyed.groupBy("kind", "key").agg(F.count("*").alias("members")).where("members > 1"))
    member = keyed.join(sizes, ["kind", "key"])
    g = F.ceil(F.col("members") / block).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("g")).cast("int")
    # A member of block b of g meets those of every other block, as the first or the second of a pair.
    dealt = member.withColumn("g", g).withColumn("b", own).select(
        "id", "word", "kind", "key", "b", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("o")
    )
    dealt = dealt.select(
        "id", "word", "kind", "key", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), (F.col("b") > F.col("o")).cast("int").alias("side")
    )
    return near_counts(dealt)


def roots(forms: DataFrame) -> DataFrame:
    """``forms`` (id, form) to id, root: where following the forms ends. A form is ten times as frequent as what it's the form
    of, so chains are short; every round doubles the steps."""
    top = materialize(forms.select("id", F.col("form").alias("root")))
    while True:
        step = top.join(top.select(F.col("id").alias("root"), F.col("root").alias("next")), "root", "left")
        step = materialize(step.select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return step.select("id", "root")
        top = step.select("id", "root")


def variants(docs: DataFrame) -> DataFrame:
    """The words of ``docs`` (doc_id, text): word, n, n_near (words at one edit), form, form_n, root.

    Words are runs of Latin letters, A-Z in lower case, of LETTERS code points and OCCURRENCES or more in all whole texts;
    where the checksum of doc_id and run divides by MODULUS, a code point is deleted first. A word's form is the most frequent
    word near it (ties: the smallest), if that has RATIO times its occurrences or more, else null; root is where following
    the forms ends, the word itself if it has none. Null and empty texts have no words; repeated rows count as often as they
    come; an empty table gives an empty result; more columns are ignored.
    """
    words = counted(docs).where(F.col("n") >= OCCURRENCES)
    # Numbered by frequency, then by code points: the least number of those near is the most frequent word.
    words = materialize(words.orderBy(F.desc("n"), "word").withColumn("id", F.monotonically_increasing_id()))
    near = materialize(near_words(words.select("id", "word")))
    other = words.select(F.col("id").alias("best"), F.col("word").alias("best_word"), F.col("n").alias("best_n"))
    own = words.join(near, "id", "left").join(other, "best", "left")
    is_form = F.col("best_n") >= RATIO * F.col("n")
    own = materialize(own.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best")).alias("form_id"), F.when(is_form, F.col("best_word")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    top = roots(own.where("form_id is not null").select("id", F.col("form_id").alias("form")))
    named = top.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    out = own.join(named, "id", "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root_word", "word").alias("root"))
