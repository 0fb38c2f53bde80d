"""Best-fit-decreasing packing of token sequences.

The plan depends on how many pieces have each length only, so it's made on a histogram of at most ``capacity`` entries,
whatever the number of documents. Lengths are placed in decreasing order. A segment tree over the remaining capacities
finds the tightest open bin in logarithmic time; pieces of equal length that best fit would put into equal bins are placed
together. The plan is a list of runs: of the pieces of one length, numbers i to j go to consecutive bins, q to a bin.
Spark numbers the pieces of each length and every piece then finds its run by binary search.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetlens.llm.common import gives_back, materialize

CAPACITY, END_ID = 4096, 1
#: Pieces of one length that are numbered together, about; a length with more is numbered in parts, so that none is one task.
PART_PIECES = 50_000
BATCH_CHARS = 2_000_000
_CACHE_PARTS = 400_000
#: Texts of these characters only are split here as the tokenizer's own pattern splits them; others go to it whole.
_PLAIN = re.compile("[^\t-\r -~\xa1-\xff]")
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Recent:
    """A table of two generations of bounded size: what isn't met again leaves with the older one."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def missing(self, keys: Iterable[str]) -> list[str]:
        """Those of ``keys`` that are in neither generation; after this, the others are in the new one."""
        if len(self.new) > self.size:
            self.new, self.old = {}, self.new
        new, old, out = self.new, self.old, []
        for k in keys:
            if k not in new:
                if k in old:
                    new[k] = old[k]
                else:
                    out.append(k)
        return out


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, END_ID last.

    This tokenizer lower-cases, splits by a pattern and encodes each part by itself. Parts repeat, so each is encoded once
    and kept in a table of bounded size. New parts are encoded many at a time, with spaces between them: the last id of
    each part is one of those that end a word.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.parts = _Recent(_CACHE_PARTS)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _apart(self, parts: list[str]) -> list[bytes]:
        """Ids of each part."""
        out: list[bytes] = []
        for at in range(0, len(parts), 2000):
            some = parts[at : at + 2000]
            data = self.whole(" ".join(some))
            cuts = (4 * (np.flatnonzero(self.ends[np.frombuffer(data, "<u4")]) + 1)).tolist()
            fits = len(cuts) == len(some)
            out += [data[a:b] for a, b in zip([0, *cuts], cuts)] if fits else [self.whole(p) for p in some]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split: list[list[str] | None] = [
            None if _PLAIN.search(t) or any(s in t for s in self.special) else _SPLIT.findall(t.lower()) for t in texts
        ]
        new = self.parts.missing(set().union(*[s for s in split if s]))
        known, end = self.parts.new, struct.pack("<I", END_ID)
        known.update(zip(new, self._apart(new)))
        return [(self.whole(t) if s is None else b"".join(map(known.__getitem__, s))) + end for t, s in zip(texts, split)]


@functools.cache
def _encoder(path: str) -> Encoder:
    """One per worker process, kept from task to task."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Only documents over ``capacity`` ids are cut. Null text is
    empty and gives a piece of one id; repeated rows and null doc_ids give pieces of their own; no rows give none."""
    path = tokenizer or default_tokenizer()

    @gives_back
    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path)
        for part in parts:
            sizes = part["text"].str.len().cumsum() // BATCH_CHARS
            for _, some in part.groupby(sizes, sort=False):
                rows = []
                for doc_id, ids in zip(some["doc_id"], encoder.encode(some["text"].tolist())):
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        rows.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own)))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"], dtype=object)

    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = texts.mapInPandas(cut, "doc_id string, piece int, start long, length long, ids_crc32 long")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


class CapacityTree:
    """A segment tree over remaining capacities 0..size that knows which of them some open bin has."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.used = bytearray(2 * self.leaves)

    def set(self, at: int, there: bool) -> None:
        k = at + self.leaves
        self.used[k] = there
        while k > 1:
            k //= 2
            self.used[k] = self.used[2 * k] | self.used[2 * k + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of an open bin that is at least ``least``."""
        k = least + self.leaves
        if self.used[k]:
            return least
        while k > 1:
            if k % 2 == 0 and self.used[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.used[2 * k] else 2 * k + 1
                return k - self.leaves
            k //= 2
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing for ``histogram`` (length to number of pieces).

    Runs (length, first, number, bin, per_bin, offset): pieces ``first`` to ``first + number - 1`` of this length go into
    bins ``bin``, ``bin + 1``, ... , ``per_bin`` into each from ``offset`` on.

    Their number doesn't grow with that of the pieces. A length opens one group of bins and splits at most one in three; a
    run adds a new length to a group, and a bin has room for at most d different lengths, d (d + 1) / 2 <= capacity. So
    there are at most d * (3 * lengths + 1) runs: 1.1 million (53 MB) for 4096 lengths, if all that happened at once.
    """
    tree, open_bins, runs, bins = CapacityTree(capacity), defaultdict(deque), [], 0
    for length in sorted(histogram, reverse=True):
        first, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, start, count = capacity, bins, -(-left // (capacity // length))
                bins += count
            else:
                start, count = open_bins[room].popleft()
            fit = room // length
            full = min(count, left // fit)
            used = []
            if full:
                runs.append((length, first, full * fit, start, fit, capacity - room))
                used.append((start, full, room - fit * length))
                first, left = first + full * fit, left - full * fit
            rest = count - full
            if rest and left:  # fewer pieces are left than one more bin takes
                runs.append((length, first, left, start + full, fit, capacity - room))
                used.append((start + full, 1, room - left * length))
                first, left, rest = first + left, 0, rest - 1
            if rest:
                open_bins[room].appendleft((start + count - rest, rest))
            for at, n, now in used:
                if now:
                    open_bins[now].append((at, n))
                    tree.set(now, True)
            tree.set(room, bool(open_bins[room]))
    return runs


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, part_pieces: int = PART_PIECES) -> DataFrame:
    """Pack all ``docs`` (doc_id, text) into sequences of at most ``capacity`` ids.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null text is empty and packs as its
    end id alone. Repeated rows and null doc_ids are packed as often as they come; more columns are ignored. An empty
    table gives an empty result.
    """
    cut = materialize(pieces(docs, tokenizer, capacity))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    runs = np.array(sorted(plan(histogram, capacity)), np.int64).reshape(-1, 6)
    many = {n: -(-c // part_pieces) for n, c in histogram.items() if c > part_pieces}
    parts = F.coalesce(F.create_map(*[F.lit(x) for kv in many.items() for x in kv])[F.col("length")], F.lit(1)) if many else F.lit(1)
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), parts)
    counts = materialize(cut.groupBy("length", salt.alias("salt")).agg(F.count("*").alias("n")))
    before = F.coalesce(
        F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    starts = materialize(counts.select("length", "salt", before.alias("before")))
    # A part of one length is ordered by what tells rows apart; rows equal in all of it may change places.
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    numbered = cut.withColumn("salt", salt).withColumn("rank", number - 1)
    # The window has dealt the pieces by these keys already, so only the starts move.
    numbered = numbered.join(starts, ["length", "salt"])
    keys = runs[:, 0] << 44 | runs[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        i, n = rank.to_numpy(np.int64), length.to_numpy(np.int64)
        at = runs[np.searchsorted(keys, n << 44 | i, side="right") - 1] if len(runs) else np.zeros((len(i), 6), np.int64)
        k = i - at[:, 1]
        return pd.DataFrame({"sequence_id": at[:, 3] + k // np.maximum(at[:, 4], 1), "offset": at[:, 5] + k % np.maximum(at[:, 4], 1) * n})

    placed = numbered.withColumn("at", place("length", (F.col("rank") + F.col("before")).cast("long")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
