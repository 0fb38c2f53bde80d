"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Each word has a fixed sparse index vector of a few +1 and -1, made from the word itself. A word's context vector is the
sum of the index vectors of its neighbours over the whole corpus. Context vectors are kept in a count sketch: each word
adds its sums, with a sign of its own, to one row of each of TABLES tables, and is read back as the median of these rows.
So every word of every document counts. The tables get more rows with the corpus, up to a stated memory, so that words in
tens of occurrences come out nearly exactly and rarer ones with the noise of those that share their rows; the median rules
out most of what common words leave there. A document is the mean and the spread of its words' index and context vectors. The network is trained on
a bounded sample of labelled rows and its probabilities are calibrated by a temperature on rows that it wasn't trained on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from sheetlens.llm.common import gives_back, materialize

#: The sketch has TABLES tables; vectors have DIM entries, NONZERO of them set; WINDOW neighbours on each side.
TABLES, DIM, NONZERO, WINDOW = 3, 32, 6, 2
#: Rows of a table: the power of two next to a row for each so many bytes of text, within these bounds; at the upper one the
#: three tables take 13 MB in a task and 25 MB as sums.
ROW_BYTES, LEAST_ROWS, MOST_ROWS = 512, 1024, 32_768
#: Parts of the sketch that are summed apart, and groups of tasks that are summed first.
BLOCKS, GROUPS = 24, 8
#: Labelled rows to train on, at most, half of either kind if there are as many.
SAMPLE_ROWS, HIDDEN, EPOCHS = 9000, 48, 60
FOLDS, HELD_OUT = 3, 1
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_CHUNK = 60_000
_CACHE_WORDS = 200_000


class Words:
    """Numbers for words as they come; index vectors, and vectors by a sketch or room for context sums, once ``settle`` is
    called. ``full`` tells when to begin anew."""

    def __init__(self, sketch: Sketch | None = None):
        self.known: dict[str, int] = {}
        self.pending: list[str] = []
        self.sketch = sketch
        self.digests = np.zeros((0, 2), np.uint64)
        self.index = np.zeros((0, DIM), np.int8)
        self.vectors = np.zeros((0, 2 * DIM), np.float32)
        self.sums = np.zeros((0, DIM), np.int32)

    def ids(self, text: str | None) -> np.ndarray:
        """Numbers of the tokens of ``text``: runs of letters and digits as written, runs of signs."""
        words, known = _TOKEN.findall(text or ""), self.known
        new = [w for w in set(words) if w not in known]
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.pending += new
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def full(self) -> bool:
        return len(self.known) > _CACHE_WORDS

    def settle(self) -> None:
        if not self.pending:
            return
        data, self.pending = b"".join([xxh3_128_digest(w.encode()) for w in self.pending]), []
        new = np.frombuffer(data, ">u8").astype(np.uint64).reshape(-1, 2)
        index, at = index_vectors(new), len(self.known) - len(new)
        self.digests, self.index = _put(self.digests, at, new), _put(self.index, at, index)
        if self.sketch:
            self.vectors = _put(self.vectors, at, self.sketch.vectors(index, new))
        else:
            self.sums = _put(self.sums, at, np.zeros((len(new), DIM), np.int32))


def _put(a: np.ndarray, at: int, rows: np.ndarray) -> np.ndarray:
    """``a`` with ``rows`` from ``at`` on, longer by half if there is no room."""
    if at + len(rows) > len(a):
        a = np.concatenate([a, np.zeros((max(len(a) // 2, at + len(rows) - len(a)), a.shape[1]), a.dtype)])
    a[at : at + len(rows)] = rows
    return a


def index_vectors(digests: np.ndarray) -> np.ndarray:
    """NONZERO places of DIM, as a word's digest gives them, half of them +1 and half -1; places that meet add up."""
    out = np.zeros((len(digests), DIM), np.int8)
    rows, h = np.arange(len(digests)), digests[:, 0] ^ (digests[:, 1] >> np.uint64(5))
    for k in range(NONZERO):
        out[rows, ((h >> np.uint64(10 * k)) % np.uint64(DIM)).astype(np.int64)] += (1, -1)[k % 2]
    return out


def _rows(digests: np.ndarray, k: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of table k of ``rows``, numbered through all tables, and signs."""
    h = digests[:, 0] + np.uint64(k) * digests[:, 1]
    return ((h >> np.uint64(8)) % np.uint64(rows)).astype(np.int64) + k * rows, np.where(h >> np.uint64(63), 1, -1)


@dataclass
class Sketch:
    """Context vectors of all words: TABLES tables, one behind the other, with rows of DIM numbers."""

    sums: np.ndarray

    def vectors(self, index: np.ndarray, digests: np.ndarray) -> np.ndarray:
        """Index vectors beside context vectors, both of length one (zero where there is none)."""
        found = []
        for k in range(TABLES):
            at, sign = _rows(digests, k, len(self.sums) // TABLES)
            found.append(self.sums[at] * sign[:, None])
        both = np.concatenate([index, _median(found)], axis=1).astype(np.float32).reshape(-1, 2, DIM)
        return (both / np.maximum(np.linalg.norm(both, axis=2, keepdims=True), 1e-9)).reshape(-1, 2 * DIM)


def _median(parts: list[np.ndarray]) -> np.ndarray:
    if len(parts) == 3:
        a, b, c = parts
        return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))
    return np.median(np.stack(parts), axis=0)


def _contexts(ids: np.ndarray, doc: np.ndarray, words: Words) -> None:
    """Add to each word's sums the index vectors of the neighbours, within one document, of its tokens."""
    own = words.index[ids].astype(np.int16)
    around = np.zeros_like(own)
    for k in range(1, WINDOW + 1):
        same = (doc[k:] == doc[:-k])[:, None]
        around[k:] += own[:-k] * same
        around[:-k] += own[k:] * same
    order = np.argsort(ids, kind="stable")
    at = ids[order]
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    words.sums[at[starts]] += np.add.reduceat(around[order], starts, axis=0, dtype=np.int32)


def _tabled(words: Words, total: np.ndarray) -> None:
    """Add all words' sums to the tables of ``total``."""
    n = len(words.known)
    for k in range(TABLES):
        rows, sign = _rows(words.digests[:n], k, len(total) // TABLES)
        order = np.argsort(rows, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(rows[order]) != 0])
        total[rows[order][first]] += np.add.reduceat((words.sums[:n] * sign[:, None])[order], first, axis=0, dtype=np.int32)


def _emit(total: np.ndarray, group: int) -> Iterator[pd.DataFrame]:
    parts = np.array_split(total, BLOCKS)
    rows = [(group, b, part.tobytes()) for b, part in enumerate(parts) if part.any()]
    if rows:
        yield pd.DataFrame(rows, columns=["part", "block", "data"])


def context_sketch(docs: DataFrame) -> Sketch:
    """Context vectors of all words over all of ``docs`` (text).

    A task sends its sums in BLOCKS blocks. They are added up per block and group of tasks first, then per block, row after
    row in constant memory, so that no task reads what all tasks of a large input send. Null and empty texts add nothing;
    repeated rows count as often as they come; an empty table gives a sketch of zeros.
    """
    size_ = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = min(MOST_ROWS, max(LEAST_ROWS, 1 << (size_ // ROW_BYTES).bit_length()))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, words = np.zeros((TABLES * rows, DIM), np.int32), Words()
        held: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            words.settle()
            _contexts(np.concatenate(held), np.repeat(np.arange(len(held)), list(map(len, held))), words)

        for part in parts:
            for text in part["text"]:
                if words.full():
                    if size:
                        flush()
                        held, size = [], 0
                    _tabled(words, total)
                    words = Words()
                ids = words.ids(text)
                for at in range(0, len(ids), _CHUNK):
                    held.append(ids[at : at + _CHUNK])
                    size += len(held[-1])
                    if size >= _CHUNK:
                        flush()
                        held, size = [], 0
        if size:
            flush()
        if words.known:
            _tabled(words, total)
        yield from _emit(total, TaskContext.get().partitionId() % GROUPS)

    def adding(kind: type):
        def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for part in parts:
                for group, block, data in zip(part["part"], part["block"], part["data"]):
                    found = np.frombuffer(data, kind)
                    if (group, block) in sums:
                        sums[group, block] += found
                    else:
                        sums[group, block] = found.astype(np.int64)
            for (group, block), data in sums.items():
                yield pd.DataFrame([(group, block, data.tobytes())], columns=["part", "block", "data"])

        return gives_back(add)

    schema = "part int, block int, data binary"
    parts = docs.select("text").mapInPandas(gives_back(count), schema).repartition("part", "block").mapInPandas(adding(np.int32), schema)
    parts = parts.withColumn("part", F.lit(0)).repartition(BLOCKS, "block").mapInPandas(adding(np.int64), schema)
    out = np.array_split(np.zeros((TABLES * rows, DIM), np.float32), BLOCKS)
    for r in parts.collect():  # BLOCKS rows
        out[r["block"]][:] = np.frombuffer(r["data"], np.int64).reshape(-1, DIM)
    return Sketch(np.concatenate(out))


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the words' vectors, the mean's length, the share of different words and the log of their number."""
    if not len(ids):
        return np.zeros(2 * vectors.shape[1] + 4, np.float32)
    words, counts = np.unique(ids, return_counts=True)
    share = (counts / len(ids)).astype(np.float32)
    own = vectors[words]
    mean = share @ own
    spread = np.sqrt(np.maximum(share @ (own * own) - mean * mean, 0))
    more = [np.linalg.norm(mean), len(words) / len(ids), np.log(share.max()), np.log1p(len(ids))]
    return np.concatenate([mean, spread, np.array(more, np.float32)])


@dataclass
class Network:
    """Two layers over standardised inputs; ``temperature`` divides the last layer's output."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.shift) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, calibration: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS) -> Network:
    """Adam on the rows outside ``calibration``; then the temperature with the least log loss on the rows inside."""
    rng = np.random.default_rng(3)
    x, y = x.astype(np.float32), y.astype(np.float32)
    fit = np.flatnonzero(~calibration)
    shift, scale = x[fit].mean(0), x[fit].std(0) + 1e-3
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), np.zeros(1)]
    p = [a.astype(np.float32) for a in p]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z = (x - shift) / scale
    for epoch in range(epochs):
        order = rng.permutation(fit)
        for at in range(0, len(order), 128):
            k = order[at : at + 128]
            h = np.tanh(z[k] @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -30, 30))) - y[k]) / len(k)
            d = e[:, None] * p[2] * (1 - h * h)
            t += 1
            for i, g in enumerate((z[k].T @ d + 1e-4 * p[0], d.sum(0), h.T @ e + 1e-4 * p[2], np.array([e.sum()]))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                rate = 3e-3 * (1 - epoch / epochs) + 1e-4
                p[i] -= (rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    net = Network(shift, scale, p[0], p[1], p[2], float(p[3][0]))
    if calibration.any():
        logit, own = net.logits(x[calibration]), y[calibration]
        loss = lambda t: np.logaddexp(0, np.where(own == 1, -logit, logit) / t).mean()
        net.temperature = float(min(np.geomspace(0.3, 10, 80), key=loss))
    return net


def _pooled_texts(texts: pd.Series, words: Words) -> list[np.ndarray]:
    """The pooled vectors of ``texts``; new words get their vectors together, some texts at a time."""
    out: list[np.ndarray] = []
    for at in range(0, len(texts), 500):
        found = [words.ids(t) for t in texts.iloc[at : at + 500]]
        words.settle()
        out += [pooled(ids, words.vectors) for ids in found]
    return out


def _pooled_rows(df: DataFrame, sketch: Sketch, schema: str) -> DataFrame:
    @gives_back
    def pool(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(sketch)
        for part in parts:
            x = [v.tobytes() for v in _pooled_texts(part["text"], words)]
            words = Words(sketch) if words.full() else words
            yield part.drop(columns="text").assign(x=pd.Series(x, index=part.index, dtype=object))

    return df.mapInPandas(pool, schema)


def fold(docs: DataFrame):
    return F.crc32(docs["doc_id"].cast("string")) % F.lit(FOLDS)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Sketch, Network | None]:
    """Context vectors over all of ``docs`` and a network trained on ``labels`` (doc_id, quality 0/1) outside the held-out fold.

    At most ``sample_rows`` labelled documents are used, chosen by a hash of doc_id, a fifth of them for the temperature.
    Null labels are left out; of several labels the largest counts, of several texts of one doc_id the last in order. ids
    may have any type; more columns are ignored. Without labels of both kinds, as for empty documents, there is no network.
    """
    sketch = context_sketch(docs)
    one = labels.where("quality is not null and doc_id is not null").where(fold(labels) != HELD_OUT)
    one = one.groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    half = sample_rows // 2
    some = one.where("y = 1").orderBy(*order).limit(half).unionByName(one.where("y = 0").orderBy(*order).limit(half))
    # The sampled ids are bounded by sample_rows, so they are sent to the documents.
    picked = docs.select("doc_id", "text").join(F.broadcast(materialize(some)), "doc_id")
    picked = picked.groupBy("doc_id", "y").agg(F.coalesce(F.max("text"), F.lit("")).alias("text"))
    apart = (F.pmod(F.xxhash64(F.lit("temperature"), F.col("doc_id")), F.lit(5)) == 0).alias("apart")
    picked = picked.select(F.xxhash64("doc_id").alias("key"), "y", apart, "text")
    schema = "key long, y int, apart boolean, x binary"
    rows = _pooled_rows(picked, sketch, schema).toPandas().sort_values(["key", "x"], ignore_index=True)
    if rows["y"].nunique() < 2:
        return sketch, None
    x = np.stack([np.frombuffer(b, np.float32) for b in rows["x"]])
    y = rows["y"].to_numpy(float)
    counts = {r["y"]: r["count"] for r in one.groupBy("y").count().collect()}
    net = train(x, y, rows["apart"].to_numpy(bool))
    # The sample has as many rows of either kind as it can; the corpus has not.
    net.b2 += net.temperature * float(np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return sketch, net


def score(docs: DataFrame, sketch: Sketch, net: Network | None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score (0 to 1), predicted (1 if score is at least 0.5).

    The whole text is read; null is empty and gets a score like any other. Without a network the score is 0.5. Repeated
    rows come out as often as they come in; more columns are ignored; an empty table gives an empty result.
    """

    @F.pandas_udf("double")
    @gives_back
    def probability(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Words(sketch)
        for part in parts:
            if net is None or not len(part):
                yield pd.Series(np.full(len(part), 0.5))
            else:
                yield pd.Series(net.probabilities(np.stack(_pooled_texts(part, words))).astype(float))
                words = Words(sketch) if words.full() else words

    out = docs.select("doc_id", (F.coalesce(fold(docs), F.lit(-1)) == HELD_OUT).alias("held_out"), probability("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
