"""Toxicity by a classifier chain.

Categories are predicted in order by linear models over word and word-prefix rates. Each later model also sees the
probabilities of the earlier categories: in training those predicted out of fold, in use those of the full models.

Labels say only whether a text is toxic, so the earlier categories are found in the data: the toxic training rows fall into
KINDS groups by the direction of their features (k-means on the sphere), and each group is a category. The label comes last.

The training rows are a bounded, stratified sample of the labelled rows; their features are chosen by statistics that
Spark counts, so only the sample's chosen features reach the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sheetlens.llm.common import gives_back, materialize

#: Labelled rows to train on, at most; a third of them toxic if there are as many.
SAMPLE_ROWS, FEATURES, MIN_DOCS, FOLDS, STEPS = 6000, 512, 5, 3, 100
PREFIXES = (4, 5, 6)
#: Groups of toxic training rows; each is a category before the label.
KINDS = 2
LABEL = "toxic"
#: F1 that a threshold may lack to the best and still count as one of the best.
NEAR_BEST = 0.002
_WORD = re.compile(r"[^\W\d_]+")
_CACHE_WORDS = 100_000


def word_features(word: str) -> list[str]:
    return [word, *[f"{word[:n]}*" for n in PREFIXES if len(word) > n]]


def rates(text: str | None) -> tuple[dict[str, int], int]:
    words = _WORD.findall((text or "").lower())
    counts: Counter[str] = Counter()
    for w, n in Counter(words).items():
        for f in word_features(w):
            counts[f] += n
    return counts, len(words)


def _value(count: np.ndarray | float, words: np.ndarray | float):
    return np.log1p(200.0 * count / np.maximum(words, 1))


@dataclass
class Chain:
    """Models of the categories in order: weights over the features, then over the earlier probabilities."""

    names: list[str]
    vocabulary: dict[str, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)
    threshold: float = 2.0
    _known: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        known, words = self._known, _WORD.findall((text or "").lower())
        counts: Counter[int] = Counter()
        for w, n in Counter(words).items():
            at = known.get(w)
            if at is None:
                if len(known) > _CACHE_WORDS:
                    known.clear()
                at = known[w] = tuple(self.vocabulary[f] for f in word_features(w) if f in self.vocabulary)
            for k in at:
                counts[k] += n
        at, n = np.fromiter(counts.keys(), np.int64), np.fromiter(counts.values(), float)
        return at, _value(n, len(words))

    def predict(self, text: str | None) -> list[float]:
        """Probabilities of the categories. A text without any known feature gives no evidence: 0 for all of them, whatever
        the models' intercepts are."""
        at, x = self.features(text)
        if not self.weights or not len(at):
            return [0.0] * len(self.names)
        out: list[float] = []
        for w in self.weights:
            z = w[at] @ x + w[-1] + (w[len(self.vocabulary) : -1] @ np.array(out) if out else 0.0)
            out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        return out


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = STEPS, l2: float = 2e-4) -> np.ndarray:
    """Logistic regression by Adam in single precision; the last weight is the intercept."""
    one = np.float32
    w, m, v = (np.zeros(x.shape[1] + 1, one) for _ in range(3))
    weight, y, columns = (weight / weight.sum()).astype(one), y.astype(one), np.ascontiguousarray(x.T)
    for t in range(1, steps + 1):
        e = weight * (_predict(x, w) - y)
        g = np.append(columns @ e + one(l2) * w[:-1], e.sum())
        m, v = one(0.9) * m + one(0.1) * g, one(0.99) * v + one(0.01) * g * g
        w -= one(0.15) * (m / one(1 - 0.9**t)) / (np.sqrt(v / one(1 - 0.99**t)) + one(1e-8))
    return w


def _predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def kinds(x: np.ndarray, number: int = KINDS, rounds: int = 20) -> np.ndarray:
    """The group of each row of ``x``, by direction, larger groups first. Each start is the row least like those before."""
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres = [unit.mean(0)]
    for _ in range(number):
        near = np.max(unit @ np.stack(centres).T, axis=1)
        centres.append(unit[int(np.argmin(near))])
    centre = np.stack(centres[1:])
    own = np.zeros(len(x), int)
    for _ in range(rounds):
        own = np.argmax(unit @ centre.T, axis=1)
        sums = np.stack([unit[own == k].sum(0) if (own == k).any() else centre[k] for k in range(number)])
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    order = np.argsort(-np.bincount(own, minlength=number), kind="stable")
    return np.argsort(order)[own]


def train(x: np.ndarray, targets: dict[str, np.ndarray], weight: np.ndarray, fold: np.ndarray, vocabulary: dict[str, int]) -> Chain:
    """A chain over the categories of ``targets`` in order. The threshold on the last one is the middle of those whose F1
    out of fold is the best or near it."""
    chain, x = Chain(list(targets), vocabulary), x.astype(np.float32)
    last, y = np.zeros(len(x), np.float32), np.zeros(len(x))
    for y in targets.values():
        last = np.zeros(len(x), np.float32)
        for k in range(FOLDS):
            if (out := fold == k).any() and (~out).any():
                last[out] = _predict(x[out], fit_linear(x[~out], y[~out], weight[~out]))
        chain.weights.append(fit_linear(x, y, weight))
        x = np.hstack([x, last[:, None].astype(np.float32)])
    scores: dict[float, float] = {}
    for t in np.arange(0.1, 0.91, 0.02):
        hit = last >= t
        tp = weight[hit & (y == 1)].sum()
        scores[float(t)] = 2 * tp / max(weight[hit].sum() + weight[y == 1].sum(), 1e-9)
    good = [t for t, f in scores.items() if f >= max(scores.values()) - NEAR_BEST]
    chain.threshold = good[len(good) // 2]
    return chain


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Chain:
    """Train on ``labels`` (doc_id, toxic 0/1) of ``docs`` (doc_id, text).

    At most ``sample_rows`` labelled documents are used, toxic ones a third of them; which ones depends on a hash of
    doc_id. Null labels are left out, a document labelled twice counts as toxic if any label says so; of several texts of
    one doc_id the last in order counts, null text is empty. ids may have any type; more columns are ignored. Without
    labels of both values, as for empty documents, the chain gives probability 0 for every text.
    """
    names = [*[f"kind{k + 1}" for k in range(KINDS)], LABEL]
    one = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    totals = {r["y"]: r["count"] for r in one.groupBy("y").count().collect()}
    if set(totals) != {0, 1}:
        return Chain(names)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = one.where("y = 1").orderBy(*order).limit(sample_rows // 3)
    some = some.unionByName(one.where("y = 0").orderBy(*order).limit(sample_rows - sample_rows // 3))

    @gives_back
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [rates(t) for t in part["text"]]
            yield part.drop(columns="text").assign(words=[n for _, n in got], terms=[list(c) for c, _ in got], counts=[list(c.values()) for c, _ in got])

    # The sampled ids are bounded by sample_rows, so they are sent to the documents.
    picked = docs.select("doc_id", "text").join(F.broadcast(materialize(some)), "doc_id")
    picked = picked.groupBy("doc_id", "y").agg(F.coalesce(F.max("text"), F.lit("")).alias("text"))
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id")), F.lit(FOLDS)).cast("int").alias("fold")
    picked = picked.select(F.xxhash64("doc_id").alias("key"), F.col("y").cast("int").alias("y"), fold, "text")
    rows = materialize(picked.mapInPandas(count, "key long, y int, fold int, words long, terms array<string>, counts array<long>"))
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if set(n) != {0, 1}:
        return Chain(names)
    n1, n0 = n[1], n[0]
    df = rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").alias("t1"), F.count("*").alias("t"))
    p = F.col("t") / F.lit(n1 + n0)
    z = (F.col("t1") / n1 - (F.col("t") - F.col("t1")) / n0) / F.sqrt(p * (1 - p) + 1e-9)
    chosen = df.where(F.col("t") >= MIN_DOCS).orderBy(F.abs(z).desc(), "term").limit(FEATURES).collect()
    vocabulary = {r["term"]: i for i, r in enumerate(chosen)}

    def sparse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            own = [[(vocabulary[t], n) for t, n in zip(ts, ns) if t in vocabulary] for ts, ns in zip(part["terms"], part["counts"])]
            yield part.drop(columns=["terms", "counts"]).assign(at=[[k for k, _ in o] for o in own], n=[[n for _, n in o] for o in own])

    schema = "key long, y int, fold int, words long, at array<int>, n array<long>"
    got = rows.mapInPandas(sparse, schema).toPandas().sort_values(["key", "words"], ignore_index=True)
    x = np.zeros((len(got), len(vocabulary)), np.float32)
    for i, (at, n, words) in enumerate(zip(got["at"], got["n"], got["words"])):
        x[i, np.asarray(at, int)] = _value(np.asarray(n, float), words)
    y = got["y"].to_numpy(float)
    weight = np.where(y == 1, totals[1] / n1, totals[0] / n0)
    kind = np.full(len(y), -1)
    kind[y == 1] = kinds(x[y == 1])
    targets = {name: (kind == k).astype(float) for k, name in enumerate(names[:-1])} | {LABEL: y}
    return train(x, targets, weight, got["fold"].to_numpy(), vocabulary)


def probabilities(chain: Chain):
    """A function from a text column to a struct of one probability per category, p_<category>, in the chain's order."""
    fields = StructType([StructField(f"p_{c}", DoubleType()) for c in chain.names])

    @F.pandas_udf(fields)
    @gives_back
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([chain.predict(t) for t in part], columns=fields.names, dtype=float)

    return predict


def is_toxic(scores: Column, chain: Chain) -> Column:
    return scores[f"p_{chain.names[-1]}"] >= F.lit(chain.threshold)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, the probability of each category, toxic (boolean).

    The whole text is read; null counts as empty. Texts without words or with unknown words only are never toxic. Every row comes back, repeated ones and those with a
    null doc_id too; an empty table gives an empty result; more columns are ignored.
    """
    out = docs.select("doc_id", probabilities(chain)("text").alias("scores"))
    return out.select("doc_id", "scores.*", is_toxic(F.col("scores"), chain).alias("toxic"))


def clean(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of ``docs`` (text) that aren't toxic, with all their columns. Null and empty texts stay; repeated rows go or
    stay together; an empty table gives an empty result."""
    return docs.where(~is_toxic(probabilities(chain)(docs["text"]), chain))
