"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed per cell (source, language, topic). Raking scales the cells' weights to one marginal after the
other until all of them meet their targets; a cell never gives more tokens than it has, and what it can't give is asked of
the others. A document is then sampled with the probability of its cell: the share of the cell's tokens that is wanted.

Topics come from the corpus: of the words that at most COMMON of all documents hold, the TOPICS that most documents hold. A
document's topic is the rarest of them that it holds.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sheetlens.llm.common import free_names, materialize

MARGINS = ("source", "lang", "topic")
#: A number a is a target share in proportion to tokens^a; a mapping gives shares by name, scaled over the names that occur.
TARGETS: dict[str, float | dict[str, float]] = {"source": 0.5, "lang": 0.7, "topic": 0.8}
BUDGET, SEED, TOLERANCE, MAX_ROUNDS = 0.5, 11, 1e-4, 3000
#: Rounds that must bring the shares nearer by GAIN together.
PATIENCE, GAIN = 20, 1e-6
TOPICS, COMMON, TOPIC_LETTERS, OTHER = 32, 0.05, 5, "other"
#: Cells up to this number are sent to the documents (some 100 bytes each); more are joined by a shuffle.
BROADCAST_CELLS = 20_000
#: Cells up to this number are raked on the driver (some 20 MB of rows).
DRIVER_CELLS = 20_000


def _words(text: Column) -> Column:
    return F.array_distinct(F.split(F.coalesce(text, F.lit("")), " "))


def topic_words(docs: DataFrame, topics: int = TOPICS, common: float = COMMON) -> list[str]:
    """The ``topics`` words that most of ``docs`` (text) hold, of those that at most ``common`` of them hold; rarest first.

    Words stand between spaces and have TOPIC_LETTERS small letters or more. All documents are counted, in partial sums.
    """
    total = docs.count()
    word = docs.select(F.explode(_words(F.col("text"))).alias("word")).where(F.length("word") >= TOPIC_LETTERS)
    per = word.groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") <= common * total) & F.col("word").rlike(r"^\p{Ll}+$"))
    found = per.orderBy(F.desc("n"), "word").limit(topics).collect()  # ``topics`` rows
    return [r["word"] for r in sorted(found, key=lambda r: (r["n"], r["word"]))]


def topic_of(text: Column, words: list[str]) -> Column:
    if not words:
        return F.lit(OTHER)
    return F.coalesce(F.get(F.array_intersect(F.lit(words), _words(text)), F.lit(0)), F.lit(OTHER))


def tokens_of(text: Column) -> Column:
    """Estimated tokens: a quarter of the UTF-8 bytes, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def _named(value: str | None) -> str:
    """A margin's value so that null is one of its own, unlike any text."""
    return "" if value is None else "=" + value


def _shares(sums: list[tuple[str, float]], target: float | dict[str, float]) -> dict[str, float]:
    """Target shares by value of a margin, over the values that occur, from their tokens; values that a mapping lacks keep
    their share of tokens."""
    total = sum(t for _, t in sums)
    if isinstance(target, dict):
        named = {_named(k): v for k, v in target.items()}
        raw = {v: named.get(v, t / total) for v, t in sums}
    else:
        raw = {v: t ** float(target) for v, t in sums}
    whole = sum(raw.values())
    return {v: r / whole for v, r in raw.items()}


class _Stop:
    """When rounds end: all shares are within ``tolerance`` of their targets, or the best gap of the last ``PATIENCE`` rounds
    is no nearer than the best before by ``GAIN``."""

    def __init__(self, tolerance: float) -> None:
        self.tolerance, self.gaps = tolerance, []

    def __call__(self, gap: float) -> bool:
        self.gaps.append(gap)
        if gap <= self.tolerance:
            return True
        return len(self.gaps) > PATIENCE and min(self.gaps[:-PATIENCE]) - min(self.gaps[-PATIENCE:]) < GAIN


def rake(
    cells: DataFrame,
    targets: dict[str, float | dict[str, float]],
    budget: float = BUDGET,
    tolerance: float = TOLERANCE,
    max_rounds: int = MAX_ROUNDS,
) -> tuple[DataFrame, float]:
    """``cells`` (margins and tokens) with ``weight``, the tokens that each is expected to give, and the largest difference
    that is left between a marginal share of these weights and its target.

    A cell can't give more tokens than it has. Each step multiplies the free weights of a margin's value so that, together
    with the cells that give all they have, they meet the target; a cell is full while its free weight is at least its
    tokens. The total is ``budget`` (a share of all tokens). Rounds end by one rule (``_Stop``), or after ``max_rounds``;
    the difference tells which targets no weights meet, as through empty or full cells.

    Up to DRIVER_CELLS cells are raked as arrays on the driver; more of them are raked by the same steps as joins of tables,
    whose sums are partial per task.
    """
    if cells.count() <= DRIVER_CELLS:
        return _rake_arrays(cells, targets, budget, tolerance, max_rounds)
    return _rake_tables(cells, targets, budget, tolerance, max_rounds)


def _rake_arrays(cells, targets, budget, tolerance, max_rounds) -> tuple[DataFrame, float]:
    rows = cells.collect()  # DRIVER_CELLS rows at most
    tokens = np.array([r["tokens"] for r in rows], float)
    wanted, free, margins = budget * tokens.sum(), tokens * float(budget), []
    for m, target in targets.items():
        values = {v: k for k, v in enumerate(sorted({r[m] for r in rows}))}
        at = np.array([values[r[m]] for r in rows])
        share = _shares(list(zip(values, np.bincount(at, tokens, len(values)))), target)
        margins.append((at, np.array([share[v] for v in values])))

    def sums(at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(at, x, n)

    stop, gap = _Stop(tolerance), 0.0
    for _ in range(max_rounds):
        for at, share in margins:
            n, full = len(share), free >= tokens
            held, loose = sums(at, np.where(full, tokens, 0.0), n), sums(at, np.where(full, 0.0, free), n)
            goal, now = share * wanted, held + loose
            # Full cells give no more: the loose ones fill the target, or all shrink where it is below what the full ones give.
            fill = (loose > 0) & (goal > held)
            step = np.where(fill, (goal - held) / np.where(fill, loose, 1.0), np.minimum(goal / np.where(now > 0, now, 1.0), 1.0))
            free = free * np.where(fill | (now > 0), step, 1.0)[at]
        weight = np.minimum(free, tokens)
        gap = max(float(np.abs(sums(at, weight, len(share)) / wanted - share).max()) for at, share in margins)
        if stop(gap):
            break
    schema = StructType([*cells.schema, StructField("weight", DoubleType())])
    out = [(*r, float(w)) for r, w in zip(rows, np.minimum(free, tokens))]
    return cells.sparkSession.createDataFrame(out, schema), gap


def _rake_tables(cells, targets, budget, tolerance, max_rounds) -> tuple[DataFrame, float]:
    total = float(cells.agg(F.sum("tokens")).first()[0])
    wanted, shares = budget * total, {}
    for m, target in targets.items():
        own = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("t"))
        if isinstance(target, dict):
            named = F.create_map(*[F.lit(x) for k, v in target.items() for x in (_named(k), float(v))]) if target else None
            kept = F.col("t") / F.lit(total)
            raw = kept if named is None else F.coalesce(named[F.col(m)], kept)
        else:
            raw = F.pow("t", F.lit(float(target)))
        own = materialize(own.select(m, raw.alias("share")))
        shares[m] = materialize(own.withColumn("share", F.col("share") / F.lit(own.agg(F.sum("share")).first()[0])))
    weight, full = F.least("free", "tokens"), F.col("free") >= F.col("tokens")
    out = cells.withColumn("free", F.col("tokens") * F.lit(float(budget)))

    def sums(df: DataFrame, m: str, share: DataFrame) -> DataFrame:
        per = df.groupBy(m).agg(
            F.sum(weight).alias("now"), F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("free"))), F.lit(0.0)).alias("loose"),
        )
        return per.join(share, m)

    stop, gap = _Stop(tolerance), 0.0
    for _ in range(max_rounds):
        for m, share in shares.items():
            goal = F.col("share") * F.lit(wanted)
            fill = (F.col("loose") > 0) & (goal > F.col("held"))
            factor = F.when(fill, F.try_divide(goal - F.col("held"), "loose"))
            factor = F.coalesce(factor, F.least(F.try_divide(goal, "now"), F.lit(1.0)), F.lit(1.0))
            step = sums(out, m, share).select(m, factor.alias("factor"))
            out = out.join(step, m).withColumn("free", F.col("free") * F.col("factor")).drop("factor")
        out = materialize(out)
        off = [sums(out, m, s).agg(F.max(F.abs(F.col("now") / F.lit(wanted) - F.col("share"))).alias("gap")) for m, s in shares.items()]
        gap = max(r["gap"] or 0.0 for r in functools.reduce(DataFrame.unionByName, off).collect())  # a row for each margin
        if stop(gap):
            break
    return out.select(*cells.columns, weight.cast("double").alias("weight")), gap


def probabilities(cells: DataFrame) -> DataFrame:
    """Raked ``cells`` with ``probability``: the share of its tokens that a cell is to give."""
    return cells.withColumn("probability", F.col("weight") / F.col("tokens"))


def mix(
    docs: DataFrame,
    targets: dict[str, float | dict[str, float]] | None = None,
    budget: float = BUDGET,
    seed: int = SEED,
    topics: list[str] | None = None,
) -> DataFrame:
    """``docs`` (doc_id, text, source, lang) with mix_topic, mix_tokens, mix_probability, mix_gap and mix_sampled.

    All rows come back with all their columns, but for those that have one of these names; taking the sample is a filter on
    mix_sampled. mix_gap is the largest difference between a marginal share and its target that raking left, the same in
    all rows. Null sources and languages are a value of their own, null text is empty and counts as one token. Whether a
    row is sampled depends on doc_id, text and seed, so repeated rows share it. An empty table gives an empty result.
    ``topics`` are the topic words, rarest first; by default they are counted in ``docs``.
    """
    targets = TARGETS if targets is None else targets
    topics = topic_words(docs) if topics is None else topics
    keys = free_names(docs, *MARGINS)
    topic, tokens, u = free_names(docs, "topic_word", "tokens", "u")
    named = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    marked = docs.withColumns({topic: topic_of(docs["text"], topics), tokens: tokens_of(docs["text"])})
    marked = marked.withColumns(dict(zip(keys, (named(docs["source"]), named(docs["lang"]), named(F.col(topic))))))
    cells = materialize(marked.groupBy(*keys).agg(F.sum(tokens).alias("tokens")))
    n = cells.count()
    if not n:
        p = cells.select(*keys, F.lit(0.0).alias("mix_probability"), F.lit(0.0).alias("mix_gap"))
    else:
        raked, gap = rake(cells, dict(zip(keys, (targets.get(m, 1.0) for m in MARGINS))), budget)
        p = probabilities(raked).select(*keys, F.col("probability").alias("mix_probability"), F.lit(gap).alias("mix_gap"))
        p = materialize(p)
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"]), 11) / F.lit(float(1 << 53))
    made = ["mix_topic", "mix_tokens", "mix_probability", "mix_gap", "mix_sampled"]
    kept = [c for c in docs.columns if c.lower() not in made]
    marked = marked.withColumn(u, hashed).select(*[docs[c] for c in kept], *keys, topic, tokens, u)
    out = marked.join(F.broadcast(p) if n <= BROADCAST_CELLS else p, keys)
    return out.select(
        *kept, F.col(topic).alias("mix_topic"), F.col(tokens).alias("mix_tokens"), "mix_probability", "mix_gap",
        (F.col(u) < F.col("mix_probability")).alias("mix_sampled"),
    )
