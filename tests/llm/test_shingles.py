"""The pipeline's near-duplicate stage against all pairs."""

import random

import pytest

import corpus_pipeline
from sheetlens.llm import shingles

WORDS = [f"w{i}" for i in range(3000)]


def sets(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0


def edited_copies(rng):
    """Texts with edited copies of similarity about 0.6 to 0.95, a crowd of copies, and a passage that many texts have."""
    passage = [rng.choice(WORDS) for _ in range(30)]
    out = ["", "one two", "One  two", "a b c d e", "a b c d e f"]
    for k in range(40):
        base = [rng.choice(WORDS) for _ in range(rng.randint(60, 250))] + passage * (k % 2)
        out.append(" ".join(base))
        for _ in range(30 if k == 0 else 2):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


def check(texts, kept):
    of = [sets(t) for t in texts]
    like = {i: [j for j in range(len(of)) if j != i and jaccard(of[i], of[j]) >= 0.8] for i in range(len(of))}
    assert sum(map(len, like.values())) > 60
    assert not [(i, j) for i in kept for j in like[i] if j in kept]
    reached = set(kept)  # whoever goes is linked to one that stays
    while new := {j for i in reached for j in like[i]} - reached:
        reached |= new
    assert reached == set(range(len(of)))


@pytest.mark.parametrize("pairwise", [1, 4])
def test_no_two_kept_texts_are_alike(spark, pairwise):
    texts = edited_copies(random.Random(2))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in shingles.representatives(df, pairwise=pairwise).collect()}
    check(texts, kept)


def test_shingles_are_those_of_brute_force():
    rng = random.Random(4)
    for n in [0, 1, 4, 5, 6, 50]:
        text = " ".join(rng.choice("abc") for _ in range(n))
        assert len(shingles.shingles(text)) == len(sets(text))


def test_stage_leaves_no_edited_copies(spark):
    texts = [t for t in edited_copies(random.Random(3)) if t and len(t) > 200]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, texts[0] + " more", "en"), (3, texts[1] + " more", "en"), (3, texts[3], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    of = [sets(r.text) for r in got.collect()]
    assert not [1 for k, a in enumerate(of) for b in of[:k] if jaccard(a, b) >= 0.8]
    assert len(of) >= 39


def crowd(rng, n=240):
    """Copies of one text with so many edits that most pairs of them, but not all links between them, are under the threshold."""
    base = [rng.choice(WORDS) for _ in range(300)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(1, 7)):
            copy[rng.randrange(len(copy))] = rng.choice(WORDS)
        out.append(" ".join(copy))
    return out


def first_of_each_component(texts):
    of, root = [sets(t) for t in texts], list(range(len(texts)))
    for j in range(len(of)):
        for i in range(j):
            if root[i] != root[j] and jaccard(of[i], of[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return set(root)


def test_one_text_of_each_component_stays(spark):
    texts = crowd(random.Random(6))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = first_of_each_component(texts)
    assert 1 < len(want) < len(texts) / 2
    assert {r.doc_id for r in shingles.representatives(df, pairwise=4).collect()} == want


def test_large_buckets_by_blocks_and_rounds_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(shingles, "BLOCK", 7)
    texts = crowd(random.Random(8))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for all_pairs in (0, 10**6):  # by a limit that grows, and all at once
        monkeypatch.setattr(shingles, "ALL_PAIRS", all_pairs)
        assert {r.doc_id for r in shingles.representatives(df, pairwise=2).collect()} == first_of_each_component(texts)


def test_pairs_within_components_are_not_compared(spark, monkeypatch):
    rng, compared, alike = random.Random(9), [], shingles._alike
    base = [rng.choice(WORDS) for _ in range(150)]
    texts = []
    for _ in range(400):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = rng.choice(WORDS)
        texts.append(" ".join(copy))
    monkeypatch.setattr(shingles, "_alike", lambda pairs, *a: compared.append(pairs.count()) or alike(pairs, *a))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in shingles.representatives(df).collect()} == first_of_each_component(texts)
    assert sum(compared) < 400 * 399 / 2 / 5


def test_links_of_both_kinds_join(spark):
    rng, seven = random.Random(10), "p q r s t u v "
    a, b = (" ".join(rng.sample(WORDS, 40)) for _ in range(2))
    rows = [(0, seven * 200 + a, "en"), (1, seven * 200 + b, "en"), (2, seven + b, "en"), (3, "by itself", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    # 0 and 1 have one fingerprint, 1 and 2 are alike by shingles, 0 and 2 are neither.
    assert jaccard(sets(rows[1][1]), sets(rows[2][1])) >= 0.8 > jaccard(sets(rows[0][1]), sets(rows[2][1]))
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got) == [0, 3]
