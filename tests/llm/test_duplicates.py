"""Exact and near duplicates against brute force, and the odd tables that every operator has to bear."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from sheetlens.llm import exact_dedup, graph, simhash_dedup
from sheetlens.llm.common import keep_rows

DOCS = "doc_id long, text string, lang string, row int, name string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", 7, "clash") for i, t in rows], DOCS)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def exact_brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for i, t in rows:
        own = groups[lower(t)]
        ids = [x for x in own if x is not None]
        out.append((i, max(ids) if ids else None, len(own), hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=repr)


NASTY = [
    (1, None), (2, ""), (3, "Äb ÄB"), (4, "äB äB"), (5, "ÄB äb"), (None, "x" * 50), (None, "X" * 50), (6, "x" * 50), (6, "x" * 50),
    (7, "ab" * 5000), (8, "aB" * 5000), (9, "ab" * 4999 + "ac"), (10, "İstanbul"), (11, "i̇stanbul"), (12, " "), (13, "abcdefgh"), (14, "abcdefgh" * 2),
]


@pytest.mark.parametrize("block, bits", [(4096, 64), (4, 64), (7, 3), (4, 1)])
def test_exact_groups_equal_brute_force(spark, block, bits):
    rng = random.Random(block)
    rows = NASTY if block > 5 else [r for r in NASTY if len(r[1] or "") < 100]
    rows = rows + [(100 + i, "".join(rng.choice("aAb") for _ in range(rng.randint(0, 30)))) for i in range(60)]
    got = exact_dedup.exact_duplicates(table(spark, rows), block, bits).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == exact_brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({lower(t) for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_of_an_empty_table(spark):
    assert exact_dedup.exact_duplicates(table(spark, [])).collect() == []


def test_keep_rows_takes_each_row_once_with_its_columns(spark):
    docs = table(spark, [(1, "a"), (1, "a"), (1, "b"), (None, "c"), (2, None)])
    kept = exact_dedup.exact_duplicates(docs).where("kept").select("doc_id", "raw_sha256")
    got = keep_rows(docs, kept)
    assert got.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=repr) == sorted([(1, "a"), (1, "b"), (None, "c"), (2, None)], key=repr)


def fingerprint_brute(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_brute(points):
    parent = {i: i for i, _ in points}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, (i, a) in enumerate(points):
        for j, b in points[k + 1 :]:
            if bin(a ^ b).count("1") <= 2:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i, _ in points}


def test_fingerprint_is_the_majority_of_shingles():
    rng = random.Random(1)
    texts = [None, "", " \t\n\x0b\x0c\r", "A", "a b", "A\x0bb c", "É É É É", "a b c d e f"] + [" ".join(rng.choice("abcdef") for _ in range(n)) for n in range(3, 60)]
    for t in texts:
        assert simhash_dedup.fingerprint((t or "").encode()) == fingerprint_brute(t)


def test_spark_hashes_shingles_alike(spark):
    assert spark.sql("SELECT xxhash64('a b c') AS h").first().h % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_masks_leave_a_common_table_for_every_pair_of_bits():
    tables = [m % 2**64 for m in simhash_dedup.masks()]
    for i in range(64):
        for j in range(64):
            assert any(not m & (1 << i | 1 << j) for m in tables)


@pytest.mark.parametrize("pairwise", [1, 4, 1000])
def test_links_connect_what_brute_force_connects(spark, pairwise):
    rng = np.random.default_rng(3)
    fps = {0, 2**64 - 1}
    for _ in range(12):
        at = int(rng.integers(0, 2**63)) * 2 + 1
        for _ in range(int(rng.integers(1, 25))):
            fps.add(at)
            for _ in range(int(rng.integers(1, 4))):
                at ^= 1 << int(rng.integers(0, 64))
    base = int(rng.integers(0, 2**63))
    fps |= {base ^ (1 << i) for i in range(64)}  # a crowd around one value
    points = list(enumerate(sorted(fps)))
    signed = [(f - 2**64 if f >= 2**63 else f, i) for i, f in points]
    df = spark.createDataFrame(signed, "fp long, node long")
    edges = [(r.a, r.b) for r in simhash_dedup.links(df, pairwise).collect()]
    of = dict(points)
    assert all(bin(of[a] ^ of[b]).count("1") <= 2 for a, b in edges)
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {i: found.get(i, i) for i, _ in points} == components_brute(points)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, "  "), (4, "one"), (5, "ONE"), (5, "one"), (None, "one two"), (6, "One\ttwo")]
    for k in range(25):
        base = [rng.choice(words) for _ in range(300)]
        for c in range(3):
            copy = list(base)
            copy[rng.randrange(300)] = "changed"
            rows.append((100 + 3 * k + c, " ".join(copy)))
    points = [(i, fingerprint_brute(t)) for i, (_, t) in enumerate(rows)]
    comp = components_brute(points)
    least = {}
    for i, c in comp.items():
        least.setdefault(c, []).append(rows[i][0])
    want = sorted(
        [(rows[i][0], f"{points[i][1]:016x}", min([x for x in least[c] if x is not None], default=None)) for i, c in comp.items()], key=repr
    )
    got = sorted([(r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup.near_duplicates(table(spark, rows)).collect()], key=repr)
    assert got == want
    reps = simhash_dedup.representatives(table(spark, rows)).collect()
    assert len(reps) == len(least)


def test_near_duplicates_without_ids_or_rows(spark):
    got = simhash_dedup.near_duplicates(table(spark, [(None, "a b"), (None, "c"), (3, "c")])).collect()
    assert sorted([(r.doc_id, r.component_id) for r in got], key=repr) == sorted([(None, None), (None, 3), (3, 3)], key=repr)
    assert simhash_dedup.near_duplicates(table(spark, [])).collect() == []


def test_near_duplicates_of_two_texts_under_one_id(spark):
    rows = [(1, "a b c d e"), (1, "v w x y z"), (2, "a b c d e"), (3, "k l m n o")]
    docs = table(spark, rows)
    got = simhash_dedup.near_duplicates(docs).collect()
    want = [(i, f"{fingerprint_brute(t):016x}", 3 if i == 3 else 1) for i, t in rows]
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted(want)
    kept = keep_rows(docs, simhash_dedup.representatives(docs)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, "a b c d e"), (1, "v w x y z"), (3, "k l m n o")]


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)] + [(5000, 5000)]
    edges += [(rng.randrange(6000, 6400), rng.randrange(6000, 6400)) for _ in range(150)]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, i) == find(i) for e in edges for i in e)
