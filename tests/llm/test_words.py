"""Collocations, spelling variants and benchmark decontamination against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from sheetlens.llm import collocations, decontaminate, registry, spelling

SF = "/root/testdata/sf0.001"


# Decontamination


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def contaminated_brute(docs, items, window=10):
    out = []
    windows = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        m = min(len(w), window)
        for i in range(len(w) - m + 1) if m else []:
            windows[tuple(w[i : i + m])].add("" if item is None else str(item))
    for doc_id, text in docs:
        w, hit, ids = words_of(text), set(), set()
        for m in range(1, window + 1):
            for i in range(len(w) - m + 1):
                if found := windows.get(tuple(w[i : i + m])):
                    hit.update(range(i, i + m))
                    ids |= found
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), digest, bool(hit)))
    return sorted(out, key=str)


def planted(rng, vocabulary, n_docs, n_items, lengths):
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice(lengths)))) for k in range(n_items)]
    docs = []
    for d in range(n_docs):
        w = rng.choices(vocabulary, k=rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 3)):
            own = words_of(rng.choice(items)[1])
            a = rng.randrange(0, max(1, len(own) - 9))
            w[(at := rng.randrange(0, len(w) + 1)) : at] = own[a : a + rng.choice([9, 10, 11, 40])]
        docs.append((d, rng.choice([" ", "  ", ", ", "-"]).join(w).upper()))
    return docs, items


@pytest.mark.parametrize("limit", [0, 1_000_000])
@pytest.mark.parametrize("lengths", [[12, 15, 40], [1, 2, 3, 5, 8, 9, 10, 11, 25]])
def test_decontamination_equals_brute_force(spark, monkeypatch, limit, lengths):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    rng = random.Random(len(lengths))
    vocabulary = [f"w{k}" for k in range(12)] + ["é", "ñandú", "9"] if lengths[0] == 12 else [f"v{k}" for k in range(400)]
    docs, items = planted(rng, vocabulary, 80, 12, lengths)
    items += [(3, items[5][1]), (99, items[5][1])]  # an id with two texts, a text with two ids
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = contaminated_brute(docs, items)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert 10 < sum(r[5] for r in want)


def test_decontamination_of_odd_tables(spark):
    long = "x " * 50_000 + "one two three"
    docs = [(1, None, "c", 5), (1, "", "c", 5), (2, "One, TWO-three", "c", 5), (2, "One, TWO-three", "c", 5), (None, "one two", "c", 5), (None, long, "c", 5), (4, "!? --", "c", 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string, kept int")
    items = [("b", "one two three", "z"), (None, "two", "z"), ("a", None, "z"), ("a", "", "z"), ("b", "one two three", "z")]
    bench = spark.createDataFrame(items, "item_id string, text string, doc_id string")
    got = sorted(map(tuple, decontaminate.contaminated(df, bench).collect()), key=str)
    assert got == contaminated_brute([r[:2] for r in docs], [r[:2] for r in items])
    assert decontaminate.contaminated(df.where("false"), bench).collect() == []
    assert not any(r.contaminated for r in decontaminate.contaminated(df, bench.where("false")).collect())
    assert decontaminate.contaminated(df, bench).columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_every_shared_window_leaves_a_shared_hash(spark):
    rng = random.Random(3)
    rows = [(k, [rng.choice("abcde") for _ in range(40)]) for k in range(5)]
    for m in range(1, 11):
        df = decontaminate.with_minima(spark.createDataFrame(rows, "k int, w array<string>"), "w", m, "h")
        by = defaultdict(set)
        for r in df.collect():
            assert len(r.h) == len(r.w) - m + 1
            for i, h in enumerate(r.h):
                by[tuple(r.w[i : i + m])].add(h)
        assert all(len(hashes) == 1 for hashes in by.values())


# Spelling variants


def near_brute(words):
    """Pairs at one edit, from the definition."""
    out = set()
    for a in words:
        edits = {a[:k] + a[k + 1 :] for k in range(len(a))}
        for b in words:
            if b in edits or len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1:
                out |= {(a, b), (b, a)}
    return out


def variants_brute(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 31 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            if len(low) >= 7:
                n[low] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    near = defaultdict(list)
    for a, b in near_brute(list(n)):
        near[a].append(b)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x))
        if n[best] >= 10 * n[w]:
            form[w] = best
    out = []
    for w, c in n.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, c, len(near[w]), form.get(w), n.get(form.get(w)), root))
    return sorted(out, key=str)


def spelled(rng, n_docs):
    base = ["".join(rng.choices("abcéñÀ", k=rng.randrange(7, 12))) for _ in range(30)]
    words = list(base)
    for w in base:
        for _ in range(5):
            k = rng.randrange(len(w))
            words.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "y" + w[k + 1 :], w[:k] + w[k] + w[k:]]))
    docs = []
    for d in range(n_docs):
        text = [rng.choice(base) if rng.random() < 0.9 else rng.choice(words) for _ in range(rng.randrange(0, 150))]
        docs.append((d, rng.choice([" ", "7", ". ", "_"]).join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in text)))
    return docs


@pytest.mark.parametrize("block", [3, 512])
def test_variants_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spelling.near_words, "__defaults__", (block,))
    monkeypatch.setattr(spelling, "_KEPT", 50)
    docs = spelled(random.Random(block), 200)
    got = spelling.variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    want = variants_brute(docs)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sum(r[3] is not None for r in want) > 20 and sum(r[5] != r[3] for r in want if r[3]) >= 0


def test_near_words_equal_brute_force_in_crowded_buckets(spark, monkeypatch):
    """Words that share almost everything, so that buckets have many members, in blocks of few."""
    monkeypatch.setattr(spelling, "PAIRS", 100)
    rng = random.Random(8)
    words = sorted({"aaaa" + "".join(rng.choices("ab", k=k)) + "bbbb" for k in (1, 2, 3, 4) for _ in range(40)} | {"a" * k for k in range(7, 12)})
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id long, word string")
    near = defaultdict(set)
    for a, b in near_brute(words):
        near[words.index(a)].add(words.index(b))
    for block in (2, 7, 1000):
        got = {r.id: (r.n_near, r.best) for r in spelling.near_words(df, block).collect()}
        assert got == {k: (len(v), min(v)) for k, v in near.items()}


def test_roots_follow_long_chains(spark):
    forms = spark.createDataFrame([(k, k - 1) for k in range(1, 12)] + [(30, 20)], "id long, form long")
    assert {r.id: r.root for r in spelling.roots(forms).collect()} == {**{k: 0 for k in range(1, 12)}, 30: 20}


def test_variants_of_odd_tables(spark):
    docs = [(None, "elephant elephant"), (1, None), (1, ""), (2, "elephant " * 40_000 + "elephants elephants"), (2, "short W0RDS"), (3, "a" * 5000 + " " + "a" * 5000)]
    df = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, word string")
    assert sorted(map(tuple, spelling.variants(df).collect()), key=str) == variants_brute(docs)
    assert spelling.variants(df.where("false")).collect() == []
    named = spark.createDataFrame([("d1", "elephant elephant"), ("d1", "elephant elephant")], "doc_id string, text string")
    assert sorted(map(tuple, spelling.variants(named).collect()), key=str) == variants_brute([("d1", "elephant elephant")] * 2)


# Collocations


def mined_brute(docs, least, top):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    out = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        longer = (q for (g, q), b in f.items() if g == lang and b == a and len(q) > len(p))
        if not any(q[i : i + len(p)] == p for q in longer for i in range(len(q) - len(p) + 1)):
            out[lang].append((" ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    rows = []
    for lang, own in out.items():
        own.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        rows += [(lang, i + 1, *x) for i, x in enumerate(own[:top])]
    return sorted(rows, key=str)


def talk(rng, n):
    words = [f"w{k}" for k in range(40)] + ["é", "'", "日本", "a\x1cb"]
    weights = [1 / (k + 1) for k in range(len(words))]
    fixed = [rng.sample(words, k) for k in (2, 3, 4, 5, 7)] + [["w1", "w1", "w1"], ["w39", "w38"]]
    docs = []
    for _ in range(n):
        out = []
        for _ in range(rng.randrange(0, 12)):
            out += rng.choice(fixed) if rng.random() < 0.4 else rng.choices(words, weights, k=rng.randrange(1, 5))
            out[-1] += rng.choice(["", "", "", ".", ",", "!", "\n", "\t"])
        docs.append((rng.choice(["en", "en", "de", None, "und"]), " ".join(w.upper() if rng.random() < 0.1 else w for w in out)))
    return docs


@pytest.mark.parametrize("least, top, opens", [(3, 7, 3), (3, 1000, 5), (5, 4, 1)])
def test_mining_equals_brute_force(spark, monkeypatch, least, top, opens):
    monkeypatch.setattr(collocations, "GROWTH", 2)
    docs = talk(random.Random(top), 300)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    monkeypatch.setattr(collocations, "LEAST", least)
    rounds, plain = [], collocations.frontier
    monkeypatch.setattr(collocations, "frontier", lambda *a: rounds.append(a[2]) or plain(*a))
    got = sorted(map(tuple, collocations.mine(df, top, opens).collect()), key=str)
    assert got == mined_brute(docs, least, top)
    assert len(got) > 10 and len(rounds) > 1  # the frontier grew


def test_small_maps_let_nothing_get_lost(spark, monkeypatch):
    """Maps so small that most bits are set: more is counted, the result is the same."""
    docs = talk(random.Random(5), 120)
    monkeypatch.setattr(collocations, "LEAST", 3)
    monkeypatch.setattr(collocations, "PIECE", 4)
    got = sorted(map(tuple, collocations.mine(spark.createDataFrame(docs, "lang string, text string"), 20, 4, 6).collect()), key=str)
    assert got == mined_brute(docs, 3, 20)


def test_scores_are_exact_beyond_64_bits(spark):
    counts = spark.createDataFrame([("x", "a b", 2, 900_000_000_000)], "lang string, phrase string, m int, n long")
    words = spark.createDataFrame([("x", "a", 900_000_000_001), ("x", "b", 900_000_000_007)], "lang string, phrase string, n long")
    total = spark.createDataFrame([("x", 3_000_000_000_017)], "lang string, n long")
    (row,) = collocations.scored(counts, words, words.select("lang", "phrase"), total).collect()
    assert row.score == 1000 * 900_000_000_000 * 3_000_000_000_017 // (900_000_000_001 * 900_000_000_007)


def test_mining_of_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST", 2)
    docs = [(None, None), ("en", ""), ("en", "a b. a b"), ("en", "a b. a b"), ("", "q r q r"), ("und", "x y"), (None, "x y"), ("en", "c d " * 30_000)]
    df = spark.createDataFrame([(*r, "clash") for r in docs], "lang string, text string, phrase string")
    assert sorted(map(tuple, collocations.mine(df).collect()), key=str) == mined_brute(docs, 2, 2000)
    assert collocations.mine(df.where("false")).collect() == []
    assert collocations.mine(df).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_tokens_are_words_and_stops():
    assert collocations.tokens_of("A,b\tC!\x1cd\x0be") == [b"a", b".", b"b", b"c", b".", b"\x1cd", b".", b"e"]


def test_registered_queries_run_on_whole_tables(spark):
    for name, columns in {
        "op11_collocations": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
        "op12_spelling_variants": ["word", "n", "n_near", "form", "form_n", "root"],
    }.items():
        assert registry.QUERIES[name](spark, SF).columns == columns
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = registry.QUERIES["op13_decontamination"](spark, SF)
    assert sorted(map(tuple, got.collect()), key=str) == contaminated_brute(docs, items)
