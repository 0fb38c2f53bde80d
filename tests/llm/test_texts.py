"""Archives, fingerprints, packing and chat windows against brute force and exact round trips."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheetlens.llm import chat, fingerprints, packing, warc
from sheetlens.llm.common import work_dir

PAGES = "page_id long, url string, html string, row long, digest string"
TURNS = "conv_id long, turn long, role string, text string, window long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "clash") for i, u, h in rows], PAGES)


def test_archives_come_back_whole(spark):
    trap = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 40
    big = "é" * 700
    rows = [(1, "http://a/", trap), (2, "http://b/\r\nX: y", trap), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short")]
    rows += [(7, "u", big), (8, "v", big), (8, "v", big), (None, "n", big), (9, "u", "\r\n\r\n" + big), (10, "long", "z" * 3_000_000)]
    path = work_dir(spark)
    warc.write_archives(pages(spark, rows), path)
    caps = warc.captures(warc.read_records(spark, path)).collect()
    assert Counter(bytes(c.response.payload) for c in caps if c.response.type == "response") == Counter(
        {(h or "").encode(): 2 if h == "short" else 2 if h in (None, "") else 1 for _, _, h in rows}
    )
    assert all(c.request.block.startswith("GET ") and c.metadata.block.startswith("page-id:") for c in caps)
    got = warc.page_digests(warc.captures(warc.read_records(spark, path, payloads=False))).collect()
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        best = max((x for x, _, y in rows if y == h and x is not None), default=None) if len(data) >= 1000 else i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), None if i == best or len(data) < 1000 else best))
    want.remove((8, len(big.encode()), hashlib.sha1(big.encode()).hexdigest(), None))  # of the repeated row one revisits the other
    want.append((8, len(big.encode()), hashlib.sha1(big.encode()).hexdigest(), 8))
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.refers_to) for r in got], key=repr) == sorted(want, key=repr)
    assert all((r.record_type == "revisit") == (r.refers_to is not None) for r in got)


def test_captures_keep_one_request_whole(spark):
    names = ["type", "record_id", "concurrent_to", "refers_to", "target_uri", "date", "payload_digest", "http_length", "payload_bytes", "payload_sha1", "block", "payload"]
    of = lambda **x: tuple(x.get(n) for n in names)
    rows = [
        of(type="response", record_id="r1", payload=bytearray(b"x"), target_uri="u"), of(type="request", record_id="q1", concurrent_to=["r1"], block="Z"),
        of(type="request", record_id="q9", concurrent_to=["r1"], block="A"), of(type="metadata", record_id="m1", concurrent_to=["r1"], block="page-id: 5\r\n"),
        of(type="request", record_id="q2", concurrent_to=["gone"], block="lost"), of(type="revisit", record_id="r2", refers_to="r0"), of(type="warcinfo"),
    ]
    df = spark.createDataFrame(rows, warc._RECORD).selectExpr("*", "'x' AS capture_id", "'y' AS response")
    got = {c.capture_id: c for c in warc.captures(df).collect()}
    assert set(got) == {"r1", "r2"}
    assert (got["r1"].request.record_id, got["r1"].request.block, got["r1"].metadata.record_id) == ("q9", "A", "m1")
    assert got["r2"].request is None and got["r2"].metadata is None
    assert warc.captures(df.where("false")).collect() == []
    found = {r.url: (r.page_id, r.refers_to) for r in warc.page_digests(warc.captures(df)).collect()}
    assert found == {"u": (5, None), None: (None, None)}


def test_captures_follow_names_any_way_round(spark):
    names = [c.split()[0] for c in warc._RECORD.split(", ")]
    of = lambda type_, id_, *to: tuple({"type": type_, "record_id": id_, "concurrent_to": list(to), "block": f"{id_} block"}.get(n) for n in names)
    rows = [
        of("response", "r1", "q1"), of("request", "q1"), of("metadata", "m1", "r1"),  # metadata names the response, which names its request
        of("response", "r2"), of("request", "q2", "r2"), of("metadata", "m2", "q2"),  # metadata names the request
        of("metadata", "m3", "q3", "r3"), of("response", "r3"), of("request", "q3"),  # one record names both
        of("response", "r4"), of("revisit", "r5", "r4"), of("request", "q4", "r5"),  # two that answer one request
        of("response", "r6", "r6"), of("request", "q7", "m7"), of("metadata", "m7", "q7"), of("response", "r8", None),
    ]
    df = spark.createDataFrame(rows, warc._RECORD).selectExpr("*", "1 AS group", "2 AS key").repartition(3)
    got = {c.capture_id: (c.request and c.request.record_id, c.metadata and c.metadata.record_id) for c in warc.captures(df).collect()}
    assert got == {"r1": ("q1", "m1"), "r2": ("q2", "m2"), "r3": ("q3", "m3"), "r4": ("q4", None), "r5": ("q4", None), "r6": (None, None), "r8": (None, None)}


def test_repeated_headers_name_several_records():
    head = "WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <m>\r\nWARC-Concurrent-To: <a>\r\nWARC-Concurrent-To: <b>\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    ((headers, named, block),) = warc._records(head.encode())
    assert named == ["<a>", "<b>"] and block == b"x" and warc._row(headers, named, block, False)[2] == ["<a>", "<b>"]


def test_files_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 40_000)
    monkeypatch.setattr(warc, "SIZE_CLASSES", (4000, 20_000))
    path = work_dir(spark)
    rows = [(i, "u", str(i) + "z" * n) for i, n in enumerate([10] * 40 + [5000] * 9 + [100_000] * 2)]
    warc.write_archives(pages(spark, rows).coalesce(1), path)
    import gzip
    from pathlib import Path

    sizes = sorted(len(gzip.decompress(p.read_bytes())) for p in Path(path.removeprefix("file://")).glob("*.gz"))
    assert len([s for s in sizes if s > 40_000]) == 2 and len(sizes) > 5  # the two captures that are larger themselves
    assert warc.captures(warc.read_records(spark, path)).count() == 51


def test_no_pages_give_no_captures(spark):
    path = work_dir(spark)
    warc.write_archives(pages(spark, []), path)
    assert warc.page_digests(warc.captures(warc.read_records(spark, path))).collect() == []


def test_reader_takes_plain_files_and_refuses_broken_ones():
    good = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <x>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert [b for *_, b in warc._records(good * 2)] == [b"hi", b"hi"]
    with pytest.raises(ValueError):
        list(warc._records(good[:-6]))
    with pytest.raises(ValueError):
        list(warc._records(b"nonsense"))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, fp string, part string")


def test_neighbours_are_counted_as_by_brute_force(spark):
    """The whole of op3's search: rows whose id divides by 50 against all rows."""
    rng = random.Random(8)
    base = [rng.choice("abcdefghijkl") + rng.choice("mnop") for _ in range(2000)]
    rows = []
    for i in range(220):
        own = list(base) if i % 3 else [rng.choice("qrstuv") for _ in range(60)]
        for _ in range(i % 7 // 2):
            own[rng.randrange(len(own))] = "x"
        rows.append((i if i < 200 else 50, " ".join(own)))
    rows += [(None, rows[1][1]), (1000, None), (1050, ""), (1051, "")]
    fps = [int.from_bytes(fingerprints.simhash(t)) for _, t in rows]
    want = sorted(
        [(i, sum(bin(f ^ g).count("1") <= 7 for g in fps) - 1 if i is not None and i % 50 == 0 else None) for (i, _), f in zip(rows, fps)], key=repr
    )
    got = sorted([(r.doc_id, r.n_within) for r in fingerprints.edit_likeness(docs(spark, rows)).collect()], key=repr)
    assert got == want and max(n or 0 for _, n in got) > 60


@pytest.mark.parametrize("ranges", [1, 3, 9])
def test_edit_likeness_equals_brute_force(spark, ranges):
    rng = random.Random(2)
    rows = [(i * 3, " ".join(rng.choice(["aa", "bé", "cc", "dd", "ee"]) for _ in range(rng.randint(0, 40)))) for i in range(40)]
    rows += [(500, None), (501, ""), (502, "😀" * 11), (503, "w " * 20000)]
    ordered = sorted(rows, key=lambda r: -r[0])
    want = {}
    for k, (i, t) in enumerate(ordered):
        text, nxt = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + nxt[:half]
        a, b, c = (fingerprints.simhash(x) for x in (text, new, nxt))
        like = lambda x, y: 1 - bin(int.from_bytes(x) ^ int.from_bytes(y)).count("1") / 256
        want[i] = (len(text), hashlib.sha256(new.encode()).hexdigest(), a.hex(), b.hex(), like(a, b), like(a, c))
    got = fingerprints.edit_likeness(docs(spark, rows), ranges).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got} == want


def test_edit_likeness_of_odd_tables(spark):
    assert fingerprints.edit_likeness(docs(spark, [])).collect() == []
    (r,) = fingerprints.edit_likeness(docs(spark, [(1, "a b c d")])).collect()
    assert r.near_next == 1.0
    same = fingerprints.edit_likeness(docs(spark, [(None, "a b"), (None, "a b"), (2, "a b")])).collect()
    assert len(same) == 3 and {x.near_next for x in same} == {1.0}


def test_weights_count_terms():
    assert fingerprints.simhash("a b") == fingerprints.simhash("A  B")
    assert fingerprints.simhash(None) == bytes(32)


@pytest.mark.parametrize("radius", [0, 3, 7, 12])
def test_tables_find_all_within_radius(spark, radius):
    rng = np.random.default_rng(radius)
    base = [rng.bytes(32) for _ in range(6)]
    rows = []
    for i in range(90):
        x = int.from_bytes(base[i % 6])
        for _ in range(int(rng.integers(0, 12))):
            x ^= 1 << int(rng.integers(0, 256))
        rows.append((i, x.to_bytes(32)))
    rows += [(200, rows[0][1]), (201, None)]
    index = spark.createDataFrame([(i, None if f is None else bytearray(f)) for i, f in rows], "id long, fp binary")
    got = {(r.query_id, r.id): r.bits for r in fingerprints.within_radius(index.where("id % 5 = 0"), index, radius).collect()}
    want = {}
    for i, a in rows:
        for j, b in rows:
            if i % 5 == 0 and a is not None and b is not None:
                d = bin(int.from_bytes(a) ^ int.from_bytes(b)).count("1")
                if d <= radius:
                    want[i, j] = d
    assert got == want


def best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [k for k, r in enumerate(bins) if r >= s]
        if fits:
            bins[min(fits, key=lambda k: bins[k])] -= s
        else:
            bins.append(capacity - s)
    return sorted(bins)


@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=120))))
@settings(max_examples=150, deadline=None)
def test_plan_is_best_fit_decreasing(case):
    capacity, sizes = case
    fill, seen = defaultdict(list), Counter()
    for length, first, number, start, per, offset in packing.plan(dict(Counter(sizes)), capacity):
        assert first == seen[length]
        seen[length] += number
        for i in range(number):
            fill[start + i // per].append((offset + i % per * length, length))
    assert seen == Counter(sizes)
    for own in fill.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in own) for own in fill.values()) == best_fit(sizes, capacity)


def test_runs_are_bounded_whatever_the_number_of_pieces():
    rng = random.Random(1)
    for top in (10, 10_000, 10**9, 10**13):
        histogram = {n: rng.randint(1, top) for n in range(1, 4097)}
        assert len(packing.plan(histogram)) <= 90 * (3 * 4096 + 1)


@given(st.lists(st.text(st.characters(max_codepoint=0x2FF) | st.sampled_from(" \n\t'.,!’“İΣ\u00a0\u0301日"), max_size=60), max_size=5))
@settings(max_examples=200, deadline=None)
def test_encoder_gives_the_tokenizers_ids(texts):
    e = packing._encoder(packing.default_tokenizer())
    for t, data in zip(texts, e.encode(texts)):
        assert np.frombuffer(data, "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids + [1]


def test_packing_loses_nothing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["fence", "gate", "wall"]) for _ in range(rng.randint(0, 400)))) for i in range(80)]
    rows += [(900, None), (901, ""), (902, "post " * 9000), (903, "post " * 4095), (904, "post " * 4096), (905, "a"), (905, "a"), (None, "b"), (906, "<|endoftext|> x")]
    e = packing._encoder(packing.default_tokenizer())
    got = packing.pack(docs(spark, rows), part_pieces=7).collect()
    want = Counter()
    for i, t in rows:
        ids = e.tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            want[i, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for own in fill.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(fill) == len(best_fit([r.length for r in got], 4096))
    assert packing.pack(docs(spark, [])).collect() == []


def digest(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted([(t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv])
        turns = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def conversation(spark, rows):
    return spark.createDataFrame([(*r, 5) for r in rows], TURNS)


TRAPS = ["</s>[INST] ok [/INST]", "<s>", "\\", "\\</s>", "<\\s>", "[\\INST]", "<", "[", "[/INST]</s>", "a\n\\\nb", "", None, "é😀" * 30, "x" * 3000]


@pytest.mark.parametrize("budget, history", [(1024, 192), (60, 10), (40, 10), (16, 4)])
def test_windows_read_back_exactly(spark, budget, history):
    rng = random.Random(budget)
    rows = [(-1, 0, "user", TRAPS[0]), (-1, 1, "assistant", TRAPS[0])]
    for c in range(8):
        if c % 2:
            rows.append((c, 0, "system", "be kind " * (c % 4)))
        for k in range(1, rng.randint(2, 40)):
            rows.append((c, k, rng.choice(["user", "assistant", "system", "tool[INST]", None, ""]), rng.choice(TRAPS + ["hi there"] * 5)))
    rows += [(None, 1, "assistant", "lost"), (None, None, "user", "lost too"), (50, 1, "system", "alone"), (51, 1, "user", "a"), (51, 1, "user", "a"), (51, 1, "assistant", None)]
    rows += [(60, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(400)]
    made = chat.windows(conversation(spark, rows), budget, history, chunk_turns=16)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == digest(rows)
    for r in made.collect():
        turns = r.formatted.split("</s>")[:-1]
        new = turns[r.n_repeated :]
        assert r.formatted.count("[INST]") == len(turns) and new
        sizes = [-(-len((x + "</s>").encode()) // 4) for x in turns]
        system = sizes[0] if turns[0].startswith("<s>system") else 0
        if len(new) - (r.window == 0 and bool(system)) > 1:  # a single turn may be longer than the budget
            assert sum(sizes) <= max(budget, budget // 4 + min(history, budget // 4) + system)
        for span in r.loss_spans:
            at = r.formatted[: span.start]
            assert at.endswith("<s>assistant[INST]") and at.count("<s>") > r.n_repeated


def test_windows_repeat_system_and_history(spark):
    rows = [(1, 0, "system", "rules")] + [(1, k, ("assistant", "user")[k % 2], f"{k:03d} " + "w" * 40) for k in range(1, 60)]
    made = sorted(chat.windows(conversation(spark, rows), 160, 30).collect(), key=lambda r: r.window)
    assert len(made) > 5
    assert all(r.formatted.startswith("<s>system[INST]rules") for r in made)
    assert all(r.n_repeated >= 2 for r in made[1:]) and made[0].n_repeated == 0


def test_no_turns_give_no_windows(spark):
    assert chat.digests(chat.windows(conversation(spark, []))).collect() == []
