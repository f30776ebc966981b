"""Substring and suffix-array dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from waymark.llm import exchange, substring_dedup, suffix_dedup, text


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(40)]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(10, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(passages)[rng.randint(0, 5) :] if rng.random() < 0.6 else [rng.choice(vocab) for _ in range(rng.randint(1, 40))]
        rows.append((i * 3 if i % 11 else 7, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(500, None), (501, ""), (502, "ab" * 400), (None, rows[5][1]), (503, rows[5][1]), (504, rows[5][1]), (505, "x " * 90)]
    return rows


def sha(x):
    return hashlib.sha256(x).hexdigest()


def brute_words(rows, w=13):
    ids = [2**63 - 1 if i is None else i for i, _ in rows]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for i, ws in zip(ids, words):
        for s in range(len(ws) - w + 1):
            k = tuple(ws[s : s + w])
            first[k] = min(first.get(k, i), i)
    out = []
    for (i0, _), i, ws in zip(rows, ids, words):
        gone = set()
        for s in range(len(ws) - w + 1):
            if first[tuple(ws[s : s + w])] < i:
                gone |= set(range(s, s + w))
        out.append((i0, len(ws), len(gone), sha(" ".join(x for k, x in enumerate(ws) if k not in gone).encode())))
    return out


def brute_bytes(rows, n=100):
    ids = [2**63 - 1 if i is None else i for i, _ in rows]
    raw = [(t or "").encode() for _, t in rows]
    first = {}
    for i, b in zip(ids, raw):
        for s in range(len(b) - n + 1):
            k = b[s : s + n]
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for (i0, _), i, b in zip(rows, ids, raw):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - n + 1):
            if first[b[s : s + n]] < (i, s):
                gone[s : s + n] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i0, len(b), int(gone.sum()), spans, sha(kept)))
    return out


def same(df, want):
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)


#: Bytes of a batch and of a part of the hash space, and rows that a batch sends: one level, and several.
SIZES = [(exchange.BATCH_BYTES, exchange.PART_BYTES, exchange.FAN), (700, 4000, 3), (700, 1500, 256)]


def shrink(monkeypatch, sizes):
    for name, value in zip(("BATCH_BYTES", "PART_BYTES", "FAN"), sizes, strict=True):
        monkeypatch.setattr(exchange, name, value)


@pytest.mark.parametrize("sizes", SIZES)
def test_substring(spark, monkeypatch, sizes):
    shrink(monkeypatch, sizes)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_words string").repartition(5)
    got = substring_dedup.remove_repeats(df)
    same(got, brute_words(rows))
    same(substring_dedup.remove_repeats(df.limit(0)), [])


@pytest.mark.parametrize(("sizes", "many"), [*((s, 4096) for s in SIZES), (SIZES[1], 1)])
def test_suffix(spark, monkeypatch, sizes, many):
    shrink(monkeypatch, sizes)
    monkeypatch.setattr(suffix_dedup, "MANY_KINDS", many)
    rows = [r for k, r in enumerate(corpus(2)) if r[0] != 7 or k == 0]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_bytes string").repartition(5)
    same(suffix_dedup.remove_repeats(df), brute_bytes(rows))
    same(suffix_dedup.remove_repeats(df.limit(0)), [])


def test_levels_grow_with_the_corpus(spark, monkeypatch):
    shrink(monkeypatch, (700, 4000, 3))
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    batches = exchange.Batches(df)
    assert batches.levels > 1 and batches.fan <= 3
    keys = np.sort(text.mix(np.arange(5000, dtype=np.uint64)))
    digits = [exchange.digit(keys, k, 3, 3) for k in range(3)]
    part = digits[0] * 9 + digits[1] * 3 + digits[2]
    assert (np.diff(part) >= 0).all() and len(np.unique(part)) == 27


def test_words_with_equal_polynomials(spark):
    # Thue-Morse words collide under any polynomial modulo 2**64
    bits = [0]
    while len(bits) < 2048:
        bits += [1 - b for b in bits]
    one, two = ("".join(x[b] for b in bits) for x in ("ab", "ba"))
    buf = np.frombuffer(f"{one} {two}".encode(), np.uint8)
    w = text.split(buf, np.array([0, len(buf)]))
    for seed in (0, 1):
        assert len(set(w.hashes(seed).tolist())) == 2
    tail = " ".join(f"t{i}" for i in range(12))
    rows = [(1, f"{one} {tail}"), (2, f"{two} {tail}"), (3, f"{one} {tail}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(substring_dedup.remove_repeats(df), brute_words(rows))
    same(suffix_dedup.remove_repeats(df), brute_bytes(rows))


def test_equal_spans():
    rng = random.Random(4)
    words = ["", "a", "ab", "abcdefgh", "abcdefghi", "abcdefgX", "x" * 30, "x" * 29 + "y"]
    seq = [rng.choice(words) for _ in range(300)]
    buf = np.frombuffer("".join(seq).encode(), np.uint8)
    end = np.cumsum([len(x) for x in seq])
    start = end - [len(x) for x in seq]
    other = np.array([rng.randrange(len(seq)) for _ in seq])
    assert text.equal_spans(buf, start, end, start[other], end[other]).tolist() == [a == seq[k] for a, k in zip(seq, other)]


def test_lpf():
    rng = np.random.default_rng(3)
    for n, k in ((0, 2), (1, 2), (300, 2), (400, 4), (50, 1)):
        data = rng.integers(0, k, n).astype(np.uint8)
        raw = data.tobytes()
        want = [max([0, *(next((m for m in range(n - i) if raw[i + m] != raw[j + m]), n - i) for j in range(i))]) for i in range(n)]
        assert suffix_dedup.longest_previous_factor(data, 128).tolist() == [min(x, 128) for x in want]


def test_words():
    buf, off = text.as_bytes(__import__("pyarrow").array(["a  b", None, "", "é\x0bç a", "b"]))
    w = text.split(buf, off)
    assert [buf[s:e].tobytes().decode() for s, e in zip(w.start, w.end)] == ["a", "b", "é", "ç", "a", "b"]
    assert w.doc.tolist() == [0, 0, 3, 3, 3, 4] and w.first.tolist() == [0, 2, 2, 2, 5, 6]
    h = w.hashes()
    assert h[0] == h[4] and h[1] == h[5] and len(set(h.tolist())) == 4
    r = text.rolling(np.array([1, 2, 3, 1, 2, 3, 1], np.uint64), 3)
    assert r[0] == r[3] and r[1] == r[4] and len(set(r.tolist())) == 3
    x = np.sort(text.mix(np.arange(1000, dtype=np.uint64)))
    a, b = exchange.unpack(exchange.pack(x, np.arange(5, dtype=np.uint16)))
    assert (a == x).all() and b.tolist() == [0, 1, 2, 3, 4]
