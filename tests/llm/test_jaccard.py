import random
import re

import numpy as np
import pytest

from waymark.llm import jaccard_join as J


def brute(rows, words, percent):
    sets = []
    for _, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least[find(i)] if d is not None else None) for i, (d, _) in enumerate(rows)]


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(300)] + ["É", "Ab", "aB"]
    rows = []
    for base in range(12):
        text = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 8, 11, 12, 13, 25, 60, 130, 400]))]
        for _ in range(rng.randint(1, 9)):
            t = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, len(t) // 50, len(t) // 30])):
                k = rng.randrange(len(t))
                t[k : k + rng.randint(0, 1)] = [rng.choice(vocab)] * rng.randint(0, 1)
            rows.append((rng.randrange(10_000), rng.choice([" ", "\n"]).join(t)))
    hard = [f"h{i}" for i in range(200)]
    for k in range(40):  # a chain: each links to its neighbours only
        rows.append((20_000 - k, " ".join(hard[: 200 - 3 * k] + [f"x{k // 2}_{i}" for i in range(3 * k)])))
    return rows + [(5, None), (6, ""), (None, rows[0][1]), (7, " \t"), (8, rows[3][1]), (8, rows[20][1]), (9, rows[3][1]), (9, rows[3][1])]


@pytest.mark.parametrize(("words", "percent", "seed"), [(3, 90, 1), (5, 80, 2)])
def test_groups(spark, words, percent, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n int").repartition(3)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, J.groups(df, words, percent).collect()), key=key) == sorted(brute(rows, words, percent), key=key)


def test_tiles_lose_no_link():
    rng = np.random.default_rng(5)
    for num in (90, 80):
        for n in (9, 10, 14, 19, 20, 27, 28, 54, 100, 333, 2000):
            for _ in range(40):
                d = J._most_different(2 * n, num, 100)
                s = rng.integers(0, 2**64 - 1, n + d, dtype=np.uint64)
                a, b = np.sort(s[:n]), np.sort(s[rng.integers(0, d // 2 + 1) :][:n])
                both = len(np.intersect1d(a, b))
                if 100 * both >= num * (len(a) + len(b) - both):
                    assert len(np.intersect1d(J.tile_keys(a, num, 100), J.tile_keys(b, num, 100)))


def test_empty_and_one_per_group(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, "x")], "doc_id long, text string")
    assert J.groups(df.limit(0)).collect() == []
    assert sorted(r.doc_id for r in J.one_per_group(df).collect()) == [1, 3, 4]


def test_one_per_group_keeps_other_texts_of_a_repeated_id(spark):
    a, b, c = ("a b c d e f g", "other words that stand alone in this corpus", "one more text unlike any of the others here")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, "Z z Y y X x W w"), (3, c), (3, c.upper()), (4, "z Z y Y x X w W"), (5, None), (5, " "), (5, b), (None, a), (None, a)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, first_hash string").repartition(3)
    got = [(r.doc_id, r.text.lower() if r.text else r.text, r.first_hash) for r in J.one_per_group(df).collect()]
    want = [(1, a), (2, b), (3, c), (3, "z z y y x x w w"), (5, None), (5, " "), (None, a), (None, a)]
    assert sorted(map(str, got)) == sorted(str((*w, "k")) for w in want)


@pytest.mark.parametrize(("members", "size"), [(4096, 8 << 20), (6, 8 << 20), (4096, 4000)])
def test_alike_but_unlinked(spark, monkeypatch, members, size):
    # texts around the limit: bitmaps allow most pairs, few link, and links join groups of several sizes
    monkeypatch.setattr(J, "_TILE", members)
    monkeypatch.setattr(J, "_TILE_BYTES", size)
    rng = random.Random(11)
    base = [f"b{i}" for i in range(160)]
    rows = []
    for i in range(70):
        t = list(base)
        for _ in range(rng.choice([1, 3, 4, 5, 6])):
            t[rng.randrange(len(t))] = f"own{i if i % 3 else 0}"
        rows.append((i, " ".join(t)))
    rows += [(100 + i, " ".join(f"z{i}_{k}" for k in range(60))) for i in range(5)] + [(200, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, J.groups(df, 5, 80).collect()))
    assert got == sorted(brute(rows, 5, 80)) and len({c for *_, c in got}) > 8


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 200]], "id long")
    got = {r.id: r.component for r in J._components(nodes, links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200}


def test_one_per_group_keeps_clashing_columns(spark):
    rows = [(1, "a b c d e f", "x", 5, "y"), (2, "a b c d e f", "x", 6, "y"), (None, "a b c d e f", "x", 7, "y"), (3, None, "x", 8, None), (3, None, "x", 9, None), (4, "q", None, 1, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string, _id int, _hash string")
    out = J.one_per_group(df)
    assert out.columns == df.columns
    assert sorted(r._id for r in out.collect()) == [1, 5, 7, 8, 9]
    assert J.one_per_group(df.limit(0)).count() == 0
