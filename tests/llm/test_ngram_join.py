"""The n-gram join against brute force."""

import re

import numpy as np
import pytest

from tessellar.llm import neardup, ngram_join

SCHEMA = "doc_id long, text string, h long, rep long, lead long, key string, n long, comp long, prefix string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, "k", 4, 5, "p") for i, t in rows], SCHEMA)


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def brute(rows, shingle, percent):
    sets = []
    for i, t in rows:
        w = words(t)
        m = min(shingle, len(w))
        sets.append((i, {tuple(w[j : j + m]) for j in range(len(w) - m + 1)} if w else set()))
    parent = {i: i for i, _ in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, s) in enumerate(sets):
        for j, t in sets[x + 1 :]:
            if i is not None and j is not None and i != j and s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=str)


def found(spark, rows, shingle=4, percent=85):
    return sorted((tuple(r) for r in ngram_join.report(docs(spark, rows), shingle, percent).collect()), key=str)


def made(n, seed=0, vocabulary=400):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{x}" for x in rng.integers(0, vocabulary, rng.integers(1, 80))) for _ in range(n)]


def mutated(seed, k, size, most):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(k):
        own = [f"m{j}" for j in range(size)]
        for at in rng.choice(size, 1 + i % most, replace=False):
            own[at] = f"x{i % 7}"
        rows.append(" ".join(own[: size - i % 20]))
    return rows


@pytest.mark.parametrize(("held", "tokens", "block", "shingle", "percent", "buckets"), [(32 << 20, 8, 256, 4, 85, 1 << 21), (100, 1, 5, 4, 85, 1 << 10), (32 << 20, 0, 5, 5, 80, 1 << 10), (32 << 20, 1, 256, 2, 60, 1 << 21)])
def test_join(spark, monkeypatch, held, tokens, block, shingle, percent, buckets):
    """Whether or not neighbours are met before, the join proper finds every link."""
    monkeypatch.setattr(neardup, "HELD_BYTES", held)
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "COPIES", 2 if block == 5 else 10_000)
    monkeypatch.setattr(ngram_join, "TOKENS", tokens)
    monkeypatch.setattr(ngram_join, "BUCKETS", buckets)
    base = made(30, 5, 5000)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t) for i, t in enumerate(base)] + [(200 + i, t + " extra") for i, t in enumerate(base)]
    rows += [(300, None), (301, ""), (302, "one"), (303, "ONE"), (304, "one two"), (None, base[0]), (5, base[5]), (305, " \t "), (306, "one two")]
    rows += [(400 + i, t) for i, t in enumerate(mutated(9, 60, 200, 9))]
    passage = " ".join(f"p{i}" for i in range(40))  # one that many documents share, too little of each to link them
    rows += [(500 + i, f"{t} {passage}") for i, t in enumerate(made(25, 11, 5000))]
    assert found(spark, rows, shingle, percent) == brute(rows, shingle, percent)


def test_groups_of_equal_prefix(spark, monkeypatch):
    """Sets of the same size whose first shingles are the same, but not the others: one group, not one component."""
    monkeypatch.setattr(ngram_join, "TOKENS", 0)
    same = [f"r{i}" for i in range(60)]
    rows = []
    for i in range(12):
        rows.append((i, " ".join([*same, *(f"c{j}" for j in range(40))])) if i % 3 == 0 else (i, " ".join([*same, *(f"d{j}" if i % 3 == 1 else f"e{(j * 7) % 40}" for j in range(40))])))
    for i in range(300):  # makes the later words common
        rows.append((1000 + i, " ".join([*(f"{x}{j}" for x in "cd" for j in range(40)), f"end{i} own{i}"])))
    assert found(spark, rows) == brute(rows, 4, 85)


def test_prefixes_and_bitmaps_lose_nothing():
    rng = np.random.default_rng(1)
    for percent in (60, 85, 90):
        sides = ngram_join.Bitmaps(percent)
        for _ in range(300):
            n = int(rng.integers(1, 300)) if rng.random() < 0.7 else int(rng.integers(2000, 9000))
            x = np.unique(rng.integers(0, 1 << 62, n, np.uint64))
            y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.uniform(0.5, 1)], rng.integers(0, 1 << 62, int(rng.integers(0, 1 + n // 4)), np.uint64)]))
            both, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
            linked = 100 * both >= percent * union
            maps = np.array([ngram_join._bitmap(s) for s in (x, y)], object)
            est, enough = sides.estimate(maps[:1], maps[1:], np.array([len(x)]), np.array([len(y)]))
            assert est[0] >= both / max(1, union) - 1e-12 and (enough[0] or not linked)
            assert sides.comparing(maps, np.array([len(x), len(y)]))(0, np.array([1]))[0] == enough[0]
            if linked and len(y):
                small, large = sorted((x, y), key=len)
                assert set(small[: sides.index_prefix(len(small))].tolist()) & set(large[: sides.prefix(len(large))].tolist())


def test_empty_table_and_long_text(spark):
    assert found(spark, []) == [] and found(spark, [(1, None)]) == [(1, 0, 1)]
    long = " ".join(f"w{i}" for i in range(150_000))
    assert found(spark, [(1, long), (2, long + " end"), (3, "other")]) == [(1, 149_997, 1), (2, 149_998, 1), (3, 1, 3)]
