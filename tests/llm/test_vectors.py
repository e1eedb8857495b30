"""Searches over vectors against brute force."""

import numpy as np
import pytest

from tessellar.llm import permutation, queries, topk, vectors

SCHEMA = "vec_id long, embedding array<float>, block int, pack int, v string, rank int, leader int, at long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "v", 3, 4, 5) for i, v in rows], SCHEMA)


def unit(n, d, seed=8):
    e = np.random.default_rng(seed).normal(size=(n, d))
    return (e / np.linalg.norm(e, axis=1, keepdims=True)).astype(np.float32)


ODD = [(900, None), (920, []), (940, [float("nan")] * 16), (960, [0.0] * 16), (980, [1.0, None] * 8), (981, [1.0] * 3)]


def brute(rows, score, k=20):
    """Rows of (query, rank, id, score); a query's vector is the least of its id's."""
    ids, e = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = []
    for q in sorted({int(i) for i in ids if i % 20 == 0}):
        own = min(tuple(v) for v in e[ids == q])
        s = score(e, np.array(own))
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out += [(q, n + 1, int(ids[j]), float(s[j])) for n, j in enumerate(order)]
    return out


def dealt(spark, rows):
    return [(i, [float(x) for x in v]) for i, v in rows]


@pytest.mark.parametrize("kind", ["spread", "ties and repeats", "few"])
def test_exact_top_k(spark, kind):
    if kind == "spread":
        rows = list(enumerate(unit(700, 16)))
    elif kind == "few":
        rows = list(enumerate(unit(9, 16))) + [(40, unit(1, 16, 3)[0])]
    else:
        rng = np.random.default_rng(2)
        rows = [(int(i), (rng.integers(-1, 2, 16) / 64).astype(np.float32)) for i in rng.integers(0, 120, 500)] + [(20, np.full(16, 0.5, np.float32))] * 60
    rows = dealt(spark, rows)
    df = table(spark, rows + ODD + [(None, rows[0][1])])
    got = topk.search(r := topk.quantised(vectors.usable(df, zeros=True)), queries._each_twentieth(r)).collect()
    want = brute(rows + [(960, [0.0] * 16)], lambda e, q: np.floor(64 * e) @ np.floor(64 * q))
    assert sorted(map(tuple, got)) == sorted(want)


def test_bounds_prune_clusters(spark):
    rng = np.random.default_rng(5)
    centres = unit(30, 16, 4) * 8
    v = np.floor(64 * np.concatenate([c + rng.normal(size=(60, 16)) * 0.05 for c in centres]))
    ids = np.arange(len(v))
    out, left = topk.scored(ids, v, ids[:5], v[:5], np.full(5, -np.inf), 10)
    assert left > 0.5 * 5 * len(v) / topk.RANGE
    for i, at, s in out:
        order = [j for j in np.lexsort((ids, -(v @ v[i]))) if j != i][:10]
        assert at.tolist() == order and s.tolist() == (v @ v[i])[order].tolist()
    blocks = [v[k : k + 60] for k in range(0, len(v), 60)]
    b = topk.bounds(np.array([x.max(0) for x in blocks]), np.array([x.min(0) for x in blocks]), v[:5])
    kth = np.array([s[-1] for _, _, s in out])
    assert (b >= kth[:, None]).any(axis=0).sum() < 10  # blocks that are sent to these queries
    df = table(spark, dealt(spark, [(int(i), x / 64) for i, x in enumerate(v)]))
    r = topk.quantised(vectors.usable(df, zeros=True))
    want = brute([(int(i), x / 64) for i, x in enumerate(v)], lambda e, q: np.floor(64 * e) @ np.floor(64 * q))
    assert sorted(map(tuple, topk.search(r, queries._each_twentieth(r)).collect())) == sorted(want)


def test_one_leader_has_all_rows(spark, monkeypatch):
    """All vectors but one point the same way: their leader's blocks share the first pass, and nothing is lost."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 50)
    monkeypatch.setattr(topk, "LEADERS", 2)
    v = unit(600, 16, 9) * 0.05 + np.eye(16, dtype=np.float32)[0]
    v[3] = -np.eye(16, dtype=np.float32)[0]
    rows = dealt(spark, enumerate(v))
    r = topk.quantised(vectors.usable(table(spark, rows), zeros=True))
    want = brute(rows, lambda e, q: np.floor(64 * e) @ np.floor(64 * q))
    assert sorted(map(tuple, topk.search(r, queries._each_twentieth(r)).collect())) == sorted(want)


def test_permutation_recall_and_cases(spark):
    """Under a fifth of 21,000 vectors is ranked anew for a query; ids that repeat, ties and odd vectors as stated."""
    e = unit(21_000, 24)
    e[5000:5040] = e[40]  # equal vectors: ties to the smaller id
    rows = dealt(spark, enumerate(e))
    df = table(spark, rows + [(x, v and v[:16]) for x, v in ODD] + [(None, rows[0][1]), (60, rows[61][1])])
    r = vectors.usable(df, zeros=False)
    got = {}
    for x in permutation.search(r, queries._each_twentieth(r)).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    e = e.astype(float)
    hits = total = 0
    for q in range(0, 21_000, 200):
        s = e @ e[q]
        found = sorted(got[q])
        assert [n for n, _, _ in found] == list(range(1, 21)) and q not in {i for _, i, _ in found}
        assert all(abs(s[i] - x) < 1e-12 for _, i, x in found if i != 60) and [(-x, i) for _, i, x in found] == sorted((-x, i) for _, i, x in found)
        best = [j for j in np.lexsort((np.arange(len(s)), -s)) if j != q][:20]
        hits += len({i for _, i, _ in found} & set(best))
        total += 20
    assert hits / total >= 0.9 and permutation.RERANKED < 0.2 and permutation.LISTED < permutation.PIVOTS / 4
    assert [i for _, i, _ in sorted(got[40])] == list(range(5000, 5020))


def test_empty_tables(spark):
    e = vectors.usable(table(spark, []), zeros=False)
    assert permutation.search(e, vectors.one_per_id(e)).collect() == topk.search(e, vectors.one_per_id(e)).collect() == []
