"""Near duplicates against brute force."""

import math
import re

import numpy as np
import pytest

from tessellar.llm import neardup

SCHEMA = "doc_id long, text string, lang string, key string, blk string, fp string, comp string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "x", "y", "z", "c") for i, t in rows], SCHEMA)


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def made(n, seed=0, vocabulary=400):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{x}" for x in rng.integers(0, vocabulary, rng.integers(1, 80))) for _ in range(n)]


@pytest.mark.parametrize(("held", "crowded", "shingle", "percent"), [(32 << 20, 1024, 3, 85), (100, 1024, 3, 85), (32 << 20, 6, 3, 85), (32 << 20, 6, 5, 80), (100, 6, 5, 80)])
def test_near_duplicates(spark, monkeypatch, held, crowded, shingle, percent):
    monkeypatch.setattr(neardup, "HELD_BYTES", held)
    monkeypatch.setattr(neardup, "CROWDED", crowded)
    monkeypatch.setattr(neardup, "BLOCK", max(5, crowded // 4))
    monkeypatch.setattr(neardup, "COPIES", 2 if crowded == 6 else 10_000)
    base = made(40, 5, 5000)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t) for i, t in enumerate(base)] + [(200 + i, t + " extra") for i, t in enumerate(base)] + [(300, None), (301, ""), (302, "one"), (303, "ONE"), (304, "one two"), (None, base[0]), (5, base[5])]
    long = [f"v{i}" for i in range(400)]
    rows += [(400 + k, " ".join(long[:k] + ["z"] + long[k + 1 :])) for k in range(30)]
    # many alike about the threshold, so regions of several components
    rng = np.random.default_rng(9)
    for k in range(80):
        own = [f"m{i}" for i in range(300)]
        for at in rng.choice(300, 2 + k % 8, replace=False):
            own[at] = f"x{k}"
        rows.append((500 + k, " ".join(own)))
    sets = {}
    for i, t in rows:
        w = words(t)
        m = min(shingle, len(w))
        sets[i] = {tuple(w[j : j + m]) for j in range(len(w) - m + 1)} if w else set()
    parent = {i: i for i in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in parent:
        for j in parent:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = neardup.report(docs(spark, rows), shingle, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert not r["kept"] and r["component_id"] is None
        else:
            assert (r["component_id"], r["n_shingles"]) == (root(r["doc_id"]), len(sets[r["doc_id"]])) and r["kept"] == (r["component_id"] == r["doc_id"])


def test_distinct_keeps_one_row_of_each_text(spark):
    x, y, z = made(3, 12, 5000)
    rows = [(5, x), (5, y), (3, y), (None, z), (None, z), (7, z), (8, "own words"), (8, "own words"), (9, None), (None, "")]
    got = sorted(((r["doc_id"], r["text"]) for r in neardup.distinct(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(5, x), (3, y), (7, z), (8, "own words"), (9, None), (None, "")], key=str)


def test_crowded_regions_lose_no_link(spark, monkeypatch):
    """More classes in a region than a block holds, all of one prefix, that link in chains far apart in the order."""
    monkeypatch.setattr(neardup, "CROWDED", 16)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    n = 150
    labels = [bytes(12)] * n
    trees = spark.createDataFrame([(0, bytearray(x), int(i), int(i)) for i, x in enumerate(labels)], "tree int, label binary, id long, comp long")
    rows = neardup.in_parts(neardup._adapted(trees)).collect()
    parts, met = {}, set()
    for r in rows:
        parts.setdefault(r["key"], []).append(r)
    for of in parts.values():
        blocks = {r["blk"] for r in of}
        assert len(blocks) <= 2 and len(of) <= 6 * 16
        met |= {(min(a["id"], b["id"]), max(a["id"], b["id"])) for a in of for b in of if a["id"] != b["id"] and (len(blocks) == 1 or a["blk"] != b["blk"])}
    assert len(met) == n * (n - 1) // 2 and len(parts) > 20
    split = [bytes(8) + bytes([0, i % 10]) + bytes(2) for i in range(n)]
    trees = spark.createDataFrame([(0, bytearray(x), int(i), int(i)) for i, x in enumerate(split)], "tree int, label binary, id long, comp long")
    assert {len({r["label"][9] for r in of}) for of in _by_key(neardup.in_parts(neardup._adapted(trees)).collect())} == {1}


def _by_key(rows):
    parts = {}
    for r in rows:
        parts.setdefault(r["key"], []).append(r)
    return parts.values()


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_odds_of_a_miss(percent):
    f, p = neardup.Forest(percent), percent / 100
    assert (1 - p**neardup.DEPTH) ** f.trees <= neardup.MISSED and (1 - p**neardup.SHALLOW) ** f.trees < 5e-8
    most = math.floor((f.least * 255 / 256 + 1 / 256) * f.hashes)
    assert sum(math.comb(f.hashes, k) * p**k * (1 - p) ** (f.hashes - k) for k in range(most)) < 1e-7


def test_empty_table_and_long_text(spark):
    assert neardup.report(docs(spark, [])).collect() == []
    long = " ".join(f"w{i}" for i in range(60_000))
    got = {r["doc_id"]: r["component_id"] for r in neardup.report(docs(spark, [(1, long), (2, long + " end"), (3, "other")])).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
