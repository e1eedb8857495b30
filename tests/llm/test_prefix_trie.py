"""The prefix trie against brute force."""

import hashlib
import random
import re
import zlib

import pytest

from tessellar.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, n long, key string, place int, depth int, a int, last string"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def brute(rows):
    """Nodes as tuples of the first turns of the rebuilt conversations."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            key = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, key, (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    members, out = {}, {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], set()).add(c)
    for node, of in members.items():
        kids = [x for x in members if len(x) == len(node) + 1 and x[: len(node)] == node]
        below = [x for x in members if x[: len(node)] == node]
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members) for x in below)
        saved = sum((len(members[x]) - 1) * words(x[-1][1]) for x in below if x)
        ends = ",".join(str(c) for c in sorted(c for c in of if built[c] == node))
        out[min(of), len(node)] = (min(members[node[:-1]]) if node else None, len(of), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, 3, 4, "l") for r in rows], SCHEMA)


def nodes(spark, rows):
    got = prefix_trie.report(table(spark, rows)).collect()
    out = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in got}
    assert len(out) == len(got)
    return out


def made(seed, conversations, most=5, kinds=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(conversations * 2), conversations):
        for t in range(rng.randint(1, most)):
            rows.append((c, t, rng.choice(["user", "assistant"]), f"w {rng.randrange(kinds)} x"))
    return rows


@pytest.mark.parametrize(("hot", "rounds", "piece"), [(10_000, 12, 8192), (3, 12, 2), (10_000, 0, 8192), (3, 1, 3)])
def test_trie(spark, monkeypatch, hot, rounds, piece):
    monkeypatch.setattr(prefix_trie, "HOT", hot)
    monkeypatch.setattr(prefix_trie, "ROUNDS", rounds)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rows = made(3, 90) + [(400, None, None, None), (400, 1, "user", ""), (400, 1, "user", ""), (401, 5, None, "late"), (401, None, "user", "first"), (None, 1, "user", "lost"), (-7, 0, "user", "w 1 x"), (-3, 1, "a", "b")]
    rows += [(c, t, "user", "same words here") for c in range(500, 560) for t in range(3)]  # a group of copies
    assert nodes(spark, rows) == brute(rows)


def test_paths_below_paths(spark, monkeypatch):
    """Each conversation leaves the longest one a turn later and has a smaller id than what is below: as many paths in a row as turns."""
    monkeypatch.setattr(prefix_trie, "ROUNDS", 3)
    rows = [(20 * k, t, "user", f"turn {t}" if t < k else f"own {k}") for k in range(1, 15) for t in range(k + 1)]
    assert nodes(spark, rows) == brute(rows)


def test_unequal_borders_and_long_texts(spark):
    """Role and text don't run into each other; long texts and emptied conversations."""
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, "user", "word " * 300_000), (20, 0, "user", "x"), (21, 0, "user", "y"), (22, 0, "user", "z"), (23, 0, "user", "z")]
    got = nodes(spark, rows)
    assert got == brute(rows) and got[1, 0][1] == 7


def test_empty(spark):
    assert nodes(spark, []) == {} and nodes(spark, [(None, 1, "user", "x")]) == {}
