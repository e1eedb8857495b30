"""Language model, toxicity, near duplicates, tokens and searches against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessellar.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, row string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "x", "y") for i, t in rows], SCHEMA)


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def made(n, seed=0, vocabulary=400):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{x}" for x in rng.integers(0, vocabulary, rng.integers(1, 80))) for _ in range(n)]


def test_levenshtein_automaton():
    lexicon = toxicity.Lexicon([("idiot", False), ("abcde", True), ("scum", False)])

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = np.random.default_rng(1)
    for _ in range(3000):
        w = list("idiot")
        for _ in range(rng.integers(0, 3)):
            k = rng.integers(1, len(w))
            w[k : k + rng.integers(0, 2)] = list(rng.choice(list("idotx"), rng.integers(0, 2)))
        w = "".join(w)
        assert lexicon.look(w) == {0: 1, 1: 2}.get(distance(w, "idiot"), 0), w
    assert lexicon.look("abcdexyz") == 1 and lexicon.look("scun") == 0 and lexicon.look("") == 0


def test_edits_at_every_place():
    lexicon = toxicity.Lexicon([("idiot", False), ("moron", True), ("scum", False, True), ("scumbag", False), ("twit", False), ("twitters", False)])
    for term, end in (("idiot", ""), ("moron", "izing"), ("scum", "")):
        for k in range(len(term) + 1):
            edits = [term[:k] + "x" + term[k:], *([term[:k] + term[k + 1 :], term[:k] + "x" + term[k + 1 :]] if k < len(term) else [])]
            for w in edits:
                exact = term == "moron" and w.startswith(term)
                assert lexicon.look(w + end) == (1 if exact else 2), w
        assert lexicon.look("xx" + term[1:]) == 0
    assert lexicon.look("twix") == 0 and lexicon.look("xtwitters") == 2


def test_short_terms_by_measured_precision(spark):
    texts = made(400, 7, 20_000)
    toxic = lambda i: f"scum {chr(97 + i // 4 % 26)}{'scum' if i % 3 else 'cum'}" if i % 8 else "twit"
    rows = [(i, f"{t} {toxic(i)} w1" if i % 4 == 0 else f"{t} twin" if i % 5 == 0 else t) for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs(spark, rows), labels)
    lexicon = toxicity.Lexicon(list(model.entries))
    assert [lexicon.look(w) for w in ("scum", "scun", "cum", "twit", "twin")] == [1, 2, 2, 1, 0]


def test_quotation_and_learning(spark):
    lexicon = toxicity.Lexicon([("idiot", False)])
    assert toxicity.hits(lexicon, "you idiot and idiott") == (1, 1, 0)
    assert toxicity.hits(lexicon, 'it has "an idiot" in it') == (0, 0, 1) == toxicity.hits(lexicon, "he said idiot")
    rng = np.random.default_rng(2)
    rows = [(i, f"{t} idiot x moron" if i % 4 == 0 else t) for i, t in enumerate(made(400, 3))] + [(1000, None), (1001, ""), (None, "idiot moron")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in rng.permutation(400).tolist()] + [(5, None), (None, 1)], "doc_id long, toxic int")
    d = docs(spark, rows)
    got = {r["doc_id"]: r for r in toxicity.judge(d, toxicity.fit(d, labels)).collect()}
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in range(400)) and got[None]["predicted"] == 1 and got[1000]["predicted"] == 0
    assert toxicity.judge(d, toxicity.fit(d, labels.filter("toxic = 3"))).count() == len(rows)


def test_quoted_and_impure_terms_are_learnt(spark):
    texts = made(400, 4, 20_000)
    slur = lambda i: "zorgle" if i % 8 else "blarfy"
    rows = [(i, f"{t} {slur(i)} x" if i % 4 == 0 else t) for i, t in enumerate(texts)]
    rows += [(400 + i, f'{t} "blarfy" w1') for i, t in enumerate(made(6, 5, 20_000))] + [(406 + i, f"{t} zorgle") for i, t in enumerate(made(4, 6, 20_000))]
    labels = spark.createDataFrame([(i, int(i < 400 and i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    assert {e[0] for e in toxicity.learn(docs(spark, rows), labels).entries} >= {"blarfy", "zorgle"}


def test_empty_tables(spark):
    d = docs(spark, [])
    model = toxicity.fit(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.judge(d, model).collect() == toxicity.reject(d, model).collect() == []


def test_long_texts_and_odd_columns(spark):
    lexicon = toxicity.Model((("foulword", False, True),), (-3.0, 4.0, 2.0, 0.5, 1.0))
    rows = [(1, "plain " * 200_000 + "foulword", "l", "s", 1, "f", "r"), (2, None, None, None, None, None, None), (None, "a foulword", "l", "s", 1, "f", "r")]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.judge(spark.createDataFrame(rows, SCHEMA), lexicon).collect()}
    assert got == {1: 1, 2: 0, None: 1}


def planted(seed=11, n=900):
    """Rows of plain words; a third toxic by two terms, some misspelled; ordinary words one edit away; quotations of terms."""
    rng = np.random.default_rng(seed)
    texts, rows = made(n, seed, 20_000), []
    for i, t in enumerate(texts):
        own = {0: "zorgleton blarfium", 1: "zorgletan zorgleton", 2: "zorglton blarfum"}[i // 3 % 3] if i % 3 == 0 else ""
        near = "zorgletov" if i % 3 and i % 7 == 0 else ""  # a word that clean rows use
        said = 'the word "blarfium" here' if i % 3 and i % 11 == 0 else ""
        rows.append((i, " ".join(x for x in (t, near, said, own) if x), int(i % 3 == 0)))
    return rows


def brute_hits(model, text):
    """Exact, misspelled and quoted hits by plain edit distances over all entries."""

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    n = [0, 0, 0]
    low = text.lower()
    for m in re.finditer(r"\w+", low):
        w = m[0]
        starts = lambda t, is_stem: [w[:k] for k in range(len(t) - 1, len(t) + 2) if k <= len(w)] if is_stem else [w]
        exact = any(w.startswith(t) if is_stem else w == t for t, is_stem, _ in model.entries)
        near = any(loose and any(edits(x, t) == 1 for x in starts(t, is_stem)) for t, is_stem, loose in model.entries) and w not in model.plain
        if exact or near:
            n[2 if toxicity._quoted(low, m.start(), m.end()) else 0 if exact else 1] += 1
    return tuple(n)


def test_planted_misspellings_and_quotations(spark):
    """What was planted is learnt, scores follow from plain counts of hits, and each part of the method moves the score."""
    rows = planted()
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    d = docs(spark, [(i, t) for i, t, _ in rows])
    model = toxicity.fit(d, labels)
    assert model.weights[2] > 0 and model.weights[3] > 0 and "zorgletov" in model.plain
    base = "w1 w2 w3"
    new = {"clean": base, "used": f"{base} zorgleton", "misspelled": f"{base} zorglexon", "twice": f"{base} zorglexon blarfixm", "quoted": f'{base} the word "zorgleton" here', "ordinary": f"{base} zorgletov"}
    got = {r["doc_id"]: r for r in toxicity.judge(docs(spark, [*[(i, t) for i, t, _ in rows], *[(5000 + k, t) for k, t in enumerate(new.values())]]), model).collect()}
    score = {name: got[5000 + k]["score"] for k, name in enumerate(new)}
    assert score["clean"] < score["quoted"] < score["used"] and score["clean"] < score["misspelled"] < score["twice"] and score["ordinary"] == score["clean"]
    w = model.weights
    for i, t in [*[(i, t) for i, t, _ in rows], *[(5000 + k, t) for k, t in enumerate(new.values())]]:
        exact, fuzzy, quoted = brute_hits(model, t)
        assert (exact, fuzzy, quoted) == tuple(got[i][c] for c in ("exact", "fuzzy", "quoted")), t
        logit = w[0] + w[1] * math.log1p(exact) + w[2] * math.log1p(fuzzy) + w[3] * math.log1p(quoted) + w[4] * (exact + 0.5 * fuzzy >= 2)
        assert abs(got[i]["score"] - 1 / (1 + math.exp(-logit))) < 1e-9
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["predicted"] == y for i, y in held) >= 0.97 * len(held)
