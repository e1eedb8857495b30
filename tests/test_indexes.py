"""Kept indexes, word pairs, stems, and large arrays of JSON."""

import json
import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellar.functions import stemming
from tessellar.operators import lexical_index, retrieval
from tessellar.operators.lexical_index import LexicalIndex
from tessellar.operators.vector_index import VectorIndex
from tessellar.sources import json_arrays

DOC = "doc_id long, text string, term string, tf int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOC)


def made(n, seed=1, words=60):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{min(int(rng.expovariate(0.12)), words)}" for _ in range(rng.randint(0, 40)))) for i in range(n)]


def brute_bm25(rows, asked, k):
    lists = {i: (t or "").split() for i, t in rows if (t or "").split()}
    mean = sum(map(len, lists.values())) / len(lists)
    df = Counter(w for ws in lists.values() for w in set(ws))
    out = set()
    for q, terms in asked.items():
        scores = []
        for i, ws in lists.items():
            c = Counter(ws)
            s = sum(math.log((len(lists) - df[t] + 0.5) / (df[t] + 0.5) + 1) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for t in set(terms) if c[t])
            if s:
                scores.append((-round(s, 5), i))
        out |= {(q, i, -s, n + 1) for n, (s, i) in enumerate(sorted(scores)[:k])}
    return out


def asked_terms(spark, asked):
    return spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "query long, term string")


ASKED = {1: ["w0", "w3"], 2: ["w9"], 3: ["w1", "w1", "w40", "never"], 4: ["never"], 5: ["w0", "w1", "w2"]}


def test_kept_index_grows_and_merges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical_index, "BLOCK", 16)
    rows = [*made(400), (1000, None), (1001, ""), (None, "w0 w3")]
    index, terms = LexicalIndex(spark, str(tmp_path / "index")), asked_terms(spark, ASKED)
    assert index.search(terms, 5).collect() == [] and index.match_all(terms).collect() == [] and index.generation == 0
    for n in range(3):
        index.append(docs(spark, [r for r in rows if (r[0] or 0) % 3 == n]), n + 1)
    index.append(docs(spark, rows[:50]), 7)  # known already
    want = brute_bm25([r for r in rows if r[0] is not None], ASKED, 5)
    found = lambda: {tuple(r) for r in index.search(terms, 5).collect()}
    assert found() == want
    index.append(docs(spark, [r for r in rows if (r[0] or 0) % 3 == 1]), 2)  # runs again
    assert found() == want
    every = {(q, i) for q, ts in ASKED.items() for i, t in rows if i is not None and set(ts) <= set((t or "").split())}
    assert {tuple(r) for r in index.match_all(terms).collect()} == every
    index.merge()
    assert index.generation == 1 and found() == want and {tuple(r) for r in index.match_all(terms).collect()} == every
    index.append(docs(spark, [(5000, "w9 w9 w9")]), 1)
    assert found() == brute_bm25([*[r for r in rows if r[0] is not None], (5000, "w9 w9 w9")], ASKED, 5)


def test_search_skips_blocks(spark, tmp_path, monkeypatch):
    """Blocks without a document that could be among the first k are left out, and nothing is lost by it."""
    monkeypatch.setattr(lexical_index, "BLOCK", 8)
    rows = [(i, "rare " * (9 if i % 97 == 0 else 1) + f"filler {i} " * 20) for i in range(800)]
    index, asked = LexicalIndex(spark, str(tmp_path / "index")), {1: ["rare"]}
    index.append(docs(spark, rows), 1)
    bounds, weighted, share = index.bounds(asked_terms(spark, asked))
    _, later = index.choose(bounds, weighted, share, 3)
    assert bounds.count() > 60 and later.count() < bounds.count() / 4
    assert {tuple(r) for r in index.search(asked_terms(spark, asked), 3).collect()} == brute_bm25(rows, asked, 3)


def test_phrases_by_places(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))) for i in range(150)]
    index = LexicalIndex(spark, str(tmp_path / "index"))
    index.append(docs(spark, rows[:70]), 1)
    index.append(docs(spark, rows[70:]), 2)
    phrases = [(n, " ".join(rng.choice("ABc") for _ in range(rng.randint(1, 5)))) for n in range(25)] + [(50, "a a a"), (51, None), (52, "a z")]
    got = index.match_phrases(spark.createDataFrame(phrases, "query long, phrase string")).collect()
    assert sorted(map(tuple, got)) == sorted((q, i) for q, p in phrases if p for i, t in rows if f" {p.lower()} " in f" {t} ")


def test_word_pairs_are_linear(spark):
    assert spark.createDataFrame([("Red fox the x runs",), ("one",), (None,)], "t string").select(retrieval.grams(F.col("t"), 3)).collect()[0][0] == ["red", "fox", "runs", "red fox", "fox runs", "red fox runs"]
    text = " ".join(f"word{i % 977}" for i in range(20_000))
    one = spark.createDataFrame([(text,)], "t string").select(F.size(retrieval.grams(F.col("t"))).alias("n"))
    one.collect()
    began = time.time()
    assert one.first()["n"] == 39_999 and time.time() - began < 5


def unit(n, dims, seed):
    v = np.random.default_rng(seed).normal(size=(n, dims))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def vectors(spark, v, first=0, name="vec_id"):
    return spark.createDataFrame([(first + i, x.tolist()) for i, x in enumerate(v)], f"{name} long, embedding array<double>")


@pytest.mark.parametrize(("rows", "pack", "packs"), [(2048, 512, 64), (7, 3, 2)])
def test_exact_nearest(spark, monkeypatch, rows, pack, packs):
    for name, value in (("ROWS", rows), ("PACK", pack), ("PACKS", packs)):
        monkeypatch.setattr(retrieval, name, value)
    v = unit(120, 6, 1)
    odd = spark.createDataFrame([(900, None), (901, []), (902, [None] * 6), (903, [1.0, 2.0]), (None, [1.0] * 6)], "vec_id long, embedding array<double>")
    queries = vectors(spark, v[:25], name="query").union(spark.createDataFrame([(77, None)], "query long, embedding array<double>"))
    got = {(r["query"], r["rank"]): (r["vec_id"], round(r["sim"], 6)) for r in retrieval.knn(vectors(spark, v).union(odd), queries, 4).collect()}
    want = {}
    for q in range(25):
        for n, (s, i) in enumerate(sorted((-round(float(v[q] @ x), 6), i) for i, x in enumerate(v))[:4]):
            want[q, n + 1] = (i, -s)
    assert {k: x[0] for k, x in got.items()} == {k: x[0] for k, x in want.items()} and all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def test_kept_vector_index(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = unit(40, 24, 2)
    v = centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 24)) * 0.12
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    index = VectorIndex(spark, str(tmp_path / "index"))
    index.build(vectors(spark, v[:2000]))
    index.append(vectors(spark, v[2000:], first=2000), 1)
    index.append(vectors(spark, v[2000:], first=2000), 1)  # runs again
    queries = vectors(spark, v[:200], name="query")
    exact = {(q, i) for q in range(200) for i in np.argsort(-np.round(v @ v[q], 6), kind="stable")[:10].tolist()}
    found = {(r["query"], r["vec_id"]) for r in index.search(queries, 10).collect()}
    assert len(found & exact) >= 0.9 * len(exact) and index.touched(queries) < 0.35
    every = {(r["query"], r["vec_id"]) for r in index.search(queries, 10, probes=10_000).collect()}
    assert every == exact and index.touched(queries, 10_000) == 1
    none = VectorIndex(spark, str(tmp_path / "none"))
    none.build(vectors(spark, v[:0].reshape(0, 24)))
    assert none.search(queries, 3).collect() == []


# the examples that the published rules give
EXAMPLES = {"caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "vileli": "vile", "hopefulness": "hope", "formaliti": "formal", "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "homologous": "homolog", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil"}


def test_stems_and_folding(spark):
    df = spark.createDataFrame([(w,) for w in [*EXAMPLES, "is", "naïve", "h2o"]] + [(None,)], "w string").withColumn("s", stemming.stems(F.col("w")))
    got = {r["w"]: r["s"] for r in df.collect()}
    assert got == {**EXAMPLES, "is": "is", "naïve": "naïve", "h2o": "h2o", None: None}
    assert stemming.fold("Ångström Đà Nẵng ÉÈ") == "angstrom đa nang ee"
    rows = docs(spark, [(1, "The cells were incubated at Ångström scale"), (2, "incubating a cell, angstroms"), (3, "nothing")])
    terms = spark.createDataFrame([(7, "Incubate"), (7, "cells"), (8, "ANGSTRÖM")], "query long, term string")
    assert sorted(map(tuple, retrieval.match_folded(rows, terms, stem=True).collect())) == [(7, 1), (7, 2), (8, 1), (8, 2)]
    assert sorted(map(tuple, retrieval.match_folded(rows, terms).collect())) == [(8, 1)]


def records(n, seed=1):
    rng = random.Random(seed)
    odd = ["}{", "][", '"', "\\", ",", "a\\\"b", "ü漢", "\n", "\\\\", "{\"id\": 1},"]
    return [{"id": i, "t": "".join(rng.choice(odd) for _ in range(rng.randint(0, 12))), "deep": {"x": [rng.choice([1, [2, {"y": "]}"}]])]}} for i in range(n)]


@pytest.mark.parametrize(("indent", "most"), [(None, "300b"), (2, "1k"), (None, "128m")])
def test_large_arrays(spark, tmp_path, monkeypatch, indent, most):
    monkeypatch.setattr(json_arrays, "CHUNK", 64)
    want = [*records(300), {"id": 1000, "t": "x" * 5000, "deep": None}, *records(3, 2)]
    (tmp_path / "a.json").write_text("  " + json.dumps(want, indent=indent) + "\n")
    (tmp_path / "b.json").write_text(json.dumps([{"id": -1, "t": "}", "deep": None}, 5, "text}", [1]], ensure_ascii=False))
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        read = json_arrays.read_array(spark, str(tmp_path / "*.json"), "id long, t string")
        assert sorted(map(tuple, read.collect())) == sorted((r["id"], r["t"]) for r in [*want, {"id": -1, "t": "}"}])
        if most != "128m":
            assert spark.read.option("lineSep", "}").text(str(tmp_path / "a.json")).rdd.getNumPartitions() > 10
        with pytest.raises(Exception, match="malformed element"):
            json_arrays.read_array(spark, str(tmp_path / "b.json"), "id long, t string", strict=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_blocks_are_made_where_documents_lie(spark, tmp_path):
    """No text is shuffled, keys that come again count once, and small blocks are put together by a merge."""
    index, words = LexicalIndex(spark, str(tmp_path / "index")), spark.range(40).select(F.col("id").alias("doc_id"), F.array(F.lit("a"), F.lit("b"), F.lit("a")).alias("words"))
    made_ = index._blocks(words)
    assert "Exchange" not in made_._jdf.queryExecution().toString()
    row = made_.filter("term = 'a'").first()
    assert row["max_tf"] == 2 and row["min_len"] == 3 and row["n"] == len(row["keys"]) and row["places"][0] == [0, 2]
    for n in (1, 2):
        index.append(docs(spark, [(n, "a b"), (n, "a b"), (1, "a c"), (n + 10, "b a")]).repartition(4), n)
    index.merge()
    kept = index._read("postings")
    assert kept.filter("bucket >= 0").select("part").distinct().count() == 1 and kept.filter("term = 'b'").select(F.sort_array("keys")).first()[0] in ([1, 2, 11, 12], [2, 11, 12])
    assert sorted(r["doc_id"] for r in index._read("docs").collect()) == [1, 2, 11, 12]


def test_commonest_grams_and_keywords_of_repeated_keys(spark):
    words = [f"w{i * i % 23}" for i in range(400)]
    rows = [(k % 7 or None, " ".join(words[k * 5 : k * 5 + k % 40])) for k in range(60)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    of, all_ = {}, Counter()
    for key, text in rows:
        w = (text or "").split()
        of.setdefault(key, Counter()).update(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])
    for c in of.values():
        all_.update(c)
    for features in (5, 30, 10_000):
        first = sorted(all_.items(), key=lambda x: (-x[1], x[0]))[:features]
        assert sorted(map(tuple, retrieval.commonest_grams(docs, features, buckets=16).collect())) == sorted(first)
        kept, want = dict(first), []
        for key, c in of.items():
            w = {t: tf * (math.log((1 + len(rows)) / (1 + sum(t in o for o in of.values()))) + 1) for t, tf in c.items() if t in kept}
            norm = math.sqrt(sum(x * x for x in w.values()))
            want += [(key, t, s, i) for i, (s, t) in enumerate(sorted(((round(x / norm, 6), t) for t, x in w.items()), key=lambda x: (-x[0], x[1]))[:4], 1)]
        got = [tuple(r) for r in retrieval.keyword_queries(docs, 4, features=features).select("doc_id", "term", "score", "rank").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
