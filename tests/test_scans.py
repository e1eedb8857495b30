"""Searches by a scan: against brute force, over small blocks, with repeated keys and with more terms than are sent to the tasks."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessellar.functions import text as T
from tessellar.operators import retrieval, scans
from test_indexes import ASKED, asked_terms, brute_bm25, made


@pytest.mark.parametrize("pairs", [scans.PAIRS, 1])
def test_scan_against_brute_force(spark, monkeypatch, pairs):
    monkeypatch.setattr(scans, "PAIRS", pairs)
    monkeypatch.setattr(scans, "CELLS", 40)
    monkeypatch.setattr(scans, "TOKENS", 100)
    rows = made(300) + [(900 + i, "w1 w2 w9") for i in range(30)] + [(800, None), (801, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    terms = asked_terms(spark, ASKED)
    assert {tuple(r) for r in retrieval.bm25_top(docs, terms, 5).select("query", "doc_id", "score", "rank").collect()} == brute_bm25(rows, ASKED, 5)
    held = {(q, i) for q, ts in ASKED.items() for i, t in rows if set(ts) <= set((t or "").split())}
    assert {tuple(r) for r in retrieval.matching(docs, terms).collect()} == held
    folded = asked_terms(spark, {q: [t.upper() for t in ts] for q, ts in ASKED.items()})
    got = retrieval.match_folded(docs, folded.groupBy("query").agg(F.array_join(F.collect_list("term"), " ").alias("term")))
    assert {tuple(r) for r in got.collect()} == held


def test_rows_of_one_key_are_one_document(spark):
    docs = spark.createDataFrame([(1, "red green"), (1, "blue"), (2, "red"), (None, "red blue"), (3, None)], "doc_id long, text string")
    terms = asked_terms(spark, {7: ["red", "blue"]})
    assert {tuple(r) for r in retrieval.matching(docs, terms).collect()} == {(7, 1), (7, None)}
    assert [r["doc_id"] for r in retrieval.bm25_top(docs, terms, 5).orderBy("rank").collect()] == [1, 2]


def test_pairs_of_queries_and_documents_are_not_shuffled(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    plan = retrieval.matching(docs, asked_terms(spark, {i: ["a", "b"] for i in range(40)}))._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_text_keys(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "y")], "doc_id string, text string")
    terms = spark.createDataFrame([("q", "x"), ("q", "y")], "query string, term string")
    assert [r["doc_id"] for r in retrieval.bm25_top(docs, terms, 2).orderBy("rank").collect()] == ["a", "b"]


def brute_tfidf(rows, k):
    """Rows of one key, or of none, are one document; all rows count."""
    lists = {}
    for i, t in rows:
        lists.setdefault(i, []).extend((t or "").lower().split())
    df, out = Counter(w for ws in lists.values() for w in set(ws)), set()
    for i, ws in lists.items():
        w = {t: n * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, n in Counter(ws).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        best = sorted((-math.floor(x / norm * 1e6 + 0.5) / 1e6, t) for t, x in w.items())[:k]
        out |= {(i, t, -s, r) for r, (s, t) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("repeated", [False, True])
def test_tfidf_against_brute_force(spark, repeated):
    rows = made(300) + [(900 + i, "w1 w2 W9") for i in range(30)] + [(800, None), (801, ""), (802, "é z \U0001f600 \uffff \U00020000 éa"), (None, "w1 zz")]
    if repeated:
        rows += [(5, "w3 w3 other"), (5, None), (802, "z é"), (None, "zz w4 zz"), (803, ""), (803, None)]
    kept = [(i, t if t is None else "".join(c for c in t if c not in "\U0001f600\uffff")) for i, t in rows]  # neither letters nor digits
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = retrieval.tfidf_terms(docs, 5).select("doc_id", "term", "score", "rank").collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == brute_tfidf(kept, 5)


def test_terms_of_documents_are_not_shuffled(spark):
    docs = spark.range(0, 900, 1, 3).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c d e x"), F.col("id") % 10).alias("text"))
    top = retrieval.tfidf_terms(docs, 2)
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(doc_id" not in plan
    blocks = scans.in_blocks(docs, "doc_id", T.tokens(F.col("text")))
    assert blocks.agg(F.sum(F.size("words")), F.sum(F.size("keys"))).first()[:] == (45, 900)  # 15 words in each of 3 blocks, of 5400 terms of documents
    assert top.count() == 1800


def test_tfidf_of_nothing(spark):
    docs = spark.createDataFrame([("a", None), ("b", " ")], "doc_id string, text string")
    assert retrieval.tfidf_terms(docs, 2).collect() == [] and retrieval.tfidf_terms(docs.limit(0), 2).collect() == []
