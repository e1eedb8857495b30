"""Queries over kept indexes: each writes its index in the shared folder, searches it, and removes it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, retrieval
from ..operators.lexical_index import LexicalIndex
from ..operators.vector_index import VectorIndex
from ..session import cut, new_path, remove
from .queries import _KNN, _TERMS2, ORACLES, TOKENS, _t, _terms, query


def _kept(spark: SparkSession, kind: str, use: Callable[[str], DataFrame]) -> DataFrame:
    """The stored result of what uses an index at a path of its own."""
    path = new_path(spark, kind)
    try:
        return cut(use(path))
    finally:
        remove(spark, path)


def _lexical(spark: SparkSession, d: str, search: Callable[[LexicalIndex], DataFrame], merged: bool = False) -> DataFrame:
    """A search of all documents, which came into the index as three batches."""

    def use(path: str) -> DataFrame:
        index, docs = LexicalIndex(spark, path), _t(spark, d, "documents")
        for n in range(3):
            index.append(docs.filter(F.pmod(F.col("doc_id"), F.lit(3)) == n), n + 1)
        if merged:
            index.merge()
        return search(index)

    return _kept(spark, "lexical", use)


@query(ORACLES["bm25_topn"])
def kept_bm25_topn(spark, d):
    return _lexical(spark, d, lambda index: index.search(_terms(spark, d), 10))


@query(ORACLES["lexical_and_match"])
def kept_and_match(spark, d):
    return _lexical(spark, d, lambda index: index.match_all(_terms(spark, d)), merged=True)


@query(f"""WITH d AS (SELECT doc_id, ' ' || array_to_string({TOKENS}, ' ') || ' ' AS t FROM documents), p AS (SELECT item_id AS query, ' ' || array_to_string({TOKENS}, ' ') || ' ' AS t FROM benchmark WHERE len({TOKENS}) > 0)
SELECT query, doc_id FROM p JOIN d ON contains(d.t, p.t)""")
def phrase_match(spark, d):
    phrases = _t(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("phrase"))
    return _lexical(spark, d, lambda index: index.match_phrases(phrases))


def _vectors(spark: SparkSession, d: str, probes: int | None) -> DataFrame:
    e = _t(spark, d, "embeddings")
    queries = e.join(_t(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").withColumnRenamed("vec_id", "query")

    def use(path: str) -> DataFrame:
        index = VectorIndex(spark, path)
        index.build(e.filter("vec_id % 3 > 0"))
        index.append(e.filter("vec_id % 3 = 0"), 1)
        return index.search(queries, 20, probes)

    return _kept(spark, "vectors", use)


@query(f"WITH {_KNN} SELECT query, vec_id, sim, CAST(rank AS INTEGER) AS rank FROM sem")
def kept_knn_all_cells(spark, d):
    """All cells are asked, so the result is exact."""
    return _vectors(spark, d, 1 << 20)


@query()
def kept_knn(spark, d):
    """As many cells as the index found to be needed: approximate, see the tests for its recall."""
    return _vectors(spark, d, None)


#: Cosines of the vectors of two sides' turns, rounded, and the greedy pairs of each conversation.
_VECTOR_PAIRS = """st AS (SELECT conv_id AS key, turn, role, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM conversations JOIN embeddings ON vec_id = (conv_id * 7 + turn) % 500),
sp AS (SELECT a.key, a.turn AS i, b.turn AS j, round(list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)), 6) AS sim FROM st a JOIN st b ON a.key = b.key AND a.role = 'assistant' AND b.role = 'user'),
op AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sim DESC, i, j) AS n FROM sp WHERE sim >= 0.02),
g AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS ui, CAST([] AS BIGINT[]) AS uj FROM op UNION ALL
SELECT g.key, op.n, CASE WHEN list_contains(ui, i) OR list_contains(uj, j) THEN ui ELSE list_append(ui, i) END, CASE WHEN list_contains(ui, i) OR list_contains(uj, j) THEN uj ELSE list_append(uj, j) END FROM g JOIN op ON op.key = g.key AND op.n = g.n + 1)
SELECT op.key, i, j, sim FROM g JOIN op ON op.key = g.key AND op.n = g.n + 1 WHERE NOT list_contains(ui, i) AND NOT list_contains(uj, j)"""


@query(f"WITH RECURSIVE {_VECTOR_PAIRS}")
def vector_step_match(spark, d):
    """Turns of two sides, matched by the cosines of vectors that stand for them."""
    steps = _t(spark, d, "conversations").withColumn("vec_id", (F.col("conv_id") * 7 + F.col("turn")) % 500).join(_t(spark, d, "embeddings"), "vec_id")
    side = lambda role, name: steps.filter(F.col("role") == role).select(F.col("conv_id").alias("key"), F.col("turn").alias(name), F.col("embedding").alias("vector"))
    return metrics.greedy_match(metrics.vector_pairs(side("assistant", "i"), side("user", "j")).withColumn("sim", F.round("sim", 6)), 0.02)


_BEST = f"""{_TERMS2}, ln AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY 1), st AS (SELECT count(*) AS docs, avg(len) AS mean FROM ln), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT query, doc_id, round(sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 5) AS score FROM tf JOIN q USING (term) JOIN df USING (term) JOIN ln USING (doc_id), st GROUP BY 1, 2),
r AS (SELECT query, doc_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS n FROM s)"""


@query(f"""WITH {_BEST}, g AS (SELECT item_id // 4 AS topic, min(CASE WHEN n <= 50 AND doc_id % 4 = 0 THEN n - 1 END) AS rank FROM benchmark LEFT JOIN r ON r.query = item_id GROUP BY 1)
SELECT topic, CAST(rank AS INTEGER) AS rank FROM g""")
def least_rank_of_queries(spark, d):
    """Several queries a topic: the least rank, from 0, at which any of them finds what is wanted; null where all miss."""
    hits = retrieval.bm25_top(_t(spark, d, "documents"), _terms(spark, d), 50)
    asked = _t(spark, d, "benchmark").select(F.floor(F.col("item_id") / 4).alias("topic"), F.col("item_id").alias("query"))
    return retrieval.least_ranks(asked, hits.filter("doc_id % 4 = 0"), "topic")
