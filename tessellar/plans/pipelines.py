"""The steps of the retrieval and evaluation pipelines, each with its settings taken from one set of options."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from ..functions import text as T
from ..operators import documents, external, metrics, retrieval
from ..options import Options


def steps(options: Options, text: Column) -> Column:
    """The sentences of a text that are long enough to be steps."""
    return T.steps(text, options.min_steplen)


def queries(options: Options, answer: Column, default: str | None = None) -> Column:
    """The queries of a model's answer, as many as are asked for."""
    return T.query_lines(answer, options.num_queries, default=default)


def keywords(options: Options, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, term: a document's commonest words and word pairs."""
    return retrieval.keywords(docs, options.top_keywords, key=key)


def candidates(options: Options, lexical: DataFrame, semantic: DataFrame, docs: DataFrame) -> DataFrame:
    """The fused first hits of two ranked lists, with previews."""
    return external.searched(options, lexical, semantic, docs)


def reranked(options: Options, pairs: DataFrame, model: Callable[[list[tuple[str, str]]], list[float]], group: str, query: str, text: str, order: list[Column]) -> DataFrame:
    """The first candidates of each group by a cross-encoder's scores."""
    return external.reranked_if_many(external.scored(pairs, model, query, text), group, order, options.topk)


def diversified(options: Options, hits: DataFrame) -> DataFrame:
    """The hits of each query that are near to it and unlike each other."""
    return retrieval.diversify(hits, options.topk, options.mmr_lambda)


def own_text(options: Options, columns: dict[str, Column]) -> Column:
    """The sections of an article that stand for it, named in the options by commas."""
    return documents.own_sections([x.strip() for x in options.self_sections.split(",")], columns)


def own_evidence(options: Options, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Windows of a document's own text, as evidence where no search helps."""
    return documents.own_evidence(docs, key, text, options.self_win, options.self_step, options.topk, options.evid_trunc)


def evidence(options: Options, texts: Column) -> Column:
    """Numbered evidence for a prompt."""
    return external.evidence(texts, options.evid_trunc)


def matched_steps(options: Options, got: DataFrame, want: DataFrame) -> DataFrame:
    """One-to-one pairs of steps by the cosines of their vectors."""
    return metrics.greedy_match(metrics.vector_pairs(got, want), options.step_sim)


def param_scores(options: Options, df: DataFrame, got: str, want: str) -> DataFrame:
    """Precision, recall and F1 of two arrays of parameters."""
    return metrics.param_quality(df, got, want, options.param_tol)
