"""Model calls behind plain functions: batches in, batches out; the stubs are deterministic."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import Options


def answered(prompts: DataFrame, model: Callable[[list[str]], list[str]], key: str, prompt: str, size: int = 32) -> DataFrame:
    """key, answer: a chat model's answers, ``size`` prompts a call."""
    kind = prompts.schema[key].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), size):
                part = f.iloc[i : i + size]
                yield pd.DataFrame({key: part[key], "answer": model(part[prompt].fillna("").tolist())})

    return prompts.select(key, prompt).mapInPandas(work, f"{key} {kind}, answer string")


def scored(pairs: DataFrame, model: Callable[[list[tuple[str, str]]], list[float]], query: str, text: str) -> DataFrame:
    """``pairs`` with ``ce_score``: a cross-encoder's score of each pair."""

    @F.pandas_udf("double")
    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(model(list(zip(q.fillna(""), t.fillna(""), strict=True))), dtype="float64")

    return pairs.withColumn("ce_score", score(F.col(query), F.col(text)))


def reranked_first(pairs: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k candidates of each group by ``order``, sorted by ``ce_score``: sorting never reaches beyond the first k."""
    from .retrieval import top

    first = top(pairs, [group], order, k).withColumnRenamed("rank", "given")
    return top(first, [group], [F.desc("ce_score"), F.col("given")], k)


def evidence(texts: Column, width: int) -> Column:
    """Numbered evidence for a prompt from an array of texts, each cut to ``width`` characters."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("[EVIDENCE "), (i + 1).cast("string"), F.lit("] "), F.left(t, F.lit(width)))), "\n\n")


def better_attempt(strict: Column, relaxed: Column, n_strict: Column, n_relaxed: Column) -> Column:
    """Of two attempts, the one with more valid steps; the relaxed one on ties."""
    return F.when(n_relaxed >= n_strict, relaxed).otherwise(strict)


def prompt(template: str, columns: dict[str, Column], cut: int = 8000) -> Column:
    """A template's named places ({name}) filled by columns, each cut to ``cut`` characters."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.left(F.coalesce(columns[p].cast("string"), F.lit("")), F.lit(cut)) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


#: Prompts for queries, for a made-up answer to search with, and for records; parameters of ``prompt``.
QUERIES_PROMPT = "Give {n} search queries, one a line, for these methods:\n{methods}"
SUMMARY_PROMPT = "Describe in a few sentences how this could be done step by step:\n{methods}"
RECORD_PROMPT = "Answer with JSON only. From the evidence below, list the steps of these methods.\n{methods}\n\n{evidence}"


def reranked_if_many(pairs: DataFrame, group: str, order: list[Column], k: int, least: int = 3) -> DataFrame:
    """``reranked_first`` for groups of more than ``least`` candidates; smaller ones keep their order."""
    from .retrieval import top

    many = pairs.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > least).select(group)
    few = top(pairs.join(many, group, "left_anti"), [group], order, k).withColumn("given", F.col("rank"))
    return reranked_first(pairs.join(many, group, "left_semi"), group, order, k).unionByName(few)


def searched(options: Options, lexical: DataFrame, semantic: DataFrame, docs: DataFrame, columns: Sequence[str] = ("text",)) -> DataFrame:
    """The hybrid search by the options: the first ``k_lex`` and ``k_sem`` of two ranked lists, fused, ``topn`` with previews."""
    from .retrieval import fuse, with_texts

    return with_texts(fuse(lexical.filter(F.col("rank") <= options.k_lex), semantic.filter(F.col("rank") <= options.k_sem), options.topn), docs, columns=columns)
