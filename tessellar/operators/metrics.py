"""Retrieval and generation metrics."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import cut
from .retrieval import blocks


def retrieval_quality(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 8, 10), depth: int = 50) -> DataFrame:
    """Recall, reciprocal rank and discounted gain of one relevant document a query; ``rank`` from 0, null if missed."""
    hit = lambda k: F.coalesce(F.col("rank") < k, F.lit(False))
    mean = lambda k, v, name: F.avg(F.when(hit(k), v).otherwise(0.0)).alias(name)
    r = F.col("rank")
    return ranks.agg(*[mean(k, F.lit(1.0), f"recall_{k}") for k in ks], mean(depth, 1 / (r + 1), "mrr"), mean(depth, 1 / F.log2(r + 2), "ndcg"))


def set_quality(df: DataFrame, got: str, want: str) -> DataFrame:
    """Precision, recall and F1 of two array columns as sets."""
    n = lambda f, a, b: F.size(f(F.col(a), F.col(b)))
    p, r, f1 = T.prf(n(F.array_intersect, got, want), n(F.array_except, got, want), n(F.array_except, want, got))
    return df.withColumns({"p": p, "r": r, "f1": f1})


#: Pairs of a key that one task may match; keys with more are matched by rounds over all tasks.
HELD_PAIRS = 1_000_000


def greedy_match(pairs: DataFrame, least: float) -> DataFrame:
    """One-to-one pairs (key, i, j, sim), always the greatest similarity left; ties to the lower i, then j.

    A key of up to ``HELD_PAIRS`` pairs is matched in one task. For larger ones a pair that is the best of both its sides is
    taken, as no pair before it in the order can take a side away; such rounds go on over the pairs that are left.
    """

    def match(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["sim", "i", "j"], ascending=[False, True, True])
        i_used, j_used, rows = set(), set(), []
        for row in d.itertuples(index=False):
            if row.i not in i_used and row.j not in j_used:
                i_used.add(row.i)
                j_used.add(row.j)
                rows.append(row)
        return pd.DataFrame(rows, columns=d.columns)

    kind = "key long, i long, j long, sim double"
    fit = cut(pairs.filter(F.col("sim") >= least).select("key", "i", "j", "sim"))
    large = cut(fit.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HELD_PAIRS).select("key"))
    if large.isEmpty():
        return fit.groupBy("key").applyInPandas(match, kind)
    done = fit.join(large, "key", "left_anti").groupBy("key").applyInPandas(match, kind)
    left = fit.join(large, "key", "left_semi")
    first = lambda side: F.row_number().over(Window.partitionBy("key", side).orderBy(F.desc("sim"), "i", "j")) == 1
    while True:
        taken = cut(left.withColumns({"_i": first("i"), "_j": first("j")}).filter("_i and _j").select("key", "i", "j", "sim"))
        if taken.isEmpty():
            return done
        done = done.unionByName(taken)
        left = cut(left.join(taken.select("key", "i"), ["key", "i"], "left_anti").join(taken.select("key", "j"), ["key", "j"], "left_anti"))


def vector_pairs(got: DataFrame, want: DataFrame) -> DataFrame:
    """key, i, j, sim: the cosines of all vectors (key, i, vector) and (key, j, vector) of a key, by products of blocks.

    A zero vector has a cosine of 0 with all; vectors that are null or hold nulls, or of another length, have none.
    """
    unit = lambda df, n: df.filter("key is not null").select("key", n, F.transform(F.col("vector").cast("array<double>"), lambda x: x / F.greatest(F.sqrt(T.dot(F.col("vector"), F.col("vector"))), F.lit(1e-300))).alias("v"))
    side = lambda df, n: blocks(unit(df, n).repartition("key").sortWithinPartitions("key"), n, "v", "key")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, dims, *packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *batch.columns[2:], strict=True):
                i, v, j, w = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(packed, (np.int64, float, np.int64, float), strict=True))
                sims = v.reshape(-1, dims) @ w.reshape(-1, dims).T
                yield pa.RecordBatch.from_arrays([pa.array(np.full(sims.size, key)), pa.array(np.repeat(i, len(j))), pa.array(np.tile(j, len(i))), pa.array(sims.ravel())], names=["key", "i", "j", "sim"])

    other = side(want, "j").withColumnsRenamed({"ids": "asked", "vectors": "asked_vectors"})
    return side(got, "i").join(other, ["key", "dims"]).select("key", "dims", "ids", "vectors", "asked", "asked_vectors").mapInArrow(work, "key long, i long, j long, sim double")


def order_agreement(pairs: DataFrame) -> DataFrame:
    """Per key, the share of pairs of matches that are in the same order on both sides; 1 for fewer than two matches."""
    a, b = pairs.select("key", "i", "j"), pairs.select("key", F.col("i").alias("i2"), F.col("j").alias("j2"))
    both = a.join(b, "key").filter("j < j2").groupBy("key").agg(F.avg((F.col("i") < F.col("i2")).cast("double")).alias("order"))
    return pairs.select("key").distinct().join(both, "key", "left").select("key", F.coalesce("order", F.lit(1.0)).alias("order"))


def near_params(a: Column, b: Column, tolerance: float = 0.1) -> Column:
    """Whether two parameters (value, unit) have one unit and values within the tolerance of the second."""
    return (a["unit"] == b["unit"]) & (F.abs(a["value"] - b["value"]) <= tolerance * F.greatest(F.lit(1.0), F.abs(b["value"])))


def param_matches(got: Column, want: Column, tolerance: float = 0.1) -> Column:
    """How many of ``got`` find a near parameter of ``want`` of their own: each takes the first that is free."""
    free = F.transform(want, lambda w: F.lit(True))

    def take(open_: Column, g: Column) -> Column:
        fits = F.transform(F.arrays_zip(want.alias("w"), open_.alias("o")), lambda x: x["o"] & near_params(g, x["w"], tolerance))
        first = F.array_position(fits, F.lit(True))
        return F.transform(open_, lambda o, i: o & (i + 1 != first))

    return F.size(F.filter(F.aggregate(got, free, take), lambda o: ~o))


def param_quality(df: DataFrame, got: str, want: str, tolerance: float = 0.1) -> DataFrame:
    """Precision, recall and F1 of two arrays of parameters (value, unit)."""
    tp = param_matches(F.col(got), F.col(want), tolerance)
    p, r, f1 = T.prf(tp, F.size(got) - tp, F.size(want) - tp)
    return df.withColumns({"p": p, "r": r, "f1": f1})


def _band(value: Column, tolerance: float) -> Column:
    """A number such that near values have the same one or neighbouring ones: steps of equal size up to 1, of equal ratio beyond."""
    size = F.abs(value)
    scale = F.when(size <= 1, value).otherwise(F.signum(value) * (1 + F.log(size)))
    return F.floor(scale / (-math.log(1 - tolerance) * (1 + 1e-9)))


def near_pairs(df: DataFrame, other: DataFrame, key: str, tolerance: float = 0.1) -> DataFrame:
    """key, got, want: all pairs of near parameters (key, value, unit) of the same key; the tolerance is below 1.

    Only values of the same or of neighbouring bands meet, not all of a unit, so the join is on the band too.
    """
    a = df.select(key, "unit", F.struct("value", "unit").alias("got"), F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: d + _band(F.col("value"), tolerance))).alias("_band"))
    b = other.select(key, "unit", F.struct("value", "unit").alias("want"), _band(F.col("value"), tolerance).alias("_band"))
    return a.join(b, [key, "unit", "_band"]).filter(near_params(F.col("got"), F.col("want"), tolerance)).select(key, "got", "want")


def keyword_quality(pairs: DataFrame, keywords: DataFrame, key: str, got: str) -> DataFrame:
    """key, p, r, f1, hits: a text's tokens against the keywords (key, term) of another; ``hits`` in order."""
    wanted = keywords.groupBy(key).agg(F.collect_set("term").alias("_want"))
    d = pairs.join(wanted, key, "left").withColumns({"_want": F.coalesce("_want", F.array().cast("array<string>")), "_got": F.array_distinct(T.ascii_tokens(F.col(got)))})
    hits = F.array_sort(F.array_intersect("_got", "_want"))
    p, r, f1 = T.prf(F.size(hits), F.size("_got") - F.size(hits), F.size("_want") - F.size(hits))
    return d.select(key, p.alias("p"), r.alias("r"), f1.alias("f1"), F.array_join(hits, " ").alias("hits"))


def macro(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Means over samples and their number; 0 without samples."""
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns])


def doubtful(pairs: DataFrame, title_a: str, title_b: str, similarity: str, least: float = 0.25) -> DataFrame:
    """Pairs without a title on a side, or of little similarity, with the reason."""
    missing = ~T.filled(F.col(title_a)) | ~T.filled(F.col(title_b))
    reason = F.when(missing, "missing_title").when(F.coalesce(F.col(similarity), F.lit(0.0)) < least, "low_similarity")
    return pairs.withColumn("reason", reason).filter("reason is not null")


def similarity_hits(df: DataFrame, sim: str, least: float) -> DataFrame:
    s = F.greatest(F.col(sim), F.lit(0.0))
    return df.agg(F.avg((s >= least).cast("double")).alias("sim_hit"), F.avg(s).alias("avg_max_sim"), *[F.percentile(s, F.lit(p)).alias(f"p{round(p * 100)}") for p in (0.1, 0.25, 0.5, 0.75, 0.9)])


def closest(sims: DataFrame, key: str, other: str, sim: str, k: int = 3) -> DataFrame:
    """Per key the greatest similarity (0 at least), what it is to, and the first k by similarity, ties to the smaller."""
    first = F.slice(F.array_sort(F.collect_list(F.struct((-F.col(sim)).alias("o"), F.col(other).alias("x")))), 1, k)
    best = F.max_by(other, F.struct(F.col(sim), -F.col(other)))
    return sims.groupBy(key).agg(F.greatest(F.max(sim), F.lit(0.0)).alias(sim), best.alias("best"), F.transform(first, lambda p: p["x"]).alias("first"))
