"""Query vectors against all vectors in bounded blocks: the frame that both searches over vectors share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, trimmed

#: Vectors of a block and queries of a pack: what a task holds at once.
BLOCK_ROWS = 8192
PACK_ROWS = 512


def _valid(v: Column, zeros: bool) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True))
    return ok if zeros else ok & F.exists(v, lambda x: x != 0)


def usable(rows: DataFrame, zeros: bool) -> DataFrame:
    """vec_id, v (doubles): rows with an id whose vector has no null or non-finite component, all of the commonest length."""
    v = F.col("embedding").cast("array<double>")
    ok = rows.select("vec_id", v.alias("v")).filter(F.col("vec_id").isNotNull() & _valid(F.col("v"), zeros))
    length = ok.agg(F.mode(F.size("v"), True).alias("length"))
    return ok.join(F.broadcast(length), F.size("v") == F.col("length"), "left_semi")


def kept(rows: DataFrame) -> DataFrame:
    """The rows, stored, each with a place of its own (``at``): what is dealt by it stays so, however often a task runs."""
    return cut(rows.select("vec_id", "v", F.monotonically_increasing_id().alias("at")))


def packed(rows: DataFrame, size: int, name: str, columns: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """Stored rows dealt evenly into packs of about ``size`` by their places, so that no id makes a hot pack."""
    n = max(1, -(-rows.count() // size))
    dealt = rows.withColumn(name, F.pmod(F.xxhash64("at"), F.lit(n)).cast("int"))
    more = [F.collect_list(F.coalesce(F.col(c).cast("double"), F.lit(float("-inf")))).alias(f"{name}_{c}") for c in columns]
    return dealt.groupBy(name).agg(F.collect_list("vec_id").alias(f"{name}_ids"), F.flatten(F.collect_list("v")).alias(f"{name}_v"), *more), n


def best_of(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of those found."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def matched(pairs: DataFrame, best: Callable, score_type: str) -> DataFrame:
    """query_id, vec_id, score of pairs of a block and a pack of queries, by ``best`` of each pair's arrays.

    ``best(ids, vectors, query_ids, query_vectors, least)`` yields (query index, row indexes, scores); ``least`` is a score
    that a query's k best are known to reach. Bytes stored with the block (``block_files``) come last.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                ids, qids = (np.asarray(batch.column(at[c])[r].values) for c in ("block_ids", "pack_ids"))
                v, q = (np.asarray(batch.column(at[c])[r].values) for c in ("block_v", "pack_v"))
                least = np.asarray(batch.column(at["pack_least"])[r].values) if "pack_least" in at else np.full(len(qids), -np.inf)
                files = [np.frombuffer(batch.column(at["block_files"])[r].as_buffer(), np.uint8)] if "block_files" in at else []
                out = [(np.full(len(j), qids[i]), ids[j], s) for i, j, s in best(ids, v.reshape(len(ids), -1), qids, q.reshape(len(qids), -1), least, *files)]
                if out:
                    a, b, c = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64() if score_type == "double" else pa.int64())], names=["query_id", "vec_id", "score"])

    names = [c for c in ("block_ids", "block_v", "pack_ids", "pack_v", "pack_least", "block_files") if c in pairs.columns]
    return pairs.select(*names).mapInArrow(trimmed(work), f"query_id long, vec_id long, score {score_type}")


def one_per_id(rows: DataFrame) -> DataFrame:
    """A vector for each id: the least, where an id repeats."""
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]
