"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors of integers are documents of signed term weights. The whole table is put in order by the nearest of some
sampled vectors (``LEADERS``, more for larger tables), so that a block holds alike rows; it keeps a forward index (a dense row per document) cut into document
ranges of ``RANGE`` rows, with each term's maximum and minimum per block and per range. For a query the summed maxima
(minima where the query's weight is negative) bound every score of a block or range.

A query is first scored in one block of its own leader, which gives a k-th score to begin with; the queries of a crowded leader
are spread over its blocks. Then blocks whose bound
falls below the k-th of every query of a pack aren't sent to it; in the others, ranges are scored through the forward index
in waves, best bounds first, until the bound of a range falls below the k-th. Ranges of equal bound are scored, as ties go
to the smaller id. So the result is exact; where bounds can't tell rows apart, all is scored.

Cases: vectors that are null, empty, of another length than most, or hold null or non-finite components take no part, nor
do rows without an id; zero vectors do; where an id repeats, all its rows are candidates of others, none of its own query,
and the query is its least vector; fewer candidates than k: all; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import cut

RANGE = 32
#: Sampled vectors that rows are put in order by: the least and the most, and rows for each between.
LEADERS, MOST_LEADERS, LED_ROWS = 128, 4096, 4096
#: Ranges in the waves, the first ones; later waves double.
FIRST_WAVE = 4
#: Blocks whose bounds a task holds at once.
BOUNDED_BLOCKS = 50_000


def quantised(rows: DataFrame, scale: int = 64) -> DataFrame:
    """Components as floor(scale * x), doubles that hold integers."""
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))


def _led(rows: DataFrame, leaders: np.ndarray) -> DataFrame:
    """Stored rows with the number of their nearest leader, by the angle."""
    to = (leaders / (np.linalg.norm(leaders, axis=1, keepdims=True) + 1e-9)).T

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((v @ to).argmax(axis=1), pa.int32())], names=["vec_id", "v", "at", "leader"])

    return rows.select("vec_id", "v", "at").mapInArrow(work, "vec_id long, v array<double>, at long, leader int")


def bounds(high: np.ndarray, low: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each query and range (or block): no score in it is higher."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def scored(ids: np.ndarray, v: np.ndarray, qids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], int]:
    """(query, rows, scores) of a block's k best for each query, none below ``least``; and how many ranges weren't scored for a query."""
    # alike rows side by side: along the block's main direction
    centred = v - v.mean(axis=0)
    order = np.argsort(centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1], kind="stable")
    ids_in, forward = ids[order], v[order]
    begins = np.arange(0, len(ids), RANGE)
    bound = bounds(np.maximum.reduceat(forward, begins), np.minimum.reduceat(forward, begins), q)
    ranks = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1, kind="stable")
    scores = np.full((len(q), len(ids)), -np.inf)
    kth, done, until, looked = least.copy(), 0, FIRST_WAVE, 0
    while done < len(begins):
        wave = (ranks >= done) & (ranks < until) & (bound >= kth[:, None])
        if not wave.any():
            break  # the bounds of all later ranges are below, too
        looked += int(wave.sum())
        for r in np.flatnonzero(wave.any(axis=0)):
            who, part = np.flatnonzero(wave[:, r]), slice(begins[r], begins[r] + RANGE)
            s = q[who] @ forward[part].T  # integers, exact in doubles
            s[qids[who][:, None] == ids_in[part][None, :]] = -np.inf
            scores[who, part] = s
        if scores.shape[1] > k:
            kth = np.maximum(kth, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
        done, until = until, 2 * until
    out = []
    for i in range(len(q)):
        at = np.flatnonzero((scores[i] > -np.inf) & (scores[i] >= least[i]))
        at = at[vectors.top(scores[i][at], ids_in[at], k)]
        out.append((i, order[at], scores[i][at].astype(np.int64)))
    return out, bound.size - looked


def _wanted(packs: DataFrame, blocks: DataFrame, n: int) -> DataFrame:
    """``packs`` for each block that may hold a row of a query's k best; the blocks' bounds are looked at part by part."""
    parts, found = max(1, -(-n // BOUNDED_BLOCKS)), None
    for part in range(parts):
        of = blocks.filter(F.pmod(F.xxhash64("block"), F.lit(parts)) == part).select("block", "high", "low").collect()  # about ``BOUNDED_BLOCKS`` rows
        pairs = packs.select("pack", "pack_v", "pack_least").mapInArrow(_reached(of), "pack int, block long")
        found = pairs if found is None else found.unionByName(pairs)
    return packs.join(found, "pack")


def _reached(blocks: list):
    names = np.array([r["block"] for r in blocks], np.int64)
    high, low = (np.array([r[c] for r in blocks], float) for c in ("high", "low"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, v, least in zip(*(batch.column(i) for i in range(3)), strict=True):
                if not len(names):
                    continue
                q = np.asarray(v.values).reshape(len(least.values), -1)
                may = (bounds(high, low, q) >= np.asarray(least.values)[:, None]).any(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(may.sum(), pack.as_py()), pa.int32()), pa.array(names[may], pa.int64())], names=["pack", "block"])

    return work


def search(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score (long): each query's k highest integer inner products. Both take vec_id and v."""

    def best(ids, v, qids, q, least):
        return scored(ids, v, qids, q, least, k)[0]

    stored = vectors.kept(rows)
    many = min(MOST_LEADERS, max(LEADERS, stored.count() // LED_ROWS))
    sample = stored.orderBy(F.xxhash64("at")).limit(many).select("v").collect()  # a bounded number of vectors
    if not sample:
        return vectors.best_of(stored.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0).cast("long").alias("score")), k)
    leaders = np.array([r["v"] for r in sample])
    led = _led(stored, leaders)
    sizes = {r["leader"]: r["count"] for r in led.groupBy("leader").count().collect()}  # a row for each leader
    # a leader without rows has no block
    parts = F.array(*[F.lit(max(1, -(-sizes.get(leader, 0) // vectors.BLOCK_ROWS))) for leader in range(len(leaders))])
    block = F.col("leader").cast("long") * (1 << 32) + F.pmod(F.xxhash64("at"), F.get(parts, F.col("leader")))
    high, low = (f.alias(name) for f, name in ((F.transform(F.sequence(F.lit(0), F.lit(leaders.shape[1] - 1)), lambda i: F.array_max(F.transform("vs", lambda v: v[i]))), "high"), (F.transform(F.sequence(F.lit(0), F.lit(leaders.shape[1] - 1)), lambda i: F.array_min(F.transform("vs", lambda v: v[i]))), "low")))
    grouped = led.withColumn("block", block).groupBy("block", "leader").agg(F.collect_list("vec_id").alias("block_ids"), F.collect_list("v").alias("vs"))
    blocks = cut(grouped.select("block", "leader", "block_ids", F.flatten("vs").alias("block_v"), high, low))

    asked = cut(_led(vectors.kept(queries), leaders))
    at_home = F.floor(F.row_number().over(vectors.Window.partitionBy("block").orderBy("at")) / vectors.PACK_ROWS)
    home = asked.withColumn("block", block).withColumn("n", at_home).groupBy("block", "n").agg(F.collect_list("vec_id").alias("pack_ids"), F.flatten(F.collect_list("v")).alias("pack_v"))
    begun = vectors.best_of(vectors.matched(home.join(blocks.select("block", "block_ids", "block_v"), "block"), best, "long"), k)
    least = cut(begun.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least")))
    packs, _ = vectors.packed(asked.join(least, "vec_id", "left"), vectors.PACK_ROWS, "pack", ("least",))
    packs = cut(packs)
    pairs = _wanted(packs, blocks, blocks.count()).join(blocks.select("block", "block_ids", "block_v"), "block")
    return vectors.best_of(vectors.matched(pairs, best, "long"), k)
