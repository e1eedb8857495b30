"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded hash sample of the vectors (``PIVOTS``); nearness to them is taken in a space whitened by
``SAMPLED`` times as many. A vector is represented by its nearest pivots in order, ``LISTED`` of them, under a quarter.
Each block of vectors posts them in inverted files, one per pivot: the pivot's place in each vector's list, or ``LISTED``
where it isn't listed. The files are made once for a block and stored with it (``index``); all packs of queries read them.
A query reads the files of its own listed pivots only and sums the differences of places (the
footrule distance over these pivots); the share ``RERANKED`` of a block with the least sums, ``LEAST`` at least, is ranked
anew by the exact inner product in double precision on the original vectors. So of a block a query touches ``LISTED`` of
``PIVOTS`` files, a byte a row in each, and no vectors but those that are ranked anew; as a vector is in nearly a quarter of the
files, hardly a row is in none of a query's.

Cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take no
part, nor do rows without an id; where an id repeats, all its rows are candidates of others, none of its own query, and
the query is its least vector; ties go to the smaller id; fewer candidates than k: all; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import cut, trimmed

PIVOTS = 512
LISTED = 120
RERANKED = 0.15
#: Rows looked at for distinct pivots, as a multiple of their number.
SAMPLED = 8
LEAST = 400


def fitted(sample: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    """Pivots and offsets: nearness to pivot p is ``v @ directions[:, p] + offsets[p]``.

    That is the cosine's numerator after whitening by the sample, so that one crowded direction, as a large group of
    alike vectors makes, doesn't decide all lists.
    """
    mean = sample.mean(axis=0)
    spread, axes = np.linalg.eigh(np.cov((sample - mean).T, ddof=0).reshape(sample.shape[1], -1))
    whiten = (axes / np.sqrt(spread + 1e-3 * spread.max() + 1e-12)) @ axes.T
    p = (sample[:pivots] - mean) @ whiten
    p /= np.linalg.norm(p, axis=1, keepdims=True) + 1e-12
    directions = whiten @ p.T
    return directions.astype(np.float32), -(mean @ directions).astype(np.float32)


def _lists(v: np.ndarray, pivots: tuple[np.ndarray, np.ndarray], listed: int) -> np.ndarray:
    return np.argsort(-(v.astype(np.float32) @ pivots[0] + pivots[1]), axis=1, kind="stable")[:, :listed]


def inverted_files(v: np.ndarray, pivots: tuple[np.ndarray, np.ndarray], listed: int) -> np.ndarray:
    """Row p: the place of pivot p in each vector's list, ``listed`` where it isn't there."""
    files = np.full((len(v), len(pivots[1])), listed, np.uint8)
    np.put_along_axis(files, _lists(v, pivots, listed), np.arange(listed, dtype=np.uint8)[None, :], 1)
    return np.ascontiguousarray(files.T)


def index(rows: DataFrame, pivots: tuple[np.ndarray, np.ndarray] | None, listed: int) -> tuple[DataFrame, int]:
    """The stored index: block, block_ids (in order), block_v, block_files (a byte for each pivot and row); and the number of blocks."""
    blocks, n = vectors.packed(vectors.kept(rows), vectors.BLOCK_ROWS, "block")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, v in zip(*batch.columns, strict=True):
                ids = np.asarray(ids.values)
                order = np.argsort(ids, kind="stable")
                v = np.asarray(v.values).reshape(len(ids), -1)[order]
                columns = [[block.as_py()], [ids[order]], [v.ravel()], [inverted_files(v, pivots, listed).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.binary()), strict=True)], names=["block", "block_ids", "block_v", "block_files"])

    return cut(blocks.select("block", "block_ids", "block_v").mapInArrow(trimmed(work), "block int, block_ids array<long>, block_v array<double>, block_files binary")), n


def search(rows: DataFrame, queries: DataFrame, k: int = 20, pivots: int = PIVOTS, listed: int = LISTED, reranked: float = RERANKED) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found by inner product. Both take vec_id and v."""
    # a bounded number of vectors
    chosen = rows.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(SAMPLED * pivots).select("v").collect()
    sample = np.array(list(dict.fromkeys(tuple(r["v"]) for r in chosen)))
    p = fitted(sample, pivots) if len(sample) else None
    listed = max(1, min(listed, pivots, len(sample), 127))

    def best(ids, v, qids, q, least, files):
        files = files.reshape(-1, len(ids))
        places = np.arange(listed, dtype=np.uint8)[:, None]
        n = min(len(ids), max(LEAST, k + 1, int(np.ceil(reranked * len(ids)))))
        for i, own in enumerate(_lists(q, p, listed)):
            posted = files[own]
            apart = np.maximum(posted, places) - np.minimum(posted, places)
            even = len(apart) // 2 * 2
            pairs = apart[:even:2] + apart[1:even:2]  # at most 2 * 127, so still bytes
            footrule = pairs.sum(axis=0, dtype=np.uint16) + apart[even:].sum(axis=0, dtype=np.uint16)
            edge = np.partition(footrule, n - 1)[n - 1]
            near = np.flatnonzero(footrule < edge)
            near = np.concatenate([near, np.flatnonzero(footrule == edge)[: n - len(near)]])  # ties to the smaller id
            near = near[ids[near] != qids[i]]
            scores = np.einsum("ij,j->i", v[near], q[i])
            chosen = vectors.top(scores, ids[near], k)
            yield i, near[chosen], scores[chosen]

    blocks, n = index(rows, p, listed)
    packs, _ = vectors.packed(vectors.kept(queries), vectors.PACK_ROWS, "pack")
    pairs = packs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(blocks, "block")
    return vectors.best_of(vectors.matched(pairs, best, "double"), k)
