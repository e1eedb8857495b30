"""A vector index that is kept: inverted cells around centroids, written once, appended to, and searched cell by cell.

``build`` fits centroids to a sample of at most ``SAMPLE`` vectors (those whose ids hash lowest, so every run takes the same
ones), gives each vector to the cell of the centroid with the largest inner product, and stores cells as blocks of up to
``ROWS`` vectors. It then measures, on at most ``TRIED`` of the sampled vectors as queries, in how many of the nearest cells
the sample's own nearest vectors lie, and stores the number of cells that finds ``TARGET`` of them. A search asks the
centroids for each query's cells, packs the queries of a cell, and compares packs with that cell's blocks only; a crowded cell
is many blocks, so no task holds a cell. All vectors are in the index; the sample only places the centroids.

Layout below ``path``: ``centroids`` (cell, centroid), ``meta`` (probes), ``cells/batch=<n>`` (cell, dims, ids, vectors).

Cases: vectors that are null, empty or hold nulls, or whose length isn't the centroids', take no part; an index of no
vectors finds nothing; with as many probes as cells the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, exists
from .retrieval import ROWS, blocks, nearest_in_blocks, packs, small, top

#: Sampled vectors, cells at most, rounds of fitting; queries of the measure, its neighbours and the share to be found.
SAMPLE, CELLS, STEPS = 20_000, 1024, 10
TRIED, NEIGHBOURS, TARGET = 500, 10, 0.96


def _fit(sample: np.ndarray, cells: int, steps: int = STEPS) -> np.ndarray:
    """Centroids of unit length, each the mean direction of the sample's vectors that are nearest to it."""
    rng = np.random.default_rng(7)
    c = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(steps):
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = np.argmax(sample @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        empty = np.bincount(own, minlength=len(c)) == 0
        sums[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        c = sums
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def _probes(sample: np.ndarray, c: np.ndarray) -> int:
    """How many of the nearest cells a query needs so that ``TARGET`` of its nearest vectors are found, on the sample."""
    tried, k = sample[:TRIED], min(NEIGHBOURS + 1, len(sample))
    near = np.argpartition(-(tried @ sample.T), k - 1, axis=1)[:, :k]
    order = np.argsort(np.argsort(-(tried @ c.T), axis=1), axis=1)  # place of each cell for a query
    places = np.sort(np.take_along_axis(order, np.argmax(sample @ c.T, axis=1)[near], axis=1).ravel())
    return int(places[min(len(places) - 1, int(np.ceil(TARGET * len(places))) - 1)]) + 1


class VectorIndex:
    """The index below ``path`` of vectors (vec_id, embedding)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, vectors: DataFrame, cells: int | None = None) -> None:
        """Fits the centroids and stores the vectors as the first batch."""
        usable = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null)")
        rows = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()  # a bounded sample
        dims = max(map(len, (r["v"] for r in rows)), key=[len(r["v"]) for r in rows].count) if rows else 0
        sample = np.array([r["v"] for r in rows if len(r["v"]) == dims], float) if rows else np.empty((0, 0))
        cells = cells or min(CELLS, max(1, int(4 * usable.count() ** 0.5)))
        c = _fit(sample, cells) if len(sample) else np.empty((0, dims))
        self.spark.createDataFrame([(i, v) for i, v in enumerate(c.tolist())], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centroids")
        probes = _probes(sample, c) if len(sample) else 0
        self.spark.createDataFrame([(len(c), probes)], "cells int, probes int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/meta")
        self.append(vectors, 0)

    def append(self, vectors: DataFrame, batch: int) -> None:
        """Vectors as a batch, in the cells that there are; a batch that runs again replaces itself."""
        placed = self._placed(vectors, "vec_id", 1).select("vec_id", "embedding", "cell")
        stored = blocks(placed.repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(8))).sortWithinPartitions("cell"), "vec_id", "embedding", "cell", size=ROWS)
        stored.write.mode("overwrite").parquet(f"{self.path}/cells/batch={batch}")

    @property
    def probes(self) -> int:
        return self.spark.read.parquet(f"{self.path}/meta").first()["probes"]

    def _centroids(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/centroids").collect()  # at most CELLS
        return np.array([r["centroid"] for r in sorted(rows, key=lambda r: r["cell"])], float)

    def _placed(self, vectors: DataFrame, key: str, probes: int) -> DataFrame:
        """``key``, embedding, cell: each vector with its ``probes`` nearest cells, a row for each."""
        c = self._centroids()

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    v = np.stack([np.array(x, float) for x in batch.column(1).to_pylist()])
                    n = min(probes, len(c))
                    near = np.argpartition(-(v @ c.T), n - 1, axis=1)[:, :n]
                    at = pa.array(np.repeat(np.arange(len(v)), n))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(near.ravel(), pa.int32())], names=[key, "embedding", "cell"])

        usable = vectors.select(F.col(key).cast("long").alias(key), F.col("embedding").cast("array<double>").alias("embedding"))
        usable = usable.filter(F.col(key).isNotNull() & (F.size("embedding") == (c.shape[1] if len(c) else -2)) & ~F.exists("embedding", lambda x: x.isNull()))
        return usable.mapInArrow(work, f"{key} long, embedding array<double>, cell int")

    def _cells(self) -> DataFrame | None:
        if not len(self._centroids()) or not exists(self.spark, f"{self.path}/cells"):
            return None
        return self.spark.read.parquet(f"{self.path}/cells")

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """query, vec_id, sim, rank: the k nearest found for queries (query, embedding), in the stored number of cells or another."""
        cells = self._cells()
        if cells is None:
            return self.spark.createDataFrame([], "query long, vec_id long, sim double, rank int")
        asked = cut(packs(self._placed(queries, "query", probes or self.probes), "cell"))
        found = nearest_in_blocks(cells.join(small(asked.drop("dims"), rows=256), "cell"), k)
        return top(found.withColumn("sim", F.round("sim", 6)), ["query"], [F.desc("sim"), F.col("vec_id")], k)

    def touched(self, queries: DataFrame, probes: int | None = None) -> float:
        """The share of all pairs of a query and a row that a search compares."""
        sizes = self._cells().groupBy("cell").agg((F.sum(F.octet_length("ids")) / 8).alias("n"))
        placed = self._placed(queries, "query", probes or self.probes)
        met = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("asked")).join(sizes, "cell").agg(F.sum(F.col("asked") * F.col("n"))).first()[0] or 0.0
        return met / max(1.0, placed.select("query").distinct().count() * sizes.agg(F.sum("n")).first()[0])
