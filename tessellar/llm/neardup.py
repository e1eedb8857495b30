"""MinHash near-duplicate detection by an LSH forest.

1. Each document's set of word shingles gets labels of ``DEPTH`` min-wise hashes, one for each tree, and a short signature.
   Documents of equal sets are one class from here on, whatever their number; its smallest id stands for it.
2. Each tree is a sorted order of the labels. A region is a run of classes that share a prefix of ``SHALLOW`` hashes;
   the candidates of a class are the neighbours that follow it in a region, i.e. those of the longest common prefix.
   The orders are cut into tasks by ranges, so a long region is no task's alone.
3. Candidates whose signatures agree enough are links to confirm. In rounds, every class proposes its best candidates
   outside its component, a few first, all in the last round; proposals are confirmed on the full sets, accepted ones merge
   components, refused ones are struck off. So copies of a group cost a few confirmations each, not all pairs.
4. When no candidate is left, regions that still hold several components are searched for all pairs across
   components. The depth adapts: a region of more than ``CROWDED`` classes is split by further hashes, up to ``DEPTH``.
   A region's largest component and its other classes are dealt into blocks of about ``BLOCK``; each block of the largest
   meets each of the others, and these meet each other, a piece of work for each pair of blocks. So no pair across
   components is left out, none needs more than two blocks in a task, and copies aren't compared. Classes with a candidate
   there bring their full sets and are compared in place, so only links leave it, not the pairs alike by signature alone. Regions whose sets exceed
   ``HELD_BYTES`` emit their candidates to the rounds.

The number of trees follows from the threshold: two sets at it share a region of some tree but for odds of 1.2e-5 at depth
``DEPTH`` (crowded regions), and of 2.5e-8 at depth ``SHALLOW`` for a similarity of 0.85 (24 trees), 2e-9 for 0.8 (38 trees).
Their signatures agree too little, by ``SLACK`` standard deviations, with odds below 1e-7. Everything is distributed:
links, components and fingerprints never reach the driver.

Cases: a null or empty text has an empty set, links with nothing and is its own component; ids that repeat join their
classes; rows without an id have a null component and aren't kept; texts of any length are hashed whole; an empty table
gives an empty result; other columns are ignored (``components``) or kept (``distinct``).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, cut, release, small, trimmed
from .hashing import mixed, shingles, word_hashes

DEPTH, SHALLOW, CROWDED, BLOCK, NEIGHBOURS = 6, 4, 1024, 256, 3
LABEL = 2 * DEPTH
#: Odds that two sets at the threshold share no label; the number of trees follows.
MISSED = 1.2e-5
#: Copies of a set from which its class is joined by a broadcast, so that they don't meet in one task.
COPIES = 10_000
#: Candidates that a class proposes in each round; None: all that are left.
PROPOSALS = (1, 8, None)
#: Texts hashed at once, in characters.
CHUNK = 1 << 20
#: Bytes of the full sets that a task may hold of one region.
HELD_BYTES = 32 << 20
#: Share of signature bytes that must agree for a candidate: below the threshold by this many standard deviations.
SLACK = 6.0


@dataclass(frozen=True)
class Forest:
    """What a threshold, in percent, asks for: trees, hashes in all, and the least agreement of signatures."""

    percent: int
    #: whether comparing signatures needs the sets' sizes
    sized = False

    @property
    def trees(self) -> int:
        return max(24, math.ceil(math.log(MISSED) / math.log(1 - min(0.99, self.percent / 100) ** DEPTH)))

    @property
    def hashes(self) -> int:
        return self.trees * DEPTH

    @property
    def least(self) -> float:
        p = self.percent / 100
        return p - SLACK * (p * (1 - p) / self.hashes) ** 0.5

    def signatures(self, column: pa.Array) -> np.ndarray:
        """A row for each signature of a column."""
        return _fixed(column, self.hashes)

    def estimate(self, x: np.ndarray, y: np.ndarray, nx: np.ndarray | None = None, ny: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Estimated similarities of signatures, and which are enough for a candidate; sizes of sets tell nothing more."""
        est = _agreement(x, y)
        return est, est >= self.least

    def comparing(self, sig: np.ndarray, n: np.ndarray):
        """Of a part's rows: which of the rows ``near`` may be linked with row i."""
        return lambda i, near: _agreement(sig[near], sig[i]) >= self.least


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        first, size, texts = 0, 0, []
        for i, t in enumerate(batch.column(batch.num_columns - 1)):
            t = t.as_py() or ""
            if texts and size + len(t) > CHUNK:
                yield batch.slice(first, len(texts)), texts
                first, size, texts = i, 0, []
            texts.append(t)
            size += len(t)
        if texts:
            yield batch.slice(first, len(texts)), texts


def _sets(texts: list[str], n: int) -> Iterator[np.ndarray]:
    words, at = word_hashes(texts)
    for i in range(len(texts)):
        yield shingles(words[at[i] : at[i + 1]], n)


def _minima(s: np.ndarray, factors: np.ndarray) -> np.ndarray:
    x, out = (s >> np.uint64(32)).astype(np.uint32), np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(out, (x[i : i + 4096, None] * factors[None, :]).min(axis=0), out=out)
    return out


def sketches(docs: DataFrame, shingle: int, forest: Forest) -> DataFrame:
    """doc_id, n_shingles, fp (of the set; null if empty), labels, sig: under 800 bytes a document."""

    hashes = forest.hashes

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = np.random.default_rng(3).integers(0, 1 << 31, hashes, np.uint32) * np.uint32(2) + np.uint32(1)
        for batch, texts in _chunks(batches):
            n, fps, labels, sigs = [], [], [], []
            for s in _sets(texts, shingle):
                n.append(len(s))
                if not len(s):
                    for x in (fps, labels, sigs):
                        x.append(None)
                    continue
                m = mixed(_minima(s, factors).astype(np.uint64))
                fps.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                labels.append((m & np.uint64(0xFFFF)).astype(">u2").tobytes())
                sigs.append(((m >> np.uint64(16)) & np.uint64(0xFF)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (fps, labels, sigs))], names=["doc_id", "n_shingles", "fp", "labels", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(work), "doc_id long, n_shingles long, fp binary, labels binary, sig binary")


def _full_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """id, set (packed): of the documents that take part in links; by a broadcast of the ids if they are few."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in _sets(texts, shingle)], pa.binary())], names=["id", "set"])

    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    ids = F.broadcast(ids) if few else ids
    wanted = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi")
    return wanted.mapInArrow(trimmed(work), "id long, set binary")


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _pairs_batch(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    x, y = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (a, b))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y), pa.int64()), pa.array(np.maximum(x, y), pa.int64())], names=["a", "b"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (tree, label, id) in order: each with the next few of its region. Holds a batch and a few rows."""
    tree, label, ids = np.empty(0, np.int32), np.empty((0, LABEL), np.uint8), np.empty(0, np.int64)
    for batch in batches:
        tree = np.concatenate([tree[-NEIGHBOURS:], batch.column(0).to_numpy()])
        label = np.concatenate([label[-NEIGHBOURS:], _fixed(batch.column(1), LABEL)])
        old = min(len(ids), NEIGHBOURS)
        ids = np.concatenate([ids[-NEIGHBOURS:], batch.column(2).to_numpy()])
        region = np.ascontiguousarray(label[:, : 2 * SHALLOW]).view(">u8").ravel()
        a, b = [], []
        for d in range(1, min(NEIGHBOURS, len(ids) - 1) + 1):
            alike = (region[:-d] == region[d:]) & (tree[:-d] == tree[d:])
            alike[: max(0, old - d)] = False  # pairs among the rows carried over were given before
            at = np.flatnonzero(alike)
            a.append(ids[at])
            b.append(ids[at + d])
        yield _pairs_batch(a, b)


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarity from signatures: agreeing bytes, less those that agree by chance."""
    return ((x == y).mean(axis=-1) - 1 / 256) * (256 / 255)


def across(blk: np.ndarray, comp: np.ndarray, sig: np.ndarray, n: np.ndarray, forest: Forest) -> Iterator[tuple[int, np.ndarray]]:
    """Of a region's part: a place, and later places of other components that may be linked with it by size and signature.

    Rows of two blocks are compared with those of the other block only; within a block is a part of its own.
    """
    two = len(blk) > 0 and (blk != blk[0]).any()
    alike = forest.comparing(sig, n)
    for i in range(len(comp) - 1):
        later = slice(i + 1, None)
        sizes = 100 * np.minimum(n[later], n[i]) >= forest.percent * np.maximum(n[later], n[i])
        if two:
            sizes &= blk[later] != blk[i]
        others = i + 1 + np.flatnonzero((comp[later] != comp[i]) & sizes)
        for k in range(0, len(others), 4096):
            near = others[k : k + 4096]
            near = near[alike(i, near)]
            if len(near):
                yield i, near


#: Columns of a region's rows: the part's key and block, the class, its component, set size and signature; sets come last, where they are needed.
REGION = "key long, blk long, id long, comp long, n long, sig binary"


def _objects(column: pa.Array) -> np.ndarray:
    out = np.empty(len(column), object)
    out[:] = [np.frombuffer(x.as_buffer(), np.uint64) for x in column]
    return out


def regions(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[tuple[list[np.ndarray], list[int]]]:
    """Of ``REGION`` rows in order, with sets or not: columns of whole parts, where each begins, and the end."""
    held: list[np.ndarray] | None = None

    def edges(parts: list[np.ndarray]) -> list[int]:
        return [0, *(np.flatnonzero(parts[0][1:] != parts[0][:-1]) + 1).tolist(), len(parts[0])]

    for batch in batches:
        if not batch.num_rows:
            continue
        *plain, sig = batch.columns[:6]
        new = [*(c.to_numpy() for c in plain), forest.signatures(sig), *map(_objects, batch.columns[6:])]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        at = edges(held)
        if len(at) > 2:  # the last part may go on
            yield [x[: at[-2]] for x in held], at[:-1]
            held = [x[at[-2] :] for x in held]
    if held is not None:
        yield held, edges(held)


def _involved(forest: Forest):
    """The rows that have a candidate in their region's part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, blk, ids, comp, n, sig), edges in regions(batches, forest):
            keep = np.zeros(len(ids), bool)
            for lo, hi in zip(edges, edges[1:], strict=False):
                for i, near in across(blk[lo:hi], comp[lo:hi], sig[lo:hi], n[lo:hi], forest):
                    keep[lo + i] = True
                    keep[lo + near] = True
            columns = [*(pa.array(x[keep], pa.int64()) for x in (key, blk, ids, comp, n)), pa.array([bytes(x) for x in sig[keep]], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in REGION.split(", ")])

    return work


def _candidates(forest: Forest):
    """All candidates (a, b) across components of the regions."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, blk, ids, comp, n, sig), edges in regions(batches, forest):
            for lo, hi in zip(edges, edges[1:], strict=False):
                for i, near in across(blk[lo:hi], comp[lo:hi], sig[lo:hi], n[lo:hi], forest):
                    yield _pairs_batch([np.full(len(near), ids[lo + i])], [ids[lo + near]])

    return work


def _links(forest: Forest):
    """Links (a, b) across components of the regions, by full sets; what is linked is one component in the part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, blk, ids, comps, _, sig, sets), edges in regions(batches, forest):
            a, b = [], []
            for lo, hi in zip(edges, edges[1:], strict=False):
                n, comp = np.array([len(x) for x in sets[lo:hi]]), comps[lo:hi].copy()
                words, code = np.unique(np.concatenate(sets[lo:hi]), return_inverse=True)
                ends, marked = np.cumsum(n), np.zeros(len(words), bool)
                for i, near in across(blk[lo:hi], comp, sig[lo:hi], n, forest):
                    own = code[ends[i] - n[i] : ends[i]]
                    marked[own] = True
                    begins = np.cumsum(n[near]) - n[near]
                    at = np.arange(n[near].sum()) + np.repeat(ends[near] - n[near] - begins, n[near])
                    both = np.add.reduceat(marked[code[at]], begins, dtype=np.int64)
                    marked[own] = False
                    near = near[100 * both >= forest.percent * (n[i] + n[near] - both)]
                    for j in near[np.unique(comp[near], return_index=True)[1]]:
                        a.append(ids[lo + i : lo + i + 1])
                        b.append(ids[lo + j : lo + j + 1])
                        comp[comp == comp[j]] = comp[i]
            yield _pairs_batch(a, b)

    return work


def _estimated(pairs: DataFrame, sigs: DataFrame, forest: Forest) -> DataFrame:
    """a, b, est: candidates whose signatures agree enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nx, ny = (batch.column(c).to_numpy() for c in (4, 5)) if forest.sized else (None, None)
                est, enough = forest.estimate(forest.signatures(batch.column(2)), forest.signatures(batch.column(3)), nx, ny)
                keep = pa.array(enough)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(est[enough], pa.float64())], names=["a", "b", "est"])

    more = ["n"] if forest.sized else []
    of = lambda c: sigs.select(F.col("rep").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("sig", *more)])
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sig_a", "sig_b", *[f"{x}_{c}" for x in more for c in "ab"]).mapInArrow(trimmed(work), "a long, b long, est double")


def _confirmed(proposals: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, linked: 100 times the intersection's size against percent times the union's, on full sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    of = lambda c: sets.select(F.col("id").alias(c), F.col("set").alias(f"set_{c}"))
    return proposals.join(of("a"), "a").join(of("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(trimmed(work), "a long, b long, linked boolean").groupBy("a", "b").agg(F.max("linked").alias("linked"))


def _connected_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of the edges of one task."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, comp = ends[: len(a)], ends[len(a) :], np.arange(len(ids))
    while True:
        new = comp.copy()
        least = np.minimum(comp[a], comp[b])
        np.minimum.at(new, comp[a], least)
        np.minimum.at(new, comp[b], least)
        new = new[new][comp]
        new = new[new]
        if (new == comp).all():
            break
        comp = new
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ids[comp], pa.int64())], names=["id", "comp"])


def connected(edges: DataFrame) -> DataFrame:
    """id, comp: the smallest id of each vertex's component.

    Edges that a count shows to be at most ``BROADCAST_ROWS`` meet in one task; more are settled by rounds of minima over
    neighbours and pointer jumps.
    """
    edges = edges.select("a", "b")
    if edges.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return edges.repartition(1).mapInArrow(_connected_here, "id long, comp long")
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        step = cut(labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("mid")))
        jump = step.select(F.col("id").alias("mid"), F.col("mid").alias("root"))
        new = cut(step.join(jump, "mid").select("id", "old", F.col("root").alias("comp")))
        labels = new.select("id", "comp")
        if new.filter("comp <> old").isEmpty():
            return labels


def _merged(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after links (a, b, ca, cb) between components; only these are looked at, not the links before."""
    new = connected(links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("id").alias("comp"), F.col("comp").alias("root"))
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("ca").alias("comp")), F.struct(F.col("b").alias("id"), F.col("cb").alias("comp")))).alias("x")).select("x.*")
    known = ends.distinct() if comps is None else ends.unionByName(comps).distinct()
    return cut(known.join(new, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")))


def _labelled(pairs: DataFrame, comps: DataFrame | None) -> DataFrame:
    """``pairs`` with the components of both ends; those within a component are dropped."""
    if comps is None:
        return pairs.withColumns({"ca": F.col("a"), "cb": F.col("b")})
    of = lambda c: comps.select(F.col("id").alias(c), F.col("comp").alias(f"_c{c}"))
    out = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return out.withColumns({"ca": F.coalesce("_ca", "a"), "cb": F.coalesce("_cb", "b")}).drop("_ca", "_cb").filter("ca <> cb")


def _sets_of(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """id, set, cut: repeated rows have one set, an id that repeats with other texts has several."""
    return cut(_full_sets(docs, cut(ids.distinct()), shingle).groupBy("id", F.xxhash64("set")).agg(F.first("set").alias("set")).select("id", "set"))


def _judged_in_rounds(docs: DataFrame, pairs: DataFrame, comps: DataFrame | None, shingle: int, percent: int) -> DataFrame | None:
    """Components after the candidates (a, b, est) were confirmed or refused, the best ones first."""
    if pairs.isEmpty():
        return comps
    sets, tried = _sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")), shingle), None
    for most in PROPOSALS:
        left = cut(_labelled(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), comps))
        if left.isEmpty():
            break
        best = left
        if most:
            order = Window.partitionBy("id").orderBy(F.desc("est"), "a", "b")
            ends = left.withColumn("id", F.explode(F.array("a", "b")))
            best = ends.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).select(*left.columns).distinct()
        judged = cut(_confirmed(best, sets, percent))
        tried = judged.select("a", "b") if tried is None else cut(tried.unionByName(judged.select("a", "b")))
        linked = cut(judged.filter("linked").select("a", "b").join(left.select("a", "b", "ca", "cb"), ["a", "b"]))
        if not linked.isEmpty():
            comps = _merged(comps, linked)
        release(docs)
    return comps


def _adapted(rows: DataFrame) -> DataFrame:
    """Rows (tree, label, id, comp) of regions with several components, with the parts (key, block) that each goes to.

    The depth of a region grows while it is crowded.
    """
    done, depth = None, SHALLOW
    while True:
        region = F.expr(f"substring(label, 1, {2 * depth})")
        several = rows.groupBy("tree", region.alias("region")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("classes")).filter("lo <> hi")
        here = cut(rows.withColumn("region", region).join(several.select("tree", "region", "classes"), ["tree", "region"]))
        crowded = here.filter(F.col("classes") > CROWDED)
        last = depth == DEPTH or crowded.isEmpty()
        part = here if last else here.filter(F.col("classes") <= CROWDED)
        done = part if done is None else done.unionByName(part)
        if last:
            break
        rows, depth = crowded.select(*rows.columns), depth + 1
    return in_blocks(done).select("tree", "label", "id", "comp", "parts")


def in_blocks(done: DataFrame) -> DataFrame:
    """Rows (tree, region, id, comp, classes of the region) with the parts (key, block) that each goes to.

    A region's largest component and the other classes are dealt into blocks: each block of the largest meets each of the
    others, and these meet each other. Classes of one component, as the copies of a large group are, don't meet.
    """
    sizes = done.groupBy("tree", "region", "comp").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("tree", "region").agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"), F.max("n").alias("n"))
    dealt = done.join(largest, ["tree", "region"])
    in_largest = F.col("comp") == F.col("largest")
    blocks = lambda n: F.ceil(n / BLOCK).cast("long")
    dealt = dealt.withColumns({"a": blocks(F.col("n")), "b": blocks(F.col("classes") - F.col("n"))})
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.when(in_largest, F.col("a")).otherwise(F.col("b"))))
    part = lambda kind, x, y, blk: F.struct(F.xxhash64("tree", "region", F.lit(kind), x, y).alias("key"), blk.cast("long").alias("blk"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), f)
    own = F.col("own")
    of_largest = each(F.col("b"), lambda y: part(0, own, y, F.lit(0)))
    of_others = F.concat(each(F.col("a"), lambda x: part(0, x, own, F.lit(1))), each(F.col("b"), lambda y: part(1, F.least(own, y), F.greatest(own, y), own)))
    return dealt.select(*done.columns, F.when(in_largest, of_largest).otherwise(of_others).alias("parts"))


def in_parts(rows: DataFrame) -> DataFrame:
    """A row for each part that it goes to."""
    return rows.withColumn("part", F.explode("parts")).select(*(c for c in rows.columns if c != "parts"), "part.key", "part.blk")


def _linked_in_regions(docs: DataFrame, trees: DataFrame, sigs: DataFrame, comps: DataFrame | None, shingle: int, forest: Forest) -> DataFrame | None:
    """Components after the trees' regions of several components were compared."""
    dealt = _adapted(with_components(trees, comps).select("tree", "label", "id", "comp"))
    release(docs)
    return linked_in_parts(docs, dealt, sigs, comps, shingle, forest)


def with_components(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """``rows`` with the component ``comp`` of each ``id``; one that has none is its own."""
    return rows.withColumn("comp", F.col("id")) if comps is None else rows.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def linked_in_parts(docs: DataFrame, dealt: DataFrame, sigs: DataFrame, comps: DataFrame | None, shingle: int, forest: Forest) -> DataFrame | None:
    """Components after the regions' parts (of ``in_blocks``) were compared in place, or by rounds if their sets are too large."""
    in_order = lambda rows: rows.repartition("key").sortWithinPartitions("key", "id")
    rows = in_parts(dealt.join(sigs.withColumnRenamed("rep", "id"), "id"))
    rows = cut(in_order(rows.select("key", "blk", "id", "comp", "n", "sig")).mapInArrow(trimmed(_involved(forest)), REGION))
    if rows.isEmpty():
        return comps
    large = cut(rows.groupBy("key").agg(F.sum(F.col("n") * 8).alias("size")).filter(F.col("size") > HELD_BYTES).select("key"))
    held = rows.join(large, "key", "left_anti")
    sets = _sets_of(docs, held.select("id"), shingle)
    release(docs)
    found = in_order(held.join(sets, "id").select("key", "blk", "id", "comp", "n", "sig", "set")).mapInArrow(trimmed(_links(forest)), "a long, b long")
    linked = cut(_labelled(found.filter("a <> b").distinct(), comps))
    if not linked.isEmpty():
        comps = _merged(comps, linked)
    if large.isEmpty():
        return comps
    rest = in_order(rows.join(large, "key", "left_semi"))
    more = rest.mapInArrow(_candidates(forest), "a long, b long").filter("a <> b").distinct()
    return _judged_in_rounds(docs, cut(_estimated(more, sigs, forest)), comps, shingle, forest.percent)


def components(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, linked at ``percent`` of Jaccard similarity and above."""
    forest = Forest(percent)
    all_docs = cut(sketches(docs, shingle, forest))
    of_class = [F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("labels", "sig")), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies")]
    classes = cut(all_docs.filter("fp is not null and doc_id is not null").groupBy("fp").agg(*of_class))
    tree = F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1))).alias("tree")
    trees = classes.select("rep", "labels", tree).select("tree", F.expr(f"substring(labels, tree * {LABEL} + 1, {LABEL})").alias("label"), F.col("rep").alias("id"))
    in_order = trees.repartitionByRange("tree", "label", "id").sortWithinPartitions("tree", "label", "id")
    found = in_order.mapInArrow(trimmed(_neighbours), "a long, b long").filter("a <> b").distinct()
    pairs = cut(_estimated(found, classes.select("rep", "n", "sig"), forest))
    comps = _judged_in_rounds(docs, pairs, None, shingle, percent)
    comps = _linked_in_regions(docs, trees, classes.select("rep", "n", "sig"), comps, shingle, forest)
    return of_documents(all_docs, classes, comps)


def of_documents(all_docs: DataFrame, classes: DataFrame, comps: DataFrame | None) -> DataFrame:
    """doc_id, n_shingles, component_id of all documents (doc_id, n_shingles, fp), given their classes (fp, rep, copies) and the components of these."""
    ends = classes.select("fp", "rep", "copies") if comps is None else classes.join(comps, classes["rep"] == comps["id"], "left").select("fp", F.coalesce("comp", "rep").alias("rep"), "copies")
    ends = cut(ends)
    # documents without words join nothing, and the copies of a large class don't meet in one task
    hot = small(ends.filter(F.col("copies") >= COPIES).select("fp", "rep"))
    with_words = all_docs.filter("fp is not null").select("doc_id", "n_shingles", "fp")
    many = with_words.join(hot, "fp")
    others = with_words.join(hot, "fp", "left_anti").join(ends.filter(F.col("copies") < COPIES).select("fp", "rep"), "fp", "left")
    alone = all_docs.filter("fp is null").select("fp", "doc_id", "n_shingles", F.col("doc_id").alias("rep"))
    out = many.unionByName(others).unionByName(alone)
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("component_id"))


def report(docs: DataFrame, shingle: int = 3, percent: int = 85) -> DataFrame:
    """The contract's columns."""
    return components(docs, shingle, percent).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def distinct(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, the first of its smallest id (one without an id only if none has one); rows without words stay.

    Rows are told apart by their place, so an id that repeats with other texts is in several components. Plans must give
    the rows in the same order each time, as those of stored tables do.
    """
    keyed = docs.withColumn("_key", F.monotonically_increasing_id())
    c = cut(components(keyed.select(F.col("_key").alias("doc_id"), "text"), shingle, percent).select(F.col("doc_id").alias("_key"), "component_id"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("first")
    kept = c.join(keyed.select("_key", "doc_id"), "_key").groupBy("component_id").agg(first).select(F.col("first._key").alias("_key"))
    gone = cut(c.select("_key").join(kept, "_key", "left_anti"))
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return keyed.join(F.broadcast(gone) if few else gone, "_key", "left_anti").drop("_key")
