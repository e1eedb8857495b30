"""Jaccard self-join of documents' sets of word n-grams: a grouped prefix join, exact.

1. Shingles are ordered by how often their hash bucket occurs in all documents, rare ones first, then by hash. The counts
   of ``BUCKETS`` buckets are a table of fixed size, whatever the input; it is summed slice by slice and broadcast.
2. A set's prefix is its first n - ceil(t n) + 1 shingles: two sets that are alike enough share one there, and the smaller
   set has it among its first n - ceil(2t/(1+t) n) + 1 (its index prefix). Documents of equal sets are one class, and
   classes of equal prefix and size are one group; only groups are posted by shingle.
3. Classes first meet a few neighbours under ``TOKENS`` shingles of their prefix, and what is linked is merged in rounds, so
   that the copies of a group cost a few confirmations each. This step loses nothing, as it decides nothing.
4. Posting lists that still hold two groups of different components, with one of these in its index prefix, are group pairs
   left to be judged; lists of the same groups are one region. Their groups are expanded to members and dealt into blocks, and
   pairs across components are looked at in place: first by size, then by bitmaps, whose Hamming distance never exceeds the sets'
   difference, so no pair is lost by it. A bitmap has ``BITS`` bits, and that of a large set a second
   one with a bit for two shingles at least, as a small one is full. A group whose own members lie in several
   components is a region, too. No list is gathered whole in a task, and no pairs within a component are made.
5. Sets that are alike enough by that meet under many shingles, so they are joined to clusters (a block gives a forest of its
   pairs, not the pairs), in which every set stands once; clusters are dealt into blocks like regions and judged on full sets.

Everything that decides is exact but for 64-bit fingerprints of shingles.

Cases: a null or empty text has an empty set, links with nothing and is its own component; ids that repeat join their
classes; rows without an id have a null component; texts of any length are hashed whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small, trimmed
from .hashing import mixed
from .neardup import NEIGHBOURS, REGION, _chunks, _judged_in_rounds, _sets, across, connected, in_blocks, in_parts, linked_in_parts, of_documents, regions, with_components

#: Buckets of the counts (a power of two) and how many slices they are summed in.
BUCKETS, SLICES = 1 << 21, 64
#: Bits of a set's bitmap; sets of more than twice as many shingles have a wider one, too.
BITS = 1024
#: Shingles of a prefix under which a class meets its neighbours before the join proper.
TOKENS = 8


@dataclass(frozen=True)
class Bitmaps:
    """What a threshold, in percent, asks of sets of given sizes and of their bitmaps."""

    percent: int
    sized = True

    def prefix(self, n: int) -> int:
        return n + self.percent * n // -100 + 1

    def index_prefix(self, n: int) -> int:
        return n + 2 * self.percent * n // -(100 + self.percent) + 1

    def signatures(self, column: pa.Array) -> np.ndarray:
        """The bitmaps of a column, one after the other in bytes."""
        out = np.empty(len(column), object)
        out[:] = column.to_pylist()
        return out

    def estimate(self, x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The most that similarities can be by sizes and bitmaps, and which are enough."""
        est, enough = self._most(_first(x), _first(y), nx, ny)
        for k in np.flatnonzero(enough).tolist():
            if min(len(x[k]), len(y[k])) > BITS // 8:
                est[k], enough[k] = self._most(*_wide(x[k], y[k]), nx[k], ny[k])
        return est, enough

    def comparing(self, sig: np.ndarray, n: np.ndarray):
        """Of a part's rows: which of the rows ``near`` may be linked with row i."""
        first, wide = _first(sig), np.array([len(x) > BITS // 8 for x in sig], bool)

        def alike(i: int, near: np.ndarray) -> np.ndarray:
            enough = self._most(first[near], first[i], n[near], n[i])[1]
            for k in np.flatnonzero(enough & wide[near]).tolist() if wide[i] else ():
                enough[k] = self._most(*_wide(sig[near[k]], sig[i]), n[near[k]], n[i])[1]
            return enough

        return alike

    def _most(self, x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart = np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
        both = np.minimum((nx + ny - apart) // 2, np.minimum(nx, ny))
        union = nx + ny - both
        return both / np.maximum(union, 1), 100 * both >= self.percent * union


def _first(sig: np.ndarray) -> np.ndarray:
    """The first bitmap of each, as 64-bit words."""
    return np.frombuffer(b"".join(x[: BITS // 8] for x in sig), np.uint64).reshape(len(sig), BITS // 64)


def _wide(x: bytes, y: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The second bitmaps of two sets, the wider one folded to the width of the other."""
    x, y = (np.frombuffer(v, np.uint64)[BITS // 64 :] for v in (x, y))
    size = min(len(x), len(y))
    return tuple(np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (x, y))


def _bucket(s: np.ndarray, buckets: int) -> np.ndarray:
    return (s >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


def bucket_counts(docs: DataFrame, shingle: int) -> np.ndarray:
    """How often each bucket's shingles occur in the documents' sets, as 32-bit numbers."""
    buckets, slices = BUCKETS, SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for _, texts in _chunks(batches):
            counts += np.bincount(_bucket(np.concatenate(list(_sets(texts, shingle))), buckets), minlength=buckets)
        for i, part in enumerate(np.minimum(counts, 0xFFFFFFFF).astype(np.uint32).reshape(slices, -1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # of the slices of one task
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(part, np.uint32).astype(np.int64)
        for i, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.minimum(part, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())], names=["slice", "counts"])

    kinds = "slice int, counts binary"
    parts = docs.select("text").mapInArrow(trimmed(count), kinds).repartition(slices, "slice").mapInArrow(trimmed(add), kinds).collect()  # SLICES rows, BUCKETS numbers in all
    out = np.zeros((slices, buckets // slices), np.uint32)
    for r in parts:
        out[r["slice"]] = np.frombuffer(r["counts"], np.uint32)
    return out.ravel()


def _bitmap(s: np.ndarray) -> bytes:
    """For each bit whether an odd number of shingles hash to it; a large set has a wider bitmap after the first."""
    bits = BITS
    while 2 * bits < len(s):
        bits *= 2
    odd = np.bincount((mixed(s ^ np.uint64(0xA5A5)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    packed = np.packbits(odd.astype(np.uint8))
    if bits == BITS:
        return packed.tobytes()
    return np.bitwise_xor.reduce(packed.reshape(-1, BITS // 8), axis=0).tobytes() + packed.tobytes()


def sketches(docs: DataFrame, counts: Broadcast, shingle: int, sides: Bitmaps) -> DataFrame:
    """doc_id, n_shingles, fp (of the set; null if empty), prefix (packed shingles in order), sig (bitmap)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for batch, texts in _chunks(batches):
            n, fps, prefixes, sigs = [], [], [], []
            for s in _sets(texts, shingle):
                n.append(len(s))
                if not len(s):
                    for x in (fps, prefixes, sigs):
                        x.append(None)
                    continue
                fps.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                # the set is in order of hashes, so a stable sort keeps that order among equals
                prefixes.append(s[np.argsort(often[_bucket(s, len(often))], kind="stable")[: sides.prefix(len(s))]].tobytes())
                sigs.append(_bitmap(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (fps, prefixes, sigs))], names=["doc_id", "n_shingles", "fp", "prefix", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(work), "doc_id long, n_shingles long, fp binary, prefix binary, sig binary")


def _tokens(most: int):
    """Of classes (rep, n, prefix, sig): a row for each of the ``most`` shingles of the prefix that hash lowest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, tokens = [], []
            for i, p in enumerate(batch.column(2)):
                s = np.frombuffer(p.as_buffer(), np.uint64)
                h = np.sort(mixed(s ^ np.uint64(0x5A5A)))[:most]
                rows.append(np.full(len(h), i))
                tokens.append(h)
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), *(batch.column(c).take(at) for c in (1, 0, 3))], names=["h", "n", "rep", "sig"])

    return work


def _met(sides: Bitmaps):
    """Of rows (h, n, rep, sig) in order: pairs (a, b, est) of a row with the next few of its shingle, if they may be linked."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [*(c.to_numpy() for c in batch.columns[:3]), sides.signatures(batch.column(3))]
            old = 0 if held is None else min(NEIGHBOURS, len(held[0]))
            h, n, rep, sig = new if held is None else [np.concatenate([x[-NEIGHBOURS:], y]) for x, y in zip(held, new, strict=True)]
            held = [h, n, rep, sig]
            out = []
            for d in range(1, min(NEIGHBOURS, len(h) - 1) + 1):
                at = np.flatnonzero((h[:-d] == h[d:]) & (rep[:-d] != rep[d:]))
                at = at[at >= old - d]  # pairs among the rows carried over were given before
                est, enough = sides.estimate(sig[at], sig[at + d], n[at], n[at + d])
                x, y = rep[at[enough]], rep[at[enough] + d]
                out.append((np.minimum(x, y), np.maximum(x, y), est[enough]))
            if out:
                a, b, est = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(est, pa.float64())], names=["a", "b", "est"])

    return work


def _posted(sides: Bitmaps):
    """Of groups (lead, n, prefix, lo, hi): a row (h, lead, lo, hi, short) for each shingle of the prefix, marked if it is of the index prefix."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                sizes = [len(p.as_buffer()) // 8 for p in part.column(2)]
                h = np.concatenate([np.frombuffer(p.as_buffer(), np.int64) for p in part.column(2)])
                at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                short = np.concatenate([np.arange(size) < sides.index_prefix(n) for size, n in zip(sizes, part.column(1).to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(h), *(part.column(c).take(at) for c in (0, 3, 4)), pa.array(short)], names=["h", "lead", "lo", "hi", "short"])

    return work


def _forest(sides: Bitmaps):
    """Of ``REGION`` rows in order: pairs (a, b) that may be linked, as many as join what such pairs join in a part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, blk, ids, comp, n, sig), edges in regions(batches, sides):
            a, b = [], []
            for lo, hi in zip(edges, edges[1:], strict=False):
                tree = np.arange(hi - lo)
                for i, near in across(blk[lo:hi], comp[lo:hi], sig[lo:hi], n[lo:hi], sides):
                    others, first = np.unique(tree[near], return_index=True)
                    for other, j in zip(others.tolist(), near[first].tolist(), strict=True):
                        if other != tree[i]:
                            a.append(ids[lo + i])
                            b.append(ids[lo + j])
                            tree[tree == other] = tree[i]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])

    return work


def _clusters(classes: DataFrame, comps: DataFrame | None, sides: Bitmaps) -> DataFrame | None:
    """tree, region, id, comp, classes: the sets that may be linked across components, each in its cluster."""
    rows = in_parts(in_blocks(_regions(classes, comps, sides)).join(classes.select(F.col("rep").alias("id"), "n", "sig"), "id"))
    rows = rows.select(*(f.split()[0] for f in REGION.split(", "))).repartition("key").sortWithinPartitions("key", "id")
    edges = cut(rows.mapInArrow(trimmed(_forest(sides)), "a long, b long").filter("a <> b").distinct())
    if edges.isEmpty():
        return None
    found = cut(with_components(connected(edges).select("id", F.col("comp").alias("region")), comps))
    return found.join(found.groupBy("region").agg(F.count(F.lit(1)).alias("classes")), "region").withColumn("tree", F.lit(2))


def _regions(classes: DataFrame, comps: DataFrame | None, sides: Bitmaps) -> DataFrame:
    """tree, region, id, comp, classes: the members of groups in posting lists, and of groups, that lie in several components."""
    of = with_components(classes.select(F.col("rep").alias("id"), "n", "pkey"), comps)
    groups = cut(of.groupBy("n", "pkey").agg(F.min("id").alias("lead"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("members")))
    leads = groups.select("lead", "lo", "hi").join(classes.select(F.col("rep").alias("lead"), "n", "prefix"), "lead")
    posted = leads.select("lead", "n", "prefix", "lo", "hi").mapInArrow(trimmed(_posted(sides)), "h long, lead long, lo long, hi long, short boolean")
    of_list = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("groups"), F.max("short").alias("short"), F.bit_xor(F.xxhash64("lead")).alias("x"), F.bit_xor(F.xxhash64("lead", F.lit(1))).alias("y")]
    lists = posted.groupBy("h").agg(*of_list).filter("groups > 1 and short and lo <> hi")
    left = cut(lists.groupBy("x", "y", "groups").agg(F.min("h").alias("h")).select("h"))  # lists of the same groups are judged once
    pairs_left = posted.select("h", "lead").join(small(left), "h")
    crowd = cut(of.join(groups.filter("members > 1").select("n", "pkey", "lead", "lo", "hi"), ["n", "pkey"]).select("lead", "id", "comp", "lo", "hi"))
    alone = with_components(pairs_left.join(small(crowd.select("lead").distinct()), "lead", "left_anti").withColumnRenamed("lead", "id"), comps)
    expanded = pairs_left.join(crowd.select("lead", "id", "comp"), "lead")
    columns = ["tree", "region", "id", "comp"]
    rows = alone.select(F.lit(0).alias("tree"), F.col("h").alias("region"), "id", "comp")
    rows = rows.unionByName(expanded.select(F.lit(0).alias("tree"), F.col("h").alias("region"), "id", "comp"))
    rows = cut(rows.unionByName(crowd.filter("lo <> hi").select(F.lit(1).alias("tree"), F.col("lead").alias("region"), "id", "comp")).select(columns))
    sizes = rows.groupBy("tree", "region").agg(F.count(F.lit(1)).alias("classes"))
    return rows.join(sizes, ["tree", "region"])


def components(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, linked at ``percent`` of Jaccard similarity and above."""
    sides = Bitmaps(percent)
    counts = docs.sparkSession.sparkContext.broadcast(bucket_counts(docs, shingle))
    all_docs = cut(sketches(docs, counts, shingle, sides))
    of_class = [F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("prefix", "sig")), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies")]
    classes = cut(all_docs.filter("fp is not null and doc_id is not null").groupBy("fp").agg(*of_class).withColumn("pkey", F.unhex(F.md5("prefix"))))
    met = classes.select("rep", "n", "prefix", "sig").mapInArrow(trimmed(_tokens(TOKENS)), "h long, n long, rep long, sig binary")
    in_order = met.repartitionByRange("h", "n", "rep").sortWithinPartitions("h", "n", "rep")
    pairs = cut(in_order.mapInArrow(trimmed(_met(sides)), "a long, b long, est double").groupBy("a", "b").agg(F.max("est").alias("est")))
    comps = _judged_in_rounds(docs, pairs, None, shingle, percent)
    clusters = _clusters(classes, comps, sides)
    if clusters is not None:
        comps = linked_in_parts(docs, in_blocks(clusters), classes.select("rep", "n", "sig"), comps, shingle, sides)
    return of_documents(all_docs.select("doc_id", "n_shingles", "fp"), classes, comps)


def report(docs: DataFrame, shingle: int = 4, percent: int = 85) -> DataFrame:
    """The contract's columns."""
    return components(docs, shingle, percent)
