"""Alignment of two tokenizers' tokens over the same bytes, with the corpus-wide counts of linked ids: a postings cogroup.

1. A text (with a space before it) is cut where both tokenizers are known to end a token; each distinct piece is encoded by
   both and aligned once while it is cached. A document's links are those of its pieces, and so are its groups.
2. A chunk of documents gives, for each slot of side-B ids, its posting list: (pair of ids, document of the chunk,
   multiplicity), and the chunk's total of each pair. Both are packed; nothing is a row for each link.
3. Lists are shuffled by slot, as spillable streams in the order of the sort: the totals come first and are summed to the
   count of each pair and each B id's maximum, of which there are no more than pairs of vocabulary entries, whatever
   the corpus; the posting lists follow one by one, and each gives its documents' contributions.
4. Contributions are summed by chunk, which gives the sums by document.

A slot holds all of a B id's totals, but a hot slot's posting lists are dealt over several tasks by chunk, in proportion to
its bytes; each of these tasks gets the slot's totals. So a token with a third of all links is not one task's alone.

Cases: null and empty texts, and texts whose tokens of either side don't give back the text's bytes, have zeros and an empty
digest, and their pairs don't count; repeated rows count each; a null id is kept; texts of any length are aligned whole;
special tokens' strings are plain text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import cut, trimmed

#: Characters of a chunk of texts, unless one text has more; pieces in a worker's cache, which is emptied when full.
CHUNK, CACHED = 1 << 20, 200_000
#: Slots of side-B ids: the session's shuffle partitions within these bounds.
SLOTS = (64, 1024)
#: Totals held apart in a task before they are summed.
HELD = 1 << 21

_WHITE = "".join(re.escape(chr(c)) for c in bpe.WHITE_SPACE)
#: Pieces of a text: one word and the white space that ends in a space before it; white space but for the last sign before a
#: word, as the first tokenizer takes that one for itself; that sign, or the white space at the end; a word after it.
_PIECES = re.compile(f"[{_WHITE}]* [^{_WHITE}]+|[{_WHITE}]+(?=[{_WHITE}][^{_WHITE}])|[{_WHITE}]+|[^{_WHITE}]+")
#: A lone space between words: both tokenizers begin a token there, whatever white space the second one's pieces hold.
_BETWEEN = re.compile(f"(?<=[^{_WHITE}]) (?=[^{_WHITE}])")
SPACE_MARK = "▁"


class SidePieces:
    """A sentencepiece model: ids of pieces of texts, and the bytes of its tokens."""

    #: A character that no vocabulary entry may hold, so that nothing merges across it.
    GUARD = "\n"

    def __init__(self, path: str):
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.bytes = [bytes([int(name[3:-1], 16)]) if m.is_byte(i) else name.replace(SPACE_MARK, " ").encode() for i, name in enumerate(names)]
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)
        self.space = m.piece_to_id(SPACE_MARK)
        plain = [name for i, name in enumerate(names) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        #: whether a word's tokens end before a space, and white space that is part of longer entries
        self.splits = not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", name) or self.GUARD in name for name in plain)
        white = set(map(chr, bpe.WHITE_SPACE)) - {" "}
        self.mixed = re.compile("[" + "".join(re.escape(c) for c in sorted(white & set("".join(name for name in plain if len(name) > 1)))) + "\0]")
        self.of_guard = len(m.encode(self.GUARD)) if self.splits else 0

    def pieces(self, text: str) -> list[str]:
        """The text with a space before it, cut where both tokenizers end a token."""
        if not self.splits:
            return [" " + text]
        if self.mixed.search(text):
            return [" " + x for x in _BETWEEN.split(text)]
        return _PIECES.findall(" " + text)

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """The ids of pieces. The library puts a space before each text, so a piece without one is encoded after a guard."""
        led = [p[1:] if p[0] == " " else self.GUARD + p for p in pieces]
        ids = self.model.encode(led, num_threads=1)
        return [([self.space] if p == " " else x) if p[0] == " " else x[self.of_guard :] for p, x in zip(pieces, ids, strict=True)]


class Aligner:
    """Pieces of texts with their links (a, b) and groups; those of each distinct piece are kept in a bounded cache."""

    def __init__(self, path_a: str, path_b: str, cached: int):
        self.a, self.b, self.cached = bpe.vocabulary(path_a), SidePieces(path_b), cached
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.counts = np.empty((4, 0), np.int64)  # tokens of a and b, groups, links
        self.whole = np.empty(0, bool)
        self.begin, self.links = np.empty(0, np.int64), np.empty((2, 0), np.int64)

    def _add(self, new: list[str]) -> None:
        """Aligns new pieces all at once: laid end to end, the tokens of both sides have ends in the same line of bytes."""
        data = [p.encode() for p in new]
        all_b = self.b.encode(new)
        whole = np.array([b"".join(map(self.b.bytes.__getitem__, ids)) == d for ids, d in zip(all_b, data, strict=True)], bool)
        for p in new:
            self.known[p] = len(self.known)
        ids_a, n_a = self.a.pieces.encode([p for p, w in zip(new, whole, strict=True) if w])
        ids_a = ids_a.astype(np.int64)
        kept = [ids for ids, w in zip(all_b, whole, strict=True) if w]
        n_b = np.fromiter(map(len, kept), np.int64, len(kept))
        ids_b = np.fromiter(chain.from_iterable(kept), np.int64, int(n_b.sum()))
        ends_a, ends_b = np.cumsum(self.a.offsets[ids_a + 1] - self.a.offsets[ids_a]), np.cumsum(self.b.lengths[ids_b])
        first = np.searchsorted(ends_a, ends_b - self.b.lengths[ids_b], "right")
        many = np.searchsorted(ends_a, ends_b, "left") - first + 1
        done = np.cumsum(many)
        links = np.stack([ids_a[np.repeat(first - done + many, many) + np.arange(int(many.sum()))], np.repeat(ids_b, many)])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        of_a, of_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        at = lambda of: np.searchsorted(of, np.arange(len(both) + 1)).tolist()
        at_a, at_b, text_a, text_b = at(of_a), at(of_b), list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        texts = [",".join(text_a[at_a[i] : at_a[i + 1]]) + "|" + ",".join(text_b[at_b[i] : at_b[i + 1]]) for i in range(len(both))]
        last_b = np.cumsum(n_b)
        last_group = of_b[last_b - 1] + 1 if len(n_b) else np.empty(0, np.int64)
        n_links = np.diff(np.concatenate([[0], done])[last_b], prepend=0)
        counts = np.zeros((4, len(new)), np.int64)
        counts[:, whole] = np.stack([n_a, n_b, np.diff(last_group, prepend=0), n_links]) if len(n_b) else 0
        ends = iter(last_group.tolist())
        at_group = 0
        for w in whole.tolist():
            if w:
                end = next(ends)
                self.groups.append(";".join(texts[at_group:end]).encode())
                at_group = end
            else:
                self.groups.append(b"")
        self.begin = np.concatenate([self.begin, self.links.shape[1] + np.cumsum(counts[3]) - counts[3]])
        self.links = np.concatenate([self.links, links], axis=1)
        self.counts = np.concatenate([self.counts, counts], axis=1)
        self.whole = np.concatenate([self.whole, whole])

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: tokens of a and b, groups, links; the groups' digest. Of all links: documents, ids and multiplicities
        (document, a, b, m), each triple once a piece."""
        if len(self.known) > self.cached:
            self._empty()
        pieces = [self.b.pieces(t) if t and SPACE_MARK not in t else [] for t in texts]
        flat = list(chain.from_iterable(pieces))
        new = [p for p in dict.fromkeys(flat) if p not in self.known]
        if new:
            self._add(new)
        numbers = list(map(self.known.__getitem__, flat))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        doc, number = np.repeat(np.arange(len(texts)), sizes), np.array(numbers, np.int64)
        failed = np.zeros(len(texts), bool)
        failed[doc[~self.whole[number]]] = True
        at, digests = 0, []
        for n, bad in zip(sizes.tolist(), failed.tolist(), strict=True):
            digests.append(hashlib.sha256(b";".join(map(self.groups.__getitem__, numbers[at : at + n]))).hexdigest() if n and not bad else "")
            at += n
        keep = ~failed[doc]
        key, times = np.unique(doc[keep] * len(self.groups) + number[keep], return_counts=True)
        doc, number = np.divmod(key, max(1, len(self.groups)))
        totals = np.zeros((4, len(texts)), np.int64)
        for i in range(4):
            np.add.at(totals[i], doc, self.counts[i, number] * times)
        size = self.counts[3, number]
        ends = np.cumsum(size)
        link = np.repeat(self.begin[number] - ends + size, size) + np.arange(int(size.sum()))
        return totals, digests, np.repeat(doc, size), self.links[:, link], np.repeat(times, size)


@cache
def aligner(path_a: str, path_b: str, cached: int) -> Aligner:
    """One a worker process, read from the paths that each executor has."""
    return Aligner(path_a, path_b, cached)


# --- packed lists ---

_KINDS = (np.uint8, np.uint16, np.uint32, np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0 on, each in the narrowest kind, compressed."""
    out = []
    for x in arrays:
        kind = next(i for i, k in enumerate(_KINDS) if not len(x) or x.max() <= np.iinfo(k).max)
        out += [np.array([kind, len(x)], np.int64).tobytes(), x.astype(_KINDS[kind]).tobytes()]
    data = b"".join(out)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 0
    while at < len(raw):
        kind, n = np.frombuffer(raw, np.int64, 2, at)
        x = np.frombuffer(raw, _KINDS[kind], int(n), at + 16)
        out.append(x.astype(np.int64))
        at += 16 + x.nbytes
    return out


def _slot_order(ids: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """A place of each B id in the order of slots, and where each slot begins in it, with the end."""
    slot = (np.arange(ids, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % slots
    order = np.argsort(slot, kind="stable")
    place = np.empty(ids, np.int64)
    place[order] = np.arange(ids)
    return place, np.searchsorted(slot[order], np.arange(slots + 1))


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
CHUNKS = ", ".join(["doc_id array<long>", *(f"{c} array<long>" for c in _COUNTS), "digest array<string>", "lists array<struct<slot:int,totals:binary,posts:binary>>"])


def _chunks_of(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, list[str]]]:
    at = 0
    for texts in bpe._chunks((t.as_py() or "" for t in batch.column(1)), most):
        yield at, texts
        at += len(texts)


def _aligned(path_a: str, path_b: str, slots: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each chunk of documents (``CHUNKS``)."""
    kinds = pa.list_(pa.struct([("slot", pa.int32()), ("totals", pa.binary()), ("posts", pa.binary())]))
    most, cached = CHUNK, CACHED

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b, cached)
        place, begins = _slot_order(len(both.b.bytes), slots)
        for batch in batches:
            for at, texts in _chunks_of(batch, most):
                counts, digests, doc, (a, b), times = both.align(texts)
                key = (place[b] * both.a.size + a) * len(texts) + doc  # by slot, B id, A id, document
                order = np.argsort(key)
                key, times = key[order], times[order]
                first = np.flatnonzero(np.diff(key, prepend=-1))
                times = np.add.reduceat(times, first) if len(first) else times
                pair, doc = np.divmod(key[first], len(texts))
                edges = np.searchsorted(pair, begins * both.a.size)
                lists = []
                for slot in np.flatnonzero(np.diff(edges)).tolist():
                    own = slice(edges[slot], edges[slot + 1])
                    p, d, m = pair[own], doc[own], times[own]
                    new = np.flatnonzero(np.diff(p, prepend=-1))
                    steps = np.diff(p[new], prepend=0)
                    lists.append({"slot": slot, "totals": pack(steps, np.add.reduceat(m, new)), "posts": pack(steps, np.diff(np.append(new, len(p))), d, m)})
                columns = [batch.column(0).slice(at, len(texts)).to_pylist(), *counts.tolist()]
                yield pa.RecordBatch.from_arrays([*(pa.array([c], pa.list_(pa.int64())) for c in columns), pa.array([digests], pa.list_(pa.string())), pa.array([lists], kinds)], names=["doc_id", *_COUNTS, "digest", "lists"])

    return work


def _contributions(size_a: int, most_held: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of lists (slot, part, kind, chunk, list) in order, totals (kind 0) before postings: the documents' sums by chunk (chunk, sums)."""

    def summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        code, count = np.concatenate(codes), np.concatenate(counts)
        order = np.argsort(code, kind="stable")
        code, count = code[order], count[order]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        return code[first], np.add.reduceat(count, first)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, codes, counts, best, held = None, [], [], None, 0
        for batch in batches:
            chunks, sums = [], []
            for slot, part, kind, chunk, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (slot, part):
                    key, codes, counts, best, held = (slot, part), [], [], None, 0
                steps, number, *posts = unpack(data)
                code = np.cumsum(steps)
                if not kind:
                    codes.append(code)
                    counts.append(number)
                    held += len(code)
                    if held > most_held and len(codes) > 1:
                        code, count = summed(codes, counts)
                        codes, counts, held = [code], [count], max(0, len(code) - most_held // 2)
                    continue
                if best is None:
                    code_of, count_of = summed(codes, counts)
                    first = np.flatnonzero(np.diff(code_of // size_a, prepend=-1))
                    most = np.maximum.reduceat(count_of, first)
                    best = count_of == np.repeat(most, np.diff(np.append(first, len(code_of))))
                    codes, counts = [], []
                at = np.repeat(np.searchsorted(code_of, code), number)
                doc, times = posts
                docs, of = np.unique(doc, return_inverse=True)
                n_best, count_sum = np.zeros((2, len(docs)), np.int64)
                np.add.at(n_best, of, np.where(best[at], times, 0))
                np.add.at(count_sum, of, times * count_of[at])
                chunks.append(chunk)
                sums.append(pack(docs, n_best, count_sum))
            if chunks:
                yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(sums, pa.binary())], names=["chunk", "sums"])

    return work


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sums (chunk, sums) in order: one row a chunk, with the sums of its documents in order (chunk, n_best, count_sum)."""
    chunk, total = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in total)], names=["chunk", "n_best", "count_sum"])

    for batch in batches:
        for c, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if c != chunk:
                if chunk is not None:
                    yield row()
                chunk, total = c, np.zeros((2, 0), np.int64)
            docs, *sums = unpack(data)
            if docs[-1] >= total.shape[1]:
                total = np.pad(total, ((0, 0), (0, int(docs[-1]) + 1 - total.shape[1])))
            total[:, docs] += np.stack(sums)
    if chunk is not None:
        yield row()


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    ``path_a``: ranks of a byte-level BPE; ``path_b``: a sentencepiece model. See the query ``op12_token_alignment``.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = min(max(tasks, SLOTS[0]), SLOTS[1])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(_aligned(path_a, path_b, slots)), CHUNKS)
    chunks = cut(rows.withColumn("chunk", F.monotonically_increasing_id()))
    lists = chunks.select("chunk", F.inline("lists"))
    size = lists.groupBy("slot").agg(F.sum(F.octet_length("posts")).alias("size"))  # a row a slot
    total = size.agg(F.sum("size").alias("all"))
    parts = F.ceil(F.col("size") * max(tasks, slots) / F.col("all")).cast("int").alias("parts")
    sized = lists.join(F.broadcast(size.crossJoin(F.broadcast(total)).select("slot", parts)), "slot")  # one total, at most SLOTS[1] rows
    posts = sized.select("slot", F.pmod(F.xxhash64("chunk"), "parts").cast("int").alias("part"), F.lit(1).alias("kind"), "chunk", F.col("posts").alias("list"))
    totals = sized.select("slot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "chunk", F.col("totals").alias("list"))
    stream = posts.unionByName(totals).repartition("slot", "part").sortWithinPartitions("slot", "part", "kind", "chunk")
    sums = stream.mapInArrow(trimmed(_contributions(bpe.vocabulary(path_a).size, HELD)), "chunk long, sums binary")
    by_chunk = sums.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(trimmed(_summed), "chunk long, n_best array<long>, count_sum array<long>")
    fields = ["doc_id", *_COUNTS, "digest"]
    zipped = F.inline(F.arrays_zip(*fields, F.coalesce("n_best", F.array().cast("array<long>")).alias("n_best"), F.coalesce("count_sum", F.array().cast("array<long>")).alias("count_sum")))
    found = chunks.select("chunk", *fields).join(by_chunk, "chunk", "left").select(zipped)
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return found.select("doc_id", *_COUNTS, number("n_best"), number("count_sum"), F.col("digest").alias("groups_sha256"))
