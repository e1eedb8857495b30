"""Token-id files by an adaptive context-mixing range coder.

Documents are dealt by ranges of their ids and encoded in order. A file's row is a group of documents; the group's ids are
cut into blocks of at most ``STRIPES * STEPS`` ids. A block is coded from a reset model, has a checksum and can be read
alone. Its ids are laid out in ``STRIPES`` stripes that advance together, so a step codes an id of every stripe by a few
array operations, and all stripes of a block learn from what each has coded.

The model of a block predicts the next id thrice. Orders 2 and 1: an id for each context of two and of one id before,
with a confidence that grows when it holds. Order 0: the adaptive distribution of all the block's ids so far, taken
anew at the steps of ``_rebuilt``. The three are mixed: how often the order-2 id, the order-1 id or neither held before,
at the same two confidences, divides the coder's range between them, and order 0 divides the rest among all ids.
The range coder is a 64-bit one that emits words of 32 bits; carries are added when a block is closed.

Cases: a null or empty text has only the end id; rows without an id come first, spread by their text; repeated ids are kept
in an order by text length; texts of any length are whole in one group; an empty table gives no rows; other columns are
ignored; a damaged block is an error that names it.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe
from .common import shared_folder, trimmed

STRIPES, STEPS = 512, 512
#: Ids of a group, 16 blocks; a longer document is a group by itself.
GROUP = 16 * STRIPES * STEPS
#: Slots of the contexts of one and two ids in a block; powers of two.
SLOTS_1, SLOTS_2 = 1 << 14, 1 << 16
#: Bits of the level of confidence; a context's entry is its id above its level.
LEVEL_BITS = 3
LEVELS = 1 << LEVEL_BITS
#: Bits into which the range is divided, at most the 32 that it always has; order 0 has these or more of them, the mixing the rest.
RANGE_BITS, ORDER_0_BITS = 30, 18
#: Entries of a worker's cache of encoded pieces.
CACHED = 1_000_000
_WORD = np.uint64(32)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)

# --- model and coder, all stripes of all blocks of a group in step ---


def _rebuilt(step: int) -> bool:
    """Steps at which order 0 is taken anew: powers of two, then each 128th."""
    return step & (step - 1) == 0 if step < 128 else step % 128 == 0


class _Model:
    def __init__(self, blocks: int, vocabulary: int, slots: bool):
        self.blocks, self.size, self.slots = blocks, vocabulary, slots
        self.bits = max(ORDER_0_BITS, int(vocabulary).bit_length() + 2)
        self.mix_bits = RANGE_BITS - self.bits
        if self.mix_bits < 4:
            raise ValueError(f"a vocabulary of {vocabulary} ids is too large")
        self.block = np.repeat(np.arange(blocks, dtype=np.int64), STRIPES)
        # orders 1 and 2 in two rows: the slots of order 2 follow those of order 1
        self.of = np.stack([self.block * SLOTS_1, blocks * SLOTS_1 + self.block * SLOTS_2])
        self.of_id, self.of_mix = self.block * (vocabulary + 1), self.block * (2 * LEVELS * LEVELS)
        self.table = np.zeros(blocks * (SLOTS_1 + SLOTS_2), np.int32)
        self.at = np.empty_like(self.of)
        self.held = np.ones((3, blocks * 2 * LEVELS * LEVELS), np.int64)
        self.counts = np.zeros((blocks, vocabulary), np.int64)
        self.before, self.before_2 = np.zeros(len(self.block), np.int64), np.zeros(len(self.block), np.int64)
        self.new: list[np.ndarray] = []

    def order_0(self) -> None:
        """Cumulative shares of all ids of each block, and for reading the id at each place of the range."""
        total = 1 << self.bits
        if self.new:
            at = np.concatenate([x + self.block * self.size for x in self.new])
            self.counts += np.bincount(at, minlength=self.counts.size).reshape(self.counts.shape)
            self.new = []
        seen = np.concatenate([np.zeros((self.blocks, 1), np.int64), np.cumsum(self.counts, axis=1)], axis=1)
        places = np.arange(self.size + 1)
        n = seen[:, -1:]
        # each id has a place at least; the others go by the counts (doubles hold these products and their floors alike everywhere)
        shares = places + (seen * ((total - self.size) / np.maximum(n, 1))).astype(np.int64)
        shares[:, -1] = total
        self.cumulative = np.where(n > 0, shares, places * total // self.size)
        if self.slots:
            ids = np.tile(np.arange(self.size, dtype=np.uint16 if self.size <= 1 << 16 else np.int32), self.blocks)
            self.at_slot = np.repeat(ids, np.diff(self.cumulative, axis=1).ravel())
        self.cumulative = self.cumulative.ravel().astype(np.uint64)

    def predict(self, step: int) -> tuple[np.ndarray, ...]:
        """The ids that orders 2 and 1 predict, and the parts of the range of both."""
        if _rebuilt(step):
            self.order_0()
        self.at[0] = (self.before * 40503 >> 3) & (SLOTS_1 - 1)
        self.at[1] = (self.before * 0x9E3779B1 + self.before_2 * 0x85EBCA6B >> 12) & (SLOTS_2 - 1)
        self.at += self.of
        self.entry = self.table[self.at]
        self.level, self.predicted = self.entry & (LEVELS - 1), self.entry >> LEVEL_BITS
        first, second = self.predicted
        self.at_mix = self.of_mix + ((self.level[1] << LEVEL_BITS | self.level[0]) << 1 | (first == second))
        scale = (1 << self.mix_bits) - 3
        total = self.held.sum(axis=0)
        parts = (1 + self.held[:2] * scale // total).astype(np.uint64)
        return second, first, parts[0][self.at_mix], parts[1][self.at_mix]

    def update(self, ids: np.ndarray, outcome: np.ndarray) -> None:
        n = self.held.shape[1]
        self.held += np.bincount(outcome * n + self.at_mix, minlength=3 * n).reshape(3, n)
        hit = self.predicted == ids
        kept = self.entry + np.where(hit, self.level < LEVELS - 1, -(self.level + 1 >> 1))
        self.table[self.at] = np.where(hit | (self.level > 1), kept, ids << LEVEL_BITS)
        self.before_2, self.before = self.before, ids.astype(np.int64)
        self.new.append(ids)


class _Encoder:
    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, _FULL)
        self.words, self.carries = np.zeros((steps + 2) * lanes, np.uint64), np.zeros((steps + 2) * lanes, np.uint8)
        self.lane, self.at = np.arange(lanes), np.arange(lanes)  # where a lane's next word goes

    def put(self, begin: np.ndarray, size: np.ndarray, bits: int) -> None:
        r = self.range >> np.uint64(bits)
        low = self.low + begin * r
        over = np.flatnonzero(low < self.low)
        if len(over):
            self.carries[self.at[over] - len(self.lane)] += 1
        self.low, self.range = low, r * size
        self._emit(np.flatnonzero(self.range < (1 << 32)))

    def _emit(self, lanes: np.ndarray) -> None:
        self.words[self.at[lanes]] = self.low[lanes] >> _WORD
        self.at[lanes] += len(self.lane)
        self.low[lanes] <<= _WORD
        self.range[lanes] <<= _WORD

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        """Words, a row for each place and a column for each lane, and the number of each lane's words."""
        low = self.low + np.uint64(0xFFFFFFFF)  # a value of the range whose lower word is zero
        over = np.flatnonzero(low < self.low)
        if len(over):
            self.carries[self.at[over] - len(self.lane)] += 1
        self.low = low
        self._emit(self.lane)
        words, carries = (x.reshape(-1, len(self.lane)) for x in (self.words, self.carries))
        carry = np.zeros(len(self.lane), np.uint64)
        for row in range(len(words) - 1, -1, -1):
            words[row] += carries[row] + carry
            carry = words[row] >> _WORD
        return words.astype(np.uint32), self.at // len(self.lane)


class _Decoder:
    def __init__(self, words: np.ndarray):
        """``words``: a row for each place and a column for each lane; zeros after the end."""
        self.words, self.lanes = words.ravel().astype(np.uint64), words.shape[1]
        lane = np.arange(self.lanes)
        self.code = self.words[lane] << _WORD | self.words[lane + self.lanes]
        self.at, self.range = lane + 2 * self.lanes, np.full(self.lanes, _FULL)

    def target(self, bits: int) -> np.ndarray:
        self.r = self.range >> np.uint64(bits)
        return np.minimum(self.code // self.r, np.uint64((1 << bits) - 1))

    def took(self, begin: np.ndarray, size: np.ndarray) -> None:
        self.code -= begin * self.r
        self.range = self.r * size
        lanes = np.flatnonzero(self.range < (1 << 32))
        at = self.at[lanes]
        self.code[lanes] = self.code[lanes] << _WORD | self.words[np.minimum(at, len(self.words) - 1)]
        self.range[lanes] <<= _WORD
        self.at[lanes] = at + self.lanes


def _grid(n: int) -> tuple[int, int]:
    """Blocks of a group of n ids, and their steps."""
    blocks = max(1, -(-n // (STRIPES * STEPS)))
    return blocks, -(-n // (blocks * STRIPES))


def _parts(model: _Model, first: np.ndarray, second: np.ndarray, outcome: np.ndarray, plain: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and size of each lane's part of the range, given the mix's first two parts; ``plain``: the lanes of order 0."""
    up, hit = np.uint64(model.bits), outcome == 0
    begin = np.where(hit, np.uint64(0), first) << up
    size = np.where(hit, first, second) << up
    at = model.of_id[plain] + ids[plain]
    low, both = model.cumulative[at], first[plain] + second[plain]
    third = np.uint64(1 << model.mix_bits) - both
    begin[plain] = (both << up) + low * third
    size[plain] = (model.cumulative[at + 1] - low) * third
    return begin, size


def compress(ids: np.ndarray, vocabulary: int) -> list[bytes]:
    """Blocks of ids below ``vocabulary``: the number of words of each stripe, then the words."""
    if not len(ids):
        return []
    blocks, steps = _grid(len(ids))
    grid = np.zeros(blocks * STRIPES * steps, np.int32)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(blocks * STRIPES, steps).T)
    model, coder = _Model(blocks, vocabulary, slots=False), _Encoder(blocks * STRIPES, steps)
    for t in range(steps):
        x = grid[t]
        two, one, first, second = model.predict(t)
        outcome = np.where(x == two, 0, np.where(x == one, 1, 2))
        coder.put(*_parts(model, first, second, outcome, np.flatnonzero(outcome == 2), x), RANGE_BITS)
        model.update(x, outcome)
    words, n = coder.close()
    used = np.arange(len(words))[None, :] < n[:, None]
    words = np.ascontiguousarray(words.T)
    lanes = [slice(b * STRIPES, (b + 1) * STRIPES) for b in range(blocks)]
    return [n[b].astype("<u2").tobytes() + words[b][used[b]].astype("<u4").tobytes() for b in lanes]


def expand(blocks: list[bytes], n: int, vocabulary: int) -> np.ndarray:
    """The ids of all blocks of a group of n ids; any run of a group's full blocks can be given alone."""
    if not n:
        return np.empty(0, np.int64)
    steps = -(-n // (len(blocks) * STRIPES))
    counts = np.concatenate([np.frombuffer(b, "<u2", STRIPES) for b in blocks]).astype(np.int64)
    words = np.zeros((len(counts), max(2, int(counts.max()))), np.uint32)
    words[np.arange(words.shape[1])[None, :] < counts[:, None]] = np.concatenate([np.frombuffer(b, "<u4", offset=2 * STRIPES) for b in blocks])
    model, coder = _Model(len(blocks), vocabulary, slots=True), _Decoder(np.ascontiguousarray(words.T))
    grid, whole, mask = np.zeros((steps, len(counts)), np.int32), np.uint64(1 << model.mix_bits), np.uint64(model.bits)
    of_slot = model.block << model.bits
    for t in range(steps):
        two, one, first, second = model.predict(t)
        target = coder.target(RANGE_BITS)
        top = target >> mask
        both = first + second
        outcome = (top >= first).astype(np.int64) + (top >= both)
        x = np.where(outcome == 0, two, one)
        plain = np.flatnonzero(outcome == 2)
        rest = both[plain]
        place = (target[plain] - (rest << mask)) // (whole - rest)
        x[plain] = model.at_slot[of_slot[plain] + place.astype(np.int64)]
        coder.took(*_parts(model, first, second, outcome, plain, x))
        grid[t] = x
        model.update(x, outcome)
    return grid.T.ravel()[:n]


# --- tokens ---


def _byte_letters() -> np.ndarray:
    """The letter that stands for each byte in byte-level vocabularies: itself if it can be seen, else the next from 256 on."""
    letters = np.arange(256, dtype="<u2")
    unseen = [*range(33), 127, *range(128, 161), 173]
    letters[unseen] = 256 + np.arange(len(unseen))
    return letters


class _Tokenizer:
    """The library's ids of whole texts: it encodes each distinct piece between token boundaries once while cached."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        split = self.library.pre_tokenizer
        plain = isinstance(split, ByteLevel) and split.use_regex and not split.add_prefix_space and self.library.normalizer is None
        self.of_bytes = _byte_letters() if plain else None
        self.pieces = bpe.Pieces(self._library_ids, CACHED)

    def _library_ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.of_bytes is not None:  # the pieces are what the library would split off, so they go to its model straight
            tokenize, ends = self.library.model.tokenize, np.cumsum(list(map(len, pieces))).tolist()
            letters = self.of_bytes[np.frombuffer(b"".join(pieces), np.uint8)].tobytes().decode("utf-16-le")
            ids = [[t.id for t in tokenize(letters[a:b])] for a, b in zip([0, *ends], ends, strict=False)]
        else:
            ids = [e.ids for e in self.library.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum())), sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and how many ids each text has."""
        special = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        if not special:
            return self.pieces.encode(texts)
        plain = list(texts)
        for i in special:
            plain[i] = ""
        ids, counts = self.pieces.encode(plain)
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i in special:
            parts[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.array([len(p) for p in parts])


@cache
def tokenizer(path: str) -> _Tokenizer:
    return _Tokenizer(path)


SCHEMA = "part int, group int, n_tokens long, vocabulary long, ids binary, lengths binary, sizes binary, checks binary, payload binary"


def _group(part: int, number: int, docs: list, tokens: list[np.ndarray], lengths: list[np.ndarray], vocabulary: int) -> pa.RecordBatch:
    ids = np.concatenate(tokens)
    blocks = compress(ids, vocabulary)
    has = np.array([d is not None for d in docs])
    keys = np.array([d or 0 for d in docs], np.int64).tobytes() + has.tobytes()
    row = [keys, np.concatenate(lengths).astype(np.int64).tobytes(), np.array([len(b) for b in blocks], np.int32).tobytes(), np.array([zlib.crc32(b) for b in blocks], np.uint32).tobytes(), b"".join(blocks)]
    head = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([vocabulary], pa.int64())]
    return pa.RecordBatch.from_arrays([*head, *(pa.array([x], pa.binary()) for x in row)], names=[f.split()[0] for f in SCHEMA.split(", ")])


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Files of all documents in ascending order of doc_id, under ``path`` in any store that Spark writes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part, number = tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0
        vocabulary = max(t.vocabulary, end_id + 1)
        docs, tokens, lengths, size = [], [], [], 0
        for batch in batches:
            keys, first = batch.column(0).to_pylist(), 0
            for texts in bpe._chunks([x or "" for x in batch.column(1).to_pylist()]):
                ids, counts = t.encode(texts)
                tokens.append(np.insert(ids, np.cumsum(counts), end_id))
                lengths.append(counts + 1)
                docs += keys[first : first + len(texts)]
                first, size = first + len(texts), size + len(tokens[-1])
                if size >= GROUP - bpe.CHUNK // 2:
                    yield _group(part, number, docs, tokens, lengths, vocabulary)
                    docs, tokens, lengths, size, number = [], [], [], 0, number + 1
        if docs:
            yield _group(part, number, docs, tokens, lengths, vocabulary)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the texts are shuffled, not the ids: finding the ranges looks at the rows once more, at their ids only
    in_order = rows.filter("doc_id is not null").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.length("text"), "text")
    # rows without an id are spread by their texts; a union keeps the order of its parts
    without = rows.filter("doc_id is null").repartition(F.xxhash64("text")).sortWithinPartitions(F.length("text"), "text")
    without.union(in_order).mapInArrow(trimmed(work), SCHEMA).write.mode("errorifexists").option("compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (packed unsigned 32-bit): each document of the files; a block with a wrong checksum is an error."""
    files = spark.read.parquet(path)
    before = Window.orderBy("part", "group").rowsBetween(Window.unboundedPreceding, -1)
    # one narrow row for each group of some four million ids
    begins = files.select("part", "group", "n_tokens").withColumn("begins", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).drop("n_tokens")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                sizes, checks = np.frombuffer(r["sizes"], np.int32), np.frombuffer(r["checks"], np.uint32)
                at = np.concatenate([[0], np.cumsum(sizes)])
                blocks = [r["payload"][a:b] for a, b in zip(at, at[1:], strict=False)]
                for i, (b, c) in enumerate(zip(blocks, checks.tolist(), strict=True)):
                    if zlib.crc32(b) != c:
                        raise ValueError(f"block {i} of part {r['part']}, group {r['group']} is damaged")
                ids = expand(blocks, r["n_tokens"], r["vocabulary"]).astype("<u4")
                lengths = np.frombuffer(r["lengths"], np.int64)
                ends, n = np.cumsum(lengths), len(lengths)
                keys, has = np.frombuffer(r["ids"], np.int64, n), np.frombuffer(r["ids"], bool, n, 8 * n)
                starts, data = ends - lengths, ids.tobytes()
                for lo in range(0, n, 4096):
                    part = slice(lo, lo + 4096)
                    packed = pa.array([data[4 * a : 4 * b] for a, b in zip(starts[part].tolist(), ends[part].tolist(), strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(keys[part], pa.int64(), mask=~has[part]), pa.array(r["begins"] + starts[part], pa.int64()), packed], names=["doc_id", "start", "ids"])

    return files.join(F.broadcast(begins) if begins.count() < 100_000 else begins, ["part", "group"]).mapInArrow(trimmed(work), "doc_id long, start long, ids binary")


def shared_path(spark: SparkSession) -> str:
    """A new folder in the cluster's shared folder."""
    return f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete the files of ``write``."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
