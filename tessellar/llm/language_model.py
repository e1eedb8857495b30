"""Language-model scoring by a hierarchical Pitman-Yor model.

A text is its lower-cased words and one end token. The context of a token is the word before it, whatever that word's
number, or the start. Each context has a restaurant whose dishes are words; all share the parent restaurant of words
without context, and that one the uniform law over the training vocabulary and one unseen word. Tables of a context's
restaurant are customers of the parent's. Seatings are sampled by Gibbs (``seating``): both levels in turn, each given the
other's last state. The predictive probabilities of a context sum to one; those of the kept sweeps are averaged.

1. Texts are cut into words once: a chunk holds its distinct words (64-bit fingerprints) and the place of each token among
   them, in the shared folder. Nothing is read again from the texts.
2. Owners, one for each range of words, count them and number them, frequent ones first; each chunk learns the numbers and
   counts of its words.
3. A chunk sends its distinct pairs (context, word) to buckets, by context; those of contexts with ``HOT`` tokens or more,
   and of the start, by pair, so no bucket holds more of one context than its share. Buckets seat the contexts' restaurants, and send the tables
   of each word to its owner, which seats the parent's and sends back its counts. What a hot context has in each bucket is
   summed by the owner of its word, too.
4. A bucket answers each chunk with the log10 probability of each pair that it asked for, averaged over the kept sweeps;
   the chunk sums them over the tokens of each text.

What is learnt grows with the corpus: every context has its own restaurant. A clash of two words' fingerprints in 10 million
words has odds of 3e-6. Only counts of all training tokens, words and tables reach the driver.

Cases: a null or empty text is its end token; a null id counts as training text, like any id whose remainder isn't the
held-out one; repeated rows count and are scored each; texts of any length are whole in one chunk; without training tokens
all probability is the unseen word's; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .hashing import mixed, word_hashes
from .seating import Restaurants, Tables

#: Characters of a chunk's texts, and of those hashed at once.
CHUNK, HASHED = 1 << 24, 1 << 21
#: Characters of all texts for each bucket and each owner of words.
BUCKET_CHARS, OWNER_CHARS = 24_000_000, 64_000_000
#: Training tokens of a context whose pairs are spread over the buckets.
HOT = 200_000
#: Sweeps, those whose probabilities are averaged, and Gibbs steps of a dish in a sweep.
SWEEPS, KEPT, STEPS = 3, 2, 16
DISCOUNT, STRENGTH = (0.6, 0.75), (5.0, 20.0)  # of words without and with context
END = np.uint64(0xE0D)
#: The number of the start as a context; words have smaller numbers.
START = 0xFFFFFFFF


def _held_out(remainder: int = 2, of: int = 7):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == remainder, F.lit(False))


# --- packs of arrays ---


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole or floating numbers, byte by byte of their items, compressed."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.itemsize, len(a)))], np.int64)
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    return head.tobytes() + zstandard.compress(b"".join(planes), 1)


def _unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 2 * n, 8).reshape(n, 2).tolist()
    raw, at, out = zstandard.decompress(data[8 + 16 * n :]), 0, []
    for (size, length), kind in zip(head, kinds, strict=True):
        plane = np.frombuffer(raw, np.uint8, size * length, at).reshape(size, length)
        out.append(np.ascontiguousarray(plane.T).view(kind).ravel())
        at += size * length
    return out


def _dealt(df: DataFrame, parts: int, key: str) -> DataFrame:
    """``df`` dealt by ``key`` into ``parts``, stored in the shared folder in a way that keeps the deal."""
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    try:
        conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan forgets how its rows are dealt
        out = cut(df.repartition(parts, key))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)
    _release(out)
    return out


def _release(df: DataFrame) -> None:
    """Collect the driver's garbage, upon which Spark removes the shuffle files of plans that were cut."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


#: Mail between chunks, owners and buckets.
MAIL = "kind string, sender long, receiver long, data binary"


def _mail(rows: list[tuple[str, int, int, bytes]]) -> pa.Table:
    kind, sender, receiver, data = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.table([pa.array(kind, pa.string()), pa.array(sender, pa.int64()), pa.array(receiver, pa.int64()), pa.array(data, pa.binary())], names=["kind", "sender", "receiver", "data"])


def _letters(mail: pa.Table, kind: str) -> list[tuple[int, bytes]]:
    """Sender and data of a kind, by sender."""
    rows = zip(mail["kind"].to_pylist(), mail["sender"].to_pylist(), mail["data"], strict=True)
    return sorted((s, d.as_py()) for k, s, d in rows if k == kind)


class _Dealt:
    """Places dealt to receivers: those of each, in order, found without a look at the others."""

    def __init__(self, of: np.ndarray, receivers: int):
        self.order = np.argsort(of, kind="stable")
        self.edges = np.searchsorted(of[self.order], np.arange(receivers + 1))

    def __getitem__(self, receiver: int) -> np.ndarray:
        return self.order[self.edges[receiver] : self.edges[receiver + 1]]

    def filled(self) -> np.ndarray:
        return np.flatnonzero(np.diff(self.edges))


# --- chunks of texts ---


def _chunk(ids: list, held: list, tokens: list[np.ndarray], counts: list[np.ndarray]) -> bytes:
    code, words = pd.factorize(np.concatenate(tokens))
    has = np.array([i is not None for i in ids])
    return _packed(np.array([i or 0 for i in ids], np.int64), has, np.array(held, bool), np.concatenate(counts).astype(np.uint32), words, code.astype(np.uint32))


def _open_chunk(data: bytes) -> tuple[np.ndarray, ...]:
    """Ids and whether there are, held or not, tokens of each text, distinct words, and the word of each token."""
    return tuple(_unpacked(data, np.int64, bool, bool, np.uint32, np.uint64, np.uint32))


def _chunks(rows: DataFrame, parts: int) -> DataFrame:
    """chunk, data: all texts in chunks; a chunk is whole in one row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, tokens, counts, size, number = [], [], [], [], 0, TaskContext.get().partitionId() << 32
        texts, length = [], 0

        def hash_texts() -> None:
            words, at = word_hashes(texts)
            tokens.append(np.insert(words, at[1:], END))
            counts.append(np.diff(at) + 1)
            texts.clear()

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([_chunk(ids, held, tokens, counts)], pa.binary())], names=["chunk", "data"])

        for batch in batches:
            for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                texts.append(t.as_py() or "")
                ids.append(i)
                held.append(h)
                length += len(texts[-1]) + 8
                if length >= HASHED:
                    hash_texts()
                    size, length = size + length, 0
                if size >= CHUNK:
                    yield row()
                    ids, held, tokens, counts, size, number = [], [], [], [], 0, number + 1
        if texts:
            hash_texts()
        if ids:
            yield row()

    return _dealt(rows.mapInArrow(work, "chunk long, data binary"), parts, "chunk")


# --- words and their owners ---


def _numbered(chunks: DataFrame, owners: int) -> tuple[DataFrame, int, int]:
    """Mail to the chunks: numbers and training counts of their words. And all training tokens and distinct ones."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, _, held, lengths, words, code = _open_chunk(data.as_py())
                times = np.bincount(code[~np.repeat(held, lengths)], minlength=len(words))
                to = _Dealt((words % np.uint64(owners)).astype(np.int64), owners)
                rows = [("words", chunk, int(o), _packed(words[to[o]], times[to[o]])) for o in to.filled()]
                yield from _mail(rows).to_batches()

    def answer(mail: pa.Table) -> pa.Table:
        owner = mail["receiver"][0].as_py()
        asked = [(chunk, *_unpacked(data, np.uint64, np.int64)) for chunk, data in _letters(mail, "words")]
        words, at = np.unique(np.concatenate([w for _, w, _ in asked]), return_inverse=True)
        times = np.bincount(at, np.concatenate([t for _, _, t in asked]), len(words)).astype(np.int64)
        number = np.empty(len(words), np.int64)
        number[np.argsort(-times, kind="stable")] = np.arange(len(words)) * owners + owner
        if len(words) and number.max() >= START:
            raise ValueError("more distinct words than numbers of 32 bits")
        rows, first = [("totals", owner, -1, np.array([times.sum(), (times > 0).sum()], np.int64).tobytes())], 0
        for chunk, w, _ in asked:
            mine = at[first : first + len(w)]
            first += len(w)
            rows.append(("numbers", owner, chunk, _packed(number[mine].astype(np.uint32), times[mine])))
        return _mail(rows)

    mail = cut(chunks.mapInArrow(ask, MAIL).groupBy("receiver").applyInArrow(answer, MAIL))
    _release(mail)
    totals = [np.frombuffer(r["data"], np.int64) for r in mail.filter("receiver = -1").select("data").collect()]  # two numbers an owner
    n, v = (int(x) for x in np.sum(totals, axis=0)) if totals else (0, 0)
    return mail.filter("receiver >= 0"), n, v


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the place of each key among them."""
    order = np.argsort(keys)
    s = keys[order]
    first = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(first) - 1
    return s[first], place


class _Pairs:
    """The distinct pairs of a chunk, by bucket: what its requests and the answers go by."""

    def __init__(self, data: bytes, mail: pa.Table, owners: int, buckets: int, hot: int):
        self.ids, self.has, self.held, self.lengths, words, code = _open_chunk(data)
        number, self.times = np.empty(len(words), np.uint32), np.empty(len(words), np.int64)
        of = _Dealt((words % np.uint64(owners)).astype(np.int64), owners)
        for owner, answer in _letters(mail, "numbers"):
            number[of[owner]], self.times[of[owner]] = _unpacked(answer, np.uint32, np.int64)
        self.code, word = code, number[code]
        context = np.concatenate([word[:1], word[:-1]])
        ends = np.cumsum(self.lengths, dtype=np.int64)
        context[ends - self.lengths] = START
        self.keys, self.place = _distinct(context.astype(np.uint64) << np.uint64(32) | word)
        first = (self.keys >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(number)
        at = np.minimum(np.searchsorted(number[order], first), len(number) - 1)
        self.hot = (first == START) | (self.times[order[at]] >= hot)
        spread = np.where(self.hot, mixed(self.keys), mixed(first.astype(np.uint64)))
        bucket = (spread % np.uint64(buckets)).astype(np.int64)
        self.of_bucket = _Dealt(bucket, buckets)  # keys ascend in each bucket

    def requests(self) -> Iterator[tuple[int, bytes]]:
        training = ~np.repeat(self.held, self.lengths)
        times = np.bincount(self.place[training], minlength=len(self.keys))
        for b in self.of_bucket.filled():
            at = self.of_bucket[b]
            yield int(b), _packed_pairs(self.keys[at], self.hot[at], times[at])

    def scores(self, mail: pa.Table) -> np.ndarray:
        """The log10 probability of each token."""
        p = np.empty(len(self.keys), np.float32)
        for b, answer in _letters(mail, "scores"):
            p[self.of_bucket[b]] = _unpacked(answer, np.float32)[0]
        return p[self.place].astype(np.float64)


def _packed_pairs(keys: np.ndarray, hot: np.ndarray, times: np.ndarray) -> bytes:
    """Pairs in order: contexts once each, by differences, and their words by differences, too."""
    context, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(START)).astype(np.int64)
    first = np.flatnonzero(np.diff(context, prepend=-1))
    step = np.diff(word, prepend=0)
    step[first] = word[first]
    return _packed(np.diff(context[first], prepend=0).astype(np.uint32), np.diff(first, append=len(keys)).astype(np.uint32), hot[first], step.astype(np.uint32), times.astype(np.uint32))


def _open_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, whether their context is hot, and training counts."""
    context, runs, hot, step, times = _unpacked(data, np.uint32, np.uint32, bool, np.uint32, np.uint32)
    runs = runs.astype(np.int64)
    sums = np.cumsum(step, dtype=np.int64)
    first = np.cumsum(runs) - runs
    before = np.where(first > 0, sums[np.maximum(first, 1) - 1], 0)
    word = sums - np.repeat(before, runs)
    context = np.repeat(np.cumsum(context, dtype=np.int64), runs)
    return context.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64), np.repeat(hot, runs), times


# --- buckets: the restaurants of contexts ---


class _Bucket:
    """The distinct pairs of a bucket and their training counts; ``trained``: those that occur in training."""

    def __init__(self, requests: pa.Table, owners: int):
        self.number, self.owners = requests["receiver"][0].as_py(), owners
        keys, hot, times = [], [], []
        for _, data in _letters(requests, "pairs"):
            k, h, t = _open_pairs(data)
            keys.append(k)
            hot.append(h)
            times.append(t)
        all_keys = np.concatenate(keys)
        self.keys, place = _distinct(all_keys)
        self.count = np.bincount(place, np.concatenate(times), len(self.keys)).astype(np.int64)
        context = self.keys >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        self.contexts = context[first].astype(np.int64)
        self.restaurant = np.repeat(np.arange(len(first)), np.diff(first, append=len(context)))
        is_hot = np.zeros(len(self.keys), bool)
        is_hot[place[np.concatenate(hot)]] = True
        self.hot = np.flatnonzero(is_hot[first])  # restaurants
        self.words, self.word = np.unique((self.keys & np.uint64(START)).astype(np.int64), return_inverse=True)
        self.words_of, self.hot_of = _Dealt(self.words % owners, owners), _Dealt(self.contexts[self.hot] % owners, owners)
        self.customers = np.bincount(self.restaurant, self.count, len(first))
        self.trained = np.flatnonzero(self.count)

    def to_owners(self, tables: np.ndarray) -> list[tuple[str, int, int, bytes]]:
        """Tables of each word, and of hot contexts customers and tables; ``tables`` of all pairs."""
        of_word = np.bincount(self.word, tables, len(self.words)).astype(np.int64)
        of_context = np.bincount(self.restaurant, tables, len(self.contexts)).astype(np.int64)
        rows = []
        for o in np.union1d(self.words_of.filled(), self.hot_of.filled()):
            w, c = self.words_of[o], self.hot[self.hot_of[o]]
            rows.append(("tables", self.number, int(o), _packed(self.words[w], of_word[w], self.contexts[c], self.customers[c].astype(np.int64), of_context[c])))
        return rows

    def read(self, mail: pa.Table, kind: str, parent: _Parent) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the owners' replies: each word's probability in the parent; customers and tables of hot contexts everywhere."""
        p, customers, tables = np.empty(len(self.words)), np.zeros(len(self.contexts)), np.zeros(len(self.contexts))
        for o, data in _letters(mail, kind):
            c, t, of_hot, in_hot = _unpacked(data, np.int64, np.int64, np.int64, np.int64)
            p[self.words_of[o]] = parent.probability(c, t)
            at = self.hot[self.hot_of[o]]
            customers[at], tables[at] = of_hot, in_hot
        return p, customers, tables

    def predictive(self, state: Tables, p: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The probability of each pair, given its seating, the parent's and the hot contexts' totals."""
        own = np.zeros(len(self.keys))
        own[self.trained] = _tables_of(state, self.count[self.trained])
        all_customers, all_tables = self.customers.copy(), np.bincount(self.restaurant, own, len(self.contexts))
        all_customers[self.hot], all_tables[self.hot] = customers[self.hot], tables[self.hot]
        (_, d), (_, s) = DISCOUNT, STRENGTH
        r = self.restaurant
        return (self.count - d * own + (s + d * all_tables[r]) * p[self.word]) / (s + all_customers[r])


def _tables_of(state: Tables, count: np.ndarray) -> np.ndarray:
    """Tables of each trained pair; ``state`` holds those of pairs with two customers or more, numbered among these."""
    out = np.ones(len(count), np.int64)
    out[count > 1] = np.bincount(state.dish, minlength=int((count > 1).sum()))
    return out


class _Parent:
    """The words' restaurant as a whole: all customers and tables, and the uniform law below it."""

    def __init__(self, customers: float, tables: float, words: int):
        self.customers, self.tables, self.uniform = customers, tables, 1.0 / (words + 1)

    def probability(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        (d, _), (s, _) = DISCOUNT, STRENGTH
        return (customers - d * tables + (s + d * self.tables) * self.uniform) / (s + self.customers)


def _by_bucket(requests: DataFrame, mail: DataFrame):
    return requests.groupBy("receiver").cogroup(mail.groupBy("receiver"))


def _seated(requests: DataFrame, mail: DataFrame, parent: _Parent, sweep: int, owners: int, steps: int) -> DataFrame:
    """A sweep over the contexts' restaurants: their seatings, kept for the next one, and the tables of words to owners."""

    def work(asked: pa.Table, got: pa.Table) -> pa.Table:
        if not len(asked):
            return _mail([])
        b = _Bucket(asked, owners)
        count = b.count[b.trained]
        several = np.flatnonzero(count > 1)
        p, _, elsewhere = b.read(got, "parent", parent)
        kept = _letters(got, "seating")
        state = Tables(*_unpacked(kept[0][1], np.int64, np.int64)) if kept else Tables(np.arange(len(several)), np.ones(len(several), np.int64))
        of = b.restaurant[b.trained]
        tables = np.bincount(of, _tables_of(state, count), len(b.contexts))
        tables[b.hot] = np.maximum(elsewhere[b.hot], tables[b.hot])
        rng = np.random.default_rng([sweep, b.number])
        who = b.trained[several]
        level = Restaurants(b.restaurant[who], p[b.word[who]], tables, DISCOUNT[1], STRENGTH[1], rng)
        if not kept:
            state = level.arrive(state, count[several])
        state = level.reseat(state, len(several), steps)
        own = np.zeros(len(b.keys), np.int64)
        own[b.trained] = _tables_of(state, count)
        return _mail([("seating", b.number, b.number, _packed(state.dish, state.size)), *b.to_owners(own)])

    out = cut(_by_bucket(requests, mail).applyInArrow(work, MAIL))
    _release(out)
    return out


def _parents(tables: DataFrame, before: DataFrame, parent: _Parent, sweep: int, steps: int) -> tuple[DataFrame, _Parent]:
    """A sweep over the words' restaurant: its seating, kept for the next one, and replies to the buckets."""
    words = round(1 / parent.uniform) - 1

    def work(got: pa.Table, kept: pa.Table) -> pa.Table:
        letters = [(s, _unpacked(data, *[np.int64] * 5)) for s, data in _letters(got, "tables")]
        if not letters:
            return _mail([])
        owner = got["receiver"][0].as_py()
        numbers, local = np.unique(np.concatenate([x[0] for _, x in letters]), return_inverse=True)
        customers = np.bincount(local, np.concatenate([x[1] for _, x in letters]), len(numbers)).astype(np.int64)
        hot, at_hot = np.unique(np.concatenate([x[2] for _, x in letters]), return_inverse=True)
        of_hot, in_hot = (np.bincount(at_hot, np.concatenate([x[i] for _, x in letters]), len(hot)).astype(np.int64) for i in (3, 4))
        state = _letters(kept, "words")
        seating = Tables(*_unpacked(state[0][1], np.int64, np.int64)) if state else Tables(np.empty(0, np.int64), np.empty(0, np.int64))
        level = Restaurants(np.zeros(len(numbers), np.int64), np.full(len(numbers), parent.uniform), np.array([parent.tables]), DISCOUNT[0], STRENGTH[0], np.random.default_rng([sweep, owner, 7]))
        seating = level.reseat(level.arrive(seating, customers), len(numbers), steps)
        of_words = np.bincount(seating.dish, minlength=len(numbers))
        rows = [("words", owner, owner, _packed(seating.dish, seating.size)), ("totals", owner, -1, np.array([customers.sum(), of_words.sum()], np.int64).tobytes())]
        first = first_hot = 0
        for bucket, x in letters:
            mine, mine_hot = local[first : first + len(x[0])], at_hot[first_hot : first_hot + len(x[2])]
            first, first_hot = first + len(x[0]), first_hot + len(x[2])
            rows.append(("parent", owner, bucket, _packed(customers[mine], of_words[mine], of_hot[mine_hot], in_hot[mine_hot])))
        return _mail(rows)

    out = cut(tables.groupBy("receiver").cogroup(before.groupBy("receiver")).applyInArrow(work, MAIL))
    _release(out)
    totals = [np.frombuffer(r["data"], np.int64) for r in out.filter("kind = 'totals'").select("data").collect()]  # two numbers an owner
    customers, seated = np.sum(totals, axis=0) if totals else (0, 0)
    return out, _Parent(float(customers), float(seated), words)


# --- the whole model ---


def score(docs: DataFrame, sweeps: int = SWEEPS, kept: int = KEPT, steps: int = STEPS, hot: int = HOT) -> DataFrame:
    """The contract's columns for every row of ``docs``, and the perplexity of a token."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held"), "text")
    size = rows.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 8)).first()[0] or 0
    owners, buckets = max(1, -(-size // OWNER_CHARS)), max(1, -(-size // BUCKET_CHARS))
    parts = max(1, -(-size // CHUNK))
    chunks = _chunks(rows, parts)
    numbers, n, v = _numbered(chunks, owners)

    def by_chunk(mail: DataFrame):
        return chunks.groupBy("chunk").cogroup(mail.groupBy("receiver"))

    def ask(chunk: pa.Table, mail: pa.Table) -> pa.Table:
        if not len(chunk):
            return _mail([])
        number = chunk["chunk"][0].as_py()
        pairs = _Pairs(chunk["data"][0].as_py(), mail, owners, buckets, hot)
        return _mail([("pairs", number, b, data) for b, data in pairs.requests()])

    requests = _dealt(by_chunk(numbers).applyInArrow(ask, MAIL), buckets, "receiver")

    # before the first sweep each pair has one table
    def first(mail: pa.Table) -> pa.Table:
        b = _Bucket(mail, owners)
        return _mail(b.to_owners((b.count > 0).astype(np.int64)))

    tables = cut(requests.groupBy("receiver").applyInArrow(first, MAIL))
    none = docs.sparkSession.createDataFrame([], MAIL)
    of_words, parent = _parents(tables, none, _Parent(0, v, v), 0, steps)
    seated, sampled = none, []
    for sweep in range(1, sweeps + 1):
        mail = of_words.filter("kind = 'parent'").unionByName(seated.filter("kind = 'seating'"))
        seated = _seated(requests, mail, parent, sweep, owners, steps)
        of_words, parent = _parents(seated.filter("kind = 'tables'"), of_words.filter("kind = 'words'"), parent, sweep, steps)
        sampled.append((sweep, seated.filter("kind = 'seating'"), of_words.filter("kind = 'parent'"), parent))
    sampled = sampled[-kept:]
    parents = {s: p for s, _, _, p in sampled}
    of_sweep = [df.withColumn("kind", F.concat("kind", F.lit(f" {s}"))) for s, a, b, _ in sampled for df in (a, b)]
    states = of_sweep[0]
    for df in of_sweep[1:]:
        states = states.unionByName(df)

    def answer(asked: pa.Table, mail: pa.Table) -> pa.Table:
        if not len(asked):
            return _mail([])
        b, p = _Bucket(asked, owners), 0.0
        for s, of in parents.items():
            state = Tables(*_unpacked(_letters(mail, f"seating {s}")[0][1], np.int64, np.int64))
            p = p + b.predictive(state, *b.read(mail, f"parent {s}", of))
        log = np.log10(p / len(parents)).astype(np.float32)
        return _mail([("scores", b.number, chunk, _packed(log[np.searchsorted(b.keys, _open_pairs(data)[0])])) for chunk, data in _letters(asked, "pairs")])

    scores = _by_bucket(requests, states).applyInArrow(answer, MAIL)
    unseen = math.log10(n + v + 1)

    def sums(chunk: pa.Table, mail: pa.Table) -> pa.Table:
        if not len(chunk):
            return pa.Table.from_arrays([pa.array([], t) for _, t in columns], names=[c for c, _ in columns])
        pairs = _Pairs(chunk["data"][0].as_py(), mail, owners, buckets, hot)
        begins = np.cumsum(pairs.lengths, dtype=np.int64) - pairs.lengths
        of_words = np.log10(pairs.times + 1) - unseen
        values = [pairs.lengths.astype(np.int64), np.add.reduceat((pairs.times > 0)[pairs.code].astype(np.int64), begins), np.add.reduceat(of_words[pairs.code], begins), np.add.reduceat(pairs.scores(mail), begins)]
        arrays = [pa.array(pairs.ids, pa.int64(), mask=~pairs.has), pa.array(pairs.held), *map(pa.array, values)]
        return pa.Table.from_arrays(arrays, names=[c for c, _ in columns])

    columns = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    out = by_chunk(numbers.unionByName(scores)).applyInArrow(sums, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
