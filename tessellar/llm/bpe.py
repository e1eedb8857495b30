"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts of a batch are laid out as one array of code points. A class table turns them into symbols (letter, number,
other, white space by what follows it, apostrophe by the ending it opens, end of text). Each symbol acts on the few
states of the splitting automaton; composing such actions is associative and closed over a small set, so a blocked
prefix scan of table look-ups gives the state before every code point at once, and with it every token boundary. No
regex runs. The slices between boundaries go through a bounded cache of pair merges, looked up all at once; slices that
aren't there are merged by rank, all new ones of a chunk side by side.

Ids are packed as little-endian unsigned 32-bit integers. Byte offsets of the tokens can be kept with them: a token's
bytes are ``decoded[offsets[i]:offsets[i + 1]]``. Decoding gathers the bytes of the vocabulary to the offsets kept.

Cases: a null or empty text has no ids and decodes to no bytes; texts of any length are encoded whole (a long one is a
chunk by itself); repeated rows are encoded each; an empty table gives an
empty result; other columns are ignored, or kept where ``keep`` names them.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import trimmed
from .hashing import mixed

#: Code points of a chunk that is scanned at once, unless one text has more.
CHUNK = 1 << 20
#: Entries of a worker's cache of merged pieces; it is emptied when full, which changes no result.
CACHED = 400_000

# --- symbols and states of the splitting automaton ---
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, SPACES, WHITE, WHITES, END = range(10)
# SHORT, LONG: an apostrophe before an ending of one or two letters. SPACE, WHITE: a space or another white space before
# something else; SPACES, WHITES: the same before white space or the end of the text.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_WHITE, AFTER_WHITE, ONE_MORE, TWO_MORE, ENDING_DONE = range(10)
STATES = 10


def _next(state: int, symbol: int) -> int:
    if symbol == END:
        return START
    if state in (ONE_MORE, TWO_MORE):
        return ENDING_DONE if state == ONE_MORE else ONE_MORE
    if symbol in (SHORT, LONG) and state not in (IN_OTHERS, AFTER_SPACE):
        return ONE_MORE if symbol == SHORT else TWO_MORE
    return {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, SPACE: AFTER_SPACE, WHITE: AFTER_WHITE, SPACES: IN_WHITE, WHITES: IN_WHITE}.get(symbol, IN_OTHERS)


def _begins(state: int, symbol: int) -> bool:
    """Whether a token begins at a symbol, given the state before it."""
    if symbol == END or state == START:
        return True
    if symbol in (SPACE, WHITE):
        return True
    if symbol in (SPACES, WHITES):
        return state != IN_WHITE
    inside = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS}.get(symbol, IN_OTHERS)
    return state not in (inside, AFTER_SPACE, ONE_MORE, TWO_MORE)


@cache
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Element of each symbol, the composition table, each element's action on states, and the boundary table."""
    of_symbol = [tuple(_next(s, x) for s in range(STATES)) for x in range(10)]
    elements = {f: i for i, f in enumerate(dict.fromkeys(of_symbol))}
    queue = list(elements)
    for f in queue:
        for g in of_symbol:
            if (h := tuple(g[s] for s in f)) not in elements:
                elements[h] = len(elements)
                queue.append(h)
    funcs = list(elements)
    compose = np.array([[elements[tuple(g[s] for s in f)] for g in funcs] for f in funcs], np.uint16)
    begins = np.array([[_begins(s, x) for x in range(10)] for s in range(STATES)])
    return np.array([elements[f] for f in of_symbol], np.uint16), compose, np.array(funcs, np.uint8), begins


#: The code points with the property White_Space.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def _classes() -> np.ndarray:
    """Letter, number, white space or other, by code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.full(0x110000, OTHER, np.uint8)
    # above plane 3 there are no letters, numbers or white space
    table[:0x40000] = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x40000)), np.uint8, 0x40000)
    table[WHITE_SPACE] = WHITE
    return table


def _symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``ends``: places of the code points that stand between texts; the last one closes the array."""
    sym = _classes()[points]
    sym[ends] = END
    white = sym == WHITE
    follows = np.zeros(len(sym), bool)  # white space or an end follows
    follows[:-1] = white[1:] | (sym[1:] == END)
    sym[white & follows] = WHITES
    space = white & (points == 32)
    sym[space] = np.where(follows[space], SPACES, SPACE)
    at = np.flatnonzero(points == 39)
    if len(at):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[at + 1], padded[at + 2]
        is_long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        sym[at[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        sym[at[is_long]] = LONG
    return sym


def _states_before(elements: np.ndarray, width: int = 128) -> np.ndarray:
    """Exclusive scan by composition: the state before each element, from START."""
    _, compose, act, _ = _automaton()
    n = len(elements)
    if n <= width:
        out, state = np.empty(n, np.uint8), START
        for i, e in enumerate(elements):
            out[i], state = state, act[e, state]
        return out
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.uint16)
    grid[:n] = elements
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    size = np.intp(len(compose))
    for j in range(1, width):  # all rows at once
        grid[j] = compose.ravel()[grid[j - 1] * size + grid[j]]
    row_state = _states_before(grid[-1].copy(), width)
    out = np.empty((width, rows), np.uint8)
    out[0] = row_state
    out[1:] = act.ravel()[grid[:-1] * np.intp(STATES) + row_state]
    return out.T.ravel()[:n]


def boundaries(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined by a code point each, the places where tokens or texts begin or end, the ends of texts, and all code points."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    sym = _symbols(points, ends)
    of_symbol, _, _, begins = _automaton()
    states = _states_before(of_symbol[sym])
    return joined, np.flatnonzero(begins.ravel()[states * np.uint8(10) + sym]), ends, points


# --- pieces ---


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of each key among the distinct ones, these in order, and where each of them is found."""
    code, distinct = pd.factorize(keys)
    first = np.empty(len(distinct), np.int64)
    first[code[::-1]] = np.arange(len(keys))[::-1]
    order = np.argsort(distinct)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[code], distinct[order], first[order]


class Pieces:
    """Texts as numbers of distinct pieces; the ids of each distinct piece are kept in a bounded cache.

    A piece of up to 7 bytes is known by its bytes and length in a 64-bit word, one of up to 15 bytes by the hash of two
    such words, which are compared; others, and those of equal hash, as bytes. ``merge`` gives the ids of new pieces.
    """

    def __init__(self, merge: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], cached: int):
        self.merge, self.cached = merge, cached
        self._empty()

    def _empty(self) -> None:
        # keys of short and middle pieces in order, and their numbers
        self.short, self.middle = ((np.empty(0, np.uint64), np.empty(0, np.int64)) for _ in range(2))
        self.long: dict[bytes, int] = {}
        self.middle_words = np.empty((2, 0), np.uint64)  # of each number, where it is one of a middle piece
        self.flat, self.begin, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int32)

    def _add(self, new: list[bytes]) -> np.ndarray:
        ids, sizes = self.merge(new)
        first = len(self.size)
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes.astype(np.int32)])
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])
        return np.arange(first, len(self.size))

    def _numbers(self, known: tuple[np.ndarray, np.ndarray], keys: np.ndarray, begins: np.ndarray, ends: np.ndarray, data: bytes) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Numbers of distinct pieces by their keys, and the grown table: those that aren't known are merged."""
        at = np.searchsorted(known[0], keys)
        have = at < len(known[0])
        have[have] = known[0][at[have]] == keys[have]
        found = np.empty(len(keys), np.int64)
        found[have] = known[1][at[have]]
        new = np.flatnonzero(~have)
        if len(new):
            found[new] = self._add([data[b:e] for b, e in zip(begins[new].tolist(), ends[new].tolist(), strict=True)])
            all_keys = np.concatenate([known[0], keys[new]])  # two runs in order
            order = np.argsort(all_keys, kind="stable")
            known = all_keys[order], np.concatenate([known[1], found[new]])[order]
        return found, known

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all pieces in order, and how many pieces each text has."""
        if len(self.size) > self.cached:
            self._empty()
        joined, at, ends, points = boundaries(texts)
        data = joined.encode()
        if len(data) > len(joined):  # places of code points to places of bytes
            widths = 1 + (points >= 0x80).view(np.uint8) + (points >= 0x800).view(np.uint8) + (points >= 0x10000).view(np.uint8)
            place = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])
            at, ends = place[at], place[ends]
        of_end = np.searchsorted(at, ends)  # what begins at an end of text is the mark between texts, no piece
        counts = np.diff(of_end, prepend=-1) - 1
        begins, until = np.delete(at, of_end), np.delete(np.append(at[1:], len(data)), of_end)
        length = until - begins
        raw = data + bytes(16)
        words = np.ndarray((len(data) + 8,), "<u8", raw, strides=(1,))
        masks = (np.uint64(1) << (np.uint64(8) * np.arange(8, dtype=np.uint64))) - np.uint64(1)
        out = np.empty(len(begins), np.int64)

        at = np.flatnonzero(length <= 7)
        key = (words[begins[at]] & masks[length[at]]) | (length[at].astype(np.uint64) << np.uint64(56))
        code, distinct, first = _distinct(key)
        found, self.short = self._numbers(self.short, distinct, begins[at[first]], until[at[first]], data)
        out[at] = found[code]

        at = np.flatnonzero((length > 7) & (length <= 15))
        two_words = np.stack([words[begins[at]], (words[begins[at] + 8] & masks[length[at] - 8]) | (length[at].astype(np.uint64) << np.uint64(56))])
        code, distinct, first = _distinct(mixed(two_words[0] + mixed(two_words[1])))
        found, self.middle = self._numbers(self.middle, distinct, begins[at[first]], until[at[first]], data)
        grown = len(self.size) - self.middle_words.shape[1]
        if grown:
            self.middle_words = np.concatenate([self.middle_words, np.zeros((2, grown), np.uint64)], axis=1)
        unset = ~self.middle_words[:, found].any(axis=0)
        self.middle_words[:, found[unset]] = two_words[:, first[unset]]
        out[at] = found[code]
        clash = (self.middle_words[:, out[at]] != two_words).any(axis=0)

        at = np.concatenate([np.flatnonzero(length > 15), at[clash]])
        if len(at):
            pieces = [data[b:e] for b, e in zip(begins[at].tolist(), until[at].tolist(), strict=True)]
            new = [p for p in dict.fromkeys(pieces) if p not in self.long]
            if new:
                self.long.update(zip(new, self._add(new).tolist(), strict=True))
            out[at] = np.fromiter(map(self.long.__getitem__, pieces), np.int64, len(pieces))
        return out, counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and how many ids each text has."""
        numbers, counts = self.numbers(texts)
        sizes = self.size[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.begin[numbers] - ends + sizes, sizes) + np.arange(total)]
        of_text = np.concatenate([[0], ends])[np.cumsum(counts)]
        return ids, np.diff(of_text, prepend=0)


# --- merges ---


class Vocabulary:
    """Ranks of byte strings, and the pair merging over them."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.size = max(self.ranks.values()) + 1
        tokens = [b""] * self.size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        # every way in which a token is two tokens side by side
        get = self.ranks.get
        pairs = [(x * self.size + y, rank) for token, rank in self.ranks.items() for cut in range(1, len(token)) if (x := get(token[:cut])) is not None and (y := get(token[cut:])) is not None]
        pairs.sort()
        self.pairs, self.merged = (np.array(v, np.int64) for v in zip(*pairs, strict=True)) if pairs else (np.full(1, -1), np.zeros(1, np.int64))
        self.pieces = Pieces(self.merge, CACHED)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that two tokens make; the vocabulary's size if none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], self.size)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces and their numbers: in each round every piece merges its leftmost pair of least rank."""
        whole = np.fromiter(map(self.ranks.get, pieces, repeat(-1)), np.int64, len(pieces))
        rest = np.flatnonzero(whole < 0)
        sizes = np.ones(len(pieces), np.int64)
        if not len(rest):
            return whole, sizes
        ids = self.of_byte[np.frombuffer(b"".join([pieces[i] for i in rest.tolist()]), np.uint8)]
        lengths = np.fromiter((len(pieces[i]) for i in rest.tolist()), np.int64, len(rest))
        done_of, done_ids, owner = [], [], rest
        rank = np.append(self._rank(ids[:-1], ids[1:]), self.size)
        rank[np.cumsum(lengths) - 1] = self.size  # the last token of a piece has no pair
        while len(owner):
            begins = np.cumsum(lengths) - lengths
            least = np.minimum.reduceat(rank, begins)
            over = least >= self.size
            if over.any():
                of_token = np.repeat(over, lengths)
                done_of.append(np.repeat(owner, lengths)[of_token])
                done_ids.append(ids[of_token])
                ids, rank = ids[~of_token], rank[~of_token]
                owner, lengths, least = owner[~over], lengths[~over], least[~over]
                if not len(owner):
                    break
                begins = np.cumsum(lengths) - lengths
            hits = np.flatnonzero(rank == np.repeat(least, lengths))
            of_hit = np.searchsorted(begins, hits, "right") - 1
            left = hits[np.flatnonzero(np.diff(of_hit, prepend=-1))]  # the leftmost of each piece
            ids[left] = least
            keep = np.ones(len(ids), bool)
            keep[left + 1] = False
            # pairs with the new token: the one before it and the one after it
            after = left + 2
            last = after >= begins + lengths
            rank[left] = np.where(last, self.size, self._rank(ids[left], ids[np.minimum(after, len(ids) - 1)]))
            inner = left > begins
            rank[left[inner] - 1] = self._rank(ids[left[inner] - 1], ids[left[inner]])
            ids, rank, lengths = ids[keep], rank[keep], lengths - 1
        of, done = np.concatenate(done_of), np.concatenate(done_ids)
        sizes[rest] = np.bincount(of, minlength=len(pieces))[rest]
        out = np.empty(int(sizes.sum()), np.int64)
        ends = np.cumsum(sizes)
        single = whole >= 0
        out[(ends - 1)[single]] = whole[single]
        order = np.argsort(of, kind="stable")
        of = of[order]
        nth = np.arange(len(of)) - np.searchsorted(of, of)
        out[(ends - sizes)[of] + nth] = done[order]
        return out, sizes

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        ids, counts = self.pieces.encode(texts)
        data, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def token_offsets(self, ids: bytes) -> np.ndarray:
        """Where each token begins in the text's bytes, and the end."""
        codes = np.frombuffer(ids, "<u4")
        return np.concatenate([[0], np.cumsum(self.offsets[codes + 1] - self.offsets[codes])])

    def decode(self, ids: bytes, into: np.ndarray | None = None) -> bytes:
        """The bytes of packed ids: a gather by token offsets, those given or new ones."""
        codes = np.frombuffer(ids, "<u4").astype(np.int64)
        into = self.token_offsets(ids) if into is None else into.astype(np.int64)
        return self.bytes[np.arange(into[-1]) + np.repeat(self.offsets[codes] - into[:-1], np.diff(into))].tobytes()


@cache
def vocabulary(path: str) -> Vocabulary:
    """One a worker process, read from the path that each executor has."""
    return Vocabulary(path)


def _chunks(texts: Iterable[str], most: int = CHUNK) -> Iterator[list[str]]:
    chunk, size = [], 0
    for t in texts:
        if chunk and size + len(t) > most:
            yield chunk
            chunk, size = [], 0
        chunk.append(t)
        size += len(t) + 1
    if chunk:
        yield chunk


def _encoded(path: str, kept: int, offsets: bool, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of ``kept`` columns and the text: these columns, ids, and offsets on request."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            at = 0
            # texts are taken out of the batch as they are needed
            for texts in _chunks((t.as_py() or "" for t in batch.column(kept)), CHUNK // 2):
                ids = v.encode(texts)
                columns = [batch.column(i).slice(at, len(texts)) for i in range(kept)] + [pa.array(ids, pa.binary())]
                if offsets:
                    columns.append(pa.array([v.token_offsets(x).astype("<u4").tobytes() for x in ids], pa.binary()))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return work


def _decoded(path: str, as_text: bool, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows with ids, and offsets or none: with the bytes or the text of the ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            kept = "offsets" in batch.schema.names
            into = [np.frombuffer(x, "<u4") for x in batch.column("offsets").to_pylist()] if kept else [None] * batch.num_rows
            found = [v.decode(x, o) for x, o in zip(batch.column("ids").to_pylist(), into, strict=True)]
            last = pa.array([x.decode(errors="replace") for x in found], pa.string()) if as_text else pa.array(found, pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, last], names=names)

    return work


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), offsets: bool = False, decoded: bool = False) -> DataFrame:
    """``keep``, then ``ids`` (packed); on request ``offsets``: where each token begins in the text's bytes, packed alike.

    With ``decoded`` (which keeps offsets) the encoded rows go on to the decoder, in the same worker: the bytes of the ids.
    """
    schema = docs.select(*[docs[c] for c in keep]).schema.add("ids", "binary")
    if offsets or decoded:
        schema = schema.add("offsets", "binary")
    work = _encoded(path, len(keep), offsets or decoded, schema.names)
    if decoded:
        schema = StructType([*schema.fields]).add("decoded", "binary")
        decoder, encoder = _decoded(path, False, schema.names), work
        work = lambda batches: decoder(encoder(batches))
    return docs.select(*[docs[c] for c in keep], docs["text"]).mapInArrow(trimmed(work), schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encode`` with ``text``, invalid bytes replaced: offsets kept with the ids say where each token's bytes go."""
    schema = StructType([*encoded.schema.fields]).add("text", "string")
    return encoded.mapInArrow(trimmed(_decoded(path, True, schema.names)), schema)
