"""Lexical searches by a scan: each document meets all queries where it lies, so that only results are shuffled.

The queries are sent to the tasks, so a count must show that they are few (``gathered``). Postings and scores are numpy arrays
of a bounded number of rows; a search holds the k best rows of each query, and no task holds more, whatever it reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as st
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..session import cut

#: Pairs (query, term) that are sent to the tasks at most; scores, or tokens, of a block of documents.
PAIRS, CELLS, TOKENS = 500_000, 1 << 20, 1 << 21


class Asked:
    """Queries and their terms as arrays: terms are numbers, and so are queries."""

    def __init__(self, pairs: list, kind: st.DataType, forms: dict[str, str] | None = None):
        terms, queries = sorted({t for _, t in pairs}), list(dict.fromkeys(q for q, _ in pairs))
        term_at, query_at = {t: i for i, t in enumerate(terms)}, {q: i for i, q in enumerate(queries)}
        of = np.array(sorted((term_at[t], query_at[q]) for q, t in pairs), np.int64).reshape(-1, 2)
        forms = {t: t for t in terms} if forms is None else forms
        self.terms, self.queries, self.spark_kind, self.kind = terms, queries, kind, to_arrow_type(kind)
        self.words, self.word_terms = pa.array(list(forms), pa.string()), np.array([term_at[t] for t in forms.values()], np.int64)
        self.starts, self.of = np.searchsorted(of[:, 0], np.arange(len(terms) + 1)), of[:, 1]
        self.needed = np.bincount(of[:, 1], minlength=len(queries))

    def postings(self, tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and frequency of the asked terms, in this order."""
        at = pc.index_in(tokens.flatten(), value_set=self.words)
        hit = at.is_valid().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(tokens)), pc.list_value_length(tokens).to_numpy())[hit]
        codes, tf = np.unique(rows * len(self.terms) + self.word_terms[at.drop_null().to_numpy()], return_counts=True)
        return codes // max(1, len(self.terms)), codes % max(1, len(self.terms)), tf

    def meet(self, rows: np.ndarray, terms: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Blocks of rows: the first row, how many, which postings count, and to which cell (row of the block, query) each counts."""
        size = max(1, CELLS // max(1, len(self.queries)))
        many = self.starts[terms + 1] - self.starts[terms]
        at, last = 0, 0 if len(rows) == 0 else int(rows[-1]) + 1
        for first in range(0, last, size):
            end = int(np.searchsorted(rows, first + size))
            n = many[at:end]
            which = np.repeat(np.arange(at, end), n)
            place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            yield first, min(size, last - first), which, (rows[which] - first) * len(self.queries) + self.of[self.starts[terms[which]] + place]
            at = end


def gathered(terms: DataFrame, forms: DataFrame | None = None) -> Asked | None:
    """The distinct terms (query, term) of queries, if a count shows that they are few; ``forms`` (token, form): the words that stand for a term."""
    pairs = terms.select("query", "term").filter("term is not null").distinct().limit(PAIRS + 1).collect()
    words = None if forms is None else dict(map(tuple, forms.select("token", "form").limit(PAIRS + 1).collect()))
    return None if max(len(pairs), len(words or ())) > PAIRS else Asked([tuple(p) for p in pairs], terms.schema["query"].dataType, words)


def one_row_each(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, ``text``: rows of one key are one document, as if their texts stood one after the other."""
    again = cut(docs.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col(key).alias("_again")))
    if again.isEmpty():
        return docs.select(key, text)
    same = F.col(key).eqNullSafe(F.col("_again"))
    joined = docs.join(again, same, "left_semi").groupBy(key).agg(F.array_join(F.collect_list(text), " ").alias(text))
    return docs.join(again, same, "left_anti").select(key, text).unionByName(joined)


def pieces(batch: pa.RecordBatch, lists: int, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, of ``rows`` rows at most, whose lists have some ``TOKENS`` items."""
    ends = np.cumsum(pc.list_value_length(batch.column(lists)).to_numpy())
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOKENS, "right")))
        end = min(end, at + rows)
        yield batch.slice(at, end - at)
        at = end


def _hits(asked: Asked, key: str, keys: pa.Array, rows: np.ndarray, terms: np.ndarray) -> Iterator[pa.RecordBatch]:
    for first, n, _, cells in asked.meet(rows, terms):
        row, query = np.nonzero(np.bincount(cells, minlength=n * len(asked.queries)).reshape(n, -1) == asked.needed)
        yield pa.RecordBatch.from_arrays([pa.array(asked.queries, asked.kind).take(pa.array(query)), keys.take(pa.array(first + row))], names=["query", key])


def holding(rows: DataFrame, asked: Asked, key: str) -> DataFrame:
    """query, key: of ``counted`` rows, those that hold all terms of a query."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for b in batches for piece in pieces(b, 1)):
            row = np.repeat(np.arange(len(batch)), pc.list_value_length(batch.column(1)).to_numpy())
            yield from _hits(asked, key, batch.column(0), row, batch.column(1).flatten().to_numpy())

    return rows.select(key, "terms").mapInArrow(work, st.StructType([st.StructField("query", asked.spark_kind), rows.schema[key]]))


def matched(docs: DataFrame, asked: Asked, key: str, tokens: Column) -> DataFrame:
    """query, key of the documents that hold all terms of a query."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for b in batches for piece in pieces(b, 1)):
            rows, terms, _ = asked.postings(batch.column(1))
            yield from _hits(asked, key, batch.column(0), rows, terms)

    rows = docs.select(key, tokens.alias("tokens"))
    schema = st.StructType([st.StructField("query", asked.spark_kind), rows.schema[key]])
    return rows.mapInArrow(work, schema)


def counted(docs: DataFrame, asked: Asked, key: str, tokens: Column) -> DataFrame:
    """key, len, terms, tfs: the asked terms of each document by their numbers, with frequencies."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for b in batches for piece in pieces(b, 1)):
            rows, terms, tf = asked.postings(batch.column(1))
            ends = pa.array(np.searchsorted(rows, np.arange(len(batch) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (terms, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.list_value_length(batch.column(1)), *lists], names=[key, "len", "terms", "tfs"])

    rows = docs.select(key, tokens.alias("tokens"))
    return rows.mapInArrow(work, st.StructType([rows.schema[key]]).add("len", st.IntegerType()).add("terms", st.ArrayType(st.IntegerType())).add("tfs", st.ArrayType(st.IntegerType())))


def one_count_each(rows: DataFrame, key: str) -> DataFrame:
    """``counted`` rows, those of one key added up."""
    again = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col(key).alias("_again")))
    if again.isEmpty():
        return rows
    same = F.col(key).eqNullSafe(F.col("_again"))
    of = rows.join(again, same, "left_semi")
    lens = of.groupBy(key).agg(F.sum("len").cast("int").alias("len"))
    pairs = of.select(key, F.explode_outer(F.arrays_zip("terms", "tfs")).alias("p")).groupBy(key, "p.terms").agg(F.sum("p.tfs").cast("int").alias("tfs"))
    lists = pairs.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.when(F.col("terms").isNotNull(), F.struct("terms", "tfs")))).alias("p"))
    added = lens.join(lists, F.col(key).eqNullSafe(F.col("_key"))).select(key, "len", F.col("p.terms").alias("terms"), F.col("p.tfs").alias("tfs"))
    return rows.join(again, same, "left_anti").unionByName(added)


def heaviest(rows: DataFrame, asked: Asked, key: str, k: int, digits: int, idf: np.ndarray) -> DataFrame:
    """key, term, score, rank: of ``counted`` rows, each row's k terms of highest share in its weights' norm, rounded, ties by term."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(asked.terms, pa.string())
        for batch in (piece for b in batches for piece in pieces(b, 1)):
            row = np.repeat(np.arange(len(batch)), pc.list_value_length(batch.column(1)).to_numpy())
            term, tf = (batch.column(i).flatten().to_numpy() for i in (1, 2))
            row, term, score, rank = _shares(row, term, tf * idf[term], len(batch), k, digits)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), words.take(pa.array(term)), pa.array(score), pa.array(rank, pa.int32())], names=[key, "term", "score", "rank"])

    kinds = st.StructType([rows.schema[key]]).add("term", st.StringType()).add("score", st.DoubleType()).add("rank", st.IntegerType())
    return rows.select(key, "terms", "tfs").mapInArrow(work, kinds)


def _shares(row: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, term, score and rank of each row's k terms of highest share in its weights' norm, rounded, ties by term."""
    unit = 10.0**digits
    norm = np.sqrt(np.bincount(row, weight * weight, rows))
    score = np.floor(weight / norm[row] * unit + 0.5) / unit
    order = np.lexsort((term, -score, row))
    rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
    order, rank = order[rank <= k], rank[rank <= k]
    return row[order], term[order], score[order], rank


def in_blocks(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """block, keys, words, dfs, ends, terms, tfs: the terms of documents that lie side by side, some ``TOKENS`` of them in a block.

    A block has its own distinct words in order, in how many of its documents each is (dfs), and packed numbers: where each
    document's terms end, its terms by their numbers in the block, and their frequencies. Rows of one key are one document.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in (piece for b in batches for piece in pieces(b, 1)):
            keys, lists, given = batch.columns
            many = pc.list_value_length(lists).to_numpy()
            if not many.any():
                continue
            coded = lists.flatten().dictionary_encode()
            order = pc.sort_indices(coded.dictionary).to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            cells = np.repeat(np.arange(len(batch)), many) * len(order) + place[coded.indices.to_numpy()]
            if given.null_count == len(batch):
                cells, tf = np.unique(cells, return_counts=True)
            else:
                times = np.ones(len(cells), np.int64)
                times[np.repeat(given.is_valid().to_numpy(zero_copy_only=False), many)] = given.flatten().to_numpy()
                cells, at = np.unique(cells, return_inverse=True)
                tf = np.bincount(at, times).astype(np.int64)
            term, ends = cells % len(order), np.searchsorted(cells // len(order), np.arange(len(batch)), "right")
            numbers = [x.tobytes() for x in (ends.astype(np.int64), term.astype(np.int32), tf.astype(np.min_scalar_type(tf.max())))]
            one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (keys, coded.dictionary.take(pa.array(order)), pa.array(np.bincount(term, minlength=len(order)), pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *one, *(pa.array([x], pa.binary()) for x in numbers)], names=["block", "keys", "words", "dfs", "ends", "terms", "tfs"])
            block += 1

    again = cut(docs.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col(key).alias("_again")))
    alone, rows = F.lit(None).cast("array<long>").alias("tfs"), docs
    if not again.isEmpty():
        same = F.col(key).eqNullSafe(F.col("_again"))
        pairs = docs.join(again, same, "left_semi").select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
        added = pairs.groupBy(key).agg(F.collect_list(F.struct("term", "tf")).alias("p")).select(key, F.col("p.term").alias("tokens"), F.col("p.tf").alias("tfs"))
        rows = docs.join(again, same, "left_anti").select(key, tokens.alias("tokens"), alone).unionByName(added)
    else:
        rows = docs.select(key, tokens.alias("tokens"), alone)
    kind = rows.schema[key].dataType
    lists = st.StructType().add("block", st.LongType()).add("keys", st.ArrayType(kind)).add("words", st.ArrayType(st.StringType())).add("dfs", st.ArrayType(st.LongType()))
    return rows.mapInArrow(work, lists.add("ends", st.BinaryType()).add("terms", st.BinaryType()).add("tfs", st.BinaryType()))


def heaviest_of_all(blocks: DataFrame, key: str, k: int, digits: int, many: int) -> DataFrame:
    """key, term, score, rank: of ``in_blocks`` of ``many`` rows, each document's k terms of highest tf-idf, as ``heaviest`` has them.

    Only the words of blocks are shuffled by word, to add up their documents; their sums come back to the block.
    """

    def work(block: pa.Table, sums: pa.Table) -> pa.Table:
        keys, words = (block[c].combine_chunks().flatten() for c in ("keys", "words"))
        ends, term, tf = (block[c][0].as_buffer() for c in ("ends", "terms", "tfs"))
        ends, term = np.frombuffer(ends, np.int64), np.frombuffer(term, np.int32)
        tf = np.frombuffer(tf, f"u{tf.size // len(term)}")
        idf = np.empty(len(words))
        idf[sums["no"].to_numpy()] = np.log((1 + many) / (1 + sums["df"].to_numpy())) + 1
        row = np.repeat(np.arange(len(keys)), np.diff(ends, prepend=0))
        row, term, score, rank = _shares(row, term, tf * idf[term], len(keys), k, digits)
        return pa.table([keys.take(pa.array(row)), words.take(pa.array(term)), pa.array(score), pa.array(rank, pa.int32())], names=[key, "term", "score", "rank"])

    words = blocks.select("block", F.posexplode(F.arrays_zip("words", "dfs")).alias("no", "word"))
    sums = words.select("block", "no", F.sum("word.dfs").over(Window.partitionBy("word.words")).alias("df"))
    kinds = st.StructType().add(key, blocks.schema["keys"].dataType.elementType).add("term", st.StringType()).add("score", st.DoubleType()).add("rank", st.IntegerType())
    return blocks.drop("dfs").groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(work, kinds)


def by_document(lists: DataFrame, key: str) -> DataFrame:
    """key, len, terms, tfs, as ``counted`` gives them, of posting lists (batch, part, no, keys, tfs, lens): a block's lists are brought together, once for all queries."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            of, part = t["batch"].to_numpy(), t["part"].to_numpy()
            ends = [0, *(np.flatnonzero((of[1:] != of[:-1]) | (part[1:] != part[:-1])) + 1).tolist()]
            yield from (t.slice(a, b - a) for a, b in zip(ends, ends[1:], strict=False))
            rest = t.slice(ends[-1]) if len(t) else rest
        if rest is not None:
            yield rest

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches):
            lists, tf, length = (t[c].combine_chunks() for c in ("keys", "tfs", "lens"))
            no = np.repeat(t["no"].to_numpy(), pc.list_value_length(lists).to_numpy())
            keys, first, row = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
            order = np.lexsort((no, row))
            ends = pa.array(np.searchsorted(row[order], np.arange(len(keys) + 1)), pa.int32())
            of = [pa.ListArray.from_arrays(ends, pa.array(x[order], pa.int32())) for x in (no, tf.flatten().to_numpy())]
            yield pa.RecordBatch.from_arrays([pa.array(keys, lists.type.value_type), length.flatten().take(pa.array(first)), *of], names=[key, "len", "terms", "tfs"])

    near = lists.select("batch", "part", "no", "keys", "tfs", "lens").repartition("batch", "part").sortWithinPartitions("batch", "part")
    kind = lists.schema["keys"].dataType.elementType
    return near.mapInArrow(work, st.StructType([st.StructField(key, kind)]).add("len", st.IntegerType()).add("terms", st.ArrayType(st.IntegerType())).add("tfs", st.ArrayType(st.IntegerType())))


def best(rows: DataFrame, asked: Asked, key: str, k: int, digits: int, idf: np.ndarray, mean: float, k1: float, b: float) -> DataFrame:
    """query, key, score: of ``counted`` rows, each task's k best of each query by BM25, scores rounded, ties by key."""
    unit = 10.0**digits

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = len(asked.queries)
        least = np.zeros(many)  # the k-th score so far
        kept = (np.empty(0, np.int64), np.empty(0), None)
        for batch in (piece for x in batches for piece in pieces(x, 2)):
            keys, length = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            row = np.repeat(np.arange(len(batch)), pc.list_value_length(batch.column(2)).to_numpy())
            term, tf = (batch.column(i).flatten().to_numpy() for i in (2, 3))
            share = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / mean))
            for first, n, which, cells in asked.meet(row, term):
                exact = np.bincount(cells, share[which], n * many).reshape(n, many)
                score = np.floor(exact * unit + 0.5) / unit
                good = (exact > 0) & (score >= least)
                if n > k:
                    good &= score >= np.partition(score, n - k, axis=0)[n - k]
                r, q = np.nonzero(good)
                if len(r):
                    found = q, score[r, q], keys[first + r]
                    kept = _first(*(y if x is None else np.concatenate([x, y]) for x, y in zip(kept, found, strict=True)), k)
                    full = np.bincount(kept[0], minlength=many) >= k
                    low = np.full(many, np.inf)
                    np.minimum.at(low, kept[0], kept[1])
                    least = np.where(full, low, 0.0)
        if kept[2] is not None:
            names = pa.array(asked.queries, asked.kind).take(pa.array(kept[0]))
            yield pa.RecordBatch.from_arrays([names, pa.array(kept[2], batch.schema.field(0).type), pa.array(kept[1])], names=["query", key, "score"])

    return rows.mapInArrow(work, st.StructType([st.StructField("query", asked.spark_kind), rows.schema[key]]).add("score", st.DoubleType()))


def _first(query: np.ndarray, score: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query."""
    order = np.lexsort((keys, -score, query))
    query, score, keys = query[order], score[order], keys[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    return query[rank < k], score[rank < k], keys[rank < k]
