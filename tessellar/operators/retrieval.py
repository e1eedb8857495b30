"""Lexical and vector retrieval, fusion, diversification."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon, stemming
from ..functions import text as T
from ..session import cut
from . import scans

#: A side of a join is broadcast only if a count shows that it has no more rows than this.
FEW = 500_000


def small(df: DataFrame, rows: int = FEW) -> DataFrame:
    """``df``, to be broadcast if it is counted to be small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def postings(docs: DataFrame, terms: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """term, document, frequency, length of the document: the inverted index, of all terms or of those asked for (term).

    Terms that nobody asks for are dropped before the shuffle; counts are summed on the map side.
    """
    t = docs.select(F.col(key), T.tokens(F.col(text)).alias("t"))
    rows = t.select(key, F.size("t").alias("len"), F.explode("t").alias("term"))
    if terms is not None:
        rows = rows.join(small(terms.select("term").distinct()), "term", "left_semi")
    return rows.groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))


def match_all(index: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """query, document pairs in which every term (query, term) of the query occurs."""
    t = terms.distinct()
    needed = t.groupBy("query").agg(F.count(F.lit(1)).alias("needed"))
    found = index.join(small(t), "term").groupBy("query", key).agg(F.count(F.lit(1)).alias("found"))
    return found.join(needed, "query").filter("found = needed").select("query", key)


def bm25(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query, document, score of the documents that hold a term. Documents without tokens don't count in the statistics."""
    length = F.size(T.tokens(F.col(text)))
    stats = docs.agg(F.count_if(length > 0).alias("docs"), F.avg(F.when(length > 0, length)).alias("mean"))
    asked = cut(postings(docs, terms, key, text))
    df = small(cut(asked.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(terms.distinct(), "term")))
    rows = asked.join(df, "term").crossJoin(F.broadcast(stats))  # one row of statistics
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return rows.groupBy("query", key).agg(F.sum(part).alias("score"))


def matching(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """query, document pairs in which every term (query, term) of the query occurs: by a scan, or by joins if the terms are many."""
    asked, docs = scans.gathered(terms), scans.one_row_each(docs, key, text)
    if asked is None:
        return match_all(postings(docs, terms, key, text), terms, key)
    return scans.matched(docs, asked, key, T.tokens(F.col(text)))


def bm25_top(docs: DataFrame, terms: DataFrame, k: int, digits: int = 5, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query, document, score, rank: the k documents of highest BM25, scores rounded, ties by key: by a scan, or by joins if the terms are many.

    The texts are read once; what is stored of them are the asked terms.
    """
    asked, docs = scans.gathered(terms), scans.one_row_each(docs, key, text)
    order = [F.desc("score"), F.col(key)]
    if asked is None:
        scored = bm25(docs, terms, key, text, k1, b).filter(F.col(key).isNotNull())
        return top(scored.withColumn("score", F.round("score", digits)), ["query"], order, k)
    rows = cut(scans.counted(docs, asked, key, T.tokens(F.col(text))))
    stats = rows.filter("len > 0").agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("mean")).first()
    df = np.zeros(len(asked.terms))
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():  # no more rows than terms asked
        df[r["term"]] = r["df"]
    idf = np.log((stats["docs"] - df + 0.5) / (df + 0.5) + 1)
    return top(scans.best(rows.filter(F.col(key).isNotNull()), asked, key, k, digits, idf, stats["mean"] or 1.0, k1, b), ["query"], order, k)


def tfidf_terms(docs: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The k terms of each document with the highest smoothed, length-normalised tf-idf.

    Terms are counted and weighed in blocks of documents; only blocks' words, not documents' terms, are shuffled by term.
    """
    return scans.heaviest_of_all(cut(scans.in_blocks(docs, key, T.tokens(F.col(text)))), key, k, 6, docs.count())


def weighted_terms(docs: DataFrame, terms: DataFrame, k: int, key: str, features: int | None = None) -> DataFrame:
    """The k terms of highest tf-idf of each document, of terms (key, term); ``features`` keeps the commonest ones only.

    Terms are counted where their document is, before anything is shuffled, and the counts are stored once; document
    frequencies meet by partial sums and go back by a broadcast if few.
    """
    tf = cut(terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("all"))
    if features:
        df = df.orderBy(F.desc("all"), "term").limit(features)
    w = tf.join(small(cut(df.select("term", "df"))), "term").crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return top(w.withColumn("score", F.round(F.col("w") / norm, 6)).select(key, "term", "score"), [key], [F.desc("score"), F.col("term")], k)


#: Rows of a block of vectors, queries of a pack that meets it.
ROWS, PACK = 2048, 512


def blocks(vectors: DataFrame, key: str, vector: str, *more: str, size: int = ROWS) -> DataFrame:
    """``more``, dims, ids, vectors (packed long and double numbers): blocks of up to ``size`` rows that lie side by side, equal in ``more``.

    Nothing is shuffled. Rows without a key, a vector or one of its components take no part.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple, list[int]] = {}
            groups = [c.to_pylist() for c in batch.columns[2:]]
            ids, flat, ends = batch.column(0).to_numpy(), batch.column(1).values.to_numpy(), batch.column(1).offsets.to_numpy()
            for i, key_of in enumerate(zip(ends[1:] - ends[:-1], *groups, strict=True)):
                rows.setdefault(key_of, []).append(i)
            out = [(g, at[i : i + size]) for g, at in rows.items() for i in range(0, len(at), size)]
            if out:
                packed = [(ids[at].tobytes(), np.stack([flat[ends[i] : ends[i + 1]] for i in at]).tobytes()) for _, at in out]
                kinds = [pa.int64(), *(batch.schema.field(2 + i).type for i in range(len(groups))), pa.binary(), pa.binary()]
                columns = [*zip(*(g for g, _ in out), strict=True), *zip(*packed, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(list(map(plain, c)), t) for c, t in zip(columns, kinds, strict=True)], names=["dims", *more, "ids", "vectors"])

    plain = lambda x: x.item() if hasattr(x, "item") else x
    usable = vectors.select(F.col(key).cast("long").alias("_key"), F.col(vector).cast("array<double>").alias("_v"), *more)
    usable = usable.filter("_key is not null and _v is not null and size(_v) > 0 and not exists(_v, x -> x is null)")
    kinds = ", ".join(f"{c} {t}" for c, t in usable.select(*more).dtypes) + ", " if more else ""
    return usable.mapInArrow(work, f"dims long, {kinds}ids binary, vectors binary")


def nearest_in_blocks(met: DataFrame, k: int) -> DataFrame:
    """query, vec_id, sim: of rows with a block (dims, ids, vectors) and a pack of queries (asked, asked_vectors), the k best of each query there, and ties with the last."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, *packed in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
                ids, v, asked, q = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(packed, (np.int64, float, np.int64, float), strict=True))
                sims = v.reshape(-1, dims) @ q.reshape(-1, dims).T
                least = np.partition(sims, -k, axis=0)[-k] if len(sims) > k else np.full(len(asked), -np.inf)
                row, col = np.nonzero(sims >= least - 2e-6)  # similarities are compared to six decimals
                yield pa.RecordBatch.from_arrays([pa.array(asked[col]), pa.array(ids[row]), pa.array(sims[row, col])], names=["query", "vec_id", "sim"])

    return met.select("dims", "ids", "vectors", "asked", "asked_vectors").mapInArrow(work, "query long, vec_id long, sim double")


def packs(queries: DataFrame, *more: str) -> DataFrame:
    """``more``, dims, asked, asked_vectors: queries (query, embedding) packed like blocks, after those equal in ``more`` were brought together."""
    near = queries.repartition(*more) if more else queries.repartition(max(1, -(-queries.count() // PACK)), "query")
    return blocks(near, "query", "embedding", *more, size=PACK).withColumnsRenamed({"ids": "asked", "vectors": "asked_vectors"})


def knn(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, vec_id, sim, rank: exact nearest by inner product of queries (query, embedding) among vectors (vec_id, embedding).

    Blocks of rows meet packs of queries of the same length, all of them, as every row is a candidate of every query; the
    packs are broadcast if counted to be few, else each block is sent to each pack. A block keeps its k best for each query,
    and ties with the last of them, before anything is shuffled.
    """
    asked, rows = cut(packs(cut(queries))), blocks(vectors, "vec_id", "embedding")
    many = asked.count()
    if many <= PACKS:
        met = rows.join(F.broadcast(asked), "dims")
    else:
        met = rows.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(many - 1)))).join(asked.withColumn("pack", F.pmod(F.xxhash64("asked"), F.lit(many)).cast("int")), ["dims", "pack"])
    found = nearest_in_blocks(met, k)
    return top(found.withColumn("sim", F.round("sim", 6)), ["query"], [F.desc("sim"), F.col("vec_id")], k)


#: Packs that are broadcast: some 16 MB of 64 numbers a query.
PACKS = 64


def top(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group, with their rank from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)


def fuse(lexical: DataFrame, semantic: DataFrame, n: int, key: str = "doc_id", weights: tuple[float, float] = (1.0, 0.5)) -> DataFrame:
    """Weighted reciprocal ranks of two lists (query, key, rank from 1), the n best of each query."""
    a = lexical.select("query", key, (weights[0] / F.col("rank")).alias("s"), F.col("rank").alias("lex"), F.lit(None).cast("int").alias("sem"))
    b = semantic.select("query", key, (weights[1] / F.col("rank")).alias("s"), F.lit(None).cast("int").alias("lex"), F.col("rank").alias("sem"))
    both = a.unionByName(b).groupBy("query", key).agg(F.round(F.sum("s"), 6).alias("score"), F.min("lex").alias("lex"), F.min("sem").alias("sem"))
    return top(both, ["query"], [F.desc("score"), F.col("lex").asc_nulls_last(), F.col("sem").asc_nulls_last(), F.col(key)], n)


def diversify(hits: DataFrame, k: int, balance: float = 0.5) -> DataFrame:
    """Maximal marginal relevance per query over (query, vec_id, sim, embedding); all, in order, if no more than k.

    A query's candidates are a bounded top list, so they fit a task.
    """

    def pick(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["sim", "vec_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        order = list(range(len(d)))
        if len(d) > k:
            v, sim, order = np.stack(d.embedding.to_numpy()).astype(float), d.sim.to_numpy(), []
            near = np.zeros(len(d))
            for _ in range(k):
                value = np.round(balance * sim - (1 - balance) * near, 9)
                value[order] = -np.inf
                order.append(int(np.argmax(value)))
                near = np.maximum(near, v @ v[order[-1]]) if len(order) > 1 else v @ v[order[-1]]
        out = d.loc[order, ["query", "vec_id"]]
        return out.assign(pos=range(1, len(out) + 1))

    return hits.groupBy("query").applyInPandas(pick, "query long, vec_id long, pos int")


def across_queries(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hits of several queries (query, key, rank): each document once, by its first query and rank."""
    w = Window.partitionBy(key).orderBy("query", "rank")
    return hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def least_ranks(asked: DataFrame, hits: DataFrame, topic: str) -> DataFrame:
    """``topic``, rank from 0: the least rank at which any query (topic, query) has a hit (query, rank from 1); null where all miss."""
    first = hits.groupBy("query").agg(F.min("rank").alias("rank"))
    return asked.join(first, "query", "left").groupBy(topic).agg((F.min("rank") - 1).cast("int").alias("rank"))


def embed(texts: DataFrame, model, key: str = "doc_id", text: str = "text", size: int = 64) -> DataFrame:
    """Vectors of texts by a pluggable batch function ``model(list[str]) -> array``."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), size):
                part = f.iloc[i : i + size]
                yield pd.DataFrame({key: part[key], "embedding": [list(map(float, v)) for v in model(part[text].fillna("").tolist())]})

    return texts.select(key, text).mapInPandas(work, f"{key} {dict(texts.dtypes)[key]}, embedding array<float>")


def with_texts(hits: DataFrame, docs: DataFrame, key: str = "doc_id", columns: Sequence[str] = ("text",), width: int = 200) -> DataFrame:
    """Hits with their documents' columns, texts cut to a preview; hits without a document stay, with nulls."""
    found = docs.select(key, *[F.left(c, F.lit(width)).alias(c) for c in columns]).join(small(hits.select(key).distinct()), key, "left_semi")
    return hits.join(found, key, "left")


def grams(c: Column, n: int = 2, stop: Sequence[str] = lexicon.STOP_WORDS) -> Column:
    """Words of two letters or more without stop words, and runs of up to n of these."""
    words = F.filter(T.tokens(c), lambda t: (F.length(t) > 1) & ~t.isin(*stop))

    def with_runs(w: Column) -> Column:
        out = [w]
        for size in range(2, n + 1):  # the runs that are a word shorter, each with the word that follows
            many = F.greatest(F.size(w) - (size - 1), F.lit(0))
            out.append(F.zip_with(F.slice(out[-1], F.lit(1), many), F.slice(w, F.lit(size), many), lambda x, y: F.concat(x, F.lit(" "), y)))
        return F.concat(*out)

    # the words stand in an array of one, so that they are made once and then known by a name
    return F.transform(F.array(words), with_runs)[0]


def commonest_grams(texts: DataFrame, features: int, text: str = "text", n: int = 2, buckets: int = 1 << 20) -> DataFrame:
    """term, all: the commonest words and word runs of all texts by their counts, ties by term.

    Words are counted one by one, runs first by buckets of their hashes only. The count of the last of the commonest words is
    one that a run must reach, and its bucket with it, so the few buckets that do hold all runs that may be among the commonest.
    """
    terms, is_run = texts.select(F.explode(grams(F.col(text), n)).alias("term")), F.contains("term", F.lit(" "))
    bucket = F.when(is_run, F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    counts = cut(terms.groupBy(F.when(~is_run, F.col("term")).alias("term"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("all")))
    words = counts.filter("term is not null").orderBy(F.desc("all"), "term").limit(features).select("term", "all")
    least = words.agg(F.when(F.count(F.lit(1)) == features, F.min("all"))).first()[0] or 0
    full = counts.filter((F.col("all") >= least) & F.col("bucket").isNotNull()).select("bucket")
    runs = terms.filter(is_run).withColumn("bucket", bucket).join(small(full), "bucket", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("all"))
    return words.unionByName(runs.filter(F.col("all") >= least)).orderBy(F.desc("all"), "term").limit(features)


def keyword_queries(docs: DataFrame, k: int, key: str = "doc_id", text: str = "text", features: int = 5000, n: int = 2) -> DataFrame:
    """key, term, score, rank: the k terms that would ask for a document, of the corpus's commonest words and word pairs.

    Terms are found and weighed where their document is, and only counts are shuffled; with more features than can be sent to
    the tasks, all terms are.
    """
    if features > scans.PAIRS:
        return weighted_terms(docs, docs.select(key, F.explode(grams(F.col(text), n)).alias("term")), k, key, features)
    asked = scans.gathered(commonest_grams(docs, features, text, n).select(F.lit(0).alias("query"), "term"))
    rows = cut(scans.one_count_each(scans.counted(docs, asked, key, grams(F.col(text), n)), key))
    df = np.zeros(len(asked.terms))
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():  # no more rows than features
        df[r["term"]] = r["df"]
    return scans.heaviest(rows, asked, key, k, 6, np.log((1 + docs.count()) / (1 + df)) + 1)


def keywords(docs: DataFrame, k: int, key: str = "doc_id", text: str = "text", n: int = 2) -> DataFrame:
    """key, term: the k commonest words and word pairs of each document, ties by term."""
    counts = docs.select(key, F.explode(grams(F.col(text), n)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
    return top(counts, [key], [F.desc("n"), F.col("term")], k).select(key, "term")


def query_candidates(title: Column, terms: Column, keywords_text: Column, long_enough: Column) -> Column:
    """An array of (kind, query): the title, the terms of a text that is long enough, or the keywords if there is neither."""
    some = lambda kind, q: F.when(F.trim(T.blank(q)) != "", F.struct(F.lit(kind).alias("kind"), F.trim(q).alias("query")))
    first = F.array_compact(F.array(some("Q1_title", title), F.when(long_enough, some("Q2_tfidf", terms))))
    return F.when(F.size(first) > 0, first).otherwise(F.array_compact(F.array(some("Q0_keywords", keywords_text))))


def with_extra_query(queries: Column, extra: Column) -> Column:
    """A list of queries and one more, each once."""
    return F.array_distinct(F.array_compact(F.concat(queries, F.array(F.nullif(F.trim(extra), F.lit(""))))))


def match_folded(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", stem: bool = False) -> DataFrame:
    """query, document: every token of the terms (query, term) occurs, without regard to case and diacritics, and by stems on request.

    The forms of words are made once for each distinct word; documents' words are then compared with the few words whose
    form is asked for.
    """
    form = (lambda c: stemming.stems(stemming.folds(c))) if stem else stemming.folds
    docs = scans.one_row_each(docs, key, text)
    unmarked = lambda c: T.tokens(F.regexp_replace(T.blank(F.col(c)), r"\pM+", ""))  # noqa: E731  marks that stand apart would split words
    tokens = terms.select("query", F.explode(unmarked("term")).alias("token"))
    asked = cut(tokens.withColumn("form", form(F.col("token"))).select("query", "form").distinct())
    words = docs.select(key, F.explode(F.array_distinct(unmarked(text))).alias("token"))
    vocabulary = words.select("token").distinct().withColumn("form", form(F.col("token"))).join(small(asked.select("form").distinct()), "form", "left_semi")
    vocabulary, terms = cut(vocabulary), asked.withColumnRenamed("form", "term")
    few = scans.gathered(terms, vocabulary)
    if few is not None:
        return scans.matched(docs, few, key, unmarked(text))
    found = words.join(small(vocabulary), "token").select(key, F.col("form").alias("term")).distinct()
    return match_all(found, terms, key)
