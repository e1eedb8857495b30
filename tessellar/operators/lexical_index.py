"""A lexical index that is kept: stored postings with positions, grown by batches, merged, and searched block by block.

Layout below ``path``, all Parquet: ``gen=<g>/`` holds one generation of the index, and in it ``postings`` (by bucket of
terms, in the order of terms), ``terms`` (document frequencies), ``docs`` (lengths) and ``stats``, each with a folder for each
batch. A batch counts only once its ``stats`` are there, which are written last; a batch that runs again replaces itself.
``merge`` writes the next generation as one batch; readers take the last generation that is complete.

A row of ``postings`` is a block: a term's documents among about ``BLOCK`` documents of a batch, with their frequencies,
lengths and places, and the block's largest frequency and least length. These two bound the score that any document of the
block can get, so a search scores first the blocks that promise most, and then only those that may still reach the k-th
score; the other blocks' lists aren't unpacked. No list is gathered: a block is bounded by its documents, whatever the term.
A block's documents lie side by side where they are read, and only its postings are shuffled, once, to their buckets; a row
without a term, in bucket -1, holds the block's documents. A search brings a block's lists together and scores it for all queries.

Cases: documents without tokens count in no statistics; a null text has no tokens; documents that are already in the index
are left out of a batch, as are those without a key; terms that aren't in the index find nothing; an empty index finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import cut, exists, remove
from . import scans
from .retrieval import small, top

#: Buckets of terms, documents of a block, blocks that are scored first for each query, documents of a bucket's file.
BUCKETS, BLOCK, FIRST, DOCS_A_FILE = 64, 1024, 4, 1_000_000


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _block(part: int, keys: pa.Array, words: pa.ListArray) -> pa.RecordBatch:
    """A block's postings by terms, and first its documents."""
    length = pc.list_value_length(words).to_numpy()
    coded = words.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(keys)), length)
    place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    order = np.argsort(coded.indices.to_numpy(), kind="stable")  # by term; documents and places are in order already
    term, row, place = coded.indices.to_numpy()[order], row[order], place[order]
    new_term = np.append(True, term[1:] != term[:-1])
    posting = np.flatnonzero(new_term | np.append(True, row[1:] != row[:-1]))  # where each posting begins
    tf, of = np.diff(np.append(posting, len(row))), row[posting]
    begin = np.flatnonzero(new_term[posting])  # where each term's postings begin
    many = np.diff(np.append(begin, len(posting)))
    numbers = lambda x: pa.array(x, pa.int32())
    ends = numbers(np.concatenate([[0, len(keys)], len(keys) + np.append(begin, len(posting))[1:]]))  # the documents' row comes first
    joined = lambda first, rest: pa.ListArray.from_arrays(ends, pa.concat_arrays([first, rest]))
    places = pa.ListArray.from_arrays(numbers(np.concatenate([np.zeros(len(keys)), posting, [len(row)]])), numbers(place))
    columns = [
        pa.concat_arrays([pa.nulls(1, pa.string()), coded.dictionary.take(pa.array(term[posting[begin]]))]),
        pa.array(np.full(len(begin) + 1, part)),
        numbers(np.append(0, np.maximum.reduceat(tf, begin))),
        numbers(np.append(0, np.minimum.reduceat(length[of], begin))),
        numbers(np.append(len(keys), many)),
        joined(keys, keys.take(pa.array(of))),
        joined(numbers(np.zeros(len(keys))), numbers(tf)),
        joined(numbers(length), numbers(length[of])),
        pa.ListArray.from_arrays(ends, places),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["term", "part", "max_tf", "min_len", "n", "keys", "tfs", "lens", "places"])


class LexicalIndex:
    """The index below ``path``; ``key`` is the name of the documents' key."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    # --- what is stored ---

    def _complete(self, generation: int) -> bool:
        return exists(self.spark, f"{self.path}/gen={generation}/stats/batch=0/_SUCCESS")

    @property
    def generation(self) -> int:
        """The last generation that was merged completely; 0 before any merge."""
        g = 0
        while self._complete(g + 1):
            g += 1
        return g

    def _read(self, name: str) -> DataFrame | None:
        """A table of the last generation, of the batches that count."""
        root = f"{self.path}/gen={self.generation}"
        if not exists(self.spark, f"{root}/stats"):
            return None
        stats = self.spark.read.parquet(f"{root}/stats").filter("docs > 0")
        counted = [r["batch"] for r in stats.select("batch").collect()]  # a row for each batch
        if name == "stats" or not counted:
            return stats if counted else None
        return self.spark.read.parquet(f"{root}/{name}").filter(F.col("batch").isin(counted))

    def append(self, docs: DataFrame, batch: int, text: str = "text") -> None:
        """Documents (key, ``text``) as a batch; one that runs again replaces what it wrote."""
        docs, known = docs.select(self.key, text).filter(F.col(self.key).isNotNull()), self._read("docs")
        keys = docs.groupBy(self.key).agg(F.count(F.lit(1)).alias("n"))
        old = F.lit(False)
        if known is not None:
            keys, old = keys.join(known.filter(F.col("batch") != batch).select(self.key, F.lit(True).alias("old")), self.key, "left"), F.coalesce("old", F.lit(False))
        keys = cut(keys.select(self.key, "n", old.alias("old")))  # texts are shuffled for keys only that come again
        odd = keys.filter("n > 1 or old")
        if not odd.isEmpty():
            odd = cut(odd)
            once = docs.join(small(odd.filter("not old").select(self.key)), self.key, "left_semi").dropDuplicates([self.key])
            docs = docs.join(small(odd.select(self.key)), self.key, "left_anti").unionByName(once)
        blocks = self._blocks(docs.select(self.key, T.tokens(F.col(text)).alias("words")))
        self._store(blocks, keys.count(), self.generation, batch)

    def merge(self) -> None:
        """All batches as one, in the next generation; what is read and written are postings, no texts.

        Blocks stay as they are, but small ones are put together.
        """
        old = self._read("postings")
        if old is None:
            return
        sizes = cut(old.filter(F.col("bucket") < 0).select("batch", "part", F.size("keys").alias("many")))
        all_docs, few = sizes.agg(F.sum("many"), F.coalesce(F.sum(F.when(F.col("many") < BLOCK // 2, F.col("many"))), F.lit(0))).first()
        group = -1 - F.pmod(F.xxhash64("batch", "part"), F.lit(max(1, few // BLOCK)))
        now = cut(sizes.select("batch", "part", F.when(F.col("many") < BLOCK // 2, group).otherwise(F.monotonically_increasing_id()).alias("now")))
        rows = old.join(small(now), ["batch", "part"]).drop("batch", "part", "bucket").withColumnRenamed("now", "part")
        lists = ("keys", "tfs", "lens", "places")
        together = rows.filter("part < 0").groupBy("term", "part").agg(F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len"), F.sum("n").cast("int").alias("n"), F.collect_list(F.struct(*lists)).alias("e"))
        names = ["term", "part", "max_tf", "min_len", "n"]
        blocks = rows.filter("part >= 0").select(*names, *lists).unionByName(together.select(*names, *[F.flatten(f"e.{c}").alias(c) for c in lists]))
        self._store(blocks, all_docs, self.generation + 1, 0)

    def _blocks(self, rows: DataFrame) -> DataFrame:
        """term, part, max_tf, min_len, n, keys, tfs, lens, places of documents (key, words) that lie side by side; nothing is shuffled.

        A row without a term holds a block's documents and their lengths.
        """
        size = BLOCK

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId() << 32
            for batch in (x for b in batches for x in scans.pieces(b, 1, size)):
                some = pc.greater(pc.list_value_length(batch.column(1)), 0)
                batch = batch.filter(some)
                if len(batch):
                    yield _block(part := part + 1, batch.column(0), batch.column(1))

        kind = rows.schema[self.key].dataType.simpleString()
        return rows.mapInArrow(work, f"term string, part long, max_tf int, min_len int, n int, keys array<{kind}>, tfs array<int>, lens array<int>, places array<array<int>>")

    def _store(self, blocks: DataFrame, many: int, generation: int, batch: int) -> None:
        at = lambda name: f"{self.path}/gen={generation}/{name}/batch={batch}"
        for name in ("stats", "docs", "terms"):  # a batch that runs again doesn't count meanwhile
            remove(self.spark, at(name))
        files = F.pmod(F.xxhash64("part"), F.lit(1 + many // DOCS_A_FILE))  # a bucket of a large batch has several files
        stored = blocks.withColumn("bucket", F.when(F.col("term").isNull(), -1).otherwise(_bucket(F.col("term"))))
        stored.repartition("bucket", files).sortWithinPartitions("bucket", "term", "part").write.mode("overwrite").partitionBy("bucket").parquet(at("postings"))
        docs = tokens = 0
        if exists(self.spark, f"{at('postings')}/bucket=-1"):
            rows = self.spark.read.parquet(at("postings"))
            listed = rows.filter("bucket < 0").select(F.explode(F.arrays_zip("keys", "lens")).alias("d"))
            listed.select(F.col("d.keys").alias(self.key), F.col("d.lens").alias("len")).write.mode("overwrite").parquet(at("docs"))
            rows.filter("bucket >= 0").groupBy("bucket", "term").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(at("terms"))
            docs, tokens = self.spark.read.parquet(at("docs")).agg(F.count(F.lit(1)), F.sum("len")).first()
        self.spark.range(1).select(F.lit(docs).cast("long").alias("docs"), F.lit(tokens).cast("long").alias("tokens")).write.mode("overwrite").parquet(at("stats"))

    # --- searches ---

    def _asked(self, terms: DataFrame, columns: list[str]) -> DataFrame | None:
        """The blocks of the terms (query, term), without their lists unless ``columns`` name these; only the terms' buckets are read."""
        blocks = self._read("postings")
        if blocks is None:
            return None
        wanted = terms.select(_bucket(F.col("term")).alias("bucket"), "term").distinct()
        buckets = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        return blocks.filter(F.col("bucket").isin(buckets)).select("bucket", "term", "batch", "part", "n", "max_tf", "min_len", *columns).join(small(wanted), ["bucket", "term"], "left_semi")

    def _frequencies(self, terms: DataFrame) -> DataFrame:
        """term, df of the terms that occur."""
        return self._read("terms").join(small(terms.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))

    def _none(self, terms: DataFrame, schema: str) -> DataFrame:
        key = next((f"{self.key} {t}" for c, t in terms.dtypes if c == self.key), f"{self.key} long")
        query = dict(terms.dtypes)["query"]
        return self.spark.createDataFrame([], f"query {query}, {key}{schema}")

    def _documents(self, asked: scans.Asked, blocks: DataFrame) -> DataFrame:
        """key, len, terms, tfs: the asked terms of the documents of blocks (batch, part)."""
        numbers = self.spark.createDataFrame(list(enumerate(asked.terms)), "no int, term string")
        lists = self._asked(numbers.select("term"), ["keys", "tfs", "lens"]).join(small(numbers), "term")
        return scans.by_document(lists.join(small(blocks.select("batch", "part").distinct()), ["batch", "part"], "left_semi"), self.key)

    def match_all(self, terms: DataFrame) -> DataFrame:
        """query, key of the documents that hold all terms (query, term); lists are read only in blocks that hold all terms."""
        terms = cut(terms.select("query", "term").distinct())
        blocks = self._whole_blocks(terms)
        if blocks is None:
            return self._none(terms, "")
        asked = scans.gathered(terms)
        if asked is not None:
            return scans.holding(self._documents(asked, blocks), asked, self.key) if asked.terms else self._none(terms, "")
        lists = self._asked(terms, ["keys"]).join(small(terms), "term").join(small(blocks), ["query", "batch", "part"])
        return lists.select("query", "needed", F.explode("keys").alias(self.key)).groupBy("query", self.key).agg(F.count(F.lit(1)).alias("n"), F.first("needed").alias("needed")).filter("n = needed").select("query", self.key)

    def _whole_blocks(self, terms: DataFrame) -> DataFrame | None:
        """query, batch, part, needed: the blocks of documents in which all of a query's terms occur."""
        blocks = self._asked(terms, [])
        if blocks is None:
            return None
        needed = terms.groupBy("query").agg(F.count(F.lit(1)).alias("needed"))
        found = blocks.join(small(terms), "term").groupBy("query", "batch", "part").agg(F.count(F.lit(1)).alias("n"))
        return cut(found.join(small(cut(needed)), "query").filter("n = needed").select("query", "batch", "part", "needed"))

    def match_phrases(self, phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
        """query, key of the documents that hold a phrase's tokens in a row, by places alone.

        A document is looked at only if its block, and then it itself, holds all the phrase's terms; each place of a term
        less its place in the phrase is where the phrase would begin, and where all terms agree it does.
        """
        words = phrases.select("query", F.posexplode(T.tokens(F.col(phrase))).alias("offset", "term"))
        asked = cut(words.groupBy("query", "term").agg(F.collect_list("offset").alias("offsets")))
        terms = cut(asked.select("query", "term"))
        if self._read("postings") is None:
            return self._none(terms, "")
        held = cut(self.match_all(terms))
        blocks = self._asked(terms, ["keys", "places"]).join(small(asked), "term")
        rows = blocks.select("query", "offsets", F.explode(F.arrays_zip("keys", "places")).alias("d")).select("query", "offsets", F.col("d.keys").alias(self.key), F.col("d.places").alias("places"))
        rows = rows.join(small(held), ["query", self.key], "left_semi")
        starts = F.explode(F.flatten(F.transform("places", lambda p: F.transform("offsets", lambda o: p - o)))).alias("start")
        lengths = asked.groupBy("query").agg(F.sum(F.size("offsets")).alias("length"))
        met = rows.select("query", self.key, starts).groupBy("query", self.key, "start").agg(F.count(F.lit(1)).alias("n"))
        return met.join(small(cut(lengths)), "query").filter("n = length").select("query", self.key).distinct()

    def _scored_terms(self, terms: DataFrame) -> tuple[DataFrame, float]:
        """query, term, idf of the terms that occur; the mean length of documents."""
        stats = self._read("stats").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).first()
        docs, mean = stats["docs"] or 0, (stats["tokens"] or 0) / max(1, stats["docs"] or 0)
        idf = F.log((F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        return cut(terms.join(small(cut(self._frequencies(terms))), "term").select("query", "term", idf.alias("idf"))), mean

    def bounds(self, terms: DataFrame, k1: float = 1.2, b: float = 0.75) -> tuple[DataFrame | None, DataFrame, Column]:
        """query, batch, part, n, bound: the most that a document of the block can score, and how many postings the block has;
        the terms with their weights; a posting's share of a score (of tf, len, idf)."""
        return self._bounds(terms, k1, b)[:3]

    def _bounds(self, terms: DataFrame, k1: float, b: float) -> tuple[DataFrame | None, DataFrame, Column, float]:
        terms = cut(terms.select("query", "term").distinct())
        blocks = self._asked(terms, [])
        if blocks is None:
            return None, terms, F.lit(0.0), 0.0
        weighted, mean = self._scored_terms(terms)
        share = lambda tf, length: F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
        of = blocks.join(small(weighted), "term").groupBy("query", "batch", "part").agg(F.sum(share(F.col("max_tf"), F.col("min_len"))).alias("bound"), F.max("n").alias("n"))
        return cut(of), weighted, share(F.col("tf"), F.col("len")), mean

    def _scores(self, weighted: DataFrame, share: Column, blocks: DataFrame) -> DataFrame:
        """query, key, score of all documents of blocks (query, batch, part) that hold a term."""
        lists = self._asked(weighted, ["keys", "tfs", "lens"]).join(small(weighted), "term").join(small(blocks.select("query", "batch", "part")), ["query", "batch", "part"])
        rows = lists.select("query", "idf", F.explode(F.arrays_zip("keys", "tfs", "lens")).alias("d")).select("query", "idf", F.col("d.keys").alias(self.key), F.col("d.tfs").alias("tf"), F.col("d.lens").alias("len"))
        return rows.groupBy("query", self.key).agg(F.sum(share).alias("score"))

    def search(self, terms: DataFrame, k: int, digits: int = 5, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """query, key, score, rank: the k documents of highest BM25 for terms (query, term), scores rounded, ties by key."""
        bounds, weighted, share, mean = self._bounds(terms, k1, b)
        if bounds is None:
            return self._none(terms, ", score double, rank int")
        first, later = self.choose(bounds, weighted, share, k, digits)
        asked = scans.gathered(weighted)
        if asked is None:
            found = self._scores(weighted, share, later).withColumn("score", F.round("score", digits))
        elif not asked.terms:
            found = first.limit(0)
        else:  # a block that one query needs is scored for all
            of = dict(map(tuple, weighted.select("term", "idf").distinct().collect()))  # no more terms than were gathered
            found = scans.best(self._documents(asked, later), asked, self.key, k, digits, np.array([of[t] for t in asked.terms]), mean, k1, b)
        every = first.unionByName(found).groupBy("query", self.key).agg(F.max("score").alias("score"))
        return top(every, ["query"], [F.desc("score"), F.col(self.key)], k).select("query", self.key, "score", "rank")

    def choose(self, bounds: DataFrame, weighted: DataFrame, share: Column, k: int, digits: int = 5) -> tuple[DataFrame, DataFrame]:
        """The best of the blocks that promise most (query, key, score), and the further blocks that may hold a better one.

        The k-th score of the first is one that the k-th of all reaches at least; a block whose bound is below it is skipped.
        """
        order = Window.partitionBy("query").orderBy(F.desc("bound"), "batch", "part")
        ranked = cut(bounds.withColumn("place", F.row_number().over(order)))
        scored = self._scores(weighted, share, ranked.filter(F.col("place") <= FIRST)).withColumn("score", F.round("score", digits))
        first = cut(top(scored, ["query"], [F.desc("score"), F.col(self.key)], k).drop("rank"))
        least = first.groupBy("query").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("have"))
        rest = ranked.filter(F.col("place") > FIRST).join(small(cut(least)), "query", "left")
        slack = 10.0**-digits  # scores are compared rounded
        return first, cut(rest.filter((F.coalesce("have", F.lit(0)) < k) | (F.col("bound") >= F.col("least") - slack)).select("query", "batch", "part"))
