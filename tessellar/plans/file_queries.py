"""Queries whose rows go through files, streams or a model's function before they come back."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import external, retrieval
from ..operators.lexical_index import LexicalIndex
from ..sources import files
from ..streaming import corpus
from .index_queries import _kept
from .queries import _KNN, ORACLES, _knn, _t, _terms, query


def _through(spark: SparkSession, write: Callable[[str], None], read: Callable[[str], DataFrame]) -> DataFrame:
    """What is read back of what was written to a folder of its own."""

    def use(path: str) -> DataFrame:
        write(path)
        return read(path)

    return _kept(spark, "files", use)


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_lines_read_back(spark, d):
    c = _t(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return _through(spark, lambda path: files.write_json(c, path), lambda path: files.read_any_json(spark, path, "conv_id long, turn long, role string, text string"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_arrays_read_back(spark, d):
    """One array a file, eight of them."""
    c = _t(spark, d, "conversations").select("conv_id", "turn", "role", "text").withColumn("part", F.pmod("conv_id", F.lit(8)))
    arrays = c.groupBy("part").agg(F.collect_list(F.to_json(F.struct("conv_id", "turn", "role", "text"))).alias("rows"))
    lines = arrays.select("part", F.explode(F.concat(F.array(F.lit("[")), F.transform("rows", lambda r, i: F.concat(F.when(i > 0, ", ").otherwise(""), r)), F.array(F.lit("]")))).alias("value"))
    return _through(spark, lambda path: lines.coalesce(1).write.partitionBy("part").text(path), lambda path: files.read_any_json(spark, path, "conv_id long, turn long, role string, text string"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CAST(p_size AS VARCHAR) AS p_size FROM part")
def table_read_back(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return _through(spark, lambda path: files.write_table(p, path, sep="\t"), lambda path: files.read_table(spark, path, sep="\t"))


@query("SELECT DISTINCT p_brand FROM part WHERE trim(p_brand) <> ''")
def ids_of_a_table(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.concat(F.lit(" "), "p_brand", F.lit(" ")).alias("p_brand"))
    return _through(spark, lambda path: files.write_table(p, path), lambda path: files.id_set(spark, path, "p_brand"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1, 2")
def routed_files(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    read = lambda path: spark.read.schema("o_orderkey long, o_orderstatus string, o_orderpriority string").json(path)
    back = _through(spark, lambda path: files.write_by(o, path, ["o_orderstatus", "o_orderpriority"]), read)
    return back.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query(ORACLES["bm25_topn"])
def streamed_bm25_topn(spark, d):
    """The documents come as a stream of JSON files, batch by batch, into the kept index that is searched."""

    def use(path: str) -> DataFrame:
        docs = _t(spark, d, "documents").select("doc_id", "text")
        files.write_json(docs.repartition(4), f"{path}/in")
        stream = corpus.read_stream(spark, f"{path}/in", "doc_id long, text string", files=2)
        corpus.grow_index(stream, f"{path}/index", f"{path}/marks").awaitTermination()
        return LexicalIndex(spark, f"{path}/index").search(_terms(spark, d), 10)

    return _kept(spark, "stream", use)


@query("SELECT item_id, md5('Give 2 search queries, one a line, for these methods:' || chr(10) || left(text, 300)) AS answer FROM benchmark")
def model_answers(spark, d):
    """A chat model's answers; the model is a function of a batch of prompts, here a digest of each."""
    prompts = _t(spark, d, "benchmark").select("item_id", external.prompt(external.QUERIES_PROMPT, {"methods": F.col("text"), "n": F.lit(2)}, cut=300).alias("prompt"))
    return external.answered(prompts, lambda batch: [hashlib.md5(p.encode()).hexdigest() for p in batch], "item_id", "prompt")


@query(f"""WITH {_KNN}, f AS (SELECT * FROM sem WHERE rank <= 12), p AS (SELECT f.query, f.vec_id, f.rank, length(coalesce(text, '')) % 97 AS s FROM f JOIN documents ON doc_id = vec_id),
g AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) AS given, count(*) OVER (PARTITION BY query) AS n FROM p)
SELECT query, vec_id, CAST(CASE WHEN n > 3 THEN row_number() OVER (PARTITION BY query ORDER BY s DESC, given) ELSE given END AS INTEGER) AS rank FROM g""")
def reranked_hits(spark, d):
    """Hits sorted anew by a cross-encoder's scores; the encoder is a function of a batch of pairs, here of the text's length."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    asked = _t(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("question"))
    pairs = _knn(spark, d).filter("rank <= 12").join(docs, "vec_id").join(asked, "query", "left").withColumnRenamed("rank", "first")
    scored = external.scored(pairs, lambda batch: [len(text) % 97 for _, text in batch], "question", "text")
    return external.reranked_if_many(scored, "query", [F.col("first")], 12).select("query", "vec_id", F.col("rank").cast("int").alias("rank"))


@query("""SELECT conv_id, string_agg('[EVIDENCE ' || n || '] ' || left(coalesce(text, ''), 40), chr(10) || chr(10) ORDER BY n) AS evidence
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY 1""")
def numbered_evidence(spark, d):
    turns = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", T.blank(F.col("text")).alias("t")))).alias("turns"))
    return turns.select("conv_id", external.evidence(F.transform("turns", lambda x: x["t"]), 40).alias("evidence"))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def embedded_texts(spark, d):
    """Vectors of texts by a batch function; here the texts are the vectors' numbers, and the function reads them."""
    texts = _t(spark, d, "embeddings").select("vec_id", F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ").alias("text"))
    found = retrieval.embed(texts, lambda batch: [list(map(float, t.split())) for t in batch], key="vec_id")
    return found.select("vec_id", F.size("embedding").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))
