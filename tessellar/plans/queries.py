"""Named queries over whole tables and the same rows in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import text as T
from ..operators import documents, graph, linkage, metrics, reports, retrieval, selection
from ..streaming import corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Pieces of SQL: tokens of a text, a list as SQL text.
TOKENS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\pL\\pN_]+'), lambda t: t <> '')"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


# --- text functions ---


@query(f"SELECT doc_id, len({TOKENS}) AS n_tokens, len(list_distinct({TOKENS})) AS n_distinct, array_to_string(list_sort(list_distinct({TOKENS})), ' ') AS tokens FROM documents")
def tokset(spark, d):
    t = T.tokens(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.array_join(T.token_set(F.col("text")), " ").alias("tokens"))


@query("SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS squeezed FROM conversations")
def ws_norm(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", T.squeeze(F.col("text")).alias("squeezed"))


@query("SELECT doc_id, length(coalesce(text, '')) AS chars, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda t: t <> '')) AS words FROM documents")
def doc_stats(spark, d):
    t = T.blank(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.length(t).cast("long").alias("chars"), F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))


@query("SELECT p_partkey, CAST(2 AS BIGINT) AS n_params, CAST(p_size + p_partkey % 60 AS DOUBLE) AS total, 'ml min' AS units FROM part")
def param_extract(spark, d):
    text = F.concat(F.col("p_name"), F.lit(" "), F.col("p_size"), F.lit(" mL for "), F.col("p_partkey") % 60, F.lit(" MIN, 7 minks"))
    rows = _t(spark, d, "part").select("p_partkey", T.params(text).alias("p"))
    units = F.array_join(F.transform("p", lambda x: T.unit(x["unit"])), " ")
    return rows.select("p_partkey", F.size("p").cast("long").alias("n_params"), F.aggregate("p", F.lit(0.0), lambda a, x: a + x["value"]).alias("total"), units.alias("units"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_intersect(list_distinct({TOKENS}), {_list(lexicon.ACTIONS)})), ' ') AS actions, array_to_string(list_sort(list_intersect(list_distinct({TOKENS}), {_list(lexicon.MATERIALS)})), ' ') AS materials FROM documents")
def action_hints(spark, d):
    hits = lambda words, name: F.array_join(T.lexicon_hits(F.col("text"), words), " ").alias(name)
    return _t(spark, d, "documents").select("doc_id", hits(lexicon.ACTIONS, "actions"), hits(lexicon.MATERIALS, "materials"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(p_name), '&', 'and'), '[-_/]+', ' ', 'g'), '[\\[\\]():,]', '', 'g'), '\\s+', ' ', 'g')) AS title FROM part")
def title_norm(spark, d):
    return _t(spark, d, "part").select("p_partkey", T.title_key(F.col("p_name")).alias("title"))


@query("""WITH s AS (SELECT doc_id, list_filter(list_transform(flatten(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: string_split(regexp_replace(l, '([.:;])\\s+([A-Z0-9(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)))), lambda x: trim(x)), lambda x: length(x) >= 20) AS p FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS pos, p[i + 1] AS step FROM s, LATERAL (SELECT unnest(range(len(p))) AS i)""")
def sentence_steps(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.posexplode(T.steps(F.col("text"))).alias("pos", "step"))


@query("""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '["''()*:^{}\\[\\]<>=!?+~&|\\\\]', ' ', 'g'), '(?i)\\b(AND|OR|NOT|NEAR)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS query FROM conversations""")
def fts_sanitize(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", T.query_text(F.col("text")).alias("query"))


@query("SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host FROM pages WHERE contains(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), 'e')")
def url_host_filter(spark, d):
    return _t(spark, d, "pages").select("page_id", T.host(F.col("url")).alias("host")).filter(F.contains("host", F.lit("e")))


@query("SELECT item_id, CAST(i AS INTEGER) AS pos, substr(text, CAST(i AS INTEGER) + 1, 200) AS part FROM benchmark, LATERAL (SELECT unnest(range(0, length(text), 150)) AS i) WHERE length(text) > 200 UNION ALL SELECT item_id, 0, coalesce(text, '') FROM benchmark WHERE length(coalesce(text, '')) <= 200")
def char_windows(spark, d):
    w = F.posexplode(T.windows(F.col("text"), 200, 150)).alias("n", "part")
    return _t(spark, d, "benchmark").select("item_id", w).select("item_id", (F.col("n") * 150).cast("int").alias("pos"), "part")


@query("SELECT conv_id, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 3) AS BIGINT) AS chunk, turn FROM conversations")
def step_packing(spark, d):
    n = F.row_number().over(retrieval.Window.partitionBy("conv_id").orderBy("turn"))
    return _t(spark, d, "conversations").select("conv_id", F.floor((n - 1) / 3).alias("chunk"), "turn")


# --- reports ---


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def count_by_domain(spark, d):
    return reports.counts(_t(spark, d, "documents"), "lang")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang HAVING count(*) >= 120")
def eligible_domains(spark, d):
    return reports.eligible(_t(spark, d, "documents"), "lang", 120)


@query("SELECT coalesce(source, 'ALL') AS source, lang AS domain, count(*) AS n FROM documents GROUP BY GROUPING SETS ((source, lang), (lang))")
def grouping_sets_source_domain(spark, d):
    return reports.counts_by_source_and_overall(_t(spark, d, "documents"), "source", "lang")


@query("SELECT user_id, " + ", ".join(f"round(sum(CASE WHEN event_type = '{k}' THEN value ELSE 0 END), 4) AS {k}_sum" for k in ("click", "view")) + " FROM events GROUP BY user_id")
def conditional_source_sums(spark, d):
    s = reports.conditional_sums(_t(spark, d, "events"), "user_id", "event_type", ["click", "view"], "value")
    return s.select("user_id", *[F.round(c, 4).alias(c) for c in ("click_sum", "view_sum")])


@query("SELECT count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, round(sum(n_chars) / greatest(count(*), 1), 4) AS chars_per_doc FROM documents")
def overall_summary(spark, d):
    return _t(spark, d, "documents").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"), F.round(F.sum("n_chars") / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias("chars_per_doc"))


@query("""WITH g AS (SELECT event_type, list_sort(list(value)) AS v, round(avg(value), 6) AS mean FROM events GROUP BY event_type)
SELECT event_type, CAST(len(v) AS BIGINT) AS n, mean, v[CAST(floor(0.25 * (len(v) - 1)) AS BIGINT) + 1] AS p25, v[CAST(floor(0.75 * (len(v) - 1)) AS BIGINT) + 1] AS p75, v[1] AS least, v[len(v)] AS most FROM g""")
def summary_quantiles_floor(spark, d):
    return reports.summary(_t(spark, d, "events"), "event_type", "value").select("event_type", "n", F.round("mean", 6).alias("mean"), "p25", "p75", "least", "most")


@query("SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS p{p}" for p in (10, 25, 50, 75, 90)) + " FROM events GROUP BY event_type")
def quantiles_linear(spark, d):
    q = reports.quantiles(_t(spark, d, "events"), "event_type", "value")
    return q.select("event_type", *[F.round(c, 6).alias(c) for c in q.columns[1:]])


@query("SELECT lang, round(avg(n_chars), 6) AS n_chars_mean FROM documents GROUP BY lang")
def domain_means(spark, d):
    return reports.averages(_t(spark, d, "documents"), ["n_chars"], "lang").withColumn("n_chars_mean", F.round("n_chars_mean", 6))


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY o_orderkey) AS joined FROM orders GROUP BY o_custkey")
def listagg_sources(spark, d):
    return reports.joined_values(_t(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderkey")


@query("SELECT CASE WHEN l.doc_id IS NULL THEN 'no_match' WHEN l.quality >= 1 THEN 'OK' ELSE 'low_confidence' END AS status, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def status_counts(spark, d):
    j = _t(spark, d, "documents").join(_t(spark, d, "labels").withColumn("_has", F.lit(True)), "doc_id", "left")
    return j.select(linkage.status(F.col("_has").isNotNull(), F.col("quality"), 1).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# --- joins, linkage, selection ---


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def exclude_anti(spark, d):
    return linkage.without(_t(spark, d, "documents"), _t(spark, d, "labels"), "doc_id").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def include_semi(spark, d):
    return linkage.within(_t(spark, d, "documents"), _t(spark, d, "labels").filter("toxic = 1"), "doc_id").select("doc_id")


@query("SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def left_defaults(spark, d):
    j = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("quality", "toxic")])


@query("""SELECT c_custkey, n_name, r_name, CASE WHEN n_name IS NULL THEN 'no_nation' WHEN r_name IS NULL THEN 'no_region' ELSE 'ok' END AS status
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 > 0) ON c_nationkey = n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_name <> 'ASIA') ON n_regionkey = r_regionkey""")
def three_way_status(spark, d):
    n, r = _t(spark, d, "nation").filter("n_nationkey % 5 > 0"), _t(spark, d, "region").filter("r_name <> 'ASIA'")
    j = _t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    status = F.when(F.col("n_name").isNull(), "no_nation").when(F.col("r_name").isNull(), "no_region").otherwise("ok")
    return j.select("c_custkey", "n_name", "r_name", status.alias("status"))


_BEST = "row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)"


@query(f"SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, {_BEST} AS n FROM orders) WHERE n = 1")
def best_confidence_dedup(spark, d):
    return linkage.keep_first(_t(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(f"SELECT o_custkey, o_orderkey FROM (SELECT *, {_BEST} AS n FROM orders) WHERE n > 1")
def dropped_rows(spark, d):
    return linkage.dropped(_t(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_orderkey) AS n FROM orders) WHERE n = 1")
def source_priority_dedup(spark, d):
    return linkage.by_priority(_t(spark, d, "orders"), ["o_custkey"], "o_orderstatus", ["F", "O"], [F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("SELECT l_orderkey, l_linenumber, round(least(1.0, greatest(0.0, 0.7 * l_discount + 0.3 * l_tax + 0.05 * CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)), 6) AS confidence FROM lineitem")
def confidence_score(spark, d):
    c = linkage.confidence(F.col("l_discount"), F.col("l_tax"), (F.col("l_returnflag") == "R").cast("int"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(c, 6).alias("confidence"))


@query("SELECT doc_id FROM labels WHERE quality >= 1 AND toxic >= 1")
def threshold_all(spark, d):
    return _t(spark, d, "labels").filter(selection.passes({"quality": 1, "toxic": 1}, "all")).select("doc_id")


@query("SELECT doc_id FROM labels WHERE quality >= 1 OR toxic >= 1")
def threshold_any(spark, d):
    return _t(spark, d, "labels").filter(selection.passes({"quality": 1, "toxic": 1, "doc_id": 0}, "any")).select("doc_id")


@query("SELECT l_orderkey, l_linenumber, round(0.3 * l_quantity + 0.7 * l_discount, 6) AS score FROM lineitem ORDER BY score DESC, l_orderkey * 10 + l_linenumber DESC LIMIT 15")
def weighted_topn(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.round(0.3 * F.col("l_quantity") + 0.7 * F.col("l_discount"), 6).alias("w"))
    return selection.weighted_top(rows, {"w": 1.0}, 15, "key").select("l_orderkey", "l_linenumber", "score")


@query("SELECT doc_id, lang FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS c, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || '42'), doc_id) AS n FROM documents) WHERE c >= 30 AND n <= 5")
def balanced_sample(spark, d):
    return selection.balanced_sample(_t(spark, d, "documents"), "doc_id", "lang", 30, 5).select("doc_id", "lang")


@query("SELECT doc_id, CASE WHEN c >= 30 AND n <= 10 THEN 'test' ELSE 'corpus' END AS split FROM (SELECT *, count(*) OVER (PARTITION BY lang, source) AS c, row_number() OVER (PARTITION BY lang, source ORDER BY md5(CAST(doc_id AS VARCHAR) || '42'), doc_id) AS n FROM documents)")
def stratified_split(spark, d):
    return selection.split(_t(spark, d, "documents"), "doc_id", ["lang", "source"], 30, 10).select("doc_id", "split")


# --- retrieval ---


def _terms(spark, d):
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))


_TERMS2 = f"""q AS (SELECT DISTINCT item_id AS query, unnest({TOKENS}) AS term FROM benchmark),
tok AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents), tf AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY 1, 2),
need AS (SELECT query, count(*) AS k FROM q GROUP BY 1)"""
_MATCH = "m AS (SELECT q.query, tf.doc_id FROM tf JOIN q USING (term) JOIN need ON need.query = q.query GROUP BY 1, 2, k HAVING count(*) = k)"


@query(f"WITH {_TERMS2}, {_MATCH} SELECT query, doc_id FROM m")
def lexical_and_match(spark, d):
    return retrieval.matching(_t(spark, d, "documents"), _terms(spark, d))


@query(f"""WITH {_TERMS2}, ln AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY 1), st AS (SELECT count(*) AS docs, avg(len) AS mean FROM ln), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT query, doc_id, round(sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 5) AS score FROM tf JOIN q USING (term) JOIN df USING (term) JOIN ln USING (doc_id), st GROUP BY 1, 2)
SELECT query, doc_id, score, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS n FROM s) WHERE n <= 10""")
def bm25_topn(spark, d):
    return retrieval.bm25_top(_t(spark, d, "documents"), _terms(spark, d), 10)


_KNN = """qv AS (SELECT vec_id AS query, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)),
sim AS (SELECT query, vec_id, round(list_inner_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), e), 6) AS sim FROM embeddings, qv),
sem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) AS rank FROM sim) WHERE rank <= 20)"""


def _knn(spark, d, k=20):
    e = _t(spark, d, "embeddings")
    ids = _t(spark, d, "benchmark").select(F.col("item_id").alias("vec_id"))
    return retrieval.knn(e, e.join(ids, "vec_id", "left_semi").withColumnRenamed("vec_id", "query"), k)


@query(f"WITH {_KNN} SELECT query, vec_id, sim, CAST(rank AS INTEGER) AS rank FROM sem")
def vector_knn(spark, d):
    return _knn(spark, d)


_BM25 = """ln AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY 1), st AS (SELECT count(*) AS docs, avg(len) AS mean FROM ln), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT query, doc_id, round(sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 5) AS score FROM tf JOIN q USING (term) JOIN df USING (term) JOIN ln USING (doc_id), st GROUP BY 1, 2)"""


@query(f"""WITH {_TERMS2}, {_BM25}, lex AS (SELECT * FROM (SELECT query, doc_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 50), {_KNN},
u AS (SELECT query, doc_id, 1.0 / rank AS s, rank AS lex, NULL AS sem FROM lex UNION ALL SELECT query, vec_id, 0.5 / rank, NULL, rank FROM sem),
f AS (SELECT query, doc_id, round(sum(CAST(s AS DOUBLE)), 6) AS score, min(lex) AS lex, min(sem) AS sem FROM u GROUP BY 1, 2)
SELECT query, doc_id, score, CAST(n AS INTEGER) AS rank, substr(text, 1, 80) AS text FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, lex NULLS LAST, sem NULLS LAST, doc_id) AS n FROM f) LEFT JOIN documents USING (doc_id) WHERE n <= 10""")
def hybrid_bm25_topn(spark, d):
    docs = _t(spark, d, "documents")
    lexical = retrieval.bm25_top(docs, _terms(spark, d), 50).drop("score")
    semantic = _knn(spark, d).select("query", F.col("vec_id").alias("doc_id"), "rank")
    hits = retrieval.fuse(lexical, semantic, 10).select("query", "doc_id", "score", "rank")
    return retrieval.with_texts(hits, docs, width=80).select("query", "doc_id", "score", "rank", "text")


def _lexical(spark, d):
    return retrieval.top(lexical_and_match(spark, d), ["query"], [F.col("doc_id")], 50)


@query(f"""WITH {_TERMS2}, {_MATCH}, lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY doc_id) AS rank FROM m) WHERE rank <= 50), {_KNN},
u AS (SELECT query, doc_id, 1.0 / rank AS s, rank AS lex, NULL AS sem FROM lex UNION ALL SELECT query, vec_id, 0.5 / rank, NULL, rank FROM sem),
f AS (SELECT query, doc_id, round(sum(CAST(s AS DOUBLE)), 6) AS score, min(lex) AS lex, min(sem) AS sem FROM u GROUP BY 1, 2)
SELECT query, doc_id, score, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, lex NULLS LAST, sem NULLS LAST, doc_id) AS n FROM f) WHERE n <= 10""")
def hybrid_rrf_topn(spark, d):
    semantic = _knn(spark, d).select("query", F.col("vec_id").alias("doc_id"), "rank")
    return retrieval.fuse(_lexical(spark, d), semantic, 10).select("query", "doc_id", "score", "rank")


@query(f"""WITH tok AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents), tf AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
w AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n), s AS (SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS score FROM w)
SELECT doc_id, term, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS r FROM s) WHERE r <= 5""")
def tfidf_keywords(spark, d):
    return retrieval.tfidf_terms(_t(spark, d, "documents"), 5)


@query(f"""WITH {_TERMS2}, {_MATCH}, lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY doc_id) AS rank FROM m) WHERE rank <= 50)
SELECT query, doc_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY query, rank) AS n FROM lex) WHERE n = 1""")
def multi_query_dedup(spark, d):
    return retrieval.across_queries(_lexical(spark, d)).select("query", "doc_id", "rank")


@query(f"""WITH RECURSIVE {_KNN}, v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), c AS (SELECT query, vec_id, sim, rank, e FROM sem JOIN v USING (vec_id)),
m AS (SELECT a.query, a.rank, a.sim, list(list_inner_product(a.e, b.e) ORDER BY b.rank) AS near FROM c a JOIN c b ON a.query = b.query GROUP BY 1, 2, 3),
l AS (SELECT query, list({{'r': rank, 's': sim, 'near': near}} ORDER BY rank) AS rows FROM m GROUP BY 1),
p AS (SELECT query, rows, CAST([] AS BIGINT[]) AS picked FROM l UNION ALL
SELECT query, rows, list_append(picked, list_sort(list_transform(list_filter(rows, lambda x: NOT list_contains(picked, x.r)), lambda x: {{'o': -round(0.5 * x.s - 0.5 * coalesce(list_max(list_transform(picked, lambda k: x.near[k])), 0), 9), 'r': x.r}}))[1].r) FROM p WHERE len(picked) < 5)
SELECT p.query, c.vec_id, CAST(list_position(picked, c.rank) AS INTEGER) AS pos FROM p JOIN c ON c.query = p.query AND list_contains(picked, c.rank) WHERE len(picked) = 5""")
def mmr_select(spark, d):
    return retrieval.diversify(_knn(spark, d).join(_t(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id"), 5)


# --- metrics and graphs ---


@query(f"""WITH {_KNN}, r AS (SELECT query, min(CASE WHEN vec_id = query + 1 THEN rank - 1 END) AS rank FROM sem GROUP BY 1)
SELECT avg(CASE WHEN rank < 1 THEN 1.0 ELSE 0 END) AS recall_1, avg(CASE WHEN rank < 10 THEN 1.0 ELSE 0 END) AS recall_10, round(avg(CASE WHEN rank < 50 THEN 1 / (rank + 1) ELSE 0 END), 6) AS mrr, round(avg(CASE WHEN rank < 50 THEN 1 / log2(rank + 2) ELSE 0 END), 6) AS ndcg FROM r""")
def recall_mrr_ndcg(spark, d):
    r = _knn(spark, d).groupBy("query").agg(F.min(F.when(F.col("vec_id") == F.col("query") + 1, F.col("rank") - 1)).alias("rank"))
    q = metrics.retrieval_quality(r)
    return q.select("recall_1", "recall_10", F.round("mrr", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"))


_SIDES = f"""u AS (SELECT conv_id, list_distinct(flatten(list({TOKENS}))) AS t FROM conversations WHERE role = 'user' GROUP BY 1), a AS (SELECT conv_id, list_distinct(flatten(list({TOKENS}))) AS t FROM conversations WHERE role = 'assistant' GROUP BY 1)"""


@query(f"""WITH {_SIDES}, n AS (SELECT conv_id, len(list_intersect(u.t, a.t)) AS tp, len(a.t) AS got, len(u.t) AS want FROM u JOIN a USING (conv_id))
SELECT conv_id, round(CASE WHEN got > 0 THEN tp / got ELSE 0 END, 6) AS p, round(CASE WHEN want > 0 THEN tp / want ELSE 0 END, 6) AS r, round(CASE WHEN tp > 0 THEN 2 * (tp / got) * (tp / want) / (tp / got + tp / want) ELSE 0 END, 6) AS f1 FROM n""")
def token_f1(spark, d):
    side = lambda role, name: _t(spark, d, "conversations").filter(F.col("role") == role).groupBy("conv_id").agg(F.array_distinct(F.flatten(F.collect_list(T.tokens(F.col("text"))))).alias(name))
    q = metrics.set_quality(side("user", "want").join(side("assistant", "got"), "conv_id"), "got", "want")
    return q.select("conv_id", *[F.round(c, 6).alias(c) for c in ("p", "r", "f1")])


def _step_pairs(spark, d):
    side = lambda role, name: _t(spark, d, "conversations").filter(F.col("role") == role).select(F.col("conv_id").alias("key"), F.col("turn").alias(name), T.token_set(F.col("text")).alias(f"t{name}"))
    return side("assistant", "i").join(side("user", "j"), "key").select("key", "i", "j", F.round(T.jaccard(F.col("ti"), F.col("tj")), 6).alias("sim"))


#: Pairs in order of similarity, then each taken if both ends are free, one after the other.
_PAIRS = f"""st AS (SELECT conv_id AS key, turn, role, list_distinct({TOKENS}) AS t FROM conversations),
sp AS (SELECT a.key, a.turn AS i, b.turn AS j, round(len(list_intersect(a.t, b.t)) / greatest(1, len(list_distinct(list_concat(a.t, b.t)))), 6) AS sim FROM st a JOIN st b ON a.key = b.key AND a.role = 'assistant' AND b.role = 'user'),
op AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sim DESC, i, j) AS n FROM sp WHERE sim >= 0.02),
g AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS ui, CAST([] AS BIGINT[]) AS uj FROM op UNION ALL
SELECT g.key, op.n, CASE WHEN list_contains(ui, i) OR list_contains(uj, j) THEN ui ELSE list_append(ui, i) END, CASE WHEN list_contains(ui, i) OR list_contains(uj, j) THEN uj ELSE list_append(uj, j) END FROM g JOIN op ON op.key = g.key AND op.n = g.n + 1),
gm AS (SELECT op.key, i, j, sim FROM g JOIN op ON op.key = g.key AND op.n = g.n + 1 WHERE NOT list_contains(ui, i) AND NOT list_contains(uj, j))"""


@query(f"WITH RECURSIVE {_PAIRS} SELECT key, i, j, sim FROM gm")
def greedy_step_match(spark, d):
    return metrics.greedy_match(_step_pairs(spark, d), 0.02)


@query(f"""WITH RECURSIVE {_PAIRS}, b AS (SELECT x.key, avg(CASE WHEN x.i < y.i THEN 1.0 ELSE 0.0 END) AS o FROM gm x JOIN gm y ON x.key = y.key AND x.j < y.j GROUP BY 1)
SELECT key, round(coalesce(o, 1.0), 6) AS "order" FROM (SELECT DISTINCT key FROM gm) LEFT JOIN b USING (key)""")
def order_score(spark, d):
    return metrics.order_agreement(metrics.greedy_match(_step_pairs(spark, d), 0.02)).select("key", F.round("order", 6).alias("order"))


@query("""SELECT DISTINCT a.conv_id AS key, a.turn AS u, b.turn AS v FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn
AND list_position(['system', 'user', 'assistant'], a.role) < list_position(['system', 'user', 'assistant'], b.role)""")
def dep_edges(spark, d):
    return graph.category_edges(_nodes(spark, d))


def _nodes(spark, d):
    cat = F.array_position(F.array(*map(F.lit, ("system", "user", "assistant"))), F.col("role"))
    return _t(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("idx"), cat.alias("cat"))


def kahn(nodes: str, edges: str) -> str:
    """SQL of the order in which nodes (key, idx) come out of a first-in, first-out queue over edges (key, u, v): kp (key, idx, pos)."""
    return f"""kn AS (SELECT key, list({{'v': idx, 'ps': coalesce(ps, CAST([] AS BIGINT[]))}} ORDER BY idx) AS nodes FROM (SELECT DISTINCT key, CAST(idx AS BIGINT) AS idx FROM {nodes}) LEFT JOIN (SELECT key, CAST(v AS BIGINT) AS idx, list(DISTINCT CAST(u AS BIGINT)) AS ps FROM {edges} GROUP BY 1, 2) USING (key, idx) GROUP BY key),
ks AS (SELECT key, nodes, list_transform(list_filter(nodes, lambda x: len(x.ps) = 0), lambda x: x.v) AS queue, CAST([] AS BIGINT[]) AS done FROM kn UNION ALL
SELECT key, nodes, list_concat(queue[2:], list_transform(list_filter(nodes, lambda x: list_contains(x.ps, queue[1]) AND len(list_filter(x.ps, lambda y: NOT list_contains(list_append(done, queue[1]), y))) = 0), lambda x: x.v)), list_append(done, queue[1]) FROM ks WHERE len(queue) > 0),
ko AS (SELECT key, list_concat(done, list_filter(list_transform(nodes, lambda x: x.v), lambda v: NOT list_contains(done, v))) AS o FROM ks WHERE len(queue) = 0),
kp AS (SELECT key, unnest(o) AS idx, CAST(unnest(range(len(o))) AS BIGINT) AS pos FROM ko)"""


_EDGES = """nd AS (SELECT conv_id AS key, turn AS idx, list_position(['system', 'user', 'assistant'], role) AS cat FROM conversations),
eg AS (SELECT DISTINCT a.key, a.idx AS u, b.idx AS v FROM nd a JOIN nd b ON a.key = b.key AND a.idx < b.idx AND a.cat < b.cat)"""


@query(f"WITH RECURSIVE {_EDGES}, {kahn('nd', 'eg')} SELECT key, idx, pos FROM kp")
def topo_order(spark, d):
    n = _nodes(spark, d)
    return graph.topological_order(n, graph.category_edges(n))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_event_counts(spark, d):
    return corpus.windowed_counts(_t(spark, d, "events"), "ts", "event_type")


# --- documents and pages ---


def _entries(spark, d):
    """Steps of conversations as entries of a hierarchy: role and turn make the dotted path."""
    section = F.array_position(F.array(*map(F.lit, ("system", "user", "assistant"))), F.col("role"))
    path = F.concat_ws(".", section.cast("string"), F.col("turn").cast("string"))
    return _t(spark, d, "conversations").select("conv_id", "turn", path.alias("path"), T.blank(F.col("text")).alias("text"))


_SECTION = "list_position(['system', 'user', 'assistant'], role)"


@query(f"SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY {_SECTION}, turn, coalesce(text, '')) AS text FROM conversations GROUP BY conv_id")
def hier_flatten(spark, d):
    return documents.flatten_hierarchy(_entries(spark, d), "conv_id", "path", "text")


@query(f"""WITH c AS (SELECT conv_id, CAST({_SECTION} AS VARCHAR) AS section, string_agg(coalesce(text, ''), chr(10) ORDER BY turn, coalesce(text, '')) AS text FROM conversations GROUP BY 1, 2),
ok AS (SELECT * FROM c WHERE length(text) >= 200)
SELECT * FROM ok UNION ALL SELECT conv_id, 'full', string_agg(coalesce(text, ''), chr(10) ORDER BY {_SECTION}, turn, coalesce(text, '')) FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM ok) GROUP BY conv_id""")
def section_chunks(spark, d):
    return documents.section_chunks(_entries(spark, d), "conv_id", "path", "text", 200)


@query("""WITH n AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 3) AS BIGINT) AS chunk FROM conversations)
SELECT conv_id, chunk, string_agg(text, chr(10) ORDER BY turn) AS text FROM n GROUP BY 1, 2""")
def packed_chunks(spark, d):
    return documents.pack(_t(spark, d, "conversations"), "conv_id", "turn", "text", 3)


@query("""WITH c AS (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto, sum(length(text)) OVER (PARTITION BY conv_id) AS total FROM conversations)
SELECT conv_id, turn FROM c WHERE upto - n < 300 AND total >= 300""")
def heuristic_prefix_sum(spark, d):
    return documents.paragraphs_until(_t(spark, d, "conversations"), "conv_id", "turn", "text", 300).select("conv_id", "turn")


@query("""WITH h AS (SELECT page_id, regexp_split_to_array(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?i)<(?:p|h[1-6]|div|li|br)\\b[^>]*>') AS p FROM pages),
t AS (SELECT page_id, list_filter(list_transform(p, lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))), lambda x: x <> '') AS p FROM h)
SELECT page_id, CAST(i AS INTEGER) AS pos, p[i + 1] AS text FROM t, LATERAL (SELECT unnest(range(len(p))) AS i)""")
def page_sections(spark, d):
    return documents.page_sections(_t(spark, d, "pages"), "page_id", "html")


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN '10.2000/b' || page_id WHEN 1 THEN '10.3000/c' ELSE '' END AS link FROM pages")
def original_link_pick(spark, d):
    k, far = F.col("page_id"), "x" * 50
    own, other = F.concat(F.lit("10.1000/own"), k), F.concat(F.lit("10.2000/b"), k)
    near = F.concat(F.lit(f"10.3000/c {far} see "), own, F.lit(" original "), other, F.lit(f" {far}"))
    first = F.concat(F.lit("10.3000/c then "), own, F.lit(" no mark"))
    html = F.when(k % 4 == 0, near).when(k % 4 == 1, first).when(k % 4 == 2, F.concat(F.lit("original "), own, F.lit(" "))).otherwise("nothing")
    return _t(spark, d, "pages").select("page_id", documents.first_link(html, own, "original", 40).alias("link"))


@query("SELECT page_id, upper(regexp_extract(coalesce(url, ''), '(?i)(p[0-9]+)', 1)) AS linked FROM pages")
def id_from_url(spark, d):
    return _t(spark, d, "pages").select("page_id", documents.linked_id(F.col("url"), "p").alias("linked"))


@query("""WITH t AS (SELECT p_partkey, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^\\pL\\pN_]+'), lambda t: t <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(p_type), '[^\\pL\\pN_]+'), lambda t: t <> '')) AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b)))), 6) AS sim FROM t""")
def title_jaccard(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.round(T.jaccard(T.token_set(F.col("p_name")), T.token_set(F.col("p_type"))), 6).alias("sim"))


_OF_WORDS = lambda side: f"list_intersect(list_distinct({TOKENS.replace('text', side)}), ['the', 'and', 'of', 'to', 'in'])"
_JACCARD = lambda a, b: f"len(list_intersect({a}, {b})) / greatest(1, len(list_distinct(list_concat({a}, {b}))))"
_PAIR_SIDES = ", ".join(f"{n} AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS {n} FROM conversations WHERE role = '{role}' GROUP BY 1)" for n, role in (("a", "user"), ("b", "assistant")))


@query(f"""WITH {_PAIR_SIDES}, p AS (SELECT conv_id, a, b, list_distinct({TOKENS.replace('text', 'a')}) AS ta, list_distinct({TOKENS.replace('text', 'b')}) AS tb, {_OF_WORDS('a')} AS wa, {_OF_WORDS('b')} AS wb, list_distinct(regexp_extract_all(coalesce(b, ''), '(?i){lexicon.PARAM}', 0)) AS w FROM a JOIN b USING (conv_id)),
s AS (SELECT conv_id, {_JACCARD('ta', 'tb')} AS title_sim, {_JACCARD('wa', 'wb')} AS o, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: contains(lower(coalesce(a, '')), lower(x)))) / len(w) ELSE 0.0 END AS c FROM p)
SELECT conv_id, title_sim, o AS action_overlap, o AS material_overlap, c AS param_coverage, CASE WHEN o < 0.15 AND c < 0.15 THEN 1 ELSE 0 END AS suspect FROM s""")
def pair_consistency(spark, d):
    c = _t(spark, d, "conversations")
    side = lambda role, name: c.filter(F.col("role") == role).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias(name))
    p = side("user", "a").join(side("assistant", "b"), "conv_id")
    words = ["the", "and", "of", "to", "in"]
    return documents.consistency(p, "a", "b", "a", "b", actions=words, materials=words).drop("a", "b")


@query("SELECT round(avg(CASE WHEN s >= 0.4 THEN 1.0 ELSE 0 END), 6) AS sim_hit, round(avg(s), 6) AS avg_max_sim FROM (SELECT query, greatest(max(sim), 0) AS s FROM (SELECT a.vec_id AS query, round(list_inner_product(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))), 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id IN (SELECT item_id FROM benchmark)) GROUP BY 1)")
def simhit(spark, d):
    best = _knn(spark, d, 2).filter("vec_id <> query").groupBy("query").agg(F.max("sim").alias("sim"))
    m = metrics.similarity_hits(best, "sim", 0.4)
    return m.select(F.round("sim_hit", 6).alias("sim_hit"), F.round("avg_max_sim", 6).alias("avg_max_sim"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def json_fields(spark, d):
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
