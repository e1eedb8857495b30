"""Queries over articles, protocol steps, parameters and pairs. Protocols and XML are made from the columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon
from ..functions import text as T
from ..operators import articles, documents, linkage, metrics, protocols, reports, retrieval, selection
from ..session import cut, spread
from .queries import TOKENS, _knn, _list, _t, kahn, query

# --- protocol steps: a part is a step, ten parts a protocol ---


def _sentences(spark, d):
    verb = F.get(F.array(*map(F.lit, lexicon.VERBS)), (F.col("p_partkey") % len(lexicon.VERBS)).cast("int"))
    first = F.when(F.col("p_partkey") % 7 == 0, "Carefully").otherwise(verb)
    more = F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.concat(F.lit(" "), F.col("p_size"), F.lit(" g for "), F.col("p_partkey") % 50, F.lit(" min at 37 °C, "), F.col("p_size") * 100, F.lit(" rpm")))
    return _t(spark, d, "part").select(F.floor(F.col("p_partkey") / 10).alias("protocol"), F.col("p_partkey").alias("pos"), F.concat(first, F.lit(" "), F.col("p_name"), more).alias("text"))


_SENTENCES = f"""sn AS (SELECT p_partkey // 10 AS protocol, p_partkey AS pos, (CASE WHEN p_partkey % 7 = 0 THEN 'Carefully' ELSE {_list(lexicon.VERBS)}[CAST(p_partkey % {len(lexicon.VERBS)} AS INTEGER) + 1] END) || ' ' || p_name ||
CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ' ' || p_size || ' g for ' || (p_partkey % 50) || ' min at 37 °C, ' || (p_size * 100) || ' rpm' END AS text FROM part)"""
_RECORDS = f"""rc AS (SELECT protocol, pos, pos - min(pos) OVER (PARTITION BY protocol) AS idx, regexp_matches(text, '^({'|'.join(lexicon.VERBS)}) ') AS known, regexp_extract(text, '^(\\S+)', 1) AS w, text,
nullif(regexp_extract(text, '(?i){lexicon.VALUE_UNIT}', 1), '') AS v, nullif(regexp_extract(text, '(?i){lexicon.VALUE_UNIT}', 2), '') AS unit, nullif(regexp_extract(text, '(?i){lexicon.TIME}', 0), '') AS tm,
nullif(replace(regexp_extract(text, '(?i){lexicon.TEMPERATURE}', 0), ' ', ''), '') AS temp, nullif(regexp_extract(text, '(?i){lexicon.RPM}', 1), '') AS rpm FROM sn),
ir AS (SELECT protocol, pos, idx, CASE WHEN known THEN w ELSE 'step' END AS action, CASE WHEN known THEN substr(text, length(w) + 2) ELSE text END AS material, CAST(v AS DOUBLE) AS value, unit, tm, temp, rpm FROM rc)"""


@query(f"WITH {_SENTENCES}, {_RECORDS} SELECT pos, action, material, value, unit, tm AS time, temp, rpm FROM ir")
def step_records(spark, d):
    ir = _sentences(spark, d).select("pos", protocols.from_text(F.col("text")).alias("ir"))
    return ir.select("pos", "ir.action", "ir.material", "ir.value", "ir.unit", "ir.condition.time", "ir.condition.temp", "ir.condition.rpm")


_TIMED = _list(lexicon.TIMED)


@query(f"""WITH {_SENTENCES}, {_RECORDS}, x AS (SELECT *, upper(action[1]) || substr(action, 2) AS cap FROM ir)
SELECT pos, concat_ws(' ', cap, material, '(' || CAST(value AS VARCHAR) || coalesce(' ' || unit, '') || ')', nullif(concat_ws(', ', rpm || ' rpm', tm, temp), '')) AS label,
regexp_replace(concat_ws(' ', CASE action WHEN 'prewarm' THEN 'Pre-warm' WHEN 'step' THEN 'Do' ELSE cap END, material, CAST(value AS VARCHAR) || ' ' || unit,
CASE WHEN concat_ws(', ', rpm || ' rpm', temp, tm) = '' THEN NULL WHEN list_contains({_TIMED}, action) THEN CASE WHEN tm IS NOT NULL THEN 'for ' ELSE '' END || concat_ws(', ', rpm || ' rpm', temp, tm)
ELSE '(' || concat_ws(', ', rpm || ' rpm', temp, tm) || ')' END), '\\.+$', '') || '.' AS sentence FROM x""")
def step_labels(spark, d):
    ir = _sentences(spark, d).select("pos", protocols.from_text(F.col("text")).alias("ir"))
    return ir.select("pos", protocols.label(F.col("ir")).alias("label"), protocols.sentence(F.col("ir")).alias("sentence"))


def _items(spark, d):
    """Steps in all the forms that a generator may give: records, triples, texts, and what is none of these."""
    name, k = F.col("p_name"), F.col("p_partkey")
    forms = [F.concat(F.lit('{"action": "Add", "material": "'), name, F.lit('"}')), F.concat(F.lit('{"predicate": "Wash", "object": "'), name, F.lit('"}')), F.concat(F.lit('{"verb": "Dry", "target": "'), name, F.lit('"}')), F.concat(F.lit('["a", "Mix", "'), name, F.lit('"]')), F.concat(F.lit("add "), name), F.lit(" "), F.lit('["a", "b"]')]
    return _t(spark, d, "part").select(F.floor(k / 10).alias("protocol"), k.alias("pos"), F.get(F.array(*forms), (k % 7).cast("int")).alias("item"))


@query("""SELECT p_partkey AS pos, ['Add', 'wash', 'dry', 'mix', 'add'][CAST(p_partkey % 7 AS INTEGER) + 1] AS action, CASE WHEN p_partkey % 7 < 5 THEN p_name END AS material, p_partkey % 7 BETWEEN 1 AND 4 AS coerced FROM part""")
def coerced_steps(spark, d):
    step, coerced = protocols.from_json(F.col("item"))
    return _items(spark, d).select("pos", step.alias("ir"), coerced.alias("coerced")).select("pos", "ir.action", "ir.material", "coerced")


@query("SELECT p_partkey // 10 AS protocol, CAST(count(*) FILTER (p_partkey % 7 BETWEEN 1 AND 4) AS BIGINT) AS coerced, CAST(count(*) FILTER (p_partkey % 7 >= 5) AS BIGINT) AS skipped FROM part GROUP BY 1")
def coercion_counts(spark, d):
    return protocols.collected(_items(spark, d), "protocol", "pos", "item")[1]


def _steps(spark, d):
    """Steps, made once, in as many tasks as there are partitions, and stored with their protocol's steps near them."""
    s = spread(_sentences(spark, d), "protocol")
    idx = F.col("pos") - F.min("pos").over(Window.partitionBy("protocol"))
    more = lambda x: x.withField("material", F.regexp_extract("text", r"^\S+ (\S+ \S+)", 1)).withField("depends_on", F.array((F.col("pos") % 10 - 3).cast("int")))
    return cut(s.select("protocol", idx.alias("idx"), F.transform(F.array(protocols.from_text(F.col("text"))), more)[0].alias("ir")))


_PREP, _ANA = _list(lexicon.PREPARING), _list(lexicon.ANALYSING)
_STEPS = f"""{_SENTENCES}, {_RECORDS}, stp AS (SELECT protocol, idx, action, regexp_extract(m, '^(\\S+ \\S+)', 1) AS mat, pos % 10 - 3 AS dep, value, unit, tm, temp, rpm, CASE WHEN list_contains({_PREP}, action) THEN 0 WHEN list_contains({_ANA}, action) THEN 2 ELSE 1 END AS cat FROM (SELECT *, CASE WHEN action = 'step' THEN substr(material, 11) ELSE material END AS m FROM ir)),
edg AS (SELECT protocol, dep AS u, idx AS v FROM stp JOIN (SELECT protocol, max(idx) AS last FROM stp GROUP BY 1) USING (protocol) WHERE dep BETWEEN 0 AND last AND dep <> idx
UNION SELECT a.protocol, a.idx, b.idx FROM stp a JOIN stp b ON a.protocol = b.protocol AND a.mat = b.mat AND a.idx <> b.idx WHERE a.mat <> '' AND (a.cat = 0)
UNION SELECT a.protocol, a.idx, b.idx FROM stp a JOIN stp b ON a.protocol = b.protocol AND a.idx < b.idx AND a.cat < b.cat)"""


@query(f"WITH {_STEPS} SELECT protocol, u, v FROM edg")
def step_dependencies(spark, d):
    return protocols.dependencies(_steps(spark, d), "protocol")


@query(f"""WITH {_STEPS}, a AS (SELECT protocol, count(*) AS n, count(*) FILTER (value IS NOT NULL OR tm IS NOT NULL OR temp IS NOT NULL OR rpm IS NOT NULL) AS ok FROM stp GROUP BY 1), e AS (SELECT protocol, count(*) AS n FROM edg GROUP BY 1)
SELECT protocol, a.n AS num_ir, coalesce(e.n, 0) AS num_edges, a.n - ok AS unresolved, round(ok / a.n, 4) AS pct_with_values FROM a LEFT JOIN e USING (protocol)""")
def plan_statistics(spark, d):
    s = _steps(spark, d)
    return protocols.statistics(s, s, protocols.dependencies(s, "protocol"), "protocol")


_ORDER = f"""{_STEPS}, kx AS (SELECT protocol AS key, idx FROM stp), ke AS (SELECT protocol AS key, u, v FROM edg), {kahn('kx', 'ke')}"""


@query(f"""WITH RECURSIVE {_ORDER}, x AS (SELECT protocol, s.idx, pos, cat, upper(action[1]) || substr(action, 2) AS cap, action, mat, value, unit, tm, temp, rpm FROM stp s JOIN kp ON kp.key = s.protocol AND kp.idx = s.idx),
r AS (SELECT protocol, cat, CAST(NULL AS VARCHAR) AS title, idx, pos, regexp_replace(concat_ws(' ', CASE action WHEN 'prewarm' THEN 'Pre-warm' WHEN 'step' THEN 'Do' ELSE cap END, mat, CAST(value AS VARCHAR) || ' ' || unit,
CASE WHEN concat_ws(', ', rpm || ' rpm', temp, tm) = '' THEN NULL WHEN list_contains({_TIMED}, action) THEN CASE WHEN tm IS NOT NULL THEN 'for ' ELSE '' END || concat_ws(', ', rpm || ' rpm', temp, tm) ELSE '(' || concat_ws(', ', rpm || ' rpm', temp, tm) || ')' END), '\\.+$', '') || '.' AS text FROM x),
ev AS (SELECT DISTINCT p_partkey // 10 * 2 AS protocol FROM part), h AS (SELECT DISTINCT protocol, cat FROM r UNION SELECT protocol, 1 FROM r UNION SELECT protocol, unnest([0, 1, 2]) FROM ev WHERE protocol NOT IN (SELECT protocol FROM r)),
a AS (SELECT protocol, cat, title, idx, pos, text FROM r UNION ALL SELECT protocol, cat, {_list(lexicon.PLAN_TITLES)}[cat + 1], CAST(NULL AS BIGINT), -1, CAST(NULL AS VARCHAR) FROM h),
n AS (SELECT *, count(title) OVER (PARTITION BY protocol ORDER BY cat, pos) AS section FROM a)
SELECT protocol, concat_ws('.', section, CASE WHEN title IS NULL THEN CAST(row_number() OVER (PARTITION BY protocol, section ORDER BY pos) - 1 AS VARCHAR) END) AS sid, title, text, coalesce(idx, -1) AS idx FROM n""")
def plan_rows(spark, d):
    s = _steps(spark, d)
    every = _t(spark, d, "part").select((F.floor(F.col("p_partkey") / 10) * 2).alias("protocol"))
    rows = protocols.plan(s, protocols.ordered(s, protocols.dependencies(s, "protocol"), "protocol"), every, "protocol")
    return rows.withColumn("idx", F.coalesce("idx", F.lit(-1)))


@query(f"WITH RECURSIVE {_ORDER} SELECT protocol, 'n' || (a.pos + 1) AS u, 'n' || (b.pos + 1) AS v FROM edg JOIN kp a ON a.key = protocol AND a.idx = u JOIN kp b ON b.key = protocol AND b.idx = v")
def relabelled_edges(spark, d):
    s = _steps(spark, d)
    e = cut(protocols.dependencies(s, "protocol"))
    return protocols.relabelled(protocols.ordered(s, e, "protocol"), e, "protocol")


@query("""WITH p AS (SELECT p_partkey // 10 AS protocol, p_partkey AS k, p_name AS n, p_size AS z FROM part),
l AS (SELECT protocol, 1 AS s, 0 AS i, 'Preparation & Materials' AS line FROM (SELECT DISTINCT protocol FROM p) UNION ALL SELECT protocol, 2, 0, 'Procedure' FROM (SELECT DISTINCT protocol FROM p)
UNION ALL SELECT protocol, 1, row_number() OVER (PARTITION BY protocol ORDER BY k), 'Prepare ' || n || ' (' || z || 'mM)' || CASE WHEN k % 2 = 0 THEN ', Supplier: S' || k ELSE '' END FROM p
UNION ALL SELECT protocol, 2, row_number() OVER (PARTITION BY protocol ORDER BY k), 'mix ' || n || ' (time=' || z || 'min)' FROM p)
SELECT protocol, CASE WHEN i = 0 THEN CAST(s AS VARCHAR) ELSE s || '.' || i END AS path, line FROM l""")
def protocol_hierarchy(spark, d):
    text = lambda c: F.col(c).cast("string")
    quantity = lambda v, u: F.struct(v.alias("value"), F.lit(u).alias("unit"))
    none = F.lit(None).cast("string")
    material = F.struct(F.col("p_partkey").alias("o"), F.col("p_name").alias("name"), quantity(text("p_size"), "mM").alias("concentration"), quantity(none, "").alias("amount"), none.alias("catalog"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("S"), text("p_partkey"))).alias("supplier"))
    step = F.struct(F.col("p_partkey").alias("o"), F.lit("mix").alias("action"), F.col("p_name").alias("reagent"), F.create_map(F.lit("time"), quantity(text("p_size"), "min")).alias("params"))
    rows = _t(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 10).alias("protocol")).agg(F.array_sort(F.collect_list(material)).alias("m"), F.collect_list(step).alias("s"))
    in_order = F.array_sort("s", lambda a, b: (a["o"] - b["o"]).cast("int"))
    lines = protocols.hierarchy(F.col("m"), F.lit(None).cast("array<struct<name:string,recipe:array<struct<name:string,amount:struct<value:string,unit:string>>>>>"), in_order)
    return rows.select("protocol", F.explode(lines).alias("l")).select("protocol", "l.path", "l.line")


@query(f"""SELECT p_partkey FROM part WHERE (list_contains({_list(lexicon.STEP_ACTIONS)}, lower({_list(lexicon.VERBS + lexicon.HEADERS)}[CAST(p_partkey % {len(lexicon.VERBS + lexicon.HEADERS)} AS INTEGER) + 1]))) AND (p_partkey % 3 > 0)""")
def valid_steps(spark, d):
    words, k = lexicon.VERBS + lexicon.HEADERS, F.col("p_partkey")
    action = F.upper(F.get(F.array(*map(F.lit, words)), (k % len(words)).cast("int")))
    step = F.struct(action.alias("action"), F.when(k % 3 == 1, F.array("p_name")).alias("inputs"), F.when(k % 3 == 0, F.array(F.lit(""))).alias("outputs"), F.create_map(F.lit("time"), F.when(k % 3 == 2, F.lit("5 min"))).alias("params"))
    records = protocols.cleaned(_t(spark, d, "part").select("p_partkey", F.array(step).alias("steps")), "steps")
    return records.filter("steps is not null").select("p_partkey")


# --- articles: a conversation is an article, a turn a section ---


def _articles(spark, d):
    safe = lambda c: F.replace(F.replace(T.blank(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    c, k = _t(spark, d, "conversations"), F.col("conv_id")
    turn = F.concat(F.lit('<x:sec sec-type="'), F.col("role"), F.lit('"><x:title>'), F.col("role"), F.lit(" "), F.col("turn"), F.lit("</x:title>\n<x:p>"), safe(F.col("text")), F.lit("</x:p>\n<x:fig><x:caption>not this</x:caption></x:fig></x:sec>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("x")))), lambda t: t["x"]), "")
    made = c.groupBy("conv_id").agg(body.alias("body"))
    note = F.when(k % 10 == 2, f"<!-- The {lexicon.BLOCKED}. -->").otherwise("")
    inner = F.when(k % 10 == 1, F.lit("<x:back/>")).otherwise(F.concat(F.lit("<x:body>"), F.col("body"), F.lit("</x:body>")))
    end = F.when(k % 10 == 0, "</broken>").otherwise("</x:article>")
    meta = F.concat(F.lit('<x:front><x:journal-title>Journal</x:journal-title><x:article-id pub-id-type="doi">10.1/'), k, F.lit("</x:article-id><x:article-title>Title "), k, F.lit("</x:article-title><x:pub-date><x:year>"), 2000 + k % 20, F.lit("</x:year></x:pub-date></x:front>"))
    return made.select("conv_id", F.concat(F.lit('<x:article xmlns:x="urn:x">'), note, meta, inner, end).alias("xml"))


_TARGETS, _TYPES = ["user 2", "user 4"], ["assistant"]


def _parsed_articles(spark, d):
    return articles.parsed(_articles(spark, d), "conv_id", "xml")


def _article_sections(spark, d):
    return articles.sections(_parsed_articles(spark, d), "conv_id", _TARGETS, _TYPES, least=500, merge=300, heuristic=150)


_WORDS = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_FOUND = f"""body AS (SELECT *, {_WORDS} AS t FROM conversations WHERE conv_id % 10 > 1),
want AS (SELECT conv_id, role || ' ' || turn AS section, t, turn FROM body WHERE role = 'assistant' OR (role = 'user' AND turn IN (2, 4))),
ok AS (SELECT conv_id, section, CASE WHEN length(section || ' ' || t) >= 500 THEN section || ' ' || t ELSE t END AS text, CASE WHEN length(section || ' ' || t) >= 500 THEN 'regular' ELSE 'merged' END AS source FROM want WHERE length(section || ' ' || t) >= 500 OR length(t) >= 300),
act AS (SELECT conv_id, turn, t, sum(length(t)) OVER (PARTITION BY conv_id ORDER BY turn) AS upto, sum(length(t)) OVER (PARTITION BY conv_id) AS total FROM body WHERE t <> '' AND conv_id NOT IN (SELECT conv_id FROM ok) AND (regexp_matches(lower(t), '{'|'.join(lexicon.ACTIONS)}') OR regexp_matches(t, '(?i){lexicon.PARAM}'))),
fnd AS (SELECT * FROM ok UNION ALL SELECT conv_id, 'Heuristic Methods', string_agg(t, chr(10) || chr(10) ORDER BY turn), 'heuristic' FROM act WHERE total >= 150 AND upto - length(t) < 150 GROUP BY conv_id)"""


@query(f"WITH {_FOUND} SELECT conv_id, section, text, source FROM fnd")
def article_sections(spark, d):
    return _article_sections(spark, d)


@query(f"""WITH {_FOUND}, ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT conv_id, CASE WHEN conv_id % 10 = 0 THEN 'parse_error' WHEN conv_id IN (SELECT conv_id FROM fnd) THEN 'ok' WHEN conv_id % 10 = 2 THEN 'publisher_blocked_xml' WHEN conv_id % 10 = 1 THEN 'no_body' ELSE 'no_sections_matched' END AS result FROM ids""")
def article_outcomes(spark, d):
    return articles.outcomes(_parsed_articles(spark, d), _article_sections(spark, d), "conv_id")


@query("""SELECT DISTINCT conv_id, conv_id % 10 = 2 AS blocked, CASE WHEN conv_id % 10 > 0 THEN 'Title ' || conv_id END AS title, CASE WHEN conv_id % 10 > 0 THEN 'Journal' END AS journal, CASE WHEN conv_id % 10 > 0 THEN CAST(2000 + conv_id % 20 AS VARCHAR) END AS year, CASE WHEN conv_id % 10 > 0 THEN '10.1/' || conv_id END AS doi FROM conversations""")
def article_metadata(spark, d):
    return _parsed_articles(spark, d).select("conv_id", "blocked", "title", "journal", "year", "doi")


@query(f"WITH {_FOUND} SELECT conv_id, section, source, length(text) AS chars, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS tokens FROM fnd")
def section_statistics(spark, d):
    return articles.statistics(_article_sections(spark, d), "conv_id")


# --- sections of pairs ---

_MAPS = """m AS (SELECT conv_id, role || ' ' || turn AS k, coalesce(text, '') AS v, CASE WHEN turn % 2 = 0 THEN 'regular' ELSE 'merged' END AS source FROM conversations)"""


def _section_maps(spark, d):
    title, source = F.concat_ws(" ", "role", "turn"), F.when(F.col("turn") % 2 == 0, "regular").otherwise("merged")
    entries = F.map_from_entries(F.collect_list(F.struct(title, T.blank(F.col("text")))))
    return _t(spark, d, "conversations").groupBy("conv_id").agg(entries.alias("sections"), F.map_from_entries(F.collect_list(F.struct(title, source))).alias("sources"))


@query(f"""WITH {_MAPS}, f AS (SELECT * FROM m WHERE regexp_matches(k, '(?i)USER|assistant [13]') AND NOT regexp_matches(k, '(?i)user 4')), r AS (SELECT conv_id FROM f WHERE source = 'regular' GROUP BY 1),
c AS (SELECT * FROM f WHERE (conv_id NOT IN (SELECT conv_id FROM r) OR source = 'regular') AND length(v) >= 150), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT conv_id, coalesce(string_agg(k, '|' ORDER BY k), '') AS kept, CAST(coalesce(sum(length(v)), 0) AS BIGINT) AS chars FROM ids LEFT JOIN c USING (conv_id) GROUP BY 1""")
def section_choice(spark, d):
    chosen = selection.prefer_source(selection.titled(F.col("sections"), "USER|assistant [13]", "user 4"), F.col("sources"), "regular")
    kept = _section_maps(spark, d).select("conv_id", selection.above(chosen, 150).alias("s"))
    return kept.select("conv_id", F.array_join(F.array_sort(F.map_keys("s")), "|").alias("kept"), F.aggregate(F.map_values("s"), F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@query("""SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'no_bio' WHEN e.vec_id IS NULL THEN 'no_article_sections' END AS reason, coalesce(quality, -1) AS quality, coalesce(label, -1) AS label FROM documents LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = doc_id""")
def pair_reasons(spark, d):
    right = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return linkage.paired(_t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels"), right, "doc_id").select("doc_id", "reason", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("label", F.lit(-1)).alias("label"))


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1")
def longest_per_source(spark, d):
    return linkage.richest(_t(spark, d, "documents"), "source", F.col("n_chars"), F.col("doc_id")).select("source", "doc_id", "n_chars")


@query("""SELECT a.vec_id, round(list_inner_product(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))), 6) AS sim, CASE WHEN a.vec_id % 9 = 0 THEN 'missing_title' ELSE 'low_similarity' END AS reason
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 9 = 0 OR round(list_inner_product(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))), 6) < 0.25""")
def doubtful_pairs(spark, d):
    e = _t(spark, d, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    pairs = e.join(other, "vec_id").select("vec_id", F.round(T.dot(F.col("embedding"), F.col("other")), 6).alias("sim"), F.when(F.col("vec_id") % 9 == 0, "").otherwise("t").alias("a"), F.lit("t").alias("b"))
    return metrics.doubtful(pairs, "a", "b", "sim").select("vec_id", "sim", "reason")


# --- parameters and keywords ---


def _quantities(spark, d):
    """Texts of two quantities for each line item: got and wanted."""
    k = F.col("l_quantity").cast("int")
    got = F.concat(F.lit("add "), k, F.lit(" ml and "), F.col("l_linenumber"), F.lit(" x 10^2 mg, then "), k, F.lit(" hours"))
    want = F.concat(F.col("l_linenumber") * 100, F.lit(" mg with "), k + F.col("l_linenumber"), F.lit(" ml"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", k.alias("k"), got.alias("got"), want.alias("want"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS INTEGER) || ' ml;' || (l_linenumber * 100) || ' mg;' || CAST(l_quantity AS INTEGER) || ' h' AS params FROM lineitem""")
def scaled_params(spark, d):
    p = T.scaled_params(F.col("got"))
    shown = F.array_join(F.transform(p, lambda x: F.concat_ws(" ", x["value"].cast("int"), F.replace(x["unit"], F.lit("hour"), F.lit("h")))), ";")
    return _quantities(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", shown.alias("params"))


@query("""WITH q AS (SELECT *, CAST(l_quantity AS INTEGER) AS k FROM lineitem), h AS (SELECT *, 1 + CASE WHEN l_linenumber <= 0.1 * greatest(1, k + l_linenumber) THEN 1 ELSE 0 END AS tp FROM q)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(tp / 3, 6) AS p, round(tp / 2, 6) AS r, round(2 * (tp / 3) * (tp / 2) / (tp / 3 + tp / 2), 6) AS f1 FROM h""")
def param_f1(spark, d):
    rows = _quantities(spark, d).withColumns({"g": T.scaled_params(F.col("got")), "w": T.scaled_params(F.col("want"))})
    return metrics.param_quality(rows, "g", "w").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in ("p", "r", "f1")])


@query("""SELECT a.p_partkey AS got, b.p_partkey AS want FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND abs(a.p_size - b.p_size) <= 0.1 * greatest(1.0, b.p_size)""")
def near_param_pairs(spark, d):
    side = _t(spark, d, "part").select("p_name", F.col("p_brand").alias("unit"), F.col("p_size").cast("double").alias("value"), "p_partkey")
    keyed = side.withColumn("value", F.col("value"))
    a = keyed.select("p_name", "unit", "value", F.col("p_partkey").alias("got"))
    b = keyed.select("p_name", "unit", "value", F.col("p_partkey").alias("want"))
    pairs = metrics.near_pairs(a.select("p_name", "unit", "value").distinct(), b.select("p_name", "unit", "value").distinct(), "p_name").select("p_name", F.col("got.unit").alias("unit"), F.col("got.value").alias("x"), F.col("want.value").alias("y"))
    return pairs.join(a.withColumnRenamed("value", "x"), ["p_name", "unit", "x"]).join(b.withColumnRenamed("value", "y"), ["p_name", "unit", "y"]).select("got", "want")


_GRAMS = f"""w AS (SELECT doc_id, list_filter({TOKENS}, lambda t: length(t) > 1 AND NOT list_contains({_list(lexicon.STOP_WORDS)}, t)) AS t FROM documents),
g AS (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM w)"""


@query(f"""WITH {_GRAMS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2), fe AS (SELECT term, count(*) AS df FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 5000), n AS (SELECT count(*) AS n FROM documents),
x AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN fe USING (term), n), s AS (SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS score FROM x)
SELECT doc_id, term, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS r FROM s) WHERE r <= 10""")
def keyword_queries(spark, d):
    return retrieval.keyword_queries(_t(spark, d, "documents"), 10)


_SIDE = lambda role, alias: f"{alias} AS (SELECT conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS text FROM conversations WHERE role = '{role}' GROUP BY 1)"


def _sides(spark, d, role):
    c = _t(spark, d, "conversations").filter(F.col("role") == role)
    in_order = F.array_sort(F.collect_list(F.struct("turn", T.blank(F.col("text")).alias("t"))))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(in_order, lambda x: x["t"]), " ").alias("text"))


@query(f"""WITH {_SIDE('user', 'u')}, {_SIDE('assistant', 'a')}, gw AS (SELECT conv_id, list_filter({TOKENS}, lambda t: length(t) > 1 AND NOT list_contains({_list(lexicon.STOP_WORDS)}, t)) AS t FROM u),
gg AS (SELECT conv_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM gw), gc AS (SELECT conv_id, term, row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, term) AS n FROM gg GROUP BY 1, 2),
kw AS (SELECT conv_id, list(term) AS want FROM gc WHERE n <= 10 GROUP BY 1), j AS (SELECT conv_id, coalesce(want, []) AS want, list_distinct(regexp_extract_all(lower(a.text), '[a-z0-9]+')) AS got FROM a LEFT JOIN kw USING (conv_id)),
h AS (SELECT *, list_sort(list_intersect(got, want)) AS hits FROM j), s AS (SELECT *, CASE WHEN len(got) > 0 THEN len(hits) / len(got) ELSE 0 END AS p, CASE WHEN len(want) > 0 THEN len(hits) / len(want) ELSE 0 END AS r FROM h)
SELECT conv_id, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, array_to_string(hits, ' ') AS hits FROM s""")
def keyword_f1(spark, d):
    wanted = retrieval.keywords(_sides(spark, d, "user"), 10, key="conv_id")
    q = metrics.keyword_quality(_sides(spark, d, "assistant"), wanted, "conv_id", "text")
    return q.select("conv_id", *[F.round(c, 6).alias(c) for c in ("p", "r", "f1")], "hits")


_UNIT_SETS = f"""{_SIDE('user', 'u')}, {_SIDE('assistant', 'a')}, s AS (SELECT conv_id, list_distinct(regexp_extract_all(lower(a.text), '[a-z0-9+\\-./%°µ]+')) AS g, list_distinct(regexp_extract_all(lower(u.text), '[a-z0-9+\\-./%°µ]+')) AS w FROM a JOIN u USING (conv_id)),
q AS (SELECT len(list_intersect(g, w)) / greatest(len(g), 1) AS p, len(list_intersect(g, w)) / greatest(len(w), 1) AS r FROM s)"""


@query(f"WITH {_UNIT_SETS} SELECT count(*) AS n, round(avg(p), 6) AS p, round(avg(r), 6) AS r, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1 FROM q")
def record_f1(spark, d):
    sets = lambda role, name: _sides(spark, d, role).select("conv_id", F.array_distinct(T.unit_tokens(F.col("text"))).alias(name))
    q = metrics.set_quality(sets("assistant", "got").join(sets("user", "want"), "conv_id"), "got", "want")
    return metrics.macro(q, ["p", "r", "f1"]).select("n", *[F.round(c, 6).alias(c) for c in ("p", "r", "f1")])


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS INTEGER) || ' ml|' || CAST(l_quantity AS INTEGER) || ' h' AS strings FROM lineitem""")
def param_strings(spark, d):
    return _quantities(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.array_join(F.filter(T.param_strings(F.col("got")), lambda x: ~F.contains(x, F.lit("mg"))), "|").alias("strings"))


# --- queries and evidence ---


@query(f"""WITH {_GRAMS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2), fe AS (SELECT term, count(*) AS df FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 5000), n AS (SELECT count(*) AS n FROM documents),
x AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN fe USING (term), n), s AS (SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS score FROM x),
t AS (SELECT doc_id, string_agg(term, ' ' ORDER BY r) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS r FROM s) WHERE r <= 10 GROUP BY 1),
c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'title ' || doc_id END AS title, CASE WHEN length(text) >= 1000 THEN terms END AS terms, lang FROM documents LEFT JOIN t USING (doc_id))
SELECT doc_id, 'Q1_title' AS kind, title AS query FROM c WHERE title <> '' UNION ALL SELECT doc_id, 'Q2_tfidf', terms FROM c WHERE terms IS NOT NULL AND trim(terms) <> '' UNION ALL SELECT doc_id, 'Q0_keywords', trim(lang) FROM c WHERE title = '' AND (terms IS NULL OR trim(terms) = '') AND trim(coalesce(lang, '')) <> ''""")
def query_candidates(spark, d):
    docs = _t(spark, d, "documents")
    terms = retrieval.keyword_queries(docs, 10).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t"))
    known = docs.select("doc_id", "lang", (F.length(T.blank(F.col("text"))) >= 1000).alias("long_enough"))  # texts aren't joined
    rows = known.join(terms, "doc_id", "left").withColumn("terms", F.array_join(F.transform("t", lambda x: x["term"]), " "))
    title = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("title "), F.col("doc_id")))
    return rows.select("doc_id", F.explode(retrieval.query_candidates(title, F.col("terms"), F.col("lang"), F.col("long_enough"))).alias("q")).select("doc_id", "q.kind", "q.query")


@query("""SELECT doc_id, 'self:' || (CAST(i AS BIGINT) // 1000 + 1) AS evidence, substr(text, CAST(i AS INTEGER) + 1, 300) AS preview FROM documents, LATERAL (SELECT unnest(range(0, CASE WHEN length(text) <= 1200 THEN 1 ELSE length(text) END, 1000)) AS i) WHERE coalesce(text, '') <> '' AND i < 3000""")
def self_evidence(spark, d):
    return documents.own_evidence(_t(spark, d, "documents"), "doc_id", "text", 1200, 1000, 3, 300)


@query("""WITH h AS (SELECT item_id AS doc_id, 'hit' AS evidence, 'p' AS preview FROM benchmark), o AS (SELECT doc_id, 'self:1' AS evidence, substr(text, 1, 80) AS preview FROM documents WHERE coalesce(text, '') <> '')
SELECT * FROM h UNION ALL SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM h)""")
def evidence_fallback(spark, d):
    hits = _t(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("hit").alias("evidence"), F.lit("p").alias("preview"))
    return documents.with_evidence(hits, documents.own_evidence(_t(spark, d, "documents"), "doc_id", "text", 1200, 1000, 1, 80), "doc_id")


@query("""SELECT doc_id, trim(concat_ws(chr(10) || chr(10), nullif(trim(lang), ''), CASE WHEN doc_id % 2 = 0 THEN nullif(trim(source), '') END)) AS text FROM documents""")
def own_sections(spark, d):
    columns = {"methods_text": F.col("lang"), "abstract_text": F.when(F.col("doc_id") % 2 == 0, F.col("source"))}
    return _t(spark, d, "documents").select("doc_id", documents.own_sections(["methods", "abstract", "intro"], columns).alias("text"))


@query("""SELECT p_partkey, p_name || ' protocol|' || lower(p_type) || ' Protocol|' || p_name || ' protocol' AS queries, p_name || ' protocol|' || lower(p_type) || ' Protocol|extra protocol' AS extended FROM part""")
def generated_queries(spark, d):
    made = F.concat(F.lit(" "), F.col("p_name"), F.lit(".. \n\n"), F.lower("p_type"), F.lit(" Protocol.\n "))
    q, two = T.query_lines(made, 3, pad=True), T.query_lines(made, 2)
    return _t(spark, d, "part").select("p_partkey", F.array_join(q, "|").alias("queries"), F.array_join(retrieval.with_extra_query(two, F.lit("extra protocol")), "|").alias("extended"))


@query("SELECT p_partkey, p_name || ' now|wash ' || p_name AS tasks FROM part")
def task_lines(spark, d):
    made = F.concat(F.lit("- "), F.col("p_name"), F.lit(" now\n* one\n2) wash "), F.col("p_name"), F.lit(" —\n\n1. "), F.col("p_name"), F.lit(" now\na b c d e f g h i j k"))
    return _t(spark, d, "part").select("p_partkey", F.array_join(T.task_lines(made), "|").alias("tasks"))


_FOLDED = "list_distinct(list_filter(regexp_split_to_array(strip_accents(lower(coalesce(text, ''))), '[^\\pL\\pN_]+'), lambda t: t <> ''))"


@query(f"""WITH f AS (SELECT item_id AS query, {_FOLDED} AS want FROM benchmark), w AS (SELECT doc_id, {_FOLDED} AS have FROM documents)
SELECT query, doc_id FROM f JOIN w ON len(want) > 0 AND len(list_intersect(want, have)) = len(want)""")
def folded_match(spark, d):
    return retrieval.match_folded(_t(spark, d, "documents"), _t(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("term")))


# --- small operators ---


@query("SELECT page_id, array_to_string(list_transform(regexp_extract_all(url, '[A-Za-z0-9]+'), lambda x: lower(x)), ' ') AS tokens, CASE WHEN length(regexp_extract(url, '([0-9]+)$', 1)) BETWEEN 1 AND 18 THEN CAST(regexp_extract(url, '([0-9]+)$', 1) AS BIGINT) ELSE -1 END AS number FROM pages")
def url_parts(spark, d):
    return _t(spark, d, "pages").select("page_id", F.array_join(T.title_tokens(F.col("url")), " ").alias("tokens"), T.last_number(F.col("url")).alias("number"))


@query("SELECT p_partkey, '10.1/x' || p_partkey AS tail, 'Item-' || p_partkey AS item FROM part")
def doi_parts(spark, d):
    url = F.concat(F.lit("https://DOI.org/10.1/X"), F.col("p_partkey"))
    return _t(spark, d, "part").select("p_partkey", T.doi_tail(url).alias("tail"), T.numbered_id(url, "/X", "Item-").alias("item"))


@query(f"SELECT doc_id FROM documents WHERE regexp_matches(lower(coalesce(text, '')), '{'|'.join(lexicon.ACTIONS)}') OR regexp_matches(coalesce(text, ''), '(?i){lexicon.PARAM}')")
def procedural_texts(spark, d):
    return _t(spark, d, "documents").filter(T.procedural(F.col("text"))).select("doc_id")


@query("SELECT doc_id, concat_ws('; ', nullif(trim(lang), ''), nullif(trim(source), ''), CAST(n_chars AS VARCHAR)) AS keywords, printf('%.3f', n_chars / 7.0) AS seventh FROM documents")
def keyword_text(spark, d):
    words = F.array(F.concat(F.lit(" "), "lang"), F.lit(""), F.lit(None), "source", F.col("n_chars").cast("string"))
    return _t(spark, d, "documents").select("doc_id", T.keyword_text(words, is_list=True).alias("keywords"), T.fixed(F.col("n_chars") / 7.0).alias("seventh"))


@query("SELECT doc_id, 'texts::' || source || '::' || doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'texts::' || source || '::' || doc_id || '::sec:' || (doc_id % 5) ELSE 'texts::' || source || '::' || doc_id END AS chunk_id FROM documents WHERE source IS NOT NULL")
def record_ids(spark, d):
    part = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 5)
    return _t(spark, d, "documents").filter("source is not null").select("doc_id", documents.record_id("texts", F.col("source"), F.col("doc_id")).alias("id"), documents.record_id("texts", F.col("source"), F.col("doc_id"), "sec", part).alias("chunk_id"))


@query("SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'bad' ELSE CAST(value AS VARCHAR) END AS DOUBLE), 0) AS number, CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END AS a, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS b FROM events")
def tolerant_numbers(spark, d):
    value, user = F.when(F.col("event_id") % 3 == 0, "bad").otherwise(F.col("value").cast("string")), F.col("user_id").cast("string")
    a, b = reports.numbers_or_none(value, user)
    return _t(spark, d, "events").select("event_id", reports.number(value).alias("number"), a.alias("a"), b.cast("long").alias("b"))


@query("SELECT pos, doc_id, lang FROM (SELECT item_id, row_number() OVER (ORDER BY item_id DESC) AS pos FROM benchmark) JOIN documents ON doc_id = item_id")
def ordered_lookup(spark, d):
    ids = linkage.numbered(_t(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")), [F.desc("doc_id")])
    return linkage.in_order(ids, _t(spark, d, "documents").select("doc_id", "lang"), "doc_id", "pos").select("pos", "doc_id", "lang")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE coalesce('q' || quality, NULL) END AS mark FROM documents LEFT JOIN labels USING (doc_id)")
def filled_in(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(" ").alias("mark"))
    known = _t(spark, d, "labels").select("doc_id", F.concat(F.lit("q"), "quality").alias("mark"))
    return linkage.filled_in(docs, known, "doc_id", "mark")


@query("SELECT count(*) AS misses FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def lookup_misses(spark, d):
    return linkage.with_defaults(_t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels"), "doc_id", {"quality": -1})[1]


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O')")
def picked_by_status(spark, d):
    return linkage.with_status(_t(spark, d, "orders"), "o_orderkey", "o_orderstatus", ["F", "O"]).select("o_orderkey")


@query("SELECT 'doc' AS source, doc_id AS id, lang, NULL AS url FROM documents UNION ALL SELECT 'page', page_id, NULL, url FROM pages UNION ALL SELECT 'item', item_id, NULL, NULL FROM benchmark")
def tagged_union(spark, d):
    id_of = lambda name, c, *more: _t(spark, d, name).select(F.col(c).alias("id"), *more)
    return linkage.tagged({"doc": id_of("documents", "doc_id", "lang"), "page": id_of("pages", "page_id", "url"), "item": id_of("benchmark", "item_id")})


@query("SELECT doc_id AS id FROM documents UNION SELECT page_id FROM pages UNION SELECT vec_id FROM embeddings")
def all_ids(spark, d):
    return linkage.all_ids(_t(spark, d, "documents").select(F.col("doc_id").alias("id")), _t(spark, d, "pages").select("page_id"), _t(spark, d, "embeddings").select("vec_id"))


@query("SELECT p_partkey, array_to_string(CASE WHEN p_type = p_brand THEN [p_type] ELSE [p_type, p_brand] END, '|') AS merged FROM part")
def merged_lists(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.array_join(linkage.merged_lists(F.array("p_type"), F.array("p_brand", "p_type")), "|").alias("merged"))


@query("SELECT source, count(*) FILTER (lang = 'en') AS n_en FROM documents GROUP BY 1")
def unknown_counts(spark, d):
    return reports.count_where(_t(spark, d, "documents"), "source", F.col("lang") == "en", "n_en")


@query("SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars, round(sum(n_chars) / count(*), 9) AS n_chars_each FROM documents GROUP BY 1")
def domain_ratios(spark, d):
    return reports.ratios(_t(spark, d, "documents"), "lang", ["n_chars"], digits=None).withColumn("n_chars_each", F.round("n_chars_each", 9))


@query("SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, min(p_partkey), p_name LIMIT 12")
def common_titles(spark, d):
    return reports.most_common(_t(spark, d, "part"), "p_name", 12, "p_partkey")


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders")
def renamed_report(spark, d):
    return reports.renamed(_t(spark, d, "orders"), {"o_orderkey": "id", "o_totalprice": "price"})


@query("""WITH p AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM p GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) + 1e-12 AS n FROM m GROUP BY 1)
SELECT label, CAST(i AS INTEGER) AS at, round(x / n, 6) AS x FROM m JOIN n USING (label)""")
def mean_vectors(spark, d):
    v = documents.mean_vectors(_t(spark, d, "embeddings"), "label", "embedding").select("label", F.posexplode("embedding").alias("at", "x"))
    return v.select("label", (F.col("at") + 1).cast("int").alias("at"), F.round("x", 6).alias("x"))


@query("SELECT page_id, row_number() OVER (ORDER BY CASE WHEN length(regexp_extract(url, '([0-9]+)$', 1)) BETWEEN 1 AND 18 THEN CAST(regexp_extract(url, '([0-9]+)$', 1) AS BIGINT) ELSE -1 END, page_id) AS pos FROM pages QUALIFY pos <= 40")
def first_by_number(spark, d):
    first = _t(spark, d, "pages").orderBy(T.last_number(F.col("url")), "page_id").limit(40)
    return first.select("page_id", F.row_number().over(retrieval.Window.orderBy(T.last_number(F.col("url")), "page_id")).cast("long").alias("pos"))  # forty rows


@query("""WITH s AS (SELECT doc_id, lang, md5(CAST(doc_id AS VARCHAR) || '42') AS h, count(*) OVER (PARTITION BY lang) AS c, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || '42'), doc_id) AS n FROM documents)
SELECT doc_id, lang FROM s WHERE c >= 30 AND n <= 5 ORDER BY lang NULLS FIRST, h, doc_id LIMIT 12""")
def capped_sample(spark, d):
    return selection.balanced(_t(spark, d, "documents"), "doc_id", "lang", 30, 5, 12).select("doc_id", "lang")


@query("""WITH g AS (SELECT o_orderpriority FROM orders GROUP BY 1 HAVING count(*) >= 5), x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_orderpriority, o_orderkey) AS n FROM orders)
SELECT o_custkey, o_orderpriority FROM x WHERE n = 1 AND o_orderpriority IN (SELECT * FROM g)""")
def collected_once(spark, d):
    return selection.collected(_t(spark, d, "orders").orderBy("o_orderkey"), "o_custkey", "o_orderpriority", "o_orderstatus", ["F", "O"], 5).select("o_custkey", "o_orderpriority")


@query("SELECT doc_id, CASE WHEN source = (SELECT min(source) FROM documents) AND c >= 30 AND n <= 10 THEN 'test' ELSE 'corpus' END AS split FROM (SELECT *, count(*) OVER (PARTITION BY lang, source) AS c, row_number() OVER (PARTITION BY lang, source ORDER BY md5(CAST(doc_id AS VARCHAR) || '42'), doc_id) AS n FROM documents)")
def designated_split(spark, d):
    docs = _t(spark, d, "documents")
    least = docs.agg(F.min("source")).first()[0]
    return selection.split(docs, "doc_id", ["lang", "source"], 30, 10, sources={"source": [least] if least else []}).select("doc_id", "split")


@query("""WITH e AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn, coalesce(text, '')) AS t, role FROM conversations GROUP BY conv_id, role), ok AS (SELECT conv_id, role, t FROM e WHERE length(t) >= 200)
SELECT conv_id, CASE role WHEN 'system' THEN '1' WHEN 'user' THEN '2' ELSE '3' END AS section, 'Talk ' || conv_id AS title, length(t) AS chars FROM ok UNION ALL
SELECT conv_id, 'full', 'Talk ' || conv_id || ' (fallback: full)', length(string_agg(t, chr(10) ORDER BY CASE role WHEN 'system' THEN '1' WHEN 'user' THEN '2' ELSE '3' END)) FROM e WHERE conv_id NOT IN (SELECT conv_id FROM ok) GROUP BY conv_id""")
def titled_chunks(spark, d):
    from .queries import _entries

    rows = _entries(spark, d).withColumn("title", F.concat(F.lit("Talk "), "conv_id"))
    chunks = documents.titled_chunks(rows, "conv_id", "path", "text", "title", 200)
    return chunks.select("conv_id", "section", "title", F.length("text").cast("long").alias("chars"))


@query("SELECT doc_id, 'full' AS section, length(coalesce(text, '')) AS chars FROM documents")
def unchunked(spark, d):
    return documents.unchunked(_t(spark, d, "documents"), "doc_id", "text").select("doc_id", "section", F.length("text").cast("long").alias("chars"))


@query("SELECT page_id, length(html) > 0 AS has_html, contains(html, '<article') AND contains(html, '</article>') AS is_article FROM pages")
def article_check(spark, d):
    return _t(spark, d, "pages").select("page_id", T.filled(F.col("html")).alias("has_html"), T.is_article(F.col("html")).alias("is_article"))


@query("SELECT query, vec_id AS doc_id, lang, CAST(rank AS INTEGER) AS rank FROM (SELECT a.vec_id AS query, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))), 6) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT item_id FROM benchmark)) LEFT JOIN documents ON doc_id = vec_id WHERE rank <= 5")
def hits_with_texts(spark, d):
    hits = _knn(spark, d, 5).select("query", F.col("vec_id").alias("doc_id"), "rank")
    return retrieval.with_texts(hits, _t(spark, d, "documents"), columns=("lang",)).select("query", "doc_id", "lang", "rank")


@query("""WITH s AS (SELECT a.vec_id AS query, b.vec_id, round(list_inner_product(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))), 6) AS sim FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT item_id FROM benchmark)),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) AS n FROM s) SELECT query, max(sim) AS sim, max(CASE WHEN n = 1 THEN vec_id END) AS best, string_agg(vec_id, ' ' ORDER BY n) AS first FROM r WHERE n <= 3 GROUP BY 1""")
def closest_vectors(spark, d):
    c = metrics.closest(_knn(spark, d, 5), "query", "vec_id", "sim")
    return c.select("query", "sim", "best", F.array_join(F.transform("first", lambda x: x.cast("string")), " ").alias("first"))


@query("""SELECT conv_id, turn, array_to_string(list_filter(string_split(coalesce(text, ''), '. '), lambda s: length(s) >= 40 OR starts_with(s, 'Th')), '|') AS steps FROM conversations""")
def long_steps(spark, d):
    kept = T.long_enough(F.split(T.blank(F.col("text")), r"\. "), 40, lambda s: F.startswith(s, F.lit("Th")))
    return _t(spark, d, "conversations").select("conv_id", "turn", F.array_join(kept, "|").alias("steps"))


@query("SELECT round(avg(CASE WHEN NOT isnan(l_quantity) THEN l_quantity END), 4) AS l_quantity_mean, round(avg(CASE WHEN l_linenumber % 3 > 0 THEN l_discount END), 4) AS holed_mean, round(avg(l_tax), 4) AS l_tax_mean FROM lineitem")
def metric_means(spark, d):
    rows = _t(spark, d, "lineitem").withColumn("holed", F.when(F.col("l_linenumber") % 3 > 0, F.col("l_discount")).otherwise(float("nan")))
    m = reports.averages(rows, ["l_quantity", "holed", "l_tax"])
    return m.select(*[F.round(c, 4).alias(c) for c in m.columns])


@query("SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE lang END), ''), nullif(trim(source), ''), substr(text, 1, 50)) AS picked FROM documents")
def first_section(spark, d):
    methods = F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("lang"))
    return _t(spark, d, "documents").select("doc_id", T.first_filled(methods, F.col("source"), F.left("text", F.lit(50))).alias("picked"))
