"""Plans, articles and stems by brute force."""

import re
from collections import deque

from pyspark.sql import functions as F

from tessellar.functions import lexicon
from tessellar.functions import text as T
from tessellar.operators import articles, graph, protocols, retrieval

VERBS = ["Prepare", "Mix", "Add", "Measure", "Wash", "Read", "Incubate", "Do"]


def brute_plan(steps):
    """Titles and steps with their numbers, of a protocol's (action, material, depends_on)."""
    cat = [0 if a in lexicon.PREPARING else 2 if a in lexicon.ANALYSING else 1 for a, _, _ in steps]
    n = len(steps)
    edges = {(u, v) for v, s in enumerate(steps) for u in s[2] if 0 <= u < n and u != v}
    edges |= {(u, v) for u in range(n) for v in range(n) if u != v and steps[u][1] and steps[u][1] == steps[v][1] and cat[u] == 0}
    edges |= {(u, v) for u in range(n) for v in range(u + 1, n) if cat[u] < cat[v]}
    open_ = [sum(v == i for _, v in edges) for i in range(n)]
    queue, order = deque(i for i in range(n) if not open_[i]), []
    while queue:
        order.append(i := queue.popleft())
        for u, v in sorted(edges):
            if u == i:
                open_[v] -= 1
                if not open_[v]:
                    queue.append(v)
    order += [i for i in range(n) if i not in order]
    rows, section = [], 0
    for c, title in enumerate(lexicon.PLAN_TITLES):
        of = [i for i in order if cat[i] == c]
        if of or c == 1:
            section += 1
            rows.append((str(section), title, None))
            rows += [(f"{section}.{k}", None, i) for k, i in enumerate(of, 1)]
    names = {i: f"n{k}" for k, i in enumerate(order, 1)}
    return rows, {(names[u], names[v]) for u, v in edges}


def test_plans(spark):
    protocols_of = {k: [(VERBS[(k * 3 + i * i) % 8].lower(), f"m{(i * k) % 3}" if i % 4 else "", [(i * 7 + k) % 6 - 2]) for i in range(k % 7)] for k in range(40)}
    rows = [(k, i, (a, m or None, None, None, (None,) * 5, dep, None)) for k, steps in protocols_of.items() for i, (a, m, dep) in enumerate(steps)]
    steps = spark.createDataFrame(rows, f"p long, idx long, ir {protocols.IR}")
    edges = protocols.dependencies(steps, "p")
    order = protocols.ordered(steps, edges, "p")
    plan, named = {}, {}
    for r in protocols.plan(steps, order, spark.range(40).withColumnRenamed("id", "p"), "p").collect():
        plan.setdefault(r["p"], []).append((r["sid"], r["title"], r["idx"]))
    for r in protocols.relabelled(order, edges, "p").collect():
        named.setdefault(r["p"], set()).add((r["u"], r["v"]))
    for k, of in protocols_of.items():
        want, edges_of = brute_plan(of)
        if not of:
            want, edges_of = [(str(i), t, None) for i, t in enumerate(lexicon.PLAN_TITLES, 1)], set()
        assert sorted(plan[k]) == sorted(want, key=lambda r: r[0]), k
        assert named.get(k, set()) == edges_of


def test_repeated_steps_are_paired_once(spark):
    nodes = spark.range(3000).select((F.col("id") % 2).alias("key"), (F.col("id") % 6).alias("idx"), (F.col("id") % 3).alias("cat"), F.array(F.lit(" Agar")).alias("outputs"), F.array(F.lit("agar")).alias("inputs"))
    pairs = {(k, u, v) for k in (0, 1) for u in range(k, 6, 2) for v in range(k, 6, 2) if u != v}
    wanted = {"category_edges": {(k, u, v) for k, u, v in pairs if u < v and u % 3 < v % 3}, "material_edges": pairs}
    for name, want in wanted.items():
        edges = getattr(graph, name)(nodes)
        assert sorted(tuple(r) for r in edges.collect()) == sorted(want)
        assert max(made_by_joins(edges)) <= 18, name


def made_by_joins(df):
    """Rows out of each join that a DataFrame's collected plan had."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if "Join" in p.nodeName():
            found.append(p.metrics().apply("numOutputRows").value())
        todo += [p.executedPlan()] if p.nodeName() == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in p.nodeName() else []
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_empty_and_odd_articles(spark):
    rows = [(1, None), (2, ""), (3, "<a>"), (4, "<a/>"), (5, "<a><body><sec><title>Methods</title><p>" + "x " * 90 + "</p></sec></body></a>"), (6, f"<a><!-- {lexicon.BLOCKED.upper()} --></a>")]
    parts = articles.parsed(spark.createDataFrame(rows, "k long, xml string"), "k", "xml")
    found = articles.sections(parts, "k", ["methods"], [], least=100)
    assert [(r["k"], r["section"], r["source"]) for r in found.collect()] == [(5, "Methods", "regular")]
    got = {r["k"]: r["result"] for r in articles.outcomes(parts, found, "k").collect()}
    assert got == {1: "parse_error", 2: "parse_error", 3: "parse_error", 4: "no_body", 5: "ok", 6: "publisher_blocked_xml"}


def test_sections_aside_and_fuzzy_titles(spark):
    text = "<a><body><sec sec-type='x'><title>Materials &amp; Methods</title><p>kept <fig>not</fig>gone</p><subsec><p>below</p></subsec></sec></body></a>"
    parts = articles.parsed(spark.createDataFrame([(1, text)], "k long, xml string"), "k", "xml")
    s = parts.first()["sections"][0]
    assert (s["title"], s["text"], s["merged"]) == ("Materials & Methods", "Materials & Methodskept below", "kept below")
    df = spark.createDataFrame([("materials and methods",)], "t string")
    for mode, targets, want in (("exact", ["materials and methods"], True), ("exact", ["methods"], False), ("startswith", ["materials"], True), ("contains", ["methods", "zz"], True), ("regex", ["^mat.*ods$"], True), ("contains", [], False)):
        assert df.select(T.title_matches(F.col("t"), targets, mode)).first()[0] is want


def test_stems_and_snippets(spark):
    docs = spark.createDataFrame([(1, "Été running far"), (2, "run")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "runs"), (7, "ete"), (8, "run")], "query long, term string")
    assert sorted(map(tuple, retrieval.match_folded(docs, asked, stem=True).collect())) == [(7, 1), (8, 1), (8, 2)]
    s = spark.createDataFrame([("a b.c Fox runs", ["fox", "b.c"]), ("none here", ["x"]), ("as it is", [])], "t string, w array<string>").select(T.snippet(F.col("t"), F.col("w"), 12)).collect()
    assert [r[0] for r in s] == ["[b.c] [Fox] runs"[: len("[b.c] [Fox] runs")], "none here", "as it is"]


def test_step_from_odd_texts(spark):
    df = spark.createDataFrame([("",), (None,), ("  Mix, 5 g  salt at -4 ° C",)], "t string").select(protocols.from_text(F.col("t")).alias("x"))
    got = [r["x"] for r in df.collect()]
    assert got[:2] == [None, None] and (got[2]["action"], got[2]["material"], got[2]["condition"]["temp"]) == ("mix", "5 g salt at -4 ° C", "-4°C")
    assert re.match(r"Mix .*\.$", spark.createDataFrame([("Mix salt..",)], "t string").select(protocols.sentence(protocols.from_text(F.col("t")))).first()[0])


def test_parts_of_some_articles_are_held_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(articles, "ARTICLES", 3)
    monkeypatch.setattr(articles, "CHARS", 4000)
    rows = spark.range(0, 50, 1, 1).select(F.col("id").alias("k"), F.concat(F.lit("<a><article-title>"), F.repeat(F.lit("x "), F.pmod("id", F.lit(7)).cast("int") * 500), F.col("id"), F.lit("</article-title></a>")).alias("xml"))
    parts = articles.parsed(rows, "k", "xml")
    assert [r["title"].split()[-1] for r in parts.orderBy("k").collect()] == [str(i) for i in range(50)]
