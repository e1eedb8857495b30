import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tessellar.operators import graph, linkage, metrics, reports, retrieval, selection
from tessellar.operators.lexical_index import LexicalIndex
from tessellar.options import Options
from tessellar.sources import files


def test_floor_quantiles(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0)], "k string, v double")
    got = {r["k"]: (r["p25"], r["p75"], r["median"]) for r in reports.summary(df, "k", "v").collect()}
    assert got == {"a": (1.0, 1.0, 1.5), "b": (5.0, 5.0, 5.0)}


def test_keep_first_and_dropped_part_the_rows(spark):
    df = spark.createDataFrame([(1, 3), (1, 2), (2, 9)], "k int, p int")
    order = [F.col("p")]
    assert sorted(map(tuple, linkage.keep_first(df, ["k"], order).collect())) == [(1, 2), (2, 9)]
    assert sorted(map(tuple, linkage.dropped(df, ["k"], order).collect())) == [(1, 3)]


def test_thresholds_that_are_inactive_pass(spark):
    df = spark.createDataFrame([(0.2, 0.9)], "a double, b double")
    count = lambda t, m: df.filter(selection.passes(t, m)).count()
    assert count({"a": 0, "b": 0}, "all") == 1 and count({"a": 0.5, "b": 0.5}, "any") == 1 and count({"a": 0.5, "b": 0.5}, "all") == 0


def test_split_takes_its_number_and_is_disjoint(spark):
    df = spark.range(50).select(F.col("id").alias("k"), (F.col("id") % 2).alias("g"))
    s = selection.split(df, "k", ["g"], 20, 3)
    assert {tuple(r) for r in s.groupBy("g", "split").count().collect()} == {(0, "test", 3), (1, "test", 3), (0, "corpus", 22), (1, "corpus", 22)}


def test_numbers_over_the_whole_table(spark):
    rows = [(i * 7 % 101, f"r{i % 5}") for i in range(101)] + [(None, "n")]
    df = spark.createDataFrame(rows, "v long, t string").repartition(5)
    got = {r["v"]: r["n"] for r in linkage.numbered(df, [F.desc_nulls_last("v")], "n").collect()}
    assert got == {**{v: 101 - v for v in range(101)}, None: 102}
    assert linkage.numbered(df.filter("v > 1000"), [F.col("v")]).collect() == []


def test_fusion_prefers_the_lexical_list_on_ties(spark):
    lex = spark.createDataFrame([(1, 10, 2)], "query long, doc_id long, rank int")
    sem = spark.createDataFrame([(1, 20, 1)], "query long, doc_id long, rank int")
    assert [r["doc_id"] for r in retrieval.fuse(lex, sem, 2).orderBy("rank").collect()] == [10, 20]


def test_topological_order_appends_cycles(spark):
    nodes = spark.createDataFrame([(1, i) for i in range(4)], "key long, idx long")
    edges = spark.createDataFrame([(1, 3, 0), (1, 1, 2), (1, 2, 1)], "key long, u long, v long")
    got = graph.topological_order(nodes, edges).orderBy("pos").collect()
    assert [r["idx"] for r in got] == [3, 0, 1, 2]


def test_greedy_match_and_order(spark):
    pairs = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 1, 0.8), (1, 1, 1, 0.7), (1, 1, 0, 0.95)], "key long, i long, j long, sim double")
    got = metrics.greedy_match(pairs, 0.7)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == [(0, 1), (1, 0)]
    assert metrics.order_agreement(got).first()["order"] == 0.0


@pytest.mark.parametrize("held", [1_000_000, 0])
def test_greedy_match_equals_the_loop(spark, monkeypatch, held):
    """In one task for each key, or by rounds of pairs that are the best of both sides; ties too."""
    monkeypatch.setattr(metrics, "HELD_PAIRS", held)
    rng = random.Random(8)
    rows = [(k, i, j, rng.choice([0.2, 0.5, 0.5, 0.7, 0.9])) for k in range(12) for i in range(rng.randint(1, 5)) for j in range(rng.randint(1, 5))]
    want = []
    for k in {r[0] for r in rows}:
        used = set()
        for _, i, j, s in sorted((r for r in rows if r[0] == k and r[3] >= 0.5), key=lambda r: (-r[3], r[1], r[2])):
            if ("i", i) not in used and ("j", j) not in used:
                used |= {("i", i), ("j", j)}
                want.append((k, i, j, s))
    got = metrics.greedy_match(spark.createDataFrame(rows, "key long, i long, j long, sim double"), 0.5)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_vectors_of_steps(spark):
    rows = [(k, i, [float(i + 1), float(k), 1.0] if i != 3 else [0.0, 0.0, 0.0]) for k in range(3) for i in range(5)] + [(0, 9, None), (None, 1, [1.0, 1.0, 1.0])]
    got = spark.createDataFrame(rows, "key long, i long, vector array<double>")
    want = spark.createDataFrame([(k, j, [1.0, float(j), 2.0]) for k in range(2) for j in range(3)], "key long, j long, vector array<double>")
    found = {(r["key"], r["i"], r["j"]): r["sim"] for r in metrics.vector_pairs(got, want).collect()}
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / ((sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5) or 1.0)
    assert found == pytest.approx({(k, i, j): cosine(v, [1.0, float(j), 2.0]) for k, i, v in rows if v and k is not None and k < 2 for j in range(3)})


def test_near_pairs_meet_by_bands(spark):
    """One unit has all rows, few values are near: only neighbouring bands meet."""
    rng = random.Random(6)
    value = lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-3, 5)
    a, b = ([("k", "ml", round(value(), 4)) for _ in range(300)] + extra for extra in ([("k", "ml", 1.1), ("k", "ml", 0.0), ("k", None, 1.0)], [("k", "ml", 1.0), ("k", "ml", 0.1), ("k", "ml", None)]))
    kind = "key string, unit string, value double"
    frames = [spark.createDataFrame(x, kind) for x in (a, b)]
    for tolerance in (0.1, 0.5):
        got = metrics.near_pairs(*frames, "key", tolerance)
        want = sorted((x, y) for _, u, x in a if u for _, _, y in b if y is not None and abs(x - y) <= tolerance * max(1.0, abs(y)))
        assert sorted((r["got"]["value"], r["want"]["value"]) for r in got.collect()) == want and len(want) > 20


def first_fit(got, want, tolerance=0.1):
    free, hits = list(want), 0
    for value, unit in got:
        for w in free:
            if unit == w[1] and abs(value - w[0]) <= tolerance * max(1.0, abs(w[0])):
                free.remove(w)
                hits += 1
                break
    return hits


def test_param_quality(spark):
    rng = random.Random(4)
    some = lambda: [(rng.choice([1.0, 1.05, 5.0, 5.2, 5.6]), rng.choice(["ml", "min"])) for _ in range(rng.randint(0, 6))]
    rows = [(i, some(), some()) for i in range(200)]
    kind = "array<struct<value:double,unit:string>>"
    df = spark.createDataFrame(rows, f"id long, got {kind}, want {kind}")
    got = {r["id"]: (round(r["p"], 9), round(r["r"], 9)) for r in metrics.param_quality(df, "got", "want").collect()}
    ratio = lambda a, b: round(a / b, 9) if b else 0.0
    assert got == {i: (ratio(first_fit(g, w), len(g)), ratio(first_fit(g, w), len(w))) for i, g, w in rows}


def test_json_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n{bad\n{"id": 2}\n')
    (tmp_path / "b.json").write_text('[{"id": 3}, {"id": 4}]')
    assert sorted(r["id"] for r in files.read_json(spark, str(tmp_path / "a.jsonl"), "id long").collect()) == [1, 2]
    assert sorted(r["id"] for r in files.read_any_json(spark, str(tmp_path / "b.json"), "id long").collect()) == [3, 4]


def test_files_of_either_kind_and_none(spark, tmp_path):
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "a.json").write_text('  [{"id": 1}, {"id": 2}]')
    (tmp_path / "many" / "b.json").write_text('\n{"id": 3}\n{bad\n')
    read = lambda p: sorted(r["id"] for r in files.read_any_json(spark, str(tmp_path / p), "id long").collect())
    assert read("many") == [1, 2, 3] and read("missing") == []
    assert files.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "many")]) == str(tmp_path / "many")


def test_reports_have_one_row_and_tables_a_header(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "a,b"', None), (2, "plain", "x")], "id long, t string, n string")
    with pytest.raises(Exception, match="more than one row"):
        files.write_report(df, str(tmp_path / "r"))
    lines = lambda p: [r["value"] for r in spark.read.text(str(tmp_path / p)).collect()]
    files.write_table(df.filter("id > 5"), str(tmp_path / "empty"))
    assert lines("empty") == ["id,t,n"]
    files.write_table(df.filter("id = 1").select("id", F.replace("t", F.lit(","), F.lit(";")).alias("t")), str(tmp_path / "raw"), sep="\t", quote=False)
    assert set(lines("raw")) == {"id\tt", '1\tsay "a;b"'}  # each file has a header
    files.write_table(df, str(tmp_path / "q"))
    assert sorted(map(tuple, files.read_table(spark, str(tmp_path / "q")).select("id", "t").collect())) == [("1", 'say "a,b"'), ("2", "plain")]


def test_reports_and_routed_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "ok", None), (2, "error", "why")], "id long, status string, note string")
    files.write_report(df.filter("id = 1"), str(tmp_path / "r"))
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "r")).collect())
    assert json.loads(text) == {"id": 1, "status": "ok", "note": None}
    files.write_by(df, str(tmp_path / "by"), ["status"])
    files.write_run(df, str(tmp_path / "runs"), "status", F.to_date(F.lit("2024-05-06")))
    assert spark.read.json(str(tmp_path / "by")).filter("status = 'ok'").count() == 1
    assert (tmp_path / "runs" / "run_date=2024-05-06" / "run_status=error").is_dir()
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "PMC7.xml").write_text("<article/>")
    assert [tuple(r) for r in files.read_articles(spark, str(tmp_path / "x")).select("id", "text").collect()] == [("PMC7", "<article/>")]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.pdf").write_bytes(b"one|two")
    (tmp_path / "p" / "b.pdf").write_bytes(b"bad")
    pages = lambda b: b.decode().split("|") if b != b"bad" else 1 / 0
    got = {r["path"][-5:]: (r["text"], r["error"]) for r in files.read_documents(spark, str(tmp_path / "p"), pages).collect()}
    assert got["a.pdf"] == ("one\ntwo", None) and got["b.pdf"][0] is None and "zero" in got["b.pdf"][1]


def test_prompts_options_and_small_groups(spark):
    from tessellar.operators import external

    df = spark.createDataFrame([("abcdef", 2)], "m string, n int")
    assert df.select(external.prompt(external.QUERIES_PROMPT, {"methods": F.col("m"), "n": F.col("n")}, cut=3)).first()[0] == "Give 2 search queries, one a line, for these methods:\nabc"
    rows = [(1, i, float(i)) for i in range(3)] + [(2, i, float(i)) for i in range(5)]
    p = spark.createDataFrame(rows, "q long, doc long, ce_score double")
    got = external.reranked_if_many(p, "q", [F.col("doc")], 9).orderBy("q", "rank").collect()
    assert [r["doc"] for r in got] == [0, 1, 2, 4, 3, 2, 1, 0]
    lex = spark.createDataFrame([(1, d, d) for d in range(1, 9)], "query long, doc_id long, rank int")
    docs = spark.createDataFrame([(d, f"text {d}") for d in range(1, 5)], "doc_id long, text string")
    hits = external.searched(Options(k_lex=3, k_sem=0, topn=2), lex, lex, docs).orderBy("rank").collect()
    assert [(r["doc_id"], r["text"]) for r in hits] == [(1, "text 1"), (2, "text 2")]


def test_external_models_are_pluggable(spark):
    from tessellar.operators import external

    def echo(prompts):
        return [hashlib.md5(p.encode()).hexdigest() for p in prompts]

    def overlap(pairs):
        return [len((a := set(q.lower().split())) & set(t.lower().split())) / max(1, len(a)) for q, t in pairs]

    p = spark.createDataFrame([(1, "red fox", "a fox"), (1, "red fox", "red fox runs"), (1, "red fox", None)], "q long, query string, text string")
    s = external.scored(p, overlap, "query", "text")
    assert [r["ce_score"] for r in external.reranked_first(s, "q", [F.col("text").desc_nulls_last()], 2).orderBy("rank").collect()] == [1.0, 0.5]
    assert external.answered(p, echo, "q", "query").filter("length(answer) = 32").count() == 3
    got = spark.range(1).select(external.evidence(F.array(F.lit("abcdef"), F.lit("x")), 3).alias("e")).first()["e"]
    assert got == "[EVIDENCE 1] abc\n\n[EVIDENCE 2] x"


def test_documents(spark):
    from tessellar.operators import documents

    e = spark.createDataFrame([(1, "1.10", "c"), (1, "1.2", "b"), (1, "2", "dddd"), (2, "1", "x")], "k long, p string, t string")
    assert {r["k"]: r["text"] for r in documents.flatten_hierarchy(e, "k", "p", "t").collect()} == {1: "b\nc\ndddd", 2: "x"}
    assert sorted((r["k"], r["section"]) for r in documents.section_chunks(e, "k", "p", "t", 4).collect()) == [(1, "2"), (2, "full")]
    page = spark.createDataFrame([(1, "<p>one<br>two <b>x</b><script>no</script><p>10.1234/self 10.1234/other")], "i long, h string")
    assert [r["text"] for r in documents.page_sections(page, "i", "h").orderBy("pos").collect()] == ["one", "two x", "10.1234/self 10.1234/other"]
    assert page.select(documents.first_link(F.col("h"), F.lit("10.1234/self"), "nowhere").alias("l")).first()["l"] == "10.1234/other"


def test_stream_counts(spark, tmp_path):
    from tessellar.streaming import corpus

    src = str(tmp_path / "in")
    kind = "id long, at timestamp"
    marks = str(tmp_path / "cp")

    def seen(rows):
        """Adds rows, and gives what the stream let through, and how many ids it still holds."""
        spark.createDataFrame([(i, dt.datetime(2024, 1, 1, hour)) for i, hour in rows], kind).coalesce(1).write.mode("append").parquet(src)
        stream = corpus.first_seen(spark.readStream.schema(kind).parquet(src), "id", "at", "1 hour")
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", marks).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()), q.lastProgress["stateOperators"][0]["numRowsTotal"]

    assert seen([(1, 1), (1, 1), (2, 1)]) == ([1, 2], 2)
    assert seen([(2, 1), (3, 9)])[0] == [1, 2, 3]  # the time moves on
    got, state = seen([(4, 9), (5, 1)])  # 5 is later than the watermark; 1 and 2 are forgotten
    assert got == [1, 2, 3, 4] and state == 2
    assert seen([(1, 9)])[0] == [1, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        corpus.first_seen(spark.readStream.schema(kind).parquet(src), "id")


def test_index_grows_with_a_stream(spark, tmp_path):
    from tessellar.streaming import corpus

    source, index, marks = (str(tmp_path / x) for x in ("in", "index", "marks"))
    for rows in ([(1, "red fox"), (2, "red red")], [(3, "fox")]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").json(source)
        corpus.grow_index(corpus.read_stream(spark, source, "doc_id long, text string"), index, marks).awaitTermination(60)
    asked = spark.createDataFrame([(7, "red"), (8, "fox")], "query long, term string")
    found = LexicalIndex(spark, index).match_all(asked).collect()
    assert sorted((r["query"], r["doc_id"]) for r in found) == [(7, 1), (7, 2), (8, 1), (8, 3)]
