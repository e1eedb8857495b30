"""Options and the pipeline steps that read them; small operators; patterns on random texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessellar.functions import lexicon
from tessellar.functions import text as T
from tessellar.operators import articles, documents, external, protocols, retrieval
from tessellar.options import Options
from tessellar.plans import pipelines
from tessellar.sources import files


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {'string' if isinstance(v, str) or v is None else 'long'}" for i, v in enumerate(values)))
    return df.select(column.alias("x")).first()["x"]


def test_every_option_is_read(spark, monkeypatch):
    few = Options(k_lex=2, k_sem=1, topn=2, topk=2, mmr_lambda=1.0, step_sim=0.9, param_tol=0.5, top_keywords=1, min_steplen=5, num_queries=1, self_win=10, self_step=8, evid_trunc=4, self_sections="abstract, intro")
    assert one(spark, pipelines.steps(few, F.col("c0")), "Mix.\nAdd the salt. Stir") == ["Add the salt."]
    assert one(spark, pipelines.queries(few, F.col("c0")), "first.\nsecond") == ["first protocol"]
    docs = spark.createDataFrame([(1, "salt salt water"), (2, "x" * 25)], "doc_id long, text string")
    assert sorted(map(tuple, pipelines.keywords(few, docs).collect())) == [(1, "salt"), (2, "x" * 25)]
    ranked = spark.createDataFrame([(1, d, d) for d in (1, 2, 3, 4)], "query long, doc_id long, rank int")
    assert {r["doc_id"] for r in pipelines.candidates(few, ranked, ranked.filter("doc_id = 9"), docs).collect()} == {1, 2}
    pairs = spark.createDataFrame([(1, "q", t, i) for i, t in enumerate(["bbbb", "a", "ccc", "dddddddd"])], "g long, q string, t string, i int")
    assert [r["t"] for r in pipelines.reranked(few, pairs, lambda ps: [len(t) for _, t in ps], "g", "q", "t", [F.col("i")]).orderBy("rank").collect()] == ["bbbb", "a"]
    hits = spark.createDataFrame([(1, 1, 0.9, [1.0, 0.0]), (1, 2, 0.8, [1.0, 0.0]), (1, 3, 0.1, [0.0, 1.0])], "query long, vec_id long, sim double, embedding array<double>")
    assert [r["vec_id"] for r in pipelines.diversified(few, hits).orderBy("pos").collect()] == [1, 2]
    sections = {f"{k}_text": F.lit(k) for k in ("methods", "abstract", "intro")}
    assert one(spark, pipelines.own_text(few, sections), 1) == "abstract\n\nintro"
    assert sorted((r["evidence"], r["preview"]) for r in pipelines.own_evidence(few, docs.filter("doc_id = 2"), "doc_id", "text").collect()) == [("self:1", "xxxx"), ("self:2", "xxxx")]
    assert one(spark, pipelines.evidence(few, F.array(F.col("c0"))), "abcdef") == "[EVIDENCE 1] abcd"
    side = lambda name, v: spark.createDataFrame([(1, 0, v), (1, 1, [0.0, 1.0])], f"key long, {name} long, vector array<double>")
    assert [(r["i"], r["j"]) for r in pipelines.matched_steps(few, side("i", [1.0, 0.2]), side("j", [1.0, -0.9])).collect()] == [(1, 1)]
    kind = "array<struct<value:double,unit:string>>"
    p = spark.createDataFrame([([(1.0, "ml")], [(1.4, "ml")])], f"g {kind}, w {kind}")
    assert pipelines.param_scores(few, p, "g", "w").first()["f1"] == 1.0
    monkeypatch.setenv("TOPK", "7")
    monkeypatch.setenv("STEP_SIM", "0.25")
    assert (Options.from_environment().topk, Options.from_environment().step_sim, Options.from_environment().topn) == (7, 0.25, 50)


def test_defaults_and_attempts(spark):
    assert [one(spark, T.or_default(F.col("c0"), "d"), v) for v in ("x", " ", None)] == ["x", "d", "d"]
    assert one(spark, T.first_filled(F.col("c0"), F.col("c1")), " ", " y ") == "y"
    attempt = lambda a, b: one(spark, external.better_attempt(F.lit("strict"), F.lit("relaxed"), F.col("c0"), F.col("c1")), a, b)
    assert [attempt(2, 1), attempt(1, 1), attempt(0, 3)] == ["strict", "relaxed", "relaxed"]
    text = lambda t: one(spark, protocols.or_minimal(F.col("c0"), F.col("c1")), t, "Title")
    assert text(" whole ") == "whole" and text(None) == text("  ") == lexicon.PLAN_TITLES[1] + "\nTitle"
    parsed = lambda t: one(spark, documents.parsed(F.col("c0"), "a int")["a"], t)
    assert [parsed('{"a": 1}'), parsed('Answer:\n{"a": 2}\nDone'), parsed("none")] == [1, 2, None]
    extra = protocols.category(F.from_json(F.lit('{"action": "blend"}'), "action string"), preparing=["blend"])
    assert one(spark, extra, 1) == 0


def test_vectors_of_texts_keep_any_key(spark):
    df = spark.createDataFrame([("a", "xx"), ("b", None)], "doc_id string, text string")
    got = retrieval.embed(df, lambda ts: [[len(t), 1.0] for t in ts], size=1)
    assert {r["doc_id"]: list(r["embedding"]) for r in got.collect()} == {"a": [2.0, 1.0], "b": [0.0, 1.0]}


def test_lines_ids_and_strict_json(spark, tmp_path):
    (tmp_path / "l.txt").write_text(" one \n\ntwo\n")
    assert sorted(r["line"] for r in files.read_lines(spark, str(tmp_path / "l.txt")).collect()) == ["one", "two"]
    (tmp_path / "i.csv").write_text("id,x\n 7 ,1\n7,2\n,3\n")
    assert [r["id"] for r in files.id_set(spark, str(tmp_path / "i.csv"), "id").collect()] == ["7"]
    (tmp_path / "j.json").write_text('{"id": 1}\n{"id": \n')
    with pytest.raises(Exception, match="MALFORMED|alformed"):
        files.read_json(spark, str(tmp_path / "j.json"), "id long", strict=True).collect()


def test_deep_articles(spark):
    deep = "<article><body><sec><title>Methods</title><p>" + "<b>" * 5000 + "core" + "</b>x" * 5000 + "</p></sec></body></article>"
    rows = spark.createDataFrame([(1, deep), (2, "<article><body><sec><title>A</title><p>one <!-- no --> two<fig>gone</fig>tail</p></sec></body></article>"), (3, "<bad")], "id long, xml string")
    got = {r["id"]: r for r in articles.parsed(rows, "id", "xml").collect()}
    assert got[1]["sections"][0]["text"].startswith("Methodscorex") and got[1]["error"] is None
    assert got[2]["sections"][0]["text"] == "Aone two" and got[3]["error"]


WORDS = ["5", "12.5", "3 x 10^2", "1×10-3", "ml", "µl", "hours", "h", "%", "rpm", "mM", "add", "at", "°C", ",", ";", ".", "(", "70%x", "g/l", "minks", "mg"]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_quantities_of_random_texts(spark):
    texts = [*random_texts(400, 3), ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i long, t string")
    got = {r["i"]: r for r in df.select("i", T.scaled_params(F.col("t")).alias("s"), T.param_strings(F.col("t")).alias("p"), T.params(F.col("t")).alias("q")).collect()}
    name = lambda u: lexicon.UNITS.get(u.lower().replace(" ", ""), u.lower().replace(" ", ""))
    for i, t in [*enumerate(texts), (-1, "")]:
        scaled = [(float(v) * (10.0 ** int(p) if p else 1.0), name(u)) for v, p, u in re.findall(lexicon.SCALED_PARAM, t, re.I)]
        assert [u for _, u in scaled] == [x["unit"] for x in got[i]["s"]] and [v for v, _ in scaled] == pytest.approx([x["value"] for x in got[i]["s"]]), t
        assert got[i]["p"] == list(dict.fromkeys(m.lower() for m in re.findall(lexicon.LOOSE_PARAM, t, re.I))), t
        assert [(x["value"], x["unit"]) for x in got[i]["q"]] == [(float(v), u) for v, u in re.findall(lexicon.PARAM, t, re.I)], t


def test_lines_of_random_lists(spark):
    rng = random.Random(9)
    marks = ["- ", "* ", "1. ", "2) ", "", "  ", "– ", "(3) "]
    line = lambda: rng.choice(marks) + " ".join(rng.choice(["wash", "cells", "Protocol", "now", "a"]) for _ in range(rng.randint(0, 12))) + rng.choice(["", ".", "...", " -", " "])
    texts = ["\n".join(line() for _ in range(rng.randint(0, 7))) for _ in range(200)]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", T.task_lines(F.col("t"), 3).alias("tasks"), T.query_lines(F.col("t"), 2, pad=True).alias("queries")).collect()
    for r in got:
        tasks, queries = [], []
        for raw in texts[r["i"]].split("\n"):
            x = re.sub(r"^(?:- |\* ){0,2}", "", raw.strip(" "))
            x = re.sub(r"^[ \-–—\t]+|[ \-–—\t]+$", "", re.sub(r"^[0-9. )(]+", "", x))
            if 2 <= len(x.split()) <= 10 and x not in tasks:
                tasks.append(x)
            q = re.sub(r"\.+$", "", raw.strip(" "))
            if q:
                queries.append(q if q.lower().endswith("protocol") else q + " protocol")
        queries = (queries[:2] + queries[:1] * 2)[:2] if queries else []
        assert r["tasks"] == tasks[:3] and r["queries"] == queries, texts[r["i"]]
