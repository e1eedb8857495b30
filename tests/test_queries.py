"""Every query with SQL gives DuckDB's rows at the smallest scale."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tessellar.plans import protocol_queries
from tessellar.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_match(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda v: None if v is None or v != v else v.item() if hasattr(v, "item") else v
    rows = lambda df: sorted(repr([plain(v) for v in r]) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_whole_passages_and_sides(spark, tmp_path):
    passage = "one two three four five six seven eight nine ten"
    at = lambda name: str(tmp_path / f"{name}.parquet")
    spark.createDataFrame([(1, f"a {passage.upper()}, b"), (2, "one two three four five six else seven"), (3, "ten nine eight seven six five four three two one")], "doc_id long, text string").write.parquet(at("documents"))
    spark.createDataFrame([(7, passage), (8, None), (9, "six five never")], "item_id long, text string").write.parquet(at("benchmark"))
    assert [tuple(r) for r in QUERIES["phrase_match"](spark, str(tmp_path)).collect()] == [(7, 1)]
    turns = [(1, 0, "user", "same words " * 10 + "left"), (1, 1, "assistant", "same words " * 10 + "right")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(at("conversations"))
    assert QUERIES["pair_consistency"](spark, str(tmp_path)).first()["title_sim"] == 0.5


def test_hosts_of_other_names_stay(spark, tmp_path):
    urls = [(1, "https://docs.example.net/a"), (2, "http://Elsewhere.org"), (3, "ftp://x.com/e"), (4, None)]
    spark.createDataFrame(urls, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted(tuple(r) for r in QUERIES["url_host_filter"](spark, str(tmp_path)).collect()) == [(1, "docs.example.net"), (2, "elsewhere.org")]


def test_candidates_join_no_texts(spark):
    plan = QUERIES["query_candidates"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Project \[([^\]]*, )?text#\d+[,\]]", plan)


def test_plan_statistics_of_repeated_and_keyless_parts(spark, tmp_path):
    part = spark.read.parquet(f"{DATA}/part.parquet").filter("p_partkey < 40")
    odd = part.limit(7).withColumn("p_partkey", F.lit(None).cast("long"))
    part.unionByName(part.filter("p_partkey % 3 = 0")).unionByName(odd).write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    for name in ("plan_statistics", "step_dependencies"):
        got, want = QUERIES[name](spark, str(tmp_path)), con.execute(ORACLES[name])
        columns = [c[0] for c in want.description]
        assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.fetchall()))
    joins = QUERIES["plan_statistics"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins <= QUERIES["step_dependencies"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_steps_are_made_once_in_many_tasks(spark):
    assert protocol_queries._steps(spark, DATA).rdd.getNumPartitions() >= 4
    for name in ("step_dependencies", "plan_statistics", "plan_rows", "relabelled_edges"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract" not in plan.lower() and "mapinpandas" not in plan.lower()
