"""Cases of the findings of a review: each failed before its change."""

import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from bazaarspark.functions import columns
from bazaarspark.functions import text as X
from bazaarspark.llm import lattice, scratch
from bazaarspark.operators import metadata, phrases, retrieval, search
from bazaarspark.plans import retrieval_queries, search_queries


def test_normalized_zeros_keep_their_sign(spark, tmp_path):
    rows = [(1, [-1e-8, 1.0]), (2, [-0.0, 2.0]), (3, [1e-8, -3.0]), (4, [0.5, None]), (5, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    signed = lambda v: [(x, x is not None and math.copysign(1, x)) for x in v]
    want = {i: signed(v) for i, v in con.sql(retrieval_queries.ORACLES["l2_normalize"]).fetchall()}
    got = {r["id"]: signed(r["v"]) for r in retrieval_queries.QUERIES["l2_normalize"](spark, str(tmp_path)).collect()}
    assert got == want
    assert got[1] == [(0.0, -1.0), (1.0, 1.0)]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_query_log_is_dealt_over_tasks(spark, tmp_path):
    spark.range(1000).selectExpr("id AS p_partkey", "'red ring' AS p_name").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert search_queries._log(spark, str(tmp_path)).rdd.getNumPartitions() >= 8


def test_texts_are_worked_out_once_for_a_list(spark):
    rows = spark.createDataFrame([(["a", "B", "b", "A", "c"],), ([],), (None,)], "tokens array<string>")
    kept = rows.select(X.keep_first(F.filter("tokens", lambda t: t != "c")).alias("t"))
    assert [r["t"] for r in kept.collect()] == [["a", "B"], [], None]
    assert _plan(kept).count("lambda (NOT") + _plan(kept).count("= c)") <= 2
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 24))
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    texts = spark.createDataFrame([("محصولات سالوته رو میخوام",)], "query string")
    assert _plan(texts.select(metadata.near_miss_brand(X.search_tokens("query")))).count("(?U)") <= 8  # 14 before


def test_names_are_folded_once(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 24))
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    asked = spark.createDataFrame([("q", ["salute"], "سالوته salute")], "query_id string, name_tokens array<string>, name_phrase string")
    named = search.name_variants(asked)
    assert named.first()["phrases"][0] == "سالوته salute"
    assert _plan(named).count("(?U)") <= 8  # 10 before


def test_no_join_of_vectors_is_a_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 8))
    x = np.concatenate([x, x + 0.01 * rng.standard_normal(x.shape)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    written, plans = scratch.written, []

    def kept(df, name):
        out = written(df, name)
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(scratch, "written", kept)
    whole = lattice.embedding_dedup(rows)
    want = sorted(map(tuple, whole.collect()))
    assert "BroadcastHashJoin" not in whole._jdf.queryExecution().executedPlan().toString()
    assert [name for name, plan in plans if "BroadcastHashJoin" in plan] == []
    assert sum(r[1] for r in want) >= 120
    # Tables one after the other, each in parts, give the same result.
    before = len(plans)
    monkeypatch.setattr(lattice, "ROUND", 500)
    assert sorted(map(tuple, lattice.embedding_dedup(rows).collect())) == want
    assert sum(name == "lattice-round" for name, _ in plans[before:]) == 8 * 4


def test_long_sides_of_a_search_are_not_broadcast(spark):
    d = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = search.search_diag(search_queries._cases(spark, d), search_queries._catalog(spark, d), spark.createDataFrame([("q", "1")], "query_id string, product_code string"))
    assert "BroadcastHashJoin" not in plan(found)
    few, many = spark.range(10), spark.range(11)
    assert "BroadcastHashJoin" in plan(spark.range(99).join(columns.side(few, 10), "id")) and "SortMergeJoin" in plan(spark.range(99).join(columns.side(many, 10), "id"))


def test_phrases_are_found_in_one_pass(spark):
    texts = spark.createDataFrame([(1, "blue ring and red ring"), (2, "note"), (3, "nothing")], "query_id long, query string")
    names = spark.createDataFrame([("ring", "B", 2), ("red ring", "R", 5), ("blue ring", "A", 5), ("and", "B", 1), ("note", "Note", 0)], "alias string, canonical string, ord int")
    found = phrases.first_phrases(texts, names)
    plan = _plan(found)
    assert plan.count("Join Inner") == 1 and plan.count("Generate explode") == 1
    assert sorted(map(tuple, found.collect())) == [(1, "A", ["B", "A", "R"]), (2, "Note", ["Note"])]


def test_bm25_deals_documents_not_pairs(spark, monkeypatch):
    queries = spark.createDataFrame([(i, f"w{i} w{i + 1} w1") for i in range(20)], "query_id int, text string")
    docs = spark.createDataFrame([(i, f"w1 w{i % 7} w{i % 5} w{i % 11}") for i in range(60)] + [(60, None)], "doc_id int, text string")
    found = retrieval.bm25(queries, docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(doc_id") > 0 and "hashpartitioning(query_id" not in plan
    want = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(retrieval, "WORDS", 3)
    assert sorted(map(tuple, retrieval.bm25(queries, docs).collect())) == want
    assert len(want) == 20 * 60
