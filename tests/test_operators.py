import datetime as dt
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from bazaarspark.functions import columns as C
from bazaarspark.functions import text as X
from bazaarspark.operators import conversations, ir_eval, metadata, orders, retrieval, tool_eval
from bazaarspark.sources import ingest
from bazaarspark.streaming import events as E


def test_money_guard(spark):
    rows = spark.createDataFrame([(x,) for x in ("", "1,000", "-5", " 5", "5\n", "5.", None, "5", "1.25")], "p string")
    assert rows.agg(C.total("p").alias("t")).first()["t"] == 6.25


def test_parse_price(spark):
    rows = spark.createDataFrame([("1.2.3",), ("250000.0 T",), ("",), (None,), ("-7",)], "p string")
    assert [r[0] and float(r[0]) for r in rows.select(X.parse_price("p")).collect()] == [None, 250000.0, None, None, 7.0]


def test_like_terms(spark):
    rows = spark.createDataFrame([("50%", "50%"), ("a_b", "axb"), ("a\\b", "a\\b"), ("x", "y")], "term string, text string")
    got = rows.withColumn("pattern", C.like_pattern(F.col("term"))).select(F.expr("text ILIKE pattern")).collect()
    assert [r[0] for r in got] == [True, True, True, False]


def test_summary_of_customers_without_orders(spark):
    items = spark.createDataFrame([("1", "o", "Complete", "5")], "customer_id string, order_id string, status string, final_price string")
    got = {r["customer_id"]: r for r in orders.order_summary(items, spark.createDataFrame([("1",), ("2",)], "customer_id string")).collect()}
    assert got["1"]["completed_orders"] == 1 and got["1"]["total_spent"] == 5.0
    assert got["2"]["total_orders"] == 0 and got["2"]["total_spent"] == 0.0


def test_payload_drops_nulls(spark):
    rows = spark.createDataFrame([("a", 2, None), ("a", 1, "x")], "k string, rank int, v string")
    assert C.result_payload(rows, ["k"], ["rank"]).first()["payload"] == '{"found":true,"results":[{"rank":1,"v":"x"},{"rank":2}]}'


def test_roles_go_after_the_limit(spark):
    m = spark.createDataFrame([("c", i, "system" if i == 9 else "user", "t") for i in range(10)], "customer_id string, id long, role string, content string")
    assert sorted(r["id"] for r in conversations.recent_messages(m, 3).collect()) == [7, 8]


def test_import_keeps_the_first(spark):
    a = spark.createDataFrame([("1", "x", 2), ("1", "w", 1), (None, "n", 3)], "code string, name string, row_order int")
    b = spark.createDataFrame([("1", "y", 1), ("2", "z", 2), (None, "m", 3)], "code string, name string, row_order int")
    got = ingest.import_users([a, b], {"code": "customer_code", "name": "name"})
    assert sorted((r[0] or "", r[1]) for r in got.collect()) == [("", "n"), ("1", "w"), ("2", "z")]
    assert ingest.import_audit([a, b], got).first().asDict() == {"rows_read": 6, "rows_kept": 3, "rows_removed": 3}
    with pytest.raises(ValueError):
        ingest.import_users([a], {"missing": "x"})


def test_chunks_cover_the_text():
    text = " ".join(f"word{i}." for i in range(600))
    chunks = retrieval.split_text(text)
    assert all(len(c) <= 700 for c in chunks) and chunks[0] == text[: len(chunks[0])]
    bare = text.replace(" ", "")
    assert all(c.replace(" ", "") in bare for c in chunks) and chunks[-1].endswith("word599.")
    assert retrieval.split_text("") == [] and retrieval.split_text("x" * 1300)[0] == "x" * 600


def test_chunk_ids_are_gapless(spark):
    docs = spark.createDataFrame([(i, "a b " * (200 * (i % 4))) for i in range(20)], "doc_id long, text string")
    rows = retrieval.assign_chunk_ids(retrieval.chunk_documents(docs)).orderBy("page", "pos").collect()
    assert [r["chunk_id"] for r in rows] == list(range(len(rows)))


def test_bm25_and_minmax(spark):
    docs = spark.createDataFrame([(1, "red shoe red"), (2, "blue hat"), (3, "red hat")], "doc_id int, text string")
    got = {r["doc_id"]: r["score"] for r in retrieval.bm25(spark.createDataFrame([(1, "red shoe")], "query_id int, text string"), docs).collect()}
    assert got[1] > got[3] and 2 not in got
    rows = spark.createDataFrame([("q", 1.0), ("q", 3.0), ("q", 5.0), ("r", 2.0)], "k string, x double")
    assert sorted(r["n"] for r in retrieval.minmax_norm(rows, "x", "k", "n").collect()) == [0.0, 0.5, 1.0, 1.0]


def test_judged_precision_and_condensed_ndcg(spark):
    run = spark.createDataFrame([("c", "p", "gold", 1), ("c", "p", "none", 2), ("c", "p", "other", 3), ("c", "n", "none", 1), ("c", "n", "a", 2), ("c", "n", "b", 3)], "config string, query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("p", "gold", 3.0), ("n", "a", 3.0), ("n", "b", 1.0)], "query_id string, doc_id string, grade double")
    got = {r["query_id"]: r for r in ir_eval.rank_metrics(run, qrels, (3,)).collect()}
    assert got["p"]["judged_precision_3"] == 1.0 and got["n"]["ndcg_3"] == 1.0 and got["n"]["mrr"] == 0.5


def test_percentile_by_place(spark):
    rows = spark.createDataFrame([("s", float(i)) for i in range(1, 11)], "suite string, latency_ms double")
    assert tool_eval.latency_percentiles(rows).first()["p95"] == 9.0


def test_text_scores(spark):
    rows = spark.createDataFrame([("the cat sat on the mat", "the cat sat on the mat"), ("the cat", "a dog"), ("", "x"), ("a b c d", "a x b d")], "prediction string, ground_truth string")
    got = tool_eval.text_scores(rows).collect()
    assert (got[0]["bleu"], got[0]["rouge_l"], got[0]["exact_match"]) == (1.0, 1.0, 1.0)
    assert [got[i]["bleu"] for i in (1, 2)] == [0.0, 0.0] and got[3]["rouge_l"] == 0.75


def test_limiter_ignores_denied_events(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", i, t0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 1, 2, 9, 10, 11, 12])]
    ev = spark.createDataFrame(rows, "user_id string, event_id long, ts timestamp")
    got = [r["allowed"] for r in E.rate_limit_verdicts(ev, max_requests=2, window_s=10.0).orderBy("event_id").collect()]
    want, held = [], deque()
    for _, _, t in rows:
        while held and held[0] <= t - dt.timedelta(seconds=10):
            held.popleft()
        want.append(len(held) < 2)
        if want[-1]:
            held.append(t)
    assert got == want


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), "product_search_completed", i % 3 == 0, False, False) for i in range(50)]
    schema = "event_id long, ts timestamp, event string, empty boolean, llm_fallback_triggered boolean, llm_failure boolean"
    batch = spark.createDataFrame(rows, schema)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "10 minutes")
    q = E.search_metrics(stream, "10 seconds").writeStream.format("memory").queryName("found").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("found").collect())) == sorted(map(tuple, E.search_metrics(batch, "10 seconds").collect()))


def test_trace_and_secrets(spark):
    row = spark.createDataFrame([("00-4bf92f3577b34da6a3ce929d0e0e4736-00f067aa0ba902b7-01", "api_key=abc Token: x", "bad")], "t string, s string, b string")
    got = row.select(E.trace_id("t"), E.redact_secrets("s"), E.trace_id("b")).first()
    assert tuple(got) == ("4bf92f3577b34da6a3ce929d0e0e4736", "api_key=[REDACTED] Token: [REDACTED]", None)


def test_limiter_on_a_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, i, t0 + dt.timedelta(seconds=s)) for k in ("a", "b") for i, s in enumerate([0, 1, 2, 9, 10, 11, 12])]
    batch = spark.createDataFrame(rows, "user_id string, event_id long, ts timestamp")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = E.rate_limit_stream(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), max_requests=2, window_s=10.0, expire=False)
    q = stream.writeStream.format("memory").queryName("verdicts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = E.rate_limit_verdicts(batch, max_requests=2, window_s=10.0).select("user_id", "ts", "allowed")
    assert sorted(map(tuple, spark.table("verdicts").collect())) == sorted(map(tuple, want.collect()))


def test_cases_and_reports(spark, tmp_path):
    path = tmp_path / "cases.json"
    path.write_text('[{"id": 1, "tools": ["a"]}, {"id": 2, "tools": []}]')
    cases = ingest.read_cases(spark, str(path), "id long, tools array<string>")
    assert cases.count() == 2
    ingest.write_report(cases.withColumn("passed", F.col("id") == 1), cases.agg(F.count("*").alias("n")), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/failed")).first()["id"] == 2


def test_cuts_are_greedy_and_whole():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["word", "a", " ", ". ", "\\n", "\\n\\n", "!", "x" * 30]) for _ in range(rng.randrange(1, 120))).replace("\\n", "\n")
        places = retrieval._cut_places(text, 50, 10)
        assert all(0 < j - i <= 50 for i, j in places) or not text
        at = 0
        for i, j in places:
            assert i == at or (at - 10 <= i < at and "x" * 30 in text)  # only windows overlap
            at = j
        assert at == len(text)
        for (i, j), (n, k) in zip(places, places[1:]):
            assert n < j or k - i > 50 or any(text[:j].endswith(m) for m in retrieval.SEPARATORS)  # pieces part at a mark, or would not fit together


def test_common_subsequence():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert tool_eval._common_length(a, b) == table[-1][-1]


def test_values_at_places(spark):
    rng = random.Random(4)
    values = {"a": [rng.gauss(0, 1) for _ in range(300)], "b": [5.0] * 40, None: [1.0, 2.0, 2.0, 1e9]}
    rows = spark.createDataFrame([(k, x) for k, xs in values.items() for x in [*xs, None]], "k string, x double").repartition(3)
    got = {(r["k"], r["name"]): r["x"] for r in C.values_at(rows, "k", "x", {"first": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "last": lambda n: n - 1}, 64).collect()}
    assert got == {(k, p): sorted(xs)[{"first": 0, "mid": len(xs) // 2, "last": len(xs) - 1}[p]] for k, xs in values.items() for p in ("first", "mid", "last")}


def test_argument_match_wants_equality_of_one_object(spark):
    args = "map<string,string>"
    rows = spark.createDataFrame(
        [
            (1, {"q": "x"}, None, [{"q": "x", "sql": "drop"}]), (2, {"q": "x"}, None, [{"q": "x"}]), (3, {"q": "x"}, None, [{"q": "x"}, {"q": "x"}]),
            (4, None, [{"q": "x"}], [{"q": "x", "more": "y"}]), (5, None, [{"q": "<resolved_from_step_1>"}], [{"r": "x"}]), (6, None, [{"q": "<resolved_from_step_1>"}], [{"q": None}]), (7, None, None, []), (8, None, [], []),
        ],
        f"case_id int, expected_args {args}, expected_calls array<{args}>, actual_calls array<{args}>",
    )
    got = {r["case_id"]: r["matched"] for r in tool_eval.argument_match(rows).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False, 6: True, 7: None, 8: True}


def test_quality_ends_at_a_word(spark):
    rows = spark.createDataFrame([("بهتر",), ("بهتری",)], "query string")
    read = rows.withColumns({c: F.lit(None).cast(t) for c, t in (("brand", "string"), ("category", "string"), ("color", "string"), ("material", "string"), ("gender", "string"), ("price_min", "double"), ("price_max", "double"), ("availability", "boolean"))}).withColumns({"leftover": F.array().cast("array<string>"), "n": F.lit(2)})
    got = {r["query"]: (r["needs_understanding"], r["needs_rerank"]) for r in metadata.gate_columns(read, candidates="n").collect()}
    assert got == {"بهتر": (True, True), "بهتری": (False, False)}


def test_messages_and_tools_on_a_stream(spark, tmp_path):
    turns = spark.createDataFrame([("c", " hi ", "  "), ("d", None, "x" * 5000)], "customer_id string, user_message string, assistant_message string")
    calls = spark.createDataFrame([("tool_execution", "a", 200), ("tool_execution", "a", 500), ("tool_execution", None, None), ("llm_call", "a", 200)], "event string, tool string, status int")
    for name, batch, make in (("turns", turns, conversations.turns_to_messages), ("calls", calls, E.tool_metrics)):
        batch.write.parquet(str(tmp_path / name))
        mode = "append" if name == "turns" else "complete"
        q = make(spark.readStream.schema(batch.schema).parquet(str(tmp_path / name))).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(tuple, spark.table(name).collect()), key=repr) == sorted(map(tuple, make(batch).collect()), key=repr)
