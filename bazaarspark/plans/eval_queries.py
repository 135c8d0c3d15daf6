"""Registered queries on evaluation, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarspark.operators import ir_eval as I
from bazaarspark.operators import search
from bazaarspark.operators import tool_eval as T
from bazaarspark.sources import ingest, scratch
from bazaarspark.sources.tables import table, view, with_views


def _run(s, d):
    return view(s, d, "runs")


def _qrels(s, d):
    return view(s, d, "qrels")


def _items(s, d):
    return search.catalog_view(view(s, d, "products")).withColumn("doc_id", F.col("product_code").cast("long")).withColumn("price", F.col("price").cast("double"))


def _expected(s, d):
    """Filters of a query: its brand always, others by the length of its text."""
    q = _run(s, d).select("query_id").distinct()
    kind, n = F.split_part("query_id", F.lit("|"), F.lit(1)), F.length("query_id")
    some = lambda cond, v: F.when(cond, F.lit(v))
    return q.select(
        "query_id", F.when(n % 13 == 0, "Xiaomi").otherwise(F.split_part("query_id", F.lit("|"), F.lit(2))).alias("brand"), F.when(n % 3 == 0, F.lower(kind)).alias("category"), some(n % 11 == 0, "a").alias("color"), some(n % 4 == 1, "MEN").alias("gender"), some(F.length(kind) % 2 == 0, 1500.0).alias("price_max"),
        some(F.length(kind) % 5 == 0, 950.0).alias("price_min"), (n % 7 == 0).alias("available"), some(n % 5 == 0, "Brand#13").alias("exclude_brand"), some(n % 6 == 0, "E").alias("product_name_contains"),
    )


def _digit():
    """The last digit of a query's brand."""
    return F.right("query_id", F.lit(1)).cast("int")


def _extracted(s, d):
    """What was read from each query, right in some fields and wrong in others."""
    n, digit = F.length("query_id"), _digit()
    kind, even = F.split_part("query_id", F.lit("|"), F.lit(1)), _digit() % 2 == 0
    none = F.array().cast("array<string>")
    return _expected(s, d).select(
        "query_id", F.when(F.col("brand") == "Xiaomi", "شیائومی").when(n % 3 == 0, "other").otherwise(F.lower("brand")).alias("brand"),
        F.when(n % 6 == 0, F.concat(kind, F.lit(" more"))).when(even, F.substring(kind, 1, 3)).otherwise("").alias("category"), F.when(n % 2 == 0, "A").otherwise("b").alias("color"), F.when(even, "Women").alias("gender"),
        F.when(even, 1500.9).otherwise(1501.0).alias("price_max"), F.when(digit % 3 > 0, 949.5).alias("price_min"), F.when(even, True).alias("availability"), F.when(even, none).otherwise(F.array(F.lit("x"), F.lit("brand#13"))).alias("exclude_brands"),
    )


TYPES = ["BRAND", "DIRECT_PRODUCT", "NO_RESULT", "BRAND_CATEGORY", "PERSIAN_VARIATION", "NEGATIVE_CONSTRAINT", "PARTIAL_PRODUCT_NAME", "OTHER"]


def _cases(s, d):
    n = F.length("query_id")
    kind = F.get(F.array(*map(F.lit, TYPES)), (n + _digit()) % 8)
    gold = _qrels(s, d).where("grade = 3").groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("gold"))
    graded = _qrels(s, d).groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("doc_id", "grade")))).alias("grades"))
    q = _run(s, d).select("query_id").distinct().withColumns({"query_type": kind, "expected_behavior": F.when(kind == "NO_RESULT", "NO_RESULTS").otherwise("RETURN_RESULTS"), "query": F.when(n % 2 == 0, F.concat(F.lit("رژ تریا "), "query_id")).otherwise(F.col("query_id")), "understanding_used": n % 3 == 0, "rerank_used": n % 2 == 0})
    q = q.join(gold, "query_id", "left").join(graded, "query_id", "left").withColumn("gold", F.coalesce("gold", F.array().cast("array<long>")))
    return I.annotate_cases(q)


def _scored(s, d):
    return I.score_cases(_run(s, d), _qrels(s, d), _cases(s, d).drop("gold", "grades"), _expected(s, d), _items(s, d), _extracted(s, d))


def _ops(s, d):
    e = view(s, d, "log_events")
    return e.select(F.col("event").alias("config"), (F.col("event_id") % 3 == 0).alias("called"), "latency_ms", "input_tokens", "output_tokens")


def _best(s, d, config):
    return _run(s, d).where(F.col("config") == config).join(_qrels(s, d).where("grade > 0"), ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("best_rank"))


def _tool_cases(s, d):
    """A case for each order: tools are kinds of products."""
    rows = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    kinds = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("p_type"))))
    n = F.col("o_orderkey")
    c = rows.groupBy("o_orderkey", "o_custkey", "o_orderpriority").agg(kinds(F.col("l_tax") < 0.04).alias("expected"), kinds(F.col("l_discount") < 0.05).alias("actual"), kinds(F.col("l_tax") > 0.06).alias("optional"), F.max("l_partkey").alias("k"), F.min("p_name").alias("name"))
    behaviour = F.when(n % 6 == 0, "ask_clarification").when(n % 6 == 1, "OUT_OF_SCOPE").when(n % 6 == 2, "refuse").otherwise("call_tools")
    query = F.when(n % 5 == 0, F.concat(F.lit("Mi: SELECT a FROM "), "name")).when(n % 7 == 0, F.concat(F.lit("شيائومی "), "name")).otherwise(F.col("name"))
    args = F.when(n % 4 == 0, F.create_map(F.lit("query"), query, F.lit("Filters"), F.lit("1"), F.lit("SQL"), F.lit("x"))).otherwise(F.create_map(F.lit("query"), query))
    call = lambda name, a: F.struct(F.lit(name).alias("name"), a.alias("args"))
    calls = F.when(n % 8 == 0, F.array(call("get_order", F.create_map(F.lit("customer_id"), F.lit("7"))), call("search_products", args))).otherwise(F.array(call("search_products", args)))
    return c.select(
        n.alias("case_id"), F.col("o_orderpriority").alias("category"), "expected", "actual", "optional", behaviour.alias("expected_behavior"), calls.alias("calls"), F.when(n % 3 == 0, F.array(F.lit("Xiaomi"), F.lit("zz"))).otherwise(F.array().cast("array<string>")).alias("wanted"),
        F.when(n % 2 == 0, "which one?").otherwise("done").alias("answer"), F.array(F.col("o_custkey"), F.when(n % 50 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))).alias("scoped_ids"), F.col("o_custkey").alias("customer_id"),
        F.when(n % 9 == 0, "ConnectTimeout: x").when(n % 9 == 1, "bad value").alias("error"), F.when(n % 2 == 0, "stress").otherwise("basic").alias("suite"), (F.col("k") * 1.5).alias("latency_ms"), F.get("expected", F.lit(0)).alias("expected_intent"),
    )


def _failed_report(s, d):
    """The failed cases of a written report, read back."""
    folder = scratch.folder(s, "report")
    scored = T.score_tool_cases(_tool_cases(s, d))
    ingest.write_report(scored.select(*FLAGS), T.tool_eval_rollup(scored), folder)
    return s.read.json(f"{folder}/failed", schema="case_id long, passed boolean, reason string")


def _listed_cases(s, d):
    """Conversations written as JSON lists, some thousand turns each, and read back."""
    rows = table(s, d, "conversations")
    lists = max(2, rows.count() // 4_000)
    folder = scratch.folder(s, "cases")
    case = F.struct("conv_id", "turn", "role", "text", F.array(F.struct((F.col("turn") % 3).alias("n"), F.lit('} ], "\\').alias("mark"))).alias("more"))
    rows.groupBy(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(lists)).alias("k")).agg(F.to_json(F.collect_list(case)).alias("value")).write.partitionBy("k").text(folder)
    return ingest.read_cases(s, folder, "conv_id long, turn long, role string, text string, more array<struct<n:long,mark:string>>").select("conv_id", "turn", "role", "text", F.col("more")[0]["n"].alias("n"), F.col("more")[0]["mark"].alias("mark"))


PREDICTED = ["actual", "calls", "answer", "scoped_ids", "customer_id"]


def _pairs(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_name").alias("prediction"), F.when(F.col("p_partkey") % 10 == 0, "").when(F.col("p_partkey") % 3 == 0, F.concat_ws(" ", "p_name", F.lower("p_type"), "p_brand", "p_name")).otherwise(F.concat_ws(" ", "p_type", "p_name", F.lit("of"), "p_brand")).alias("ground_truth"), F.when(F.col("p_partkey") % 8 == 0, "failed").alias("error"))


def _args(s, d):
    """Expected arguments of an order's call: one object for even keys, a list of one or two for odd ones, none for every eleventh."""
    n, status = F.col("o_orderkey"), F.col("o_orderstatus")
    key = n.cast("string")
    order = lambda v: F.create_map(F.lit("order"), v, F.lit("status"), status)
    want = order(F.when(n % 3 == 0, "<resolved_from_step_1>").otherwise(key))
    got = F.when(n % 5 == 0, F.create_map(F.lit("status"), status)).when(n % 7 == 0, order(F.lit("none"))).when(n % 4 == 0, F.create_map(F.lit("status"), status, F.lit("order"), key)).otherwise(F.map_concat(order(key), F.create_map(F.lit("more"), F.lit("1"))))
    calls = F.when(n % 13 == 0, F.array(got, got)).otherwise(F.array(got))
    return table(s, d, "orders").select(n.alias("case_id"), F.when((n % 2 == 0) & (n % 11 != 0), order(key)).alias("expected_args"), F.when((n % 2 == 1) & (n % 11 != 0), F.when(n % 13 == 0, F.array(want, F.create_map(F.lit("status"), status))).otherwise(F.array(want))).alias("expected_calls"), calls.alias("actual_calls"))


FLAGS = ["case_id", "selection_ok", "arguments_ok", "security_ok", "context_ok", "clarification_ok", "no_tool_ok", "violations", "passed", "reason"]

QUERIES = {
    "read_cases": _listed_cases,
    "rank_metrics": lambda s, d: I.rank_metrics(_run(s, d), _qrels(s, d)),
    "retrieval_metrics": lambda s, d: I.retrieval_metrics(_run(s, d), _qrels(s, d)),
    "relevance_grades": lambda s, d: I.relevance_grades(_cases(s, d)),
    "annotate_cases": lambda s, d: _cases(s, d).select("query_id", "query_type", "evaluation_type", "mismatch", "needs_review", "review_notes"),
    "filter_compliance": lambda s, d: I.filter_compliance(_run(s, d), _expected(s, d), _items(s, d)),
    "metadata_accuracy": lambda s, d: I.metadata_accuracy(_extracted(s, d), _expected(s, d)),
    "family_hit": lambda s, d: I.family_hit(_run(s, d), _qrels(s, d), _items(s, d)),
    "score_cases": lambda s, d: _scored(s, d),
    "aggregate_cases": lambda s, d: I.aggregate_cases(_scored(s, d)),
    "operational_metrics": lambda s, d: I.operational_metrics(_ops(s, d)),
    "failure_counts": lambda s, d: I.failure_counts(_scored(s, d)),
    "filter_violations": lambda s, d: I.filter_violations(_scored(s, d)),
    "config_comparison": lambda s, d: I.config_comparison(_scored(s, d), "a"),
    "run_diff": lambda s, d: I.run_diff(_scored(s, d).where("config = 'a'"), _scored(s, d).where("config = 'b'")),
    "candidate_recall": lambda s, d: I.candidate_recall(view(s, d, "deep_runs"), view(s, d, "deep_qrels"), view(s, d, "deep_runs").select("query_id").where("length(query_id) % 2 = 0")),
    "rank_shift": lambda s, d: I.rank_shift(_best(s, d, "a"), _best(s, d, "b")),
    "text_scores": lambda s, d: T.text_scores(_pairs(s, d)),
    "summarize_scores": lambda s, d: T.summarize_scores(T.text_scores(T.valid_predictions(_pairs(s, d))), ["exact_match", "rouge_l"]),
    "set_rates": lambda s, d: T.set_rates(_tool_cases(s, d).select("case_id", F.col("actual").alias("retrieved"), F.col("expected").alias("relevant"))).select("case_id", "hit", "recall", "precision"),
    "valid_predictions": lambda s, d: T.valid_predictions(_pairs(s, d)),
    "tool_selection_micro": lambda s, d: T.tool_selection_micro(_tool_cases(s, d)),
    "argument_match": lambda s, d: T.argument_match(_args(s, d)).select("case_id", "matched"),
    "confusion_matrix": lambda s, d: T.confusion_matrix(_tool_cases(s, d)),
    "guardrail_accuracy": lambda s, d: T.guardrail_accuracy(_tool_cases(s, d)),
    "latency_percentiles": lambda s, d: T.latency_percentiles(_tool_cases(s, d)),
    "suite_report": lambda s, d: T.suite_report(T.ordered_verdicts(_tool_cases(s, d))),
    "ordered_verdicts": lambda s, d: T.ordered_verdicts(_tool_cases(s, d)).select("case_id", "passed"),
    "failed_report": _failed_report,
    "tool_accuracy": lambda s, d: T.tool_accuracy(T.ordered_verdicts(_tool_cases(s, d))),
    "rescore": lambda s, d: T.rescore(_tool_cases(s, d).drop(*PREDICTED), _tool_cases(s, d).where("case_id % 4 <> 1").select("case_id", *PREDICTED)).select(*FLAGS),
    "tool_set_compare": lambda s, d: T.tool_set_compare(_tool_cases(s, d)).select("case_id", "missing", "extra", "ordered", "correct"),
    "argument_issues": lambda s, d: T.argument_issues(_tool_cases(s, d)).select("case_id", "issues"),
    "score_tool_cases": lambda s, d: T.score_tool_cases(_tool_cases(s, d)).select(*FLAGS),
    "per_tool_prf": lambda s, d: T.per_tool_prf(_tool_cases(s, d)),
    "tool_eval_rollup": lambda s, d: T.tool_eval_rollup(T.score_tool_cases(_tool_cases(s, d))),
    "readiness_verdict": lambda s, d: T.readiness_verdict(T.tool_eval_rollup(T.score_tool_cases(_tool_cases(s, d)))),
    "scope_audit": lambda s, d: T.scope_audit(_tool_cases(s, d).select(F.col("category").alias("tool"), F.explode("scoped_ids").alias("customer_id"), F.col("customer_id").alias("authenticated_id"))),
    "error_class": lambda s, d: _tool_cases(s, d).select("case_id", T.error_class("error").alias("class")),
}

JUDGED = """j AS (SELECT config, query_id, doc_id, rank, grade, CASE WHEN grade IS NOT NULL THEN count(grade) OVER (PARTITION BY config, query_id ORDER BY rank) END AS nth FROM runs LEFT JOIN qrels USING (query_id, doc_id)),
rel AS (SELECT query_id, count(*) AS relevant FROM qrels WHERE grade > 0 GROUP BY 1), idl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS i FROM qrels)"""


def _per(ks, where="true"):
    cols = ", ".join(f"count(*) FILTER (rank <= {k}) AS n{k}, count(*) FILTER (rank <= {k} AND grade > 0) AS good{k}, count(*) FILTER (rank <= {k} AND grade IS NOT NULL) AS judged{k}, sum((2 ** grade - 1) / log2(nth + 1)) FILTER (nth <= {k}) AS dcg{k}" for k in ks)
    ideal = ", ".join(f"sum((2 ** grade - 1) / log2(i + 1)) FILTER (i <= {k}) AS ideal{k}" for k in ks)
    out = ", ".join(
        f"CAST(good{k} > 0 AS INT)::DOUBLE AS hit_{k}, CASE WHEN n{k} > 0 THEN round(good{k} / n{k}, 6) END AS precision_{k}, CASE WHEN judged{k} > 0 THEN round(good{k} / judged{k}, 6) WHEN relevant > 0 THEN 0.0::DOUBLE END AS judged_precision_{k}, CASE WHEN relevant > 0 THEN round(good{k} / relevant, 6) END AS recall_{k}, CASE WHEN ideal{k} > 0 THEN round(dcg{k} / ideal{k}, 6) END AS ndcg_{k}"
        for k in ks
    )
    return f"""{JUDGED}, p AS (SELECT config, query_id, min(rank) FILTER (grade > 0) AS first, count(*) AS retrieved, {cols} FROM j WHERE {where} GROUP BY 1, 2), b AS (SELECT query_id, {ideal} FROM idl GROUP BY 1),
m AS (SELECT config, query_id, retrieved, coalesce(relevant, 0) AS relevant, coalesce(round(1 / first, 6), 0.0::DOUBLE) AS mrr, {out} FROM p LEFT JOIN rel USING (query_id) LEFT JOIN b USING (query_id))"""


EXPECTED = """e AS (SELECT query_id, CASE WHEN n % 13 = 0 THEN 'Xiaomi' ELSE split_part(query_id, '|', 2) END AS brand, CASE WHEN n % 3 = 0 THEN lower(kind) END AS category, CASE WHEN n % 11 = 0 THEN 'a' END AS color, CASE WHEN n % 4 = 1 THEN 'MEN' END AS gender, CASE WHEN length(kind) % 2 = 0 THEN 1500.0 END AS price_max,
 CASE WHEN length(kind) % 5 = 0 THEN 950.0 END AS price_min, n % 7 = 0 AS available, CASE WHEN n % 5 = 0 THEN 'Brand#13' END AS exclude_brand, CASE WHEN n % 6 = 0 THEN 'E' END AS name_part FROM (SELECT DISTINCT query_id, split_part(query_id, '|', 1) AS kind, length(query_id) AS n FROM runs)),
it AS (SELECT CAST(product_code AS BIGINT) AS doc_id, product_name, brand, type, category_level1, category_level2, color, gender, last_status, TRY_CAST(nullif(regexp_replace(coalesce(sum_of_price, ''), '[^0-9.]+', '', 'g'), '') AS DOUBLE) AS price FROM products)"""
CASES = f"""c AS (SELECT query_id, {TYPES}[(n + digit) % 8 + 1] AS query_type, CASE WHEN n % 2 = 0 THEN 'رژ تریا ' || query_id ELSE query_id END AS query, n % 3 = 0 AS understanding_used, n % 2 = 0 AS rerank_used, coalesce(gold, 0) AS gold, coalesce(named, 0) AS named
 FROM (SELECT DISTINCT query_id, length(query_id) AS n, CAST(right(query_id, 1) AS INT) AS digit FROM runs) LEFT JOIN (SELECT query_id, count(*) FILTER (grade = 3) AS gold, count(*) AS named FROM qrels GROUP BY 1) USING (query_id)),
an AS (SELECT *, CASE WHEN query_type = 'NO_RESULT' THEN 'NO_RESULTS' ELSE 'RETURN_RESULTS' END AS expected_behavior, CASE WHEN query_type IN ('NO_RESULT', 'NEGATIVE_CONSTRAINT') THEN 'special' WHEN query_type = 'BRAND' OR gold >= 20 THEN 'broad' WHEN query_type <> 'OTHER' THEN 'narrow' WHEN gold > 0 THEN 'broad' ELSE 'special' END AS evaluation_type,
 gold > 0 AND gold < named AS mismatch, query_type IN ('DIRECT_PRODUCT', 'BRAND_CATEGORY', 'PERSIAN_VARIATION', 'PARTIAL_PRODUCT_NAME') AND gold >= 20 AS large FROM c),
ann AS (SELECT * EXCLUDE (gold, named, large), mismatch OR large AS needs_review, nullif(concat_ws('; ', CASE WHEN large THEN '{I.LARGE_NOTE}' END, CASE WHEN mismatch THEN '{I.DIFFER_NOTE}' END), '') AS review_notes FROM an)"""
# Each field by its rule: a brand by any spelling, a category that holds the other, a gender that holds the expected one, prices less than 1 apart.
META = """xm AS (SELECT query_id, CASE WHEN brand = 'Xiaomi' THEN 'شیائومی' WHEN n % 3 = 0 THEN 'other' ELSE lower(brand) END AS brand, CASE WHEN n % 6 = 0 THEN kind || ' more' WHEN digit % 2 = 0 THEN substr(kind, 1, 3) ELSE '' END AS category, CASE WHEN n % 2 = 0 THEN 'A' ELSE 'b' END AS color, CASE WHEN digit % 2 = 0 THEN 'Women' END AS gender,
 CASE WHEN digit % 2 = 0 THEN 1500.9 ELSE 1501.0 END AS price_max, CASE WHEN digit % 3 > 0 THEN 949.5 END AS price_min, CASE WHEN digit % 2 = 0 THEN true END AS available, CASE WHEN digit % 2 = 0 THEN [] ELSE ['x', 'brand#13'] END AS excluded FROM (SELECT *, split_part(query_id, '|', 1) AS kind, length(query_id) AS n, CAST(right(query_id, 1) AS INT) AS digit FROM e)),
mc AS (SELECT e.query_id, (e.brand IS NOT NULL)::INT AS n_brand, (lower(x.brand) = lower(e.brand) OR x.brand = 'شیائومی' AND e.brand = 'Xiaomi')::INT AS c_brand, (e.category IS NOT NULL)::INT AS n_category, (x.category <> '' AND (contains(lower(x.category), lower(e.category)) OR contains(lower(e.category), lower(x.category))))::INT AS c_category,
 (e.gender IS NOT NULL)::INT AS n_gender, contains(lower(x.gender), lower(e.gender))::INT AS c_gender, (e.color IS NOT NULL)::INT AS n_color, (lower(x.color) = lower(e.color))::INT AS c_color, (e.price_max IS NOT NULL)::INT AS n_price_max, (abs(x.price_max - e.price_max) < 1)::INT AS c_price_max, (e.price_min IS NOT NULL)::INT AS n_price_min, (abs(x.price_min - e.price_min) < 1)::INT AS c_price_min,
 e.available::INT AS n_availability, (e.available AND x.available)::INT AS c_availability, (e.exclude_brand IS NOT NULL)::INT AS n_exclude_brand, list_contains(x.excluded, lower(e.exclude_brand))::INT AS c_exclude_brand FROM e JOIN xm x USING (query_id))"""
META_FIELDS = ["brand", "category", "gender", "color", "price_max", "price_min", "availability", "exclude_brand"]
HITS = "mh AS (SELECT query_id, CAST(" + " + ".join(f"n_{f}" for f in META_FIELDS) + " AS BIGINT) AS metadata_checked, CAST(" + " + ".join(f"n_{f} * coalesce(c_{f}, 0)" for f in META_FIELDS) + " AS BIGINT) AS metadata_hits FROM mc)"
COMPLY = f"""{EXPECTED}, cm AS (SELECT config, query_id, {{c}} FROM runs JOIN it USING (doc_id) JOIN e USING (query_id) GROUP BY 1, 2)"""
MEETS = """lower(it.brand) = lower(e.brand) AND (e.category IS NULL OR contains(lower(concat_ws('|', it.type, it.category_level1, it.category_level2, it.product_name)), lower(e.category))) AND (e.color IS NULL OR coalesce(contains(lower(it.color), lower(e.color)), false))
 AND (e.gender IS NULL OR coalesce(contains(lower(it.gender), lower(e.gender)), false)) AND (e.price_max IS NULL OR coalesce(it.price <= e.price_max, false)) AND (e.price_min IS NULL OR coalesce(it.price >= e.price_min, false)) AND (NOT e.available OR it.last_status = 'Enable')
 AND (e.exclude_brand IS NULL OR lower(it.brand) <> lower(e.exclude_brand)) AND (e.name_part IS NULL OR contains(lower(it.product_name), lower(e.name_part)))"""
FAMILY = "gf AS (SELECT DISTINCT query_id, p_brand, p_type FROM qrels JOIN part ON p_partkey = doc_id WHERE grade > 0 AND trim(p_brand) <> '' AND trim(p_type) <> ''), fam AS (SELECT config, query_id, {c} FROM (SELECT DISTINCT config, query_id FROM runs) LEFT JOIN (SELECT config, query_id, min(rank) AS first FROM runs JOIN part p ON p.p_partkey = doc_id WHERE EXISTS (SELECT 1 FROM gf WHERE gf.query_id = runs.query_id AND gf.p_brand = p.p_brand AND gf.p_type = p.p_type) GROUP BY 1, 2) USING (config, query_id))"
FAMILY_AT = "CASE WHEN query_id IN (SELECT query_id FROM gf) THEN CAST(coalesce(first <= {k}, false) AS INT)::DOUBLE END AS family_hit_{k}"
JUDGED_ONLY = ["mrr", *[f"{c}_{k}" for c in ("hit", "precision", "judged_precision", "ndcg", "family_hit") for k in I.KS]]
SCORED = (
    _per(I.KS)
    + ", "
    + COMPLY.replace("{c}", ", ".join(f"round(count(*) FILTER ({MEETS} AND rank <= {k}) / {k}, 6) AS compliance_{k}" for k in I.KS))
    + ", "
    + FAMILY.replace("{c}", ", ".join(FAMILY_AT.replace("{k}", str(k)) for k in I.KS))
    + f""", {CASES}, {META}, {HITS},
v AS (SELECT ann.*, config, retrieved, relevant, {', '.join(f"CASE WHEN relevant > 0 AND evaluation_type <> 'special' THEN {c} END AS {c}" for c in JUDGED_ONLY)}, {', '.join(f"CASE WHEN evaluation_type = 'narrow' AND relevant > 0 AND relevant < 20 THEN recall_{k} END AS recall_{k}" for k in I.KS)},
 {', '.join(f'compliance_{k}' for k in I.KS)}, metadata_checked, metadata_hits, CASE WHEN metadata_checked > 0 THEN metadata_checked = metadata_hits END AS metadata_correct, hit_10 AS hit_ten, mrr > 0 AS found
 FROM ann JOIN m USING (query_id) JOIN cm USING (config, query_id) JOIN fam USING (config, query_id) JOIN mh USING (query_id)),
w AS (SELECT * EXCLUDE (hit_ten), CASE WHEN evaluation_type = 'broad' THEN compliance_10 >= 1 WHEN evaluation_type = 'narrow' AND relevant > 0 THEN hit_ten >= 1 WHEN expected_behavior = 'NO_RESULTS' THEN retrieved = 0 ELSE retrieved > 0 END AS passed FROM v),
sc AS (SELECT * EXCLUDE (found), CASE WHEN passed THEN NULL WHEN query_type = 'NEGATIVE_CONSTRAINT' THEN 'NEGATIVE_CONSTRAINT' WHEN query_type = 'PERSIAN_VARIATION' AND contains(query, 'تریا') THEN 'TYPO_VARIATION' WHEN query_type = 'NO_RESULT' THEN 'NO_CATALOG_MATCH'
 WHEN NOT metadata_correct THEN CASE WHEN understanding_used THEN 'QUERY_UNDERSTANDING_MISS' ELSE 'METADATA_MISS' END WHEN compliance_10 < 1 THEN 'FILTER_MISS' WHEN found THEN 'RANKING_MISS' WHEN evaluation_type = 'narrow' OR relevant > 0 THEN CASE WHEN rerank_used THEN 'LLM_RANKING_MISS' ELSE 'RANKING_MISS' END ELSE 'METADATA_MISS' END AS failure_reason FROM w)"""
)
SLICES = "sl AS (SELECT 'all' AS slice, '' AS name, * FROM sc UNION ALL SELECT 'query_type', query_type, * FROM sc UNION ALL SELECT 'evaluation_type', evaluation_type, * FROM sc UNION ALL SELECT 'focus', query_type, * FROM sc WHERE query_type IN ('BRAND_CATEGORY', 'PERSIAN_VARIATION', 'COLLOQUIAL', 'PARTIAL_PRODUCT_NAME') UNION ALL SELECT 'focus', 'METADATA_MISS', * FROM sc WHERE failure_reason = 'METADATA_MISS')"


def _mean(c, name):
    return f"CAST(sum(CAST({c} AS DECIMAL(18, 6))) AS DOUBLE) / count({c}) AS {name}"


BEST = "best AS (SELECT config, query_id, min(rank) AS best_rank FROM runs JOIN qrels USING (query_id, doc_id) WHERE grade > 0 GROUP BY 1, 2)"

def _kinds(cond):
    return f"coalesce(list_sort(list_distinct(list(p_type) FILTER ({cond}))), CAST([] AS VARCHAR[]))"


FOLDED = "lower(translate(c.args['query'], 'يك', 'یک'))"
SQL_MARKS = " OR ".join(f"contains(' ' || {FOLDED} || ' ', '{m}')" for m in T.SQL_MARKS)
TOOLS = f"""g AS (SELECT o_orderkey AS n, o_custkey AS customer_id, o_orderpriority AS category, {_kinds('l_tax < 0.04')} AS expected, {_kinds('l_discount < 0.05')} AS actual, {_kinds('l_tax > 0.06')} AS optional, max(l_partkey) AS k, min(p_name) AS name
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
h AS (SELECT n AS case_id, *, CASE n % 6 WHEN 0 THEN 'ask_clarification' WHEN 1 THEN 'OUT_OF_SCOPE' WHEN 2 THEN 'refuse' ELSE 'call_tools' END AS expected_behavior, CASE n % 9 WHEN 0 THEN 'ConnectTimeout: x' WHEN 1 THEN 'bad value' END AS error, CASE WHEN n % 2 = 0 THEN 'stress' ELSE 'basic' END AS suite, k * 1.5::DOUBLE AS latency_ms,
 CASE WHEN n % 2 = 0 THEN 'which one?' ELSE 'done' END AS answer, CASE WHEN n % 3 = 0 THEN ['Xiaomi', 'zz'] ELSE CAST([] AS VARCHAR[]) END AS wanted, [customer_id, CASE WHEN n % 50 = 0 THEN customer_id + 1 ELSE customer_id END] AS scoped_ids,
 CASE WHEN n % 5 = 0 THEN 'Mi: SELECT a FROM ' || name WHEN n % 7 = 0 THEN 'شيائومی ' || name ELSE name END AS query FROM g),
ca AS (SELECT case_id, n, unnest(CASE WHEN n % 8 = 0 THEN [1, 2] ELSE [2] END) AS i, query, wanted FROM h),
cb AS (SELECT *, CASE WHEN i = 1 THEN {{'name': 'get_order', 'args': MAP {{'customer_id': '7'}}}} WHEN n % 4 = 0 THEN {{'name': 'search_products', 'args': MAP {{'query': query, 'Filters': '1', 'SQL': 'x'}}}} ELSE {{'name': 'search_products', 'args': MAP {{'query': query}}}} END AS c FROM ca),
cc AS (SELECT case_id, i, c.name AS name, list_contains(map_keys(c.args), 'customer_id') AS own_id, list_sort(list_filter(list_transform(map_keys(c.args), lambda k: lower(k)), lambda k: list_contains({T.FORBIDDEN}, k))) AS bad, {SQL_MARKS} AS has_sql,
 list_filter(wanted, lambda w: NOT CASE WHEN list_contains({T.ALIASES}, lower(w)) THEN {' OR '.join(f"contains({FOLDED}, '{a}')" for a in T.ALIASES)} ELSE contains({FOLDED}, lower(w)) END) AS lacking FROM cb),
ci AS (SELECT case_id, coalesce(flatten(list(list_concat(CASE WHEN len(bad) > 0 THEN ['forbidden_keys:' || array_to_string(bad, ',')] ELSE [] END, CASE WHEN has_sql THEN ['sql_in_query'] ELSE [] END, list_transform(lacking, lambda w: 'missing_substring:' || w)) ORDER BY i) FILTER (name = 'search_products')), []) AS issues,
 list(name || ':customer_id_argument' ORDER BY i) FILTER (own_id) AS own FROM cc GROUP BY case_id),
t AS (SELECT h.*, issues, own, list_sort(list_filter(expected, lambda x: NOT list_contains(actual, x))) AS missing, list_sort(list_filter(actual, lambda x: NOT list_contains(expected, x) AND NOT list_contains(optional, x))) AS extra, expected = actual AS ordered, len(list_filter(scoped_ids, lambda x: x <> customer_id)) = 0 AS context_ok FROM h JOIN ci USING (case_id)),
v AS (SELECT *, len(missing) = 0 AND len(extra) = 0 AS correct, list_concat(list_concat(list_filter(issues, lambda x: x LIKE 'forbidden_keys:%' OR x = 'sql_in_query'), coalesce(own, [])), CASE WHEN context_ok THEN [] ELSE ['request_context_mismatch'] END) AS violations FROM t),
s AS (SELECT *, len(issues) = 0 AS arguments_ok, len(violations) = 0 AS security_ok, CASE WHEN expected_behavior = 'ask_clarification' THEN correct AND (len(actual) = 0 OR contains(answer, '?')) END AS clarification_ok, CASE WHEN expected_behavior IN ('no_tool', 'refuse') THEN correct END AS no_tool_ok FROM v),
z AS (SELECT *, coalesce(clarification_ok, correct) AS selection_ok, coalesce(clarification_ok, correct) AND arguments_ok AND security_ok AND context_ok AS passed, CASE WHEN expected_behavior = 'ask_clarification' AND NOT contains(answer, '?') THEN CASE WHEN len(actual) > 0 THEN 'guessed_instead_of_clarifying' ELSE 'answer_not_clarifying' END END AS unclear FROM s),
o AS (SELECT * , CASE WHEN NOT passed THEN array_to_string(list_filter([CASE WHEN len(missing) > 0 THEN 'missing=' || array_to_string(missing, ',') END, CASE WHEN len(extra) > 0 THEN 'extra=' || array_to_string(extra, ',') END, CASE WHEN len(issues) > 0 THEN 'args=' || array_to_string(issues, ';') END,
 CASE WHEN len(violations) > 0 THEN 'security=' || array_to_string(violations, ';') END, unclear], lambda x: x IS NOT NULL), '; ') END AS reason, (CASE WHEN expected_behavior = 'refuse' THEN len(actual) = 0 ELSE expected = actual END) AND error IS NULL AS ordered_ok FROM z)"""
RATES = """count(*) AS cases, CAST(sum(CAST(passed::INT AS DECIMAL(18, 6))) AS DOUBLE) / count(passed::INT) AS pass_rate, CAST(sum(CAST(selection_ok::INT AS DECIMAL(18, 6))) AS DOUBLE) / count(selection_ok::INT) AS selection_rate, CAST(sum(CAST(arguments_ok::INT AS DECIMAL(18, 6))) AS DOUBLE) / count(arguments_ok::INT) AS argument_rate, CAST(sum(CAST(security_ok::INT AS DECIMAL(18, 6))) AS DOUBLE) / count(security_ok::INT) AS security_rate, CAST(sum(CAST(ordered::INT AS DECIMAL(18, 6))) AS DOUBLE) / count(ordered::INT) AS ordered_rate,
 CAST(sum(CAST((len(expected) = len(actual))::INT AS DECIMAL(18, 6))) AS DOUBLE) / count((len(expected) = len(actual))::INT) AS count_rate, count(*) FILTER (len(expected) > 1) AS multi_tool, CAST(sum(CAST(clarification_ok::INT AS DECIMAL(18, 6))) AS DOUBLE) / count(clarification_ok::INT) AS clarification_rate, CAST(sum(CAST(CASE WHEN len(expected) > 1 THEN correct::INT END AS DECIMAL(18, 6))) AS DOUBLE) / count(CASE WHEN len(expected) > 1 THEN correct::INT END) AS multi_tool_rate, CAST(sum(CAST(CASE WHEN len(expected) = 0 THEN (len(actual) = 0)::INT END AS DECIMAL(18, 6))) AS DOUBLE) / count(CASE WHEN len(expected) = 0 THEN (len(actual) = 0)::INT END) AS no_tool_rate"""
DIV = "CASE WHEN {b} > 0 THEN round({a} / ({b}), {n}) ELSE 0.0::DOUBLE END"
PAIRS = """pr AS (SELECT p_partkey, concat_ws(' ', p_name, p_type, p_brand, p_name) AS prediction, CASE WHEN p_partkey % 10 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN concat_ws(' ', p_name, lower(p_type), p_brand, p_name) ELSE concat_ws(' ', p_type, p_name, 'of', p_brand) END AS ground_truth, CASE WHEN p_partkey % 8 = 0 THEN 'failed' END AS error FROM part)"""



def _precision(n):
    """log of the share of the prediction's runs of n words that the reference holds, each once."""
    runs = lambda w: f"list_transform(range(1, greatest(len({w}) - {n - 2}, 1)), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))"
    return f"coalesce(list_sum(list_transform(list_distinct({runs('pw')}), lambda x: least(len(list_filter({runs('pw')}, lambda y: y = x)), len(list_filter({runs('gw')}, lambda y: y = x))))), 0) AS hits{n}, greatest(len(pw) - {n - 1}, 0) AS total{n}"


# The longest common subsequence, a word of the prediction a step: each cell is the largest of what the line above allows up to it.
SCORES = f"""wd AS (SELECT *, list_filter(regexp_split_to_array(lower(prediction), '\\s+'), lambda w: w <> '') AS pw, list_filter(regexp_split_to_array(lower(ground_truth), '\\s+'), lambda w: w <> '') AS gw,
 regexp_extract_all(lower(prediction), '[\\p{{L}}\\p{{N}}]+') AS pl, regexp_extract_all(lower(ground_truth), '[\\p{{L}}\\p{{N}}]+') AS gl FROM pr),
lc AS (SELECT p_partkey, pl, gl, 0 AS i, list_transform(gl, lambda w: 0) AS line FROM wd
 UNION ALL SELECT p_partkey, pl, gl, i + 1, list_transform(range(1, len(gl) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(line[k], CASE WHEN gl[k] = pl[i + 1] THEN CASE WHEN k > 1 THEN line[k - 1] ELSE 0 END + 1 ELSE 0 END)))) FROM lc WHERE i < len(pl) AND len(gl) > 0),
ll AS (SELECT p_partkey, max(line[len(gl)]) AS n FROM lc GROUP BY 1),
bl AS (SELECT wd.*, n, {_precision(1)}, {_precision(2)}, {_precision(3)}, {_precision(4)} FROM wd JOIN ll USING (p_partkey)),
ts AS (SELECT *, (replace(replace(lower(trim(prediction)), chr(10), ' '), '  ', ' ') = replace(replace(lower(trim(ground_truth)), chr(10), ' '), '  ', ' '))::INT::DOUBLE AS exact_match,
 CASE WHEN hits1 = 0 THEN 0.0::DOUBLE ELSE round(exp((CASE WHEN len(pw) >= len(gw) THEN 0 ELSE 1 - len(gw) / len(pw) END) + ({' + '.join(f'ln(greatest(hits{n}::DOUBLE, 0.1) / greatest(total{n}, 1))' for n in range(1, 5))}) / 4), 6) END AS bleu,
 CASE WHEN coalesce(n, 0) > 0 THEN round(2.0 * n / (len(pl) + len(gl)), 6) ELSE 0.0 END::DOUBLE AS rouge_l FROM bl)"""
RUNS = ("runs", "qrels", "products")
ORACLES = {
    "read_cases": """SELECT conv_id, turn, role, text, turn % 3 AS n, '} ], "\\' AS mark FROM conversations""",
    "rank_metrics": with_views(f"WITH {_per((3, 5, 10))} SELECT * FROM m", *RUNS),
    "retrieval_metrics": with_views(f"WITH {_per((3,), 'rank <= 3')} SELECT config, count(*) AS queries, CAST(sum(CAST(hit_3 AS DECIMAL(18, 6))) AS DOUBLE) / count(hit_3) AS hit, CAST(sum(CAST(mrr AS DECIMAL(18, 6))) AS DOUBLE) / count(mrr) AS mrr, CAST(sum(CAST(precision_3 AS DECIMAL(18, 6))) AS DOUBLE) / count(precision_3) AS precision, CAST(sum(CAST(recall_3 AS DECIMAL(18, 6))) AS DOUBLE) / count(recall_3) AS recall FROM m GROUP BY config", *RUNS),
    "relevance_grades": with_views("SELECT query_id, doc_id, grade FROM qrels WHERE grade > 0", "qrels"),
    "annotate_cases": with_views(f"WITH {CASES} SELECT query_id, query_type, evaluation_type, mismatch, needs_review, review_notes FROM ann", *RUNS),
    "filter_compliance": with_views("WITH " + COMPLY.replace("{c}", ", ".join(f"round(count(*) FILTER ({MEETS} AND rank <= {k}) / {k}, 6) AS compliance_{k}" for k in (3, 5, 10))) + " SELECT * FROM cm", *RUNS),
    "metadata_accuracy": with_views(f"WITH {EXPECTED}, {META} " + " UNION ALL ".join(f"SELECT '{f}' AS field, CAST(coalesce(sum(n_{f}), 0) AS BIGINT) AS checked, CAST(coalesce(sum(n_{f} * coalesce(c_{f}, 0)), 0) AS BIGINT) AS correct FROM mc" for f in META_FIELDS), "runs", "products"),
    "family_hit": with_views("WITH " + FAMILY.replace("{c}", ", ".join(FAMILY_AT.replace("{k}", str(k)) for k in (3, 10))) + " SELECT * FROM fam", *RUNS),
    "score_cases": with_views(f"WITH {SCORED} SELECT * FROM sc", *RUNS),
    "aggregate_cases": with_views(f"WITH {SCORED}, {SLICES} SELECT config, slice, name, count(*) AS cases, {', '.join(_mean(c, c) for c in I.MEANS)}, {_mean('passed::INT', 'pass_rate')}, CAST(sum(metadata_hits) AS DOUBLE) / nullif(sum(metadata_checked), 0) AS metadata_accuracy FROM sl GROUP BY 1, 2, 3", *RUNS),
    "operational_metrics": with_views("SELECT event AS config, CAST(sum(CAST((event_id % 3 = 0)::INT AS DECIMAL(18, 6))) AS DOUBLE) / count((event_id % 3 = 0)::INT) AS call_rate, CAST(sum(CAST(latency_ms AS DECIMAL(18, 6))) AS DOUBLE) / count(latency_ms) AS mean_ms, round(median(latency_ms), 6) AS median_ms, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round((sum(input_tokens) * 30 + sum(output_tokens) * 250) / 100000000, 6) AS cost_usd FROM log_events GROUP BY event", "log_events"),
    "failure_counts": with_views(f"WITH {SCORED} SELECT config, failure_reason, count(*) AS n FROM sc WHERE failure_reason IS NOT NULL GROUP BY 1, 2", *RUNS),
    "filter_violations": with_views(f"WITH {SCORED} SELECT config, count(*) FILTER (compliance_10 < 1) AS violations FROM sc GROUP BY 1", *RUNS),
    "config_comparison": with_views(f"WITH {SCORED}, a AS (SELECT config, CAST(sum(CAST(hit_10 AS DECIMAL(18, 6))) AS DOUBLE) / count(hit_10) AS hit_10, CAST(sum(CAST(mrr AS DECIMAL(18, 6))) AS DOUBLE) / count(mrr) AS mrr, CAST(sum(CAST(ndcg_10 AS DECIMAL(18, 6))) AS DOUBLE) / count(ndcg_10) AS ndcg_10 FROM sc GROUP BY 1) SELECT a.*, a.hit_10 < b.hit_10 OR a.mrr < b.mrr OR a.ndcg_10 < b.ndcg_10 AS regressed FROM a, a b WHERE b.config = 'a'", *RUNS),
    "run_diff": with_views(
        f"""WITH {SCORED}, df AS (SELECT query_id, x.query_type, x.mrr AS m0, y.mrr AS m1, x.compliance_10 AS c0, y.compliance_10 AS c1, coalesce(x.hit_10, 0) AS h0, coalesce(y.hit_10, 0) AS h1, coalesce(y.mrr, 0) > coalesce(x.mrr, 0) AS nearer FROM (SELECT * FROM sc WHERE config = 'a') x JOIN (SELECT * FROM sc WHERE config = 'b') y USING (query_id)
          WHERE x.query_type IN ('BRAND_CATEGORY', 'PERSIAN_VARIATION', 'COLLOQUIAL', 'PARTIAL_PRODUCT_NAME') OR x.failure_reason = 'METADATA_MISS'),
        z AS (SELECT *, h1 < h0 OR c1 + 1e-9 < c0 AND h1 <= h0 AS worse, h1 > h0 OR h1 = h0 AND nearer AS better FROM df)
        SELECT query_id, query_type, m0, m1, c0, c1, CASE WHEN worse THEN 'regressed' WHEN better THEN 'improved' ELSE 'unchanged' END AS change FROM z""",
        *RUNS,
    ),
    "candidate_recall": with_views("WITH g AS (SELECT * FROM deep_qrels WHERE grade > 0 AND length(query_id) % 2 = 0 AND query_id IN (SELECT query_id FROM deep_runs)), b AS (SELECT config, query_id, min(rank) AS best_rank FROM deep_runs JOIN g USING (query_id, doc_id) GROUP BY 1, 2), x AS (SELECT DISTINCT config FROM deep_runs), q AS (SELECT DISTINCT query_id FROM g) SELECT config, count(*) AS queries, " + ", ".join(_mean(f"coalesce(best_rank <= {k}, false)::INT", f"recall_{k}") for k in (20, 50, 100, 500)) + " FROM x CROSS JOIN q LEFT JOIN b USING (config, query_id) GROUP BY config", "deep_runs", "deep_qrels"),
    "rank_shift": with_views(f"WITH {BEST} SELECT query_id, a.best_rank, b.best_rank AS new_rank, CASE WHEN b.best_rank > a.best_rank THEN 'pushed_down' WHEN b.best_rank < a.best_rank THEN 'improved' ELSE 'unchanged' END AS shift FROM (SELECT * FROM best WHERE config = 'a') a JOIN (SELECT * FROM best WHERE config = 'b') b USING (query_id)", *RUNS),
    "text_scores": f"WITH RECURSIVE {PAIRS}, {SCORES} SELECT p_partkey, prediction, ground_truth, error, exact_match, bleu, rouge_l FROM ts",
    "summarize_scores": f"WITH RECURSIVE {PAIRS}, {SCORES} SELECT count(*) AS rows, CAST(sum(CAST(exact_match AS DECIMAL(18, 6))) AS DOUBLE) / count(exact_match) AS exact_match, CAST(sum(CAST(rouge_l AS DECIMAL(18, 6))) AS DOUBLE) / count(rouge_l) AS rouge_l FROM ts WHERE ground_truth <> '' AND error IS NULL",
    "valid_predictions": f"WITH {PAIRS} SELECT * FROM pr WHERE ground_truth <> '' AND error IS NULL",
    "set_rates": f"WITH {TOOLS} SELECT case_id, (len(list_intersect(actual, expected)) > 0)::INT::DOUBLE AS hit, CASE WHEN len(expected) > 0 THEN round(len(list_intersect(actual, expected)) / len(expected), 6) END AS recall, CASE WHEN len(actual) > 0 THEN round(len(list_intersect(actual, expected)) / len(actual), 6) ELSE 0.0::DOUBLE END AS precision FROM o",
    "tool_selection_micro": f"WITH {TOOLS}, u AS (SELECT count(*) AS cases, count(*) FILTER (expected = actual) AS exact, CAST(sum(len(list_intersect(actual, expected))) AS BIGINT) AS tp, CAST(sum(len(actual) - len(list_intersect(actual, expected))) AS BIGINT) AS fp, CAST(sum(len(expected) - len(list_intersect(actual, expected))) AS BIGINT) AS fn FROM o) SELECT *, {DIV.format(a='tp', b='tp + fp', n=6)} AS precision, {DIV.format(a='tp', b='tp + fn', n=6)} AS recall, {DIV.format(a='2 * tp', b='2 * tp + fp + fn', n=6)} AS f1 FROM u",
    "argument_match": """WITH m AS (SELECT o_orderkey AS n, CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS status FROM orders),
        w AS (SELECT *, CASE WHEN n % 2 = 0 AND n % 11 <> 0 THEN MAP {'order': key, 'status': status} END AS want_one, MAP {'order': CASE WHEN n % 3 = 0 THEN '<resolved_from_step_1>' ELSE key END, 'status': status} AS want,
              CASE WHEN n % 5 = 0 THEN MAP {'status': status} WHEN n % 7 = 0 THEN MAP {'order': 'none', 'status': status} WHEN n % 4 = 0 THEN MAP {'status': status, 'order': key} ELSE MAP {'order': key, 'status': status, 'more': '1'} END AS got FROM m),
        l AS (SELECT *, CASE WHEN n % 13 = 0 THEN [got, got] ELSE [got] END AS calls, CASE WHEN n % 2 = 1 AND n % 11 <> 0 THEN CASE WHEN n % 13 = 0 THEN [want, MAP {'status': status}] ELSE [want] END END AS wants FROM w)
        SELECT n AS case_id, CASE WHEN want_one IS NOT NULL THEN len(calls) = 1 AND list_sort(map_entries(calls[1])) = list_sort(map_entries(want_one))
               WHEN wants IS NOT NULL THEN len(calls) = len(wants) AND len(list_filter(range(1, len(wants) + 1), lambda i: len(list_filter(map_entries(wants[i]), lambda e: NOT CASE WHEN e.value LIKE '<resolved_from_step_%' THEN list_contains(map_keys(calls[i]), e.key) ELSE coalesce(calls[i][e.key] = e.value, false) END)) > 0)) = 0 END AS matched FROM l""",
    "confusion_matrix": f"WITH {TOOLS} SELECT expected[1] AS expected_intent, coalesce(actual[1], 'NONE') AS tool, count(*) AS n FROM o GROUP BY 1, 2",
    "guardrail_accuracy": f"WITH {TOOLS} SELECT expected_behavior, count(*) AS cases, CAST(sum(CAST((len(actual) = 0)::INT AS DECIMAL(18, 6))) AS DOUBLE) / count((len(actual) = 0)::INT) AS accuracy FROM o WHERE expected_behavior = 'OUT_OF_SCOPE' GROUP BY 1",
    "latency_percentiles": f"WITH {TOOLS}, l AS (SELECT suite, list_sort(list(latency_ms)) AS x FROM o GROUP BY 1) SELECT suite, len(x) AS n, round(list_avg(x), 2) AS mean, x[CAST(floor((len(x) - 1) * 0.5) AS INT) + 1] AS p50, x[CAST(floor((len(x) - 1) * 0.95) AS INT) + 1] AS p95, x[CAST(floor((len(x) - 1) * 0.99) AS INT) + 1] AS p99, list_min(x) AS least, list_max(x) AS most FROM l",
    "suite_report": f"WITH {TOOLS} SELECT suite, count(*) AS cases, count(*) FILTER (NOT ordered_ok) AS failed, CAST(sum(CAST(ordered_ok::INT AS DECIMAL(18, 6))) AS DOUBLE) / count(ordered_ok::INT) AS pass_rate FROM o GROUP BY 1",
    "ordered_verdicts": f"WITH {TOOLS} SELECT case_id, ordered_ok AS passed FROM o",
    "failed_report": f"WITH {TOOLS} SELECT case_id, passed, reason FROM o WHERE NOT passed",
    "tool_accuracy": f"WITH {TOOLS}, x AS (SELECT 'category' AS kind, coalesce(nullif(category, ''), 'unknown') AS name, ordered_ok AS ok FROM o UNION ALL SELECT 'tool', tool, list_contains(actual, tool) FROM (SELECT unnest(list_distinct(expected)) AS tool, actual FROM o)) SELECT kind, name, count(*) FILTER (ok) AS passed, count(*) AS total, round(100 * count(*) FILTER (ok) / count(*), 2) AS accuracy FROM x GROUP BY 1, 2",
    "rescore": f"WITH {TOOLS} SELECT {', '.join(FLAGS)} FROM o WHERE case_id % 4 <> 1",
    "tool_set_compare": f"WITH {TOOLS} SELECT case_id, missing, extra, ordered, correct FROM o",
    "argument_issues": f"WITH {TOOLS} SELECT case_id, issues FROM o",
    "score_tool_cases": f"WITH {TOOLS} SELECT {', '.join(FLAGS)} FROM o",
    "per_tool_prf": f"WITH {TOOLS}, x AS (SELECT expected, list_filter(actual, lambda x: list_contains(expected, x) OR NOT list_contains(optional, x)) AS acted FROM o), y AS (SELECT unnest(list_distinct(list_concat(expected, acted))) AS tool, expected, acted FROM x), w AS (SELECT tool, count(*) FILTER (list_contains(expected, tool) AND list_contains(acted, tool)) AS tp, count(*) FILTER (NOT list_contains(expected, tool)) AS fp, count(*) FILTER (NOT list_contains(acted, tool)) AS fn FROM y GROUP BY 1) SELECT *, {DIV.format(a='tp', b='tp + fp', n=4)} AS precision, {DIV.format(a='tp', b='tp + fn', n=4)} AS recall, {DIV.format(a='2 * tp', b='2 * tp + fp + fn', n=4)} AS f1 FROM w",
    "tool_eval_rollup": f"WITH {TOOLS} SELECT category, {RATES} FROM o GROUP BY ROLLUP (category)",
    "readiness_verdict": f"WITH {TOOLS}, r AS (SELECT {RATES} FROM o) SELECT cases, pass_rate, CASE WHEN security_rate < 1 THEN 'NEEDS ARCHITECTURE FIX' WHEN selection_rate >= 0.8 AND argument_rate >= 0.85 AND clarification_rate >= 0.6 AND coalesce(multi_tool_rate, 1) >= 0.5 AND coalesce(no_tool_rate, 1) >= 0.75 THEN 'READY' ELSE 'NEEDS PROMPT FIX' END AS verdict FROM r",
    "scope_audit": f"WITH {TOOLS} SELECT category AS tool, 2 * count(*) AS calls, count(*) FILTER (NOT context_ok) AS violations FROM o GROUP BY 1",
    "error_class": f"WITH {TOOLS} SELECT case_id, CASE WHEN error LIKE 'Connect%' THEN 'connection' WHEN error IS NOT NULL THEN 'other' END AS class FROM o",
}
