"""Evaluation of ranked retrieval: runs against judgements, all configurations in one pass.

A run is (config, query_id, doc_id, rank) and judgements are (query_id, doc_id, grade). Metrics are joins and grouped sums;
no query's list is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarspark.functions.columns import mean, values_at
from bazaarspark.operators import metadata as M


def _safe(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.round(a / b, 6))


def rank_metrics(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """For each query of a configuration: mrr, and at each k hit, precision over all, over judged ones, recall and NDCG.

    Recall is null without relevant documents. Judged precision divides by judged documents in the first k; it is 0 if none
    is judged though some are relevant, and null for an empty list. NDCG is over the judged documents, ranked anew, with gains
    2 ** grade - 1; it is null if none is judged.
    """
    judged = run.join(qrels, ["query_id", "doc_id"], "left")
    dense = Window.partitionBy("config", "query_id").orderBy("rank")
    rows = judged.withColumn("nth", F.when(F.col("grade").isNotNull(), F.count("grade").over(dense)))
    good = F.col("grade") > 0
    relevant = qrels.where("grade > 0").groupBy("query_id").agg(F.count("*").alias("relevant"))
    ideal = qrels.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")))
    gain = lambda g, i: (F.pow(F.lit(2.0), g) - 1) / F.log2(i + 1.0)
    best = ideal.groupBy("query_id").agg(*[F.sum(F.when(F.col("i") <= k, gain(F.col("grade"), F.col("i")))).alias(f"ideal{k}") for k in ks])
    parts = [F.min(F.when(good, F.col("rank"))).alias("first"), F.count("*").alias("retrieved")]
    for k in ks:
        at = F.col("rank") <= k
        parts += [
            F.count_if(at).alias(f"n{k}"),
            F.count_if(at & good).alias(f"good{k}"),
            F.count_if(at & F.col("grade").isNotNull()).alias(f"judged{k}"),
            F.sum(F.when(F.col("nth") <= k, gain(F.col("grade"), F.col("nth")))).alias(f"dcg{k}"),
        ]
    per = rows.groupBy("config", "query_id").agg(*parts).join(relevant, "query_id", "left").join(best, "query_id", "left")
    out = [F.col("config"), F.col("query_id"), F.col("retrieved"), F.coalesce("relevant", F.lit(0)).alias("relevant"), F.coalesce(F.round(1 / F.col("first"), 6), F.lit(0.0)).alias("mrr")]
    for k in ks:
        good_k, judged_k = F.col(f"good{k}"), F.col(f"judged{k}")
        out += [
            (good_k > 0).cast("double").alias(f"hit_{k}"),
            _safe(good_k, F.col(f"n{k}")).alias(f"precision_{k}"),
            F.when(judged_k > 0, F.round(good_k / judged_k, 6)).when(F.col("relevant") > 0, 0.0).alias(f"judged_precision_{k}"),
            _safe(good_k, F.col("relevant")).alias(f"recall_{k}"),
            _safe(F.col(f"dcg{k}"), F.col(f"ideal{k}")).alias(f"ndcg_{k}"),
        ]
    return per.select(*out)


def retrieval_metrics(run: DataFrame, qrels: DataFrame, k: int = 3) -> DataFrame:
    """One row for each configuration: queries and mean hit, reciprocal rank, precision and recall in the first k."""
    m = rank_metrics(run.where(F.col("rank") <= k), qrels, (k,))
    return m.groupBy("config").agg(F.count("*").alias("queries"), *[mean(a).alias(b) for a, b in ((f"hit_{k}", "hit"), ("mrr", "mrr"), (f"precision_{k}", "precision"), (f"recall_{k}", "recall"))])


def relevance_grades(cases: DataFrame) -> DataFrame:
    """(query_id, gold array, grades map) as judgements: positive grades, else gold documents at 3."""
    graded = F.map_filter("grades", lambda _, g: g > 0)
    has = F.coalesce(F.size(graded), F.lit(0)) > 0
    entries = F.when(has, F.transform(F.map_entries(graded), lambda e: F.struct(e["key"].alias("doc_id"), e["value"].alias("grade")))).otherwise(F.transform("gold", lambda g: F.struct(g.alias("doc_id"), F.lit(3.0).alias("grade"))))
    return cases.select("query_id", F.inline(entries))


# Query types and how they are judged, the types that comparisons of runs look at, and notes of a review.
BROAD = ["BRAND", "CATEGORY", "GENDER_FILTER", "PRICE_FILTER", "AVAILABILITY_FILTER", "MULTI_ATTRIBUTE"]
NARROW = ["DIRECT_PRODUCT", "BRAND_CATEGORY", "ATTRIBUTE", "PARTIAL_PRODUCT_NAME", "COLLOQUIAL", "PERSIAN_VARIATION"]
SPECIAL = ["AMBIGUOUS", "NO_RESULT", "OUT_OF_SCOPE", "NEGATIVE_CONSTRAINT"]
FOCUS = ["BRAND_CATEGORY", "PERSIAN_VARIATION", "COLLOQUIAL", "PARTIAL_PRODUCT_NAME"]
MISSPELLED = "تریا|دیفاکتو"
LARGE_NOTE = "large gold set treated as judged relevance, not exhaustive recall"
DIFFER_NOTE = "relevance keys and expected_product_codes differ; relevance used as judged set"
#: Gold documents from which a query counts as broad.
MANY = 20


def annotate_cases(cases: DataFrame) -> DataFrame:
    """Adds evaluation_type (special, broad, narrow), whether gold and grades name different documents (``mismatch``), and what a reviewer
    should look at: needs_review and review_notes, null without any."""
    kind = F.col("query_type")
    large = F.size("gold") >= MANY
    judged = F.when(kind.isin(*SPECIAL), "special").when(kind.isin(*BROAD) | large, "broad").when(kind.isin(*NARROW), "narrow").when(F.size("gold") > 0, "broad").otherwise("special")
    named = F.coalesce(F.map_keys("grades"), F.array().cast(cases.schema["gold"].dataType))
    differ = (F.size("gold") > 0) & (F.size(named) > 0) & (F.size(F.array_except("gold", named)) + F.size(F.array_except(named, "gold")) > 0)
    notes = F.array_compact(F.array(F.when(kind.isin(*NARROW) & large, F.lit(LARGE_NOTE)), F.when(differ, F.lit(DIFFER_NOTE))))
    asked = F.coalesce(F.col("needs_review"), F.lit(False)) if "needs_review" in cases.columns else F.lit(False)
    return cases.withColumns({"evaluation_type": judged, "mismatch": differ, "needs_review": (F.size(notes) > 0) | asked, "review_notes": F.nullif(F.array_join(notes, "; "), F.lit(""))})


#: Expected filters of a case; columns that a table of expectations lacks set none.
FILTERS = {"brand": "string", "category": "string", "color": "string", "gender": "string", "price_max": "double", "price_min": "double", "available": "boolean", "exclude_brand": "string", "product_name_contains": "string"}


def expected_filters(expected: DataFrame, prefix: str = "_") -> DataFrame:
    """(query_id, filters): all nine filters under prefixed names; blank texts set none."""
    cols = {f: (F.col(f).cast(t) if f in expected.columns else F.lit(None).cast(t)) for f, t in FILTERS.items()}
    return expected.select("query_id", *[(F.when(F.length(c) > 0, c) if FILTERS[f] == "string" else c).alias(prefix + f) for f, c in cols.items()])


def _part_of(text: str, part: Column) -> Column:
    return F.contains(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lower(part))


def item_matches_filters(prefix: str = "_") -> Column:
    """Whether a product meets the expected filters of its row. Products have product_name, brand, type, category_level1,
    category_level2, color, gender, price and last_status."""
    want = lambda f: F.col(prefix + f)
    meets = lambda f, cond: want(f).isNull() | F.coalesce(cond, F.lit(False))
    category = _part_of("type", want("category")) | _part_of("category_level1", want("category")) | _part_of("category_level2", want("category")) | _part_of("product_name", want("category"))
    return (
        meets("brand", M.same_brand(F.col("brand"), want("brand")))
        & meets("category", category)
        & meets("color", _part_of("color", want("color")))
        & meets("gender", _part_of("gender", want("gender")))
        & meets("price_max", F.col("price") <= want("price_max"))
        & meets("price_min", F.col("price") >= want("price_min"))
        & (~F.coalesce(want("available"), F.lit(False)) | F.coalesce(F.col("last_status") == "Enable", F.lit(False)))
        & (want("exclude_brand").isNull() | ~F.coalesce(M.same_brand(F.col("brand"), want("exclude_brand")), F.lit(False)))
        & meets("product_name_contains", _part_of("product_name", want("product_name_contains")))
    )


def has_filters(prefix: str = "_") -> Column:
    found = F.lit(False)
    for f in FILTERS:
        found = found | F.col(prefix + f).isNotNull()
    return found


def filter_compliance(run: DataFrame, expected: DataFrame, items: DataFrame, ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """Share of the first k places held by products that meet the expected filters (see ``FILTERS``).

    It divides by k and not by the length of the list; a query without filters has null, an empty list 0.
    """
    rows = run.join(items, "doc_id").join(expected_filters(expected), "query_id")
    per = rows.groupBy("config", "query_id").agg(F.max(has_filters()).alias("f"), *[F.count_if(item_matches_filters() & (F.col("rank") <= k)).alias(f"n{k}") for k in ks])
    return per.select("config", "query_id", *[F.when(F.col("f"), F.round(F.col(f"n{k}") / k, 6)).alias(f"compliance_{k}") for k in ks])


def metadata_checks() -> dict[str, tuple[Column, Column]]:
    """By field: whether an expected filter (prefix ``_``) asks for it, and whether what was extracted (prefix ``x_``) is right: any spelling
    of a brand, a category that holds the other, a gender that holds the expected one, prices less than 1 apart."""
    want, got = (lambda f: F.col("_" + f)), (lambda f: F.col("x_" + f))
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    near = lambda f: F.abs(got(f).cast("double") - want(f)) < 1
    either = (F.length(got("category")) > 0) & (F.contains(low(got("category")), low(want("category"))) | F.contains(low(want("category")), low(got("category"))))
    excluded = F.exists(F.coalesce(got("exclude_brands"), F.array().cast("array<string>")), lambda b: F.coalesce(M.same_brand(b, want("exclude_brand")), F.lit(False)))
    given = lambda f: want(f).isNotNull()
    return {
        "brand": (given("brand"), M.same_brand(got("brand"), want("brand"))),
        "category": (given("category"), either),
        "gender": (given("gender"), F.contains(low(got("gender")), low(want("gender")))),
        "color": (given("color"), low(got("color")) == low(want("color"))),
        "price_max": (given("price_max"), near("price_max")),
        "price_min": (given("price_min"), near("price_min")),
        "availability": (F.coalesce(want("available"), F.lit(False)), got("availability")),
        "exclude_brand": (given("exclude_brand"), excluded),
    }


EXTRACTED = ["brand", "category", "gender", "color", "price_max", "price_min", "availability", "exclude_brands"]


def _checked(extracted: DataFrame, expected: DataFrame) -> DataFrame:
    """One row a query: (checked, correct) of each field as ``n_`` and ``c_`` columns of 0 and 1."""
    both = expected_filters(expected).join(extracted.select("query_id", *[F.col(f).alias("x_" + f) for f in EXTRACTED]), "query_id", "left")
    as_int = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    return both.select("query_id", *[x for f, (asked, right) in metadata_checks().items() for x in (as_int(asked).alias("n_" + f), as_int(asked & right).alias("c_" + f))])


def metadata_hits(extracted: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, metadata_checked, metadata_hits): fields that are expected, and how many of them were extracted right."""
    sums = lambda p: sum((F.col(p + f) for f in metadata_checks()), F.lit(0).cast("long"))
    return _checked(extracted, expected).select("query_id", sums("n_").alias("metadata_checked"), sums("c_").alias("metadata_hits"))


def metadata_accuracy(extracted: DataFrame, expected: DataFrame) -> DataFrame:
    """(field, checked, correct) over all queries; extracted metadata as :func:`metadata_checks` takes it."""
    fields = list(metadata_checks())
    sums = _checked(extracted, expected).agg(*[F.coalesce(F.sum(p + f), F.lit(0)).alias(p + f) for f in fields for p in ("n_", "c_")])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col("n_" + f).alias("checked"), F.col("c_" + f).alias("correct")) for f in fields])))


def family_hit(run: DataFrame, qrels: DataFrame, items: DataFrame, ks: tuple[int, ...] = (3, 10)) -> DataFrame:
    """Whether a product of a gold product's family (canonical brand and type) is among the first k; null if no gold product has one.
    A product without brand or type has no family."""
    family = items.select("doc_id", M.canonical_brand(F.coalesce("brand", F.lit(""))).alias("b"), F.trim(F.lower("type")).alias("t")).where("b <> '' and t <> ''")
    gold = qrels.where("grade > 0").join(family, "doc_id").select("query_id", "b", "t").distinct()
    first = run.join(family, "doc_id").join(gold, ["query_id", "b", "t"], "left_semi").groupBy("config", "query_id").agg(F.min("rank").alias("first"))
    every = run.select("config", "query_id").distinct().join(gold.select("query_id", F.lit(True).alias("has")).distinct(), "query_id", "left")
    hit = lambda k: F.when(F.col("has"), F.coalesce(F.col("first") <= k, F.lit(False)).cast("double"))
    return every.join(first, ["config", "query_id"], "left").select("config", "query_id", *[hit(k).alias(f"family_hit_{k}") for k in ks])


KS = (3, 5, 10)


def score_cases(run: DataFrame, qrels: DataFrame, cases: DataFrame, expected: DataFrame, items: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """One wide row for each configuration and case, found or not, with verdict and failure reason.

    Ranking is judged where there are relevant documents and the case isn't special, recall only where these are all that is relevant
    (narrow, less than ``MANY``). ``extracted`` is the metadata read from the queries. Cases may tell by ``query`` what was asked and by
    ``understanding_used`` and ``rerank_used`` whether a model read or ranked it.
    """
    found = rank_metrics(run, qrels, KS).drop("relevant")
    relevant = qrels.where("grade > 0").groupBy("query_id").agg(F.count("*").alias("relevant"))
    met = filter_compliance(run, expected, items, KS).withColumnsRenamed({f"compliance_{k}": f"_c{k}" for k in KS})
    filtered = expected_filters(expected).select("query_id", has_filters().alias("filtered"))
    hits = expected_filters(expected).select("query_id", F.lit(0).cast("long").alias("metadata_checked"), F.lit(0).cast("long").alias("metadata_hits")) if extracted is None else metadata_hits(extracted, expected)
    every = cases.crossJoin(F.broadcast(run.select("config").distinct()))  # a few configurations
    key = ["config", "query_id"]
    rows = every.join(found, key, "left").join(met, key, "left").join(family_hit(run, qrels, items, KS), key, "left")
    rows = rows.join(relevant, "query_id", "left").join(filtered, "query_id", "left").join(hits, "query_id", "left")
    rows = rows.fillna(0, ["retrieved", "relevant", "metadata_checked", "metadata_hits"]).fillna(False, ["filtered"])
    judged = (F.col("relevant") > 0) & (F.col("evaluation_type") != "special")
    all_known = judged & (F.col("evaluation_type") == "narrow") & (F.col("relevant") < MANY)
    nothing = F.lit(0.0)
    rows = rows.withColumn("found", F.col("mrr") > 0)
    rows = rows.withColumns(
        {"mrr": F.when(judged, F.coalesce("mrr", nothing))}
        | {f"hit_{k}": F.when(judged, F.coalesce(f"hit_{k}", nothing)) for k in KS}
        | {f"recall_{k}": F.when(all_known, F.coalesce(f"recall_{k}", nothing)) for k in KS}
        | {f"{c}_{k}": F.when(judged, F.col(f"{c}_{k}")) for c in ("precision", "judged_precision", "ndcg", "family_hit") for k in KS}
        | {f"compliance_{k}": F.when(F.col("filtered"), F.coalesce(f"_c{k}", nothing)) for k in KS}
        | {"metadata_correct": F.when(F.col("metadata_checked") > 0, F.col("metadata_checked") == F.col("metadata_hits"))}
    ).drop(*[f"_c{k}" for k in KS])
    empty = F.col("expected_behavior").isin("NO_RESULTS", "OUT_OF_SCOPE")
    passed = (
        F.when((F.col("evaluation_type") == "broad") & F.col("filtered"), F.col("compliance_10") >= 1)
        .when((F.col("evaluation_type") == "narrow") & (F.col("relevant") > 0), F.col("hit_10") >= 1)
        .when(empty, F.col("retrieved") == 0)
        .when(F.col("expected_behavior") == "RETURN_RESULTS", F.col("retrieved") > 0)
        .otherwise(True)
    )
    used = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in cases.columns else F.lit(False)
    asked = F.col("query") if "query" in cases.columns else F.lit("")
    reason = (
        F.when(passed, F.lit(None))
        .when(F.col("query_type") == "NEGATIVE_CONSTRAINT", "NEGATIVE_CONSTRAINT")
        .when((F.col("query_type") == "PERSIAN_VARIATION") & F.coalesce(asked.rlike(MISSPELLED), F.lit(False)), "TYPO_VARIATION")
        .when(F.col("query_type").isin("NO_RESULT", "OUT_OF_SCOPE"), F.when(F.col("retrieved") > 0, "NO_CATALOG_MATCH").otherwise("NO_RESULT"))
        .when(~F.coalesce("metadata_correct", F.lit(True)), F.when(used("understanding_used"), "QUERY_UNDERSTANDING_MISS").otherwise("METADATA_MISS"))
        .when(F.col("filtered") & (F.col("compliance_10") < 1), "FILTER_MISS")
        .when(F.col("retrieved") == 0, "NO_CATALOG_MATCH")
        .when(F.coalesce("found", F.lit(False)), "RANKING_MISS")
        .when((F.col("evaluation_type") == "narrow") | (F.col("relevant") > 0), F.when(used("rerank_used"), "LLM_RANKING_MISS").otherwise("RANKING_MISS"))
        .when(F.col("filtered"), "METADATA_MISS")
        .otherwise("OTHER")
    )
    return rows.withColumns({"passed": passed, "failure_reason": reason}).drop("found", "filtered")


MEANS = ["mrr", *[f"{c}_{k}" for c in ("hit", "judged_precision", "recall", "ndcg", "family_hit", "compliance") for k in KS]]


def aggregate_cases(scored: DataFrame) -> DataFrame:
    """(config, slice, name): means over all cases, by query type, by evaluation type and over the types in focus, among which are the
    cases that failed by METADATA_MISS. ``metadata_accuracy`` is over fields and not over cases."""
    part = lambda kind, name: F.struct(F.lit(kind).alias("slice"), name.alias("name"))
    kind = F.coalesce("query_type", F.lit("unknown"))
    parts = F.array(part("all", F.lit("")), part("query_type", kind), part("evaluation_type", F.col("evaluation_type")), F.when(kind.isin(*FOCUS), part("focus", kind)), F.when(F.col("failure_reason") == "METADATA_MISS", part("focus", F.lit("METADATA_MISS"))))
    rows = scored.select("config", F.explode(F.array_compact(parts)).alias("_p"), "passed", "metadata_hits", "metadata_checked", *MEANS)
    return rows.groupBy("config", F.col("_p.slice").alias("slice"), F.col("_p.name").alias("name")).agg(
        F.count("*").alias("cases"), *[mean(c).alias(c) for c in MEANS], mean(F.col("passed").cast("double")).alias("pass_rate"), (F.sum("metadata_hits") / F.nullif(F.sum("metadata_checked"), F.lit(0))).alias("metadata_accuracy")
    )


def operational_metrics(scored: DataFrame, price_in: float = 0.30, price_out: float = 2.50) -> DataFrame:
    """By configuration: share of model calls, mean and median latency, tokens and cost in USD."""
    cost = (F.sum("input_tokens").cast("decimal(20,0)") * F.lit(str(price_in)).cast("decimal(10,4)") + F.sum("output_tokens").cast("decimal(20,0)") * F.lit(str(price_out)).cast("decimal(10,4)")) / 1_000_000
    sums = scored.groupBy("config").agg(mean(F.col("called").cast("double")).alias("call_rate"), mean("latency_ms").alias("mean_ms"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(cost, 6).cast("double").alias("cost_usd"))
    middle = values_at(scored, "config", "latency_ms", {"lower": lambda n: F.floor((n - 1) / 2), "upper": lambda n: F.ceil((n - 1) / 2)})
    median = middle.groupBy(F.col("config").alias("_config")).agg(F.round(F.avg("x"), 6).alias("median_ms"))
    return sums.join(median, F.col("config").eqNullSafe(F.col("_config")), "left").select("config", "call_rate", "mean_ms", "median_ms", "input_tokens", "output_tokens", "cost_usd")


def failure_counts(scored: DataFrame) -> DataFrame:
    return scored.where("failure_reason is not null").groupBy("config", "failure_reason").agg(F.count("*").alias("n"))


def filter_violations(scored: DataFrame) -> DataFrame:
    return scored.groupBy("config").agg(F.count_if(F.col("compliance_10") < 1).alias("violations"))


def config_comparison(scored: DataFrame, baseline: str) -> DataFrame:
    """By configuration: means, and whether any is under the baseline's."""
    per = scored.groupBy("config").agg(*[mean(c).alias(c) for c in ("hit_10", "mrr", "ndcg_10")])
    base = per.where(F.col("config") == baseline).select(*[F.col(c).alias("b_" + c) for c in ("hit_10", "mrr", "ndcg_10")])
    worse = (F.col("hit_10") < F.col("b_hit_10")) | (F.col("mrr") < F.col("b_mrr")) | (F.col("ndcg_10") < F.col("b_ndcg_10"))
    return per.crossJoin(base).select("config", "hit_10", "mrr", "ndcg_10", F.coalesce(worse, F.lit(False)).alias("regressed"))


def run_diff(base: DataFrame, other: DataFrame) -> DataFrame:
    """Cases in focus of two scored runs as improved, regressed or unchanged. In focus are the types of ``FOCUS`` in either run and cases
    that failed by METADATA_MISS in the first. Improved: a hit more, or the same hit at a better rank, and nothing worse. Regressed: a hit
    less, or filters met less often without a hit more. Missing values count as 0, a missing compliance as no change."""
    columns = ["query_type", "failure_reason", "hit_10", "mrr", "compliance_10"]
    side = lambda df, n: df.select("query_id", *[F.col(c).alias(c + n) for c in columns])
    rows = side(base, "_0").join(side(other, "_1"), "query_id")
    rows = rows.where(F.col("query_type_0").isin(*FOCUS) | (F.coalesce("failure_reason_0", F.lit("")) == "METADATA_MISS") | F.col("query_type_1").isin(*FOCUS))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    more, same = zero("hit_10_1") > zero("hit_10_0"), zero("hit_10_1") == zero("hit_10_0")
    better = more | same & (zero("mrr_1") > zero("mrr_0"))
    worse = ~more & ~same | F.coalesce(F.col("compliance_10_1") + 1e-9 < F.col("compliance_10_0"), F.lit(False)) & ~more
    change = F.when(better & ~worse, "improved").when(worse, "regressed").otherwise("unchanged")
    return rows.select("query_id", F.col("query_type_0").alias("query_type"), F.col("mrr_0").alias("m0"), F.col("mrr_1").alias("m1"), F.col("compliance_10_0").alias("c0"), F.col("compliance_10_1").alias("c1"), change.alias("change"))


def candidate_recall(run: DataFrame, qrels: DataFrame, narrow: DataFrame | None = None, ks: tuple[int, ...] = (20, 50, 100, 500)) -> DataFrame:
    """By configuration: share of judged queries, of ``narrow`` (query_id) only if given, with a gold document among the first k."""
    gold = qrels.where("grade > 0")
    gold = gold if narrow is None else gold.join(narrow.select("query_id").distinct(), "query_id", "left_semi")
    first = run.join(gold, ["query_id", "doc_id"]).groupBy("config", "query_id").agg(F.min("rank").alias("first"))
    every = run.select("config").distinct().crossJoin(gold.select("query_id").distinct())
    rows = every.join(first, ["config", "query_id"], "left")
    return rows.groupBy("config").agg(F.count("*").alias("queries"), *[mean(F.coalesce(F.col("first") <= k, F.lit(False)).cast("double")).alias(f"recall_{k}") for k in ks])


def filter_exclusions(pairs: DataFrame) -> DataFrame:
    """Adds ``exclusions``: which of a query's extracted filters a gold product fails, in a fixed order.

    Rows hold a product (as in :func:`item_matches_filters`) and the query's metadata under the prefix ``q_``, with
    ``q_exclude_brands`` as an array.
    """
    q = lambda c: F.col("q_" + c)
    fails = lambda f, cond: F.when(q(f).isNotNull() & ~F.coalesce(cond, F.lit(False)), F.lit(f))
    category = _part_of("type", q("category")) | _part_of("category_level1", q("category")) | _part_of("category_level2", q("category"))
    excluded = F.exists(F.coalesce(q("exclude_brands"), F.array().cast("array<string>")), lambda b: F.coalesce(M.same_brand(F.col("brand"), b), F.lit(False)))
    reasons = [
        fails("brand", M.same_brand(F.col("brand"), q("brand"))),
        fails("category", category),
        fails("color", _part_of("color", q("color"))),
        fails("gender", _part_of("gender", q("gender"))),
        fails("price_min", F.col("price") >= q("price_min")),
        fails("price_max", F.col("price") <= q("price_max")),
        F.when(F.coalesce(q("availability"), F.lit(False)) & ~F.coalesce(F.col("last_status") == "Enable", F.lit(False)), F.lit("availability")),
        F.when(excluded, F.lit("exclude_brand")),
    ]
    return pairs.withColumn("exclusions", F.array_compact(F.array(*reasons)))


def narrow_facts(cases: DataFrame, gold: DataFrame, catalog: DataFrame, filtered: DataFrame) -> DataFrame:
    """What :func:`classify_narrow` asks of each case: gold products in the catalog, meeting the expected filters, found by the
    query's conditions, failing its extracted filters, and ranked, with the best rank of a gold product.

    ``cases`` hold query_id, the extracted metadata (prefix ``q_``) and the expected filters (prefix ``_``); ``gold`` is (query_id,
    product_code); ``filtered`` is (query_id, product_code, rank) of what passes a query's conditions, rank null beyond the list.
    """
    pairs = gold.join(catalog, "product_code", "left").withColumn("known", F.col("enabled").isNotNull()).join(cases, "query_id")
    found = filtered.select("query_id", "product_code", "rank", F.lit(True).alias("passes"))
    rows = filter_exclusions(pairs).join(found, ["query_id", "product_code"], "left")
    meets = ~has_filters() | item_matches_filters()
    sums = rows.groupBy("query_id").agg(
        F.count_if("known").alias("gold_in_catalog"),
        F.count_if(F.col("known") & meets).alias("gold_meets_filters"),
        F.count_if(F.coalesce("passes", F.lit(False))).alias("gold_filtered"),
        F.count_if(F.col("known") & meets & (F.size("exclusions") > 0)).alias("gold_excluded"),
        F.min("rank").alias("best_rank"),
        F.count("*").alias("gold"),
        F.count("rank").alias("gold_ranked"),
    )
    zeros = {c: F.coalesce(c, F.lit(0)) for c in ("gold_in_catalog", "gold_meets_filters", "gold_filtered", "gold_excluded", "gold", "gold_ranked")}
    return cases.select("query_id").join(sums, "query_id", "left").withColumns(zeros)


def classify_narrow(facts: DataFrame) -> DataFrame:
    """Facts of a case (:func:`narrow_facts`) as the first cause of its failure; null if a gold product is among the first ten."""
    cause = (
        F.when(F.col("gold_in_catalog") == 0, "NO_CATALOG_MATCH")
        .when(F.col("gold_meets_filters") == 0, "DATA/GOLD_ISSUE")
        .when((F.col("gold_filtered") == 0) & (F.col("gold_excluded") > 0), "FILTER_FAILURE")
        .when(F.col("gold_filtered") == 0, "CANDIDATE_GENERATION_FAILURE")
        .when(F.col("best_rank").isNull() | (F.col("best_rank") > 10), "RANKING_FAILURE")
    )
    return facts.withColumn("failure_class", cause)


def diagnostic_rollup(diag: DataFrame) -> DataFrame:
    """Over all cases with gold products (query_type null) and by query type: how often some gold product passed the conditions, came among
    the first 20 to 500 and 3 to 10, the mean reciprocal rank and NDCG of the first ten that are judged, failed cases and those of them
    whose gold had passed, and failures by class with the most frequent one (ties: the first by name). A failed case without a class is
    UNCLASSIFIED_FAIL over all, and no class by type."""
    hit = lambda k: F.coalesce(F.col("best_rank") <= k, F.lit(False)).cast("double")
    gain = lambda c: F.aggregate(F.sequence(F.lit(1), F.least(c, F.lit(10)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    # Gold documents have one grade, so that gains cancel out.
    ndcg = F.when(F.col("gold_ranked") > 0, gain(F.col("gold_ranked")) / gain(F.col("gold")))
    failed = F.coalesce(F.col("best_rank") > 10, F.lit(True))
    rows = diag.where("gold > 0").withColumns({"failed": failed, "passed_conditions": F.col("gold_filtered") > 0, "ndcg_10": F.when(F.col("gold_ranked") > 0, ndcg)})
    rows = rows.select("*", F.explode(F.array(F.lit(None).cast("string"), F.coalesce("query_type", F.lit("unknown")))).alias("by"))
    named = F.when(F.col("failure_class").isNotNull(), F.col("failure_class")).when(F.col("by").isNull() & F.col("failed"), "UNCLASSIFIED_FAIL")
    counts = rows.withColumn("class", named).where("class is not null").groupBy("by", "class").agg(F.count("*").alias("n"))
    top = counts.groupBy(F.col("by").alias("_by")).agg(F.min(F.struct((-F.col("n")).alias("n"), "class")).alias("t"), F.array_sort(F.collect_list(F.struct("class", "n"))).alias("classes"))
    sums = rows.groupBy("by").agg(
        F.count("*").alias("cases"),
        mean(F.col("passed_conditions").cast("double")).alias("gold_passed"),
        *[mean(hit(k)).alias(f"candidate_recall_{k}") for k in (20, 50, 100, 500)],
        *[mean(hit(k)).alias(f"hit_{k}") for k in KS],
        mean(F.coalesce(1 / F.col("best_rank"), F.lit(0.0))).alias("mrr"),
        mean("ndcg_10").alias("ndcg_10"),
        F.count_if("failed").alias("failed"),
        F.count_if(F.col("failed") & F.col("passed_conditions")).alias("failed_gold_passed"),
    )
    listed = F.array_join(F.transform("classes", lambda c: F.concat(c["class"], F.lit("="), c["n"])), ",")
    out = sums.join(top, F.col("by").eqNullSafe(F.col("_by")), "left").withColumns({"top_failure": F.col("t.class"), "top_n": -F.col("t.n"), "classes": listed, "failed_gold_share": F.round(F.col("failed_gold_passed") / F.nullif(F.col("failed"), F.lit(0)), 6)})
    return out.withColumnRenamed("by", "query_type").drop("t", "_by")


def rank_shift(base: DataFrame, other: DataFrame) -> DataFrame:
    """Gold ranks of two runs (query_id, best_rank): removed, pushed_down, improved or unchanged."""
    o = other.select("query_id", F.col("best_rank").alias("new_rank"))
    shift = F.when(F.col("best_rank").isNotNull() & F.col("new_rank").isNull(), "removed").when(F.col("new_rank") > F.col("best_rank"), "pushed_down").when((F.col("new_rank") < F.col("best_rank")) | F.col("best_rank").isNull() & F.col("new_rank").isNotNull(), "improved").otherwise("unchanged")
    return base.select("query_id", "best_rank").join(o, "query_id").withColumn("shift", shift)
