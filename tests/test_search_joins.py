"""Product search meets only products that share a condition's rare keys, and its plans hold no whole pool."""

import random

import pytest
from pyspark.sql import functions as F

from bazaarspark.operators import search as S
from bazaarspark.plans import search_queries as Q

QUERY = "query_id string, rank_query string, terms array<string>, tokens array<string>, brand string, brand_keys array<string>, exclude_keys array<string>, category string, color string, material string, gender string, price_min double, price_max double, availability boolean"
PRODUCT = "product_code string, product_name string, brand string, type string, sku string, category_level1 string, category_level2 string, last_status string, sum_of_price string, color string, gender string"


def catalog_of(spark, rng, n, third=False):
    words = ["red", "hair", "hand", "cream", "mask", "ab", "x", "sun", "lip", "stick"]
    rows = []
    for i in range(n):
        brand = "Main" if third and rng.random() < 1 / 3 else rng.choice([" Alpha", "beta", "Gamma ", None, "Main"])
        price = rng.choice([None, "", str(rng.randint(1, 999)), f"{rng.randint(1, 99)}.5 T"])
        rows.append((f"p{i}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 5))) or None, brand, rng.choice(["hair cream", "Mask", None, "xy"]), rng.choice([f"S{i}", None]), rng.choice(words), rng.choice(words), rng.choice(["Enable", "Disable", None]), price, rng.choice(["Red", "dark red", None, "x"]), rng.choice(["women", "men", None])))
    return S.catalog_view(spark.createDataFrame(rows, PRODUCT))


def queries_of(spark, rng, n):
    rows = []
    some = lambda p, *values: rng.choice(values) if rng.random() < p else None
    for i in range(n):
        brand = some(0.3, "Alpha", "Main", "unknown")
        keys = {"Alpha": ["alpha", "beta"], "Main": ["main"], "unknown": ["none"]}.get(brand, [])
        terms = rng.choice([[], [], ["red"], ["Hair", "mask"], ["ab"], ["x"], ["nothing"], ["cream", "x", "red"]])
        low, high = some(0.3, 5.0, 100.0, 2_000.0), some(0.3, 50.0, 500.0, 1.0)
        rows.append((f"q{i}", rng.choice(["red", " "]), terms, terms, brand, keys, rng.choice([[], [], ["main"], ["gamma", "beta"]]), some(0.2, "hair", "Mask", "xy"), some(0.2, "red", "x", "RED"), some(0.1, "cream", "ab"), some(0.2, "men", "w"), low, high, some(0.3, True, False)))
    return spark.createDataFrame(rows, QUERY)


@pytest.mark.parametrize("seed,cut", [(1, None), (2, 5), (3, 5)])
def test_pairs_equal_those_of_all_pairs(spark, monkeypatch, seed, cut):
    if cut:
        for name in ("PRODUCTS", "CONDITIONS", "FREQUENT"):
            monkeypatch.setattr(S, name, cut)
    rng = random.Random(seed)
    catalog, queries = catalog_of(spark, rng, 150, seed == 3), queries_of(spark, rng, 300)
    asked = S.drop_empty_queries(queries).withColumn("positive", S._positive())
    every = asked.select(*[F.col(c).alias("q_" + c) for c in asked.columns]).crossJoin(catalog).where(S._matches())
    pair = lambda df: sorted((r["q_query_id"], r["product_code"]) for r in df.select("q_query_id", "product_code").collect())
    got = S.hard_filters(queries, catalog)
    assert pair(got) == pair(every)
    assert set(got.columns) == set(every.columns)


def test_a_brand_with_a_third_of_the_catalog_is_cut(spark, monkeypatch):
    monkeypatch.setattr(S, "PRODUCTS", 50)
    monkeypatch.setattr(S, "CONDITIONS", 20)
    rng = random.Random(8)
    postings = spark.createDataFrame([(f"p{i}", "bmain" if i % 3 == 0 else f"b{i % 40}") for i in range(6_000)], "code string, key string")
    asked = spark.createDataFrame([(f"c{i}", key, n, None) for i in range(900) for key, n in [("bmain", 2_000) if i % 3 == 0 else (f"b{rng.randrange(1, 40)}", 150)]], "cond string, key string, n long, second string")
    asks, posts = S.dealt(asked, postings)
    cells = asks.join(posts, ["key", "part", "share"]).groupBy("key", "part", "share").agg(F.count("*").alias("n"))
    sizes = sorted(r["n"] for r in cells.collect())
    assert sizes[-1] <= 3 * 50 * 20  # shares are dealt by hash
    hot = sorted(r["n"] for r in cells.where("key = 'bmain'").collect())
    assert len(hot) >= 40 * 15 * 0.9 and hot[-1] <= 4 * hot[len(hot) // 2]
    total = lambda df: df.groupBy("key").agg(F.count("*").alias("n")).collect()
    want = asked.join(postings, "key")
    assert sorted(total(asks.join(posts, ["key", "part", "share"]))) == sorted(total(want))


def test_few_products_are_met(spark, monkeypatch):
    """A condition with a frequent and a rare piece meets the products of the rare one; one with a price meets the products of its ranges."""
    rows = [(f"p{i}", f"cream number{i:05d}", "Main", None, None, "a", "b", "Enable", str(i), None, None) for i in range(3_000)]
    catalog = S.catalog_view(spark.createDataFrame(rows, PRODUCT))
    base = dict(rank_query="x", terms=[], tokens=[], brand=None, brand_keys=[], exclude_keys=[], category=None, color=None, material=None, gender=None, price_min=None, price_max=None, availability=None)
    asked = [base | {"query_id": "text", "terms": ["cream", "number00017"]}, base | {"query_id": "price", "price_min": 100.0, "price_max": 140.0}, base | {"query_id": "both", "brand": "Main", "brand_keys": ["main"], "category": None, "material": "number00042"}]
    queries = spark.createDataFrame([tuple(a[c.split()[0]] for c in QUERY.split(", ")) for a in asked], QUERY)
    joined, original = {}, S.dealt

    def dealt(asked_rows, postings):
        asks, posts = original(asked_rows, postings)
        joined["n"] = asks.join(posts, ["key", "part", "share"]).groupBy("cond").count().agg(F.max("count")).first()[0]
        return asks, posts

    monkeypatch.setattr(S, "dealt", dealt)
    got = sorted((r["q_query_id"], r["product_code"]) for r in S.hard_filters(queries, catalog).collect())
    assert [x for x in got if x[0] != "price"] == [("both", "p42"), ("text", "p17")]
    assert len([x for x in got if x[0] == "price"]) == 41
    assert joined["n"] <= 400


def windows_without_limit(plan):
    """Window nodes that no limit of their groups stands under."""
    lines = plan.split("\n")
    found = []
    for i, line in enumerate(lines):
        if "Window " in line and "WindowGroupLimit" not in line and "row_number" in line and not any("WindowGroupLimit" in x for x in lines[i + 1 : i + 8]):
            found.append(line)
    return found


def test_no_window_over_a_whole_pool(spark):
    sf = "/root/testdata/sf0.001"
    cases, catalog = Q._cases(spark, sf), Q._catalog(spark, sf)
    plans = [S.named_search(S.name_variants(cases), catalog), Q._hybrid(spark, sf), S.product_search(cases, catalog)]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and not windows_without_limit(plan)
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
