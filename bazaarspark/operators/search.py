"""Product search: a log of read queries against a catalog, all at once.

Queries with equal conditions are one condition. A condition meets products by keys that a product must have: its brand, pieces of three
letters of the texts it must hold, or, where there is neither, a range of prices. The rarest key of a condition is looked up; where that
is frequent, what it brings must also have the second rarest. Keys of many products or conditions are cut on both sides, so that no task
holds a brand with a third of the catalog.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarspark.functions import dictionaries as D
from bazaarspark.functions import text as X
from bazaarspark.functions.columns import clamp, is_blank, side, top_n
from bazaarspark.operators import metadata as M
from bazaarspark.sources import scratch

FILTERS = [*M.POSITIVE, "exclude_brands"]
#: Products and conditions of a key that one task holds, and from how many products on the second key is asked for.
PRODUCTS, CONDITIONS, FREQUENT = 4_096, 256, 256
#: Ranges of prices, of about as many products each.
PRICES = 64
# Products that hybrid search scores classically, the weights of its two scores, and those of BM25.
CANDIDATES, DENSE, LEXICAL, K1, B = 50, 0.6, 0.4, 1.5, 0.75


def catalog_view(products: DataFrame) -> DataFrame:
    """The catalog with the columns that a search reads; products without a code are left out."""
    low = {f"low_{name}": F.lower(F.coalesce(c, F.lit(""))) for name, c in (("name", "product_name"), ("sku", "sku"), ("brand", "brand"), ("type", "type"), ("level1", "category_level1"), ("level2", "category_level2"))}
    return products.where("product_code is not null").withColumns(
        low
        | {"brand_key": F.lower(F.trim("brand")), "searchable": F.lower(X.searchable_text()), "norm_name": X.normalized_name("product_name"), "price": X.parse_price("sum_of_price"), "enabled": F.coalesce(F.col("last_status") == "Enable", F.lit(False))}
    )


def drop_empty_queries(queries: DataFrame) -> DataFrame:
    """Queries without any condition ask for nothing."""
    return queries.where(_positive() | (F.size("terms") > 0) | (F.size("exclude_keys") > 0) & ~is_blank(F.col("rank_query")))


def _positive() -> Column:
    found = F.lit(False)
    for f in M.POSITIVE:
        found = found | F.col(f).isNotNull()
    return found


def _typed(word: Column) -> Column:
    """Whether a type or category of a product holds a word in lower case."""
    return F.contains("low_type", word) | F.contains("low_level1", word) | F.contains("low_level2", word)


def _pieces(c: Column, size: int = 3) -> Column:
    """The distinct pieces of ``size`` letters."""
    starts = F.when(F.length(c) >= size, F.sequence(F.lit(1), F.length(c) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, F.lit(size))))


def _matches() -> Column:
    """The conjunction of a query's conditions; prefixed columns are the query's."""
    q = lambda c: F.col("q_" + c)
    either = lambda col, cond: q(col).isNull() | F.coalesce(cond, F.lit(False))
    category = (F.lower(F.trim("type")) == F.lower(q("category"))) | _typed(F.lower(q("category")))
    free = F.when(q("positive"), True).otherwise(F.forall(q("terms"), lambda t: F.contains(F.col("searchable"), F.lower(t))))
    return (
        either("brand", F.array_contains(q("brand_keys"), F.col("brand_key")))
        & (F.col("brand").isNull() | ~F.coalesce(F.array_contains(q("exclude_keys"), F.col("brand_key")), F.lit(False)))
        & either("category", category)
        & either("color", F.contains(F.lower("color"), F.lower(q("color"))))
        & either("material", F.contains(F.col("searchable"), F.lower(q("material"))))
        & either("gender", F.contains(F.lower("gender"), F.lower(q("gender"))))
        & either("price_min", F.col("price") >= q("price_min"))
        & either("price_max", F.col("price") <= q("price_max"))
        & either("availability", F.col("enabled") == q("availability"))
        & free
    )


CONDITION = [*FILTERS[:-1], "brand_keys", "exclude_keys", "positive", "terms"]


def price_range(price: Column, cuts: list[float]) -> Column:
    """How many of the cuts a price has reached."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= price)) if cuts else F.lit(0)


def _range_key(enabled: Column, place: Column) -> Column:
    return F.concat(F.lit("r"), enabled.cast("string"), F.lit(":"), place.cast("string"))


def asked_keys(conditions: DataFrame, cuts: list[float]) -> DataFrame:
    """(cond, alternative, key): a product meets a condition only if it has all keys of one of its alternatives, which are the spellings
    of a brand, and the ranges of prices that a condition without brand or text covers."""
    texts = F.when(F.col("q_positive"), F.array("q_category", "q_color", "q_material")).otherwise(F.col("q_terms"))
    texts = F.filter(F.transform(F.array_compact(texts), F.lower), lambda t: F.length(t) > 0)
    pieces = F.array_distinct(F.flatten(F.transform(texts, lambda t: F.when(F.length(t) >= 3, _pieces(t)).otherwise(F.array(t)))))
    c = conditions.withColumn("_pieces", F.transform(pieces, lambda p: F.concat(F.lit("t"), p)))
    branded = c.where("q_brand is not null").select("cond", F.explode(F.array_distinct("q_brand_keys")).alias("alternative"), "_pieces")
    branded = branded.select("cond", "alternative", F.explode(F.concat(F.array(F.concat(F.lit("b"), "alternative")), "_pieces")).alias("key"))
    texted = c.where("q_brand is null").select("cond", F.lit("").alias("alternative"), F.explode("_pieces").alias("key"))
    low = F.when(F.col("q_price_min").isNull(), 0).otherwise(price_range(F.col("q_price_min"), cuts))
    high = F.when(F.col("q_price_max").isNull(), len(cuts)).otherwise(price_range(F.col("q_price_max"), cuts))
    places = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    # Products without a price have a range of their own, which only conditions without one cover.
    places = F.when(F.col("q_price_min").isNull() & F.col("q_price_max").isNull(), F.array_append(places, F.lit(-1))).otherwise(places)
    stock = F.when(F.col("q_availability").isNull(), F.array(F.lit(True), F.lit(False))).otherwise(F.array("q_availability"))
    bare = c.where("q_brand is null and size(_pieces) = 0").select("cond", F.explode(places).alias("place"), stock.alias("stock"))
    bare = bare.select("cond", "place", F.explode("stock").alias("enabled")).withColumn("key", _range_key(F.col("enabled"), F.col("place")))
    return branded.unionByName(texted).unionByName(bare.select("cond", F.col("key").alias("alternative"), "key"))


def _postings(catalog: DataFrame, keys: DataFrame, cuts: list[float]) -> DataFrame:
    """(code, key) of the keys that are asked for."""
    text = F.concat_ws(" ", "searchable", F.lower("color"))
    # As a list of one, so that the text isn't put together anew for each of its pieces.
    listed = lambda size: F.flatten(F.transform(F.array(text), lambda t: F.transform(_pieces(t, size), lambda p: F.concat(F.lit("t"), p))))
    place = F.when(F.col("price").isNull(), -1).otherwise(price_range(F.col("price").cast("double"), cuts))
    own = [F.concat(F.lit("b"), "brand_key"), _range_key(F.col("enabled"), place)]
    wanted = scratch.written(keys.select("key").distinct(), "search-wanted")
    rows = catalog.select(F.col("product_code").alias("code"), F.explode(F.concat(F.array_compact(F.array(*own)), listed(3))).alias("key"))
    short = wanted.where("key LIKE 't%' and length(key) < 4")
    if not short.isEmpty():
        for size in (1, 2):
            rows = rows.unionByName(catalog.select(F.col("product_code").alias("code"), F.explode(listed(size)).alias("key")).join(short, "key", "left_semi").select("code", "key"))
    return rows.join(wanted, "key", "left_semi").select("code", "key")


def rarest_keys(keys: DataFrame, postings: DataFrame) -> DataFrame:
    """(cond, alternative, key, n, second) for each alternative of which all keys have products: its rarest key, the number of its products and, where
    these are many, the second rarest."""
    sizes = postings.groupBy("key").agg(F.count("*").alias("n"))
    found = keys.join(sizes.hint("merge"), "key", "left").groupBy("cond", "alternative").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("found"), F.count_if(F.col("n").isNull()).alias("missing"))
    first, second = F.get("found", F.lit(0)), F.get("found", F.lit(1))
    return found.where("missing = 0").select("cond", "alternative", first["key"].alias("key"), first["n"].alias("n"), F.when(first["n"] > FREQUENT, second["key"]).alias("second"))


def dealt(asked: DataFrame, postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join by key, cut: a cell (key, part, share) has about ``PRODUCTS`` products and ``CONDITIONS`` conditions at most."""
    shares = asked.groupBy("key").agg(F.max(F.ceil(F.col("n") / PRODUCTS)).alias("parts"), F.ceil(F.count("*") / CONDITIONS).alias("shares"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    shares = side(shares)
    asks = asked.join(shares, "key").withColumn("share", F.pmod(F.xxhash64("cond"), F.col("shares"))).withColumn("part", F.explode(upto("parts")))
    posts = postings.join(shares, "key").withColumn("part", F.pmod(F.xxhash64("code"), F.col("parts"))).withColumn("share", F.explode(upto("shares")))
    return asks.drop("n", "parts", "shares"), posts.select("key", "part", "share", "code")


def hard_filters(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Pairs of a query and a product that meets all its conditions. Query columns get the prefix ``q_``.

    Queries hold query_id, rank_query, terms, tokens, brand_keys, exclude_keys and the filters of the metadata.
    """
    asked = drop_empty_queries(queries).withColumn("positive", _positive())
    q = asked.select(*[F.col(c).alias("q_" + c) for c in asked.columns])
    condition = F.struct(*["q_" + c for c in CONDITION if c != "terms"], F.when(~F.col("q_positive"), F.col("q_terms")).alias("terms"))
    q = scratch.written(q.withColumn("cond", F.sha2(F.to_json(condition), 256)), "search-asked")
    conditions = scratch.written(q.select("cond", *["q_" + c for c in CONDITION]).dropDuplicates(["cond"]), "search-conditions")
    cuts: list[float] = []
    if not conditions.where("q_price_min is not null or q_price_max is not null").isEmpty():
        found = catalog.agg(F.percentile_approx(F.col("price").cast("double"), [i / PRICES for i in range(1, PRICES)])).first()[0]
        cuts = sorted(set(found or []))
    keys = scratch.written(asked_keys(conditions, cuts), "search-keys")
    postings = scratch.written(_postings(catalog, keys, cuts), "search-postings")
    asks, posts = dealt(rarest_keys(keys, postings), postings)
    met = asks.join(posts.hint("merge"), ["key", "part", "share"]).select("cond", "alternative", "code", "second")
    second = postings.withColumnRenamed("key", "second").hint("merge")
    met = met.where("second is null").unionByName(met.join(second, ["second", "code"], "left_semi").select(*met.columns)).drop("second")
    once = F.col("q_brand").isNull() | (F.col("brand_key") == F.col("alternative"))  # rare texts bring a product to all spellings of a brand
    pairs = met.join(catalog.hint("merge"), F.col("code") == F.col("product_code")).join(side(conditions), "cond").where(_matches() & once)
    return pairs.drop("code", "alternative", *conditions.columns[1:]).join(side(q), "cond").drop("cond")


def _each(tokens: Column, points: list[tuple[int, object]]) -> Column:
    """Sum over tokens of the points whose condition holds."""

    def add(acc: Column, t: Column) -> Column:
        for n, cond in points:
            acc = acc + F.when(F.coalesce(cond(t), F.lit(False)), n).otherwise(0)
        return acc

    return F.aggregate(tokens, F.lit(0), add)


def relevance_score() -> Column:
    """Points of a product for a query, over the columns that :func:`hard_filters` gives."""
    name, sku = F.col("low_name"), F.col("low_sku")
    query, tokens = F.lower(F.trim("q_rank_query")), F.transform(F.slice(F.col("q_tokens"), 1, 12), F.lower)
    points = lambda n, cond: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
    numbered = F.slice(F.filter(tokens, lambda t: t.rlike("[0-9۰-۹]")), 1, 4)
    any_token = F.size(tokens) > 0
    return (
        points(100, (F.length(query) > 0) & (F.trim(name) == query))
        + points(50, F.col("q_brand").isNotNull() & F.array_contains("q_brand_keys", F.col("brand_key")))
        + points(40, F.lower(F.trim("type")) == F.lower("q_category"))
        + points(18, (F.length(query) > 0) & F.startswith(name, query))
        + points(12, (F.length(query) > 0) & F.contains(name, query))
        + _each(numbered, [(25, lambda t: F.contains(name, t) | F.contains(sku, t))])
        + points(30, any_token & F.forall(tokens, lambda t: F.contains(F.col("searchable"), t)))
        + points(20, any_token & F.forall(tokens, lambda t: F.contains(name, t)))
        + _each(tokens, [(6, lambda t: F.contains(name, t)), (5, lambda t: F.contains("low_brand", t)), (4, _typed), (1, lambda t: F.contains(F.col("searchable"), t))])
    )


def name_variants(queries: DataFrame) -> DataFrame:
    """Adds ``phrases`` (the folded phrase and its spellings with other brand names) and ``token_variants``."""
    pairs = D.longest_first(D.brand_aliases())
    keys: dict[str, list[str]] = {}
    for alias, canonical in D.brand_aliases():
        keys.setdefault(canonical, []).append(alias)
    swaps = F.array(*[F.struct(F.lit(a).alias("alias"), F.array(*map(F.lit, list(dict.fromkeys([c.lower(), *sorted(keys[c])]))[:3])).alias("to")) for a, c in pairs])
    hits = lambda low: F.filter(swaps, lambda e: F.contains(low, F.concat(F.lit(" "), e["alias"], F.lit(" "))))
    swapped = lambda low: F.flatten(F.transform(hits(low), lambda e: F.transform(e["to"], lambda r: F.trim(F.replace(low, F.concat(F.lit(" "), e["alias"], F.lit(" ")), F.concat(F.lit(" "), r, F.lit(" ")))))))
    spelled = lambda folded: X.once(F.concat(F.lit(" "), F.lower(folded), F.lit(" ")), swapped)
    phrases = F.slice(X.once(X.fold_text("name_phrase"), lambda folded: X.keep_order_unique(F.concat(F.array(folded), spelled(folded)))), 1, 6)
    brands = F.create_map(*[F.lit(x) for a, c in D.brand_aliases() for x in (a, c)])
    variants = lambda t: F.slice(X.keep_order_unique(F.concat(F.array(t), F.coalesce(M.brand_keys(F.try_element_at(brands, F.lower(t))), F.array().cast("array<string>")))), 1, 6)
    return queries.withColumns({"phrases": phrases, "token_variants": F.transform("name_tokens", variants)})


def name_match_score() -> Column:
    """Points of a product's name, over q_rank_query, q_phrases, q_name_tokens and q_token_variants. Rounded half up."""
    name, raw = F.col("norm_name"), F.col("low_name")
    phrases = F.col("q_phrases")
    inside = F.exists(phrases, lambda p: F.contains(name, p))
    share = F.length(F.get(phrases, F.lit(0))).cast("decimal(20,6)") / F.greatest(F.length(F.trim(F.coalesce("product_name", F.lit("")))), F.lit(1))
    query = F.lower(F.trim("q_rank_query"))
    held = lambda vs: F.exists(vs, lambda v: F.contains(name, v) | F.contains(raw, F.lower(v)))
    hits = F.size(F.filter("q_token_variants", held))
    pairs = F.arrays_zip(F.col("q_name_tokens").alias("t"), F.col("q_token_variants").alias("v"))
    cut = lambda p: (F.length(p["t"]) >= 4) & ~held(p["v"]) & F.contains(name, F.substring(p["t"], F.lit(1), F.length(p["t"]) - 1))
    n = F.size("q_token_variants")
    zero = F.lit(0).cast("decimal(20,2)")
    return (
        F.when(inside, 80).otherwise(0)
        + F.when(F.exists(phrases, lambda p: F.startswith(name, p)), 35).otherwise(0)
        + F.when(inside, F.least(F.lit(40).cast("decimal(20,2)"), F.round(share * 55, 2).cast("decimal(20,2)"))).otherwise(zero)
        + F.when((F.size(phrases) > 0) & (F.length(query) > 0) & (name == query), 20).otherwise(0)
        + 8 * hits
        + 4 * F.size(F.filter(pairs, cut))
        + F.when((n > 0) & (hits == n), 50).otherwise(0)
        + F.when(n > 0, F.round(hits.cast("decimal(20,6)") / n * 40, 2).cast("decimal(20,2)")).otherwise(zero)
    ).cast("double")


def _best(score: str) -> list[Column]:
    return [F.desc(score), F.desc("enabled"), F.asc_nulls_last("product_name"), F.asc("product_code")]


def product_search(queries: DataFrame, catalog: DataFrame, limit: int = 10) -> DataFrame:
    """The most relevant products of each query, enabled ones first among equals."""
    scored = hard_filters(queries, catalog).withColumn("score", relevance_score())
    return top_n(scored, ["q_query_id"], _best("score"), clamp(limit, 1, 50))


def two_stage_topk(queries: DataFrame, catalog: DataFrame, candidate_limit: int = 80, limit: int = 10) -> DataFrame:
    """A pool by the name's score, then the most relevant of it by both scores."""
    pool = hard_filters(queries, catalog).withColumn("name_score", name_match_score())
    pool = top_n(pool, ["q_query_id"], _best("name_score"), clamp(candidate_limit, 10, 200), "pool_rank")
    return top_n(pool.withColumn("score", relevance_score() + F.col("name_score")), ["q_query_id"], _best("score"), clamp(limit, 1, 50))


def restricts_pool() -> Column:
    """Whether a query ranks only the products whose names fit best: it has name words, a filter, and words left to search for."""
    return (F.size("q_name_tokens") > 0) & F.col("q_positive") & (F.size("q_terms") > 0)


def named_search(queries: DataFrame, catalog: DataFrame, limit: int = 10, candidate_limit: int = 80) -> DataFrame:
    """The most relevant products of each query by both scores. Queries that restrict their pool (:func:`restricts_pool`) rank the
    ``candidate_limit`` best by name only."""
    pool = hard_filters(queries, catalog).withColumn("name_score", name_match_score())
    # Only queries that restrict their pool are ranked twice, each time with a bound that Spark prunes partitions by before it shuffles.
    first = top_n(pool.where(restricts_pool()), ["q_query_id"], _best("name_score"), clamp(candidate_limit, 10, 200), "pool_rank").drop("pool_rank")
    pool = pool.where(~restricts_pool()).unionByName(first)
    return top_n(pool.withColumn("score", relevance_score() + F.col("name_score")), ["q_query_id"], _best("score"), clamp(limit, 1, 20))


def classical_score() -> Column:
    """Points of a product in the evaluation's own ranking, over folded texts."""
    fold = lambda c: F.lower(X.fold_text(c))
    name, query = fold("product_name"), fold("q_rank_query")
    tokens = F.filter(F.transform("q_tokens", lambda t: F.lower(X.fold_text(t))), lambda t: F.length(t) > 0)
    haystack = fold("searchable")
    hits = F.size(F.filter(tokens, lambda t: F.contains(haystack, t)))
    points = lambda n, cond: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
    return (
        points(100, (F.length(name) > 0) & (name == query))
        + points(50, F.col("q_brand").isNotNull() & F.array_contains("q_brand_keys", fold("brand")))
        + points(40, F.col("q_category").isNotNull() & F.contains(F.lower(F.coalesce("type", F.lit(""))), F.lower("q_category")))
        + points(25, (F.length(query) > 0) & F.contains(name, query))
        + 8 * hits
        + points(20, (F.size(tokens) > 0) & (hits == F.size(tokens)))
    ).cast("double")


def _with_idf(queries: DataFrame, words: DataFrame) -> DataFrame:
    """Queries with ``idf``: their tokens (repeats stay) with the weight of each over the whole catalog, and ``avgdl``."""
    docs = words.agg(F.count("*").alias("n"), F.greatest(F.avg(F.size("words")), F.lit(1.0)).alias("avgdl"))
    asked = queries.select("query_id", F.explode(F.transform("tokens", lambda t: F.lower(t))).alias("term"))
    held = words.select(F.explode(F.array_distinct("words")).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    df = held.groupBy("term").agg(F.count("*").alias("df")).crossJoin(docs)  # one row of totals
    weighed = asked.join(df, "term").groupBy("query_id").agg(F.collect_list(F.struct("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))).alias("idf"), F.first("avgdl").alias("avgdl"))
    return queries.join(weighed, "query_id", "left")


def hybrid_search(queries: DataFrame, catalog: DataFrame, query_vectors: DataFrame, vectors: DataFrame, limit: int = 10) -> DataFrame:
    """Products that meet a query's conditions, by vectors and words: the best ``CANDIDATES`` of both scores together, each scaled
    to 0..1 among what passes, are ranked by :func:`classical_score`; ties keep the order of both scores.

    Vectors are (query_id, v) and (product_code, v), of one length and length 1.
    """
    words = X.fold_tokens("searchable")
    counts = F.map_from_entries(F.transform(F.array_distinct("words"), lambda w: F.struct(w, F.size(F.filter("words", lambda x: x == w)).cast("double"))))
    stock = catalog.withColumn("words", words).withColumns({"word_counts": counts, "n_words": F.greatest(F.size("words"), F.lit(1))})
    asked = _with_idf(queries, stock.select("words")).join(query_vectors.withColumnRenamed("v", "vector"), "query_id")
    pool = hard_filters(asked, stock.drop("words")).join(vectors, "product_code")
    dense = F.aggregate(F.zip_with("q_vector", "v", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    norm = K1 * (1 - B + B * F.col("n_words") / F.col("q_avgdl"))
    tf = lambda t: F.try_element_at("word_counts", t)
    gain = lambda e: F.coalesce(e["idf"] * tf(e["term"]) * (K1 + 1) / (tf(e["term"]) + norm), F.lit(0.0))
    lexical = F.coalesce(F.aggregate("q_idf", F.lit(0.0), lambda a, e: a + gain(e)), F.lit(0.0))
    scored = pool.withColumns({"dense": F.round(dense, 6), "lexical": F.round(lexical, 6)})
    scored = scratch.written(scored.drop("v", "word_counts", "n_words", "q_vector", "q_idf", "q_avgdl"), "hybrid-pool")
    # What a query's scores range over is summed up in each partition first; no task sorts or holds a whole pool.
    ends = scored.groupBy("q_query_id").agg(*[f(c).alias(f"{c}_{name}") for c in ("dense", "lexical") for name, f in (("low", F.min), ("high", F.max))])
    scaled = lambda c: F.when(F.col(f"{c}_high") > F.col(f"{c}_low"), (F.col(c) - F.col(f"{c}_low")) / (F.col(f"{c}_high") - F.col(f"{c}_low"))).otherwise(1.0)
    fused = scored.join(ends, "q_query_id").withColumn("fused", F.round(DENSE * scaled("dense") + LEXICAL * scaled("lexical"), 6))
    best = top_n(fused, ["q_query_id"], [F.desc("fused"), F.asc("product_code")], CANDIDATES, "fused_rank")
    return top_n(best.withColumn("score", classical_score()), ["q_query_id"], [F.desc("score"), F.asc("fused_rank")], clamp(limit, 1, 50))


def read_queries(raw: DataFrame, col: str = "query", payloads: DataFrame | None = None) -> DataFrame:
    """Raw queries as :func:`hard_filters` wants them: cut to 200 characters, tokens, filters, keys and how sure their reading is.

    With ``payloads`` (query_id, payload) of a model, those that the dictionaries are not sure of take what it adds.
    """
    # Written after each part, as the expressions of one would be repeated in those of the next.
    q = scratch.written(M.metadata_extract(raw.withColumn(col, F.substring(F.trim(X.text(col)), 1, 200)), col), "query-metadata")
    q = scratch.written(M.metadata_confidence(q, col).withColumnRenamed("score", "confidence"), "query-confidence")
    if payloads is not None:
        wanted = q.where("needs_llm").select("query_id")
        q = M.merge_model_metadata(q, payloads.join(wanted, "query_id", "left_semi"), "query_id", col).drop("price_intent", "model_confidence")
        q = scratch.written(q, "query-answers").withColumn("leftover", M.leftover_tokens(X.catalog_tokens(X.search_tokens(col))))
    empty = F.array().cast("array<string>")
    q = q.withColumns(
        {
            "tokens": F.slice(X.search_tokens(col), 1, 12),
            "terms": X.hard_tokens(F.col("leftover")),
            "brand_keys": F.coalesce(M.brand_keys(F.col("brand")), empty),
            "exclude_keys": F.flatten(F.transform("exclude_brands", lambda b: F.coalesce(M.brand_keys(b), empty))),
            "name_tokens": M.name_tokens(col),
        }
    )
    q = q.withColumn("name_phrase", F.array_join("name_tokens", " "))
    q = scratch.written(q, "query-tokens")
    return name_variants(q.withColumn("rank_query", F.coalesce(F.nullif("name_phrase", F.lit("")), F.array_join("tokens", " "))))


def search_pipeline(raw: DataFrame, products: DataFrame, limit: int = 10, payloads: DataFrame | None = None) -> DataFrame:
    """From raw query texts to ranked products. Equal texts are searched once; ``payloads`` are (query, payload) of a model."""
    texts = raw.select("query").distinct().withColumn("query_id", F.sha2("query", 256))
    answers = None if payloads is None else payloads.groupBy(F.sha2("query", 256).alias("query_id")).agg(F.min("payload").alias("payload"))
    asked = scratch.written(read_queries(texts, payloads=answers), "queries")  # several joins read it
    found = named_search(asked, catalog_view(products), limit)
    best = found.select("q_query_id", "rank", "product_code", "product_name", "score", F.col("q_confidence").alias("confidence"))
    return raw.select("query_id", "query").join(best, F.sha2("query", 256) == F.col("q_query_id")).drop("q_query_id")


def search_diag(queries: DataFrame, catalog: DataFrame, qrels: DataFrame, ranked_limit: int = 500) -> DataFrame:
    """For each query: products that pass its conditions, the gold products that pass, the first gold's rank within the limit, and
    what comes first: the codes of the best ten and a preview of the best three."""
    scored = hard_filters(queries, catalog).select("q_query_id", "product_code", "product_name", "enabled", relevance_score().alias("score"))
    scored = scratch.written(scored, "search-scored")  # read four times
    counts = scored.groupBy("q_query_id").agg(F.count("*").alias("filtered"))
    ranked = top_n(scored, ["q_query_id"], _best("score"), ranked_limit)
    sought = qrels.withColumnRenamed("query_id", "q_query_id").hint("merge")
    gold = scored.select("q_query_id", "product_code").join(sought, ["q_query_id", "product_code"]).groupBy("q_query_id").agg(F.count("*").alias("gold_filtered"), F.array_sort(F.collect_set("product_code")).alias("gold_codes"))
    shown = ranked.where("rank <= 10").groupBy("q_query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "product_code", "product_name"))).alias("s"))
    shown = shown.select("q_query_id", F.transform("s", lambda x: x["product_code"]).alias("top_codes"), F.array_join(F.transform(F.slice("s", 1, 3), lambda x: x["product_name"]), " | ").alias("preview"))
    first = ranked.select("q_query_id", "product_code", "rank").join(sought, ["q_query_id", "product_code"]).groupBy("q_query_id").agg(F.min("rank").alias("best_rank"))
    every = queries.select(F.col("query_id").alias("q_query_id"))
    out = reduce(lambda rows, part: rows.join(part.hint("merge"), "q_query_id", "left"), (counts, gold, first, shown), every)
    none = F.array().cast("array<string>")
    return out.select(F.col("q_query_id").alias("query_id"), F.coalesce("filtered", F.lit(0)).alias("filtered"), F.coalesce("gold_filtered", F.lit(0)).alias("gold_filtered"), F.coalesce("gold_codes", none).alias("gold_codes"), "best_rank", F.coalesce("top_codes", none).alias("top_codes"), F.coalesce("preview", F.lit("")).alias("preview"))


def apply_model_order(candidates: DataFrame, order: DataFrame) -> DataFrame:
    """Candidates (query_id, product_code, rank) reordered: codes of ``order`` (query_id, product_code, pos) first, then the rest."""
    first = order.groupBy("query_id", "product_code").agg(F.min("pos").alias("pos"))
    placed = candidates.join(first, ["query_id", "product_code"], "left")
    return top_n(placed, ["query_id"], [F.asc_nulls_last("pos"), F.asc("rank")], 2**31 - 1, "new_rank").drop("pos")


def candidate_payload(rows: DataFrame) -> DataFrame:
    """What a model is shown of a candidate."""
    return rows.select("query_id", "rank", "product_code", "product_name", "brand", F.coalesce("type", "category_level2", "category_level1").alias("category"), F.coalesce("special_price", "sum_of_price").alias("price"))


def search_log_facts(outcomes: DataFrame) -> DataFrame:
    """Where the filters came from, which ones were set, and whether nothing was found."""
    source = F.when(F.col("fallback_failed"), "fallback_failed").when(F.col("fallback_triggered"), "llm_fallback").otherwise("deterministic")
    names = [c for c in M.POSITIVE if c in outcomes.columns]
    return outcomes.withColumns({"metadata_source": source, "applied_filters": F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in names])), "empty": F.col("result_count") == 0})
