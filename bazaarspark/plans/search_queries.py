"""Registered queries on query texts, metadata and product search, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarspark.functions import dictionaries as D
from bazaarspark.functions import text as X
from bazaarspark.functions.columns import side
from bazaarspark.operators import ir_eval, metadata, phrases, retrieval, search
from bazaarspark.sources.tables import spread, table, view, with_views


def _log(spark, d):
    return spread(view(spark, d, "query_log"), "query_id")


def _read(spark, d):
    return metadata.metadata_extract(_log(spark, d))


def _cases(spark, d):
    """Read queries over the catalog's own brands."""
    none = F.lit(None)
    keys = lambda c: F.when(F.col(c).isNotNull(), F.array(F.lower(F.col(c)))).otherwise(F.array().cast("array<string>"))
    q = view(spark, d, "search_cases").withColumns(
        {
            "tokens": X.search_tokens("rank_query"),
            "brand_keys": keys("brand"),
            "exclude_keys": keys("excluded"),
            **{c: none.cast("string") for c in ("color", "material", "gender")},
            "price_min": none.cast("double"),
            "availability": none.cast("boolean"),
        }
    )
    return q.withColumns({"terms": X.hard_tokens(F.col("tokens")), "name_tokens": F.col("tokens"), "name_phrase": F.col("rank_query")})


def _catalog(spark, d):
    return search.catalog_view(view(spark, d, "products"))


def _ranked(df):
    return df.select(F.col("q_query_id").alias("query_id"), "product_code", F.col("score").cast("double").alias("score"), "rank")


def _qrels(spark, d):
    """Gold products of a case: those of its name with an even code."""
    return side(view(spark, d, "search_cases").select("query_id", "rank_query")).join(view(spark, d, "products").where("CAST(product_code AS BIGINT) % 2 = 0").select("product_code", F.col("product_name").alias("rank_query")), "rank_query").select("query_id", "product_code")


def _diag_gold(spark, d):
    """The gold products, and a code that the catalog lacks for some cases; every eighth case has only that."""
    gold, n = _qrels(spark, d), F.length("query_id") + F.length(F.substring_index("query_id", " ", -1))
    return gold.where(n % 8 != 3).unionByName(view(spark, d, "search_cases").where(n % 4 == 3).select("query_id", F.lit("none").alias("product_code")))


def _facts(spark, d):
    """The facts of each case: its own conditions are the extracted metadata, a brand and a price the expected ones."""
    cases, catalog = _cases(spark, d), _catalog(spark, d)
    q = cases.select("query_id", *[F.col(c).alias("q_" + c) for c in metadata.POSITIVE if c != "availability"], F.col("availability").alias("q_availability"), F.array_compact(F.array("excluded")).alias("q_exclude_brands"))
    n = F.length("query_id")
    want = ir_eval.expected_filters(cases.select("query_id", F.when(n % 5 == 0, "Brand#1").alias("brand"), F.when(n % 3 == 0, 1100.0).alias("price_max")))
    scored = search.hard_filters(cases, catalog).withColumn("score", search.relevance_score())
    ranked = search.top_n(scored, ["q_query_id"], search._best("score"), 2**31 - 1).select(F.col("q_query_id").alias("query_id"), "product_code", F.when(F.col("rank") <= 500, F.col("rank")).alias("rank"))
    facts = ir_eval.narrow_facts(q.join(want, "query_id"), _diag_gold(spark, d), catalog, ranked)
    return ir_eval.classify_narrow(facts).withColumn("query_type", F.split_part("query_id", F.lit("|"), F.lit(1)))


def _exclusions(spark, d):
    """Every gold product of a case against the case's conditions."""
    q = _cases(spark, d).select("query_id", *[F.col(c).alias("q_" + c) for c in metadata.POSITIVE], F.array_compact(F.array("excluded")).alias("q_exclude_brands"))
    return ir_eval.filter_exclusions(_qrels(spark, d).join(_catalog(spark, d), "product_code").join(q, "query_id")).select("query_id", "product_code", "exclusions")


def _vectors(spark, d):
    """Vectors of products and of cases, of length 1."""
    v = table(spark, d, "embeddings").select("vec_id", retrieval.l2_normalize(F.col("embedding").cast("array<double>")).alias("v"))
    key = lambda c: F.pmod(c, F.lit(500)) == F.col("vec_id")
    products = view(spark, d, "products").select("product_code").join(v, key(F.col("product_code").cast("long"))).select("product_code", "v")
    cases = view(spark, d, "search_cases").select("query_id").join(v, key(F.length("query_id") * 7)).select("query_id", "v")
    return cases, products


def _hybrid(spark, d):
    cases, products = _vectors(spark, d)
    return search.hybrid_search(_cases(spark, d), _catalog(spark, d), cases, products)


def _top(spark, d):
    return search.product_search(_cases(spark, d), _catalog(spark, d))


def _names(spark, d):
    """Dictionaries of the catalog's words beside the brands: first words and whole names, with the smallest brand that has them."""
    part = table(spark, d, "part")
    rows = part.select(F.lower(F.substring_index("p_name", " ", 1)).alias("alias"), "p_brand").unionByName(part.select(F.lower("p_name").alias("alias"), "p_brand"))
    rows = rows.groupBy("alias").agg(F.min("p_brand").alias("canonical"))
    own = rows.select("alias", "canonical", (F.length("alias") + 100).cast("int").alias("ord"))
    brands = phrases.brand_table(spark)
    return brands.unionByName(own.join(brands, "alias", "left_anti"))


def _spoiled(spark, d):
    """The words of product names, one in three with a letter lost, changed or added."""
    w = F.split("p_name", " ")
    n = F.col("p_partkey")
    bad = F.transform(w, lambda x: F.when(n % 3 == 0, F.concat(F.substring(x, 1, 2), F.substring(x, 4, 99))).when(n % 3 == 1, F.concat(x, F.lit("q"))).otherwise(x))
    return table(spark, d, "part").select(n.alias("query_id"), bad.alias("tokens"))


def _payloads(spark, d):
    k = F.col("query_id")
    payload = F.to_json(F.struct(F.lit("merida").alias("brand"), F.when(k % 2 == 0, "کرم ضد آفتاب").otherwise("رنگ مو").alias("category_or_type"), F.lit("قرمز").alias("color"), F.lit(5000).alias("price_min"), F.lit("budget").alias("price_intent"), ((k % 10) / 10).alias("confidence")))
    return _log(spark, d).select("query_id", payload.alias("payload"))


QUERIES = {
    "normalize_queries": lambda s, d: metadata.normalize_queries(_log(s, d)),
    "query_text_norms": lambda s, d: table(s, d, "documents").select("doc_id", X.fold_text("text").alias("folded"), X.normalized_name("text").alias("named"), X.eval_norm("text").alias("evaluated"), X.chunk_norm("text").alias("chunked"), F.size(X.bm25_tokens("text")).cast("long").alias("n_bm25"), F.size(X.fold_tokens("text")).cast("long").alias("n_folded")),
    "load_catalog": lambda s, d: _catalog(s, d).select("product_code", "brand_key", "searchable", "norm_name", F.col("price").cast("double").alias("price"), "enabled"),
    "extract_price": lambda s, d: _log(s, d).select("query_id", X.extract_price("query").alias("p")).select("query_id", "p.price_min", "p.price_max"),
    "extract_phrases": lambda s, d: _log(s, d).select(
        "query_id",
        X.first_phrase("query", D.brand_aliases()).alias("brand"),
        X.first_phrase("query", D.CATEGORIES).alias("category"),
        X.first_phrase("query", D.same(D.COLORS)).alias("color"),
        X.first_phrase("query", D.same(D.MATERIALS)).alias("material"),
        X.first_phrase("query", D.same(D.GENDERS)).alias("gender"),
        X.extract_availability("query").alias("availability"),
        X.all_phrases("query", D.CATEGORIES).alias("categories"),
    ),
    "dictionary_phrases": lambda s, d: phrases.first_phrases(_log(s, d), _names(s, d)),
    "near_misses": lambda s, d: phrases.near_misses(_spoiled(s, d), _names(s, d).select("alias").where("instr(alias, ' ') = 0")),
    "extract_excluded_brands": lambda s, d: _log(s, d).select("query_id", metadata.excluded_brands("query").alias("n")).select("query_id", "n.excluded", "n.remaining"),
    "metadata_extract": _read,
    "metadata_confidence": lambda s, d: metadata.metadata_confidence(_read(s, d)),
    "gate_columns": lambda s, d: metadata.gate_columns(_read(s, d).withColumn("candidates", F.col("query_id") % 3), candidates="candidates").select("query_id", "needs_understanding", "needs_rerank"),
    "merge_model_metadata": lambda s, d: metadata.merge_model_metadata(_read(s, d), _payloads(s, d)),
    "name_tokens": lambda s, d: search.name_variants(_log(s, d).select("query_id", metadata.name_tokens("query").alias("name_tokens")).withColumn("name_phrase", F.array_join("name_tokens", " "))),
    "hard_filters": lambda s, d: search.hard_filters(_cases(s, d), _catalog(s, d)).groupBy(F.col("q_query_id").alias("query_id")).agg(F.count("*").alias("n"), F.min("product_code").alias("least"), F.max("product_code").alias("most")),
    "product_search": lambda s, d: _ranked(_top(s, d)),
    "two_stage_topk": lambda s, d: _ranked(search.two_stage_topk(search.name_variants(_cases(s, d)), _catalog(s, d))),
    "search_pipeline": lambda s, d: search.search_pipeline(_log(s, d), view(s, d, "products")),
    "hybrid_search": lambda s, d: _ranked(_hybrid(s, d)),
    "classical_score": lambda s, d: search.hard_filters(_cases(s, d), _catalog(s, d)).select(F.col("q_query_id").alias("query_id"), "product_code", search.classical_score().alias("score")),
    "filter_exclusions": lambda s, d: _exclusions(s, d),
    "classify_narrow": _facts,
    "diagnostic_rollup": lambda s, d: ir_eval.diagnostic_rollup(_facts(s, d)),
    "search_diag": lambda s, d: search.search_diag(_cases(s, d), _catalog(s, d), _qrels(s, d)),
    "apply_model_order": lambda s, d: search.apply_model_order(_ranked(_top(s, d)).drop("score"), _qrels(s, d).withColumn("pos", F.md5("product_code"))),
    "candidate_payload": lambda s, d: search.candidate_payload(_top(s, d).withColumnRenamed("q_query_id", "query_id")),
    "search_log_facts": lambda s, d: search.search_log_facts(_read(s, d).select("query_id", *metadata.POSITIVE, (F.col("query_id") % 5 == 0).alias("fallback_triggered"), (F.col("query_id") % 10 == 0).alias("fallback_failed"), (F.col("query_id") % 4).alias("result_count"))),
}


def _list(words):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _dedupe(x):
    return f"list_filter({x}, lambda t, i: list_position(list_transform({x}, lambda u: lower(u)), lower(t)) = i)"


def _squeeze(x):
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'), ' ')"


PUNCT = X.PUNCTUATION.replace("'", "''")
FOLD = _squeeze(f"regexp_replace(translate(replace(coalesce(@, ''), '‌', ''), 'يىك', 'ییک'), '{PUNCT}', ' ', 'g')")
BARE = FOLD.replace("@", "query")
for phrase in sorted(D.PHRASE_FILLERS, key=lambda p: -len(p)):
    BARE = f"replace({BARE}, '{phrase}', ' ')"
SPLIT = f"list_filter(string_split({_squeeze(f'regexp_replace({BARE}, $r$[^\\p{{L}}\\p{{N}}_]+$r$, $r$ $r$, $r$g$r$)')}, ' '), lambda t: t <> '' AND NOT list_contains({_list(D.TOKEN_FILLERS)}, t))"
IS_CONSTRAINT = f"(list_contains({_list(D.CONSTRAINT_TOKENS)}, {{t}}) OR regexp_full_match({{t}}, '{X.DIGITS}'))"
TOKENS = f"""raw AS (SELECT query_id, query, {SPLIT} AS split FROM query_log), tok AS (SELECT query_id, query, {_dedupe('split')} AS tokens FROM raw),
cat AS (SELECT *, list_filter(tokens, lambda t: NOT {IS_CONSTRAINT.format(t='t')}) AS c0 FROM tok), cat2 AS (SELECT query_id, query, tokens, CASE WHEN len(c0) > 0 THEN c0 ELSE tokens END AS catalog FROM cat)"""
NORM = _squeeze("replace(query, '‌', '')")


def _first(pairs):
    rows = D.longest_first(pairs)
    body = " ".join(f"WHEN contains(t, ' {a} ') THEN '{n}'" for a, n in rows)
    return f"CASE {body} END"


def _all(pairs):
    return "list_filter(list_distinct_in_order, lambda x: x IS NOT NULL)".replace("list_distinct_in_order", "[" + ", ".join(f"CASE WHEN contains(t, ' {a} ') THEN '{n}' END" for a, n in pairs) + "]")


NUMBER = "([0-9]+|یک|دو|سه|ده|بیست|صد)"


def _amount(n, s):
    words = " ".join(f"WHEN {n} = '{w}' THEN {float(v)}" for w, v in D.NUMBER_WORDS.items())
    return f"(CASE {words} ELSE TRY_CAST({n} AS DOUBLE) END * CASE WHEN {s} LIKE 'هزار%' THEN 1000.0 WHEN {s} = 'میلیون' THEN 1000000.0 ELSE 1.0 END)"


BETWEEN = rf"بین\s*{NUMBER}\s*(هزار|میلیون)?\s*تا\s*{NUMBER}\s*(هزار|میلیون)?"
SPACED = rf"(زیر|بالای|بالا)\s+{NUMBER}\s*(هزارتومان|هزارتومن|هزار|میلیون)?"
COMPACT = "(زیر|بالای|بالا)?([0-9]+)(هزارتومان|هزارتومن|هزار|میلیون)?"
CATALOG = r"""catalog AS (SELECT *, lower(trim(brand)) AS brand_key, lower(concat_ws(' ', product_name, brand, type, sku, product_code, category_level1, category_level2, color)) AS searchable,
 TRY_CAST(nullif(regexp_replace(coalesce(sum_of_price, ''), '[^0-9.]+', '', 'g'), '') AS DOUBLE) AS price, coalesce(last_status = 'Enable', false) AS enabled FROM products)"""
PAIRS = f"""{CATALOG}, pairs AS (SELECT q.query_id, q.rank_query, q.brand AS q_brand, q.category AS q_category, string_split(q.rank_query, ' ') AS toks, c.* FROM search_cases q JOIN catalog c ON
 (q.kind = 0 AND c.brand_key = lower(q.brand)) OR (q.kind = 1 AND (lower(c.type) = lower(q.category) OR contains(lower(c.type), lower(q.category)) OR contains(lower(c.category_level1), lower(q.category)) OR contains(lower(c.category_level2), lower(q.category))) AND c.price <= q.price_max)
 OR (q.kind = 2 AND c.brand_key <> lower(q.excluded) AND contains(c.searchable, split_part(q.rank_query, ' ', 1)) AND contains(c.searchable, split_part(q.rank_query, ' ', 2))))"""
SCORE = """(CASE WHEN lower(product_name) = lower(rank_query) THEN 100 ELSE 0 END + CASE WHEN q_brand IS NOT NULL AND brand_key = lower(q_brand) THEN 50 ELSE 0 END + CASE WHEN lower(type) = lower(q_category) THEN 40 ELSE 0 END
 + CASE WHEN starts_with(lower(product_name), rank_query) THEN 18 ELSE 0 END + CASE WHEN contains(lower(product_name), rank_query) THEN 12 ELSE 0 END
 + CASE WHEN contains(searchable, toks[1]) AND contains(searchable, toks[2]) THEN 30 ELSE 0 END + CASE WHEN contains(product_name, toks[1]) AND contains(product_name, toks[2]) THEN 20 ELSE 0 END
 + list_sum(list_transform(toks, lambda t: CASE WHEN contains(product_name, t) THEN 6 ELSE 0 END + CASE WHEN contains(lower(brand), t) THEN 5 ELSE 0 END
 + CASE WHEN lower(type) = t OR contains(lower(type), t) OR contains(lower(category_level1), t) OR contains(lower(category_level2), t) THEN 4 ELSE 0 END + CASE WHEN contains(searchable, t) THEN 1 ELSE 0 END)))"""
SCORED = f"{PAIRS}, scored AS (SELECT *, {SCORE} AS score FROM pairs)"
BEST = "PARTITION BY query_id ORDER BY {s} DESC, enabled DESC, product_name NULLS LAST, product_code"
TOP = f"{SCORED}, best AS (SELECT *, row_number() OVER ({BEST.format(s='score')}) AS rank FROM scored QUALIFY rank <= 10)"
QRELS = "qrels AS (SELECT query_id, product_code FROM search_cases JOIN products ON product_name = rank_query WHERE CAST(product_code AS BIGINT) % 2 = 0)"
# Tokens of these names are words of three letters or more, two for each name, and no brand's alias.
NAME_SCORE = """CAST(CASE WHEN contains(product_name, rank_query) THEN 80 ELSE 0 END + CASE WHEN starts_with(product_name, rank_query) THEN 35 ELSE 0 END
 + CASE WHEN contains(product_name, rank_query) THEN least(40, round(CAST(length(rank_query) AS DECIMAL(20, 6)) / length(product_name) * 55, 2)) ELSE 0 END + CASE WHEN product_name = rank_query THEN 20 ELSE 0 END
 + 8 * list_sum(list_transform(toks, lambda t: CASE WHEN contains(product_name, t) THEN 1 ELSE 0 END)) + 4 * list_sum(list_transform(toks, lambda t: CASE WHEN length(t) >= 4 AND NOT contains(product_name, t) AND contains(product_name, t[:-2]) THEN 1 ELSE 0 END))
 + CASE WHEN contains(product_name, toks[1]) AND contains(product_name, toks[2]) THEN 50 ELSE 0 END + 20 * list_sum(list_transform(toks, lambda t: CASE WHEN contains(product_name, t) THEN 1 ELSE 0 END)) AS DOUBLE)"""

# Words of these names are their tokens; brands have one spelling.
CLASSICAL = """(CASE WHEN lower(product_name) = lower(rank_query) THEN 100 ELSE 0 END + CASE WHEN q_brand IS NOT NULL AND lower(brand) = lower(q_brand) THEN 50 ELSE 0 END + CASE WHEN q_category IS NOT NULL AND contains(lower(type), lower(q_category)) THEN 40 ELSE 0 END
 + CASE WHEN contains(lower(product_name), lower(rank_query)) THEN 25 ELSE 0 END + 8 * len(list_filter(list_distinct(toks), lambda t: contains(searchable, t))) + CASE WHEN len(list_filter(toks, lambda t: NOT contains(searchable, t))) = 0 THEN 20 ELSE 0 END)"""
EXCLUDED = """list_filter([CASE WHEN q.brand IS NOT NULL AND lower(c.brand) <> lower(q.brand) THEN 'brand' END, CASE WHEN q.category IS NOT NULL AND NOT contains(lower(concat_ws('|', c.type, c.category_level1, c.category_level2)), lower(q.category)) THEN 'category' END,
 CASE WHEN q.price_max IS NOT NULL AND NOT coalesce(c.price <= q.price_max, false) THEN 'price_max' END, CASE WHEN q.excluded IS NOT NULL AND lower(c.brand) = lower(q.excluded) THEN 'exclude_brand' END], lambda x: x IS NOT NULL)"""
DIAG = f"""gd AS (SELECT query_id, product_code FROM qrels WHERE (length(query_id) + length(split_part(query_id, ' ', -1))) % 8 <> 3 UNION ALL SELECT query_id, 'none' FROM search_cases WHERE (length(query_id) + length(split_part(query_id, ' ', -1))) % 4 = 3),
rk AS (SELECT query_id, product_code, row_number() OVER ({BEST.format(s='score')}) AS rank FROM scored),
fx AS (SELECT q.query_id, c.product_code IS NOT NULL AS known, (length(q.query_id) % 5 <> 0 OR lower(c.brand) = 'brand#1') AND (length(q.query_id) % 3 <> 0 OR coalesce(c.price <= 1100, false)) AS meets, rk.rank, {EXCLUDED} AS ex
 FROM gd JOIN search_cases q USING (query_id) LEFT JOIN catalog c ON c.product_code = gd.product_code LEFT JOIN rk ON rk.query_id = gd.query_id AND rk.product_code = gd.product_code),
fa AS (SELECT query_id, count(*) FILTER (known) AS gold_in_catalog, count(*) FILTER (known AND meets) AS gold_meets_filters, count(rank) AS gold_filtered, count(*) FILTER (known AND meets AND len(ex) > 0) AS gold_excluded, min(CASE WHEN rank <= 500 THEN rank END) AS best_rank, count(*) AS gold, count(CASE WHEN rank <= 500 THEN rank END) AS gold_ranked FROM fx GROUP BY 1),
f AS (SELECT query_id, coalesce(gold_in_catalog, 0) AS gold_in_catalog, coalesce(gold_meets_filters, 0) AS gold_meets_filters, coalesce(gold_filtered, 0) AS gold_filtered, coalesce(gold_excluded, 0) AS gold_excluded, best_rank, coalesce(gold, 0) AS gold, coalesce(gold_ranked, 0) AS gold_ranked FROM search_cases LEFT JOIN fa USING (query_id)),
k AS (SELECT *, CASE WHEN gold_in_catalog = 0 THEN 'NO_CATALOG_MATCH' WHEN gold_meets_filters = 0 THEN 'DATA/GOLD_ISSUE' WHEN gold_filtered = 0 AND gold_excluded > 0 THEN 'FILTER_FAILURE' WHEN gold_filtered = 0 THEN 'CANDIDATE_GENERATION_FAILURE' WHEN best_rank IS NULL OR best_rank > 10 THEN 'RANKING_FAILURE' END AS failure_class,
 split_part(query_id, '|', 1) AS query_type FROM f)"""


def _mean(c, name):
    return f"CAST(sum(CAST({c} AS DECIMAL(18, 6))) AS DOUBLE) / count({c}) AS {name}"


def _map(entries):
    return "MAP {" + ", ".join(f"'{k}': {_list(ws)}" for k, ws in entries.items()) + "}"


def _words(pairs):
    """canonical -> the words that it accounts for, its own and those of its spellings."""
    out = {}
    for alias, canonical in pairs:
        out.setdefault(canonical, {}).update(dict.fromkeys([*alias.lower().split(), alias.lower(), *canonical.lower().split()]))
    return out


def _soft(t):
    return f"list_contains({_list(D.SOFT_TOKENS)}, lower({FOLD.replace('@', t)}))"


def _price_token(t):
    compact = f"replace(translate(replace({t}, '{X.ZWNJ}', ''), '{X.FOREIGN_DIGITS}', '{X.ASCII_DIGITS}'), ' ', '')"
    return f"(list_contains({_list(D.PRICE_TOKENS)}, {compact}) OR regexp_full_match({compact}, '[0-9]+(هزارتومان|هزارتومن|هزار|میلیون|تومان|تومن)?'))"


def _left_over(tokens, category):
    plain = " ".join(f", list_append(string_split(lower(coalesce({c}, '')), ' '), lower({c}))" for c in ("color", "material", "gender"))
    used = f"flatten([coalesce({_map(_words(D.brand_aliases()))}[brand], []), coalesce({_map(_words(D.CATEGORIES))}[{category}], []){plain}])"
    return f"list_filter({tokens}, lambda t: NOT list_contains({used}, lower(t)) AND NOT ((price_min IS NOT NULL OR price_max IS NOT NULL) AND {_price_token('t')}))"


def _part_of_a_name(text, category, left):
    name, folded = FOLD.replace("@", category), FOLD.replace("@", text)
    return f"""({category} IS NOT NULL AND (len(list_filter({left}, lambda t: list_contains({_list(D.PHRASE_EXTENDERS)}, lower({FOLD.replace('@', 't')})))) > 0
 OR regexp_matches({folded}, {name} || '\\s+و\\s+\\S+') OR ({name} = 'رنگ مو' AND contains(' ' || {folded} || ' ', ' ماسک '))))"""


def _catalog_part(tokens):
    kept = f"list_filter({tokens}, lambda t: NOT {IS_CONSTRAINT.format(t='t')})"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {tokens} END"


def _one_edit(a, b):
    """At most one letter is put in, left out or changed: beyond an equal beginning, one letter is passed over on either side or both."""
    rest = lambda x, n: f"substr({x}, i + {n})"
    return f"len(list_filter(range(0, length({b}) + 2), lambda i: left({a}, i) = left({b}, i) AND ({rest(a, 2)} = {rest(b, 2)} OR {rest(a, 2)} = {rest(b, 1)} OR {rest(a, 1)} = {rest(b, 2)}))) > 0"


BRANDS = ", ".join(f"({i}, '{n}', '{a}')" for i, (a, n) in enumerate(D.longest_first(D.brand_aliases()), 1))
BEFORE = f"'(?i)(^|\\s)(?:{'|'.join(D.NEGATIVE_PREFIXES)})\\s+' || alias || '(\\s|$)'"
AROUND = "'(?i)(^|\\s)از\\s+(?:برند\\s+)?' || alias || '\\s+نه(\\s|$)'"
SPACED_TEXT = lambda c: f"translate({NORM.replace('query', c)}, '{X.FOREIGN_DIGITS}', '{X.ASCII_DIGITS}')"
FILLED = "b1 <> '' AND lo IS NOT NULL AND hi IS NOT NULL"


def _prices(source, text):
    """Price bounds of a text, as further columns of a table expression."""
    return f"""g_{text} AS (SELECT *, {SPACED_TEXT(text)} AS sp FROM {source}),
h_{text} AS (SELECT *, regexp_extract(sp, '{BETWEEN}', 1) AS b1, regexp_extract(sp, '{BETWEEN}', 2) AS b2, regexp_extract(sp, '{BETWEEN}', 3) AS b3, regexp_extract(sp, '{BETWEEN}', 4) AS b4, regexp_extract(sp, '{SPACED}', 1) <> '' AS apart FROM g_{text}),
i_{text} AS (SELECT *, CASE WHEN apart THEN regexp_extract(sp, '{SPACED}', 1) ELSE regexp_extract(replace(sp, ' ', ''), '{COMPACT}', 1) END AS bound, CASE WHEN apart THEN regexp_extract(sp, '{SPACED}', 2) ELSE regexp_extract(replace(sp, ' ', ''), '{COMPACT}', 2) END AS num, CASE WHEN apart THEN regexp_extract(sp, '{SPACED}', 3) ELSE regexp_extract(replace(sp, ' ', ''), '{COMPACT}', 3) END AS scale FROM h_{text}),
j_{text} AS (SELECT *, {_amount('b1', "(CASE WHEN b2 <> '' THEN b2 ELSE b4 END)")} AS lo, {_amount('b3', "(CASE WHEN b4 <> '' THEN b4 ELSE b2 END)")} AS hi, {_amount('num', 'scale')} AS amount FROM i_{text}),
p_{text} AS (SELECT * EXCLUDE (sp, b1, b2, b3, b4, apart, bound, num, scale, lo, hi, amount), CASE WHEN {FILLED} THEN lo WHEN bound IN ('بالای', 'بالا') THEN amount END AS price_min, CASE WHEN {FILLED} THEN hi WHEN bound = 'زیر' THEN amount END AS price_max FROM j_{text})"""


PRESENT = lambda c: f"CASE WHEN regexp_matches({c}, 'ناموجود|موجود نیست') THEN false WHEN regexp_matches({c}, 'موجوده|موجود([^\\p{{L}}\\p{{N}}_]|$)') THEN true END"
META = f"""WITH RECURSIVE ent(i, name, alias) AS (VALUES {BRANDS}),
ng AS (SELECT query_id, query, 0 AS i, {FOLD.replace('@', 'query')} AS remaining, CAST([] AS VARCHAR[]) AS excluded FROM query_log
 UNION ALL SELECT query_id, query, i, CASE WHEN pattern IS NOT NULL THEN {_squeeze("regexp_replace(remaining, pattern, '\\1\\2', 'g')")} ELSE remaining END, CASE WHEN pattern IS NOT NULL THEN list_append(excluded, name) ELSE excluded END
 FROM (SELECT query_id, query, e.i, name, remaining, excluded, CASE WHEN list_contains(excluded, name) THEN NULL WHEN regexp_matches(remaining, {BEFORE}) THEN {BEFORE} WHEN regexp_matches(remaining, {AROUND}) THEN {AROUND} END AS pattern FROM ng JOIN ent e ON e.i = ng.i + 1)),
nx AS (SELECT query_id, query, remaining, excluded, CASE WHEN len(excluded) > 0 THEN remaining ELSE coalesce(query, '') END AS working FROM ng WHERE i = (SELECT max(i) FROM ent)),
ws AS (SELECT *, {SPLIT.replace('query', 'working')} AS s0, {SPLIT} AS s1 FROM nx), wt AS (SELECT * EXCLUDE (s0, s1), {_dedupe('s0')} AS t0, {_dedupe('s1')} AS tokens FROM ws),
wc AS (SELECT *, {_catalog_part('t0')} AS tw, {_catalog_part('tokens')} AS ta, ' ' || lower({NORM.replace('query', 'working')}) || ' ' AS t, {NORM.replace('query', 'working')} AS wn FROM wt),
wp AS (SELECT * EXCLUDE (t), {_first(D.brand_aliases())} AS brand0, {_first(D.CATEGORIES)} AS category0, {_first(D.same(D.COLORS))} AS color, {_first(D.same(D.MATERIALS))} AS material, {_first(D.same(D.GENDERS))} AS gender, {PRESENT('wn')} AS availability FROM wc),
wb AS (SELECT *, CASE WHEN NOT list_contains(excluded, brand0) THEN brand0 END AS brand FROM wp), {_prices('wb', 'working')},
we AS (SELECT *, CASE WHEN NOT {_part_of_a_name('working', 'category0', _left_over('tw', 'category0'))} THEN category0 END AS category FROM p_working),
md AS (SELECT *, {_left_over('ta', 'category')} AS leftover, ' ' || lower({NORM}) || ' ' AS t FROM we)"""
KEEP = "query_id, query, excluded AS exclude_brands, brand, color, material, gender, availability, price_min, price_max, category, leftover"
LOCKED = "list_filter([" + ", ".join(f"CASE WHEN {f} IS NOT NULL THEN '{f}' END" for f in metadata.POSITIVE) + ", CASE WHEN len(excluded) > 0 THEN 'exclude_brands' END], lambda x: x IS NOT NULL)"
NOTHING = " AND ".join(f"{f} IS NULL" for f in metadata.POSITIVE)
KEYS = [a for a, _ in D.brand_aliases()]
NEAR = f"list_filter(kept, lambda t: length(lower({FOLD.replace('@', 't')})) >= 4 AND NOT {_soft('t')} AND NOT list_contains({_list(KEYS)}, lower(t)) AND len(list_filter({_list([k for k in KEYS if len(k) >= 4])}, lambda a: {_one_edit("lower(" + FOLD.replace('@', 't') + ")", 'a')})) > 0)[1]"
CONFIDENT = f"""ra AS (SELECT *, list_filter(leftover, lambda t: length(t) > 0 AND NOT {_soft('t')}) AS kept, {_first(D.CATEGORIES)} AS raw, {_all(D.CATEGORIES)} AS mentioned FROM md),
rb AS (SELECT *, CASE WHEN brand IS NULL THEN {NEAR} END AS near_miss, {_part_of_a_name('query', 'raw', _left_over('ta', 'raw'))} AS aside FROM ra),
rc AS (SELECT *, list_filter([CASE WHEN raw IS NOT NULL AND category IS NULL AND aside THEN 'ambiguous_category' END, CASE WHEN len(list_distinct(mentioned)) > 1 THEN 'conflicting_metadata' END, CASE WHEN near_miss IS NOT NULL THEN 'unknown_or_near_miss_brand' END,
 CASE WHEN category IS NULL AND len(list_filter(kept, lambda t: list_contains({_list(D.PHRASE_EXTENDERS)}, lower({FOLD.replace('@', 't')})))) > 0 THEN 'partial_product_phrase' END,
 CASE WHEN {NOTHING} THEN CASE WHEN regexp_matches(query, '{D.COLLOQUIAL}') THEN 'colloquial_without_reliable_metadata' WHEN regexp_matches(query, '{D.IMPLICIT_USE}|مرطوب') THEN 'implicit_use_without_category' END END], lambda x: x IS NOT NULL) AS reasons FROM rb),
cf AS (SELECT *, greatest(0.0, round(1 - 0.35 * len(reasons), 6))::DOUBLE AS confidence, {LOCKED} AS locked_fields FROM rc)"""
BETTER = D.QUALITY.replace("(?![\\p{L}\\p{N}_])", "([^\\p{L}\\p{N}_]|$)")
VAGUE = "len(leftover) > 0 AND brand IS NULL AND category IS NULL"
GATE = f"""(regexp_matches(query, '{D.IMPLICIT_PRICE}') AND price_min IS NULL AND price_max IS NULL) OR (regexp_matches(query, '{D.IMPLICIT_USE}') AND category IS NULL) OR regexp_matches(query, '{D.COLLOQUIAL}')
 OR (({NOTHING}) AND len(leftover) <= 1 AND regexp_matches(query, '{'|'.join((D.COLLOQUIAL, D.IMPLICIT_USE, D.IMPLICIT_PRICE, BETTER, D.COMPLEX_INTENT))}'))"""
RERANK = f"query_id % 3 > 1 AND (regexp_matches(query, '{'|'.join((D.COLLOQUIAL, BETTER, D.IMPLICIT_USE, D.COMPLEX_INTENT))}') OR ({VAGUE}))"
NAMES = f"nt AS (SELECT query_id, {_dedupe('f0')}[1:12] AS name_tokens FROM (SELECT query_id, list_filter(list_transform(list_filter({_dedupe('s1')}, lambda t: NOT {_price_token('t')}), lambda t: {FOLD.replace('@', 't')}), lambda t: t <> '') AS f0 FROM (SELECT query_id, {SPLIT} AS s1 FROM query_log)))"
SPELLINGS = {}
for _alias, _name in D.brand_aliases():
    SPELLINGS.setdefault(_name, []).append(_alias)
# By alias: the brand's own name and its spellings in order, three at most; and by alias all its spellings.
SWAPS = "[" + ", ".join(f"{{'a': ' {a} ', 'r': {_list(list(dict.fromkeys([n.lower(), *sorted(SPELLINGS[n])]))[:3])}}}" for a, n in D.longest_first(D.brand_aliases())) + "]"
BY_ALIAS = _map({a: sorted(SPELLINGS[n]) for a, n in D.brand_aliases()})
VARIANTS = f"""{NAMES}, np AS (SELECT *, array_to_string(name_tokens, ' ') AS name_phrase FROM nt), nf AS (SELECT *, {FOLD.replace('@', 'name_phrase')} AS folded, ' ' || lower({FOLD.replace('@', 'name_phrase')}) || ' ' AS low FROM np),
nl AS (SELECT *, list_filter(list_transform(list_concat([folded], flatten(list_transform(list_filter({SWAPS}, lambda e: contains(low, e.a)), lambda e: list_transform(e.r, lambda r: trim(replace(low, e.a, ' ' || r || ' ')))))), lambda x: {FOLD.replace('@', 'x')}), lambda x: x <> '') AS ph,
 list_transform(name_tokens, lambda t: list_filter(list_transform(list_concat([t], coalesce({BY_ALIAS}[lower(t)], [])), lambda x: {FOLD.replace('@', 'x')}), lambda x: x <> '')) AS tv FROM nf),
nv AS (SELECT query_id, name_tokens, name_phrase, {_dedupe('ph')}[1:6] AS phrases, list_transform(tv, lambda v: list_filter(v, lambda t, i: list_position(list_transform(v, lambda u: lower(u)), lower(t)) = i)[1:6]) AS token_variants FROM nl)"""


def _map_text(pairs):
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"


KEYS_OF = _map({n: sorted(a) for n, a in SPELLINGS.items()})
_NAMES = {}
for _alias, _name in D.longest_first(D.CATEGORIES):
    _NAMES.setdefault(_alias, _name)
    _NAMES.setdefault(_name, _name)
CANON = _map_text(_NAMES)
PRICED = f"WITH {_prices('query_log', 'query')} SELECT * FROM p_query"

DICTIONARY = (
    "br AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{c}', {i})" for i, (a, c) in enumerate(D.brand_aliases())) + """) AS v(alias, canonical, ord)),
nm AS (SELECT alias, min(p_brand) AS canonical FROM (SELECT lower(split_part(p_name, ' ', 1)) AS alias, p_brand FROM part UNION ALL SELECT lower(p_name), p_brand FROM part) GROUP BY 1),
dc AS (SELECT alias, canonical, ord FROM br UNION ALL SELECT alias, canonical, length(alias) + 100 FROM nm WHERE alias NOT IN (SELECT alias FROM br))"""
)

ORACLES = {
    "dictionary_phrases": with_views(
        f"""WITH {DICTIONARY}, tx AS (SELECT query_id, ' ' || lower({NORM}) || ' ' AS t FROM query_log), h AS (SELECT query_id, alias, canonical, ord FROM tx JOIN dc ON contains(t, ' ' || alias || ' ')),
        c AS (SELECT query_id, canonical, min(ord) AS ord FROM h GROUP BY 1, 2), l AS (SELECT query_id, list(canonical ORDER BY ord, canonical) AS canonicals FROM c GROUP BY 1),
        b AS (SELECT query_id, canonical FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(alias) DESC, ord, alias) = 1)
        SELECT query_id, canonical, canonicals FROM b JOIN l USING (query_id)""",
        "query_log",
    ),
    "near_misses": f"""WITH {DICTIONARY}, kn AS (SELECT alias FROM dc WHERE NOT contains(alias, ' ')), w AS (SELECT p_partkey AS query_id, unnest(string_split(p_name, ' ')) AS x, unnest(range(len(string_split(p_name, ' ')))) AS pos FROM part),
        t AS (SELECT query_id, pos, CASE query_id % 3 WHEN 0 THEN substr(x, 1, 2) || substr(x, 4, 99) WHEN 1 THEN x || 'q' ELSE x END AS token FROM w),
        r AS (SELECT query_id, pos, token, lower(token) AS word FROM t WHERE NOT list_contains({_list(D.SOFT_TOKENS)}, lower(token)) AND length(token) >= 4 AND lower(token) NOT IN (SELECT alias FROM kn)),
        m AS (SELECT query_id, pos, token, min(alias) AS alias FROM r JOIN kn ON length(alias) >= 4 AND abs(length(alias) - length(word)) <= 1 AND levenshtein(word, alias) <= 1 GROUP BY 1, 2, 3)
        SELECT query_id, token, alias FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos) = 1""",
    "extract_excluded_brands": with_views(f"{META} SELECT query_id, excluded, remaining FROM nx", "query_log"),
    "metadata_extract": with_views(f"{META} SELECT {KEEP} FROM md", "query_log"),
    "metadata_confidence": with_views(f"{META}, {CONFIDENT} SELECT {KEEP}, near_miss, reasons, confidence AS score, locked_fields, confidence < 0.75 AND len(reasons) > 0 AS needs_llm FROM cf", "query_log"),
    "gate_columns": with_views(f"{META} SELECT query_id, {GATE} AS needs_understanding, {RERANK} AS needs_rerank FROM md", "query_log"),
    "name_tokens": with_views(f"WITH {VARIANTS} SELECT * FROM nv", "query_log"),
    # The answers name one brand and color, a category by parity, and prices; none is given back for what the dictionaries know.
    "merge_model_metadata": with_views(
        f"""{META}, {CONFIDENT}, mm AS (SELECT *, query_id % 10 / 10 AS model_confidence, query_id % 10 / 10 >= 0.7 AS sure, CASE WHEN query_id % 2 = 0 THEN 'کرم ضد آفتاب' ELSE 'رنگ مو' END AS said FROM cf),
        mc AS (SELECT *, {CANON}[said] AS canonical FROM mm)
        SELECT query_id, query, exclude_brands, coalesce(brand, CASE WHEN sure THEN {_map_text({a: n for a, n in reversed(D.brand_aliases())})}['merida'] END) AS brand, coalesce(color, CASE WHEN sure THEN 'قرمز' END) AS color, material, gender, availability,
          coalesce(price_min, CASE WHEN sure AND (asked_min IS NOT NULL OR asked_max IS NOT NULL) THEN 5000.0 END)::DOUBLE AS price_min, price_max, coalesce(category, CASE WHEN sure AND NOT coalesce(canonical = raw AND aside, false) THEN canonical END) AS category, leftover, model_confidence::DOUBLE AS model_confidence, 'budget' AS price_intent
        FROM (SELECT * EXCLUDE (excluded), excluded AS exclude_brands FROM mc) JOIN (SELECT query_id, price_min AS asked_min, price_max AS asked_max FROM ({PRICED})) USING (query_id)""",
        "query_log",
    ),
    "search_pipeline": with_views(
        f"""{META}, {CONFIDENT}, {VARIANTS}, {CATALOG},
        qr AS (SELECT cf.*, tokens[1:12] AS toks, name_tokens, phrases, token_variants, coalesce(nullif(name_phrase, ''), array_to_string(tokens[1:12], ' ')) AS rank_query, NOT ({NOTHING}) AS positive,
          list_filter(leftover, lambda t: t <> '' AND NOT {IS_CONSTRAINT.format(t='t')} AND NOT {_soft('t')})[1:12] AS terms, coalesce({KEYS_OF}[cf.brand], []) AS keys, flatten(list_transform(excluded, lambda b: coalesce({KEYS_OF}[b], []))) AS no_keys FROM cf JOIN nv USING (query_id)),
        pairs AS (SELECT q.query_id, q.query, q.confidence, q.toks, q.name_tokens, q.phrases, q.token_variants, q.rank_query, q.positive, q.terms, q.keys, q.brand AS q_brand, q.category AS q_category, c.* FROM qr q JOIN catalog c ON (q.positive OR len(q.terms) > 0 OR (len(q.no_keys) > 0 AND q.rank_query <> ''))
          AND (q.brand IS NULL OR list_contains(q.keys, c.brand_key)) AND NOT list_contains(q.no_keys, c.brand_key) AND (q.category IS NULL OR contains(lower(concat_ws('|', c.type, c.category_level1, c.category_level2)), lower(q.category))) AND (q.color IS NULL OR contains(lower(c.color), q.color))
          AND (q.material IS NULL OR contains(c.searchable, q.material)) AND (q.gender IS NULL OR coalesce(contains(c.gender, q.gender), false)) AND (q.price_min IS NULL OR coalesce(c.price >= q.price_min, false)) AND (q.price_max IS NULL OR coalesce(c.price <= q.price_max, false))
          AND (q.availability IS NULL OR c.enabled = q.availability) AND (q.positive OR len(list_filter(q.terms, lambda t: NOT contains(c.searchable, lower(t)))) = 0)),
        nm AS (SELECT *, len(list_filter(token_variants, lambda v: len(list_filter(v, lambda x: contains(lower(product_name), lower(x)))) > 0)) AS hits, len(list_filter(phrases, lambda p: contains(lower(product_name), p))) > 0 AS inside FROM pairs),
        ns AS (SELECT *, CAST(CASE WHEN inside THEN 80 ELSE 0 END + CASE WHEN len(list_filter(phrases, lambda p: starts_with(lower(product_name), p))) > 0 THEN 35 ELSE 0 END + CASE WHEN inside THEN least(40, round(CAST(length(phrases[1]) AS DECIMAL(20, 6)) / length(product_name) * 55, 2)) ELSE 0 END
          + CASE WHEN lower(product_name) = lower(rank_query) THEN 20 ELSE 0 END + 8 * hits + 4 * len(list_filter(range(1, len(name_tokens) + 1), lambda i: length(name_tokens[i]) >= 4 AND len(list_filter(token_variants[i], lambda x: contains(lower(product_name), lower(x)))) = 0 AND contains(lower(product_name), name_tokens[i][:-2])))
          + CASE WHEN len(token_variants) > 0 AND hits = len(token_variants) THEN 50 ELSE 0 END + CASE WHEN len(token_variants) > 0 THEN round(CAST(hits AS DECIMAL(20, 6)) / len(token_variants) * 40, 2) ELSE 0 END AS DOUBLE) AS name_score FROM nm),
        pl AS (SELECT * FROM ns QUALIFY NOT (len(name_tokens) > 0 AND positive AND len(terms) > 0) OR row_number() OVER ({BEST.format(s='name_score')}) <= 80),
        sc AS (SELECT *, name_score + (CASE WHEN lower(product_name) = lower(rank_query) THEN 100 ELSE 0 END + CASE WHEN q_brand IS NOT NULL AND list_contains(keys, brand_key) THEN 50 ELSE 0 END + CASE WHEN lower(type) = lower(q_category) THEN 40 ELSE 0 END
          + CASE WHEN starts_with(lower(product_name), lower(rank_query)) THEN 18 ELSE 0 END + CASE WHEN contains(lower(product_name), lower(rank_query)) THEN 12 ELSE 0 END + 25 * len(list_filter(list_filter(toks, lambda t: regexp_matches(t, '[0-9۰-۹]'))[1:4], lambda t: contains(lower(product_name), lower(t)) OR contains(lower(sku), lower(t))))
          + CASE WHEN len(toks) > 0 AND len(list_filter(toks, lambda t: NOT contains(searchable, lower(t)))) = 0 THEN 30 ELSE 0 END + CASE WHEN len(toks) > 0 AND len(list_filter(toks, lambda t: NOT contains(lower(product_name), lower(t)))) = 0 THEN 20 ELSE 0 END
          + coalesce(list_sum(list_transform(toks, lambda t: CASE WHEN contains(lower(product_name), lower(t)) THEN 6 ELSE 0 END + CASE WHEN contains(lower(brand), lower(t)) THEN 5 ELSE 0 END + CASE WHEN contains(lower(concat_ws('|', type, category_level1, category_level2)), lower(t)) THEN 4 ELSE 0 END + CASE WHEN contains(searchable, lower(t)) THEN 1 ELSE 0 END)), 0)) AS score FROM pl)
        SELECT query_id, query, CAST(row_number() OVER ({BEST.format(s='score')}) AS BIGINT) AS rank, product_code, product_name, score, confidence FROM sc QUALIFY rank <= 10""",
        "query_log",
        "products",
    ),
    "search_log_facts": with_views(f"{META} SELECT query_id, {', '.join(metadata.POSITIVE)}, query_id % 5 = 0 AS fallback_triggered, query_id % 10 = 0 AS fallback_failed, query_id % 4 AS result_count, CASE WHEN query_id % 10 = 0 THEN 'fallback_failed' WHEN query_id % 5 = 0 THEN 'llm_fallback' ELSE 'deterministic' END AS metadata_source,"
        f" list_filter([{', '.join(f'CASE WHEN {f} IS NOT NULL THEN {chr(39)}{f}{chr(39)} END' for f in metadata.POSITIVE)}], lambda x: x IS NOT NULL) AS applied_filters, query_id % 4 = 0 AS empty FROM md", "query_log"),
    "normalize_queries": with_views(f"WITH {TOKENS} SELECT query_id, query, tokens, catalog, list_filter(catalog, lambda t: t <> '' AND NOT {IS_CONSTRAINT.format(t='t')} AND NOT list_contains({_list(D.SOFT_TOKENS)}, lower(t)))[1:12] AS hard, array_to_string(tokens, ' ') AS normalized FROM cat2", "query_log"),
    "query_text_norms": f"""SELECT doc_id, {FOLD.replace('@', 'text')} AS folded, regexp_replace(translate(lower(trim(regexp_replace(coalesce(text, ''), '[‌!-/:-@\\[-`{{-~]+', ' ', 'g'), ' ')), 'يىك', 'ییک'), '\\s+', ' ', 'g') AS named,
        replace(replace(lower(trim(coalesce(text, ''), ' ')), chr(10), ' '), '  ', ' ') AS evaluated, {_squeeze("replace(coalesce(text, ''), '‌', ' ')")} AS chunked,
        len(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-zA-Z؀-ۿ]+')) AS n_bm25, len(list_filter(string_split(lower({FOLD.replace('@', 'text')}), ' '), lambda t: t <> '')) AS n_folded FROM documents""",
    "load_catalog": with_views(f"WITH {CATALOG} SELECT product_code, brand_key, searchable, lower(product_name) AS norm_name, price, enabled FROM catalog", "products"),
    "extract_price": with_views(
        f"""WITH t AS (SELECT query_id, translate({NORM}, '{X.FOREIGN_DIGITS}', '{X.ASCII_DIGITS}') AS s FROM query_log),
        g AS (SELECT query_id, regexp_extract(s, '{BETWEEN}', 1) AS b1, regexp_extract(s, '{BETWEEN}', 2) AS b2, regexp_extract(s, '{BETWEEN}', 3) AS b3, regexp_extract(s, '{BETWEEN}', 4) AS b4,
              regexp_extract(s, '{SPACED}', 1) <> '' AS sp, CASE WHEN regexp_extract(s, '{SPACED}', 1) <> '' THEN regexp_extract(s, '{SPACED}', 1) ELSE regexp_extract(replace(s, ' ', ''), '{COMPACT}', 1) END AS bound,
              CASE WHEN regexp_extract(s, '{SPACED}', 1) <> '' THEN regexp_extract(s, '{SPACED}', 2) ELSE regexp_extract(replace(s, ' ', ''), '{COMPACT}', 2) END AS num,
              CASE WHEN regexp_extract(s, '{SPACED}', 1) <> '' THEN regexp_extract(s, '{SPACED}', 3) ELSE regexp_extract(replace(s, ' ', ''), '{COMPACT}', 3) END AS scale FROM t),
        a AS (SELECT query_id, bound, b1, {_amount('b1', "(CASE WHEN b2 <> '' THEN b2 ELSE b4 END)")} AS lo, {_amount('b3', "(CASE WHEN b4 <> '' THEN b4 ELSE b2 END)")} AS hi, {_amount('num', 'scale')} AS amount FROM g)
        SELECT query_id, CASE WHEN b1 <> '' AND lo IS NOT NULL AND hi IS NOT NULL THEN lo WHEN bound IN ('بالای', 'بالا') THEN amount END AS price_min,
               CASE WHEN b1 <> '' AND lo IS NOT NULL AND hi IS NOT NULL THEN hi WHEN bound = 'زیر' THEN amount END AS price_max FROM a""",
        "query_log",
    ),
    "extract_phrases": with_views(
        f"""WITH x AS (SELECT query_id, {NORM} AS n, ' ' || lower({NORM}) || ' ' AS t FROM query_log)
        SELECT query_id, {_first(D.brand_aliases())} AS brand, {_first(D.CATEGORIES)} AS category, {_first(D.same(D.COLORS))} AS color, {_first(D.same(D.MATERIALS))} AS material, {_first(D.same(D.GENDERS))} AS gender,
        CASE WHEN regexp_matches(n, 'ناموجود|موجود نیست') THEN false WHEN regexp_matches(n, 'موجوده|موجود([^\\p{{L}}\\p{{N}}_]|$)') THEN true END AS availability, {_all(D.CATEGORIES)} AS categories FROM x""",
        "query_log",
    ),
    "hard_filters": with_views(f"WITH {PAIRS} SELECT query_id, count(*) AS n, min(product_code) AS least, max(product_code) AS most FROM pairs GROUP BY query_id", "products", "search_cases"),
    "product_search": with_views(f"WITH {TOP} SELECT query_id, product_code, CAST(score AS DOUBLE) AS score, rank FROM best", "products", "search_cases"),
    "two_stage_topk": with_views(
        f"""WITH {PAIRS}, named AS (SELECT *, {NAME_SCORE} AS name_score FROM pairs), pool AS (SELECT * FROM named QUALIFY row_number() OVER ({BEST.format(s='name_score')}) <= 80),
        scored AS (SELECT *, {SCORE} + name_score AS score FROM pool) SELECT query_id, product_code, CAST(score AS DOUBLE) AS score, row_number() OVER ({BEST.format(s='score')}) AS rank FROM scored QUALIFY rank <= 10""",
        "products",
        "search_cases",
    ),
    "search_diag": with_views(
        f"""WITH {SCORED}, {QRELS}, ranked AS (SELECT query_id, product_code, product_name, row_number() OVER ({BEST.format(s='score')}) AS rank FROM scored),
        c AS (SELECT query_id, count(*) AS filtered, list(product_code ORDER BY rank) FILTER (rank <= 10) AS top_codes, string_agg(product_name, ' | ' ORDER BY rank) FILTER (rank <= 3) AS preview FROM ranked GROUP BY 1),
        g AS (SELECT query_id, count(*) AS gold, list_sort(list(product_code)) AS gold_codes, min(CASE WHEN rank <= 500 THEN rank END) AS best_rank FROM ranked JOIN qrels USING (query_id, product_code) GROUP BY 1)
        SELECT q.query_id, coalesce(filtered, 0) AS filtered, coalesce(gold, 0) AS gold_filtered, coalesce(gold_codes, []) AS gold_codes, best_rank, coalesce(top_codes, []) AS top_codes, coalesce(preview, '') AS preview FROM search_cases q LEFT JOIN c USING (query_id) LEFT JOIN g USING (query_id)""",
        "products",
        "search_cases",
    ),
    "classical_score": with_views(f"WITH {PAIRS} SELECT query_id, product_code, CAST({CLASSICAL} AS DOUBLE) AS score FROM pairs", "products", "search_cases"),
    "hybrid_search": with_views(
        f"""WITH {PAIRS}, wd AS (SELECT product_code, list_filter(string_split({FOLD.replace('@', 'searchable')}, ' '), lambda t: t <> '') AS words FROM catalog), tot AS (SELECT count(*) AS n, greatest(avg(len(words)), 1.0) AS avgdl FROM wd),
        df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(words)) AS term FROM wd) GROUP BY 1),
        qt AS (SELECT query_id, unnest({_dedupe("string_split(rank_query, ' ')")}) AS term FROM search_cases), tf AS (SELECT product_code, term, count(*) AS tf FROM (SELECT product_code, unnest(words) AS term FROM wd) GROUP BY ALL),
        lex AS (SELECT query_id, product_code, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(len(words), 1) / avgdl))) AS lexical FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN wd USING (product_code), tot GROUP BY 1, 2),
        pool AS (SELECT pairs.*, round(coalesce(lexical, 0), 6) AS lexical, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS dense FROM pairs LEFT JOIN lex USING (query_id, product_code) JOIN embeddings a ON a.vec_id = length(query_id) * 7 % 500 JOIN embeddings b ON b.vec_id = CAST(product_code AS BIGINT) % 500),
        fu AS (SELECT *, round(0.6 * CASE WHEN max(dense) OVER w > min(dense) OVER w THEN (dense - min(dense) OVER w) / (max(dense) OVER w - min(dense) OVER w) ELSE 1 END + 0.4 * CASE WHEN max(lexical) OVER w > min(lexical) OVER w THEN (lexical - min(lexical) OVER w) / (max(lexical) OVER w - min(lexical) OVER w) ELSE 1 END, 6) AS fused FROM pool WINDOW w AS (PARTITION BY query_id)),
        best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, product_code) AS fused_rank FROM fu QUALIFY fused_rank <= 50)
        SELECT query_id, product_code, CAST({CLASSICAL} AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id ORDER BY {CLASSICAL} DESC, fused_rank) AS rank FROM best QUALIFY rank <= 10""",
        "products",
        "search_cases",
    ),
    "filter_exclusions": with_views(f"WITH {CATALOG}, {QRELS} SELECT query_id, product_code, {EXCLUDED} AS exclusions FROM qrels JOIN catalog c USING (product_code) JOIN search_cases q USING (query_id)", "products", "search_cases"),
    "classify_narrow": with_views(f"WITH {SCORED}, {QRELS}, {DIAG} SELECT * FROM k", "products", "search_cases"),
    "diagnostic_rollup": with_views(
        f"""WITH {SCORED}, {QRELS}, {DIAG}, r AS (SELECT NULL AS grp, *, best_rank IS NULL OR best_rank > 10 AS failed FROM k WHERE gold > 0 UNION ALL SELECT query_type, *, best_rank IS NULL OR best_rank > 10 FROM k WHERE gold > 0),
        n AS (SELECT grp, class, count(*) AS n FROM (SELECT grp, CASE WHEN failure_class IS NOT NULL THEN failure_class WHEN grp IS NULL AND failed THEN 'UNCLASSIFIED_FAIL' END AS class FROM r) WHERE class IS NOT NULL GROUP BY 1, 2),
        t AS (SELECT grp, arg_min(class, (-n, class)) AS top_failure, max(n) AS top_n, string_agg(class || '=' || n, ',' ORDER BY class) AS classes FROM n GROUP BY 1),
        s AS (SELECT grp, count(*) AS cases, {_mean('(gold_filtered > 0)::INT', 'gold_passed')}, {', '.join(_mean(f'coalesce(best_rank <= {k}, false)::INT', f'candidate_recall_{k}') for k in (20, 50, 100, 500))}, {', '.join(_mean(f'coalesce(best_rank <= {k}, false)::INT', f'hit_{k}') for k in (3, 5, 10))}, {_mean('coalesce(1 / best_rank, 0)', 'mrr')},
          {_mean('CASE WHEN gold_ranked > 0 THEN list_sum(list_transform(range(1, least(gold_ranked, 10) + 1), lambda i: 1 / log2(i + 1))) / list_sum(list_transform(range(1, least(gold, 10) + 1), lambda i: 1 / log2(i + 1))) END', 'ndcg_10')}, count(*) FILTER (failed) AS failed, count(*) FILTER (failed AND gold_filtered > 0) AS failed_gold_passed FROM r GROUP BY 1)
        SELECT s.grp AS query_type, s.* EXCLUDE (grp), top_failure, top_n, classes, round(failed_gold_passed / nullif(failed, 0), 6) AS failed_gold_share FROM s LEFT JOIN t ON s.grp IS NOT DISTINCT FROM t.grp""",
        "products",
        "search_cases",
    ),
    "apply_model_order": with_views(f"WITH {TOP}, {QRELS} SELECT query_id, product_code, rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN q.product_code IS NOT NULL THEN md5(best.product_code) END NULLS LAST, rank) AS new_rank FROM best LEFT JOIN (SELECT DISTINCT * FROM qrels) q USING (query_id, product_code)", "products", "search_cases"),
    "candidate_payload": with_views(f"WITH {TOP} SELECT query_id, rank, product_code, product_name, brand, type AS category, coalesce(special_price, sum_of_price) AS price FROM best", "products", "search_cases"),
}
