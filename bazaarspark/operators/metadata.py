"""What a product query asks for: brand, category and other filters, and how sure that reading is.

All of it is column expressions over a table of queries: dictionaries have a fixed size and are written into the plan, so that a
query log of any length is one pass without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarspark.functions import dictionaries as D
from bazaarspark.functions import text as X

POSITIVE = ["brand", "category", "color", "material", "gender", "price_min", "price_max", "availability"]
PENALTY = 0.35


def normalize_queries(queries: DataFrame, col: str = "query") -> DataFrame:
    """Adds ``tokens``, ``catalog``, ``hard`` and ``normalized``."""
    out = queries.withColumn("tokens", X.search_tokens(col))
    out = out.withColumn("catalog", X.catalog_tokens(F.col("tokens")))
    return out.withColumns({"hard": X.hard_tokens(F.col("catalog")), "normalized": F.array_join("tokens", " ")})


def brand_dictionary(spark, brands: dict[str, list[str]] | None = None) -> DataFrame:
    """(alias, canonical, ord)."""
    return spark.createDataFrame([(a, c, i) for i, (a, c) in enumerate(D.brand_aliases(brands))], "alias string, canonical string, ord int")


def _word_map(pairs: list[tuple[str, str]]) -> Column:
    """canonical -> the words that it accounts for."""
    words: dict[str, list[str]] = {}
    for alias, canonical in pairs:
        words.setdefault(canonical, [])
        words[canonical] += [w for w in (*alias.lower().split(), alias.lower(), *canonical.lower().split()) if w not in words[canonical]]
    return F.create_map(*[x for k, ws in words.items() for x in (F.lit(k), F.array(*map(F.lit, ws)))])


def brand_keys(brand: Column) -> Column:
    """All spellings of a canonical brand."""
    keys: dict[str, list[str]] = {}
    for alias, canonical in D.brand_aliases():
        keys.setdefault(canonical, []).append(alias)
    return F.try_element_at(F.create_map(*[x for k, ws in keys.items() for x in (F.lit(k), F.array(*map(F.lit, sorted(ws))))]), brand)


def canonical_brand(c: Column) -> Column:
    """The canonical name of a spelling in lower case; other names as they are, trimmed and in lower case."""
    names = F.create_map(*[F.lit(x) for alias, canonical in D.brand_aliases() for x in (alias, canonical)])
    return F.trim(F.lower(F.coalesce(F.try_element_at(names, F.lower(X.normalize_text(c))), c)))


def same_brand(a: Column, b: Column) -> Column:
    """Whether two names are of one brand: equal, or spellings of one canonical name."""
    return F.when((F.length(a) > 0) & (F.length(b) > 0), (F.lower(F.trim(a)) == F.lower(F.trim(b))) | (canonical_brand(a) == canonical_brand(b))).otherwise(False)


def excluded_brands(c: Column | str) -> Column:
    """struct(remaining, excluded): brands that a query rules out, longest alias first, and the text without them."""
    prefix = "|".join(D.NEGATIVE_PREFIXES)
    entries = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("alias"), F.lit(rf"(?i)(^|\s)(?:{prefix})\s+{a}(\s|$)").alias("before"), F.lit(rf"(?i)(^|\s)از\s+(?:برند\s+)?{a}\s+نه(\s|$)").alias("around")) for a, n in D.longest_first(D.brand_aliases())])

    def step(acc: Column, e: Column) -> Column:
        pattern = F.when(F.regexp_like(acc["remaining"], e["before"]), e["before"]).when(F.regexp_like(acc["remaining"], e["around"]), e["around"])
        hit = ~F.array_contains(acc["excluded"], e["name"]) & pattern.isNotNull()
        left = F.trim(F.regexp_replace(F.regexp_replace(acc["remaining"], F.coalesce(pattern, F.lit("(^)($)")), F.lit("$1$2")), r"(?U)\s+", " "))
        return F.struct(F.when(hit, left).otherwise(acc["remaining"]).alias("remaining"), F.when(hit, F.array_append(acc["excluded"], e["name"])).otherwise(acc["excluded"]).alias("excluded"))

    start = lambda f: F.struct(f.alias("remaining"), F.array().cast("array<string>").alias("excluded"))
    named = lambda f: X.once(F.lower(f), lambda low: F.filter(entries, lambda e: F.contains(low, e["alias"])))
    return X.once(X.fold_text(c), lambda f: F.when(f.rlike("بدون|به\\s+جز|غیر\\s+از|نه"), F.aggregate(named(f), start(f), step)).otherwise(start(f)))


def has_positive(prefix: str = "") -> Column:
    found = F.lit(False)
    for f in POSITIVE:
        found = found | F.col(prefix + f).isNotNull()
    return found


def leftover_tokens(tokens: Column, category: Column | None = None) -> Column:
    """Catalog tokens that no filter accounts for."""
    category = F.col("category") if category is None else category
    empty = F.array().cast("array<string>")
    plain = [F.coalesce(F.array_append(F.split(F.lower(c), " "), F.lower(F.col(c))), empty) for c in ("color", "material", "gender")]
    used = F.concat(F.coalesce(F.try_element_at(_word_map(D.brand_aliases()), F.col("brand")), empty), F.coalesce(F.try_element_at(_word_map(D.CATEGORIES), category), empty), *plain)
    priced = F.col("price_min").isNotNull() | F.col("price_max").isNotNull()
    return X.once(used, lambda words: F.filter(tokens, lambda t: ~F.array_contains(words, F.lower(t)) & ~(priced & X.is_price_token(t))))


def _embedded(c: Column, category: Column, leftover: Column) -> Column:
    """Whether the category is only part of another product's name."""
    folded, name = X.fold_text(c), X.fold_text(category)
    extended = F.arrays_overlap(F.transform(leftover, lambda t: F.lower(X.fold_text(t))), F.array(*map(F.lit, D.PHRASE_EXTENDERS)))
    # Compiling a pattern for a row costs more than finding out that it can't match.
    joined = F.contains(folded, F.lit("و")) & F.regexp_like(folded, F.concat(name, F.lit(r"\s+و\s+\S+")))
    mask = (name == "رنگ مو") & X.has_phrase(folded, F.lit("ماسک"))
    return category.isNotNull() & (extended | joined | mask)


def metadata_extract(queries: DataFrame, col: str = "query", allow_negatives: bool = True) -> DataFrame:
    """Adds brand, category, color, material, gender, price_min, price_max, availability, exclude_brands and leftover."""
    negative = excluded_brands(col) if allow_negatives else F.struct(X.text(col).alias("remaining"), F.array().cast("array<string>").alias("excluded"))
    q = queries.withColumn("_negative", negative)
    q = q.withColumn("exclude_brands", F.col("_negative.excluded")).withColumn("_working", F.when(F.size("exclude_brands") > 0, F.col("_negative.remaining")).otherwise(X.text(col)))
    w = F.col("_working")
    q = q.withColumns(
        {
            "brand": X.first_phrase(w, D.brand_aliases()),
            "_category": X.first_phrase(w, D.CATEGORIES),
            "color": X.first_phrase(w, D.same(D.COLORS)),
            "material": X.first_phrase(w, D.same(D.MATERIALS)),
            "gender": X.first_phrase(w, D.same(D.GENDERS)),
            "_price": X.extract_price(w),
            "availability": X.extract_availability(w),
            "_tokens": X.catalog_tokens(X.search_tokens(w)),
            "_all": X.catalog_tokens(X.search_tokens(col)),
        }
    )
    q = q.withColumns({"brand": F.when(~F.array_contains("exclude_brands", F.col("brand")), F.col("brand")), "price_min": F.col("_price.price_min"), "price_max": F.col("_price.price_max")})
    q = q.withColumn("category", F.when(~_embedded(w, F.col("_category"), leftover_tokens(F.col("_tokens"), F.col("_category"))), F.col("_category")))
    q = q.withColumn("leftover", leftover_tokens(F.col("_all")))
    return q.drop("_negative", "_working", "_category", "_price", "_tokens", "_all")


def name_tokens(c: Column | str) -> Column:
    """Search tokens without prices, folded, each once, twelve at most."""
    return F.slice(X.keep_order_unique(F.filter(X.search_tokens(c), lambda t: ~X.is_price_token(t))), 1, 12)


def near_miss_brand(tokens: Column) -> Column:
    """The first token that is one edit away from a brand's alias without being one; both of four letters at least."""
    keys = [a for a, _ in D.brand_aliases()]
    long = F.array(*[F.lit(a) for a in keys if len(a) >= 4])
    close = lambda t: X.once(F.lower(X.fold_text(t)), lambda low: (F.length(low) >= 4) & F.exists(long, lambda a: F.levenshtein(low, a, 1) >= 0))
    return F.get(F.filter(tokens, lambda t: ~X.soft(t) & ~F.lower(t).isin(*keys) & close(t)), F.lit(0))


def metadata_confidence(read: DataFrame, col: str = "query", threshold: float = 0.75) -> DataFrame:
    """Adds near_miss, reasons, score, locked_fields and needs_llm to what :func:`metadata_extract` gives."""
    q = read.withColumn("_left", F.filter("leftover", lambda t: (F.length(t) > 0) & ~X.soft(t))).withColumn("_raw", X.first_phrase(col, D.CATEGORIES))
    q = q.withColumn("near_miss", F.when(F.col("brand").isNull(), near_miss_brand(F.col("_left"))))
    tentative = leftover_tokens(X.catalog_tokens(X.search_tokens(col)), F.col("_raw"))
    extended = F.arrays_overlap(F.transform("_left", lambda t: F.lower(X.fold_text(t))), F.array(*map(F.lit, D.PHRASE_EXTENDERS)))
    t = X.text(col)
    reasons = [
        F.when(F.col("_raw").isNotNull() & F.col("category").isNull() & _embedded(F.col(col), F.col("_raw"), tentative), F.lit("ambiguous_category")),
        F.when(F.size(X.all_phrases(col, D.CATEGORIES)) > 1, F.lit("conflicting_metadata")),
        F.when(F.col("near_miss").isNotNull(), F.lit("unknown_or_near_miss_brand")),
        F.when(F.col("category").isNull() & extended, F.lit("partial_product_phrase")),
        F.when(~has_positive(), F.when(t.rlike(D.COLLOQUIAL), F.lit("colloquial_without_reliable_metadata")).when(t.rlike(D.IMPLICIT_USE + "|مرطوب"), F.lit("implicit_use_without_category"))),
    ]
    q = q.withColumn("reasons", F.array_compact(F.array(*reasons)))
    q = q.withColumn("score", F.greatest(F.lit(0.0), F.round(1 - PENALTY * F.size("reasons"), 6)))
    locked = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in POSITIVE], F.when(F.size("exclude_brands") > 0, F.lit("exclude_brands"))))
    return q.withColumns({"locked_fields": locked, "needs_llm": (F.col("score") < threshold) & (F.size("reasons") > 0)}).drop("_left", "_raw")


def gate_columns(read: DataFrame, col: str = "query", candidates: str | None = None) -> DataFrame:
    """Adds needs_understanding and, with a column of candidate counts, needs_rerank."""
    t = X.text(col)
    priced = F.col("price_min").isNotNull() | F.col("price_max").isNotNull()
    softly = t.rlike("|".join((D.COLLOQUIAL, D.IMPLICIT_USE, D.IMPLICIT_PRICE, D.QUALITY, D.COMPLEX_INTENT)))
    understand = (t.rlike(D.IMPLICIT_PRICE) & ~priced) | (t.rlike(D.IMPLICIT_USE) & F.col("category").isNull()) | t.rlike(D.COLLOQUIAL) | (~has_positive() & (F.size("leftover") <= 1) & softly)
    out = read.withColumn("needs_understanding", understand)
    if candidates:
        vague = (F.size("leftover") > 0) & F.col("brand").isNull() & F.col("category").isNull()
        out = out.withColumn("needs_rerank", (F.col(candidates) > 1) & (t.rlike("|".join((D.COLLOQUIAL, D.QUALITY, D.IMPLICIT_USE, D.COMPLEX_INTENT))) | vague))
    return out


PAYLOAD = "brand string, category_or_type string, color string, material string, gender string, price_min string, price_max string, availability string, price_intent string, confidence string, attributes array<string>"


def merge_model_metadata(read: DataFrame, payloads: DataFrame, key: str = "query_id", col: str = "query", threshold: float = 0.7) -> DataFrame:
    """Fills what the dictionaries left open from model answers, given as JSON (``key``, ``payload``).

    Answers under the threshold change nothing. Names must be known; prices need a price in the query, availability
    its mention; a category that was set aside as part of another name isn't brought back.
    """
    m = F.from_json("payload", PAYLOAD)
    q = read.join(payloads.select(key, m.alias("_m")), key, "left")
    confidence = F.least(F.greatest(F.coalesce(F.col("_m.confidence").try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    q = q.withColumn("model_confidence", confidence)
    sure = F.col("model_confidence") >= threshold
    brands = F.create_map(*[F.lit(x) for a, c in D.brand_aliases() for x in (a, c)])
    brand = F.try_element_at(brands, F.lower(F.trim(F.replace(F.col("_m.brand"), F.lit(X.ZWNJ), F.lit("")))))
    names: dict[str, str] = {}
    for alias, canonical in D.longest_first(D.CATEGORIES):
        names.setdefault(alias, canonical)
        names.setdefault(canonical, canonical)
    category = F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.lower(X.normalize_text("_m.category_or_type")))
    raw = X.first_phrase(col, D.CATEGORIES)
    aside = (category == raw) & _embedded(F.col(col), raw, leftover_tokens(X.catalog_tokens(X.search_tokens(col)), raw))
    asked = X.extract_price(col)
    priced = asked["price_min"].isNotNull() | asked["price_max"].isNotNull()
    said = X.text(col).rlike("ناموجود|موجود")
    filled = {
        "brand": brand,
        "category": F.when(~F.coalesce(aside, F.lit(False)), category),
        "color": X.first_phrase("_m.color", D.same(D.COLORS)),
        "material": X.first_phrase("_m.material", D.same(D.MATERIALS)),
        "gender": X.first_phrase("_m.gender", D.same(D.GENDERS)),
        "price_min": F.when(priced, F.col("_m.price_min").try_cast("double")),
        "price_max": F.when(priced, F.col("_m.price_max").try_cast("double")),
        "availability": F.when(said & F.col("_m.availability").isin("true", "false"), F.col("_m.availability") == "true"),
    }
    return q.withColumns({c: F.coalesce(F.col(c), F.when(sure, v)) for c, v in filled.items()} | {"price_intent": F.when(F.col("_m.price_intent").isin("budget", "premium", "range"), F.col("_m.price_intent"))}).drop("_m")
