"""Text of queries and products as column expressions: folding, tokens, prices. They stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from bazaarspark.functions import dictionaries as D

ZWNJ = "‌"
PUNCTUATION = "[؟?!،,.;:٪%()\\[\\]{}\"'«»…]+"
NOT_WORD = r"[^\p{L}\p{N}_]+"
DIGITS = "[0-9۰-۹٠-٩]+"
FOREIGN_DIGITS, ASCII_DIGITS = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` or a function inside it reads it: Spark would put the whole
    expression in each of these places, and work it out anew for every element of a list."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def text(c: Column | str) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def squeeze(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fold_letters(c: Column) -> Column:
    return F.translate(c, "يىك", "ییک")


def fold_text(c: Column | str) -> Column:
    """Joiners deleted, letters folded, punctuation to spaces, white space collapsed."""
    return squeeze(F.regexp_replace(fold_letters(F.replace(text(c), F.lit(ZWNJ), F.lit(""))), PUNCTUATION, " "))


def normalize_text(c: Column | str) -> Column:
    """Joiners deleted and white space collapsed; punctuation and letters stay as they are."""
    return squeeze(F.replace(text(c), F.lit(ZWNJ), F.lit("")))


def keep_first(tokens: Column) -> Column:
    """Tokens in order, each but once whatever its case."""
    first = lambda ts, low: F.filter(ts, lambda t, i: F.array_position(low, F.get(low, i)) == i + 1)
    return once(tokens, lambda ts: once(F.transform(ts, lambda t: F.lower(t)), lambda low: first(ts, low)))


def keep_order_unique(tokens: Column) -> Column:
    """Folded, without blanks, each but once."""
    return keep_first(F.filter(F.transform(tokens, fold_text), lambda t: F.length(t) > 0))


def _among(t: Column, words: list[str]) -> Column:
    return t.isin(*words)


def search_tokens(c: Column | str) -> Column:
    """Filler phrases go wherever they stand, even inside a word; then filler words; then repeats."""
    bare = reduce(lambda x, p: F.replace(x, F.lit(p), F.lit(" ")), sorted(D.PHRASE_FILLERS, key=lambda p: -len(p)), fold_text(c))
    tokens = F.split(squeeze(F.regexp_replace(bare, NOT_WORD, " ")), " ")
    return keep_first(F.filter(tokens, lambda t: (F.length(t) > 0) & ~_among(t, D.TOKEN_FILLERS)))


def _constraint(t: Column) -> Column:
    return _among(t, D.CONSTRAINT_TOKENS) | t.rlike(f"^{DIGITS}\\z")


def soft(t: Column) -> Column:
    return _among(F.lower(fold_text(t)), D.SOFT_TOKENS)


def catalog_tokens(tokens: Column) -> Column:
    """Search tokens without constraint words and numbers; all of them if nothing else is left."""
    left = lambda ts: F.filter(ts, lambda t: ~_constraint(t))
    return once(tokens, lambda ts: once(left(ts), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(ts)))


def hard_tokens(tokens: Column) -> Column:
    """Tokens that a product must hold: no constraint, number or soft word; twelve at most, as in the product search."""
    return F.slice(F.filter(tokens, lambda t: (F.length(t) > 0) & ~_constraint(t) & ~soft(t)), 1, 12)


def ascii_digits(c: Column) -> Column:
    return F.translate(c, FOREIGN_DIGITS, ASCII_DIGITS)


def is_price_token(t: Column) -> Column:
    compact = F.replace(ascii_digits(F.replace(t, F.lit(ZWNJ), F.lit(""))), F.lit(" "), F.lit(""))
    return once(compact, lambda x: _among(x, D.PRICE_TOKENS) | x.rlike(r"^[0-9]+(هزارتومان|هزارتومن|هزار|میلیون|تومان|تومن)?\z"))


def bm25_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text(c)), F.lit("[0-9a-zA-Z؀-ۿ]+"), 0)


def fold_tokens(c: Column | str) -> Column:
    return F.filter(F.split(F.lower(fold_text(c)), " "), lambda t: F.length(t) > 0)


SEARCHABLE = ["product_name", "brand", "type", "sku", "product_code", "category_level1", "category_level2", "color"]


def searchable_text() -> Column:
    return F.concat_ws(" ", *SEARCHABLE)


def normalized_name(c: Column | str) -> Column:
    """Joiners and ASCII punctuation to spaces (not deleted), trimmed, lower case, letters folded, white space collapsed."""
    spaced = F.regexp_replace(text(c), "[‌!-/:-@\\[-`{-~]+", " ")
    return F.regexp_replace(fold_letters(F.lower(F.trim(spaced))), r"(?U)\s+", " ")


def eval_norm(c: Column | str) -> Column:
    """Trimmed, lower case, line feeds to spaces, then double spaces to single ones, once."""
    return F.replace(F.replace(F.lower(F.trim(text(c))), F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" "))


def chunk_norm(c: Column | str) -> Column:
    return squeeze(F.replace(text(c), F.lit(ZWNJ), F.lit(" ")))


def parse_price(c: Column | str) -> Column:
    """Digits and points of a text as a number; null if none is left or it isn't a number."""
    return F.nullif(F.regexp_replace(text(c), "[^0-9.]+", ""), F.lit("")).try_cast("decimal(38,10)")


def has_phrase(folded: Column, alias: Column) -> Column:
    """Whether a phrase stands in a text between spaces."""
    return F.contains(F.concat(F.lit(" "), folded, F.lit(" ")), F.concat(F.lit(" "), alias, F.lit(" ")))


def _held(c: Column | str, pairs: list[tuple[str, str]]) -> Column:
    """The entries whose alias stands in a text, in their order."""
    entries = F.array(*[F.struct(F.lit(f" {a} ").alias("alias"), F.lit(n).alias("name")) for a, n in pairs])
    return once(F.concat(F.lit(" "), F.lower(normalize_text(c)), F.lit(" ")), lambda low: F.filter(entries, lambda e: F.contains(low, e["alias"])))


def first_phrase(c: Column | str, pairs: list[tuple[str, str]]) -> Column:
    """The canonical name of the longest alias in a text; ties go by the dictionary's order."""
    return F.get(_held(c, D.longest_first(pairs)), F.lit(0))["name"]


def all_phrases(c: Column | str, pairs: list[tuple[str, str]]) -> Column:
    """The distinct canonical names in a text, in the dictionary's order."""
    return F.array_distinct(F.transform(_held(c, pairs), lambda e: e["name"]))


_NUMBER = "([0-9]+|یک|دو|سه|ده|بیست|صد)"
_BETWEEN = rf"بین\s*{_NUMBER}\s*(هزار|میلیون)?\s*تا\s*{_NUMBER}\s*(هزار|میلیون)?"
_SPACED = rf"(زیر|بالای|بالا)\s+{_NUMBER}\s*(هزارتومان|هزارتومن|هزار|میلیون)?"
_COMPACT = "(زیر|بالای|بالا)?([0-9]+)(هزارتومان|هزارتومن|هزار|میلیون)?"


def _amount(number: Column, scale: Column) -> Column:
    value = number.try_cast("double")
    for word, n in D.NUMBER_WORDS.items():
        value = F.when(number == word, F.lit(float(n))).otherwise(value)
    return value * F.when(scale.startswith("هزار"), F.lit(1000.0)).when(scale == "میلیون", F.lit(1_000_000.0)).otherwise(F.lit(1.0))


def extract_price(c: Column | str) -> Column:
    """struct(price_min, price_max): a range, or a bound before a number; a number alone bounds nothing.

    The scale of one end of a range holds for the other if that has none. A bound and number with a space between
    come before those without.
    """
    return once(ascii_digits(normalize_text(c)), _price_of)


def _price_of(spaced: Column) -> Column:
    compact = F.replace(spaced, F.lit(" "), F.lit(""))
    low, s1, high, s2 = (F.regexp_extract(spaced, _BETWEEN, i) for i in (1, 2, 3, 4))
    lo, hi = _amount(low, F.when(s1 != "", s1).otherwise(s2)), _amount(high, F.when(s2 != "", s2).otherwise(s1))
    is_spaced = F.regexp_extract(spaced, _SPACED, 1) != ""
    bound, number, scale = (F.when(is_spaced, F.regexp_extract(spaced, _SPACED, i)).otherwise(F.regexp_extract(compact, _COMPACT, i)) for i in (1, 2, 3))
    amount = _amount(number, scale)
    ranged = (low != "") & lo.isNotNull() & hi.isNotNull()
    return F.struct(F.when(ranged, lo).when(bound.isin("بالای", "بالا"), amount).alias("price_min"), F.when(ranged, hi).when(bound == "زیر", amount).alias("price_max"))


def extract_availability(c: Column | str) -> Column:
    t = normalize_text(c)
    return F.when(t.rlike("ناموجود|موجود نیست"), False).when(t.rlike(r"موجوده|موجود(?![\p{L}\p{N}_])"), True)
