"""Dictionaries as tables: phrases of any number found in texts, and tokens one edit away from an alias.

Both are hash joins. A phrase stands in a text as a run of whole words, so that the runs of a text with as many words as some alias has
meet the dictionary by equality. Two words at most one edit apart share a word that either gives by dropping a letter or none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarspark.functions import text as X
from bazaarspark.functions.columns import side
from bazaarspark.operators import metadata as M
from bazaarspark.sources import scratch

#: Letters that a word must have to be compared by edits.
LONG = 4


def brand_table(spark, brands: dict[str, list[str]] | None = None) -> DataFrame:
    """The brands as a dictionary table: (alias, canonical, ord)."""
    return M.brand_dictionary(spark, brands)


def phrase_matches(texts: DataFrame, dictionary: DataFrame, key: str = "query_id", col: str = "query") -> DataFrame:
    """(key, alias, canonical, ord): the aliases that stand in each text as whole words. Aliases are in lower case with single spaces."""
    sizes = F.size(F.split("alias", " "))
    lengths = sorted(r[0] for r in dictionary.select(sizes).distinct().collect())  # words of a phrase: a handful of numbers
    words = texts.select(key, F.split(F.lower(X.normalize_text(col)), " ").alias("_words"))

    def runs_of(n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size("_words") - (n - 1)), lambda i: F.array_join(F.slice("_words", i, n), " "))
        return F.when(F.size("_words") >= n, runs).otherwise(F.array().cast("array<string>"))

    runs = [runs_of(n) for n in lengths]
    found = words.select(key, F.explode(F.array_distinct(F.flatten(F.array(*runs)))).alias("alias")) if runs else words.select(key, F.lit(None).cast("string").alias("alias")).limit(0)
    return found.join(side(dictionary), "alias").select(key, "alias", "canonical", "ord")


def first_phrases(texts: DataFrame, dictionary: DataFrame, key: str = "query_id", col: str = "query") -> DataFrame:
    """(key, canonical, canonicals): of the aliases in each text the longest one's name (ties: the dictionary's order), and all names in
    that order. Texts without one are left out."""
    hits = phrase_matches(texts, scratch.written(dictionary, "phrases"), key, col)  # the dictionary is read more than once
    names = hits.groupBy(key, "canonical").agg(F.min("ord").alias("ord"), F.min(F.struct((-F.length("alias")).alias("n"), F.col("ord"), F.col("alias"))).alias("best"))
    found = names.groupBy(key).agg(F.min_by("canonical", "best").alias("first"), F.array_sort(F.collect_list(F.struct("ord", "canonical"))).alias("all"))
    return found.select(key, F.col("first").alias("canonical"), F.transform("all", lambda x: x["canonical"]).alias("canonicals"))


def _shortened(word: Column) -> Column:
    """A word, and what it is without each of its letters."""
    less = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), less))


def near_misses(tokens: DataFrame, aliases: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, token, alias): the first of each query's tokens (key, tokens) that is one edit away from an alias without being one, and the
    first such alias. Words of fewer than ``LONG`` letters and soft tokens don't count; both sides are compared folded and in lower case."""
    low = F.lower(X.fold_text("token"))
    rows = tokens.select(key, F.posexplode("tokens").alias("pos", "token")).where(~X.soft(F.col("token"))).withColumn("word", low).where(F.length("word") >= LONG)
    known = aliases.select(F.col("alias")).distinct()
    rows = rows.join(known, F.col("word") == F.col("alias"), "left_anti")
    words = rows.select("word").distinct().select("word", F.explode(_shortened(F.col("word"))).alias("part"))
    parts = known.where(F.length("alias") >= LONG).select("alias", F.explode(_shortened(F.col("alias"))).alias("part"))
    close = words.join(parts, "part").where(F.levenshtein("word", "alias", 1) >= 0).groupBy("word").agg(F.min("alias").alias("alias"))
    first = rows.join(close, "word").groupBy(key).agg(F.min(F.struct("pos", "token", "alias")).alias("m"))
    return first.select(key, "m.token", "m.alias")
