"""Alignment of old chunks with new ones: a set-similarity join with prefix and length filters, and a piece index for containment.

Words of a page have one order, the rarest first. Two sets whose Jaccard similarity reaches a threshold share one of the first words of
either, the fewer the higher the threshold, and have sizes of that ratio; so chunks meet by these words only. A text that holds another
one also holds its rarest piece of three letters, by which the two meet. Pairs that meet are scored, so that their number grows with the
matches, not with the square of a page. Pages of so few texts that all their pairs are a bounded number need no index; their pairs are
scored as they are. Chunks of one text are one chunk until the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarspark.functions import text as X
from bazaarspark.sources import scratch

#: Scores are rounded to six places.
SLACK = 1e-6
PIECE = 3
#: Pairs of a page that are scored without an index.
FEW = 1 << 14


def _pieces(c: Column, size: int) -> Column:
    """The distinct pieces of ``size`` letters."""
    starts = F.when(F.length(c) >= size, F.sequence(F.lit(1), F.length(c) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, F.lit(size))))


def _texts(chunks: DataFrame, name: str, pick) -> DataFrame:
    """One row for each text of a page, by its smallest or largest chunk."""
    rows = chunks.select("page", F.col("chunk_id").alias("id"), X.chunk_norm("content").alias("text"))
    return rows.groupBy("page", "text").agg(pick("id").alias(name))


def _ordered(rows: DataFrame, frequency: DataFrame, key: str) -> DataFrame:
    """(page, key, n, words): words of each text, the rarest first."""
    words = rows.select("page", key, F.explode(F.array_distinct(X.bm25_tokens("text"))).alias("word"))
    return words.join(frequency, ["page", "word"]).groupBy("page", key).agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("df", "word"))).alias("words"))


def similar_pairs(old: DataFrame, new: DataFrame, threshold: float) -> DataFrame:
    """(page, old, new) of texts whose words may reach the threshold: by prefixes and sizes."""
    words = old.select("page", "text").unionByName(new.select("page", "text")).select("page", F.explode(F.array_distinct(X.bm25_tokens("text"))).alias("word"))
    frequency = words.groupBy("page", "word").agg(F.count("*").alias("df"))
    least = threshold - SLACK

    def prefix(rows: DataFrame, key: str) -> DataFrame:
        first = F.slice("words", 1, F.col("n") - F.ceil(F.col("n") * least - SLACK).cast("int") + 1)
        return _ordered(rows, frequency, key).select("page", key, F.col("n").alias(key + "_n"), F.explode(F.transform(first, lambda w: w["word"])).alias("word"))

    pairs = prefix(old, "old").join(prefix(new, "new"), ["page", "word"])
    return pairs.where((F.col("old_n") >= F.col("new_n") * least) & (F.col("new_n") >= F.col("old_n") * least)).select("page", "old", "new").distinct()


def _inside(part: DataFrame, whole: DataFrame, key: str, other: str) -> DataFrame:
    """(page, key, other): texts of ``part`` that may lie in one of ``whole``, by the rarest piece of them that ``whole`` has."""
    asked = part.where("text <> ''").select("page", key, F.explode(F.when(F.length("text") >= PIECE, _pieces(F.col("text"), PIECE)).otherwise(F.array("text"))).alias("piece"))
    short = asked.where(F.length("piece") < PIECE).select("page", "piece").distinct()
    held = whole.select("page", other, F.explode(_pieces(F.col("text"), PIECE)).alias("piece"))
    for size in range(1, PIECE):
        held = held.unionByName(whole.select("page", other, F.explode(_pieces(F.col("text"), size)).alias("piece")).join(short, ["page", "piece"], "left_semi"))
    counts = held.groupBy("page", "piece").agg(F.count("*").alias("df"))
    every = asked.groupBy("page", key).agg(F.count("*").alias("pieces"))
    rarest = asked.join(counts, ["page", "piece"]).groupBy("page", key).agg(F.min_by("piece", F.struct("df", "piece")).alias("piece"), F.count("*").alias("found"))
    rarest = rarest.join(every, ["page", key]).where("found = pieces").select("page", key, "piece")  # else nothing holds it
    return rarest.join(held, ["page", "piece"]).select("page", key, other)


def candidate_pairs(old: DataFrame, new: DataFrame, threshold: float) -> DataFrame:
    """(page, old, new) of different texts (page, text, old or new) that are worth scoring."""
    count = lambda rows, name: rows.groupBy("page").agg(F.count("*").alias(name))
    pages = scratch.written(count(old, "a").join(count(new, "b"), "page"), "align-pages")
    large = pages.where(F.col("a") * F.col("b") > FEW).select("page")
    small = pages.where(F.col("a") * F.col("b") <= FEW).select("page")
    few = old.join(small, "page", "left_semi").select("page", "old").join(new.select("page", "new"), "page")
    if large.isEmpty():
        return few
    return few.unionByName(indexed_pairs(old.join(large, "page", "left_semi"), new.join(large, "page", "left_semi"), threshold))


def indexed_pairs(old: DataFrame, new: DataFrame, threshold: float) -> DataFrame:
    """The pairs that share a word of their prefixes, or a piece where one may lie in the other."""
    inside = _inside(old, new, "old", "new").unionByName(_inside(new, old, "new", "old").select("page", "old", "new"))
    return similar_pairs(old, new, threshold).unionByName(inside).distinct()


def align_chunks(old: DataFrame, new: DataFrame, threshold: float = 0.45) -> DataFrame:
    """(page, old_id, new_id, score): equal chunks of a page, else the most similar one by Jaccard of words, 0.99 if one holds the other.

    Chunks are (page, chunk_id, content). Ties go to the larger new identifier.
    """
    mine = old.select("page", F.col("chunk_id").alias("old_id"), X.chunk_norm("content").alias("text"))
    theirs = new.select("page", F.col("chunk_id").alias("new_id"), X.chunk_norm("content").alias("text"))
    equal = mine.join(theirs, ["page", "text"]).select("page", "old_id", "new_id", F.lit(1.0).alias("score"))
    targets = scratch.written(_texts(new, "new", F.max), "align-new")
    rest = scratch.written(_texts(old, "old", F.min).join(targets.select("page", "text"), ["page", "text"], "left_anti"), "align-old")
    pairs = candidate_pairs(rest, targets, threshold)
    both = pairs.join(rest.withColumnRenamed("text", "a"), ["page", "old"]).join(targets.withColumnRenamed("text", "b"), ["page", "new"])
    words = lambda c: F.array_distinct(X.bm25_tokens(c))
    common, sizes = F.size(F.array_intersect(words("a"), words("b"))), F.size(words("a")) + F.size(words("b"))
    jaccard = F.coalesce(common / F.nullif(sizes - common, F.lit(0)), F.lit(0.0))
    holds = (F.contains("a", F.col("b")) | F.contains("b", F.col("a"))) & (F.length("a") > 0) & (F.length("b") > 0)
    scored = both.select("page", "old", F.col("a").alias("text"), "new", F.round(F.greatest(jaccard, F.when(holds, 0.99).otherwise(0.0)), 6).alias("score"))
    best = scored.where(F.col("score") >= threshold).groupBy("page", "text").agg(F.max(F.struct("score", "new")).alias("best"))
    return equal.unionByName(mine.join(best, ["page", "text"]).select("page", "old_id", F.col("best.new").alias("new_id"), "best.score"))
