"""The best documents of each query by BM25, without a pair for every document that shares a word with a query.

Postings are kept in blocks of falling weight with their largest and smallest weights. A score that the k-th document of a query surely
reaches comes from its heaviest words; a document can pass it only if each of its words weighs enough in it, and not by the lightest words
of the query alone. Blocks that weigh less are not read, and the light, mostly frequent words are looked up only in documents that the others
have brought up and that can still enter (MaxScore: Turtle and Flood, 1995; block maxima: Ding and Suel, 2011).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarspark.functions import text as X
from bazaarspark.functions.columns import top_n
from bazaarspark.sources import scratch

#: Blocks of a word's postings; words of a query that give its first bound, and how many times k documents they bring.
BLOCKS, HEAVY, MARGIN = 256, 3, 4
#: Scores are rounded to six places, and sums differ by their order.
SLACK = 2e-6


def postings(queries: DataFrame, docs: DataFrame, k1: float = 1.5, b: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(query_id, term, qtf), and of the words asked for (doc_id, term, w, block)."""
    terms = queries.select("query_id", F.explode(X.bm25_tokens("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    tokens = docs.select("doc_id", F.explode(X.bm25_tokens("text")).alias("term"))
    tf = tokens.join(terms.select("term").distinct(), "term", "left_semi").groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    lengths = docs.select("doc_id", F.size(X.bm25_tokens("text")).alias("len"))
    corpus = lengths.agg(F.count("*").alias("n"), F.greatest(F.avg("len"), F.lit(1.0)).alias("avgdl"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(corpus)  # one row of totals
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    fill = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    block = F.floor((1 - fill) * BLOCKS).cast("int")
    return terms, tf.join(lengths, "doc_id").join(df, "term").select("doc_id", "term", weight.alias("w"), block.alias("block"))


def bounds(terms: DataFrame, post: DataFrame, k: int) -> DataFrame:
    """Each query's words with the blocks of their postings (falling weight), the most a word can add, and what its k-th document gets."""
    blocks = post.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("w").alias("hi"), F.min("w").alias("lo"))
    upto = F.sum("n").over(Window.partitionBy("term").orderBy("block"))  # BLOCKS rows a word at most
    listed = blocks.withColumn("upto", upto).groupBy("term").agg(F.max("hi").alias("top"), F.max(F.when(F.col("upto") >= k, F.col("lo"))).alias("kth"), F.array_sort(F.collect_list(F.struct("block", "hi", (F.col("upto") - F.col("n")).alias("before")))).alias("blocks"))
    return terms.join(listed, "term").select("query_id", "term", "qtf", (F.col("qtf") * F.col("top")).alias("most"), (F.col("qtf") * F.coalesce("kth", F.lit(0.0))).alias("sure"), "blocks")


def _partial(asked: DataFrame, post: DataFrame) -> DataFrame:
    """Sums over the blocks asked for: (query_id, doc_id, part). ``asked``: query_id, term, qtf, need and its blocks."""
    read = asked.select("query_id", "term", "qtf", "need", F.explode("blocks").alias("block"))
    return read.join(post, ["term", "block"]).where("w >= need").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("qtf")).alias("part"))


def _kth(parts: DataFrame, k: int) -> DataFrame:
    best = top_n(parts, ["query_id"], [F.desc("part"), F.asc("doc_id")], k)
    return best.where(F.col("rank") == k).select("query_id", F.col("part").alias("reached"))


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int = 100, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank): exactly the ``k`` best documents of each query among those that share a word with it. Equal scores
    go by document. Repeated words of a query add again. Queries are (query_id, text) and documents (doc_id, text)."""
    terms, post = postings(queries, docs, k1, b)
    post = scratch.written(post, "bm25-postings")
    words = scratch.written(bounds(terms, post, k), "bm25-words")
    heavy = words.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("most"), "term"))).where(F.col("nth") <= HEAVY)
    early = heavy.select("query_id", "term", "qtf", F.lit(0.0).alias("need"), F.transform(F.filter("blocks", lambda x: x["before"] < MARGIN * k), lambda x: x["block"]).alias("blocks"))
    words = words.join(_kth(_partial(early, post), k), "query_id", "left")

    query, rising = Window.partitionBy("query_id"), Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    words = words.withColumn("floor", F.greatest(F.max("sure").over(query), F.coalesce("reached", F.lit(0.0))) - SLACK)
    words = words.withColumns({"all": F.sum("most").over(query), "light": F.sum("most").over(rising) < F.col("floor")})
    words = words.withColumn("spare", F.sum(F.when(F.col("light"), F.col("most")).otherwise(0.0)).over(query))
    words = scratch.written(words.withColumn("need", (F.col("floor") - (F.col("all") - F.col("most"))) / F.col("qtf") - SLACK), "bm25-bounds")
    heavy = words.where("not light").select("query_id", "term", "qtf", "need", F.transform(F.filter("blocks", lambda x: x["hi"] >= F.col("need")), lambda x: x["block"]).alias("blocks"))
    parts = scratch.written(_partial(heavy, post), "bm25-parts")

    spare = words.groupBy("query_id").agg(F.max("floor").alias("floor"), F.max("spare").alias("spare")).join(_kth(parts, k), "query_id", "left")
    able = parts.join(spare, "query_id").where(F.col("part") + F.col("spare") >= F.greatest("floor", F.coalesce("reached", F.lit(0.0)) - SLACK)).select("query_id", "doc_id", "part")
    light = able.select("query_id", "doc_id").join(words.where("light").select("query_id", "term", "qtf"), "query_id").join(post, ["doc_id", "term"])
    sums = able.unionByName(light.select("query_id", "doc_id", (F.col("w") * F.col("qtf")).alias("part"))).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
    return top_n(sums, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)
