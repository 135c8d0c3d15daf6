"""Mixing sources to target weights by entropy balancing.

The mix is the set of document rates closest in entropy to taking each document once, under one constraint for each source:
the words of its documents, times their rates, are its target, and no rate is above ``cap``. The solution tilts rates
exponentially, rate = min(cap, exp(lambda_s * size)), with the multipliers of the convex dual. Newton iterations find them:
each step sums size * rate and its derivative over all documents of all sources in one Spark aggregate. Documents of one source and size
have one rate, so that the sums run over a written table of (source, size, documents), which is counted once with partial sums.

Rates are rounded into copies by sequential Poisson sampling: a document is taken floor(rate) times, and once more in the
order of u / fraction, where u is a uniform number from a digest of its identifier, until the source's target is met; the last
one is cut. The place where that order is cut is found in three steps, over 256 ranges, over 256 parts of one and then within
one of these, so that no task holds a source.
Nothing about single sources or documents comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarspark.llm import scratch
from bazaarspark.llm.text import WORD, count_words

#: Newton steps at most, and the relative error of a source's sum at which they end.
STEPS, CLOSE = 100, 1e-13
#: Ranges of the order in which documents are taken once more.
RANGES = 1 << 16
#: Sources whose plans are broadcast: all of them up to this number; beyond it, those with more than its inverse of all documents.
SHARES = 1 << 12


def _columns(id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), count_words(F.col(text_col).cast("string")).alias("size"), _order(F.col(id_col)).alias("key")]


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(*_columns(id_col, text_col, source_col))


def _order(id_col: Column) -> Column:
    return F.md5(F.coalesce(id_col.cast("string"), F.lit("")))


def _numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``nth`` from 0 in the order of code points, null last: a sort by ranges, and the rows before each range."""
    ranged = scratch.written(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("at", 33)
    counts = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))  # one row for each range
    before = counts.withColumn("before", F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).select("part", "before")
    return ranged.withColumn("part", part).join(F.broadcast(before), "part").withColumn("nth", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "before", "at")


def _targets(totals: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """Shares by weight, none above ``cap`` times its source: min(cap * size, level * weight), with the level that uses all words.

    The level rises until no more sources are capped; each step is one sum over sources.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    t = scratch.written(_numbered(totals).withColumn("weight", weight).withColumn("most", cap * F.col("source_size")), "mix-weights")
    level, capped = -1.0, -1
    while True:
        full = F.col("most") < F.lit(level) * F.col("weight")
        s = t.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("most"))).alias("fixed"), F.sum(F.when(~full, F.col("weight"))).alias("share"), F.count_if(full).alias("n")).first()
        if s["n"] == capped or not s["share"]:
            break
        level, capped = (s["all"] - (s["fixed"] or 0.0)) / s["share"], s["n"]
    return t.select("source", "source_size", F.least("most", F.lit(level) * F.col("weight")).alias("target"))


def _tilted(size: Column, lam: Column, scale: Column, cap: float) -> Column:
    return F.least(F.lit(cap), F.exp(F.least(lam * size / scale, F.lit(50.0))))


def _solved(by_size: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """``targets`` with the multiplier ``lam`` of each source, in units of ``scale`` words.

    Steps are Newton's for the logarithm of the source's sum, kept in a bracket that every sum narrows. A source whose target is
    ``cap`` times its size has all rates at the cap.
    """
    scale = F.greatest(F.lit(1.0), F.col("source_size") / F.col("docs"))
    counted = by_size.groupBy("source").agg(F.sum("n").alias("docs"))
    start = targets.join(counted, targets["source"].eqNullSafe(counted["source"])).drop(counted["source"]).withColumn("scale", scale).drop("docs")
    goal, size = F.col("target"), F.col("source_size")
    inner = (goal > 0) & (goal < cap * size * (1 - 1e-12))
    start = start.withColumns({"lam": F.when(inner, 0.0).when(goal > 0, 1e12).otherwise(0.0), "lo": F.when(goal >= size, 0.0).otherwise(-1e12), "hi": F.when(goal <= size, 0.0).otherwise(1e12), "open": inner & (goal != size)})
    now = scratch.written(start, "mix-duals")
    for _ in range(STEPS):
        open_ = now.where("open").alias("d")
        rate = _tilted(F.col("h.size"), F.col("lam"), F.col("scale"), cap)
        words = F.col("h.n") * F.col("h.size")
        sums = open_.join(by_size.alias("h"), F.col("d.source").eqNullSafe(F.col("h.source"))).groupBy("d.source").agg(
            F.sum(words * rate).alias("sum"), F.sum(F.when(rate < cap, words * rate * F.col("h.size") / F.col("scale")).otherwise(0.0)).alias("slope")
        )
        step = now.alias("d").join(sums.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")), "left")
        low, high = F.when(F.col("sum") < goal, F.col("lam")).otherwise(F.col("lo")), F.when(F.col("sum") > goal, F.col("lam")).otherwise(F.col("hi"))
        step = step.select("d.*", "sum", "slope", low.alias("low"), high.alias("high"))
        newton = F.col("lam") + F.log(goal / F.col("sum")) * F.col("sum") / F.col("slope")
        # With one end of the bracket still open, a step at most doubles; otherwise one that leaves the bracket halves it.
        reach = 2 * F.abs("lam") + 4
        inside = F.when((newton > F.col("low")) & (newton < F.col("high")) & (F.abs(newton - F.col("lam")) <= reach), newton)
        halfway = F.when(F.col("high") >= 1e12, F.col("low") + reach).when(F.col("low") <= -1e12, F.col("high") - reach).otherwise((F.col("low") + F.col("high")) / 2)
        close = F.abs(F.col("sum") / goal - 1) <= CLOSE
        moved = F.coalesce(inside, halfway)
        still = F.col("open") & ~close & (moved != F.col("lam"))
        after = step.select("source", "source_size", "target", "scale", F.when(still, moved).otherwise(F.col("lam")).alias("lam"), F.when(still, F.col("low")).otherwise(F.col("lo")).alias("lo"), F.when(still, F.col("high")).otherwise(F.col("hi")).alias("hi"), still.alias("open"))
        before, now = now, scratch.written(after, "mix-duals")
        scratch.drop(before)
        if now.where("open").isEmpty():
            break
    return now.select("source", "source_size", "target", "scale", "lam")


def _planned(rows: DataFrame, plan: DataFrame, docs: int, columns: list[str]) -> DataFrame:
    """``rows`` joined to the plan of their source (in column ``source``). The plan of up to ``SHARES`` sources is broadcast. Of
    more, only sources with a large share of the documents are, so that their rows stay where they are."""
    p = plan.select(F.col("source").alias("_source"), "source_docs", *columns)
    same = rows["source"].eqNullSafe(F.col("_source"))
    if plan.limit(SHARES + 1).count() <= SHARES:
        return rows.join(F.broadcast(p), same).drop("_source", "source_docs")
    large = F.broadcast(p.where(F.col("source_docs") * SHARES > docs))
    rest = rows.join(large, same, "left_anti").join(p.where(F.col("source_docs") * SHARES <= docs), same)
    return rows.join(large, same).unionByName(rest).drop("_source", "source_docs")


def _rates(cap: int) -> dict[str, Column]:
    """Columns of a document from its size, key and its source's ``lam`` and ``scale``: whole copies, and the place in the order of one more."""
    rate = _tilted(F.col("size"), F.col("lam"), F.col("scale"), float(cap))
    whole = F.when(F.col("target") > 0, F.floor(rate + 1e-9)).when(F.col("size") > 0, F.lit(0)).otherwise(F.lit(1)).cast("int")
    u = (F.conv(F.substring("key", 1, 13), 16, 10).cast("double") + 1) / 2**52
    fraction = rate - F.floor(rate + 1e-9)
    return {"whole": whole, "place": F.when((fraction > 1e-9) & (F.col("target") > 0) & (F.col("size") > 0), u / fraction)}


def _range() -> Column:
    """The range of a place: places below 1 are the first half."""
    return F.least(F.floor(RANGES * F.col("place") / (1 + F.col("place"))), F.lit(RANGES - 1)).cast("int")


def _reached(parts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, at, want): the part in which the words of a source, summed in order, reach ``want``, and what is left to take there."""
    upto = parts.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("at"))).alias("r")  # 256 rows at most
    w = wanted.alias("w")
    found = upto.join(w, F.col("r.source").eqNullSafe(F.col("w.source"))).where("w.want > r.upto - r.words and w.want <= r.upto")
    return found.select("r.source", "r.at", (F.col("w.want") - F.col("r.upto") + F.col("r.words")).alias("want"))


def mixing_plan(sized: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """One row for each source: its size and documents, target, multiplier, and where the order of one more copy is cut."""
    by_size = scratch.written(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-by-size")
    totals = by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    plan = _solved(by_size, _targets(totals, weights, float(cap)), float(cap))
    docs = by_size.groupBy("source").agg(F.sum("n").alias("source_docs")).alias("c")
    plan = scratch.written(plan.alias("p").join(docs, F.col("p.source").eqNullSafe(F.col("c.source"))).select("p.*", "source_docs"), "mix-plan")
    total = sized.count()

    rated = _planned(sized, plan, total, ["target", "lam", "scale"]).withColumns(_rates(cap)).withColumn("range", F.when(F.col("place").isNotNull(), _range()))
    ranges = scratch.written(rated.groupBy("source", "range").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("whole")).alias("full")), "mix-ranges")
    full = ranges.groupBy("source").agg(F.sum("full").alias("full")).alias("f")
    more = plan.alias("p").join(full, F.col("p.source").eqNullSafe(F.col("f.source"))).select("p.*", F.greatest(F.lit(0), F.round("target").cast("long") - F.col("full")).alias("more"))
    more = scratch.written(more, "mix-more")
    held = ranges.where("range is not null")
    coarse = F.shiftright("range", 8)
    first = _reached(held.groupBy("source", coarse.alias("at")).agg(F.sum("words").alias("words")), more.select("source", F.col("more").alias("want")))
    first = scratch.written(first, "mix-coarse").alias("f")
    inner = held.join(first.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")) & (coarse == F.col("at"))).select("source", F.col("range").alias("at"), "words")
    here = _reached(inner, first.select("source", "want")).alias("h").join(more.alias("p"), F.col("h.source").eqNullSafe(F.col("p.source")))
    here = scratch.written(here.select("p.source", "p.source_docs", F.col("h.at").alias("cut_range"), "h.want"), "mix-cuts")
    within = _planned(rated.where("range is not null"), here, total, ["cut_range", "want"]).where("range = cut_range")
    ties = within.groupBy("source", "want", "place", "key", "size").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source").orderBy("place", "key", "size")
    ties = ties.withColumn("upto", F.sum(F.col("size") * F.col("n")).over(order)).where("want > upto - size * n and want <= upto")
    cut = ties.select("source", F.struct("place", "key", "size").alias("cut"), F.expr("(want - upto + size * n) div n").alias("part")).alias("c")
    # Where the fractions don't reach the target (by less than rounding), every document that has one is taken once more.
    planned = more.alias("p").join(cut, F.col("p.source").eqNullSafe(F.col("c.source")), "left").select("p.*", "cut", "part")
    return scratch.written(planned.withColumn("all", F.col("cut").isNull() & (F.col("more") > 0)), "mix-plan")


PLAN = ["source_size", "target", "lam", "scale", "cut", "part", "all"]


def _extra() -> Column:
    """Words of the copy beyond the whole ones."""
    own = F.struct("place", "key", "size")
    return F.when(F.col("place").isNull(), 0).when(F.col("all") | (own < F.col("cut")), F.col("size")).when(own == F.col("cut"), F.col("part")).otherwise(0).cast("long")


def _taken(sized: DataFrame, weights: tuple[float, ...], cap: int) -> DataFrame:
    plan = mixing_plan(sized, weights, cap)
    return _planned(sized, plan, sized.count(), PLAN).withColumns(_rates(cap)).withColumn("extra", _extra())


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """One row per document: ``id_col``, ``size``, ``source_size``, ``target``, ``taken``.

    ``size`` counts words; a null text has none and nothing is taken from it. Sources in the order of their code points,
    null last, weigh ``weights``, repeating, and share 100% of all sizes; a target stops at ``cap`` times its source's
    size and the excess is shared again by weight. ``taken`` is the number of words that the mix takes, repeats counted,
    and ``cap`` times the size at most. Rows that share identifier and size where a source is cut share what is left,
    rounded down. Very long texts are counted whole; where a source gets more than its size, they reach the cap first, where it
    gets less, they go first. Reruns agree. Other columns are not read. An empty table gives an empty one.
    """
    sized = scratch.written(_sized(docs, id_col, text_col, source_col), "mix-sizes")
    return _taken(sized, weights, cap).select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The documents as the mix takes them, with all their columns: a row for each copy.

    Null, empty and blank texts weigh nothing and stay once. The last copy where a source is cut ends after the words that it
    needs, and keeps its white space. Rows repeated whole are taken each by themselves. An empty table gives an empty one.
    """
    sized = scratch.written(_sized(docs, id_col, text_col, source_col), "mix-sizes")
    plan = mixing_plan(sized, weights, cap)
    nested = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(text_col).cast("string").alias("text"), *_columns(id_col, text_col, source_col))
    rows = _planned(nested, plan, sized.count(), PLAN).withColumns(_rates(cap)).withColumn("extra", _extra())
    part = F.when((F.col("extra") > 0) & (F.col("extra") < F.col("size")), F.col("extra"))
    once_more = F.when(part.isNotNull(), F.array(part)).when(F.col("extra") > 0, F.array(F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>"))
    rows = rows.withColumn("copy", F.explode(F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("whole")), once_more)))
    head = F.expr(f"array_join(slice(regexp_extract_all(text, r'[\\x20\\x09-\\x0D]*{WORD}', 0), 1, cast(copy as int)), '')")
    cut = F.when(F.col("copy") >= 0, head).otherwise(F.col(f"doc.`{text_col}`")).alias(text_col)
    return rows.select(*[cut if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
