"""Line dedup by a suffix array over line identifiers.

A document is a sequence of line identifiers. The suffixes of all documents are sorted by distributed prefix doubling:
after round k, suffixes have one rank exactly if their first 2 ** k lines agree, and ranks are in the order of these
lines. Suffixes whose rank is theirs alone are in place and leave the next rounds, so that a round costs what is
still tied. Suffixes with one rank after round k are an interval of the array with a longest common prefix of 2 ** k
lines or more; a run of any length l is an interval of pairs of ranks, of its first and its last 2 ** k lines.

A repeated run counts if it holds ``min_words`` words. The shortest such runs that start and that end at each line are
looked up in their intervals (doubling ends with the longest of them): where an interval starts with another suffix (in the order of documents and lines), the run is
a later copy and goes. A maximal repeated run is the union of these shortest ones in it, so that exactly the later copies of
maximal runs go.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarspark.llm import scratch
from bazaarspark.llm.hot import SHARES, classed, merged

#: The first member of a class, in the order of documents and lines.
FIRST = "min(struct(id is null as none, id, digest, pos))"
#: Lines that the scan hands over at once.
CHUNK = 10_000


def _runs(sizes: list[int], min_words: int) -> list[set[int]]:
    """For each line, the lengths of the runs from it: the shortest one, and those that are the shortest up to their end. Two a line."""
    runs: list[set[int]] = [set() for _ in sizes]
    end = held = 0
    for i in range(len(sizes)):
        while end < len(sizes) and held < min_words:
            held += sizes[end]
            end += 1
        if held >= min_words:
            runs[i].add(end - i)
        held -= sizes[i]
    start = held = 0
    for i in range(len(sizes)):
        held += sizes[i]
        while start < i and held - sizes[start] >= min_words:
            held -= sizes[start]
            start += 1
        if held >= min_words:
            runs[start].add(i + 1 - start)
    return runs


def _scan(min_words: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []

            def out(batch: pa.RecordBatch = batch, rows: list[tuple] = rows) -> pa.RecordBatch:
                at, digest, pos, line, check, needs = zip(*rows, strict=True)
                columns = [batch.column("id").take(pa.array(at, pa.int64())), pa.array(digest, pa.int64()), pa.array(pos, pa.int32()), pa.array(line, pa.int64()), pa.array(check, pa.int32()), pa.array(needs, pa.list_(pa.int32()))]
                return pa.RecordBatch.from_arrays(columns, ["id", "digest", "pos", "line", "check", "needs"])

            for at, (text, digest) in enumerate(zip(batch.column("text"), batch.column("digest").to_pylist(), strict=True)):
                lines = text.as_py().encode("utf-8", "surrogatepass").split(b"\n")
                needs = _runs([len(x.split()) for x in lines], min_words)
                for pos, x in enumerate(lines):
                    d = xxhash.xxh3_128_intdigest(x)
                    rows.append((at, digest, pos, (d & (2**64 - 1)) - 2**63, (d >> 96) - 2**31, sorted(needs[pos])))
                    if len(rows) >= CHUNK:
                        yield out()
                        rows.clear()
            if rows:
                yield out()

    return scan


def _row_digest(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def _ranked(classes: DataFrame, by: list[str]) -> DataFrame:
    """Classes with two members or more, with a rank in the order of ``by``. Written, as ranks are given once."""
    return scratch.written(classes.where("n > 1").orderBy(*by).withColumn("rank", F.monotonically_increasing_id()), "line-classes")


def _later(suffixes: DataFrame) -> DataFrame:
    is_first = F.col("first").eqNullSafe(F.struct(F.col("id").isNull().alias("none"), "id", "digest", "pos"))
    return suffixes.where(~is_first)


def _same_row(a: str, b: str) -> Column:
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.digest") == F.col(f"{b}.digest"))


def _once(lines: DataFrame, base: DataFrame) -> DataFrame:
    """The lines of rows that are repeated whole, once. Nearly always there are none and nothing is moved."""
    again = scratch.written(base.groupBy("id", "digest").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("_id"), F.col("digest").alias("_digest")), "line-repeats")
    if again.isEmpty():
        return lines
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    return lines.join(again, same, "left_semi").dropDuplicates(["id", "digest", "pos"]).unionByName(lines.join(again, same, "left_anti"))


def later_copies(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """The lines that later copies of repeated runs cover, as intervals that don't touch: (id, digest, spans), a row for each
    document that has some. ``digest`` is of the text, so that rows with one identifier and different texts are told apart."""
    base = docs.select(F.col(id_col).alias("id"), _row_digest(text_col).alias("digest"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    id_type = base.schema["id"].dataType.simpleString()
    lines = scratch.written(base.mapInArrow(_scan(min_words), f"id {id_type}, digest long, pos int, line long, check int, needs array<int>"), "lines")
    most = lines.count() // SHARES + 1
    lines = _once(lines, base)

    classes = _ranked(lines.groupBy("line", "check").agg(F.count("*").alias("n"), F.expr(FIRST).alias("first")), ["line", "check"])
    tied = scratch.written(classed(lines, classes, ["line", "check"], most).select("id", "digest", "pos", "needs", "rank", "first"), "line-suffixes")
    found = [_later(tied.where(F.array_contains("needs", 1))).select("id", "digest", "pos", F.lit(1).alias("len"))]
    width = 1
    # Doubling ends with the last suffix that starts a run as long as this round's prefix: no other lookup is left.
    while (tied.agg(F.max(F.array_max("needs"))).first()[0] or 0) >= max(width, 2):
        here = tied.withColumn("need", F.explode("needs")).where(F.col("need").between(width, 2 * width - 1) & (F.col("need") > 1)).alias("a")
        last = tied.select("id", "digest", F.col("pos").alias("end"), F.col("rank").alias("last")).alias("b")
        ends = here.join(last, _same_row("a", "b") & (F.col("b.end") == F.col("a.pos") + F.col("a.need") - width))
        ends = scratch.written(ends.select("a.id", "a.digest", "pos", "need", "rank", "last"), "line-runs")
        firsts = ends.groupBy("need", "rank", "last").agg(F.count("*").alias("n"), F.expr(FIRST).alias("first")).where("n > 1")
        found.append(_later(classed(ends, firsts, ["need", "rank", "last"], most)).select("id", "digest", "pos", F.col("need").alias("len")))
        follows = tied.select("id", "digest", (F.col("pos") - width).alias("pos"), F.col("rank").alias("second")).alias("b")
        pairs = tied.withColumnRenamed("rank", "head").alias("a").join(follows, _same_row("a", "b") & (F.col("a.pos") == F.col("b.pos")))
        pairs = scratch.written(pairs.select("a.id", "a.digest", "a.pos", "needs", "head", "second"), "line-pairs")
        classes = _ranked(pairs.groupBy("head", "second").agg(F.count("*").alias("n"), F.expr(FIRST).alias("first")), ["head", "second"])
        tied = scratch.written(classed(pairs, classes, ["head", "second"], most).select("id", "digest", "pos", "needs", "rank", "first"), "line-suffixes")
        width *= 2
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return merged(every.groupBy("id", "digest", "pos").agg(F.max("len").alias("len")))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5) -> DataFrame:
    """All columns of ``docs`` with the text cleaned, and ``n_lines``, ``n_removed`` and ``removed`` (line numbers from 0).

    Lines are split at line feeds and compared as they are. A null text has no line and stays null; an empty one
    has one empty line. A document whose lines all go keeps its row, with an empty text. Rows repeated whole count once and
    stay alike; rows with one identifier and different texts are different documents, in the order of the texts' digests. A null
    identifier comes after all others. Very long texts pass the scan in pieces of ``CHUNK`` lines, and what is removed is held
    as intervals. Columns of ``docs`` that have one of the three names are replaced. An empty table gives an empty one.
    """
    gone = later_copies(docs, id_col, text_col, min_words).select(F.struct("id", "digest", "spans").alias("_line_gone"))
    here = docs.withColumn("_line_digest", _row_digest(text_col))
    rows = here.join(gone, here[id_col].eqNullSafe(F.col("_line_gone.id")) & (F.col("_line_digest") == F.col("_line_gone.digest")), "left")
    parts = F.split(F.col(text_col).cast("string"), "\n", -1)
    removed = F.flatten(F.transform("_line_gone.spans", lambda s: F.sequence(s["start"], s["end"] - 1)))
    removed = F.coalesce(removed, F.array().cast("array<int>"))
    rows = rows.withColumns({"n_lines": F.when(F.col(text_col).isNotNull(), F.size(parts)).otherwise(0), "removed": removed, "n_removed": F.size(removed), "_line_parts": F.when(F.size(removed) > 0, parts)})
    kept = F.array_except(F.sequence(F.lit(0), F.size("_line_parts") - 1), F.col("removed"))
    cleaned = F.array_join(F.transform(kept, lambda i: F.get(F.col("_line_parts"), i)), "\n")
    out = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed")]
    return rows.withColumn(text_col, F.when(F.col("_line_parts").isNotNull(), cleaned).otherwise(F.col(text_col))).select(*out, "n_lines", "n_removed", "removed")
