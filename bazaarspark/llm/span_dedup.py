"""Substring dedup by sliding sentence spans.

The shortest runs of consecutive sentences with at least ``span`` sentences and ``min_words`` words that start and that end at each
sentence are hashed, and each sentence of ``LONG`` words or more by itself. Hashes are joined globally; of equal runs, the one in the document with the smallest identifier that comes
first there stays. Sentences that any other run covers are removed. Longer repeated passages are the union of the
shortest runs in them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarspark.llm import scratch
from bazaarspark.llm.hot import SHARES, classed, merged

#: One sentence with its end marks and the white space after it. Matches follow each other without a gap.
SENTENCE = r"[^.!?\n]*[.!?\n][.!?\x20\x09-\x0D]*|[^.!?\n]+"
#: Words of a sentence that counts as a run alone.
LONG = 50
#: Runs that the scan hands over at once.
CHUNK = 20_000
_sentence = re.compile(SENTENCE)


def runs(text: str, span: int, min_words: int) -> tuple[list[int], list[int], list[int]]:
    """Start, number of sentences and 128-bit digest of each run; words are compared, not white space or A-Z case."""
    parts = [s.encode("utf-8", "surrogatepass").lower().split() for s in _sentence.findall(text)]
    digests = [xxhash.xxh3_128_digest(b" ".join(p)) for p in parts]
    words = [len(p) for p in parts]
    found: set[tuple[int, int]] = {(i, 1) for i, n in enumerate(words) if n >= LONG}
    end = held = 0
    for i, n in enumerate(words):  # the shortest from each sentence
        while end < len(parts) and (end - i < span or held < min_words):
            held += words[end]
            end += 1
        if end - i < span or held < min_words:
            break
        if n:  # a run starts with a word
            found.add((i, end - i))
        held -= n
    start = held = 0
    for i, n in enumerate(words):  # and up to each sentence
        held += n
        while start < i and (not words[start] or (i - start >= span and held - words[start] >= min_words)):
            held -= words[start]
            start += 1
        if n and i + 1 - start >= span and held >= min_words:
            found.add((start, i + 1 - start))
    order = sorted(found)
    hashes = [xxhash.xxh3_128_intdigest(b"".join(digests[i : i + n])) for i, n in order]
    return [i for i, _ in order], [n for _, n in order], hashes


def _scan(span: int, min_words: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []

            def out(batch: pa.RecordBatch = batch, rows: list[tuple] = rows) -> pa.RecordBatch:
                at, digest, pos, n, hashes, check, again = zip(*rows, strict=True)
                columns = [batch.column("id").take(pa.array(at, pa.int64())), pa.array(digest, pa.int64()), pa.array(pos, pa.int32()), pa.array(n, pa.int32()), pa.array(hashes, pa.int64()), pa.array(check, pa.int32()), pa.array(again, pa.bool_())]
                return pa.RecordBatch.from_arrays(columns, ["id", "digest", "pos", "len", "hash", "check", "again"])

            for at, (text, digest) in enumerate(zip(batch.column("text"), batch.column("digest").to_pylist(), strict=True)):
                seen: set[int] = set()
                for pos, n, h in zip(*runs(text.as_py() or "", span, min_words), strict=True):
                    rows.append((at, digest, pos, n, (h & (2**64 - 1)) - 2**63, (h >> 96) - 2**31, h in seen))
                    seen.add(h)
                    if len(rows) >= CHUNK:
                        yield out()
                        rows.clear()
            if rows:
                yield out()

    return scan


def span_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 2, min_words: int = 12) -> DataFrame:
    """All columns of ``docs`` with the text cleaned, and ``n_sentences``, ``n_removed`` and ``removed`` (sentence numbers from 0).

    A null or empty text has no sentence and stays as it is. A document whose sentences all go keeps its row, with an
    empty text. Rows with one identifier count as one document: what they share stays in both. A null identifier comes
    after all others. Very long texts pass the scan in pieces of ``CHUNK`` runs, and what is removed is held as intervals. Columns of ``docs`` that have one of the three names are replaced. An empty table gives an empty one.
    """
    digest = F.xxhash64(F.col(text_col).cast("string"))
    base = docs.select(F.col(id_col).alias("id"), digest.alias("digest"), F.col(text_col).cast("string").alias("text"))
    id_type = base.schema["id"].dataType.simpleString()
    scanned = base.where("text is not null").mapInArrow(_scan(span, min_words), f"id {id_type}, digest long, pos int, len int, hash long, check int, again boolean")
    spans = scratch.written(scanned, "spans")
    most = spans.count() // SHARES + 1
    first = scratch.written(spans.groupBy("hash", "check").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"), "span-classes")
    later = classed(spans, first, ["hash", "check"], most).where(F.col("again") | ~F.col("id").eqNullSafe(F.col("first")))
    covered = merged(later.groupBy("id", "digest", "pos").agg(F.max("len").alias("len"))).select(F.struct("id", "digest", "spans").alias("_span_gone"))
    here = docs.withColumn("_span_digest", digest)
    rows = here.join(covered, here[id_col].eqNullSafe(F.col("_span_gone.id")) & (F.col("_span_digest") == F.col("_span_gone.digest")), "left")
    parts = F.expr(f"regexp_extract_all(coalesce(cast(`{text_col}` as string), ''), r'{SENTENCE}', 0)")
    gone = F.flatten(F.transform("_span_gone.spans", lambda s: F.sequence(s["start"], s["end"] - 1)))
    gone = F.coalesce(gone, F.array().cast("array<int>"))
    rows = rows.withColumns({"n_sentences": F.size(parts), "removed": gone, "n_removed": F.size(gone), "_span_parts": F.when(F.size(gone) > 0, parts)})
    kept = F.array_except(F.sequence(F.lit(0), F.size("_span_parts") - 1), F.col("removed"))
    cleaned = F.array_join(F.transform(kept, lambda i: F.get(F.col("_span_parts"), i)), "")
    out = [c for c in docs.columns if c not in ("n_sentences", "n_removed", "removed")]
    return rows.withColumn(text_col, F.when(F.col("_span_parts").isNotNull(), cleaned).otherwise(F.col(text_col))).select(*out, "n_sentences", "n_removed", "removed")
