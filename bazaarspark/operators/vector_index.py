"""Approximate vector search by an inverted file with product codes, for all queries at once.

Centroids learned from a bounded sample deal vectors to lists, whose number grows with the table; a vector is kept there as one byte for
each four components of its difference from the centroid. Lists are read in two rounds: the nearest ones first, for a k-th score, then every list of which the angle
between query and centroid, less the list's own width, doesn't prove that it can't reach that score. Within lists vectors are compared by
their codes; only the best by codes are scored in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarspark.functions.columns import top_n
from bazaarspark.sources import scratch

#: Vectors that the index is learned from (about), the most lists, codes of a block, queries of a pack, components of a code.
SAMPLE, LISTS, BLOCK, PACK, PART = 32_768, 4_096, 8_192, 256, 4
ROUNDS = 10


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    return _unit(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1))


def _closest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids * centroids).sum(1) / 2
    return np.concatenate([(x[i : i + 8192] @ centroids.T - half).argmax(1) for i in range(0, len(x), 8192)])


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k means of the rows; a mean without rows takes the row that is worst served."""
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = _closest(x, centroids)
        n = np.bincount(own, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, own, x)
        worst = np.argsort(-((x - centroids[own]) ** 2).sum(1))
        centroids = total / np.maximum(n, 1)[:, None]
        centroids[n == 0] = x[worst[: (n == 0).sum()]]
    return centroids


class VectorIndex(NamedTuple):
    """Centroids of the lists, and the means that code each group of components of what vectors differ from their centroids."""

    centroids: np.ndarray
    means: list[np.ndarray]

    def codes(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        off = x - self.centroids[own]
        return np.stack([_closest(off[:, i * PART : (i + 1) * PART], m) for i, m in enumerate(self.means)], 1).astype(np.uint8)

    def decoded(self, codes: np.ndarray, own: np.ndarray) -> np.ndarray:
        """At length 1, as the vectors are: along themselves codes err most, and neighbours differ least."""
        return _unit(self.centroids[own] + np.concatenate([m[codes[:, i]] for i, m in enumerate(self.means)], 1))


def fit(sample: np.ndarray, n: int, seed: int = 5) -> VectorIndex:
    """An index for ``n`` vectors, from unit vectors of a sample. A list has about as many vectors as there are lists."""
    rng = np.random.default_rng(seed)
    lists = int(max(1, min(LISTS, round(n**0.5), len(sample) // 8)))
    centroids = _unit(_means(sample, lists, rng))
    off = sample - centroids[(sample @ centroids.T).argmax(1)]
    return VectorIndex(centroids, [_means(off[:, i : i + PART], 256, rng) for i in range(0, sample.shape[1], PART)])


def _coded(index: VectorIndex, codes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column("v"))
                near = x @ index.centroids.T
                own = near.argmax(1)
                more = [pa.array(own, pa.int32()), pa.array(near[np.arange(len(x)), own])]
                more += [pa.array([c.tobytes() for c in index.codes(x, own)], pa.binary())] if codes else [batch.column("v")]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *more], ["id", "list", "near", "code" if codes else "v"])

    return run


class Lists(NamedTuple):
    """By list: its first block, how many blocks it has, its vectors and the angle within which they lie."""

    first: np.ndarray
    parts: np.ndarray
    counts: np.ndarray
    angles: np.ndarray


def _lists(coded: DataFrame, n: int) -> Lists:
    counts, angles = np.zeros(n, np.int64), np.zeros(n)
    for row in coded.groupBy("list").agg(F.count("*").alias("n"), F.min("near").alias("near")).collect():  # LISTS rows at most
        counts[row["list"]], angles[row["list"]] = row["n"], np.arccos(np.clip(row["near"], -1, 1))
    first, parts, block, room = np.zeros(n, np.int64), np.ones(n, np.int64), 0, BLOCK
    for i in np.flatnonzero(counts):
        if counts[i] > room and room < BLOCK:
            block, room = block + 1, BLOCK
        first[i], parts[i] = block, -(-counts[i] // BLOCK)
        block, room = (block + parts[i], BLOCK) if counts[i] > BLOCK else (block, room - counts[i])
    return Lists(first, parts, counts, angles)


def reached(near: np.ndarray, lists: Lists, kth: float | None, wanted: int) -> np.ndarray:
    """The lists that a query reads, of those with vectors: the nearest that hold ``wanted`` vectors, or all that may reach ``kth``."""
    if kth is None:
        order = np.argsort(-near, kind="stable")
        held = np.cumsum(lists.counts[order])
        some = order[: np.searchsorted(held, min(wanted, held[-1])) + 1]
    else:
        angle = np.maximum(np.arccos(np.clip(near, -1, 1)) - lists.angles, 0)
        some = np.flatnonzero(np.cos(angle) >= kth - 1e-6)  # scores are rounded to as many places
    return some[lists.counts[some] > 0]


def _visits(index: VectorIndex, lists: Lists, wanted: int):
    """Packs of queries, once for each block that one of them reads, with the queries (as bits) that read each of its lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                asked = batch.slice(i, 1).column("asked").flatten()
                ids, v, kth = asked.field("id"), asked.field("v"), asked.field("kth").to_pylist()
                near = _matrix(v) @ index.centroids.T
                reads = np.zeros((len(ids), len(lists.counts)), bool)
                for q in range(len(ids)):
                    reads[q, reached(near[q], lists, kth[q], wanted)] = True
                at: dict[int, list] = {}
                for n in np.flatnonzero(reads.any(0)):
                    for block in range(lists.first[n], lists.first[n] + lists.parts[n]):
                        at.setdefault(int(block), []).append({"list": n, "asks": np.packbits(reads[:, n]).tobytes()})
                whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                kind = pa.list_(pa.struct([("list", pa.int32()), ("asks", pa.binary())]))
                for block, reading in at.items():
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), whole(ids), whole(v), pa.array([reading], kind)], ["block", "query_ids", "query_v", "reads"])

    return run


def _compared(index: VectorIndex, best: int):
    """For each query of a pack the ``best`` vectors of a block by their codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                asking, q = row.column("query_ids").flatten().to_numpy(), _matrix(row.column("query_v").flatten())
                held = row.column("held").flatten()
                ids, own = held.field("id").to_numpy(), held.field("list").to_numpy()
                codes = np.frombuffer(b"".join(held.field("code").to_pylist()), np.uint8).reshape(len(ids), -1)
                allowed = np.zeros((len(q), len(ids)), bool)
                for r in row.column("reads").flatten().to_pylist():
                    allowed |= np.unpackbits(np.frombuffer(r["asks"], np.uint8), count=len(q)).astype(bool)[:, None] & (own == r["list"])
                allowed &= asking[:, None] != ids
                guess = np.where(allowed, q @ index.decoded(codes, own).T, -np.inf)
                if len(ids) > best:
                    allowed &= guess >= np.partition(guess, -best, 1)[:, -best, None]
                a, b = np.nonzero(allowed)
                yield pa.RecordBatch.from_arrays([pa.array(asking[a], pa.int64()), pa.array(ids[b], pa.int64()), pa.array(guess[a, b])], ["query_id", "id", "guess"])

    return run


def candidates(queries: DataFrame, index: VectorIndex, lists: Lists, blocks: DataFrame, best: int, wanted: int) -> DataFrame:
    """(query_id, id) of the ``best`` vectors of each query by codes. Queries are (id, v, list, kth)."""
    sizes = queries.groupBy("list").agg(F.ceil(F.count("*") / PACK).alias("packs"))
    packed = queries.join(F.broadcast(sizes), "list")  # LISTS rows at most
    packed = packed.groupBy("list", F.pmod(F.xxhash64("id"), F.col("packs")).alias("pack")).agg(F.collect_list(F.struct("id", "v", "kth")).alias("asked"))
    kind = queries.schema["v"].dataType.simpleString()
    visits = packed.select("asked").mapInArrow(_visits(index, lists, wanted), f"block long, query_ids array<long>, query_v array<{kind}>, reads array<struct<list:int,asks:binary>>")
    guesses = visits.join(blocks, "block").mapInArrow(_compared(index, best), "query_id long, id long, guess double")
    return top_n(guesses, ["query_id"], [F.desc("guess"), F.asc("id")], best).select("query_id", "id")


def _scored(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    q = queries.select(F.col("id").alias("query_id"), F.col("v").cast("array<double>").alias("a"))
    v = vectors.select("id", F.col("v").cast("array<double>").alias("b"))
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return pairs.join(v, "id").join(q, "query_id").select("query_id", "id", F.round(F.coalesce(dot / F.nullif(norm(F.col("a")) * norm(F.col("b")), F.lit(0.0)), F.lit(0.0)), 6).alias("score"))


def build(vectors: DataFrame, sample: int = SAMPLE) -> tuple[VectorIndex, Lists, DataFrame] | None:
    """The index of vectors (id, v) of one length, its lists, and its blocks of codes; None for an empty table."""
    n = vectors.count()
    if not n:
        return None
    share = int(min(1.0, sample / n) * (1 << 30))
    picked = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= share).select("v").toArrow()  # about ``sample`` rows
    picked = picked if len(picked) else vectors.select("v").limit(1).toArrow()
    x = _matrix(picked.column("v").combine_chunks())
    index = fit(x[np.lexsort(x.T)], n)  # whatever the order of rows
    coded = scratch.written(vectors.select("id", "v").mapInArrow(_coded(index, True), "id long, list int, near double, code binary"), "vector-codes")
    lists = _lists(coded, len(index.centroids))
    places = vectors.sparkSession.createDataFrame([(int(i), int(lists.first[i]), int(lists.parts[i])) for i in np.flatnonzero(lists.counts)], "list int, first long, parts long")
    placed = coded.join(F.broadcast(places), "list").withColumn("block", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")))
    return index, lists, placed.groupBy("block").agg(F.collect_list(F.struct("id", "list", "code")).alias("held"))


def ann_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, best: int = 20, first: int = 4, sample: int = SAMPLE) -> DataFrame:
    """About the ``k`` most similar vectors of each query by cosine: (query_id, id, score, rank). A query doesn't find itself.

    Queries and vectors are (id, v) of one length. ``best`` times ``k`` vectors of each query are scored in full, and ``first`` times
    ``k`` before that for the k-th score that tells which lists are read.
    """
    empty = queries.sparkSession.createDataFrame([], "query_id long, id long, score double, rank long")
    built = build(vectors, sample)
    if built is None:
        return empty
    index, lists, blocks = built
    blocks = scratch.written(blocks, "vector-blocks")
    kind = queries.schema["v"].dataType.simpleString()
    asked = scratch.written(queries.select("id", "v").mapInArrow(_coded(index, False), f"id long, list int, near double, v {kind}"), "vector-queries")
    order = [F.desc("score"), F.asc("id")]
    early = candidates(asked.withColumn("kth", F.lit(None).cast("double")), index, lists, blocks, first * k, first * k)
    kth = top_n(_scored(early, queries, vectors), ["query_id"], order, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    sure = asked.join(kth, "id", "left").withColumn("kth", F.coalesce("kth", F.lit(-2.0)))
    return top_n(_scored(candidates(sure, index, lists, blocks, best * k, 0), queries, vectors), ["query_id"], order, k)
