"""Approximate nearest neighbours by an inverted multi-index.

Both halves of the vectors are quantised by centroids of their own, learned from a bounded sample; a pair of centroids is a cell, of
which there are as many as the square of a codebook. A query walks over pairs of centroids by the sum of the two halves' scores with a
heap (Babenko and Lempitsky, "The Inverted Multi-Index", 2012), until the cells still to come are expected to hold less than a set share
of its neighbours; the expectation takes what vectors differ from their centroids as normal, with the covariance of the sample. All
vectors of the cells that were reached are reranked by their inner products in double precision.

Equal vectors are one entry with the identifiers that can be among the first. Cells are packed into blocks of bounded size, large ones cut;
queries of one cell travel in packs, once for each block that one of them reaches.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from bazaarspark.llm import scratch

#: Vectors that the codebooks are learned from (about), the most centroids of a half, and vectors that a cell has on average.
SAMPLE, MOST, OCCUPANCY = 32_768, 256, 64
#: The share of its neighbours that a query's cells are expected to hold, and entries that it reads at least.
PROBE, LEAST = 0.98, 1_024
BLOCK, PACK = 2_048, 256
ROUNDS = 12


class Codebooks(NamedTuple):
    """Centroids of the halves, the covariance of what is left, and the scale that vectors are divided by."""

    left: np.ndarray
    right: np.ndarray
    left_spread: np.ndarray
    right_spread: np.ndarray
    scale: float

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.clip(x / self.scale, -1e6, 1e6)
        return x[:, : self.left.shape[1]], x[:, self.left.shape[1] :]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return _nearest(a, self.left) * len(self.right) + _nearest(b, self.right)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids * centroids).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64), *[(x[i : i + 4096] @ centroids.T - half).argmax(1) for i in range(0, len(x), 4096)]])


def _centroids(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from distinct rows; a centroid without rows moves to a row far from its own."""
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centroids = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(ROUNDS):
        own = _nearest(x, centroids)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
        if (lost := np.flatnonzero(n == 0)).size:
            far = ((x - centroids[own]) ** 2).sum(1)
            centroids[lost] = x[np.argsort(-far)[: len(lost)]]
    return centroids


def fit(sample: np.ndarray, entries: int, most: int = MOST, seed: int = 11) -> Codebooks:
    """Codebooks for ``entries`` vectors from a sample of them."""
    rng = np.random.default_rng(seed)
    k = int(max(1, min(most, round((entries / OCCUPANCY) ** 0.5), len(sample))))
    scale = float(np.abs(sample).max())
    x = sample / scale
    h = x.shape[1] // 2
    parts, spreads = [], []
    for half in (x[:, :h], x[:, h:]):
        c = _centroids(half, k, rng)
        off = half - c[_nearest(half, c)]
        parts.append(c)
        spreads.append(off.T @ off / len(half))
    return Codebooks(*parts, *spreads, scale)


def _tail(z: np.ndarray) -> np.ndarray:
    """The share of a normal distribution above ``z``, to about 1e-7 (Zelen and Severo)."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    p = np.exp(-z * z / 2) * 0.3989422804 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z > 0, p, 1 - p)


def reached(q: np.ndarray, books: Codebooks, counts: np.ndarray, k: int, probe: float, least: int) -> list[int]:
    """The cells that a query reads, by falling summed score. ``counts``: entries by cell."""
    a, b = (x[0] for x in books.halves(q[None]))
    s, t = books.left @ a, books.right @ b
    width = len(t)
    spread = max(float(np.sqrt(a @ books.left_spread @ a + b @ books.right_spread @ b)), 1e-9 * float(np.abs(q / books.scale).sum()), 1e-300)
    scores = (s[:, None] + t[None, :]).ravel()
    held = np.flatnonzero(counts)
    n, scores = counts[held], scores[held]
    low, high = scores.min() - 9 * spread, scores.max() + 9 * spread
    for _ in range(26):  # the score that k entries are expected to pass
        middle = (low + high) / 2
        low, high = (middle, high) if (n * _tail((middle - scores) / spread)).sum() > k else (low, middle)
    hits = np.zeros(len(counts))
    hits[held] = n * _tail((low - scores) / spread)
    wanted, reads = probe * hits.sum(), min(least, int(n.sum()))
    by_s, by_t = np.argsort(-s, kind="stable"), np.argsort(-t, kind="stable")
    s, t = s[by_s].tolist(), t[by_t].tolist()
    rows, columns = (by_s * width).tolist(), by_t.tolist()
    count, hit = counts.tolist(), hits.tolist()
    heap, cells = [(-(s[0] + t[0]), 0, 0)], []
    while heap and (wanted > 0 or reads > 0):
        _, i, j = heapq.heappop(heap)
        if j + 1 < width:
            heapq.heappush(heap, (-(s[i] + t[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(s):
            heapq.heappush(heap, (-(s[i + 1] + t[0]), i + 1, 0))
        cell = rows[i] + columns[j]
        if count[cell]:
            cells.append(cell)
            wanted, reads = wanted - hit[cell], reads - count[cell]
    return cells


def layout(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first group, number of groups) by cell: neighbouring small cells share a group, one of more than ``size`` is cut."""
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    group, room = 0, size
    for cell in np.flatnonzero(counts):
        n = int(counts[cell])
        if n > room and room < size:
            group, room = group + 1, size
        first[cell] = group
        if n > size:
            parts[cell] = -(-n // size)
            group, room = group + int(parts[cell]), size
        else:
            room -= n
    return first, parts


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _assigned(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = books.cells(_matrix(batch.column("v"))) if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.astype(np.int32))], [*batch.schema.names, "cell"])

    return run


def _walked(books: Codebooks, counts: np.ndarray, blocks: tuple[np.ndarray, np.ndarray], k: int, probe: float, least: int):
    """Packs of queries, once for each block that one of them reaches, with the queries (as bits) that reach each of its cells."""
    first, parts = blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                queries = batch.slice(i, 1).column("queries").flatten()
                nodes, vectors = queries.field("node"), queries.field("v")
                visits: dict[int, np.ndarray] = {}
                for nth, q in enumerate(_matrix(vectors)):
                    for cell in reached(q, books, counts, k, probe, least):
                        visits.setdefault(cell, np.zeros(len(nodes), bool))[nth] = True
                at: dict[int, list] = {}
                for cell in sorted(visits):
                    for block in range(first[cell], first[cell] + parts[cell]):
                        at.setdefault(int(block), []).append({"cell": cell, "asks": np.packbits(visits[cell]).tobytes()})
                for block, cells in at.items():
                    wrap = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                    kind = pa.list_(pa.struct([("cell", pa.int32()), ("asks", pa.binary())]))
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), wrap(nodes), wrap(vectors), pa.array([cells], kind)], ["block", "nodes", "asked_v", "visits"])

    return run


class _Firsts:
    """The first ``k`` entries of each query met by a task. They are merged whenever ``room`` rows have gathered, so that what leaves the
    task is ``k`` rows for each query and not for each block; queries beyond the room leave it before."""

    def __init__(self, k: int, room: int = 1 << 18) -> None:
        self.k, self.room, self.held, self.parts = k, room, 0, []

    def merged(self) -> tuple[np.ndarray, ...]:
        asker, score, found, own = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((~own, found, -score, asker))
        asker = asker[order]
        nth = np.arange(len(asker)) - np.searchsorted(asker, asker)
        order = order[nth < self.k]
        return tuple(np.concatenate(x)[order] for x in zip(*self.parts, strict=True))

    def add(self, *part: np.ndarray) -> tuple[np.ndarray, ...] | None:
        self.parts.append(part)
        self.held += len(part[0])
        if self.held > self.room:
            self.parts = [self.merged()]
            self.held = len(self.parts[0][0])
            if self.held > self.room // 2:
                return self.rest()
        return None

    def rest(self) -> tuple[np.ndarray, ...] | None:
        out, self.parts, self.held = self.merged() if self.parts else None, [], 0
        return out


def _rows(part: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.float64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(part, kinds, strict=True)], ["asker", "score", "id", "own"])


def _scored(k: int):
    """For each query of a pack the first ``k`` entries among the cells that it reaches. Scores are summed component by component from
    the first, so that equal vectors have equal scores wherever they are met."""

    def best(row: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        asking, q = row.column("nodes").flatten().to_numpy(), _matrix(row.column("asked_v").flatten())
        entries = row.column("entries").flatten()
        cell, node, v = entries.field("cell").to_numpy(), entries.field("node").to_numpy(), _matrix(entries.field("v"))
        asks = np.zeros((len(q), len(v)), bool)
        for visit in row.column("visits").flatten().to_pylist():
            asks |= np.unpackbits(np.frombuffer(visit["asks"], np.uint8), count=len(q)).astype(bool)[:, None] & (cell == visit["cell"])
        near = np.where(asks, q @ v.T, -np.inf)
        if len(v) > k:
            slack = 1e-12 * np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1).max()) * v.shape[1]
            asks &= near >= (np.partition(near, -k, 1)[:, -k] - slack)[:, None]
        r, c = np.nonzero(asks)
        score = np.cumsum(q[r] * v[c], 1)[:, -1] if len(r) else np.zeros(0)
        ids = entries.field("ids")
        size = ids.value_lengths().to_numpy()
        start = np.concatenate(([0], np.cumsum(size)))[:-1]
        n = size[c]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[c], n)
        return np.repeat(asking[r], n), np.repeat(score, n), ids.flatten().to_numpy()[place], np.repeat(asking[r] == node[c], n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = _Firsts(k)
        for batch in batches:
            for i in range(len(batch)):
                if (part := firsts.add(*best(batch.slice(i, 1)))) is not None:
                    yield _rows(part)
        if (part := firsts.rest()) is not None:
            yield _rows(part)

    return run


def nearest(vectors: DataFrame, asked: Column | None = None, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", probe: float = PROBE, least: int = LEAST, sample: int = SAMPLE, most: int = MOST) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id_col``, ``score``: for each row that ``asked`` (default: identifiers divisible by 20) holds for,
    the ``k`` nearest other rows found, or all where there are fewer. Nearest: largest inner product; ties to the smaller identifier.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a null identifier. Vectors of
    different lengths don't meet. Of rows repeated whole each asks and each is found. A query's own row is left out, and no other of the
    same identifier. ``sample`` vectors (about) fit the codebooks; all vectors are indexed. Other columns are not read. An empty table
    gives an empty one.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType
    single = kind == ArrayType(FloatType(), kind.containsNull)
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), (F.pmod(F.col(id_col), F.lit(20)) == 0 if asked is None else asked).alias("asked"))
    usable = F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    # Floats travel as such, which loses nothing; -0.0 becomes 0.0, so that equal vectors are one entry.
    rows = rows.where(F.coalesce(usable, F.lit(False))).withColumn("v", F.transform("v", lambda x: x + 0.0).cast("array<float>" if single else "array<double>"))
    few = rows.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("nth") <= k + 1)
    asks = rows.where("asked").select("v").distinct().withColumn("asks", F.lit(True))
    merged = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).join(asks, "v", "left")
    nodes = scratch.written(merged.select(F.monotonically_increasing_id().alias("node"), "v", "ids", F.coalesce("asks", F.lit(False)).alias("asks"), F.size("v").alias("width")), "multi-nodes")
    found = None
    for width, entries in sorted(map(tuple, nodes.groupBy("width").agg(F.count("*")).collect())):  # lengths of vectors: one, as a rule
        part = _found(nodes.where(F.col("width") == width).drop("width"), entries, k, probe, least, sample, most)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    best = found.withColumn("nth", F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "id", F.desc("own")))).where(F.col("nth") <= k + 1)
    best = best.groupBy("asker").agg(F.array_sort(F.collect_list(F.struct("nth", "id", "score", "own"))).alias("best"))
    asking = rows.where("asked").join(nodes.where("asks").select("v", F.col("node").alias("asker")), "v").select(F.col("id").alias("query_id"), "asker")
    itself = F.array_position(F.transform("best", lambda x: x["own"] & (x["id"] == F.col("query_id"))), True)
    others = F.slice(F.filter("best", lambda x, i: i != F.col("itself") - 1), 1, k)
    listed = asking.join(best, "asker").withColumn("itself", itself).select("query_id", F.posexplode(others).alias("at", "one"))
    return listed.select("query_id", (F.col("at") + 1).alias("rank"), F.col("one.id").alias(id_col), F.col("one.score").alias("score"))


def _found(nodes: DataFrame, entries: int, k: int, probe: float, least: int, sample: int, most: int) -> DataFrame:
    """(asker, score, id, own): for each block that a query reaches, its first entries there."""
    spark = nodes.sparkSession
    share = int(min(1.0, sample / entries) * (1 << 30))
    taken = nodes.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < share).select("v").toArrow()
    taken = taken if len(taken) else nodes.select("v").limit(1).toArrow()
    x = np.unique(_matrix(taken.column("v").combine_chunks()), axis=0)  # in one order, whatever the order of rows
    books = fit(x, entries, most)
    fields = {f.name: f.dataType.simpleString() for f in nodes.schema}
    ddl = ", ".join(f"{c} {t}" for c, t in fields.items())
    assigned = scratch.written(nodes.mapInArrow(_assigned(books), f"{ddl}, cell int"), "multi-cells")
    size = len(books.left) * len(books.right)
    counts, asking = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for cell, n, m in assigned.groupBy("cell").agg(F.count("*"), F.count_if("asks")).collect():  # most * most rows at the most
        counts[cell], asking[cell] = n, m
    blocks, packs = layout(counts, BLOCK), layout(asking, PACK)
    places = [(int(c), *(int(x[c]) for x in (*blocks, *packs))) for c in np.flatnonzero(counts)]
    places = F.broadcast(spark.createDataFrame(places, "cell int, block long, blocks long, pack long, packs long"))  # as many rows as counts
    placed = assigned.join(places, "cell")
    part = lambda n: F.pmod(F.xxhash64("v"), F.col(n))
    dealt = placed.groupBy((F.col("block") + part("blocks")).alias("block")).agg(F.collect_list(F.struct("cell", "node", "v", "ids")).alias("entries"))
    tasks = min(int((packs[0] + packs[1])[asking > 0].max(initial=1)), 4 * spark.sparkContext.defaultParallelism)  # walks are long, their rows few
    asked = placed.where("asks").select((F.col("pack") + part("packs")).alias("pack"), "node", "v").repartition(tasks, "pack").groupBy("pack").agg(F.collect_list(F.struct("node", "v")).alias("queries"))
    walked = asked.mapInArrow(_walked(books, counts, blocks, k + 1, probe, least), f"block long, nodes array<long>, asked_v array<{fields['v']}>, visits array<struct<cell:int,asks:binary>>")
    return walked.join(dealt, "block").drop("block").mapInArrow(_scored(k + 1), "asker long, score double, id long, own boolean")
