"""Embedding near-dedup by lattice hashing.

In each of several tables a vector is projected at random to eight dimensions and decoded to the nearest point of the E8
lattice, which is its cell. A vector lies in its own cell and probes the neighbouring cells that its projection leans
to. Two vectors meet where one's own cell is the other's own or probed cell, and every pair that meets is verified by its
cosine in double precision. Large cells are cut into random blocks that meet in pairs, so that a task holds two blocks at most.
A pair counts in the first cell in which it meets; blocks give each node's number of links and the least node reached there.

Vectors are copied to the cells they meet others in, a hundred times and more. This is done in rounds, each for some of the tables or some
of the cells of one, so that the copies on disk at a time have a fixed number. Joins are hinted, as Spark takes exploded rows for few.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from bazaarspark.llm import scratch
from bazaarspark.llm.components import connected_components

TABLES = 8
PROBES = 12
#: Lattice points per unit of a projected vector. Larger: smaller cells.
SCALE = 2.4
BLOCK = 256
#: Memberships in cells that are dealt out in one round, about.
ROUND = 4_000_000
#: Up to this length of vectors, coordinates of lattice points (times two) fit into one byte.
SMALL = 4096


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8 to the rows of ``x``, times two so that all coordinates are whole numbers.

    E8 is D8 and D8 shifted by one half; the nearest point of D8 rounds all coordinates and, where their sum is odd, rounds
    the worst of them the other way (Conway and Sloane, 1982).
    """

    def d8(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        off = y - near
        odd = np.flatnonzero(near.sum(1).astype(np.int64) & 1)
        worst = np.abs(off[odd]).argmax(1)
        near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
        return near

    whole, half = d8(x), d8(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1)
    return np.rint(2 * np.where(closer[:, None], half, whole)).astype(np.int64)


def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8, times two."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((-2, 2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [v for v in product((-1, 1), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out, np.int64)


def _projections(dim: int, tables: int, seed: int = 5) -> list[np.ndarray]:
    """Random projections to eight orthonormal directions, scaled to keep lengths on average."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(tables):
        q, _ = np.linalg.qr(rng.standard_normal((max(dim, 8), 8)))
        out.append(q[:dim] * np.sqrt(dim / 8) * SCALE)
    return out


def _cells(points: np.ndarray, table: int) -> list[int]:
    return [xxhash.xxh3_64_intdigest(p.tobytes(), seed=table) - 2**63 for p in points]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # neither overflows nor underflows
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Unit vectors of lists of one length."""
    return _unit(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1))


def _hashed(tables: int, probes: int):
    """(node, width, home, probed): for each table the own point, and which of its neighbours are probed."""
    around = neighbours()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, lengths = batch.column("node").to_numpy(), batch.column("v").value_lengths().to_numpy()
            for width in np.unique(lengths):
                rows = np.flatnonzero(lengths == width)
                x = _matrix(batch.column("v").take(pa.array(rows)))
                homes, probed = np.empty((len(x), tables, 8), np.int8 if width <= SMALL else np.int16), np.empty((len(x), tables, probes), np.uint8)
                for t, p in enumerate(_projections(int(width), tables)):
                    y = x @ p
                    homes[:, t] = home = decode_e8(y)
                    lean = (y - home / 2) @ around.T
                    for k in range(probes):
                        probed[:, t, k] = best = lean.argmax(1)
                        lean[np.arange(len(x)), best] = -np.inf
                raw = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (homes, probed)]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[rows]), pa.array(np.full(len(x), width, np.int32)), *raw], ["node", "width", "home", "probed"])

    return run


def _placed(tables: int, probes: int, some: range):
    """(node, width, table, cell, own): the cells of the nodes in some tables, the own one and those probed."""
    around = neighbours()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, probed = batch.column("width").to_numpy(), batch.column("probed").to_pylist()
            homes = batch.column("home").to_pylist()
            for small in (True, False):
                rows = np.flatnonzero((widths <= SMALL) == small)
                if not len(rows):
                    continue
                home = np.frombuffer(b"".join([homes[i] for i in rows]), np.int8 if small else np.int16).reshape(len(rows), tables, 8)
                step = np.frombuffer(b"".join([probed[i] for i in rows]), np.uint8).reshape(len(rows), tables, probes)
                for t in some:
                    own = home[:, t].astype(np.int64)
                    points = np.concatenate([own[:, None], own[:, None] + around[step[:, t]]], 1).reshape(-1, 8)
                    at = np.repeat(rows, probes + 1)
                    columns = [batch.column("node").take(pa.array(at)), batch.column("width").take(pa.array(at)), pa.array(np.full(len(at), t, np.int32)), pa.array(_cells(points, t), pa.int64()), pa.array(np.arange(len(at)) % (probes + 1) == 0)]
                    yield pa.RecordBatch.from_arrays(columns, ["node", "width", "table", "cell", "own"])

    return run


def _steps() -> np.ndarray:
    """By the difference of two points, as digits to the base of five: the neighbour it leads to, 240 for none at all, -1 for others."""
    table = np.full(5**8, -1, np.int16)
    table[(neighbours() + 2) @ 5 ** np.arange(8)] = np.arange(240)
    table[np.full(8, 2) @ 5 ** np.arange(8)] = 240
    return table


def _first_met(home: np.ndarray, probed: np.ndarray, r: np.ndarray, c: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """For pairs (r, c), twice the first table in which they meet, plus one where only the own cell of ``c`` is met there."""
    apart = home[c].astype(np.int64) - home[r]
    near = np.abs(apart).max(2) <= 2
    met = []
    for there, other in ((-apart, c), (apart, r)):
        step = np.where(near, steps[np.where(near[:, :, None], there + 2, 0) @ 5 ** np.arange(8)], -1)
        met.append((step == 240) | (probed[other] == step[:, :, None]).any(2))
    return np.stack(met, 2).reshape(len(r), -1).argmax(1)


def _least_reached(n: int, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the least one that links reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[r], label[c])
        new = label.copy()
        np.minimum.at(new, r, low)
        np.minimum.at(new, c, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verified(threshold: float, tables: int):
    """For each node of two blocks that has links there, their number and the least node they reach. Every pair of the corpus is
    taken in the first cell in which it meets, so that counts add up and no table of pairs is made."""

    steps = _steps()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("members")
            flat = lists.flatten()
            nodes, own, block, copies = flat.field("node").to_numpy(), flat.field("own").to_numpy(zero_copy_only=False), flat.field("block").to_numpy(), flat.field("copies").to_numpy()
            vectors, homes, probes = flat.field("v"), flat.field("home"), flat.field("probed")
            at = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            out: tuple[list, list, list] = ([], [], [])
            for lo, hi, i, j, table in zip(at[:-1], at[1:], batch.column("i").to_pylist(), batch.column("j").to_pylist(), batch.column("table").to_pylist(), strict=True):
                n, o, b, weight = nodes[lo:hi], own[lo:hi], block[lo:hi], copies[lo:hi]
                left, right = np.flatnonzero(o & (b == i)), np.flatnonzero(b == j)
                if not len(left) or not len(right):
                    continue
                v = _matrix(vectors[lo:hi])
                r, c = np.nonzero(v[left] @ v[right].T >= threshold - 1e-9)
                r, c = left[r], right[c]
                swap = n[r] > n[c]
                r, c = np.where(swap, c, r), np.where(swap, r, c)
                exact = (n[r] != n[c]) & ((v[r] * v[c]).sum(1) >= threshold)
                if not exact.any():
                    continue
                r, c = np.unique(np.stack([r[exact], c[exact]]), axis=1)  # own members of one block meet from both sides
                home = homes[lo:hi].to_pylist()
                home = np.frombuffer(b"".join(home), np.int8 if len(home[0]) == 8 * tables else np.int16).reshape(hi - lo, tables, 8)
                probed = np.frombuffer(b"".join(probes[lo:hi].to_pylist()), np.uint8).reshape(hi - lo, tables, -1)
                first = _first_met(home, probed, r, c, steps)
                # A node is an own member of one cell of a table, so that this tells whether the pair meets first in this cell.
                here = (first >> 1 == table) & np.where(first & 1, o[c], o[r])
                # Two own members of different blocks meet in (i, j) and in (j, i).
                here &= ~(o[r] & o[c]) | (b[r] <= b[c]) & (b[r] == i) | (b[r] > b[c]) & (b[c] == i)
                r, c = r[here], c[here]
                if len(r):
                    count = np.bincount(r, weight[c], len(n)).astype(np.int64) + np.bincount(c, weight[r], len(n)).astype(np.int64)
                    order = np.argsort(n, kind="stable")
                    place = np.empty(len(n), np.int64)
                    place[order] = np.arange(len(n))
                    least = n[order][_least_reached(len(n), place[r], place[c])][place]
                    some = np.flatnonzero(count)
                    out[0].append(n[some])
                    out[1].append(count[some])
                    out[2].append(least[some])
            columns = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out]
            yield pa.RecordBatch.from_arrays(columns, ["node", "links", "least"])

    return run


def _rounds(hashed: DataFrame, tables: int, probes: int, size: int | None = None) -> Iterator[DataFrame]:
    """Where nodes lie (node, width, table, cell, own), about ``size`` (``ROUND``) rows at a time."""
    size, a_table = size or ROUND, max(1, hashed.count() * (probes + 1))
    at_once, parts = max(1, min(tables, size // a_table)), -(-a_table // size)
    for first in range(0, tables, at_once):
        placed = hashed.select("node", "width", "home", "probed").mapInArrow(_placed(tables, probes, range(first, min(first + at_once, tables))), "node long, width int, table int, cell long, own boolean")
        for part in range(parts):
            yield placed.where(F.pmod(F.xxhash64("cell"), F.lit(parts)) == part) if parts > 1 else placed


def _links(placed: DataFrame, carried: DataFrame, threshold: float, tables: int) -> DataFrame:
    """(node, least, links) from the cells that are placed."""
    key = ["table", "cell", "width"]
    sizes = placed.groupBy(*key).agg(F.count("*").alias("n"), F.count_if("own").alias("owned")).where("owned > 0 and n > 1")
    members = placed.join(sizes.hint("merge"), key).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node", "cell"), F.col("blocks")).cast("int"))
    # An own member meets the members of every block; a probing member meets the own members of every block.
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    as_left = members.where("own").select("node", *key, "own", "block", F.col("block").alias("i"), F.explode(every).alias("j"))
    as_right = members.select("node", *key, "own", "block", F.explode(every).alias("i"), F.col("block").alias("j"))
    dealt = as_left.unionByName(as_right).distinct().join(carried.hint("merge"), "node")
    groups = dealt.groupBy(*key, "i", "j").agg(F.collect_list(F.struct("node", "own", "block", "copies", "v", "home", "probed")).alias("members")).select("table", "i", "j", "members")
    return groups.mapInArrow(_verified(threshold, tables), "node long, links long, least long").groupBy("node", "least").agg(F.sum("links").alias("links"))


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """One row per vector: ``id_col``, ``n_links``, ``component_id``, ``kept``.

    Vectors with a cosine of ``threshold`` or more are linked; ``n_links`` counts the other vectors that a vector is linked
    with directly, equal ones included, and ``component_id`` is the smallest identifier reachable. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing, nor do vectors of different lengths with each other, nor
    rows with a null identifier. Equal vectors are one node, whatever their number. Other columns are not read. An empty
    table gives an empty one. Rows with one identifier and several vectors are one node. Recall is measured against brute force in the tests.
    """
    single = vectors.schema[vector_col].dataType == ArrayType(FloatType(), vectors.schema[vector_col].dataType.containsNull)
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"))
    usable = F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(F.coalesce(usable, F.lit(False)), F.transform("v", lambda x: x + 0.0)).cast("array<float>" if single else "array<double>"))  # floats are carried as such, which loses nothing
    nodes = scratch.written(rows.where("v is not null").groupBy("v").agg(F.min("id").cast("long").alias("node"), F.count("*").alias("copies")), "lattice-nodes")
    hashed = scratch.written(nodes.select("node", "v").mapInArrow(_hashed(tables, probes), "node long, width int, home binary, probed binary"), "lattice-points")
    carried = scratch.written(nodes.select("node", "v", "copies").join(hashed.hint("merge"), "node").drop("width"), "lattice-carried")
    found_links = [scratch.written(_links(placed, carried, threshold, tables), "lattice-round") for placed in _rounds(hashed, tables, probes)]
    links = reduce(DataFrame.unionByName, found_links)
    links = scratch.written(links.groupBy("node", "least").agg(F.sum("links").alias("links")), "lattice-links")
    for done in (carried, hashed, *found_links):
        scratch.drop(done)

    parts = connected_components(links.select(F.col("node").alias("a"), F.col("least").alias("b")))
    more = links.groupBy("node").agg(F.sum("links").alias("more"))
    known = nodes.join(more.hint("merge"), "node", "left").join(parts.hint("merge"), "node", "left")
    known = known.select("v", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n"), F.coalesce("component", "node").alias("component"))
    found = rows.join(known.hint("merge"), "v", "left")
    component = F.coalesce(F.when(F.col("v").isNotNull(), F.col("component")), F.col("id"))
    return found.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
