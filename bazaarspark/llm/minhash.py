"""MinHash near-dedup: universal hash minima, banding, signature verification, alternating large-star and small-star.

Documents with equal shingle sets form a class and are one node from there on. 32 bands of 7 minima put two classes
with a similarity of 0.85 into a common bucket but for about 4 cases in a million. Nothing caps a bucket: a large one
is cut into random blocks, and blocks meet in pairs, so that a task holds two blocks at most.

Pairs are found in two passes, as copies of copies would otherwise give all pairs of a group:

1. Within each block, every class is paired with its two most similar ones and with the block's most central one.
   Pairs that the signatures rule out are left out; the rest is confirmed on the full shingle sets. Stars of large
   groups come out of this pass in one component.
2. In buckets that still hold more than one component, all pairs of different components that the signatures don't
   rule out are confirmed on the full sets. A pair inside one component could not change the result. A pair is taken
   in the first bucket that it shares, and not in each.

The signatures of 512 one-byte minima rule out a pair below 0.78; at a similarity of 0.85 that is 4.4 standard deviations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarspark.llm import scratch
from bazaarspark.llm.components import connected_components
from bazaarspark.llm.shingles import Minima, shingle_set

ROWS, BANDS = 7, 32
SIGNATURE = 512
#: Members of a block on average.
BLOCK = 192


def _key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _band_keys(minima: np.ndarray) -> list[int]:
    parts = minima.reshape(BANDS, ROWS)
    return [xxhash.xxh3_64_intdigest(p.tobytes(), seed=i) - 2**63 for i, p in enumerate(parts)]


def _scan(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima = Minima(ROWS * BANDS, seed=11)
        for batch in batches:
            sizes, keys, bands = [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), k)
                sizes.append(len(s))
                keys.append(_key(s) if len(s) else None)
                bands.append(_band_keys(minima.of(s)) if len(s) else [])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "digest", "n", "key", "bands"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima = Minima(SIGNATURE, seed=12)
        for batch in batches:
            keys, sizes, sets, signatures = [], [], [], []
            for text, key in zip(batch.column("text"), batch.column("key"), strict=True):
                s = shingle_set(text.as_py(), k)
                if _key(s) == key.as_py():  # else another row with the same identifier
                    keys.append(key.as_py())
                    sizes.append(len(s))
                    sets.append(s.view(np.int64))
                    signatures.append(minima.of(s).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sets, pa.list_(pa.int64())), pa.array(signatures, pa.binary())], ["key", "n", "sh", "sig"])

    return run


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each row of ``members``: keys, sizes, signatures as a matrix, and members' other fields as an Arrow array."""
    lists = batch.column("members")
    flat = lists.flatten()
    keys = np.array(flat.field("key").to_pylist(), dtype=object)
    sizes = flat.field("n").to_numpy(zero_copy_only=False)
    signatures = np.frombuffer(b"".join(flat.field("sig").to_pylist()), np.uint8).reshape(-1, SIGNATURE)
    at = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        yield keys[lo:hi], sizes[lo:hi], signatures[lo:hi], flat[lo:hi]


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), len(b)), np.int32)
    for i in range(0, len(a), 16):
        out[i : i + 16] = (a[i : i + 16, None] == b[None]).sum(-1)
    return out


def _close(sizes: np.ndarray, signatures: np.ndarray, percent: int) -> np.ndarray:
    """Agreements of the pairs that can be linked; 0 elsewhere and on the diagonal."""
    agree = _agreement(signatures, signatures)
    least = (max(percent / 100 - 0.07, 0) + 1 / 256) * SIGNATURE
    agree[(agree < least) | (100 * np.minimum.outer(sizes, sizes) < percent * np.maximum.outer(sizes, sizes))] = 0
    np.fill_diagonal(agree, 0)
    return agree


def _pairs(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.binary()), pa.array([max(p) for p in found], pa.binary())], ["a", "b"])


def _nearest(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for keys, sizes, signatures, _ in _groups(batch):
                if len(keys) < 2:
                    continue
                agree = _close(sizes, signatures, percent)
                hub = int(agree.sum(1).argmax())
                links = {(i, hub) for i in np.flatnonzero(agree[hub])}
                for _ in range(2):
                    best = agree.argmax(1)
                    links |= {(i, j) for i, j in enumerate(best) if agree[i, j]}
                    agree[np.arange(len(keys)), best] = 0
                found += {(min(p), max(p)) for p in ((keys[i], keys[j]) for i, j in links)}
            yield _pairs(found)

    return run


def _across(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for bucket, (keys, sizes, signatures, members) in zip(batch.column("bucket").to_pylist(), _groups(batch), strict=True):
                labels = members.field("label").to_pylist()
                if len(set(labels)) > 1:
                    _, label = np.unique(np.array([x.hex() for x in labels]), return_inverse=True)
                    agree = np.triu(_close(sizes, signatures, percent))
                    agree[label[:, None] == label[None]] = 0
                    i, j = np.nonzero(agree)
                    bands = members.field("bands").flatten().to_numpy().reshape(-1, BANDS)
                    first = (bands[i] == bands[j]).argmax(1)
                    here = bands[i, first] == bucket
                    found += [(keys[x], keys[y]) for x, y in zip(i[here], j[here], strict=True)]
            yield _pairs(found)

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = sets.select(F.col("key").alias("a"), F.col("sh").alias("sa"))
    right = sets.select(F.col("key").alias("b"), F.col("sh").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _blocks(rows: DataFrame, *fields: str) -> DataFrame:
    """Lists of the members of each pair of blocks; with one block in a bucket, that block alone."""
    return rows.groupBy("bucket", "i", "j").agg(F.collect_list(F.struct("key", "n", "sig", *fields)).alias("members")).select("bucket", "members")


def _digest(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def near_rows(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """One row per document: (id, digest, n, key, group, component_id). ``digest`` is of the text, ``key`` of the set, and ``group``
    is one for all rows of a component; a row without a set or identifier has no group."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), _digest(text_col).alias("digest"))
    id_type = base.schema["id"].dataType.simpleString()
    scanned = scratch.written(base.mapInArrow(_scan(k), f"id {id_type}, digest long, n long, key binary, bands array<long>"), "minhash-scan")
    base = base.drop("digest")
    classes = scratch.written(scanned.where("id is not null and n > 0").groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.any_value("bands").alias("bands")), "minhash-classes")

    banded = classes.select("key", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = banded.join(shared, "bucket").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("key", "bucket"), F.col("blocks")).cast("int"))
    members = scratch.written(members, "minhash-members")

    wanted = members.select("key").distinct().join(classes.select("key", F.col("first").alias("id")), "key")
    sets = scratch.written(base.join(wanted, "id").select("text", "key").mapInArrow(_sets(k), "key binary, n long, sh array<long>, sig binary").dropDuplicates(["key"]), "minhash-sets")

    signed = members.join(sets.select("key", "n", "sig"), "key")
    near = _blocks(signed.select("bucket", F.col("block").alias("i"), F.col("block").alias("j"), "key", "n", "sig"))
    tried = scratch.written(near.mapInArrow(_nearest(percent), "a binary, b binary").distinct(), "minhash-tried")
    links = scratch.written(_confirmed(tried, sets, percent), "minhash-links")
    parts = scratch.written(connected_components(links), "minhash-parts")

    labelled = members.where("size > 2").join(parts.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("component", "key")).drop("component")
    mixed = labelled.groupBy("bucket").agg((F.min("label") != F.max("label")).alias("mixed")).where("mixed").select("bucket")
    rest = labelled.join(mixed, "bucket").join(sets.select("key", "n", "sig"), "key").join(classes.select("key", "bands"), "key")
    dealt = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = _blocks(dealt.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "n", "sig", "label", "bands"), "label", "bands")
    more = blocks.mapInArrow(_across(percent), "a binary, b binary").distinct().join(tried, ["a", "b"], "left_anti")
    more = scratch.written(_confirmed(more, sets, percent), "minhash-links")
    parts = scratch.written(connected_components(links.unionByName(more)), "minhash-parts") if not more.isEmpty() else parts

    least = parts.join(classes.select(F.col("key").alias("node"), "first"), "node").groupBy("component").agg(F.min("first").alias("component_id"))
    linked = parts.join(least, "component").select(F.col("node").alias("key"), "component", "component_id")
    ids = classes.where("copies > 1").select("key", "first").join(linked, "key", "full").select("key", "component", F.coalesce("component_id", "first").alias("component_id"))
    named = F.col("id").isNotNull()
    of = F.coalesce(F.when(named, F.col("component_id")), F.col("id"))
    return scanned.select("id", "digest", "n", "key").join(ids, "key", "left").select("id", "digest", "n", F.when(named, F.coalesce("component", "key")).alias("group"), of.alias("component_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``id_col``, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked when 100 * intersection >= ``percent`` * union of their sets of ``k``-word shingles (A-Z
    lower-cased). ``component_id`` is the smallest identifier reachable by links, itself included, and ``kept`` says
    that it is the row's own. A text with fewer words has one shingle; null and empty texts, and texts of white space,
    have none and are linked with nothing. A row with a null identifier is linked with nothing and kept. Rows that share
    an identifier are one document each by its own text. Very long texts enter whole. Other columns are not read. An empty
    table gives an empty one.
    """
    found = near_rows(docs, id_col, text_col, k, percent)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near copies, with all columns: the one with the smallest identifier (of one identifier, with
    the smallest digest of its text; of rows with both, one).

    Decisions are taken by row and not by identifier: a row goes only if its own text has a copy that stays. Rows without words or
    without an identifier stay. An empty table gives an empty one.
    """
    found = scratch.written(near_rows(docs, id_col, text_col, k, percent).where("group is not null").select("id", "digest", "group"), "minhash-groups")
    least = found.groupBy("group").agg(F.min(F.struct("id", "digest")).alias("least"), F.count("*").alias("n")).where("n > 1")
    members = found.join(least, "group").select("id", "digest", (F.struct("id", "digest") == F.col("least")).alias("stays"))
    rows = members.groupBy("id", "digest").agg(F.max("stays").alias("stays"), F.count("*").alias("n"))
    rows = scratch.written(rows.select(F.col("id").alias("_near_id"), F.col("digest").alias("_near_digest"), "stays", "n"), "minhash-decisions")
    marked = docs.withColumn("_near_text", _digest(text_col))
    same = (marked[id_col] == F.col("_near_id")) & (F.col("_near_text") == F.col("_near_digest"))
    again = rows.where("stays and n > 1").select("_near_id", "_near_digest")
    kept = marked.join(rows.where("not stays or n > 1").select("_near_id", "_near_digest"), same, "left_anti")
    if not again.isEmpty():
        kept = kept.unionByName(marked.join(again, same, "left_semi").dropDuplicates([id_col, "_near_text"]))
    return kept.drop("_near_text")
