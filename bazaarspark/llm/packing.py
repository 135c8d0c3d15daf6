"""Packing documents into sequences as a cutting-stock problem, by column generation.

Documents are cut every 1024 ids, and what remains at the last multiple of 32 in it, so that pieces have one of 63
lengths. Their histogram is all that the driver sees. The linear program over patterns (how many pieces of each length share a sequence) starts from patterns of one length; an
exact-fill knapsack, by dynamic programming over the current prices, finds the pattern that improves most, and a pivot
takes it in. Patterns are rounded down, the few pieces left are packed best-fit. Pieces are then ranked within their
length, in two steps so that no task holds a length, and ranks are looked up in the patterns' ranges.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarspark.llm import scratch

CAPACITY = 1024
#: The rest of a document after its full pieces is cut at the last multiple of this.
GRAIN = 32
#: The linear program ends when padding is under this share of all ids, or no pattern improves it.
GAP = 0.001
#: Fixed value: the special token of the vocabulary. Its string in a text is this one id.
SPECIAL = {"<|endoftext|>": 50256}
#: Pieces of one length that a task ranks, about.
RANKED = 100_000


def _encoder(ranks_path: str | None):
    """The encoder whose ids are those of ``byte_bpe_50k.json``: the same vocabulary as ranks, which is several times faster, and
    its special token."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def _pieces(ranks_path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path)
        for batch in batches:
            at, starts, lengths, crcs, totals = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.append(np.asarray(encoder.encode_to_numpy(text.as_py() or "", allowed_special="all", disallowed_special=()), "<u4"), np.uint32(0))
                for start, end in cuts(len(ids)):
                    piece = ids[start:end]
                    at.append(i)
                    starts.append(start)
                    lengths.append(len(piece))
                    crcs.append(zlib.crc32(piece.tobytes()))
                    totals.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def cuts(n: int) -> list[tuple[int, int]]:
    """Where a document of ``n`` ids is cut."""
    full = n - n % CAPACITY
    even = n - n % GRAIN
    marks = [*range(0, full, CAPACITY), full, *([even] if even > full else []), *([n] if n > even else [])]
    return list(zip(marks[:-1], marks[1:], strict=True))


def _cost(total: int) -> int:
    """Ids of a sequence after padding: none is added at a power of two."""
    return total if total & (total - 1) == 0 else CAPACITY


def _best_pattern(sizes: np.ndarray, prices: np.ndarray) -> tuple[float, Counter]:
    """The pattern whose prices exceed its cost most, by dynamic programming over exact totals."""
    value, last = np.full(CAPACITY + 1, -np.inf), np.zeros(CAPACITY + 1, np.int64)
    value[0] = 0
    for t in range(int(sizes[0]), CAPACITY + 1):
        n = np.searchsorted(sizes, t, "right")
        gains = value[t - sizes[:n]] + prices[:n]
        last[t] = j = int(gains.argmax())
        value[t] = gains[j]
    costs = np.array([0, *(_cost(t) for t in range(1, CAPACITY + 1))], float)
    t = int((value - costs)[1:].argmax()) + 1
    gain, pattern = value[t] - costs[t], Counter()
    while t > 0:
        pattern[int(last[t])] += 1
        t -= int(sizes[last[t]])
    return gain, pattern


def solve(demand: dict[int, int]) -> list[tuple[dict[int, int], int]]:
    """Patterns as ({length: pieces}, sequences) that hold exactly the pieces of ``demand``."""
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[int(s)] for s in sizes], float)
    fill = CAPACITY // sizes
    patterns = [Counter({i: int(k)}) for i, k in enumerate(fill)]
    costs = np.array([_cost(int(k * s)) for k, s in zip(fill, sizes, strict=True)], float)
    inverse = np.diag(1.0 / fill)
    amounts = need / fill
    least = float((sizes * need).sum())
    for _ in range(20 * len(sizes)):
        if costs @ amounts <= (1 + GAP) * least:
            break
        gain, pattern = _best_pattern(sizes, costs @ inverse)
        if gain <= 1e-7 * CAPACITY:
            break
        column = sum(inverse[:, i] * k for i, k in pattern.items())
        ratios = np.where(column > 1e-9, amounts / np.where(column > 1e-9, column, 1), np.inf)
        out = int(ratios.argmin())
        step = ratios[out]
        amounts = np.maximum(amounts - step * column, 0)
        amounts[out] = step
        inverse[out] /= column[out]
        others = column.copy()
        others[out] = 0
        inverse -= np.outer(others, inverse[out])
        patterns[out], costs[out] = pattern, _cost(sum(int(sizes[i]) * k for i, k in pattern.items()))
    left = {i: int(n) for i, n in enumerate(need)}
    chosen = []
    for j in np.argsort(-amounts, kind="stable"):
        n = min([int(amounts[j] + 1e-6), *(left[i] // k for i, k in patterns[j].items())])
        if n > 0:
            chosen.append(({int(sizes[i]): k for i, k in patterns[j].items()}, n))
            for i, k in patterns[j].items():
                left[i] -= n * k
    return chosen + _best_fit({int(sizes[i]): n for i, n in left.items() if n})


def _best_fit(left: dict[int, int]) -> list[tuple[dict[int, int], int]]:
    """The pieces left over by rounding, longest first, each where it fits closest."""
    open_bins: dict[int, list[Counter]] = {}
    for size in sorted(left, reverse=True):
        for _ in range(left[size]):
            room = next((r for r in range(size, CAPACITY) if open_bins.get(r)), None)
            content = open_bins[room].pop() if room is not None else Counter()
            content[size] += 1
            open_bins.setdefault((CAPACITY if room is None else room) - size, []).append(content)
    same = Counter(tuple(sorted(c.items())) for contents in open_bins.values() for c in contents)
    return [(dict(c), n) for c, n in sorted(same.items())]


def _ranges(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end of ranks, first sequence, pieces in each, offset of the first) by pattern and length."""
    used: Counter = Counter()
    out, sequence = [], 0
    for content, n in patterns:
        offset = 0
        for size, k in sorted(content.items(), reverse=True):
            out.append((size, used[size], used[size] + n * k, sequence, k, offset))
            used[size] += n * k
            offset += size * k
        sequence += n
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """One row per piece: ``id_col``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    A document is its ids and then id 0; a null or empty text is id 0 alone. Each id lies in exactly one piece and the
    pieces of a sequence follow each other from offset 0. Very long texts are cut into many pieces, each placed by itself. Rows repeated whole are packed each time. Other columns are not
    read. An empty table gives an empty one. ``ranks_path``: the vocabulary, on every executor.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = base.schema["id"].dataType.simpleString()
    pieces = scratch.written(base.mapInArrow(_pieces(ranks_path), f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long"), "pieces")
    lots = max(16, 1 << (pieces.count() // RANKED).bit_length())
    dealt = pieces.withColumn("lot", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(lots)))
    counts = dealt.groupBy("length", "lot").agg(F.count("*").alias("n"))
    demand = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # 63 rows at most
    whole = demand.pop(CAPACITY, 0)
    ranges = _ranges([({CAPACITY: 1}, whole)] * (whole > 0) + solve(demand))
    spark = docs.sparkSession
    places = spark.createDataFrame(ranges, "length long, lo long, hi long, sequence long, each long, at long")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("lot")) - F.col("n")).drop("n")
    own = Window.partitionBy("length", "lot").orderBy("id", "start", "ids_crc32", "doc_tokens")
    ranked = dealt.join(before, ["length", "lot"]).withColumn("rank", F.col("before") + F.row_number().over(own) - 1)
    # A few ranges for each of 63 lengths: the size of the broadcast doesn't depend on the documents.
    placed = ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).drop(places["length"])
    nth = F.col("rank") - F.col("lo")
    return placed.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.floor(nth / F.col("each"))).alias("sequence_id"), (F.col("at") + (nth % F.col("each")) * F.col("length")).alias("offset"))
