"""Periodic runs of words: a suffix automaton whose suffix-link tree is held in link-cut trees.

Each word is appended to the automaton of its text. The access from the new prefix to the root passes the segments of the tree that
were last seen at one end each; a segment of length l last seen d words ago is a square of period d where d <= l, its stretch being
the last l + d words. The stretch reaches as far left as its period holds, d is its smallest period (a smaller one would have been
seen later), and it extends to the last end at which its start and period come up. The access then recolours the whole path.

Texts don't meet, so nothing is shuffled; a text is read whole by one task. Before the automaton is built, stretches in which no run
can lie are left out: in a run of 3 periods and 24 words every 8 words come again within a third of the stretch that holds them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, TIMES = 24, 3
RUN = "struct<start:bigint,length:bigint,period:bigint>"
_M = np.uint64(0x9E3779B97F4A7C15)


def automaton_runs(word: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of ``times`` periods and ``least`` items, by start and period."""
    size = 2 * len(word) + 2
    # State 1 is the root and stays outside the trees; 0 is none. ``seen`` (the last end) counts at the top of each splay tree only.
    steps: list[dict[int, int]] = [{} for _ in range(2)]
    link, longest, up, left, right, seen = ([0] * size for _ in range(6))
    made, last = 1, 1
    found: dict[tuple[int, int], int] = {}

    def splay(x: int) -> None:
        while True:
            y = up[x]
            if not y or (left[y] != x and right[y] != x):
                return
            z = up[y]
            if z and (left[z] == y or right[z] == y):
                top = up[z]
                seen[x] = seen[z]
                if left[z] == y:
                    if left[y] == x:
                        a, b = right[y], right[x]
                        left[z], right[y], up[z] = a, z, y
                        left[y], right[x], up[y] = b, y, x
                        if a:
                            up[a] = z
                        if b:
                            up[b] = y
                    else:
                        a, b = left[x], right[x]
                        right[y], left[z], left[x], right[x], up[y], up[z] = a, b, y, z, x, x
                        if a:
                            up[a] = y
                        if b:
                            up[b] = z
                elif right[y] == x:
                    a, b = left[y], left[x]
                    right[z], left[y], up[z] = a, z, y
                    right[y], left[x], up[y] = b, y, x
                    if a:
                        up[a] = z
                    if b:
                        up[b] = y
                else:
                    a, b = left[x], right[x]
                    right[z], left[y], left[x], right[x], up[z], up[y] = a, b, z, y, x, x
                    if a:
                        up[a] = z
                    if b:
                        up[b] = y
                up[x] = top
                if top:
                    if left[top] == z:
                        left[top] = x
                    elif right[top] == z:
                        right[top] = x
            else:
                seen[x] = seen[y]
                if left[y] == x:
                    a = right[x]
                    left[y], right[x] = a, y
                else:
                    a = left[x]
                    right[y], left[x] = a, y
                if a:
                    up[a] = y
                up[x], up[y] = z, x
                return

    for end, c in enumerate(word):
        made += 1
        new, p = made, last
        longest[new] = longest[last] + 1
        steps.append({})
        while p and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if not p:
            parent = 1
        else:
            q = steps[p][c]
            if longest[q] == longest[p] + 1:
                parent = q
            else:  # the clone stands above ``q`` and was last seen where ``q`` was
                made += 1
                parent = made
                longest[parent], link[parent] = longest[p] + 1, link[q]
                steps.append(dict(steps[q]))
                link[q] = parent
                splay(q)
                a = left[q]
                left[parent], up[parent], left[q] = a, q, parent
                if a:
                    up[a] = parent
                while p and steps[p].get(c) == q:
                    steps[p][c] = parent
                    p = link[p]
        link[new] = parent
        if parent > 1:
            up[new] = y = parent
            below = new
            while y:
                splay(y)
                ago, reach = end - seen[y], longest[y]
                if reach >= (times - 1) * ago and reach + ago >= least:
                    found[end - ago - reach + 1, ago] = end
                cut = right[y]
                if cut:
                    seen[cut] = seen[y]
                right[y] = below
                below, y = y, up[y]
            seen[below] = end
        else:
            seen[new] = end
        last = new
    return sorted((start, end - start + 1, period) for (start, period), end in found.items())


def stretches(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """(start, end) of the stretches in which runs can lie; each run lies whole in one of them.

    Windows of k = least / times items that don't come again within a ``times``-th of their stretch belong to no run: a run of
    ``times`` >= 3 periods holds each of its windows once more, one period on or back.
    """
    k = max(1, least // times)
    if len(ids) < least:
        return []
    n = len(ids) - k + 1
    grams = np.zeros(n, np.uint64)
    for i in range(k):
        grams = grams * _M + ids[i : i + n]
    order = np.argsort(grams, kind="stable")
    gaps = np.where(grams[order[1:]] == grams[order[:-1]], order[1:] - order[:-1], len(ids))
    near = np.full(n, len(ids))
    near[order[1:]] = gaps
    near[order[:-1]] = np.minimum(near[order[:-1]], gaps)
    alive = near < len(ids)
    while True:
        edges = np.flatnonzero(np.diff(np.concatenate(([0], alive.view(np.int8), [0]))))
        starts, ends = edges[::2], edges[1::2] + k - 1
        lengths = ends - starts
        reach = np.repeat(np.where(lengths >= least, lengths // times, 0), lengths - k + 1)
        stays = near[alive] <= reach
        if stays.all():
            return [(int(a), int(b)) for a, b in zip(starts, ends, strict=True)]
        alive[alive] = stays


def word_runs(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text's words, by start and period."""
    if len(words) < least:
        return []
    known: dict[bytes, int] = {}
    ids = [known.setdefault(w, len(known)) for w in words]
    marked = (np.array(ids, np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    marked ^= marked >> np.uint64(29)
    found = []
    for a, b in stretches(marked, least, times):
        found += [(a + start, length, period) for start, length, period in automaton_runs(ids[a:b], least, times)]
    return sorted(found)


def _found(least: int, times: int, prepare: Callable[[object, list[bytes]], list[bytes]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, runs, numbers, texts = batch.column("id"), [], [], []
            for key, text in zip(ids, batch.column("text"), strict=True):
                text = text.as_py()
                words = text.encode("utf-8", "surrogatepass").split() if text else []
                words = prepare(key.as_py(), words) if prepare else words
                found = word_runs(words, least, times)
                runs.append([{"start": a, "length": n, "period": q} for a, n, q in found])
                numbers.append(len(words))
                if found:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for a, n, q in found:
                        gone[a + q] += 1
                        gone[a + n] -= 1
                    words = [w for w, out in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not out]
                texts.append(b" ".join(words).decode("utf-8", "replace"))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(numbers, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())], ["id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES, prepare: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per document: ``id_col``, ``n_words``, ``runs`` (start, length, period; by start and period), ``collapsed``.

    A run is a stretch of words with smallest period q, of ``least`` words and ``times`` (3 or more) periods at least, that no
    neighbouring word extends. ``collapsed`` is the text without the words that lie behind the first q words of some run, its words
    joined by one space. Words are compared as they are. A null, empty or blank text has no words, no runs and an empty
    ``collapsed``. Rows are judged each by itself, repeated ones alike; very long texts are read whole. Other columns are not read.
    An empty table gives an empty one. ``prepare(identifier, words)`` may change a text's words first.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = base.schema["id"].dataType.simpleString()
    found = base.mapInArrow(_found(least, times, prepare), f"id {id_type}, n_words long, runs array<{RUN}>, collapsed string")
    return found.select(F.col("id").alias(id_col), "n_words", "runs", "collapsed")


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The number of runs, the one with the greatest exact length / period (ties: smallest start, then period; nulls without one), and
    SHA-256 of the list of runs and of the collapsed text."""
    more = lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a)
    best = F.aggregate("runs", F.lit(None).cast(RUN), more)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    out = found.withColumn("best", best)
    return out.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
