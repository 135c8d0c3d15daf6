"""JSON lists read by many tasks, however few files and lines they have.

Spark's text reader cuts a file into blocks at any byte and lets each begin behind the next mark; with ``}`` as the mark, every block begins
where an object may have ended, in a string or not. One pass gives each block's effect for either case: whether it leaves a string, how deep it
goes and comes out. These few numbers of each block, put together in order, tell how every block begins, so that the second pass cuts out the
elements of the list; those that go on in a later block are put together by the block in which they began.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MARK = re.compile(r'\\.|["{}\[\]]', re.S)
_DEPTH = {"{": 1, "[": 1, "}": -1, "]": -1}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    """(file and place of the block, text up to and with a mark). The text behind a file's last mark gets one too many."""
    for batch in batches:
        for file, start, value in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), batch.column("value").to_pylist(), strict=True):
            yield (file, start), value + "}"


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By block: its first character, quotes modulo 2, and for a beginning outside and inside of a string the change of depth and its least."""
    found: dict[tuple[str, int], list] = {}
    for block, text in _blocks(batches):
        e = found.setdefault(block, ["", 0, 0, 0, 0, 0])
        e[0] = e[0] or text.lstrip("﻿ \t\r\n")[:1]
        for m in _MARK.finditer(text):
            c = m[0]
            if c == '"':
                e[1] ^= 1
            elif c in _DEPTH:
                at = 2 + 2 * e[1]
                e[at] += _DEPTH[c]
                e[at + 1] = min(e[at + 1], e[at])
    rows = [[f, s, *e] for (f, s), e in found.items()]
    kinds = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 5]
    names = ["file", "start", "first", "quotes", "out", "out_least", "inside", "inside_least"]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _begins(effects: list) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """How each block begins: in a string or not, how deep, and in which block its open element began."""
    out: dict[tuple[str, int], tuple[bool, int, int]] = {}
    file, quoted, depth, owner = None, False, 0, 0
    for e in sorted(effects, key=lambda e: (e["file"], e["start"])):
        if e["file"] != file:
            if depth > 0 or quoted:
                raise ValueError(f"{file} is cut off")
            if e["first"] != "[":
                raise ValueError(f"{e['file']} is not a JSON list")
            file, quoted, depth, owner = e["file"], False, 0, 0
        out[e["file"], e["start"]] = (quoted, depth, owner)
        change, least = (e["inside"], e["inside_least"]) if quoted else (e["out"], e["out_least"])
        if depth < 2 or depth + least < 2:
            owner = e["start"]
        depth, quoted = depth + change, quoted ^ bool(e["quotes"])
    if depth > 0 or quoted:
        raise ValueError(f"{file} is cut off")
    return out


def _elements(begins: dict[tuple[str, int], tuple[bool, int, int]]):
    """(file, owner, start, text): whole elements without an owner, and parts of those that lie in several blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        block, quoted, depth, owner, held, ended = None, False, 0, None, [], False

        def left() -> None:
            if held and any(held):
                rows.append((*block[:1], owner if owner is not None else block[1], block[1], "".join(held)))

        for at, text in _blocks(batches):
            if at != block:
                left()
                block, held, ended = at, [], False
                quoted, depth, owner = begins[at]
                owner = owner if depth >= 2 else None
            begin = 0
            for m in _MARK.finditer(text):
                c = m[0]
                if ended:
                    if c not in "}]":
                        raise ValueError(f"{at[0]} goes on behind its list")
                    continue
                if c == '"':
                    quoted = not quoted
                elif not quoted and c in _DEPTH:
                    depth += _DEPTH[c]
                    if depth == 2 and _DEPTH[c] > 0:
                        begin, held, owner = m.start(), [], None
                    elif depth == 1 and _DEPTH[c] < 0:
                        rows.append((at[0], owner, at[1], "".join(held) + text[begin : m.end()]))
                        held, owner, begin = [], None, m.end()
                    elif depth == 0:
                        ended = True
            if depth >= 2 and not ended:
                held.append(text[begin:])
            if len(rows) >= 1_024:
                yield _rows(rows)
                rows = []
        left()
        yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["file", "owner", "start", "text"])


def read_json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The elements of one or more JSON lists of objects or lists, with a fixed schema. Anything but a list is an error."""
    marked = spark.read.option("lineSep", "}").text(path)
    marked = marked.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    effects = marked.mapInArrow(_effects, "file string, start long, first string, quotes long, out long, out_least long, inside long, inside_least long").collect()  # a row for each block
    found = marked.mapInArrow(_elements(_begins(effects)), "file string, owner long, start long, text string")
    parts = found.where("owner is not null").groupBy("file", "owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda p: p["text"]), "").alias("text"))
    texts = found.where("owner is null").select("text").unionByName(parts.select("text"))
    return texts.select(F.from_json("text", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
