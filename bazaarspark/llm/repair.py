"""Repair of conversation structure: a run-length dynamic program over min-plus transitions.

A row is a symbol: its role's initial and its fault. A symbol moves between four states of ``(s?(ua)+)?`` (nothing yet, after s, after
u, after a) at the costs of a 4 x 4 min-plus matrix. Equal consecutive symbols are one run, which is advanced through cached binary
powers of its matrix; choices are unrolled from the costs that remain, again by halves of a run, so that no list of vectors is kept.

Rows are sorted by conversation over range partitions, so that a conversation with a third of all rows lies in many tasks, and cut into
pieces of bounded size. A conversation that lies in one piece is done there. The pieces of the others have their matrices multiplied
from the last one back, as a stream of 4 x 4 numbers; then their rows stream once more in order, since choices, audit and digest of a
conversation depend on what stands before.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from bazaarspark.llm import scratch

#: A piece ends with so many distinct rows or so many characters.
PIECE_ROWS, PIECE_CHARS = 4_096, 1 << 20
# Costs of the edits, and the white space that doesn't fill a text.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACE = "\t\n\x0b\x0c\r "
FAR = 1 << 60

INITIALS = "sua"
FINE, CUT, GONE = range(3)
#: Roles that a state asks for, and the state they lead to.
WANTED, AFTER = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
#: Where rows may end, and what inserting costs until then.
START_VECTOR = (0, 2 * INSERT, INSERT, 0)
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

Vector = tuple[int, int, int, int]


def symbol(initial: str, fault: int) -> int:
    return (INITIALS.find(initial) + 1 if initial else 0) * 3 + fault


def _times(m: tuple[Vector, ...], v: Vector) -> Vector:
    return tuple(min(a + b for a, b in zip(row, v, strict=True)) for row in m)


def _product(a: tuple[Vector, ...], b: tuple[Vector, ...]) -> tuple[Vector, ...]:
    columns = list(zip(*b, strict=True))
    return tuple(tuple(min(min(x + y for x, y in zip(row, c, strict=True)), FAR) for c in columns) for row in a)


ONE = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))


def _moves(sym: int) -> list[list[tuple[str, int, int]]]:
    """For each state: (edit, cost, next state) of this row, without what is inserted before it."""
    initial, fault = ("", *INITIALS)[sym // 3], sym % 3
    out = []
    for s in range(4):
        here = [("D", DELETE, s)]
        if fault != GONE:
            more = TRUNCATED if fault == CUT else 0
            if (s, initial) in KEPT:
                here.append(("K", more, KEPT[s, initial]))
            here.append(("R", RENAME + more, AFTER[s]))
        out.append(here)
    return out


@functools.cache
def power(sym: int, k: int) -> tuple[Vector, ...]:
    """The transition over 2 ** k equal rows."""
    if k:
        half = power(sym, k - 1)
        return _product(half, half)
    step = [[FAR] * 4 for _ in range(4)]
    for s, moves in enumerate(_moves(sym)):
        for _, cost, t in moves:
            step[s][t] = min(step[s][t], cost)
    before = [list(row) for row in ONE]
    for s in range(4):
        t, cost = s, 0
        for _ in range(3):
            t, cost = AFTER[t], cost + INSERT
            before[s][t] = min(before[s][t], cost)
    return _product(tuple(map(tuple, before)), tuple(map(tuple, step)))


def matrix_of(runs: list[tuple[int, int]]) -> tuple[Vector, ...]:
    """The transition over runs of (symbol, number of rows)."""
    out = ONE
    for sym, n in runs:
        k = 0
        while n:
            if n & 1:
                out = _product(out, power(sym, k))
            n, k = n >> 1, k + 1
    return out


@functools.lru_cache(1 << 16)
def _back(sym: int, k: int, v: Vector) -> tuple[Vector, int]:
    w = _times(power(sym, k), v)
    low = min(w)
    return tuple(x - low for x in w), low


def _lowered(v: Vector) -> Vector:
    low = min(v)
    return tuple(x - low for x in v)


def back(runs: list[tuple[int, int]], v: Vector) -> list[Vector]:
    """Costs that remain after each run, lowered to a least of 0 (they differ by a bounded number, so that few vectors occur)."""
    out, v = [], _lowered(v)
    for sym, n in reversed(runs):
        out.append(v)
        k = 0
        while n:
            if n & 1:
                v = _back(sym, k, v)[0]
            n, k = n >> 1, k + 1
    return out[::-1]


@functools.lru_cache(1 << 16)
def _choice(sym: int, v: Vector, state: int) -> tuple[str, int]:
    """The cheapest edits of a row and the state after it; of equal ones the least in ASCII."""
    edits, moves = "", _moves(sym)
    least = _times(power(sym, 0), v)
    while True:
        left = least[state]
        taken = {e: t for e, cost, t in moves[state] if cost + v[t] == left}
        if "D" in taken:
            return edits + "D", taken["D"]
        if INSERT + least[AFTER[state]] == left:
            edits, state = edits + "I", AFTER[state]
            continue
        e = min(taken)
        return edits + e, taken[e]


def choices(sym: int, n: int, v: Vector, state: int) -> Iterator[tuple[str, int]]:
    """(edits of a row, state before it) for each of ``n`` equal rows that leave ``v``. A stack of halves instead of n vectors."""
    waiting = [(n, v)]
    while waiting:
        n, v = waiting.pop()
        if n > 1:
            k = (n - 1).bit_length() - 1
            waiting += [(1 << k, v), (n - (1 << k), _back(sym, k, v)[0])]
        else:
            edits, after = _choice(sym, v, state)
            yield edits, state
            state = after


def closing(state: int) -> str:
    """What is inserted after the last row."""
    return "I" * (START_VECTOR[state] // INSERT)


def _runs(rows: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for r in rows:
        for sym, n in ((r["sym"], 1), (r["again"], r["n"] - 1)):
            if n and out and out[-1][0] == sym:
                out[-1][1] += n
            elif n:
                out.append([sym, n])
    return [tuple(x) for x in out]


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


class Piece:
    """Consecutive distinct rows of one conversation, with numbers that add up over pieces."""

    __slots__ = ("rows", "chars", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last")

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.chars = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first = self.last = None

    def add(self, turn: int | None, role: str, text: str, n: int, blank: bool, cut: bool, seen: bool) -> None:
        initial = role[:1]
        fault = GONE if blank or seen else CUT if cut else FINE
        self.rows.append({"role": role, "text": text, "n": n, "sym": symbol(initial, fault), "again": symbol(initial, GONE)})
        self.chars += len(text) + len(role)
        self.blank += n if blank else 0
        self.duplicate += 0 if blank else n if seen else n - 1
        self.truncated += fault == CUT
        self.illegal += (n - 1) * (not _legal(initial, initial)) + (self.last is not None and not _legal(self.last, initial))
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.first, self.last = initial if self.first is None else self.first, initial


class Walk:
    """Reads a conversation's pieces in order."""

    def __init__(self, conv) -> None:
        self.conv, self.state, self.cost, self.edits, self.sha, self.empty, self.nth = conv, 0, 0, [], hashlib.sha256(), True, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last = None

    def _line(self, role: str, text: str) -> None:
        self.sha.update((("" if self.empty else "\n") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.empty = False

    def _insertions(self, edits: str, turns: list | None) -> None:
        state = self.state
        for _ in edits:
            self._line(WANTED[state], "")
            if turns is not None:
                turns.append(("I", WANTED[state], ""))
            self.cost, state = self.cost + INSERT, AFTER[state]
        self.state = state

    def read(self, rows: list[dict], v: Vector, turns: list | None = None) -> None:
        """``v``: what remains to be paid after these rows."""
        runs = _runs(rows)
        left = zip(runs, back(runs, v), strict=True)
        walk = iter(())
        for r in rows:
            for i in range(r["n"]):
                step = next(walk, None)
                while step is None:
                    (sym, n), after = next(left)
                    walk = choices(sym, n, after, self.state)
                    step = next(walk, None)
                edits, _ = step
                sym, edit = r["again"] if i else r["sym"], edits[-1]
                self._insertions(edits[:-1], turns)
                self.edits.append(edits)
                role = WANTED[self.state] if edit == "R" else r["role"]
                if edit == "D":
                    self.cost += DELETE
                else:
                    self.cost += (RENAME if edit == "R" else 0) + (TRUNCATED if sym % 3 == CUT else 0)
                    self._line(role, r["text"])
                    self.state = AFTER[self.state] if edit == "R" else KEPT[self.state, role[:1]]
                if turns is not None:
                    turns.append((edit, role, r["text"]))

    def count(self, p) -> None:
        self.blank, self.duplicate, self.truncated = self.blank + p.blank, self.duplicate + p.duplicate, self.truncated + p.truncated
        if p.first is not None:
            self.illegal += p.illegal + (self.last is not None and not _legal(self.last, p.first))
            self.last = p.last
        if p.high is not None:
            self.turns += p.turns - (self.high == p.low)
            self.low, self.high = p.low if self.low is None else self.low, p.high

    def end(self, turns: list | None = None) -> dict:
        edits = closing(self.state)
        self._insertions(edits, turns)
        self.edits.append(edits)
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.turns
        return {"conv": self.conv, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.edits), "repaired_sha256": self.sha.hexdigest()}


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_ROWS = "array<struct<role:string,text:string,n:bigint,sym:int,again:int>>"
_COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns", "low", "high"]


def _schema(id_type: str, *fields: str) -> str:
    return ", ".join([f"conv {id_type}", *fields])


def _report_fields() -> list[str]:
    return [f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'bigint'}" for c in REPORT]


def _piece_fields() -> list[str]:
    return ["part int", "seq bigint", "first string", "last string", "m array<bigint>", f"rows {_ROWS}", *[f"p_{c} bigint" for c in _COUNTS]]


def _batches(rows: list[dict], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=kind)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _cut(kind: pa.Schema, direct: bool):
    """Sorted rows to finished conversations, and to pieces of those that may go on in another task or are long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        conv, piece, pieces, opened, first = None, None, 0, False, True
        out: list[dict] = []

        def put(p: Piece) -> None:
            nonlocal seq
            m = [x for row in matrix_of(_runs(p.rows)) for x in row]
            out.append({"conv": conv, "part": part, "seq": seq, "first": p.first, "last": p.last, "m": m, "rows": p.rows} | {f"p_{c}": getattr(p, c) for c in _COUNTS})
            seq += 1

        def close(more: bool) -> None:
            """``more``: the conversation may have rows in another task."""
            if more or pieces or not direct:
                put(piece)
            else:
                walk = Walk(conv)
                walk.count(piece)
                walk.read(piece.rows, START_VECTOR)
                out.append(walk.end())

        for batch in batches:
            for row in batch.to_pylist():
                if not opened or row["conv"] != conv:
                    if opened:
                        close(first)
                        first = False
                    conv, piece, pieces, opened = row["conv"], Piece(), 0, True
                elif len(piece.rows) >= PIECE_ROWS or piece.chars >= PIECE_CHARS:
                    put(piece)
                    piece, pieces = Piece(), pieces + 1
                if row["n"]:
                    piece.add(row["turn"], row["role"], row["text"], row["n"], row["blank"], row["cut"], row["seen"])
                if len(out) >= 256 or out and piece.chars >= PIECE_CHARS:
                    yield _batches(out, kind)
                    out.clear()
        if opened:
            close(True)
        yield _batches(out, kind)

    return run


def _remaining(kind: pa.Schema):
    """Pieces of a conversation from the last one back: the costs that remain after each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, conv, v = False, None, START_VECTOR
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if not opened or r["conv"] != conv:
                    opened, conv, v = True, r["conv"], START_VECTOR
                out.append({"part": r["part"], "seq": r["seq"], "after": list(v)})
                m = r["m"]
                v = _lowered(_times(tuple(tuple(m[i : i + 4]) for i in range(0, 16, 4)), v))
            yield _batches(out, kind)

    return run


class _Counted:
    def __init__(self, r: dict) -> None:
        self.__dict__.update({c: r[f"p_{c}"] for c in _COUNTS}, first=r["first"], last=r["last"])


def _read(kind: pa.Schema, edits: bool):
    """Pieces in order to reports, or to the turns of the repaired conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None

        def listed(w: Walk, turns: list) -> list[dict]:
            rows = [{"conv": w.conv, "nth": w.nth + i, "edit": e, "role": role, "text": text} for i, (e, role, text) in enumerate(turns)]
            w.nth += len(turns)
            w.edits.clear()
            return rows

        for batch in batches:
            for i in range(len(batch)):
                r, out = batch.slice(i, 1).to_pylist()[0], []
                if walk is None or walk.conv != r["conv"]:
                    if walk is not None:
                        turns: list = []
                        row = walk.end(turns)
                        out += listed(walk, turns) if edits else [row]
                    walk = Walk(r["conv"])
                walk.count(_Counted(r))
                turns = [] if edits else None
                walk.read(r["rows"], tuple(r["after"]), turns)
                if edits:
                    out += listed(walk, turns)
                if out:
                    yield _batches(out, kind)
        if walk is not None:
            turns = []
            row = walk.end(turns)
            yield _batches(listed(walk, turns) if edits else [row], kind)

    return run


def _sorted_rows(rows: DataFrame, copies: Column | None) -> DataFrame:
    """Distinct rows in order, with their number, faults and whether an earlier row has the same role and text."""
    base = rows.select("conv", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), (F.lit(1) if copies is None else copies).cast("long").alias("n"))
    named = F.concat(F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.lit(":"), F.length("role"), F.lit(":"), "role", "text")
    base = base.withColumn("content", F.unhex(F.sha2(named, 256)))
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    repeated = base.where("n > 0").groupBy("content").agg(F.min(at).alias("first_at"), F.max(at).alias("last_at")).where("first_at < last_at").select("content", "first_at")
    distinct = base.groupBy("conv", "turn", "role", "text", "content").agg(F.sum("n").alias("n"))
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    flags = {"blank": F.length(body) == 0, "cut": (F.length(body) > 0) & ~F.right(body, F.lit(1)).isin(".", "!", "?"), "seen": F.coalesce(at > F.col("first_at"), F.lit(False))}
    marked = distinct.join(repeated, "content", "left").withColumns(flags).select("conv", "turn", "role", "text", "n", *flags)
    return marked.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv", "turn", "role", "text")


def _pieces(rows: DataFrame, copies: Column | None, direct: bool) -> tuple[DataFrame, str]:
    id_type = rows.schema["conv"].dataType.simpleString()
    ddl = _schema(id_type, *_report_fields(), *_piece_fields())
    return scratch.written(_sorted_rows(rows, copies).mapInArrow(_cut(_arrow(ddl), direct), ddl), "repair-pieces"), id_type


def _joined(pieces: DataFrame, id_type: str) -> DataFrame:
    """Pieces in order, each with the costs that remain after it."""
    ddl = "part int, seq bigint, after array<bigint>"
    last_first = pieces.select("conv", "part", "seq", "m").repartition("conv").sortWithinPartitions(F.col("conv"), F.desc("part"), F.desc("seq"))
    after = last_first.mapInArrow(_remaining(_arrow(ddl)), ddl)
    return pieces.drop("m").join(after, ["part", "seq"]).repartition("conv").sortWithinPartitions("conv", "part", "seq")


def _named(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, copies: Column | None) -> tuple[DataFrame, Column | None]:
    picked = rows.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), *([] if copies is None else [copies.alias("copies")]))
    return picked, None if copies is None else F.col("copies")


def repair_conversations(rows: DataFrame, copies: Column | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``id_col``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``,
    ``repaired_sha256``.

    Rows are taken by turn, nulls first; rows of one turn by role and text, repeated rows one after the other. Null roles and texts are
    one space. A row's first fault counts: blank (nothing but white space), duplicate (role and text seen earlier in the conversation),
    truncated (does not end in ``.``, ``!`` or ``?``). ``gaps``: turns missing between the least and the largest, nulls ignored.
    ``illegal``: adjacent rows whose roles' initials are not su, ua or au. ``audit``: the cheapest edits (Keep, Rerole, Delete, Insert)
    that leave initials ``(s?(ua)+)?``, of equal ones the least in ASCII; a role without an initial is never kept. The digest is of the
    repaired ``role:text`` lines. Identifiers may be null, which is one conversation. ``copies``: how many times a row counts; 0 only
    names its conversation, and one without rows has zeros, an empty audit and the digest of nothing. Very long texts are carried whole.
    Other columns are not read. An empty table gives an empty one.
    """
    rows, copies = _named(rows, id_col, turn_col, role_col, text_col, copies)
    parts, id_type = _pieces(rows, copies, True)
    ddl = _schema(id_type, *_report_fields())
    whole = parts.where("part is null").select("conv", *REPORT)
    rest = _joined(parts.where("part is not null").select("conv", *[f.split()[0] for f in _piece_fields()]), id_type).mapInArrow(_read(_arrow(ddl), False), ddl)
    return whole.unionByName(rest).withColumnRenamed("conv", id_col)


def repaired_turns(rows: DataFrame, copies: Column | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The edits themselves: ``id_col``, ``nth`` (from 0), ``edit`` (K, R, D or I), ``role`` and ``text`` after the edit. Rows without D,
    by ``nth``, are the repaired conversation. Odd rows are taken as by :func:`repair_conversations`."""
    rows, copies = _named(rows, id_col, turn_col, role_col, text_col, copies)
    parts, id_type = _pieces(rows, copies, False)
    ddl = _schema(id_type, "nth bigint", "edit string", "role string", "text string")
    pieces = parts.select("conv", *[f.split()[0] for f in _piece_fields()])
    return _joined(pieces, id_type).mapInArrow(_read(_arrow(ddl), True), ddl).withColumnRenamed("conv", id_col)


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations with faults, by the hash of ``conv_id:turn``: rows dropped, emptied, without their stops, repeated or given to the
    user. Rows, and how many times each counts."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    code = F.crc32(key.cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(code == 0, 0).when(code == 3, 2).otherwise(1)
    out = rows.select("conv_id", "turn", F.when(code == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))
    return out, F.col("copies")
