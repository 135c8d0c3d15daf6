import functools
import hashlib
import random
import re
import sys
import zlib

import pytest

from bazaarspark.llm import repair
from bazaarspark.llm.repair import damaged, repair_conversations, repaired_turns

sys.setrecursionlimit(20_000)
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def word(c):
    return c not in " \t\n\x0b\x0c\r"


def repaired(conv, rows):
    """rows: (turn, role, text) in order. Every edit of every row from every state is tried, row by row."""
    seen, faults, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        body = [c for c in text if word(c)]
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        if fault:
            counts[fault] += 1
    accepts = lambda s: s == "" or s[-1] == "a"

    def step(s, initial):
        if initial == "s":
            return "s" if s == "" else None
        if initial == "u":
            return "u" if s in ("", "s", "a") else None
        return "a" if initial == "a" and s == "u" else None

    @functools.cache
    def best(i, s, inserted):
        found = [(0, "", ())] if i == len(rows) and accepts(s) else []
        for role in ("user", "assistant"):
            t = step(s, role[0])
            if t is not None and inserted < 4:
                c, e, lines = best(i, t, inserted + 1)
                found.append((c + 5, "I" + e, ((role, ""), *lines)))
        if i < len(rows):
            _, role, text = rows[i]
            c, e, lines = best(i + 1, s, 0)
            found.append((c + 2, "D" + e, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                for cost, edit, to in ((0, "K", role), (1, "R", "user"), (1, "R", "assistant")):
                    t = step(s, to[:1]) if to else None
                    if t is not None:
                        c, e, lines = best(i + 1, t, 0)
                        found.append((c + cost + more, edit + e, ((to, text), *lines)))
        return min(found, default=(10**9, "", ()))

    cost, audit, lines = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())


def plain(rows):
    """(conv, turn, role, text) to conversations in order."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv in by:
        by[conv].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return by


def with_faults(rows):
    out, convs = [], set()
    for conv, turn, role, text in rows:
        convs.add(conv)
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else re.sub(r"[.!?]", "", text or "") if code == 2 else text
        role = "user" if code == 4 else role
        out += [(conv, turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return convs, out


def chat(rng, conv, n):
    texts = ["Yes.", "yes", "", " \n", "What?", "A longer text.", "end!", "no stop ", None, "x. \t"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    return [(conv, rng.choice([i, i, i, rng.randrange(9), None]), rng.choice(roles), rng.choice(texts + [f"t{i}." for i in range(8)])) for i in range(n)]


SCHEMA = "conv_id long, turn long, role string, text string"


def rows_of(frame):
    assert frame.columns == COLUMNS
    return sorted(map(repr, map(tuple, frame.collect())))


@pytest.mark.parametrize("piece", [4_096, 1, 3])
def test_against_trying_all_edits(spark, monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE_ROWS", piece)
    rng = random.Random(piece)
    rows = [r for c in [*range(60), None] for r in chat(rng, c, rng.randint(1, 14))]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(repair_conversations(frame)) == sorted(repr(repaired(c, r)) for c, r in plain(rows).items())
    convs, left = with_faults(rows)
    by = plain(left)
    assert rows_of(repair_conversations(*damaged(frame))) == sorted(repr(repaired(c, by.get(c, []))) for c in convs)


def test_one_conversation_over_many_partitions_and_pieces(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(1, i, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Yes.", "no", "", f"t{i}."])) for i in range(300)] + chat(rng, 0, 5) + chat(rng, 2, 5)
    monkeypatch.setattr(repair, "PIECE_ROWS", 7)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = sorted(repr(repaired(c, r)) for c, r in plain(rows).items())
    assert rows_of(repair_conversations(frame)) == want
    turns = sorted(map(tuple, repaired_turns(frame).where("conv_id = 1").collect()), key=lambda r: r[1])
    assert [r[1] for r in turns] == list(range(len(turns)))
    digest = hashlib.sha256("\n".join(f"{r[3]}:{r[4]}" for r in turns if r[2] != "D").encode()).hexdigest()
    assert any(digest in w and "".join(r[2] for r in turns) in w for w in want)


def test_powers_equal_single_steps():
    rng = random.Random(2)
    for _ in range(200):
        runs = [(rng.randrange(12), rng.randint(1, 40)) for _ in range(rng.randint(1, 4))]
        v = repair.START_VECTOR
        for sym, n in reversed(runs):
            for _ in range(n):
                v = repair._times(repair.power(sym, 0), v)
        assert repair._times(repair.matrix_of(runs), repair.START_VECTOR) == v


def test_many_copies_and_long_texts(spark):
    rows = [(1, 0, "user", "What? " * 300_000)] + [(1, 1, "assistant", "Yes.")] * 5_000 + [(1, None, "tool", "x.")] * 2_000
    got = repair_conversations(spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA + ", n int, blank int")).collect()
    assert [tuple(r) for r in got] == [tuple(repaired_plainly(rows))]


def repaired_plainly(rows):
    """The first conversation's answer by hand: of equal rows all but the first go."""
    audit = "D" * 2_000 + "KK" + "D" * 4_999
    text = "user:" + "What? " * 300_000 + "\nassistant:Yes."
    return 1, 0, 0, 1_999 + 4_999, 0, 1_999 + 1 + 4_999, 2 * 2_000 + 2 * 4_999, audit, hashlib.sha256(text.encode()).hexdigest()


def test_empty_table_and_dropped_conversations(spark):
    assert repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    dropped = next(t for t in range(999) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    rows, copies = damaged(spark.createDataFrame([(5, dropped, "user", "a.")], SCHEMA))
    assert [tuple(r) for r in repair_conversations(rows, copies).collect()] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_query_against_trying_all_edits(spark):
    import __spark_entry__

    got = __spark_entry__.queries()["op11_repair_conversations"](spark, "/root/testdata/sf0.01")
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    convs, left = with_faults(rows)
    by = plain(left)
    assert rows_of(got) == sorted(repr(repaired(c, by.get(c, []))) for c in convs)


def test_query_against_sql(spark):
    import duckdb

    import __spark_entry__

    con = duckdb.connect()
    con.sql("create view conversations as select * from '/root/testdata/sf0.1/conversations.parquet' where conv_id < 300")
    want = con.sql(__spark_entry__.oracle_sql()["op11_repair_conversations"])
    rows = [dict(zip(want.columns, r)) for r in want.fetchall()]
    frame = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet").where("conv_id < 300")
    assert rows_of(repair_conversations(*damaged(frame))) == sorted(repr(tuple(r[c] for c in COLUMNS)) for r in rows)
