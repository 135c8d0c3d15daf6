"""Deduplication against brute force, with nulls, empties, ties, repeats, hot groups and clashing columns."""

import hashlib
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarspark.llm.components import connected_components
from bazaarspark.llm.exact_dedup import exact_dedup
from bazaarspark.llm.lattice import decode_e8, embedding_dedup, neighbours
from bazaarspark.llm.line_dedup import line_dedup
from bazaarspark.llm.minhash import near_dedup
from bazaarspark.llm.shingles import shingle_set
from bazaarspark.llm.span_dedup import _sentence, runs, span_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, rank int, removed int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "k", 1, 7) for i, t in rows], SCHEMA)


def sentence(rng, n):
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n)) + "."


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    parent = {x: x for e in edges for x in e if None not in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    linked = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: min(y for y in parent if find(y) == find(x)) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact(spark):
    rows = [(i, "Hot Text") for i in range(60)] + [(100, "hot text"), (101, None), (102, ""), (103, "É"), (104, "é"), (105, "x" * 300_000), (105, "x" * 300_000), (None, "alone"), (None, "alone"), (None, "hot TEXT")]
    df = frame(spark, rows).repartition(20)
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    want = []
    for i, t in rows:
        ids = [j for j, u in rows if low(u) == low(t)]
        best = max((j for j in ids if j is not None), default=None)
        want.append((i, best, len(ids), i == best, hashlib.sha256(low(t).encode()).hexdigest()))
    assert sorted(map(tuple, exact_dedup(df).collect()), key=repr) == sorted(want, key=repr)
    assert {r["keep_id"] for r in exact_dedup(df, keep="smallest").where("text_sha256 = sha2('hot text', 256)").collect()} == {0}
    assert exact_dedup(df.limit(0)).count() == 0


def near_rows():
    rng, rows = random.Random(3), []
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    for i in range(150):  # copies of copies on both sides of the threshold
        ws = list(base)
        for _ in range(rng.randrange(5)):
            ws[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(ws)))
    rows += [(1000 + i, sentence(rng, rng.randrange(5, 60))) for i in range(60)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "a b c"), (2004, "A B  C"), (2005, "a b"), (2006, "é x y z w"), (2007, "É x y z w"), (1005, rows[155][1]), (None, rows[0][1]), (None, None)]
    return rows + [(2008, " ".join(f"l{i}" for i in range(30_000)))]


def test_near(spark):
    rows = near_rows()

    def shingles(t):
        ws = (t or "").encode().lower().split()
        return {tuple(ws[i : i + 5]) for i in range(max(len(ws) - 4, 1))} if ws else set()

    sets = [shingles(t) for _, t in rows]
    n, parent = len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                    parent[find(i)] = find(j)
    want = []
    for i, (d, _) in enumerate(rows):
        c = min(rows[j][0] for j in range(n) if find(j) == find(i)) if d is not None else None
        want.append((d, len(sets[i]), c, d == c))
    got = sorted(map(tuple, near_dedup(frame(spark, rows).repartition(5), percent=85).collect()), key=repr)
    assert got == sorted(want, key=repr)
    assert near_dedup(frame(spark, [])).count() == 0


def line_brute(rows, min_words):
    docs = sorted(((d is None, d or 0), t.split("\n")) for d, t in rows if t is not None)
    first, out = {}, {}
    for d, lines in docs:
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[i:j]) >= min_words:
                    run = tuple(lines[i:j])
                    if first.setdefault(run, (d, i)) != (d, i):
                        out.setdefault(d, set()).update(range(i, j))
    return out


def test_lines(spark):
    rng = random.Random(5)
    pool = ["one two three", "a b", "c", "", "long line with many words here", "x y z w v u"]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, rows[0][1]), (103, "\n".join(f"row {i} of a long one" for i in range(300))), (104, "\n".join(f"row {i} of a long one" for i in range(300))), (None, "x y z w v u\nq")]
    gone = line_brute(rows, 5)
    got = line_dedup(frame(spark, rows)).collect()
    assert set(got[0].asDict()) == {*"doc_id text lang source n_chars key rank".split(), "n_lines", "n_removed", "removed"}
    for r in got:
        d, t = next((d, t) for d, t in rows if d == r["doc_id"])
        cut = gone.get((d is None, d or 0), set())
        assert r["removed"] == sorted(cut), d
        assert r["text"] == (t if not cut else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in cut))
    assert len(got) == len(rows) and line_dedup(frame(spark, [])).count() == 0


def test_repeated_rows_keep_their_lines(spark):
    got = line_dedup(frame(spark, [(1, "a b c d e\nf"), (1, "a b c d e\nf"), (2, "a b c d e\ng")])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, "a b c d e\nf"), (1, "a b c d e\nf"), (2, "g")]


def test_lines_of_blank_texts_and_of_one_identifier(spark):
    blank = "\n" * 30_000
    rows = [(1, f"one two three four five{blank}"), (2, f"one two three four five{blank}"), (3, blank), (3, "a b c d e\nmine"), (3, "a b c d e\nyours"), (None, "a b c d e")]
    got = {(r["doc_id"], r["n_lines"]): (r["n_removed"], r["text"]) for r in line_dedup(frame(spark, rows)).collect() if r["doc_id"] != 3}
    assert got == {(1, 30_001): (0, rows[0][1]), (2, 30_001): (30_001, ""), (None, 1): (1, "")}
    three = [r["text"] for r in line_dedup(frame(spark, rows)).where("doc_id = 3").collect()]
    assert blank in three and sorted(len(t) for t in three if t != blank) in ([4, 15], [5, 14])


def test_spans(spark):
    rng = random.Random(7)
    passages = [" ".join(sentence(rng, rng.randrange(1, 9)) for _ in range(5)) for _ in range(6)]
    rows = [(i, " ".join(rng.choice(passages) if rng.random() < 0.4 else sentence(rng, rng.randrange(1, 12)) for _ in range(rng.randrange(1, 6)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "no mark at all"), (203, rows[0][1]), (None, rows[1][1]), (204, "Long. " * 20_000)]
    first = {}
    for d, t in sorted((x for x in rows if x[1]), key=lambda x: (x[0] is None, x[0] or 0)):
        for h in runs(t, 2, 12)[2]:
            first.setdefault(h, d)
    for r in span_dedup(frame(spark, rows)).collect():
        t = next(t for d, t in rows if d == r["doc_id"])
        seen, cut = set(), set()
        for pos, n, h in zip(*runs(t or "", 2, 12)):
            if h in seen or first[h] != r["doc_id"]:
                cut.update(range(pos, pos + n))
            seen.add(h)
        parts = _sentence.findall(t or "")
        assert r["removed"] == sorted(cut) and r["n_sentences"] == len(parts)
        assert r["text"] == (t if not cut else "".join(p for i, p in enumerate(parts) if i not in cut))
    assert span_dedup(frame(spark, [])).count() == 0


def span_brute(rows, span, min_words):
    """All runs of sentences that start and end with words, found by taking texts apart letter by letter."""
    def sentences(text):
        out, now, ended = [], "", False
        for ch in text:
            if ended and ch not in ".!? \t\n\x0b\x0c\r":
                out.append(now)
                now, ended = "", False
            now += ch
            ended = ended or ch in ".!?\n"
        return out + [now] if now else out

    first, gone = {}, {}
    for d, text in sorted(((d is None, d or 0), t) for d, t in rows if t):
        parts = [tuple(w.lower() for w in p.split()) for p in sentences(text)]
        for i in range(len(parts)):
            for j in range(i + 1, min(len(parts), i + 30) + 1):
                words = sum(map(len, parts[i:j]))
                if parts[i] and parts[j - 1] and ((j - i >= span and words >= min_words) or (j - i == 1 and words >= 50)):
                    if first.setdefault(tuple(parts[i:j]), (d, i)) != (d, i):
                        gone.setdefault(d, set()).update(range(i, j))
    return gone


def test_spans_against_all_runs(spark):
    rng = random.Random(11)
    passages = [" ".join(sentence(rng, rng.randrange(1, 9)) for _ in range(rng.randrange(2, 7))) for _ in range(8)] + [" ".join(f"L{i}" for i in range(60)) + "!"]
    rows = [(i, "\n".join(rng.choice(passages) if rng.random() < 0.5 else sentence(rng, rng.randrange(1, 12)) for _ in range(rng.randrange(1, 7)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\nA b. . ? c"), (None, rows[3][1])]
    gone = span_brute(rows, 2, 12)
    assert any(gone.values())
    for r in span_dedup(frame(spark, rows)).collect():
        assert r["removed"] == sorted(gone.get((r["doc_id"] is None, r["doc_id"] or 0), ())), r["doc_id"]


def test_spans_cover_the_end_of_a_passage_and_long_sentences(spark):
    passage = "One two three four five six seven eight. Nine ten eleven twelve thirteen fourteen. A short end."
    long = " ".join(f"w{i}" for i in range(55)) + "."
    rows = [(1, f"{passage} Only here. {long} Tail of one."), (2, f"Another start of words. {passage} Different words follow in this text. {long} Tail of two.")]
    got = {r["doc_id"]: r["text"] for r in span_dedup(frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "Another start of words. Different words follow in this text. Tail of two."}


def test_e8():
    v = neighbours()
    assert len(v) == 240 and (np.sum(v * v, 1) == 8).all() and len({tuple(x) for x in v}) == 240
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8)) * 3
    near = decode_e8(x)
    closer = ((near[:, None] + v[None]) / 2 - x[:, None]) ** 2
    assert (closer.sum(-1) >= ((near / 2 - x) ** 2).sum(-1)[:, None] - 1e-9).all()


@pytest.mark.parametrize("dim", [64, 3])
def test_embeddings(spark, dim):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, dim))
    rows = []
    for b in base:
        for _ in range(25):
            z = rng.standard_normal(dim)
            rows.append((len(rows), (b + rng.uniform(0, 0.6) * np.linalg.norm(b) / np.sqrt(dim) * z).tolist()))
    rows += [(5000 + i, rows[0][1]) for i in range(300)]  # one hot vector
    bad = [None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1)]
    odd = [(9000 + i, v) for i, v in enumerate(bad)] + [(9100, [1.0, 2.0]), (9101, [2.0, 4.0]), (None, rows[0][1]), (9102, [1e-300 * x for x in rows[0][1]])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")).collect()}
    good = rows + [odd[-1]]
    x = np.array([v for _, v in good])
    x = x / np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    comp = np.arange(len(good))
    for _ in range(len(good)):
        new = np.minimum(comp, np.where(link, comp[None], len(good)).min(1))
        if (new == comp).all():
            break
        comp = new
    for k, (i, _) in enumerate(good):
        c = good[comp[k]][0]
        assert got[i] == (int(link[k].sum()), c, c == i), i
    assert all(got[9000 + i] == (0, 9000 + i, True) for i in range(6))
    assert got[9100] == (1, 9100, True) and got[9101] == (1, 9100, False) and got[None] == (0, None, True)
    assert embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_embeddings_with_clashing_columns(spark):
    rows = [(1, [1.0, 0.0, 0.0], 7, "a", 1), (2, [1.0, 0.01, 0.0], 7, "b", 2), (3, [0.0, 1.0, 0.0], 7, "c", 3), (3, [0.0, 1.0, 0.0], 7, "c", 3)]
    frame_ = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int, cell string, links int").withColumnRenamed("cell", "component")
    assert sorted(map(tuple, embedding_dedup(frame_).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (3, 1, 3, True)]


def test_shingles_leave_no_words_in_a_worker():
    shingle_set("one two three four five six")
    tracemalloc.start()
    try:
        for i in range(100):
            assert len(shingle_set(" ".join(f"w{i}x{j}" for j in range(1_000)))) == 996
        assert tracemalloc.get_traced_memory()[0] < 1_000_000
    finally:
        tracemalloc.stop()
