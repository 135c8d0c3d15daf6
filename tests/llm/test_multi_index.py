import math

import duckdb
import numpy as np
import pytest

from bazaarspark.llm.multi_index import fit, layout, nearest, reached

SCHEMA = "vec_id long, embedding array<float>"


def exact(rows, k=20):
    """All pairs of usable rows; a query's own row by its place."""
    usable = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for at, (i, q) in enumerate(usable):
        if i % 20 == 0:
            near = sorted((-float(np.cumsum(q * v)[-1]), j) for b, (j, v) in enumerate(usable) if b != at and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near[:k])]
    return sorted(out)


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(90)]
    rows += [(90 + i, rows[i % 3][1]) for i in range(60)]  # equal vectors, ties to the smaller identifier
    rows += [(40, rows[40][1]), (40, rows[7][1]), (None, rows[1][1]), (200, None), (201, []), (220, [0.0] * 8), (221, [1.0] * 7 + [None]), (240, [float("nan")] * 8), (241, [float("inf")] * 8)]
    rows += [(260, [1.0, 2.0]), (261, [3.0, 4.0]), (280, [-0.0, 1.0]), (300, [5.0])]
    frame = spark.createDataFrame([(*r, 7, 1.0, "x") for r in rows], SCHEMA + ", rank int, score double, id string")
    got = nearest(frame)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == exact(rows)
    some = nearest(spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>"), k=3)
    assert sorted(map(tuple, some.collect())) == exact(rows, 3)


def test_empty_table(spark):
    assert nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert nearest(spark.createDataFrame([(20, None)], SCHEMA)).count() == 0
    assert nearest(spark.createDataFrame([(20, [1.0])], SCHEMA)).count() == 0


@pytest.mark.parametrize("kind", ["even", "clusters", "one cluster of a third"])
def test_recall_and_work(spark, kind):
    rng = np.random.default_rng(4)
    n = 12_000
    x = rng.standard_normal((n, 32))
    if kind != "even":
        centre = 3 * rng.standard_normal((60, 32))
        x = 0.6 * x + centre[np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, 60, n)) if kind != "clusters" else rng.integers(0, 60, n)]
    x = x.astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    got = {}
    for r in nearest(frame).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    asked = np.arange(0, n, 20)
    scores = x[asked].astype(float) @ x.astype(float).T
    scores[np.arange(len(asked)), asked] = -np.inf
    true = np.argsort(-scores, 1)[:, :20]
    recall = np.mean([len(set(got[int(q)]) & set(t.tolist())) / 20 for q, t in zip(asked, true)])
    assert len(got) == len(asked) and all(len(v) == 20 for v in got.values())
    assert recall >= 0.95, recall
    books = fit(x.astype(float), n)
    counts = np.bincount(books.cells(x.astype(float)), minlength=len(books.left) * len(books.right))
    read = np.mean([counts[reached(x[q].astype(float), books, counts, 21, 0.98, 1_024)].sum() for q in asked[:50]])
    assert read < {"even": 0.9, "clusters": 0.5}.get(kind, 0.6) * n, read


def test_cells_come_by_falling_score_and_once():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3_000, 16))
    books = fit(x, len(x))
    counts = np.bincount(books.cells(x), minlength=len(books.left) * len(books.right))
    for q in x[:20]:
        cells = reached(q, books, counts, 20, 1.0, len(x))
        a, b = (h[0] for h in books.halves(q[None]))
        score = ((books.left @ a)[:, None] + (books.right @ b)[None]).ravel()[cells]
        assert len(set(cells)) == len(cells) and (np.diff(score) <= 1e-12).all() and (counts[cells] > 0).all()
        assert set(cells) == set(np.flatnonzero(counts).tolist())


def test_layout_covers_every_cell():
    counts = np.array([0, 5, 3, 40, 0, 9, 1, 1, 12])
    first, parts = layout(counts, 10)
    held = {}
    for cell in np.flatnonzero(counts):
        for g in range(first[cell], first[cell] + parts[cell]):
            held.setdefault(g, []).append(int(cell))
    assert parts[3] == 4 and all(cells == [3] for g, cells in held.items() if first[3] <= g < first[3] + 4)
    assert all(counts[cells].sum() <= 10 for g, cells in held.items() if cells not in ([3], [8]))
    assert sorted(held) == list(range(len(held)))


def test_query_against_sql(spark):
    import __spark_entry__

    con = duckdb.connect()
    con.sql("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    want = sorted(con.sql(__spark_entry__.oracle_sql()["op12_inverted_multi_index"]).fetchall())
    got = __spark_entry__.queries()["op12_inverted_multi_index"](spark, "/root/testdata/sf0.01")
    assert sorted(map(tuple, got.collect())) == want
