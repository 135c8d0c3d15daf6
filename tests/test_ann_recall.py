"""Recall and work of the inverted file against the exact search."""

import numpy as np
import pytest

from bazaarspark.operators import retrieval as R
from bazaarspark.operators import vector_index as V
from bazaarspark.sources.tables import table


def recall(got, want):
    got, want = ({(r["query_id"], r["id"]) for r in x.collect()} for x in (got, want))
    return len(got), len(want), len(got & want) / len(want)


def scored_pairs(monkeypatch):
    counts, plain = [], V._scored

    def counting(pairs, queries, vectors):
        counts.append(pairs.count())
        return plain(pairs, queries, vectors)

    monkeypatch.setattr(V, "_scored", counting)
    return counts


def test_recall_and_pairs_on_all_asked_vectors(spark, monkeypatch):
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings").selectExpr("vec_id AS id", "CAST(embedding AS ARRAY<DOUBLE>) AS v")
    asked = vectors.where("id % 20 = 0")
    counts = scored_pairs(monkeypatch)
    n, exact, found = recall(R.ann_topk(asked, vectors), R.cosine_topk(asked, vectors))
    assert n == exact and found >= 0.9
    assert sum(counts) < asked.count() * vectors.count() / 5


@pytest.mark.parametrize("kind", ["clusters", "one cluster of a third", "equal vectors"])
def test_recall_on_odd_tables(spark, monkeypatch, kind):
    rng = np.random.default_rng(5)
    centres = 3 * rng.standard_normal((40, 16))
    own = rng.integers(0, 40, 6_000)
    if kind != "clusters":
        own[rng.random(6_000) < 1 / 3] = 0
    x = centres[own] + (0.4 * rng.standard_normal((6_000, 16)) if kind != "equal vectors" else 0)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    asked = vectors.where("id % 20 = 0")
    counts = scored_pairs(monkeypatch)
    got, want = R.ann_topk(asked, vectors).collect(), R.cosine_topk(asked, vectors).collect()
    assert len(got) == len(want)
    if kind == "equal vectors":  # which of the equal ones is open
        assert [r["score"] for r in sorted(got, key=lambda r: (r["query_id"], r["rank"]))] == pytest.approx([r["score"] for r in sorted(want, key=lambda r: (r["query_id"], r["rank"]))])
    else:
        assert len({(r["query_id"], r["id"]) for r in got} & {(r["query_id"], r["id"]) for r in want}) >= 0.9 * len(want)
    assert sum(counts) < 300 * 6_000 / 20


def test_lists_that_cannot_reach_the_score_are_left_out():
    rng = np.random.default_rng(2)
    centres = V._unit(rng.standard_normal((30, 8)))
    x = V._unit(np.repeat(centres, 50, 0) + 0.05 * rng.standard_normal((1_500, 8)))
    index = V.fit(x, len(x))
    near = x @ index.centroids.T
    own = near.argmax(1)
    lists = V.Lists(*np.zeros((2, len(index.centroids)), int), np.bincount(own, minlength=len(index.centroids)), np.array([np.arccos(np.clip(near[own == i, i].min(initial=1), -1, 1)) for i in range(len(index.centroids))]))
    for q in range(0, 1_500, 100):
        kth = np.sort(x @ x[q])[-10]
        read = V.reached(near[q], lists, kth, 0)
        assert set(own[x @ x[q] >= kth]) <= set(read.tolist()) and len(read) < len(index.centroids) / 2


def test_empty(spark):
    none = spark.createDataFrame([], "id long, v array<double>")
    some = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>")
    assert R.ann_topk(none, some).count() == R.ann_topk(some, none).count() == R.ann_topk(some, some).count() == 0
