"""Bounded top-k and set-similarity joins: equal to all pairs, with far fewer of them."""

import random

import pytest
from pyspark.sql import functions as F

from bazaarspark.operators import alignment as A
from bazaarspark.operators import bounded_bm25 as B
from bazaarspark.operators import retrieval as R


def corpus(rng, n, words):
    """Texts whose words fall off steeply: the first words are in almost all of them."""
    return [" ".join(f"w{min(int(rng.paretovariate(0.7)), words)}" for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("k", [1, 5, 40])
def test_bm25_topk_is_the_first_of_all_pairs(spark, k, monkeypatch):
    rng = random.Random(k)
    docs = spark.createDataFrame(list(enumerate(corpus(rng, 900, 400))) + [(9_000, None), (9_001, "w1 w1 w1")], "doc_id long, text string")
    texts = corpus(rng, 40, 400) + ["w1", "w1 w1 w2", "", None, "unknown", "w399 w1"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    want = R.top_n(R.bm25(queries, docs), ["query_id"], [F.desc("score"), F.asc("doc_id")], k).select("query_id", "doc_id", "score", "rank")
    assert sorted(map(tuple, R.bm25_topk(queries, docs, k).collect())) == sorted(map(tuple, want.collect()))


def test_bm25_topk_reads_few_pairs(spark, monkeypatch):
    rng = random.Random(7)
    docs = spark.createDataFrame(list(enumerate(corpus(rng, 4_000, 3_000))), "doc_id long, text string")
    queries = spark.createDataFrame([(i, f"w1 w2 w3 w{rng.randint(20, 60)} w{rng.randint(60, 200)}") for i in range(30)], "query_id long, text string")
    pairs, plain = [], B._partial

    def counting(asked, post):
        out = plain(asked, post)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(B, "_partial", counting)
    assert R.bm25_topk(queries, docs, 10).count() == 300
    assert sum(pairs) < R.bm25(queries, docs).count() / 5


def all_pairs(old, new, threshold):
    """By comparing each pair of a page."""
    import re

    norm = lambda t: re.sub(r"\s+", " ", (t or "").replace("‌", " ")).strip()
    words = lambda t: set(re.findall("[0-9a-z؀-ۿ]+", t.lower()))
    out = []
    for page, i, a in old:
        a, there = norm(a), [(j, norm(b)) for p, j, b in new if p == page]
        same = [(page, i, j, 1.0) for j, b in there if a == b]
        scored = []
        for j, b in there:
            both = words(a) | words(b)
            score = len(words(a) & words(b)) / len(both) if both else 0.0
            scored.append((round(max(score, 0.99 if a and b and (a in b or b in a) else 0.0), 6), j))
        out += same or [(page, i, j, s) for s, j in [max(scored, default=(0, 0))] if s >= threshold]
    return sorted(out)


def chunks(rng, n, spoil):
    rows = []
    for i in range(n):
        t = " ".join(rng.choice(["a", "of", "the", *[f"t{k}" for k in range(60)]]) for _ in range(rng.randint(0, 9)))
        rows.append((rng.randrange(4), i, rng.choice([t, t + "‌x", "  " + t.upper(), t[3:], None]) if spoil else t))
    return rows


@pytest.mark.parametrize("threshold,few", [(0.45, 0), (0.8, 0), (1.0, 0), (0.45, 3_000), (0.45, 1 << 14)])
def test_alignment_equals_all_pairs(spark, monkeypatch, threshold, few):
    monkeypatch.setattr(A, "FEW", few)
    rng = random.Random(4)
    old = chunks(rng, 150, False)
    new = [(p, i + 1_000, rng.choice([t, t[2:], t[:-1], t + " more", t.replace("t1", "u1"), "the", ""])) for p, i, t in old] + chunks(rng, 60, True) + [(9, 5_000, "alone"), (0, 5_001, "a")]
    frame = lambda rows: spark.createDataFrame(rows, "page long, chunk_id long, content string")
    assert sorted(map(tuple, R.align_chunks(frame(old), frame(new), threshold).collect())) == all_pairs(old, new, threshold)


def test_alignment_scores_few_pairs(spark):
    """On one page of frequent words, pairs grow with the number of chunks and not with its square."""
    rng = random.Random(6)
    rows = [(0, i, " ".join(["the", "of", "a", *[f"r{rng.randrange(4_000)}" for _ in range(12)]])) for i in range(1_500)]
    texts = lambda name: spark.createDataFrame([(p, i, t) for p, i, t in rows], f"page long, {name} long, text string")
    n = A.candidate_pairs(texts("old"), texts("new").withColumn("text", F.concat(F.lit("now "), "text")), 0.45).count()
    assert 1_500 <= n < 1_500 * 1_500 / 20


def test_no_chunks(spark):
    none = spark.createDataFrame([], "page long, chunk_id long, content string")
    some = spark.createDataFrame([(1, 1, "x")], none.schema)
    assert R.align_chunks(none, some).count() == R.align_chunks(some, none).count() == 0
    assert R.bm25_topk(spark.createDataFrame([], "query_id long, text string"), spark.createDataFrame([(1, "x")], "doc_id long, text string")).count() == 0
