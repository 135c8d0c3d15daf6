import hashlib
import random
import zlib

import pytest

from bazaarspark.llm.periodic_runs import automaton_runs, periodic_runs, run_digests, stretches, word_runs
from bazaarspark.llm.queries import repeated_tail

DIGESTS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def all_runs(w, least=24, times=3):
    """By comparing each word with the one q before it, for every q."""
    found = set()
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, times * q) and not any(w[i : i + n - r] == w[i + r : i + n] for r in range(1, q)):
                found.add((i, n, q))
            i = max(j, i + 1)
    return sorted(found)


def sample(rng):
    n, letters = rng.randint(0, 140), rng.choice([1, 2, 3, 5, 40])
    w = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n > 1 else 0):
        s = rng.randrange(n)
        p, e = rng.randint(1, max(1, (n - s) // 3)), rng.randint(s, n)
        for i in range(s, e):
            w[i] = w[s + (i - s) % p]
    return w


@pytest.mark.parametrize("least,times", [(24, 3), (6, 3), (12, 4)])
def test_automaton_against_comparing_all_periods(least, times):
    rng = random.Random(least)
    for _ in range(400):
        w = sample(rng)
        want = all_runs(w, least, times)
        assert automaton_runs(w, least, times) == want
        assert word_runs([str(x).encode() for x in w], least, times) == want


def test_stretches_hold_every_run():
    import numpy as np

    rng = random.Random(5)
    for _ in range(300):
        w = sample(rng)
        spans = stretches(np.array(w, np.uint64))
        assert all(any(a <= s and s + n <= b for a, b in spans) for s, n, _ in all_runs(w))


def digest_row(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and words:
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = all_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    more = (best[0], best[1], best[2], best[1] * 1000 // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *more, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(kept)))


def test_digests_against_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{x}" for x in sample(rng)) for _ in range(60)]
    docs = list(enumerate(texts)) + [(100, None), (101, ""), (102, " \n\t"), (103, "é a " * 30), (104, "a  b\n" * 24), (104, "a  b\n" * 24), (105, "x " * 24), (106, "x " * 23), (9, texts[9])]
    frame = spark.createDataFrame([(i, t, 1, "z", 0) for i, t in docs], "doc_id long, text string, runs int, collapsed string, best int")
    got = run_digests(periodic_runs(frame, prepare=repeated_tail))
    assert got.columns == DIGESTS
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(digest_row(i, t)) for i, t in docs)


def test_texts_and_spans(spark):
    text = "one two " + "a b c " * 9 + "end"
    row = periodic_runs(spark.createDataFrame([(None, text)], "doc_id long, text string")).first()
    assert row["n_words"] == 30 and [tuple(r) for r in row["runs"]] == [(2, 27, 3)] and row["collapsed"] == "one two a b c end"


def test_very_long_text(spark):
    text = "\n".join(["the same line again"] * 30_000) + " tail " + " ".join(map(str, range(20_000)))
    row = periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 120_000, 4)]


def test_empty_table(spark):
    assert run_digests(periodic_runs(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_query_against_brute_force(spark):
    import __spark_entry__

    rows = __spark_entry__.queries()["op13_periodic_runs"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    short = {r["doc_id"]: r["text"] for r in docs if len((r["text"] or "").split()) < 400}
    assert len(rows) == len(docs)
    assert {tuple(r) for r in rows if r["doc_id"] in short} == {digest_row(i, t) for i, t in short.items()}
