"""Packing, mixing, toxicity, licences and language-model scoring on small tables."""

import math
import pickle
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from bazaarspark.llm import license_scan as L
from bazaarspark.llm import lm_context
from bazaarspark.llm import toxicity as X
from bazaarspark.llm.lm_context import END, UNSEEN, Decisions, Tokens, Tree
from bazaarspark.llm.lm_scoring import DEPTHS, SLOTS, TABLES, Bits, Mixer, _count_words, fit, fit_contexts, lm_score, packed, sizes
from bazaarspark.llm.mixing import mix, mixed_documents
from bazaarspark.llm.packing import CAPACITY, _cost, pack, solve

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length int, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, 3, "k") for i, t, s in rows], SCHEMA)


ROWS = [(i, f"the cat {i} sat on mat number {i % 7} " * (i % 40), ["a", "b", None, "hot", "hot", "hot"][i % 6]) for i in range(120)]
ROWS += [(500, None, "a"), (501, "", None), (502, " \n\t", "b"), (503, "word " * 9000, "hot"), (503, "word " * 9000, "hot"), (None, "no id here", "c"), (504, "x" * 50_000, "d")]


def test_cutting_stock_holds_every_piece():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 3000):
        demand = dict(Counter(rng.integers(1, 63, n).tolist()))
        patterns = solve(demand)
        held = Counter()
        for content, times in patterns:
            assert sum(s * k for s, k in content.items()) <= CAPACITY
            for s, k in content.items():
                held[s] += k * times
        assert held == Counter(demand)
    tokens = sum(s * k for s, k in demand.items())
    assert sum(_cost(sum(s * k for s, k in c.items())) * n for c, n in patterns) <= 1.02 * tokens


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = ROWS + [(601, "<|endoftext|>", "a"), (602, "a  <|endoftext|><|endoftext|>\n b <|endoftext", "a"), (600, "<|endoftext|> é日本語 🙂   tabs\t\tand\n\nlines 12345 can't", "a")]
    got = pack(frame(spark, rows).repartition(3)).collect()
    ids = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t, _ in rows)
    for (doc, tokens), times in ids.items():
        pieces = [r for r in got if r["doc_id"] == doc and r["doc_tokens"] == len(tokens)]
        assert len(pieces) % times == 0
        covered = sorted(set((r["start"], r["length"], r["ids_crc32"]) for r in pieces))
        at = 0
        for start, length, crc in covered:
            assert start == at and crc == zlib.crc32(np.array(tokens[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(tokens)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padded = 0
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= CAPACITY
        padded += _cost(at)
    assert padded <= 1.03 * sum(r["length"] for r in got)
    assert pack(frame(spark, [])).count() == 0


def test_mixing(spark):
    got = mix(frame(spark, ROWS).repartition(5)).collect()
    assert len(got) == len(ROWS)
    size = lambda t: len((t or "").encode().split())
    sizes = Counter()
    for _, t, s in ROWS:
        sizes[s] += size(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3.0 * sizes[s] for s in over)
        free -= over
    target |= share
    taken = Counter()
    source = {(i, size(t)): s for i, t, s in ROWS}
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= max(2, 0.001 * target[s]) for s in order)
    assert sorted(map(tuple, mix(frame(spark, ROWS).repartition(2)).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    cut = Counter()
    for s in order:  # the same dual, solved by halving
        docs = [size(t) for _, t, x in ROWS if x == s]
        scale = max(1.0, sum(docs) / len(docs))
        rates = lambda lam: [min(3.0, math.exp(min(lam * n / scale, 50))) for n in docs]  # noqa: E731, B023
        lo, hi = -1e4, 1e4
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(n * r for n, r in zip(docs, rates(mid))) < target[s] else (lo, mid)
        for r in got:
            if source[r["doc_id"], r["size"]] == s and r["size"]:
                rate = min(3.0, math.exp(min((lo + hi) / 2 * r["size"] / scale, 50)))
                assert math.floor(rate + 1e-6) * r["size"] <= r["taken"] <= math.ceil(rate - 1e-6) * r["size"]
                cut[s] += r["taken"] % r["size"] != 0
    assert all(cut[s] <= 1 for s in order if s != "hot") and cut["hot"] <= 2  # one identifier is repeated there
    copies = mixed_documents(frame(spark, ROWS)).collect()
    blank = sorted((r["doc_id"], r["text"]) for r in copies if size(r["text"]) == 0 and (r["doc_id"] or 0) >= 500)
    assert blank == [(500, None), (501, ""), (502, " \n\t")]
    longest = next(r["text"] for r in copies if r["doc_id"] == 119)
    assert longest and ROWS[119][1].startswith(longest)
    assert sum(size(r["text"]) for r in copies) == sum(taken.values()) and copies[0].asDict().keys() == {c.split()[0] for c in SCHEMA.split(", ")}
    assert mix(frame(spark, [])).count() == 0 and mixed_documents(frame(spark, [])).count() == 0


def test_grammar_reads_clauses():
    g = X.Grammar({w: 2.0 for w in X.INSULTS})
    plain, aimed = g.score("What an idiot that was"), g.score("You are an idiot")
    assert aimed >= plain > g.score("You are not an idiot") and plain > g.score("He said the word idiot was used")
    assert g.score("I will kill you") > g.score("I will kill the process") > 0
    assert g.score(None) == g.score("") == g.score("a calm text. nothing here")
    assert X.compose([X.NEGATION, X.OTHER, X.INSULT]) == [X.NEGATION, X.OTHER, X.INSULT | X.NEGATED]
    assert X.compose([X.REPORT, X.OTHER, X.OTHER, X.OTHER, X.INSULT])[-1] & X.REPORTED
    assert X.compose([X.INSULT, X.OTHER, X.TARGET])[0] & X.AIMED


def plain_patterns(symbols):
    """Patterns of a clause by its words' distances, without transducers."""
    out = []
    for i, s in enumerate(symbols):
        if s not in (X.INSULT, X.THREAT):
            continue
        close = lambda kind, reach, i=i: any(symbols[j] == kind for j in range(max(0, i - reach), i))
        if close(X.NEGATION, 3):
            mark = X.NEGATED
        elif close(X.REPORT, len(symbols)):
            mark = X.REPORTED
        else:
            led = close(X.MODAL, 3) if s == X.THREAT else close(X.COPULA, 3) or close(X.TARGET, 1)
            aimed = close(X.TARGET, 4) or X.TARGET in symbols[i + 1 : i + 5]
            mark = (X.LED if led else 0) | (X.AIMED if aimed else 0)
        out.append(s | mark)
    return out


def test_grammar_against_distances():
    rng = np.random.default_rng(8)
    for _ in range(3_000):
        symbols = rng.choice(8, rng.integers(1, 14), p=[0.4, 0.15, 0.15, 0.08, 0.06, 0.04, 0.06, 0.06]).tolist()
        got = [s & 7 | X._mark(s) for s in X.compose(symbols) if s & 7 in (X.INSULT, X.THREAT)]
        assert got == plain_patterns(symbols), symbols
    assert set(X.PATTERNS) == {k | m for k in (X.INSULT, X.THREAT) for m in X.STRENGTH}
    g = X.Grammar({w: 2.0 for w in X.INSULTS})
    assert g.score("we will hurt them") > g.score("hurt") == g.score("a hurt knee")
    assert g.score("you are such an idiot") > g.score("one idiot more")


PLAIN = """The morning train to work is more pleasant than traffic. The pig ate the corn in the field. Close the path before the class is lost.
This trash is full, so take it out. The clown at the circus made everyone laugh. They will shoot the film in May. Please kill the process and restart it.
Le train du matin est plus agréable que la voiture. Nous allons tuer le temps avant le départ. Der Zug zur Arbeit ist angenehmer als der Verkehr.
Die Klasse schlägt ein neues Buch auf. El tren de la mañana es más agradable que el tráfico. Vamos a golpear la masa con las manos. idiot. Moron. loser"""


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_plain_language_stays_and_weights_follow_the_grammar(spark, sf):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf{sf}/{name}.parquet")
    g = X.fit(read("documents"), read("labels"))
    for line in PLAIN.split("\n"):
        for text in re.findall(r"[^.]+\.?", line):
            assert g.score(text) < 0.3, text
    bare, aimed, led, more, threat, meant = g.weights[1:]
    assert min(bare, aimed, led, more, threat, meant) >= 0
    assert g.score("You are such a worthless idiot.") > 0.3 and g.score("We will kill you.") > 0.3 > g.score("We will kill time.")
    assert g.score("You are not an idiot.") == g.score("A calm text.") == g.score("He said: fine.")
    docs = {r["doc_id"]: r["text"] for r in read("documents").collect()}
    held = [(g.score(docs[r["doc_id"]]) >= 0.3, r["toxic"]) for r in read("labels").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    found, toxic = sum(p and t for p, t in held), sum(t for _, t in held)
    clean, kept = sum(1 - t for _, t in held), sum(not p and not t for p, t in held)
    assert found >= {"0.01": 9, "0.1": 110}[sf] and kept >= 0.99 * clean, (found, toxic, kept, clean)


@pytest.mark.parametrize("learned", [True, False])
def test_tasks_know_the_fixed_words(spark, learned):
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(["th", "an", "er", "in", "ou", "sh"], 3)) for _ in range(200)]
    rows, labels = [], []
    for i in range(900):
        ws = list(rng.choice(words, 40))
        if i % 5 == 0:
            for k, w in zip(rng.choice(40, 2, replace=False), rng.choice(["idiot", "moron", "scum"], 2, replace=False), strict=True):
                ws[int(k)] = w
        rows.append((i, " ".join(ws) + ".", "s"))
        labels.append((i, int(i % 5 == 0)))
    rows.append((1000, "You are such a worthless idiot.", "s"))
    docs, y = frame(spark, rows), spark.createDataFrame(labels if learned else [], "doc_id long, toxic int")
    g = X.fit(docs, y)
    got = {r["doc_id"]: r for r in X.toxicity(docs, y).collect()}
    assert all(got[i]["score"] == pytest.approx(g.score(text)) for i, text, _ in rows) and got[1000]["predicted"] == 1
    if learned:
        assert [i for i, toxic in labels if got[i]["predicted"] != toxic] == []
    assert {r["doc_id"] for r in X.without_toxic(docs, y).collect()} == {i for i, r in got.items() if not r["predicted"]}


def test_stems_are_counted_in_bounded_parts(monkeypatch):
    texts = [f"{chr(97 + i % 26) * 4}{chr(97 + i // 26) * 5}" for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([i % 2 for i in range(300)])], ["text", "toxic"])
    total = lambda: sum((Counter({(r["stem"], x): r[x] for x in ("toxic", "clean")}) for b in X._beginnings(iter([batch])) for r in b.to_pylist()), Counter())
    whole = total()
    monkeypatch.setattr(X, "COUNTED", 100)
    parts = [len(b) for b in X._beginnings(iter([batch]))]
    assert max(parts) < 120 and total() == whole


def test_toxicity(spark):
    words = [f"w{i}" for i in range(300)]
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(600):
        ws = list(rng.choice(words, 40))
        toxic = i % 5 == 0
        if toxic:
            ws[int(rng.integers(40))] = f"blargo{rng.integers(9)}"
        rows.append((i, " ".join(ws) + ".", "s"))
        labels.append((i, int(toxic)))
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, "x " * 40_000, "s"), (None, "text", "s"), (5, rows[5][1], "s")]
    y = spark.createDataFrame(labels + [(None, 1), (1000, None), (7777, 1)], "doc_id long, toxic int")
    got = X.toxicity(frame(spark, rows), y).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 4 == 2) for r in got)
    label = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in label]
    assert len(held) > 50 and sum(r["predicted"] == label[r["doc_id"]] for r in held) >= 0.97 * len(held)
    kept = X.without_toxic(frame(spark, rows), y)
    assert kept.count() == sum(1 - r["predicted"] for r in got) and kept.columns == frame(spark, rows).columns
    assert X.toxicity(frame(spark, []), y).count() == 0
    assert X.toxicity(frame(spark, rows), y.limit(0)).where("predicted = 1").count() == 0


def test_licences(spark):
    assert not [s for s in L.SENTENCES.values() if not re.search(L.ANCHORS, s)]
    mit = " ".join(L.SENTENCES[k] for k in ("mit-grant", "mit-notice", "mit-warranty"))
    rows = [(1, "Intro here.\n" + mit + " End."), (2, "Licensed under CC BY-NC 4.0."), (3, L.SENTENCES["mit-notice"] + " " + L.SENTENCES["mit-grant"]), (4, None), (5, ""), (6, "licence " * 50_000), (2, "Licensed under CC BY-NC 4.0.")]
    got = L.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["n_matched"], r["licenses"]) for r in got] == [(3, ["MIT"]), (1, ["CC-BY-NC-4.0"]), (2, []), (0, []), (0, []), (0, []), (1, ["CC-BY-NC-4.0"])]
    assert L.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    clash = L.license_scan(spark.createDataFrame([(1, "Licensed under CC BY-NC 4.0.", 5, "x", None)], "doc_id long, text string, licenses int, n_matched string, sentences string")).collect()
    assert [(r["doc_id"], r["n_matched"], r["licenses"]) for r in clash] == [(1, 1, ["CC-BY-NC-4.0"])]


def test_wrapped_licences_and_tags(spark):
    wrap = lambda keys, width, sign="": "\n".join(sign + x for x in textwrap.wrap(" ".join((L.SENTENCES | L.MORE_SENTENCES)[k] for k in keys), width))
    apache = "Copyright 2020 Someone\n" + wrap(["apache-header", "apache-use", "apache-copy"], 70) + "\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n" + wrap(["apache-basis", "apache-limits"], 70)
    gpl = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even"
    want = {
        1: (wrap(["mit-grant", "mit-notice", "mit-warranty"], 72, " * "), ["MIT"]),
        2: (apache, ["Apache-2.0"]),
        3: ("\n".join("# " + x for x in apache.split("\n")), ["Apache-2.0"]),
        4: (gpl, ["GPL-2.0-or-later"]),
        5: (wrap(["fsf-library", "fsf-terms-lgpl", "fsf-later-2.1", "fsf-library-warranty"], 60, "// "), ["LGPL-2.1-or-later"]),
        6: (wrap(["gpl-free-1", "agpl-terms", "gpl-warranty-1"], 75), ["AGPL-3.0-or-later"]),
        7: ("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Linux-syscall-note\nint x;", ["Apache-2.0", "GPL-2.0-only", "MIT"]),
        8: ("Title\nLicensed under CC BY 4.0.\nmore lines\nwithout marks", ["CC-BY-4.0"]),
        9: (wrap(["bsd-grant"], 70) + "\n\n" + "\n".join(wrap([k], 70, "  ") for k in ("bsd-source", "bsd-binary", "bsd-endorse")) + "\n\n" + wrap(["bsd-warranty"], 70), ["BSD-3-Clause"]),
    }
    got = L.license_scan(spark.createDataFrame([(i, t) for i, (t, _) in want.items()], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["licenses"] for r in got} == {i: w for i, (_, w) in want.items()}


class Local:
    """Counts of one process."""

    def __init__(self, tables):
        self.tables = tables

    def looked_up(self, bits):
        return [np.stack([c.take(bits.slots(b, t)) for t, c in enumerate(self.tables)]) for b in range(bits.COUNT)]


def test_mixer_is_a_distribution():
    """The probabilities of all first bytes sum to one."""
    counts = np.zeros((TABLES, 2, SLOTS), np.int32)
    mixer = Mixer()
    firsts = [bytes([b]) for b in range(256) if b not in (9, 10, 11, 12, 13, 32)]
    for bit, slots, _ in Bits([b"the", b"cat", b""]):
        for t, s in enumerate(slots):
            counts[t, bit.astype(int), s] += 3
    counts = Local(packed(counts))
    logit = []
    for token in [*firsts, b""]:
        bits = Bits([token])
        bits.data, bits.token, bits.place = bits.data[:1], bits.token[:1], bits.place[:1]
        bits.contexts = [h[:1] for h in bits.contexts]
        logit.append(-mixer.cost(counts, bits, 1)[0])
    missing = []
    for b in (9, 11, 12, 13, 32):
        bits = Bits([bytes([b])])
        bits.data, bits.token, bits.place = bits.data[:1], bits.token[:1], bits.place[:1]
        bits.contexts = [h[:1] for h in bits.contexts]
        missing.append(-mixer.cost(counts, bits, 1)[0])
    assert sum(2.0**x for x in [*logit, *missing]) == pytest.approx(1, abs=1e-6)


def test_predictors_keep_ratios_and_grow(spark):
    counts = np.array([[3, 70, 300, 100_000, 9_000_000], [60, 2, 3_000, 1_000, 4_500_000]])
    got = Mixer().logit.take(packed(counts))
    assert got == pytest.approx(np.log((counts[1] + 0.4) / (counts[0] + 0.4)), abs=0.11)
    for own in (0, 1):  # small counts without the word itself are exact
        less = counts[:, :1] - np.array([[1 - own], [own]])
        at = packed(counts[:, :1]).astype(int) + (own + 1) * 65536
        assert Mixer().logit.take(at)[0] == pytest.approx(np.log((less[1] + 0.4) / (less[0] + 0.4))[0], abs=1e-5)
    assert sizes(100) == (18,) * TABLES and sizes(400_000)[3:5] == (20, 22)
    words = [f"w{i:x}".encode() for i in range(80_000)]
    vocabulary = spark.createDataFrame([(bytearray(w), 1) for w in words], "word binary, c long")
    whole, mixer = fit(vocabulary)
    sharded, same = fit(vocabulary, shard_bits=18)
    bits = Bits(words, sizes(len(words)))
    assert bits.size[4] == 20 and [len(s) for s in sharded.shards] == [1, 1, 1, 1, 4, 1] and mixer.value == same.value
    want = [np.zeros((2, 1 << b), np.int64) for b in bits.size]
    for bit, slots, _ in bits:
        for t, s in enumerate(slots):
            np.add.at(want[t], (bit, s), 1)
    for t, w in enumerate(want):
        for got in (whole, sharded):
            assert (np.concatenate([s.value for s in got.shards[t]]) == packed(w)).all()
    fitted = pickle.loads(mixer.value)
    part, at = bits.part(100, 300)
    costs = fitted.cost(whole, part, 200)
    assert (costs == fitted.cost(sharded, part, 200)).all() and costs == pytest.approx(fitted.cost(whole, bits, len(words))[100:300])


def plain_tokens(text):
    """(beginning, one before, two before, word before) of each token, by a loop."""
    out, last, last2, word = [], UNSEEN, UNSEEN, b""
    for w in [*(text or "").encode().lower().split(), None]:
        b = END if w is None else (w + b" ")[0] * 256 + (w + b" ")[1]
        out.append((b, last, last2, word))
        last2, last, word = last, b, w
    return out


def test_beginnings_of_running_text(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(["th", "an", "é", "X", "z"], rng.integers(1, 4))) for _ in range(rng.integers(0, 90))) for _ in range(60)] + [None, "", " \t\n", "A", "x" * 9_000 + "\x0b\x0cb c"]
    tokens = Tokens(pa.array(texts, pa.string()))
    want = [(k, *row) for k, t in enumerate(texts) for row in plain_tokens(t)]
    assert list(zip(tokens.text.tolist(), tokens.begin.tolist())) == [(k, b) for k, b, *_ in want]
    for hashes, key in zip(tokens.contexts, (lambda r: r[2], lambda r: r[2:4], lambda r: r[4]), strict=True):
        by = {}
        for h, r in zip(hashes.tolist(), want, strict=True):
            by.setdefault(key(r), set()).add(h)
        assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)

    seen = Counter(r[1] for r in want)
    tree = Tree(seen)
    assert sum(2.0 ** -tree.length[k] for k in [*seen, UNSEEN]) == 1 and tree.unseen[0] and not tree.unseen[END]
    shared = spark.sparkContext.broadcast(pickle.dumps(tree))
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    counts, fitted = fit_contexts(docs, shared, 1000, len(want), len(texts))
    mixer = pickle.loads(fitted.value)
    assert counts.size == (18, 20, 20)

    plain = [Counter() for _ in counts.size]  # every step down the tree, counted one by one
    steps = []
    for i, r in enumerate(want):
        at = tree.first[r[1]]
        for depth in range(tree.length[r[1]]):
            one = Decisions(tokens, slice(i, i + 1), tree, counts.size)
            slots = [int(one.slots(0, t)[depth]) for t in range(len(plain))]
            bit = int(tree.bit[at + depth])
            steps.append((i, depth, bit, slots))
            for t, s in enumerate(slots):
                plain[t][s, bit] += 1
    for t, shards in enumerate(counts.shards):
        table = np.concatenate([s.value for s in shards])
        used = {s for s, _ in plain[t]}
        assert set(np.flatnonzero(table).tolist()) == used
        pairs = sorted(used)[:300]
        assert (table[pairs] == packed(np.array([[plain[t][s, 0] for s in pairs], [plain[t][s, 1] for s in pairs]]))).all()

    cost = mixer.cost(counts, Decisions(tokens, slice(0, len(want)), tree, counts.size), len(want))
    slow = np.zeros(len(want))  # logistic mixing of one bit after the other
    refined = np.log(mixer.hits[..., 1] / mixer.hits[..., 0])
    for i, depth, bit, slots in steps:
        gate, z = min(depth, DEPTHS - 1), 0.0
        for t, s in enumerate(slots):
            code = int(counts.shards[t][0].value[s])
            z += mixer.w[gate, t, mixer.seen[code]] * mixer.logit[code]
        z = min(max(z, -8.0), 8.0)
        lo = min(int((z + 8) * 2), 31)
        part = (z + 8) * 2 - lo
        z = min(max((z + (1 - part) * refined[gate, lo] + part * refined[gate, lo + 1]) / 2, -12.0), 12.0)
        slow[i] += math.log2(1 + math.exp(-z if bit else z))
    assert cost == pytest.approx(slow, abs=1e-5)
    total = 0.0  # all beginnings after one word sum to one
    for k in [*seen, UNSEEN]:
        probe = Tokens(pa.array(["th"]))
        probe.begin[:] = k
        total += 2.0 ** -mixer.cost(counts, Decisions(probe, slice(1, 2), tree, counts.size), 1)[0]
    assert total == pytest.approx(1, abs=1e-6)


def test_beginnings_are_fitted_on_all_training_texts(spark):
    texts = [f"{'th' if i % 3 else 'an'} in{i % 7} on" for i in range(6_000)]
    tokens = Tokens(pa.array(texts))
    seen = Counter(tokens.begin.tolist())
    tree = Tree(seen)
    bits = int(sum(tree.length[k] * n for k, n in seen.items()))
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    _, fitted = fit_contexts(docs, spark.sparkContext.broadcast(pickle.dumps(tree)), 9, len(tokens.begin), len(texts))
    assert (pickle.loads(fitted.value).hits - Mixer(DEPTHS, lm_context.TABLES).hits).sum() == pytest.approx(bits)


def test_words_are_counted_as_a_column():
    texts = ["The the\x0bCAT é", None, "", " \t", "cat dog", "x" * 5_000_000, "dog The\x85 cat"]
    held = [False, True, False, False, True, False, False]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(held)], ["text", "held_out"])
    c, n = Counter(), Counter()
    for out in _count_words(iter([batch.slice(0, 0), batch, batch.slice(2)])):
        assert len(set(out.column("word").to_pylist())) == len(out)
        for w, a, b in zip(*(out.column(x).to_pylist() for x in ("word", "c", "n")), strict=True):
            c[w] += a
            n[w] += b
    every = [(h, w) for h, t in [*zip(held, texts, strict=True), *zip(held[2:], texts[2:], strict=True)] for w in [*(t or "").encode().lower().split(), b""]]
    assert n == Counter(w for _, w in every) and +c == Counter(w for h, w in every if not h)


def test_folded_weights_cost_the_same():
    rng = np.random.default_rng(5)
    mixer = Mixer(DEPTHS, lm_context.TABLES)
    mixer.w = rng.normal(size=mixer.w.shape)
    where, gate, bit = rng.integers(0, 1 << 16, (lm_context.TABLES, 5_000)), rng.integers(0, DEPTHS, 5_000), rng.integers(0, 2, 5_000)
    refined = rng.normal(size=DEPTHS * Mixer.STEPS)
    plain = mixer._cost(where, bit, gate, refined)
    assert mixer.fold()._cost(where.astype(np.uint16), bit, gate, refined) == pytest.approx(plain, abs=1e-12)


def test_lm(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(["th", "an", "er", "in", "on"], rng.integers(1, 5))) for _ in range(400)]
    rows = [(i, " ".join(vocabulary[int(k)] for k in rng.zipf(1.3, 60) % 400), "s") for i in range(300)]
    rows += [(900, None, "s"), (901, "", "s"), (902, "y" * 20_000, "s"), (None, "The END", "s"), (3, rows[3][1], "s")]
    got = lm_score(frame(spark, rows)).collect()
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    c = Counter(w for i, t, _ in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    want = sorted(((i, held(i), len(tokens(t)), sum(w in c for w in tokens(t)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t, _ in rows), key=repr)
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got), key=repr) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    fair = [r for r in got if r["held_out"] and r["n_known"] == r["n_tokens"]]
    assert sum(r["score"] for r in fair) > 1.01 * sum(r["base_score"] for r in fair)  # words drawn independently: the unigram model is nearly right
    text = {r["doc_id"]: r["bits_per_byte"] for r in got if r["held_out"]}
    assert np.mean([b for i, b in text.items() if i is not None and i < 300]) < 4
    assert lm_score(frame(spark, [])).count() == 0
