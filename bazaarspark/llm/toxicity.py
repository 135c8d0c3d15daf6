"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses and a clause into words. A lexical transducer maps words to symbols: insults and threats with
their weights, targets, negations, verbs of reported speech, modal words, copulas, others. More transducers read its output, one
after the other: negation marks what follows it closely, reported speech marks the rest of the clause, a modal word leads a threat
("will ... hurt") and a copula or an address leads an insult ("you are ... a"), and a target marks insults and threats near it, before
or after. What the composition writes for a match is a pattern of several words: bare, aimed, led, led and aimed, negated, reported.

A text is judged by its patterns: whether an insult stands unmarked, how many are aimed or led, how many both, how many different
insults meet, and the same of threats, whose verbs alone mean nothing. Each of these adds to the ones before it with a weight of 0 or more,
so that an aimed insult never weighs less than a bare one, nor a negated one anything. A single bare word of the fixed list, which is
plain language as often as not, stays under the threshold by rule.

The lexicon's other insults are whole words or stems of five letters and more whose documents are labelled toxic far more often than others;
a stem is taken as far as nearly all its toxic words agree. Weights are a logistic regression with a prior, for the patterns that labelled
texts lack. Both are fitted on a bounded sample of labelled rows and are small; scoring is one pass over the texts, without an exchange.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarspark.llm import scratch

#: Labelled rows of either label that are learned from, about: all up to so many, beyond that a share of them by a hash of their identifier.
SAMPLE = 10_000
#: Lengths of learned stems, and letters that a word may have beyond its stem.
SHORTEST, LONGEST, ENDING = 5, 12, 6
#: A stem is learned if so many toxic texts, and this share of them, hold it and its odds are raised this much; it goes on while one letter
#: follows in this share of them.
SUPPORT, SHARE, LIFT, AGREE = 4, 0.01, 20.0, 0.9
#: Stems that a task holds at once, about.
COUNTED = 200_000
#: A text whose only match is one bare word of the fixed list has this score at most.
ALONE = 0.25

# Words of the grammar.
INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown imbecile jerk dumbass bastard asshole bitch cretin pig vermin".split()
THREATS = "kill hurt destroy murder shoot stab strangle burn punch tuer frapper töten umbringen schlagen matar golpear".split()
TARGETS = "you your yours they them their he him his she her tu te toi vous ils elles du dich dir ihr sie euch ellos ellas usted ustedes".split()
NEGATIONS = "not no never none nobody isn aren wasn don doesn didn without pas jamais aucun nicht kein keine nie nunca ningún tampoco".split()
REPORTS = "said says say wrote writes claimed called quoted quote reported according dit écrit sagte schrieb laut dijo escribió según".split()

MODALS = "will gonna going shall should must ll would werde werden wirst vais vas va allons voy vas vamos deberían".split()
COPULAS = "are is re am were was such absolute total bist ist sind seid es est sont eres son".split()

_clause = re.compile(r"[.!?;:,\n\"()]+")
_word = re.compile(r"[^\W\d_]+")

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, MODAL, COPULA = range(8)
NEGATED, REPORTED, AIMED, LED = 8, 16, 32, 64
#: Patterns that the grammar writes, in the order of their weights.
PATTERNS = [kind | mark for kind in (INSULT, THREAT) for mark in (0, AIMED, LED, LED | AIMED, NEGATED, REPORTED)]
#: An unmarked insult; insults aimed or led, and both; different insults beyond the first; threats aimed or led, and both.
FEATURES = 6
#: The weights of insults and of threats that are both led and aimed.
CALLED, MEANT = 3, 6
#: Weights where labelled texts say nothing.
PRIOR = np.array([-3.5, 0.8, 0.8, 2.4, 3.0, 1.5, 3.0])
#: How strong a pattern is: nothing, bare, aimed or led, both.
STRENGTH = {0: 1.0, AIMED: 1.25, LED: 1.25, LED | AIMED: 1.5, NEGATED: 0.0, REPORTED: 0.0}


@dataclass(frozen=True)
class Transducer:
    """States are numbers; ``arcs[state, symbol]`` is (next state, mark put on the symbol). Others keep what ``idle`` says."""

    arcs: dict[tuple[int, int], tuple[int, int]]
    idle: dict[int, int] = field(default_factory=dict)

    def run(self, symbols: list[int]) -> list[int]:
        state, out = 0, []
        for s in symbols:
            after = self.arcs.get((state, s & 7))
            if after is None:
                state = self.idle.get(state, state)
                out.append(s)
            else:
                state = after[0]
                out.append(s | after[1])
        return out


def _window(opener: int, mark: int, reach: int | None, kinds: tuple[int, ...] = (INSULT, THREAT)) -> Transducer:
    """Marks matches of some kinds in the ``reach`` words after an opener; without a reach, in all the rest."""
    states = range(1, (reach or 1) + 1)
    following = (lambda s: s) if reach is None else (lambda s: s + 1 if s < reach else 0)
    arcs = {(s, x): (following(s), mark) for s in states for x in kinds}
    arcs |= {(s, opener): (1, 0) for s in (0, *states)}
    return Transducer(arcs, {s: following(s) for s in states})


NEGATE, QUOTE, AIM = _window(NEGATION, NEGATED, 3), _window(REPORT, REPORTED, None), _window(TARGET, AIMED, 4)
LEAD = [_window(MODAL, LED, 3, (THREAT,)), _window(COPULA, LED, 3, (INSULT,)), _window(TARGET, LED, 1, (INSULT,))]


def compose(symbols: list[int]) -> list[int]:
    """The marked symbols of a clause: negation, then reported speech, what leads, and targets from the left and from the right."""
    marked = QUOTE.run(NEGATE.run(symbols))
    for lead in LEAD:
        marked = lead.run(marked)
    return AIM.run(AIM.run(marked)[::-1])[::-1]


def _mark(s: int) -> int:
    """A negated match is not reported; what is either is not led or aimed."""
    return NEGATED if s & NEGATED else REPORTED if s & REPORTED else s & (LED | AIMED)


def _has_object(symbols: list[int], i: int) -> bool:
    """Whether a verb has a target after it or right before it ("kill you", "dich töten"); one further before is who acts."""
    return TARGET in symbols[i + 1 : i + 5] or symbols[i - 1 : i] == [TARGET]


class Grammar:
    def __init__(self, stems: dict[str, float], weights: np.ndarray | None = None):
        #: All that another grammar is made of: the learned stems and the words of the fixed list.
        self.lexicon = stems
        self.stems = {s: g for s, g in stems.items() if s not in INSULTS}
        self.plain = {w + end for w in INSULTS if w in stems for end in ("", "s", "es")}
        self.short = {s[:SHORTEST] for s in self.stems}
        self.fixed = {w: k for k, ws in ((COPULA, COPULAS), (MODAL, MODALS), (REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS)) for w in ws}
        self.weights = PRIOR if weights is None else weights
        self.known: dict[str, bool] = {}

    def insult(self, word: str) -> bool:
        if word in self.plain:
            return True
        if word[:SHORTEST] not in self.short:
            return False
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            found = self.known[word] = any(word[:n] in self.stems for n in range(max(SHORTEST, len(word) - ENDING), min(len(word), LONGEST) + 1))
        return found

    def read(self, text: str | None) -> tuple[np.ndarray, bool]:
        """The features of a text, and whether all it has is one bare word of the fixed list."""
        out = np.zeros(FEATURES)
        low = (text or "").lower()
        plain, short, fixed = self.plain, self.short, self.fixed
        if not any(w in plain or (w[:SHORTEST] in short and self.insult(w)) or fixed.get(w) == THREAT for w in _word.findall(low)):
            return out, False
        counts: Counter = Counter()
        insults: set[str] = set()
        for clause in _clause.split(low):
            tokens = _word.findall(clause)
            symbols = [INSULT if self.insult(w) else fixed.get(w, OTHER) for w in tokens]
            if not any(s in (INSULT, THREAT) for s in symbols):
                continue
            for i, (s, w) in enumerate(zip(compose(symbols), tokens, strict=True)):
                kind = s & 7
                if kind in (INSULT, THREAT):
                    strength = STRENGTH[_mark(s)]
                    counts[kind, 1] += strength > 1
                    counts[kind, 2] += strength > 1.25 and (kind == INSULT or _has_object(symbols, i))
                    if kind == INSULT and strength:
                        insults.add(w)
        out[:] = [bool(insults), math.log1p(counts[INSULT, 1]), math.log1p(counts[INSULT, 2]), math.log1p(max(len(insults) - 1, 0)), math.log1p(counts[THREAT, 1]), math.log1p(counts[THREAT, 2])]
        return out, len(insults) == 1 and insults <= plain and not any(counts.values())

    def features(self, text: str | None) -> np.ndarray:
        return self.read(text)[0]

    def score(self, text: str | None) -> float:
        found, alone = self.read(text)
        score = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.weights[0] + self.weights[1:] @ found)))))
        return min(score, ALONE) if alone else score


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic: Counter = Counter()
    clean: Counter = Counter()

    def out() -> pa.RecordBatch:
        every = list(toxic.keys() | clean.keys())
        return pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([toxic[w] for w in every], pa.int64()), pa.array([clean[w] for w in every], pa.int64())], ["stem", "toxic", "clean"])

    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            held = {w[:n] for w in set(_word.findall((text.as_py() or "").lower())) for n in range(SHORTEST, min(len(w), LONGEST) + 1)}
            (toxic if label else clean).update(held)
            if len(toxic) + len(clean) > COUNTED:
                yield out()
                toxic.clear()
                clean.clear()
    yield out()


def _featured(stems: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(stems)
        for batch in batches:
            rows = [grammar.features(t.as_py()).tolist() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

    return run


def _regression(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression with weights of 0 or more and a prior, by Newton steps along one weight after the other."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = PRIOR.copy()
    penalty = np.array([1e-3, *[ridge] * (x.shape[1] - 1)])
    z = x @ w
    for _ in range(200):
        moved = 0.0
        for j in range(len(w)):
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            slope = x[:, j] @ (y - p) - penalty[j] * (w[j] - PRIOR[j])
            new = w[j] + np.clip(slope / (x[:, j] ** 2 @ (p * (1 - p)) + penalty[j]), -2, 2)
            new = new if j == 0 else max(new, 0.0)
            z += x[:, j] * (new - w[j])
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < 1e-7:
            break
    return w


def _fold(id_col: str):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Grammar:
    """The grammar learned from labelled rows outside the held-out fold. Without any, the fixed words under fixed weights."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~_fold(id_col)).groupBy(F.col(id_col).alias("_label_id")).agg(F.max(label_col).cast("int").alias("_label"))
    known = scratch.written(known, "toxic-labels")
    numbers = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    part = F.pmod(F.xxhash64("_label_id"), F.lit(1 << 30))
    share = lambda k: int(min(1.0, sample / max(numbers.get(k, 0), 1)) * (1 << 30))
    ids = F.broadcast(known.where(part < F.when(F.col("_label") == 1, share(1)).otherwise(share(0))))  # about 2 * sample rows
    rows = docs.join(ids, F.col(id_col) == F.col("_label_id")).select(F.col(text_col).cast("string").alias("text"), F.col("_label").alias("toxic"))
    rows = scratch.written(rows.dropDuplicates(["text", "toxic"]), "toxic-sample")
    seen = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    stems = {w: 2.0 for w in INSULTS}
    if not seen.get(1) or not seen.get(0):
        return Grammar(stems)
    counts = rows.mapInArrow(_beginnings, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    lift = ((F.col("toxic") + 0.1) / seen[1]) / ((F.col("clean") + 0.1) / seen[0])
    useful = counts.withColumn("lift", lift).where((F.col("toxic") >= max(SUPPORT, SHARE * seen[1])) & (F.col("lift") >= LIFT))
    # A stem is in a hundredth of the toxic texts or more: there are at most a hundred times as many as a text has on average.
    found = {r["stem"]: r for r in useful.collect()}
    for stem in sorted(found, key=lambda x: (len(x), x)):
        if any(stem[:n] in stems for n in range(SHORTEST, len(stem) + 1)) or any(stem.startswith(w) for w in INSULTS):
            continue
        while True:
            longer = [x for x in found if len(x) == len(stem) + 1 and x.startswith(stem) and found[x]["toxic"] >= AGREE * found[stem]["toxic"]]
            if not longer:
                break
            stem = max(longer, key=lambda x: (found[x]["toxic"], x))
        if stem not in INSULTS:
            stems[stem] = min(math.log(found[stem]["lift"]), 6.0)
    data = rows.mapInArrow(_featured(stems), "x array<double>, toxic int").toPandas()  # about 2 * sample rows
    y = data["toxic"].to_numpy(float)
    x = np.stack(data["x"])
    weights = _regression(x, y)
    for last in (CALLED, MEANT):
        if not x[:, last - 1].any():  # no labelled text has the pattern: one of it is as likely as not
            rest = weights[0] + weights[1] * (last == CALLED) + math.log(2) * weights[last - 1]
            weights[last] = max(weights[last], -rest / math.log(2))
    return Grammar(stems, weights)


def _scores(stems: dict[str, float], weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(stems, weights)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array([grammar.score(t.as_py()) for t in batch.column("text")], pa.float64())], ["id", "held_out", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """One row per document: ``id_col``, ``held_out``, ``score``, ``predicted``.

    Only texts enter a score. A null or empty text has no clause and gets the score of a text without a match. Labels are
    learned from rows with crc32(identifier as text) mod 4 other than 2; null labels and labels of unknown documents
    are left out, of several labels the largest counts, and one text counts once. Very long texts are read whole, clause by clause.
    Other columns are not read. An empty table gives an empty one.
    """
    grammar = fit(docs, labels, id_col, text_col, sample=sample)
    base = docs.select(F.col(id_col).alias("id"), _fold(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    id_type = base.schema["id"].dataType.simpleString()
    scored = base.mapInArrow(_scores(grammar.lexicon, grammar.weights), f"id {id_type}, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The documents, with all their columns, that are not predicted to be toxic. Null, empty and blank texts stay, and repeated rows stay
    or go alike; labels are taken as by :func:`toxicity`, and very long texts are read whole. An empty table gives an empty one."""
    grammar = fit(docs, labels, id_col, text_col, sample=sample)
    stems, weights = grammar.lexicon, grammar.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(stems, weights)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([own.score(t.as_py()) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
