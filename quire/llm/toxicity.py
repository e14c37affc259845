"""Toxicity by a weighted finite-state pattern grammar over clauses."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, sampled_ids, small_batches, stage

#: Labelled rows learned from at most.
TRAIN_ROWS = 20_000
#: Terms of the insult transducer at most; the least evidence (a likelihood ratio) and weight (a log ratio of odds) of one.
TERMS, EVIDENCE, LEAST_WEIGHT, MOST_WEIGHT = 1000, 15.0, 1.0, 6.0
#: Lengths of the word beginnings that may be terms.
STEMS = (4, 5, 6, 7, 8)
THRESHOLD = 0.7

# Words that open the grammar's other transducers, in English, German, French and Spanish.
NEGATION = frozenset("not no never none cannot nicht kein keine nie niemals ne pas jamais aucun ni nunca jamás ningún".split())
REPORTED = frozenset("said says wrote quoted claimed called reported sagte sagt schrieb zitierte dit écrit cité dijo dice escribió citó".split())
TARGET = frozenset("you your yourself he him she her they them du dich dir ihr euch sie er tu toi vous ils elle usted ustedes tú ti ellos ella".split())
THREAT = frozenset("kill hurt destroy shoot stab murder beat burn töten umbringen schlagen erschießen tuer frapper détruire matar golpear destruir".split())

#: Weight of a threat word, and what a target soon after it adds; words that a negation and a threat reach; factors of
#: a negated or reported word and of a clause with a target.
THREAT_WEIGHT, THREATENED = 3.0, 1.5
NEGATION_REACH, THREAT_REACH = 3, 3
NEGATED, REPORTING, TARGETED = 0.5, 0.5, 1.25

SYMBOL = re.compile(r"[^\W\d_]+|[.!?;\n]|[\"«»“”„]")
WORD = re.compile(r"[^\W\d_]+")
OPENING = frozenset("\"«“„")
MARKS = frozenset(".!?;\n")

#: What a transducer reads and writes: an insult or threat, the same once it is negated or reported, a target, a
#: negation, a verb of reporting, quotation marks, any other word, and the end of a clause.
LABELS = INSULT, THREATS, MILD_INSULT, MILD_THREAT, TARGETS, NEGATES, REPORTS, OPENS, CLOSES, OTHER, END = range(11)


@dataclass
class Transducer:
    """A deterministic weighted transducer.

    arcs: (state, label) -> (next state, label written, factor, added): the weight that comes with a label is
    multiplied and added to. A label without an arc is written as it is and leaves the state alone. finals: the factor of a
    clause that ends in a state, 1 where none is given.
    """

    start: Any
    arcs: dict[tuple[Any, int], tuple[Any, int, float, float]]
    finals: dict[Any, float] = field(default_factory=dict)

    def step(self, state: Any, label: int) -> tuple[Any, int, float, float]:
        return self.arcs.get((state, label), (state, label, 1.0, 0.0))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The transducer that reads what ``a`` reads and writes what ``b`` writes of it; its weights are those of both in turn."""
    start = (a.start, b.start)
    arcs, finals, due = {}, {}, [start]
    while due:
        state = due.pop()
        if state in finals:
            continue
        finals[state] = a.finals.get(state[0], 1.0) * b.finals.get(state[1], 1.0)
        for label in LABELS:
            s, between, factor, added = a.step(state[0], label)
            t, written, more, also = b.step(state[1], between)
            arcs[state, label] = ((s, t), written, factor * more, added * more + also)
            due.append((s, t))
    return Transducer(start, arcs, finals)


def negation(reach: int = NEGATION_REACH) -> Transducer:
    """The state is how many words a negation still reaches; insults and threats within are mild."""
    arcs = {}
    for state in range(reach + 1):
        less = max(0, state - 1)
        for label in (INSULT, THREATS, TARGETS, REPORTS, OTHER):
            mild = {INSULT: MILD_INSULT, THREATS: MILD_THREAT}.get(label, label) if state else label
            arcs[state, label] = (less, mild, NEGATED if mild != label else 1.0, 0.0)
        arcs[state, NEGATES] = (reach, NEGATES, 1.0, 0.0)
        arcs[state, END] = (0, END, 1.0, 0.0)
    return Transducer(0, arcs)


def reported() -> Transducer:
    """Speech is reported from a verb to the end of the clause, and between quotation marks over clauses."""
    arcs = {("plain", REPORTS): ("said", REPORTS, 1.0, 0.0), ("said", END): ("plain", END, 1.0, 0.0)}
    for state in ("plain", "said", "quoted"):
        arcs[state, OPENS] = ("plain" if state == "quoted" else "quoted", OPENS, 1.0, 0.0)
        arcs[state, CLOSES] = ("plain", CLOSES, 1.0, 0.0)
        if state != "plain":
            for label, mild in ((INSULT, MILD_INSULT), (THREATS, MILD_THREAT), (MILD_INSULT, MILD_INSULT), (MILD_THREAT, MILD_THREAT)):
                arcs[state, label] = (state, mild, REPORTING, 0.0)
    return Transducer("plain", arcs)


def threat(reach: int = THREAT_REACH) -> Transducer:
    """A threat that isn't mild weighs more if a target follows within reach."""
    arcs = {}
    for state in range(reach + 1):
        for label in (INSULT, MILD_INSULT, MILD_THREAT, NEGATES, REPORTS, OTHER):
            arcs[state, label] = (max(0, state - 1), label, 1.0, 0.0)
        arcs[state, TARGETS] = (0, TARGETS, 1.0, THREATENED if state else 0.0)
        arcs[state, THREATS] = (reach, THREATS, 1.0, 0.0)
        arcs[state, END] = (0, END, 1.0, 0.0)
    return Transducer(0, arcs)


def insult() -> Transducer:
    """Each further insult of a clause weighs as much as the first; they end with the clause."""
    arcs = {("none", x): ("some", x, 1.0, 0.0) for x in (INSULT, MILD_INSULT, THREATS, MILD_THREAT)}
    return Transducer("none", arcs | {("some", END): ("none", END, 1.0, 0.0)}, {"none": 0.0})


def target() -> Transducer:
    """A clause with a target weighs more."""
    return Transducer("none", {("none", TARGETS): ("some", TARGETS, 1.0, 0.0), ("some", END): ("none", END, 1.0, 0.0)}, {"some": TARGETED})


def grammar() -> Transducer:
    """All of them in turn: a clause matches if it has an insult or threat, and its weight is that of its path."""
    made = negation()
    for part in (reported(), threat(), insult(), target()):
        made = compose(made, part)
    return made


def numbered(made: Transducer) -> tuple[list[list[tuple[int, float, float]]], list[float]]:
    """The transducer with its states as numbers, 0 the start: (next, factor, added) by state and label, and the finals."""
    places = {made.start: 0} | {s: n for n, s in enumerate((s for s in made.finals if s != made.start), 1)}
    table = [[(places[t], f, more) for t, _, f, more in (made.step(s, label) for label in LABELS)] for s in places]
    return table, [made.finals[s] for s in places]


TABLE, FINALS = numbered(grammar())


@dataclass
class Insults:
    """The learned lexicon: whole words, and word beginnings of some lengths, each with its weight."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[int, dict[str, float]] = field(default_factory=dict)

    @classmethod
    def of(cls, terms: list[tuple[str, float]]) -> Insults:
        made = cls()
        for term, weight in terms:
            if term.endswith("*"):
                made.stems.setdefault(len(term) - 1, {})[term[:-1]] = weight
            else:
                made.words[term] = weight
        return made

    def weight(self, word: str) -> float:
        """Of the ways to read a word (itself, its beginnings) the one of most weight."""
        found = self.words.get(word, 0.0)
        for size, stems in self.stems.items():
            if len(word) >= size:
                found = max(found, stems.get(word[:size], 0.0))
        return found

    def read(self, word: str) -> tuple[int, float]:
        """A word's label and weight."""
        own = self.weight(word)
        if word in THREAT:
            return THREATS, max(own, THREAT_WEIGHT)
        if own:
            return INSULT, own
        return NEGATES if word in NEGATION else REPORTS if word in REPORTED else TARGETS if word in TARGET else OTHER, 0.0

    def within(self, words: set[str]) -> bool:
        if not self.words.keys().isdisjoint(words) or not THREAT.isdisjoint(words):
            return True
        return any(not stems.keys().isdisjoint({w[:size] for w in words}) for size, stems in self.stems.items())


def clauses(text: str, insults: Insults) -> tuple[list[tuple[float, float]], int]:
    """(score, weight taken off) of each clause that the grammar matches, and the number of words.

    The composed transducer reads the text's symbols once. A clause's score is the sum of its words' weights, as its path
    multiplies and adds to them, times the factor of the state that it ends in.
    """
    found = []
    words = state = 0
    weight = lost = 0.0
    known: dict[str, tuple[int, float]] = {}
    for symbol in [*SYMBOL.findall(text), "\n"]:
        if symbol in MARKS:
            if weight or lost:
                found.append((weight * FINALS[state], lost))
            state, weight, lost = TABLE[state][END][0], 0.0, 0.0
        elif not symbol.isalpha():
            state = TABLE[state][OPENS if symbol in OPENING else CLOSES][0]
        else:
            words += 1
            read = known.get(symbol)
            if read is None:
                read = known[symbol] = insults.read(symbol)
            label, full = read
            state, factor, added = TABLE[state][label]
            own = full * factor + added
            weight += own
            lost += max(0.0, full - own)
    return found, words


FEATURES = 6


def features(text: str | None, insults: Insults) -> list[float]:
    """What the calibration sees of a text: the sum and the largest of its clauses' scores, their number, the sum for each hundred words, the weight taken off."""
    low = (text or "").lower()
    if not insults.within(set(WORD.findall(low))):
        return [1.0] + [0.0] * (FEATURES - 1)
    found, words = clauses(low, insults)
    total = sum(s for s, _ in found)
    return [
        1.0,
        math.log1p(total),
        math.log1p(max((s for s, _ in found), default=0.0)),
        math.log1p(len(found)),
        math.log1p(100 * total / max(50, words)),
        math.log1p(sum(x for _, x in found)),
    ]


def calibrated(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with a small ridge, by Newton's method."""
    w = np.zeros(FEATURES)
    ridge = np.eye(FEATURES) * 0.5
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + ridge, rows.T @ (labels - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def remainder(column: Column) -> Column:
    return F.pmod(F.crc32(column.cast("string")), F.lit(3))


def learning_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, toxic) of at most TRAIN_ROWS labelled documents that aren't held out, one of each group of near copies."""
    named = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    named = named.filter((remainder(F.col("id")) != 1) & F.col("toxic").isNotNull())
    ids = sampled_ids(named, TRAIN_ROWS, "id")
    chosen = named.join(F.broadcast(ids), "id").groupBy("id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").join(F.broadcast(chosen), "id")
    # Near copies share their least shingle more often than not; without this their words would pass for insults.
    words = F.split("text", r"\s+")
    last = F.greatest(F.size(words) - 2, F.lit(1))
    least = let(words, lambda w: F.array_min(F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(w, i, 3)))))
    rows = stage(rows.withColumn("copy", least), "labelled")
    return rows.groupBy("copy").agg(F.min(F.struct("id", "text", "toxic")).alias("first")).select("first.*")


def lexicon(rows: DataFrame) -> list[tuple[str, float]]:
    """The TERMS words and word beginnings at most that toxic documents have far more often, with their log odds ratios."""
    toxic, all_ = rows.agg(F.sum("toxic"), F.count("*")).first()
    if not toxic or toxic == all_:
        return []
    stems = lambda w: F.array(w, *(F.when(F.length(w) >= n, F.concat(F.substring(w, 1, n), F.lit("*"))) for n in STEMS))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    terms = F.array_distinct(F.array_compact(F.flatten(F.transform(words, stems))))
    counts = rows.select("toxic", F.explode(terms).alias("term")).groupBy("term").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    share = toxic / all_
    t, n = F.col("t"), F.col("n")
    safe = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    evidence = 2 * (safe(t, n * share) + safe(n - t, n * (1 - share)))
    weight = F.log((t + 0.5) / (toxic + 1.0)) - F.log((n - t + 0.5) / (all_ - toxic + 1.0))
    found = counts.filter((n >= 5) & (t > n * share)).select("term", weight.alias("w"), evidence.alias("e"))
    found = found.filter((F.col("w") >= LEAST_WEIGHT) & (F.col("e") >= EVIDENCE)).orderBy(F.desc("e"), "term").limit(TERMS)
    return [(r["term"], min(MOST_WEIGHT, r["w"])) for r in found.collect()]


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Insults, np.ndarray]:
    """The lexicon, learned from the sample, and the calibration of clause scores.

    For the calibration each half of the sample is scored by the lexicon of the other half.
    """
    rows = stage(learning_rows(docs, labels, id_col, text_col), "learning").withColumn("half", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)))
    halves = [Insults.of(lexicon(rows.filter(F.col("half") != k))) for k in (0, 1)]
    shared = rows.sparkSession.sparkContext.broadcast(halves)

    def run(batches):
        for batch in batches:
            texts, half = batch.column("text").to_pylist(), batch.column("half").to_pylist()
            made = [features(t, shared.value[k]) for t, k in zip(texts, half, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

    held = rows.select("text", "toxic", "half").mapInArrow(run, "x array<double>, toxic int").toPandas()
    insults = Insults.of(lexicon(rows))
    if not len(held):
        return insults, np.array([-5.0] + [0.0] * (FEATURES - 1))
    x, y = np.array(held["x"].tolist()), held["toxic"].to_numpy(float)
    order = np.lexsort((y, *x.T))  # sums in one order, whatever order the rows came in
    return insults, calibrated(x[order], y[order])


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row.

    score is the calibrated probability that the text is toxic; a null or empty text has no clause and gets
    the score of one without an insult. predicted is 1 where score >= THRESHOLD. held_out: crc32 of the id as text
    leaves remainder 1 by 3; a null id is not held out and never learned from. An id with several labels counts as
    toxic if one of them is. Without labels nothing is toxic. Repeated rows keep a row each; only the
    named columns are read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col, text_col))

    def run(batches):
        insults, w = shared.value
        for batch in batches:
            made = np.array([features(t, insults) for t in batch.column("text").to_pylist()]).reshape(-1, FEATURES)
            p = 1 / (1 + np.exp(-np.clip(made @ w, -30, 30)))
            arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "score", "predicted"])

    held_out = F.coalesce(remainder(F.col(id_col)) == 1, F.lit(False)).alias("held_out")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out, F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
