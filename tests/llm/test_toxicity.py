import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import toxicity as tx

INSULTS = tx.Insults.of([("idiot", 6.0), ("ach*", 2.0), ("achl*", 4.0)])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", []),
        ("a fine day", []),
        ("the idiot sat", [6.0]),
        ("you idiot", [7.5]),
        ("idiot you are. calm", [7.5]),
        ("not an idiot", [3.0]),
        ("not at all really an idiot", [6.0]),
        ('he said idiot', [3.75]),
        ('"idiot" and idiot', [9.0]),
        ('he wrote "a. idiot" then idiot', [3.0 + 6.0]),
        ("i will kill you", [5.625]),
        ("kill it all for good then you", [3.75]),
        ("never kill you", [1.875]),
        ("he said kill you", [1.875]),
        ('„kill“ you', [1.875]),
        ("not said \"kill you\" idiot", [(0.75 + 6.0) * 1.25]),
        ("achter; achlich", [2.0, 4.0]),
        ("idiotic", []),
        ("one\nidiot\nidiot", [6.0, 6.0]),
        ("not said idiot", [1.5]),
    ],
)
def test_clauses(text, want):
    assert [round(s, 6) for s, _ in tx.clauses(text, INSULTS)[0]] == want
    assert (tx.features(text, INSULTS)[1] > 0) == bool(want)


def test_lost_weight_and_length():
    assert tx.clauses("not an idiot", INSULTS) == ([(3.0, 3.0)], 3)
    assert tx.features(None, INSULTS) == [1.0] + [0.0] * 5
    assert tx.features("IDIOT " * 30000, INSULTS)[1] == math.log1p(6.0 * 30000)


def walk(parts, labels):
    """Weights of a clause's words by the transducers one after another, each over all that the one before wrote."""
    tape = [(label, weight) for label, weight in labels]
    factor = 1.0
    for part in parts:
        state, wrote = part.start, []
        for label, weight in tape:
            state, out, times, added = part.step(state, label)
            wrote.append((out, weight * times + added))
        factor *= part.finals.get(state, 1.0)
        tape = wrote
    return sum(w for _, w in tape) * factor


def test_composition_against_the_parts_in_turn():
    rng = random.Random(1)
    parts = [tx.negation(), tx.reported(), tx.threat(), tx.insult(), tx.target()]
    words = [x for x in tx.LABELS if x != tx.END]
    for n in range(3000):
        labels = [(x, 2.0 if x == tx.INSULT else 3.0 if x == tx.THREATS else 0.0) for x in rng.choices(words, k=rng.randrange(9))]
        state = total = 0
        for label, weight in labels:
            state, factor, added = tx.TABLE[state][label]
            total += weight * factor + added
        assert abs(total * tx.FINALS[state] - walk(parts, labels)) < 1e-9


def test_states_at_the_end_of_a_clause():
    begin = tx.TABLE[0][tx.OPENS][0]
    for row in tx.TABLE:
        assert row[tx.END][0] in (0, begin)  # nothing but an open quotation outlasts a clause


def test_held_out_recall_on_given_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = tx.score(docs, labels).filter("held_out").join(labels, "doc_id")
    caught, toxic, wrong = out.agg(*(F.count_if(F.expr(x)) for x in ("toxic = 1 and predicted = 1", "toxic = 1", "toxic = 0 and predicted = 1"))).first()
    assert toxic > 100 and caught >= 0.9 * toxic and wrong <= 0.02 * toxic


def test_order_of_rows_changes_nothing(spark, docs):
    rows, labels = corpus()
    rows += [(3000 + i, t) for i, t in rows[:200]]
    labels += [(3000 + i, 1 - y) for i, y in labels[:200]]  # copies with other labels
    made = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        frame = docs(rows).repartition(1 + seed)
        made.append(sorted(tuple(r) for r in tx.score(frame, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()))
    assert made[0] == made[1]


def corpus():
    rng = random.Random(9)
    words = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows, labels = [], []
    for n in range(900):
        toxic = n % 5 == 0
        text = [rng.choice(words) for _ in range(rng.randrange(15, 40))]
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["grobian", "lump", "schuft" + rng.choice(["e", "en", "ig"])]))
        rows.append((n, " ".join(text)))
        labels.append((n, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, docs):
    rows, labels = corpus()
    extra = [(2000, None), (2001, ""), (None, "grobian lump grobian"), (5, rows[5][1])]
    marks = spark.createDataFrame(labels + [(7, None), (None, 1)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    out = tx.score(docs(rows + extra), marks).collect()
    assert len(out) == len(rows) + len(extra)
    truth = dict(labels)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [(truth[r.doc_id], r.predicted) for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 200 and np.mean([a == b for a, b in held]) > 0.98
    assert [r.predicted for r in out if r.doc_id is None] == [1]
    assert {r.predicted for r in out if r.doc_id in (2000, 2001)} == {0}


def test_labels_that_are_held_out_change_nothing(spark, docs):
    rows, labels = corpus()
    kept = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    flipped = [(i, t if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - t) for i, t in labels]
    data = docs(rows[:300])
    made = [sorted(tuple(r) for r in tx.score(data, spark.createDataFrame(x, "doc_id long, toxic int")).collect()) for x in (kept, flipped)]
    assert made[0] == made[1]


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert tx.score(docs([]), none).count() == 0
    assert [r.predicted for r in tx.score(docs([(1, "idiot")]), none).collect()] == [0]
