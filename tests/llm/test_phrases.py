import collections
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import phrases

SCHEMA = "doc_id long, text string, lang string, n int, words string"


def docs_of(spark, rows):
    return spark.createDataFrame([(k, t, lang, 1, "x") for k, (t, lang) in enumerate(rows)], SCHEMA)


def plain(rows, least=10, most=3, inside=50, top=2000):
    """The same by counting everything."""
    counts, totals = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    candidates = {x: n for x, n in counts.items() if len(x[1]) > 1 and n >= least}
    dropped = {
        (lang, w[i : i + k])
        for (lang, w), n in candidates.items()
        for k in range(2, len(w))
        for i in range(len(w) - k + 1)
        if 100 * n >= inside * counts[lang, w[i : i + k]]
    }
    out = []
    for lang in totals:
        found = []
        for (x, w), a in candidates.items():
            if x == lang and (x, w) not in dropped:
                score, k = min((1_000_000 * a * a // (counts[x, w[:k]] * counts[x, w[k:]]), k) for k in range(1, len(w)))
                found.append((-score, -a, " ".join(w).encode(), counts[x, w[:k]], counts[x, w[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top]):
            out.append((lang, rank + 1, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def texts(seed, n=200):
    rng = random.Random(seed)
    words = ["New", "york", "new", "the", "of", "É", "é", "a\x01b", "a", "x'y", "ünder", "\x85", "🙂", "the"]
    made = []
    for _ in range(n):
        parts = [rng.choice([*words, "New York City", "of the", "a\x01b a"]) + rng.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n", "\r\n", "!?", "\x0b"]) for _ in range(rng.randrange(60))]
        made.append(("".join(parts), rng.choice(["en", "de", None, "und", "a b"])))
    return [*made, (None, "en"), ("", None), ("hot pair " * 3000, "en"), ("hot pair x" * 50, "zz"), ("...", "none"), ("one two three " * 9, "few")]


@pytest.mark.parametrize("most", [2, 3, 4])
def test_against_counting_all(spark, monkeypatch, most):
    monkeypatch.setattr(phrases, "ROUND_BYTES", 4000)
    monkeypatch.setattr(phrases, "GROW_ROWS", 900)
    rows = texts(most)
    got = phrases.collocations(docs_of(spark, rows).repartition(7), most=most)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, most=most)


def test_many_crowded_pairs_and_top(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARE", 20)
    monkeypatch.setattr(phrases, "ROUND_BYTES", 3000)
    rows = texts(11) + [("of the " + str(k % 40), "en") for k in range(2000)]
    got = phrases.collocations(docs_of(spark, rows).repartition(9), least=5, inside=80, top=7)
    assert sorted(map(tuple, got.collect())) == plain(rows, least=5, inside=80, top=7)


def test_wide_keys(spark, monkeypatch):
    """More words than fit into one key side by side."""
    rng = random.Random(1)
    rows = [(" ".join(f"w{rng.randrange(3000)} same old {rng.randrange(2)}" for _ in range(200)), "en") for _ in range(40)]
    got = phrases.collocations(docs_of(spark, rows), most=7)
    assert sorted(map(tuple, got.collect())) == plain(rows, most=7)


def test_large_numbers_are_exact(spark, monkeypatch):
    counts = spark.createDataFrame([("en", "a", 10**15), ("en", "b", 3 * 10**14), ("en", "a b", 10**14 - 1)], "lang string, words string, n long")
    totals = spark.createDataFrame([("en", 2 * 10**15)], "lang string, total long")
    monkeypatch.setattr(phrases, "patterns", lambda *_: (counts, totals))
    got = phrases.collocations(docs_of(spark, [("", "en")])).collect()
    score = 10**6 * (10**14 - 1) ** 2 // (10**15 * 3 * 10**14)
    assert [tuple(r) for r in got] == [("en", 1, "a b", 10**14 - 1, 10**15, 3 * 10**14, 2 * 10**15, score)]


@pytest.mark.parametrize("rows", [[], [(None, None)], [("one", "en")], [(" .,", "en")]])
def test_empty(spark, rows):
    assert phrases.collocations(docs_of(spark, rows)).collect() == []


def many_words(n, parts):
    """Batches of ``n`` words in all, half of them rare."""
    rng = np.random.default_rng(5)
    for _ in range(parts):
        drawn = np.where(rng.random(n // parts) < 0.5, rng.zipf(1.3, n // parts) % 500, rng.integers(0, 60_000, n // parts)).tolist()
        yield pa.RecordBatch.from_pydict({"lang": pa.array(["en", "de"] * 20), "text": pa.array([" ".join(f"w{x}" for x in drawn[k::40]) for k in range(40)])})


def test_a_worker_holds_little():
    """A round needs a share of a worker's memory, and what goes to the shuffle leaves it in small batches."""
    used, most, largest = pa.default_memory_pool(), 0, 0
    batches = list(many_words(3_000_000, 10))
    before = used.bytes_allocated()
    tracemalloc.start()
    try:
        for out in phrases.projected(iter(batches), 3, 330, set()):
            most, largest = max(most, used.bytes_allocated() - before), max(largest, out.nbytes)
        arrays = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert largest < 4 << 20
    assert most < 48 << 20
    assert arrays < 100 << 20


def test_many_buckets_cost_little():
    """There are as many buckets as the input is large: a row for one holds its occurrences and little else."""
    rows = [r for out in phrases.projected(many_words(100_000, 1), 3, 100_000, set()) for r in out.to_pylist()]
    assert len(rows) > 20_000
    assert sum(len(v) for r in rows for v in r.values() if isinstance(v, bytes)) < 40 * 100_000
