import random
import tracemalloc

import numpy as np

from quire.llm import decontaminate as dc


def best(item, text):
    """Fewest edits between the item and any substring of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def edited(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("xyzé")
        elif kind == 1:
            chars.insert(at, rng.choice("xyz "))
        elif len(chars) > 1:
            del chars[at]
    return "".join(chars)


def cases(seed=0):
    rng = random.Random(seed)
    syllables = ["an", "the", "er", "in", "on", "th", "es", " ", " ", "é", ". "]
    words = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    items = [words(rng.randrange(20, 70)) for _ in range(12)] + ["tiny é", "exactly8"]
    docs = [None, "", "  ", items[0], items[1].upper(), items[2].replace(" ", " \n\t")]
    for _ in range(110):
        item = dc.normal(rng.choice(items[:12]))
        docs.append(words(rng.randrange(60)) + " " + edited(rng, item, rng.randrange(0, len(item) // 7)) + " " + words(rng.randrange(60)))
    docs += [words(100) for _ in range(20)] + ["a tiny É b exactly8", items[3][: len(items[3]) // 2], items[4] + " " + items[4]]
    return items, docs


def test_against_full_alignment(spark, docs):
    items, texts = cases()
    bench = spark.createDataFrame([(100 + k, t, "x") for k, t in enumerate(items)] + [(99, None, ""), (98, " ", "")], "item_id long, text string, doc_id string")
    rows = list(enumerate(texts))
    found = dc.regions(docs(rows), bench).collect()
    got = {}
    for r in found:
        text, item = dc.normal(texts[r.doc_id]), dc.normal(items[r.item_id - 100])
        assert distance(item, text[r.start : r.end]) == r.edits <= dc.edit_budget(len(item))
        got[r.doc_id, r.item_id] = min(r.edits, got.get((r.doc_id, r.item_id), 999))
    want = {}
    for d, t in rows:
        for k, item in enumerate(items):
            item = dc.normal(item)
            edits = best(item, dc.normal(t))
            if dc.normal(t) and edits <= dc.edit_budget(len(item)):
                want[d, 100 + k] = edits
    assert got == want
    assert len(want) > 60 and any(want.values())
    kept = dc.clean(docs(rows), bench)
    assert kept.columns == docs(rows).columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_blocks_repeats_and_empty(spark, docs, monkeypatch):
    items, _ = cases(1)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(3, items[0]), (3, items[0]), (None, items[0]), (4, "clean")]
    whole = sorted(map(str, dc.regions(docs(rows), bench).collect()))
    monkeypatch.setattr(dc, "BLOCK_CHARS", 100)
    assert sorted(map(str, dc.regions(docs(rows), bench).collect())) == whole and len(whole) == 3
    assert {r.doc_id for r in dc.clean(docs(rows), bench).collect()} == {4}
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.regions(docs(rows), none).count() == 0 and dc.clean(docs(rows), none).count() == 4
    assert dc.regions(docs([]), bench).count() == 0


def test_bound_never_loses_a_region():
    rng = random.Random(2)
    for _ in range(60):
        item = "".join(rng.choice("abcd ") for _ in range(rng.randrange(8, 160)))
        block = dc.Block([1], [item])
        text = "".join(rng.choice("abcd ") for _ in range(300)) + edited(rng, item, dc.edit_budget(len(item))) + "abcd" * 20
        assert block.regions([text])
    assert np.array_equal(dc.qgrams(dc.codes("short")), np.empty(0, np.uint32))


def test_memory_where_a_text_repeats_an_items_qgram():
    block = dc.Block([1], ["=" * 80])
    tracemalloc.start()
    found = block.regions(["=" * 300_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    spans = [r[2:4] for r in found]
    spans.sort()
    assert len(spans) > 3000 and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert peak < 300 << 20


def test_hits_counted_in_parts(monkeypatch):
    block = dc.Block([1, 2], ["the cat sat on the cat and the dog sat too", "another line of some words in a row"])
    texts = ["x the cat sat on the cat and the dog sat too y another line of some wrds in a row " * 3, "nothing here"]
    whole = block.regions(texts)
    monkeypatch.setattr(dc, "HITS", 3)
    monkeypatch.setattr(dc, "ALIGNED_CELLS", 1)
    assert len(whole) == 6 and block.regions(texts) == whole
