import random

import xxhash

from quire.llm import components, simhash


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    out = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(s.encode(), seed=42) >> bit & 1 for s in shingles)
        out |= (2 * ones > len(shingles)) << bit
    return out


def grouped(nodes, near):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in nodes:
        for b in nodes:
            if near(a, b):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {n: top(n) for n in nodes}


def texts():
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("ka", "Lo", "mé", "ßu", "I") for b in ("ra", "ti", "x")]
    made = [None, "", " \t\n", "one", "One", "two words", "a\x0bb\x0cc", "a b c", "a b c d", "Ünï " * 5000]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 60, 300]))]
        for _ in range(rng.choice([1, 4])):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            made += [" ".join(base), " ".join(copy)]
    return made


def test_against_brute_force(spark, docs):
    made = texts()
    rows = [(1000 - i, t) for i, t in enumerate(made)]
    found = {r.doc_id: r for r in simhash.near_duplicates(docs(rows)).collect()}
    assert len(found) == len(rows)
    fps = {i: plain(t) for i, t in rows}
    assert {i: r.fp % 2**64 for i, r in found.items()} == fps
    want = grouped(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    assert {i: r.component_id for i, r in found.items()} == want


def test_links_with_crowded_keys(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 4)
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for base in list(fps)[:6]:
        for _ in range(30):
            fp = base
            for _ in range(rng.randrange(1, 6)):
                fp ^= 1 << rng.randrange(64)
            fps.add(fp)
    fps = sorted(f - 2**64 if f >= 2**63 else f for f in fps)
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(20)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100 + k: 100 for k in range(30)} | {200: 200, 201: 200}


def test_nulls_repeats_and_empty(spark, docs):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (3, "a b c d"), (9, None), (8, ""), (None, "alone here")]
    found = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs(rows)).collect()]
    assert sorted(found, key=str) == sorted([(5, 3), (5, 3), (None, 3), (3, 3), (9, 8), (8, 8), (None, None)], key=str)
    kept = simhash.keep_one(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 8, None]
    assert simhash.near_duplicates(docs([])).count() == 0
    assert simhash.keep_one(docs([])).count() == 0


def test_one_row_for_each_component_whatever_its_id(spark, docs):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(12)]
    rows = [(None, base[0]), (None, base[1]), (None, base[1]), (None, base[2]), (4, base[2])]  # null ids in three components
    rows += [(7, base[3]), (7, base[4]), (7, base[4]), (7, base[5]), (3, base[5])]  # an id with three texts
    rows += [(k, base[6]) for k in (9, 8)] + [(8, base[7])]
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs(rows)).collect()]
    want = [(None, base[0]), (None, base[1]), (4, base[2]), (7, base[3]), (7, base[4]), (3, base[5]), (8, base[6]), (8, base[7])]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_variants_are_never_broadcast(spark):
    rows = spark.createDataFrame([(k,) for k in range(300)], "fp long")
    plan = simhash.links(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "fp" in plan
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "sub" in line]
