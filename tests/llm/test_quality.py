import math
import random
import re

import xxhash
from pyspark.sql import functions as F

from quire.llm import quality


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed


def hashed(text, size):
    """The buckets of a text, by an XXH64 of its own: of each token, and of each token's hash seeded with the one's before."""
    tokens = [xxhash.xxh64_intdigest(t.encode(), 42) for t in re.findall(r"[^\W_]*[\w]+|[^\w\s]+", text or "")]
    pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(tokens, tokens[1:], strict=False)]
    signed = [h - (h >> 63 << 64) for h in tokens + pairs]
    return [h % size for h in signed]


def texts():
    rng = random.Random(2)
    made = [None, "", " \n\t", "a", "x " * 200, "one two three four five six seven eight " * 2, "line\nline\n \nline\n", "#*$ é|<> 😀& %"]
    for n in range(60):
        words = [rng.choice(["aa", "bb", "cé", "d😀", "#", "e.", "||"]) if n % 2 else f"w{rng.randrange(90)}" for _ in range(rng.randrange(1, 120))]
        if n % 3 == 0:
            words += words[: rng.randrange(len(words))]
        made.append("".join(w + rng.choice([" ", "\n", "\t\t", "\x0b ", "\r\n", " "]) for w in words))
    made.append(" ".join(f"v{k % 7919}" for k in range(20000)))
    return made


def test_base_against_brute_force(spark, docs):
    rows = list(enumerate(texts()))
    out = docs(rows).select("doc_id", quality.base(F.coalesce("text", F.lit(""))).alias("m")).select("doc_id", "m.*")
    got = {r[0]: tuple(r)[1:] for r in out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    assert got == {i: measures(t)[:5] for i, t in rows}


def test_verdicts_against_brute_force(spark, docs):
    rng = random.Random(4)
    good = [" ".join(rng.choice(["the", "of", "and", "river", "stone"]) for _ in range(40)) for _ in range(12)]
    bad = [" ".join(rng.choice(["buy", "now", "||", "$$$", "click"]) for _ in range(40)) for _ in range(12)]
    rows = list(enumerate(good + bad + [None, "", "short", good[0] + " " + bad[0]]))
    rows += [(3, good[3]), (None, good[1])]
    data = docs(rows)
    trusted = spark.createDataFrame([(i,) for i in [0, 1, 2, 3, 4, 5, 5, None]], "doc_id long")
    got = sorted(((r.doc_id, r.score, r.kept, r.base_failed) for r in quality.judge(data, trusted).collect()), key=str)
    size = quality.buckets_for(len(rows))
    grams = {t: hashed(t, size) for _, t in rows}
    for r in data.select("text", quality.buckets(F.coalesce("text", F.lit("")), size).alias("b")).distinct().collect():
        assert sorted(r.b) == sorted(grams[r.text])
    raw, target = [1] * size, [0] * size
    for i, t in rows:
        for b in grams[t]:
            raw[b] += 1
            target[b] += i in range(6)
    mixed = [t + size * r / sum(raw) for r, t in zip(raw, target, strict=True)]
    weight = [round(1e6 * (math.log(t / sum(mixed)) - math.log(r / sum(raw)))) for r, t in zip(raw, mixed, strict=True)]
    want = []
    for i, t in rows:
        score = math.floor(sum(weight[b] for b in grams[t]) / len(grams[t])) if grams[t] else None
        failed = measures(t)[5]
        want.append((i, score, not failed and score is not None and score >= quality.LEAST_SCORE, failed))
    near = [(a[0], a[2], a[3]) for a in got], sorted(want, key=str)
    assert near[0] == [(a[0], a[2], a[3]) for a in near[1]]
    assert all((a[1] is None) == (b[1] is None) and (a[1] is None or abs(a[1] - b[1]) <= 2) for a, b in zip(got, near[1], strict=True))
    kept = {r[0] for r in got if r[2]}
    assert {0, 1, 2, 3, 4, 5} <= kept


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "doc_id long")
    assert quality.judge(docs([]), none).count() == 0
    assert quality.judge(docs([(1, "a b c " * 9)]), none).count() == 1


def test_every_trusted_row_counts(spark):
    n = 20_500  # more trusted ids than the 20,000 that once counted
    data = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    data = data.unionByName(spark.range(40).select(F.lit(None).cast("long").alias("doc_id"), F.lit("||").alias("text")))
    size = 1 << 15
    got = quality.weights(data, data.select("doc_id"), size).first().table
    raw, target = [1] * size, [0] * size
    for i in range(n):
        for b in hashed(f"w{i}", size):
            raw[b] += 1
            target[b] += 1
    for b in hashed("||", size):
        raw[b] += 40
    want = [round(1e6 * math.log((t + size * r / sum(raw)) / (sum(target) + size) / (r / sum(raw)))) for r, t in zip(raw, target, strict=True)]
    assert sum(target) == n and len(got) == size == 1 << 15 and max(abs(a - b) for a, b in zip(got, want, strict=True)) <= 1


def test_buckets_grow_with_the_corpus(spark, docs, monkeypatch):
    assert [quality.buckets_for(n) for n in (0, 1, 1 << 18, (1 << 18) + 1, 10**7, 10**9)] == [1 << 14, 1 << 14, 1 << 14, 1 << 15, 1 << 20, 1 << 22]
    monkeypatch.setattr(quality, "LEAST_BUCKETS", 1 << 10)
    assert len(quality.weights(docs([(1, "a b")]), spark.createDataFrame([(1,)], "doc_id long"), 1 << 12).first().table) == 1 << 12


def test_verdicts_on_given_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = quality.judge(docs, labels.filter("quality = 1").select("doc_id")).filter("not base_failed").join(labels, "doc_id")
    found = {(r.quality, r.kept): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert found.get((1, False), 0) <= 0.001 * found[1, True]
    assert found[0, False] > 4 * found.get((0, True), 0)
