import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from quire.llm import secret_scan as ss

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    out = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end(), m[2]))
    out += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def brute(rows):
    """rows: (doc_id, text, owner, repository)."""
    owners, repos, known, runs = defaultdict(set), defaultdict(set), set(), []
    for i, t, o, repo in rows:
        t = t or ""
        found = base(t)
        more = [(m.start(), 3, m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
        for *_, v in found + more:
            owners[v].add(o or "")
            repos[v].add(repo or "")
        known |= {v for *_, v in found}
        runs.append((i, found, more))

    def verdict(v):
        if len(owners[v]) >= 3 or len(repos[v]) >= 8:
            return "copied"
        return "live" if len(owners[v]) == 1 and len(repos[v]) <= 2 else "shared"

    out = []
    for i, found, more in runs:
        added = []
        for s, k, e, v in more:
            if any(a < e and s < b for a, _, b, _ in found) or verdict(v) == "copied":
                continue
            mixed = re.search("[a-z]", v) and re.search("[A-Z]", v) and re.search("[0-9]", v) or re.fullmatch("[0-9A-F]{32,}", v)
            if v in known or mixed and verdict(v) == "live":
                added.append((s, k, e, v))

        def text_of(places):
            return ",".join(f"{ss.KINDS[k]}:{s}:{e}" for s, k, e, _ in sorted(places))

        out.append((i, *(sum(k == n for _, k, _, _ in found) for n in range(3)), hashlib.sha256(text_of(found).encode()).hexdigest(), text_of(found + added), *([verdict(v) for *_, v in found + added].count(x) for x in ("live", "shared", "copied"))))
    return sorted(out, key=str)


def got(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, source string, place string, kind int, digest string, key string")
    return sorted([tuple(r) for r in ss.scan(docs, F.col("source"), F.col("place")).collect()], key=str)


def test_random_texts_against_brute_force(spark):
    rng = random.Random(3)
    pieces = [
        "token", "Token", "API_KEY", "apikey", "secret", "passwd", "=", ": ", '"', "'", " ", "  ", "\n", "é😀", "AKIA", "AKIAABCDEFGHIJ1234", "abc", "0123456789abcdef",
        "DEADBEEF" * 4, "Zx9" * 8, "short", "a.b-c/d+e_f=", "token=password=abcdefgh1234", "deadbeefdeadbeef00", "the", "q1w2e3r4t5y6u7i8o9p0q1",
    ]
    rows = [(n, "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 40))), f"o{rng.randrange(5)}", f"r{rng.randrange(12)}") for n in range(150)]
    rows += [(500, None, "a", "r1"), (501, "", None, None), (502, 'x token = "' + "Ab1" * 4000 + '"', "a", None), (503, "ff " * 3 + "0a" * 30000, "b", "r2")]
    assert got(spark, rows) == brute(rows)


def test_ownership_separates_copied_values(spark):
    value = "abcDEF0123456789abcdXYZ"
    rows = [(n, f"key {value} here", f"o{n}", "r") for n in range(3)] + [(9, "mine ZZ9plural8ZalphaQ77xx", "o1", "r")]
    rows += [(20, "token = Qq11Ww22Ee33Rr44Tt55", "o1", "r"), (21, "seen bare Qq11Ww22Ee33Rr44Tt55", "o2", "r")]
    spans = {r[0]: r[5] for r in got(spark, rows)}
    assert spans == {0: "", 1: "", 2: "", 9: "opaque:5:26", 20: "assign:0:28", 21: "opaque:10:30"}
    assert got(spark, rows) == brute(rows)


def test_repositories_separate_the_values_of_one_owner(spark):
    wide, narrow = "Wide5wide5wide5wide5WW", "Nrow7nrow7nrow7nrow7NN"
    rows = [(n, f"an example {wide}", "o1", f"r{n}") for n in range(8)] + [(20 + n, f"mine {narrow}", "o1", "r1") for n in range(8)]
    out = got(spark, rows)
    assert {r[0]: r[5] for r in out} == {n: "" for n in range(8)} | {20 + n: "opaque:5:27" for n in range(8)}
    assert out == brute(rows)


def test_repeats_and_empty(spark):
    rows = [(1, "token = abcdefabcdef", "a", "r")] * 2 + [(None, "token = abcdefabcdef", None, None)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_redact(spark, docs):
    rows = [(1, 'é token = "abcdefabcdef" end AKIAABCDEFGHIJKLMN'), (2, "clean"), (3, None), (4, "ab cdefabcdefabcdef0 and 0123456789abcdef0")]
    data = docs(rows)
    out = ss.redact(data, F.col("source"), F.col("source"))
    assert out.columns == data.columns
    found = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert found[1] == ("é [secret]\" end [secret]", 24) and found[2] == ("clean", 5)
    assert found[3] == (None, 0) and found[4] == ("ab [secret] and [secret]", 24)


def test_redact_keeps_rows_of_one_id_apart(spark):
    rows = [(1, "token = abcdefabcdef end"), (1, "other words = follow and 0123456789abcdef0"), (None, "AKIAABCDEFGHIJKLMN"), (None, "x 0123456789abcdef0"), (1, "token = abcdefabcdef end")]
    data = spark.createDataFrame([(*r, "s", 1, "k") for r in rows], "doc_id long, text string, source string, own_spans int, own_key string")
    out = ss.redact(data, F.col("source"), F.col("source"))
    assert out.columns == data.columns
    want = [(1, "[secret] end"), (1, "[secret] end"), (1, "other words = follow and [secret]"), (None, "[secret]"), (None, "x [secret]")]
    assert sorted([tuple(r)[:2] for r in out.collect()], key=str) == sorted(want, key=str)
