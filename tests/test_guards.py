import random
import re

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import guards as G


def one(spark, make, *values):
    names = [f"v{k}" for k in range(len(values))]
    rows = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return rows.select(make(*(F.col(n) for n in names)).alias("out")).first()["out"]


@pytest.mark.parametrize("text", ["", " ", "a", "a b c d", "\n x \x1c y\n", "uno\ttwo\x0bthree ", "​ a"])
def test_words_are_pythons(spark, text):
    assert one(spark, T.word_count, text) == len(text.split())
    assert one(spark, T.flat, text) == " ".join(text.split())
    assert one(spark, T.strip, text) == text.strip()


@pytest.mark.parametrize(
    ("text", "open_"), [("a ⟦PRE-1: x⟧ b", False), ("a ⟦PRE-1: x", True), ("⟦A ⟦B⟧", True), ("x\n⟦A\n", True), ("", False)]
)
def test_unclosed_token(spark, text, open_):
    assert one(spark, T.unclosed_token, text) is open_


@pytest.mark.parametrize(
    ("text", "opening"),
    [("\n  \n⟦ANCHOR:a⟧ ⟦ANCHOR:b⟧\n⟦ANCHOR:c⟧ # Name\nrest", "# Name"), ("", ""), (" line", "line"), ("⟦ANCHOR:a⟧", "")],
)
def test_opening_line(spark, text, opening):
    assert one(spark, T.opening_line, text) == opening


@pytest.mark.parametrize(
    ("source", "body", "problem"),
    [
        ("# A\n" + "w " * 10, "no title " * 10, "body does not open with the chapter title"),
        ("⟦TITLE-0: A⟧\n" + "w " * 10, "# A\n" + "w " * 10, ""),
        ("w " * 10, "w " * 9 + "⟦PRE-1: cut", "body cut off inside a ⟦token⟧"),
        ("w " * 10, "w " * 9 + "\n\n  ## End\n \n", "body ends on a bare heading"),
        ("w " * 8, "w", "body is 12% of the chapter"),
        ("w " * 100, "w " * 35, ""),
        ("", "", "body is 0% of the chapter"),
    ],
)
def test_body_problem(spark, source, body, problem):
    assert one(spark, G.body_problem, source, body) == problem


@pytest.mark.parametrize(("words_in", "words_out", "ok"), [(100, 4, False), (100, 5, True), (100, 50, True), (100, 150, True), (100, 151, False), (0, 1, True)])
def test_sane(spark, words_in, words_out, ok):
    assert one(spark, G.sane, "w " * words_in, "w " * words_out) is ok


BASE = "# T\n\nSome words with a [link](a.html) here ⟦PRE-1: x⟧.\n\n## Part\n\n| a | b |\n\n```\ncode # no\n```\n" + "more words " * 10


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        (("", ""), ""),
        (("⟦PRE-1: x⟧", ""), "⟦tokens⟧ changed"),
        (("## Part", "## Other"), "headings changed"),
        (("code # no", "code # yes"), "code changed"),
        (("| a | b |", "| a | c |"), "tables changed"),
        (("(a.html)", "(b.html)"), "a link was dropped"),
        (("more words more", "more delving more"), "banned word"),
        (("more words " * 10, "more words " * 3), "length 67% of the body"),
    ],
)
def test_revision_problem(spark, change, problem):
    assert one(spark, G.revision_problem, BASE, BASE, BASE.replace(*change, 1) if change[0] else BASE) == problem


def test_banned_spares_the_sources_own_words(spark):
    assert one(spark, T.banned, "a Gate", "gates, provenance; delve") == ["provenance", "delve"]
    assert one(spark, T.banned, "", "agate delvex über_gate") == []


@pytest.mark.parametrize(
    ("source", "cached", "kept"),
    [
        ("x", "# A\n\ntext\n\n## Key points\n- a\n", "# A\n\ntext"),
        ("# Key points\n", "# A\n\ntext\n\n## Key points\n- a", "# A\n\ntext\n\n## Key points\n- a"),
        ("x", "# A\ntext\n## Key points\n- a\n## More\nb", "# A\ntext\n## Key points\n- a\n## More\nb"),
        ("x", "# A\n\n# A\ntext", "# A\ntext"),
        ("x", "# A\n## Key points\na\n## Check yourself\nb\n# c", "# A"),
    ],
)
def test_upgraded(spark, source, cached, kept):
    assert one(spark, G.upgraded, source, cached) == kept


def test_shown_measures(spark):
    def shown(make, value):
        return spark.range(1).select(make(F.lit(value)).alias("out")).first()["out"]

    assert [shown(T.human_time, s) for s in (9, 61, 3720)] == ["9s", "1m01s", "1h02m"]
    assert [shown(T.human_size, s) for s in (12, 1280, 1536, 1792, 3 << 20, 5 << 30)] == ["12 B", "1.2 KB", "1.5 KB", "1.8 KB", "3.0 MB", "5.0 GB"]
    assert [shown(T.percent, s) for s in (0.125, 0.135, 0.7)] == ["12%", "14%", "70%"]


def test_turns_pair_each_role(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", None), (2, 0, "assistant", "c"), (None, 1, "assistant", "d")]
    made = G.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in made] == [(1, 1, "b", "")]


def test_first_and_last_lines_are_pythons(spark):
    rng = random.Random(7)
    parts = ["a", "#", " ", "\n", "\r\n", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\u2028", "\xa0", "⟦ANCHOR:x⟧", "⟦ANCHOR:", "⟧", "⟦PRE-1⟧", "b c"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(1500)]
    anchors = re.compile(r"^(?:⟦ANCHOR:[^⟧]*⟧\s*)+")
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    for r in rows.select("n", T.opening_line(F.col("t")).alias("a"), T.last_line(F.col("t")).alias("b")).collect():
        lines = [x for x in texts[r.n].splitlines() if x.strip()]
        assert r.a == next((s for x in lines if (s := anchors.sub("", x.strip()))), ""), repr(texts[r.n])
        assert r.b == (lines[-1].rstrip() if lines else ""), repr(texts[r.n])
    assert rows.limit(1).select(T.opening_line(F.lit(None).cast("string")).alias("a"), T.last_line(F.lit(None).cast("string")).alias("b")).first() == ("", "")


def test_words_are_counted_without_a_pattern(spark):
    texts = ["", " ", "a", " a  b c　", "\n\x1cé\x85ß  x", "\U0001f600 y\t"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(9, None)], "k int, t string")
    made = rows.select("k", T.word_count(F.col("t")).alias("n"), T.strip(F.col("t")).alias("s"), T.flat(F.col("t")).alias("f"), T.words(F.col("t")).alias("w"))
    plan = rows.select(T.word_count(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "x{2000}" not in plan
    found = {r.k: r for r in made.collect()}
    for k, t in enumerate(texts):
        assert (found[k].n, found[k].s, found[k].f, found[k].w) == (len(t.split()), t.strip(), " ".join(t.split()), t.split())
    assert found[9].n is None and found[9].s is None


def test_an_upgrade_works_out_a_text_once(spark):
    rows = spark.createDataFrame([("s", "c")], "source string, cached string")
    plan = rows.select(G.upgraded(F.col("source"), F.col("cached")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Check yourself") == 1
