import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import markdown as M
from quire.plans.edition_queries import _rejections


def one(spark, make, *values):
    names = [f"v{k}" for k in range(len(values))]
    rows = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return rows.select(make(*(F.col(n) for n in names)).alias("out")).first()["out"]


BODY = "# Title\nintro\n\n```py\n# not\n~~~\n```\n\n## One\nx\n### Deep\n~~~~\n## no\n~~~\n## no\n~~~~\n## ⟦ANCHOR:a⟧ Two\ny\n## Three\nz"


def test_headings_outside_fences(spark):
    assert [(h.pos, h.prefix, h.text) for h in one(spark, M.headings, BODY)] == [(8, "## ", "One"), (10, "### ", "Deep"), (16, "## ⟦ANCHOR:a⟧ ", "Two"), (18, "## ", "Three")]
    assert [h.text for h in one(spark, M.headings, "a\n```\n## open to the end")] == []
    assert one(spark, M.headings, "") == []


@pytest.mark.parametrize(
    ("body", "cut"),
    [(BODY, 18), ("# T\n## a\n## b", None), ("# T\n## a\n## b\n## c", 3), ("no title\n# a\n# b\n# c\n## d", 3), ("", None), ("⟦ANCHOR:x⟧ # T\n# a\n# b\n# c", 3), ("# T\n# T\n# b\n# c", 3)],
)
def test_split_top(spark, body, cut):
    assert one(spark, M.opening_length, body) == cut
    parts = one(spark, M.split_top, body)
    lines = body.split("\n")
    assert tuple(parts) == ((body, "") if cut is None else ("\n".join(lines[:cut]), "\n".join(lines[cut:])))


SOURCE = "The gate was\nopen. A cat sat on ⟦PRE-1: x⟧ the mat."


@pytest.mark.parametrize(
    ("old", "new", "quote", "why"),
    [
        ("A dog.", "x", "", "sentence not found once in the opening"),
        ("", "x", "", "sentence not found once in the opening"),
        ("Same.", "x", "", "sentence not found once in the opening"),
        ("head", "x", "", "sentence is structure, not prose"),
        ("cell", "x", "", "sentence is structure, not prose"),
        ("A cat.", "a | b", "", "replacement changes structure"),
        ("A cat.", "a\nb", "", "replacement changes structure"),
        ("A cat.", "x", "not said", "quoted evidence is not in the original"),
        ("A cat.", "x", " gate  was open.", ""),
        ("On ⟦PRE-1: x⟧", "On", None, "replacement drops a ⟦token⟧"),
        ("A cat.", "He delved.", "", "replacement uses a banned word"),
        ("A cat.", "The gates.", "", ""),
        ("A cat.", "", "", ""),
    ],
)
def test_sentence_rejection(spark, old, new, quote, why):
    top = "# T\n\n## head\n| cell |\nA cat. On ⟦PRE-1: x⟧ mats.\nSame. Same."
    assert one(spark, M.rejection, top, SOURCE, old, new, quote) == why


@pytest.mark.parametrize(
    ("old", "new", "quote", "why"),
    [
        ("Four", "x", "A cat sat", "heading not found once"),
        (" One ", "", "A cat sat", "replacement is not a heading"),
        ("One", "# x", "A cat sat", "replacement is not a heading"),
        ("One", "x", "", "quoted evidence is not in the original"),
        ("One", "x", "cat  sat", ""),
        ("One", "Provenance", "cat sat", "replacement uses a banned word"),
    ],
)
def test_heading_rejection(spark, old, new, quote, why):
    assert one(spark, M.heading_rejection, BODY, SOURCE, old, new, quote) == why


def test_fixes_fold(spark):
    body = "# T\n\nA cat sat. It ran. See *One*.\n\n## One\nwords\n\n## Two\nmore\n\n## Three\nend"
    fixes = [("A cat sat.", "A dog sat.", ""), ("A cat sat.", "gone already", ""), ("It ran.", "", ""), ("A dog sat.", "⟦cut", "")]
    heads = [("One", "First", "A cat sat"), ("One", "again", "A cat sat"), ("Three", "Third", "A cat sat")]
    lit = lambda items: F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("old", "new", "quote"), f, strict=True))) for f in items))
    out = one(spark, lambda s, b: M.patched(s, b, lit(fixes), lit(heads)), SOURCE, body)
    assert out.text == body.replace("A cat sat. It ran. See *One*", "A dog sat. See *First*").replace("## One", "## First").replace("## Three", "## Third")
    assert out.applied == 4
    assert list(out.rejected) == ["sentence not found once in the opening", "breaks the body check", "heading not found once"]


def test_section_numbers(spark):
    source = "# 1 T\n⟦ANCHOR:a⟧\n\n## 1.2 One\n⟦ANCHOR:b⟧\n## A.10 Two\n⟦ANCHOR:c⟧\ntext\n```\n## 9.9 no ⟦ANCHOR:z⟧\n```\n## ⟦ANCHOR:d⟧ 1.2.1 Three\n## ⟦ANCHOR:page7⟧ 3.1 Four"
    # a stands above One; b above Two, as a heading follows it; c below Two; d in Three
    assert [tuple(x) for x in one(spark, M.section_numbers, source)] == [("a", "1.2"), ("b", "A.10"), ("c", "A.10"), ("d", "1.2.1")]
    text = "# T\n\n⟦ANCHOR:b⟧\n⟦ANCHOR:a⟧\n## ⟦PRE-1: x⟧ Joined\n⟦ANCHOR:d⟧\nx\n## 2.1 Kept ⟦ANCHOR:c⟧\n## None"
    assert one(spark, M.with_section_numbers, source, text) == text.replace("## ⟦PRE-1: x⟧ Joined", "## ⟦PRE-1: x⟧ 1.2.1, A.10 Joined")
    assert one(spark, M.with_section_numbers, "no numbers", text) == text
    assert one(spark, M.with_section_numbers, source, None) is None


@pytest.mark.parametrize(
    ("make", "values", "want"),
    [
        (T.unescaped_tokens, ("a\\_b ⟦PRE\\_1: \\[x\\]⟧ c\\d ⟦x",), "a\\_b ⟦PRE_1: [x]⟧ c\\d ⟦x"),
        (T.caption_label, (" Figure  2–1 : of",), "figure2–1"),
        (T.caption_label, ("⟦ANCHOR:a⟧listing A-3.",), "listinga-3"),
        (T.caption_label, ("Figures 1-1",), None),
        (T.caption_key, ("Figure 1-1 :\n x ⟦a⟧",), "figure1-1:x"),
        (T.normal, (" A ⟦x⟧  B\n",), "a b"),
        (T.slug, ("  What's New?  ",), "sec-what-s-new"),
        (T.slug, ("§§",), "sec-x"),
        (T.contents_id, ("a/b.html#c_d-é",), "toc-a-b-html-c_d-é"),
        (T.reply, ("\x1b[32m> Hi\x1b[0m\n> there\n▸ Credits: 1 • Time: 2s\n",), "Hi\n> there"),
        (T.has_token, ("a ⟦PRE-1⟧", "PRE", "1"), True),
        (T.has_token, ("a ⟦PRE-10: x⟧", "PRE", "1"), False),
        (T.has_token, ("a ⟦PRE-1: new gist⟧", "PRE", "1"), True),
        (T.caption_like, ("Table 2-1. What it shows", "Table 2-1. The thing"), True),
        (T.caption_like, ("Table 2-1 shows", "Table 2-1. The thing"), False),
        (T.caption_like, ("Table 2-1. " + "long " * 20, "Table 2-1. The thing"), False),
        (T.words_shared, ("a b c a", "b c d e"), 0.5),
        (T.words_shared, ("", "b"), 0.0),
        (T.jaccard, ("a b", "b c"), 1 / 3),
    ],
)
def test_text_functions(spark, make, values, want):
    assert one(spark, make, *values) == want


def test_a_quote_is_held_as_in_flat_texts(spark):
    rows = [
        ("the gate  holds\n\tall", "gate holds all"), ("the gate holds", " the gate "), ("the gate holds", "e gate h"), ("a b", "b a"), ("ab", "a b"), ("a  b", "a b"),
        ("some gate", "gate holds"), ("gate", "the gate"), ("", "x"), ("x", ""), (None, "x"), ("x", None),
    ]
    text, quote = F.col("text"), F.col("quote")
    frame = spark.createDataFrame(rows, "text string, quote string")
    made = frame.select(T.holds(text, quote).alias("held"), F.contains(T.flat(text), T.flat(quote)).alias("want")).collect()
    assert [r.held for r in made] == [r.want for r in made] and [r.held for r in made[:6]] == [True, True, True, False, False, True]


def test_a_chapter_is_searched_for_headings_once(spark):
    rows = spark.createDataFrame([(1, SOURCE, BODY, "not there", "y", "", "One", "Two", "z")], "doc_id long, source string, body string, sentence_old string, sentence_new string, sentence_quote string, heading_old string, heading_new string, heading_quote string")
    plan = _rejections(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("^#+") == 1
    assert _rejections(rows).first().sentence == "sentence not found once in the opening"
