import pytest
from pyspark.sql import functions as F

from quire.operators import anchors as A
from quire.operators import blocks as B

PAGE = "page_id long, url string, html string"


def tokens(spark, html, ids):
    row = A.with_tokens(spark.createDataFrame([(1, html, ids)], "page_id long, html string, ids array<string>")).first()
    return row.html, row.anchors


@pytest.mark.parametrize(
    ("html", "ids", "made", "found"),
    [
        ('<p id="a">x<b id=c>y</b></p>', ["c", "a", "no"], '⟦ANCHOR:a⟧<p id="a">x⟦ANCHOR:c⟧<b id=c>y</b></p>', ["a", "c"]),
        ('<p id="a">x</p><br id=\'a\'/>', ["a"], '⟦ANCHOR:a⟧<p id="a">x</p><br id=\'a\'/>', ["a"]), ('<p>x<img id="z"/>', ["z"], '<p>x⟦ANCHOR:z⟧<img id="z"/>', ["z"]),
        ('<!--<p id="a">--><p id="b">', ["a"], '<!--<p id="a">--><p id="b">', []), ('<p id="a">', [], '<p id="a">', []), ('<p id="a">', None, '<p id="a">', []), (None, ["a"], None, []), ("", ["a"], "", []),
        ('<i id="b"></i><i id="a"></i><i id="b"></i>', ["a", "b"], '⟦ANCHOR:b⟧<i id="b"></i>⟦ANCHOR:a⟧<i id="a"></i><i id="b"></i>', ["b", "a"]),
    ],
)
def test_tokens(spark, html, ids, made, found):
    assert tokens(spark, html, ids) == (made, found)


@pytest.mark.parametrize(
    ("html", "ids", "made", "lost"),
    [
        ("before ⟦ANCHOR:s1⟧ after", ["s1"], 'before <a id="s1"></a> after', []), ("<p>none</p>", ["b", "a"], '<a id="b"></a><a id="a"></a><p>none</p>', ["b", "a"]),
        ("x ⟦ANCHOR:P\\_iv⟧ y", ["P_iv"], 'x <a id="P_iv"></a> y', []), ("⟦ANCHOR:a⟧⟦ANCHOR:b⟧⟦ANCHOR:a⟧⟦PRE-1⟧", ["a"], '<a id="a"></a>⟦ANCHOR:b⟧⟦PRE-1⟧', []), ("⟦ANCHOR:a ⟦ANCHOR:a⟧", ["a"], '⟦ANCHOR:a <a id="a"></a>', []),
        ("", ["a"], '<a id="a"></a>', ["a"]), ("⟦ANCHOR:a⟧", [], "⟦ANCHOR:a⟧", []),
    ],
)
def test_restored(spark, html, ids, made, lost):
    row = spark.createDataFrame([(html, ids)], "html string, ids array<string>").select(A.restored(F.col("html"), F.col("ids")).alias("x")).first().x
    assert (row.html, row.lost) == (made, lost)


def test_protected_by_links_of_other_pages(spark):
    pages = [
        (1, "http://k.example/a", '<p id="x">1</p><p id="y">2</p><a href="#y">'), (2, "http://k.example/b", '<a href="a#x">to a</a><p id="x">'), (3, "http://other.example/a", '<p id="x">'),
        (4, None, '<p id="x">'), (5, "http://k.example/a", None),
    ]
    made = {r.page_id: (r.html, r.anchors) for r in A.protected(spark.createDataFrame(pages, PAGE)).collect()}
    assert made[1] == ('⟦ANCHOR:x⟧<p id="x">1</p>⟦ANCHOR:y⟧<p id="y">2</p><a href="#y">', ["x", "y"])
    assert made[2] == (pages[1][2], []) and made[3] == (pages[2][2], []) and made[4] == (pages[3][2], []) and made[5] == (None, [])
    assert A.protected(spark.createDataFrame([], PAGE)).count() == 0


def test_many_anchors_come_back_where_they_were(spark):
    ids = [f"s{k}" for k in range(2000)]
    html = "".join(f'<p id="{i}">t</p>' for i in ids)
    there, anchors = tokens(spark, html, ids)
    assert anchors == ids
    row = spark.createDataFrame([(there, ids)], "html string, ids array<string>").select(A.restored(F.col("html"), F.col("ids")).alias("x")).first().x
    assert row.lost == [] and row.html == "".join(f'<a id="{i}"></a><p id="{i}">t</p>' for i in ids)


def test_captions_rewritten(spark):
    source = '<p>Table 2-1. A table.</p><figure><figcaption>Listing 3-1: code</figcaption></figure><p>Table 2-1. Another that is long</p>'
    outputs = {
        "<table></table><p>Table 2-1. The table</p>": ["The table"], "<p>Table 2-1. The table</p> x <!-- c --><pre>1</pre>": ["The table"], "<p>Table 2-1. The table</p><i></i><table></table>": [],
        "<div><table></table></div><p>Table 2-1. The table</p>": [], "<table></table><p>Table 2-1 shows it</p>": [], "<pre></pre><p>Listing 3-1: <b>new</b></p>": ["new"],
        "<pre></pre><p>Table 2-1. " + "long " * 20 + "</p>": [], "<pre></pre><p>Table 9-1. Other</p>": [], "": [],
    }
    rows = lambda texts: spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")
    made = B.captions_rewritten(rows([source] * len(outputs)), rows(outputs)).collect()
    assert {r.page_id: r.text.split(" ", 2)[-1] for r in made} == {k: w[0] for k, w in enumerate(outputs.values()) if w}
