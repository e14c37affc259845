import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import contents as K

SCHEMA = "page_id long, url string, html string"
TOC = (
    '<nav epub:type="toc"><ol><li><a href="a.x">Part</a><ol><li class="c d"><a href="a.x#1">A</a></li><li><a href="b.x">B</a></li></ol></li>'
    '<li><a href="b.x">B again</a><ol><li class="s"><a href="./b.x#2">B two</a><span><a href="b.x#3">deep</a></span></li></ol></li><li><a href="b.x#9">Later</a></li>'
    '<li><a href="http://else.example/t/b.x">Out</a></li><li>none</li></ol></nav><nav epub:type="page-list"><ol><li><a href="b.x#p">1</a></li><li><a href="c.x#p">2</a></li></ol></nav>'
)


def frame(spark, *htmls):
    return spark.createDataFrame([(k, "https://k.example/t/nav.x", h) for k, h in enumerate(htmls)], SCHEMA)


def test_entries_and_what_lies_under_them(spark):
    rows = K.entries(frame(spark, TOC, None, "", "<ol><li><a href='x'>no nav</a></li></ol>")).orderBy("pre").collect()
    assert [(r.label, r.target, r.sole) for r in rows] == [
        ("Part", "/t/a.x", False), ("A", "/t/a.x", True), ("B", "/t/b.x", True), ("B again", "/t/b.x", True), ("B two", "/t/b.x", True),
        ("Later", "/t/b.x", True), ("Out", None, False), ("1", "/t/b.x", True), ("2", "/t/c.x", True),
    ]
    mixed = "<nav epub:type='toc'><ol><li><b><a href='q'>q</a></b><a href='p'>p</a><ol><li><a href='p#1'>1</a></li></ol></li><li><a href='p'>2</a><i><a href='q'>q</a></i></li></ol></nav>"
    assert [(r.label, r.sole) for r in K.entries(frame(spark, mixed)).orderBy("pre").collect()] == [("p", False), ("1", True), ("2", False)]


def test_rebuilt(spark):
    heads = [("k.example", "/t/b.x", 0, 1, "h", "New"), ("k.example", "/t/b.x", 1, 2, "i", "Sub"), ("k.example", "/t/c.x", None, None, None, None), ("other", "/t/a.x", 0, 1, "z", "Z")]
    headings = spark.createDataFrame(heads, "book string, path string, nth int, level int, id string, text string")
    made = K.rebuilt(frame(spark, TOC), headings).orderBy("pre", "nth").collect()
    assert [(r.label, r.href, r["class"]) for r in made] == [
        ("Part", "a.x", ""), ("A", "a.x#1", "c d"), ("B", "b.x", ""), ("New", "b.x#h", ""), ("Sub", "b.x#i", ""),
        ("B again", "b.x", ""), ("B two", "./b.x#2", "s"), ("Later", "b.x#9", ""), ("Out", "http://else.example/t/b.x", ""),
    ]
    depth = {r.label: r.depth for r in made}
    assert depth["New"] == depth["B"] + 2 and depth["Sub"] == depth["B"] + 4
    again = K.rebuilt(frame(spark, TOC.replace('<li><a href="b.x">B</a></li>', "")), headings).orderBy("pre", "nth").collect()
    assert [(r.label, r["class"]) for r in again] == [("Part", ""), ("A", "c d"), ("B again", ""), ("New", "s"), ("Sub", "s"), ("Later", ""), ("Out", "")]
    assert K.rebuilt(frame(spark, TOC), headings.limit(0)).count() == 9
    assert K.rebuilt(frame(spark, TOC).limit(0), headings).count() == 0


def joined(first, second):
    tail = max(len(first) - T.OVERLAP, 0)
    for start in ([] if tail else [0]) + [k + 1 for k in range(tail, len(first)) if first[k] == "\n"]:
        if second.startswith(first[start:]):
            return first[:start] + second
    return first + second


@pytest.mark.parametrize(
    ("first", "second"),
    [
        ("a\nb\nc", "b\nc d"), ("a\nb\nc", "c"), ("a\nb\nc", "a\nb\ncd"), ("a\nb\n", "x"), ("ab", "b"), ("", "x"), ("x", ""), ("\n\n", "\n\n"), ("a\na\na", "a\na"),
        ("x" * 5000, "x" * 5000), ("x" * 5000 + "\nend", "end."), ("k\n" * 1999 + "q\nz", "k\n" * 1999 + "q\nz!"), ("k\n" * 3000, "k\nk\n"), ("é\n𝄞b", "𝄞b c"),
    ],
)
def test_continued(spark, first, second):
    rows = spark.createDataFrame([(first, second)], "a string, b string")
    assert rows.select(T.continued(F.col("a"), F.col("b"))).first()[0] == joined(first, second)


def test_navigation_is_read_once(spark):
    """The rows of two pages in one round are each page's own, and no step reads the pages' tags again."""
    rows = K.entries(frame(spark, TOC))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    twice = K.entries(frame(spark, TOC, None, TOC)).drop("book")
    one, other = (twice.filter(F.col("page_id") == k).drop("page_id") for k in (0, 2))
    assert one.count() == 9 and one.exceptAll(other).count() == 0
    made = K.rebuilt(frame(spark, TOC), spark.createDataFrame([("k.example", "/t/b.x", 0, 1, "h", "New")], "book string, path string, nth int, level int, id string, text string"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 0
