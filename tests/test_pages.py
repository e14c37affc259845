import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quire.functions import html as H
from quire.operators import blocks as B
from quire.operators import chapters as C
from quire.operators import links as L
from quire.plans import queries

LONG = "word " * 300
SHAPES = [
    ("<body><h1>Glossary</h1></body>", True, False),
    ("<body><h2> Works  <b>Cited</b></h2></body>", True, False),
    ("<html><body epub:type='bodymatter index'><p>x</p></body></html>", True, False),
    ('<body><div class="wide toc">x</div></body>', True, False),
    ('<body><div class="a">1</div><div class="b">2</div><div class="c">3</div><div class="index">4</div></body>', False, False),
    ("<body><h1>Preface</h1></body>", False, True),
    ("<body><h1>Part IV</h1></body>", False, True),
    ("<body><h1>Partly done</h1></body>", False, False),
    ('<body><section epub:type="appendix">x</section></body>', False, True),
    ('<body><section epub:type="chapter">x</section><h1>Foreword</h1></body>', False, False),
    ("<body><h1>Introduction to Colophons</h1><p>All Rights Reserved</p></body>", False, False),
    ("<body><p>All rights reserved.</p></body>", False, True),
    ("<body><p>All rights <i>reserved</i>.</p></body>", False, False),  # two blanks, once tags are blanks
    (f"<body><p>{'word ' * 1000}all rights reserved</p></body>", False, False),
    (f"<body><h1>A</h1><script>x = 1 < 2;</script><!-- {LONG} --><p>{LONG}</p></body>", False, False),
]


def pages(spark, rows):
    return spark.createDataFrame([(k, f"https://a.example/d/p{k}", h) for k, h in enumerate(rows)], "page_id long, url string, html string")


def test_classification(spark):
    made = C.classified(pages(spark, [s[0] for s in SHAPES])).orderBy("page_id").collect()
    assert [(r.is_reference, r.is_matter) for r in made] == [s[1:] for s in SHAPES]
    assert [r.page_id for r in C.classified(pages(spark, [s[0] for s in SHAPES])).filter(C.selected()).collect()] == [13, 14]


def test_text_and_title(spark):
    html = "<head><title>T</title></head><h2>A <i>b</i>\n c &amp;lt;</h2><p>one</p><p>two&nbsp;x</p>"
    row = pages(spark, [html]).select(H.title(F.col("html")).alias("t"), H.page_text(F.col("html")).alias("x")).first()
    assert row.t == "A b c &lt;"
    assert row.x == "TA b\n c &lt;onetwo\xa0x"


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_places_in_large_groups(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rows = spark.createDataFrame([("a", 2 * k) for k in range(50)] + [("b", 7)], "book string, page_id long")
    made = sorted((r.book, r.page_id, r["index"]) for r in C.ranked(rows, "book", "page_id", "index").collect())
    assert made == [("a", 2 * k, k) for k in range(50)] + [("b", 7, 0)]


def test_links_resolve(spark):
    html = [
        '<a href="p1">',
        "<a class='x' href='../d/./p2#s'><img src=\"/d/p%31\"><a href='https://b.example/'><a href=\"mailto:x@y\">",
        '<link href="gone.css"><p id="t u"><a href="#t%20u"><a href="#gone"><a href="p1#"><a href="nowhere#t u">',
    ]
    made = {(r.page_id, r.ref): (r.target, r.fragment, r.resolves) for r in L.checked(pages(spark, html)).collect()}
    assert made == {
        (0, "p1"): ("/d/p1", "", True),
        (1, "../d/./p2#s"): ("/d/p2", "s", False),
        (1, "/d/p%31"): ("/d/p1", "", True),
        (2, "gone.css"): ("/d/gone.css", "", False),
        (2, "#t%20u"): ("/d/p2", "t u", True),
        (2, "#gone"): ("/d/p2", "gone", False),
        (2, "p1#"): ("/d/p1", "", True),
        (2, "nowhere#t u"): ("/d/nowhere", "t u", False),
    }
    assert [tuple(r) for r in L.referenced(pages(spark, html)).collect()] == [("a.example", "/d/p2", "t u")]
    lost = L.lost(pages(spark, html), pages(spark, html[:2]))
    assert sorted(tuple(r) for r in lost.collect()) == [("a.example", "/d/gone.css"), ("a.example", "/d/nowhere")]


def test_pages_without_an_address(spark):
    rows = [(1, None, "<h1>A</h1><a href='x'>"), (None, "not a url", "<h1>B</h1>"), (3, "https://a.example/c", "<h1>C</h1><a href='d'>"), (4, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted([(r.page_id, r.book, r["index"]) for r in C.scan(frame).collect()], key=str) == sorted([(None, "", 0), (1, "", 1), (4, "", 2), (3, "a.example", 0)], key=str)
    assert L.lost(frame, frame).count() == 0
    assert L.checked(frame).count() == 2


def test_ids_tags_and_jumps(spark):
    before = pages(spark, ["<h1 id='a'>x</h1><h3 id='a'>y</h3><img id=\"b\"><p><img></p><h2>z</h2><h4>w</h4>"])
    after = pages(spark, ["<h1>x</h1><img>"])
    assert [tuple(r) for r in L.duplicate_ids(before).collect()] == [(0, "a", 2)]
    assert {(r.tag, r.before, r.after) for r in L.fewer_tags(before, after).collect()} >= {("img", 2, 1), ("p", 1, 0)}
    assert before.select(H.heading_jumps(F.col("html"))).first()[0] == 2


def test_empty_and_null_pages(spark):
    for rows in ([], [None, ""]):
        frame = pages(spark, rows)
        assert C.summary(C.results(C.classified(frame))).count() <= 1
        assert L.checked(frame).count() == 0
        assert L.tag_counts(frame).count() == 0


def test_contents_classes_and_callouts(spark):
    frame = pages(spark, ['<nav class="x" epub:type="toc landmarks"><style>.a-b{} p.c{}</style><aside epub:type="sidebar"><div class="y Note"><section class="noted">', "<nav><p>"])
    assert [r.is_contents for r in C.classified(frame).orderBy("page_id").collect()] == [True, False]
    assert frame.select(H.style_classes(F.col("html")).alias("c")).first().c == ["a-b", "c"]
    assert [(r.tag, r["class"]) for r in B.callouts(frame).orderBy("pos").collect()] == [("aside", ""), ("div", "y Note")]
    assert [r.inside for r in B.callouts(frame).orderBy("pos").collect()] == [False, True]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_agree_with_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("pages", "documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    made = queries.queries()[name](spark, sf_dir)
    assert sorted(made.columns) == sorted(want.columns)
    rows = [tuple(r) for r in made.select(*want.columns).collect()]
    assert sorted(rows, key=repr) == sorted(want.fetchall(), key=repr)


def test_entry(spark):
    assert {r.status for r in __spark_entry__.entry(spark).collect()} <= {"eligible", "skipped"}


def test_a_filter_does_not_work_out_a_text_again(spark):
    frame = pages(spark, [s[0] for s in SHAPES])
    plan = C.classified(frame).filter(C.selected()).select("page_id", "title")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 2  # the title's words and the text's


def test_a_cache_is_read_from_the_chapters_that_were_classified(spark, tmp_path):
    html = "<h1>T</h1><p>" + "w " * 250 + "</p>"
    rows = [(1, "u", html), (2, "u", html.replace("w", "w w")), (3, "u", "<p>short</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    made = queries.queries()["cache_misses"](spark, str(tmp_path))
    assert [tuple(r) for r in made.collect()] == [(2, "T")]
    assert "pages.parquet" not in str(made.inputFiles())
    excerpt = queries.queries()["primer_excerpts"](spark, str(tmp_path)).orderBy("page_id").first().excerpt
    assert excerpt == "## Chapter 1: T\n(250 words) Tw" + " w" * 119
