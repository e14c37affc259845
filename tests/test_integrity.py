import difflib
import random

import pytest
from pyspark.sql import functions as F

from quire.functions import html as H
from quire.functions import nodes as N
from quire.functions import text as T
from quire.operators import blocks as B
from quire.operators import integrity as I
from quire.operators import results as R

PAGE = (
    '<head><link rel="alternate stylesheet" href="/m.css"><style>.k{} .w{}</style></head><body class="b"><nav><a href="/d/p1#t">One</a></nav><h1 id="t" class="k">T</h1>'
    "<p>text</p><img src='/i.png'><table></table><pre># code</pre><aside class='note'><h5>Note</h5></aside></body>"
)
SCHEMA = "page_id long, url string, ord long, html string"


def edition(spark, pages, order=None):
    rows = [(k, f"https://a.example/d/p{k}", (order or {}).get(k, k), h) for k, h in pages.items()]
    return spark.createDataFrame(rows, SCHEMA)


def told(spark, change, **more):
    source = {0: PAGE, 1: PAGE}
    output = source | {0: change(PAGE)}
    return sorted((r.kind, r.level, r.detail) for r in I.pages_changed(edition(spark, source), edition(spark, output), **more).collect())


@pytest.mark.parametrize(
    ("change", "want"),
    [
        (("", ""), []),
        (('href="/m.css"', 'href="/n.css"'), [("stylesheet link lost", "problem", "/m.css")]),
        (('class="b"', 'class="c"'), [("body attributes changed", "warning", 'class="b" -> class="c"')]),
        (("text</p><img src='/i.png'>", "other</p>"), [("fewer <img>", "problem", "1 -> 0")]),
        (("text</p><img src='/i.png'><table></table>", "other</p><img src='/i.png'>"), [("fewer <table>", "warning", "1 -> 0")]),
        (("text", "⟦PRE-1: long⟧"), [("token left in text", "problem", "⟦PRE-1: long")]),
        (("text", "**bold** `x` ](y)"), [("markdown left in text", "warning", "2 marker(s), e.g. **bold**")]),
        (("text", "<h4>a</h4>"), [("heading levels skip", "warning", "0 -> 1 jumps")]),
        (("text", "<h5 class='x'>a</h5><div class='Tip'><h6>b</h6></div>"), [("heading levels skip", "warning", "0 -> 1 jumps")]),
        (("<p>text", "<p id='t'>other"), [("duplicate ids", "problem", "t")]),
        ((' class="k">T', ">U"), [("styled classes lost", "warning", "k")]),
    ],
)
def test_page_findings(spark, change, want):
    assert told(spark, lambda h: h.replace(*change, 1) if change[0] else h) == want


def test_wrappers(spark):
    bodies = {
        0: "<body><div class='a b'> <!-- x --><DIV id='i'><p>1</p><div>2</div></div></div></body></html>",
        1: "<body><div class='a'>1</div><div>2</div></body>",
        2: "<body>text<div class='a'>1</div></body>",
        3: "<body><section class='s'><p>1</p>tail</section>",
        4: "<body></body>",
        5: "<body><div><div><div><div><div>deep</div></div></div></div></div></body>",
        6: None,
    }
    made = {r.page_id: r.w for r in N.with_tree(edition(spark, bodies)).select("page_id", N.wrappers(F.col("tree")).alias("w")).collect()}
    assert made == {0: ["div.a.b", "div"], 1: [], 2: [], 3: ["section.s"], 4: [], 5: ["div"] * 5, 6: []}
    source = edition(spark, {0: PAGE.replace("<body class=\"b\">", "<body><div class='w x'>").replace("</body>", "</div></body>")})
    output = edition(spark, {0: PAGE.replace("text", "other").replace("<body class=\"b\">", "<body>")})
    assert [(r.kind, r.detail) for r in I.pages_changed(source, output).collect()] == [("styled wrapper lost", "div.w.x")]


def test_well_formed(spark):
    good = "<html><head/><body><p>a &amp; b<br/></p></body></html>"
    assert edition(spark, {0: good, 1: "<p>a<p>b", 2: None, 3: ""}).select(H.ill_formed(F.col("html")).alias("x")).collect() == [(False,), (True,), (False,), (True,)]
    source, output = edition(spark, {0: good, 1: "<p>a<p>b", None: good}), edition(spark, {0: good.replace("</p>", ""), 1: "<p>a<p>b", 2: "<p>new", 3: good, None: good.replace("a &", "b &")})
    made = I.pages_changed(source, output, spark.createDataFrame([], "page_id long")).collect()
    assert sorted(((r.page_id, r.kind) for r in made), key=str) == [(0, "not well-formed XHTML"), (2, "not well-formed XHTML"), (None, "untouched document changed")]


def test_navigation_may_change_untouched(spark):
    nav = "<nav epub:type='toc'>a</nav>"
    none = spark.createDataFrame([], "page_id long")
    assert I.pages_changed(edition(spark, {0: nav}), edition(spark, {0: nav.replace("a<", "b<")}), none).count() == 0


def test_nested_callouts(spark):
    page = "<body><h1>a</h1><aside class='note'><div class='tip'><h3>x</h3></div><h6>y</h6><p>in</p></aside><h2>b</h2><p>out</p></body>"
    frame = edition(spark, {0: page})
    assert N.with_tree(frame).select(N.heading_jumps(F.col("tree")).alias("n")).first().n == 0
    assert [(r.pos, r.text) for r in B.paragraphs(frame).collect()] == [(0, "out")]
    assert [(r.note, r.text) for r in B.notes(frame).collect()] == [(0, "in")]
    assert sorted((r.tag, r.inside) for r in B.callouts(frame).collect()) == [("aside", False), ("div", True)]


def test_contents_have_identifiers_of_their_own(spark):
    page = "<h1>T</h1><h2>X y</h2><p id='sec-x-y-2'></p><h2 id='k'>Z</h2><h3>X, y</h3><h3>X y</h3><h4>deep</h4><h2> </h2><aside class='note'><h2>no</h2></aside><h2>x y 2</h2>"
    made = [(r.grp, r.depth, r.text, r.href) for r in B.contents(edition(spark, {0: page})).orderBy("grp", "pos").collect()]
    assert made == [(1, 1, "X y", "#sec-x-y"), (2, 1, "Z", "#k"), (2, 2, "X, y", "#sec-x-y-3"), (2, 2, "X y", "#sec-x-y-4"), (3, 1, "x y 2", "#sec-x-y-2-2")]
    headed = "<header><h1>T</h1><h2>sub</h2></header><h2>a</h2>"
    assert [r.text for r in B.contents(edition(spark, {0: headed, 1: None, 2: "<h1>only</h1>"})).collect()] == ["a"]


def test_leads_come_back(spark):
    source = edition(spark, {0: "<h2>a</h2><p class='l m'>1</p><h3>b</h3>text<!-- c --><p class='l m'>2</p>"})
    output = edition(spark, {0: "<div><h2>a</h2>\n<P>1</P><p>2</p></div><h4>b</h4><p class=''>3</p><h3>c</h3><p class='own'>4</p><h2>d</h2><p><br/> </p>"})
    assert [(r.lead, r.n, r.sections) for r in B.section_leads(source).collect()] == [("l m", 2, 2)]
    made = B.leads_restored(source, output).collect()
    want = "<div><h2>a</h2>\n<P class=\"l m\">1</P><p>2</p></div><h4>b</h4><p class=\"l m\">3</p><h3>c</h3><p class='own'>4</p><h2>d</h2><p><br/> </p>"
    assert [(r.html, r.restored) for r in made] == [(want, 2)]


@pytest.mark.parametrize("piece", ["<br/>", "<p>", "</p>", "\n", "<p>x</p>", "⟦ANCHOR:a⟧ ", "<!-- -->", "<", "<div class='note'>"])
def test_no_input_kills_a_task(spark, piece):
    text = piece * 100_000
    rows = N.with_tree(edition(spark, {0: text}))
    made = rows.select(
        F.length(H.prose(F.col("html"))).alias("prose"), F.size(N.wrappers(F.col("tree"))).alias("wrappers"), F.length(T.opening_line(F.col("html"))).alias("opening"),
        F.length(T.without_anchors(F.col("html"))).alias("line"), (F.array_join(F.transform("tree", lambda x: x["raw"]), "") == F.col("html")).alias("whole"),
    ).first()
    assert made.whole and made.wrappers == 0 and made.line <= len(text)


def test_untouched_and_rewritten(spark):
    none = spark.createDataFrame([], "page_id long")
    assert told(spark, lambda h: h.replace("text", "other"), rewritten=none) == [("untouched document changed", "warning", "text differs from the source")]
    named = spark.createDataFrame([(1,), (1,), (None,)], "page_id long")
    assert told(spark, lambda h: h.replace("<img src='/i.png'>", ""), rewritten=named) == []
    assert [k for k, *_ in told(spark, lambda h: h.replace("<img src='/i.png'>", ""), rewritten=spark.createDataFrame([(0,)], "page_id long"))] == ["fewer <img>"]


def test_spine(spark):
    source = edition(spark, {k: PAGE for k in range(9)})
    assert I.spine(source, source).count() == 0
    moved = edition(spark, {k: PAGE for k in range(9)}, {3: 70})
    assert [r.detail for r in I.spine(source, moved).collect()] == ["same documents, different order"]
    less = edition(spark, {k: PAGE for k in (8, 20)})
    assert [r.detail for r in I.spine(source, less).collect()] == ["lost [0, 1, 2, 3, 4], added [20]"]


def test_links_and_entries(spark):
    source = edition(spark, {0: PAGE + "<a href='#bad'><a href='p1'>", 1: PAGE, 2: PAGE})
    output = edition(spark, {0: PAGE.replace('id="t"', 'id="u"') + "<a href='#bad'><a href='p1'><a href='p9'>", 2: PAGE.replace("One", "Two")})
    broken = {r.page_id: r.detail for r in I.links_broken(source, output).collect()}
    assert broken[0] == "3: /d/p1#t, p1, p9" and broken[2] == "1: /d/p1#t"
    assert [(r.place, r.detail) for r in I.entries_unresolved(output).collect()] == [("One", "/d/p1#t"), ("Two", "/d/p1#t")]
    lost = I.entries_lost(source, edition(spark, {0: PAGE.replace("One", "Uno"), 1: PAGE.replace("One", "Uno"), 2: PAGE.replace("One", "Uno")}), spark.createDataFrame([(2,)], "page_id long"))
    assert [r.detail for r in lost.collect()] == ["3 of 3 (outside rewritten chapters): One; One; One"]
    assert sorted(r.place for r in I.resources_lost(source, output).collect()) == ["/d/p1"]


def test_summary_and_report(spark):
    source = edition(spark, {k: PAGE for k in range(8)})
    output = edition(spark, {k: PAGE.replace("text", "⟦x⟧") for k in range(7)})
    found = I.verify(source, output)
    line = I.summary(found).first()
    assert (line.problems, line.warnings, line.said, line.failed) == (9, 0, "9 problems, 0 warnings", True)
    lines = [r.line for r in I.report(found).orderBy("nth").collect()]
    assert len(lines) == 6 and lines[-1] == "… 4 more" and lines[0].startswith("problem: resource lost in /d/p7")
    assert I.verify(source, source).count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert I.verify(empty, empty).count() == 0


def test_listings(spark):
    source = edition(spark, {0: "<pre>a b</pre><pre>x</pre><pre> a  b</pre><pre>one two three</pre>", 1: "<pre>q</pre>"})
    output = edition(spark, {0: "<pre>a b</pre><pre>one two four three</pre><pre class='k'>a\nb</pre><pre>x</pre>", 1: "<pre>z</pre><pre>q</pre>"})
    made = {(r.page_id, r.pos): (r.original, r.how) for r in B.matched_listings(source, output).collect()}
    assert made == {(0, 0): (0, "text"), (0, 1): (3, "order"), (0, 2): (2, "text"), (0, 3): (1, "text"), (1, 0): (None, "none"), (1, 1): (0, "text")}


def test_link_classes_and_leads(spark):
    source = edition(spark, {0: "<a class='f' href='x'><a class='g' href='x'><a id='n' class='h'><h2>a</h2><p class='l'>1</p><h3>b</h3> <p class='m'>2</p><h2>c</h2><p class='l'>3</p><h4>d</h4>text"})
    output = edition(spark, {0: "<a href='x'><a href='y'><a id='n'><a class='own' href='x'>"})
    assert sorted((r.pos, r["class"]) for r in B.link_classes(source, output).collect()) == [(0, "f"), (2, "h")]
    assert [(r.lead, r.n, r.sections) for r in B.section_leads(source).collect()] == [("l", 2, 4)]
    assert B.section_leads(edition(spark, {0: "<h2>a</h2><p>1</p><h2>b</h2><p class='l'>2</p>"})).count() == 0


def test_kept_notes(spark):
    note = "Mind the ⟦a⟧ gap between the train and the platform"
    notes = spark.createDataFrame([(0, 0, note), (0, 1, "nothing like it at all"), (1, 0, note)], "page_id long, note int, text string")
    paragraphs = [(0, 3, "MIND the gap between the train and platform"), (0, 4, "mind the gap between the train and platform"), (0, 5, "Mind your head"), (1, 0, "")]
    made = B.kept_notes(notes, spark.createDataFrame(paragraphs, "page_id long, pos int, text string")).collect()
    assert [(r.page_id, r.note, r.pos) for r in made] == [(0, 0, 3)]
    a, b = "mind the gap between the train and the platform", "mind the gap between the train and platform"
    assert abs(made[0].likeness - difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()) < 1e-12


def paragraphs_kept(spark, source, output):
    pages = lambda html: spark.createDataFrame([(0, html)], "page_id long, html string")
    return sorted((r.note, r.pos, round(r.likeness, 3)) for r in B.kept_notes(B.notes(pages(source)), B.paragraphs(pages(output))).collect())


def test_a_note_kept_as_several_paragraphs(spark):
    said = ["Operating as root can be dangerous.", "It is difficult to identify the mistakes.", "The system will let you do anything."]
    block = lambda texts: "".join(f"<p>{x}</p>" for x in texts)
    source = f'<aside class="note"><h2>Note</h2>{block(said)}</aside>'
    edited = ["Operating as root is dangerous.", *said[1:]]
    ratio = difflib.SequenceMatcher(None, " ".join(said).lower(), " ".join(edited).lower(), autojunk=False).ratio()
    assert paragraphs_kept(spark, source, f"<p>Before.</p>{block(edited)}<p>After.</p>") == [(0, k, round(ratio, 3)) for k in (1, 2, 3)]
    assert paragraphs_kept(spark, source, f"<p>{' '.join(said)}</p>") == [(0, 0, 1.0)]
    # One paragraph of a longer note stays prose, and what follows must be beside it.
    assert paragraphs_kept(spark, source, block(said[:1])) == []
    assert paragraphs_kept(spark, source, f"{block(said[:1])}<hr>{block(said[1:2])}<div>{block(said[2:])}</div>") == []


def test_a_note_kept_without_its_label(spark):
    for label in ('<p class="title">What you should know of gaps</p>', '<p><span class="NoteHead">What you should know of gaps</span></p>', "<b>What you should know of gaps</b>"):
        assert paragraphs_kept(spark, f'<div class="tip">{label}<p>Mind the gap.</p></div>', "<p>Mind the gap.</p>") == [(0, 0, 1.0)]


def test_notes_of_pages_with_one_identifier_are_all_kept(spark):
    notes = spark.createDataFrame([(0, 0, "mind the gap"), (0, 0, "stand back")], "page_id long, note int, text string")
    paragraphs = spark.createDataFrame([(0, 0, "mind the gap"), (0, 1, "stand back")], "page_id long, pos int, text string")
    assert sorted((r.pos, r.likeness) for r in B.kept_notes(notes, paragraphs).collect()) == [(0, 1.0), (1, 1.0)]


def test_kept_notes_leaves_out_no_pair_that_is_like(spark):
    """Against all pairs: likeness is 0 below the share of words, whatever letters two texts have in common."""
    words, rnd = "mind the gap gaps minding between a train trains platform of".split(), random.Random(3)
    said = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 9)))
    notes = [(page, k, said()) for page in range(20) for k in range(10)]
    paragraphs = [(page, k, said()) for page in range(20) for k in range(20)]

    def alike(a, b):
        one, other = set(a.split()), set(b.split())
        return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() if len(one & other) / len(one | other) >= 0.4 else 0.0

    best = {(p, n): max((alike(a, b), -k) for q, k, b in paragraphs if q == p) for p, n, a in notes}
    made = B.kept_notes(spark.createDataFrame(notes, "page_id long, note int, text string"), spark.createDataFrame(paragraphs, "page_id long, pos int, text string"))
    assert {(r.page_id, r.note): (r.likeness, -r.pos) for r in made.collect()} == {k: x for k, x in best.items() if x[0] >= 0.7}


def test_run(spark):
    long = "# T\n" + "w " * 300
    rows = [(1, long, long), (2, long, long), (3, long, "# T\nshort"), (4, "# T", "# T"), (5, long, None), (6, long, long)]
    chapters = spark.createDataFrame(rows, "doc_id long, source string, body string")
    cache = spark.createDataFrame([(1, long), (2, "# T\nbad"), (5, "# T\nbad"), (6, None)], "doc_id long, cached string")
    made = {r.doc_id: (r.status, r.words_out, r.detail) for r in R.resumed(chapters, cache).collect()}
    assert made == {
        1: ("cached", 302, ""), 2: ("rewritten", 302, ""), 3: ("failed", 0, "body is 1% of the chapter"), 4: ("skipped", 0, ""),
        5: ("failed", 0, "body does not open with the chapter title"), 6: ("rewritten", 302, ""),
    }
    again = {r.doc_id: (r.status, r.detail) for r in R.resumed(chapters, cache, rebuild=True).collect()}
    assert again[1] == ("cached", "") and again[2] == ("failed", "body is 1% of the chapter") and again[6] == ("failed", "no cached text")
    total = {r.status: (r.chapters, r.words_in, r.words_out, r.ratio) for r in R.run_summary(R.resumed(chapters, cache)).collect()}
    assert total["words"] == (3, 906, 906, "100%") and total["failed"][0] == 2
    assert R.run_summary(R.resumed(chapters.limit(0), cache)).count() == 0


def test_a_note_meets_paragraphs_without_its_page(spark):
    html = '<body><aside class="note"><h5>Note</h5><p>Mind the gap.</p></aside><p>Mind the big gap.</p><p>Far.</p></body>'
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    made = B.note_candidates(pages, pages)
    assert [(r.note, r.pos, r.shared) for r in made.collect()] == [(0, 0, 0.75)]
    exploded = [line for line in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate posexplode" in line]
    assert exploded and all("tree" not in line.split("[page_id")[-1] for line in exploded)


def test_a_run_joins_texts_by_a_shuffle_and_counts_words_once(spark):
    rows = spark.createDataFrame([(1, "# A\n" + "a " * 300, "# A\n" + "b " * 250)], "doc_id long, source string, body string")
    made = R.resumed(rows, rows.select("doc_id", F.col("body").alias("cached")))
    query = made._jdf.queryExecution()
    assert "BroadcastHashJoin" not in query.executedPlan().toString()
    assert query.optimizedPlan().toString().count("translate(") == 3
    assert [tuple(r) for r in made.collect()] == [(1, "cached", 302, 252, "")]


def test_an_outline_is_what_the_tree_tells_and_pages_stay_in_the_jvm(spark):
    bodies = [
        "<body><div class='a b'> <!-- x --><DIV id='i'><p>1</p><div>2</div></div></div></body></html>",
        "<body class='z'><section><div class=\"k\">in</div></section></body><h2>after</h2><h4>more</h4>",
        "<body><div><div>open<h1>a</h1><aside class='note'><h6>b</h6></aside><h3/>",
        "<body/><div class='a'>x</div>", "<body>text<div class='a'>1</div></body>", "<h1>a</h1><H3>b</H3></div></body><body><div>",
        "<body><div class='a'><body><div class='b'>x</div></body></div></body>", "<div><body><p class='q'></p></body></div>", "<body><br class='v'/></body>", "", None,
    ]
    pages = edition(spark, dict(enumerate(bodies)))
    tree, outline = F.col("tree"), F.col("o")
    want = {r.page_id: (r.w, r.j) for r in N.with_tree(pages).select("page_id", N.wrappers(tree).alias("w"), N.heading_jumps(tree).alias("j")).collect()}
    rows = pages.withColumn("o", N.outline(F.col("html")))
    made = rows.select("page_id", F.coalesce(N.named_wrappers(outline["wrappers"]), F.array().cast("array<string>")).alias("w"), N.jumps(outline["levels"]).alias("j"))
    assert {r.page_id: (r.w, r.j) for r in made.collect()} == want
    assert want[0][0] == ["div.a.b", "div"] and want[2][1] == 1
    plan = I.features(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" in plan


def test_prose_and_counts_as_pass_by_pass(spark):
    bodies = [
        "<BODY\nclass='x'>a<Pre>b</PRE >c\n\n<b>d</b>\n<CODE>e <pre>f</code> g</pre> h</code> &amp;lt; <!-- <pre> -->i</pre>",
        "<code>a<code>b</code>c</code><script>'</pre>'<pre></script>d<style>e</style\n>f", "<p>x<body>y<body >z", "no tags < here\n\n\n\n> or < there", "<bodyx>a</bodyx>", "x\U0001f600<body>y", "", None,
        "<!-- <img> --><IMG/><img\n><svg><table><pre ><figures><script><math></script><math>",
    ]
    html = F.col("html")
    whole = F.when(F.regexp_extract(html, H.BODY, 0) != "", F.regexp_extract(html, H.BODY, 0)).otherwise(html)
    want = F.regexp_replace(whole, H.COMMENT, "")
    for pattern in H.UNPROSE:
        want = F.regexp_replace(want, pattern, "\n")
    want = H.unescape(F.regexp_replace(F.regexp_replace(want, H.TAG, "\n"), r"\n+", "\n"))
    counts = lambda t: F.array_size(F.filter(H.content_tags(html), lambda x: x == t))
    rows = edition(spark, dict(enumerate(bodies))).select(
        H.prose(html).eqNullSafe(want).alias("prose"), *(counts(t).eqNullSafe(H.tag_count(html, t)).alias(t) for t in H.CONTENT)
    )
    assert [set(r) for r in rows.collect()] == [{True}] * len(bodies)


def test_leads_come_back_as_by_the_tree(spark):
    bodies = [
        "<h2>a</h2><p>1</p><h3>b</h3><p class=''>&nbsp; <b>&am</b>p;</p><h4>c</h4><P  id='x'>&nb<i>sp;</i></P><h2>d</h2><p class='own'>x</p>",
        "<div><h2>a</h2><!-- c --><p><h3>b</h3><p>open<h4>c</h4><p>end", "<h2>a</h2><p/><h3>b</h3>text<p>1</p>", "<h2>a</h2><p>\U0001f600</p>é<h3>b</h3><p> <br/></p>",
        "<h5>a</h5><p>1</p>", "<h2>a</h2><p class=\"\">q<p>r</p></p>", "<p>&</p>", "", None,
    ]
    output = edition(spark, dict(enumerate(bodies)))
    source = edition(spark, dict.fromkeys(range(len(bodies)), "<h2>a</h2><p class='l m'>1</p>"))
    want = {}
    for r in N.with_tree(output).select("page_id", "tree").collect():
        heads = [x.pre for x in r.tree or [] if x.tag in ("h2", "h3", "h4")]
        chosen = set()
        for x in r.tree or []:
            said = "".join(y.raw for y in r.tree[x.i + 1 : (x.until or 0) + 1] if y.kind == N.TEXT)
            for name, sign in H.ENTITIES:
                said = said.replace(name, sign)
            if x.tag == "p" and x.after in heads and "own" not in x.raw and x.last > x.pre and said.strip():
                chosen.add(x.i)
        if chosen:
            start = lambda raw: raw[:2] + ' class="l m"' + raw[2:].replace(" class=''", "").replace(' class=""', "")
            want[r.page_id] = ("".join(start(x.raw) if x.i in chosen else x.raw for x in r.tree), len(chosen))
    made = B.leads_restored(source, output)
    assert {r.page_id: (r.html, r.restored) for r in made.collect()} == want and len(want) == 5
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and "MapInArrow" not in plan
