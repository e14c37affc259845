"""Two editions of the pages, and Markdown chapters from the documents, in which every rule finds something.

The given pages have no identifiers, fragments, figures or callouts, and the documents no headings, fences or tokens. The
rules here add them by the row's number, so that a share of rows breaks each rule. They are written in the SQL that Spark and
DuckDB share, and both sides of a query's comparison start from the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages to a book, by the remainder of page_id; one page in so many has no address.
BOOKS, LOST_ADDRESS = 6, 23

_EXTRA = f"""concat(
    '<h2 id="more">1.2 More</h2><p class="lead">First.</p><h3 id="less">Less</h3><p class="lead">Second one.</p><h3>Last</h3><p class="lead">Third.</p><h3>Last!</h3>and<p id="sec-last-2">more</p><h2>Beyond</h2><!-- so --><p>Fourth.</p>',
    '<figure><img src="/img/', page_id % 7, '.png" alt="x"/><figcaption>Figure 1-', page_id % 4, ': what it shows</figcaption></figure>',
    '<table><tr><td>1</td></tr></table><p>Table 2-1. A table.</p><pre>run  it ', page_id % 3, '</pre><pre>run it ', page_id % 3, '</pre><pre>stop now or never &lt;', page_id, '&gt;</pre>',
    '<aside class="note"><h5>Note</h5><p>Mind the gap.</p></aside>',
    '<div class="box wide"><div class="tip"><h2>Tip</h2><p>Inner one.</p></div><h6>Deep</h6><p>Outer one.</p></div>',
    '<p><a class="xref" href="#more">up</a><a href="#gone">gone</a><a class="next" href="/p/', page_id + {BOOKS}, '#top">next</a><a id="mark', page_id % 5, '" class="mark"></a></p>')"""
_BODY = """CASE page_id % 13 WHEN 0 THEN '<body epub:type="index">' WHEN 1 THEN '<body epub:type="frontmatter">' WHEN 2 THEN '<body class="b" lang="en"><div class="toc">toc</div>'
    WHEN 3 THEN '<body><section epub:type="chapter">part</section>' WHEN 4 THEN '<body><div class="copyright">(c)</div>' ELSE '<body class="b" lang="en"><div class="wrap"><section class="inner"><div><div class="third"><div class="fourth"><div class="fifth">' END"""
_BODY_END = "CASE WHEN page_id % 13 > 4 THEN '</div></div></div></div></section></div></body>' ELSE '</body>' END"
_TITLE = """CASE page_id % 11 WHEN 0 THEN '<h1 id="top" class="title">Index</h1><h1>' WHEN 1 THEN '<h1 id="top" class="title">Preface to it</h1><h1>' ELSE '<h1 id="top" class="title">' END"""

URL = f"CASE WHEN page_id % {LOST_ADDRESS} = 7 THEN NULL ELSE concat('https://book', page_id % {BOOKS}, '.example/p/', page_id) END"
_NAV = f"""concat(CASE page_id % 41 WHEN 5 THEN '<nav epub:type="toc">' ELSE '<nav>' END, '<a href="/p/', page_id + {BOOKS}, '#top">Next</a>')"""
SOURCE = f"""replace(replace(replace(replace(replace(replace(html, '<nav>', {_NAV}), '</body>', {_BODY_END}),
    '<head>', '<head><link rel="stylesheet" href="/css/main.css"/><style>.note{{}} .lead{{}} .title{{}} .xref{{}} .wrap{{}} .inner{{}} .fifth{{}}</style>'),
    '<body>', {_BODY}), '<h1>', {_TITLE}), '</article>', concat({_EXTRA}, '</article>'))"""
OUTPUT = """CASE page_id % 10
    WHEN 1 THEN replace(html, concat('<figure><img src="/img/', page_id % 7, '.png" alt="x"/>'), '<figure>')
    WHEN 2 THEN replace(html, '</article>', '<p>⟦PRE-1: x⟧ rest</p></article>')
    WHEN 3 THEN replace(html, '</article>', concat('<p>', chr(10), '## Left **bold** text [a](b)</p></article>'))
    WHEN 4 THEN replace(replace(replace(html, '<section class="inner">', '<section>'), '<h3 id="less">Less</h3>', '<h5 id="less">Less</h5>'), '<p class="lead">First', '<p>Changed')
    WHEN 5 THEN replace(replace(html, 'id="more"', 'id="top"'), '1.2 More', 'More')
    WHEN 0 THEN replace(html, 'now or never', 'now and never')
    WHEN 6 THEN replace(replace(html, '<body', '<body data-x="1"'), '<pre>stop now or never', '<pre>gone')
    WHEN 7 THEN replace(replace(replace(html, '<link rel="stylesheet" href="/css/main.css"/>', ''), '<div class="fifth">', '<div>'), '<p class="lead">Third.</p>', '<p>The third</p>')
    WHEN 8 THEN replace(replace(replace(replace(html, '<aside class="note"><h5>Note</h5><p>Mind the gap.</p></aside>', '<p>Mind the big gap.</p>'), ' class="lead"', ''), ' class="xref"', ''), 'Second one', 'Second')
    WHEN 9 THEN replace(replace(html, '<li><a href="', '<li><a href="/lost'), '><a href="/p/', '><a href="/q/')
    ELSE html END"""
#: Pages that the output lacks, and its order.
KEPT = "page_id % 17 <> 3"
ORDER = "CASE WHEN page_id % 29 = 4 THEN page_id - 100 ELSE page_id END"

SOURCE_SQL = f"source AS (SELECT page_id, {URL} AS url, page_id AS ord, {SOURCE} AS html FROM pages)"
OUTPUT_SQL = f"output AS (SELECT page_id, url, {ORDER} AS ord, {OUTPUT} AS html FROM source WHERE {KEPT})"


#: Contents and page lists of which a third of the pages were rewritten: entries into one page, parts of several, later entries.
NAVIGATION = f"""concat('<html><body><nav epub:type="toc landmarks"><h1>Contents</h1><ol>',
    '<li class="part"><a href="/p/', page_id, '">Part</a><ol class="inner"><li class="chapter"><a href="/p/', page_id, '#top">One</a></li><li><a href="/p/', page_id + {BOOKS}, '">Two</a><ol><li><span><a href="', page_id + {BOOKS}, '#more">Two one</a></span></li></ol></li></ol></li>',
    '<li><a href="/p/', page_id, '">Again</a><ol><li class="sub"><a href="', page_id, '#less">Deep</a><ol><li class="low"><a href="/p/./', page_id, '#last">Deeper</a></li></ol></li></ol></li>',
    '<li><a href="/p/', page_id, '#end">Later</a></li><li><a href="https://else.example/p/', page_id, '">Out</a></li>',
    CASE WHEN page_id % 4 = 0 THEN concat('<li><a href="/p/', page_id + {2 * BOOKS}, '">Next</a></li>') ELSE '' END,
    '</ol></nav><nav epub:type="page-list"><ol><li><a href="/p/', page_id, '#p1">1</a></li><li><a href="/p/', page_id + {BOOKS}, '#p2">2</a></li></ol></nav></body></html>')"""
REWRITTEN = "page_id % 3 = 0"
NAVIGATION_SQL = f"navigation AS (SELECT page_id, {URL} AS url, {NAVIGATION} AS html FROM pages)"


def navigation(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.expr(URL).alias("url"), F.expr(NAVIGATION).alias("html"))


#: Blocks in styled wrappers, and what a rewrite made of them: wrappers gone, texts edited, identifiers kept.
WRAPPED = """replace(html, '</article>', concat('<div class="quote" id="q', page_id, '"><blockquote class="said">It is what it is, said page ', page_id, ' of itself.</blockquote></div>',
    '<div class="footnote"><p class="small"><a id="fn', page_id % 5, '"></a>See the end of it.</p></div><div class="footnote"><p>See the very end of page ', page_id, '.</p></div>',
    '<section class="aside wide"><a id="z"></a><ul><li>First point of page ', page_id, '</li><li>Second point &amp; last</li></ul></section>',
    '<div class="same"><p>The very same text stands twice.</p></div><div class="same" id="s2"><p>The very same text stands twice.</p></div><section class="other"><p>The very same text stands twice.</p></section>',
    '<div class="warning"><p>A callout is left to another rule.</p></div><div class="pic"><blockquote><img src="x.png"/>A picture has its own wrapper.</blockquote></div>',
    '<div class="two"><p>One of two blocks in here.</p><p>The other of two blocks.</p></div><div class="short"><p>Too short.</p></div></article>'))"""
_BARE = """replace(replace(replace(replace(replace(replace(html, concat('<div class="quote" id="q', page_id, '">'), ''), '<blockquote class="said">', '<blockquote>'), '</blockquote></div>', '</blockquote>'),
    '<div class="footnote">', ''), '<section class="aside wide"><a id="z"></a>', '<section>'), '<div class="short">', '')"""
UNWRAPPED = f"""CASE page_id % 6
    WHEN 1 THEN replace({_BARE}, 'said page', 'says page')
    WHEN 2 THEN replace(replace({_BARE}, 'See the end of it.', 'Look at the end.'), 'First point of', 'Something else is said of')
    WHEN 3 THEN replace(replace(replace(html, '<div class="same">', '<div>'), '<div class="same" id="s2">', '<i id="s2"></i><div>'), '<section class="other">', '<section>')
    WHEN 4 THEN replace(replace(html, '<section class="aside wide"><a id="z"></a><ul>', '<section><ul class="kept">'), 'Second point', '⟦PRE-1: x⟧ second  POINTS')
    WHEN 5 THEN replace(replace(replace({_BARE}, 'It is what it is, said', 'Nothing of this is left in'), '<p class="small">', '<p>'), 'See the very end', 'See the very last')
    ELSE html END"""


def wrapped(pages: DataFrame, side: int) -> DataFrame:
    rows = source(pages).select("page_id", F.expr(WRAPPED).alias("html"))
    return rows if side == 0 else rows.select("page_id", F.expr(UNWRAPPED).alias("html"))


#: Pages as XML of which some can't be read, some of them only after the rewrite, and some are new.
XHTML = "concat('<html><body><p>', page_id, CASE WHEN broken THEN '<br>' ELSE '<br/>' END, '</p></body></html>')"
XHTML_SIDES = ("page_id % 4 = 1", "page_id % 3 = 0 OR page_id % 8 = 1")
NEW_PAGES = "page_id % 7 = 2"


def xhtml(pages: DataFrame, side: int) -> DataFrame:
    rows = pages.select("page_id", F.expr(URL).alias("url"), F.expr(XHTML_SIDES[side]).alias("broken"))
    rows = rows.filter(f"NOT ({NEW_PAGES})") if side == 0 else rows
    return rows.select("page_id", "url", F.expr(XHTML).alias("html"))


def source(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.expr(URL).alias("url"), F.col("page_id").alias("ord"), F.expr(SOURCE).alias("html"))


def output(pages: DataFrame) -> DataFrame:
    return source(pages).filter(KEPT).select("page_id", "url", F.expr(ORDER).alias("ord"), F.expr(OUTPUT).alias("html"))


#: Text of a document that is put into a chapter: no line of its own can pass for a heading, fence or table.
_PLAIN = "replace(replace(replace(replace(text, '`', ' '), '#', ' '), '|', ' '), '~', ' ')"
CHAPTER = f"""concat(
    CASE doc_id % 4 WHEN 0 THEN concat('⟦TITLE-1: Chapter ', doc_id, '⟧') WHEN 1 THEN concat('⟦ANCHOR:c1⟧ # Chapter ', doc_id) WHEN 2 THEN concat('# Chapter ', doc_id) ELSE 'No title here.' END,
    chr(10), chr(10), 'It is ⟦PRE-1: a', chr(92), '_b⟧ said that the gate holds. See *First things* and [link](a.html).', chr(10), chr(10),
    '⟦ANCHOR:s1⟧', chr(10), '## 1.1 First things', chr(10), chr(10), {_PLAIN}, chr(10), chr(10),
    '```', chr(10), '# not a heading', chr(10), 'x = 1', chr(10), '```', chr(10), chr(10),
    '## ⟦ANCHOR:s2⟧ 1.2 Second things', chr(10), '⟦ANCHOR:s3⟧', chr(10), '### 1.2.1 Inner things', chr(10), chr(10), '| a | b |', chr(10), '| --- | --- |', chr(10), chr(10),
    CASE WHEN doc_id % 3 = 0 THEN concat('## 1.10 Third things', chr(10), '⟦ANCHOR:s4⟧', chr(10), 'The cat sat. The cat sat. Delving on.', chr(10)) ELSE concat('~~~', chr(10), '## kept', chr(10), '~~~', chr(10)) END,
    'The end is near enough.')"""
REWRITE = """CASE doc_id % 12
    WHEN 1 THEN replace(text, '⟦PRE-1: a', '⟦PRE-2: a')
    WHEN 2 THEN replace(text, '## 1.1 First', '## First')
    WHEN 3 THEN replace(text, 'x = 1', 'x = 2')
    WHEN 4 THEN replace(text, '| a | b |', '| a | c |')
    WHEN 5 THEN replace(text, '(a.html)', '(b.html)')
    WHEN 6 THEN replace(text, 'The end', 'Its provenance')
    WHEN 7 THEN concat(substring(text, 1, 160), chr(10), 'short')
    WHEN 8 THEN concat(text, chr(10), '## Bare end')
    WHEN 9 THEN concat(text, ' ⟦PRE-9: cut')
    WHEN 10 THEN concat('Opening.', chr(10), text)
    WHEN 11 THEN replace(replace(replace(text, '1.1 ', ''), '1.2.1 ', ''), '1.2 ', '')
    ELSE text END"""
CACHED = """CASE doc_id % 6
    WHEN 0 THEN concat(text, chr(10), '## Key points', chr(10), '- a', chr(10))
    WHEN 1 THEN concat(text, chr(10), '## Key points', chr(10), '- a', chr(10), '## Check yourself', chr(10), 'b', chr(10), '# c')
    WHEN 2 THEN concat(text, chr(10), '## Key points', chr(10), '- a', chr(10), '## More', chr(10), 'b')
    WHEN 3 THEN concat('# Twice', chr(10), chr(10), '# Twice', chr(10), 'text')
    WHEN 4 THEN concat(text, chr(10), '## Key points', chr(10), '## Key points', chr(10), '- b')
    ELSE text END"""
#: Fixes of a sentence and of a heading (old text, new text, quoted evidence), by turns with each fault.
_END = "'The end is near enough.'"
SENTENCES = (
    ("'The cat sat.'", "'The dog sat.'", "''"),
    ("'## 1.1 First things'", "'Other'", "''"),
    (_END, "concat('Two', chr(10), 'lines')", "''"),
    (_END, "'It ends.'", "'nowhere said'"),
    ("concat('It is ⟦PRE-1: a', chr(92), '_b⟧ said')", "'It is said'", "''"),
    (_END, "'Its provenance is near.'", "''"),
    (_END, "''", "'the gate  holds'"),
    (_END, "' The end is at hand. '", "'the gate holds'"),
)
HEADINGS = (
    ("'Nothing'", "'Other'", "'the gate holds'"),
    ("'1.1 First things'", "'# Other'", "'the gate holds'"),
    ("'1.1 First things'", "'Other'", "''"),
    ("'1.1 First things'", "'A provenance'", "'the gate holds'"),
    ("'1.1 First things'", "' 1.1 Other things'", "'the gate holds'"),
)


def _by_turns(kind: str, fixes: tuple[tuple[str, str, str], ...]) -> list[str]:
    cases = [" ".join(f"WHEN {k} THEN {f[n]}" for k, f in enumerate(fixes)) for n in range(3)]
    return [f"CASE doc_id % {len(fixes)} {c} END AS {kind}_{name}" for c, name in zip(cases, ("old", "new", "quote"), strict=True)]


#: A chapter in two pieces, the second of which begins with the last lines of the first, with part of a line, or anew.
_AT = "position('## 1.1' IN source)"
PIECES = (f"substring(source, 1, {_AT} + CASE WHEN doc_id % 3 = 0 THEN 9 ELSE 3000 END)", f"substring(source, {_AT} + CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN -7 ELSE 5000 END)")


def json_text(text: str) -> str:
    """A text as a string of JSON, in the SQL that Spark and DuckDB share."""
    for sign, by in ((92, "chr(92), chr(92)"), (34, "chr(92), chr(34)"), (10, "chr(92), 'n'"), (13, "chr(92), 'r'"), (9, "chr(92), 't'")):
        text = f"replace({text}, chr({sign}), concat({by}))"
    return f"concat(chr(34), {text}, chr(34))"


#: A reviewer's reply: in a fence, in prose with braces and quotes, cut off before a whole one, none, under other names, in other objects.
LISTED = f"""concat('{{"fixes": [{{"sentence": ', {json_text("left(body, 300)")}, ', "replacement": ', {json_text("right(body, 200)")}, ', "source": "s", "problem": null}}, {{"sentence": 3, "replacement": "x"}}, 7, null, ',
    '{{"heading": "H {{", "sentence": " ", "replacement": ""}}, {{"sentence": "no new text"}}]}}')"""
REVIEW = f"""CASE doc_id % 9
    WHEN 0 THEN concat('Here:', chr(10), '```json', chr(10), listed, chr(10), '```')
    WHEN 1 THEN concat('Use {{x}}, a 5" pipe }} and ', chr(92), '{{: ', listed, ' {{')
    WHEN 2 THEN concat('{{"fixes": [{{"sentence": "cut {{ off', chr(10), listed)
    WHEN 3 THEN source
    WHEN 4 THEN concat('{{"fixes": "none"}} or {{"fix": []}}, then ', listed, ' and {{"fixes": []}}')
    WHEN 5 THEN concat('{{"a": "}} {{', chr(92), '" ", "fixes": []}} ', listed)
    WHEN 6 THEN concat('{{"fixes": 1, "more": [', listed, ']}}')
    WHEN 7 THEN concat('{{"said": ', {json_text("listed")}, '}}')
    ELSE left(listed, 400) END"""
#: The events of a reply, by place: what they are, the message they belong to, and their text.
EVENTS = (
    ("""'{"type": "system"}'"""),
    (f"""concat('{{"type": "assistant", "message": {{"id": "m1", "content": [{{"type": "text", "text": ', {json_text("first")}, '}}, {{"type": "tool", "text": "x"}}]}}}}')"""),
    ("""CASE WHEN doc_id % 5 = 1 THEN 'not an event' ELSE '{"type": "assistant", "message": {"id": "m0", "content": []}}' END"""),
    (f"""concat('{{"type": "assistant", "message": {{"id": "', CASE WHEN doc_id % 3 = 1 THEN 'm1' ELSE 'm2' END, '", "content": [{{"type": "text", "text": ', {json_text("second")}, '}}]}}}}')"""),
    ("""concat('{"type": "result", "is_error": ', CASE WHEN doc_id % 7 = 3 THEN 'true' ELSE 'false' END, '}')"""),
)
#: A rewrite of a page with anchors' tokens: some dropped, doubled, with backslashes, or beside those of no page.
ANCHORED = """CASE page_id % 4 WHEN 0 THEN replace(html, '⟦ANCHOR:top⟧', '')
    WHEN 1 THEN replace(html, '⟦ANCHOR:more⟧', '⟦ANCHOR:more⟧⟦ANCHOR:else⟧ and ⟦ANCHOR:more⟧')
    WHEN 2 THEN replace(html, '⟦ANCHOR:mo', concat('⟦ANCHOR', chr(92), ':mo')) ELSE html END"""
#: What earlier runs left of a chapter, by kind, and the chapters that a later run has.
LEFT = {"output": ("cached", "doc_id % 5 <> 4"), "failed": ("concat('failed ', doc_id)", "doc_id % 7 = 2"), "stale": ("concat('stale ', doc_id)", "doc_id % 9 = 1")}
IN_RUN = "doc_id % 13 <> 5"
#: Replies that came as plain text.
PLAIN_REPLY = "doc_id % 11 = 4"
FIX_COLUMNS = _by_turns("sentence", SENTENCES) + _by_turns("heading", HEADINGS)

CHAPTER_SQL = f"""chapters AS (SELECT doc_id, text AS source, {REWRITE} AS body, {CACHED} AS cached FROM (SELECT doc_id, {CHAPTER} AS text FROM documents)),
fixes AS (SELECT *, {", ".join(FIX_COLUMNS)} FROM chapters)"""


def chapters(documents: DataFrame) -> DataFrame:
    """(doc_id, source, body, cached): a chapter, its rewrite, and what an earlier run kept of it."""
    rows = documents.select("doc_id", F.expr(CHAPTER).alias("text"))
    return rows.select("doc_id", F.col("text").alias("source"), F.expr(REWRITE).alias("body"), F.expr(CACHED).alias("cached"))


def fixes(documents: DataFrame) -> DataFrame:
    """``chapters`` with a sentence's and a heading's fix: its old text, its new one and the quoted evidence."""
    return chapters(documents).selectExpr("*", *FIX_COLUMNS)
