"""DuckDB SQL for the queries over editions and chapters, from the same fixed values."""

from __future__ import annotations

from ..functions import html as H
from ..functions import text as T
from ..operators import blocks as B
from ..operators import chapters as C
from ..operators import integrity as I
from ..operators import markdown as M
from ..operators import results as R
from . import editions as E
from . import node_sql as D
from . import sql as S
from .sql import every, has, q, strip, sub

EDITIONS = f"{E.SOURCE_SQL}, {E.OUTPUT_SQL}"


def _place() -> str:
    return S._clean(S.PATH)


# --- chapters

OPENING = S.opening("body")
#: Lines of a text, with the headings outside fences: a fence opens and closes by turns here.
_AT = f"regexp_extract(line, {q('^#{1,6}[' + T.BLANK + '](?:⟦ANCHOR:[^⟧]*⟧[' + T.BLANK + ']*)*')}, 0)"


def lines_of(text: str) -> str:
    return f"(SELECT doc_id, i - 1 AS pos, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split({text}, chr(10)) AS l FROM fixes)))"


HEADINGS = f"""
marked AS (SELECT *, {has("line", M.FENCE)} AS mark, sum({has("line", M.FENCE)}::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM {lines_of("body")}),
heads AS (SELECT doc_id, pos, line, length(regexp_extract(line, '^#+', 0)) AS level FROM marked WHERE NOT mark AND n % 2 = 0 AND {has("line", M.HEADING)}),
openings AS (SELECT doc_id, body, {OPENING} AS opening FROM fixes),
named AS (
    SELECT doc_id, pos, prefix, {strip("substr(line, length(prefix) + 1)")} AS text
    FROM (SELECT h.doc_id, pos, line, {_AT} AS prefix, opening FROM heads h JOIN openings USING (doc_id)) WHERE {sub(strip("line"), T.ANCHORS)} <> opening
),
headings AS (SELECT * FROM named WHERE text <> ''),
titles AS (
    SELECT doc_id, min(pos) AS at FROM marked JOIN openings USING (doc_id)
    WHERE {S.is_title("opening")} AND {strip("line")} <> '' AND {sub(strip("line"), T.ANCHORS)} = opening GROUP BY doc_id
),
sections AS (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth
    FROM (SELECT h.*, min(level) OVER (PARTITION BY h.doc_id) AS least FROM heads h LEFT JOIN titles t ON h.doc_id = t.doc_id AND h.pos = t.at WHERE t.at IS NULL) WHERE level = least
),
cuts AS (SELECT f.*, s.pos AS cut FROM fixes f LEFT JOIN sections s ON f.doc_id = s.doc_id AND s.nth = {M.TOP_SECTIONS + 1}),
tops AS (
    SELECT *, CASE WHEN cut IS NULL THEN body ELSE array_to_string(string_split(body, chr(10))[:cut], chr(10)) END AS top,
        CASE WHEN cut IS NULL THEN '' ELSE array_to_string(string_split(body, chr(10))[cut + 1:], chr(10)) END AS rest FROM cuts
)"""


def _lost(old: str, new: str) -> str:
    return f"len(list_filter({every(old, T.CLOSED_TOKEN)}, lambda x: NOT list_contains({every(new, T.CLOSED_TOKEN)}, x))) > 0"


def _line_from(top: str, old: str) -> str:
    before = f"string_split(substr({top}, 1, greatest(strpos({top}, {old}) - 1, 0)), chr(10))[-1]"
    return f"regexp_replace({before} || substr({top}, strpos({top}, {old})), {q(f'^[{T.BLANK}]+')}, '')"


SENTENCE = f"""CASE
    WHEN sentence_old = '' OR (length(top) - length(replace(top, sentence_old, ''))) / length(sentence_old) <> 1 THEN 'sentence not found once in the opening'
    WHEN contains(sentence_old, chr(10)) OR starts_with({_line_from("top", "sentence_old")}, '#') OR starts_with({_line_from("top", "sentence_old")}, '|')
        OR starts_with({_line_from("top", "sentence_old")}, '⟦TITLE') THEN 'sentence is structure, not prose'
    WHEN contains(sentence_new, chr(10)) OR (contains(sentence_new, '|') AND NOT contains(sentence_old, '|')) THEN 'replacement changes structure'
    WHEN {strip("sentence_quote")} <> '' AND NOT contains({S.flat("source")}, {S.flat("sentence_quote")}) THEN 'quoted evidence is not in the original'
    WHEN {_lost("sentence_old", "sentence_new")} THEN 'replacement drops a ⟦token⟧'
    WHEN len({S.banned("source", "sentence_new")}) > 0 THEN 'replacement uses a banned word' ELSE '' END"""
HEADING = f"""CASE
    WHEN coalesce(len(list_filter(texts, lambda x: x = {strip("heading_old")})), 0) <> 1 THEN 'heading not found once'
    WHEN {strip("heading_new")} = '' OR contains({strip("heading_new")}, chr(10)) OR starts_with({strip("heading_new")}, '#') THEN 'replacement is not a heading'
    WHEN {strip("heading_quote")} = '' OR NOT contains({S.flat("source")}, {S.flat("heading_quote")}) THEN 'quoted evidence is not in the original'
    WHEN {_lost(strip("heading_old"), strip("heading_new"))} THEN 'replacement drops a ⟦token⟧'
    WHEN len({S.banned("source", strip("heading_new"))}) > 0 THEN 'replacement uses a banned word' ELSE '' END"""
REJECTIONS = f"""{HEADINGS},
texts AS (SELECT doc_id, list(text ORDER BY pos) AS texts FROM headings GROUP BY doc_id),
rejections AS (SELECT t.*, h.texts, {SENTENCE} AS sentence, {HEADING} AS heading FROM tops t LEFT JOIN texts h USING (doc_id))"""

#: The sentence's fix, then the heading's on what that left. Sentences' fixes leave headings as they are, so the headings' places hold, too.
_NEW = f"""CASE WHEN {strip("sentence_new")} <> '' THEN replace(top, sentence_old, {strip("sentence_new")})
    WHEN contains(top, sentence_old || ' ') THEN replace(top, sentence_old || ' ', '') ELSE replace(top, sentence_old, '') END"""
_WHOLE = "CASE WHEN rest = '' THEN {0} ELSE {0} || chr(10) || rest END"
PATCHED = f"""{REJECTIONS},
first AS (SELECT *, {_WHOLE.format(f"({_NEW})")} AS candidate, {_WHOLE.format("top")} AS before FROM rejections),
second AS (SELECT *, CASE WHEN sentence = '' AND {S.body_problem("source", "candidate")} <> '' THEN 'breaks the body check' ELSE sentence END AS why FROM first),
third AS (SELECT *, CASE WHEN why = '' THEN candidate ELSE before END AS text FROM second),
places AS (SELECT t.doc_id, h.pos, h.prefix FROM third t JOIN headings h ON t.doc_id = h.doc_id AND h.text = {strip("t.heading_old")} WHERE t.heading = ''),
fourth AS (
    SELECT t.*, CASE WHEN p.pos IS NULL THEN text ELSE replace(
        array_to_string(list_concat(string_split(text, chr(10))[:p.pos], [p.prefix || {strip("heading_new")}], string_split(text, chr(10))[p.pos + 2:]), chr(10)),
        '*' || {strip("heading_old")} || '*', '*' || {strip("heading_new")} || '*') END AS renamed
    FROM third t LEFT JOIN places p USING (doc_id)
),
fifth AS (SELECT *, CASE WHEN heading = '' AND {S.body_problem("source", "renamed")} <> '' THEN 'breaks the body check' ELSE heading END AS what FROM fourth)"""


def numbered_lines(text: str, name: str) -> str:
    """Headings with their anchors: islands of lines that hold anchors alone, above each heading, and below it where no heading follows."""
    rest = f"regexp_extract(line, {q(M.NUMBERED_HEADING)}, 2)"
    bare = f"{strip(sub(rest, M.LEADING_TOKENS))}"
    return f"""
{name}_l AS (SELECT *, sum(starts_with(line, '```')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM {lines_of(text)}),
{name}_h AS (SELECT *, n % 2 = 0 AND NOT starts_with(line, '```') AND {has("line", M.NUMBERED_HEADING)} AS head FROM {name}_l),
{name}_s AS (SELECT *, head OR {strip(sub("line", M.ANCHOR_ID))} <> '' AS stop FROM {name}_h),
{name}_w AS (
    SELECT *, coalesce(max(CASE WHEN stop THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS above,
        min(CASE WHEN stop THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS below FROM {name}_s
),
{name}_a AS (
    SELECT h.doc_id, h.pos, h.line, l.pos AS lpos, a.i AS i, a.id FROM {name}_w h JOIN {name}_s l ON h.doc_id = l.doc_id LEFT JOIN {name}_s b ON b.doc_id = h.doc_id AND b.pos = h.below,
        LATERAL (SELECT unnest(range(1, len({every("l.line", M.ANCHOR_ID, 1)}) + 1)) AS i, unnest({every("l.line", M.ANCHOR_ID, 1)}) AS id) a
    WHERE h.head AND (l.pos BETWEEN h.above + 1 AND h.pos OR (NOT coalesce(b.head, false) AND l.pos > h.pos AND (h.below IS NULL OR l.pos < h.below))) AND NOT {has("a.id", M.PAGE_ANCHOR)}
),
{name}_n AS (SELECT *, regexp_extract({bare}, {q(M.SECTION_NUMBER)}, 1) AS number FROM {name}_a)"""


NUMBERS = f"""{numbered_lines("source", "src")}, {numbered_lines("body", "out")},
known AS (SELECT doc_id, id, first(number ORDER BY pos, lpos, i) AS number FROM src_n WHERE number <> '' GROUP BY ALL),
given AS (
    SELECT o.doc_id, o.pos, o.line, list(DISTINCT k.number) AS numbers FROM out_n o JOIN known k ON o.doc_id = k.doc_id AND o.id = k.id WHERE o.number = '' GROUP BY ALL
),
chosen AS (SELECT *, list_filter(numbers, lambda n: len(list_filter(numbers, lambda m: starts_with(m, n || '.'))) = 0) AS kept FROM given),
sorted AS (
    SELECT *, list_transform(list_sort(list_transform(kept, lambda n: {{'k': list_transform(string_split(n, '.'), lambda p: CASE WHEN {has("p", "^[0-9]+$")} THEN p::BIGINT ELSE ascii(p)::BIGINT END), 'n': n}})), lambda x: x.n) AS nums FROM chosen
),
renewed AS (
    SELECT doc_id, pos, regexp_extract(line, {q(M.NUMBERED_HEADING)}, 1) || ' ' || tokens || array_to_string(nums, ', ') || ' ' || {strip("substr(rest, length(tokens) + 1)")} AS line
    FROM (SELECT *, regexp_extract(rest, {q(M.LEADING_TOKENS)}, 0) AS tokens FROM (SELECT *, regexp_extract(line, {q(M.NUMBERED_HEADING)}, 2) AS rest FROM sorted))
),
restored AS (
    SELECT l.doc_id, string_agg(coalesce(r.line, l.line), chr(10) ORDER BY l.pos) AS made FROM out_l l LEFT JOIN renewed r ON l.doc_id = r.doc_id AND l.pos = r.pos GROUP BY l.doc_id
)"""

_CHAPTER = "WITH " + E.CHAPTER_SQL
_NORMAL = lambda t: f"lower({S.flat(sub(t, T.CLOSED_TOKEN))})"
_SLUG = lambda t: f"'sec-' || coalesce(nullif(substr(regexp_replace(regexp_replace(lower({t}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, {T.SLUG_LENGTH}), ''), 'x')"
_WORDS = lambda t: f"list_distinct({every(t, f'[^{T.BLANK}]+')})"
_COMMON = lambda a, b: f"len(list_intersect({_WORDS(a)}, {_WORDS(b)}))"
_UNESCAPED = f"""array_to_string(list_transform(range(1, len(regexp_split_to_array(body, {q(T.CLOSED_TOKEN)})) + 1),
    lambda i: regexp_split_to_array(body, {q(T.CLOSED_TOKEN)})[i] || coalesce(replace({every("body", T.CLOSED_TOKEN)}[i], chr(92), ''), '')), '')"""
_REPLY = "'> ' || chr(27) || '[1m' || opening || chr(27) || '[0m' || chr(10) || chr(10) || ' ▸ Credits: 0.1 Time: 9s' || chr(10)"
_CLEAN_REPLY = strip(f"regexp_replace({strip(sub(sub('reply', T.ANSI), T.FOOTER))}, '^> ', '')")

_RESULTS = f"""{_CHAPTER},
judged AS (
    SELECT doc_id, source, body, {S.words("source")} AS words_in, CASE WHEN doc_id % 5 <> 4 THEN {S.upgraded("source", "cached")} END AS kept, {S.body_problem("source", "body")} AS fresh FROM chapters
),
stale AS (SELECT *, CASE WHEN kept IS NOT NULL THEN {S.body_problem("source", "kept")} END AS stale FROM judged),
results AS (
    SELECT doc_id, CASE WHEN words_in < {C.MIN_WORDS} THEN 'skipped' WHEN stale = '' THEN 'cached' WHEN fresh <> '' THEN 'failed' ELSE 'rewritten' END AS status, words_in, kept, body, fresh FROM stale
),
run AS (
    SELECT doc_id, status, words_in, CASE status WHEN 'cached' THEN {S.words("kept")} WHEN 'rewritten' THEN {S.words("body")} ELSE 0 END AS words_out, CASE WHEN status = 'failed' THEN fresh ELSE '' END AS detail FROM results
)"""

# --- pages


def prose(html: str) -> str:
    inner = f"(CASE WHEN regexp_extract({html}, {q(H.BODY)}, 0) <> '' THEN regexp_extract({html}, {q(H.BODY)}, 0) ELSE {html} END)"
    text = sub(inner, H.COMMENT)
    for pattern in H.UNPROSE:
        text = f"regexp_replace({text}, {q(pattern)}, chr(10), 'g')"
    return S.unescape(f"regexp_replace({text}, {q(f'(?:{H.TAG}|{chr(92)}n)+')}, chr(10), 'g')")


_SHEETS = f"list_transform(list_filter({every('html', H.LINK_TAG, 1)}, lambda t: {has('t', H.STYLESHEET)} AND {has('t', H.HREF)}), lambda t: {S.unescape(f'regexp_extract(t, {q(H.HREF)}, 1)')})"
_CLASSES = f"list_filter(list_distinct(flatten(list_transform({every('html', H.CLASSES, 1)}, lambda c: regexp_split_to_array(c, {q(chr(92) + 's+')})))), lambda c: c <> '')"

def _evictions(force: bool) -> str:
    was = {kind: f"CASE WHEN {when} THEN {text} END" for kind, (text, when) in E.LEFT.items()}
    used = "NULL" if force else was["output"]
    gone = f"len(list_filter(list_distinct({every('source', R.BLOCK, 1)}), lambda k: NOT starts_with(k, {q(R.TITLE)}) AND NOT regexp_matches(out, '⟦' || k || '(?:[^0-9⟦⟧][^⟦⟧]*)?⟧'))) > 0"
    return f"""{_CHAPTER}, was AS (SELECT *, {", ".join(f"{t} AS was_{k}" for k, t in was.items())} FROM chapters),
        judged AS (SELECT *, {S.words("source")} AS words_in, {S.upgraded("source", used)} AS kept, {S.body_problem("source", "body")} AS fresh FROM was WHERE {E.IN_RUN}),
        stale AS (SELECT *, CASE WHEN kept IS NOT NULL THEN {S.body_problem("source", "kept")} END AS stale FROM judged),
        told AS (SELECT *, CASE WHEN words_in < {C.MIN_WORDS} THEN 'skipped' WHEN stale = '' THEN 'cached' WHEN fresh <> '' THEN 'failed' ELSE 'rewritten' END AS status FROM stale),
        outs AS (SELECT *, CASE status WHEN 'cached' THEN kept WHEN 'rewritten' THEN body END AS out FROM told),
        losses AS (SELECT *, out IS NOT NULL AND {gone} AS lost FROM outs),
        texts AS (
            SELECT doc_id, CASE WHEN lost THEN NULL WHEN out IS NOT NULL THEN out WHEN status = 'failed' AND {force} THEN NULL ELSE was_output END AS output,
                CASE WHEN lost THEN out WHEN status = 'failed' THEN body ELSE was_failed END AS failed,
                CASE WHEN status = 'failed' AND {force} AND was_output IS NOT NULL THEN was_output ELSE was_stale END AS stale FROM losses
            UNION ALL SELECT doc_id, was_output, was_failed, was_stale FROM was WHERE NOT ({E.IN_RUN}))
        SELECT doc_id, kind, sha256(text) AS digest FROM (UNPIVOT texts ON output, failed, stale INTO NAME kind VALUE text)"""


_IDS = every("html", H.IDS, 1)
_STYLE = every("html", H.STYLE, 1)
_STYLED = f"unnest({every(f'array_to_string({_STYLE}, chr(10))', H.CSS_CLASS, 1)})"


def features(pages: str) -> str:
    counts = ", ".join(f"len({every(S.visible('html'), f'(?i)<{t}[' + chr(92) + 's/>]')}) AS n_{t}" for t in H.CONTENT)
    return f"""(SELECT page_id, {S.HOST} AS book, {_place()} AS place,
        list_sort(list_distinct(list_transform({_SHEETS}, lambda ref: {S.TARGET}))) AS sheets,
        list_sort({every(f"regexp_extract(html, {q(H.BODY_TAG)}, 1)", H.ATTRIBUTE, 1)}) AS attributes, prose, regexp_extract(prose, '⟦[^⟧\\n]{{0,40}}', 0) AS token,
        len({every("prose", "(?m)" + T.RESIDUE)}) AS marks, regexp_extract(prose, {q("(?m)" + T.RESIDUE)}, 0) AS mark, {_CLASSES} AS classes, coalesce(wrappers, []) AS wrappers, coalesce(jumps, 0) AS jumps, {has("html", H.CONTENTS)} AS is_nav,
        list_sort(list_distinct(list_filter({_IDS}, lambda i: len(list_filter({_IDS}, lambda j: j = i)) > 1))) AS repeated, {counts}
        FROM (SELECT *, {prose("html")} AS prose FROM {pages}) LEFT JOIN {D.wrappers(f"{pages}_nodes")} USING (page_id) LEFT JOIN {D.jumps(f"{pages}_nodes")} USING (page_id))"""


_STYLES = f"styles AS (SELECT book, list(DISTINCT class) AS styled FROM (SELECT {S.HOST} AS book, {_STYLED} AS class FROM output) GROUP BY book)"
_FEWER = " UNION ALL ".join(
    f"SELECT page_id, book, '{'problem' if t in H.PROTECTED else 'warning'}', 'fewer <{t}>', place, s_{t} || ' -> ' || o_{t} FROM told WHERE rewritten AND o_{t} < s_{t}" for t in H.CONTENT
)
_SIDES = ", ".join(f"s.{c} AS s_{c}, o.{c} AS o_{c}" for c in ("sheets", "attributes", "prose", "token", "marks", "mark", "classes", "wrappers", "jumps", "repeated", "is_nav"))
_TAGS = ", ".join(f"s.n_{t} AS s_{t}, o.n_{t} AS o_{t}" for t in H.CONTENT)


_NODES = ", ".join(f"{p}_nodes AS MATERIALIZED (SELECT * FROM {D.nodes(p)})" for p in ("source", "output"))


def page_findings(rewritten: str) -> str:
    return f"""{_NODES},
told AS (
    SELECT o.page_id, o.book, o.place, {_SIDES}, {_TAGS}, {rewritten} AS rewritten,
        list_filter(s.sheets, lambda x: NOT list_contains(o.sheets, x)) AS lost_sheets,
        list_filter(s.wrappers, lambda w: NOT list_contains(o.wrappers, w) AND list_has_any(string_split(w, '.')[2:], coalesce(styled, []))) AS unwrapped,
        list_sort(list_filter(s.classes, lambda x: NOT list_contains(o.classes, x) AND list_contains(coalesce(styled, []), x)
            AND NOT list_contains(flatten(list_transform(unwrapped, lambda w: string_split(w, '.')[2:])), x))) AS gone
    FROM {features("source")} s JOIN {features("output")} o USING (page_id) LEFT JOIN styles ON o.book = styles.book
),
told_all AS (
    SELECT page_id, book, 'problem' AS level, 'stylesheet link lost' AS kind, place, array_to_string(lost_sheets, ', ') AS detail FROM told WHERE len(lost_sheets) > 0
    UNION ALL SELECT page_id, book, 'warning', 'body attributes changed', place, array_to_string(s_attributes, ' ') || ' -> ' || array_to_string(o_attributes, ' ') FROM told WHERE s_attributes <> o_attributes
    UNION ALL SELECT page_id, book, 'warning', 'untouched document changed', place, 'text differs from the source' FROM told WHERE NOT rewritten AND NOT o_is_nav AND s_prose <> o_prose
    UNION ALL SELECT page_id, book, 'problem', 'styled wrapper lost', place, array_to_string(unwrapped, ', ') FROM told WHERE rewritten AND len(unwrapped) > 0
    UNION ALL SELECT page_id, book, 'warning', 'styled classes lost', place, array_to_string(gone[:{I.CLASSES_SHOWN}], ', ') || CASE WHEN len(gone) > {I.CLASSES_SHOWN} THEN ' …' ELSE '' END FROM told WHERE rewritten AND len(gone) > 0
    UNION ALL {_FEWER}
    UNION ALL SELECT page_id, book, 'problem', 'token left in text', place, o_token FROM told WHERE rewritten AND o_token <> ''
    UNION ALL SELECT page_id, book, 'warning', 'markdown left in text', place, (o_marks - s_marks) || ' marker(s), e.g. ' || o_mark FROM told WHERE rewritten AND o_marks > s_marks
    UNION ALL SELECT page_id, book, 'warning', 'heading levels skip', place, s_jumps || ' -> ' || o_jumps || ' jumps' FROM told WHERE rewritten AND o_jumps > s_jumps
    UNION ALL SELECT page_id, book, 'problem', 'duplicate ids', place, array_to_string(o_repeated[:{I.IDS_SHOWN}], ', ') FROM told WHERE rewritten AND len(o_repeated) > 0
)"""


def checked(pages: str) -> str:
    rows = f"(SELECT page_id, {S.HOST} AS book, kind, pos, ref, {S.TARGET} AS target, {S.FRAGMENT} AS fragment FROM {S.links(pages)})"
    return S.resolving(rows, pages)


def entries(pages: str) -> str:
    inside = f"array_to_string({every('html', H.NAV, 1)}, chr(10))"
    found = f"list_filter({every(inside, H.NAV_LINK, 1)}, lambda a: {has('a', H.HREF)})"
    label = S.flat(S.unescape(sub("found[i]", H.TAG, " ")))
    ref = S.unescape(f"regexp_extract(found[i], {q(H.HREF)}, 1)")
    rows = f"(SELECT page_id, url, i - 1 AS pos, {ref} AS ref, {label} AS label FROM (SELECT page_id, url, found, unnest(range(1, len(found) + 1)) AS i FROM (SELECT page_id, url, {found} AS found FROM {pages})))"
    return f"(SELECT page_id, pos, ref, label, {S.HOST} AS book, {S.TARGET} AS target, {S.FRAGMENT} AS fragment FROM {rows} WHERE NOT {has('ref', H.EXTERNAL)})"


def _resources(pages: str) -> str:
    return f"(SELECT {S.HOST} AS book, {_place()} AS path FROM {pages} UNION SELECT {S.HOST}, {S.TARGET} FROM {S.links(pages)} WHERE kind <> 'a')"


SPINE = f"""
spine_was AS (SELECT page_id, {S.HOST} AS book, row_number() OVER (PARTITION BY {S.HOST} ORDER BY ord) AS was FROM source),
spine_now AS (SELECT page_id, {S.HOST} AS book, row_number() OVER (PARTITION BY {S.HOST} ORDER BY ord) AS now FROM output),
moved AS (SELECT *, CASE WHEN now IS NULL THEN 'lost' WHEN was IS NULL THEN 'added' ELSE 'moved' END AS change FROM spine_was FULL JOIN spine_now USING (page_id, book) WHERE was IS DISTINCT FROM now),
spine_shown AS (SELECT book, change, array_to_string((list(page_id ORDER BY was, now))[:{I.SPINE_SHOWN}], ', ') AS ids FROM moved WHERE change <> 'moved' GROUP BY ALL),
spine_all AS (
    SELECT m.book, 'problem' AS level, 'spine changed' AS kind, 'package' AS place,
        CASE WHEN count(*) FILTER (change <> 'moved') > 0 THEN 'lost [' || coalesce((SELECT ids FROM spine_shown s WHERE s.book = m.book AND change = 'lost'), '') || '], added ['
            || coalesce((SELECT ids FROM spine_shown s WHERE s.book = m.book AND change = 'added'), '') || ']' ELSE 'same documents, different order' END AS detail
    FROM moved m GROUP BY m.book
)"""
LOST = f"lost_all AS (SELECT book, 'problem' AS level, 'resource lost' AS kind, path AS place, 'in the source manifest, missing from the output' AS detail FROM (SELECT * FROM {_resources('source')} EXCEPT SELECT * FROM {_resources('output')}))"
BROKEN = f"""
held AS (SELECT page_id, ref, bool_or(resolves) AS held FROM {checked("source")} GROUP BY ALL),
broken_rows AS (SELECT o.* FROM {checked("output")} o LEFT JOIN held USING (page_id, ref) WHERE NOT o.resolves AND coalesce(held, true)),
broken_all AS (
    SELECT page_id, book, 'problem' AS level, 'links broken' AS kind, count(*) || ': ' || array_to_string((list(ref ORDER BY list_position(['a', 'img', 'link'], kind), pos))[:{I.LINKS_SHOWN}], ', ') AS detail
    FROM broken_rows GROUP BY page_id, book
)"""
NAV = f"""
nav_now AS (SELECT * FROM {S.resolving(entries("output"), "output")}),
nav_was AS (SELECT * FROM {S.resolving(entries("source"), "source")} WHERE resolves),
nav_open AS (
    SELECT book, 'problem' AS level, 'nav entry unresolved' AS kind, CASE WHEN label <> '' THEN label ELSE ref END AS place, ref AS detail
    FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page_id, pos) AS nth FROM nav_now WHERE NOT resolves) WHERE nth <= {I.ENTRIES_SHOWN}
),
changed AS (SELECT page_id FROM source s JOIN output o USING (page_id) WHERE {prose("s.html")} <> {prose("o.html")}),
spared AS (SELECT DISTINCT {S.HOST} AS book, {_place()} AS target FROM output WHERE page_id IN (SELECT page_id FROM changed)),
nav_gone AS (
    SELECT w.*, CASE WHEN label <> '' THEN label ELSE target || '#' || fragment END AS name FROM nav_was w
    WHERE NOT EXISTS (SELECT 1 FROM spared s WHERE s.book = w.book AND s.target = w.target)
        AND NOT EXISTS (SELECT 1 FROM nav_now n WHERE n.book = w.book AND n.target = w.target AND n.fragment = w.fragment AND n.label = w.label)
),
nav_lost_all AS (
    SELECT g.book, 'problem' AS level, 'nav entries lost' AS kind, 'navigation' AS place,
        count(*) || ' of ' || (SELECT count(*) FROM nav_was w WHERE w.book = g.book) || ' (outside rewritten chapters): ' || array_to_string((list(name ORDER BY page_id, pos))[:{I.LOST_SHOWN}], '; ') AS detail
    FROM nav_gone g GROUP BY g.book
)"""
_P = f"WITH {EDITIONS}"
FINDINGS = f"""{_P}, {_STYLES}, {page_findings("s.prose <> o.prose")}, {SPINE}, {LOST}, {BROKEN}, {NAV},
findings AS (
    SELECT DISTINCT {S.HOST} AS book, NULL AS level, NULL AS kind, NULL AS place, NULL AS detail FROM output UNION ALL
    SELECT * FROM spine_all UNION ALL SELECT * FROM lost_all UNION ALL SELECT book, level, kind, place, detail FROM told_all
    UNION ALL SELECT b.book, level, kind, {_place()}, detail FROM broken_all b JOIN output USING (page_id)
    UNION ALL SELECT * FROM nav_open UNION ALL SELECT * FROM nav_lost_all
)"""
_SAID = lambda x: f"count(*) FILTER (level = '{x}') || ' {x}' || CASE WHEN count(*) FILTER (level = '{x}') = 1 THEN '' ELSE 's' END"
_CLASSIFIED = S._CLASSIFIED.replace("$pages", "source")


def _listings(pages: str) -> str:
    key = S.flat(S.unescape(sub("h", H.TAG)))
    return f"""(SELECT *, row_number() OVER (PARTITION BY page_id, key ORDER BY pos) AS nth FROM (SELECT page_id, (i - 1)::INT AS pos, {key} AS key FROM (
        SELECT page_id, i, l[i] AS h FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, {every("html", B.LISTING, 1)} AS l FROM {pages})))))"""


def _starts(pages: str) -> str:
    value = lambda p: f"CASE WHEN {has('t', p)} THEN {S.unescape(f'regexp_extract(t, {q(p)}, 1)')} END"
    return f"""(SELECT page_id, (i - 1)::INT AS pos, {value(H.HREF)} AS href, {value(B.ID)} AS id, nullif({value(B.CLASS)}, '') AS class FROM (
        SELECT page_id, i, l[i] AS t FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, {every("html", B.LINK_START, 1)} AS l FROM {pages}))))"""


def _each(pages: str, found: str, columns: str) -> str:
    """A row for each match x, with its place pos."""
    return f"(SELECT {columns} FROM (SELECT *, (i - 1)::INT AS pos, l[i] AS x FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT *, {found} AS l FROM {pages}))))"


_WAS = f"was AS MATERIALIZED (SELECT * FROM {D.nodes('source')})"
_NOW = f"now AS MATERIALIZED (SELECT * FROM {D.nodes('output')})"
_CAPTION_TEXT = S.flat(S.unescape(sub("x", H.TAG, " ")))
_PLAIN = sub("text", T.CLOSED_TOKEN)
_LABEL = f"nullif(lower({sub(f'regexp_extract({_PLAIN}, {q(T.CAPTION)}, 0)', f'[{T.BLANK}]+')}), '')"

#: Pages with a token before the first element of each identifier that is led to, put in one identifier after the other; the identifiers by place.
_ANCHORED = f"""{_P}, led AS (SELECT DISTINCT book, target AS path, fragment AS id FROM {checked("source")} WHERE fragment <> ''),
    own AS (SELECT DISTINCT page_id, {S.HOST} AS book, {_place()} AS path, unnest({_IDS}) AS id FROM source),
    named AS (SELECT page_id, list(id ORDER BY id) AS ids FROM own JOIN led USING (book, path, id) GROUP BY page_id),
    put AS (SELECT page_id, coalesce(ids, []) AS ids, list_reduce(coalesce(ids, []), lambda h, x: regexp_replace(h, '(<[A-Za-z][^>]* id="' || x || '"[^>]*>)', '⟦ANCHOR:' || x || '⟧\\1'), html) AS html
        FROM source LEFT JOIN named USING (page_id)),
    tokens AS (SELECT page_id, html, list_transform(list_sort(list_transform(ids, lambda x: {{'at': strpos(html, '⟦ANCHOR:' || x || '⟧'), 'id': x}})), lambda x: x.id) AS ids FROM put)"""

#: Pieces ``a`` and ``b`` of a text, put together at the longest tail of whole lines that b begins with.
_JOINED = f"""tails AS (SELECT doc_id, a, b, unnest(list_append(list_filter(range(1, length(a) + 1), lambda i: i > length(a) - {T.OVERLAP} AND a[i] = chr(10)), 0)) AS cut FROM pieces),
        best AS (SELECT doc_id, any_value(a) AS a, any_value(b) AS b, min(cut) AS cut FROM tails WHERE (cut > 0 OR length(a) <= {T.OVERLAP}) AND starts_with(b, substr(a, cut + 1)) GROUP BY doc_id),
        made AS (SELECT p.doc_id, length(p.a) + length(p.b) AS whole, CASE WHEN cut IS NULL THEN p.a || p.b ELSE left(p.a, cut) || p.b END AS text FROM pieces p LEFT JOIN best USING (doc_id))"""


QUERIES = {
    "opening_lines_marked": f"{_CHAPTER} SELECT doc_id, {OPENING} AS opening, {S.is_title(OPENING)} AS titled FROM fixes",
    "token_scan_marked": f"""{_CHAPTER} SELECT doc_id, len({every("body", T.TOKEN)}) AS tokens, {has("body", T.UNCLOSED)} AS unclosed, sha256({sub("body", T.TOKEN)}) AS plain,
        {has("body", "⟦PRE-1(?:[^0-9⟦⟧][^⟦⟧]*)?⟧")} AS named FROM fixes""",
    "banned_words_marked": f"""{_CHAPTER} SELECT doc_id, array_to_string({S.banned("source", "body")}, ',') AS banned, array_to_string({S.banned("''", "body")}, ',') AS alone FROM fixes""",
    "body_problem_marked": f"{_CHAPTER} SELECT doc_id, {S.body_problem('source', 'body')} AS problem FROM fixes",
    "revision_guard_marked": f"{_CHAPTER} SELECT doc_id, {S.revision_problem('source', 'source', 'body')} AS problem FROM fixes",
    "cache_upgrade_marked": f"{_CHAPTER} SELECT doc_id, sha256({S.upgraded('source', 'cached')}) AS upgraded FROM fixes",
    "chapter_texts": f"""{_CHAPTER}, {HEADINGS},
        listed AS (SELECT o.*, f.source, coalesce((SELECT string_agg(text, chr(10) ORDER BY pos) FROM headings h WHERE h.doc_id = o.doc_id), '') AS heads, {_REPLY} AS reply,
            'p' || o.doc_id || '.html#' || {_SLUG("opening")} AS href, {S.opening("f.source")} AS other FROM openings o JOIN fixes f USING (doc_id))
        SELECT doc_id, sha256({_UNESCAPED}) AS unescaped, sha256({_NORMAL("body")}) AS normal, {_SLUG("opening")} AS slug,
            'toc-' || regexp_replace(href, {q("[^" + chr(92) + "p{L}" + chr(92) + "p{N}_-]")}, '-', 'g') AS uid, {_CLEAN_REPLY} AS reply,
            chr(10) || chr(10) || '# Book context' || chr(10) || chr(10) || 'The arc.' || chr(10) || chr(10) || '# Current chapter' || chr(10) || chr(10) || 'You are rewriting chapter ' || doc_id || ': ' || opening || '.' AS context,
            sha256('ORIGINAL:' || chr(10) || chr(10) || source || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'REWRITE:' || chr(10) || chr(10) || body) AS request,
            sha256('ORIGINAL:' || chr(10) || chr(10) || source || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'TOP:' || chr(10) || chr(10) || opening
                || CASE WHEN heads <> '' THEN chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'HEADINGS:' || chr(10) || chr(10) || heads ELSE '' END) AS check,
            lower({sub(sub("opening", T.CLOSED_TOKEN), f"[{T.BLANK}]+")}) AS key,
            round(CASE WHEN len({_WORDS("source")}) > 0 AND len({_WORDS("body")}) > 0 THEN {_COMMON("source", "body")}::DOUBLE / greatest(len({_WORDS("source")}), len({_WORDS("body")})) ELSE 0 END, 6) AS shared,
            round(CASE WHEN len({_WORDS("opening")}) > 0 AND len({_WORDS("other")}) > 0
                THEN {_COMMON("opening", "other")}::DOUBLE / (len({_WORDS("opening")}) + len({_WORDS("other")}) - {_COMMON("opening", "other")}) ELSE 0 END, 6) AS jaccard
        FROM listed""",
    "md_headings": f"{_CHAPTER}, {HEADINGS} SELECT doc_id, pos::INT AS pos, text FROM headings",
    "md_split_top": f"{_CHAPTER}, {HEADINGS} SELECT doc_id, cut::INT AS cut, sha256(top) AS top, sha256(rest) AS rest FROM tops",
    "section_numbers": f"{_CHAPTER}, {NUMBERS} SELECT doc_id, sha256(made) AS digest, made <> body AS changed FROM restored JOIN fixes USING (doc_id)",
    "fix_rejections": f"{_CHAPTER}, {REJECTIONS} SELECT doc_id, sentence, heading FROM rejections",
    "fixes_applied": f"""{_CHAPTER}, {PATCHED} SELECT doc_id, sha256(CASE WHEN what = '' THEN renamed ELSE text END) AS digest, ((why = '')::INT + (what = '')::INT)::INT AS applied,
        array_to_string(list_filter([why, what], lambda x: x <> ''), '; ') AS rejected FROM fifth""",
    "run_results": f"{_RESULTS} SELECT * FROM run",
    "run_evictions": _evictions(False),
    "run_evictions_forced": _evictions(True),
    "run_summary": f"""{_RESULTS}, counts AS (SELECT status, count(*) AS chapters, sum(words_in)::BIGINT AS words_in, sum(words_out)::BIGINT AS words_out FROM run GROUP BY status),
        every AS (SELECT * FROM counts UNION ALL SELECT 'words', sum(chapters)::BIGINT, sum(words_in)::BIGINT, sum(words_out)::BIGINT FROM counts WHERE status IN {R.WORKING} HAVING count(*) > 0)
        SELECT *, {S.percent("words_out::DOUBLE / greatest(words_in, 1)")} AS ratio FROM every""",
    "chapter_scan_marked": f"""{_P} SELECT page_id, book, (row_number() OVER (PARTITION BY book ORDER BY page_id) - 1)::BIGINT AS index, title, words
        FROM (SELECT page_id, {S.HOST} AS book, {S.title("html")} AS title, {S.words(S.page_text("html"))} AS words FROM output)""",
    "chapter_classify_marked": f"{_P}, {_CLASSIFIED} SELECT page_id, title, words, is_contents, is_reference, is_matter, passthrough FROM judged",
    "link_resolve_marked": f"{_P} SELECT page_id, book, kind, pos, ref, target, fragment, resolves FROM {checked('output')}",
    "anchors_referenced": f"""{_P} SELECT DISTINCT i.book, i.path, i.id FROM (SELECT {S.HOST} AS book, {_place()} AS path, unnest({_IDS}) AS id FROM source) i
        JOIN {checked("source")} l ON l.book = i.book AND l.target = i.path AND l.fragment = i.id""",
    "anchors_protected": f"{_ANCHORED} SELECT page_id, sha256(html) AS digest, array_to_string(ids, ' ') AS anchors FROM tokens",
    "anchors_restored": f"""{_ANCHORED}, rewritten AS (SELECT page_id, ids, replace({E.ANCHORED}, '⟦ANCHOR' || chr(92), '⟦ANCHOR') AS html FROM tokens),
        split AS (SELECT *, list_filter(ids, lambda x: contains(html, '⟦ANCHOR:' || x || '⟧')) AS held, list_filter(ids, lambda x: NOT contains(html, '⟦ANCHOR:' || x || '⟧')) AS lost FROM rewritten),
        made AS (SELECT page_id, lost, array_to_string(list_transform(lost, lambda x: '<a id="' || x || '"></a>'), '') || list_reduce(held,
            lambda h, x: replace(regexp_replace(h, '⟦ANCHOR:' || x || '⟧', '<a id="' || x || '"></a>'), '⟦ANCHOR:' || x || '⟧', ''), html) AS html FROM split)
        SELECT page_id, sha256(html) AS digest, array_to_string(lost, ' ') AS lost FROM made""",
    "page_ids": f"{_P} SELECT page_id, unnest({_IDS}) AS id FROM source",
    "stylesheet_refs": f"""{_P} SELECT page_id, (i - 1)::INT AS pos, l[i] AS sheet FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
        SELECT page_id, list_sort(list_distinct(list_transform({_SHEETS}, lambda ref: {S.TARGET}))) AS l FROM output))""",
    "style_classes": f"{_P} SELECT DISTINCT {S.HOST} AS book, {_STYLED} AS class FROM source",
    "tags_lost": f"""{_P}, was AS (SELECT page_id, lower(tag) AS tag, count(*) AS before FROM (SELECT page_id, unnest({every(S.visible("html"), H.START_TAG, 1)}) AS tag FROM source) GROUP BY ALL),
        now AS (SELECT page_id, lower(tag) AS tag, count(*) AS after FROM (SELECT page_id, unnest({every(S.visible("html"), H.START_TAG, 1)}) AS tag FROM output) GROUP BY ALL)
        SELECT page_id, tag, before, coalesce(after, 0) AS after FROM was LEFT JOIN now USING (page_id, tag) WHERE page_id IN (SELECT page_id FROM output) AND coalesce(after, 0) < before""",
    "duplicate_ids_marked": f"{_P} SELECT page_id, id, count(*) AS n FROM (SELECT page_id, unnest({_IDS}) AS id FROM output) GROUP BY ALL HAVING count(*) > 1",
    "heading_jumps_marked": f"{_P}, {_NOW} SELECT page_id, coalesce(jumps, 0) AS jumps FROM output LEFT JOIN {D.jumps('now')} USING (page_id)",
    "nav_entries": f"WITH {E.NAVIGATION_SQL}, was AS MATERIALIZED (SELECT * FROM {D.nodes('navigation')}), {D.entries()} SELECT * REPLACE (pre::INT AS pre, last::INT AS last, depth::INT AS depth) FROM entries",
    "nav_rebuilt": f"""WITH RECURSIVE {EDITIONS}, {E.NAVIGATION_SQL}, was AS MATERIALIZED (SELECT * FROM {D.nodes('navigation')}), {_WAS.replace("was AS", "page_nodes AS")},
        {D.rebuilt(_place(), "WITH RECURSIVE " + D.contents("page_nodes"))}""",
    "replies_continued": f"""{_CHAPTER}, pieces AS (SELECT doc_id, {E.PIECES[0]} AS a, {E.PIECES[1]} AS b FROM chapters), {_JOINED}
        SELECT doc_id, sha256(text) AS digest, (whole - length(text))::INT AS repeated FROM made""",
    "reply_fixes": f"""{_CHAPTER}, listed AS (SELECT doc_id, source, body, {E.LISTED} AS listed FROM chapters), replies AS (SELECT doc_id, {E.REVIEW} AS reply FROM listed),
        signs AS (SELECT doc_id, reply, unnest(list_filter(range(1, length(reply) + 1), lambda i: reply[i] = '{{')) AS i FROM replies),
        objects AS (SELECT doc_id, i, substr(reply, i, j - i + 1) AS object FROM (SELECT *, unnest(list_filter(range(i + 1, length(reply) + 1), lambda j: reply[j] = '}}')) AS j FROM signs)),
        first_of AS (SELECT doc_id, arg_min(object, i) AS object FROM objects WHERE CASE WHEN json_valid(object) THEN json_type(object, '$.fixes') = 'ARRAY' END GROUP BY doc_id),
        entries AS (SELECT doc_id, unnest(json_extract(object, '$.fixes[*]')) AS e, generate_subscripts(json_extract(object, '$.fixes[*]'), 1) AS nth FROM first_of),
        members AS (SELECT doc_id, nth, {", ".join(f"CASE WHEN json_type(e, '$.{n}') = 'VARCHAR' THEN json_extract_string(e, '$.{n}') END AS {n}" for n in ("sentence", "heading", "replacement", "source", "problem"))}
            FROM entries WHERE json_type(e) = 'OBJECT'),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(concat_ws('|', coalesce(sentence, '-'), coalesce(heading, '-'), replacement, coalesce(source, '-'), coalesce(problem, '-')), chr(10) ORDER BY nth) AS said
            FROM members WHERE replacement IS NOT NULL AND (coalesce({S.strip("sentence")}, '') <> '' OR coalesce({S.strip("heading")}, '') <> '') GROUP BY doc_id)
        SELECT doc_id, object IS NOT NULL AS found, coalesce(n, 0)::INT AS n, sha256(coalesce(said, '')) AS digest FROM replies LEFT JOIN first_of USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "reply_events": f"""{_CHAPTER}, cut AS (SELECT doc_id, {E.PIECES[0]} AS first, {E.PIECES[1]} AS second FROM chapters),
        lines AS (SELECT doc_id, unnest([{", ".join(E.EVENTS)}]) AS line, generate_subscripts([{", ".join("0" * len(E.EVENTS))}], 1) AS seq FROM cut WHERE NOT ({E.PLAIN_REPLY})),
        events AS (SELECT doc_id, seq, line FROM lines WHERE json_valid(line)),
        blocks AS (SELECT doc_id, seq, json_extract_string(line, '$.message.id') AS id, unnest(json_extract(line, '$.message.content[*]')) AS block FROM events WHERE json_extract_string(line, '$.type') = 'assistant'),
        messages AS (SELECT doc_id, id, min(seq) AS seq, string_agg(json_extract_string(block, '$.text'), '' ORDER BY seq) AS text FROM blocks WHERE json_extract_string(block, '$.type') = 'text' GROUP BY ALL),
        pieces AS (SELECT doc_id, coalesce(first(text ORDER BY seq), '') AS a, CASE WHEN count(*) > 1 THEN last(text ORDER BY seq) ELSE '' END AS b FROM messages WHERE text <> '' GROUP BY doc_id), {_JOINED},
        failed AS (SELECT doc_id FROM events WHERE json_extract_string(line, '$.type') = 'result' AND (line->>'$.is_error') = 'true'),
        replies AS (SELECT doc_id, {S.strip("CASE WHEN doc_id IN (SELECT doc_id FROM failed) THEN '' WHEN " + E.PLAIN_REPLY + " THEN ' plain ' || chr(10) || first ELSE coalesce(text, '') END")} AS reply FROM cut LEFT JOIN made USING (doc_id))
        SELECT doc_id, length(reply)::INT AS chars, sha256(reply) AS digest FROM replies""",
    "ill_formed_pages": f"""WITH xhtml AS (SELECT page_id, {E.URL} AS url, {E.XHTML_SIDES[0]} AS was, {E.XHTML_SIDES[1]} AS now, {E.NEW_PAGES} AS new FROM pages)
        SELECT page_id, 'problem' AS level, {_place()} AS place FROM xhtml WHERE now AND (new OR NOT was)""",
    "page_nodes": f"{_P}, {_WAS} SELECT page_id, pre::INT AS pre, last::INT AS last, parent::INT AS parent, depth::INT AS depth, after::INT AS after, tag, array_to_string(classes, ' ') AS classes, id, boxed FROM was WHERE pre IS NOT NULL",
    "page_wrappers": f"{_P}, {_NOW} SELECT page_id, unnest(wrappers) AS wrapper, unnest(range(0, len(wrappers)))::INT AS level FROM {D.wrappers('now')}",
    "leads_restored": f"{_P}, {_WAS}, {_NOW}, {D.restored()}",
    "wrappers_restored": f"""WITH RECURSIVE {E.SOURCE_SQL}, styled AS (SELECT page_id, {E.WRAPPED} AS html FROM source), bare AS (SELECT page_id, {E.UNWRAPPED} AS html FROM styled),
        was AS MATERIALIZED (SELECT * FROM {D.nodes('styled')}), now AS MATERIALIZED (SELECT * FROM {D.nodes('bare')}), {D.wrapped_again()}""",
    "spine_changes": f"{_P}, {SPINE} SELECT * FROM spine_all",
    "resources_lost": f"{_P}, {LOST} SELECT * FROM lost_all",
    "page_findings": f"{_P}, {_STYLES}, {page_findings('s.prose <> o.prose')} SELECT * FROM told_all",
    "untouched_findings": f"{_P}, {_STYLES}, {_CLASSIFIED}, {page_findings('o.page_id IN (SELECT page_id FROM judged WHERE wanted)')} SELECT * FROM told_all",
    "links_broken": f"{_P}, {BROKEN} SELECT * FROM broken_all",
    "nav_unresolved": f"{_P}, {NAV} SELECT * FROM nav_open",
    "nav_entries_lost": f"{_P}, {NAV} SELECT * FROM nav_lost_all",
    "findings_summary": f"""{FINDINGS} SELECT book, count(*) FILTER (level = 'problem') AS problems, count(*) FILTER (level = 'warning') AS warnings,
        {_SAID("problem")} || ', ' || {_SAID("warning")} AS said, count(*) FILTER (level = 'problem') > 0 AS failed FROM findings GROUP BY book""",
    "findings_report": f"""{FINDINGS}, ranked AS (
            SELECT book, row_number() OVER (PARTITION BY book ORDER BY level <> 'problem', kind, place, detail) AS nth, level || ': ' || kind || ' in ' || place || ': ' || detail AS line FROM findings WHERE level IS NOT NULL)
        SELECT book, nth::INT AS nth, line FROM ranked WHERE nth <= {I.REPORTED}
        UNION ALL SELECT book, {I.REPORTED + 1}, '… ' || (count(*) - {I.REPORTED}) || ' more' FROM findings WHERE level IS NOT NULL GROUP BY book HAVING count(*) > {I.REPORTED}""",
    "listings_matched": f"""{_P}, joined AS (SELECT coalesce(o.page_id, s.page_id) AS page_id, o.pos, s.pos AS original, o.key AS new, s.key AS old
            FROM {_listings("output")} o FULL JOIN {_listings("source")} s ON o.page_id = s.page_id AND o.key = s.key AND o.nth = s.nth),
        olds AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY original) AS k FROM joined WHERE pos IS NULL),
        news AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS k FROM joined WHERE original IS NULL),
        paired AS (SELECT coalesce(n.page_id, d.page_id) AS page_id, n.pos, d.original, n.pos IS NOT NULL AND d.original IS NOT NULL AND coalesce({_COMMON("d.old", "n.new")}::DOUBLE
            / greatest(len({_WORDS("d.old")}), len({_WORDS("n.new")}), 1) >= {B.SIMILAR}, false) AS good FROM news n FULL JOIN olds d ON n.page_id = d.page_id AND n.k = d.k),
        whole AS (SELECT *, bool_and(good) OVER (PARTITION BY page_id) AS every FROM paired)
        SELECT page_id, pos, original, 'text' AS how FROM joined WHERE pos IS NOT NULL AND original IS NOT NULL
        UNION ALL SELECT page_id, pos, CASE WHEN every THEN original END, CASE WHEN every THEN 'order' ELSE 'none' END FROM whole WHERE pos IS NOT NULL""",
    "link_classes": f"""{_P}, was AS (SELECT * FROM {_starts("source")} WHERE class IS NOT NULL), now AS (SELECT * FROM {_starts("output")} WHERE class IS NULL),
        by_href AS (SELECT page_id, href, first(class ORDER BY pos) AS of_href FROM was WHERE href <> '' GROUP BY ALL),
        by_id AS (SELECT page_id, id, last(class ORDER BY pos) AS of_id FROM was WHERE coalesce(href, '') = '' AND id IS NOT NULL GROUP BY ALL)
        SELECT * FROM (SELECT n.page_id, n.pos, CASE WHEN coalesce(n.href, '') <> '' THEN of_href ELSE of_id END AS class
        FROM now n LEFT JOIN by_href h ON n.page_id = h.page_id AND n.href = h.href LEFT JOIN by_id i ON n.page_id = i.page_id AND n.id = i.id) WHERE class IS NOT NULL""",
    "section_leads": f"{_P}, {_WAS} SELECT * FROM {D.leads('was')}",
    "captions": f"""{_P} SELECT * FROM (SELECT page_id, pos, {_LABEL} AS label, text FROM {_each("source", every("html", B.CAPTION, 1), f"page_id, pos, {_CAPTION_TEXT} AS text")}) WHERE label IS NOT NULL""",
    "captions_rewritten": f"""{_P}, {_NOW}, heads AS (SELECT * FROM (SELECT page_id, pos, {_LABEL} AS label, {_PLAIN} AS text FROM {_each("source", every("html", B.CAPTION, 1), f"page_id, pos, {_CAPTION_TEXT} AS text")}) WHERE label IS NOT NULL),
        old AS (SELECT page_id, label, arg_min(text, pos) AS original FROM heads GROUP BY ALL),
        beside AS (SELECT page_id, pre, {S.flat("text")} AS text FROM {D.texts("now", "x.tag = 'p' AND EXISTS (SELECT 1 FROM now s WHERE s.page_id = x.page_id AND s.tag IN ('pre', 'table') AND (s.pre = x.after OR s.after = x.pre))")}),
        paras AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY pre) - 1)::INT AS pos, text, {_LABEL} AS label, {S.strip(_PLAIN)} AS plain FROM beside)
        SELECT page_id, pos, label, text FROM paras JOIN old USING (page_id, label) WHERE length(plain) <= 2 * length(original) + 20
            AND {" = ".join(f"substr({t}, length(regexp_extract({t}, {q(T.CAPTION)}, 0)) + 1, 1)" for t in ("plain", "original"))}""",
    "callouts": f"""{_P}, {_WAS} SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY pre) - 1)::INT AS pos, tag, array_to_string(classes, ' ') AS class, boxed AS inside FROM was WHERE callout""",
    "note_candidates": f"""{_P}, {_WAS}, {_NOW}, notes AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY pre) - 1)::INT AS note, {_NORMAL("text")} AS a FROM {D.texts("was", "x.callout AND NOT x.boxed", without=D.HEADS)}),
        paras AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY pre) - 1)::INT AS pos, {_NORMAL("text")} AS b FROM {D.texts("now", "x.tag = 'p' AND NOT x.boxed")})
        SELECT page_id, note, pos, round(shared, 6) AS shared FROM (
            SELECT n.page_id, note, pos, {_COMMON("a", "b")}::DOUBLE / (len({_WORDS("a")}) + len({_WORDS("b")}) - {_COMMON("a", "b")}) AS shared FROM notes n JOIN paras p ON n.page_id = p.page_id WHERE a <> '' AND b <> ''
        ) WHERE shared >= {B.LEAST_SHARED}""",
    "contents_groups": f"WITH RECURSIVE {EDITIONS}, {_WAS}, {D.contents()}",
}
