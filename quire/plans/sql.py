"""DuckDB SQL for the registered queries, from the same fixed values."""

from __future__ import annotations

from ..functions import html as H
from ..functions import text as T
from ..operators import chapters as C
from ..operators import guards as G


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, {q(pattern)}, {q(by)}, 'g')"


def every(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {q(pattern)}, {group})"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(pattern)})"


def words(text: str) -> str:
    return f"len({every(text, f'[^{T.BLANK}]+')})"


def strip(text: str) -> str:
    return sub(text, rf"^[{T.BLANK}]+|[{T.BLANK}]+\z")


def flat(text: str) -> str:
    return strip(sub(text, f"[{T.BLANK}]+", " "))


def lines(text: str) -> str:
    return f"regexp_split_to_array({text}, {q(T.LINE_END)})"


def opening(text: str) -> str:
    made = f"list_transform({lines(text)}, lambda l: {sub(strip('l'), T.ANCHORS)})"
    return f"coalesce(list_filter({made}, lambda l: l <> '')[1], '')"


def is_title(line: str) -> str:
    return f"(starts_with({line}, '# ') OR {has(line, T.TITLE_TOKEN)})"


def percent(value: str) -> str:
    return f"(round_even(({value}) * 100, 0)::INT::VARCHAR || '%')"


def unescape(text: str) -> str:
    for name, sign in H.ENTITIES:
        text = f"replace({text}, {q(name)}, {q(sign)})"
    return text


def visible(html: str) -> str:
    return sub(sub(html, H.COMMENT), H.UNSEEN)


def page_text(html: str) -> str:
    return unescape(sub(visible(html), H.TAG))


def title(html: str) -> str:
    return flat(unescape(sub(f"regexp_extract({html}, {q(H.HEADING)}, 1)", H.TAG, " ")))


HOST = r"coalesce(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '')"
PATH = r"coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), ''), '/')"

def _clean(path: str) -> str:
    """A path without empty segments (the pages' links have no dotted ones)."""
    return f"('/' || array_to_string(list_filter(string_split({path}, '/'), lambda x: x <> '' AND x <> '.'), '/'))"


_BODY = f"(CASE WHEN regexp_extract(html, {q(H.BODY)}, 0) <> '' THEN regexp_extract(html, {q(H.BODY)}, 0) ELSE html END)"
_CLASSES = f"flatten(list_transform({every('inner_html', H.CLASSED, 1)}[:3], lambda c: regexp_split_to_array(c, {q(chr(92) + 's+')})))"


def _any(items: str, pattern: str) -> str:
    return f"len(list_filter({items}, lambda x: {has('x', pattern)})) > 0"


_CLASSIFIED = f"""
read AS (SELECT page_id, url, html, {_BODY} AS inner_html, {title("html")} AS title, {words(page_text("html"))} AS words FROM $pages),
marked AS (
    SELECT *, {_CLASSES} AS classes, {every("html", H.typed("body|section|nav|div"), 1)} AS all_types,
        list_concat({every("inner_html", H.typed("section|div"), 1)}[:3], {every("html", H.typed("body"), 1)}) AS types
    FROM read
),
classified AS (
    SELECT page_id, url, html, title, words, {has("html", H.CONTENTS)} AS is_contents,
        {has("title", H.REFERENCE_TITLE)} OR {_any("all_types", H.word_in(H.REFERENCE_WORD))} OR {_any("classes", f"(?i)^(?:{H.REFERENCE_WORD})" + chr(92) + "z")} AS is_reference,
        NOT ({has("title", H.INTRODUCTION)} OR {_any("types", H.word_in(H.CHAPTER_WORD))})
            AND ({has("title", H.MATTER_TITLE)} OR {_any("types", H.word_in(H.MATTER_WORD))} OR {_any("classes", H.MATTER_CLASS)}
                OR (words < {H.SHORT_MATTER} AND contains(lower({sub(visible("inner_html"), H.TAG, " ")}), 'all rights reserved'))) AS is_matter
    FROM marked
),
judged AS (
    SELECT *, is_contents OR is_reference OR is_matter AS passthrough, NOT (is_contents OR is_reference OR is_matter) AND words >= {C.MIN_WORDS} AS wanted FROM classified
)
"""
CLASSIFIED = _CLASSIFIED.replace("$pages", "pages")

PAIRS = """
pairs AS (
    SELECT a.conv_id, a.turn, coalesce(a.text, '') AS source, coalesce(b.text, '') AS output
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn WHERE a.role = 'assistant' AND b.role = 'user'
)
"""
REPLIES = PAIRS.replace("'assistant'", "'?'").replace("'user'", "'assistant'").replace("'?'", "'user'")
_IN, _OUT = words("source"), words("output")


def share(source: str, output: str) -> str:
    return f"({words(output)}::DOUBLE / greatest({words(source)}, 1))"


def body_problem(source: str, body: str) -> str:
    last = f"regexp_replace(coalesce(list_filter({lines(body)}, lambda l: {strip('l')} <> '')[-1], ''), {q(f'^[{T.BLANK}]+')}, '')"
    ratio = share(source, body)
    return f"""CASE
        WHEN {is_title(opening(source))} AND NOT {is_title(opening(body))} THEN 'body does not open with the chapter title'
        WHEN {has(body, T.UNCLOSED)} THEN 'body cut off inside a ⟦token⟧'
        WHEN starts_with({last}, '#') THEN 'body ends on a bare heading'
        WHEN {ratio} < {G.LEAST_BODY} THEN 'body is ' || {percent(ratio)} || ' of the chapter' ELSE '' END"""


def banned(source: str, output: str) -> str:
    each = ", ".join(f"CASE WHEN {has(output, T.bounded(s))} AND NOT {has(source, T.bounded(s))} THEN '{s}' END" for s in T.BANNED)
    return f"list_filter([{each}], lambda x: x IS NOT NULL)"


#: A fence of three signs up to the next of that sign: this engine's patterns can't refer back.
FENCED = "(?ms)^[ \\t]*```.*?^[ \\t]*```[^\\n]*|^[ \\t]*~~~.*?^[ \\t]*~~~[^\\n]*"


def revision_problem(source: str, before: str, after: str) -> str:
    plain = lambda t, test: f"list_filter(list_transform({lines(sub(t, FENCED))}, lambda x: {strip('x')}), lambda x: {test})"
    headings = lambda t: plain(t, has("x", G.HEADING))
    tables = lambda t: plain(t, "starts_with(x, '|')")
    code = lambda t: f"list_transform({every(t, FENCED)}, lambda x: {strip('x')})"
    tokens = lambda t: f"list_sort(list_distinct({every(t, T.TOKEN)}))"
    links = lambda t: every(t, G.LINK, 1)
    ratio = share(before, after)
    problem = body_problem(source, after)
    return f"""CASE
        WHEN ({problem}) <> '' THEN ({problem})
        WHEN {tokens(before)} <> {tokens(after)} THEN '⟦tokens⟧ changed'
        WHEN {headings(before)} <> {headings(after)} THEN 'headings changed'
        WHEN {code(before)} <> {code(after)} THEN 'code changed'
        WHEN {tables(before)} <> {tables(after)} THEN 'tables changed'
        WHEN len(list_filter({links(before)}, lambda x: NOT list_contains({links(after)}, x))) > 0 THEN 'a link was dropped'
        WHEN len({banned(source, after)}) > 0 THEN 'banned word'
        WHEN {ratio} < {G.REVISED[0]}::DOUBLE OR {ratio} > {G.REVISED[1]}::DOUBLE THEN 'length ' || {percent(ratio)} || ' of the body' ELSE '' END"""


def upgraded(source: str, cached: str) -> str:
    """The retired tail begins at the first heading of key points after which no other heading comes but that of questions."""
    head = "chr(10) || '## Key points' || chr(10)"
    parts = f"string_split({cached}, {head})"
    tail = f"array_to_string({parts}[i + 1:], {head})"
    after = f"regexp_extract({tail}, '(?s)\\n#{{1,2}} .*', 0)"
    found = f"list_filter(range(1, len({parts})), lambda i: {after} = '' OR starts_with({after}, chr(10) || '## Check yourself' || chr(10)))[1]"
    cut = f"(CASE WHEN {has(source, '(?im)^#+' + chr(92) + 's*key points' + chr(92) + 's*$')} OR {found} IS NULL THEN {cached} ELSE array_to_string({parts}[:{found}], {head}) END)"
    kept = strip(cut)
    first = "string_split(kept, chr(10))[1]"
    rest = "substr(kept, length(string_split(kept, chr(10))[1]) + 2)"
    doubled = f"{is_title(first)} AND {opening(rest)} = {strip(first)}"
    return f"(SELECT {strip(f'(CASE WHEN {doubled} THEN {rest} ELSE kept END)')} FROM (SELECT {kept} AS kept))"


def links(pages: str) -> str:
    refs = " UNION ALL ".join(
        f"SELECT page_id, url, '{k}' AS kind, (i - 1)::INT AS pos, {unescape('refs[i]')} AS ref FROM (SELECT page_id, url, refs, unnest(range(1, len(refs) + 1)) AS i FROM (SELECT page_id, url, {every('html', p, 1)} AS refs FROM {pages}))"
        for k, p in H.LINKS.items()
    )
    return f"(SELECT * FROM ({refs}) WHERE NOT {has('ref', H.EXTERNAL)})"


LINKS = f"links AS {links('pages')}"


def resolving(rows: str, pages: str) -> str:
    """``rows(book, target, fragment)`` with ``resolves``."""
    ids = f"SELECT DISTINCT {HOST} AS book, {_clean(PATH)} AS target, unnest({every('html', H.IDS, 1)}) AS fragment FROM {pages}"
    return f"""(SELECT r.*, t.target IS NOT NULL AND (r.fragment = '' OR i.fragment IS NOT NULL) AS resolves FROM {rows} r
        LEFT JOIN (SELECT DISTINCT {HOST} AS book, {_clean(PATH)} AS target FROM {pages}) t ON r.book = t.book AND r.target = t.target
        LEFT JOIN ({ids}) i ON r.book = i.book AND r.target = i.target AND r.fragment = i.fragment)"""


_TO = "url_decode(replace(regexp_replace(ref, '[?#].*', ''), '+', '%2B'))"
TARGET = _clean(f"(CASE WHEN {_TO} = '' THEN {PATH} WHEN starts_with({_TO}, '/') THEN {_TO} ELSE regexp_replace({PATH}, '[^/]*$', '') || {_TO} END)")
FRAGMENT = "url_decode(replace(regexp_extract(ref, '#(.*)', 1), '+', '%2B'))"
TARGETS = f"targets AS (SELECT page_id, {HOST} AS book, kind, pos, ref, {TARGET} AS target, {FRAGMENT} AS fragment FROM links)"
_STEMS = "list_filter([" + ", ".join(f"CASE WHEN {has('text', T.bounded(s))} THEN '{s}' END" for s in T.BANNED) + "], lambda x: x IS NOT NULL)"
_LEVELS = f"list_transform({every('html', '(?i)<h([1-6])(?:' + chr(92) + 's[^>]*)?>', 1)}, lambda x: x::INT)"

QUERIES = {
    "chapter_scan": f"""SELECT page_id, book, (row_number() OVER (PARTITION BY book ORDER BY page_id) - 1)::BIGINT AS index, title, words
        FROM (SELECT page_id, {HOST} AS book, {title("html")} AS title, {words(page_text("html"))} AS words FROM pages)""",
    "chapter_classify": f"WITH {CLASSIFIED} SELECT page_id, title, words, is_contents, is_reference, is_matter, passthrough FROM judged",
    "rewrite_select": f"WITH {CLASSIFIED} SELECT page_id, title, words FROM judged WHERE wanted",
    "results_summary": f"""WITH {CLASSIFIED} SELECT CASE WHEN wanted THEN 'eligible' ELSE 'skipped' END AS status, count(*) AS chapters, sum(words)::BIGINT AS words_in
        FROM judged GROUP BY ALL""",
    "primer_excerpts": f"""WITH {CLASSIFIED} SELECT page_id, '## Chapter ' || page_id || ': ' || CASE WHEN title <> '' THEN title ELSE url END || chr(10) || '(' || words || ' words) '
        || array_to_string({every(page_text("html"), f"[^{T.BLANK}]+")}[:{C.EXCERPT_WORDS}], ' ') AS excerpt FROM judged WHERE wanted""",
    "length_contract": f"""WITH {CLASSIFIED} SELECT page_id, floor(words * {T.LEAST_SHARE}::DOUBLE)::BIGINT AS least_words, floor(words * {T.MOST_SHARE}::DOUBLE)::BIGINT AS most_words
        FROM judged WHERE wanted""",
    "source_digests": "SELECT page_id, substr(sha256(html), 1, 8) AS digest FROM pages",
    "cache_misses": f"""WITH {CLASSIFIED} SELECT page_id, title FROM judged
        WHERE wanted AND sha256(html) NOT IN (SELECT sha256(html) FROM judged WHERE wanted AND words < 2 * {C.MIN_WORDS})""",
    "word_counts": f"SELECT doc_id, {words('text')} AS words FROM documents",
    "opening_lines": f"SELECT doc_id, {opening('text')} AS opening, {is_title(opening('text'))} AS titled FROM documents",
    "token_scan": f"""SELECT doc_id, len({every("text", T.TOKEN)}) AS tokens, {has("text", T.UNCLOSED)} AS unclosed, length({sub("text", T.TOKEN)}) AS plain_chars FROM documents""",
    "banned_words": f"SELECT doc_id, array_to_string({_STEMS}, ',') AS banned FROM documents",
    "markdown_residue": f"SELECT doc_id, len({every('text', '(?m)' + T.RESIDUE)}) AS marks FROM documents",
    "shown_measures": """SELECT doc_id, CASE WHEN b IS NULL THEN '-' WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0::DOUBLE)
            WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0::DOUBLE) ELSE printf('%.1f GB', b / 1073741824.0::DOUBLE) END AS size,
        CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN printf('%dm%02ds', s // 60, s % 60) ELSE printf('%dh%02dm', s // 3600, s % 3600 // 60) END AS time
        FROM (SELECT doc_id, n_chars * 640 AS b, n_chars AS s FROM documents)""",
    "sane_pairs": f"""WITH {PAIRS} SELECT conv_id, turn, {_OUT} >= greatest({_IN}, 1) * {G.SANE[0]}::DOUBLE AND {_OUT} <= greatest({_IN}, 1) * {G.SANE[1]}::DOUBLE AS sane FROM pairs""",
    "ratio_pairs": f"WITH {PAIRS} SELECT conv_id, turn, {_IN} AS words_in, {_OUT} AS words_out, {percent(share('source', 'output'))} AS ratio FROM pairs",
    "sane_replies": f"""WITH {REPLIES} SELECT conv_id, turn, {_OUT} >= greatest({_IN}, 1) * {G.SANE[0]}::DOUBLE AND {_OUT} <= greatest({_IN}, 1) * {G.SANE[1]}::DOUBLE AS sane FROM pairs""",
    "ratio_replies": f"WITH {REPLIES} SELECT conv_id, turn, {_IN} AS words_in, {_OUT} AS words_out, {percent(share('source', 'output'))} AS ratio FROM pairs",
    "revision_guard": f"WITH {PAIRS} SELECT conv_id, turn, {revision_problem('source', 'source', 'output')} AS problem FROM pairs",
    "cache_upgrade": f"WITH {PAIRS} SELECT conv_id, turn, {upgraded('source', 'output')} AS upgraded FROM pairs",
    "body_problem_pairs": f"WITH {PAIRS} SELECT conv_id, turn, {body_problem('source', 'output')} AS problem FROM pairs",
    "evidence_containment": f"""WITH {PAIRS} SELECT conv_id, turn, {flat("e")} <> '' AND contains({flat("source")}, {flat("e")}) AS held
        FROM (SELECT conv_id, turn, source, {opening("output")} AS e FROM pairs)""",
    "link_extract": f"WITH {LINKS} SELECT page_id, kind, pos, ref FROM links",
    "link_resolve": f"WITH {LINKS}, {TARGETS} SELECT page_id, book, kind, pos, ref, target, fragment, resolves FROM {resolving('targets', 'pages')}",
    "nav_lost": f"""WITH {CLASSIFIED}, {LINKS}, {TARGETS} SELECT book, target FROM targets
        EXCEPT SELECT book, target FROM targets WHERE page_id IN (SELECT page_id FROM judged WHERE wanted)""",
    "tag_counts": f"""SELECT page_id, lower(tag) AS tag, count(*) AS n FROM (SELECT page_id, unnest({every(visible("html"), H.START_TAG, 1)}) AS tag FROM pages) GROUP BY ALL""",
    "duplicate_ids": f"""SELECT page_id, id, count(*) AS n FROM (SELECT page_id, unnest({every("html", H.IDS, 1)}) AS id FROM pages) GROUP BY ALL HAVING count(*) > 1""",
    "heading_jumps": f"""SELECT page_id, len(list_filter(range(1, len(levels)), lambda i: levels[i + 1] > levels[i] + 1)) AS jumps
        FROM (SELECT page_id, {_LEVELS} AS levels FROM pages)""",
}
