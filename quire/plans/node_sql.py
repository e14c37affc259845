"""DuckDB SQL for the nodes of pages, and for what is read from them."""

from __future__ import annotations

from ..functions import html as H
from ..functions import nodes as N
from ..functions import text as T
from ..operators import blocks as B
from ..operators import wrappers as W
from . import sql as S
from .sql import has, q, sub


def value(name: str) -> str:
    return f"""CASE WHEN {has("raw", f'[\\s"]{name}="')} THEN {S.unescape(f"""regexp_extract(raw, {q(f'[\\s"]{name}="([^"]*)"')}, 1)""")} END"""


def nodes(pages: str) -> str:
    """A row for each event of a page; the open elements are carried from event to event by a recursive query."""
    void = ", ".join(f"'{v}'" for v in (*N.VOID, "script", "style"))
    return f"""(WITH RECURSIVE ev AS (
        SELECT page_id, unnest(l) AS raw, unnest(range(0, len(l))) AS i FROM (SELECT page_id, regexp_extract_all(html, {q(N.EVENT)}) AS l FROM {pages})
    ), kinds AS MATERIALIZED (
        SELECT *, sum((kind IN (1, 2, 3))::INT) OVER (PARTITION BY page_id ORDER BY i) - 1 AS pre FROM (
            SELECT *, lower(regexp_extract(raw, {q(N.NAME)}, 1)) AS name,
                CASE WHEN name <> '' AND starts_with(raw, '</') THEN 4 WHEN name IN ({void}) OR name <> '' AND ends_with(raw, '/>') THEN 3 WHEN name <> '' THEN 2
                    WHEN raw = '<' OR NOT starts_with(raw, '<') AND {S.flat("raw")} <> '' THEN 1 ELSE 0 END AS kind FROM ev)
    ), stacks AS (
        SELECT DISTINCT page_id, -1::BIGINT AS i, []::BIGINT[] AS opened, []::VARCHAR[] AS names, []::BIGINT[] AS closed FROM kinds
        UNION ALL
        SELECT page_id, i, CASE WHEN kind = 2 THEN list_append(opened, i) WHEN nth > 0 THEN opened[:nth - 1] ELSE opened END,
            CASE WHEN kind = 2 THEN list_append(names, name) WHEN nth > 0 THEN names[:nth - 1] ELSE names END, CASE WHEN nth > 0 THEN opened[nth:] ELSE [] END
        FROM (SELECT k.*, s.opened, s.names, CASE WHEN kind = 4 THEN coalesce(list_max(list_filter(range(1, len(s.names) + 1), lambda j: s.names[j] = k.name)), 0) ELSE 0 END AS nth
            FROM stacks s JOIN kinds k ON k.page_id = s.page_id AND k.i = s.i + 1)
    ), ends AS (SELECT page_id, unnest(closed) AS i, i AS until FROM stacks
    ), whole AS (SELECT page_id, max(i) AS until FROM kinds GROUP BY page_id
    ), spans AS (
        SELECT k.page_id, k.i, kind, raw, CASE WHEN kind = 1 THEN '#text' WHEN kind IN (2, 3) THEN name END AS tag, CASE WHEN kind IN (1, 2, 3) THEN k.pre END AS pre,
            CASE WHEN kind IN (1, 2, 3) THEN len(s.opened) + 1 END AS depth, CASE WHEN kind IN (1, 2, 3) THEN s.opened[-1] END AS held,
            CASE WHEN kind = 2 THEN coalesce(e.until, w.until) ELSE k.i END AS until,
            CASE WHEN kind IN (2, 3) THEN list_filter(regexp_split_to_array(coalesce({value("class")}, ''), '\\s+'), lambda c: c <> '') END AS classes, CASE WHEN kind IN (2, 3) THEN {value("id")} END AS id
        FROM kinds k JOIN stacks s ON k.page_id = s.page_id AND k.i = s.i + 1 JOIN whole w ON k.page_id = w.page_id LEFT JOIN ends e ON k.page_id = e.page_id AND k.i = e.i
    ), lasts AS (SELECT s.*, CASE WHEN s.pre IS NOT NULL THEN CASE WHEN s.kind = 2 THEN u.pre ELSE s.pre END END AS last FROM spans s JOIN kinds u ON s.page_id = u.page_id AND s.until = u.i
    ), parents AS (
        SELECT c.*, CASE WHEN c.pre IS NOT NULL THEN coalesce(p.pre, -1) END AS parent,
            c.kind = 2 AND c.tag IN ('aside', 'div', 'section') AND len(list_filter(c.classes, lambda x: {has("x", H.CALLOUT)})) > 0 AS callout
        FROM lasts c LEFT JOIN lasts p ON c.page_id = p.page_id AND c.held = p.i
    ), boxes AS (SELECT page_id, pre, last FROM parents WHERE callout
    ), boxed AS (SELECT DISTINCT n.page_id, n.pre FROM parents n JOIN boxes b ON n.page_id = b.page_id AND n.pre > b.pre AND n.pre <= b.last
    ), before AS (SELECT page_id, pre, lag(pre) OVER (PARTITION BY page_id, parent ORDER BY pre) AS after FROM parents WHERE kind IN (2, 3)
    )
    SELECT p.*, b.after, x.pre IS NOT NULL AS boxed FROM parents p LEFT JOIN before b ON p.page_id = b.page_id AND p.pre = b.pre LEFT JOIN boxed x ON p.page_id = x.page_id AND p.pre = x.pre)"""


def wrappers(of: str) -> str:
    """(page_id, wrappers): an element holds all of the body if the body has no other nodes than it, those inside, and those around it."""
    return f"""(SELECT b.page_id, list(array_to_string(list_concat([x.tag], x.classes), '.') ORDER BY x.pre) FILTER (x.pre IS NOT NULL) AS wrappers
        FROM (SELECT * FROM {of} WHERE tag = 'body') b LEFT JOIN {of} x ON b.page_id = x.page_id AND x.kind IN (2, 3) AND x.pre > b.pre AND x.pre <= b.last AND b.last - b.pre = x.last - x.pre + x.depth - b.depth
        GROUP BY b.page_id)"""


def jumps(of: str) -> str:
    return f"""(SELECT page_id, count(*) FILTER (level > before + 1) AS jumps FROM (
        SELECT page_id, level, lag(level) OVER (PARTITION BY page_id ORDER BY pre) AS before FROM (SELECT page_id, pre, substr(tag, 2, 1)::INT AS level FROM {of} WHERE regexp_full_match(tag, 'h[1-6]') AND NOT boxed)
    ) GROUP BY page_id)"""


def texts(of: str, where: str, spaced: bool = True, without: str = "false") -> str:
    """(page_id, pre, ...) of the nodes x for which ``where`` holds, with the texts inside, but for those inside elements y for which ``without`` holds."""
    raw = f"string_agg(t.raw, '{' ' if spaced else ''}' ORDER BY t.pre)"
    return f"""(SELECT x.page_id, x.pre, any_value(x.tag) AS tag, any_value(x.id) AS id, {S.unescape(f"coalesce({raw}, '')")} AS text
        FROM (SELECT * FROM {of} x WHERE {where}) x LEFT JOIN {of} t ON x.page_id = t.page_id AND t.kind = 1 AND t.pre > x.pre AND t.pre <= x.last
            AND NOT EXISTS (SELECT 1 FROM {of} y WHERE y.page_id = t.page_id AND ({without}) AND y.pre > x.pre AND y.pre < t.pre AND t.pre <= y.last)
        GROUP BY x.page_id, x.pre)"""


HEADS = "regexp_full_match(y.tag, 'h[1-6]')"


def leads(of: str) -> str:
    """(page_id, lead, n, sections)"""
    return f"""(WITH heads AS (SELECT page_id, pre FROM {of} WHERE regexp_full_match(tag, 'h[2-4]')), sections AS (SELECT page_id, count(*) AS sections FROM heads GROUP BY page_id),
        firsts AS (SELECT p.page_id, p.pre, array_to_string(p.classes, ' ') AS lead FROM {of} p JOIN heads h ON p.page_id = h.page_id AND p.after = h.pre WHERE p.tag = 'p'),
        counts AS (SELECT page_id, lead, count(*) AS n, min(pre) AS first FROM firsts GROUP BY ALL),
        best AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, first) AS nth FROM counts)
        SELECT page_id, lead, n, sections FROM best JOIN sections USING (page_id) WHERE nth = 1 AND lead <> '' AND 2 * n >= sections)"""


def restored() -> str:
    """(page_id, digest, restored) over the nodes ``was`` and ``now`` of both editions."""
    return f"""lead AS (SELECT * FROM {leads("was")}),
        bare AS (SELECT p.page_id, p.i FROM now p JOIN now h ON p.page_id = h.page_id AND p.after = h.pre AND regexp_full_match(h.tag, 'h[2-4]')
            WHERE p.tag = 'p' AND len(p.classes) = 0 AND EXISTS (SELECT 1 FROM now t WHERE t.page_id = p.page_id AND t.kind = 1 AND t.pre > p.pre AND t.pre <= p.last)),
        made AS (SELECT n.page_id, string_agg(CASE WHEN b.i IS NULL THEN raw ELSE '<p class="' || lead || '"' || substr(raw, 3) END, '' ORDER BY n.i) AS html, count(b.i) AS restored
            FROM now n JOIN lead USING (page_id) LEFT JOIN bare b ON n.page_id = b.page_id AND n.i = b.i GROUP BY n.page_id)
        SELECT page_id, sha256(html) AS digest, restored::INT AS restored FROM made WHERE restored > 0"""


def contents(was: str = "was") -> str:
    """The contents of the nodes ``was``; identifiers are given heading by heading."""
    text = S.flat("text")
    slug = f"'sec-' || coalesce(nullif(substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, {T.SLUG_LENGTH}), ''), 'x')"
    return f"""heads AS (
            SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY pre) - 1)::INT AS pos, substr(tag, 2, 1)::INT AS level, {text} AS text, coalesce(id, '') AS id
            FROM {texts(was, "regexp_full_match(x.tag, 'h[1-4]') AND NOT x.boxed")}),
        deep AS (SELECT *, level - min(level) OVER (PARTITION BY page_id) + 1 AS depth FROM heads WHERE pos > 0 AND text <> ''),
        listed AS (SELECT page_id, pos, depth, text, id, {slug} AS base, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS nth FROM deep WHERE depth <= 2),
        given AS (
            SELECT page_id, 0::BIGINT AS nth, coalesce(list(id) FILTER (id IS NOT NULL), []) AS taken, '' AS own FROM {was} GROUP BY page_id
            UNION ALL
            SELECT page_id, nth, list_append(taken, own), own FROM (
                SELECT l.page_id, l.nth, g.taken, CASE WHEN l.id <> '' THEN l.id WHEN NOT list_contains(g.taken, base) THEN base
                    ELSE base || '-' || list_min(list_filter(range(2, len(g.taken) + 3), lambda k: NOT list_contains(g.taken, base || '-' || k))) END AS own
                FROM given g JOIN listed l ON l.page_id = g.page_id AND l.nth = g.nth + 1)),
        grouped AS (SELECT *, sum((depth = 1 OR nth = 1)::INT) OVER (PARTITION BY page_id ORDER BY nth) AS grp FROM listed)
        SELECT c.page_id, grp::BIGINT AS grp, pos, depth, text, '#' || own AS href, 'toc-' || regexp_replace('#' || own, {q("[^" + chr(92) + "p{L}" + chr(92) + "p{N}_-]")}, '-', 'g') AS uid
        FROM grouped c JOIN given g ON c.page_id = g.page_id AND c.nth = g.nth"""


def entries() -> str:
    """``entries`` over the nodes ``was`` of the pages ``navigation``: for each item all links under it are looked at."""
    label = S.flat("text")
    href = value("href")
    return f"""navs AS (SELECT page_id, pre, last, {value("epub:type")} AS nav FROM was WHERE tag = 'nav'),
        hrefs AS (SELECT w.page_id, url, nav, w.pre, w.parent, {href} AS ref FROM was w JOIN navs n ON w.page_id = n.page_id AND w.pre > n.pre AND w.pre <= n.last JOIN navigation g ON w.page_id = g.page_id WHERE w.tag = 'a' AND {href} IS NOT NULL),
        led AS (SELECT *, CASE WHEN NOT {has("ref", H.EXTERNAL)} THEN {S.TARGET} END AS target, {S.HOST} AS book FROM hrefs),
        labels AS (SELECT page_id, pre, {label} AS label FROM {texts("was", "x.tag = 'a'")}),
        entries AS (
            SELECT l.page_id, l.book, l.nav, i.pre, i.last, i.depth, array_to_string(i.classes, ' ') AS class, l.ref AS href, label, l.target,
                l.target IS NOT NULL AND NOT EXISTS (SELECT 1 FROM led o WHERE o.page_id = l.page_id AND o.pre > i.pre AND o.pre <= i.last AND o.target IS DISTINCT FROM l.target) AS sole
            FROM led l JOIN was i ON l.page_id = i.page_id AND l.parent = i.pre AND i.tag = 'li' JOIN labels b ON b.page_id = l.page_id AND b.pre = l.pre
            QUALIFY row_number() OVER (PARTITION BY l.page_id, i.pre ORDER BY l.pre) = 1)"""


def rebuilt(place: str, heads: str) -> str:
    """Entries with the headings of ``heads(page_id, pos, depth, text, href)`` for rewritten pages of ``source``."""
    return f"""{entries()},
        rewritten AS (SELECT page_id, {S.HOST} AS book, {place} AS target FROM source WHERE page_id % 3 = 0),
        firsts AS (SELECT e.* FROM entries e WHERE sole AND {has("nav", chr(92) + "btoc" + chr(92) + "b")} AND EXISTS (SELECT 1 FROM rewritten r WHERE r.book = e.book AND r.target = e.target)
            QUALIFY row_number() OVER (PARTITION BY page_id, target ORDER BY pre) = 1),
        gone AS (SELECT e.page_id, e.pre, e.class, f.pre AS f_pre FROM entries e JOIN firsts f ON e.page_id = f.page_id AND e.pre > f.pre AND e.pre <= f.last)
        SELECT page_id, nav, pre::INT AS pre, 0 AS nth, depth::INT AS depth, class, href, label FROM entries e
        WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.page_id = e.page_id AND g.pre = e.pre)
            AND NOT ({has("nav", chr(92) + "bpage-list" + chr(92) + "b")} AND EXISTS (SELECT 1 FROM rewritten r WHERE r.book = e.book AND r.target = e.target))
        UNION ALL
        SELECT f.page_id, f.nav, f.pre::INT, c.pos, (f.depth + 2 * c.depth)::INT, coalesce((SELECT first(class ORDER BY pre) FROM gone g WHERE g.page_id = f.page_id AND g.f_pre = f.pre), ''),
            regexp_replace(f.href, '#.*', '') || c.href, c.text
        FROM firsts f JOIN rewritten r ON r.book = f.book AND r.target = f.target JOIN ({heads}) c ON c.page_id = r.page_id WHERE c.page_id % 5 <> 0"""


def _listed(names: tuple[str, ...]) -> str:
    return ", ".join(q(n) for n in names)


def _blocks(of: str) -> str:
    """(page_id, pre, i, until, tag, class, up_tag, up_class, ids, text) of the blocks among the nodes ``of``."""
    normal = f"lower({S.flat(sub('t.text', T.CLOSED_TOKEN))})"
    inside = f"(SELECT coalesce(list(y.id), []) FROM {of} y WHERE y.page_id = x.page_id AND y.pre > x.pre AND y.pre <= x.last AND y.id IS NOT NULL)"
    return f"""(SELECT x.page_id, x.pre, x.i, x.until, x.tag, array_to_string(x.classes, ' ') AS class, u.tag AS up_tag, array_to_string(u.classes, ' ') AS up_class, {inside} AS ids, {normal} AS text
        FROM {of} x JOIN {texts(of, f"x.kind = 2 AND x.tag IN ({_listed(W.BLOCKS)})")} t ON x.page_id = t.page_id AND x.pre = t.pre LEFT JOIN {of} u ON x.page_id = u.page_id AND x.parent = u.pre)"""


def wrapped_again() -> str:
    """(page_id, digest, restored) over the nodes ``was`` and ``now``: all pairs of wrapper and block are listed, then each wrapper in turn takes its first free one."""
    near = f"{W.EDITED} * (2 * levenshtein(w.text, b.text) - abs(length(w.text) - length(b.text))) <= length(w.text) + length(b.text)"
    same = f"len(w.ids) = 0 AND length(w.text) >= {W.LEAST_TEXT} AND (w.text = b.text OR w.block <> 'p' AND {near})"
    return f"""was_blocks AS MATERIALIZED (SELECT * FROM {_blocks("was")}), now_blocks AS MATERIALIZED (SELECT * FROM {_blocks("now")}),
        kids AS (SELECT p.page_id, p.pre AS w, c.pre AS b FROM was p JOIN was c ON c.page_id = p.page_id AND c.parent = p.pre
            WHERE p.kind = 2 AND p.tag IN ({_listed(W.WRAPPERS)}) AND len(p.classes) > 0 AND NOT p.callout
                AND NOT EXISTS (SELECT 1 FROM was m WHERE m.page_id = p.page_id AND m.tag = 'img' AND m.pre > p.pre AND m.pre <= p.last)
                AND (c.tag <> 'a' OR EXISTS (SELECT 1 FROM was t WHERE t.page_id = c.page_id AND t.kind = 1 AND t.pre > c.pre AND t.pre <= c.last))),
        sole AS (SELECT page_id, w, min(b) AS b FROM kids GROUP BY page_id, w HAVING count(*) = 1),
        wraps AS (SELECT s.page_id, row_number() OVER (PARTITION BY s.page_id ORDER BY s.w) AS n, p.tag, array_to_string(p.classes, ' ') AS class, p.raw AS start, p.id, b.tag AS block, b.class AS block_class, b.ids, b.text
            FROM sole s JOIN was p ON p.page_id = s.page_id AND p.pre = s.w JOIN was_blocks b ON b.page_id = s.page_id AND b.pre = s.b),
        fits AS (SELECT w.page_id, w.n, w.tag || '.' || w.class AS kind, coalesce(list(b.i ORDER BY b.i) FILTER (b.i IS NOT NULL), []) AS places
            FROM wraps w LEFT JOIN now_blocks b ON b.page_id = w.page_id AND b.tag = w.block AND (b.up_tag, b.up_class) IS DISTINCT FROM (w.tag, w.class)
                AND (len(w.ids) > 0 AND list_has_any(w.ids, b.ids) OR {same}) GROUP BY ALL),
        picked AS (
            SELECT DISTINCT page_id, 0::BIGINT AS n, []::VARCHAR[] AS used, NULL::BIGINT AS i FROM wraps
            UNION ALL
            SELECT page_id, n, CASE WHEN i IS NULL THEN used ELSE list_append(used, i || ' ' || kind) END, i
            FROM (SELECT f.page_id, f.n, f.kind, p.used, list_filter(f.places, lambda x: NOT list_contains(p.used, x || ' ' || f.kind))[1] AS i FROM picked p JOIN fits f ON f.page_id = p.page_id AND f.n = p.n + 1)),
        made AS (SELECT w.*, b.i, b.until - (starts_with(u.raw, '</') AND lower(regexp_extract(u.raw, {q(N.NAME)}, 1)) <> b.tag)::INT AS until, b.class AS own, CASE WHEN EXISTS (SELECT 1 FROM now t WHERE t.page_id = w.page_id AND t.id = w.id) THEN regexp_replace(w.start, '\\sid="[^"]*"', '') ELSE w.start END AS opened
            FROM picked p JOIN wraps w ON w.page_id = p.page_id AND w.n = p.n JOIN now_blocks b ON b.page_id = p.page_id AND b.i = p.i JOIN now u ON u.page_id = b.page_id AND u.i = b.until),
        starts AS (SELECT page_id, i, string_agg(opened, '' ORDER BY n) AS opened, first(block_class ORDER BY n) FILTER (own = '' AND block_class <> '') AS class FROM made GROUP BY page_id, i),
        ends AS (SELECT page_id, until AS i, string_agg('</' || tag || '>', '' ORDER BY i DESC, n DESC) AS closed FROM made GROUP BY page_id, until)
        SELECT x.page_id, sha256(string_agg(coalesce(s.opened, '') || CASE WHEN s.class IS NULL THEN x.raw ELSE '<' || x.tag || ' class="' || s.class || '"' || substr(x.raw, length(x.tag) + 2) END || coalesce(e.closed, ''), '' ORDER BY x.i)) AS digest,
            (SELECT count(*) FROM made m WHERE m.page_id = x.page_id)::INT AS restored
        FROM now x LEFT JOIN starts s ON s.page_id = x.page_id AND s.i = x.i LEFT JOIN ends e ON e.page_id = x.page_id AND e.i = x.i
        WHERE x.page_id IN (SELECT page_id FROM made) GROUP BY x.page_id"""
