"""The elements of a page as rows, by a stack over its tags, and what is read from them."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

from . import html as H
from . import text as T

#: A comment, a script or style with its content, a tag, a declaration, a text; together they are the whole page.
EVENT = r"(?is)<!--.*?(?:-->|\z)|<(?:script|style)(?:\s[^>]*)?>.*?</(?:script|style)\s*>|</?[a-z][^>]*>|<[!?/][^>]*>|[^<]+|<"
# Elements without content.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
NAME = "^</?([A-Za-z][A-Za-z0-9:_-]*)"
#: What stands in a page beside elements: nothing to see, text, an element with content, one without, an end tag.
NOTHING, TEXT, OPEN, SINGLE, END = range(5)
#: What a row of ``tree`` holds.
EVENT_TYPE = (
    "struct<i: int, kind: int, tag: string, raw: string, pre: int, parent: int, depth: int, after: int, boxed: boolean, last: int, until: int>"
)


def attribute(start: Column, name: str) -> Column:
    """The value of a start tag's attribute; null if it has none."""
    found = lambda pattern: F.regexp_extract(start, pattern, 1)
    head = rf"(?is)^<[^>]*?[\s\"']{name}\s*=\s*"
    value = F.when(start.rlike(head + '"'), found(head + '"([^"]*)"')).when(start.rlike(head + "'"), found(head + "'([^']*)'"))
    # Most tags don't have it, which one look tells.
    return H.unescape(F.when(start.rlike(head), value.otherwise(found(head + r"([^\s\"'>]+)"))))


def classes(start: Column) -> Column:
    """The classes of a start tag; none without such an attribute."""
    return F.array_remove(F.split(F.coalesce(attribute(start, "class"), F.lit("")), r"\s+"), "")


#: How many characters of pages are taken together; a longer page is a round of its own.
ROUND = 1 << 18
_EVENT = re.compile(EVENT.replace(r"\z", r"\Z"))
_NAME = re.compile(NAME)
_BOX = re.compile(r"""[\s"']class\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_TYPE = re.compile(r"""[\s"']epub:type\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_CALLOUT = re.compile(H.CALLOUT)


def _boxes(name: str, raw: str) -> bool:
    """Whether an element is a callout, as ``html.is_callout`` has it."""
    if name not in ("aside", "div", "section"):
        return False
    value = lambda pattern: (found[1].strip("\"'") if (found := pattern.search(raw)) else "")
    return name == "aside" and "sidebar" in value(_TYPE) or any(map(_CALLOUT.match, value(_BOX).split()))


#: What ``events_of`` gives of a page, but for the places of its events.
_FIELDS = ("kind", "tag", "raw", "pre", "parent", "depth", "after", "boxed", "last", "until")


def events_of(html: str) -> tuple[list, ...]:
    """A page's events as one list for each of ``_FIELDS``, by a stack of open elements; its time grows with the number of tags."""
    raws = _EVENT.findall(html)
    n = len(raws)
    kinds = [NOTHING] * n
    tags, pres, parents, depths, afters, boxed, lasts, untils = ([None] * n for _ in range(8))
    stack, open_of = [], {}  # the places of open elements, and how many there are of a name
    boxes = {}  # by the place of an open element, whether it is a callout or in one
    closed = None  # the place of the last element that was closed, which may be the one before the next
    pre = 0

    def close(at: int, until: int) -> None:
        nonlocal closed
        lasts[at], untils[at], closed = pre - 1, until, at
        open_of[tags[at]] -= 1

    for i, raw in enumerate(raws):
        name = ""
        if raw[0] != "<":
            if raw.isspace():
                continue
        elif named := _NAME.match(raw):
            name = named[1].lower()
            if raw[1] == "/":
                kinds[i] = END
                if open_of.get(name):
                    while tags[stack[-1]] != name:
                        close(stack.pop(), i)
                    close(stack.pop(), i)
                continue
        elif raw != "<":
            continue
        up = stack[-1] if stack else None
        parents[i], boxed[i] = (-1, False) if up is None else (pres[up], boxes[up])
        tags[i], pres[i], depths[i], lasts[i], untils[i] = name or "#text", pre, len(stack) + 1, pre, i
        pre += 1
        if not name:
            kinds[i] = TEXT
            continue
        if closed is not None and depths[closed] == depths[i] and parents[closed] == parents[i]:
            afters[i] = pres[closed]
        if name in VOID or name in ("script", "style") or raw.endswith("/>"):
            kinds[i], closed = SINGLE, i
        else:
            kinds[i] = OPEN
            boxes[i] = boxed[i] or _boxes(name, raw)
            stack.append(i)
            open_of[name] = open_of.get(name, 0) + 1
    while stack:
        close(stack.pop(), n - 1)
    return kinds, tags, raws, pres, parents, depths, afters, boxed, lasts, untils


def _trees(htmls: list[str | None], kind: pa.DataType) -> pa.Array:
    """The events of some pages as an array of ``kind``; a null page has none."""
    places, columns, offsets, end = [], [[] for _ in _FIELDS], [], 0
    for html in htmls:
        offsets.append(None if html is None else end)
        if html is not None:
            made = events_of(html)
            for column, more in zip(columns, made, strict=True):
                column += more
            places += range(len(made[0]))
            end += len(made[0])
    arrays = [pa.array(c, f.type) for c, f in zip([places, *columns], kind.value_type, strict=True)]
    return pa.ListArray.from_arrays(pa.array([*offsets, end], pa.int32()), pa.StructArray.from_arrays(arrays, fields=list(kind.value_type)), type=kind)


def with_tree(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``tree``: each page in events that together are its text, in order; nothing is shuffled.

    ``kind`` is that of the event, ``raw`` its text. Texts and elements are nodes: ``pre`` is the place in document
    order, ``last`` that of the last node inside, ``parent`` and ``depth`` are as in a tree (-1 and 1 at the top), ``after``
    is the element before it in the same parent, ``boxed`` tells whether a callout holds it; ``until`` is the event that
    ends it. Other events have none of these. An end tag closes the last open element of its name and all in it, or
    nothing; what is never closed ends with the page. A null page has no tree.

    A fold in column expressions would copy what it has gathered at each tag, so this is a small helper in Python over
    Arrow batches, which gathers a list for each field and takes pages by rounds of ROUND characters, or one page.
    """
    schema = StructType([*pages.schema.fields, StructField("tree", DataType.fromDDL(f"array<{EVENT_TYPE}>"))])
    kind = to_arrow_type(schema["tree"].dataType)

    def run(batches):
        for batch in batches:
            start, texts, size = 0, [], 0
            column = batch.column(html)
            for k in range(batch.num_rows):
                texts.append(column[k].as_py())
                size += len(texts[-1] or "")
                if size >= ROUND or k + 1 == batch.num_rows:
                    some = batch.slice(start, k + 1 - start)
                    yield pa.RecordBatch.from_arrays([*some.columns, _trees(texts, kind)], [*batch.schema.names, "tree"])
                    start, texts, size = k + 1, [], 0

    return pages.mapInArrow(run, schema)


#: What the comparison of editions needs of a page's tree.
OUTLINE_TYPE = "struct<wrappers: array<struct<tag: string, raw: string>>, levels: array<int>>"


def outline_of(html: str | None) -> dict | None:
    """The start tags of the elements that alone hold the whole body, outermost first, and the levels of headings outside callouts."""
    if html is None:
        return None
    kinds, tags, raws, pres, _, depths, _, boxed, lasts, _ = events_of(html)
    levels = [int(tag[1]) for tag, box in zip(tags, boxed, strict=True) if tag in _HEADS and not box]
    wraps = []
    if "body" in tags:
        body = tags.index("body")
        for i in range(body + 1, len(tags)):
            if pres[i] is None:
                continue
            # Nodes that stand alone are the first ones in the body: what follows one that doesn't isn't alone either.
            if kinds[i] == TEXT or depths[i] != depths[body] + len(wraps) + 1 or lasts[i] != lasts[body] or pres[i] > lasts[body]:
                break
            wraps.append({"tag": tags[i], "raw": raws[i]})
    return {"wrappers": wraps, "levels": levels}


_HEADS = tuple(f"h{k}" for k in range(1, 7))


def _each(html: Column, of: Callable[[str | None], dict | list[dict] | None], made: str) -> Column:
    """``of`` each page: only the text goes to Python, and only what is needed of its tree comes back."""
    kind = to_arrow_type(DataType.fromDDL(made))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array((of(x.as_py()) for x in batch), kind)

    # A filter by what is made would else be pushed below it, and every page be read twice.
    return F.arrow_udf(run, made).asNondeterministic()(html)


def outline(html: Column) -> Column:
    return _each(html, outline_of, OUTLINE_TYPE)


#: The number of headings of sections, and what ``firsts`` and ``cut_at_firsts`` tell of the paragraphs that are first after them.
FIRSTS_TYPE = "struct<sections: int, starts: array<string>>"
CUT_TYPE = "struct<pieces: array<string>, said: array<boolean>>"
#: A sign that is neither blank nor part of a character reference.
_SAID = re.compile(f"[^{T.BLANKS}{''.join(sorted({c for name, _ in H.ENTITIES for c in name}))}]")


def _firsts(tags: list, pres: list, afters: list) -> tuple[int, list[int]]:
    """How many headings of sections there are, and the events that are a paragraph whose element before it in the same parent is one."""
    heads = {pre for tag, pre in zip(tags, pres, strict=True) if tag in ("h2", "h3", "h4")}
    return len(heads), [i for i, tag in enumerate(tags) if tag == "p" and afters[i] in heads]


def firsts_of(html: str | None) -> dict | None:
    if html is None:
        return None
    _, tags, raws, pres, _, _, afters, *_ = events_of(html)
    sections, at = _firsts(tags, pres, afters)
    return {"sections": sections, "starts": [raws[i] for i in at]}


def cut_at_firsts_of(html: str | None) -> dict | None:
    if html is None:
        return None
    kinds, tags, raws, pres, _, _, afters, _, lasts, untils = events_of(html)

    def says(i: int) -> bool:
        parts = []
        for j in range(i + 1, untils[i] + 1):
            if kinds[j] == TEXT:
                if _SAID.search(raws[j]):
                    return True
                parts.append(raws[j])
        text = "".join(parts)
        for name, sign in H.ENTITIES:
            text = text.replace(name, sign)
        return text.strip(T.BLANKS) != ""

    pieces, said, start = [], [], 0
    for i in _firsts(tags, pres, afters)[1]:
        pieces += ["".join(raws[start:i]), raws[i]]
        said.append(lasts[i] > pres[i] and says(i))
        start = i + 1
    return {"pieces": [*pieces, "".join(raws[start:])], "said": said}


def firsts(html: Column) -> Column:
    """(sections, starts) of a page: the number of its h2 to h4, and the start tags of the paragraphs that are the first element after one in the same parent."""
    return _each(html, firsts_of, FIRSTS_TYPE)


def cut_at_firsts(html: Column) -> Column:
    """(pieces, said) of a page: its text cut before and after each start tag of ``firsts``, which are every second piece, and whether that paragraph holds text."""
    return _each(html, cut_at_firsts_of, CUT_TYPE)


#: The notes of a page with the blocks of each, and the paragraphs outside callouts with their place among their siblings.
NOTES_TYPE = "array<struct<text: string, body: string, parts: array<string>>>"
PARAGRAPHS_TYPE = "array<struct<text: string, parent: int, pre: int, after: int>>"
# What a callout's body is made of, and the class of a paragraph that is its label.
BLOCKS = ("p", "ul", "ol", "dl", "div", "blockquote", "pre", "table")
_TITLED = re.compile("title|head", re.I)
_TOKEN = re.compile(T.CLOSED_TOKEN)


def _normal(pieces: list[str]) -> str:
    """Texts of a page as one, as ``text.normal`` has it."""
    text = " ".join(pieces)
    if "&" in text:
        for name, sign in H.ENTITIES:
            text = text.replace(name, sign)
    return " ".join(_TOKEN.sub("", text).split()).lower()


def notes_of(html: str | None) -> list[dict] | None:
    if html is None:
        return None
    kinds, tags, raws, pres, _, _, _, boxed, lasts, untils = events_of(html)

    def note(i: int) -> dict:
        own = [j for j in range(i + 1, untils[i] + 1) if pres[j] is not None]
        said, headed = [], -1
        for j in own:
            if tags[j] in _HEADS:
                headed = max(headed, lasts[j])
            elif kinds[j] == TEXT and pres[j] > headed:
                said.append(raws[j])
        label = next((j for j in own if tags[j] in _HEADS), None)
        if label is None:
            titled = (j for j in own if tags[j] in ("p", "span") and (found := _BOX.search(raws[j])) and _TITLED.search(found[1]))
            label = next(titled, None)
            if label is not None and tags[label] == "span":
                label = max((j for j in own if tags[j] == "p" and pres[j] < pres[label] <= lasts[j]), default=label)
        rest = [j for j in own if label is None or not pres[label] <= pres[j] <= lasts[label]]
        words = [j for j in rest if kinds[j] == TEXT]
        blocks = [j for j in rest if kinds[j] == OPEN and tags[j] in BLOCKS]
        parts, body, held = [], [], -1
        for k, j in enumerate(blocks):
            outer, inner_ = pres[j] > held, k + 1 == len(blocks) or pres[blocks[k + 1]] > lasts[j]
            held = max(held, lasts[j])
            if outer or inner_:
                pieces = [raws[x] for x in words[bisect_right(words, j) : bisect_right(words, untils[j])]]
                parts.append(_normal(pieces))
                body += pieces if outer else []
        return {"text": _normal(said), "body": _normal(body), "parts": parts}

    return [note(i) for i, kind in enumerate(kinds) if kind == OPEN and not boxed[i] and _boxes(tags[i], raws[i])]


def paragraphs_of(html: str | None) -> list[dict] | None:
    if html is None:
        return None
    kinds, tags, raws, pres, parents, _, afters, boxed, _, untils = events_of(html)
    text_of = lambda i: _normal([raws[j] for j in range(i + 1, untils[i] + 1) if kinds[j] == TEXT])
    return [{"text": text_of(i), "parent": parents[i], "pre": pres[i], "after": afters[i]} for i, tag in enumerate(tags) if tag == "p" and not boxed[i]]


def notes(html: Column) -> Column:
    """The callouts of a page that no other one holds.

    Texts are normal. ``text`` is what stands in one outside headings, ``body`` what stands in its blocks without its label, which is its first
    heading or else its first paragraph of a title's class. ``parts`` are the texts of the blocks that hold no other or that no other holds.
    """
    return _each(html, notes_of, NOTES_TYPE)


def paragraphs(html: Column) -> Column:
    """The paragraphs of a page outside callouts, as normal texts; ``after`` is the element before one in the same parent, as in ``tree``."""
    return _each(html, paragraphs_of, PARAGRAPHS_TYPE)


def nodes(events: Column) -> Column:
    return F.filter(events, lambda x: x["pre"].isNotNull())


def inner(events: Column, x: Column) -> Column:
    """The events between an element's tags."""
    return F.slice(events, x["i"] + 2, F.greatest(x["until"] - x["i"], F.lit(0)))


def text(events: Column, x: Column) -> Column:
    """The texts inside an element, with nothing between them."""
    return H.unescape(F.array_join(F.transform(F.filter(inner(events, x), lambda y: y["kind"] == TEXT), lambda y: y["raw"]), ""))


def holding(events: Column, tags: str, x: Column) -> Column:
    """Whether an element of one of these names (a pattern) holds node ``x``."""
    return F.exists(F.filter(events, lambda y: y["tag"].rlike(tags)), lambda y: (y["pre"] < x["pre"]) & (x["pre"] <= y["last"]))


def is_callout(x: Column) -> Column:
    return (x["kind"] == OPEN) & x["tag"].isin("aside", "div", "section") & H.is_callout(x["tag"], classes(x["raw"]), attribute(x["raw"], "epub:type"))


def spaced_text(events: Column, x: Column, without: str | None = None) -> Column:
    """The texts inside an element with a space between them, but for those in elements of the names ``without``."""
    held = F.filter(inner(events, x), lambda y: y["kind"] == TEXT)
    if without:
        held = T.named(inner(events, x), lambda own: F.filter(own, lambda y: (y["kind"] == TEXT) & ~holding(own, without, y)))
    return H.unescape(F.array_join(F.transform(held, lambda y: y["raw"]), " "))


def rows(pages: DataFrame) -> DataFrame:
    """(page_id, pre, last, parent, depth, after, tag, classes, id, boxed) of the elements and texts of pages."""
    made = with_tree(pages.select("page_id", "html")).select("page_id", F.explode(nodes(F.col("tree"))).alias("x"))
    start = F.when(F.col("x.kind") != TEXT, F.col("x.raw"))
    columns = [F.col(f"x.{c}").alias(c) for c in ("pre", "last", "parent", "depth", "after", "tag")]
    return made.select("page_id", *columns, F.when(start.isNotNull(), F.array_join(classes(start), " ")).alias("classes"), attribute(start, "id").alias("id"), F.col("x.boxed").alias("boxed"))


def heading_jumps(events: Column) -> Column:
    """How often a heading outside callouts is more than one level below the one before it."""
    heads = F.filter(events, lambda x: x["tag"].rlike("^h[1-6]$") & ~x["boxed"])
    return jumps(F.transform(heads, lambda x: F.substring(x["tag"], 2, 1).cast("int")))


def jumps(levels: Column) -> Column:
    """How often a level is more than one below the one before it."""
    return T.named(levels, lambda v: F.size(F.filter(F.zip_with(v, F.slice(v, 2, F.greatest(F.size(v), F.lit(1))), lambda a, b: b > a + 1), lambda x: x)))


def named_wrappers(starts: Column) -> Column:
    """tag.class of start tags."""
    return F.transform(starts, lambda x: F.array_join(F.concat(F.array(x["tag"]), classes(x["raw"])), "."))


def wrappers(events: Column) -> Column:
    """tag.class of each element that alone holds the whole body, outermost first.

    Such elements follow the body's start one inside the other, and nothing stands after any of them.
    """

    def of(b: Column) -> Column:
        inside = F.filter(b["nodes"], lambda x: (x["pre"] > b["body"]["pre"]) & (x["pre"] <= b["body"]["last"]))
        alone = lambda x, k: (x["kind"] != TEXT) & (x["depth"] == b["body"]["depth"] + k + 1) & (x["last"] == b["body"]["last"])
        kept = F.filter(F.transform(inside, lambda x, k: F.when(alone(x, k), x)), lambda x: x.isNotNull())
        return named_wrappers(kept)

    both = F.struct(F.get(F.filter(events, lambda x: x["tag"] == "body"), F.lit(0)).alias("body"), nodes(events).alias("nodes"))
    return F.coalesce(T.named(both, of), F.array().cast("array<string>"))
