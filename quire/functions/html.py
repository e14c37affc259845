"""What can be read from a page's markup without a tree, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

COMMENT = r"(?s)<!--.*?-->"
UNSEEN = r"(?is)<(?:script|style)(?:\s[^>]*)?>.*?</(?:script|style)\s*>"
TAG = r"<[^>]*>"
TAGS_OR_ENDS = r"(?:<[^>]*>|\n)++"
HEADING = r"(?is)<h[1-3](?:\s[^>]*)?>(.*?)</h[1-3]\s*>"
BODY = r"(?is)<body(?:\s|>).*"
#: Where the match of BODY begins.
BODY_START = r"(?i)<body(?=[\s>])"
# Character references that are resolved, the ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))

# Titles, types and classes that tell reference apparatus and front and back matter from chapters.
REFERENCE_TITLE = r"(?i)^(?:index|glossary|bibliography|references|works cited|notes|(?:table of )?contents(?: in detail)?)\z"
REFERENCE_WORD = r"index|glossary|bibliography|toc|landmarks"
MATTER_TITLE = (
    r"(?i)^(?:foreword|preface|acknowledge?ments?|praise\b|reviews for|about the authors?|dedication|colophon|copyright(?: page)?\z|"
    r"part\s+(?:[ivxlcdm]+|\d+|one|two|three|four|five|six|seven|eight|nine|ten)\b|appendix\b)"
)
MATTER_WORD = (
    r"frontmatter|backmatter|copyright-page|titlepage|halftitlepage|dedication|epigraph|foreword|preface|acknowledgments|colophon|"
    r"imprint|contributors|other-credits|errata|endnotes|rearnotes|appendix|part"
)
MATTER_CLASS = r"(?i)^(?:preface|colophon|dedication|acknowledgments|appendix|copyright)\z"
CHAPTER_WORD = r"introduction|prologue|chapter|bodymatter"
INTRODUCTION = r"(?i)^introduction\b"
SHORT_MATTER = 1000

LINKS = {
    "a": r"""(?is)<(?:a|area)\s(?:[^>]*?\s)?href\s*=\s*["']([^"']*)["']""",
    "img": r"""(?is)<img\s(?:[^>]*?\s)?src\s*=\s*["']([^"']*)["']""",
    "link": r"""(?is)<link\s(?:[^>]*?\s)?href\s*=\s*["']([^"']*)["']""",
}
EXTERNAL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)"
IDS = r"""(?is)<[a-z][^>]*?\sid\s*=\s*["']([^"']*)["']"""
START_TAG = r"<([A-Za-z][A-Za-z0-9]*)"


def typed(names: str) -> str:
    return rf"""(?is)<(?:{names})\s(?:[^>]*?\s)?epub:type\s*=\s*["']([^"']*)["']"""


CLASSED = r"""(?is)<(?:div|section)\s(?:[^>]*?\s)?class\s*=\s*["']([^"']*)["']"""


def found(html: Column, pattern: str) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))


def word_in(words: str) -> str:
    return rf"(?i)\b(?:{words})\b"


def unescape(text: Column) -> Column:
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def visible(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, COMMENT, ""), UNSEEN, "")


def page_text(html: Column) -> Column:
    """All text, with nothing put between neighbouring nodes."""
    return unescape(F.regexp_replace(visible(html), TAG, ""))


def title(html: Column) -> Column:
    """The first heading's text; empty without one."""
    return T.flat(unescape(F.regexp_replace(F.regexp_extract(html, HEADING, 1), TAG, " ")))


def body(html: Column) -> Column:
    """A page from its body's start tag on, whose name is put in lower case; the whole page without one. The text behind the tag is not matched."""
    return F.coalesce(F.concat(F.lit("<body"), F.get(F.split(html, BODY_START, 2), F.lit(1))), html)


def first_classes(inner: Column) -> Column:
    """The classes of the first three classed divs and sections of a body."""
    return F.flatten(F.transform(F.slice(found(inner, CLASSED), 1, 3), lambda c: F.split(c, r"\s+")))


def is_reference(html: Column, heading: Column, firsts: Column | None = None) -> Column:
    """Whether a page is reference apparatus; ``firsts`` are its ``first_classes``, where they are known."""
    firsts = first_classes(body(html)) if firsts is None else firsts
    types = F.exists(found(html, typed("body|section|nav|div")), lambda t: t.rlike(word_in(REFERENCE_WORD)))
    classes = F.exists(firsts, lambda c: c.rlike(rf"(?i)^(?:{REFERENCE_WORD})\z"))
    return heading.rlike(REFERENCE_TITLE) | types | classes


def is_matter(html: Column, heading: Column, n_words: Column, firsts: Column | None = None) -> Column:
    """Whether a page, or its ``body``, is front or back matter; ``firsts`` are its ``first_classes``, where they are known."""

    def of(inner: Column) -> Column:
        rights = F.contains(F.lower(F.regexp_replace(visible(inner), TAG, " ")), F.lit("all rights reserved"))
        classed = F.exists(first_classes(inner) if firsts is None else firsts, lambda c: c.rlike(MATTER_CLASS))
        types = F.concat(F.slice(found(inner, typed("section|div")), 1, 3), found(html, typed("body")))

        def typed_as(t: Column) -> Column:
            any_of = lambda words: F.exists(t, lambda x: x.rlike(word_in(words)))
            chapter = heading.rlike(INTRODUCTION) | any_of(CHAPTER_WORD)
            return ~chapter & (heading.rlike(MATTER_TITLE) | any_of(MATTER_WORD) | classed | (n_words < SHORT_MATTER) & rights)

        return T.named(types, typed_as)

    return T.named(body(html), of)


# Elements whose loss is told, and those that are never rewritten; classes of callouts.
CONTENT = ("img", "table", "pre", "math", "svg", "figure")
PROTECTED = ("img", "math", "svg", "figure")
CALLOUT = r"(?i)^(?:note|tip|warning|caution|important|sidebar|box)$"
#: Elements that are no prose, each with its content.
UNPROSE_NAMES = ("pre", "code", "script", "style")
UNPROSE = tuple(rf"(?is)<{t}(?:\s[^>]*)?>.*?</{t}\s*>" for t in UNPROSE_NAMES)
CLASSES = r"""(?is)<[a-z][^>]*?\sclass\s*=\s*["']([^"']*)["']"""
BODY_TAG = r"(?is)<body((?:\s[^>]*)?)>"
ATTRIBUTE = r"""([A-Za-z_:][A-Za-z0-9_:.-]*\s*=\s*(?:"[^"]*"|'[^']*'))"""
LINK_TAG = r"(?is)(<link\s[^>]*>)"
STYLESHEET = r"""(?is)\srel\s*=\s*["'][^"']*stylesheet"""
HREF = r"""(?is)\shref\s*=\s*["']([^"']*)["']"""
CSS_CLASS = r"\.([A-Za-z_][A-Za-z0-9_-]*)"
STYLE = r"(?is)<style(?:\s[^>]*)?>(.*?)</style\s*>"
NAV = r"(?is)(<nav(?:\s[^>]*)?>.*?</nav\s*>)"
NAV_LINK = r"(?is)(<a\s[^>]*>.*?</a\s*>)"
CONTENTS = r"""(?is)<nav\s(?:[^>]*?\s)?epub:type\s*=\s*["'][^"']*toc"""


def prose(html: Column) -> Column:
    """The body's text without code, scripts and styles; one line end where tags stand between texts."""
    text = F.regexp_replace(body(html), COMMENT, "")
    for name, pattern in zip(UNPROSE_NAMES, UNPROSE, strict=True):
        text = _without(text, name, pattern)
    return unescape(F.regexp_replace(text, TAGS_OR_ENDS, "\n"))


def _without(text: Column, name: str, pattern: str) -> Column:
    """A text without the elements of a pattern; it is matched only if the first letter of their end tag stands there, which bytes tell."""
    ends = lambda t: F.contains(t, F.lit(f"</{name[0]}")) | F.contains(t, F.lit(f"</{name[0].upper()}"))
    return T.named(text, lambda t: F.when(ends(t), F.regexp_replace(t, pattern, "\n")).otherwise(t))


def is_callout(tag: Column, classes: Column, types: Column) -> Column:
    """Whether an element of this name, with these classes and epub:type, is a callout."""
    sidebar = (tag == "aside") & F.contains(F.coalesce(types, F.lit("")), F.lit("sidebar"))
    return sidebar | tag.isin("div", "section", "aside") & F.exists(F.coalesce(classes, F.array().cast("array<string>")), lambda c: c.rlike(CALLOUT))


def is_contents(html: Column) -> Column:
    """Whether a page is the book's navigation document."""
    return html.rlike(CONTENTS)


def classes(html: Column) -> Column:
    return F.array_remove(F.array_distinct(F.flatten(F.transform(found(html, CLASSES), lambda c: F.split(c, r"\s+")))), "")


def body_attributes(html: Column) -> Column:
    """The body's attributes, each as name=\"value\", in order."""
    return F.array_sort(F.regexp_extract_all(F.regexp_extract(html, BODY_TAG, 1), F.lit(ATTRIBUTE), F.lit(1)))


def stylesheets(html: Column) -> Column:
    """What the page's stylesheet links refer to."""
    tags = F.filter(found(html, LINK_TAG), lambda t: t.rlike(STYLESHEET) & t.rlike(HREF))
    return F.transform(tags, lambda t: unescape(F.regexp_extract(t, HREF, 1)))


def style_classes(html: Column) -> Column:
    """The classes that the page's own styles name."""
    return F.array_distinct(F.regexp_extract_all(F.array_join(found(html, STYLE), "\n"), F.lit(CSS_CLASS), F.lit(1)))


def repeated_ids(html: Column) -> Column:
    """The identifiers that stand twice or more, in order."""
    return repeated(found(html, IDS))


def repeated(values: Column) -> Column:
    """The values that stand twice or more, in order."""

    def of(ids: Column) -> Column:
        return F.array_distinct(F.array_compact(F.zip_with(ids, F.slice(ids, 2, F.greatest(F.size(ids), F.lit(1))), lambda a, b: F.when(a == b, a))))

    return T.named(F.array_sort(values), of)


def ill_formed(html: Column) -> Column:
    """Whether a page can't be read as XML."""
    made = F.from_xml(html, "broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    return F.coalesce(made["broken"].isNotNull(), html.isNotNull())


def tag_count(html: Column, tag: str) -> Column:
    return F.regexp_count(visible(html), F.lit(rf"(?i)<{tag}[\s/>]"))


def content_tags(html: Column) -> Column:
    """The names of the start tags of CONTENT, in order; ``tag_count`` is how often one is among them."""
    return F.transform(found(visible(html), rf"(?i)<({'|'.join(CONTENT)})[\s/>]"), F.lower)


def heading_jumps(html: Column) -> Column:
    """How often a heading is more than one level below the one before it."""
    levels = F.transform(found(html, r"(?i)<h([1-6])(?:\s[^>]*)?>"), lambda x: x.cast("int"))
    return F.size(F.filter(F.zip_with(levels, F.slice(levels, 2, F.greatest(F.size(levels), F.lit(1))), lambda a, b: b > a + 1), lambda x: x))
