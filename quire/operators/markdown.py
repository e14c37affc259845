"""Headings and sections of Markdown chapters, and the fixes made to them. A chapter is a row: nothing here is shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from . import guards as G

# Fences, headings and numbers of a Markdown chapter.
FENCE = rf"^[{T.BLANK}]*(`{{3,}}|~{{3,}})"
HEADING = rf"^#{{1,6}}[{T.BLANK}]"
NUMBERED_HEADING = r"^(#{1,6})[ \t]+(.*)$"
SECTION_NUMBER = rf"^((?:[0-9]+|[A-Z])(?:\.[0-9]+)+)(?:[{T.BLANK}]|[A-Za-z]|$)"
ANCHOR_ID = "⟦ANCHOR:([^⟦⟧]+)⟧"
PAGE_ANCHOR = "(?i)^page"
LEADING_TOKENS = rf"^(?:⟦[^⟦⟧]*⟧[{T.BLANK}]*)*"
TOP_SECTIONS = 2

_LAST = 1 << 30


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def numbered(lines: Column) -> Column:
    return F.transform(lines, lambda x, i: F.struct(i.alias("pos"), x.alias("line")))


def fences(lines: Column) -> Column:
    """The first and last lines of fenced blocks. A fence closes at a run of its sign that is as long or longer, or never."""
    marks = F.filter(numbered(lines), lambda m: (F.contains(m["line"], F.lit("```")) | F.contains(m["line"], F.lit("~~~"))) & m["line"].rlike(FENCE))
    none = F.array().cast("array<struct<first:int,last:int>>")

    def step(acc: Column, m: Column) -> Column:
        mark = F.regexp_extract(m["line"], FENCE, 1)
        opens = acc["open"] == ""
        closes = (F.substring(mark, 1, 1) == F.substring(acc["open"], 1, 1)) & (F.length(mark) >= F.length(acc["open"]))
        begun = F.array(F.struct(m["pos"].alias("first"), F.lit(_LAST).alias("last")))
        ended = F.array(F.struct(F.try_element_at(acc["spans"], F.lit(-1))["first"].alias("first"), m["pos"].alias("last")))
        return F.struct(
            F.when(opens, mark).when(closes, "").otherwise(acc["open"]).alias("open"),
            F.when(opens, F.concat(acc["spans"], begun))
            .when(closes, F.concat(F.slice(acc["spans"], 1, F.greatest(F.size(acc["spans"]) - 1, F.lit(0))), ended))
            .otherwise(acc["spans"])
            .alias("spans"),
        )

    return F.aggregate(marks, F.struct(F.lit("").alias("open"), none.alias("spans")), step)["spans"]


def _outside(spans: Column, pos: Column) -> Column:
    return ~F.exists(spans, lambda s: (s["first"] <= pos) & (pos <= s["last"]))


def heading_lines(text: Column) -> Column:
    """(pos, line, level) of the lines outside fences that are headings, the title among them."""
    return T.named(
        split_lines(text),
        lambda lines: T.named(
            fences(lines),
            lambda spans: F.transform(
                F.filter(numbered(lines), lambda x: x["line"].startswith("#") & x["line"].rlike(HEADING) & _outside(spans, x["pos"])),
                lambda x: F.struct(x["pos"].alias("pos"), x["line"].alias("line"), F.length(F.regexp_extract(x["line"], "^#+", 0)).alias("level")),
            ),
        ),
    )


def headings(text: Column, found: Column | None = None) -> Column:
    """(pos, prefix, text) of section headings: the title's line and empty ones are left out; prefix is what stands before the text, anchors too.

    ``found`` are the text's ``heading_lines``, where they are known; so below.
    """

    def parted(x: Column) -> Column:
        prefix = F.regexp_extract(x["line"], rf"^#{{1,6}}[{T.BLANK}](?:⟦ANCHOR:[^⟧]*⟧[{T.BLANK}]*)*+", 0)
        return F.struct(x["pos"].alias("pos"), prefix.alias("prefix"), T.strip(F.substring(x["line"], F.length(prefix) + 1, F.length(x["line"]))).alias("text"))

    def of(opening: Column) -> Column:
        named = F.filter(heading_lines(text) if found is None else found, lambda x: T.without_anchors(x["line"]) != opening)
        return F.filter(F.transform(named, parted), lambda x: x["text"] != "")

    return T.named(T.opening_line(text), of)


def opening_length(text: Column, lines: Column | None = None, found: Column | None = None) -> Column:
    """Lines of the opening and the first TOP_SECTIONS sections at the shallowest level; null where that is the whole text."""
    lines = split_lines(text) if lines is None else lines

    def title_at(opening: Column) -> Column:
        # What is left of a line without its anchors is a part of it, which is looked for before any pattern.
        here = F.filter(numbered(lines), lambda x: F.contains(x["line"], opening) & (T.strip(x["line"]) != "") & (T.without_anchors(x["line"]) == opening))
        return F.coalesce(F.when(T.is_title(opening), F.get(here, F.lit(0))["pos"]), F.lit(-1))

    def cut(heads: Column) -> Column:
        least = F.array_min(F.transform(heads, lambda x: x["level"]))
        return T.named(least, lambda level: F.get(F.filter(heads, lambda x: x["level"] == level), F.lit(TOP_SECTIONS))["pos"])

    at = T.named(T.opening_line(text), title_at)
    return T.named(T.named(at, lambda title: F.filter(heading_lines(text) if found is None else found, lambda x: x["pos"] != title)), cut)


def split_top(text: Column, found: Column | None = None) -> Column:
    """(top, rest): the opening and first sections, and the rest, which may be empty."""

    def of(lines: Column) -> Column:
        def parts(n: Column) -> Column:
            top, rest = F.array_join(F.slice(lines, 1, n), "\n"), F.array_join(F.slice(lines, n + 1, F.size(lines)), "\n")
            return F.struct(F.when(n.isNull(), text).otherwise(top).alias("top"), F.when(n.isNull(), "").otherwise(rest).alias("rest"))

        return T.named(opening_length(text, lines, found), parts)

    return T.named(split_lines(text), of)


def joined(top: Column, rest: Column) -> Column:
    return F.when(rest == "", top).otherwise(F.concat(top, F.lit("\n"), rest))


def occurrences(text: Column, part: Column) -> Column:
    """How often a part stands in a text, without overlap; 0 for an empty part."""
    return F.when(part == "", 0).otherwise(((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int"))


def _lost_token(old: Column, new: Column) -> Column:
    found = lambda t: F.regexp_extract_all(t, F.lit(T.CLOSED_TOKEN), F.lit(0))
    return F.size(F.array_except(found(old), found(new))) > 0


def rejection(top: Column, source: Column, old: Column, new: Column, quote: Column) -> Column:
    """Why a sentence's fix must not be applied to an opening; empty when it can be. A null quote is none."""
    quote = F.coalesce(quote, F.lit(""))
    at = F.instr(top, old)
    before = F.substring_index(F.substring(top, F.lit(1), at - 1), "\n", -1)
    line = F.regexp_replace(F.concat(before, F.substring(top, at, F.length(top))), f"^[{T.BLANK}]+", "")
    structure = F.contains(old, F.lit("\n")) | line.startswith("#") | line.startswith("|") | line.startswith("⟦TITLE")
    return (
        F.when(occurrences(top, old) != 1, "sentence not found once in the opening")
        .when(structure, "sentence is structure, not prose")
        .when(F.contains(new, F.lit("\n")) | F.contains(new, F.lit("|")) & ~F.contains(old, F.lit("|")), "replacement changes structure")
        .when((T.strip(quote) != "") & ~T.holds(source, quote), "quoted evidence is not in the original")
        .when(_lost_token(old, new), "replacement drops a ⟦token⟧")
        .when(F.size(T.banned(source, new)) > 0, "replacement uses a banned word")
        .otherwise("")
    )


def fixed(top: Column, rest: Column, source: Column, fix: Column) -> Column:
    """(text, rejected) of an opening after the fix (old, new, quote): the text as it was where a reason is given."""
    new = T.strip(fix["new"])
    spaced = F.concat(fix["old"], F.lit(" "))
    gone = F.when(F.contains(top, spaced), F.replace(top, spaced, F.lit(""))).otherwise(F.replace(top, fix["old"], F.lit("")))
    candidate = F.when(new == "", gone).otherwise(F.replace(top, fix["old"], new))
    reason = rejection(top, source, fix["old"], fix["new"], fix["quote"])

    def judged(why: Column) -> Column:
        return T.named(F.when(why == "", candidate), lambda made: _kept(top, made, why, source, joined(made, rest)))

    return T.named(reason, judged)


def heading_rejection(body: Column, source: Column, old: Column, new: Column, quote: Column, lines: Column | None = None) -> Column:
    """Why a heading's fix must not be applied; empty when it can be. Evidence must be given. ``lines`` are the body's ``heading_lines``, where they are known."""
    return T.named(headings(body, lines), lambda found: _heading_reason(found, source, old, new, quote))


def _heading_reason(found: Column, source: Column, old: Column, new: Column, quote: Column) -> Column:
    old, new, quote = T.strip(old), T.strip(new), F.coalesce(quote, F.lit(""))
    same = F.size(F.filter(found, lambda h: h["text"] == old))
    return (
        F.when(same != 1, "heading not found once")
        .when((new == "") | F.contains(new, F.lit("\n")) | new.startswith("#"), "replacement is not a heading")
        .when((T.strip(quote) == "") | ~T.holds(source, quote), "quoted evidence is not in the original")
        .when(_lost_token(old, new), "replacement drops a ⟦token⟧")
        .when(F.size(T.banned(source, new)) > 0, "replacement uses a banned word")
        .otherwise("")
    )


def heading_fixed(body: Column, source: Column, fix: Column) -> Column:
    """(text, rejected) of a chapter after a heading's fix: the heading and each *italic* mention of it are renamed."""
    old, new = T.strip(fix["old"]), T.strip(fix["new"])
    star = lambda x: F.concat(F.lit("*"), x, F.lit("*"))

    def of(found: Column) -> Column:
        def renamed(h: Column) -> Column:
            lines = F.transform(split_lines(body), lambda x, i: F.when(i == h["pos"], F.concat(h["prefix"], new)).otherwise(x))
            return F.replace(F.array_join(lines, "\n"), star(old), star(new))

        def judged(why: Column) -> Column:
            candidate = F.when(why == "", T.named(F.get(F.filter(found, lambda h: h["text"] == old), F.lit(0)), renamed))
            return T.named(candidate, lambda made: _kept(body, made, why, source, made))

        return T.named(_heading_reason(found, source, fix["old"], fix["new"], fix["quote"]), judged)

    return T.named(headings(body), of)


def _kept(text: Column, candidate: Column, why: Column, source: Column, whole: Column) -> Column:
    """(text, rejected): the candidate where there is no reason against it and the whole chapter passes with it, else the text as it was."""
    broken = F.when(why == "", G.body_problem(source, whole) != "").otherwise(F.lit(False))
    return T.named(
        F.when(broken, "breaks the body check").otherwise(why),
        lambda said: F.struct(F.when(said == "", candidate).otherwise(text).alias("text"), said.alias("rejected")),
    )


def fold(text: Column, fixes: Column, apply) -> Column:
    """(text, applied, rejected) after all ``fixes`` in turn, each on what the ones before left; ``apply(text, fix)`` gives (text, rejected)."""
    start = F.struct(text.alias("text"), F.lit(0).alias("applied"), F.array().cast("array<string>").alias("rejected"))

    def step(acc: Column, fix: Column) -> Column:
        return T.named(
            apply(acc["text"], fix),
            lambda r: F.struct(
                r["text"].alias("text"),
                (acc["applied"] + (r["rejected"] == "").cast("int")).alias("applied"),
                F.when(r["rejected"] == "", acc["rejected"]).otherwise(F.concat(acc["rejected"], F.array(r["rejected"]))).alias("rejected"),
            ),
        )

    return F.aggregate(fixes, start, step)


def patched(source: Column, body: Column, sentences: Column, heads: Column) -> Column:
    """(text, applied, rejected) of a chapter after its sentences' fixes, made in the opening, and its headings' fixes."""

    def both(parts: Column) -> Column:
        first = fold(parts["top"], sentences, lambda top, fix: fixed(top, parts["rest"], source, fix))

        def then(r: Column) -> Column:
            second = fold(joined(r["text"], parts["rest"]), heads, lambda text, fix: heading_fixed(text, source, fix))
            return T.named(
                second, lambda x: F.struct(x["text"].alias("text"), (r["applied"] + x["applied"]).alias("applied"), F.concat(r["rejected"], x["rejected"]).alias("rejected"))
            )

        return T.named(first, then)

    return T.named(split_top(body), both)


def heading_anchors(text: Column) -> Column:
    """(pos, hashes, rest, ids) of headings: the section anchors in the heading's line, on the lines of anchors alone above it, and, where no heading follows them, below it.

    Lines without a sign count as lines of anchors alone. A fence begins and ends at any line that starts with three backticks.
    """

    alone = lambda x: T.strip(F.regexp_replace(x, ANCHOR_ID, "")) == ""
    ids_of = lambda some: F.flatten(F.transform(some, lambda x: F.regexp_extract_all(x, F.lit(ANCHOR_ID), F.lit(1))))

    def of(lines: Column) -> Column:
        def outside(toggles: Column) -> Column:
            return F.filter(numbered(lines), lambda x: x["line"].rlike(NUMBERED_HEADING) & (F.size(F.filter(toggles, lambda t: t <= x["pos"])) % 2 == 0))

        def each(heads: Column) -> Column:
            def stops_of(at: Column) -> Column:
                stops = F.transform(F.filter(numbered(lines), lambda x: ~alone(x["line"]) | F.array_contains(at, x["pos"])), lambda x: x["pos"])
                return F.struct(at.alias("heads"), stops.alias("all"))

            def made(stops: Column) -> Column:
                def one(h: Column) -> Column:
                    above = F.coalesce(F.array_max(F.filter(stops["all"], lambda s: s < h["pos"])), F.lit(-1))
                    below = F.coalesce(F.array_min(F.filter(stops["all"], lambda s: s > h["pos"])), F.size(lines))
                    after = F.slice(lines, h["pos"] + 2, F.greatest(below - h["pos"] - 1, F.lit(0)))
                    ids = F.concat(
                        ids_of(F.slice(lines, above + 2, F.greatest(h["pos"] - above, F.lit(0)))),
                        F.when(F.array_contains(stops["heads"], below), F.array().cast("array<string>")).otherwise(ids_of(after)),
                    )
                    part = lambda n: F.regexp_extract(h["line"], NUMBERED_HEADING, n)
                    return F.struct(h["pos"].alias("pos"), part(1).alias("hashes"), part(2).alias("rest"), F.filter(ids, lambda a: ~a.rlike(PAGE_ANCHOR)).alias("ids"))

                return F.transform(heads, one)

            return T.named(T.named(F.transform(heads, lambda h: h["pos"]), stops_of), made)

        toggles = F.transform(F.filter(numbered(lines), lambda x: x["line"].startswith("```")), lambda x: x["pos"])
        return T.named(T.named(toggles, outside), each)

    return T.named(split_lines(text), of)


def _number(rest: Column) -> Column:
    return F.regexp_extract(T.strip(F.regexp_replace(rest, f"{LEADING_TOKENS}+", "")), SECTION_NUMBER, 1)


def section_numbers(text: Column) -> Column:
    """(anchor, number) of the numbered headings' anchors, in order; of one anchor the first counts."""
    numbered_ = F.filter(heading_anchors(text), lambda h: _number(h["rest"]) != "")
    return F.flatten(F.transform(numbered_, lambda h: F.transform(h["ids"], lambda a: F.struct(a.alias("anchor"), _number(h["rest"]).alias("number")))))


def with_section_numbers(source: Column, text: Column) -> Column:
    """``text`` with the source's numbers back on the headings that carry a numbered section's anchor.

    A heading of several sections gets all their numbers in order, but none that another one lies below; one that has a number keeps it.
    """
    value = lambda p: F.when(p.rlike("^[0-9]+$"), p.cast("long")).otherwise(F.ascii(p).cast("long"))

    def put(known: Column) -> Column:
        def line_of(h: Column) -> Column:
            own = F.array_distinct(F.array_compact(F.transform(h["ids"], lambda a: F.get(F.filter(known, lambda k: k["anchor"] == a), F.lit(0))["number"])))

            def chosen(numbers: Column) -> Column:
                kept = F.filter(numbers, lambda n: ~F.exists(numbers, lambda m: m.startswith(F.concat(n, F.lit(".")))))
                order = F.array_sort(F.transform(kept, lambda n: F.struct(F.transform(F.split(n, r"\."), value).alias("key"), n.alias("n"))))
                tokens = F.regexp_extract(h["rest"], f"{LEADING_TOKENS}+", 0)
                rest = T.strip(F.substring(h["rest"], F.length(tokens) + 1, F.length(h["rest"])))
                new = F.concat(h["hashes"], F.lit(" "), tokens, F.array_join(F.transform(order, lambda x: x["n"]), ", "), F.lit(" "), rest)
                return F.when((F.size(numbers) > 0) & (_number(h["rest"]) == ""), new)

            return F.struct(h["pos"].alias("pos"), T.named(own, chosen).alias("line"))

        changed = F.filter(F.transform(heading_anchors(text), line_of), lambda x: x["line"].isNotNull())

        def apply(new: Column) -> Column:
            lines = F.transform(split_lines(text), lambda x, i: F.coalesce(F.get(F.filter(new, lambda c: c["pos"] == i), F.lit(0))["line"], x))
            return F.when(F.size(new) == 0, text).otherwise(F.array_join(lines, "\n"))

        return T.named(changed, apply)

    return T.named(section_numbers(source), put)
