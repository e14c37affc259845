"""Measures and normal forms of chapter text, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's white space and line ends, which Java's \s and line terminators differ from.
BLANK = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same characters one by one: a pattern compares each letter with all ranges.
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# Placeholders that travel through a rewrite.
TOKEN = "⟦[^⟧]*⟧"
UNCLOSED = r"⟦[^⟦⟧]*(?:⟦|\z)"
TITLE_TOKEN = rf"^⟦TITLE-[0-9]+[^⟧]*⟧[{BLANK}]*\z"
ANCHORS = rf"^(?:⟦ANCHOR:[^⟧]*⟧[{BLANK}]*)+"
#: Blanks and anchors of any number of lines, then the rest of a line. Every line end is a blank. Repeated groups are possessive
#: wherever Java matches them: a greedy group takes a level of the stack for each repetition.
ENDS = r"\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}"
OPENING = rf"^[{BLANK}]*(?:⟦ANCHOR:[^⟧{ENDS}]*⟧[{BLANK}]*)*+([^{ENDS}]*)"
# Stems that a rewrite must not bring in.
BANNED = {"gate": "gat(?:e|es|ed|ing)", "provenance": "provenances?", "delve": "delv(?:e|es|ed|ing)"}
# What Markdown leaves in a text.
RESIDUE = r"^#{1,6}\s|\*\*\S[^*]*\*\*|```|\]\([^)\s]+\)|^\|\s*-{3}"

# The shares of a chapter's words that a rewrite may have.
LEAST_SHARE, MOST_SHARE = 0.55, 0.70
# Labels of captions, what a terminal program adds to a reply, and what an identifier may not hold.
CAPTION = rf"(?i)^[{BLANK}]*(?:figure|table|listing|example)[{BLANK}]+[0-9A-Z]+[-.–][0-9]+"
CLOSED_TOKEN = "⟦[^⟦⟧]*⟧"
ANSI = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"
FOOTER = rf"(?m)^[{BLANK}▸>]*Credits:.*?Time:.*$"
SLUG, SLUG_LENGTH = "[^a-z0-9]+", 40


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once for each row."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """The words of a text. Blanks become spaces first, at which a text is split without a pattern."""
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " ", -1), "")


def word_count(text: Column) -> Column:
    return F.array_size(words(text))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def flat(text: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.array_join(words(text), " ")


def holds(text: Column, quote: Column) -> Column:
    """Whether a text holds a quote, whatever white space stands between words.

    A text with the quote's words and single spaces holds it as it stands, one that lacks a word doesn't: only what is left is made flat.
    """

    def of(q: Column) -> Column:
        each = F.forall(q, lambda w: F.contains(text, w))
        return named(F.array_join(q, " "), lambda said: F.contains(text, said) | each & F.contains(flat(text), said))

    return named(words(quote), of)


def lines(text: Column) -> Column:
    return F.split(text, LINE_END, -1)


def strip_tokens(text: Column) -> Column:
    return F.regexp_replace(text, TOKEN, "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def unclosed_token(text: Column) -> Column:
    """A token that isn't closed before the next one opens or the text ends."""
    return text.rlike(UNCLOSED)


def without_anchors(line: Column) -> Column:
    return F.regexp_replace(strip(line), f"{ANCHORS}+", "")


def opening_line(text: Column) -> Column:
    """The first line that holds more than anchors; empty if there is none. Only the head of the text is looked at."""
    return F.coalesce(F.rtrim(F.regexp_extract(text, OPENING, 1), F.lit(BLANKS)), F.lit(""))


def last_line(text: Column) -> Column:
    """The last line that isn't blank, without blanks at its end; empty if there is none."""
    tail = F.substring_index(F.rtrim(text, F.lit(BLANKS)), "\n", -1)
    return F.coalesce(F.try_element_at(lines(tail), F.lit(-1)), F.lit(""))


def is_title(line: Column) -> Column:
    return line.startswith("# ") | line.rlike(TITLE_TOKEN)


def bounded(stem: str) -> str:
    """A pattern for a whole word, whatever an engine's word boundary is."""
    return rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{BANNED[stem]})(?:\z|[^\p{{L}}\p{{N}}_])"


def banned(source: Column, output: Column) -> Column:
    """The stems that stand in the output and not in the source."""
    return F.array_compact(F.array(*(F.when(output.rlike(bounded(s)) & ~source.rlike(bounded(s)), s) for s in BANNED)))


def share(words_in: Column, words_out: Column) -> Column:
    return words_out / F.greatest(words_in, F.lit(1))


def percent(value: Column) -> Column:
    """A share as a whole percentage, halves to even."""
    return F.concat(F.bround(value * 100, 0).cast("int").cast("string"), F.lit("%"))


def human_time(seconds: Column) -> Column:
    s = F.floor(seconds)
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm%02ds", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%dh%02dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))
    )


def human_size(size: Column) -> Column:
    shown = lambda unit, power: F.format_string(f"%.1f {unit}", F.bround(size / F.lit(1024.0**power), 1))  # noqa: E731  halves to even
    return (
        F.when(size.isNull(), "-")
        .when(size < 1024, F.format_string("%d B", size.cast("long")))
        .when(size < 1024**2, shown("KB", 1))
        .when(size < 1024**3, shown("MB", 2))
        .otherwise(shown("GB", 3))
    )


def residue(text: Column) -> Column:
    """How many marks of Markdown a text holds."""
    return F.regexp_count(text, F.lit(f"(?md){RESIDUE}"))


def length_contract(n_words: Column) -> dict[str, Column]:
    """The least and most words that a rewrite may have."""
    return {"least_words": F.floor(n_words * F.lit(LEAST_SHARE)), "most_words": F.floor(n_words * F.lit(MOST_SHARE))}


def unescaped_tokens(text: Column) -> Column:
    """Backslashes inside tokens go."""
    gaps, found = F.split(text, CLOSED_TOKEN, -1), F.regexp_extract_all(text, F.lit(CLOSED_TOKEN), F.lit(0))
    made = F.zip_with(gaps, found, lambda g, t: F.concat(g, F.coalesce(F.replace(t, F.lit("\\"), F.lit("")), F.lit(""))))
    return F.array_join(made, "")


def has_token(text: Column, kind: Column, number: Column) -> Column:
    """Whether a token of this kind and number stands in the text, whatever its gist has become; PRE-1 isn't PRE-10."""
    return F.rlike(text, F.concat(F.lit("⟦"), kind, F.lit("-"), number.cast("string"), F.lit("(?:[^0-9⟦⟧][^⟦⟧]*)?⟧")))


def caption_label(text: Column) -> Column:
    """The label that a caption opens with, without blanks, in lower case; null without one."""
    return F.nullif(F.lower(F.regexp_replace(F.regexp_extract(F.regexp_replace(text, CLOSED_TOKEN, ""), CAPTION, 0), f"[{BLANK}]+", "")), F.lit(""))


def caption_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, CLOSED_TOKEN, ""), f"[{BLANK}]+", ""))


def caption_like(paragraph: Column, original: Column) -> Column:
    """Whether a paragraph is a caption rewritten: its label and the sign after it, and no more than twice its length and 20 letters.

    That it stands beside a listing or table is for the caller to see.
    """
    old, new = F.regexp_replace(original, CLOSED_TOKEN, ""), strip(F.regexp_replace(paragraph, CLOSED_TOKEN, ""))
    after = lambda t: F.substring(t, F.length(F.regexp_extract(t, CAPTION, 0)) + 1, F.lit(1))
    return old.rlike(CAPTION) & new.rlike(CAPTION) & (after(old) == after(new)) & (F.length(new) <= 2 * F.length(old) + 20)


def normal(text: Column) -> Column:
    """Without tokens, one space for each run of white space, in lower case."""
    return F.lower(flat(F.regexp_replace(text, CLOSED_TOKEN, "")))


def slug(text: Column) -> Column:
    """The identifier that a heading's text gives, before it is told apart from others."""
    made = F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), SLUG, "-"), "^-+|-+$", ""), 1, SLUG_LENGTH)
    return F.concat(F.lit("sec-"), F.when(made == "", "x").otherwise(made))


def contents_id(href: Column) -> Column:
    return F.concat(F.lit("toc-"), F.regexp_replace(href, r"[^\p{L}\p{N}_-]", "-"))


def context(primer: Column, index: Column, name: Column) -> Column:
    """What a rewriter is told of the book and the chapter at hand."""
    head, at = F.lit("\n\n# Book context\n\n"), F.lit("\n\n# Current chapter\n\nYou are rewriting chapter ")
    return F.concat(head, primer, at, index.cast("string"), F.lit(": "), name, F.lit("."))


def request(original: Column, rewrite: Column) -> Column:
    return F.concat(F.lit("ORIGINAL:\n\n"), original, F.lit("\n\n---\n\nREWRITE:\n\n"), rewrite)


def check_request(original: Column, top: Column, headings: Column) -> Column:
    """The request to check an opening; the headings come last, if there are any."""
    listed = named(headings, lambda h: F.when(F.size(h) > 0, F.concat(F.lit("\n\n---\n\nHEADINGS:\n\n"), F.array_join(h, "\n"))).otherwise(""))
    return F.concat(F.lit("ORIGINAL:\n\n"), original, F.lit("\n\n---\n\nTOP:\n\n"), top, listed)


def reply(text: Column) -> Column:
    """A program's reply without colours, without the line on its costs, and without the mark before it."""
    kept = strip(F.regexp_replace(F.regexp_replace(text, ANSI, ""), FOOTER, ""))
    return strip(F.regexp_replace(kept, "^> ", ""))


def _shared(a: Column, b: Column, of: Callable[[Column, Column], Column]) -> Column:
    """The words that two texts share, as a share of ``of`` their sets; 0 where one has none. Each set is worked out once."""

    def share_of(w: Column) -> Column:
        both = (F.size(w["a"]) > 0) & (F.size(w["b"]) > 0)
        return F.when(both, F.size(F.array_intersect(w["a"], w["b"])) / of(w["a"], w["b"])).otherwise(0.0)

    return named(F.struct(F.array_distinct(words(a)).alias("a"), F.array_distinct(words(b)).alias("b")), share_of)


def words_shared(a: Column, b: Column) -> Column:
    """The words that two texts share, as a share of the larger set; 0 where one has none."""
    return _shared(a, b, lambda one, other: F.greatest(F.size(one), F.size(other)))


def jaccard(a: Column, b: Column) -> Column:
    return _shared(a, b, lambda one, other: F.size(F.array_union(one, other)))


# Fixed value: how far back a reply that was cut off is searched for what its continuation repeats.
OVERLAP = 4000


def continued(first: Column, second: Column) -> Column:
    """A reply and its continuation as one text: the longest tail of whole lines that the continuation begins with counts once."""

    def of(lines_: Column) -> Column:
        tails = F.transform(lines_, lambda _, k: F.array_join(F.slice(lines_, k + 1, F.size(lines_)), "\n"))
        # The tail is cut amid a line if the reply is longer: its first line isn't whole.
        whole = F.filter(tails, lambda t, k: ((k > 0) | (F.length(first) <= OVERLAP)) & second.startswith(t))
        return F.concat(F.substring(first, F.lit(1), F.length(first) - F.length(F.coalesce(F.get(whole, F.lit(0)), F.lit("")))), second)

    return named(F.split(F.right(first, F.lit(OVERLAP)), "\n", -1), of)
