"""Guards over (source, output) pairs: why a rewritten text must not replace another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Bounds of a rewrite's share of the words, and of a revision's.
SANE = (0.05, 1.5)
LEAST_BODY = 0.35
REVISED = (0.8, 1.1)
# Outline of a Markdown text.
FENCED = r"(?msd)^[ \t]*(`{3,}|~{3,}).*?^[ \t]*\1[^\n]*"
HEADING = rf"^#{{1,6}}[{T.BLANK}]"
LINK = r"\]\(([^)]*)\)"
# A tail that earlier runs added, and the heading of a source that has its own.
RETIRED = r"(?s)\n## Key points\n(?:(?!\n#{1,2} ).)*?(?:\n## Check yourself\n.*)?\z"
KEY_POINTS = r"(?imd)^#+\s*key points\s*$"


def turns(conversations: DataFrame, source_role: str = "assistant", output_role: str = "user") -> DataFrame:
    """(conv_id, turn, source, output): each turn of one role with the other role's turn that follows.

    Joined by conversation and turn, so a conversation with many turns is spread over all tasks. A null text is empty.
    """
    text = F.coalesce("text", F.lit(""))
    source = conversations.filter(F.col("role") == source_role).select("conv_id", "turn", text.alias("source"))
    output = conversations.filter(F.col("role") == output_role).select("conv_id", (F.col("turn") - 1).alias("turn"), text.alias("output"))
    return source.join(output, ["conv_id", "turn"])


def share(source: Column, output: Column) -> Column:
    return T.share(T.word_count(source), T.word_count(output))


def sane(source: Column, output: Column) -> Column:
    words_in, words_out = F.greatest(T.word_count(source), F.lit(1)), T.word_count(output)
    return (words_out >= words_in * F.lit(SANE[0])) & (words_out <= words_in * F.lit(SANE[1]))


def body_problem(source: Column, body: Column, ratio: Column | None = None) -> Column:
    """Why a rewritten chapter must not ship; empty when it may. ``ratio`` is the body's share of the words, where it is known."""
    titled = lambda text: T.named(T.opening_line(text), T.is_title)
    small = lambda ratio: F.when(ratio < LEAST_BODY, F.concat(F.lit("body is "), T.percent(ratio), F.lit(" of the chapter"))).otherwise("")
    return (
        F.when(titled(source) & ~titled(body), "body does not open with the chapter title")
        .when(T.unclosed_token(body), "body cut off inside a ⟦token⟧")
        .when(F.ltrim(T.last_line(body), F.lit(T.BLANKS)).startswith("#"), "body ends on a bare heading")
        .otherwise(T.named(share(source, body) if ratio is None else ratio, small))
    )


def outline(text: Column) -> Column:
    """Headings and table lines outside fences, and the fenced blocks."""
    plain = F.transform(T.lines(F.regexp_replace(text, FENCED, "")), T.strip)
    marked = F.filter(plain, lambda x: x.startswith("|") | x.startswith("#"))
    return T.named(
        marked,
        lambda lines: F.struct(
            F.filter(lines, lambda x: x.rlike(HEADING)).alias("headings"),
            F.filter(lines, lambda x: x.startswith("|")).alias("tables"),
            F.transform(F.regexp_extract_all(text, F.lit(FENCED), F.lit(0)), T.strip).alias("code"),
        ),
    )


def revision_problem(source: Column, before: Column, after: Column) -> Column:
    """Why a revised chapter must not replace the one before; empty when it may."""
    links = lambda text: F.regexp_extract_all(text, F.lit(LINK), F.lit(1))
    as_set = lambda items: F.array_sort(F.array_distinct(items))
    far = lambda ratio: F.when(~ratio.between(*REVISED), F.concat(F.lit("length "), T.percent(ratio), F.lit(" of the body"))).otherwise("")

    def changed(x: Column) -> Column:
        was, now = x["was"], x["now"]
        return (
            F.when(was["headings"] != now["headings"], "headings changed")
            .when(was["code"] != now["code"], "code changed")
            .when(was["tables"] != now["tables"], "tables changed")
            .when(F.size(F.array_except(links(before), links(after))) > 0, "a link was dropped")
            .when(F.size(T.banned(source, after)) > 0, "banned word")
            .otherwise(T.named(share(before, after), far))
        )

    outlines = T.named(F.struct(outline(before).alias("was"), outline(after).alias("now")), changed)
    own = F.when(as_set(T.tokens(before)) != as_set(T.tokens(after)), "⟦tokens⟧ changed").otherwise(outlines)
    return T.named(body_problem(source, after), lambda problem: F.when(problem != "", problem).otherwise(own))


def upgraded(source: Column, cached: Column) -> Column:
    """A cached output without the retired tail and without a doubled title."""

    def once(kept: Column) -> Column:
        def parted(first: Column) -> Column:
            rest = F.substring(kept, F.length(first) + 2, F.length(kept))
            doubled = T.is_title(first) & (T.opening_line(rest) == T.strip(first))
            return T.strip(F.when(doubled, rest).otherwise(kept))

        return T.named(F.substring_index(kept, "\n", 1), parted)

    return T.named(T.strip(F.when(source.rlike(KEY_POINTS), cached).otherwise(F.regexp_replace(cached, RETIRED, ""))), once)


def evidence_held(source: Column, evidence: Column) -> Column:
    """Whether quoted evidence stands in the source, white space aside; empty evidence doesn't."""
    return (T.flat(evidence) != "") & F.contains(T.flat(source), T.flat(evidence))
