"""What a rewriter's replies hold: the fixes that a reviewer lists, and the text of a reply that came as events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# White space of JSON, and where a reviewer's reply names what it found.
_SPACE = "[ \\t\\n\\r]*+"
FIXES, PLACES, REPLACEMENT = "fixes", ("sentence", "heading"), "replacement"
#: Deeper objects aren't read: parsers stop there.
DEEPEST = 1000
_SPANS = "array<struct<start: int, end: int>>"


def _string(value: Column, name: str) -> Column:
    """A member of an object if it is a string; null if it is anything else."""
    member = F.try_variant_get(value, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(member) == "STRING", F.try_variant_get(value, f"$.{name}", "string"))


def _is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))


def spans(reply: Column, key: str) -> Column:
    """(start, end), both from 0, of whatever between braces may be an object with a list under ``key``, by start.

    Quotes that no backslash escapes open and close strings. A brace belongs with those that an even number of quotes lies
    between: the others are in strings, seen from it. So two stacks of open braces, which change places at each quote,
    find each brace's other half in one pass, whatever quotes the prose around holds. A brace counts only if the key
    stands in it directly. ``key`` is written plainly, without escapes.
    """
    # Escaped signs become as many blanks, so that places stay.
    plain = F.regexp_replace(reply, '\\\\[\\\\"]', "  ")
    tokens = F.regexp_extract_all(plain, F.lit(f'"{key}"{_SPACE}:{_SPACE}\\[|[^"{{}}]++|["{{}}]'), F.lit(0))
    none = F.array().cast("array<int>")
    state = F.struct(F.lit(0).alias("at"), none.alias("here"), none.alias("other"), F.array().cast(_SPANS).alias("found"))

    def step(s: Column, token: Column) -> Column:
        here, size = s["here"], F.size(s["here"])
        top = F.get(here, size - 1)
        below = F.slice(here, 1, F.greatest(size - 1, F.lit(0)))
        first = F.substring(token, 1, 1)
        keyed = (first == '"') & (F.length(token) > 1)
        # An open brace is its place from 1; less than 0 if the key stands in it.
        pushed = F.concat(F.slice(here, F.greatest(size - DEEPEST + 2, F.lit(1)), F.lit(DEEPEST)), F.array(s["at"] + 1))
        marked = F.when(size > 0, F.concat(below, F.array(-F.abs(top)))).otherwise(here)
        closed = (token == "}") & (top < 0)
        return F.struct(
            (s["at"] + F.length(token)).alias("at"),
            F.when(keyed, marked).when(first == '"', s["other"]).when(token == "{", pushed).when(token == "}", below).otherwise(here).alias("here"),
            F.when((first == '"') & ~keyed, here).otherwise(s["other"]).alias("other"),
            F.when(closed, F.concat(s["found"], F.array(F.struct((-top - 1).alias("start"), s["at"].alias("end"))))).otherwise(s["found"]).alias("found"),
        )

    return F.array_sort(F.aggregate(tokens, state, step, lambda s: s["found"]))


def json_list(reply: Column, key: str) -> Column:
    """The list under ``key``, as variants, in the first JSON object of a reply that has one; null if none has.

    Code fences, prose with braces or quotes, broken objects and objects without such a list are passed over. Objects may
    lie in others. Not read are objects with a name twice, or more than DEEPEST deep. A null reply has no list.
    """
    lists = F.transform(
        spans(reply, key),
        lambda s: F.try_variant_get(F.try_parse_json(F.substring(reply, s["start"] + 1, s["end"] - s["start"] + 1)), f"$.{key}", "array<variant>"),
    )
    found = F.get(F.filter(lists, lambda x: x.isNotNull()), F.lit(0))
    return F.when(F.contains(reply, F.lit(f'"{key}"')), found)


def fixes(reply: Column) -> Column:
    """The fixes that a reply lists: (sentence, heading, replacement, source, problem); null if no list can be read.

    Entries without a replacement, or without a sentence and a heading that aren't blank, are dropped; members that aren't
    strings are null.
    """
    named = lambda x, n: T.strip(F.coalesce(_string(x, n), F.lit(""))) != ""
    good = lambda x: _is_object(x) & (named(x, PLACES[0]) | named(x, PLACES[1])) & _string(x, REPLACEMENT).isNotNull()
    kept = F.filter(json_list(reply, FIXES), good)
    return F.transform(kept, lambda x: F.struct(*(_string(x, n).alias(n) for n in (*PLACES, REPLACEMENT, "source", "problem"))))


def _event(line: Column) -> Column:
    """The object that a whole line is; null if it is anything else."""
    only = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), line, F.lit("]"))), "$", "array<variant>")
    return F.when((F.size(only) == 1) & _is_object(F.get(only, F.lit(0))), F.get(only, F.lit(0)))


def of_lines(lines: Column) -> Column:
    """The text of a reply whose lines are events in JSON, in order.

    Texts of one message belong together, in the place of its first; a message that goes on from one that was cut off is
    joined to it (``text.continued``). A result that is an error makes the reply empty. Lines that aren't objects are
    passed over; if none is, the lines are the reply. Null lines, as none, give an empty reply.
    """
    lines = F.filter(lines, lambda x: x.isNotNull())
    events = F.filter(F.transform(lines, _event), lambda e: e.isNotNull())

    def read(found: Column) -> Column:
        failed = F.exists(found, lambda e: (_string(e, "type") == "result") & F.coalesce(F.try_variant_get(e, "$.is_error", "boolean"), F.lit(False)))
        said = F.transform(
            F.filter(found, lambda e: _string(e, "type") == "assistant"),
            lambda e, k: F.struct(F.coalesce(F.nullif(F.try_variant_get(e, "$.message.id", "string"), F.lit("")), F.concat(F.lit("\n"), k.cast("string"))).alias("id"), _said(e).alias("text")),
        )
        messages = T.named(said, lambda a: F.transform(F.array_distinct(a["id"]), lambda i: F.array_join(F.transform(F.filter(a, lambda x: x["id"] == i), lambda x: x["text"]), "")))
        whole = F.aggregate(F.filter(messages, lambda t: t != ""), F.lit(""), lambda a, t: F.when(a == "", t).otherwise(T.continued(a, t)))
        return F.when(F.size(found) == 0, F.array_join(lines, "\n")).when(F.coalesce(failed, F.lit(False)), "").otherwise(whole)

    return T.strip(F.coalesce(T.named(events, read), F.lit("")))


def _said(event: Column) -> Column:
    """The texts of a message's blocks."""
    blocks = F.filter(F.coalesce(F.try_variant_get(event, "$.message.content", "array<variant>"), F.array().cast("array<variant>")), lambda b: _string(b, "type") == "text")
    return F.array_join(F.transform(blocks, lambda b: F.coalesce(_string(b, "text"), F.lit(""))), "")


def of_output(output: Column) -> Column:
    """The text of a reply that a program printed as events, one to a line."""
    return of_lines(F.split(output, T.LINE_END))


def gathered(events: DataFrame, *by: str | Column) -> DataFrame:
    """(reply_id, reply) of ``events(reply_id, seq, line)`` in the order of ``seq``; one reply's events meet in one row, as its text does."""
    rows = events.groupBy("reply_id", *by).agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("events"))
    return rows.select("reply_id", of_lines(F.col("events.line")).alias("reply"))
