"""Identifiers that links lead to, carried through a rewrite as tokens in the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nodes as N
from ..functions import text as T
from . import links as L

# The token of an anchor, and what it becomes.
OPEN_TOKEN, CLOSE_TOKEN, MARK = "⟦ANCHOR:", "⟧", ('<a id="', '"></a>')
_PIECES = "⟦ANCHOR:[^⟦⟧]*⟧|[^⟦]++|⟦"


def _firsts(found: Column, name: str) -> Column:
    """Of structs whose first member is ``name`` and whose next is a place, those of the least place for each name."""
    return T.named(F.array_sort(found), lambda s: F.filter(s, lambda x, k: (k == 0) | (F.get(s, k - 1)[name] != x[name])))


def with_tokens(pages: DataFrame, ids: str = "ids") -> DataFrame:
    """``pages`` whose ``html`` has a token before the first element of each identifier in ``ids`` (an array), and ``anchors``, those found, in order.

    Identifiers that no element has are passed over, and so is what stands in comments, scripts and styles. A null page has
    no anchors and stays null; null ``ids`` are none.
    """
    rows = N.with_tree(pages)
    named = F.transform(
        F.filter("tree", lambda x: x["kind"].isin(N.OPEN, N.SINGLE)), lambda x: F.struct(N.attribute(x["raw"], "id").alias("id"), x["i"].alias("i"))
    )
    wanted = F.filter(named, lambda x: F.coalesce(F.array_contains(ids, x["id"]), F.lit(False)))
    places = F.array_sort(F.transform(_firsts(wanted, "id"), lambda x: F.struct(x["i"].alias("i"), x["id"].alias("id"))))
    rows = rows.withColumn("places", F.coalesce(places, F.array().cast("array<struct<i: int, id: string>>")))
    text = lambda start, end: F.array_join(F.slice(F.transform("tree", lambda x: x["raw"]), start + 1, end - start), "")
    before = lambda k: F.when(k == 0, 0).otherwise(F.get("places", k - 1)["i"])
    parts = F.transform("places", lambda p, k: F.concat(text(before(k), p["i"]), F.lit(OPEN_TOKEN), p["id"], F.lit(CLOSE_TOKEN)))
    made = F.concat(F.array_join(parts, ""), text(before(F.size("places")), F.size("tree")))
    return rows.withColumn("anchors", F.col("places.id")).withColumn("html", made).drop("tree", "places")


def protected(pages: DataFrame) -> DataFrame:
    """(page_id, html, anchors): the pages with a token before each element that some link leads to.

    Links of all pages meet the identifiers by book, path and identifier; those of one page are put together before the
    page is joined with them.
    """
    ids = L.referenced(pages).groupBy("book", "path").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    rows = pages.select("page_id", "html", L.book().alias("book"), L.normal(L.path()).alias("path")).join(ids, ["book", "path"], "left")
    return with_tokens(rows.select("page_id", "html", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))).drop("ids")


def restored(html: Column, ids: Column) -> Column:
    """(html, lost): the first token of each of ``ids`` as an anchor of that name, others of these names gone; lost ones stand at the top, in order.

    Backslashes that a conversion put into tokens go first. Tokens of other names stay. A null text stays null.
    """

    def of(pieces: Column) -> Column:
        name = lambda p: F.when(F.startswith(p, F.lit(OPEN_TOKEN)), F.substring(p, len(OPEN_TOKEN) + 1, F.length(p) - len(OPEN_TOKEN) - len(CLOSE_TOKEN)))
        found = F.filter(F.transform(pieces, lambda p, k: F.struct(name(p).alias("id"), k.alias("k"))), lambda x: F.coalesce(F.array_contains(ids, x["id"]), F.lit(False)))
        anchor = lambda x: F.concat(F.lit(MARK[0]), x, F.lit(MARK[1]))

        def put(firsts: Column) -> Column:
            known = lambda p: F.startswith(p, F.lit(OPEN_TOKEN)) & F.coalesce(F.array_contains(ids, name(p)), F.lit(False))
            body = F.array_join(F.transform(pieces, lambda p, k: F.when(~known(p), p).when(F.array_contains(firsts["k"], k), anchor(name(p))).otherwise("")), "")
            lost = F.array_except(ids, firsts["id"])
            return F.struct(F.concat(F.array_join(F.transform(lost, anchor), ""), body).alias("html"), lost.alias("lost"))

        return T.named(_firsts(found, "id"), put)

    return T.named(F.regexp_extract_all(T.unescaped_tokens(html), F.lit(_PIECES), F.lit(0)), of)
