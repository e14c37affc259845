"""Styled wrappers that hold a single block, put back around the block after a rewrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nodes as N
from ..functions import text as T

# The blocks that a wrapper may hold, the elements that wrap, the least text that a block is known by.
BLOCKS, WRAPPERS, LEAST_TEXT = ("p", "blockquote", "ul", "ol", "dl"), ("div", "section"), 20
#: Blocks but paragraphs are also known by a text whose edits come to no more than one in so many of both texts' characters.
EDITED = 10
_ID = r"(?is)\sid\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"


def _ids(tree: Column, x: Column) -> Column:
    """The identifiers of the elements inside an element."""
    inside = F.filter(N.inner(tree, x), lambda y: y["kind"].isin(N.OPEN, N.SINGLE) & (y["pre"] != x["pre"]))
    return F.array_compact(F.transform(inside, lambda y: N.attribute(y["raw"], "id")))


def _text(tree: Column, x: Column) -> Column:
    return T.normal(N.spaced_text(tree, x))


def _class(x: Column) -> Column:
    return F.array_join(N.classes(x["raw"]), " ")


def wrapped(source: DataFrame) -> DataFrame:
    """(page_id, wraps): the wrappers of each page that has some, in order.

    A wrapper is a div or section with a class that is no callout and holds no image, but one block and no other text;
    links without text, which are anchors, don't count. Of the block its name, class, text and the identifiers inside are kept.
    """
    tree = F.col("tree")
    is_wrapper = lambda x: (x["kind"] == N.OPEN) & x["tag"].isin(*WRAPPERS) & N.attribute(x["raw"], "class").isNotNull() & ~F.coalesce(N.is_callout(x), F.lit(False))

    def sole(inside: Column, x: Column) -> Column:
        own = F.filter(inside, lambda y: (y["parent"] == x["pre"]) & ~((y["kind"] == N.TEXT) & (T.strip(N.H.unescape(y["raw"])) == "")))
        blocks = F.filter(own, lambda y: (y["tag"] != "a") | (T.strip(N.text(tree, y)) != ""))
        bare = F.size(F.filter(inside, lambda y: y["tag"] == "img")) == 0
        return T.named(blocks, lambda b: F.when((F.size(b) == 1) & F.get(b, F.lit(0))["tag"].isin(*BLOCKS) & bare, F.get(b, F.lit(0))))

    def held(x: Column) -> Column:
        return F.struct(x.alias("x"), T.named(N.inner(tree, x), lambda inside: sole(inside, x)).alias("block"))

    def kept(w: Column) -> Column:
        x, b = w["x"], w["block"]
        return F.struct(
            x["tag"].alias("tag"), _class(x).alias("class"), x["raw"].alias("start"), N.attribute(x["raw"], "id").alias("id"),
            b["tag"].alias("block"), _class(b).alias("block_class"), _ids(tree, b).alias("ids"), _text(tree, b).alias("text"),
        )

    rows = _once(N.with_tree(source.select("page_id", "html")), "held", F.array(F.transform(F.filter(tree, is_wrapper), held)))
    wraps = F.transform(F.filter("held", lambda w: w["block"].isNotNull()), kept)
    return _once(rows, "wraps", F.filter(F.array(wraps), lambda w: F.size(w) > 0)).select("page_id", "wraps")


def like(a: Column, b: Column) -> Column:
    """Whether two texts differ by few edits: an exchanged character counts twice, once in each text, one more or less counts once."""
    both, apart = F.length(a) + F.length(b), F.abs(F.length(a) - F.length(b))
    most = F.when(EDITED * apart <= both, F.levenshtein(a, b))
    return F.coalesce(EDITED * (2 * most - apart) <= both, F.lit(False))


def _once(rows: DataFrame, name: str, values: Column) -> DataFrame:
    """``rows`` with one column more, a row for each of ``values``: unlike a projection, this isn't put in place of its name in what loops over it."""
    return rows.select("*", F.explode(values).alias(name))


def _chosen(wraps: Column, blocks: Column) -> Column:
    """For each wrapper in turn the first block that is its own and isn't wrapped in one of its kind: (w, b), in the order of wrappers."""

    def step(acc: Column, w: Column) -> Column:
        def own(b: Column) -> Column:
            same = (F.length(w["text"]) >= LEAST_TEXT) & ((b["text"] == w["text"]) | (w["block"] != "p") & like(b["text"], w["text"]))
            known = F.when(F.size(w["ids"]) > 0, F.arrays_overlap(w["ids"], b["ids"])).otherwise(same)
            taken = F.exists(acc, lambda u: (u["b"]["i"] == b["i"]) & (u["w"]["tag"] == w["tag"]) & (u["w"]["class"] == w["class"]))
            around = (b["parent_tag"] == w["tag"]) & (b["parent_class"] == w["class"])
            return (b["tag"] == w["block"]) & ~F.coalesce(around, F.lit(False)) & known & ~taken

        found = F.transform(F.slice(F.filter(blocks, own), 1, 1), lambda b: F.struct(w.alias("w"), b.alias("b")))
        return F.concat(acc, found)

    kind = "array<struct<w: struct<tag: string, class: string, start: string, id: string, block: string, block_class: string, ids: array<string>, text: string>, b: struct<i: int, until: int, after: boolean, tag: string, class: string, parent_tag: string, parent_class: string, ids: array<string>, text: string>>>"
    return F.aggregate(wraps, F.array().cast(kind), step)


def restored(source: DataFrame, output: DataFrame) -> DataFrame:
    """(page_id, html, restored): output pages with the wrappers of their source back around blocks that lost them.

    A block of the same name is a wrapper's own if it holds one of the identifiers that the source's block held, or, where
    that held none, if its text has LEAST_TEXT characters and is the source's; blocks other than paragraphs may differ by
    a few edits (``like``). The first such block in the page counts that doesn't stand in a wrapper of that name and
    class yet. It gets the source's class if it has none. A wrapper's identifier goes where the page has it already. Pages that gain nothing
    are left out. Only wrappers, without the rest of their pages, are joined with the output.
    """
    tree = F.col("tree")
    rows = N.with_tree(output.select("page_id", "html").join(wrapped(source), "page_id"))
    rows = _once(rows, "nodes", F.array(N.nodes(tree)))

    def block(x: Column) -> Column:
        parent = F.when(x["parent"] >= 0, F.get("nodes", x["parent"]))
        end = F.get(tree, x["until"])
        after = (end["kind"] != N.END) | (F.lower(F.regexp_extract(end["raw"], N.NAME, 1)) == x["tag"])
        return F.struct(
            x["i"].alias("i"), x["until"].alias("until"), after.alias("after"), x["tag"].alias("tag"), _class(x).alias("class"), parent["tag"].alias("parent_tag"),
            F.when(parent.isNotNull(), _class(parent)).alias("parent_class"), _ids(tree, x).alias("ids"), _text(tree, x).alias("text"),
        )

    wanted = F.array_distinct(F.transform("wraps", lambda w: w["block"]))
    rows = _once(rows, "blocks", F.array(T.named(wanted, lambda names: F.transform(F.filter(tree, lambda x: (x["kind"] == N.OPEN) & F.array_contains(names, x["tag"])), block))))
    rows = _once(rows, "made", F.filter(F.array(_chosen(F.col("wraps"), F.col("blocks"))), lambda m: F.size(m) > 0))
    taken = F.array_compact(F.transform(F.filter("nodes", lambda x: x["kind"].isin(N.OPEN, N.SINGLE)), lambda x: N.attribute(x["raw"], "id")))
    rows = _once(rows, "taken", F.array(taken))

    # What is put in, by the event that it stands before: ends, of the inner ones first, and then starts, of the outer ones first.
    start = lambda w: F.when(F.coalesce(F.array_contains("taken", w["id"]), F.lit(False)), F.regexp_replace(w["start"], _ID, "")).otherwise(w["start"])
    opened = F.transform("made", lambda u, k: F.struct(u["b"]["i"].alias("at"), F.lit(1).alias("kind"), u["b"]["i"].alias("of"), k.alias("k"), start(u["w"]).alias("text")))
    end = lambda u: u["b"]["until"] + u["b"]["after"].cast("int")
    closed = F.transform("made", lambda u, k: F.struct(end(u).alias("at"), F.lit(0).alias("kind"), (-u["b"]["i"]).alias("of"), (-k).alias("k"), F.concat(F.lit("</"), u["w"]["tag"], F.lit(">")).alias("text")))
    rows = _once(rows, "edits", F.array(F.array_sort(F.concat(opened, closed))))
    styled = F.filter("made", lambda u: (u["b"]["class"] == "") & (u["w"]["block_class"] != ""))
    rows = _once(rows, "styled", F.array(F.transform(styled, lambda u: F.struct(u["b"]["i"].alias("i"), u["w"]["block_class"].alias("class")))))

    def raw(x: Column) -> Column:
        given = F.get(F.filter("styled", lambda s: s["i"] == x["i"]), F.lit(0))["class"]
        name = F.length(x["tag"]) + 1
        bare = F.regexp_replace(F.substring(x["raw"], name + 1, F.length(x["raw"])), r"(?is)\sclass\s*=\s*(?:\"\s*\"|'\s*')", "")
        return F.coalesce(F.concat(F.substring(x["raw"], F.lit(1), name), F.lit(' class="'), given, F.lit('"'), bare), x["raw"])

    rows = _once(rows, "pieces", F.array(F.transform(tree, lambda x: F.when(F.size("styled") == 0, x["raw"]).otherwise(raw(x)))))
    text = lambda a, b: F.array_join(F.slice("pieces", a + 1, b - a), "")
    before = lambda k: F.when(k == 0, 0).otherwise(F.get("edits", k - 1)["at"])
    parts = F.transform("edits", lambda e, k: F.concat(text(before(k), e["at"]), e["text"]))
    html = F.concat(F.array_join(parts, ""), text(before(F.size("edits")), F.size("pieces")))
    return rows.select("page_id", html.alias("html"), F.size("made").alias("restored"))
