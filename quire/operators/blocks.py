"""Listings, links and paragraphs of two editions, matched by keys, ranks and likeness."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions import html as H
from ..functions import nodes as N
from ..functions import text as T

# Listings are alike from this share of words, notes from this likeness, which is 0 below a share of words.
SIMILAR, LIKENESS, LEAST_SHARED = 0.6, 0.7, 0.4

LISTING = r"(?is)(<pre(?:\s[^>]*)?>.*?</pre\s*>)"
LINK_START = r"(?is)(<a\s[^>]*>)"
CLASS = r"""(?is)\sclass\s*=\s*["']([^"']*)["']"""
ID = r"""(?is)\sid\s*=\s*["']([^"']*)["']"""
CAPTION = r"(?is)<(?:figcaption|p)(?:\s[^>]*)?>(.*?)</(?:figcaption|p)\s*>"


def listings(pages: DataFrame) -> DataFrame:
    """(page_id, pos, html, key): the listings of a page; the key is their text, one space for each run of white space."""
    rows = pages.select("page_id", F.posexplode(H.found(F.col("html"), LISTING)).alias("pos", "html"))
    return rows.withColumn("key", T.flat(H.unescape(F.regexp_replace("html", H.TAG, ""))))


def similar(a: Column, b: Column) -> Column:
    return T.words_shared(a, b) >= SIMILAR


def matched_listings(source: DataFrame, output: DataFrame) -> DataFrame:
    """(page_id, pos, original, how): each listing of the output with the place of the source's that it is, or null.

    The k-th listing of a text is the source's k-th of that text (``text``). What is left on both sides is paired in order
    (``order``) if there is as much of it and every pair is alike; else it stays (``none``). A task orders the listings of one page at most.
    """
    same = Window.partitionBy("page_id", "key").orderBy("pos")
    ranked = lambda pages: listings(pages).select("page_id", "pos", "key", F.row_number().over(same).alias("nth"))
    was, now = ranked(source).withColumnRenamed("pos", "original"), ranked(output)
    both = now.join(was, ["page_id", "key", "nth"], "full")
    left = lambda pos, name: both.filter(F.col(pos).isNotNull() & F.col("original" if pos == "pos" else "pos").isNull()).select(
        "page_id", pos, F.col("key").alias(name)
    )
    place = Window.partitionBy("page_id").orderBy("at")
    old = left("original", "old").withColumnRenamed("original", "at").withColumn("k", F.row_number().over(place)).withColumnRenamed("at", "original")
    new = left("pos", "new").withColumnRenamed("pos", "at").withColumn("k", F.row_number().over(place)).withColumnRenamed("at", "pos")
    pairs = new.join(old, ["page_id", "k"], "full")
    whole = F.bool_and(F.col("pos").isNotNull() & F.col("original").isNotNull() & F.coalesce(similar(F.col("old"), F.col("new")), F.lit(False)))
    pairs = pairs.withColumn("all", whole.over(Window.partitionBy("page_id"))).filter("pos is not null")
    found = both.filter("pos is not null and original is not null").select("page_id", "pos", "original", F.lit("text").alias("how"))
    rest = pairs.select("page_id", "pos", F.when(F.col("all"), F.col("original")).alias("original"), F.when(F.col("all"), "order").otherwise("none").alias("how"))
    return found.unionByName(rest)


def link_starts(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, id, class) of the start tags of links; null for what one hasn't."""
    value = lambda pattern: F.when(F.col("tag").rlike(pattern), H.unescape(F.regexp_extract("tag", pattern, 1)))
    rows = pages.select("page_id", F.posexplode(H.found(F.col("html"), LINK_START)).alias("pos", "tag"))
    return rows.select("page_id", "pos", value(H.HREF).alias("href"), value(ID).alias("id"), F.nullif(value(CLASS), F.lit("")).alias("class"))


def link_classes(source: DataFrame, output: DataFrame) -> DataFrame:
    """(page_id, pos, class): the class that a link without one gets back, by its target or, without a target, by its id.

    Of several links of the source with one target the first counts, of several with one id the last.
    """
    was = link_starts(source).filter("class is not null")
    by_href = was.filter("href is not null and href <> ''").groupBy("page_id", "href").agg(F.min_by("class", "pos").alias("of_href"))
    by_id = was.filter("(href is null or href = '') and id is not null").groupBy("page_id", "id").agg(F.max_by("class", "pos").alias("of_id"))
    now = link_starts(output).filter("class is null")
    rows = now.join(by_href, ["page_id", "href"], "left").join(by_id, ["page_id", "id"], "left")
    chosen = F.when(F.coalesce("href", F.lit("")) != "", F.col("of_href")).otherwise(F.col("of_id"))
    return rows.select("page_id", "pos", chosen.alias("class")).filter("class is not null")


def section_leads(source: DataFrame) -> DataFrame:
    """(page_id, lead, n, sections): the class that most first paragraphs after headings have, if half of the headings' do.

    Of classes as frequent the one seen first counts; paragraphs without a class count as the class without a name, which is no lead.
    """
    rows = source.select("page_id", N.firsts(F.col("html")).alias("h"))
    rows = rows.select("page_id", "h.sections", F.posexplode(F.transform("h.starts", lambda x: F.array_join(N.classes(x), " "))).alias("pos", "lead"))
    counts = rows.groupBy("page_id", "sections", "lead").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = counts.groupBy("page_id", "sections").agg(F.max_by(F.struct("lead", "n"), F.struct("n", -F.col("first"))).alias("b"))
    best = best.select("page_id", F.col("b.lead").alias("lead"), F.col("b.n").alias("n"), "sections")
    return best.filter((F.col("lead") != "") & (2 * F.col("n") >= F.col("sections")))


def leads_restored(source: DataFrame, output: DataFrame) -> DataFrame:
    """(page_id, html, restored): output pages with their source's lead as the class of first paragraphs that have none but have text.

    Which these are is known before the lead is, so only pages with some meet it, as a few pieces of text.
    """
    rows = output.select("page_id", N.cut_at_firsts(F.col("html")).alias("cut")).select("page_id", "cut.pieces", "cut.said")
    rows = rows.withColumn("chosen", F.transform("said", lambda x, k: x & (F.size(N.classes(F.col("pieces")[2 * k + 1])) == 0)))
    rows = rows.filter(F.array_contains("chosen", True)).join(section_leads(source).select("page_id", "lead"), "page_id")
    start = lambda x: F.concat(F.substring(x, 1, 2), F.lit(' class="'), F.col("lead"), F.lit('"'), F.regexp_replace(F.substring(x, 3, F.length(x)), r"(?is)\sclass\s*=\s*(?:\"\"|'')", ""))
    put = F.transform("pieces", lambda x, j: F.when((j % 2 == 1) & F.get("chosen", F.floor(j / 2).cast("int")), start(x)).otherwise(x))
    return rows.select("page_id", F.array_join(put, "").alias("html"), F.size(F.filter("chosen", lambda x: x)).alias("restored"))


def captions(pages: DataFrame) -> DataFrame:
    """(page_id, pos, label, text) of paragraphs and captions of figures that open with a label."""
    rows = pages.select("page_id", F.posexplode(H.found(F.col("html"), CAPTION)).alias("pos", "inner"))
    rows = rows.withColumn("text", T.flat(H.unescape(F.regexp_replace("inner", H.TAG, " "))))
    return rows.withColumn("label", T.caption_label(F.col("text"))).filter("label is not null").select("page_id", "pos", "label", "text")


def captions_rewritten(source: DataFrame, output: DataFrame) -> DataFrame:
    """(page_id, pos, label, text): the paragraphs of an output page that are a caption of its source rewritten, by the first caption of their label.

    Such a paragraph is one by its text (``text.caption_like``), and the element before or after it in the same parent is a listing or table.
    """
    rows = N.with_tree(output.select("page_id", "html"))
    shown = F.filter("tree", lambda x: x["tag"].isin("pre", "table"))
    rows = rows.withColumn("shown", F.struct(F.transform(shown, lambda x: x["pre"]).alias("pre"), F.array_compact(F.transform(shown, lambda x: x["after"])).alias("after")))
    has = lambda places, x: F.coalesce(F.array_contains(places, x), F.lit(False))
    beside = F.filter("tree", lambda x: (x["tag"] == "p") & (has(F.col("shown.pre"), x["after"]) | has(F.col("shown.after"), x["pre"])))
    rows = rows.select("page_id", F.posexplode(F.transform(beside, lambda x: T.flat(N.spaced_text(F.col("tree"), x)))).alias("pos", "text"))
    first = captions(source).groupBy("page_id", "label").agg(F.min_by("text", "pos").alias("original"))
    rows = rows.withColumn("label", T.caption_label(F.col("text"))).join(first, ["page_id", "label"])
    return rows.filter(T.caption_like(F.col("text"), F.col("original"))).select("page_id", "pos", "label", "text")


def _each(pages: DataFrame, chosen, made) -> DataFrame:
    """(page_id, pos, x): what ``made`` gives of the tree and each of the nodes that ``chosen`` takes, in order; only this leaves the page's row."""
    rows = N.with_tree(pages.select("page_id", "html"))
    return rows.select("page_id", F.posexplode(F.transform(F.filter("tree", chosen), lambda x: made(F.col("tree"), x))).alias("pos", "x"))


def callouts(pages: DataFrame) -> DataFrame:
    """(page_id, pos, tag, class, inside) of the elements that are callouts, and whether another one holds them."""
    rows = _each(pages, N.is_callout, lambda tree, x: F.struct(x["tag"].alias("tag"), F.array_join(N.classes(x["raw"]), " ").alias("class"), x["boxed"].alias("inside")))
    return rows.select("page_id", "pos", "x.*")


def notes(pages: DataFrame) -> DataFrame:
    """(page_id, note, text, body, parts) of a page's callouts that no other one holds, without their labels, and of their blocks (``nodes.notes``)."""
    rows = pages.select("page_id", N.notes(F.col("html")).alias("notes")).select("page_id", F.posexplode("notes").alias("note", "x"))
    return rows.select("page_id", "note", "x.*").filter("text <> ''")


def paragraphs(pages: DataFrame) -> DataFrame:
    """(page_id, pos, text, parent, pre, after) of the paragraphs outside callouts, with their place in the page's tree."""
    rows = pages.select("page_id", N.paragraphs(F.col("html")).alias("paragraphs")).select("page_id", F.posexplode("paragraphs").alias("pos", "x"))
    return rows.select("page_id", "pos", "x.*").filter("text <> ''")


def _near(notes: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(page_id, note, a, pos, b, shared) of the notes and paragraphs of a page that share LEAST_SHARED of their words.

    Each text's words are gathered once, before the join. A pair whose sets differ too much in size is left out unseen.
    """
    rows = lambda side, place, name: side.select("page_id", place, F.col("text").alias(name), F.array_distinct(T.words(F.col("text"))).alias(f"{name}_words"))
    one, other = F.col("a_words"), F.col("b_words")
    least, most = F.least(F.size(one), F.size(other)), F.greatest(F.size(one), F.size(other))
    pairs = rows(notes, "note", "a").join(rows(paragraphs, "pos", "b"), "page_id").filter((least > 0) & (least / most >= LEAST_SHARED))
    both = F.explode(F.array(F.size(F.array_intersect(one, other)))).alias("n")
    pairs = pairs.select("page_id", "note", "a", "pos", "b", (F.size(one) + F.size(other)).alias("all"), both)
    return pairs.withColumn("shared", F.col("n") / (F.col("all") - F.col("n"))).filter(F.col("shared") >= LEAST_SHARED).drop("n", "all")


def note_candidates(source: DataFrame, output: DataFrame) -> DataFrame:
    """(page_id, note, pos, shared): the paragraphs of an output page that share LEAST_SHARED of the words of a note of the source's."""
    return _near(notes(source), paragraphs(output)).select("page_id", "note", "pos", F.round("shared", 6).alias("shared"))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([1.0 if x == y else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(StructType([StructField("place", IntegerType()), StructField("likeness", DoubleType())]))
def _likest(wholes: pd.Series, runs: pd.Series) -> pd.DataFrame:
    """The place and likeness of the run that is likest to one of the texts, the first where equal, if it has LIKENESS; -1 and 0 if none has.

    Likeness is at most what the lengths of two texts allow, and what their letters in any order do: those that can't be the likest aren't matched.
    """

    def likest(texts: list[str], others: list[str]) -> tuple[int, float]:
        tried = sorted(((2.0 * min(len(a), len(b)) / (len(a) + len(b)), -k, a, b) for a in texts for k, b in enumerate(others)), reverse=True)
        place, most = -1, LIKENESS
        for bound, k, a, b in tried:
            if bound < most:
                break
            one, other = set(a.split(" ")), set(b.split(" "))
            match = difflib.SequenceMatcher(None, a, b, autojunk=False)
            if len(one & other) / len(one | other) < LEAST_SHARED or match.quick_ratio() < most:
                continue
            ratio = match.ratio()
            if ratio > most or ratio == most and (place < 0 or -k < place):
                place, most = -k, ratio
        return (place, most) if place >= 0 else (-1, 0.0)

    made = [(-1, 0.0) if b is None else likest(list(a), list(b)) for a, b in zip(wholes, runs, strict=True)]
    return pd.DataFrame(made, columns=["place", "likeness"])


def likeness(pairs: DataFrame) -> DataFrame:
    """``pairs(a, b)`` of normal texts with ``likeness``: 0 below LEAST_SHARED of common words, so that only the others are matched letter by letter."""
    shared = T.jaccard(F.col("a"), F.col("b")) >= LEAST_SHARED
    near = pairs.withColumn("likeness", F.when(shared, _ratio(F.when(shared, F.col("a")).otherwise(""), F.when(shared, F.col("b")).otherwise(""))).otherwise(0.0))
    return near


def _may_be_like(a: Column, b: Column) -> Column:
    """Whether two lengths of texts allow LIKENESS, which is at most twice the shorter one's share of both."""
    return 2.0 * F.least(a, b) / (a + b) >= LIKENESS


def _runs(like: Column, most: Column) -> Column:
    """The runs of siblings that follow each other among ``like`` (by parent and place): from each one as far as they go, ``most`` at most."""
    follows = lambda j: F.coalesce(F.get(like, j)["after"] == F.get(like, j - 1)["pre"], F.lit(False))
    heads = F.filter(F.sequence(F.lit(0), F.size(like) - 1), lambda j: (j == 0) | ~follows(j))
    chains = T.named(heads, lambda h: F.transform(h, lambda s, k: F.slice(like, s + 1, F.coalesce(F.get(h, k + 1), F.size(like)) - s)))
    runs = F.flatten(F.transform(chains, lambda c: F.transform(c, lambda _, k: F.slice(c, k + 1, most))))
    return F.when(F.size(like) > 1, F.filter(runs, lambda r: F.size(r) > 1))


def _note_pairs(notes: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """A row for each paragraph b of a page and each text a of a note that have LIKENESS: a is one of ``wholes`` or, if ``part``, of its ``most`` blocks.

    A note's lengths are compared first, then each text's, then words, then letters; the first two rule out no pair that has LIKENESS.
    """
    said = lambda texts: F.array_distinct(F.filter(texts, lambda x: x != ""))
    rows = notes.select("page_id", "note", said(F.array("text", "body")).alias("wholes"), said(F.col("parts")).alias("parts"))
    each = lambda name, part: F.transform(name, lambda x: F.struct(x.alias("a"), F.length(x).alias("n"), F.lit(part).alias("part")))
    # A note of one block is a paragraph or nothing.
    texts = F.when(F.size("parts") > 1, F.concat(each("wholes", False), each("parts", True))).otherwise(each("wholes", False))
    rows = rows.select("page_id", "note", "wholes", F.size("parts").alias("most"), texts.alias("texts"))
    lengths = F.transform("texts", lambda x: x["n"])
    rows = rows.select("*", F.array_min(lengths).alias("shortest"), F.array_max(lengths).alias("longest"))
    other = paragraphs.select("page_id", "pos", F.col("text").alias("b"), "parent", "pre", "after", F.length("text").alias("length"))
    nearest = F.greatest(F.col("shortest"), F.least(F.col("longest"), F.col("length")))
    pairs = rows.join(other, "page_id").filter(_may_be_like(nearest, F.col("length")))
    pairs = pairs.select("*", F.explode(F.filter("texts", lambda x: _may_be_like(x["n"], F.col("length")))).alias("x"))
    pairs = pairs.select("page_id", "note", "wholes", "most", "pos", "parent", "pre", "after", "b", "x.a", "x.part")
    # In a generator words are gathered once, whatever reads it.
    pairs = pairs.select("*", F.explode(F.array(T.jaccard(F.col("a"), F.col("b")) >= LEAST_SHARED)).alias("near")).filter("near")
    return pairs.withColumn("likeness", _ratio("a", "b")).filter(F.col("likeness") >= LIKENESS)


def kept_notes(notes: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(page_id, note, pos, likeness): for each note (page_id, note, text) its likest paragraph (page_id, pos, text) of the page, the first where equal, if it is the note kept.

    A note may have a ``body`` and ``parts``, and paragraphs a ``parent``, ``pre`` and ``after``, for ``notes_kept``, whose rule this is for any texts.
    """
    had = lambda rows, name, kind: F.col(name) if name in rows.columns else F.lit(None).cast(kind)
    parts = F.coalesce(F.transform(had(notes, "parts", "array<string>"), T.normal), F.array().cast("array<string>"))
    own = notes.select("page_id", "note", T.normal(F.col("text")).alias("text"), T.normal(had(notes, "body", "string")).alias("body"), parts.alias("parts"))
    places = [had(paragraphs, name, "int").alias(name) for name in ("parent", "pre", "after")]
    return _kept(own, paragraphs.select("page_id", "pos", T.normal(F.col("text")).alias("text"), *places))


def notes_kept(source: DataFrame, output: DataFrame) -> DataFrame:
    """(page_id, note, pos, likeness): for each note of a page its likest paragraph of the output's page, the first where equal, if it is the note kept.

    The note is its text, or that of its blocks (``body``). One of several blocks (``parts``) may be kept as several paragraphs, a row each:
    as many as it has blocks at most, of which each is like one of them, and each but the first follows the one before in the same
    parent (``parent``, ``pre``, ``after``); together they are matched with the whole note, and count if they are likelier than any one paragraph.
    Likeness is that of ``likeness``: 0 of texts below LEAST_SHARED of common words, whatever letters they share.
    """
    return _kept(notes(source), paragraphs(output))


def _kept(notes: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """``notes_kept`` of normal texts."""
    pairs = _note_pairs(notes, paragraphs)
    found = pairs.groupBy("page_id", "note", "wholes").agg(
        F.max_by(F.struct(F.array("pos").alias("places"), "likeness"), F.when(~F.col("part"), F.struct("likeness", -F.col("pos")))).alias("one"),
        F.array_sort(F.collect_set(F.when(F.col("part"), F.struct("parent", "pre", "after", "pos", "b")))).alias("like"),
        F.first("most").alias("most"),
    )
    joined = lambda r: F.struct(F.transform(r, lambda x: x["pos"]).alias("places"), F.array_join(F.transform(r, lambda x: x["b"]), " ").alias("b"))
    runs = F.array_sort(F.transform(_runs(F.col("like"), F.col("most")), joined))
    rows = found.select("page_id", "note", "wholes", "one", runs.alias("runs"))
    rows = rows.withColumn("likest", _likest("wholes", F.transform("runs", lambda x: x["b"])))
    run = F.struct(F.get("runs", F.col("likest.place"))["places"].alias("places"), "likest.likeness")
    likelier = (F.col("likest.likeness") >= LIKENESS) & (F.col("one").isNull() | (F.col("likest.likeness") > F.col("one.likeness")))
    rows = rows.select("page_id", "note", F.when(likelier, run).otherwise(F.col("one")).alias("best"))
    return rows.select("page_id", "note", F.explode("best.places").alias("pos"), "best.likeness")


def _named_once(ids: Column, heads: Column) -> Column:
    """The headings with an identifier each: its own, or one of its text that neither the page nor a heading before has."""

    def next_(acc: Column, h: Column) -> Column:
        base = T.slug(h["text"])
        taken = lambda name: F.array_contains(acc["taken"], name)
        n = F.filter(F.sequence(F.lit(2), F.size(acc["taken"]) + 2), lambda k: ~taken(F.concat(base, F.lit("-"), k.cast("string"))))[0]
        own = F.when(h["id"] != "", h["id"]).when(~taken(base), base).otherwise(F.concat(base, F.lit("-"), n.cast("string")))
        return T.named(own, lambda x: F.struct(F.concat(acc["taken"], F.array(x)).alias("taken"), F.concat(acc["names"], F.array(x)).alias("names")))

    start = F.struct(ids.alias("taken"), F.array().cast("array<string>").alias("names"))
    names = F.aggregate(heads, start, next_)["names"]
    return F.zip_with(heads, names, lambda h, x: F.struct(h["pos"].alias("pos"), h["depth"].alias("depth"), h["text"].alias("text"), x.alias("id"), (h["id"] == "").alias("made")))


def contents(pages: DataFrame) -> DataFrame:
    """(page_id, grp, pos, depth, text, href, uid): the headings below the title as two levels of contents; a page is grouped by itself.

    The title is the first heading; if a header holds it, all headings of headers are left out, as are those in
    callouts and those without text. The shallowest level is depth 1, deeper than 2 is left out. A heading of depth 1, or
    the first one, opens a group, and those of depth 2 that follow belong to it. A heading without an identifier gets one
    from its text, with a number where the page or an earlier heading has it.
    """
    rows = N.with_tree(pages.select("page_id", "html"))
    tree = F.col("tree")
    heads = F.filter(tree, lambda x: x["tag"].rlike("^h[1-4]$") & ~x["boxed"])
    rows = rows.withColumn("heads", F.transform(heads, lambda x, k: F.struct(k.alias("pos"), F.substring(x["tag"], 2, 1).cast("int").alias("level"), T.flat(N.spaced_text(tree, x)).alias("text"), F.coalesce(N.attribute(x["raw"], "id"), F.lit("")).alias("id"), N.holding(tree, "^header$", x).alias("headed"))))
    titled = F.get("heads", F.lit(0))["headed"]
    rows = rows.withColumn("heads", F.filter("heads", lambda h: (h["text"] != "") & F.when(titled, ~h["headed"]).otherwise(h["pos"] > 0)))
    top = F.array_min(F.transform("heads", lambda h: h["level"]))
    deep = F.transform("heads", lambda h: F.struct(h["pos"].alias("pos"), (h["level"] - top + 1).alias("depth"), h["text"].alias("text"), h["id"].alias("id")))
    rows = rows.withColumn("heads", F.filter(deep, lambda h: h["depth"] <= 2))
    ids = F.array_compact(F.transform(F.filter(tree, lambda x: x["kind"].isin(N.OPEN, N.SINGLE)), lambda x: N.attribute(x["raw"], "id")))
    rows = rows.select("page_id", F.posexplode(_named_once(ids, F.col("heads"))).alias("nth", "h")).select("page_id", "nth", "h.*")
    up = Window.partitionBy("page_id").orderBy("nth")
    rows = rows.withColumn("grp", F.sum(((F.col("depth") == 1) | (F.col("nth") == 0)).cast("int")).over(up))
    href = F.concat(F.lit("#"), "id")
    return rows.select("page_id", "grp", "pos", "depth", "text", href.alias("href"), T.contents_id(href).alias("uid"))
