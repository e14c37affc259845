"""Navigation as rows: entries in document order, those that lead into one page alone, and contents rebuilt after a rewrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import nodes as N
from ..functions import text as T
from ..sources.staged import staged
from . import links as L


def lists(pages: DataFrame) -> DataFrame:
    """(page_id, url, nav, link, pre, last, depth, class, href, label): the links of navigation, which stand at ``link``.

    ``nav`` is the epub:type of the nav that holds a link. The first link that stands in a list item directly is the
    item's entry, with its pre, last, depth and class; pre is null for other links.
    """
    rows = N.with_tree(pages.select("page_id", "url", "html"))
    navs = F.transform(F.filter("tree", lambda x: x["tag"] == "nav"), lambda x: F.struct(x["pre"].alias("pre"), x["last"].alias("last"), F.coalesce(N.attribute(x["raw"], "epub:type"), F.lit("")).alias("type")))
    rows = rows.withColumn("navs", navs).filter(F.size("navs") > 0)
    some = F.filter("tree", lambda x: x["tag"].isin("li", "a") & F.exists("navs", lambda n: (x["pre"] > n["pre"]) & (x["pre"] <= n["last"])))
    kinds = F.transform(
        some,
        lambda x: F.struct(
            x["pre"].alias("pre"), x["last"].alias("last"), x["depth"].alias("depth"), x["parent"].alias("parent"), x["tag"].alias("tag"), F.array_join(N.classes(x["raw"]), " ").alias("class"),
            N.attribute(x["raw"], "href").alias("href"), F.when(x["tag"] == "a", T.flat(N.spaced_text(F.col("tree"), x))).alias("label"),
            F.element_at(F.filter("navs", lambda n: (x["pre"] > n["pre"]) & (x["pre"] <= n["last"])), -1)["type"].alias("nav"),
        ),
    )
    rows = rows.select("page_id", "url", F.explode(kinds).alias("x")).select("page_id", "url", "x.*")
    # An item and the links in it meet at the item's place, by a window: a join of both would read the pages twice.
    rows = rows.withColumn("at", F.when(F.col("tag") == "li", F.col("pre")).otherwise(F.col("parent")))
    at = Window.partitionBy("page_id", "at")
    is_link = (F.col("tag") == "a") & F.col("href").isNotNull()
    rows = rows.withColumn("item", F.max(F.when((F.col("tag") == "li") & F.col("page_id").isNotNull(), F.struct("last", "depth", "class"))).over(at))
    rows = rows.withColumn("first", F.min(F.when(is_link, F.col("pre"))).over(at)).filter(is_link)
    return rows.select(
        "page_id", "url", "nav", F.col("pre").alias("link"), F.when(F.col("item").isNotNull() & (F.col("pre") == F.col("first")), F.col("parent")).alias("pre"),
        F.col("item.last").alias("last"), F.col("item.depth").alias("depth"), F.col("item.class").alias("class"), "href", "label",
    )


def entries(pages: DataFrame) -> DataFrame:
    """(page_id, book, nav, pre, last, depth, class, href, label, target, sole): the entries of ``lists`` and where they lead.

    ``sole`` tells that all links under an entry's item lead where it does. In document order they are a run: they lead to
    one page if no link but the first leads elsewhere than the one before it, so changes are counted and two places
    compared.
    """
    inner = F.when(~F.col("href").rlike(H.EXTERNAL), L.resolved(F.when(L.path() == "", "/").otherwise(L.path()), F.col("href")))
    rows = lists(pages).withColumn("book", L.book()).withColumn("target", inner).drop("url")
    up = Window.partitionBy("page_id").orderBy("link")
    changed = (~F.col("target").eqNullSafe(F.lag("target").over(up)) & (F.row_number().over(up) > 1)).cast("int")
    rows = rows.withColumn("k", F.row_number().over(up)).withColumn("changed", changed).withColumn("run", F.sum("changed").over(up))
    # A run's number never falls in document order: that of an item's first link is the least from where the item begins, that
    # of its last link the most up to where it ends. Links and edges of items are ordered together, in one pass over the page.
    event = lambda at, edge, run: F.struct(F.col(at).alias("at"), F.lit(edge).alias("edge"), run.alias("of"))
    none = F.lit(None).cast("long")
    edges = F.array(event("link", 0, F.col("run")), *(F.when(F.col("pre").isNotNull(), event(at, k, none)) for at, k in (("pre", 1), ("last", 2))))
    marks = rows.select("*", F.explode(F.array_compact(edges)).alias("e"))
    near = lambda order: Window.partitionBy("page_id").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    marks = marks.withColumn("upto", F.max("e.of").over(near(F.col("e.at")))).withColumn("from", F.min("e.of").over(near(F.col("e.at").desc())))
    edge = lambda k, run: F.max(F.when(F.col("e.edge") == k, F.col(run)))
    own = ["book", "nav", "pre", "last", "depth", "class", "href", "label", "target"]
    made = marks.filter("pre is not null").groupBy("page_id", "link").agg(F.first(F.struct(*own)).alias("own"), edge(1, "from").alias("first_run"), edge(2, "upto").alias("last_run"))
    sole = F.col("own.target").isNotNull() & (F.col("first_run") == F.col("last_run"))
    return made.select("page_id", *(F.col(f"own.{c}").alias(c) for c in own), sole.alias("sole"))


def is_toc(nav: Column) -> Column:
    return nav.rlike(r"\btoc\b")


def rebuilt(nav: DataFrame, headings: DataFrame) -> DataFrame:
    """(page_id, nav, pre, nth, depth, class, href, label) of navigation after some pages were rewritten.

    ``headings(book, path, nth, level, id, text)`` are the contents of rewritten pages, level 1 or 2 and a row with a null
    nth where a page has none. The first entry of a contents list that leads into such a page with all that is under it
    holds the page's headings in place of what was there, with the class of the first that was; entries of page lists
    into rewritten pages go. All else stays: a part that links its first chapter keeps its other chapters.
    """
    headings = staged(headings, "headings")
    rows = entries(nav)
    files = headings.select("book", F.col("path").alias("target")).distinct().withColumn("rewritten", F.lit(True))
    rows = rows.join(files, ["book", "target"], "left").withColumn("rewritten", F.coalesce("rewritten", F.lit(False)))
    # What stands under a chosen entry leads to its page, so it is found by page and target.
    same = Window.partitionBy("page_id", "book", "target")
    fit = F.col("rewritten") & F.col("sole") & is_toc(F.col("nav"))
    rows = rows.withColumn("f", F.min(F.when(fit, F.struct("pre", "last"))).over(same))
    gone = F.col("f").isNotNull() & (F.col("pre") > F.col("f.pre")) & (F.col("pre") <= F.col("f.last"))
    listed = F.col("rewritten") & F.col("nav").rlike(r"\bpage-list\b")
    rows = rows.withColumn("gone", gone).withColumn("old", F.min(F.when(F.col("gone"), F.struct("pre", "class"))).over(same)["class"])
    # The navigation is read once: what stays and what is put in both come from these rows.
    rows = rows.select("page_id", "book", "nav", "pre", "depth", "class", "href", "label", "target", "gone", listed.alias("listed"), "old", F.coalesce(F.col("pre") == F.col("f.pre"), F.lit(False)).alias("chosen"))
    rows = staged(rows, "navigation")
    kept = rows.filter("not gone and not coalesce(listed, false)").select("page_id", "nav", "pre", F.lit(0).alias("nth"), "depth", "class", "href", "label")
    into = rows.filter("chosen").drop("label").join(headings.filter("nth is not null").withColumnRenamed("path", "target"), ["book", "target"])
    new = into.select(
        "page_id", "nav", "pre", F.col("nth"), (F.col("depth") + 2 * F.col("level")).alias("depth"), F.coalesce("old", F.lit("")).alias("class"),
        F.concat(F.regexp_replace("href", "#.*", ""), F.lit("#"), F.col("id")).alias("href"), F.col("text").alias("label"),
    )
    return kept.unionByName(new.withColumn("nth", F.col("nth").cast("int")))
