"""An edition of the pages against its source: what was lost, broken or left behind, as rows of findings.

A finding is (book, level, kind, place, detail). Both sides are reduced to narrow rows before they are joined by page, so no text
is shuffled; a book of any size is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import nodes as N
from ..functions import text as T
from ..sources.staged import staged
from . import links as L
from .chapters import BLOCK, ranked

#: How many examples a finding names.
SPINE_SHOWN, CLASSES_SHOWN, IDS_SHOWN, LINKS_SHOWN, ENTRIES_SHOWN, LOST_SHOWN, REPORTED = 5, 12, 8, 5, 20, 6, 5
HEADS = "<h([1-6])(?:\\s[^>]*)?>"


def finding(level: str | Column, kind: str | Column, detail: Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(level).alias("level"), lit(kind).alias("kind"), detail.alias("detail"))


def first_of(rows: DataFrame, by: str | list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each group: of blocks of pages first, then of what is left, so no task orders a group."""
    by = [by] if isinstance(by, str) else by
    rows = rows.withColumn("_block", F.floor(F.col("page_id") / BLOCK))
    near, all_ = (Window.partitionBy(*by, *extra).orderBy(*order) for extra in (["_block"], []))
    rows = rows.withColumn("_nth", F.row_number().over(near)).filter(F.col("_nth") <= most)
    return rows.withColumn("_nth", F.row_number().over(all_)).filter(F.col("_nth") <= most).drop("_block")


def listed(value: str, most: int) -> Column:
    """The values of ``first_of``'s rows, in order, as one text."""
    return F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("_nth", value))), 1, most), lambda x: x[value]), ", ")


def spine(source: DataFrame, output: DataFrame) -> DataFrame:
    """A finding for each book whose documents or their order (``ord``) changed.

    Two books are in the same order if each document has the same place, so places are joined and no list is gathered.
    """

    def placed(pages: DataFrame, name: str) -> DataFrame:
        rows = pages.select("page_id", "ord", L.book().alias("book"))
        return ranked(rows, "book", "ord", name).select("page_id", "book", name)

    both = placed(source, "was").join(placed(output, "now"), ["page_id", "book"], "full")
    both = both.filter(F.col("was").isNull() | F.col("now").isNull() | (F.col("was") != F.col("now")))
    both = both.withColumn("change", F.when(F.col("now").isNull(), "lost").when(F.col("was").isNull(), "added").otherwise("moved"))
    counts = both.groupBy("book").agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("lost", "added")))
    shown = first_of(both.filter("change <> 'moved'"), ["book", "change"], ["was", "now"], SPINE_SHOWN)
    shown = shown.withColumn("id", F.col("page_id").cast("string")).groupBy("book", "change").agg(listed("id", SPINE_SHOWN).alias("ids"))
    shown = shown.groupBy("book").agg(*(F.max(F.when(F.col("change") == c, F.col("ids"))).alias(f"{c}_ids") for c in ("lost", "added")))
    named = lambda c: F.coalesce(F.col(f"{c}_ids"), F.lit(""))
    detail = F.when(F.col("lost") + F.col("added") > 0, F.concat(F.lit("lost ["), named("lost"), F.lit("], added ["), named("added"), F.lit("]"))).otherwise(
        "same documents, different order"
    )
    rows = counts.join(shown, "book", "left")
    return rows.select("book", F.lit("problem").alias("level"), F.lit("spine changed").alias("kind"), F.lit("package").alias("place"), detail.alias("detail"))


def resources(pages: DataFrame) -> DataFrame:
    """(book, path) of an edition's pages, images and stylesheets."""
    used = L.targets(pages).filter("kind <> 'a'").select("book", F.col("target").alias("path"))
    return L.addressed(pages).unionByName(used).distinct()


def resources_lost(source: DataFrame, output: DataFrame) -> DataFrame:
    gone = resources(source).join(resources(output), ["book", "path"], "left_anti")
    detail = F.lit("in the source manifest, missing from the output")
    return gone.select("book", F.lit("problem").alias("level"), F.lit("resource lost").alias("kind"), F.col("path").alias("place"), detail.alias("detail"))


def features(pages: DataFrame) -> DataFrame:
    """What the comparison needs of a page: some short arrays, counts and digests. A reduced edition has them."""
    if "wrappers" in pages.columns:
        return pages
    html = F.col("html")
    rest = [c for c in pages.columns if c not in ("page_id", "html", "ids")]
    # The prose is worked out before what is read from it, so that each isn't one expression with it.
    named = (L.book().alias("book"), L.normal(L.path()).alias("path"), H.prose(html).alias("prose"), H.content_tags(html).alias("content"), L.given(pages, "ids", H.found(html, H.IDS)).alias("ids"))
    rows = pages.select("page_id", *rest, "html", *named, N.outline(html).alias("outline"))
    rows = rows.withColumn("marked", F.regexp_extract_all("prose", F.lit(f"(?md){T.RESIDUE}"), F.lit(0)))
    sheets = F.transform(H.stylesheets(html), lambda h: L.resolved(F.col("path"), h))
    return rows.select(
        "page_id", *rest, "book", "path", "ids",
        F.array_sort(F.array_distinct(sheets)).alias("sheets"),
        H.body_attributes(html).alias("attributes"),
        F.sha2("prose", 256).alias("prose"),
        F.regexp_extract("prose", "⟦[^⟧\\n]{0,40}", 0).alias("token"),
        F.array_size("marked").alias("marks"),
        F.when(F.array_size("marked") == 0, "").otherwise(F.get("marked", F.lit(0))).alias("mark"),
        H.classes(html).alias("classes"),
        F.coalesce(N.named_wrappers(F.col("outline.wrappers")), F.array().cast("array<string>")).alias("wrappers"),
        N.jumps(F.col("outline.levels")).alias("jumps"),
        H.repeated(F.col("ids")).alias("repeated"),
        H.ill_formed(html).alias("broken"),
        H.is_contents(html).alias("is_nav"),
        *(F.array_size(F.filter("content", lambda x: x == t)).alias(f"n_{t}") for t in H.CONTENT),
    )


def reduced(pages: DataFrame) -> DataFrame:
    """An edition without its texts, in one pass over them: (page_id, url, ord), ``features``, references, identifiers, styles and entries of navigation."""
    html = F.col("html")
    more = {"references": L.references(), "ids": H.found(html, H.IDS), "styles": H.style_classes(html), "entries": nav_entries()}
    return features(pages.select("page_id", "url", "ord", "html", *(c.alias(n) for n, c in more.items())))


def rewritten_pages(source: DataFrame, output: DataFrame) -> DataFrame:
    """(page_id) of the pages whose prose differs."""
    made = [p.select("page_id", L.given(p, "prose", F.sha2(H.prose(F.col("html")), 256)).alias(n)) for p, n in ((source, "was"), (output, "now"))]
    return made[0].join(made[1], "page_id").filter("was <> now").select("page_id")


def pages_changed(source: DataFrame, output: DataFrame, rewritten: DataFrame | None = None) -> DataFrame:
    """Findings of each page of the output.

    A page that can't be read as XML is told if the source's could or there was none; all else is told of pages that both
    editions have. ``rewritten(page_id)`` names the pages that were rewritten, others are expected unchanged, but for
    navigation; without it those whose prose differs count as rewritten. A null page_id is a page like others.
    """
    was, now = (features(p).alias(n) for p, n in ((source, "s"), (output, "o")))
    both = now.join(was.withColumn("there", F.lit(True)).alias("s"), F.col("s.page_id").eqNullSafe(F.col("o.page_id")), "left")
    both = both.withColumn("there", F.coalesce("there", F.lit(False)))
    if rewritten is None:
        both = both.withColumn("rewritten", F.col("there") & (F.col("s.prose") != F.col("o.prose")))
    else:
        named = rewritten.select(F.col("page_id").alias("r")).distinct().withColumn("rewritten", F.lit(True))
        both = both.join(named, F.col("o.page_id").eqNullSafe(F.col("r")), "left").withColumn("rewritten", F.col("there") & F.coalesce("rewritten", F.lit(False)))
    styles = output.select(L.book().alias("book"), F.explode(L.given(output, "styles", H.style_classes(F.col("html")))).alias("class")).distinct()
    styles = styles.groupBy("book").agg(F.array_sort(F.collect_set("class")).alias("styled"))
    both = both.join(styles.select(F.col("book").alias("b"), "styled"), F.col("o.book") == F.col("b"), "left")

    def change(a: Column, b: Column) -> Column:
        return F.concat(a.cast("string"), F.lit(" -> "), b.cast("string"))

    sheets = F.array_except("s.sheets", "o.sheets")
    kept = F.coalesce("styled", F.array().cast("array<string>"))
    class_of = lambda w: F.slice(F.split(w, r"\."), 2, F.size(F.split(w, r"\.")))
    unwrapped = F.filter(F.array_except("s.wrappers", "o.wrappers"), lambda w: F.arrays_overlap(class_of(w), kept))
    gone = F.array_sort(F.array_except(F.array_intersect(F.array_except("s.classes", "o.classes"), kept), F.flatten(F.transform(unwrapped, class_of))))
    more = F.when(F.size(gone) > CLASSES_SHOWN, " …").otherwise("")
    stray = F.col("o.marks") - F.col("s.marks")
    every = [
        F.when(F.col("o.broken") & ~F.coalesce("s.broken", F.lit(False)), finding("problem", "not well-formed XHTML", F.lit("can't be read as XML"))),
        F.when(F.size(sheets) > 0, finding("problem", "stylesheet link lost", F.array_join(sheets, ", "))),
        F.when(
            F.col("s.attributes") != F.col("o.attributes"),
            finding("warning", "body attributes changed", F.concat(F.array_join("s.attributes", " "), F.lit(" -> "), F.array_join("o.attributes", " "))),
        ),
        F.when(F.col("there") & ~F.col("rewritten") & ~F.col("o.is_nav") & (F.col("s.prose") != F.col("o.prose")), finding("warning", "untouched document changed", F.lit("text differs from the source"))),
    ]
    inside = [
        F.when(F.size(unwrapped) > 0, finding("problem", "styled wrapper lost", F.array_join(unwrapped, ", "))),
        F.when(F.size(gone) > 0, finding("warning", "styled classes lost", F.concat(F.array_join(F.slice(gone, 1, CLASSES_SHOWN), ", "), more))),
        *(
            F.when(
                F.col(f"o.n_{t}") < F.col(f"s.n_{t}"),
                finding("problem" if t in H.PROTECTED else "warning", f"fewer <{t}>", change(F.col(f"s.n_{t}"), F.col(f"o.n_{t}"))),
            )
            for t in H.CONTENT
        ),
        F.when(F.col("o.token") != "", finding("problem", "token left in text", F.col("o.token"))),
        F.when(stray > 0, finding("warning", "markdown left in text", F.concat(stray.cast("string"), F.lit(" marker(s), e.g. "), F.col("o.mark")))),
        F.when(F.col("o.jumps") > F.col("s.jumps"), finding("warning", "heading levels skip", F.concat(change(F.col("s.jumps"), F.col("o.jumps")), F.lit(" jumps")))),
        F.when(F.size("o.repeated") > 0, finding("problem", "duplicate ids", F.array_join(F.slice("o.repeated", 1, IDS_SHOWN), ", "))),
    ]
    made = F.array_compact(F.array(*every, *(F.when(F.col("rewritten"), x) for x in inside)))
    rows = both.select(F.col("o.book").alias("book"), F.col("o.page_id").alias("page_id"), F.col("o.path").alias("place"), F.explode(made).alias("f"))
    return rows.select("page_id", "book", "f.level", "f.kind", "place", "f.detail")


def links_broken(source: DataFrame, output: DataFrame) -> DataFrame:
    """A finding for each output page with links that lead nowhere, but for those that did so in the source."""
    known = L.checked(source).groupBy("page_id", "ref").agg(F.max("resolves").alias("held"))
    rows = L.checked(output).filter("not resolves").join(known, ["page_id", "ref"], "left").filter("held is null or held")
    rank = F.element_at(F.create_map(*(F.lit(x) for pair in (("a", 0), ("img", 1), ("link", 2)) for x in pair)), F.col("kind"))
    order = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "pos", "ref")))
    rows = rows.groupBy("page_id", "book").agg(F.count("*").alias("n"), order.alias("refs"))
    named = F.array_join(F.transform(F.slice("refs", 1, LINKS_SHOWN), lambda x: x["ref"]), ", ")
    return rows.select(
        "page_id", "book", F.lit("problem").alias("level"), F.lit("links broken").alias("kind"), F.concat(F.col("n").cast("string"), F.lit(": "), named).alias("detail")
    )


def nav_entries() -> Column:
    """(pos, ref, label) of the links in a page's navigation."""

    def parted(a: Column, i: Column) -> Column:
        label = T.flat(H.unescape(F.regexp_replace(a, H.TAG, " ")))
        return F.struct(i.alias("pos"), H.unescape(F.regexp_extract(a, H.HREF, 1)).alias("ref"), label.alias("label"))

    inside = F.array_join(H.found(F.col("html"), H.NAV), "\n")
    return F.transform(F.filter(H.found(inside, H.NAV_LINK), lambda a: a.rlike(H.HREF)), parted)


def entries(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, ref, label) of the links in pages' navigation."""
    rows = pages.select("page_id", "url", F.explode(L.given(pages, "entries", nav_entries())).alias("e"))
    return rows.select("page_id", "url", "e.*").filter(~F.col("ref").rlike(H.EXTERNAL))


def entries_unresolved(output: DataFrame) -> DataFrame:
    """The first ENTRIES_SHOWN entries of each book's navigation that lead nowhere."""
    rows = L.resolving(L.placed(entries(output)), output).filter("not resolves")
    rows = first_of(rows, "book", ["page_id", "pos"], ENTRIES_SHOWN)
    place = F.when(F.col("label") != "", F.col("label")).otherwise(F.col("ref"))
    return rows.select("book", F.lit("problem").alias("level"), F.lit("nav entry unresolved").alias("kind"), place.alias("place"), F.col("ref").alias("detail"))


def entries_lost(source: DataFrame, output: DataFrame, rewritten: DataFrame | None = None) -> DataFrame:
    """A finding for each book whose navigation lost entries that resolved and lead to pages that weren't rewritten."""
    rewritten = rewritten_pages(source, output) if rewritten is None else rewritten
    spared = output.join(rewritten.select("page_id").distinct(), "page_id", "left_semi").select(L.book().alias("book"), L.normal(L.path()).alias("target")).distinct()
    was = L.resolving(L.placed(entries(source)), source).filter("resolves")
    now = L.placed(entries(output)).select("book", "target", "fragment", "label").distinct()
    gone = was.join(spared, ["book", "target"], "left_anti").join(now, ["book", "target", "fragment", "label"], "left_anti")
    named = F.when(F.col("label") != "", F.col("label")).otherwise(F.concat("target", F.lit("#"), "fragment"))
    counts = was.groupBy("book").agg(F.count("*").alias("all")).join(gone.groupBy("book").agg(F.count("*").alias("n")), "book")
    shown = first_of(gone.withColumn("name", named), "book", ["page_id", "pos"], LOST_SHOWN)
    shown = shown.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "name"))), lambda x: x["name"]), "; ").alias("names"))
    detail = F.concat(F.col("n").cast("string"), F.lit(" of "), F.col("all").cast("string"), F.lit(" (outside rewritten chapters): "), F.col("names"))
    rows = counts.join(shown, "book")
    return rows.select("book", F.lit("problem").alias("level"), F.lit("nav entries lost").alias("kind"), F.lit("navigation").alias("place"), detail.alias("detail"))


def verify(source: DataFrame, output: DataFrame, rewritten: DataFrame | None = None) -> DataFrame:
    """All findings: (book, level, kind, place, detail).

    Each edition is read once and reduced to a narrow staged table; all rules work on the two.
    """
    source, output = staged(reduced(source), "source"), staged(reduced(output), "output")
    where = output.select("page_id", L.normal(L.path()).alias("place"))
    parts = [
        spine(source, output),
        resources_lost(source, output),
        pages_changed(source, output, rewritten).drop("page_id"),
        links_broken(source, output).join(where, "page_id").drop("page_id"),
        entries_unresolved(output),
        entries_lost(source, output, rewritten),
    ]
    made = parts[0]
    for part in parts[1:]:
        made = made.unionByName(part)
    return made


def summary(findings: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(book, problems, warnings, said, failed): a line for each book, and whether it fails; with the ``pages`` of an edition also for its books without findings."""
    if pages is not None:
        none = pages.select(L.book().alias("book")).distinct().select("book", *(F.lit(None).cast("string").alias(c) for c in ("level", "kind", "place", "detail")))
        findings = findings.unionByName(none)
    counts = findings.groupBy("book").agg(*(F.count_if(F.col("level") == x).alias(f"{x}s") for x in ("problem", "warning")))
    said = lambda x: F.concat(F.col(f"{x}s").cast("string"), F.lit(f" {x}"), F.when(F.col(f"{x}s") == 1, "").otherwise("s"))
    return counts.select("book", "problems", "warnings", F.concat(said("problem"), F.lit(", "), said("warning")).alias("said"), (F.col("problems") > 0).alias("failed"))


def report(findings: DataFrame) -> DataFrame:
    """(book, nth, line): the first REPORTED findings of each book, problems first, and how many more there are."""
    order = ["rank", "kind", "place", "detail"]
    rows = findings.withColumn("rank", (F.col("level") != "problem").cast("int"))
    line = F.concat("level", F.lit(": "), "kind", F.lit(" in "), "place", F.lit(": "), "detail")
    rows = rows.withColumn("line", line).withColumn("_block", F.pmod(F.xxhash64("place", "detail"), F.lit(64)))
    near, all_ = (Window.partitionBy("book", *extra).orderBy(*order) for extra in (["_block"], []))
    shown = rows.withColumn("nth", F.row_number().over(near)).filter(F.col("nth") <= REPORTED)
    shown = shown.withColumn("nth", F.row_number().over(all_)).filter(F.col("nth") <= REPORTED).select("book", "nth", "line")
    more = findings.groupBy("book").agg(F.count("*").alias("n")).filter(F.col("n") > REPORTED)
    more = more.select("book", F.lit(REPORTED + 1).alias("nth"), F.concat(F.lit("… "), (F.col("n") - REPORTED).cast("string"), F.lit(" more")).alias("line"))
    return shown.unionByName(more)
