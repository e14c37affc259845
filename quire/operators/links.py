"""Links, identifiers and tags of pages, and the integrity queries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H


def decoded(path: Column) -> Column:
    """Percent signs resolved; a plus sign stays, and so does what can't be decoded."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def normal(path: Column) -> Column:
    """A path without empty, ``.`` and ``..`` segments; it starts with a slash."""
    none = F.array().cast("array<string>")
    parts = F.aggregate(
        F.split(path, "/"),
        none,
        lambda done, x: F.when(x.isin("", "."), done)
        .when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(x))),
    )
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def resolved(page_path: Column, ref: Column) -> Column:
    """The path that an internal reference leads to from a page."""
    path = decoded(F.regexp_replace(ref, "[?#].*", ""))
    folder = F.regexp_replace(page_path, "[^/]*$", "")
    full = F.when(path == "", page_path).when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    return normal(full)


def fragment(ref: Column) -> Column:
    return decoded(F.regexp_extract(ref, "#(.*)", 1))


def given(pages: DataFrame, name: str, made: Column) -> Column:
    """A column of ``pages``, or what it would be made of: an edition that was reduced has no text any more."""
    return F.col(name) if name in pages.columns else made


def references() -> Column:
    """(kind, pos, ref) of a page's anchors, images and link elements."""
    html = F.col("html")

    def named(kind: str):
        return lambda ref, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), H.unescape(ref).alias("ref"))

    return F.concat(*(F.transform(H.found(html, pattern), named(kind)) for kind, pattern in H.LINKS.items()))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, kind, pos, ref): internal references of anchors, images and link elements; nothing is shuffled."""
    rows = pages.select("page_id", "url", F.explode(given(pages, "references", references())).alias("l")).select("page_id", "url", "l.*")
    return rows.filter(~F.col("ref").rlike(H.EXTERNAL))


def book() -> Column:
    """The host of ``url``; empty for a page without a readable address, so that such pages are a book of their own."""
    return F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))


def path() -> Column:
    return F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))


def addressed(pages: DataFrame) -> DataFrame:
    """(book, path) of the pages that there are."""
    return pages.select(book().alias("book"), normal(path()).alias("path")).distinct()


def identified(pages: DataFrame) -> DataFrame:
    """(book, path, id) of the identifiers that there are."""
    rows = pages.select(book().alias("book"), normal(path()).alias("path"), F.explode(given(pages, "ids", H.found(F.col("html"), H.IDS))).alias("id"))
    return rows.distinct()


def placed(rows: DataFrame) -> DataFrame:
    """``rows(url, ref, ...)`` with the book, path and fragment that the reference leads to, and without the address."""
    made = rows.withColumn("book", book()).withColumn("target", resolved(F.when(path() == "", "/").otherwise(path()), F.col("ref")))
    return made.withColumn("fragment", fragment(F.col("ref"))).drop("url")


def targets(pages: DataFrame) -> DataFrame:
    """(page_id, book, kind, pos, ref, target, fragment): the links with the paths and identifiers that they lead to."""
    return placed(extracted(pages)).select("page_id", "book", "kind", "pos", "ref", "target", "fragment")


def resolving(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """``rows`` of ``placed`` with ``resolves``: there is such a page and, where a fragment is given, it has such an identifier.

    References of one book meet its pages and identifiers by book, path and identifier, so a large book is spread.
    """
    there = addressed(pages).select("book", F.col("path").alias("target"), F.lit(True).alias("there"))
    named = identified(pages).select("book", F.col("path").alias("target"), F.col("id").alias("fragment"), F.lit(True).alias("named"))
    rows = rows.join(there, ["book", "target"], "left").join(named, ["book", "target", "fragment"], "left")
    found = F.col("there").isNotNull() & ((F.col("fragment") == "") | F.col("named").isNotNull())
    return rows.withColumn("resolves", found).drop("there", "named")


def checked(pages: DataFrame) -> DataFrame:
    """(page_id, book, kind, pos, ref, target, fragment, resolves) of all internal links."""
    return resolving(targets(pages), pages).select("page_id", "book", "kind", "pos", "ref", "target", "fragment", "resolves")


def referenced(pages: DataFrame) -> DataFrame:
    """(book, path, id) of the identifiers that some link leads to: the anchors that a rewrite must keep."""
    wanted = targets(pages).filter("fragment <> ''").select("book", F.col("target").alias("path"), F.col("fragment").alias("id")).distinct()
    return identified(pages).join(wanted, ["book", "path", "id"], "left_semi")


def stylesheets(pages: DataFrame) -> DataFrame:
    """(page_id, pos, sheet): the paths of the stylesheets that a page links to, in order and each once."""
    sheets = F.transform(H.stylesheets(F.col("html")), lambda ref: resolved(F.when(path() == "", "/").otherwise(path()), ref))
    return pages.select("page_id", F.posexplode(F.array_sort(F.array_distinct(sheets))).alias("pos", "sheet"))


def lost(source: DataFrame, output: DataFrame) -> DataFrame:
    """(book, target) that links of ``source`` lead to and no link of ``output`` does."""
    return targets(source).select("book", "target").distinct().join(targets(output).select("book", "target").distinct(), ["book", "target"], "left_anti")


def tag_counts(pages: DataFrame) -> DataFrame:
    """(page_id, tag, n) of start tags."""
    rows = pages.select("page_id", F.explode(H.found(H.visible(F.col("html")), H.START_TAG)).alias("tag"))
    return rows.groupBy("page_id", F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))


def fewer_tags(source: DataFrame, output: DataFrame) -> DataFrame:
    """(page_id, tag, before, after) where an output page has fewer of a tag."""
    before, after = tag_counts(source).withColumnRenamed("n", "before"), tag_counts(output).withColumnRenamed("n", "after")
    rows = before.join(after, ["page_id", "tag"], "left").withColumn("after", F.coalesce("after", F.lit(0)))
    return rows.filter("after < before")


def duplicate_ids(pages: DataFrame) -> DataFrame:
    """(page_id, id, n) of identifiers that a page has twice or more."""
    rows = pages.select("page_id", F.explode(H.found(F.col("html"), H.IDS)).alias("id"))
    return rows.groupBy("page_id", "id").agg(F.count("*").alias("n")).filter("n > 1")


def css_classes(sheets: DataFrame, text_col: str = "text") -> DataFrame:
    """(class) that stylesheets name."""
    return sheets.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(H.CSS_CLASS), F.lit(1))).alias("class")).distinct()
