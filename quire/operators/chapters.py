"""Chapters of books: scan, classification, selection and the summary of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from .links import book

#: Rows of one group that a task ranks at most; the blocks of a group are put in order by their counts.
BLOCK = 4096
MIN_WORDS, EXCERPT_WORDS = 200, 120


def ranked(rows: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """``rows`` with each row's place in its group, from 0, by the whole number ``order`` (unique in the group; groups aren't null).

    A large group is ranked in blocks of BLOCK consecutive numbers, whose row counts are summed up, so no task gets a whole group.
    """
    rows = rows.withColumn("_block", F.coalesce(F.floor(F.col(order) / BLOCK), F.lit(-(1 << 60))))
    counts = rows.groupBy(group, "_block").count()
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, "_block").orderBy(order)
    place = F.col("_before") + F.row_number().over(inside) - 1
    return rows.join(starts, [group, "_block"]).withColumn(name, place).drop("_block", "_before")


def scan(pages: DataFrame) -> DataFrame:
    """(page_id, book, index, title, words): pages as the chapters of their host, in the order of page_id; a null one comes first.

    Pages without a readable address are the chapters of a book without a name.
    """
    rows = pages.select(
        "page_id",
        book().alias("book"),
        H.title(F.col("html")).alias("title"),
        T.word_count(H.page_text(F.col("html"))).alias("words"),
    )
    return ranked(rows, "book", "page_id", "index").select("page_id", "book", "index", "title", "words")


def classified(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, url, html, title, words, opening, is_contents, is_reference, is_matter, passthrough) and the columns to ``keep``; nothing is shuffled.

    ``opening`` is the first EXCERPT_WORDS words. All of it is made by a generator of one row: a filter by what is made stays above
    that, while one pushed below a projection would work out each text again.
    """
    html = F.col("html")

    def measured(words: Column) -> Column:
        return F.struct(F.array_size(words).alias("words"), F.array_join(F.slice(words, 1, EXCERPT_WORDS), " ").alias("opening"))

    def judged(m: Column) -> Column:
        title, words = m["title"], m["measures"]["words"]
        return F.struct(
            title.alias("title"),
            words.alias("words"),
            m["measures"]["opening"].alias("opening"),
            H.is_contents(html).alias("is_contents"),
            H.is_reference(html, title, m["firsts"]).alias("is_reference"),
            H.is_matter(m["body"], title, words, m["firsts"]).alias("is_matter"),
        )

    def made(body: Column) -> Column:
        measures = T.named(T.words(H.page_text(html)), measured)
        return T.named(F.struct(H.title(html).alias("title"), measures.alias("measures"), body.alias("body"), H.first_classes(body).alias("firsts")), judged)

    rows = pages.select("page_id", "url", "html", *keep, F.explode(F.array(T.named(H.body(html), made))).alias("made"))
    rows = rows.select("page_id", "url", "html", *keep, "made.*")
    return rows.withColumn("passthrough", F.col("is_contents") | F.col("is_reference") | F.col("is_matter"))


def selected(min_words: int = MIN_WORDS, skip: tuple[int, ...] = (), only: tuple[int, ...] | None = None, index: str = "page_id") -> Column:
    """Whether a classified chapter is to be rewritten."""
    wanted = ~F.col("passthrough") & (F.col("words") >= min_words)
    if skip:
        wanted &= ~F.col(index).isin(*skip)
    return wanted if only is None else wanted & F.col(index).isin(*only)


def results(rows: DataFrame) -> DataFrame:
    """(page_id, title, status, words_in) of classified chapters."""
    status = F.when(selected(), "eligible").otherwise("skipped")
    return rows.select("page_id", "title", status.alias("status"), F.col("words").alias("words_in"))


def summary(rows: DataFrame) -> DataFrame:
    """(status, chapters, words_in) of ``results``' rows."""
    return rows.groupBy("status").agg(F.count("*").alias("chapters"), F.sum("words_in").alias("words_in"))


def excerpts(rows: DataFrame) -> DataFrame:
    """(page_id, excerpt): a heading and the first EXCERPT_WORDS words of each selected chapter."""
    named = F.when(F.col("title") != "", F.col("title")).otherwise(F.col("url"))
    head = F.concat(F.lit("## Chapter "), F.col("page_id"), F.lit(": "), named, F.lit("\n("), F.col("words"), F.lit(" words) "))
    return rows.filter(selected()).select("page_id", F.concat(head, F.col("opening")).alias("excerpt"))


def missing_from_cache(rows: DataFrame, cache: DataFrame, source: str = "html") -> DataFrame:
    """The chapters whose text has no row in ``cache(source_sha)``; of rows with a ``source_sha`` no text is needed."""
    rows = rows if "source_sha" in rows.columns else rows.withColumn("source_sha", F.sha2(source, 256))
    return rows.join(cache.select("source_sha"), "source_sha", "left_anti")
