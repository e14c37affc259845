"""What became of chapters in a run: cached, rewritten, skipped or failed, the texts that it leaves, and the sums over a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import guards as G
from .chapters import MIN_WORDS

# The statuses whose words count.
WORKING = ("rewritten", "cached")


# Blocks that a rewrite must carry, but for titles, which are put back without their token.
BLOCK, TITLE = "⟦([A-Z]+-[0-9]+)", "TITLE-"
#: The texts that a run leaves of a chapter: the one in use, one that must not ship, and one that a forced run gave up.
OUTPUT, FAILED, STALE = "output", "failed", "stale"


def _judged(chapters: DataFrame, cache: DataFrame, rebuild: bool) -> DataFrame:
    """``chapters`` with their status, the text that stands for them and why they failed."""
    # Whole texts: Spark takes each for 20 bytes, and would broadcast a table that is larger by far.
    rows = chapters.join(cache.select("doc_id", "cached").hint("shuffle_merge"), "doc_id", "left")
    rows = rows.withColumn("kept", G.upgraded(F.col("source"), F.col("cached"))).withColumn("text", F.coalesce("body", F.lit("")))
    # The words of each text are counted once; a projection isn't put in place of a column that several expressions name.
    rows = rows.withColumns({f"n_{c}": T.word_count(F.col(c)) for c in ("source", "text", "kept")})
    problem = lambda c: G.body_problem(F.col("source"), F.col(c), T.share(F.col("n_source"), F.col(f"n_{c}")))
    rows = rows.withColumn("stale", F.when(F.col("kept").isNotNull(), problem("kept"))).withColumn("fresh", problem("text"))
    short = F.col("n_source") < MIN_WORDS
    usable = F.coalesce(F.col("stale") == "", F.lit(False))
    status = F.when(short, "skipped").when(usable, "cached").when(F.lit(rebuild) | (F.col("fresh") != ""), "failed").otherwise("rewritten")
    rows = rows.withColumn("status", status)
    out = F.when(F.col("status") == "cached", F.col("kept")).when(F.col("status") == "rewritten", F.col("body"))
    why = F.when(F.lit(rebuild), F.coalesce("stale", F.lit("no cached text"))).otherwise(F.col("fresh"))
    return rows.withColumn("out", out).withColumn("why", F.when(F.col("status") == "failed", why).otherwise(""))


def resumed(chapters: DataFrame, cache: DataFrame, rebuild: bool = False) -> DataFrame:
    """(doc_id, status, words_in, words_out, detail) of ``chapters(doc_id, source, body)`` with ``cache(doc_id, cached)``.

    A cached text, brought up to date, is used if nothing is wrong with it; an unusable one counts as none, and as a failure when only rebuilding.
    Without one the new text must pass; a chapter below MIN_WORDS is skipped. A null body is none.
    """
    n_out = F.when(F.col("status") == "cached", F.col("n_kept")).when((F.col("status") == "rewritten") & F.col("body").isNotNull(), F.col("n_text"))
    words_out = F.coalesce(n_out, F.lit(0)).alias("words_out")
    return _judged(chapters, cache, rebuild).select("doc_id", "status", F.col("n_source").alias("words_in"), words_out, F.col("why").alias("detail"))


def blocks_lost(source: Column, text: Column) -> Column:
    """The protected blocks of a source, as KIND-1, in order, whose token its text lacks."""
    kinds = F.array_distinct(F.filter(F.regexp_extract_all(source, F.lit(BLOCK), F.lit(1)), lambda x: ~x.startswith(TITLE)))
    return F.filter(kinds, lambda x: ~T.has_token(text, F.substring_index(x, "-", 1), F.substring_index(x, "-", -1)))


def evicted(chapters: DataFrame, left: DataFrame, force: bool = False, rebuild: bool = False) -> DataFrame:
    """(doc_id, kind, text) after a run over ``chapters(doc_id, source, body)``, from those that earlier runs ``left`` of the same books.

    A text that passed replaces the one in use. One that must not ship is put aside as failed, and the one in use stays;
    when forced, cached texts aren't looked at, and one whose chapter fails is put aside as stale. A text that lost a
    protected block is put aside as failed and leaves none in use. Rebuilding puts nothing aside and changes no text in
    use. What was put aside stays until another text takes its place; texts of chapters that the run doesn't have stay
    as they are. The latest rows are the whole state: write them over the books' own.
    """
    was = left.groupBy("doc_id").agg(*(F.max(F.when(F.col("kind") == k, F.col("text"))).alias(f"was_{k}") for k in (OUTPUT, FAILED, STALE)))
    cache = was.select("doc_id", F.when(F.lit(not force), F.col("was_output")).alias("cached"))
    rows = _judged(chapters.select("doc_id", "source", "body"), cache, rebuild).join(was, "doc_id", "full")
    rows = rows.withColumn("lost", F.coalesce(F.size(blocks_lost(F.col("source"), F.col("out"))) > 0, F.lit(False)))
    failed, passed = F.col("status") == "failed", F.col("out").isNotNull() & ~F.col("lost")
    aside = F.lit(force) & failed
    if rebuild:
        kinds = {k: F.col(f"was_{k}") for k in (OUTPUT, FAILED, STALE)}
    else:
        kinds = {
            OUTPUT: F.when(passed, F.col("out")).when(~(F.col("lost") | F.coalesce(aside, F.lit(False))), F.col("was_output")),
            FAILED: F.coalesce(F.when(F.col("lost"), F.col("out")).when(failed, F.col("body")), F.col("was_failed")),
            STALE: F.coalesce(F.when(aside, F.col("was_output")), F.col("was_stale")),
        }
    texts = F.array(*(F.struct(F.lit(k).alias("kind"), t.alias("text")) for k, t in kinds.items()))
    return rows.select("doc_id", F.explode(texts).alias("x")).select("doc_id", "x.kind", "x.text").filter(F.col("text").isNotNull())


def run_summary(results: DataFrame) -> DataFrame:
    """(status, chapters, words_in, words_out, ratio): a row for each status that occurs, and ``words`` for those that count."""
    kinds = F.array_compact(F.array(F.col("status"), F.when(F.col("status").isin(*WORKING), "words")))
    rows = results.select(F.explode(kinds).alias("status"), "words_in", "words_out")
    rows = rows.groupBy("status").agg(F.count("*").alias("chapters"), F.sum("words_in").alias("words_in"), F.sum("words_out").alias("words_out"))
    return rows.withColumn("ratio", T.percent(T.share(F.col("words_in"), F.col("words_out"))))
