"""Chapters and replies that arrive while a run goes on: classified and put together as they come, with running sums by status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chapters as C
from ..operators import replies as R


def statuses(pages: DataFrame) -> DataFrame:
    """(page_id, title, status, words_in) of a stream of pages (page_id, url, html); nothing is kept between batches."""
    return C.results(C.classified(pages))


def unseen(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """The selected chapters of a stream whose text isn't in ``cache(source_sha)``; the cache is what it was when the stream was started."""
    return C.missing_from_cache(C.classified(pages).filter(C.selected()), cache)


def running_summary(pages: DataFrame) -> DataFrame:
    """(status, chapters, words_in) so far: a state of two rows, whatever has come."""
    return C.summary(statuses(pages))


def arrivals_by_hour(pages: DataFrame, time_col: str, late: str = "1 hour") -> DataFrame:
    """(hour, status, chapters, words_in) of pages with an arrival time; hours that are older than ``late`` are closed and forgotten."""
    rows = C.classified(pages.withWatermark(time_col, late), keep=(time_col,))
    rows = rows.withColumn("status", F.when(C.selected(), "eligible").otherwise("skipped"))
    hours = rows.groupBy(F.window(time_col, "1 hour").alias("w"), "status").agg(F.count("*").alias("chapters"), F.sum("words").alias("words_in"))
    return hours.select(F.col("w.start").alias("hour"), "status", "chapters", "words_in")


def replies(events: DataFrame, time_col: str, quiet: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(reply_id, reply) of a stream of ``events(reply_id, seq, line)`` with an arrival time, told once when a reply has been quiet so long.

    What comes out of order is put in order; what comes more than ``late`` behind the newest is passed over. The state
    holds the events of open replies alone.
    """
    return R.gathered(events.withWatermark(time_col, late), F.session_window(time_col, quiet))


def write(rows: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Start to write a stream as Parquet, all that is there now; ``checkpoint`` lies in a shared folder, so a run that broke off goes on from there."""
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.format("parquet").start(folder)
