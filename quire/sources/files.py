"""Pages, stylesheets and chapters from folders of files, and records of a run back to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _text(content: Column) -> Column:
    """UTF-8 text; what isn't UTF-8 becomes replacement signs."""
    return F.make_valid_utf8(content.cast("string"))


def _files(spark: SparkSession, folder: str, names: str) -> DataFrame:
    """(path, text) of the files below a folder; path is relative to it. A folder without such files gives no row."""
    root = folder.rstrip("/") + "/"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(folder)
    full = F.regexp_replace("path", "^[a-z]+:/*", "/")
    plain = F.regexp_replace(F.lit(root), "^[a-z]+:/*", "/")
    return rows.select(F.substring(full, F.length(plain) + 1, F.length(full)).alias("path"), _text(F.col("content")).alias("text"))


def pages(spark: SparkSession, folder: str, book: str) -> DataFrame:
    """(page_id, url, html) of the HTML files below a folder, as pages of one book; page_id is the place of the path among all, from 0.

    Paths are put in order by ranges of them, without their texts; each range is numbered after those before it.
    """
    rows = _files(spark, folder, "*.{html,xhtml,htm}")
    ranged = rows.select("path").repartitionByRange("path").withColumn("part", F.spark_partition_id()).persist()  # both uses see the same ranges
    counts = ranged.groupBy("part").count()
    before = counts.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("path"))
    placed = ranged.withColumn("nth", nth).join(F.broadcast(before), "part").select("path", (F.col("before") + F.col("nth") - 1).alias("page_id"))
    return rows.join(placed, "path").select("page_id", F.concat(F.lit(f"file://{book}/"), "path").alias("url"), F.col("text").alias("html"))


def stylesheets(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the stylesheets below a folder."""
    return _files(spark, folder, "*.css")


def chapters(spark: SparkSession, folder: str) -> DataFrame:
    """(index, text) of the Markdown files of a folder that are named by their number, as a run leaves them."""
    rows = _files(spark, folder, "*.md").withColumn("index", F.regexp_extract("path", r"(?:^|/)([0-9]+)\.md$", 1))
    return rows.filter("index <> ''").select(F.col("index").cast("int").alias("index"), "text")


def write_records(rows: DataFrame, folder: str, by: str | None = None) -> None:
    """A run's records as JSON lines, in a folder for each value of ``by``; a run replaces the folders of its own values and leaves others."""
    writer = rows.write.mode("overwrite").option("ignoreNullFields", "false").option("partitionOverwriteMode", "dynamic" if by else "static")
    (writer.partitionBy(by) if by else writer).json(folder)


def records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The records that runs left in a folder."""
    return spark.read.schema(schema).json(folder)
