"""What the operators of this package share: shared folders, staged tables, batches of text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch holds at most: long texts stay within a worker's memory.
BATCH_ROWS = 512


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, which ``spark.checkpoint.dir`` names.

    Where that is unset, a local session gets a temporary folder; on a cluster, whose executors would each write to
    their own disk, it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        root = tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write the rows as Parquet in the shared folder and read them back."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to BATCH_ROWS rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sampled_ids(rows: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """``most`` distinct ids of ``rows`` at most, the first by their hashes; few more than that are ever sorted."""
    ids = rows.select(F.col(id_col).alias("id")).filter("id is not null").distinct()
    wide = 1 << 40
    share = min(1.0, 1.25 * most / max(1, rows.count()))
    near = ids.filter(F.pmod(F.xxhash64("id"), F.lit(wide)) < int(share * wide)) if share < 1 else ids
    return near.orderBy(F.pmod(F.xxhash64("id"), F.lit(wide)), "id").limit(most)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """SHA-256 of a row's id and text: rows with one key are repeated rows."""
    named = F.coalesce(F.col(id_col).cast("string"), F.lit("-"))
    return F.sha2(F.concat(named, F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))), 256)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of name_1, name_2, ... that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{k}" for k in range(1, len(taken) + 2))) if n not in taken)


def let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once for each row however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def gathered(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.Table]:
    """Consecutive batches joined until their ``column`` holds ``most_bytes``, so that a dictionary serves many rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= most_bytes:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
