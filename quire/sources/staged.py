"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def staged(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet below ``spark.checkpoint.dir`` and read back; what is read many times is worked out once.

    Where that is unset a local session gets a temporary folder; on a cluster, whose executors would each write to their
    own disk, it is an error.
    """
    spark = rows.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        root = tempfile.mkdtemp(prefix="quire-")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
