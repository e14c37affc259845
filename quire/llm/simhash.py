"""SimHash near-duplicates, found by deletion-variant signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, row_key, small_batches, stage
from .components import components

#: Words to a shingle and the most bits in which linked fingerprints differ.
SHINGLE_WORDS, MOST_BITS = 3, 3
#: A signature that more fingerprints share is split by a second level of variants.
BUCKET = 256


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit fingerprint of one text; zero for a null text or one without words."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    hash_ = xxhash.xxh64_intdigest
    hashes = np.array(
        [hash_(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[len(parts) - n :].tolist(), strict=True)],
        dtype="<u8",
    )
    total = np.zeros(64, np.int64)
    for k in range(0, n, 4096):
        block = hashes[k : k + 4096].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, key) for each row; fp holds the 64 bits as a signed long, key is ``row_key``."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            made = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64()), batch.column(2)], ["doc_id", "fp", "key"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key")).mapInArrow(
        run, "doc_id long, fp long, key string"
    )


def _half(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 32 * k).bitwiseAND(F.lit(0xFFFFFFFF))


def _variants(value: Column, bits: int, tag: int) -> Column:
    """For each bit of a segment: the segment without it, the bit's place and the segment's number, as one long."""
    one = F.lit(1).cast("long")
    return F.transform(
        F.sequence(F.lit(0), F.lit(bits - 1)),
        lambda i: F.struct(
            (value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", one, i))) * 256 + tag * 64 + i).alias("k"),
            i.alias("bit"),
        ),
    )


def links(fps: DataFrame) -> DataFrame:
    """(a, b), a < b, for each two distinct fingerprints of ``fps(fp)`` that differ in at most three bits.

    Three bits over two 32-bit segments leave one segment with at most one differing bit, so such a
    pair shares that segment with the bit's place left out. Each fingerprint is indexed under its 64
    one-wildcard variants; equal keys are joined and the whole distance is verified. A key that more
    than BUCKET fingerprints share (known from the counts of whole segments) is split further: its
    members are keyed again by the variants of the other segment's two 16-bit halves, of which one
    again differs in at most one bit. Nothing is capped.
    """
    fp = F.col("fp")
    one = stage(
        fps.select(fp, F.explode(F.array(*(F.struct(F.lit(k).alias("seg"), _half(fp, k).alias("part")) for k in (0, 1)))).alias("s")).select("fp", "s.seg", "s.part"),
        "segments",
    )

    def keyed(rows: DataFrame) -> DataFrame:
        kinds = [F.when(F.col("seg") == k, _variants(F.col("part"), 32, k)) for k in (0, 1)]
        return rows.select("*", F.explode(F.coalesce(*kinds)).alias("v")).select("*", "v.k", "v.bit").drop("v")

    # A key with more than BUCKET members holds a whole segment value with more than BUCKET / 2.
    crowded = stage(keyed(one.groupBy("seg", "part").count().filter(F.col("count") > BUCKET // 2)).select("k").distinct(), "crowded")
    rows = keyed(one)
    if crowded.isEmpty():
        rows = rows.withColumn("sub", F.lit(-1).cast("long")).withColumn("sub_bit", F.lit(0))
    else:
        other = F.when(F.col("seg") == 0, _half(fp, 1)).otherwise(_half(fp, 0))
        halves = (other.bitwiseAND(F.lit(0xFFFF)), F.shiftright(other, 16))
        subs = F.concat(*(_variants(h, 16, k) for k, h in enumerate(halves)))
        none = F.array(F.struct(F.lit(-1).cast("long").alias("k"), F.lit(0).alias("bit")))
        flagged = rows.join(crowded.withColumn("hot", F.lit(True)), "k", "left")
        rows = flagged.select("*", F.explode(F.when(F.col("hot"), subs).otherwise(none)).alias("w")).select(
            "fp", "k", "bit", "part", F.col("w.k").alias("sub"), F.col("w.bit").alias("sub_bit")
        )
    rows = rows.select("fp", "k", "sub")
    # Spark sizes the rows by the table before it was multiplied, and would broadcast them; both sides are shuffled whatever their size.
    a, b = rows.alias("a"), rows.hint("shuffle_merge").alias("b")
    close = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MOST_BITS
    pairs = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.sub") == F.col("b.sub")) & (F.col("a.fp") < F.col("b.fp")) & close)
    return pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id, root, key) for each row of ``docs``; root names the component, key the row (``row_key``).

    Letters A-Z are lower-cased, words are runs without ASCII white space, shingles are three words
    (the whole sequence where there are fewer). A null or empty text has fingerprint zero, which is
    linked like any other. Repeated rows each get a row; a null doc_id takes part in linking, but
    component_id is the smallest doc_id that is not null (null if there is none). Only the two named
    columns are read, so other columns may have any name.
    """
    rows = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "classes")
    roots = components(links(classes.select("fp")))
    roots = stage(roots.select(F.col("node").alias("fp"), "root"), "roots")
    linked = stage(classes.join(roots, "fp"), "linked")
    least = stage(linked.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    of_linked = linked.join(least, "root").select("fp", "component_id", "root")
    alone = classes.join(roots, "fp", "left_anti").select("fp", F.col("least_id").alias("component_id"), F.col("fp").alias("root"))
    known = stage(of_linked.unionByName(alone), "known")
    return rows.join(known, "fp", "left").select("doc_id", "fp", "component_id", "root", "key")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns of ``docs``: the smallest doc_id that is not null, then the least key.

    Rows are told apart by ``row_key``, not by doc_id, so null ids and an id with several texts stand for
    their own components only. Rows with one key are repeated rows and count once.
    """
    found = near_duplicates(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = stage(found.groupBy("root").agg(F.min("key").alias("row_key")), "keep").select("row_key")
    name = free_name(docs, "own_key")
    # Repeated rows go first, combined before they are shuffled; the join then finds the rows dealt by key.
    rows = docs.withColumn(name, row_key()).dropDuplicates([name])
    return rows.join(keep, F.col(name) == F.col("row_key"), "left_semi").drop(name)
