"""Token ids in files: frequency-ranked, byte-aligned, with the control bytes apart from the data."""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import spread, summed
from .common import gathered, shared_dir, small_batches, stage

#: Bytes of text whose distinct words are encoded together, and characters of words that a worker remembers.
ROUND_BYTES, REMEMBERED_CHARS = 4 << 20, 3 << 20
#: Ids to a partition of the sorted output, the most such partitions (beyond, each gets more and its sort spills), and ids to a file.
PART_IDS, MOST_PARTS, FILE_IDS = 8 << 20, 10_000, 4 << 20
#: Words put into one text for the library, and ids that are decoded at a time.
CHUNK_WORDS, BLOCK_IDS = 2000, 1 << 18

MAGIC = b"QTF2"
HEAD = "<4sIQQ"  # magic, documents, ids, ids of all files before
RANKS = "_ranks"  # the folder's file of ids by falling frequency, little-endian 32-bit
#: Words of these letters alone are one match of the splitting pattern in either case, whatever stands around them;
#: so is a run of these signs after them. None of them composes with another, so each may be lower-cased by itself.
LETTERS, SIGNS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
SIGN = f"[{re.escape(SIGNS)}]"
PLAIN, ENDED = f"^{LETTERS}$", f"^{LETTERS}{SIGN}+$"


class Words:
    """Ids of words by the tokenizers library; a word stands between ASCII white space, over which no token reaches."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.chars = 0
        self.ids, self.counts = np.empty(0, np.int32), np.empty(0, np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_new(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        held = pa.array(units, pa.large_string())
        plain = pc.match_substring_regex(held, f"{PLAIN}|^{SIGN}+$").to_numpy(zero_copy_only=False)
        texts = np.array(units, object)
        parts, of = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        some = np.flatnonzero(plain)
        for k in range(0, len(some), CHUNK_WORDS):
            chunk = some[k : k + CHUNK_WORDS]
            ids = self._ids([" ".join(texts[chunk])])[0]
            last = self.ends[ids]
            if last.sum() != len(chunk):
                raise ValueError("a plain word isn't one match of this tokenizer's pattern")
            parts.append(ids)
            of.append(chunk[np.cumsum(last) - last])
        rest = np.flatnonzero(~plain)
        for k in range(0, len(rest), CHUNK_WORDS):
            chunk = rest[k : k + CHUNK_WORDS]
            found = self._ids(texts[chunk].tolist())
            parts += found
            of.append(np.repeat(chunk, [len(x) for x in found]))
        ids, of = np.concatenate(parts), np.concatenate(of)
        return ids[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(units))

    def _places(self, units: list[str]) -> np.ndarray:
        """The places of distinct units among those remembered; new ones are encoded."""
        if self.chars > REMEMBERED_CHARS:
            self._forget()
        found = np.fromiter(map(self.places.get, units, itertools.repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [units[k] for k in missing.tolist()]
            ids, counts = self._encode_new(new)
            self.ids, self.counts = np.concatenate((self.ids, ids)), np.concatenate((self.counts, counts))
            found[missing] = np.arange(len(self.places), len(self.places) + len(new))
            self.places.update(zip(new, found[missing].tolist(), strict=True))
            self.chars += sum(map(len, new))
        return found

    def encode(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each has. A word of letters and signs is two units."""
        ended = pc.match_substring_regex(words, ENDED)
        lower = pc.utf8_lower(words)
        alike = pc.or_(ended, pc.match_substring_regex(words, PLAIN))
        heads = pc.if_else(alike, pc.if_else(ended, pc.utf8_rtrim(lower, SIGNS), lower), words)
        tails = pc.replace_substring_regex(words.filter(ended), f"^{LETTERS}", "")
        units = pa.concat_arrays([heads, tails]).dictionary_encode()
        places = self._places(units.dictionary.to_pylist())[units.indices.to_numpy()]
        two = ended.to_numpy(zero_copy_only=False)
        sizes = 1 + two.astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        chosen = np.empty(len(places), np.int64)
        chosen[starts] = places[: len(words)]
        chosen[starts[two] + 1] = places[len(words) :]
        ids, counts = spread(self.ids, self.counts, chosen)
        return ids, summed(counts, sizes)


@functools.lru_cache(maxsize=1)
def words_of(path: str) -> Words:
    return Words(path)


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n): little-endian unsigned 16-bit ids (32-bit ones for larger vocabularies), the end id last.

    What the tokenizer lists as an added token is one wherever it stands in a text, as the library has it.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        own = words_of(tokenizer_path)
        kind = "<u2" if max(len(own.ends), end_id + 1) <= 1 << 16 else "<u4"
        for rows in gathered(batches, "text", ROUND_BYTES):
            text = pc.fill_null(rows["text"].combine_chunks(), "")
            split = pc.ascii_split_whitespace(text)
            sizes = pc.list_value_length(split).to_numpy()
            coded = split.flatten().dictionary_encode()
            del split, text
            ids, counts = own.encode(coded.dictionary)
            ids, counts = spread(ids.astype(kind), counts, coded.indices.to_numpy())
            totals = summed(counts, sizes.astype(np.int64))
            ends = np.cumsum(totals)
            end = np.array([end_id], kind).tobytes()
            made = [ids[b - n : b].tobytes() + end for b, n in zip(ends.tolist(), totals.tolist(), strict=True)]
            for k in range(0, len(made), 256):
                arrays = [rows["doc_id"].slice(k, 256).combine_chunks(), pa.array(made[k : k + 256], pa.binary()), pa.array(totals[k : k + 256] + 1)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "n"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, ids binary, n long"
    )


def _kind(ids: bytes, n: int) -> str:
    return "<u2" if len(ids) == 2 * n else "<u4"


def ranked(rows: DataFrame) -> np.ndarray:
    """The ids of ``encoded`` rows by falling frequency (smaller ids first where equal); as long as the vocabulary, not the input."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            held = b"".join(batch.column("ids").to_pylist())
            more = np.bincount(np.frombuffer(held, _kind(held, sum(batch.column("n").to_pylist()))), minlength=len(total))
            more[: len(total)] += total
            total = more
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "count"])

    found = rows.select("ids", "n").mapInArrow(count, "id long, count long").groupBy("id").agg(F.sum("count").alias("count")).collect()
    return np.array([r["id"] for r in sorted(found, key=lambda r: (-r["count"], r["id"]))], np.uint32)


def blocks(counts: np.ndarray):
    """(first, last) of consecutive documents that hold about BLOCK_IDS ids, or a longer one alone."""
    nth = (np.cumsum(counts) - counts) // BLOCK_IDS
    edges = [0, *(np.flatnonzero(np.diff(nth)) + 1).tolist(), len(counts)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def slots_of(counts: np.ndarray) -> np.ndarray:
    """The place of each value among those of the control bytes: a document's values begin with a control byte of their own."""
    controls = -(-counts // 4)
    return np.repeat(4 * (np.cumsum(controls) - controls) - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def pack_all(values: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """For each document (of counts[k] values) its control bytes (two bits for each value: its bytes less one, the first value lowest) and its data bytes."""
    values = values.astype(np.uint32)
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    controls = -(-counts // 4)
    padded = np.zeros(4 * controls.sum(), np.uint8)
    padded[slots_of(counts)] = extra
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes()
    ends = np.cumsum(extra.astype(np.int64) + 1)
    data = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    starts = ends - extra - 1
    data[starts] = values & 0xFF
    for byte in (1, 2, 3):
        some = np.flatnonzero(extra >= byte)
        if not len(some):
            break
        data[starts[some] + byte] = (values[some] >> (8 * byte)) & 0xFF
    held = data.tobytes()
    control_ends, data_ends = np.cumsum(controls).tolist(), np.cumsum(summed(extra.astype(np.int64) + 1, counts)).tolist()
    return [control[a:b] + held[c:d] for a, b, c, d in zip([0, *control_ends], control_ends, [0, *data_ends], data_ends, strict=False)]


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """The control bytes and the data bytes of one document."""
    made = pack_all(values, np.array([len(values)]))[0]
    cut = -(-len(values) // 4)
    return made[:cut], made[cut:]


MANIFEST = ["part", "nth", "name", "n_docs", "n_ids", "start"]
#: For each control byte the lengths of its four values.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


def unpack(control: np.ndarray, data: np.ndarray, slots: np.ndarray | None = None) -> np.ndarray:
    """The values of control and data bytes; ``slots`` names the used places of the control bytes, all if None."""
    lengths = LENGTHS[control].ravel()
    if slots is not None:
        lengths = lengths[slots]
    starts = np.cumsum(lengths) - lengths
    values = data[starts].astype(np.uint32)
    for byte in (1, 2, 3):
        some = np.flatnonzero(lengths > byte)
        if not len(some):
            break
        values[some] |= data[starts[some] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return values


def open_folder(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system's scheme, as every executor resolves it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return re.sub("^file:/+", "file:///", full)


def bounds(rows: DataFrame, total: int) -> np.ndarray:
    """The doc_ids between the sorted output's parts, MOST_PARTS less one at most; a doc_id of many rows may stand several times."""
    parts = min(MOST_PARTS, max(1, -(-total // PART_IDS)))
    if parts == 1:
        return np.empty(0, np.int64)
    return np.array(sorted(int(x) for x in rows.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.1 / parts)), np.int64)


def placed(doc_ids: pa.Array, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The part of each row. A doc_id that is a bound several times is dealt over all the parts that it may stand in, by its row number."""
    at = pc.fill_null(doc_ids, np.iinfo(np.int64).min).to_numpy()
    first, last = np.searchsorted(bounds, at, "left"), np.searchsorted(bounds, at, "right")
    return (first + rows * 0x9E3779B1 % (1 << 31) % (last - first + 1)).astype(np.int32)


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Write ``encoded`` rows, staged with a ``row`` number, as files in ascending doc_id order (null ids first).

    The folder can be read by itself: it holds the files, the table of ids by rank (RANKS) and the manifest (part,
    nth, name, n_docs, n_ids, start), which is returned too. Parts hold consecutive ranges of doc_id, and a part's
    files follow one another. A file is head, doc_ids (64-bit), whether each is null (byte), id counts (32-bit), each
    document's control bytes, then all data bytes. The ids are replaced by their ranks. A file gets its name only
    when it is whole, and a part's rows are in one order (doc_id, row), so a task that runs again writes the same files.
    What is broadcast is the ranks, as long as the vocabulary, and MOST_PARTS bounds and starts at most.
    """
    spark = rows.sparkSession
    by_rank = ranked(rows)
    total = rows.agg(F.sum("n")).first()[0] or 0
    edges = bounds(rows, total)
    target = qualified(spark, folder)
    ranks = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    ranks[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    shared = spark.sparkContext.broadcast((ranks, edges))

    def part_of(batch):
        return placed(batch.column("doc_id"), batch.column("row").to_numpy(), shared.value[1])

    def sizes(batches):
        for batch in batches:
            n = np.bincount(part_of(batch), weights=batch.column("n").to_numpy()).astype(np.int64)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some])], ["part", "n"])

    per_part = rows.select("doc_id", "row", "n").mapInArrow(sizes, "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).collect()
    starts = np.zeros(len(edges) + 2, np.int64)
    for r in per_part:
        starts[r["part"] + 1] = r["n"]
    starts = spark.sparkContext.broadcast(np.cumsum(starts))
    fs, path = open_folder(target)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{RANKS}") as out:
        out.write(by_rank.astype("<u4").tobytes())

    def code(batches):
        for batch in batches:
            ids, counts, made = batch.column("ids").to_pylist(), batch.column("n").to_numpy(), []
            for a, b in blocks(counts):
                held = b"".join(ids[a:b])
                made += pack_all(shared.value[0][np.frombuffer(held, _kind(held, counts[a:b].sum()))], counts[a:b])
            arrays = [pa.array(part_of(batch)), batch.column("doc_id"), batch.column("row"), pa.array(made, pa.binary()), batch.column("n")]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "doc_id", "row", "packed", "n"])

    def save(batches):
        fs, path = open_folder(target)
        fs.create_dir(path, recursive=True)
        held: list[tuple] = []
        size, number, at, start = 0, 0, None, 0

        def flush():
            name = f"{at:06d}-{number:06d}.qtf"
            controls = [-(-n // 4) for *_, n in held]
            body = [
                struct.pack(HEAD, MAGIC, len(held), size, start),
                np.array([i or 0 for i, *_ in held], "<i8").tobytes(),
                np.array([i is None for i, *_ in held], np.uint8).tobytes(),
                np.array([n for *_, n in held], "<u4").tobytes(),
                *(p[:c] for (_, p, _), c in zip(held, controls, strict=True)),
                *(p[c:] for (_, p, _), c in zip(held, controls, strict=True)),
            ]
            draft = f"{path}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(draft) as out:
                for x in body:
                    out.write(x)
            fs.move(draft, f"{path}/{name}")
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((at, pa.int32()), (number, pa.int32()), (name, pa.string()), (len(held), pa.int64()), (size, pa.int64()), (start, pa.int64()))],
                MANIFEST,
            )

        for batch in batches:
            for p, i, packed, n in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "packed", "n")), strict=True):
                if held and (p != at or size + n > FILE_IDS):
                    yield flush()
                    number, start, held, size = number + 1, start + size, [], 0
                if p != at:
                    at, number, start = p, 0, int(starts.value[p])
                held.append((i, packed, n))
                size += n
        if held:
            yield flush()

    dealt = (
        rows.select("doc_id", "row", "ids", "n")
        .mapInArrow(code, "part int, doc_id long, row long, packed binary, n long")
        .repartitionById(len(edges) + 1, F.col("part"))
        .sortWithinPartitions("part", "doc_id", "row")
    )
    made = dealt.mapInArrow(save, "part int, nth int, name string, n_docs long, n_ids long, start long")
    made.write.parquet(f"{folder}/_manifest")
    return spark.read.schema(made.schema).parquet(f"{folder}/_manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of the files in a folder, decoded; start counts the ids before a document. ids are little-endian 32-bit.

    A folder that ``write`` has not finished has no manifest and is an error.
    """
    fs, path = open_folder(qualified(spark, folder))
    with fs.open_input_stream(f"{path}/{RANKS}") as held:
        shared = spark.sparkContext.broadcast(np.frombuffer(held.read(), "<u4"))
    if spark.read.parquet(f"{folder}/_manifest").isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, ids binary")

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                yield from _documents(memoryview(content.as_buffer()), shared.value)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.qtf").load(folder)
    return files.select("content").mapInArrow(run, "doc_id long, start long, ids binary")


def _documents(raw: memoryview, ids_of: np.ndarray):
    magic, docs, _, start = struct.unpack_from(HEAD, raw)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = struct.calcsize(HEAD)
    doc_ids = np.frombuffer(raw, "<i8", docs, at)
    null = np.frombuffer(raw, np.uint8, docs, at + 8 * docs).astype(bool)
    counts = np.frombuffer(raw, "<u4", docs, at + 9 * docs).astype(np.int64)
    at += 13 * docs
    controls = -(-counts // 4)
    control = np.frombuffer(raw, np.uint8, controls.sum(), at)
    data = np.frombuffer(raw, np.uint8, offset=at + len(control))
    block = (np.cumsum(counts) - counts) // BLOCK_IDS
    first = 0
    while first < docs:
        after = int(np.searchsorted(block, block[first], "right"))
        for k in range(first, after, 256):
            some = slice(k, min(k + 256, after))
            n, c = counts[some], controls[some]
            # A document's control bytes may end in unused places.
            slots = slots_of(n)
            used, control = control[: c.sum()], control[c.sum() :]
            ids = ids_of[unpack(used, data, slots)].astype("<u4")
            data = data[LENGTHS[used].ravel()[slots].sum() :]
            ends = np.cumsum(n)
            made = [ids[b - m : b].tobytes() for b, m in zip(ends.tolist(), n.tolist(), strict=True)]
            arrays = [pa.array(doc_ids[some], mask=null[some]), pa.array(start + ends - n), pa.array(made, pa.binary())]
            start += int(n.sum())
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "ids"])
        first = after


def digests(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of ``read``'s rows."""

    def run(batches):
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            arrays = [batch.column("doc_id"), batch.column("start"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, write in ascending doc_id order to a new shared folder, read the files back; rows as ``read`` gives them.

    A null or empty text is its end id alone. Repeated ids follow one another in any order, null ids come first.
    An empty table writes no file. Only the named columns are read.
    """
    spark = docs.sparkSession
    rows = stage(encoded(docs, tokenizer_path, end_id, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "ids")
    folder = shared_dir(spark, "tokens")
    write(rows, folder)
    return read(spark, folder)
