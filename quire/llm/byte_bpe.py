"""Byte-level BPE: DuckDB recursive queries inside each partition contract pairs until a fixpoint."""

from __future__ import annotations

import base64
import contextlib
import functools
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, small_batches

#: Bytes of text whose distinct words are encoded together; a worker's memory follows this, not the partition.
ROUND_BYTES = 2 << 20
#: Ids that are decoded at once, unless one text has more.
DECODE_IDS = 1 << 18
#: Memory of one worker's DuckDB.
DUCKDB_MEMORY = "300MB"

# The code points with the property White_Space.
SPACES = "\t-\r \x85\xa0  -     　"
#: White space with the word after it. No match of a tokenizer's pattern reaches over the end of such a piece.
PIECE = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")

#: Bytes that a query takes at once (it holds the rows of every step), and distinct words that a worker remembers.
QUERY_BYTES, REMEMBERED = 1 << 19, 300_000
#: Bytes of the windows that a longer word is cut into, and from one window's start to the next: small ones first, larger ones
#: where neighbours share no token. The steps are multiples of many small numbers, so that windows of a periodic word start alike.
WINDOW, STEP = 120, 60
LARGER = ((4096, 1920), (61_440, 30_720))

#: Each step pairs neighbours, ranks the pairs by the merge table, and contracts each word's leftmost pair of least rank.
ENCODE = """
WITH RECURSIVE t AS (
    SELECT (w::BIGINT << 7) | pos AS k, id, false AS done FROM symbols
  UNION ALL (
    WITH paired AS (
        SELECT k, id, lead(id) OVER (ORDER BY k) AS next_id, lead(k) OVER (ORDER BY k) AS next_k FROM t WHERE NOT done
    ), ranked AS (
        SELECT p.k, p.k >> 7 AS w, p.id, ((m.made::BIGINT << 14) | ((p.k & 127) << 7)) | (p.next_k & 127) AS turn
        FROM paired p LEFT JOIN merges m ON p.id = m.l AND p.next_id = m.r AND (p.k >> 7) = (p.next_k >> 7)
    ), least AS (
        SELECT w, min(turn) AS turn FROM ranked GROUP BY w
    )
    SELECT r.k, (CASE WHEN r.turn = l.turn THEN (l.turn >> 14) ELSE r.id END)::INT AS id, l.turn IS NULL AS done
    FROM ranked r JOIN least l ON r.w = l.w WHERE l.turn IS NULL OR (r.k & 127) <> (l.turn & 127)
  )
)
SELECT (k >> 7)::INT AS w, id FROM t WHERE done ORDER BY k
"""

#: The same for whole long words: where no other pair can come between, a step contracts all equal pairs of a word from left to right.
ENCODE_LONG = """
WITH RECURSIVE t AS (
    SELECT w, pos, id, false AS done FROM symbols
  UNION ALL (
    WITH paired AS (
        SELECT w, pos, id, lead(id) OVER near AS next_id, lead(pos) OVER near AS next_pos
        FROM t WHERE NOT done WINDOW near AS (PARTITION BY w ORDER BY pos)
    ), ranked AS (
        SELECT p.*, m.made, m.alone FROM paired p LEFT JOIN merges m ON p.id = m.l AND p.next_id = m.r
    ), least AS (
        SELECT w, min(made) AS made, count(*) AS n FROM ranked GROUP BY w
    ), hits AS (
        SELECT r.w, r.pos, r.next_pos, r.made, r.alone,
               coalesce(lag(r.next_pos) OVER (PARTITION BY r.w ORDER BY r.pos) <> r.pos, true) AS opens
        FROM ranked r JOIN least l ON r.w = l.w AND r.made = l.made
    ), runs AS (
        SELECT *, sum(opens::INT) OVER (PARTITION BY w ORDER BY pos) AS run FROM hits
    ), numbered AS (
        SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY pos) AS nth FROM runs
    ), chosen AS (
        SELECT w, pos, next_pos, made FROM numbered WHERE nth % 2 = 1 AND (NOT alone OR (run = 1 AND nth = 1))
    )
    SELECT r.w, r.pos, coalesce(c.made, r.id) AS id, l.made IS NULL AS done
    FROM ranked r JOIN least l ON r.w = l.w
    LEFT JOIN chosen c ON r.w = c.w AND r.pos = c.pos
    WHERE NOT EXISTS (SELECT 1 FROM chosen g WHERE g.w = r.w AND g.next_pos = r.pos)
  )
)
SELECT w, id FROM t WHERE done ORDER BY w, pos
"""

DECODE = """
SELECT coalesce(string_agg(v.hex, '' ORDER BY i.pos), '') AS hex
FROM docs d LEFT JOIN ids i ON d.doc = i.doc LEFT JOIN vocabulary v ON i.id = v.id
GROUP BY d.doc ORDER BY d.doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """(l, r, made, alone): each way to put two tokens together.

    ``alone`` marks a token that lies at an end of another token of lower rank: after one contraction a
    neighbouring pair may come first, so equal pairs of a word have to be contracted one at a time.
    """
    rows, alone = [], set()
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                rows.append((left, right, rank))
                alone.update(r for r in (left, right) if r > rank)
    left, right, made = (np.array(x, np.int32) for x in zip(*rows, strict=True))
    return pa.table({"l": left, "r": right, "made": made, "alone": np.isin(made, list(alone))})


class Coder:
    """One worker's DuckDB with the merge table and the vocabulary."""

    def __init__(self, ranks_path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = read_ranks(ranks_path)
        self.pattern = regex.compile(pattern)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": ""})
        self._table("merges", merge_table(self.ranks))
        tokens = sorted(self.ranks.items(), key=lambda x: x[1])
        self.lengths = np.zeros(tokens[-1][1] + 1, np.int64)
        self.lengths[[i for _, i in tokens]] = [len(t) for t, _ in tokens]
        self._forget()
        self._table("vocabulary", pa.table({"id": pa.array([i for _, i in tokens], pa.int32()), "hex": [t.hex() for t, _ in tokens]}))

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.single: dict[str, int] = {}  # of the pieces that are one word
        self.ids, self.counts = np.empty(0, np.int32), np.empty(0, np.int64)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each has."""
        known = [self.ranks.get(w) for w in words]
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        rest = [n for n, k in enumerate(known) if k is None]
        short = [n for n in rest if len(words[n]) <= WINDOW]
        for some in chunks(short, [len(words[n]) for n in short], QUERY_BYTES):
            ids, of = self._contracted(ENCODE, [words[n] for n in some])
            parts.append((np.array(some, np.int64)[of], ids))
        for n in rest:
            if len(words[n]) > WINDOW:
                ids = self._long(words[n])
                parts.append((np.full(len(ids), n, np.int64), ids))
        whole = [n for n, k in enumerate(known) if k is not None]
        parts.append((np.array(whole, np.int64), np.array([known[n] for n in whole], np.int32)))
        of, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        return ids[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))

    def _long(self, word: bytes) -> np.ndarray:
        """The ids of a word longer than WINDOW, from those of its overlapping windows.

        A sequence of tokens is what contraction gives exactly if each two neighbours are so by themselves. Two
        windows that hold the same token at the same place are joined there: then each two neighbours stand
        side by side in a window. Where two windows have no token in common the whole word is contracted.
        """
        for window, step, query, most in ((WINDOW, STEP, ENCODE, QUERY_BYTES // 8), *((*x, ENCODE_LONG, x[0]) for x in LARGER)):
            if len(word) > window:
                ids = self._joined(word, window, step, query, most)
                if ids is not None:
                    return ids
        return self._contracted(ENCODE_LONG, [word])[0]

    def _joined(self, word: bytes, window: int, step: int, query: str, most: int) -> np.ndarray | None:
        """The ids of a word by its windows; None if two neighbours share no token. Equal windows are contracted once."""
        starts = range(0, len(word) - window + step, step)
        cut = [word[s : s + window] for s in starts]
        distinct = {w: n for n, w in enumerate(dict.fromkeys(cut))}
        cut = [distinct[w] for w in cut]
        found: list[np.ndarray] = []
        for some in chunks(list(distinct), [len(w) for w in distinct], most):
            ids, of = self._contracted(query, some)
            found += np.split(ids, np.cumsum(np.bincount(of, minlength=len(some)))[:-1])
        ends = [np.cumsum(self.lengths[ids]) for ids in found]
        met: dict[tuple[int, int], int] = {}  # of two neighbouring windows, where they are joined: bytes from the second one's start
        parts, at = [], 0
        for n, start in enumerate(starts):
            ids, here = found[cut[n]], ends[cut[n]]
            first = int(np.searchsorted(here, at - start, "right"))
            if n + 1 == len(starts):
                parts.append(ids[first:])
                break
            pair = cut[n], cut[n + 1]
            if pair not in met:
                # A token is known by its end and length; the middle one of those in common is as good as any.
                after = found[pair[1]]
                same = np.intersect1d((here - step) << 10 | self.lengths[ids], ends[pair[1]] << 10 | self.lengths[after], assume_unique=True)
                same = same[same >= 0]
                met[pair] = int(same[len(same) // 2]) >> 10 if len(same) else -1
            if met[pair] < 0:
                return None
            at = start + step + met[pair]
            parts.append(ids[first : int(np.searchsorted(here, at - start, "right"))])
        return np.concatenate(parts)

    def _contracted(self, query: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbols = {
            "w": np.repeat(np.arange(len(words), dtype=np.int32), lengths),
            "pos": (np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32),
            "id": self.of_byte[flat],
        }
        self._table("symbols", pa.table(symbols))
        found = self.db.sql(query).to_arrow_table()
        return found["id"].to_numpy(), found["w"].to_numpy()

    def _remember(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The places of each piece's words, one piece after the other, and how many words each has; new words are encoded."""
        if len(self.places) > REMEMBERED:
            self._forget()
        first = len(self.places)
        places, single = self.places, self.single  # an error below leaves these without ids: such a coder isn't used again
        of, sizes = [], np.ones(len(pieces), np.int64)
        for n, piece in enumerate(pieces):
            at = single.get(piece)
            if at is not None:
                of.append(at)
                continue
            found = self.pattern.findall(piece)
            for w in found:
                of.append(places.setdefault(w, len(places)))
            if found == [piece]:
                single[piece] = of[-1]
            sizes[n] = len(found)
        if len(places) > first:
            new = itertools.islice(places, first, None)
            ids, counts = self.words([w.encode() for w in new])
            self.ids, self.counts = np.concatenate((self.ids, ids)), np.concatenate((self.counts, counts))
        return np.array(of, np.int64), sizes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        pieces: list[str] = []
        sizes = []
        for text in texts:
            found = PIECE.findall(text)
            sizes.append(len(found))
            pieces += found
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        del pieces
        of, counts = self._remember(coded.dictionary.to_pylist())
        ids, lengths = spread(self.ids, self.counts, of)
        ids, counts = spread(ids, summed(lengths, counts), coded.indices.to_numpy())
        ends = np.cumsum(summed(counts, np.array(sizes, np.int64)))
        return np.split(ids.astype("<u4"), ends[:-1]) if texts else []

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each sequence of ids, by an aggregation in the order of their positions."""
        sizes = np.array([len(x) for x in ids], np.int64)
        rows = {
            "doc": np.repeat(np.arange(len(ids), dtype=np.int32), sizes),
            "pos": np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]) if len(ids) else np.empty(0, np.int32),
            "id": np.concatenate(ids).astype(np.int32) if len(ids) else np.empty(0, np.int32),
        }
        self._table("ids", pa.table(rows))
        self._table("docs", pa.table({"doc": np.arange(len(ids), dtype=np.int32)}))
        found = self.db.sql(DECODE).to_arrow_table()["hex"].to_pylist()
        return [bytes.fromhex(x) for x in found]


def chunks(items: list, sizes: list[int], most: int):
    """Consecutive items whose sizes add up to ``most`` or less, or a larger one alone."""
    held, size = [], 0
    for item, n in zip(items, sizes, strict=True):
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append(item)
        size += n
    if held:
        yield held


def spread(values: np.ndarray, counts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` (run k has counts[k] of them) for each chosen k in turn, and their lengths."""
    starts = np.cumsum(counts) - counts
    lengths = counts[chosen]
    at = np.repeat(starts[chosen] - (np.cumsum(lengths) - lengths), lengths)
    at += np.arange(len(at))
    return values[at], lengths


def summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of ``values``; empty groups have sum 0."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


@functools.lru_cache(maxsize=2)
def coder(ranks_path: str, pattern: str) -> Coder:
    return Coder(ranks_path, pattern)


@contextlib.contextmanager
def using(ranks_path: str, pattern: str):
    """A worker's coder; after an error the next task of the worker makes a new one."""
    try:
        yield coder(ranks_path, pattern)
    except BaseException:
        coder.cache_clear()
        raise


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) for each row: the token ids, and the bytes that decoding them gives.

    ``ranks_path`` names the rank file on the executors, ``pattern`` the expression that splits a text.
    Each match is encoded by itself: one that is a token is that token; else its bytes are rows of
    (word, position, id) which meet the merge table, and the leftmost pair of least rank is contracted,
    again and again in one recursive query, until no pair is left. Words of more than WINDOW bytes are
    contracted in overlapping windows that are joined at tokens they share, which gives the same ids. A worker
    encodes the distinct words of ROUND_BYTES of text at a time and remembers about REMEMBERED words. Special
    tokens are ordinary text. A null or empty text has no ids. Repeated rows and null ids keep a row each; only
    the named columns are read.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        with using(ranks_path, pattern) as own:
            for rows in gathered(batches, "text", ROUND_BYTES):
                ids = own.encode([t or "" for t in rows["text"].to_pylist()])
                for k in range(0, len(ids), 256):
                    part = ids[k : k + 256]
                    arrays = [rows["doc_id"].slice(k, 256).combine_chunks(), pa.array([x.tolist() for x in part], pa.list_(pa.int32())), pa.array(own.decode(part), pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>, decoded binary"
    )


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encode``'s ids and bytes, made where they are made."""
    small_batches(docs.sparkSession)

    def run(batches):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        with using(ranks_path, pattern) as own:
            for rows in gathered(batches, "text", ROUND_BYTES):
                ids = own.encode([t or "" for t in rows["text"].to_pylist()])
                decoded = []
                for some in chunks(ids, [len(x) for x in ids], DECODE_IDS):
                    decoded += [sha(x) for x in own.decode(some)]
                arrays = [rows["doc_id"].combine_chunks(), pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(x.tobytes()) for x in ids], pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
