"""BPE of words with an end mark: each short word is an array of parts and of its neighbours' ranks."""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import spread, summed
from .common import gathered, small_batches
from .token_files import ENDED, LETTERS, PLAIN, SIGN, SIGNS

#: Bytes of text whose distinct words are encoded together, and characters of words that a worker remembers.
ROUND_BYTES, REMEMBERED_CHARS = 4 << 20, 3 << 20
#: Words of up to so many bytes stand side by side, the ranks of each an array that is scanned; longer ones take a queue,
#: as the time of scanning grows with the square of a word.
WIDTHS = (4, 8, 16, 32, 64, 128)
#: Parts of words that are scanned at once.
PARTS = 1 << 20
#: Greater than any rank.
NONE = (1 << 31) - 1

# How the tokenizer's file splits lower-cased ASCII text (white space parts words and is dropped).
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9\t-\r ]+")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


class Merges:
    """The merges of a vocabulary: words to ids. A word is its bytes; the last one stands with the end mark."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        letters = byte_letters()
        self.of_byte = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.of_last = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int32)
        #: For each pair of ids its rank, and for each rank the id that it gives.
        self.ranks = {(vocab[a], vocab[b]): n for n, (a, b) in enumerate(merges)}
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.size = max(vocab.values()) + 1
        keys = np.array([a * self.size + b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank_of_key = keys[order], np.fromiter(self.ranks.values(), np.int32, len(keys))[order]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs; NONE of what can't be merged or isn't there (-1)."""
        pair = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where((self.keys[at] == pair) & (left >= 0) & (right >= 0), self.rank_of_key[at], NONE).astype(np.int32)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (of a byte at least) one after the other, and how many each has: the leftmost pair of least rank becomes one part, again and again."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(sizes) - sizes
        ids = self.of_byte[flat]
        last = starts + sizes - 1
        ids[last] = self.of_last[flat[last]]
        counts, parts = np.zeros(len(words), np.int64), []
        shorter = 0
        for width in WIDTHS:
            some = np.flatnonzero((sizes > shorter) & (sizes <= width))
            for k in range(0, len(some), PARTS // width):
                chunk = some[k : k + PARTS // width]
                place = np.arange(width)
                held = np.where(place < sizes[chunk, None], ids[np.minimum(starts[chunk, None] + place, len(ids) - 1)], np.int32(-1))
                made = self._scanned(held)
                counts[chunk] = (made >= 0).sum(1)
                parts.append((np.repeat(chunk, counts[chunk]), made[made >= 0]))
            shorter = width
        for n in np.flatnonzero(sizes > shorter):
            made = self._queued(ids[starts[n] : starts[n] + sizes[n]])
            counts[n] = len(made)
            parts.append((np.full(len(made), n), made))
        of, found = (np.concatenate(x) for x in zip((np.empty(0, np.int64), np.empty(0, np.int32)), *parts, strict=True))
        return found[np.argsort(of, kind="stable")], counts

    def _scanned(self, parts: np.ndarray) -> np.ndarray:
        """Words of like length side by side, a row each, -1 after their end.

        Beside the parts of a word stand the ranks of neighbours. In a step each word's ranks are scanned for the
        least, the boundary there goes, and the two ranks beside it are set anew; a word without a rank is done.
        """
        done, rows = np.full(parts.shape, -1, np.int32), np.arange(len(parts))
        width = parts.shape[1]
        ranks = np.full(parts.shape, NONE, np.int32)
        ranks[:, :-1] = self._rank(parts[:, :-1], parts[:, 1:])
        place = np.arange(width)
        while len(rows):
            at = ranks.argmin(1)
            least = np.take_along_axis(ranks, at[:, None], 1)[:, 0]
            on = least < NONE
            if not on.all():
                done[rows[~on]] = parts[~on]
                rows, parts, ranks, at, least = rows[on], parts[on], ranks[on], at[on], least[on]
            each = np.arange(len(rows))
            parts[each, at] = self.made[least]
            parts = np.take_along_axis(parts, np.minimum(place + (place > at[:, None]), width - 1), 1)
            ranks = np.take_along_axis(ranks, np.minimum(place + (place >= at[:, None]), width - 1), 1)
            parts[:, -1], ranks[:, -1] = -1, NONE
            after = np.minimum(at + 1, width - 1)
            ranks[each, at] = np.where(at + 1 < width, self._rank(parts[each, at], parts[each, after]), NONE)
            some = np.flatnonzero(at)
            ranks[some, at[some] - 1] = self._rank(parts[some, at[some] - 1], parts[some, at[some]])
        return done

    def _queued(self, parts: np.ndarray) -> np.ndarray:
        """The same for a long word by a queue of (rank, place), each in one whole number; outdated entries are passed over."""
        rank, n = self.ranks.get, len(parts)
        ids = array("i", parts.tobytes())
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        first = self._rank(parts[:-1], parts[1:])
        ranks = array("i", np.append(first, np.int32(NONE)).tobytes())
        some = np.flatnonzero(first < NONE)
        queue = (first[some].astype(np.int64) << 32 | some).tolist()
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            at, least = entry & 0xFFFFFFFF, entry >> 32
            if ranks[at] != least:
                continue
            gone = after[at]
            ids[at], ids[gone] = int(self.made[least]), -1
            ranks[gone] = NONE
            after[at] = after[gone]
            if after[at] < n:
                before[after[at]] = at
            for left in (before[at], at):
                if left >= 0:
                    right = after[left]
                    new = rank((ids[left], ids[right]), NONE) if right < n else NONE
                    if ranks[left] != new:
                        ranks[left] = new
                        if new != NONE:
                            heapq.heappush(queue, new << 32 | left)
        found = np.array(ids, np.int32)
        return found[found >= 0]


class Coder:
    """One worker's tokenizer: the library normalises and splits what isn't ASCII, the merges are done here."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            kind = json.load(file)
        model = kind["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges") or kind["decoder"] is not None:
            raise ValueError("not a BPE tokenizer of words with an end mark and without a decoder")
        self.added = {t["content"]: t["id"] for t in kind["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in kind["added_tokens"]):
            raise ValueError("added tokens must stand for their exact text")
        self.split_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.to_byte = {ord(x): chr(b) for b, x in byte_letters().items()}
        names = model["vocab"] | self.added
        held = [""] * (max(names.values()) + 1)
        for token, i in names.items():
            held[i] = token
        self.tokens = pa.array(held, pa.large_string())
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.chars = 0
        self.ids, self.counts = np.empty(0, np.int32), np.empty(0, np.int64)

    def _words(self, unit: str) -> list[bytes]:
        """The words of a text without white space and added tokens."""
        if unit.isascii():
            return [w.encode() for w in ASCII_WORDS.findall(unit.lower())]
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(unit))
        return [w.translate(self.to_byte).encode("latin-1") for w, _ in found]

    def _parts(self, unit: str) -> list[bytes | int]:
        """The words and the ids of added tokens: what the tokenizer lists as such is one wherever it stands."""
        if self.split_added is None or not any(t in unit for t in self.added):
            return self._words(unit)
        parts, at = [], 0
        for found in self.split_added.finditer(unit):
            parts += self._words(unit[at : found.start()])
            parts.append(self.added[found[0]])
            at = found.end()
        return parts + self._words(unit[at:])

    def _encode_new(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        held = pa.array(units, pa.large_string())
        plain = pc.match_substring_regex(held, f"{PLAIN}|^{SIGN}+$").to_numpy(zero_copy_only=False)
        words: list[bytes] = []
        fixed: dict[int, int] = {}
        sizes = np.ones(len(units), np.int64)
        for n, (unit, alone) in enumerate(zip(units, plain.tolist(), strict=True)):
            if alone:
                words.append(unit.encode())
                continue
            parts = self._parts(unit)
            sizes[n] = len(parts)
            for part in parts:
                if isinstance(part, int):
                    fixed[len(words)] = part
                    part = b"\0"
                words.append(part)
        ids, counts = self.merges.encode(words)
        if fixed:
            at = np.fromiter(fixed, np.int64, len(fixed))
            ids[(np.cumsum(counts) - counts)[at]] = list(fixed.values())
        return ids, summed(counts, sizes)

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

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has. No word reaches over ASCII white space.

        What stands between is one unit, or two if it is letters and then signs; equal units are encoded once.
        """
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        sizes = pc.list_value_length(split).to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        del split
        whole = coded.dictionary
        ended = pc.match_substring_regex(whole, ENDED)
        lower = pc.utf8_lower(whole)
        alike = pc.or_(ended, pc.match_substring_regex(whole, PLAIN))
        heads = pc.if_else(alike, pc.if_else(ended, pc.utf8_rtrim(lower, SIGNS), lower), whole)
        tails = pc.replace_substring_regex(whole.filter(ended), f"^{LETTERS}", "")
        units = pa.concat_arrays([heads, tails]).dictionary_encode()
        places = self._places(units.dictionary.to_pylist())[units.indices.to_numpy()]
        ids, counts = spread(self.ids, self.counts, places)
        two = ended.to_numpy(zero_copy_only=False)
        # The units of each whole in order: its head, then its tail.
        order = np.argsort(np.concatenate((np.arange(len(whole)) * 2, np.flatnonzero(two) * 2 + 1)), kind="stable")
        ids, counts = spread(ids, counts, order)
        ids, counts = spread(ids, summed(counts, 1 + two.astype(np.int64)), coded.indices.to_numpy())
        return ids, summed(counts, sizes)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The text of each sequence of ids: its tokens with a space between, as the library joins them without a decoder."""
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int64())
        return pc.binary_join(pa.LargeListArray.from_arrays(offsets, self.tokens.take(pa.array(ids))), pa.scalar(" ", pa.large_string()))


@functools.lru_cache(maxsize=1)
def coder(path: str) -> Coder:
    return Coder(path)


def _rounds(batches, path: str):
    """(rows, ids, counts, texts decoded from them) of some documents at a time; no worker goes on with what an error has left."""
    try:
        own = coder(path)
        for rows in gathered(batches, "text", ROUND_BYTES):
            ids, counts = own.encode(rows["text"].combine_chunks())
            ends = np.cumsum(counts)
            for k in range(0, len(counts), 256):
                part = counts[k : k + 256]
                some = ids[ends[k] - part[0] : ends[k + len(part) - 1]]
                yield rows["doc_id"].slice(k, 256).combine_chunks(), some, part, own.decode(some, part)
    except BaseException:
        coder.cache_clear()
        raise


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) for each row: the token ids, and the text that decoding them gives.

    ``tokenizer_path`` names the tokenizer's file on the executors: byte-level BPE of words with an end mark,
    lower-casing, without a decoder. A text is cut at ASCII white space, over which no word reaches; ASCII words are
    split here, others are normalised and split by the library. A word of up to 128 bytes (WIDTHS) is an array of parts
    beside an array of its neighbours' ranks, which is scanned for the least rank until none is left, many words
    side by side; a longer word takes a queue instead, which gives the same ids. A worker encodes the distinct words of ROUND_BYTES of text
    at a time and remembers about REMEMBERED_CHARS characters of words. No special token is added; one in a text is
    its id. A null or empty text has no ids and an empty text. Repeated rows and null ids keep a row each; only the
    named columns are read.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for doc_ids, ids, counts, texts in _rounds(batches, tokenizer_path):
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
            yield pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), texts.cast(pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>, decoded string"
    )


def digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encode``'s ids and texts, made where they are made."""
    small_batches(docs.sparkSession)

    def run(batches):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for doc_ids, ids, counts, texts in _rounds(batches, tokenizer_path):
            each = np.split(ids.astype("<u4"), np.cumsum(counts)[:-1])
            arrays = [doc_ids, pa.array(counts, pa.int64()), pa.array([sha(x.tobytes()) for x in each], pa.string()), pa.array([sha(x.as_buffer() or b"") for x in texts], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
