"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sampled_ids, small_batches, stage

#: Places of a vector, letters told apart (z and the ones before it, the rest by a hash), and the seed of their vectors.
DIMENSIONS, LETTERS, SEED = 1024, 128, 20260
#: Rows that prototypes are learned from at most.
TRAIN_ROWS = 20_000
#: Characters worked on at a time, codes whose vectors are held at once, and how many times more cells than entries a
#: matrix of texts and codes may have.
ROUND_CHARS, CODES, SPARSE = 1 << 19, 4096, 32
#: Languages that can be learned; more is an error, as each has a prototype on the driver.
MOST_LANGUAGES = 500
#: Language of a text without a letter.
UNKNOWN = "und"
#: Of what its language's own texts reach, a known text reaches this share, less so many standard errors at its length.
LEAST_SHARE, ERRORS = 0.5, 1.5
#: N-grams that a known text has for each sign that isn't blank: one letter among numbers is no language.
LEAST_LETTERS = 0.1

#: Random vectors of 1 and -1; letter 0 is the space between words.
LETTER = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (LETTERS, DIMENSIONS))


def _letter_table() -> np.ndarray:
    """The letter of each code point of the basic plane, 0 where it isn't one."""
    table = np.zeros(1 << 16, np.uint8)
    for code in range(1 << 16):
        if chr(code).isalpha():
            low = code - ord("a")
            table[code] = 1 + low if 0 <= low < 26 else 27 + code * 40503 % 65536 % (LETTERS - 27)
    return table


_TABLE: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """A text's letters with one space before each word and one at the end."""
    if not _TABLE:
        _TABLE.append(_letter_table())
    low = text.lower()
    made = np.zeros(len(low) + 2, np.uint8)
    for k in range(0, len(low), ROUND_CHARS):
        codes = np.frombuffer(low[k : k + ROUND_CHARS].encode("utf-32-le", "surrogatepass"), np.uint32)
        made[k + 1 : k + 1 + len(codes)] = _TABLE[0][np.minimum(codes, 0xFFFF)]
        for at in np.flatnonzero(codes > 0xFFFF).tolist():  # letters beyond the basic plane are rare
            if chr(codes[at]).isalpha():
                made[k + at + 1] = 27 + int(codes[at]) % (LETTERS - 27)
    keep = np.ones(len(made), bool)
    keep[1:] = (made[1:] > 0) | (made[:-1] > 0)
    return made[keep]


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, times) of each text's distinct three-letter codes, in the order of text and code.

    The letters are gone through in blocks, so memory follows ROUND_CHARS and the distinct codes, however long a text is.
    """
    parts = [letters(t) for t in texts]
    ends = np.cumsum([len(p) for p in parts])
    flat = np.concatenate(parts)
    del parts
    keys, times = [], []
    for k in range(0, len(flat) - 2, ROUND_CHARS):
        some = flat[k : k + ROUND_CHARS + 2].astype(np.int64)
        at = np.arange(k, k + len(some) - 2)
        doc = np.searchsorted(ends, at, "right")
        inside = at + 2 < ends[doc]
        key = (doc << 21) | (some[:-2] << 14) | (some[1:-1] << 7) | some[2:]
        found, n = np.unique(key[inside], return_counts=True)
        keys.append(found)
        times.append(n)
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    key, n = keys[0], times[0]
    if len(keys) > 1:
        key, of = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(of, weights=np.concatenate(times)).astype(np.int64)
    return key >> 21, key & (LETTERS**3 - 1), n


def bound(codes: np.ndarray) -> np.ndarray:
    """The vector of each three-letter code: its letters' vectors, turned by their places, multiplied."""
    first, second, third = codes >> 14, (codes >> 7) & 127, codes & 127
    return np.roll(LETTER, 2, 1)[first] * np.roll(LETTER, 1, 1)[second] * LETTER[third]


def bundled(texts: list[str]) -> np.ndarray:
    return bundle(*counted(texts), len(texts))


def bundle(doc: np.ndarray, code: np.ndarray, n: np.ndarray, docs: int) -> np.ndarray:
    """The sum of the vectors of each text's n-grams, from ``counted``, CODES codes at a time."""
    total = np.zeros((docs, DIMENSIONS), np.float32)
    distinct, place = np.unique(code, return_inverse=True)
    if docs * len(distinct) > SPARSE * len(code):  # few texts share a code: add up each text's own rows
        for k in range(0, len(code), CODES):
            rows = bound(code[k : k + CODES]) * n[k : k + CODES, None].astype(np.float32)
            first = np.flatnonzero(np.diff(doc[k : k + CODES], prepend=-1))
            total[doc[k : k + CODES][first]] += np.add.reduceat(rows, first, axis=0)
        return total
    order = np.argsort(place, kind="stable")
    doc, place, n = doc[order], place[order], n[order]
    for k in range(0, len(distinct), CODES):
        a, b = np.searchsorted(place, (k, k + CODES))
        block = np.zeros((docs, min(CODES, len(distinct) - k)), np.float32)
        block[doc[a:b], place[a:b] - k] = n[a:b]
        total += block @ bound(distinct[k : k + CODES]).astype(np.float32)
    return total


def rounds(texts: list[str]):
    """Consecutive texts of ROUND_CHARS characters, or a longer one alone."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > ROUND_CHARS:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def remainder(id_col: str, by: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(by))


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The languages of at most TRAIN_ROWS documents that aren't held out, a unit vector for each (all its n-grams'
    vectors bundled), the projection of one n-gram on it to be expected in a new text, and its standard deviation.

    The sample isn't stratified: a language of less than about one in TRAIN_ROWS documents may not be learned. Vectors
    are summed up by Spark; the driver gets DIMENSIONS numbers for each of MOST_LANGUAGES languages at most.
    """
    spark = docs.sparkSession
    small_batches(spark)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    named = named.filter((remainder("doc_id", 4) != 2) & F.col("lang").isNotNull())
    ids = F.broadcast(sampled_ids(named, TRAIN_ROWS))
    sample = stage(named.join(ids, named["doc_id"] == ids["id"], "left_semi").select("text", "lang"), "profile")
    langs = [r["lang"] for r in sample.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs.sort()

    def each(batches):
        """(language, its distinct codes, their times) of some texts."""
        for batch in batches:
            of = np.array(batch.column("lang").to_pylist(), object)
            texts = np.array([t or "" for t in batch.column("text").to_pylist()], object)
            for lang in sorted(set(of)):
                for some in rounds(texts[of == lang].tolist()):
                    _, code, n = counted(some)
                    code, at = np.unique(code, return_inverse=True)
                    yield lang, code, np.bincount(at, weights=n, minlength=len(code))

    def total(batches):
        sums: dict[str, np.ndarray] = {}
        for lang, code, n in each(batches):
            vector = bundle(np.zeros(len(code), np.int64), code, n, 1)[0]
            sums[lang] = sums.get(lang, np.zeros(DIMENSIONS + 1)) + np.append(vector, n.sum())
        for lang, values in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([values.astype(np.int64).tolist()], pa.list_(pa.int64()))], ["lang", "sums"])

    summed = sample.mapInArrow(total, "lang string, sums array<bigint>").select("lang", F.posexplode("sums").alias("at", "v"))
    found = summed.groupBy("lang", "at").agg(F.sum("v").alias("v")).toPandas()
    vectors = np.zeros((len(langs), DIMENSIONS + 1))
    vectors[[langs.index(x) for x in found["lang"]], found["at"]] = found["v"]
    vectors, n = vectors[:, :-1], vectors[:, -1]
    norms = np.maximum(1e-9, np.linalg.norm(vectors, axis=1))
    made = (vectors / norms[:, None]).astype(np.float32)
    # Without each learned n-gram's projection on itself: a new text has no part in the prototype.
    expected = np.where(n > 1, np.maximum(0.0, (norms * norms - n * DIMENSIONS) / np.maximum(1, n - 1) / norms), 0.0)
    shared = spark.sparkContext.broadcast((langs, made))

    def squared(batches):
        langs, made = shared.value
        for lang, code, n in each(batches):
            own = made[langs.index(lang)]
            once = twice = 0.0
            for k in range(0, len(code), CODES):
                reached = (bound(code[k : k + CODES]) @ own).astype(np.float64)
                once += float(n[k : k + CODES] @ reached)
                twice += float(n[k : k + CODES] @ (reached * reached))
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([once]), pa.array([twice])], ["lang", "once", "twice"])

    spread = np.zeros(len(langs))
    moments = sample.mapInArrow(squared, "lang string, once double, twice double").groupBy("lang").agg(F.sum("once").alias("once"), F.sum("twice").alias("twice"))
    for r in moments.collect():
        k = langs.index(r["lang"])
        if n[k] > 1:
            spread[k] = np.sqrt(max(0.0, r["twice"] / n[k] - (r["once"] / n[k]) ** 2))
    return langs, made, expected, spread


def prototypes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """The learned languages and a unit vector for each."""
    return profiles(docs, id_col, text_col, lang_col)[:2]


def predict(docs: DataFrame, learned: tuple[list[str], np.ndarray] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row.

    A document's vector bundles the vectors of its three-letter n-grams; the prototype with the largest
    cosine (the first by name where equal) gives the language, the cosine, cut to 0..1, the score.
    A null text, or one without a letter, is ``und`` with score 0, as is everything if no language could be
    learned. held_out: crc32 of the id as text leaves remainder 2 by 4; a null id is not held out, and never
    learned from. Repeated rows keep a row each. Only the named columns are read; source and
    language are no inputs of a prediction.
    """
    small_batches(docs.sparkSession)
    langs, made = learned if learned is not None else prototypes(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast((langs, made))

    def run(batches):
        langs, made = shared.value
        for batch in batches:
            names, scores = [], []
            for some in rounds([t or "" for t in batch.column("text").to_pylist()]):
                for name, score in judged(some, langs, made):
                    names.append(name)
                    scores.append(score)
            arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score"])

    held_out = F.coalesce(remainder(id_col, 4) == 2, F.lit(False)).alias("held_out")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out, F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def judged(texts: list[str], langs: list[str], made: np.ndarray) -> list[tuple[str, float]]:
    if not langs:
        return [(UNKNOWN, 0.0)] * len(texts)
    vectors = bundled(texts)
    cosines = (vectors @ made.T) / np.maximum(1e-9, np.linalg.norm(vectors, axis=1))[:, None]
    best = np.argmax(cosines, axis=1)
    lettered = [any(c.isalpha() for c in t) for t in texts]
    return [
        (langs[k], float(min(1.0, max(0.0, row[k])))) if some else (UNKNOWN, 0.0) for k, row, some in zip(best, cosines, lettered, strict=True)
    ]


def known(texts: list[str], langs: list[str], made: np.ndarray, expected: np.ndarray, spread: np.ndarray, least_share: float = LEAST_SHARE) -> list[bool]:
    """Whether each text is of a learned language.

    The mean projection of its n-grams on the nearest prototype doesn't depend on its length, as a cosine does. It
    has to reach ``least_share`` of what that language's own n-grams give, less ERRORS standard errors of a
    mean of so many. Both come from the learned rows. A text without a letter, or with next to none among
    its signs (LEAST_LETTERS), is of no language.
    """
    if not langs:
        return [False] * len(texts)
    doc, code, times = counted(texts)
    n = np.maximum(1, np.bincount(doc, weights=times, minlength=len(texts)))
    reached = bundle(doc, code, times, len(texts)) @ made.T / n[:, None]
    best = np.argmax(reached, axis=1)
    enough = reached[np.arange(len(texts)), best] >= least_share * expected[best] - ERRORS * spread[best] / np.sqrt(n)
    enough &= n >= LEAST_LETTERS * np.array([len("".join(t.split())) for t in texts])
    return [bool(e) and any(c.isalpha() for c in t) for e, t in zip(enough, texts, strict=True)]


def keep_known(docs: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """``docs`` without the rows whose text is of no learned language (``known``); nothing is shuffled."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(profiles(docs))

    def run(batches):
        for batch in batches:
            keep = []
            for some in rounds([t or "" for t in batch.column("text").to_pylist()]):
                keep += known(some, *shared.value, least_share)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
