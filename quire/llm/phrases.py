"""Phrases by contiguous pattern growth: the occurrences of each frequent prefix are projected and extended to the right."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import gathered, small_batches, stage

#: Bytes of text whose equal occurrences are put together before the shuffle, and occurrences whose prefixes are extended together.
ROUND_BYTES, GROW_ROWS = 4 << 20, 200_000
#: Occurrences of a round that one batch takes to the shuffle, and those of the bucket in which they end.
DEALT_ROWS = 50_000
#: A word or pair with more than one of so many occurrences is crowded; there are fewer than 2 * SHARE such.
SHARE = 1024
#: Where a text is cut; the piece mark can't be a word.
CUTS, MARK = "[.,;:!?\n-\r]+", "."


def _codes(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(words, code of each occurrence, whether the next one is in its piece, languages, its language's code): of all words in order."""
    marked = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(rows["text"].combine_chunks(), "")), CUTS, f" {MARK} ")
    split = pc.ascii_split_whitespace(marked)
    del marked
    sizes = pc.list_value_length(split).to_numpy()
    coded = split.flatten().dictionary_encode()
    del split
    langs = rows["lang"].combine_chunks().dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary
    of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    mark = codes == words.index(MARK).as_py()
    keep = np.flatnonzero(~mark & (codes != words.index("").as_py()))  # a text that begins or ends with white space has empty words there
    piece = (of + np.cumsum(mark, dtype=np.int32))[keep]  # changes at each mark and at each text
    goes_on = np.append(piece[1:] == piece[:-1], False) if len(piece) else np.empty(0, bool)
    return words, codes[keep], goes_on, langs.dictionary, langs.indices.to_numpy()[of[keep]].astype(np.int64)


def word_counts(batches):
    """(lang, words, n, crowded): how often each word occurs in a round, and the pairs that one in SHARE of its words begins."""
    for rows in gathered(batches, "text", ROUND_BYTES):
        words, codes, goes_on, langs, lang = _codes(rows)
        size = len(words)
        at, n = np.unique(lang * size + codes, return_counts=True)
        yield _counted(langs.take(pa.array(at // max(1, size))), words.take(pa.array(at % max(1, size))), n, False)
        heavy = np.bincount(codes, minlength=size) * SHARE >= len(codes)
        some = np.flatnonzero(goes_on & heavy[codes] & heavy[np.append(codes[1:], 0)])
        keys, n = np.unique((lang[some] * size + codes[some]) * size + codes[some + 1], return_counts=True)
        keys, n = keys[n * SHARE >= len(codes)], n[n * SHARE >= len(codes)]
        if len(keys):
            pair = pc.binary_join_element_wise(words.take(pa.array(keys // size % size)), words.take(pa.array(keys % size)), " ")
            yield _counted(langs.take(pa.array(keys // size**2)), pair, n, True)


def _counted(lang: pa.Array, words: pa.Array, n: np.ndarray, crowded: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang.cast(pa.string()), words.cast(pa.string()), pa.array(n, pa.int64()), pa.array(np.full(len(n), crowded))], ["lang", "words", "n", "crowded"])


def _mixed(value: np.ndarray, more: np.ndarray) -> np.ndarray:
    return (value ^ more) * np.uint64(0x9E3779B97F4A7C15) + (value >> np.uint64(29))


def projected(batches, most: int, buckets: int, crowded: set[tuple[str, str]]):
    """(bucket, lang, open, words, n): each occurrence of two words with the words after them in their piece, ``most`` in all.

    Equal ones of a round are one, with their number. A row holds those of a bucket: a line of ``words`` and 32 bits of
    ``n`` for each. Those of a pair go to one bucket, by their hashes. ``open`` marks crowded pairs, whose occurrences
    go to buckets by all their words.
    """
    for rows in gathered(batches, "text", ROUND_BYTES):
        yield from _dealt(*_codes(rows), most, buckets, crowded)


def _dealt(words: pa.Array, codes: np.ndarray, goes_on: np.ndarray, langs: pa.Array, lang: np.ndarray, most: int, buckets: int, crowded: set[tuple[str, str]]):
    size = len(words) + 1
    at = np.flatnonzero(goes_on)
    if not len(at):
        return
    key, room = lang[at] * size + codes[at], (1 << 62) // size
    inside, runs = np.ones(len(at), bool), []
    for depth in range(1, most):
        if len(key) and key.max() >= room:
            runs.append((depth, *np.unique(key, return_inverse=True)))
            key = runs[-1][2].astype(np.int64)
        if depth > 1:
            inside &= np.append(goes_on, np.zeros(most, bool))[at + depth - 1]
        key *= size
        key += np.where(inside, np.append(codes, np.zeros(most, codes.dtype))[at + depth], size - 1)
    del lang, codes, goes_on, at, inside
    keys, n = np.unique(key, return_counts=True)
    del key
    columns = []
    for depth in range(most - 1, -1, -1):
        columns.insert(0, (keys % size).astype(np.int32))
        keys //= size
        if runs and runs[-1][0] == depth:
            keys = runs.pop()[1][keys]
    names = words.to_pylist()
    is_open = np.zeros(len(n), bool)
    kinds = {x: k for k, x in enumerate(langs.to_pylist())}
    of = {w: k for k, w in enumerate(names)} if crowded else {}
    for x, pair in crowded:
        first, second = (of.get(w, -1) for w in pair.split(" "))
        is_open |= (keys == kinds.get(x, -1)) & (columns[0] == first) & (columns[1] == second)
    hashed = np.array([zlib.crc32(w.encode()) for w in [*names, ""]], np.uint64)
    del names, of
    mixed = _mixed(_mixed(np.array([zlib.crc32(x.encode()) for x in kinds] or [0], np.uint64)[keys], hashed[columns[0]]), hashed[columns[1]])
    for column in columns[2:]:
        mixed[is_open] = _mixed(mixed[is_open], hashed[column[is_open]])
    place = (keys * buckets + ((mixed >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)) * 2 + is_open
    del keys, mixed, is_open
    order = np.argsort(place, kind="stable")
    place, n = place[order], n[order].astype(np.int32)
    columns = [c[order] for c in columns]
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    place, ends = place[starts], np.append(starts[1:], len(n))
    del order
    # Parts of the round one after the other, so that neither side holds all its texts at once.
    some = np.unique(np.searchsorted(ends, np.arange(0, len(n), DEALT_ROWS), side="right"))
    for a, b in zip(some, [*some[1:], len(ends)], strict=True):
        a_row, b_row = starts[a], ends[b - 1]
        texts = [words.take(pa.array(c[a_row:b_row], mask=c[a_row:b_row] == size - 1)) for c in columns]
        phrase = pc.binary_join_element_wise(*texts, " ", null_handling="skip")
        offsets = np.append(starts[a:b], b_row).astype(np.int32) - np.int32(a_row)
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), phrase), "\n").cast(pa.binary())
        numbers = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets * np.int32(4)), pa.py_buffer(n[a_row:b_row].copy())])
        where = place[a:b] // 2
        yield pa.RecordBatch.from_arrays([pa.array(where % buckets), langs.take(pa.array(where // buckets)).cast(pa.string()), pa.array(place[a:b] % 2 == 1), lines, numbers], ["bucket", "lang", "open", "words", "n"])


def extended(lines: pa.Array, n: np.ndarray, least: int, most: int):
    """(words, n) of the prefixes of a bucket, from pairs on, one more word at a time.

    A prefix of ``least`` occurrences is extended by each word that follows it, and so on to the right; others end here.
    """
    phrases = lines.dictionary_encode()
    inverse, size = phrases.indices.to_numpy(), len(phrases.dictionary)
    n = np.bincount(inverse, n, size).astype(np.int64)
    split = pc.split_pattern(phrases.dictionary, " ")
    sizes, words = pc.list_value_length(split).to_numpy(), split.flatten().dictionary_encode()
    codes, starts = words.indices.to_numpy().astype(np.int64), np.cumsum(sizes) - sizes
    at = np.arange(size)
    prefix = codes[starts]
    for depth in range(1, most):
        ids, first, inverse = np.unique(prefix * len(words.dictionary) + codes[starts[at] + depth], return_index=True, return_inverse=True)
        total = np.bincount(inverse, n[at], len(ids)).astype(np.int64)
        kept = total >= least
        shown = at[first[kept]]
        parts = [words.dictionary.take(pa.array(codes[starts[shown] + k])) for k in range(depth + 1)]
        yield pc.binary_join_element_wise(*parts, b" ").cast(pa.string()), total[kept]
        on = kept[inverse] & (sizes[at] > depth + 1)
        at, prefix = at[on], inverse[on].astype(np.int64)


def grown(batches, least: int, most: int):
    """(lang, words, n) of all buckets of a task, which come one after the other, each language's rows together.

    Open ones are extended whatever their number, as they are in other buckets, too: such counts are parts of a sum.
    """

    def of(held: list[tuple[bytes, bytes]], lang: str, is_open: bool):
        lines = pc.split_pattern(pa.array([x for x, _ in held], pa.binary()), "\n").flatten()
        for words, n in extended(lines, np.frombuffer(b"".join(n for _, n in held), np.int32), 1 if is_open else least, most):
            yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(n), np.int8))), words, pa.array(n)], ["lang", "words", "n"])

    held, at = [], None
    for batch in batches:
        for *key, words, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "lang", "open", "words", "n")), strict=True):
            if held and at != key:
                yield from of(held, *at[1:])
                held = []
            at = key
            held.append((words, n))
    if held:
        yield from of(held, *at[1:])


def patterns(docs: DataFrame, least: int, most: int) -> tuple[DataFrame, DataFrame]:
    """((lang, words, n), (lang, total)): all words and the phrases of ``least`` occurrences, staged; the words of a language."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counted = texts.mapInArrow(word_counts, "lang string, words string, n long, crowded boolean").groupBy("lang", "words", "crowded").agg(F.sum("n").alias("n"))
    counted = stage(counted, "words")
    single = counted.filter("not crowded").select("lang", "words", "n")
    totals = single.groupBy("lang").agg(F.sum("n").alias("total"))
    total = single.agg(F.sum("n")).first()[0] or 0
    # A pair with a share of all occurrences has it in a round at least; each row here has half of it, so they are few.
    crowded = {(r["lang"], r["words"]) for r in counted.filter(F.col("crowded") & (F.col("n") * 2 * SHARE >= total)).collect()}
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-total // GROW_ROWS))
    rows = texts.mapInArrow(lambda batches: projected(batches, most, buckets, crowded), "bucket long, lang string, open boolean, words binary, n binary")
    dealt = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "lang", "open")
    found = dealt.mapInArrow(lambda batches: grown(batches, least, most), "lang string, words string, n long")
    found = found.groupBy("lang", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return stage(single.filter(F.col("n") >= least).unionByName(found), "patterns"), totals


def collocations(docs: DataFrame, least: int = 10, most: int = 3, scale: int = 1_000_000, inside: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language.

    A text is lower-cased in A to Z and cut at ``.,;:!?`` and line ends into pieces, these at spaces and tabs into
    words. Candidates are the phrases of 2 to ``most`` words with ``least`` occurrences (a) within pieces, overlaps
    included. A cut after some words gives l and r, the occurrences of both parts, and a score of
    floor(scale * a * a / (l * r)); the cut of the lowest score counts, the earliest of such. A candidate goes that
    lies in a longer one which has ``inside`` hundredths of its occurrences. The ``top`` first of each language
    stay: by score, then a, then bytes of the phrase.

    One pass counts words. The next projects occurrences: a pair with the words after it, equal ones of a round of
    texts as one. Each pair belongs to a bucket of about GROW_ROWS occurrences; a task takes buckets one after the
    other and extends the pairs with enough occurrences to the right. A pair that holds more than a share of 1 in
    SHARE is spread over all buckets and its parts are summed, so no task holds a crowded prefix; a prefix of one word
    is never gathered. Counts that a part must meet are joined by a
    shuffle, those of crowded words and pairs, fewer than 2 * SHARE, by a broadcast. Arithmetic is in decimals of
    38 digits: exact up to 10^15 occurrences of a phrase and a scale of 10^6.

    A null text has no words, a null language is ``und``. Rows count as often as they are repeated, whatever their
    ids; only lang and text are read. An empty table gives no rows.
    """
    counts, totals = patterns(docs, least, most)
    # A phrase has a space between its words, which hold none.
    candidates = counts.filter("contains(words, ' ')").withColumn("w", F.split("words", " "))
    span = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    shorter = F.array(*[
        F.when((F.size("w") > n) & (F.size("w") >= a + n - 1), span(a, n)) for n in range(2, most) for a in range(1, most - n + 2)
    ]) if most > 2 else F.array().cast("array<string>")
    longer = candidates.select("lang", F.explode(F.array_compact(shorter)).alias("words"), F.col("n").alias("longer"))
    own = candidates.select("lang", "words", "n", F.lit(None).cast("long").alias("longer"))
    kept = (
        own.unionByName(longer.withColumn("n", F.lit(None).cast("long")))
        .groupBy("lang", "words")
        .agg(F.max("n").alias("n"), F.max("longer").alias("longer"))
        .filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("n") * inside))
        .select("lang", F.col("words").alias("phrase"), F.col("n").alias("a"), F.split("words", " ").alias("w"))
    )
    cuts = [F.struct(F.lit(k).alias("k"), span(1, k).alias("left"), F.when(F.size("w") > k, F.array_join(F.slice("w", F.lit(k + 1), F.size("w")), " ")).alias("right")) for k in range(1, most)]
    cut = kept.select("lang", "phrase", "a", F.explode(F.filter(F.array(*cuts), lambda c: c["k"] < F.size("w"))).alias("c"))
    parts = cut.select("lang", "phrase", "a", "c.k", F.explode(F.array(F.struct(F.lit(True).alias("first"), F.col("c.left").alias("words")), F.struct(F.lit(False).alias("first"), F.col("c.right").alias("words")))).alias("p")).select("lang", "phrase", "a", "k", "p.first", "p.words")
    total = totals.agg(F.sum("total")).first()[0] or 0
    crowded = F.broadcast(counts.filter(F.col("n") * SHARE > total))
    met = parts.join(crowded, ["lang", "words"], "left")
    near = met.filter("n is not null")
    far = met.filter("n is null").drop("n").join(counts.hint("shuffle_merge"), ["lang", "words"])
    both = near.unionByName(far).groupBy("lang", "phrase", "k").agg(
        F.max("a").alias("a"), F.max(F.when(F.col("first"), F.col("n"))).alias("l"), F.max(F.when(~F.col("first"), F.col("n"))).alias("r")
    )
    scored = both.withColumn("score", F.expr(f"(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * cast({scale} as decimal(7,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    least_cut = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("m")).select("lang", "phrase", "m.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each part of a language first, so that no task sorts a whole language.
    some = least_cut.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    some = some.withColumn("nth", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("nth") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals.withColumnRenamed("total", "n")), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )


def sql() -> str:
    """DuckDB SQL of ``collocations(docs)`` over ``documents``, by counting all phrases."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
    ), worded AS (
        SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
    ), phrases AS (
        SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS words
        FROM worded, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(w) >= k
    ), counts AS (
        SELECT lang, k, words, count(*) AS n FROM phrases GROUP BY ALL
    ), totals AS (
        SELECT lang, sum(n)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang
    ), candidates AS (
        SELECT lang, k, words, n, string_split(words, ' ') AS w FROM counts WHERE k > 1 AND n >= 10
    ), longer AS (
        SELECT lang, part AS words, max(n) AS n FROM (
            SELECT lang, n, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM candidates WHERE k = 3
        ) GROUP BY ALL
    ), kept AS (
        SELECT c.* FROM candidates c LEFT JOIN longer b ON c.lang = b.lang AND c.words = b.words WHERE b.n IS NULL OR 100 * b.n < 50 * c.n
    ), cuts AS (
        SELECT lang, words, n, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS rest
        FROM kept, (VALUES (1), (2)) AS places(cut) WHERE cut < k
    ), scored AS (
        SELECT c.lang, c.words, c.n AS a, c.cut, h.n AS l, t.n AS r, (1000000::HUGEINT * c.n * c.n) // (h.n::HUGEINT * t.n) AS score
        FROM cuts c JOIN counts h ON c.lang = h.lang AND c.head = h.words JOIN counts t ON c.lang = t.lang AND c.rest = t.words
    ), chosen AS (
        SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, words) AS rank FROM chosen
    )
    SELECT lang, rank, words AS phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """
