"""Quality rules: base measures of each text, and the log-likelihood ratio of its hashed n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stage

# Fixed values of the base rules.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30

#: Buckets of the two multinomials: a power of two, at least one for so many documents, from the first to the last of these.
#: The last bounds what is broadcast (four bytes each); beyond 67 million documents, more n-grams share a bucket.
DOCUMENTS, LEAST_BUCKETS, MOST_BUCKETS = 16, 1 << 14, 1 << 22
#: Weights are put together from rows of so many buckets.
ROW = 1 << 10
#: Added to each raw bucket's count; the target is smoothed by as many n-grams of the raw corpus as there are buckets.
RAW_PRIOR = 1
#: Millionths of a nat for each n-gram: a document below this is dropped.
LEAST_SCORE = -150_000

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _repeated(w: Column) -> Column:
    """Words within windows of WINDOW words that stand twice or more in the text."""

    def covered(starts: Column) -> Column:
        following = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.lit(1 << 30)))
        return F.aggregate(F.zip_with(starts, following, lambda a, b: F.least(F.lit(WINDOW), b - a)), F.lit(0), lambda a, b: a + b)

    def twice(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marked(p: Column) -> Column:
            left = F.concat(F.array(F.lit(None).cast("long")), F.slice(p["h"], 1, F.size(p) - 1))
            right = F.concat(F.slice(p["h"], 2, F.size(p) - 1), F.array(F.lit(None).cast("long")))
            near = F.zip_with(left, right, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
            both = F.zip_with(p, near, lambda x, y: F.when(x["h"].eqNullSafe(y["a"]) | x["h"].eqNullSafe(y["b"]), x["i"]))
            return covered(F.array_sort(F.array_compact(both)))

        return let(placed, marked)

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), twice(hashes)).otherwise(0)

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))

    made = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(windows(h), counted))
    return F.when(F.size(w) > WINDOW, made).otherwise(0)


def base(text: Column) -> Column:
    """The base measures of a text that is not null, as a struct."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    dup = F.when(F.instr(text, "\n") > 0, let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).otherwise(0)
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
            dup.cast("long").alias("n_dup_lines"),
            _repeated(w).cast("long").alias("n_repeat_words"),
        ),
    )


def buckets_for(documents: int) -> int:
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << max(0, -(-documents // DOCUMENTS) - 1).bit_length()))


def buckets(text: Column, size: int) -> Column:
    """The buckets of a text's single tokens and pairs of neighbours; tokens are runs of letters and digits, or of other signs."""
    hashed = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))

    def made(h: Column) -> Column:
        follow = F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0)))
        single = F.transform(h, lambda x: F.pmod(x, F.lit(size)).cast("int"))
        paired = F.zip_with(F.slice(h, 1, F.size(follow)), follow, lambda x, y: F.pmod(F.xxhash64(x, y), F.lit(size)).cast("int"))
        return F.concat(single, paired)

    return let(hashed, made)


def weights(docs: DataFrame, trusted: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row with ``table``: millionths of ln(target / raw) for each of ``size`` buckets.

    The raw multinomial counts every document, the target every one that ``trusted(doc_id)`` names. The two
    meet in a shuffled join, so nothing that grows with the input is broadcast; rows with a null id are never
    trusted and stay out of it. The driver gets the sums of the two.
    """
    ids = trusted.select(F.col("doc_id").alias("_trusted")).filter("_trusted is not null").distinct().hint("shuffle_hash")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    named = rows.filter("_id is not null").join(ids, F.col("_id") == F.col("_trusted"), "left")
    rows = named.select("_text", "_trusted").unionByName(rows.filter("_id is null").select("_text"), allowMissingColumns=True)
    counts = rows.select(F.col("_trusted").isNotNull().alias("t"), F.explode(buckets(F.col("_text"), size)).alias("b"))
    counts = stage(counts.groupBy("b").agg(F.count("*").alias("raw"), F.count_if("t").alias("target")), "buckets")
    sums = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("target"), F.lit(0)).alias("target")).first()
    every = docs.sparkSession.range(size).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left")
    share = (F.coalesce("raw", F.lit(0)) + RAW_PRIOR) / F.lit(float(sums["raw"] + RAW_PRIOR * size))
    ratio = (F.coalesce("target", F.lit(0)) + size * F.col("share")) / F.lit(float(sums["target"] + size)) / F.col("share")
    every = every.withColumn("share", share).withColumn("w", F.round(1e6 * F.ln(ratio)).cast("int"))
    lines = every.groupBy(F.floor(F.col("b") / ROW).alias("line")).agg(F.array_sort(F.collect_list(F.struct("b", "w"))).alias("ws"))
    table = lines.select("line", F.col("ws.w").alias("ws")).agg(F.array_sort(F.collect_list(F.struct("line", "ws"))).alias("lines"))
    return table.select(F.flatten("lines.ws").alias("table"))


def judge(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_score: int = LEAST_SCORE) -> DataFrame:
    """doc_id, the base measures, base_failed, score and kept for each row of ``docs``.

    score is the mean log-likelihood ratio of the text's hashed one- and two-token n-grams, trusted target
    against raw corpus, in millionths of a nat (whole numbers, so every run gives the same verdict); null
    without an n-gram. kept is false if the base rules fail, else whether score >= least_score. The buckets that n-grams are
    hashed to grow with the number of documents (``buckets_for``). A null text
    has no words and fails the base rules, as does an empty one. Repeated rows and null ids keep one row
    each. With no trusted row at all every score is zero. Only the named columns are read.
    """
    size = buckets_for(docs.count())
    table = stage(weights(docs, trusted, size, id_col, text_col), "weights").scalar()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("table", table)

    def total(b: Column) -> Column:
        return F.struct(F.aggregate(b, F.lit(0).cast("long"), lambda acc, x: acc + F.col("table")[x]).alias("sum"), F.size(b).alias("n"))

    rows = rows.select("doc_id", base(F.col("text")).alias("m"), let(buckets(F.col("text"), size), total).alias("s"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    score = F.when(F.col("s.n") > 0, F.floor(F.col("s.sum") / F.col("s.n")).cast("long"))
    out = rows.select("doc_id", "m.*", "s").withColumn("base_failed", failed).withColumn("score", score).drop("s")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= least_score, F.lit(False)))
