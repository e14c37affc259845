"""Secret scans: candidate spans, judged by how many owners hold the same value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, row_key, stage

# The base rules' patterns and lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "opaque")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

#: The method's own kind: long runs outside the base spans.
OPAQUE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: A value that so many owners or repositories hold is a copied example; one of a single owner looks live in so many repositories at most.
COPIED_OWNERS, COPIED_REPOS, LIVE_REPOS = 3, 8, 2


def _found(text: Column, kind: int, pattern: str, group: int, good) -> Column:
    """One struct for each match: the text between it and the match before, its own length, whether it counts, its value's digest."""
    zipped = F.arrays_zip(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
    )
    made = F.transform(
        F.filter(zipped, lambda x: x["1"].isNotNull()),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("idx"),
            F.length(x["0"]).alias("gap"),
            F.length(x["1"]).alias("len"),
            good(x["2"]).alias("ok"),
            F.sha2(x["2"], 256).alias("digest"),
            (x["2"].rlike("[a-z]") & x["2"].rlike("[A-Z]") & x["2"].rlike("[0-9]") | x["2"].rlike("^[0-9A-F]{32,}$")).alias("mixed"),
        ),
    )
    return F.when(text.rlike(pattern), made)


def candidates(docs: DataFrame, owner: Column, repo: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each match (one with nulls for a document without any), without the matched text itself."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = [
        _found(text, 0, ASSIGN, 2, lambda v: F.length(v) >= ASSIGN_LEAST),
        _found(text, 1, ACCESS, 0, lambda v: F.length(v) >= ACCESS_LEAST),
        _found(text, 2, HEX, 0, lambda v: F.lit(True)),
        _found(text, 3, OPAQUE, 0, lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")),
    ]
    empty = F.from_json(F.lit("[]"), "array<struct<kind:int,idx:int,gap:int,len:int,ok:boolean,digest:string,mixed:boolean>>")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        row_key(id_col, text_col).alias("key"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repo.cast("string"), F.lit("")).alias("repo"),
        F.concat(*(F.coalesce(k, empty) for k in kinds)).alias("all"),
    )
    return rows.select("row_id", "key", "doc_id", "owner", "repo", F.explode_outer("all").alias("m")).select(
        "row_id", "key", "doc_id", "owner", "repo", "m.*"
    )


def ownership(found: DataFrame) -> DataFrame:
    """(digest, owners, repos, base) over the whole corpus; base: the base rules found the value somewhere."""
    return found.filter("ok").groupBy("digest").agg(
        F.count_distinct("owner").alias("owners"),
        F.count_distinct("repo").alias("repos"),
        F.max(F.col("kind") < 3).alias("base"),
    )


def judged(docs: DataFrame, owner: Column, repo: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, key, doc_id, kind, start, end, verdict) for each span; a row with a null kind for each document without one."""
    found = stage(candidates(docs, owner, repo, id_col, text_col), "candidates")
    known = stage(ownership(found), "ownership")
    verdict = (
        F.when((F.col("owners") >= COPIED_OWNERS) | (F.col("repos") >= COPIED_REPOS), "copied")
        .when((F.col("owners") == 1) & (F.col("repos") <= LIVE_REPOS), "live")
        .when(F.col("owners") >= 1, "shared")
    )
    met = found.filter("ok").join(known, "digest", "left").withColumn("verdict", verdict)
    rest = found.filter("ok is null or not ok").withColumns(
        {"owners": F.lit(None).cast("long"), "repos": F.lit(None).cast("long"), "base": F.lit(None).cast("boolean"), "verdict": F.lit(None).cast("string")}
    )
    rows = met.unionByName(rest).repartition("row_id")
    before = Window.partitionBy("row_id", "kind").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("len")).over(before)).withColumn("start", F.col("end") - F.col("len"))
    # The method's own spans stay out of base ones, so a run that a base span overlaps is dropped.
    rows = rows.filter("ok or kind is null or idx = 0")
    base_end = F.when(F.col("ok") & (F.col("kind") < 3), F.col("end"))
    base_start = F.when(F.col("ok") & (F.col("kind") < 3), F.col("start"))
    up = Window.partitionBy("row_id").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("row_id").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("base_end", F.max(base_end).over(up)).withColumn("base_start", F.min(base_start).over(down))
    clear = (F.coalesce("base_end", F.lit(0)) <= F.col("start")) & (F.coalesce("base_start", F.col("end")) >= F.col("end"))
    own = (F.col("kind") == 3) & clear & (F.col("verdict") != "copied") & (F.col("base") | F.col("mixed") & (F.col("verdict") == "live"))
    span = F.coalesce(F.col("ok") & ((F.col("kind") < 3) | own), F.lit(False))
    return rows.select("row_id", "key", "doc_id", *(F.when(span, F.col(c)).alias(c) for c in ("kind", "start", "end", "verdict")))


def scan(docs: DataFrame, owner: Column, repo: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: counts of base spans, their digest, all spans, and the verdicts' counts.

    Base spans come from the three fixed rules. Candidate values are hashed and their distinct owners
    and repositories counted over the corpus: a value that COPIED_OWNERS owners or COPIED_REPOS repositories
    hold is a copied example, one that a single owner holds in LIVE_REPOS repositories at most looks live, the
    rest is shared. Repositories need not lie within owners. The method adds spans of kind ``opaque``:
    long runs that the base rules did not cover, if the same value is a base candidate elsewhere, or if it
    mixes letters and digits and belongs to one owner. A null text is empty; documents without spans
    have zero counts, an empty ``spans`` and the digest of the empty string. Repeated rows and null ids
    keep one row each; null owners count as one owner. Only the named columns are read.
    """
    rows = judged(docs, owner, repo, id_col, text_col)
    names = F.array(*(F.lit(k) for k in KINDS))
    place = F.struct("start", "kind", "end")

    def joined(places: Column) -> Column:
        return F.array_join(F.transform(F.sort_array(places), lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")

    base = F.col("kind") < 3
    return (
        rows.groupBy("row_id", "doc_id")
        .agg(
            *(F.count_if(F.col("kind") == k).alias(f"n_{KINDS[k]}") for k in (0, 1, 2)),
            F.collect_list(F.when(base, place)).alias("base"),
            F.collect_list(F.when(F.col("kind").isNotNull(), place)).alias("all"),
            *(F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("live", "shared", "copied")),
        )
        .select(
            "doc_id",
            "n_assign",
            "n_access",
            "n_hex",
            F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
            joined(F.col("all")).alias("spans"),
            "n_live",
            "n_shared",
            "n_copied",
        )
    )


def redact(docs: DataFrame, owner: Column, repo: Column, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span that isn't a copied example masked in ``text``; ``n_chars``, where there is one, to match.

    Documents without a match pass unchanged and are not shuffled; the others meet their spans by ``row_key``, so rows
    that share a doc_id, or have none, each lose their own spans only. Null and empty texts stay as they are.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    hit = F.coalesce(text.rlike(ASSIGN) | text.rlike(ACCESS) | text.rlike(HEX) | text.rlike(OPAQUE), F.lit(False))
    rows = judged(docs, owner, repo).filter("kind is not null and verdict <> 'copied'")
    key, places = free_name(docs, "own_key"), free_name(docs, "own_spans")
    spans = stage(rows.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans")), "spans")
    some = docs.filter(hit).withColumn(key, row_key())
    some = some.join(spans.select(F.col("key").alias(key), F.col("spans").alias(places)), key, "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    folded = F.aggregate(
        places,
        start,
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))),
    )
    masked = some.withColumn("text", F.when(F.col(places).isNotNull(), folded).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col(places).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return docs.filter(~hit).unionByName(masked.select(*docs.columns))
