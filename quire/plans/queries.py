"""The registered queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..operators import chapters as C
from ..operators import guards as G
from ..operators import links as L
from ..sources.staged import staged
from . import edition_queries, edition_sql, sql


REPLIES = ("user", "assistant")
CLASSES = ("page_id", "title", "words", "is_contents", "is_reference", "is_matter", "passthrough")


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over(name: str, make: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: make(_table(name)(spark, sf_dir))


def _documents(**columns: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    """One row for each document, with columns made of its text."""
    return _over("documents", lambda docs: docs.select("doc_id", *(make(F.col("text")).alias(n) for n, make in columns.items())))


def _pairs(roles: tuple[str, str] = ("assistant", "user"), **columns: Callable[[Column, Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    """One row for each pair of turns of these roles, with columns made of its source and output."""
    return _over(
        "conversations",
        lambda rows: G.turns(rows, *roles).select("conv_id", "turn", *(make(F.col("source"), F.col("output")).alias(n) for n, make in columns.items())),
    )


def _cache_misses(pages: DataFrame) -> DataFrame:
    """Selected chapters that a cache of the shorter ones lacks."""
    wanted = C.classified(pages).filter(C.selected()).select("page_id", "title", "words", F.sha2("html", 256).alias("source_sha"))
    wanted = staged(wanted, "wanted")
    cache = wanted.filter(F.col("words") < 2 * C.MIN_WORDS).select("source_sha")
    return C.missing_from_cache(wanted, cache).select("page_id", "title")


def _nav_lost(pages: DataFrame) -> DataFrame:
    """Link targets of all pages that no selected page leads to."""
    return L.lost(pages, C.classified(pages).filter(C.selected()).select("page_id", "url", "html"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "chapter_scan": _over("pages", C.scan),
        "chapter_classify": _over("pages", lambda p: C.classified(p).select(*CLASSES)),
        "rewrite_select": _over("pages", lambda p: C.classified(p).filter(C.selected()).select("page_id", "title", "words")),
        "results_summary": _over("pages", lambda p: C.summary(C.results(C.classified(p)))),
        "primer_excerpts": _over("pages", lambda p: C.excerpts(C.classified(p))),
        "length_contract": _over(
            "pages",
            lambda p: C.classified(p).filter(C.selected()).select("page_id", *(c.alias(n) for n, c in T.length_contract(F.col("words")).items())),
        ),
        "source_digests": _over("pages", lambda p: p.select("page_id", F.substring(F.sha2("html", 256), 1, 8).alias("digest"))),
        "cache_misses": _over("pages", _cache_misses),
        "word_counts": _documents(words=T.word_count),
        "opening_lines": _documents(opening=T.opening_line, titled=lambda t: T.is_title(T.opening_line(t))),
        "token_scan": _documents(tokens=lambda t: F.regexp_count(t, F.lit(T.TOKEN)), unclosed=T.unclosed_token, plain_chars=lambda t: F.length(T.strip_tokens(t))),
        "banned_words": _documents(banned=lambda t: F.array_join(T.banned(F.lit(""), t), ",")),
        "markdown_residue": _documents(marks=T.residue),
        "shown_measures": _over(
            "documents", lambda d: d.select("doc_id", T.human_size(F.col("n_chars") * 640).alias("size"), T.human_time(F.col("n_chars")).alias("time"))
        ),
        "sane_pairs": _pairs(sane=G.sane),
        "ratio_pairs": _pairs(words_in=lambda a, b: T.word_count(a), words_out=lambda a, b: T.word_count(b), ratio=lambda a, b: T.percent(G.share(a, b))),
        "sane_replies": _pairs(REPLIES, sane=G.sane),
        "ratio_replies": _pairs(
            REPLIES, words_in=lambda a, b: T.word_count(a), words_out=lambda a, b: T.word_count(b), ratio=lambda a, b: T.percent(G.share(a, b))
        ),
        "body_problem_pairs": _pairs(problem=G.body_problem),
        "evidence_containment": _pairs(held=lambda a, b: G.evidence_held(a, T.opening_line(b))),
        "link_extract": _over("pages", lambda p: L.extracted(p).select("page_id", "kind", "pos", "ref")),
        "link_resolve": _over("pages", L.checked),
        "nav_lost": _over("pages", _nav_lost),
        "tag_counts": _over("pages", L.tag_counts),
        "duplicate_ids": _over("pages", L.duplicate_ids),
        "heading_jumps": _over("pages", lambda p: p.select("page_id", H.heading_jumps(F.col("html")).alias("jumps"))),
        "revision_guard": _pairs(problem=lambda a, b: G.revision_problem(a, a, b)),
        "cache_upgrade": _pairs(upgraded=G.upgraded),
    } | edition_queries.queries()


def oracle_sql() -> dict[str, str]:
    return sql.QUERIES | edition_sql.QUERIES
