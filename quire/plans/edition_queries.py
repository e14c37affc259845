"""Queries over the editions of the pages and the chapters made of the documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import nodes as N
from ..functions import text as T
from ..operators import anchors as A
from ..operators import blocks as B
from ..operators import chapters as C
from ..operators import contents as K
from ..operators import guards as G
from ..operators import integrity as I
from ..operators import links as L
from ..operators import markdown as M
from ..operators import replies as Y
from ..operators import results as R
from ..operators import wrappers as W
from . import editions as E

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _source(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(E.source(_read(spark, sf_dir, "pages")))


def _output(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(E.output(_read(spark, sf_dir, "pages")))


def _both(make: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = _read(spark, sf_dir, "pages")
        return make(E.source(pages), E.output(pages))

    return run


def _chapters(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(E.fixes(_read(spark, sf_dir, "documents")))


def _columns(make: Callable[[Column, Column], dict[str, Column]]) -> Query:
    """A row for each chapter with the columns that ``make`` gives of its source and body."""
    return _chapters(lambda rows: rows.select("doc_id", *(c.alias(n) for n, c in make(F.col("source"), F.col("body")).items())))


def _sha(text: Column) -> Column:
    return F.sha2(text, 256)


def _fix(kind: str) -> Column:
    return F.struct(*(F.coalesce(F.col(f"{kind}_{n}"), F.lit("")).alias(n) for n in ("old", "new", "quote")))


def _split(rows: DataFrame) -> DataFrame:
    rows = rows.select("doc_id", M.opening_length(F.col("body")).alias("cut"), M.split_top(F.col("body")).alias("parts"))
    return rows.select("doc_id", "cut", _sha(F.col("parts.top")).alias("top"), _sha(F.col("parts.rest")).alias("rest"))


def _rejections(rows: DataFrame) -> DataFrame:
    source, body = F.col("source"), F.col("body")
    sentence, heading = _fix("sentence"), _fix("heading")

    def both(lines: Column) -> Column:
        why = T.named(M.split_top(body, lines)["top"], lambda t: M.rejection(t, source, sentence["old"], sentence["new"], sentence["quote"]))
        return F.struct(why.alias("sentence"), M.heading_rejection(body, source, heading["old"], heading["new"], heading["quote"], lines).alias("heading"))

    return rows.select("doc_id", T.named(M.heading_lines(body), both).alias("x")).select("doc_id", "x.*")


def _patched(rows: DataFrame) -> DataFrame:
    made = M.patched(F.col("source"), F.col("body"), F.array(_fix("sentence")), F.array(_fix("heading")))
    rows = rows.select("doc_id", made.alias("p"))
    return rows.select("doc_id", _sha(F.col("p.text")).alias("digest"), F.col("p.applied").alias("applied"), F.array_join("p.rejected", "; ").alias("rejected"))


def _headings(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.explode(M.headings(F.col("body"))).alias("h")).select("doc_id", "h.pos", "h.text")


def _results(rows: DataFrame) -> DataFrame:
    cache = rows.filter("doc_id % 5 <> 4").select("doc_id", "cached")
    return R.resumed(rows.select("doc_id", "source", "body"), cache)


def _evicted(force: bool) -> Callable[[DataFrame], DataFrame]:
    def run(rows: DataFrame) -> DataFrame:
        texts = F.array(*(F.when(F.expr(when), F.struct(F.lit(kind).alias("kind"), F.expr(text).alias("text"))) for kind, (text, when) in E.LEFT.items()))
        left = rows.select("doc_id", F.explode(F.array_compact(texts)).alias("x")).select("doc_id", "x.*")
        made = R.evicted(rows.filter(E.IN_RUN).select("doc_id", "source", "body"), left, force)
        return made.select("doc_id", "kind", _sha(F.col("text")).alias("digest"))

    return run


def _numbers(rows: DataFrame) -> DataFrame:
    made = M.with_section_numbers(F.col("source"), F.col("body"))
    rows = rows.select("doc_id", "body", made.alias("made"))
    return rows.select("doc_id", _sha(F.col("made")).alias("digest"), (F.col("made") != F.col("body")).alias("changed"))



def _opening(source: Column, body: Column) -> dict[str, Column]:
    opening = T.opening_line(body)
    return {"opening": opening, "titled": T.is_title(opening)}


def _tokens(source: Column, body: Column) -> dict[str, Column]:
    named = T.has_token(body, F.lit("PRE"), F.lit(1))
    return {"tokens": F.regexp_count(body, F.lit(T.TOKEN)), "unclosed": T.unclosed_token(body), "plain": _sha(T.strip_tokens(body)), "named": named}


def _banned(source: Column, body: Column) -> dict[str, Column]:
    return {"banned": F.array_join(T.banned(source, body), ","), "alone": F.array_join(T.banned(F.lit(""), body), ",")}


def _texts(source: Column, body: Column) -> dict[str, Column]:
    """What the other text functions make of a chapter, whose opening line is a column."""
    opening = F.col("opening")
    href = F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit(".html#"), T.slug(opening))
    said = F.concat(F.lit("> "), F.lit("\x1b[1m"), opening, F.lit("\x1b[0m"), F.lit("\n\n ▸ Credits: 0.1 Time: 9s\n"))
    return {
        "unescaped": _sha(T.unescaped_tokens(body)),
        "normal": _sha(T.normal(body)),
        "slug": T.slug(opening),
        "uid": T.contents_id(href),
        "reply": T.reply(said),
        "context": T.context(F.lit("The arc."), F.col("doc_id"), opening),
        "request": _sha(T.request(source, body)),
        "check": _sha(T.check_request(source, opening, F.transform(M.headings(body), lambda h: h["text"]))),
        "key": T.caption_key(opening),
        "shared": F.round(T.words_shared(source, body), 6),
        "jaccard": F.round(T.jaccard(opening, T.opening_line(source)), 6),
    }


def _navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.entries(E.navigation(_read(spark, sf_dir, "pages")))
    return rows.select("page_id", "book", "nav", "pre", "last", "depth", "class", "href", "label", "target", "sole")


def _rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The navigation of pages, a third of which are taken as rewritten; one of five of these has no headings."""
    pages = _read(spark, sf_dir, "pages")
    chosen = E.source(pages).filter(E.REWRITTEN)
    heads = B.contents(chosen.filter("page_id % 5 <> 0")).select("page_id", F.col("pos").alias("nth"), F.col("depth").alias("level"), F.expr("substring(href, 2)").alias("id"), "text")
    named = chosen.select("page_id", L.book().alias("book"), L.normal(L.path()).alias("path")).join(heads, "page_id", "left").drop("page_id")
    return K.rebuilt(E.navigation(pages), named)


def _continued(rows: DataFrame) -> DataFrame:
    rows = rows.select("doc_id", *(F.expr(p).alias(n) for p, n in zip(E.PIECES, ("first", "second"), strict=True)))
    made = T.continued(F.col("first"), F.col("second"))
    return rows.select("doc_id", _sha(made).alias("digest"), (F.length("first") + F.length("second") - F.length(made)).alias("repeated"))


def _anchors_restored(pages: DataFrame) -> DataFrame:
    rows = A.protected(pages).withColumn("html", F.expr(E.ANCHORED))
    rows = rows.select("page_id", A.restored(F.col("html"), F.col("anchors")).alias("x"))
    return rows.select("page_id", _sha(F.col("x.html")).alias("digest"), F.array_join("x.lost", " ").alias("lost"))


def _review(rows: DataFrame) -> DataFrame:
    rows = rows.select("doc_id", "source", "body", F.expr(E.LISTED).alias("listed"))
    rows = rows.select("doc_id", Y.fixes(F.expr(E.REVIEW)).alias("fixes"))
    parts = lambda f: F.concat_ws("|", *(F.coalesce(f[n], F.lit("-")) for n in ("sentence", "heading", "replacement", "source", "problem")))
    return rows.select("doc_id", F.col("fixes").isNotNull().alias("found"), F.coalesce(F.size("fixes"), F.lit(0)).alias("n"), _sha(F.coalesce(F.array_join(F.transform("fixes", parts), "\n"), F.lit(""))).alias("digest"))


def _events(rows: DataFrame) -> DataFrame:
    """(reply_id, seq, line): a chapter in two pieces as the events of a reply, or as plain lines."""
    rows = rows.select("doc_id", *(F.expr(p).alias(n) for n, p in zip(("first", "second"), E.PIECES, strict=True)))
    lines = F.when(F.expr(E.PLAIN_REPLY), F.array(F.lit(" plain "), F.col("first"))).otherwise(F.array(*(F.expr(e) for e in E.EVENTS)))
    return rows.select(F.col("doc_id").alias("reply_id"), F.posexplode(lines).alias("seq", "line"))


def _replies(rows: DataFrame) -> DataFrame:
    return Y.gathered(_events(rows)).select(F.col("reply_id").alias("doc_id"), F.length("reply").alias("chars"), _sha(F.col("reply")).alias("digest"))


def _ill_formed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    made = I.pages_changed(E.xhtml(pages, 0), E.xhtml(pages, 1), pages.select("page_id").limit(0))
    return made.filter("kind = 'not well-formed XHTML'").select("page_id", "level", "place")


def _wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return W.restored(E.wrapped(pages, 0), E.wrapped(pages, 1)).select("page_id", _sha(F.col("html")).alias("digest"), "restored")


def queries() -> dict[str, Query]:
    return {
        "opening_lines_marked": _columns(_opening),
        "token_scan_marked": _columns(_tokens),
        "banned_words_marked": _columns(_banned),
        "body_problem_marked": _columns(lambda source, body: {"problem": G.body_problem(source, body)}),
        "revision_guard_marked": _columns(lambda source, body: {"problem": G.revision_problem(source, source, body)}),
        "cache_upgrade_marked": _columns(lambda source, body: {"upgraded": _sha(G.upgraded(source, F.col("cached")))}),
        "chapter_texts": _chapters(
            lambda rows: rows.withColumn("opening", T.opening_line(F.col("body"))).select("doc_id", *(c.alias(n) for n, c in _texts(F.col("source"), F.col("body")).items()))
        ),
        "md_headings": _chapters(_headings),
        "md_split_top": _chapters(_split),
        "section_numbers": _chapters(_numbers),
        "fix_rejections": _chapters(_rejections),
        "fixes_applied": _chapters(_patched),
        "run_results": _chapters(_results),
        "run_evictions": _chapters(_evicted(False)),
        "run_evictions_forced": _chapters(_evicted(True)),
        "run_summary": _chapters(lambda rows: R.run_summary(_results(rows))),
        "chapter_scan_marked": _output(C.scan),
        "chapter_classify_marked": _source(lambda p: C.classified(p).select("page_id", "title", "words", "is_contents", "is_reference", "is_matter", "passthrough")),
        "link_resolve_marked": _output(L.checked),
        "anchors_referenced": _source(L.referenced),
        "anchors_protected": _source(lambda p: A.protected(p).select("page_id", _sha(F.col("html")).alias("digest"), F.array_join("anchors", " ").alias("anchors"))),
        "anchors_restored": _source(_anchors_restored),
        "page_ids": _source(lambda p: p.select("page_id", F.explode(H.found(F.col("html"), H.IDS)).alias("id"))),
        "stylesheet_refs": _output(L.stylesheets),
        "style_classes": _source(lambda p: p.select(L.book().alias("book"), F.explode(H.style_classes(F.col("html"))).alias("class")).distinct()),
        "tags_lost": _both(lambda s, o: L.fewer_tags(s.join(o.select("page_id"), "page_id", "left_semi"), o)),
        "duplicate_ids_marked": _output(L.duplicate_ids),
        "heading_jumps_marked": _output(lambda p: N.with_tree(p.select("page_id", "html")).select("page_id", N.heading_jumps(F.col("tree")).alias("jumps"))),
        "nav_entries": _navigation,
        "nav_rebuilt": _rebuilt,
        "replies_continued": _chapters(_continued),
        "reply_fixes": _chapters(_review),
        "reply_events": _chapters(_replies),
        "ill_formed_pages": _ill_formed,
        "page_nodes": _source(N.rows),
        "page_wrappers": _output(lambda p: N.with_tree(p.select("page_id", "html")).select("page_id", F.posexplode(N.wrappers(F.col("tree"))).alias("level", "wrapper"))),
        "leads_restored": _both(lambda s, o: B.leads_restored(s, o).select("page_id", _sha(F.col("html")).alias("digest"), "restored")),
        "wrappers_restored": _wrappers,
        "spine_changes": _both(I.spine),
        "resources_lost": _both(I.resources_lost),
        "page_findings": _both(I.pages_changed),
        "untouched_findings": _both(lambda s, o: I.pages_changed(s, o, C.classified(s).filter(C.selected()).select("page_id"))),
        "links_broken": _both(I.links_broken),
        "nav_unresolved": _output(I.entries_unresolved),
        "nav_entries_lost": _both(I.entries_lost),
        "findings_summary": _both(lambda s, o: I.summary(I.verify(s, o), o)),
        "findings_report": _both(lambda s, o: I.report(I.verify(s, o))),
        "listings_matched": _both(B.matched_listings),
        "link_classes": _both(B.link_classes),
        "section_leads": _source(B.section_leads),
        "captions": _source(B.captions),
        "captions_rewritten": _both(B.captions_rewritten),
        "callouts": _source(B.callouts),
        "note_candidates": _both(B.note_candidates),
        "kept_notes": _both(B.notes_kept),
        "contents_groups": _source(B.contents),
    }
