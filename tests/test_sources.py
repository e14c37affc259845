import datetime

import pytest
from pyspark.sql import functions as F

from quire.operators import chapters as C
from quire.operators import results as R
from quire.sources import files, staged
from quire.streaming import arrivals

LONG = "<h1>T</h1><p>" + "word " * 300


def test_files(spark, tmp_path):
    (tmp_path / "text" / "deep").mkdir(parents=True)
    (tmp_path / "text" / "a.xhtml").write_text(LONG)
    (tmp_path / "text" / "deep" / "b.html").write_bytes(b"<h1>\xff\xc3\xa9</h1>")
    (tmp_path / "style.css").write_text(".k{}")
    (tmp_path / "007.md").write_text("# Seven")
    (tmp_path / "007.failed.md").write_text("no")
    made = files.pages(spark, str(tmp_path), "mine")
    assert sorted((r.page_id, r.url) for r in made.collect()) == [(0, "file://mine/text/a.xhtml"), (1, "file://mine/text/deep/b.html")]
    assert {r.html for r in made.collect()} == {LONG, "<h1>�é</h1>"}
    assert [(r.title, r.words) for r in C.scan(made).orderBy("words").collect()] == [("\ufffdé", 1), ("T", 300)]
    assert [tuple(r) for r in files.stylesheets(spark, str(tmp_path)).collect()] == [("style.css", ".k{}")]
    assert [tuple(r) for r in files.chapters(spark, f"file://{tmp_path}").collect()] == [(7, "# Seven")]


def test_records(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "doc_id long, book string, detail string")
    for _ in range(2):
        files.write_records(rows, str(tmp_path / "out"), "book")
    back = spark.read.json(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.book, r.detail) for r in back.collect()) == [(1, "a", None), (2, "b", "x")]


def test_pages_are_in_the_order_of_their_paths(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"{k:02d}.xhtml").write_text("<p>x")
    made = files.pages(spark, str(tmp_path), "mine").collect()
    assert [r.url for r in sorted(made, key=lambda r: r.page_id)] == [f"file://mine/{k:02d}.xhtml" for k in range(40)]
    assert sorted(r.page_id for r in made) == list(range(40))


def test_records_of_others_stay(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, book string")
    files.write_records(rows, str(tmp_path / "out"), "book")
    files.write_records(rows.filter("book = 'b'").withColumn("doc_id", F.lit(3)), str(tmp_path / "out"), "book")
    assert sorted((r.doc_id, r.book) for r in spark.read.json(str(tmp_path / "out")).collect()) == [(1, "a"), (3, "b")]


def stream(spark, tmp_path, rows):
    folder = tmp_path / f"in{len(rows)}"
    schema = "page_id long, url string, html string, at timestamp"
    for k, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_streams(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 10, 30)
    rows = [(k, "https://a.example/x", LONG if k % 2 else "<p>short", at + datetime.timedelta(hours=k)) for k in range(6)]
    rows.append((9, None, None, at))
    pages = stream(spark, tmp_path, rows)
    query = arrivals.running_summary(pages).writeStream.outputMode("complete").format("memory").queryName("sums").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.status: (r.chapters, r.words_in) for r in spark.table("sums").collect()} == {"eligible": (3, 900), "skipped": (4, 3)}
    cache = spark.createDataFrame([(LONG,)], "html string").select(F.sha2("html", 256).alias("source_sha"))
    for known, want in ((cache, 0), (cache.limit(0), 3)):
        out = str(tmp_path / f"out{want}")
        arrivals.write(arrivals.unseen(pages, known).select("page_id"), out, str(tmp_path / f"check{want}")).awaitTermination(120)
        assert spark.read.schema("page_id long").parquet(out).count() == want


def test_hours_close(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 10, 30)
    rows = [(k, None, LONG, at + datetime.timedelta(minutes=20 * k)) for k in range(12)]
    out = str(tmp_path / "hours")
    arrivals.write(arrivals.arrivals_by_hour(stream(spark, tmp_path, rows), "at", "10 minutes"), out, str(tmp_path / "check")).awaitTermination(180)
    made = {(r.hour.hour, r.status): r.chapters for r in spark.read.parquet(out).collect()}
    assert made[10, "eligible"] == 2 and made[11, "eligible"] == 3


BLOCKS = "# T\n\n⟦PRE-1: x⟧ ⟦TITLE-1⟧ ⟦IMG-2⟧ " + "word " * 300


@pytest.mark.parametrize(
    ("body", "cached", "force", "wanted"),
    [
        ("⟦PRE-1: y⟧ ⟦IMG-2⟧", None, False, {"output": "body"}), ("⟦PRE-1: y⟧ ⟦IMG-2⟧", "⟦PRE-1⟧ ⟦IMG-2⟧", False, {"output": "cached"}), ("⟦PRE-1: y⟧ ⟦IMG-2⟧", "⟦PRE-1⟧ ⟦IMG-2⟧", True, {"output": "body"}),
        ("⟦PRE-1: y⟧", None, False, {"failed": "body"}), ("⟦PRE-12⟧ ⟦IMG-2⟧", "⟦PRE-1⟧ ⟦IMG-2⟧", True, {"failed": "body"}), ("⟦IMG-2⟧", "⟦PRE-1⟧", False, {"failed": "cached"}),
        ("⟦PRE-1: y⟧ ⟦IMG-2", None, False, {"failed": "body"}), ("⟦PRE-1: y⟧ ⟦IMG-2", "⟦PRE-1⟧ ⟦IMG-2⟧", True, {"failed": "body", "stale": "cached"}), (None, "⟦PRE-1⟧ ⟦IMG-2⟧", True, {"stale": "cached"}),
        (None, None, True, {}), ("⟦PRE-1", "⟦PRE-1", False, {"output": "cached", "failed": "body"}),
    ],
)
def test_evicted(spark, body, cached, force, wanted):
    whole = lambda t: t and "# T\n\n" + "word " * 300 + t
    texts = {"body": whole(body), "cached": whole(cached)}
    chapters = spark.createDataFrame([(1, BLOCKS, texts["body"])], "doc_id long, source string, body string")
    left = spark.createDataFrame([(1, "output", texts["cached"])] if cached else [], "doc_id long, kind string, text string")
    assert {r.kind: r.text for r in R.evicted(chapters, left, force).collect()} == {k: texts[v] for k, v in wanted.items()}
    assert {r.kind: r.text for r in R.evicted(chapters, left, force, rebuild=True).collect()} == ({"output": texts["cached"]} if cached else {})


def test_runs_leave_other_books_and_what_a_killed_run_found(spark, tmp_path):
    folder, schema = str(tmp_path / "left"), "book string, doc_id long, kind string, text string"
    files.write_records(spark.createDataFrame([("a", 1, "output", "old"), ("a", 2, "stale", "s"), ("b", 3, "output", "b's")], schema), folder, "book")
    chapters = spark.createDataFrame([(1, BLOCKS, "# T\n\n⟦PRE-1⟧⟦IMG-2⟧" + "new " * 300)], "doc_id long, source string, body string")

    def run(body=F.col("text")):
        left = files.records(spark, folder, schema).filter("book = 'a'").select("doc_id", "kind", "text")
        made = staged.staged(R.evicted(chapters, left), "left")
        files.write_records(made.select(F.lit("a").alias("book"), "doc_id", "kind", body.alias("text")), folder, "book")

    state = lambda: sorted((r.book, r.doc_id, r.kind, r.text[:7]) for r in files.records(spark, folder, schema).collect())
    before = state()
    with pytest.raises(Exception, match="killed"):
        run(F.when(F.col("doc_id") == 1, F.raise_error(F.lit("killed"))).otherwise(F.col("text")))
    assert state() == before
    run()
    after = state()
    assert after == [("a", 1, "output", "# T\n\n⟦P"), ("a", 2, "stale", "s"), ("b", 3, "output", "b's")]
    run()
    assert state() == after
