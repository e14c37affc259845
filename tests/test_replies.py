import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import replies as R
from quire.streaming import arrivals


def read(reply):
    """The list in the first object that has one, by trying to read an object at every brace."""
    for start in [k for k, sign in enumerate(reply) if sign == "{"]:
        try:
            made, _ = json.JSONDecoder().raw_decode(reply, start)
        except ValueError:
            continue
        if isinstance(made.get("fixes"), list):
            return made["fixes"]
    return None


def lists(spark, replies):
    rows = spark.createDataFrame(list(enumerate(replies)), "k int, reply string").select("k", R.json_list(F.col("reply"), "fixes").cast("array<string>").alias("x"))
    return [r.x for r in rows.orderBy("k").collect()]


SOUND = '{"fixes": [{"sentence": "A.", "replacement": "B."}, {"sentence": 3}]}'


def test_lists_of_replies(spark):
    replies = [
        f"Here:\n```json\n{SOUND}\n```", "no object", "", None, '{"fixes": "none"} and ' + SOUND, '{"fixes": [{"sentence": "cut', '{"fixes": [{"sentence": "cut {"} then ' + SOUND,
        'Use {x}, a 5" pipe } and \\{"fixes": ["p"]}', '{"a": "}{\\"", "b": "\\\\", "fixes": ["q"]}', '{"other": [{"fixes": ["in"]}], "fixes": 1}', '{"a": {"fixes": ["in"]}, "fixes": ["out"]}',
        '{"a": "\\"fixes\\": [1]"}', '{"note": "a \\"fixes\\": [ b"} {"fixes" : \n ["c"]}', '"{" {"fixes": ["d"]}', '{"fixes": ["e"]', '𝄞é {"fixes": ["é𝄞"]} x', '{"fixes": []} {"fixes": ["later"]}',
    ]
    made = lists(spark, replies)
    wanted = [None if r is None else read(r) for r in replies]
    assert [x if x is None else len(x) for x in made] == [x if x is None else len(x) for x in wanted]
    assert [x for x in made if x and x[0] in ("p", "q", "in", "out", "c", "d", "é𝄞")] == [x for x in wanted if x and isinstance(x[0], str)]


def test_lists_of_random_replies(spark):
    draw = random.Random(5)
    parts = ['"fixes"', '"fixes": ["a"]', '"b": 1', "{", "}", "{", "}", '"', ",", "\\", '"x{"', '"y}"', ": ", "[", "]", ' {"fixes": [1, 2]} ', "é", "\n", '\\"', '{"k": ']
    replies = ["".join(draw.choices(parts, k=draw.randrange(1, 14))) for _ in range(3000)]
    wanted = [read(r) for r in replies]
    assert sum(x is not None for x in wanted) > 300
    assert [x and len(x) for x in lists(spark, replies)] == [x and len(x) for x in wanted]


def test_long_replies(spark):
    many = 100_000
    replies = ["{" * many + SOUND, '"' * (many + 1) + SOUND, "}" * many + SOUND, '{"a":' * many + SOUND, "\\" * many + SOUND, "x" * 10 * many + SOUND, '"fixes": [' * many]
    assert [x and len(x) for x in lists(spark, replies)] == [2, 2, 2, 2, 2, 2, None]


def test_fixes(spark):
    listed = [
        {"sentence": "A.", "replacement": "B.", "source": "C", "problem": None}, {"sentence": 3, "replacement": "x"}, {"sentence": " \t", "heading": "H", "replacement": ""}, {"sentence": " ", "replacement": "x"},
        {"heading": "H", "replacement": 4}, 5, None, "s", [], {"heading": "H"},
    ]
    rows = spark.createDataFrame([(json.dumps({"fixes": listed}),), ("none",), (None,)], "reply string").select(R.fixes(F.col("reply")).alias("f")).collect()
    assert [tuple(f) for f in rows[0].f] == [("A.", None, "B.", "C", None), (" \t", "H", "", None, None)]
    assert rows[1].f is None and rows[2].f is None


def said(text, message=None, kind="text"):
    return json.dumps({"type": "assistant", "message": {"id": message, "content": [{"type": kind, "text": text}]}})


@pytest.mark.parametrize(
    ("lines", "reply"),
    [
        ([said("one\ntwo\nthr", "a"), said("two\nthree", "b"), json.dumps({"type": "result", "is_error": False})], "one\ntwo\nthree"),
        ([said("one", "a"), said("X", "b", "tool_use"), said(" two", "a"), said("three ", "c")], "one twothree"),
        ([said("one"), said("two")], "onetwo"), ([said("one", "a"), json.dumps({"type": "result", "is_error": True})], ""),
        (["plain", " text "], "plain\n text"), (["plain", "3", "[]", said("one", "a"), said("two", "a") + " x"], "one"), ([], ""), (None, ""), ([None, said("one", "a")], "one"),
        ([json.dumps({"type": "assistant"}), json.dumps({"type": "assistant", "message": {"content": None}})], ""), ([said("é𝄞", "a"), said("", "b"), said("z", "c")], "é𝄞z"),
    ],
)
def test_replies_of_events(spark, lines, reply):
    rows = spark.createDataFrame([(lines,)], "lines array<string>")
    assert rows.select(R.of_lines(F.col("lines"))).first()[0] == reply
    if lines and None not in lines:
        assert rows.select(R.of_output(F.array_join("lines", "\n"))).first()[0] == reply


def test_gathered(spark):
    rows = [(2, 1, said("b", "n")), (1, 2, said("two\nthree", "m2")), (1, 1, said("one\ntwo", "m1")), (3, 1, "plain"), (None, 1, said("none", "m"))]
    made = R.gathered(spark.createDataFrame(rows, "reply_id long, seq int, line string")).collect()
    assert {r.reply_id: r.reply for r in made} == {1: "one\ntwo\nthree", 2: "b", 3: "plain", None: "none"}
    assert R.gathered(spark.createDataFrame([], "reply_id long, seq int, line string")).count() == 0


def test_replies_of_a_stream(spark, tmp_path):
    """Events come in any order; a reply is told once it has been quiet; what comes after that is too late."""
    at = datetime.datetime(2024, 1, 1, 10)
    minute = lambda n: at + datetime.timedelta(minutes=n)
    rows = [
        (1, 2, said("two\nthree", "b"), minute(1)), (2, 1, said("other", "a"), minute(1)), (1, 1, said("one\ntwo", "a"), minute(0)), (1, 3, said(" end", "b"), minute(2)),
        (3, 1, said("far", "a"), minute(60)), (4, 1, said("open", "a"), minute(61)), (1, 0, said("late", "a"), minute(1)), (5, 1, said("x", "a"), minute(62)),
    ]
    schema = "reply_id long, seq int, line string, at timestamp"
    folder = str(tmp_path / "in")
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(folder)
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    for _ in range(2):  # a run that goes on from where the one before it ended tells nothing twice
        arrivals.write(arrivals.replies(events, "at", "5 minutes", "3 minutes"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(180)
    made = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.reply_id, r.reply) for r in made) == [(1, "one\ntwo\nthree end"), (2, "other")]
