import json
import random
import time

import duckdb
from pyspark.sql import functions as F

from quire.llm import tool_calls as tc

TOOLS = {
    "tools": [
        {
            "name": "add",
            "parameters": {
                "required": ["a", "b"],
                "additionalProperties": False,
                "properties": {"a": {"type": "number"}, "b": {"type": "integer"}, "unit": {"type": "string", "enum": ["cm", "in"]}},
            },
        }
    ]
}


def rows(spark, data):
    data = [(c, t, r, x if isinstance(x, str | None) else json.dumps(x), 1, "u") for c, t, r, x in data]
    made = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, slot int, call_id string")
    return sorted(tc.link(made).collect(), key=lambda r: (r.conv_id or -1, r.slot, r.depth, r.turn, r.nth, r.json))


def call(id_, name="add", args='{"b":1,"a":2.5}', needs=None):
    return {"id": id_, "name": name, "arguments": args, "depends_on": needs or []}


def test_links_in_topological_order(spark):
    out = rows(
        spark,
        [
            (1, 0, "system", TOOLS),
            (1, 1, "user", 'add "these"\n'),
            (1, 2, "assistant", {"content": "wait", "tool_calls": [call("y", args='{"a": "${call:x}", "b": 3}'), call("x")]}),
            (1, 3, "tool", {"tool_call_id": "x", "content": '{"sum": 3.5, "at": [1]}'}),
            (1, 4, "tool", {"tool_call_id": "y", "content": "plain"}),
            (1, 5, "tool", {"tool_call_id": "z", "content": "lost"}),
            (2, 0, "assistant", {"tool_calls": [call("x", args="{bad")]}),
        ],
    )
    calls = [r for r in out if r.kind == "call" and r.conv_id == 1]
    assert [(r.call_id, r.depth) for r in calls] == [("x", 0), ("y", 1)]
    assert calls[0].json == '{"arguments":{"a":2.5,"b":1},"call":"x","name":"add","result":{"at":[1],"sum":3.5}}'
    assert calls[0].problems == []
    assert calls[1].problems == ["not a number: a"] and json.loads(calls[1].json)["result"] == "plain"
    said = [json.loads(r.json) for r in out if r.kind == "message" and r.conv_id == 1]
    assert {"content": 'add "these"\n', "role": "user"} in said and {"content": "wait", "role": "assistant"} in said
    assert [(r.call_id, r.problems) for r in out if r.kind == "orphan"] == [("z", ["no call"])]
    other = [r for r in out if r.conv_id == 2]
    assert [r.problems for r in other] == [["no schema", "no result"]]


def test_schema_problems(spark):
    args = ['{"a":1}', '{"a":1,"b":1.5,"c":1}', '{"a":1,"b":1,"unit":"km"}', '[1]', '{"a":1,"b":true,"unit":"cm"}', None]
    data = [(1, 0, "system", TOOLS), (1, 1, "assistant", {"tool_calls": [call(f"c{k}", args=a) for k, a in enumerate(args)]})]
    data += [(1, 2, "tool", {"tool_call_id": f"c{k}", "content": "1"}) for k in range(len(args))]
    out = {r.call_id: r.problems for r in rows(spark, data) if r.kind == "call"}
    assert out == {
        "c0": ["missing b"],
        "c1": ["not a integer: b", "unknown c"],
        "c2": ["not listed: unit"],
        "c3": ["arguments aren't an object"],
        "c4": ["not a integer: b"],
        "c5": ["missing a", "missing b"],
    }


def test_cycles_and_repeats(spark):
    loop = [call("p", needs=["q"]), call("q", needs=["p"]), call("r", needs=["q"]), call("s", needs=["none"]), call("s")]
    chain = [call(f"n{k}", needs=[f"n{k - 1}"] if k else None) for k in range(5)]
    made = rows(spark, [(1, 0, "assistant", {"tool_calls": loop}), (2, 0, "assistant", {"tool_calls": chain[::-1]}), (3, 0, "assistant", {"tool_calls": chain})])
    out = {(r.conv_id, r.call_id): r for r in made}
    assert [out[1, c].depth for c in "pqrs"] == [-1, -1, -1, 0]
    assert "cycle" in out[1, "p"].problems and "repeated id" in out[1, "s"].problems and "cycle" not in out[1, "s"].problems
    assert [out[2, f"n{k}"].depth for k in range(5)] == [0, 1, 2, 3, 4]
    assert [(out[3, f"n{k}"].depth, out[3, f"n{k}"].nth) for k in range(5)] == [(0, k) for k in range(5)]  # the written order will do
    assert len(made) == 15


def test_every_call_has_a_row(spark):
    nested = {"id": "x", "type": "function", "function": {"name": "add", "arguments": {"b": 1, "a": 2}}}
    out = rows(
        spark,
        [
            (1, 0, "system", TOOLS | {"content": "hello"}),
            (1, 1, "assistant", {"tool_calls": [nested]}),
            (1, 2, "tool", {"tool_call_id": "x", "content": "first"}),
            (1, 2, "tool", {"tool_call_id": "x", "content": "first again"}),
            (1, 5000, "assistant", {"tool_calls": [nested, call(None)]}),
            (1, 9000, "tool", {"tool_call_id": "x", "content": "second"}),
            (None, 0, "assistant", {"tool_calls": [call("x")]}),
            (None, 1, "tool", {"tool_call_id": "x", "content": "of no conversation"}),
        ],
    )
    calls = [(r.conv_id, r.turn, r.call_id, json.loads(r.json)["result"], r.problems) for r in out if r.kind == "call"]
    assert sorted(calls, key=str) == sorted(
        [
            (1, 1, "x", calls[[c[1] for c in calls].index(1)][3], ["repeated id"]),
            (1, 5000, "x", "second", ["repeated id"]),
            (1, 5000, None, None, ["no id", "no result"]),
            (None, 0, "x", None, ["no schema", "no result"]),
        ],
        key=str,
    )
    assert {c[3] for c in calls if c[1] == 1} <= {"first", "first again"}
    assert sum(r.kind == "orphan" for r in out) == 2 and [r.json for r in out if r.kind == "message"] == ['{"content":"hello","role":"system"}']


def brute(data):
    """(conv, turn, nth, id, result, depth class) of each call: linked by a scan of the conversation, settled by repeated passes."""
    out = []
    for conv in sorted({c for c, *_ in data}):
        events = sorted((t, n, r, json.loads(x)) for n, (c, t, r, x) in enumerate(data) if c == conv)
        calls, results = [], {}
        for t, n, role, x in sorted(events, key=lambda e: (e[0], e[2] != "assistant", e[1])):
            if role == "assistant":
                calls += [((t, k), c) for k, c in enumerate(x["tool_calls"])]
            else:
                own = [p for p, c in calls if c["id"] == x["tool_call_id"]]
                if own and own[-1] not in results:
                    results[own[-1]] = x["content"]
        needs = {}
        for place, c in calls:
            needs[place] = set()
            for need in c["depends_on"]:
                before, all_ = [p for p, d in calls if d["id"] == need and p < place], [p for p, d in calls if d["id"] == need]
                if all_:
                    needs[place].add(before[-1] if before else all_[0])
        done, more = set(), True
        while more:
            more = [p for p in needs if p not in done and needs[p] <= done]
            done |= set(more)
        out += [(conv, *place, c["id"], results.get(place), place in done, frozenset(needs[place])) for place, c in calls]
    return out


def test_random_conversations_against_brute_force(spark):
    rng = random.Random(5)
    data = []
    for conv in range(12):
        for turn in range(rng.randrange(2, 9)):
            if rng.random() < 0.6:
                made = [call(f"c{rng.randrange(6)}", needs=[f"c{rng.randrange(7)}" for _ in range(rng.randrange(3))]) for _ in range(rng.randrange(1, 4))]
                data.append((conv, turn, "assistant", json.dumps({"tool_calls": made})))
            else:
                data.append((conv, turn, "tool", json.dumps({"tool_call_id": f"c{rng.randrange(6)}", "content": f"r{turn}"})))
    want = brute(data)
    got = {(r.conv_id, r.turn, r.nth): r for r in rows(spark, data) if r.kind == "call"}
    assert len(got) == len(want) == len({w[:3] for w in want})
    for conv, turn, nth, id_, result, settled, needs in want:
        r = got[conv, turn, nth]
        assert (r.call_id, json.loads(r.json)["result"], r.depth >= 0) == (id_, result, settled)
        if settled:
            key = lambda x: (x.slot, x.depth, x.turn, x.nth)
            assert all(key(got[conv, *n]) < key(r) for n in needs)
    assert any(r.depth > 0 for r in got.values()) and any(r.depth < 0 for r in got.values())


def test_chains_of_a_thousand(spark):
    """Needs against the written order, over two blocks of turns; a tail of later calls, and calls before a cycle."""
    n = 1000
    back = [(1, 2 * k, "assistant", {"tool_calls": [call(f"b{k}", needs=[f"b{k + 1}"])]}) for k in range(n)]
    tail = [(1, 2 * (n + k), "assistant", {"tool_calls": [call(f"t{k}", needs=[f"t{k - 1}" if k else "b0"])]}) for k in range(n)]
    stuck = [(2, k, "assistant", {"tool_calls": [call(f"c{k}", needs=[f"c{min(k + 1, n - 1)}"])]}) for k in range(n)]
    began = time.perf_counter()
    out = {(r.conv_id, r.call_id): r for r in rows(spark, back + tail + stuck)}
    assert time.perf_counter() - began < 60
    assert [(out[1, f"b{k}"].slot, out[1, f"b{k}"].depth) for k in range(n)] == [(2 * (n - 1), n - 1 - k) for k in range(n)]
    assert [(out[1, f"t{k}"].slot, out[1, f"t{k}"].depth) for k in range(n)] == [(2 * (n + k), n + k) for k in range(n)]
    assert {out[2, f"c{k}"].depth for k in range(n)} == {-1} and out[2, "c7"].slot == 7


def test_groups_of_few_edges_give_the_same_order(spark, monkeypatch):
    made = [(1, k, "assistant", {"tool_calls": [call(f"c{k}", needs=[f"c{k + 1}", f"c{k - 2}"])]}) for k in range(9)]
    want = rows(spark, made)
    monkeypatch.setattr(tc, "EDGES", 2)
    monkeypatch.setattr(tc, "BLOCK", 2)
    assert rows(spark, made) == want and {r.depth for r in want} == {-1}
    made = [(1, k, "assistant", {"tool_calls": [call(f"c{k}", needs=[f"c{k + 1}", f"c{k + 2}"])]}) for k in range(9)]
    got = rows(spark, made + [(1, None, "assistant", {"tool_calls": [call("n", needs=["c3", "c0"])]})])
    assert sorted((r.call_id, r.depth, r.slot) for r in got if r.call_id != "n") == [(f"c{k}", 8 - k, 8) for k in range(9)]


def test_plain_conversations_agree_with_sql(spark):
    texts = ['line "one"\nnext', None, "", "é\\😀", "12", '{"a": [1, "x"]}', "not {json"]
    data = [(1, 0, "system", "s"), (1, 1, "user", texts[0]), (1, 2, "assistant", texts[4]), (1, 3, "user", texts[1]), (2, 0, "user", texts[2]), (2, 1, "assistant", texts[5])]
    data += [(2, 2, "user", texts[3]), (2, 3, "assistant", texts[1]), (3, 0, "assistant", texts[6]), (4, 0, None, "x"), (4, 1, "other", None)]
    data += [(7, t, ("user", "assistant")[t % 2], texts[t % 7]) for t in range(8)] + [(-2, t, "user", texts[t]) for t in (0, 2, 3, 6)]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    made = tc.link(tc.transcript(frame)).withColumn("problems", F.array_join("problems", "; "))
    conversations = frame.toPandas()
    con = duckdb.connect()
    con.register("conversations", conversations)
    want = con.sql(tc.transcript_sql())
    assert sorted([tuple(r) for r in made.select(*want.columns).collect()], key=repr) == sorted(want.fetchall(), key=repr)


def test_nulls_and_empty(spark):
    out = rows(spark, [(None, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (1, 1, "tool", "not json"), (1, 2, "assistant", "{x" * 50000)])
    assert len(out) == 5 and {r.kind for r in out} == {"message"}
    assert [r.json for r in out if r.conv_id is None] == ['{"content":null,"role":null}']
    assert rows(spark, []) == []
