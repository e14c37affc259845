"""Tool-call linking: calls meet their results by identifier, in topological order, with checked arguments."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,depends_on:array<string>,function:struct<name:string,arguments:string>>>,content:string>"
RESULT = "struct<tool_call_id:string,content:string>"
TOOLS = "struct<tools:array<struct<name:string,parameters:struct<required:array<string>,additionalProperties:boolean,properties:map<string,struct<type:string,enum:array<string>>>>>>,content:string>"
#: Turns of one identifier that a task orders at most; blocks of turns are put in order by their last calls.
BLOCK = 1024
#: Edges between calls that a task holds at a time.
EDGES = 65_536
_NEVER = -(1 << 62)

#: What stands before and after the identifier where an argument names another call's result.
REFERENCE = r"\$\{call:([^}]*)\}"


def _parsed(role: str, schema: str) -> Column:
    """The message's JSON where it has this role and is an object; null otherwise."""
    text = F.col("text")
    return F.when((F.col("role") == role) & text.rlike(r"\A\s*\{"), F.from_json(text, schema))


def messages(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, calls, result, tools, content): each row with what it says about tools."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    rows = rows.withColumns({"calls": _parsed("assistant", CALLS), "result": _parsed("tool", RESULT), "system": _parsed("system", TOOLS)})
    content = F.when(F.col("system.tools").isNotNull(), F.coalesce("system.content", "text")).otherwise(F.col("text"))
    return rows.withColumn("content", content).withColumn("tools", F.col("system.tools")).drop("system")


def declared(rows: DataFrame) -> DataFrame:
    """(conv_id, name, parameters): the schemas that a conversation's system messages give; of one name the earliest counts."""
    tools = rows.filter("tools is not null").select("conv_id", "turn", F.posexplode("tools").alias("nth", "tool"))
    first = F.min_by(F.col("tool.parameters"), F.struct("turn", "nth"))
    return tools.groupBy("conv_id", F.col("tool.name").alias("name")).agg(first.alias("parameters"))


def _problems() -> Column:
    """What is wrong with ``given`` under ``parameters``, in the order of the arguments' names."""
    names = F.array_sort(F.map_keys("given"))
    wanted = F.coalesce(F.col("parameters.required"), F.array().cast("array<string>"))
    properties = F.col("parameters.properties")
    missing = F.transform(F.array_sort(F.array_distinct(F.array_except(wanted, names))), lambda n: F.concat(F.lit("missing "), n))

    def kind(value: Column) -> Column:
        said = F.schema_of_variant(value)
        return (
            F.when(said == "STRING", "string")
            .when(said == "BIGINT", "integer")
            .when(said.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number")
            .when(said == "BOOLEAN", "boolean")
            .when(said.startswith("ARRAY"), "array")
            .when(said.startswith("OBJECT"), "object")
            .otherwise("null")
        )

    def wrong(name: Column) -> Column:
        rule, value = properties[name], F.col("given")[name]
        said = kind(value)
        fits = rule["type"].isNull() | (said == rule["type"]) | ((rule["type"] == "number") & (said == "integer"))
        listed = rule["enum"].isNull() | F.array_contains(rule["enum"], value.cast("string"))
        return (
            F.when(rule.isNull(), F.when(F.col("parameters.additionalProperties") == F.lit(False), F.concat(F.lit("unknown "), name)))
            .when(~fits, F.concat(F.lit("not a "), rule["type"], F.lit(": "), name))
            .when(~listed, F.concat(F.lit("not listed: "), name))
        )

    found = F.concat(missing, F.array_compact(F.transform(names, wrong)))
    return F.when(F.col("parameters").isNull(), F.array(F.lit("no schema"))).when(
        F.col("given").isNull(), F.array(F.lit("arguments aren't an object"))
    ).otherwise(found)


def called(rows: DataFrame) -> DataFrame:
    """A row for each call: (conv_id, turn, nth, msg_id, call_id, name, arguments, needs); msg_id and nth name it."""
    calls = rows.filter("calls.tool_calls is not null").select("conv_id", "turn", "msg_id", F.posexplode("calls.tool_calls").alias("nth", "c"))
    given = F.coalesce("c.arguments", "c.function.arguments")
    named = F.regexp_extract_all(F.coalesce(given, F.lit("")), F.lit(REFERENCE), F.lit(1))
    return calls.select(
        "conv_id", "turn", "nth", "msg_id",
        F.col("c.id").alias("call_id"),
        F.coalesce("c.name", "c.function.name").alias("name"),
        F.coalesce(given, F.lit("{}")).alias("arguments"),
        F.array_distinct(F.array_compact(F.concat(F.coalesce(F.col("c.depends_on"), F.array().cast("array<string>")), named))).alias("needs"),
    )


def latest(calls: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(conv_id, id, turn, after, nth, msg_id)`` with ``call``: the place of the last call of that id so far.

    A row asks for calls before its own place; with ``after`` = 1 calls of its own turn count, too. The calls
    and the askers of an id are ordered in blocks of BLOCK turns, and the blocks by their last calls.
    """
    place = F.struct("turn", "nth", "msg_id")
    one = calls.filter("conv_id is not null and call_id is not null").select(
        "conv_id", F.col("call_id").alias("id"), "turn", F.lit(0).alias("after"), "nth", "msg_id", F.lit(1).alias("is_call"), place.alias("place")
    )
    both = one.unionByName(asked.filter("conv_id is not null and id is not null").withColumn("is_call", F.lit(0)), allowMissingColumns=True)
    both = both.withColumn("block", F.floor(F.coalesce("turn", F.lit(0)) / BLOCK))
    inside = Window.partitionBy("conv_id", "id", "block").orderBy("turn", "after", "nth", "msg_id", "is_call").rowsBetween(Window.unboundedPreceding, 0)
    blocks = both.groupBy("conv_id", "id", "block").agg(F.max("place").alias("last"))
    earlier = Window.partitionBy("conv_id", "id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "id", "block", F.max("last").over(earlier).alias("before"))
    rows = both.withColumn("near", F.last("place", ignorenulls=True).over(inside)).filter("is_call = 0")
    rows = rows.join(blocks, ["conv_id", "id", "block"]).withColumn("call", F.coalesce("near", "before"))
    return rows.drop("is_call", "place", "block", "near", "before")


def edges_of(calls: DataFrame) -> DataFrame:
    """(conv_id, msg_id, nth, turn, need_msg, need_nth, need_turn, against): a call and one that it needs.

    A need is the last call of that id before, or else the first one after: then the edge runs against the written order.
    """
    asked = calls.select("conv_id", F.explode("needs").alias("id"), "turn", F.lit(0).alias("after"), "nth", "msg_id")
    first = calls.filter("conv_id is not null and call_id is not null").groupBy("conv_id", F.col("call_id").alias("id")).agg(F.min(F.struct("turn", "nth", "msg_id")).alias("first"))
    rows = latest(calls, asked).join(first, ["conv_id", "id"]).withColumn("need", F.coalesce("call", "first"))
    return rows.select(
        "conv_id", "msg_id", "nth", "turn",
        F.col("need.msg_id").alias("need_msg"), F.col("need.nth").alias("need_nth"), F.col("need.turn").alias("need_turn"), F.col("call").isNull().alias("against"),
    ).distinct()


def _grouped(edges: DataFrame) -> DataFrame:
    """``edges`` with ``bucket``: many blocks of conversations together, and blocks of more than EDGES edges in parts; a message's edges stay together."""
    block = ["conv_id", F.floor(F.coalesce("turn", F.lit(0)) / BLOCK).alias("block")]
    buckets = 1 + 4 * edges.count() // EDGES
    sizes = edges.groupBy(*block).agg(F.ceil(F.count("*") / EDGES).alias("parts"))
    rows = edges.select("*", block[1]).join(sizes, ["conv_id", "block"])
    part = F.pmod(F.xxhash64("msg_id"), F.col("parts"))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("conv_id", "block", part), F.lit(buckets))).drop("conv_id", "block", "parts")


def _calls_of(rows: pd.DataFrame) -> tuple[list[tuple[int, int]], dict[tuple[int, int], list[int]]]:
    """The caller of each edge of a group, and the places of the edges that lead to each call."""
    leading: dict[tuple[int, int], list[int]] = {}
    for k, need in enumerate(zip(rows["need_msg"].tolist(), rows["need_nth"].tolist(), strict=True)):
        leading.setdefault(need, []).append(k)
    return list(zip(rows["msg_id"].tolist(), rows["nth"].tolist(), strict=True)), leading


def _spread(rows: pd.DataFrame) -> pd.DataFrame:
    """The calls of a group that are late: those with a late edge, and those that need them."""
    callers, leading = _calls_of(rows)
    late = {callers[k] for k in rows.index[rows["late"]]}
    front = list(late)
    while front:
        for k in leading.get(front.pop(), ()):
            if callers[k] not in late:
                late.add(callers[k])
                front.append(callers[k])
    return pd.DataFrame(sorted(late), columns=["msg_id", "nth"])


def _settle(rows: pd.DataFrame) -> pd.DataFrame:
    """The calls of a group all of whose needs are settled, be it in turn: one more deep than the deepest, in the last of their slots."""
    callers, leading = _calls_of(rows)
    waiting: dict[tuple[int, int], int] = {}
    found: dict[tuple[int, int], list[int]] = {}
    for c, turn, slot, depth, is_open in zip(callers, rows["turn"].tolist(), rows["slot"].tolist(), rows["depth"].tolist(), rows["open"].tolist(), strict=True):
        waiting[c] = waiting.get(c, 0) + is_open
        best = found.setdefault(c, [turn, 1])
        if not is_open:
            best[:] = max(best[0], slot), max(best[1], depth + 1)
    ready = [c for c, n in waiting.items() if n == 0]
    out = []
    while ready:
        c = ready.pop()
        slot, depth = found[c]
        out.append((*c, slot, depth))
        for k in leading.get(c, ()):
            caller = callers[k]
            best = found[caller]
            best[:] = max(best[0], slot), max(best[1], depth + 1)
            waiting[caller] -= 1
            if waiting[caller] == 0:
                ready.append(caller)
    return pd.DataFrame(out, columns=["msg_id", "nth", "slot", "depth"])


def ordered(calls: DataFrame) -> DataFrame:
    """``calls`` with (slot, depth): by (slot, depth, turn, nth) a call comes after all calls that it needs.

    Where every need was written before the call, the written order is a topological one: slot is the call's turn and
    depth 0. Only calls behind an edge that runs against the written order (late ones) are put in order: their slot is
    the last turn of all that they need, their depth one more than the deepest need's. That goes by rounds, each of which
    settles all it can inside buckets of whole blocks of BLOCK turns, or of their parts of about EDGES edges, so there are as
    many rounds as the longest chain changes its bucket, not as it is long. A conversation is never gathered. Calls on a cycle, or behind one, never
    settle: their depth is -1 and they stay in their own turn.
    """
    key, need = ["msg_id", "nth"], ["need_msg", "need_nth"]
    edges = stage(edges_of(calls), "edges")
    if edges.filter("against").isEmpty():
        return calls.withColumns({"slot": F.col("turn"), "depth": F.lit(0)})
    edges = stage(_grouped(edges), "grouped")

    rest, late = edges.withColumn("late", F.col("against")), None
    while True:
        front = stage(rest.groupBy("bucket").applyInPandas(lambda rows: _spread(rows), "msg_id long, nth int"), "front")
        if front.isEmpty():
            break
        late = front if late is None else stage(late.unionByName(front), "late")
        reached = front.select(F.col("msg_id").alias("need_msg"), F.col("nth").alias("need_nth"), F.lit(True).alias("hit"))
        rest = rest.join(front, key, "left_anti").join(reached, need, "left")
        rest = stage(rest.withColumn("late", F.col("hit").isNotNull()).drop("hit"), "rest")

    never = F.lit(_NEVER)
    others = late.select(F.col("msg_id").alias("need_msg"), F.col("nth").alias("need_nth"), F.lit(True).alias("open"))
    inner = edges.join(late, key, "left_semi").join(others, need, "left").withColumn("open", F.col("open").isNotNull())
    inner = inner.withColumns({"turn": F.coalesce("turn", never), "slot": F.coalesce("need_turn", never), "depth": F.lit(0)})
    inner, settled = stage(inner.drop("need_turn", "against"), "inner"), []
    while not inner.isEmpty():
        now = stage(inner.groupBy("bucket").applyInPandas(lambda rows: _settle(rows), "msg_id long, nth int, slot long, depth int"), "settled")
        if now.isEmpty():
            break
        settled.append(now)
        known = now.select(F.col("msg_id").alias("need_msg"), F.col("nth").alias("need_nth"), F.col("slot").alias("s"), F.col("depth").alias("d"))
        inner = inner.join(now, key, "left_anti").join(known, need, "left")
        inner = inner.withColumns({"open": F.col("open") & F.col("s").isNull(), "slot": F.coalesce("s", "slot"), "depth": F.coalesce("d", "depth")})
        inner = stage(inner.drop("s", "d"), "inner")

    rows = calls.join(late.withColumn("late", F.lit(True)), key, "left")
    if settled:
        rows = rows.join(reduce(DataFrame.unionByName, settled), key, "left")
    else:
        rows = rows.withColumns({"slot": F.lit(None).cast("long"), "depth": F.lit(None).cast("int")})
    depth = F.when(F.col("late").isNull(), 0).otherwise(F.coalesce("depth", F.lit(-1)))
    return rows.withColumns({"slot": F.coalesce(F.nullif("slot", never), "turn"), "depth": depth}).drop("late")


def link(conversations: DataFrame) -> DataFrame:
    """A row for each message and each call: (conv_id, slot, depth, turn, nth, kind, call_id, json, problems).

    Within a conversation, rows in the order of (slot, depth, turn, nth) are a topological order: a call after
    the calls that it needs (listed in depends_on, or named ``${call:id}`` in its arguments), its result, held in the same row, with it. Messages
    keep their turn and have depth 0. kind is ``message``, ``call`` or ``orphan`` (a result of no call).
    json is canonical: keys sorted, no blanks, arguments and results inside it normalised the same way.
    problems lists what breaks the schema that the conversation's system messages declare, a repeated
    identifier, a missing one, a missing result and a cycle; it is empty for messages. A call gives name and arguments
    itself or under ``function``.

    Every call has a row. Where an id is used again, a result belongs to the last call of that id so far, and a
    need is the last one before; of several results of a call the earliest counts, the others are orphans. Calls
    without an id or conversation have no result and are needed by none.

    Tool messages appear as their call's result, not as messages; a system message that declares tools is a message of its content, or its whole
    text. A text that isn't a JSON object is a message as it stands; a null text or role is JSON null. Repeated
    rows are repeated messages and calls. Other columns aren't read. Hot conversations: every join and
    grouping goes by conversation and call, so no task gathers a conversation.
    """
    rows = messages(conversations)
    plain = F.to_json(F.struct(F.col("content"), F.col("role")), {"ignoreNullFields": "false"})
    spoken = rows.filter("calls.tool_calls is null and result.tool_call_id is null").select("conv_id", "turn", "role", "content")
    said = rows.filter("calls.tool_calls is not null and calls.content is not null").select(
        "conv_id", "turn", "role", F.col("calls.content").alias("content")
    )
    nothing = F.array().cast("array<string>")
    out = spoken.unionByName(said).select(
        "conv_id", F.col("turn").alias("slot"), F.lit(0).alias("depth"), "turn", F.lit(-1).alias("nth"), F.lit("message").alias("kind"),
        F.lit(None).cast("string").alias("call_id"), plain.alias("json"), nothing.alias("problems"),
    )
    uses = rows.filter("calls.tool_calls is not null or result.tool_call_id is not null or tools is not null")
    uses = stage(uses.drop("text", "role", "content").withColumn("msg_id", F.monotonically_increasing_id()), "uses")
    calls = stage(called(uses), "calls")
    results = uses.filter("result.tool_call_id is not null").select(
        "conv_id", F.col("result.tool_call_id").alias("id"), "turn", F.lit(1).alias("after"), F.lit(0).alias("nth"), "msg_id", F.col("result.content").alias("content")
    )
    met = latest(calls, results.drop("content")).filter("call is not null")
    met = met.groupBy("call.msg_id", "call.nth").agg(F.min(F.struct("turn", F.col("msg_id"))).alias("at"))
    met = stage(met.select(F.col("msg_id"), F.col("nth"), F.col("at.msg_id").alias("result_id")), "met")
    held = results.select(F.col("msg_id").alias("result_id"), "content")
    often = calls.groupBy("conv_id", "call_id").agg(F.count("*").alias("n_calls")).filter("n_calls > 1 and conv_id is not null and call_id is not null")

    rows = ordered(calls).join(met.join(held, "result_id"), ["msg_id", "nth"], "left")
    rows = rows.join(often, ["conv_id", "call_id"], "left").join(declared(uses), ["conv_id", "name"], "left")
    rows = rows.withColumn("given", F.from_json("arguments", "map<string,variant>")).withColumn("broken", _problems())
    more = F.array_compact(
        F.array(
            F.when(F.col("call_id").isNull(), "no id"),
            F.when(F.col("n_calls") > 1, "repeated id"),
            F.when(F.col("result_id").isNull(), "no result"),
            F.when(F.col("depth") < 0, "cycle"),
        )
    )
    content = F.coalesce(F.try_parse_json("content"), F.col("content").cast("variant"))
    json = F.to_json(
        F.struct(
            F.coalesce(F.try_parse_json("arguments"), F.col("arguments").cast("variant")).alias("arguments"),
            F.col("call_id").alias("call"),
            "name",
            F.when(F.col("result_id").isNotNull(), content).alias("result"),
        ),
        {"ignoreNullFields": "false"},
    )
    made = rows.select(
        "conv_id", "slot", "depth", "turn", "nth", F.lit("call").alias("kind"), "call_id", json.alias("json"), F.concat("broken", more).alias("problems")
    )
    orphans = results.join(met.select(F.col("result_id").alias("msg_id")), "msg_id", "left_anti").select(
        "conv_id", F.col("turn").alias("slot"), F.lit(0).alias("depth"), "turn", F.lit(-1).alias("nth"), F.lit("orphan").alias("kind"),
        F.col("id").alias("call_id"), F.to_json(F.struct("content", F.lit("tool").alias("role")), {"ignoreNullFields": "false"}).alias("json"),
        F.array(F.lit("no call")).alias("problems"),
    )
    return out.unionByName(made).unionByName(orphans)


#: The tool that ``transcript`` takes a conversation's replies for.
TOOL = "reply"
#: Of so many conversations one is planned from its end: each call needs the next one.
PLANNED = 3
PARAMETERS = '{"additionalProperties":false,"properties":{"text":{"type":"string"},"turn":{"type":"integer"}},"required":["text"]}'


def transcript(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): a plain conversation written out as tool calls.

    A user's turn is a call of the tool ``reply`` with the turn as its id, the text and turn as arguments, and the user's turn two
    before as its need, or, where conv_id leaves 1 when divided by PLANNED, the one two after; an assistant's turn is the result of the call of the turn before; a system message
    declares the tool. Other roles stay as they are.
    """
    whole = {"ignoreNullFields": "false"}
    turn = F.col("turn").cast("string")
    arguments = F.to_json(F.struct("text", "turn"), whole)
    before = F.array((F.col("turn") + F.when(F.pmod("conv_id", F.lit(PLANNED)) == 1, 2).otherwise(-2)).cast("string"))
    call = F.struct(turn.alias("id"), F.lit("function").alias("type"), F.struct(F.lit(TOOL).alias("name"), arguments.alias("arguments")).alias("function"), before.alias("depends_on"))
    tool = F.struct(F.lit(TOOL).alias("name"), F.from_json(F.lit(PARAMETERS), "variant").alias("parameters"))
    role = F.col("role")
    text = (
        F.when(role == "user", F.to_json(F.struct(F.array(call).alias("tool_calls")), whole))
        .when(role == "assistant", F.to_json(F.struct((F.col("turn") - 1).cast("string").alias("tool_call_id"), F.col("text").alias("content")), whole))
        .when(role == "system", F.to_json(F.struct(F.array(tool).alias("tools"), F.col("text").alias("content")), whole))
        .otherwise(F.col("text"))
    )
    said = F.when(role == "user", "assistant").when(role == "assistant", "tool").otherwise(role)
    return conversations.select("conv_id", "turn", said.alias("role"), text.alias("text"))


def transcript_sql() -> str:
    """DuckDB SQL for ``link`` of ``transcript``'s rows, with problems joined, where (conv_id, turn) is unique."""
    return f"""
    WITH RECURSIVE calls AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
    replies AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
    declared AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system'),
    placed AS (
        SELECT conv_id, turn, turn AS slot, 0 AS depth FROM calls c
        WHERE NOT EXISTS (SELECT 1 FROM calls n WHERE n.conv_id = c.conv_id AND n.turn = c.turn + CASE WHEN (c.conv_id % {PLANNED} + {PLANNED}) % {PLANNED} = 1 THEN 2 ELSE -2 END)
        UNION ALL
        SELECT c.conv_id, c.turn, greatest(p.slot, c.turn), p.depth + (c.turn < p.turn)::INT
        FROM placed p JOIN calls c ON c.conv_id = p.conv_id AND c.turn = p.turn + CASE WHEN (c.conv_id % {PLANNED} + {PLANNED}) % {PLANNED} = 1 THEN -2 ELSE 2 END
    ),
    linked AS (
        SELECT c.conv_id, c.turn, p.slot, p.depth, c.text, r.turn IS NOT NULL AS answered, d.conv_id IS NOT NULL AS known,
            CASE WHEN json_valid(r.text) THEN json(r.text) ELSE to_json(r.text) END AS result
        FROM calls c LEFT JOIN placed p USING (conv_id, turn) LEFT JOIN declared d USING (conv_id)
        LEFT JOIN replies r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1
    )
    SELECT conv_id, turn AS slot, 0 AS depth, turn, -1 AS nth, 'message' AS kind, NULL::VARCHAR AS call_id,
        json_object('content', text, 'role', role)::VARCHAR AS json, '' AS problems
    FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
    UNION ALL
    SELECT conv_id, coalesce(slot, turn), coalesce(depth, -1), turn, 0, 'call', turn::VARCHAR,
        json_object('arguments', json_object('text', text, 'turn', turn), 'call', turn::VARCHAR, 'name', '{TOOL}', 'result', result)::VARCHAR,
        array_to_string(list_filter([
            CASE WHEN NOT known THEN 'no schema' WHEN text IS NULL THEN 'not a string: text' END, CASE WHEN NOT answered THEN 'no result' END
        ], lambda x: x IS NOT NULL), '; ')
    FROM linked
    UNION ALL
    SELECT r.conv_id, r.turn, 0, r.turn, -1, 'orphan', (r.turn - 1)::VARCHAR, json_object('content', r.text, 'role', 'tool')::VARCHAR, 'no call'
    FROM replies r LEFT JOIN calls c ON c.conv_id = r.conv_id AND c.turn = r.turn - 1 WHERE c.turn IS NULL
    """
