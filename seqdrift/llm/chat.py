"""Chat formatting with tool-call linking, DataFrame functions only.

Messages are rows (conv_id, turn, role, text). Three kinds of text carry JSON:

* a ``system`` message may declare tools: {"tools": [{"name", "parameters": schema}]};
* an ``assistant`` message may call them: {"content", "tool_calls": [{"id", "name", "arguments",
  "after": [ids]}]}, where ``after`` names calls whose results it needs;
* a ``tool`` message is a result: {"tool_call_id", "content"}.

Tools and calls may also be nested, {"type": "function", "function": {"name", "parameters" or
"arguments"}}, with arguments as an object or as its JSON text.

Calls and results are hash-joined by (conversation, identifier). A message comes after the messages
it depends on: a result after its call, a call after the results it names. Messages are placed level
by level (Kahn's method): each moves no further than behind the last of what it needs; messages on
a cycle keep their own turn. Arguments are validated against the declared schema at any depth, one
written level after another: ``type`` (a name or a list), ``enum``, ``required``, ``properties``,
``additionalProperties`` and ``items``; other words of a schema are not judged. Every message is
written as canonical JSON (sorted keys, no white space); keys that mean nothing here are kept.

One row per message, never one per conversation, so a conversation of any length is no large group;
positions within it are counted in blocks of the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seqdrift.config import materialize
from seqdrift.operators.ordered import ordered_index

from .common import let, read

TOOLS = "struct<tools:array<struct<name:string,parameters:string,function:struct<name:string,parameters:string>>>>"
CALLS = ("struct<content:string,tool_calls:array<struct<id:string,name:string,arguments:string,after:array<string>,"
         "function:struct<name:string,arguments:string>>>>")
RESULT = "struct<tool_call_id:string,content:string>"
OBJECT = "map<string,variant>"
MORE = f"struct<tool_calls:array<struct<function:{OBJECT}>>>"
RAW_CALLS = f"struct<tool_calls:array<{OBJECT}>>"
SCHEMA = ("struct<type:string,enum:array<variant>,required:array<string>,properties:map<string,string>,"
          "additionalProperties:string,items:string>")

#: Keys with a meaning; the role is the message's own column.
MESSAGE_KEYS = ("content", "role", "tool_call_id", "tool_calls")
CALL_KEYS = ("id", "name", "arguments", "function")
FUNCTION_KEYS = ("name", "arguments")

LAST_TURN = 2 ** 63 - 1


def _looks(text: Column, word: str) -> Column:
    return text.rlike(r"^[\x20\t\n\r]*\{") & text.contains(f'"{word}"')


def _with(asked: Column, parsed: Column, field: str) -> Column:
    """The parsed text where it has the field; other texts are plain."""
    return F.when(asked, let(parsed, lambda p: F.when(p[field].isNotNull(), p)))


def without(object_: Column, keys) -> Column:
    """The entries of a JSON object under other keys."""
    return F.map_filter(object_, lambda k, v: ~k.isin(*keys))


def canonical(*parts: Column) -> Column:
    """One JSON text of several objects without common keys; null values are left out, keys sorted."""
    none = F.create_map().cast(OBJECT)
    entries = F.map_entries(F.map_concat(*[F.coalesce(p, none) for p in parts]))
    by_key = F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))
    return F.to_json(F.map_from_entries(F.filter(by_key, lambda e: e["value"].isNotNull())))


def as_object(**values: Column) -> Column:
    return F.create_map(*[x for k, v in sorted(values.items()) for x in (F.lit(k), v)])


def text_value(text: Column) -> Column:
    return text.cast("variant")


def fold_messages(conversations: DataFrame) -> DataFrame:
    """Distinct messages with their number of copies, parsed, under null-safe keys.

    Null turns come last. Messages that repeat all of (conv_id, turn, role, text) are one.
    """
    m = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    m = m.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    return m.select(
        "*", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), F.col("conv_id").isNull().alias("no_id"),
        F.coalesce("turn", F.lit(LAST_TURN)).alias("own"), role.alias("who"), text.alias("said"),
        F.col("text").isNull().cast("int").alias("silent"),
        F.when((role == "system") & _looks(text, "tools"), F.from_json(text, TOOLS)["tools"]).alias("tools"),
        _with((role == "assistant") & _looks(text, "tool_calls"), F.from_json(text, CALLS), "tool_calls").alias("calls"),
        _with((role == "tool") & _looks(text, "tool_call_id"), F.from_json(text, RESULT), "tool_call_id").alias("result"),
        F.when((role == "assistant") & _looks(text, "tool_calls") | (role == "tool") & _looks(text, "tool_call_id"),
               without(F.from_json(text, OBJECT), MESSAGE_KEYS)).alias("more"),
        F.when((role == "assistant") & _looks(text, "tool_calls"), F.from_json(text, RAW_CALLS)["tool_calls"]).alias("raw"),
        F.when((role == "assistant") & _looks(text, "tool_calls"), F.from_json(text, MORE)["tool_calls"]).alias("nested"),
        F.xxhash64("turn", "role", "text").alias("message"))


def argument_type(value: Column) -> Column:
    """JSON-schema name of a variant's type."""
    t = F.schema_of_variant(value)
    return (F.when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t == "BIGINT", "integer")
            .when(t.startswith("DECIMAL") | (t == "DOUBLE") | (t == "FLOAT"), "number")
            .when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").when(t == "VOID", "null"))


def fits(wanted: Column, found: Column) -> Column:
    """Whether a type is the wanted one, given as a name or as a JSON list of names."""
    names = F.when(wanted.startswith("["), F.from_json(wanted, "array<string>")).otherwise(F.array(wanted))
    return wanted.isNull() | F.coalesce(F.exists(names, lambda w: (w == found) | ((w == "number") & (found == "integer"))), F.lit(False))


def schema_problems(asked: DataFrame, by: list[str]) -> DataFrame:
    """(by, problem): the first problem of each value (by, value, schema as JSON texts), if it has one.

    A value and its schema are judged, then the members of objects and arrays with a schema of their
    own, level by level in written tables until none is left. Problems rank by level, then missing,
    unexpected and mistyped argument, then one that ``enum`` does not list; the outermost ``properties``
    are complete unless ``additionalProperties`` says otherwise, inner ones where it is false.
    """
    found, depth = None, 0
    while True:
        d = asked.withColumn("v", F.try_parse_json("value")).withColumn("s", F.from_json("schema", SCHEMA))
        kind = argument_type(F.col("v"))
        members = F.when(kind == "object", F.from_json("value", OBJECT))
        d = materialize(d.select(*by, "value", "s", kind.alias("kind"), members.alias("members")), "chat-schemas")
        listed = F.coalesce(F.map_keys("s.properties"), F.array().cast("array<string>"))
        open_ = F.coalesce(F.col("s.additionalProperties"), F.lit("false" if depth == 0 else "true")) != "false"
        missing = F.size(F.array_except(F.coalesce("s.required", F.array().cast("array<string>")), F.map_keys("members"))) > 0
        unexpected = ~open_ & (F.size(F.array_except(F.map_keys("members"), listed)) > 0)
        same = F.exists("s.enum", lambda e: F.to_json(e) == F.to_json(F.try_parse_json("value")))
        problem = (F.when(missing, F.struct(F.lit(0).alias("rank"), F.lit("missing_argument").alias("name")))
                   .when(unexpected, F.struct(F.lit(1).alias("rank"), F.lit("unexpected_argument").alias("name")))
                   .when(~fits(F.col("s.type"), F.col("kind")), F.struct(F.lit(2).alias("rank"), F.lit("mistyped_argument").alias("name")))
                   .when(~same, F.struct(F.lit(3).alias("rank"), F.lit("not_in_enum").alias("name"))))
        here = d.select(*by, problem.alias("p")).where("p is not null").select(*by, F.struct(F.lit(depth).alias("depth"), "p.*").alias("p"))
        found = here if found is None else found.unionAll(here)
        inner = F.filter(F.map_entries("members"), lambda e: F.map_contains_key("s.properties", e["key"]))
        inner = F.transform(inner, lambda e: F.struct(F.to_json(e["value"]).alias("value"),
                                                      F.element_at("s.properties", e["key"]).alias("schema")))
        each = F.when((F.col("kind") == "array") & F.col("s.items").isNotNull(), F.transform(
            F.from_json("value", "array<variant>"), lambda v: F.struct(F.to_json(v).alias("value"), F.col("s.items").alias("schema"))))
        asked = d.select(*by, F.explode(F.coalesce(inner, each)).alias("c")).select(*by, "c.*")
        depth += 1
        if asked.isEmpty():
            return found.groupBy(*by).agg(F.min("p").alias("p")).select(*by, F.col("p.name").alias("problem"))


def link_calls(messages: DataFrame) -> DataFrame:
    """One row per call: its place, canonical arguments, verdict and number of results.

    status: ok; unknown_tool; bad_json (arguments are no JSON object); missing, unexpected or
    mistyped argument; not_in_enum. Of calls that share an identifier in a conversation the first is
    linked; of tools that share a name the first one declared counts.
    """
    calls = messages.where("calls is not null").select(
        "key", "no_id", "message", "own", "raw", "nested", F.posexplode("calls.tool_calls").alias("at", "call"))
    more = F.element_at("raw", F.col("at") + 1)
    inside = without(F.element_at("nested", F.col("at") + 1)["function"], FUNCTION_KEYS)
    calls = calls.select("key", "no_id", "message", "own", "at", F.col("call.id").alias("call_id"),
                         F.coalesce("call.function.name", "call.name").alias("name"), F.col("call.after").alias("after"),
                         without(more, CALL_KEYS).alias("more"), F.when(F.size(inside) > 0, inside).alias("inside"),
                         let(F.coalesce("call.function.arguments", "call.arguments", F.lit("{}")),
                             lambda a: F.coalesce(F.try_parse_json(a), a.cast("variant"))).alias("arguments"))
    tool = F.struct("own", F.coalesce("tool.function.parameters", "tool.parameters", F.lit("{}")).alias("parameters"))
    tools = (messages.where("tools is not null").select("key", "no_id", "own", F.explode("tools").alias("tool"))
             .groupBy("key", "no_id", F.coalesce("tool.function.name", "tool.name").alias("name"))
             .agg(F.min(tool).alias("first_tool")))
    results = (messages.where("result.tool_call_id is not null")
               .groupBy("key", "no_id", F.col("result.tool_call_id").alias("call_id")).agg(F.count(F.lit(1)).alias("n_results")))
    first = calls.groupBy("key", "no_id", "call_id").agg(F.min(F.struct("own", "message", "at")).alias("first"))
    c = calls.join(tools, ["key", "no_id", "name"], "left").join(results, ["key", "no_id", "call_id"], "left") \
        .join(first, ["key", "no_id", "call_id"], "left")
    c = materialize(c.withColumn("is_object", F.schema_of_variant("arguments").startswith("OBJECT")), "chat-linked")
    by = ["key", "no_id", "message", "at"]
    problems = schema_problems(c.where("first_tool is not null and is_object").select(
        *by, F.to_json("arguments").alias("value"), F.col("first_tool.parameters").alias("schema")), by)
    status = (F.when(F.col("first_tool").isNull(), "unknown_tool").when(~F.coalesce("is_object", F.lit(False)), "bad_json")
              .otherwise(F.coalesce("problem", F.lit("ok"))))
    is_first = F.struct("own", "message", "at") == F.col("first")
    return c.join(problems, by, "left").select(
        *by, "call_id", "name", "after", F.to_json("arguments").alias("arguments"), "more", "inside", status.alias("status"),
        is_first.alias("first"), F.when(is_first, F.coalesce("n_results", F.lit(0))).otherwise(0).alias("n_results"))


def dependencies(messages: DataFrame, calls: DataFrame) -> DataFrame:
    """(key, no_id, message, needs): a result needs its call's message, a call the results it names."""
    of = calls.where("first").select("key", "no_id", "call_id", F.col("message").alias("caller"))
    results = messages.where("result.tool_call_id is not null").select(
        "key", "no_id", "message", F.col("result.tool_call_id").alias("call_id"))
    back = results.join(of, ["key", "no_id", "call_id"]).select("key", "no_id", "message", F.col("caller").alias("needs"))
    named = calls.select("key", "no_id", "message", F.explode("after").alias("call_id"))
    on = named.join(results.withColumnRenamed("message", "needs"), ["key", "no_id", "call_id"]) \
        .select("key", "no_id", "message", "needs")
    return back.unionAll(on).where("message != needs").distinct()


def levels(messages: DataFrame, needs: DataFrame) -> DataFrame:
    """(key, no_id, message, place, level, cyclic) of the messages that need others or are needed."""
    by = ["key", "no_id", "message"]
    edges = materialize(needs, "chat-needs")
    if edges.isEmpty():
        return messages.sparkSession.createDataFrame(
            [], "key string, no_id boolean, message bigint, place bigint, level int, cyclic boolean")
    nodes = edges.select(*by).union(edges.select("key", "no_id", "needs")).distinct()
    nodes = materialize(nodes.join(messages.select(*by, "own"), by), "chat-nodes")
    placed = nodes.join(edges, by, "left_anti").select(*by, F.col("own").alias("place"), F.lit(0).alias("level"))
    placed = materialize(placed, "chat-placed")
    while True:
        known = placed.select("key", "no_id", F.col("message").alias("needs"), "place", "level")
        open_ = edges.join(placed, by, "left_anti").join(known, ["key", "no_id", "needs"], "left")
        ready = open_.groupBy(*by).agg(F.bool_and(F.col("place").isNotNull()).alias("ready"), F.max("place").alias("p"),
                                       F.max("level").alias("l")).where("ready")
        new = materialize(ready.join(nodes, by).select(*by, F.greatest("own", "p").alias("place"),
                                                       (F.col("l") + 1).alias("level")), "chat-ready")
        if new.isEmpty():
            break
        placed = materialize(placed.unionAll(new), "chat-placed")
    cyclic = nodes.join(placed, by, "left_anti").select(*by, F.col("own").alias("place"), F.lit(0).alias("level"), F.lit(True).alias("cyclic"))
    return placed.withColumn("cyclic", F.lit(False)).unionAll(cyclic)


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, turn, role, message, n_calls, n_valid, n_linked, result_of, status, copies).

    message is canonical JSON with the keys content, role, tool_call_id, tool_calls (absent if
    null) and any others that the message had; a nested call is written flat, what else its function
    held stays under ``function``; position counts from 0 in the order of the conversation. status of a message: the first
    problem of its calls, ``orphan`` for a result without a call, ``cycle``, or ``ok``. Null
    conversations form one conversation, null turns come last, null texts have no content, text that
    is no JSON of the kinds above is plain content. Repeated messages are one row with ``copies``.
    Empty input gives an empty result; extra columns are ignored.
    """
    messages = materialize(fold_messages(conversations), "chat-messages")
    calls = materialize(link_calls(messages), "chat-calls")
    by = ["key", "no_id", "message"]
    placed = levels(messages, dependencies(messages, calls))
    call = canonical(as_object(id=text_value(F.col("call_id")), name=text_value(F.col("name")),
                               arguments=F.try_parse_json("arguments"), function=F.try_parse_json(F.to_json("inside"))), F.col("more"))
    per = calls.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("at", call.alias("call")))).alias("list"),
        F.count(F.lit(1)).alias("n_calls"), F.count_if(F.col("status") == "ok").alias("n_valid"),
        F.count_if(F.col("n_results") > 0).alias("n_linked"),
        F.min_by(F.when(F.col("status") != "ok", F.col("status")),
                 F.when(F.col("status") != "ok", F.col("at"))).alias("problem"))
    known = calls.where("first").select("key", "no_id", F.col("call_id").alias("result_id"), F.lit(True).alias("called"))
    m = (messages.withColumn("result_id", F.col("result.tool_call_id"))
         .join(per, by, "left").join(placed, by, "left").join(known, ["key", "no_id", "result_id"], "left"))
    content = F.when(F.col("calls").isNotNull(), F.col("calls.content")).when(
        F.col("result").isNotNull(), F.col("result.content")).otherwise(F.col("text"))
    listed = F.when(F.size("list") > 0, F.try_parse_json(F.concat(
        F.lit("["), F.array_join(F.transform("list", lambda c: c["call"]), ","), F.lit("]"))))
    parts = as_object(content=text_value(content), role=text_value(F.col("role")), tool_call_id=text_value(F.col("result_id")),
                      tool_calls=listed)
    plain = F.to_json(F.struct(content.alias("content"), "role"))
    body = F.when(F.col("calls").isNotNull() | F.col("result").isNotNull(), canonical(parts, F.col("more"))).otherwise(plain)
    status = (F.when(F.coalesce("cyclic", F.lit(False)), "cycle").when(F.col("problem").isNotNull(), F.col("problem"))
              .when(F.col("result_id").isNotNull() & F.col("called").isNull(), "orphan").otherwise("ok"))
    rows = m.select("conv_id", "key", "no_id", "turn", "role", "who", "said", "silent", "own", body.alias("body"),
                    F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_valid", F.lit(0)).alias("n_valid"),
                    F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
                    F.when(F.col("called"), F.col("result_id")).alias("result_of"), status.alias("status"), "copies",
                    F.coalesce("place", "own").alias("place"), F.coalesce("level", F.lit(0)).alias("level"))
    ranked = ordered_index(rows, ["key", "no_id"], ["place", "level", "own", "who", "said", "silent"],
                           [("_b1", F.col("place")), ("_b2", F.col("level")), ("_b3", F.col("own")), ("_b4", F.col("who")),
                            ("_b5", F.substring("said", 1, 2))], name="position", start=0)
    return ranked.select("conv_id", "position", "turn", "role", F.col("body").alias("message"), "n_calls", "n_valid",
                         "n_linked", "result_of", "status", "copies")


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    return format_chats(read(spark, sf_dir, "conversations"))


#: Plain messages (the given tables hold no tool calls; those are tested against brute force).
OP9_SQL = """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, ''), coalesce(text, ''),
           (text IS NULL)::INT) - 1 AS position,
       turn, role, CASE WHEN text IS NULL AND role IS NULL THEN '{}' WHEN text IS NULL THEN to_json({'role': role})::VARCHAR
           WHEN role IS NULL THEN to_json({'content': text})::VARCHAR
           ELSE to_json({'content': text, 'role': role})::VARCHAR END AS message,
       0::BIGINT AS n_calls, 0::BIGINT AS n_valid, 0::BIGINT AS n_linked, NULL::VARCHAR AS result_of, 'ok' AS status, copies
FROM (SELECT conv_id, turn, role, text, count(*) AS copies FROM conversations GROUP BY ALL)
"""
