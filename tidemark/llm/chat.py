"""Chat formatting: tool calls linked to results, ordered, checked and written as canonical JSON.

Messages are rows (conv_id, turn, role, text). An assistant text may be a JSON object with
`tool_calls`, a list of {id, name, arguments, after}; a tool text is a JSON object with
`tool_call_id` and `content`. Calls and results meet in an equi-join on (conversation,
identifier, occurrence), the n-th result of an identifier with its n-th call. A call comes
after the calls it names in `after`: its level is one more than theirs, found in rounds of
joins, one per level, and none if no call names another. Name and arguments may also stand in
`function`. Arguments are checked against (tool, parameter, type, required) rows; the query takes
those that a conversation declares: a system text may be a JSON object with `tools`, a list of
{name, parameters} or {function: {name, parameters}}, `parameters` being a JSON schema.
JSON is canonical: keys in order, no blanks.

The result has one row per event (message, call, result), with the columns to sort by; no
conversation is ever gathered, so one with a third of all turns is no different from others.
Within a conversation the order is (turn, level, step): a message before its calls, a
call before its result, results at the place of their call.

Cases: null conv_id, turn, role or text stay null (a null text is written as null); texts
that are not such JSON are plain messages; a call without identifier or result and a result
without call are kept with that status; a call in a cycle, or after an unknown one, gets
level null and sorts last in its turn; unknown tools and arguments that are no object are
invalid; calls of a conversation that declares no tools are neither valid nor invalid (null); a
parameter declared with several types may have any; repeated rows give repeated events; an empty table gives no row; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.lineage import durable

CALLS = "content string, tool_calls array<struct<id string, name string, arguments string, after array<string>, function struct<name string, arguments string>>>"
DECLARED = "tools array<struct<name string, parameters string, function struct<name string, parameters string>>>"
PARAMETERS = "properties map<string, struct<type string>>, required array<string>"
RESULT = "tool_call_id string, content string"
#: Types of schema rows, and the beginning of the type names that fit them.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DECIMAL|DOUBLE|FLOAT", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT"}
EVENT = ["conv_id", "turn", "level", "step", "kind", "call_id", "status", "valid", "json"]


def _json(**fields: Column) -> Column:
    """An object with its keys in order; null fields are left out but for `content`."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def _canonical(text: Column) -> Column:
    """JSON with the keys of all objects in order (a variant keeps them so); null if it is none."""
    return F.to_json(F.try_parse_json(text))


def parsed(messages: DataFrame) -> DataFrame:
    rows = messages.select("conv_id", "turn", "role", "text")
    object_like = F.col("text").rlike(r"^\s*\{")
    said = F.from_json(F.when((F.col("role") == "assistant") & object_like, F.col("text")), CALLS)
    got = F.from_json(F.when((F.col("role") == "tool") & object_like, F.col("text")), RESULT)
    rows = rows.withColumns({"said": said, "got": got})
    return rows.withColumns({
        "is_call": F.coalesce(F.size("said.tool_calls") > 0, F.lit(False)),
        "is_result": F.col("got.tool_call_id").isNotNull(),
    })


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls that name others in `after`, in one round of joins per level."""
    named = calls.filter(F.size("after") > 0)
    edges = durable(named.select("conv_id", "call_id", F.explode("after").alias("dep")).distinct())
    if edges.isEmpty():
        return edges.select("conv_id", "call_id", F.lit(0).alias("level"))
    nodes = calls.select("conv_id", "call_id").filter("call_id is not null").distinct()
    waiting = edges.select("conv_id", "call_id").distinct()
    done = durable(nodes.join(waiting, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)))
    while True:
        met = edges.join(done.select("conv_id", F.col("call_id").alias("dep"), "level"), ["conv_id", "dep"], "left")
        ready = met.groupBy("conv_id", "call_id").agg(F.max("level").alias("level"), F.count("level").alias("met"), F.count(F.lit(1)).alias("all"))
        fresh = ready.filter("met = `all`").select("conv_id", "call_id", (F.col("level") + 1).alias("level")).join(done.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
        fresh = durable(fresh)
        if fresh.isEmpty():
            break
        done = durable(done.unionByName(fresh))
    return waiting.join(done, ["conv_id", "call_id"], "left")


def declared(messages: DataFrame) -> DataFrame:
    """(conv_id, tool, parameter, type, required) of the tools in system texts; a tool without parameters has one row, its parameter null."""
    system = messages.filter((F.col("role") == "system") & F.col("text").rlike(r"^\s*\{")).select("conv_id", F.from_json("text", DECLARED).alias("d"))
    tools = system.select("conv_id", F.explode("d.tools").alias("t")).select(
        "conv_id", F.coalesce("t.name", "t.function.name").alias("tool"), F.from_json(F.coalesce("t.parameters", "t.function.parameters"), PARAMETERS).alias("p")
    ).filter("tool is not null")
    needed = F.coalesce("p.required", F.array().cast("array<string>"))
    named = F.array_union(F.coalesce(F.map_keys("p.properties"), F.array().cast("array<string>")), needed)
    each = tools.withColumns({"needed": needed, "parameter": F.explode_outer(named)})
    return each.select("conv_id", "tool", "parameter", F.try_element_at("p.properties", F.col("parameter"))["type"].alias("type"), F.array_contains("needed", F.col("parameter")).alias("required"))


def checked(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """`calls` with `valid`: the tool is known, required parameters are there, all given ones are known and of their type.

    With `conv_id` among the schemas' columns they hold for their conversation, and a conversation without any has null.
    """
    own = "conv_id" in schemas.columns
    fits = F.element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), F.col("type"))
    keys = [F.col("conv_id").alias("_conv")] * own + [F.col("tool")]
    rules = schemas.filter("tool is not null").groupBy(*keys, "parameter").agg(
        F.array_join(F.array_sort(F.collect_set(F.coalesce(fits, F.lit(".*")))), "|").alias("fits"), F.bool_or(F.coalesce("required", F.lit(False))).alias("required")
    )
    tools = rules.groupBy(*["_conv"] * own, "tool").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("parameter").isNotNull(), F.struct("parameter", "fits")))).alias("known"),
        F.collect_set(F.when(F.col("required"), F.col("parameter"))).alias("needed"),
    )
    object_only = F.when(F.schema_of_variant(F.try_parse_json("arguments")).startswith("OBJECT"), F.col("arguments"))
    given = calls.withColumn("given", F.from_json(object_only, "map<string,variant>"))
    same = F.col("name") == F.col("tool")
    joined = given.join(tools, same & F.col("conv_id").eqNullSafe(F.col("_conv")) if own else same, "left")
    each = F.forall(F.map_entries("given"), lambda e: F.coalesce(F.regexp_like(F.schema_of_variant(e["value"]), F.concat(F.lit("^("), F.element_at("known", e["key"]), F.lit(")"))), F.lit(False)))
    whole = F.forall("needed", lambda p: F.map_contains_key("given", p))
    found = joined.withColumn("valid", F.coalesce(each & whole, F.lit(False))).drop("given", "tool", "known", "needed", "_conv")
    if not own:
        return found
    asked = schemas.select(F.col("conv_id").alias("_conv")).distinct().withColumn("_asked", F.lit(True))
    found = found.join(asked, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return found.withColumn("valid", F.when(F.col("_asked"), F.col("valid"))).drop("_conv", "_asked")


def linked(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """Events of all conversations: columns `EVENT`."""
    rows = parsed(messages)
    none = lambda kind: F.lit(None).cast(kind)
    plain = rows.filter(~F.col("is_result"))
    content = F.when(F.col("is_call"), F.col("said.content")).otherwise(F.col("text"))
    message = plain.select(
        "conv_id", "turn", F.lit(0).alias("level"), F.lit(-1).alias("step"), F.lit("message").alias("kind"), none("string").alias("call_id"),
        F.lit("message").alias("status"), none("boolean").alias("valid"), _json(content=content, role=F.col("role")).alias("json"),
    )
    called = durable(rows.filter("is_call").select("conv_id", "turn", F.posexplode("said.tool_calls").alias("k", "c")).select("conv_id", "turn", "k", F.col("c.id").alias("call_id"), F.coalesce("c.name", "c.function.name").alias("name"), F.coalesce("c.arguments", "c.function.arguments").alias("arguments"), F.coalesce("c.after", F.array().cast("array<string>")).alias("after")))
    nth = Window.partitionBy("conv_id", "call_id").orderBy("turn", "k")
    calls = checked(called, schemas).withColumn("nth", F.row_number().over(nth))
    level = levels(called).withColumnsRenamed({"conv_id": "_conv", "call_id": "_call", "level": "_level"})
    calls = calls.join(level, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("call_id") == F.col("_call")), "left")
    calls = calls.withColumn("level", F.when(F.size("after") > 0, F.col("_level")).otherwise(0)).drop("_conv", "_call", "_level")
    results = rows.filter("is_result").select("conv_id", "turn", F.col("got.tool_call_id").alias("call_id"), F.col("got.content").alias("content"))
    results = results.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "call_id").orderBy("turn")))
    left = calls.alias("c")
    right = results.alias("r")
    match = F.col("c.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("c.call_id") == F.col("r.call_id")) & (F.col("c.nth") == F.col("r.nth"))
    met = durable(left.join(right, match, "full_outer").select(
        F.coalesce("c.conv_id", "r.conv_id").alias("conv_id"), F.coalesce("c.turn", "r.turn").alias("turn"), "c.level", F.coalesce("c.k", F.lit(0)).alias("k"),
        F.coalesce("c.call_id", "r.call_id").alias("call_id"), F.col("c.nth").isNotNull().alias("has_call"), F.col("r.nth").isNotNull().alias("has_result"), "c.name", "c.arguments", "c.valid", "r.content",
    ))
    one = met.filter("has_call").select(
        "conv_id", "turn", "level", (F.col("k") * 2).alias("step"), F.lit("call").alias("kind"), "call_id", F.when(F.col("has_result"), "linked").otherwise("no_result").alias("status"), "valid",
        _json(arguments=F.coalesce(_canonical(F.col("arguments")), F.to_json(F.struct(F.col("arguments").alias("text")))), id=F.col("call_id"), name=F.col("name"), role=F.lit("call")).alias("json"),
    )
    other = met.filter("has_result").select(
        "conv_id", "turn", "level", (F.col("k") * 2 + 1).alias("step"), F.lit("result").alias("kind"), "call_id", F.when(F.col("has_call"), "linked").otherwise("no_call").alias("status"), none("boolean").alias("valid"),
        _json(content=F.coalesce(_canonical(F.col("content")), F.col("content")), id=F.col("call_id"), role=F.lit("tool")).alias("json"),
    )
    return message.unionByName(one).unionByName(other).select(*EVENT)


def chat_format(conversations: DataFrame) -> DataFrame:
    """Events of the conversations, their calls checked against the tools that their system texts declare."""
    return linked(conversations, declared(conversations))


#: For tables whose texts hold no tool call or result, as the given ones: every row is a message.
ORACLE = """
SELECT conv_id, turn, 0 AS level, -1 AS step, 'message' AS kind, NULL::VARCHAR AS call_id, 'message' AS status, NULL::BOOLEAN AS valid,
       '{' || CASE WHEN text IS NULL THEN '' ELSE '"content":' || to_json(text)::VARCHAR || CASE WHEN role IS NULL THEN '' ELSE ',' END END
           || CASE WHEN role IS NULL THEN '' ELSE '"role":' || to_json(role)::VARCHAR END || '}' AS json
FROM conversations
"""
