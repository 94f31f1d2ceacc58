"""Chat formatting with linked tool calls, in DataFrame expressions only.

Messages carry the calls that they make and the id of the call that they answer. Calls and results meet in an equi
join on (conversation, call id); results are brought to one row an id first, so ids that many rows share cost no
product. A call may name the calls that it needs, one id or a list of them, in its argument ``after``; its level is one
more than the highest of theirs, so (level, turn, kind) puts every call behind what it needs and every result behind
its call. Levels come from joins over the ids that are still open: each round replaces an id with one open need by
what that one stands for, so chains take rounds in the logarithm of their length, and ids with several open needs take one round for
each such id on the deepest path. Arguments are brought to one form for each number, parsed, checked against the
tool's JSON schema (types, enum, properties, required, additionalProperties, items) and written with sorted keys.

Defined cases: a null or empty content is written as an empty string; a null role as "unknown"; a repeated call id
links each of its calls to the first answer, and who needs that id stands behind all of its calls, each of which keeps its own
needs and level; a result without a call is an unlinked result and has no level; malformed arguments
are invalid, written as a JSON string of what they were, and need nothing; calls in a cycle, or behind a missing
call, have no level; a null conv_id links nothing; repeated message rows are written each; numbers outside 20 digits before
and 18 behind the point are doubles; an empty table gives an empty result; columns beyond those named below are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import let, table, written

_AFTER = {"type": ["string", "array"], "items": {"type": "string"}}
#: tool -> JSON schema of its arguments
SCHEMAS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}, "after": _AFTER}, "required": ["query", "limit"]},
    "lookup": {"type": "object", "properties": {"query": {"type": "string"}, "after": _AFTER}, "required": ["query"]},
}

#: A weight that only cycles reach: more calls than a conversation can have.
CYCLE = 1 << 31

#: JSON type -> what schema_of_variant() says of its values
KINDS = {"string": "STRING", "integer": r"BIGINT|DECIMAL\(\d+,0\)", "number": r"BIGINT|DOUBLE|DECIMAL\(\d+,\d+\)", "boolean": "BOOLEAN", "null": "VOID", "object": "OBJECT<.*", "array": "ARRAY<.*"}
TOKENS = r'("(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|[^"\d-]+|.)'


def one_form(raw: Column) -> Column:
    """JSON text with every number of a point or an exponent as a plain decimal without trailing zeros, if a decimal can hold it."""

    def plain(token: Column) -> Column:
        exact = token.try_cast("decimal(38,18)")
        short = F.regexp_replace(F.regexp_replace(exact.cast("string"), r"0+$", ""), r"\.$", "")
        return F.when(exact.cast("double") == token.try_cast("double"), F.when(exact == 0, "0").otherwise(short)).otherwise(token)

    number = lambda x: x.rlike(r"^-?\d.*[.eE]|^-0$")
    whole = F.array_join(F.transform(F.regexp_extract_all(raw, F.lit(TOKENS), F.lit(1)), lambda x: F.when(number(x), plain(x)).otherwise(x)), "")
    return F.when(raw.rlike(r"\d[.eE]|-0"), whole).otherwise(raw)


def fits(value: Column, schema: dict) -> Column:
    """Whether a variant meets a JSON schema; null if there is no value."""
    kind = F.schema_of_variant(value)
    ok = F.lit(True)
    if "type" in schema:
        types = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        ok = kind.rlike("^(?:" + "|".join(KINDS[t] for t in types) + ")$")
    if "enum" in schema:
        ok = ok & F.to_json(value).isin([json.dumps(x, ensure_ascii=False, separators=(",", ":"), sort_keys=True) for x in schema["enum"]])
    for name, below in schema.get("properties", {}).items():
        child = F.try_variant_get(value, f"$['{name}']", "variant")
        ok = ok & (~kind.startswith("OBJECT<") | F.coalesce(fits(child, below), F.lit(name not in schema.get("required", []))))
    if schema.get("additionalProperties") is False:
        keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
        ok = ok & F.coalesce(F.size(F.array_except(keys, F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>"))) == 0, F.lit(True))
    if "items" in schema:
        ok = ok & F.coalesce(F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda x: fits(x, schema["items"])), F.lit(True))
    return ok


def valid(tool: Column, arguments: Column, schemas: dict) -> Column:
    """Whether parsed arguments meet the tool's schema; false for unknown tools and null arguments."""
    out = F.lit(False)
    for name, schema in schemas.items():
        out = F.when(tool == name, fits(arguments, schema)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def levels(needs: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the ids that an order exists for; needs: (conv_id, call_id, after), a row for each id needed, or one with null.

    Rows of ``front`` say that an id's level is w at least (to is null), or w more than that of ``to``. A round puts
    what is known of each ``to`` with at most one open need in its place. The ids that no round
    resolves stand in or behind a cycle or a missing call. In a cycle w doubles with each round; rows beyond CYCLE, which no chain of
    calls is as long as, stay as they are.
    """
    w = F.when(F.col("after").isNull(), 0).otherwise(1).cast("long")
    front = written(needs.select("conv_id", "call_id", F.col("after").alias("to"), w.alias("w")).distinct(), "needs")
    before = None
    while True:
        known = front.groupBy("conv_id", F.col("call_id").alias("to")).agg(F.count("to").alias("open"), F.max(F.when(F.col("to").isNull(), F.col("w"))).alias("base"), F.max(F.when(F.col("to").isNotNull(), F.struct("to", "w"))).alias("one"))
        now = known.filter("open > 0").count()
        if now in (0, before):
            return known.filter("open = 0").select("conv_id", F.col("to").alias("call_id"), F.col("base").cast("int").alias("level"))
        before = now
        met = front.filter("to is not null").join(known.filter(F.col("open") < 2).filter(F.coalesce("one.w", F.lit(0)) < CYCLE), ["conv_id", "to"], "left")
        none = F.lit(None).cast("string")
        base = F.when(F.col("base").isNotNull(), F.struct(none.alias("to"), (F.col("w") + F.col("base")).alias("w")))
        ahead = F.when(F.col("open").isNull(), F.struct("to", "w")).when(F.col("open") == 1, F.struct(F.col("one.to").alias("to"), (F.col("w") + F.col("one.w")).alias("w")))
        met = met.select("conv_id", "call_id", F.inline(F.array_compact(F.array(base, ahead))))
        front = written(front.filter("to is null").unionByName(met).groupBy("conv_id", "call_id", "to").agg(F.max("w").alias("w")), "needs")


def format_chats(messages: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """messages: conv_id, turn, role, content, calls array<struct<id, name, arguments string>>, answers string.

    A row for each message, call and result: conv_id, turn, kind, call_id, level, linked, valid, json.
    """
    role, content = F.coalesce("role", F.lit("unknown")), F.coalesce("content", F.lit(""))
    said = messages.select("conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("boolean").alias("linked"), F.lit(None).cast("boolean").alias("valid"), F.to_json(F.struct(content.alias("content"), role.alias("role"))).alias("json"))
    calls = messages.select("conv_id", "turn", F.posexplode("calls").alias("place", "c")).select("conv_id", "turn", "place", F.col("c.id").alias("call_id"), F.col("c.name").alias("tool"), F.col("c.arguments").alias("raw"))
    calls = calls.withColumn("arguments", F.try_parse_json(one_form(F.col("raw")))).withColumn("node", F.xxhash64("turn", "place", "call_id", "tool", "raw"))
    after = let(F.try_variant_get("arguments", "$.after", "variant"), lambda x: F.when(F.schema_of_variant(x).startswith("ARRAY<"), F.try_variant_get(x, "$", "array<string>")).otherwise(F.array(F.try_variant_get(x, "$", "string"))))
    needs = calls.select("conv_id", "call_id", "node", F.explode_outer(F.array_distinct(F.array_compact(after))).alias("after"))
    results = messages.filter("answers is not null").select("conv_id", F.col("answers").alias("call_id"), "turn", content.alias("content"))
    first = results.groupBy("conv_id", "call_id").agg(F.min("turn").alias("answered"))
    at = levels(needs.select("conv_id", "call_id", "after"))
    known = calls.select("conv_id", "call_id").distinct().join(at, ["conv_id", "call_id"], "left").withColumn("linked", F.lit(True))
    below = needs.filter("after is not null").select("conv_id", "node", "after").distinct().join(at.select("conv_id", F.col("call_id").alias("after"), F.col("level").alias("below")), ["conv_id", "after"], "left")
    below = below.groupBy("conv_id", "node").agg(F.when(F.count("below") == F.count("*"), F.max("below") + 1).otherwise(-1).alias("level"))
    below = below.withColumnsRenamed({"conv_id": "__conv", "node": "__node"})
    calls = calls.join(below, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("node") == F.col("__node")), "left").withColumn("level", F.coalesce("level", F.lit(0)))
    ok = valid(F.col("tool"), F.col("arguments"), schemas)
    written_arguments = F.when(F.col("arguments").isNotNull(), F.to_json("arguments")).otherwise(quoted(F.coalesce("raw", F.lit(""))))
    call_json = F.concat(F.lit('{"arguments":'), written_arguments, F.lit(',"id":'), quoted(F.coalesce("call_id", F.lit(""))), F.lit(',"tool":'), quoted(F.coalesce("tool", F.lit(""))), F.lit("}"))
    asked = calls.join(first, ["conv_id", "call_id"], "left").select("conv_id", "turn", F.lit("call").alias("kind"), "call_id", F.nullif("level", F.lit(-1)).alias("level"), F.col("answered").isNotNull().alias("linked"), ok.alias("valid"), call_json.alias("json"))
    got = results.join(known, ["conv_id", "call_id"], "left").select("conv_id", "turn", F.lit("result").alias("kind"), "call_id", "level", F.coalesce("linked", F.lit(False)).alias("linked"), F.lit(None).cast("boolean").alias("valid"), F.to_json(F.struct(F.col("content"), F.col("call_id").alias("id"))).alias("json"))
    return said.unionByName(asked).unionByName(got)


def quoted(text: Column) -> Column:
    """text as a JSON string."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def tool_messages(conversations: DataFrame) -> DataFrame:
    """Turns read as tool traffic: a user's turn calls a tool with its text, an assistant's turn answers the turn before.

    Arguments come with spaces and unsorted keys, and some are wrong in kind, wait for an earlier call or aren't JSON.
    """
    call_id = lambda turn: F.concat(F.lit("c"), F.col("conv_id"), F.lit("_"), turn)
    conv, turn, text = F.col("conv_id"), F.col("turn"), F.coalesce("text", F.lit(""))
    limit = F.when(conv % 7 == 3, quoted(turn.cast("string"))).otherwise((turn + 1).cast("string"))
    after = F.when((turn >= 2) & (conv % 3 == 0), F.concat(F.lit(', "after": '), quoted(call_id(turn - 2)))).otherwise("")
    raw = F.concat(F.lit('{ "query": '), quoted(text), after, F.lit(', "limit": '), limit, F.when(conv % 11 == 5, "").otherwise(" }"))
    call = F.struct(call_id(turn).alias("id"), F.when(turn % 4 == 0, "search").otherwise("lookup").alias("name"), raw.alias("arguments"))
    calls = F.when(F.col("role") == "user", F.array(call))
    answers = F.when((F.col("role") == "assistant") & (conv % 13 != 6), call_id(turn - 1))
    return conversations.select("conv_id", "turn", "role", F.col("text").alias("content"), calls.alias("calls"), answers.alias("answers"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """call_id is empty and level -1 where there is none; linked and valid are false where they say nothing."""
    return format_chats(tool_messages(table(spark, sf_dir, "conversations"))).fillna({"call_id": "", "level": -1, "linked": False, "valid": False})


OP7_SQL = """
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS content,
    CASE WHEN role = 'user' THEN 'c' || conv_id || '_' || turn END AS call_id,
    CASE WHEN role = 'user' AND turn >= 2 AND conv_id % 3 = 0 AND conv_id % 11 <> 5 THEN 'c' || conv_id || '_' || (turn - 2) END AS after,
    CASE WHEN role = 'assistant' AND conv_id % 13 <> 6 THEN 'c' || conv_id || '_' || (turn - 1) END AS answers
  FROM conversations
), c AS (
  SELECT *, CASE WHEN turn % 4 = 0 THEN 'search' ELSE 'lookup' END AS tool,
    '{ "query": ' || to_json(content) || CASE WHEN turn >= 2 AND conv_id % 3 = 0 THEN ', "after": ' || to_json('c' || conv_id || '_' || (turn - 2)) ELSE '' END
      || ', "limit": ' || CASE WHEN conv_id % 7 = 3 THEN to_json(CAST(turn AS VARCHAR)) ELSE CAST(turn + 1 AS VARCHAR) END AS raw
  FROM m WHERE role = 'user'
), lv AS (
  SELECT conv_id, call_id, 0 AS level FROM c WHERE after IS NULL
  UNION ALL SELECT c.conv_id, c.call_id, lv.level + 1 FROM c JOIN lv ON c.conv_id = lv.conv_id AND c.after = lv.call_id
)
SELECT conv_id, turn, 'message' AS kind, '' AS call_id, -1 AS level, false AS linked, false AS valid,
  '{"content":' || to_json(content) || ',"role":' || to_json(coalesce(role, 'unknown')) || '}' AS json FROM m
UNION ALL
SELECT c.conv_id, c.turn, 'call', c.call_id, coalesce(lv.level, -1), EXISTS (SELECT 1 FROM m WHERE m.conv_id = c.conv_id AND m.answers = c.call_id),
  c.conv_id % 11 <> 5 AND (c.tool = 'lookup' OR c.conv_id % 7 <> 3),
  '{"arguments":' || CASE WHEN c.conv_id % 11 = 5 THEN to_json(c.raw) ELSE
      '{' || CASE WHEN c.after IS NOT NULL THEN '"after":' || to_json(c.after) || ',' ELSE '' END
      || '"limit":' || CASE WHEN c.conv_id % 7 = 3 THEN to_json(CAST(c.turn AS VARCHAR)) ELSE CAST(c.turn + 1 AS VARCHAR) END
      || ',"query":' || to_json(c.content) || '}' END
    || ',"id":' || to_json(c.call_id) || ',"tool":' || to_json(c.tool) || '}'
FROM c LEFT JOIN lv USING (conv_id, call_id)
UNION ALL
SELECT m.conv_id, m.turn, 'result', m.answers, coalesce(lv.level, -1), EXISTS (SELECT 1 FROM c WHERE c.conv_id = m.conv_id AND c.call_id = m.answers), false,
  '{"content":' || to_json(m.content) || ',"id":' || to_json(m.answers) || '}'
FROM m LEFT JOIN lv ON lv.conv_id = m.conv_id AND lv.call_id = m.answers WHERE m.answers IS NOT NULL
"""
