"""Chat formatting with linked tool calls.

Calls and results are joined by identifier, one call and one result to each; what is left over on either side is
marked. Calls are ordered after those they wait for by pointer doubling, which takes rounds logarithmic in the longest
chain and notices circles. Arguments are validated against the schema of the tool, and every message becomes one line of
canonical JSON: keys sorted, no blanks. Messages stay rows; no conversation is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace

#: A tool's schema: its fields with type, whether they are required, and the most characters of a string.
SCHEMAS = {
    "ask": {"prompt": ("string", True, 400), "turn": ("integer", True, None)},
    "follow_up": {"after": ("string", True, 64), "prompt": ("string", True, 400), "turn": ("integer", True, None)},
}
INTEGERS = ("TINYINT", "SMALLINT", "INT", "BIGINT")


def canonical_json(text: Column) -> Column:
    """Sorted keys, no blanks; null where ``text`` isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def argument_error(name: Column, arguments: Column, schemas: dict = SCHEMAS) -> Column:
    """The first thing wrong with a call's arguments, fields in alphabetical order; null where all is right."""
    parsed = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    by_tool = F.lit("unknown tool")
    for tool, fields in schemas.items():
        checks = [F.when(parsed.isNull() | keys.isNull(), F.lit("not an object"))]
        checks.append(F.when(F.size(F.array_except(keys, F.array(*(F.lit(k) for k in sorted(fields))))) > 0, F.lit("unknown field")))
        for field, (kind, required, most) in sorted(fields.items()):
            value = F.try_variant_get(parsed, f"$.{field}", "variant")
            type_ = F.schema_of_variant(value)
            absent = value.isNull() | (type_ == "VOID")
            if required:
                checks.append(F.when(absent, F.lit(f"{field}: missing")))
            wrong = ~type_.isin(*INTEGERS) if kind == "integer" else type_ != kind.upper()
            checks.append(F.when(~absent & wrong, F.lit(f"{field}: not {kind}")))
            if most is not None:
                text = F.try_variant_get(parsed, f"$.{field}", "string")
                checks.append(F.when(F.length(text) > most, F.lit(f"{field}: too long")))
        by_tool = F.when(name == tool, F.coalesce(*checks)).otherwise(by_tool)
    return by_tool


def call_levels(calls: DataFrame, ws: Workspace) -> DataFrame:
    """``calls(call_id, after)``, one row an id -> ``call_id, level``; level -1 for calls in or behind a circle.

    Level 0 waits for nothing, or for a call that isn't there.
    """
    known = calls.select(F.col("call_id").alias("known")).hint("shuffle_hash")
    now = calls.join(known, F.col("after") == F.col("known"), "left").select("call_id", F.col("known").alias("up"), F.when(F.col("known").isNull(), 0).otherwise(1).cast("long").alias("level"))
    now, n, steps = ws.keep(now, "levels"), None, 1
    while True:
        waiting = now.where("up is not null").count()
        if not waiting:
            break
        n = n or now.count()
        if steps > 2 * n:  # longer than any chain: what still waits is circular
            return now.select("call_id", F.when(F.col("up").isNull(), F.col("level")).otherwise(-1).alias("level"))
        above = now.select(F.col("call_id").alias("id"), F.col("up").alias("next"), F.col("level").alias("more")).hint("shuffle_hash")
        now = now.join(above, F.col("up") == F.col("id"), "left").select("call_id", F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"))
        now, steps = ws.keep(now, "levels"), steps * 2
    return now.select("call_id", "level")


def linked(messages: DataFrame, ws: Workspace, schemas: dict = SCHEMAS) -> DataFrame:
    """Links, orders, validates and serialises messages.

    ``messages(conv_id, turn, role, kind, call_id, name, after, arguments, content)``, ``kind`` one of call, result and
    text. Of several calls (results) with one id the first by turn and content is linked, the others are ``duplicate``.
    Calls without a result are ``pending``, results without a call ``orphan``. A null id links with nothing. Null
    content is the empty text, a null kind text. ``position`` orders a conversation: twice the level of the call, plus one for its result;
    messages without a level come first, at -1. Null turns rank before all others. An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    messages = messages.select("conv_id", "turn", "role", F.coalesce("kind", F.lit("text")).alias("kind"), "call_id", "name", "after", "arguments", "content")
    rank = F.struct("turn", F.coalesce("arguments", F.lit("")).alias("arguments"), F.coalesce("content", F.lit("")).alias("content"), F.coalesce("after", F.lit("")).alias("after"))
    ids = messages.where("call_id is not null and kind in ('call', 'result')").groupBy("call_id").agg(
        F.min(F.when(F.col("kind") == "call", rank)).alias("call"), F.min(F.when(F.col("kind") == "result", rank)).alias("result")
    )
    ids = ws.keep(ids, "ids")
    levels = call_levels(ids.where("call is not null").select("call_id", F.col("call.after").alias("after")), ws)
    ids = ids.join(levels, "call_id", "left")
    mine, linkable = messages.withColumn("mine", rank), F.col("call_id").isNotNull() & F.col("kind").isin("call", "result")
    rows = mine.where(linkable).join(ids.hint("shuffle_hash"), "call_id", "left").unionByName(mine.where(~linkable), allowMissingColumns=True)
    first = F.when(F.col("kind") == "call", F.col("mine").eqNullSafe(F.col("call"))).otherwise(F.col("mine").eqNullSafe(F.col("result")))
    partner = F.when(F.col("kind") == "call", F.col("result").isNotNull()).otherwise(F.col("call").isNotNull())
    status = F.when(F.col("kind") == "text", "text").when(F.col("call_id").isNull() | ~partner, F.when(F.col("kind") == "call", "pending").otherwise("orphan")).when(~first, "duplicate").otherwise("linked")
    position = F.when((F.col("kind") == "text") | F.col("level").isNull(), F.lit(-1)).otherwise(2 * F.col("level") + F.when(F.col("kind") == "result", 1).otherwise(0))
    error = F.when(F.col("kind") == "call", F.when(F.col("level") < 0, F.lit("circular")).otherwise(argument_error(F.col("name"), F.col("arguments"), schemas)))
    content = F.coalesce("content", F.lit(""))
    call = F.concat(F.lit('{"arguments":'), F.coalesce(canonical_json(F.col("arguments")), F.lit("null")), F.lit(","), F.substr(F.to_json(F.struct(F.coalesce("call_id", F.lit("")).alias("call_id"), F.lit("call").alias("kind"), F.coalesce("name", F.lit("")).alias("name"))), F.lit(2)))
    result = F.to_json(F.struct(F.coalesce("call_id", F.lit("")).alias("call_id"), content.alias("content"), F.lit("result").alias("kind")))
    text = F.to_json(F.struct(content.alias("content"), F.lit("text").alias("kind"), F.coalesce("role", F.lit("")).alias("role")))
    line = F.when(F.col("kind") == "call", call).when(F.col("kind") == "result", result).otherwise(text)
    return rows.select("conv_id", "turn", "role", "call_id", status.alias("status"), position.cast("long").alias("position"), error.alias("error"), line.alias("message_json"))


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Reads turns as tool messages: a user's turn calls the assistant, whose next turn is the result.

    The first call of a conversation is ``ask``; later ones are ``follow_up`` and wait for the call two turns before.
    """
    turn, conv = F.col("turn").cast("long"), F.col("conv_id").cast("long")
    named = lambda t: F.concat(F.lit("call-"), conv.cast("string"), F.lit("-"), t.cast("string"))
    kind = F.when(F.col("role") == "user", "call").when(F.col("role") == "assistant", "result").otherwise("text")
    rows = conversations.select(conv.alias("conv_id"), turn.alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content")).withColumn("kind", kind)
    id_ = F.when(F.col("kind") == "call", named(F.col("turn"))).when(F.col("kind") == "result", named(F.col("turn") - 1))
    later = (F.col("kind") == "call") & (F.col("turn") >= 2)
    after = F.when(later, named(F.col("turn") - 2))
    arguments = F.when(later, F.to_json(F.struct(after.alias("after"), F.col("content").alias("prompt"), F.col("turn")))).when(F.col("kind") == "call", F.to_json(F.struct(F.col("content").alias("prompt"), F.col("turn"))))
    return rows.select("conv_id", "turn", "role", "kind", id_.alias("call_id"), F.when(later, "follow_up").when(F.col("kind") == "call", "ask").alias("name"), after.alias("after"), arguments.alias("arguments"), "content")


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(conversation_messages(spark.read.parquet(f"{sf_dir}/conversations.parquet")), Workspace(spark))


OP9_SQL = """
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS content,
         CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'text' END AS kind FROM conversations
), named AS (
  SELECT *, CASE kind WHEN 'call' THEN 'call-' || conv_id || '-' || turn WHEN 'result' THEN 'call-' || conv_id || '-' || (turn - 1) END AS call_id,
         CASE WHEN kind = 'call' AND turn >= 2 THEN 'call-' || conv_id || '-' || (turn - 2) END AS after
  FROM m
), levels AS (
  SELECT c.call_id, 0 AS level FROM named c WHERE kind = 'call' AND NOT EXISTS (SELECT 1 FROM named p WHERE p.kind = 'call' AND p.call_id = c.after)
  UNION ALL
  SELECT c.call_id, level + 1 FROM named c JOIN levels l ON c.after = l.call_id WHERE c.kind = 'call'
), sides AS (
  SELECT call_id, count(*) FILTER (kind = 'call') AS calls, count(*) FILTER (kind = 'result') AS results FROM named WHERE call_id IS NOT NULL GROUP BY call_id
)
SELECT conv_id, turn, role, n.call_id,
  CASE WHEN kind = 'text' THEN 'text' WHEN kind = 'call' AND results = 0 THEN 'pending' WHEN kind = 'result' AND calls = 0 THEN 'orphan' ELSE 'linked' END AS status,
  CASE WHEN kind = 'text' OR level IS NULL THEN -1 ELSE 2 * level + (kind = 'result')::INT END::BIGINT AS position,
  CASE WHEN kind = 'call' AND length(content) > 400 THEN 'prompt: too long' END AS error,
  CASE kind
    WHEN 'call' THEN '{"arguments":' || CASE WHEN turn >= 2 THEN json_object('after', after, 'prompt', content, 'turn', turn) ELSE json_object('prompt', content, 'turn', turn) END
      || ',"call_id":' || to_json(n.call_id) || ',"kind":"call","name":"' || CASE WHEN turn >= 2 THEN 'follow_up' ELSE 'ask' END || '"}'
    WHEN 'result' THEN json_object('call_id', n.call_id, 'content', content, 'kind', 'result')::VARCHAR
    ELSE json_object('content', content, 'kind', 'text', 'role', role)::VARCHAR END AS message_json
FROM named n LEFT JOIN sides s ON n.call_id = s.call_id LEFT JOIN levels l ON n.call_id = l.call_id
"""
