"""Tool calls of conversations: linked to their results, ordered, validated, and serialised.

Calls and results are hash-joined by conversation and identifier. A call may name the call it
comes ``after``; its depth in that forest is found by doubling the distance to the ancestor, for the
calls that are not at a root yet. Calls of a conversation are then numbered by depth, turn and
identifier: all calls are sorted by ranges once, a call's number is its place there less the place
of its conversation's first one. A result stands right after its call, so positions have no ties.
Arguments are checked against the schema of their tool, and every message becomes one canonical JSON
text: keys sorted, no blanks, absent values left out. A conversation is never gathered; its messages
are rows with a position.

Of calls (or results) that give one identifier different contents, the first by turn and content
counts, and every other content is a ``conflict`` (no position, no result); ``copies`` is the number
of rows of one content. A call without a result is ``no result``, a result without a call ``orphan``
(no position); a message without an identifier is ``no id``. A call after one that is not there
starts anew; calls that wait for each other are a ``cycle`` (no position). Turns without a role are
``no role``. Arguments that are no JSON object are invalid. Null conversations are one conversation.
Very long texts are kept whole, and empty tables give no messages. Extra columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptframe.llm.registry import query, table, written


@dataclass(frozen=True)
class Field:
    """What a tool expects of one argument: its JSON type and bounds."""

    type: str
    required: bool = True
    least: float | None = None
    longest: int | None = None
    one_of: tuple[str, ...] | None = None


#: Names of a variant's type by JSON type.
_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN",
          "array": "ARRAY.*", "object": "OBJECT.*"}


def json_text(value: Column) -> Column:
    """A JSON string literal; null stays null."""
    listed = F.to_json(F.array(value.cast("string")))
    return F.when(value.isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))


def canonical(json: Column) -> Column:
    """A JSON text with sorted keys and no blanks; null if it is not JSON."""
    return F.to_json(F.try_parse_json(json))


def json_object(**members: Column) -> Column:
    """The canonical object of JSON texts by name; members that are null are left out."""
    parts = [F.concat(F.lit(f'"{name}":'), members[name]) for name in sorted(members)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def violations(name: Column, arguments: Column, tools: dict[str, dict[str, Field]]) -> Column:
    """What is wrong with the arguments of a call, in order of the fields."""
    value = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    out = F.array(F.concat(F.lit("unknown tool: "), F.coalesce(name, F.lit("null"))))
    for tool, fields in tools.items():
        wrong = []
        for field, want in fields.items():
            own = F.try_variant_get(value, f"$.{field}", "variant")
            there = F.coalesce(F.array_contains(keys, field), F.lit(False)) & ~F.coalesce(F.is_variant_null(own), F.lit(True))
            if want.required:
                wrong.append(F.when(~there, F.lit(f"{field}: missing")))
            right = F.coalesce(F.schema_of_variant(own).rlike(f"^(?:{_TYPES[want.type]})$"), F.lit(False))
            wrong.append(F.when(there & ~right, F.lit(f"{field}: not {want.type}")))
            text, number = F.try_variant_get(value, f"$.{field}", "string"), F.try_variant_get(value, f"$.{field}", "double")
            if want.least is not None:
                wrong.append(F.when(there & right & (number < want.least), F.lit(f"{field}: too small")))
            if want.longest is not None:
                wrong.append(F.when(there & right & (F.length(text) > want.longest), F.lit(f"{field}: too long")))
            if want.one_of is not None:
                wrong.append(F.when(there & right & ~text.isin(*want.one_of), F.lit(f"{field}: not allowed")))
        extra = F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, fields)))),
                            lambda k: F.concat(k, F.lit(": unexpected")))
        found = F.array_compact(F.concat(F.array(*wrong), F.coalesce(extra, F.array().cast("array<string>"))))
        out = F.when(name == tool, F.when(keys.isNull(), F.array(F.lit("not an object"))).otherwise(found)).otherwise(out)
    return out


def depths(calls: DataFrame) -> DataFrame:
    """conv_id, call_id and depth (0 without a known predecessor, null in a cycle)."""
    ids = calls.select("conv_id", "call_id")
    parent = F.col("after").alias("up")
    known = ids.select(F.col("conv_id").alias("c"), F.col("call_id").alias("up"))
    start = calls.select("conv_id", "call_id", parent).join(
        known.withColumn("there", F.lit(True)).withColumnRenamed("up", "u"),
        F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("u")), "left")
    up = F.when(F.col("there"), F.col("up"))
    now = written(start.select("conv_id", "call_id", up.alias("up"),
                               F.when(up.isNull(), 0).otherwise(1).cast("long").alias("depth")), "call-depth")
    total, reach = now.count(), 1
    done, waiting = now.filter("up IS NULL"), now.filter("up IS NOT NULL")
    while reach <= total and not waiting.isEmpty():
        # calls at a root are never written again
        far = done.unionByName(waiting).select(
            F.col("conv_id").alias("c"), F.col("call_id").alias("a"), F.col("up").alias("next"), F.col("depth").alias("more"))
        same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("a"))
        now = written(waiting.join(far, same, "left").select(
            "conv_id", "call_id", F.col("next").alias("up"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "call-depth")
        done, waiting = done.unionByName(now.filter("up IS NULL")), now.filter("up IS NOT NULL")
        reach *= 2
    return done.unionByName(waiting).select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def numbered(calls: DataFrame) -> DataFrame:
    """conv_id, call_id and number (dense from 0 by depth, turn and call_id) of the calls that have a depth.

    Rows are sorted by ranges of the whole order, so a conversation of any size is spread over tasks.
    """
    parts = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "depth", "turn", "call_id"]
    placed = calls.filter("depth IS NOT NULL").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = written(placed.select("conv_id", "call_id", F.monotonically_increasing_id().alias("at")), "call-order")
    part = F.shiftright("at", 33)
    # one row for each task of the sort
    counts = at.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = at.withColumn("part", part).join(shifts, "part").select("conv_id", "call_id", (inside + F.col("shift")).alias("place"))
    first = placed.groupBy("conv_id").agg(F.min("place").alias("first")).select(F.col("conv_id").alias("c"), "first")
    return placed.join(first, placed["conv_id"].eqNullSafe(first["c"])).select(
        "conv_id", "call_id", (F.col("place") - F.col("first")).alias("number"))


def _contents(rows: DataFrame, content: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Of every identifier its first content with its copies, and all other contents with theirs."""
    each = written(rows.groupBy("conv_id", "call_id", *content[1:]).agg(
        F.min(content[0]).alias(content[0]), F.count("*").alias(f"n_{name}s")).select(
        "conv_id", "call_id", F.struct(*content).alias(name), f"n_{name}s"), f"{name}-contents")
    known = each.filter("call_id IS NOT NULL")
    first = known.groupBy("conv_id", "call_id").agg(F.min(name).alias(name), F.min_by(f"n_{name}s", name).alias(f"n_{name}s"))
    several = known.groupBy("conv_id", "call_id").agg(F.min(name).alias("first"), F.count("*").alias("n")).filter("n > 1").select(
        F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), "first")
    same = known["conv_id"].eqNullSafe(several["_c"]) & (known["call_id"] == several["_i"])
    others = known.join(several, same).filter(F.col(name) != F.col("first")).select(*known.columns, F.lit(True).alias("conflict"))
    return first, others.unionByName(each.filter("call_id IS NULL").withColumn("conflict", F.lit(False)))


def link(calls: DataFrame, results: DataFrame, tools: dict[str, dict[str, Field]]) -> DataFrame:
    """Messages of all conversations: conv_id, position, kind, call_id, copies, status, errors, message.

    ``calls`` has conv_id, call_id, after, name, arguments (JSON) and turn; ``results`` has conv_id,
    call_id, content and turn.
    """
    calls = calls.select("conv_id", F.col("call_id").cast("string"), F.col("after").cast("string"), "name", "arguments",
                         F.col("turn").cast("long"))
    results = results.select("conv_id", F.col("call_id").cast("string"), "content", F.col("turn").cast("long"))
    one_call, other_calls = _contents(calls, ["turn", "name", "arguments", "after"], "call")
    one_result, other_results = _contents(results, ["turn", "content"], "result")
    placed = written(one_call.select("*", "call.after"), "calls")
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["call_id"] == b["call_id"])
    depth = depths(placed)
    deep = written(placed.join(depth, same(placed, depth)).select(
        placed["conv_id"], placed["call_id"], "call", "n_calls", "depth"), "calls")
    number = numbered(deep.select("conv_id", "call_id", "depth", "call.turn"))
    ordered = deep.join(number, same(deep, number), "left").select(
        deep["conv_id"], deep["call_id"], "call", "n_calls", "number")
    both = ordered.join(one_result, same(ordered, one_result), "full").select(
        F.when(F.col("call").isNotNull(), ordered["conv_id"]).otherwise(one_result["conv_id"]).alias("conv_id"),
        F.coalesce(ordered["call_id"], one_result["call_id"]).alias("call_id"), "call", "n_calls", "number", "result",
        "n_results", F.lit(False).alias("conflict"))
    every = both.unionByName(other_calls, allowMissingColumns=True).unionByName(other_results, allowMissingColumns=True)
    errors = violations(F.col("call.name"), F.col("call.arguments"), tools)
    every = every.withColumn("errors", errors)
    none = F.array().cast("array<string>")
    apart = F.when(F.col("call_id").isNull(), "no id").when(F.col("conflict"), "conflict")
    call_status = (
        apart.when(F.col("number").isNull(), "cycle")
        .when(F.size("errors") > 0, "invalid arguments").when(F.col("result").isNull(), "no result").otherwise("ok"))
    result_status = apart.when(F.col("call").isNull(), "orphan").otherwise("ok")
    call_row = F.when(F.col("call").isNotNull(), F.struct(
        (2 * F.col("number")).alias("position"), F.lit("call").alias("kind"), F.col("n_calls").cast("long").alias("copies"),
        call_status.alias("status"), F.col("errors").alias("errors"), json_object(
            arguments=F.coalesce(canonical(F.col("call.arguments")), json_text(F.col("call.arguments"))),
            id=json_text(F.col("call_id")), name=json_text(F.col("call.name")),
            type=F.lit('"function"')).alias("message")))
    result_row = F.when(F.col("result").isNotNull(), F.struct(
        (2 * F.col("number") + 1).alias("position"), F.lit("result").alias("kind"),
        F.col("n_results").cast("long").alias("copies"), result_status.alias("status"), none.alias("errors"), json_object(
            content=json_text(F.col("result.content")), role=F.lit('"tool"'),
            tool_call_id=json_text(F.col("call_id"))).alias("message")))
    rows = every.select("conv_id", "call_id", F.explode(F.array_compact(F.array(call_row, result_row))).alias("m"))
    return rows.select("conv_id", "call_id", "m.*")


def calls_in(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The calls and results written as JSON in the texts of messages (conv_id, turn, role, text).

    An assistant's text may hold ``tool_calls`` (id, after, and a function's name and arguments), a
    tool's text a ``tool_call_id`` and its content; other texts hold neither. A tool's text of another
    form is a result without an identifier.
    """
    call = "array<struct<id:string, after:string, function:struct<name:string, arguments:string>>>"
    told = messages.select("conv_id", "turn", "role", "text", F.from_json(
        "text", f"tool_calls {call}, tool_call_id string, content string").alias("m"))
    calls = told.filter("role = 'assistant'").select("conv_id", "turn", F.explode("m.tool_calls").alias("c")).select(
        "conv_id", F.col("c.id").alias("call_id"), "c.after", "c.function.name", "c.function.arguments", "turn")
    results = told.filter("role = 'tool'").select(
        "conv_id", F.col("m.tool_call_id").alias("call_id"), F.coalesce("m.content", "text").alias("content"), "turn")
    return calls, results


def without_role(messages: DataFrame) -> DataFrame:
    """The messages (conv_id, turn, role, text) of no role, in the form of ``link``."""
    message = json_object(content=json_text(F.col("text")), turn=F.col("turn").cast("string"))
    return messages.filter("role IS NULL").groupBy("conv_id", message.alias("message")).agg(F.count("*").alias("copies")).select(
        "conv_id", F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("long").alias("position"),
        F.lit("message").alias("kind"), "copies", F.lit("no role").alias("status"),
        F.array().cast("array<string>").alias("errors"), "message")


#: The tools of the query: a turn is a call of the tool named after its role.
TOOLS = {
    "user": {"text": Field("string", longest=600), "turn": Field("integer", least=0), "words": Field("integer", least=5)},
    "system": {"text": Field("string"), "turn": Field("integer", least=0), "words": Field("integer", required=False)},
}

SQL = r"""
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, role, text, conv_id || ':' || turn AS id, conv_id || ':' || (turn - 2) AS after,
         conv_id || ':' || (turn - 1) AS answered, len(string_split(text, ' ')) AS words FROM conversations),
calls AS (SELECT * FROM turns WHERE role NOT IN ('assistant', 'tool')),
results AS (SELECT * FROM turns WHERE role = 'assistant'),
placed AS (
  SELECT conv_id, id, turn, 0::BIGINT AS depth FROM calls c WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.id = c.after)
  UNION ALL SELECT c.conv_id, c.id, c.turn, p.depth + 1 FROM placed p JOIN calls c ON c.after = p.id),
numbered AS (SELECT id, row_number() OVER (PARTITION BY conv_id ORDER BY depth, turn, id) - 1 AS k FROM placed)
SELECT c.conv_id, c.id AS call_id, 2 * k AS position, 'call' AS kind, 1::BIGINT AS copies,
       CASE WHEN e <> '' THEN 'invalid arguments' WHEN r.id IS NULL THEN 'no result' ELSE 'ok' END AS status, e AS errors,
       '{"arguments":{"text":' || to_json(c.text) || ',"turn":' || c.turn || ',"words":' || c.words || '},"id":"' || c.id
       || '","name":"' || c.role || '","type":"function"}' AS message
FROM (SELECT *, CASE WHEN role <> 'user' THEN '' ELSE concat_ws('; ', CASE WHEN length(text) > 600 THEN 'text: too long' END,
             CASE WHEN words < 5 THEN 'words: too small' END) END AS e FROM calls) c
JOIN numbered USING (id) LEFT JOIN results r ON r.answered = c.id
UNION ALL
SELECT r.conv_id, r.answered, 2 * k + 1, 'result', 1, CASE WHEN k IS NULL THEN 'orphan' ELSE 'ok' END, '',
       '{"content":' || to_json(r.text) || ',"role":"tool","tool_call_id":"' || r.answered || '"}'
FROM results r LEFT JOIN numbered p ON p.id = r.answered
UNION ALL
SELECT conv_id, NULL, NULL, 'message', count(*), 'no role', '', '{"content":' || to_json(text) || ',"turn":' || turn || '}'
FROM conversations WHERE role IS NULL GROUP BY conv_id, turn, text
"""


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, turn, role, text) as calls of a tool named after their role, assistants' as results."""
    name = lambda turn: F.concat_ws(":", "conv_id", turn)
    words = F.size(F.split("text", " "))
    calls = turns.filter("role NOT IN ('assistant', 'tool')").select(
        "conv_id", name(F.col("turn")).alias("call_id"), name(F.col("turn") - 2).alias("after"), F.col("role").alias("name"),
        F.to_json(F.struct(words.alias("words"), "turn", "text")).alias("arguments"), "turn")
    results = turns.filter("role = 'assistant'").select(
        "conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"), "turn")
    return calls, results


def transcripts(turns: DataFrame, tools: dict[str, dict[str, Field]] = TOOLS) -> DataFrame:
    """Messages of all turns, of the calls and results that are written in their texts, and of those without a role."""
    (calls, results), (more_calls, more_results) = turns_as_calls(turns), calls_in(turns)
    linked = link(calls.unionByName(more_calls), results.unionByName(more_results), tools)
    return linked.unionByName(without_role(turns))


@query(SQL)
def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of ``conversations`` as calls (user and system turns) and results (the answers)."""
    linked = transcripts(table(spark, sf_dir, "conversations"))
    return linked.withColumn("errors", F.array_join("errors", "; "))
