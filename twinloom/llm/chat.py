"""Chat formatting: tool calls linked to results, ordered, validated and written as canonical JSON.

Calls and results are two tables that meet in one equi-join on (conversation,
call id). A call has one result, the first in the order of turn and content
(null first); later ones, equal ones too, and those without a call are kept
and marked. A call's depth is one more than that of the deepest call it
depends on, and it stands no earlier than the latest turn of any call that it
depends on, however indirectly; items are put into the order (that turn,
depth, kind, own turn, id), which is a topological order of a conversation's
calls with each result after its call. Arguments are checked against the
tool's schema (JSON object; required names present; types right; no unknown
names) and written anew. Canonical JSON has its keys in order, no blanks, and
no escapes beyond those JSON asks for; numbers are written as Spark's variant
type writes them; arguments that are no JSON become a JSON string.

Everything is DataFrame expressions. No conversation is gathered in one task:
the output has one row per item with its position, and positions come from
counts of blocks of turns, so one conversation may hold any share of the rows.

Defined cases: null text, content or arguments are written as null; a null
conversation or call id links with nothing; repeated messages and calls are
items of their own, in any order of each other; texts of any length are
written whole; empty tables give an empty table; calls in a dependency cycle,
or below one, get depth -1 and status 'cycle', and stand at their own turn.
Only named columns are looked at.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinloom.llm.common import scratch, written

#: Schema of the tool that a conversation's turns are read as a call of: argument -> (JSON type, required).
REPLY = {"prompt": ("string", True), "turn": ("integer", True)}
BLOCK = 1024


def quoted(text: Column) -> Column:
    """A JSON string: quotes, backslashes and control characters escaped, everything else as it is; null: null."""
    whole = F.to_json(F.struct(text.cast("string").alias("v")))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(whole, F.lit(6), F.char_length(whole) - 6))


def number(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def canonical(fields: dict[str, Column]) -> Column:
    """A JSON object of already written values, keys in order."""
    parts: list[Column] = []
    for i, k in enumerate(sorted(fields)):
        parts += [F.lit(("," if i else "{") + f'"{k}":'), fields[k]]
    return F.concat(*parts, F.lit("}"))


def rewritten(arguments: Column) -> Column:
    """A string of JSON in canonical form; what is no JSON (or has a name twice in an object) as a JSON string."""
    parsed = F.try_parse_json(arguments)  # objects of this type have their names in order
    return F.when(parsed.isNull(), quoted(arguments)).otherwise(F.to_json(parsed))


def validity(arguments: Column, schema: dict[str, tuple[str, bool]]) -> Column:
    """'ok', or what is wrong with a string of JSON arguments: 'not an object', 'missing x', 'type of x', 'unknown x'."""
    parsed = F.try_parse_json(arguments)
    kind = F.schema_of_variant(parsed)
    names = F.json_object_keys(arguments)
    out = F.when(parsed.isNull() | names.isNull() | ~F.startswith(kind, F.lit("OBJECT")), F.lit("not an object"))
    for k in sorted(schema):
        here = F.array_contains(names, k)
        if schema[k][1]:
            out = out.when(~here, F.lit(f"missing {k}"))
        got = F.schema_of_variant(F.try_variant_get(parsed, f"$.{k}", "variant"))
        want = {"string": got == "STRING", "integer": got == "BIGINT", "number": got.isin("BIGINT", "DOUBLE") | F.startswith(got, F.lit("DECIMAL")), "boolean": got == "BOOLEAN", "object": F.startswith(got, F.lit("OBJECT")), "array": F.startswith(got, F.lit("ARRAY"))}[schema[k][0]]
        out = out.when(here & ~F.coalesce(want, F.lit(False)), F.lit(f"type of {k}"))
    odd = F.array_sort(F.array_except(names, F.array(*[F.lit(k) for k in sorted(schema)])))
    return out.when(F.size(odd) > 0, F.concat(F.lit("unknown "), F.element_at(odd, 1))).otherwise(F.lit("ok"))


def depths(calls: DataFrame, depends: DataFrame) -> DataFrame:
    """conv_id, call_id, depth and since of calls.

    depth: 0 without dependencies, else one more than the deepest; -1 in or
    below a cycle. since: the latest turn of the call and all that it depends
    on (of a call in or below a cycle, its own). depends: conv_id, call_id,
    on_id; dependencies on unknown calls are ignored. Peels one layer a round
    until none comes off; a round shuffles the calls that are still open.
    """
    spark = calls.sparkSession
    keys = calls.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.max("turn").alias("turn"))
    open_ = written(keys, "open")
    known = open_.select("conv_id", F.col("call_id").alias("on_id"))
    edges = written(depends.select("conv_id", "call_id", "on_id").distinct().join(known, ["conv_id", "on_id"], "left_semi"), "edges")
    done = scratch(spark, "depths")
    columns = ["conv_id", "call_id", "depth", "since"]
    open_.limit(0).select("conv_id", "call_id", F.lit(0).alias("depth"), F.col("turn").alias("since")).write.parquet(f"{done}/none")
    layers = spark.read.parquet(f"{done}/none")
    for depth in itertools.count():
        waits = edges.join(open_.select("conv_id", F.col("call_id").alias("on_id")), ["conv_id", "on_id"], "left_semi").select("conv_id", "call_id").distinct()
        free = open_.join(waits, ["conv_id", "call_id"], "left_anti")
        before = edges.join(layers.select("conv_id", F.col("call_id").alias("on_id"), "since"), ["conv_id", "on_id"]).groupBy("conv_id", "call_id").agg(F.max("since").alias("_since"))
        free = free.join(before, ["conv_id", "call_id"], "left").withColumn("depth", F.lit(depth)).withColumn("since", F.greatest("turn", "_since"))
        free.select(*columns).write.parquet(f"{done}/{depth}")
        layers = spark.read.schema(layers.schema).parquet(f"{done}/*")
        if layers.where(F.col("depth") == depth).isEmpty():
            break
        open_ = written(open_.join(waits, ["conv_id", "call_id"], "left_semi"), "open")
        if open_.isEmpty():
            break
    return layers.unionByName(open_.select("conv_id", "call_id", F.lit(-1).alias("depth"), F.col("turn").alias("since")))


def link(messages: DataFrame, calls: DataFrame, results: DataFrame, schema: dict[str, tuple[str, bool]], depends: DataFrame | None = None) -> DataFrame:
    """One row per message, call and result: conv_id, turn, position, kind, call_id, status, depth, json.

    messages: conv_id, turn, role, text. calls: conv_id, turn, call_id, name,
    arguments (JSON). results: conv_id, turn, call_id, content. depends:
    conv_id, call_id, on_id. Status of a call: what validity() says, 'cycle',
    or 'no result' when valid but unanswered; of a result: 'linked', 'repeated'
    (another result of its call, or its equal, comes first) or 'no call'; of a
    message 'ok'.
    """
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments")
    results = results.select("conv_id", "turn", "call_id", "content")
    if depends is None:
        calls = calls.withColumn("depth", F.lit(0)).withColumn("_at", F.col("turn"))
    else:
        calls = calls.join(depths(calls, depends), ["conv_id", "call_id"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
        calls = calls.withColumn("_at", F.greatest("turn", "since"))
    # only the first result of a call is one: a minimum by key, and of equal results the first
    first = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("_first"))
    results = results.groupBy("conv_id", "turn", "call_id", "content").agg(F.count(F.lit(1)).cast("int").alias("_n")).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    answered = calls.join(first, ["conv_id", "call_id"], "left")
    check = validity(F.col("arguments"), schema)
    call_rows = answered.select(
        "conv_id", "turn", "_at", F.lit(1).alias("_kind"), F.lit("call").alias("kind"), "call_id",
        F.when(F.col("depth") < 0, F.lit("cycle")).when(check != "ok", check).when(F.col("_first").isNull(), F.lit("no result")).otherwise(F.lit("ok")).alias("status"), "depth",
        canonical({"arguments": rewritten(F.col("arguments")), "id": quoted(F.col("call_id")), "name": quoted(F.col("name")), "type": F.lit('"call"')}).alias("json"),
    )
    known = calls.groupBy("conv_id", "call_id").agg(F.max("depth").alias("depth"), F.max("_at").alias("_since"))
    is_first = (F.col("_copy") == 1) & F.struct("turn", "content").eqNullSafe(F.col("_first"))
    result_rows = results.join(first, ["conv_id", "call_id"], "left").join(known, ["conv_id", "call_id"], "left").select(
        "conv_id", "turn", F.greatest("turn", "_since").alias("_at"), F.lit(2).alias("_kind"), F.lit("result").alias("kind"), "call_id",
        F.when(F.col("depth").isNull(), F.lit("no call")).when(is_first, F.lit("linked")).otherwise(F.lit("repeated")).alias("status"), F.coalesce("depth", F.lit(0)).alias("depth"),
        canonical({"content": quoted(F.col("content")), "id": quoted(F.col("call_id")), "type": F.lit('"result"')}).alias("json"),
    )
    message_rows = messages.select(
        "conv_id", "turn", F.col("turn").alias("_at"), F.lit(0).alias("_kind"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit("ok").alias("status"), F.lit(0).alias("depth"),
        canonical({"content": quoted(F.col("text")), "role": quoted(F.col("role")), "turn": number(F.col("turn")), "type": F.lit('"message"')}).alias("json"),
    )
    return positions(message_rows.unionByName(call_rows).unionByName(result_rows)).drop("_kind", "_at")


def positions(items: DataFrame) -> DataFrame:
    """items with position: their place in the conversation in the order (_at, depth, kind, turn, call_id, json)."""
    items = items.withColumn("_block", F.floor(F.coalesce(F.col("_at"), F.lit(-1)) / BLOCK))
    blocks = items.groupBy("conv_id", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("_c"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("conv_id", "_block").orderBy("_at", "depth", "_kind", "turn", "call_id", "json")
    joined = items.join(blocks, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_block") == F.col("_b")))
    return joined.withColumn("position", F.col("_before") + F.row_number().over(inside) - 1).drop("_c", "_b", "_block", "_before")


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages, calls, results): system turns are messages; a user turn is a call of 'reply', the assistant turn after it the result.

    The call's id is 'c' and its turn; a user turn's arguments are its text and turn.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    messages = rows.where(~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)))
    calls = rows.where("role = 'user'").select("conv_id", "turn", F.concat(F.lit("c"), F.col("turn").cast("string")).alias("call_id"), F.lit("reply").alias("name"), canonical({"prompt": quoted(F.col("text")), "turn": number(F.col("turn"))}).alias("arguments"))
    results = rows.where("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("text").alias("content"))
    return messages, calls, results


def turns_as_dependencies(conversations: DataFrame) -> DataFrame:
    """depends of turns_as_calls(): the i-th pair of turns is read as building on the pair (i - 1) div 2, so that depths are those of a binary tree."""
    turn = F.col("turn")
    pair = F.floor(turn / 2)
    on = 2 * F.floor((pair - 1) / 2) + F.pmod(turn, F.lit(2))
    return conversations.where("role = 'user'").where(pair >= 1).select("conv_id", F.concat(F.lit("c"), turn.cast("string")).alias("call_id"), F.concat(F.lit("c"), on.cast("string")).alias("on_id"))
