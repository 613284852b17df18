"""Chat formatting with linked tool calls (DataFrame functions only).

Calls and results meet in a hash join on (conversation, call identifier).  Calls that
refer to results of other calls are ordered topologically: chains by doubling pointers, calls with several
references by peeling, where a round resolves those whose references are all resolved;
what is left when a round resolves nothing refers to itself or to nothing.  Arguments are
checked against schemas one argument per row, and every message is serialised as
canonical JSON: sorted keys, no white space.  The unit of output is the message with
its place (level, turn), so a conversation of any length needs no task of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import forget, shared_dir, written

#: How an argument's text refers to another call's result; what follows is that call's identifier.
REFERENCE = "$ref:"
#: Names of JSON types, and how the engine's variant type spells them.
TYPES = {"integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "string": "STRING", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*", "null": "VOID"}


def references(arguments: Column) -> Column:
    """The identifiers that the arguments refer to: whole strings that begin with ``REFERENCE``, at any depth, but not keys.

    They are read off the parsed arguments as written again, where nothing but \\\\ and \\" can stand before a quotation
    mark inside a string; two control characters, which JSON always escapes, stand in for these.
    """
    text = F.to_json(F.try_parse_json(arguments))
    text = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    strings = F.regexp_extract_all(text, F.lit('"[^"]*"(?:\\s*:)?'), F.lit(0))
    whole = F.filter(strings, lambda x: F.startswith(x, F.lit(f'"{REFERENCE}')) & F.endswith(x, F.lit('"')))
    plain = lambda x: F.replace(F.replace(x, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    value = lambda x: F.try_variant_get(F.try_parse_json(plain(x)), "$", "string")
    return F.transform(whole, lambda x: F.substring(value(x), len(REFERENCE) + 1, 2**31 - 1))


def call_levels(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 for calls that refer to nothing, -1 where no order exists.

    A reference to a call without a result, to itself, in a circle, or to nothing has none.

    Calls with a single reference are chains: pointers along them double their reach in every
    round, so a chain of any length takes as many rounds as its length has bits.  Only calls with several
    references are peeled, one layer of such calls in a round.
    """
    key = ["conv_id", "call_id"]
    known = calls.select(*key).distinct()
    refs = calls.select(*key, F.explode(references(F.col("arguments"))).alias("needs")).distinct()
    answered = results.select("conv_id", F.col("call_id").alias("needs")).distinct().join(known.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"])
    refs = written(refs.join(answered.withColumn("has", F.lit(True)), ["conv_id", "needs"], "left"), "refs")
    if refs.isEmpty():
        return known.withColumn("level", F.lit(0))
    degree = refs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce("has", F.lit(False))).alias("whole"), F.min("needs").alias("needs"))
    degree = written(degree, "degrees")
    single = degree.filter("whole and n = 1").select(*key, F.col("needs").alias("root"), F.lit(1).cast("long").alias("steps"), F.lit(False).alias("ended"))
    jumps = _doubled(written(single, "jumps"))
    # what is not a chain any more: calls without references have level 0, broken ones none, the others are peeled
    levels = known.join(degree.select(*key), key, "left_anti").withColumn("level", F.lit(0).cast("long"))
    several = degree.filter("whole and n > 1").select(*key)
    if not several.isEmpty():
        ends = jumps.filter("ended").select("conv_id", F.col("call_id").alias("needs"), "root", "steps")
        edges = refs.join(several, key).join(ends, ["conv_id", "needs"], "left")
        edges = edges.select(*key, F.coalesce("root", "needs").alias("root"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
        levels = _peeled(written(edges.groupBy(*key, "root").agg(F.max("steps").alias("steps")), "edges"), levels)
    at = levels.select("conv_id", F.col("call_id").alias("root"), F.col("level").alias("base"))
    chained = jumps.filter("ended").join(at, ["conv_id", "root"]).select(*key, (F.col("base") + F.col("steps")).alias("level"))
    found = levels.unionByName(chained)
    return known.join(found, key, "left").select(*key, F.coalesce("level", F.lit(-1)).cast("int").alias("level"))


def _doubled(jumps: DataFrame) -> DataFrame:
    """Every call of a chain with the call that ends it, and how many steps away; ``ended`` is false on circles."""
    longest = jumps.count()
    for _ in range(longest.bit_length() + 1):
        ahead = jumps.select("conv_id", F.col("call_id").alias("root"), F.col("root").alias("beyond"), F.col("steps").alias("more"))
        moved = jumps.filter("not ended").join(ahead, ["conv_id", "root"], "left")
        moved = moved.select(
            "conv_id", "call_id", F.coalesce("beyond", "root").alias("root"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("beyond").isNull().alias("ended")
        )
        before, jumps = jumps, written(jumps.filter("ended").unionByName(moved), "jumps")
        forget(before)
        if jumps.filter("not ended").isEmpty():
            break
    return jumps


def _peeled(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """``levels`` with those of the calls of ``edges`` (call, root, steps) that can be ordered."""
    key = ["conv_id", "call_id"]
    folder = shared_dir(edges.sparkSession, f"levels-{uuid.uuid4().hex}")
    rounds = 0
    levels.write.parquet(f"{folder}/round={rounds}")
    schema = levels.schema
    left = edges.withColumn("at", F.lit(None).cast("long"))
    while True:
        newest = edges.sparkSession.read.schema(schema).parquet(f"{folder}/round={rounds}")
        at = newest.select("conv_id", F.col("call_id").alias("root"), F.col("level").alias("found"))
        left = left.join(at, ["conv_id", "root"], "left").select(*key, "root", "steps", F.coalesce("at", F.col("found") + F.col("steps")).alias("at"))
        left = written(left, "edges")
        ready = left.groupBy(*key).agg(F.bool_and(F.col("at").isNotNull()).alias("ready"), F.max("at").alias("level")).filter("ready").select(*key, "level")
        rounds += 1
        ready.write.parquet(f"{folder}/round={rounds}")
        if edges.sparkSession.read.schema(schema).parquet(f"{folder}/round={rounds}").isEmpty():
            return edges.sparkSession.read.schema(schema).parquet(*[f"{folder}/round={r}" for r in range(rounds)])
        left = left.join(ready, key, "left_anti")


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(asked, errors) for the calls whose arguments break their schema, by what they ask (see ``asked``).

    ``schemas`` has a row (name, param, type, required) per parameter.  Errors are
    "json" (not a JSON object), "tool" (no such schema), "missing:p", "unknown:p" and
    "type:p", sorted.  Errors depend on nothing but name and arguments, so equal calls are checked once.
    """
    parsed = calls.select(asked().alias("asked"), "name", "arguments").dropDuplicates(["asked"])
    parsed = parsed.select("asked", "name", F.expr("try_parse_json(arguments)").alias("v"), F.expr("json_object_keys(arguments)").alias("ks"))
    key = ["asked"]
    known = schemas.select("name").distinct().withColumn("tool", F.lit(True))
    s = schemas.select("name", "param", "type", F.coalesce("required", F.lit(False)).alias("required"))
    base = parsed.join(known, "name", "left")
    whole = base.select(
        *key,
        F.when(F.col("v").isNull() | F.col("ks").isNull(), "json").when(F.col("tool").isNull(), "tool").alias("error"),
    ).filter("error is not null")
    good = base.filter("v is not null and ks is not null and tool")
    pattern = F.coalesce(*[F.when(F.col("type") == t, F.lit(p)) for t, p in TYPES.items()], F.lit(".*"))
    # Each argument with its own type, then the schema's row for it.
    given = good.lateralJoin(calls.sparkSession.tvf.variant_explode(F.col("v").outer()))
    typed = given.select(*key, "name", F.col("key").alias("param"), F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0).alias("got"))
    checked = typed.join(s, ["name", "param"], "left").select(
        *key,
        F.when(F.col("type").isNull(), F.concat(F.lit("unknown:"), "param"))
        .when(~F.regexp(F.col("got"), F.concat(F.lit("^("), pattern, F.lit(")$"))), F.concat(F.lit("type:"), "param"))
        .alias("error"),
    ).filter("error is not null")
    needed = good.select(*key, "name", "ks").join(s.filter("required"), "name").filter(~F.array_contains("ks", F.col("param")))
    missing = needed.select(*key, F.concat(F.lit("missing:"), "param").alias("error"))
    return whole.unionByName(checked).unionByName(missing).groupBy(*key).agg(F.array_sort(F.collect_set("error")).alias("errors"))


def asked():
    """What a call asks for, its name and arguments, as a digest; null and "null" differ."""
    return F.sha2(F.to_json(F.struct("name", "arguments")), 256)


def format_chats(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, call_id, linked, level, errors, json.

    ``messages`` has conv_id, turn, role, text, and kind ("call", "result" or null),
    call_id, name and arguments (JSON) for tool messages.  A call is linked if a result
    of its conversation bears its identifier, and a result if a call does; duplicates
    link all alike; a null identifier links with nothing.  ``level`` is the call's place
    in the topological order, its result's too, and null for other messages.  Null texts
    are null in the JSON.  Repeated messages give repeated rows; extra columns are
    ignored; empty tables give an empty one.
    """
    m = messages.select("conv_id", "turn", "role", "text", "kind", "call_id", "name", "arguments")
    tools = m.filter("kind is not null and call_id is not null")
    calls, results = tools.filter("kind = 'call'"), tools.filter("kind = 'result'")
    called = calls.select("conv_id", "call_id").distinct()
    resulted = results.select("conv_id", "call_id").distinct()
    link = called.withColumn("c", F.lit(1)).hint("shuffle_hash").join(resulted.withColumn("r", F.lit(1)), ["conv_id", "call_id"], "full_outer")
    link = link.select("conv_id", "call_id", (F.col("c").isNotNull() & F.col("r").isNotNull()).alias("linked"))
    level = call_levels(calls.select("conv_id", "call_id", "arguments"), results)
    link = link.join(level, ["conv_id", "call_id"], "left")
    errors = argument_errors(calls, schemas)
    m = m.withColumn("asked", F.when(F.expr("kind = 'call' and call_id is not null"), asked()))
    out = m.join(link.hint("shuffle_hash"), ["conv_id", "call_id"], "left").join(errors, "asked", "left")
    # Keys in order; arguments are parsed, which sorts their keys and drops white space.
    body = F.to_json(
        F.struct(
            F.when(F.col("kind") == "call", F.col("call_id")).alias("call_id"),
            F.col("text").alias("content"),
            F.col("name").alias("name"),
            F.when(F.col("kind") == "result", F.col("call_id")).alias("result_of"),
            F.col("role").alias("role"),
        ),
        {"ignoreNullFields": "true"},
    )
    arguments = F.to_json(F.expr("try_parse_json(arguments)"))
    json = F.when(
        (F.col("kind") == "call") & arguments.isNotNull(),
        F.concat(F.lit('{"arguments":'), arguments, F.when(body == "{}", "}").otherwise(F.concat(F.lit(","), F.substr(body, F.lit(2))))),
    ).otherwise(body)
    return out.select(
        "conv_id", "turn", "role", "call_id",
        F.when(F.col("kind").isNotNull(), F.coalesce("linked", F.lit(False))).alias("linked"),
        F.col("level").cast("long").alias("level"),
        F.array_join(F.coalesce("errors", F.array().cast("array<string>")), ",").alias("errors"),
        json.alias("json"),
    )


def turns_as_calls(conversations: DataFrame) -> DataFrame:
    """Plain turns read as tool messages: a user's turn calls "reply", the turn after it is its result.

    A call refers to the one two turns before, and so to the whole conversation.  It gives the numbers of words and characters,
    the former as text where the latter is a multiple of five, and the latter not at all where the former is a multiple of
    seven: such calls break the schema.
    """
    call = F.col("role") == "user"
    result = F.col("role") == "assistant"
    words = F.size(F.expr("regexp_extract_all(coalesce(text, ''), '[^ \\n]+', 0)"))
    chars = F.char_length(F.coalesce("text", F.lit("")))
    arguments = F.to_json(
        F.struct(
            F.when(chars % 5 != 0, words).alias("words"),
            F.when(words % 7 != 0, chars).alias("chars"),
            F.when(F.col("turn") >= 2, F.concat(F.lit(REFERENCE), F.concat_ws("-", "conv_id", F.col("turn") - 2))).alias("after"),
        ),
        {"ignoreNullFields": "true"},
    )
    as_text = F.concat(F.lit('{"words":"'), words.cast("string"), F.when(arguments == "{}", '"}').otherwise(F.concat(F.lit('",'), F.substr(arguments, F.lit(2)))))
    return conversations.select(
        "conv_id", "turn", "role", "text",
        F.when(call, "call").when(result, "result").alias("kind"),
        F.when(call, F.concat_ws("-", "conv_id", "turn")).when(result, F.concat_ws("-", "conv_id", F.col("turn") - 1)).alias("call_id"),
        F.when(call, F.lit("reply")).alias("name"),
        F.when(call, F.when(chars % 5 == 0, as_text).otherwise(arguments)).alias("arguments"),
    )
