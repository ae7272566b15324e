"""Chat formatting with tool calls: calls and results linked, ordered, validated and serialised.

A call is a JSON object in <tool_call>...</tool_call> in an assistant's message: id, name, arguments. A
block ends at its end tag, at the next block or with the text; one that is no JSON object is malformed.
A result is a tool's message, a JSON object with tool_call_id and content. An argument "$id" stands for
the result of another call of the conversation. All of it is DataFrame expressions; calls and results
are first summed up for each identifier, so that the joins multiply no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

CALL = r"(?s)<tool_call>(.*?)(?:</tool_call>|(?=<tool_call>)|\z)"
REFERENCE = r'"\$([A-Za-z0-9_.:-]+)"'
#: Names of types in schemas, and what they are called of a variant.
TYPES = {
    "string": r"^STRING$",
    "integer": r"^BIGINT$|^DECIMAL\(\d+,0\)$",
    "number": r"^BIGINT$|^DECIMAL|^DOUBLE$|^FLOAT$",
    "boolean": r"^BOOLEAN$",
    "object": r"^OBJECT<",
    "array": r"^ARRAY<",
    "null": r"^VOID$",
}
SCHEMA_COLUMNS = "name string, parameter string, type string, required boolean"


def canonical(text: Column) -> Column:
    """JSON with keys in code point order and no white space; null where text is not JSON."""
    return F.to_json(F.try_parse_json(text))


def _calls(turns: DataFrame) -> DataFrame:
    blocks = turns.where((F.col("role") == "assistant") & F.col("text").contains("<tool_call>"))
    blocks = blocks.select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(CALL), F.lit(1))).alias("step", "block"))
    # What is no JSON object has no parts.
    whole = F.col("block").contains("{") & F.coalesce(F.schema_of_variant(F.try_parse_json("block")).startswith("OBJECT<"), F.lit(False))
    blocks = blocks.withColumn("whole", whole)
    part = lambda path: F.when(F.col("whole"), F.get_json_object("block", path))
    arguments = F.when(F.col("whole"), F.coalesce(F.get_json_object("block", "$.arguments"), F.lit("{}")))
    return blocks.select(
        "conv_id", "turn", (F.col("step") + 1).alias("step"), part("$.id").alias("call_id"), part("$.name").alias("name"), canonical(arguments).alias("arguments"),
        F.when(~F.col("whole"), F.col("block")).alias("bad"),
    )


def _levels(calls: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls in topological order, level 0 first; those on or behind a cycle or a missing call have none.

    A call's level is the greatest of max(b, level + w) over the calls it needs, at first with b and w of one.
    In each round all calls that wait for one call alone are stepped over: who needs them needs that call
    instead, with greater b and w. So a chain of n calls takes about log2 n rounds. Once as many rounds have
    settled nothing, what is left waits for itself.
    """
    key = ["conv_id", "call_id"]
    edges = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL").select(*key, F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(REFERENCE), F.lit(1)))).alias("needs"))
    one = F.lit(1).cast("long")
    open_ = stored(edges.distinct().withColumns({"b": one, "w": one}))
    nodes = ids.select(*key)
    free = nodes.join(open_, key, "left_anti").select(*key, F.lit(0).cast("long").alias("level"), F.lit(False).alias("dead"))
    missing = open_.select("conv_id", F.col("needs").alias("call_id")).distinct().join(nodes, key, "left_anti")
    done = stored(free.union(missing.select(*key, F.lit(None).cast("long"), F.lit(True))))
    left, idle = open_.count(), 0
    while left and idle <= left.bit_length():
        known = done.select("conv_id", F.col("call_id").alias("needs"), "level", F.col("dead").alias("gone"))
        alone = open_.groupBy(*key).agg(F.count("*").alias("n"), F.max("needs").alias("to"), F.max("b").alias("to_b"), F.max("w").alias("to_w")).where("n = 1")
        met = open_.join(known, ["conv_id", "needs"], "left").join(alone.select("conv_id", F.col("call_id").alias("needs"), "to", "to_b", "to_w"), ["conv_id", "needs"], "left")
        over = F.col("gone").isNull() & F.col("to").isNotNull()
        moved = stored(met.select(
            *key, F.when(F.col("gone").isNull(), F.coalesce("to", "needs")).alias("needs"), F.greatest("b", F.col("level") + F.col("w")).alias("so_far"), F.col("gone"),
            F.when(over, F.greatest("b", F.col("to_b") + F.col("w"))).otherwise(F.col("b")).alias("b"), F.when(over, F.col("w") + F.col("to_w")).otherwise(F.col("w")).alias("w"),
        ))
        facts = stored(moved.groupBy(*key).agg(F.max(F.when(F.col("gone") == F.lit(False), F.col("so_far"))).alias("level"), F.coalesce(F.bool_or("gone"), F.lit(False)).alias("dead"), F.count("needs").alias("waits")))
        fresh = facts.where("dead OR waits = 0").select(*key, F.when(~F.col("dead"), F.col("level")).alias("level"), "dead")
        still = facts.where("NOT dead AND waits > 0").select(*key, F.coalesce("level", F.lit(0)).alias("at_least"))
        open_ = stored(moved.where("needs IS NOT NULL").join(still, key).groupBy(*key, "needs").agg(F.max(F.greatest("b", "at_least")).alias("b"), F.max("w").alias("w")))
        idle = idle + 1 if fresh.isEmpty() else 0
        done, left = done.union(fresh), open_.count()
    return done.where("NOT dead").select(*key, F.col("level").cast("int"))


def _problems(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls with problems: what their arguments have against the schema of their name; empty if nothing."""
    spec = schemas.groupBy("name").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("parameter", F.struct("type", "required"))))).alias("spec"))
    given = F.expr("try_cast(try_parse_json(arguments) AS map<string, variant>)")
    met = calls.join(stored(spec).withColumnRenamed("name", "spec_name"), F.col("name") == F.col("spec_name"), "left").drop("spec_name").withColumn("given", given)
    keys, known = F.map_keys("given"), F.map_keys("spec")
    missing = F.filter(known, lambda k: F.element_at("spec", k)["required"] & ~F.array_contains(keys, k))
    extra = F.array_except(keys, known)
    kind = lambda k: F.schema_of_variant(F.element_at("given", k))
    wanted = lambda k: F.element_at("spec", k)["type"]
    refers = lambda k: F.coalesce(F.to_json(F.element_at("given", k)).rlike("^" + REFERENCE + "$"), F.lit(False))

    def wrong(k: Column) -> Column:
        fits = F.lit(False)
        for name, pattern in TYPES.items():
            fits = fits | ((wanted(k) == name) & kind(k).rlike(pattern))
        return wanted(k).isNotNull() & ~refers(k) & ~F.coalesce(fits, F.lit(False))

    found = F.concat(
        F.transform(missing, lambda k: F.concat(F.lit("missing "), k)),
        F.transform(extra, lambda k: F.concat(F.lit("unknown "), k)),
        F.transform(F.filter(F.array_intersect(keys, known), wrong), lambda k: F.concat(F.lit("type of "), k)),
    )
    problems = F.when(F.col("spec").isNull(), F.array(F.lit("no such tool"))).when(F.col("given").isNull(), F.array(F.lit("arguments are no object"))).otherwise(F.array_sort(found))
    return met.withColumn("problems", problems).drop("spec", "given")


def format_chat(
    turns: DataFrame, schemas: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, turn, step, role, kind, call_id, level, partner, status, json): a row for each message, call and result.

    Rows of a conversation in order of level, turn and step are in a topological order of its calls.
    kind: message (step 0), call (steps from 1, in the order of its message) or result. level: of a call,
    how many calls its arguments need before it; a result has its call's; messages have 0; null if it waits
    for ever. partner: turn of the result or of the call. status: ok, or what is wrong, comma-joined:
    malformed (a block that is no JSON object; its json holds its text), no id, repeated id, no result, no call, result first, cycle (or a reference to no call), and problems
    with the schema, which has a row (name, parameter, type, required) for each parameter; without schemas
    arguments are not checked. json: the row in canonical JSON, keys sorted. Messages keep their whole
    text; a null text is an empty one. Null conversations or turns are kept, but nothing in a null
    conversation is linked. Repeated rows appear as often as they do. Other columns are not looked at.
    """
    told = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    calls = _calls(told)
    calls = _problems(calls, schemas.select("name", "parameter", "type", "required")) if schemas is not None else calls.withColumn("problems", F.array().cast("array<string>"))
    results = told.where(F.col("role") == "tool").select("conv_id", "turn", "role", "text", F.get_json_object("text", "$.tool_call_id").alias("call_id"))
    ids = stored(calls.where("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min("turn").alias("call_turn"), F.count("*").alias("n_calls")))
    answers = stored(results.where("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min("turn").alias("result_turn"), F.count("*").alias("n_results")))
    levels = stored(_levels(calls, ids))
    said = lambda *tests: F.concat_ws(", ", *[F.when(test, F.lit(word)) for test, word in tests])
    status = lambda text: F.when(text == "", F.lit("ok")).otherwise(text)

    call = calls.withColumn("problems", F.when(F.col("bad").isNull(), F.col("problems")).otherwise(F.array(F.lit("malformed")))).join(ids, ["conv_id", "call_id"], "left").join(answers, ["conv_id", "call_id"], "left").join(levels, ["conv_id", "call_id"], "left")
    wrong = said((F.col("call_id").isNull() & F.col("bad").isNull(), "no id"), (F.col("n_calls") > 1, "repeated id"), (F.col("call_id").isNotNull() & F.col("result_turn").isNull(), "no result"), (F.col("result_turn") < F.col("turn"), "result first"), (F.col("level").isNull() & F.col("call_id").isNotNull(), "cycle"))
    call = call.select("conv_id", "turn", "step", F.lit("assistant").alias("role"), F.lit("call").alias("kind"), "call_id", "level", F.col("result_turn").alias("partner"),
        status(F.concat_ws(", ", F.nullif(wrong, F.lit("")), "problems")).alias("status"),
        F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), "name", F.col("bad").alias("text"), F.lit("call").alias("type"))).alias("json"))
    result = results.join(ids, ["conv_id", "call_id"], "left").join(answers, ["conv_id", "call_id"], "left").join(levels, ["conv_id", "call_id"], "left")
    wrong = said((F.col("call_id").isNull(), "no id"), (F.col("n_results") > 1, "repeated id"), (F.col("call_id").isNotNull() & F.col("call_turn").isNull(), "no call"), (F.col("turn") < F.col("call_turn"), "result first"))
    content = F.coalesce(F.get_json_object("text", "$.content"), F.col("text"))
    result = result.select("conv_id", "turn", F.lit(0).alias("step"), "role", F.lit("result").alias("kind"), "call_id", "level", F.col("call_turn").alias("partner"), status(wrong).alias("status"),
        F.to_json(F.struct(F.col("call_id").alias("call"), content.alias("content"), F.lit("result").alias("type"))).alias("json"))
    message = told.where(~F.col("role").eqNullSafe("tool")).select("conv_id", "turn", F.lit(0).alias("step"), "role", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(0).alias("level"),
        F.lit(None).cast(told.schema["turn"].dataType).alias("partner"), F.lit("ok").alias("status"),
        F.to_json(F.struct(F.col("text").alias("content"), "role")).alias("json"))
    return message.union(call).union(result)


def exchanges_as_calls(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text), and calls and results that say who answers whom.

    Each user turn is also a call of the tool `answer` by the assistant, with id t and the number of the
    turn after it; its arguments are the question, its length and, from the third turn on, the answer two
    turns before. Each assistant turn is also the result t and its own number. Null turns give neither.
    """
    at = lambda role: turns.where((F.col("role") == role) & F.col("turn").isNotNull())
    id_of = lambda shift: F.concat(F.lit("t"), (F.col("turn") + shift).cast("string"))
    text = F.coalesce("text", F.lit(""))
    previous = F.when(F.col("turn") >= 2, F.concat(F.lit("$"), id_of(-1)))
    call = F.struct(F.struct(F.length(text).alias("chars"), previous.alias("previous"), text.alias("question")).alias("arguments"), id_of(1).alias("id"), F.lit("answer").alias("name"))
    asked = F.concat(F.lit("<tool_call>"), F.to_json(call), F.lit("</tool_call>"))
    told = F.to_json(F.struct(text.alias("content"), id_of(0).alias("tool_call_id")))
    return (
        turns.select("conv_id", "turn", "role", "text")
        .union(at("user").select("conv_id", "turn", F.lit("assistant"), asked))
        .union(at("assistant").select("conv_id", "turn", F.lit("tool"), told))
    )


def answer_schema(spark: SparkSession) -> DataFrame:
    """The schema of the tool that exchanges_as_calls makes calls of."""
    return spark.sql("SELECT * FROM VALUES ('answer', 'chars', 'integer', true), ('answer', 'previous', 'string', false), ('answer', 'question', 'string', true) AS t(name, parameter, type, required)")
