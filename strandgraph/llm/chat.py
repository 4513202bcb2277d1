"""Chat formatting with linked tool calls, with DataFrame functions only.

Calls and results are hash-joined by conversation and identifier, the side of unique keys being hashed; a call's level in
the conversation's order follows from the calls that its arguments refer to, by pointer doubling; arguments are checked
against schemas; messages become canonical JSON (keys in order, no white space). Nothing gathers a conversation: every
step's keys are messages or identifiers.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm import common

CALL = "array<struct<id: string, name: string, arguments: string>>"
#: In arguments, {"$ref": "<id>"} stands for the result of another call.
REFERENCE = r'"\\$ref"\\s*:\\s*"([^"]*)"'


def calls_in_text() -> Column:
    """Calls of an assistant's message whose text is JSON with tool_calls; else none."""
    parsed = F.from_json("text", f"tool_calls {CALL}")
    return F.when((F.col("role") == "assistant") & F.col("text").startswith("{"), parsed["tool_calls"])


def result_in_text() -> Column:
    """The identifier that a tool's message answers; else null."""
    return F.when(F.col("role") == "tool", F.get_json_object("text", "$.tool_call_id"))


def _valid(schemas: Mapping[str, Mapping[str, tuple[str, bool]]]) -> Column:
    """Whether arguments (JSON) of call name fit their schema; false for unknown names and for what isn't an object.

    A schema gives a type (a prefix of Spark's name for it, as STRING or BIGINT) and whether it is required, by parameter;
    parameters that it lacks aren't allowed.
    """
    out = F.lit(False)
    value = "try_parse_json(arguments)"
    for name, parameters in schemas.items():
        fits = F.expr(f"coalesce(startswith(schema_of_variant({value}), 'OBJECT'), false)")
        for key, (kind, required) in parameters.items():
            got = F.expr(f"schema_of_variant(variant_get({value}, '$.{key}', 'variant'))")
            fits = fits & F.coalesce(got.startswith(kind), F.lit(not required))
        keys = ", ".join(f"'{k}'" for k in parameters) or "CAST(NULL AS STRING)"
        fits = fits & F.expr(f"coalesce(forall(json_object_keys(arguments), k -> coalesce(k IN ({keys}), false)), false)")
        out = F.when(F.col("name") == name, fits).otherwise(out)
    return out


def _unique(right: DataFrame) -> DataFrame:
    """right, of unique keys, as the side of a join that is hashed: the other side may hold a key any number of times."""
    return right.hint("shuffle_hash")


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 without references, else two more than the highest call referred to; null in a cycle.

    References to unknown calls don't count. A call's level is the maximum of a known number and of its open references'
    levels plus their distances. Each round takes in the levels that are known, and replaces each reference to a call
    with one open reference itself by one to that call's reference, so a chain halves with each round: rounds grow with the logarithm
    of the chains, and with the depth of calls that have several open references each. It ends when no call is open, or
    after more rounds without a new level than the longest chain could take: what is left are cycles, and calls that need them.
    """
    key = ["conv_id", "call_id"]
    edges = calls.select(*key, F.explode(F.expr(f"regexp_extract_all(arguments, '{REFERENCE}', 1)")).alias("needs")).distinct()
    known = calls.select("conv_id", F.col("call_id").alias("needs"))
    edges = common.materialize(edges.join(_unique(known), ["conv_id", "needs"], "left_semi").withColumn("far", F.lit(2)), "references")
    if edges.isEmpty():
        return calls.select(*key).withColumn("level", F.lit(0))
    met = edges.select("conv_id", F.col("needs").alias("call_id")).union(edges.select(*key)).distinct()
    open_ = common.materialize(met.withColumn("base", F.lit(0)), "calls")
    patience, idle, before = open_.count().bit_length() + 1, 0, None
    levels = calls.select(*key).join(_unique(met), key, "left_anti").withColumn("level", F.lit(0))
    raised = lambda rows, gained: rows.join(_unique(gained.groupBy(*key).agg(F.max("gain").alias("gain"))), key, "left").select(*key, F.greatest("base", F.coalesce("gain", F.lit(0))).alias("base"))
    recent = None  # the calls that the round before has settled
    while True:
        if recent is not None:  # references to them are taken in, before any other follows these
            met = common.materialize(edges.join(_unique(recent), ["conv_id", "needs"], "left"), "references")
            open_ = raised(open_, met.where("level IS NOT NULL").select(*key, (F.col("level") + F.col("far")).alias("gain")))
            edges = met.where("level IS NULL").select(*key, "needs", "far")
        degree = edges.groupBy(*key).agg(F.count("*").alias("open"), F.min(F.struct("needs", "far")).alias("one"))
        now = common.materialize(open_.join(_unique(degree), key, "left").select(*key, "base", "open", "one"), "calls")
        ready, rest = now.where("open IS NULL"), now.where("open > 0")
        levels = levels.unionByName(ready.select(*key, F.col("base").alias("level")))
        still = rest.count()
        idle = idle + 1 if still == before else 0
        if not still or idle > patience:
            return levels
        before = still
        single = rest.where("open = 1").select("conv_id", F.col("call_id").alias("needs"), F.col("base").alias("known"), F.col("one.needs").alias("next"), F.col("one.far").alias("step"))
        met = common.materialize(edges.join(_unique(single), ["conv_id", "needs"], "left"), "references")
        open_ = common.materialize(raised(rest.select(*key, "base"), met.where("known IS NOT NULL").select(*key, (F.col("known") + F.col("far")).alias("gain"))), "calls")
        onward = met.select(*key, F.coalesce("next", "needs").alias("needs"), (F.col("far") + F.coalesce("step", F.lit(0))).alias("far"))
        edges = common.materialize(onward.groupBy(*key, "needs").agg(F.max("far").alias("far")), "references")
        recent = ready.select("conv_id", F.col("call_id").alias("needs"), F.col("base").alias("level"))


def link(messages: DataFrame, schemas: Mapping[str, Mapping[str, tuple[str, bool]]], calls: Column | None = None, result: Column | None = None) -> DataFrame:
    """Per row of messages (conv_id, turn, role, text): its calls and results linked, its level, and its canonical JSON.

    calls and result are expressions over a message: an array of (id, name, arguments) and the identifier answered
    (default: those in JSON texts). Of several calls with one identifier in a conversation the first counts; a result
    links to a call of its own or an earlier turn. Columns: conv_id, turn, role, n_calls, n_answered (calls with a
    result), n_valid (calls whose arguments fit their schema), call_turn (of the call a result links to, null if none),
    level (order among messages: calls 0, their results 1, calls that need those 2, ...; null in a cycle; 0 for
    other messages and unlinked results), json (arguments that are no JSON stay as a text there). Null texts have no content; repeated rows get equal results; messages
    without a conversation or turn are linked with nothing, and none of their calls counts as answered.
    """
    rows = messages.select("conv_id", "turn", "role", "text")
    rows = rows.select("*", F.xxhash64("role", "text").alias("_key"), (calls_in_text() if calls is None else calls).alias("_calls"), (result_in_text() if result is None else result).alias("_answers"))
    of_row = ["conv_id", "turn", "_key"]  # the hash tells messages of one turn apart
    made = rows.where("size(_calls) > 0").groupBy(*of_row).agg(F.first("_calls").alias("_calls")).select(*of_row, F.posexplode("_calls").alias("pos", "call"))
    made = made.select(*of_row, "pos", F.col("call.id").alias("call_id"), F.col("call.name").alias("name"), F.col("call.arguments").alias("arguments"))
    made = common.materialize(made.select("*", _valid(schemas).cast("int").alias("valid")), "calls")
    first = made.where("conv_id IS NOT NULL AND turn IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "pos", "arguments")).alias("call"))
    first = common.materialize(first.select("conv_id", "call_id", F.col("call.turn").alias("call_turn"), F.col("call.arguments").alias("arguments")), "firsts")
    first = common.materialize(first.join(_unique(_levels(first)), ["conv_id", "call_id"], "left").select("conv_id", "call_id", "call_turn", "level"), "levels")
    answers = rows.where("_answers IS NOT NULL").groupBy("conv_id", F.col("_answers").alias("call_id")).agg(F.max("turn").alias("last"))
    answered = answers.join(_unique(first), ["conv_id", "call_id"]).where("call_turn <= last").select("conv_id", "call_id", F.lit(1).alias("answered"))
    of_calls = made.join(_unique(first.select("conv_id", "call_id", "level")), ["conv_id", "call_id"], "left").join(_unique(answered), ["conv_id", "call_id"], "left")
    of_calls = of_calls.groupBy(*[F.col(c).alias(f"_{i}") for i, c in enumerate(of_row)])
    of_calls = of_calls.agg(F.count("*").alias("n_calls"), F.sum(F.coalesce("answered", F.lit(0))).alias("n_answered"), F.sum("valid").alias("n_valid"), F.max("level").alias("c_level"), F.count("level").alias("c_levels"))
    same = F.col("conv_id").eqNullSafe(F.col("_0")) & F.col("turn").eqNullSafe(F.col("_1")) & (F.col("_key") == F.col("_2"))
    of_results = first.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_id"), "call_turn", (F.col("level") + 1).alias("r_level"), F.lit(True).alias("_linked"))
    linked = (F.col("conv_id") == F.col("_c")) & (F.col("_answers") == F.col("_id")) & (F.col("call_turn") <= F.col("turn"))
    out = rows.join(_unique(of_calls), same, "left").join(_unique(of_results), linked, "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    level = F.when(F.col("_linked"), F.col("r_level")).when(F.col("n_calls") > 0, F.when(F.col("c_levels") == F.col("n_calls"), F.col("c_level"))).otherwise(0)
    canonical = F.expr("""to_json(named_struct('content', text, 'role', role, 'tool_call_id', _answers,
        'tool_calls', transform(_calls, c -> named_struct('arguments', coalesce(try_parse_json(c.arguments), CAST(c.arguments AS VARIANT)), 'id', c.id, 'name', c.name))))""")
    return out.select("conv_id", "turn", "role", count("n_calls"), count("n_answered"), count("n_valid"), "call_turn", level.cast("int").alias("level"), canonical.alias("json"))


#: The tools of the query: a reply needs a text; one that follows another needs the other's result, by reference.
TOOLS = {"reply": {"text": ("STRING", True)}, "follow": {"after": ("OBJECT", True), "text": ("STRING", True)}}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no tool messages: each user's turn is a call, the assistant's next turn its result.

    The first call of a conversation is reply(text); one two turns after an even or later turn is follow(after, text), where
    after refers to the call two turns before.
    """
    identifier = lambda turn: F.concat_ws("-", F.lit("call"), "conv_id", turn)
    follows = F.col("turn") >= 2
    after = F.when(follows, F.struct(identifier(F.col("turn") - 2).alias("$ref")))
    call = F.struct(identifier(F.col("turn")).alias("id"), F.when(follows, "follow").otherwise("reply").alias("name"), F.to_json(F.struct(F.col("text"), after.alias("after"))).alias("arguments"))
    calls = F.when(F.col("role") == "user", F.array(call))
    result = F.when(F.col("role") == "assistant", identifier(F.col("turn") - 1))
    return link(common.table(spark, sf_dir, "conversations"), TOOLS, calls, result)


SQL = """
WITH c AS (SELECT * FROM conversations),
call AS (SELECT conv_id, turn, min(text) AS text FROM c WHERE role = 'user' GROUP BY conv_id, turn),
run AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM call),
lev AS (SELECT conv_id, turn, CAST(2 * (row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1) AS INTEGER) AS level FROM run),
answer AS (SELECT DISTINCT conv_id, turn - 1 AS turn FROM c WHERE role = 'assistant')
SELECT c.conv_id, c.turn, c.role, CAST(c.role = 'user' AS BIGINT) AS n_calls, CAST(c.role = 'user' AND a.turn IS NOT NULL AS BIGINT) AS n_answered,
       CAST(c.role = 'user' AND c.text IS NOT NULL AS BIGINT) AS n_valid, CASE WHEN c.role = 'assistant' THEN q.turn END AS call_turn,
       CASE WHEN c.role = 'user' THEN l.level WHEN c.role = 'assistant' AND q.turn IS NOT NULL THEN q.level + 1 ELSE 0 END AS level,
       '{"content":' || to_json(c.text) || ',"role":' || to_json(c.role)
         || CASE c.role WHEN 'assistant' THEN ',"tool_call_id":"call-' || c.conv_id || '-' || (c.turn - 1) || '"'
                        WHEN 'user' THEN ',"tool_calls":[{"arguments":{' || CASE WHEN c.turn >= 2 THEN '"after":{"$ref":"call-' || c.conv_id || '-' || (c.turn - 2) || '"},' ELSE '' END
                             || '"text":' || to_json(c.text) || '},"id":"call-' || c.conv_id || '-' || c.turn || '","name":"' || CASE WHEN c.turn >= 2 THEN 'follow' ELSE 'reply' END || '"}]' ELSE '' END || '}' AS json
FROM c LEFT JOIN answer a ON a.conv_id = c.conv_id AND a.turn = c.turn LEFT JOIN lev q ON q.conv_id = c.conv_id AND q.turn = c.turn - 1
LEFT JOIN lev l ON l.conv_id = c.conv_id AND l.turn = c.turn
"""
