"""Chat formatting: tool calls linked to results, ordered, validated and written as canonical JSON.

Only DataFrame functions are used. Every row stands for itself: no conversation is ever gathered in
one task, and a conversation's lines in order are those sorted by (level, turn, call_id).
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskline.llm.common import any_of, discard, written

#: Tools by name, their arguments as name -> (JSON type, required). A user's turn is a call of 'reply'.
TOOLS: dict[str, dict[str, tuple[str, bool]]] = {"reply": {"prompt": ("string", True)}}
_TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}
_CALLS = "content string, tool_calls array<struct<id:string,name:string,arguments:string,after:array<string>>>"
_RESULT = "tool_call_id string, content string"


def canonical(json: Column) -> Column:
    """A JSON text with sorted keys and no white space; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(json))


def calls_and_results(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, other messages) of messages (conv_id, turn, role, text).

    Explicit ones are JSON texts: an assistant's {"content", "tool_calls": [{id, name, arguments, after}]}, where
    after lists calls that must come first and content is a message beside them, and a tool's {"tool_call_id",
    "content"}. Any other turn of the user is a call of 'reply' whose identifier is its turn, and the assistant's
    turn that follows its result; a list without a call (empty, or of nulls) is such a turn.
    """
    m = messages.select("conv_id", "turn", "role", "text")
    looks_json = F.coalesce(F.col("text").rlike(r"^\s*\{"), F.lit(False))
    role = F.coalesce("role", F.lit(""))
    m = m.withColumn("said", F.when(looks_json & (role == "assistant"), F.from_json("text", _CALLS))).withColumn(
        "answer", F.when(looks_json & (role == "tool"), F.from_json("text", _RESULT))
    )
    m = m.withColumn("made", F.filter("said.tool_calls", lambda c: c.isNotNull()))
    explicit = F.coalesce(F.size("made") > 0, F.lit(False))
    answered = F.col("answer.tool_call_id").isNotNull()
    keys = ("conv_id", "turn")
    own = F.concat(F.lit("turn-"), F.col("turn").cast("string"))
    calls = (
        m.where(explicit).select(*keys, F.explode("made").alias("c"))
        .select(*keys, F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.coalesce("c.after", F.array().cast("array<string>")).alias("after"))
        .unionByName(m.where((role == "user")).select(*keys, own.alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt")), {"ignoreNullFields": "false"}).alias("arguments"), F.array().cast("array<string>").alias("after")))
    )
    results = (
        m.where(answered).select(*keys, F.col("answer.tool_call_id").alias("call_id"), F.col("answer.content").alias("content"))
        .unionByName(m.where((role == "assistant") & ~explicit).select(*keys, F.concat(F.lit("turn-"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("text").alias("content")))
    )
    beside = m.where(explicit & (F.col("said.content") != "")).select(*keys, "role", F.col("said.content").alias("text"))
    other = m.where(~role.isin("user", "assistant") & ~answered).select(*keys, "role", "text").unionByName(beside)
    return calls, results, other


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Full hash join by (conv_id, call_id). A call's result is its first by turn and content; all are counted.

    Results are reduced to one row for each identifier before the join, so repeated rows don't multiply.
    Each further result is a row of its own, without a name and with further = true.
    """
    first = results.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results")
    )
    joined = calls.hint("shuffle_hash").join(first.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    known = calls.select("conv_id", "call_id").distinct()
    orphans = first.hint("shuffle_hash").join(known.hint("shuffle_hash"), ["conv_id", "call_id"], "left_anti")
    unnamed = results.where("conv_id is null or call_id is null").select("conv_id", "call_id", F.struct("turn", "content").alias("r"), F.lit(1).cast("long").alias("n_results"))
    # equal results of an identifier are told apart by their number only, so no row needs one of its own
    same = results.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id", F.struct("turn", "content").alias("r")).agg(F.count("*").alias("copies"))
    several = first.where("n_results > 1").select("conv_id", "call_id", F.col("r").alias("r0"), "n_results")
    left = same.join(several.hint("shuffle_hash"), ["conv_id", "call_id"]).withColumn("copies", F.col("copies") - F.col("r").eqNullSafe(F.col("r0")).cast("long"))
    further = left.where("copies > 0").select("conv_id", "call_id", "r", "n_results", F.lit(True).alias("further"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")
    out = joined.unionByName(orphans, allowMissingColumns=True).unionByName(unnamed, allowMissingColumns=True)
    return out.unionByName(further, allowMissingColumns=True)


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls that come after others: the length of the longest chain before.

    Rounds of Kahn's method over the edges alone, each ending in a written table; calls on or behind a
    cycle get level null. Edges from calls that don't exist are left out. There are as many rounds as
    the longest chain has calls; where none becomes ready, only cycles and what follows them are left.
    """
    edges = calls.select("conv_id", F.explode("after").alias("before"), "call_id").distinct()
    known = calls.select("conv_id", F.col("call_id").alias("before")).distinct()
    edges = edges.join(known, ["conv_id", "before"], "left_semi")
    spark, empty = calls.sparkSession, "conv_id long, call_id string, level int"
    if edges.isEmpty():
        return spark.createDataFrame([], empty)
    todo = written(edges)
    done = None
    for k in count():
        waiting = todo.select("conv_id", "call_id").distinct()
        free = todo.select("conv_id", F.col("before").alias("call_id")).distinct().join(waiting, ["conv_id", "call_id"], "left_anti")
        released = todo.join(free.select("conv_id", F.col("call_id").alias("before")), ["conv_id", "before"], "left_semi")
        rest = written(todo.join(free.select("conv_id", F.col("call_id").alias("before")), ["conv_id", "before"], "left_anti"))
        ready = written(released.select("conv_id", "call_id").distinct().join(rest.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(k + 1)))
        done = ready if done is None else done.unionByName(ready)
        discard(todo)
        todo = rest
        if todo.isEmpty() or ready.isEmpty():
            break
    stuck = todo.select("conv_id", "call_id").distinct().withColumn("level", F.lit(None).cast("int"))
    return done.unionByName(stuck)


def problems(name: Column, arguments: Column, tools: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Array of what is wrong with a call's arguments by its tool's schema; empty if nothing."""
    value = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    found = []
    for tool, schema in sorted(tools.items()):
        checks = [F.when(F.size(F.array_except(keys, F.array(*(F.lit(a) for a in sorted(schema))))) > 0, F.lit("unknown argument"))]
        for arg, (kind, required) in sorted(schema.items()):
            at = F.try_variant_get(value, f"$['{arg}']", "variant")
            missing = at.isNull() | F.is_variant_null(at)
            of = F.schema_of_variant(at)
            checks.append(F.when(missing, F.lit(f"missing {arg}") if required else F.lit(None)).when(~any_of([of.startswith(t) for t in _TYPES[kind]]), F.lit(f"{arg} is no {kind}")))
        found.append((tool, F.filter(F.array(*checks), lambda x: x.isNotNull())))
    none = F.array(F.lit("unknown tool"))
    by_tool = none
    for tool, checks in found:
        by_tool = F.when(name == tool, checks).otherwise(by_tool)
    return F.when(name.isNull(), none).when(value.isNull() | keys.isNull(), F.array(F.lit("arguments are no JSON object"))).otherwise(by_tool)


def format_chat(messages: DataFrame, tools: dict[str, dict[str, tuple[str, bool]]] = TOOLS) -> DataFrame:
    """(conv_id, turn, kind, call_id, level, n_results, valid, problems, json): a line for each message or call.

    kind is call, orphan (a result without its call), result (one after the first of its identifier) or message. json is canonical: keys sorted, no
    white space. A call is valid if its arguments fit its tool's schema, it has exactly one result and
    it is on no cycle. Null roles are plain messages, a user's null text is an argument that is missing,
    results without an identifier are orphans, repeated calls are lines of their own. Other columns are
    left unread; an empty table gives no rows.
    """
    calls, results, other = calls_and_results(messages)
    deep = levels(calls)
    cyclic = F.col("in_order").isNotNull() & F.col("level").isNull()
    linked = link(calls, results).join(deep.withColumn("in_order", F.lit(1)).hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    is_call = F.col("name").isNotNull()
    args = F.col("arguments")
    wrong = F.concat(problems(F.col("name"), args, tools), F.when(F.col("n_results").isNull(), F.array(F.lit("no result"))).when(F.col("n_results") > 1, F.array(F.lit("several results"))).otherwise(F.array().cast("array<string>")), F.when(cyclic, F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>")))
    parts = {
        "arguments": F.coalesce(canonical(args), F.to_json(F.to_variant_object(F.struct(args.alias("raw"))))),
        "id": _string(F.col("call_id")), "name": _string(F.col("name")), "result": _string(F.col("r.content")),
    }
    line = F.concat(F.lit("{"), *[x for i, (k, v) in enumerate(sorted(parts.items())) for x in (F.lit(("," if i else "") + f'"{k}":'), F.coalesce(v, F.lit("null")))], F.lit("}"))
    orphan = F.concat(F.lit('{"id":'), _string(F.col("call_id")), F.lit(',"result":'), _string(F.col("r.content")), F.lit("}"))
    lines = linked.select(
        "conv_id", F.coalesce("turn", "r.turn").alias("turn"), F.when(is_call, "call").when(F.col("further"), "result").otherwise("orphan").alias("kind"), "call_id",
        F.when(cyclic, F.lit(None)).otherwise(F.coalesce("level", F.lit(0))).cast("int").alias("level"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        F.when(is_call, wrong).when(F.col("further"), F.array(F.lit("several results"))).otherwise(F.array(F.lit("no call"))).alias("problems"), F.when(is_call, line).otherwise(orphan).alias("json"),
    )
    plain = other.select(
        "conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("n_results"),
        F.array().cast("array<string>").alias("problems"), F.concat(F.lit('{"role":'), _string(F.col("role")), F.lit(',"text":'), _string(F.col("text")), F.lit("}")).alias("json"),
    )
    return lines.unionByName(plain).withColumn("valid", F.size("problems") == 0).withColumn("problems", F.array_join("problems", "; "))


def _string(c: Column) -> Column:
    """A text as a JSON string, null as null."""
    made = F.to_json(F.struct(c.alias("x")))  # {"x":"..."}
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substring(made, F.lit(6), F.length(made) - 6))
