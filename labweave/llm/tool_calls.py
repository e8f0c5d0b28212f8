"""Tool calls of conversations: linked with their results, ordered, checked and written as canonical JSON.

Everything is DataFrame operations. Calls meet their results in a hash join on conversation and call id. A call's level is one more than
the largest level of the calls it depends on: each round settles the calls whose dependencies are settled, so rounds follow the longest
chain and not the number of calls. Arguments are parsed once and checked against the schema of the named tool. Canonical JSON has
sorted keys, no blanks and one spelling of each value.

Defined cases: arguments that are null or no JSON object are a problem of the call, as are unknown tools, missing, mistyped, unknown or
out-of-range parameters; a dependency that is no call counts as settled and is reported; calls on a cycle, or behind one, have no
level; of calls with one id the first by turn and content counts, of results the smallest; null ids take no part; an empty table gives
no rows; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labweave.llm.shared import stored


@dataclass(frozen=True)
class Parameter:
    """One parameter of a tool: ``kind`` is string, integer, number, boolean, array or object."""

    name: str
    kind: str
    required: bool = True
    least: float | None = None  # of a number, or of a string's length
    most: float | None = None
    choices: tuple[str, ...] = ()


#: What a variant's schema calls each kind.
_KINDS = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "number": "BIGINT|DOUBLE|DECIMAL.*", "array": "ARRAY.*", "object": "OBJECT.*"}


def canonical(json: Column) -> Column:
    """One spelling of a JSON text: keys sorted, no blanks; null where it is no JSON."""
    return F.to_json(F.try_parse_json(json))


def _quoted(value: Column) -> Column:
    """A string as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def _problems(parsed: Column, tools: dict[str, tuple[Parameter, ...]], name: Column, text: Column) -> Column:
    """What is wrong with the arguments, in a fixed order, joined by ``;``."""
    out = F.when(name.isNull() | ~name.isin(*tools), F.array(F.lit("unknown tool")))
    for tool, parameters in sorted(tools.items()):
        found = []
        for p in sorted(parameters, key=lambda p: p.name):
            value = F.try_variant_get(parsed, f"$['{p.name}']", "variant")
            kind = F.schema_of_variant(value)
            absent = value.isNull() | (kind == "VOID")
            right = kind.rlike(f"^({_KINDS[p.kind]})$")
            missing = F.when(absent, F.lit(f"{p.name}: missing")) if p.required else F.when(absent, F.lit(None).cast("string"))
            wrong = missing.when(~right, F.lit(f"{p.name}: not {p.kind}"))
            if p.kind in ("integer", "number", "string"):
                size = F.length(F.try_variant_get(parsed, f"$['{p.name}']", "string")).cast("double") if p.kind == "string" else F.try_variant_get(parsed, f"$['{p.name}']", "double")
                for limit, beyond in ((p.least, lambda s, x: s < x), (p.most, lambda s, x: s > x)):
                    if limit is not None:
                        wrong = wrong.when(beyond(size, F.lit(float(limit))), F.lit(f"{p.name}: out of range"))
            if p.choices:
                wrong = wrong.when(~F.try_variant_get(parsed, f"$['{p.name}']", "string").isin(*p.choices), F.lit(f"{p.name}: not a choice"))
            found.append(wrong)
        known = F.array(*(F.lit(p.name) for p in parameters)) if parameters else F.array().cast("array<string>")
        others = F.transform(F.array_sort(F.array_except(F.json_object_keys(text), known)), lambda k: F.concat(k, F.lit(": unknown")))
        checked = F.concat(F.filter(F.array(*found), lambda x: x.isNotNull()), F.coalesce(others, F.array().cast("array<string>")))
        whole = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
        out = out.when(name == tool, F.when(whole, checked).otherwise(F.array(F.lit("arguments: no object"))))
    return F.array_join(out, ";")


def levels(calls: DataFrame) -> DataFrame:
    """``conv_id``, ``call_id``, ``level`` (null on or behind a cycle) and ``unresolved``, how many dependencies are no call.

    ``calls`` has ``conv_id``, ``call_id`` and the array ``depends_on``, one row for each call.
    """
    ids = calls.select("conv_id", "call_id")
    needed = calls.select("conv_id", "call_id", F.explode(F.array_distinct("depends_on")).alias("needs")).where("needs is not null")
    target = ids.select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"))
    looked = needed.join(target, (F.col("conv_id") == F.col("_conv")) & (F.col("needs") == F.col("_call")), "left")
    counts = looked.groupBy("conv_id", "call_id").agg(
        F.count(F.when(F.col("_call").isNull(), 1)).alias("unresolved"), F.count("_call").alias("open"),
    )
    edges = stored(looked.where("_call is not null").select("conv_id", "call_id", "needs"))
    start = calls.select("conv_id", "call_id").join(counts, ["conv_id", "call_id"], "left").fillna(0, ["unresolved", "open"])
    state = stored(start.withColumn("level", F.when(F.col("open") == 0, F.lit(0))))
    waiting = state.where("level is null").count()
    while waiting:
        done = state.where("level is not null").select("conv_id", F.col("call_id").alias("needs"), F.col("level").alias("below"))
        reached = edges.join(done, ["conv_id", "needs"]).groupBy("conv_id", "call_id").agg(F.count("*").alias("met"), F.max("below").alias("below"))
        state = stored(
            state.join(reached, ["conv_id", "call_id"], "left")
            .withColumn("level", F.coalesce("level", F.when(F.col("met") == F.col("open"), F.col("below") + 1))).drop("met", "below")
        )
        left = state.where("level is null").count()
        if left == waiting:
            break
        waiting = left
    return state.select("conv_id", "call_id", "level", "unresolved")


def link_tool_calls(calls: DataFrame, results: DataFrame, tools: dict[str, tuple[Parameter, ...]]) -> DataFrame:
    """One row for each call: ``conv_id``, ``turn``, ``call_id``, ``name``, ``level``, ``unresolved``, ``linked``, ``problems`` and the
    canonical ``json`` of call and result. Ordering a conversation by level, then turn, is a topological order.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), depends_on. ``results``: conv_id, call_id, content.
    """
    content = F.struct("turn", "name", "arguments", "depends_on")
    unique = (
        calls.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(content).alias("call"))
        .select("conv_id", "call_id", "call.*")
    )
    order = levels(unique.select("conv_id", "call_id", "depends_on"))
    answers = results.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min("content").alias("content"), F.count("*").alias("answers"))
    joined = (
        unique.drop("depends_on").join(order, ["conv_id", "call_id"]).join(answers.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
        .withColumn("parsed", F.try_parse_json("arguments"))
    )
    arguments = F.coalesce(F.to_json("parsed"), F.lit("null"))
    result = F.when(F.col("content").isNull(), F.lit("null")).otherwise(_quoted(F.col("content")))
    name = F.when(F.col("name").isNull(), F.lit("null")).otherwise(_quoted(F.col("name")))
    return joined.select(
        "conv_id", "turn", "call_id", "name", F.col("level").cast("int").alias("level"), F.col("unresolved").cast("long").alias("unresolved"),
        F.col("answers").isNotNull().alias("linked"), _problems(F.col("parsed"), tools, F.col("name"), F.col("arguments")).alias("problems"),
        F.concat(F.lit('{"arguments":'), arguments, F.lit(',"id":'), _quoted(F.col("call_id")), F.lit(',"name":'), name, F.lit(',"result":'), result, F.lit("}")).alias("json"),
    )


#: Tools of the calls that ``conversation_calls`` derives.
CONVERSATION_TOOLS = {
    "configure": (Parameter("prompt", "string", least=1),),
    "search": (Parameter("limit", "integer", least=1, most=50), Parameter("query", "string", least=1)),
    "summarise": (Parameter("source", "string"), Parameter("words", "integer", least=1)),
}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that the turns of plain conversations stand for.

    A system turn configures, a user turn searches for its text, and any other turn summarises the turn before, whose result is the text.
    A search depends on the conversation's opening turn, a summary on the turn before it.
    """
    conv, turn, role = F.col("conv_id").cast("string"), F.col("turn"), F.col("role")
    here, before, opening = (F.concat(F.lit("c"), conv, F.lit("-"), x.cast("string")) for x in (turn, turn - 1, F.lit(0)))
    name = F.when(role == "system", F.lit("configure")).when(role == "user", F.lit("search")).otherwise(F.lit("summarise"))
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \n]+"), lambda x: x != ""))
    arguments = (
        F.when(role == "system", F.to_json(F.struct(F.col("text").alias("prompt"))))
        .when(role == "user", F.to_json(F.struct(F.col("text").alias("query"), (turn + 1).alias("limit"))))
        .otherwise(F.to_json(F.struct(words.alias("words"), before.alias("source"))))
    )
    depends = F.when(role == "system", F.array().cast("array<string>")).when(role == "user", F.when(turn > 0, F.array(opening)).otherwise(F.array().cast("array<string>"))).otherwise(F.array(before))
    calls = turns.select("conv_id", "turn", here.alias("call_id"), name.alias("name"), arguments.alias("arguments"), depends.alias("depends_on"))
    results = turns.where(F.coalesce(~role.isin("system", "user"), F.lit(True))).select("conv_id", before.alias("call_id"), F.col("text").alias("content"))
    return calls, results
