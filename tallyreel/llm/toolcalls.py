"""Chat formatting: tool calls linked to their results, ordered, validated and serialised.

Messages are rows. Calls and results are joined by conversation and call id. A result comes
after its call, and a call after the results of the calls its arguments refer to
(``{"$ref": "<call id>"}``); calls that come too early are lifted, whole chains of them in a logarithmic number of
rounds over the table. Each message is then checked and written as canonical JSON on its own, so a conversation of any length
is never gathered in one task.
"""

import json
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyreel.llm import storage

# The tools of the registered query. A parameter has a type, may be required,
# and may be limited to listed values.
TOOLS: dict[str, dict[str, dict[str, Any]]] = {
    "search": {
        "query": {"type": "string", "required": True},
        "limit": {"type": "integer"},
        "after": {"type": "reference"},
    },
    "open": {
        "page": {"type": "string", "required": True},
        "mode": {"type": "string", "values": ["html", "text"]},
        "after": {"type": "reference"},
    },
    "measure": {
        "text": {"type": "string", "required": True},
        "scale": {"type": "number", "required": True},
        "after": {"type": "reference"},
    },
}
REFERENCE = "$ref"
_PYTHON_TYPES = {"string": str, "boolean": bool, "array": list, "object": dict, "null": type(None)}

MESSAGE_COLUMNS = ("conv_id", "turn", "role", "text", "call_id", "tool", "arguments")


class _Unreadable(ValueError):
    pass


def _once(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    names = [n for n, _ in pairs]
    if len(set(names)) < len(names):
        raise _Unreadable("repeated key")
    return dict(pairs)


def _no_constant(name: str) -> None:
    raise _Unreadable(f"{name} is not JSON")


def read_json(text: str) -> Any:
    """Strict JSON: repeated keys and NaN are errors."""
    return json.loads(text, object_pairs_hook=_once, parse_constant=_no_constant)


def canonical(value: Any) -> str:
    """Keys in order of their code points, no white space, characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _fits(value: Any, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool)
    if kind == "number":
        return isinstance(value, int | float) and not isinstance(value, bool)
    if kind == "reference":
        return isinstance(value, dict) and set(value) == {REFERENCE} and isinstance(value[REFERENCE], str)
    return isinstance(value, _PYTHON_TYPES[kind])


def faults_of(tool: str | None, arguments: Any, tools: Mapping[str, Mapping[str, Mapping[str, Any]]]) -> list[str]:
    """What is wrong with a call's arguments, in a fixed order."""
    if tool not in tools:
        return ["unknown tool"]
    if not isinstance(arguments, dict):
        return ["arguments are not an object"]
    schema, out = tools[tool], []
    for name in sorted(schema):
        wanted = schema[name]
        if name not in arguments:
            if wanted.get("required"):
                out.append(f"{name}: missing")
        elif not _fits(arguments[name], wanted["type"]):
            out.append(f"{name}: not {wanted['type']}")
        elif "values" in wanted and arguments[name] not in wanted["values"]:
            out.append(f"{name}: not a listed value")
    return out + [f"{name}: unknown" for name in sorted(set(arguments) - set(schema))]


def references_of(value: Any) -> list[str]:
    """Call ids that arguments refer to."""
    if isinstance(value, dict):
        if set(value) == {REFERENCE} and isinstance(value[REFERENCE], str):
            return [value[REFERENCE]]
        return [r for v in value.values() for r in references_of(v)]
    return [r for v in value for r in references_of(v)] if isinstance(value, list) else []


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text in batch.column("arguments").to_pylist():
            try:
                found.append(sorted(set(references_of(read_json(text or "")))))
            except (ValueError, RecursionError):
                found.append([])
        yield pa.RecordBatch.from_pydict(
            {
                "conv_id": batch.column("conv_id"),
                "call_id": batch.column("call_id"),
                "turn": batch.column("turn"),
                "refers": pa.array(found, pa.list_(pa.string())),
            }
        )


def _serialise(tools: Mapping[str, Mapping[str, Mapping[str, Any]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, faults = [], []
            for row in batch.to_pylist():
                message: dict[str, Any] = {"content": row["text"], "role": row["role"]}
                own: list[str] = []
                if row["is_call"]:
                    arguments: Any = row["arguments"]
                    try:
                        arguments = read_json(row["arguments"] or "")
                        own = faults_of(row["tool"], arguments, tools)
                    except (ValueError, RecursionError):
                        own = ["arguments are not JSON"]
                    call = {"arguments": arguments, "id": row["call_id"], "name": row["tool"]}
                    message["tool_calls"] = [call]
                elif row["call_id"] is not None:
                    message["tool_call_id"] = row["call_id"]
                try:
                    texts.append(canonical(message))
                except (ValueError, RecursionError):
                    message["tool_calls"][0]["arguments"] = row["arguments"]
                    own = ["arguments are not JSON"]
                    texts.append(canonical(message))
                faults.append(own)
            kept = [c for c in batch.schema.names if c not in ("text", "tool", "arguments")]
            columns = [*(batch.column(c) for c in kept), pa.array(texts), pa.array(faults, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "message", "faults"])

    return run


def _place(at, depth):
    return F.struct(at.alias("at"), depth.cast("long").alias("depth"))


def _referring(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls of the conversations in which some call comes too early, if they refer to others.

    ``base`` is the place that a call has if all calls it refers to keep their turn, ``open`` the calls
    still to be followed, each with the depth that the way there adds: two a reference, one for the
    call and one for its result. ``most`` is the depth that no way without a repeated call exceeds.
    """
    key = ["conv_id", "call_id"]
    last = results.groupBy(*key).agg(F.max("turn").alias("result_turn"))
    needed = (
        calls.select(*key, F.col("turn").alias("needed_turn"))
        .join(last, key)
        .withColumnRenamed("call_id", "needed")
    )
    edges = calls.select(*key, "turn", F.explode("refers").alias("needed")).join(needed, ["conv_id", "needed"])
    behind = F.greatest(
        _place(F.col("result_turn"), F.lit(1)), _place(F.col("needed_turn"), F.lit(2)), _place(F.col("turn"), F.lit(0))
    )
    return edges.groupBy(*key, "turn").agg(
        F.max(behind).alias("base"),
        F.collect_list(F.struct("needed", F.lit(2).cast("long").alias("adds"))).alias("open"),
    )


def _jump(states: DataFrame) -> DataFrame:
    """One round: a reference to a call that has one way on goes that way, to a placed call it ends.

    A reference to a call with several ways waits until at most one is left. Ways double in length
    each round. A way longer than the conversation has calls passes one of them twice.
    """
    key = ["conv_id", "call_id"]
    ways = states.select(*key, F.explode("open").alias("way")).select(*key, "way.*")
    ahead = states.select(
        "conv_id",
        F.col("call_id").alias("needed"),
        F.col("base").alias("next_base"),
        F.col("open").alias("next_open"),
        F.col("cyclic").alias("next_cyclic"),
    )
    met = ways.join(ahead, ["conv_id", "needed"], "left")
    n_ways = F.coalesce(F.size("next_open"), F.lit(0))
    only = F.col("next_open")[0]
    on = F.when(n_ways == 1, F.struct(only["needed"].alias("needed"), (F.col("adds") + only["adds"]).alias("adds")))
    on = on.when(n_ways > 1, F.struct("needed", "adds"))
    behind = F.when(
        F.col("next_base").isNotNull(), _place(F.col("next_base.at"), F.col("next_base.depth") + F.col("adds"))
    )
    steps = met.groupBy(*key).agg(
        F.max(behind).alias("behind"),
        F.array_distinct(F.collect_list(on)).alias("ways"),
        F.coalesce(F.bool_or("next_cyclic"), F.lit(False)).alias("led"),
        F.bool_or((n_ways <= 1) | F.coalesce("next_cyclic", F.lit(False))).alias("moved"),
    )
    stepped = states.drop("moved").join(steps, key, "left")
    ways = F.coalesce("ways", F.expr("filter(open, w -> false)"))
    cyclic = F.col("cyclic") | F.coalesce("led", F.lit(False)) | F.exists(ways, lambda w: w["adds"] > F.col("most"))
    return stepped.select(
        *key,
        "most",
        F.greatest("base", "behind").alias("base"),
        F.when(cyclic, F.expr("filter(open, w -> false)")).otherwise(ways).alias("open"),
        cyclic.alias("cyclic"),
        F.coalesce("moved", F.lit(False)).alias("moved"),
    )


def _ordered(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Place (base: at, depth) of the calls that their turn may not place, and whether a cycle holds them (cyclic).

    A call's place is the greatest of its own turn and, for each call it refers to, the place right behind
    that one's result; a result is lifted behind its call. So a place is the maximum, over all ways along references,
    of the last call's base place plus the depth of the way, and ways can be joined end to end: a chain
    of n calls takes some log2(n) rounds. Calls with several references that hang on one another take a
    round each. A conversation where turns already are the order takes no part. A reference to a
    call that is not there or has no result binds nothing.
    """
    key = ["conv_id", "call_id"]
    spark = calls.sparkSession
    with storage.scratch(spark) as settle:
        bound = settle(_referring(calls, results), "referring")
        early = F.col("base") > _place(F.col("turn"), F.lit(0))
        conversations = bound.groupBy("conv_id").agg(
            (F.count(F.lit(1)) * 2).alias("most"), F.bool_or(early).alias("early")
        )
        states = settle(
            bound.join(conversations.filter("early").drop("early"), "conv_id").select(
                *key, "most", "base", "open", F.lit(False).alias("cyclic"), F.lit(True).alias("moved")
            ),
            "states",
        )
        while True:
            left = F.size("open") > 0
            counts = states.agg(F.count_if(left).alias("open"), F.count_if(left & F.col("moved")).alias("moving")).first()
            if not counts["moving"]:
                break
            states = settle(_jump(states), "states")
        # Where nothing moves any more, every way left leads to a cycle of calls with several references.
        return storage.settle(states.select(*key, "base", (F.col("cyclic") | left).alias("cyclic")), "placed")


def format_messages(
    messages: DataFrame, tools: Mapping[str, Mapping[str, Mapping[str, Any]]] = TOOLS
) -> DataFrame:
    """Canonical JSON of every message, with its place in the conversation.

    ``messages`` has conv_id, turn (long), role, text, call_id, tool and arguments (JSON text); a row with
    call_id is a call if its role is assistant, else a result. Returns ``conv_id, turn, role, call_id,
    is_call, at, depth, status, message, faults``. Sorted by (at, depth, turn, call_id), every
    result follows its call and every call the results it refers to, as near to the turns as can be.
    status: ``plain``, ``answered``, ``unanswered``, ``repeated`` (a later call with the id of an earlier
    one), ``cycle`` (its references lead to a cycle), ``linked`` or ``orphan`` (a result without call). Calls
    on a cycle or behind one keep their turn.
    Among calls of one id the smallest turn is the call that results are linked to, of equal
    turns the one with the smallest arguments. Null ids are no ids; null conversations are not linked; null
    turns come first. A text of any length is one row's work, and an empty table gives an empty one.
    Every input row gives one row; other columns are left out.
    """
    rows = messages.select(*[F.col(f"`{c}`") for c in MESSAGE_COLUMNS]).withColumn(
        "is_call", F.coalesce((F.col("role") == "assistant") & F.col("call_id").isNotNull(), F.lit(False))
    )
    rows = storage.settle(rows.withColumn("mark", F.xxhash64("turn", "tool", "arguments", "text")), "messages")
    key = ["conv_id", "call_id"]
    first = F.min(F.struct("turn", "arguments", "mark")).alias("f")
    firsts = storage.settle(
        rows.filter("is_call AND conv_id IS NOT NULL").groupBy(*key).agg(first).select(*key, "f.*"), "calls"
    )
    results = rows.filter("NOT is_call AND call_id IS NOT NULL AND conv_id IS NOT NULL").select(*key, "turn")
    calls = storage.settle(
        firsts.mapInArrow(
            _references,
            T.StructType(
                [*(firsts.schema[c] for c in (*key, "turn")), T.StructField("refers", T.ArrayType(T.StringType()))]
            ),
        ),
        "referring",
    )
    placed = _ordered(calls, results).select(
        *key, F.when(~F.col("cyclic"), F.col("base")).alias("place"), "cyclic"
    )
    answered = results.select(*key).distinct()
    known = storage.settle(
        firsts.select(*key, F.col("mark").alias("call_mark"), F.col("turn").alias("call_turn"))
        .join(placed.select(*key, "place.*", "cyclic"), key, "left")
        .join(answered.withColumn("answered", F.lit(True)), key, "left"),
        "known-calls",
    )
    joined = rows.join(known, key, "left")
    call_at = F.coalesce("at", "call_turn")
    own = F.col("is_call") & (F.col("call_mark") == F.col("mark"))
    status = (
        F.when(F.col("call_id").isNull(), "plain")
        .when(~F.col("is_call"), F.when(F.col("call_mark").isNull(), "orphan").otherwise("linked"))
        .when(F.coalesce(~own, F.lit(False)), "repeated")
        .when(F.col("cyclic"), "cycle")
        .when(F.col("answered"), "answered")
        .otherwise("unanswered")
    )
    is_result = F.col("call_id").isNotNull() & ~F.col("is_call") & F.col("call_mark").isNotNull()
    at = F.when(own, call_at).when(is_result, F.greatest("turn", call_at)).otherwise(F.col("turn"))
    depth = F.coalesce(F.col("depth"), F.lit(0))
    after = F.when(call_at >= F.col("turn"), depth + 1).otherwise(F.lit(0))
    depth = F.when(own, depth).when(is_result, after).otherwise(F.lit(0))
    final = joined.select(
        *[c for c in MESSAGE_COLUMNS],
        "is_call",
        at.alias("at"),
        depth.cast("long").alias("depth"),
        status.alias("status"),
    )
    kept = [f for f in final.schema.fields if f.name not in ("text", "tool", "arguments")]
    made = [T.StructField("message", T.StringType()), T.StructField("faults", T.ArrayType(T.StringType()))]
    return final.mapInArrow(_serialise(tools), T.StructType([*kept, *made]))


def messages_of(conversations: DataFrame) -> DataFrame:
    """Conversations bound to messages with tool calls.

    Every assistant turn becomes a call, named by conversation and turn; the next turn, if it is
    a user's, is its result. What a call refers to goes by the conversation's number modulo 5:
    0 the call two turns earlier; 1 the one two turns later, a chain that ends at a missing call; 2 in turns
    the one before and after, a cycle; 3 the one four turns later, and every other call repeats the id of the one two
    turns before; 4 in turns itself and the one after, which so is behind a cycle. Some arguments are
    wrong on purpose: every seventh conversation has a number as text, every eleventh a
    key too many.
    """
    conv, turn = F.col("conv_id"), F.col("turn")

    def name(of):
        return F.concat(conv.cast("string"), F.lit("-"), of.cast("string"))

    kind = F.pmod(conv, F.lit(5))

    def second(of):
        return F.pmod(F.floor(of / 2), F.lit(2)) == 1

    def own_name(of):
        return F.when((kind == 3) & second(of), name(of - 2)).otherwise(name(of))

    referred = (
        F.when(kind == 0, turn - 2)
        .when(kind == 1, turn + 2)
        .when(kind == 2, F.when(second(turn), turn - 2).otherwise(turn + 2))
        .when(kind == 3, turn + 4)
        .otherwise(F.when(second(turn), turn).otherwise(turn + 2))
    )

    calls = F.col("role") == "assistant"
    results = (F.col("role") == "user") & (turn > 0)
    tool = F.element_at(F.array(*[F.lit(t) for t in TOOLS]), (F.pmod(conv, F.lit(3)) + 1).cast("int"))
    wrong = F.pmod(conv, F.lit(7)) == 0
    after = F.when(referred >= 0, F.struct(name(referred).alias(REFERENCE)))
    extra = F.when(F.pmod(conv, F.lit(11)) == 0, F.lit(True)).alias("extra")
    first_line = F.substring_index("text", "\n", 1)
    arguments = (
        F.when(
            tool == "search",
            F.to_json(
                F.struct(first_line.alias("query"), after.alias("after"), extra,
                         F.when(~wrong, turn).alias("limit"), F.when(wrong, F.lit("ten")).alias("Limit"))
            ),
        )
        .when(
            tool == "open",
            F.to_json(
                F.struct(first_line.alias("page"), F.when(wrong, "pdf").otherwise("text").alias("mode"),
                         after.alias("after"), extra)
            ),
        )
        .otherwise(
            F.to_json(F.struct(first_line.alias("text"), F.when(~wrong, turn / 2).alias("scale"), after.alias("after"), extra))
        )
    )
    return conversations.select(
        "conv_id",
        "turn",
        F.when(results, "tool").otherwise(F.col("role")).alias("role"),
        "text",
        F.when(calls, own_name(turn)).when(results, own_name(turn - 1)).alias("call_id"),
        F.when(calls, tool).alias("tool"),
        F.when(calls, arguments).alias("arguments"),
    )


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    """Per message: its place, its status, what is wrong with its arguments, and its canonical JSON."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return format_messages(messages_of(conversations)).withColumn("faults", F.array_join("faults", "; "))
