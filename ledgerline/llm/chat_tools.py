"""Chat formatting with linked tool calls, in DataFrame operations only.

Calls and results are hash-joined by conversation and identifier, ordered so
that every call follows what it depends on, checked against the parameters of
their tool, and written as canonical JSON (keys sorted, no blanks)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize, prefix_sums, scratch, shared_path

#: Schema of the call that a plain exchange stands for: (tool, parameter, type, required).
REPLY_SCHEMA = (("reply", "text", "string", True), ("reply", "turn", "integer", False))
#: Turns that share a range when the records of a conversation are numbered.
_TURNS = 1 << 10
#: Where a null turn stands among turns, in comparisons only.
_NO_TURN = -(1 << 49)
#: Edges that the driver takes to peel the last of long chains.
_REST = 1 << 16
_CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after array<string>"


def schema_table(spark: SparkSession, rows: tuple = REPLY_SCHEMA) -> DataFrame:
    return spark.createDataFrame(list(rows), "tool string, param string, type string, required boolean")


def exchanges(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, messages) of plain conversations: a user turn calls
    `reply` with its text and turn and depends on the exchange two turns before,
    the assistant turn after it is the result; any other role is a message."""
    c = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    name = lambda back: F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - back).cast("string"))
    calls = c.where("role = 'user'").select(
        "conv_id", "turn", name(0).alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct("text", "turn")).alias("arguments"), F.when(F.col("turn") >= 2, F.array(name(2))).otherwise(F.array().cast("array<string>")).alias("after")
    )
    results = c.where("role = 'assistant'").select("conv_id", "turn", name(1).alias("call_id"), F.col("text").alias("content"))
    return calls, results, c.where("role is null or role not in ('user', 'assistant')").select("conv_id", "turn", "role", F.col("text").alias("content"))


def tool_messages(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, messages) of conversations in the tool protocol: an
    assistant text {"tool_calls": [{"id", "name", "arguments", "after"?}, ...]}
    and a tool text {"tool_call_id", "content"}; anything else, malformed JSON
    included, is a message."""
    c = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    v = c.withColumn("v", F.when(F.col("role").isin("assistant", "tool") & F.ltrim("text").startswith("{"), F.try_parse_json("text")))
    v = v.withColumn("many", F.expr("try_variant_get(v, '$.tool_calls', 'array<variant>')")).withColumn("answered", F.expr("try_variant_get(v, '$.tool_call_id', 'string')"))
    is_call = (F.col("role") == "assistant") & F.col("many").isNotNull()
    is_result = (F.col("role") == "tool") & F.col("answered").isNotNull()
    one = v.where(is_call).select("conv_id", "turn", F.explode("many").alias("one"))
    calls = one.select(
        "conv_id",
        "turn",
        F.expr("try_variant_get(one, '$.id', 'string')").alias("call_id"),
        F.expr("try_variant_get(one, '$.name', 'string')").alias("name"),
        F.coalesce(F.expr("CASE WHEN schema_of_variant(variant_get(one, '$.arguments')) = 'STRING' THEN try_variant_get(one, '$.arguments', 'string') END"), F.expr("to_json(variant_get(one, '$.arguments'))")).alias("arguments"),
        F.coalesce(F.expr("try_variant_get(one, '$.after', 'array<string>')"), F.array().cast("array<string>")).alias("after"),
    )
    results = v.where(is_result).select("conv_id", "turn", F.col("answered").alias("call_id"), F.coalesce(F.expr("try_variant_get(v, '$.content', 'string')"), F.expr("to_json(variant_get(v, '$.content'))")).alias("content"))
    plain = v.where(~F.coalesce(is_call | is_result, F.lit(False))).select("conv_id", "turn", "role", F.col("text").alias("content"))
    return calls, results, plain


def tool_calls_and_exchanges(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, messages): turns in the tool protocol as tool_messages()
    reads them, all other turns as exchanges()."""
    calls, results, plain = tool_messages(conversations)
    more, answers, messages = exchanges(plain.withColumnRenamed("content", "text"))
    return calls.unionByName(more), results.unionByName(answers), messages


def _fits(value: Column, kind: Column) -> Column:
    shape = F.schema_of_variant(value)
    whole = (shape == "BIGINT") | shape.rlike(r"^DECIMAL\(\d+,0\)$")
    return (
        F.when(kind == "string", shape == "STRING")
        .when(kind == "integer", whole)
        .when(kind == "number", whole | shape.startswith("DECIMAL") | shape.isin("DOUBLE", "FLOAT"))
        .when(kind == "boolean", shape == "BOOLEAN")
        .when(kind == "object", shape.startswith("OBJECT"))
        .when(kind == "array", shape.startswith("ARRAY"))
        .when(kind == "null", shape == "VOID")
        .otherwise(F.lit(True))
    )


def validate(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Adds `errors`, the breaches of the tool's schema in the order missing,
    wrong type, unknown parameter (or `unknown tool`, `arguments are no object`)
    and `canonical`, the arguments as canonical JSON."""
    tools = schemas.where("tool is not null and param is not null").groupBy(F.col("tool").alias("__tool")).agg(F.array_sort(F.collect_set(F.struct("param", "type", "required"))).alias("__params"))
    c = calls.join(tools, F.col("name") == F.col("__tool"), "left").withColumn("__v", F.try_parse_json("arguments"))
    c = c.withColumn("__m", F.expr("CASE WHEN schema_of_variant(__v) LIKE 'OBJECT%' THEN try_cast(__v AS map<string, variant>) END"))
    missing = F.transform(F.filter("__params", lambda p: p["required"] & ~F.map_contains_key(F.col("__m"), p["param"])), lambda p: F.concat(F.lit("missing "), p["param"]))
    wrong = F.transform(F.filter("__params", lambda p: F.map_contains_key(F.col("__m"), p["param"]) & ~_fits(F.element_at("__m", p["param"]), p["type"])), lambda p: F.concat(F.lit("wrong type "), p["param"]))
    unknown = F.transform(F.filter(F.map_keys("__m"), lambda k: ~F.exists("__params", lambda p: p["param"] == k)), lambda k: F.concat(F.lit("unknown parameter "), k))
    errors = F.when(F.col("__params").isNull(), F.array(F.lit("unknown tool"))).when(F.col("__m").isNull(), F.array(F.lit("arguments are no object"))).otherwise(F.concat(missing, wrong, F.array_sort(unknown)))
    quoted = F.to_json(F.struct(F.coalesce("arguments", F.lit("")).alias("x")))  # {"x":"..."}
    canonical = F.coalesce(F.to_json("__v"), quoted.substr(F.lit(6), F.length(quoted) - 6))
    return c.withColumn("errors", errors).withColumn("canonical", canonical).drop("__tool", "__params", "__v", "__m")


def order_levels(calls: DataFrame, max_depth: int = 64) -> DataFrame:
    """(key, call_id, level) of the calls of conversations in which some call
    can't stay where the transcript has it. Sorting by (level, turn) puts each
    call after those it depends on.

    An edge to a later call raises the level above it, any other edge keeps it
    as high. Calls are peeled: a round settles the edges to calls that wait for
    nothing, until none is left or none can be settled. What is left then
    depends on itself or waits for a call that does: its level is null. After
    max_depth rounds a rest of at most _REST edges is peeled on the driver; a
    larger one goes on in rounds, however long its chains are."""
    path = shared_path(calls.sparkSession, "call-levels")
    with scratch():  # the tables of the rounds go with the last one
        return materialize(_peeled(calls, max_depth), "call-levels", path)


def _peeled(calls: DataFrame, max_depth: int) -> DataFrame:
    turn = F.coalesce("turn", F.lit(_NO_TURN))
    at = calls.select("key", "call_id", turn.alias("own"))
    needs = calls.select("key", "call_id", turn.alias("turn"), F.explode("after").alias("need"))
    edges = needs.join(at.select("key", F.col("call_id").alias("need"), "own"), ["key", "need"]).select("key", "call_id", "need", (F.col("own") >= F.col("turn")).cast("int").alias("up"))
    edges = materialize(edges, "edges")
    unmet = materialize(edges.join(edges.where("up = 1").select("key").distinct(), "key", "left_semi"), "unmet")
    levels = unmet.select("key", "call_id", F.lit(0).alias("level")).limit(0)
    rounds = 0
    while not unmet.isEmpty():
        if rounds >= max_depth and unmet.count() <= _REST:
            return _with_rest(unmet, levels)
        waits = unmet.select("key", F.col("call_id").alias("need")).distinct().withColumn("waits", F.lit(True))
        marked = materialize(unmet.join(waits, ["key", "need"], "left"), "marked")
        met = marked.where("waits is null")
        if met.isEmpty():
            break
        known = levels.select("key", F.col("call_id").alias("need"), "level")
        raised = met.join(known, ["key", "need"], "left").select("key", "call_id", (F.coalesce("level", F.lit(0)) + F.col("up")).alias("level"))
        levels = materialize(levels.unionByName(raised).groupBy("key", "call_id").agg(F.max("level").alias("level")), "levels")
        unmet = marked.where("waits").drop("waits")
        rounds += 1
    still = unmet.select("key", "call_id").distinct().withColumn("cyclic", F.lit(True))
    whole = levels.join(still, ["key", "call_id"], "full")
    return whole.select("key", "call_id", F.when(F.col("cyclic").isNull(), F.col("level")).alias("level"))


def _with_rest(unmet: DataFrame, levels: DataFrame) -> DataFrame:
    """The levels with those of the rest, peeled on the driver."""
    ends = unmet.select("key", "call_id").union(unmet.select("key", "need")).distinct()
    level = {(r.key, r.call_id): r.level for r in levels.join(ends, ["key", "call_id"], "left_semi").collect()}
    left, users = {}, {}
    for r in unmet.collect():
        own = (r.key, r.call_id)
        left[own] = left.get(own, 0) + 1
        users.setdefault((r.key, r.need), []).append((own, r.up))
    ready = [x for x in users if x not in left]
    while ready:
        met = ready.pop()
        for own, up in users.get(met, ()):
            level[own] = max(level.get(own, 0), level.get(met, 0) + up)
            left[own] -= 1
            if not left[own]:
                ready.append(own)
    rows = [(*own, None if n else level[own]) for own, n in left.items()]
    rest = unmet.sparkSession.createDataFrame(rows, "key string, call_id string, level int")
    return levels.join(rest, ["key", "call_id"], "left_anti").unionByName(rest)


def link_tool_calls(calls: DataFrame, results: DataFrame, messages: DataFrame, schemas: DataFrame, max_depth: int = 64) -> DataFrame:
    """One record per call (with its result), orphan result and message:
    (conv_id, seq, turn, kind, call_id, name, linked, valid, errors, json).

    seq numbers the records of a conversation in topological order. Of calls
    that share an identifier the earliest is the call, the others are kind
    `repeated_call`; of results, the earliest is linked, the others are
    `repeated_result`; a result without a call is an `orphan_result`. A null
    identifier links to nothing, a null conversation is one of its own, a null
    turn comes first and stays null. valid: arguments fit the schema and there is no cycle.
    json is canonical, null fields are left out. Numbering runs over ranges of
    turns, so a conversation of any length is spread over tasks. Repeated
    rows are repeated calls or results, long texts stay whole, extra columns are
    ignored. Empty tables give no rows."""
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n"))
    c = validate(calls.select("conv_id", "turn", "call_id", "name", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after")), schemas).withColumn("key", key)
    r = results.select("conv_id", "turn", "call_id", "content").withColumn("key", key)
    c = materialize(c.withColumn("tag", F.struct("turn", F.xxhash64("name", "arguments"))), "calls")
    r = materialize(r.withColumn("tag", F.struct("turn", F.xxhash64("content"))), "results")

    def firsts(df: DataFrame) -> DataFrame:
        return df.where("call_id is not null").groupBy("key", "call_id").agg(F.min("tag").alias("first"))

    c = c.join(firsts(c), ["key", "call_id"], "left").withColumn("real", F.coalesce(F.col("tag") == F.col("first"), F.lit(True))).drop("first")
    owned = c.where("real and call_id is not null").select("key", "call_id").distinct().withColumn("owned", F.lit(True))
    r = r.join(firsts(r), ["key", "call_id"], "left").join(owned, ["key", "call_id"], "left")
    r = r.withColumn("kind", F.when(F.col("owned").isNull(), "orphan_result").when(F.col("tag") == F.col("first"), "result").otherwise("repeated_result")).drop("first", "owned")
    answers = r.where("kind = 'result'").groupBy("key", "call_id").agg(F.min(F.struct("turn", "content")).alias("answer"))
    levels = order_levels(c.where("real and call_id is not null"), max_depth).withColumn("__moved", F.lit(True))
    c = c.join(answers, ["key", "call_id"], "left").join(levels, ["key", "call_id"], "left")
    errors = F.concat("errors", F.when(F.col("__moved") & F.col("level").isNull(), F.array(F.lit("cyclic dependency"))).otherwise(F.array().cast("array<string>")))
    said = F.concat_ws(
        "",
        F.lit('{"arguments":'),
        F.col("canonical"),
        F.lit(","),
        F.to_json(F.struct(F.col("call_id"), F.col("name"), F.when(F.col("real"), F.col("answer.content")).alias("result"), F.when(F.col("real"), F.col("answer.turn")).alias("result_turn"), F.col("turn"))).substr(2, 1 << 30),
    )
    as_calls = c.withColumn("errors", errors).select(
        "conv_id",
        "key",
        F.coalesce("level", F.lit(0)).cast("long").alias("level"),
        "turn",
        F.when(F.col("real"), "call").otherwise("repeated_call").alias("kind"),
        "call_id",
        "name",
        (F.col("real") & F.col("answer").isNotNull()).alias("linked"),
        (F.size("errors") == 0).alias("valid"),
        F.concat_ws("; ", "errors").alias("errors"),
        said.alias("json"),
    )
    rest = r.where("kind != 'result'").select("conv_id", "key", "turn", "kind", "call_id", F.to_json(F.struct("call_id", "content", "turn")).alias("json"))
    plain = messages.withColumn("key", key).select("conv_id", "key", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.to_json(F.struct("content", "role", "turn")).alias("json"))
    others = rest.unionByName(plain).select("conv_id", "key", F.lit(0).cast("long").alias("level"), "turn", "kind", "call_id", F.lit(None).cast("string").alias("name"), F.lit(False).alias("linked"), F.lit(True).alias("valid"), F.lit("").alias("errors"), "json")
    records = as_calls.unionByName(others)
    records = records.withColumn("range", F.col("level") * F.lit(1 << 40) + F.floor(F.coalesce("turn", F.lit(_NO_TURN)) / _TURNS)).withColumn("one", F.lit(1)).withColumn("digest", F.xxhash64("json"))
    placed = prefix_sums(records, ["key"], "range", ["turn", "kind", "call_id", "digest"], {"seq": "one"})
    return placed.select("conv_id", F.col("seq").cast("long").alias("seq"), "turn", "kind", "call_id", "name", "linked", "valid", "errors", "json")
