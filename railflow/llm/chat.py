"""Chat formatting (10): tool-call linking with DataFrame functions only.

Messages have a conversation, a turn, a role and content; a call has a call id, a tool name and JSON
arguments; a result (role ``tool``) names the call it answers. Calls and results of one id meet in one
hash aggregate and join back to the messages by (conversation, id). In the order of a conversation
a result comes behind its call, even if its turn is earlier. Calls have no other predecessors, so two levels are a
topological order: by (turn, or the call's turn if that is later), then calls before the results moved behind them. Places come from a range partitioning of that order, so one long
conversation is spread over tasks. Arguments are checked against the tools' schemas, and every
message is one line of canonical JSON: sorted keys, no white space, each number in one form.

Defined cases: null conversations are one conversation; messages without a call id are only placed; a
result without a call is an ``orphan``, a call without a result ``unanswered``, an id with several calls or results
``repeated`` (each result goes behind the first call); arguments that are not a JSON object, and null ones,
are errors and are serialised as a string; an unknown tool is an error; equal messages keep a place each;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railflow.skew import global_index

#: Variant types of the schema types.
_TYPES = {
    "string": "^STRING", "integer": "^(BIGINT|DECIMAL\\([0-9]+,0\\))", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "^BOOLEAN", "array": "^ARRAY",
    "object": "^OBJECT",
}

#: tool -> field -> rules: ``type``, ``required``, ``min``, ``max``, ``min_length``, ``max_length``.
Schemas = dict[str, dict[str, dict]]


def _path(name: str) -> str:
    for quote in ("'", '"'):
        if quote not in name:
            return f"$[{quote}{name}{quote}]"
    raise ValueError(f"a field name with both kinds of quotes: {name}")


def canonical_numbers(json: Column) -> Column:
    """Valid JSON text with every number in one form: plain digits without trailing zeros as long as 38 digits hold it, the
    shortest double beyond; integers stay exact. Strings stay as they are."""
    hidden = F.replace(F.replace(json, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))  # raw control characters are not in JSON

    def number(token: Column) -> Column:
        exact, whole, double = (token.try_cast(t) for t in ("decimal(38,18)", "decimal(38,0)", "double"))
        plain = F.regexp_replace(exact.cast("string"), "\\.?0+$", "")
        as_double = F.when(whole.isNotNull() & (whole.cast("double") == double), whole.cast("string")).otherwise(double.cast("string"))
        fits = exact.isNotNull() & ((exact.cast("double") == double) | (double == 0))
        shown = F.when(fits, F.when(exact == 0, F.lit("0")).otherwise(plain)).otherwise(as_double)
        return F.when(token.rlike("^-?[0-9]+$") & (token != "-0"), token).when(token.rlike("^-?[0-9]"), shown).otherwise(token)

    def outside(part: Column) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(part, F.lit("[^,:\\[\\]{}]+|[,:\\[\\]{}]"), F.lit(0)), number), "")

    parts = F.transform(F.split(hidden, '"'), lambda s, i: F.when(i % 2 == 1, s).otherwise(outside(s)))  # every other part is a string
    return F.replace(F.replace(F.array_join(parts, '"'), F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))


def _field_errors(v: Column, name: str, rules: dict) -> Column:
    """Array of the errors of one field."""
    at = _path(name)
    got = F.try_variant_get(v, at, "variant")
    right = F.schema_of_variant(got).rlike(_TYPES[rules["type"]])
    value = F.try_variant_get(v, at, "double")
    length = F.length(F.try_variant_get(v, at, "string"))
    bad = F.lit(False)
    for rule, test in (
        ("min", lambda x: value < x), ("max", lambda x: value > x), ("min_length", lambda x: length < x), ("max_length", lambda x: length > x),
    ):
        if rule in rules:
            bad = bad | F.coalesce(test(rules[rule]), F.lit(False))
    missing = F.lit(f"missing:{name}") if rules.get("required") else F.lit(None).cast("string")
    error = F.when(got.isNull(), missing).when(~right, F.lit(f"type:{name}")).when(bad, F.lit(f"range:{name}"))
    return F.array_compact(F.array(error))


def argument_errors(tool: Column, arguments: Column, schemas: Schemas) -> Column:
    """Errors of a call's arguments as an array of strings, in the order of the schema's fields; empty if none."""
    v = F.try_parse_json(arguments)
    out = F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), F.array(F.lit("not_an_object")))
    for name, fields in schemas.items():
        known = F.array(*[F.lit(f) for f in fields]) if fields else F.array().cast("array<string>")
        others = F.transform(F.array_sort(F.array_except(F.json_object_keys(arguments), known)), lambda k: F.concat(F.lit("unexpected:"), k))
        found = [_field_errors(v, f, rules) for f, rules in fields.items()]
        out = out.when(tool == name, F.concat(*found, others))
    return out.otherwise(F.array(F.lit("unknown_tool")))


def link(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per message: ``conv_id``, ``position`` in its conversation, ``turn``, ``kind``, ``call_id``, ``status``,
    ``errors`` of a call's arguments, and ``message``, its canonical JSON.

    ``messages``: conv_id, turn, role, content, call_id, name, arguments (JSON text)."""
    kind = F.when(F.col("call_id").isNull(), "message").when(F.col("role") == "tool", "result").otherwise("call")
    own = messages.select("conv_id", "turn", "role", "content", "call_id", "name", "arguments", kind.alias("kind"))
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    named = own.filter("call_id is not null")
    ids = named.groupBy(F.col("conv_id").alias("_c"), F.col("call_id").alias("_id")).agg(
        F.min(F.when(call, F.col("turn"))).alias("_call_turn"), F.count(F.when(call, 1)).alias("_calls"), F.count(F.when(result, 1)).alias("_results")
    )
    met = named.join(ids, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("call_id") == F.col("_id"))).drop("_c", "_id")
    plain = own.filter("call_id is null").select(
        "*", F.lit(None).cast(own.schema["turn"].dataType).alias("_call_turn"), F.lit(0).cast("bigint").alias("_calls"), F.lit(0).cast("bigint").alias("_results")
    )
    late = result & (F.col("_call_turn") >= F.col("turn"))
    status = (
        F.when(F.col("kind") == "message", F.lit("plain"))
        .when(result & (F.col("_calls") == 0), "orphan")
        .when(call & (F.col("_results") == 0), "unanswered")
        .when((F.col("_calls") > 1) | (F.col("_results") > 1), "repeated")
        .otherwise("linked")
    )
    errors = F.when(call, argument_errors(F.col("name"), F.col("arguments"), schemas)).otherwise(F.array().cast("array<string>"))
    v = F.try_parse_json("arguments")
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    content, role = F.col("content").alias("content"), F.col("role").alias("role")
    message = (
        F.when(F.col("kind") == "message", F.to_json(F.struct(content, role)))
        .when(result, F.to_json(F.struct("call_id", content, role)))
        .when(is_object, canonical_numbers(F.to_json(F.struct(v.alias("arguments"), "call_id", content, "name", role))))
        .otherwise(F.to_json(F.struct("arguments", "call_id", content, "name", role)))
    )
    rows = met.unionByName(plain).select(
        "conv_id", "turn", "kind", "call_id", status.alias("status"), errors.alias("errors"), message.alias("message"),
        F.when(late, F.col("_call_turn")).otherwise(F.col("turn")).alias("_key"), F.when(late, 1).otherwise(0).alias("_behind"),
    )
    placed = global_index(rows.withColumn("_tie", F.xxhash64("message")), ["conv_id", "_key", "_behind", "turn", "kind", "call_id", "_tie"], "_i")
    first = placed.groupBy(F.col("conv_id").alias("_c")).agg(F.min("_i").alias("_first"))
    return placed.join(first, F.col("conv_id").eqNullSafe(F.col("_c"))).select(
        "conv_id", (F.col("_i") - F.col("_first")).alias("position"), "turn", "kind", "call_id", "status", "errors", "message"
    )
