"""Tool-call linking: calls and results joined by identifier, ordered, validated and serialised.

A call may name a parent, an earlier call whose result it uses. A call's depth is the number of calls
above it, so ordering by depth is a topological order; a call's position is its place in the order by depth,
turn and identifier within its conversation. Depths come from pointer doubling: each
round every call looks past its present ancestor, so the rounds grow with the logarithm of the longest
chain, and no conversation is ever gathered in one place. What is left after enough rounds runs
in a circle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation
from math import ceil, isfinite, log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kveil.llm.common import map_arrow, table
from kveil.operators.project import with_dense_id
from kveil.session import cut_lineage

SMALL_SCHEMAS = 10_000  # tables of up to so many tool schemas are broadcast
CALLS = ["conv_id", "call_id", "parent_id", "turn", "name", "arguments"]
KEY = ["conv_id", "call_id"]


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth, parent_known): depth is null on a circle and below one."""
    known = calls.select("conv_id", F.col("call_id").alias("parent_id"), F.lit(True).alias("parent_known"))
    state = calls.select(*KEY, "parent_id").join(known, ["conv_id", "parent_id"], "left")
    state = state.select(
        *KEY,
        F.when(F.col("parent_known"), F.col("parent_id")).alias("above"),
        F.col("parent_known").isNotNull().cast("long").alias("depth"),
        (F.col("parent_known") | F.col("parent_id").isNull()).alias("parent_known"),
    )
    state = cut_lineage(state.withColumn("parent_known", F.coalesce("parent_known", F.lit(False))))
    rounds = ceil(log2(state.count() + 1)) + 1
    for _ in range(rounds):
        if state.filter("above IS NOT NULL").isEmpty():
            break
        far = state.select("conv_id", F.col("call_id").alias("above"), F.col("above").alias("far"), "depth")
        far = far.withColumnRenamed("depth", "more")
        state = cut_lineage(
            state.join(far, ["conv_id", "above"], "left").select(
                *KEY,
                F.col("far").alias("above"),
                (F.col("depth") + F.coalesce("more", F.lit(0).cast("long"))).alias("depth"),
                "parent_known",
            )
        )
    return state.select(*KEY, F.when(F.col("above").isNull(), F.col("depth")).alias("depth"), "parent_known")


def positions(calls: DataFrame, depth: DataFrame) -> DataFrame:
    """(conv_id, call_id, position): from 0 in a topological order of each conversation, null turns last.

    Numbered over the whole table, so a long conversation is spread over many tasks. Calls on a circle and
    below one have no position.
    """
    rows = calls.select(*KEY, F.col("turn").isNull().alias("no_turn"), "turn").join(depth.select(*KEY, "depth"), KEY)
    placed = with_dense_id(
        rows.filter("depth IS NOT NULL"), ["conv_id", "depth", "no_turn", "turn", "call_id"], id_col="no", unique=True
    )
    first = placed.groupBy("conv_id").agg(F.min("no").alias("first"))
    return placed.join(cut_lineage(first), "conv_id").select(*KEY, (F.col("no") - F.col("first")).alias("position"))


class SchemaFault(Exception):
    """A schema that cannot be applied."""


def keyword(schema: dict, name: str, *kinds: type):
    """The value of a keyword, None without it; a value of another kind is a fault of the schema."""
    if name not in schema:
        return None
    value = schema[name]
    if not isinstance(value, kinds) or isinstance(value, bool) and bool not in kinds:
        raise SchemaFault(f"schema has a wrong {name}")
    return value


NUMBERS = (int, float, Decimal)


def of_type(value: object, kind: object) -> bool:
    if kind == "null":
        return value is None
    if kind == "boolean":
        return isinstance(value, bool)
    if kind in ("integer", "number"):
        if isinstance(value, bool) or not isinstance(value, NUMBERS):
            return False
        if kind == "number" or isinstance(value, int):
            return True
        return value.is_integer() if isinstance(value, float) else value == value.to_integral_value()
    if kind == "string":
        return isinstance(value, str)
    if kind == "array":
        return isinstance(value, list)
    if kind == "object":
        return isinstance(value, dict)
    raise SchemaFault("schema has an unknown type")


def same(a: object, b: object) -> bool:
    """Equality of JSON values: numbers by value, and no number is a truth value."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return a == b


def schema_error(value: object, schema: object, where: str = "arguments") -> str | None:
    """The first way in which a value breaks a schema: type, enum, lengths, bounds, properties, items.

    Other keywords are not read. A schema may be true (anything goes) or false (nothing does).
    """
    if isinstance(schema, bool):
        return None if schema else f"{where} is not allowed"
    if not isinstance(schema, dict):
        raise SchemaFault("schema is neither an object nor a truth value")
    kind = keyword(schema, "type", str, list)
    kinds = kind if isinstance(kind, list) else [kind]
    if kind is not None and not any([of_type(value, k) for k in kinds]):
        return f"{where} is not of type {' or '.join(kinds)}"
    allowed = keyword(schema, "enum", list)
    if allowed is not None and not any(same(value, x) for x in allowed):
        return f"{where} is none of the allowed values"
    shortest, longest = keyword(schema, "minLength", *NUMBERS), keyword(schema, "maxLength", *NUMBERS)
    least, most = keyword(schema, "minimum", *NUMBERS), keyword(schema, "maximum", *NUMBERS)
    required, known = keyword(schema, "required", list) or [], keyword(schema, "properties", dict) or {}
    more = keyword(schema, "additionalProperties", bool, dict)
    items = keyword(schema, "items", bool, dict)
    if isinstance(value, str):
        if shortest is not None and len(value) < shortest:
            return f"{where} is too short"
        if longest is not None and len(value) > longest:
            return f"{where} is too long"
    if isinstance(value, NUMBERS) and not isinstance(value, bool):
        if least is not None and value < least:
            return f"{where} is too small"
        if most is not None and value > most:
            return f"{where} is too large"
    if isinstance(value, dict):
        for name in required:
            if not isinstance(name, str):
                raise SchemaFault("schema has a wrong required")
            if name not in value:
                return f"{where} lacks {name}"
        for name in sorted(value):
            if name in known:
                if error := schema_error(value[name], known[name], f"{where}.{name}"):
                    return error
            elif more is False:
                return f"{where} has unknown {name}"
            elif isinstance(more, dict) and (error := schema_error(value[name], more, f"{where}.{name}")):
                return error
    if isinstance(value, list) and items is not None:
        for i, item in enumerate(value):
            if error := schema_error(item, items, f"{where}[{i}]"):
                return error
    return None


def no_number(text: str):
    raise ValueError(f"{text} is no JSON")


def parsed(text: str) -> object:
    """A JSON value; of repeated names the last counts, and numbers too large for Python's keep their digits."""

    def whole(digits: str) -> int | Decimal:
        return int(digits) if len(digits) < 1000 else Decimal(digits)

    def broken(digits: str) -> float | Decimal:
        return x if isfinite(x := float(digits)) else Decimal(digits)

    return json.loads(text, parse_int=whole, parse_float=broken, parse_constant=no_number)


def canonical(value: object) -> str:
    """JSON with names in the order of their code points, no white space, and text as it is."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, Decimal):
        return str(value)
    return json.dumps(value, ensure_ascii=False)


def checked(arguments: str | None, schema: str | None) -> tuple[str | None, str | None]:
    """(canonical arguments, error). Every input has a defined result; without a canonical form the first is None."""
    try:
        value = parsed(arguments or "")
        text = canonical(value)
        text.encode()
    except UnicodeEncodeError:
        return None, "arguments hold half a surrogate pair"
    except (ValueError, InvalidOperation):
        return None, "arguments are not JSON"
    except RecursionError:
        return None, "arguments are nested too deeply"
    if schema is None:
        return text, "unknown tool"
    try:
        error = schema_error(value, parsed(schema))
        if error is not None:
            error.encode()
        return text, error
    except UnicodeEncodeError:
        return text, "schema holds half a surrogate pair"
    except (ValueError, InvalidOperation):
        return text, "schema is not JSON"
    except RecursionError:
        return text, "schema is nested too deeply"
    except SchemaFault as fault:
        return text, str(fault)


def record(arguments: str | None, call_id: object, name: object, result: object) -> str | None:
    """The canonical record of a call and its result; None without canonical arguments."""
    if arguments is None:
        return None
    told = {"id": call_id, "name": name, "result": result}
    rest = ",".join(f'"{k}":{canonical(None if v is None else str(v))}' for k, v in told.items())
    return f'{{"arguments":{arguments},{rest}}}'


def validate_worker(names: list[str]):
    read = ("arguments", "schema", "call_id", "name", "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, error = [], []
            for arguments, schema, call_id, name, content in zip(*(batch.column(c).to_pylist() for c in read)):
                plain, wrong = checked(arguments, schema)
                text.append(record(plain, call_id, name, content))
                error.append(wrong)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(text, pa.string()), pa.array(error, pa.string())],
                names=[*names, "json", "error"],
            )

    return work


def first_of(df: DataFrame, fields: list[str]) -> DataFrame:
    """Of rows with one identifier the first by turn, ties by content, and their number."""
    first = F.min(F.struct(*(F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("v")).alias(c) for c in fields)))
    grouped = df.groupBy(*KEY).agg(first.alias("f"), F.count(F.lit(1)).alias("copies"))
    return grouped.select(*KEY, *(F.col(f"f.{c}.v").alias(c) for c in fields), "copies")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per identifier of a call or a result.

    ``calls`` has CALLS, ``results`` conv_id, call_id, turn and content, ``schemas`` name and schema
    (JSON). Columns: conv_id, call_id, name, depth, position (see ``positions``), status (linked, no_result, no_call,
    result_before_call), copies and result_copies (calls and results with that identifier; the first by turn counts), error
    (null if valid; also unknown parents, circles, and schemas that cannot be applied), and json, the canonical
    record of call and result, null if the arguments have no canonical form. No row ends the job: see ``checked``. Rows without a conversation or identifier cannot be linked and are left
    out of the result, see ``without_identifier``; a table may be empty; other columns are
    not read. Null turns come last. Of several schemas for a tool the first in text order counts.
    """
    calls = first_of(calls.filter("conv_id IS NOT NULL AND call_id IS NOT NULL"), ["turn", "parent_id", "name", "arguments"])
    calls = cut_lineage(calls)
    results = first_of(results.filter("conv_id IS NOT NULL AND call_id IS NOT NULL"), ["turn", "content"])
    answers = results.select(
        *KEY,
        F.col("turn").alias("result_turn"),
        "content",
        F.lit(True).alias("answered"),
        F.col("copies").alias("result_copies"),
    )
    known = schemas.filter("name IS NOT NULL").groupBy("name").agg(F.min("schema").alias("schema"))
    if known.count() <= SMALL_SCHEMAS:
        known = F.broadcast(known)
    depth = depths(calls)
    placed = depth.join(positions(calls, depth), KEY, "left")
    called = calls.withColumn("called", F.lit(True)).join(placed, KEY).join(known, "name", "left")
    both = called.join(answers, KEY, "full_outer")
    names = [*KEY, "name", "turn", "result_turn", "depth", "position", "parent_known", "called", "answered", "copies", "result_copies"]
    both = both.select(*names, "content", "arguments", "schema")
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.select(*names).schema)
    done = map_arrow(both, validate_worker(names), f"{shape}, json string, error string")
    late = F.col("result_turn") < F.col("turn")
    status = (
        F.when(F.col("called").isNull(), "no_call")
        .when(F.col("answered").isNull(), "no_result")
        .when(late, "result_before_call")
        .otherwise("linked")
    )
    error = (
        F.when(F.col("called").isNull(), None)
        .when(F.col("depth").isNull(), "parents run in a circle")
        .when(~F.col("parent_known"), "unknown parent")
        .otherwise(F.col("error"))
    )

    return done.select(
        *KEY, "name", "depth", "position", status.alias("status"), "copies", "result_copies", error.alias("error"), "json"
    )


def without_identifier(calls: DataFrame, results: DataFrame) -> DataFrame:
    """One row per call or result without a conversation or identifier: status no_identifier, json as given."""
    none = "conv_id IS NULL OR call_id IS NULL"
    keys = [*KEY, F.lit("no_identifier").alias("status")]
    asked = F.to_json(F.struct("arguments", "name"), {"ignoreNullFields": "false"})
    told = F.to_json(F.struct(F.col("content").alias("result")), {"ignoreNullFields": "false"})
    lost = calls.filter(none).select(*keys, "name", asked.alias("json"))
    return lost.unionByName(results.filter(none).select(*keys, told.alias("json")), allowMissingColumns=True)


# The tools whose calls the query reads out of conversations.
TOOL_SCHEMAS = [
    (
        "answer",
        '{"type":"object","required":["limit","query"],"additionalProperties":false,"properties":'
        '{"query":{"type":"string","minLength":1,"maxLength":300},"limit":{"type":"integer","minimum":1,"maximum":40}}}',
    ),
    (
        "configure",
        '{"type":"object","required":["text"],"properties":{"text":{"type":"string","maxLength":2000}}}',
    ),
]


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User and system turns as calls, each using the turn two before it, and assistant turns as results."""
    name = F.concat_ws(":", "conv_id", "turn")
    words = F.size(F.split("text", " "))
    asked = F.to_json(F.struct(F.col("text").alias("query"), words.alias("limit")))
    told = F.to_json(F.struct(F.col("text")))
    calls = conversations.filter("role IN ('user', 'system')").select(
        "conv_id",
        name.alias("call_id"),
        F.when(F.col("turn") >= 2, F.concat_ws(":", "conv_id", F.col("turn") - 2)).alias("parent_id"),
        "turn",
        F.when(F.col("role") == "user", "answer").otherwise("configure").alias("name"),
        F.when(F.col("role") == "user", asked).otherwise(told).alias("arguments"),
    )
    results = conversations.filter("role = 'assistant'").select(
        "conv_id",
        F.concat_ws(":", "conv_id", F.col("turn") - 1).alias("call_id"),
        "turn",
        F.col("text").alias("content"),
    )
    return calls, results


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = calls_of(table(spark, sf_dir, "conversations"))
    linked = link_tool_calls(calls, results, spark.createDataFrame(TOOL_SCHEMAS, "name string, schema string"))
    return linked.unionByName(without_identifier(calls, results), allowMissingColumns=True)
