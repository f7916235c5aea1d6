"""Chat formatting: tool calls linked with their results.

Calls and results are hash-joined by (conversation, call identifier). Calls are ordered topologically by the calls that
their arguments refer to ({"$ref": id}); arguments are validated against the tool's JSON schema; a linked call is
serialised as canonical JSON (sorted keys, no white space, integral floats as integers, UTF-8; half of a surrogate pair
stays an escape).

Conversations of up to ``MAX_CALLS`` calls are ordered in one pass, call references only, no texts. In larger ones, chains
of calls with one reference are first followed to their ends by doubling steps; what has several references is then ordered
by rounds of joins, one for each level of those, so no conversation has to fit in a task.

Tools come as a dict of schemas or as a table (name, schema); a dict of up to ``MAX_TOOLS`` is broadcast, else Spark joins.
Schemas may use the keywords of ``KEYWORDS``; others are refused, since a check that is left out would say that all is well.

Defined results: a call without an identifier is ``no_id`` and links to nothing; of several calls or results of one
identifier the earliest counts, and the others are ``duplicate``; a result without a call is ``orphan_result``; a call
on or behind a cycle of references has no level; a reference to an unknown call counts as none and is an error;
arguments that are no JSON object are an error, and so are those with NaN, an infinity or a number beyond the doubles, or
nested over ``MAX_DEPTH``; an unknown tool is an error; very long texts are taken whole. An assistant's text that is no
call message as a whole (text behind the object, an empty list, no list) is a plain turn. conv_id and turn are read as
bigint. An empty table gives no rows. Extra columns are dropped.
"""

from __future__ import annotations

import json
import math
import operator
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.common import cut
from netloom.operators.graph import pointer_roots

MAX_CALLS = 10_000
MAX_TOOLS = 10_000
CALLS = "conv_id bigint, call_id string, turn bigint, name string, arguments string"
RESULTS = "conv_id bigint, call_id string, turn bigint, content string"


MAX_DEPTH = 200
HALF = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    """Canonical JSON text of a value."""

    def plain(x):
        if isinstance(x, float):
            return int(x) if x.is_integer() else x
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    text = json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


KINDS = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None), "integer": int, "number": (int, float)}
#: Keywords of schemas that are checked, and those that say nothing about validity.
KEYWORDS = (
    "type", "enum", "const", "anyOf", "allOf", "oneOf", "not", "required", "properties", "additionalProperties", "items", "minItems", "maxItems",
    "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum",
)
NOTES = ("title", "description", "default", "examples", "format", "$schema", "$id", "$comment")
BOUNDS = {"minimum": operator.ge, "maximum": operator.le, "exclusiveMinimum": operator.gt, "exclusiveMaximum": operator.lt}
SIZES = {"minItems": (list, operator.ge), "maxItems": (list, operator.le), "minLength": (str, operator.ge), "maxLength": (str, operator.le)}


def check_schema(schema) -> None:
    """Refuse what ``violations`` can't check."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict) or (unknown := set(schema) - set(KEYWORDS) - set(NOTES)):
        raise ValueError(f"schema keywords that are not checked: {sorted(unknown)}" if isinstance(schema, dict) else f"no schema: {schema!r}")
    kinds = schema.get("type", [])
    if set([kinds] if isinstance(kinds, str) else kinds) - set(KINDS):
        raise ValueError(f"unknown type: {kinds}")
    re.compile(schema.get("pattern", ""))
    for part in [*schema.get("properties", {}).values(), *(x for k in ("anyOf", "allOf", "oneOf") for x in schema.get(k, [])), *(schema[k] for k in ("not", "items", "additionalProperties") if k in schema)]:
        check_schema(part)


def violations(value, schema, at: str = "$") -> list[str]:
    """What of a checked schema ``value`` breaks."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    out = []
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        fits = [isinstance(value, KINDS[k]) and not (isinstance(value, bool) and k in ("integer", "number")) or (k == "integer" and isinstance(value, float) and value.is_integer()) for k in kinds]
        if not any(fits):
            return [f"{at}: not of type {'|'.join(kinds)}"]
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{at}: not one of the enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        out.append(f"{at}: not the constant")
    for name, fits in (("anyOf", lambda n, of: n > 0), ("allOf", lambda n, of: n == of), ("oneOf", lambda n, of: n == 1)):
        if name in schema and not fits(sum(not violations(value, x, at) for x in schema[name]), len(schema[name])):
            out.append(f"{at}: breaks {name}")
    if "not" in schema and not violations(value, schema["not"], at):
        out.append(f"{at}: breaks not")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: breaks {k}" for k, holds in BOUNDS.items() if k in schema and not holds(value, schema[k])]
    out += [f"{at}: breaks {k}" for k, (kind, holds) in SIZES.items() if k in schema and isinstance(value, kind) and not holds(len(value), schema[k])]
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{at}: breaks pattern")
    if isinstance(value, dict):
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            out += violations(value[k], known.get(k, more), f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{i}]")
    return [HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", x) for x in out] if at == "$" else out


def references(value) -> list[str]:
    """Identifiers of {"$ref": id} anywhere in a value."""
    if isinstance(value, dict):
        if set(value) == {"$ref"} and isinstance(value["$ref"], str):
            return [value["$ref"]]
        return [r for v in value.values() for r in references(v)]
    return [r for v in value for r in references(v)] if isinstance(value, list) else []


def _no_number(text: str):
    raise ValueError(f"no number: {text}")


def _number(text: str) -> float:
    return x if math.isfinite(x := float(text)) else _no_number(text)


def depth(text: str) -> int:
    """How deep brackets nest outside of strings."""
    level = most = 0
    for c in re.sub(r'"(?:[^"\\]|\\.)*"', "", text, flags=re.S):
        level += (c in "[{") - (c in "]}")
        most = max(most, level)
    return most


def parse_object(text: str | None) -> dict | None:
    """The JSON object of a text; None if it is none, too deep, or holds a number that is no finite double."""
    try:
        value = json.loads(text, parse_constant=_no_number, parse_float=_number) if text is not None and depth(text) <= MAX_DEPTH else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


MARKED = "conv_id bigint, turn bigint, text string, calls array<struct<call_id:string,name:string,arguments:string>>"


def marked_calls(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, text, calls) of the assistant's messages that speak of tool calls. ``calls`` is null unless the text
    is an object {"tool_calls": [{"id", "name", "arguments"}, ...]} with one call or more, which alone makes a call message.
    Arguments are an object or its text; a value is passed on as its own JSON, so a number that is no double stays an error."""

    def called(text: str) -> list[dict] | None:
        try:
            value = json.loads(text) if depth(text) <= 2 * MAX_DEPTH else None
        except (ValueError, RecursionError):
            return None
        found = value.get("tool_calls") if isinstance(value, dict) else None
        if not isinstance(found, list) or not found:
            return None
        out = []
        for call in found:
            call = call if isinstance(call, dict) else {}
            arguments = call.get("arguments")
            plain = [call.get(k) if isinstance(call.get(k), str) else None for k in ("id", "name")]
            plain = [x if x is None else HALF.sub("\ufffd", x) for x in plain]
            out.append({"call_id": plain[0], "name": plain[1], "arguments": HALF.sub("\ufffd", arguments) if isinstance(arguments, str) else None if arguments is None else json.dumps(arguments)})
        return out

    def run(batches: Iterator[pa.RecordBatch]):
        kind = pa.list_(pa.struct([(c, pa.string()) for c in ("call_id", "name", "arguments")]))
        for batch in batches:
            made = [called(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind)], names=["conv_id", "turn", "text", "calls"])

    said = messages.where("role = 'assistant' AND text LIKE '%tool_calls%'")
    return said.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "text").mapInArrow(run, MARKED)


def _calls(marked: DataFrame) -> DataFrame:
    """CALLS of the call messages among ``marked``."""
    each = marked.select("conv_id", "turn", F.explode("calls").alias("c"))
    return each.select("conv_id", "c.call_id", "turn", "c.name", "c.arguments")


def _replies(messages: DataFrame) -> DataFrame:
    """RESULTS of the tools' messages {"tool_call_id", "content"}."""
    reply = messages.where("role = 'tool'").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.from_json("text", "tool_call_id string, content string").alias("r"))
    return reply.select("conv_id", F.col("r.tool_call_id").alias("call_id"), "turn", F.col("r.content").alias("content"))


def extract(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of messages (conv_id, turn, role, text) in the usual chat form."""
    return _calls(marked_calls(messages)), _replies(messages)


def turns_as_calls(messages: DataFrame, name: str = "respond") -> tuple[DataFrame, DataFrame]:
    """Plain chats as calls and results: a user turn calls ``name`` with its prompt and, as history, the user turn two
    before; an assistant turn is the result of the turn before it. The identifier is the calling turn."""

    def ident(turn):
        return F.concat(F.lit("turn-"), turn.cast("string"))

    said = messages.where("role = 'user'")
    before = said.groupBy("conv_id", (F.col("turn") + 2).alias("turn")).agg(F.lit(True).alias("follows"))
    said = said.join(before, ["conv_id", "turn"], "left")
    history = F.when(F.col("follows"), F.struct(ident(F.col("turn") - 2).alias("$ref")))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), history.alias("history")))
    calls = said.select("conv_id", ident(F.col("turn")).alias("call_id"), "turn", F.lit(name).alias("name"), arguments.alias("arguments"))
    results = messages.where("role = 'assistant'").select("conv_id", ident(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def tool_table(spark: SparkSession, schemas: dict[str, dict] | DataFrame) -> DataFrame:
    """(name, schema as text) of a dict of schemas, or of a table of them."""
    if isinstance(schemas, DataFrame):
        return schemas.select("name", "schema")
    for schema in schemas.values():
        check_schema(schema)
    found = spark.createDataFrame([(k, json.dumps(v)) for k, v in schemas.items()], "name string, schema string")
    return F.broadcast(found) if len(schemas) <= MAX_TOOLS else found


def parse_calls(calls: DataFrame, schemas: dict[str, dict] | DataFrame) -> DataFrame:
    """``calls`` with args (canonical text or null), refs and errors."""

    def run(batches: Iterator[pa.RecordBatch]):
        @lru_cache(1024)
        def read(text):
            schema = json.loads(text)
            check_schema(schema)
            return schema

        for batch in batches:
            args, refs, errors = [], [], []
            for text, schema in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                value = parse_object(text)
                wrong = ["arguments: no JSON object"] if value is None else violations(value, read(schema)) if schema is not None else []
                args.append(None if value is None else canonical(value))
                refs.append(sorted({HALF.sub("\ufffd", r) for r in references(value)}) if value is not None else [])
                errors.append(wrong + (["unknown tool"] if schema is None else []))
            new = [pa.array(args, pa.string()), pa.array(refs, pa.list_(pa.string())), pa.array(errors, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *new], names=["conv_id", "call_id", "turn", "name", "args", "refs", "errors"])

    fields = "conv_id bigint, call_id string, turn bigint, name string, args string, refs array<string>, errors array<string>"
    named = calls.join(tool_table(calls.sparkSession, schemas), "name", "left")
    return named.select("conv_id", "call_id", "turn", "name", "arguments", "schema").mapInArrow(run, fields)


def _levels(edges: dict[str, list[str]]) -> dict[str, int | None]:
    """Longest path to each call over its references; None on or behind a cycle."""
    waits = {c: {r for r in refs if r in edges} for c, refs in edges.items()}
    users: dict[str, list[str]] = {}
    for c, refs in waits.items():
        for r in refs:
            users.setdefault(r, []).append(c)
    level = {c: 0 for c, refs in waits.items() if not refs}
    ready = list(level)
    for c in ready:
        for u in users.get(c, ()):
            waits[u].discard(c)
            if not waits[u]:
                level[u] = max(level[r] for r in edges[u] if r in edges) + 1
                ready.append(u)
    return {c: level.get(c) for c in edges}


def order(calls: DataFrame, max_calls: int = MAX_CALLS) -> DataFrame:
    """(conv_id, call_id, level) of calls with an identifier (conv_id, call_id, refs; each once)."""
    calls = calls.select("conv_id", "call_id", "refs")
    size = calls.groupBy("conv_id").agg(F.count("*").alias("n"))
    small = calls.join(size.where(F.col("n") <= max_calls), "conv_id").groupBy("conv_id").agg(F.collect_list(F.struct("call_id", "refs")).alias("calls"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = [(conv, c, x) for conv, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for c, x in _levels({f["call_id"]: f["refs"] for f in found}).items()]
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.string(), pa.int32()), strict=True)], names=["conv_id", "call_id", "level"])

    ordered = small.mapInArrow(run, "conv_id bigint, call_id string, level int")
    large = calls.join(size.where(F.col("n") > max_calls), "conv_id", "left_semi")
    return ordered if large.isEmpty() else ordered.unionByName(_order_by_rounds(cut(large, "calls")))


def _order_by_rounds(calls: DataFrame) -> DataFrame:
    """Levels by rounds: a call is settled once all calls that it refers to are. Chains of single references count as one step."""
    ends = ["conv_id", "call_id"]
    edges = calls.select(*ends, F.explode("refs").alias("ref"))
    edges = cut(edges.join(calls.select("conv_id", F.col("call_id").alias("ref")), ["conv_id", "ref"]).distinct(), "references")
    need = edges.groupBy(*ends).agg(F.count("*").alias("need"), F.min("ref").alias("ref"))
    node, key = calls.select(*ends, F.to_json(F.struct("conv_id", "call_id")).alias("node")), F.to_json(F.struct("conv_id", F.col("ref").alias("call_id")))
    parents = node.join(need.where("need = 1").withColumn("parent", key), ends, "left").select("node", "parent")
    anchored = node.join(pointer_roots(parents), "node").where("root IS NOT NULL").select(*ends, "node", F.col("root").alias("anchor"), F.col("dist").alias("steps"))
    anchored = cut(anchored, "anchors")  # calls whose chain runs into a cycle have none
    many = need.where("need > 1").select(*ends, "need")
    arcs = edges.join(many, ends).join(anchored.select("conv_id", F.col("call_id").alias("ref"), "anchor", "steps"), ["conv_id", "ref"])
    arcs = cut(arcs.join(node, ends).select("node", "need", "anchor", F.col("steps") + 1), "arcs").toDF("node", "need", "anchor", "steps")
    new = cut(node.join(need, ends, "left_anti").select("node", F.lit(0).cast("long").alias("level")), "levels")
    done, met = new, None
    while not new.isEmpty():
        step = arcs.join(new.withColumnRenamed("node", "anchor"), "anchor").select("node", "need", F.lit(1).cast("long").alias("met"), (F.col("level") + F.col("steps")).alias("top"))
        met = cut((step if met is None else met.unionByName(step)).groupBy("node", "need").agg(F.sum("met").alias("met"), F.max("top").alias("top")), "met")
        new = cut(met.where("met = need").select("node", F.col("top").alias("level")), "levels")
        met = met.where("met < need")
        done = done.unionByName(new)
    levels = anchored.join(cut(done, "levels").withColumnRenamed("node", "anchor"), "anchor").select(*ends, (F.col("level") + F.col("steps")).cast("int").alias("level"))
    return calls.select(*ends).join(levels, ends, "left")


def _first(rows: DataFrame, value: list[str]) -> DataFrame:
    """The earliest row of every identifier and how many there are; ties by the other columns. Partial sums, no window."""
    least = F.min(F.struct("turn", *value)).alias("x")
    return rows.where("call_id IS NOT NULL AND conv_id IS NOT NULL").groupBy("conv_id", "call_id").agg(least, F.count("*").alias("times")).select("conv_id", "call_id", "x.*", "times")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict] | DataFrame, max_calls: int = MAX_CALLS) -> DataFrame:
    """One row per call identifier, orphan result, and call or result without an identifier: conv_id, call_id, turn,
    result_turn, name, status, level, duplicates, errors, json (canonical text of linked calls)."""
    parsed = cut(parse_calls(calls, schemas), "calls")
    first = _first(parsed, ["name", "args", "refs", "errors"]).withColumnRenamed("times", "calls")
    levels = order(first, max_calls)
    answer = _first(results, ["content"]).select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content", F.col("times").alias("answers"))
    joined = first.join(levels, ["conv_id", "call_id"], "left").join(answer.hint("shuffle_hash"), ["conv_id", "call_id"], "full")
    called, answered = F.col("calls").isNotNull(), F.col("answers").isNotNull()
    status = F.when(called & answered, "linked").when(called, "missing_result").otherwise("orphan_result")
    extra = (F.coalesce("calls", F.lit(1)) + F.coalesce("answers", F.lit(1)) - 2).alias("duplicates")
    rows = joined.select("conv_id", "call_id", "turn", "result_turn", "name", "args", "content", status.alias("status"), "level", extra, "refs", "errors")
    lone = parsed.where("call_id IS NULL OR conv_id IS NULL").select("conv_id", "call_id", "turn", F.lit(None).cast("bigint").alias("result_turn"), "name", "args", F.lit(None).cast("string").alias("content"), F.lit("no_id").alias("status"), F.lit(None).cast("int").alias("level"), F.lit(0).cast("bigint").alias("duplicates"), "refs", "errors")
    silent = results.where("call_id IS NULL OR conv_id IS NULL").select("conv_id", "call_id", F.lit(None).cast("bigint").alias("turn"), F.col("turn").alias("result_turn"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("args"), "content", F.lit("no_id").alias("status"), F.lit(None).cast("int").alias("level"), F.lit(0).cast("bigint").alias("duplicates"), F.lit(None).cast("array<string>").alias("refs"), F.lit(None).cast("array<string>").alias("errors"))
    known = first.select("conv_id", F.col("call_id").alias("ref"))
    unknown = first.select("conv_id", "call_id", F.explode("refs").alias("ref")).join(known, ["conv_id", "ref"], "left_anti").groupBy("conv_id", "call_id").agg(F.array_sort(F.transform(F.collect_list("ref"), lambda r: F.concat(F.lit("unknown reference: "), r))).alias("lost"))
    rows = rows.join(unknown, ["conv_id", "call_id"], "left").withColumn("errors", F.concat(F.coalesce("errors", F.array().cast("array<string>")), F.coalesce("lost", F.array().cast("array<string>")))).drop("lost", "refs")
    return _serialise(rows.unionByName(lone.unionByName(silent).drop("refs")))


def _serialise(rows: DataFrame) -> DataFrame:
    """Canonical JSON of linked calls: arguments, id, name and result."""

    @F.pandas_udf("string")
    def text(status: pd.Series, args: pd.Series, call_id: pd.Series, name: pd.Series, content: pd.Series) -> pd.Series:
        def one(s, a, i, n, c):
            return None if s != "linked" else f'{{"arguments":{a or "null"},"id":{canonical(i)},"name":{canonical(n)},"result":{canonical(c)}}}'

        return pd.Series(map(one, status, args, call_id, name, content), dtype=object)

    return rows.withColumn("json", text("status", "args", "call_id", "name", "content")).drop("args", "content")


#: The tool that plain chat turns are calls of.
RESPOND = {"type": "object", "required": ["prompt"], "properties": {"prompt": {"type": "string"}, "history": {"type": "object", "required": ["$ref"], "properties": {"$ref": {"type": "string"}}, "additionalProperties": False}}, "additionalProperties": False}


def link_messages(messages: DataFrame) -> DataFrame:
    """``link`` of a conversations table (conv_id and turn are read as bigint): marked tool calls and, for the rest, turns as
    calls. Whether an assistant's message is a call message is decided once; what isn't stays a plain turn."""
    marked = cut(marked_calls(messages), "marked")
    rest = messages.where("role IS NULL OR role <> 'tool'").where("NOT coalesce(role = 'assistant' AND text LIKE '%tool_calls%', false)")
    said = rest.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    plain = said.unionByName(marked.where("calls IS NULL").select("conv_id", "turn", F.lit("assistant").alias("role"), "text"))
    calls, results = turns_as_calls(plain)
    return link(calls.unionByName(_calls(marked)), results.unionByName(_replies(messages)), {"respond": RESPOND})


#: ``link_messages`` in DuckDB, for a table of plain chats with one row a turn; errors joined by "; ".
SQL = """
WITH RECURSIVE said AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
calls AS (SELECT s.*, EXISTS (SELECT 1 FROM said p WHERE p.conv_id = s.conv_id AND p.turn = s.turn - 2) AS follows FROM said s),
levels AS (SELECT conv_id, turn, 0 AS level FROM calls WHERE NOT follows UNION ALL SELECT c.conv_id, c.turn, level + 1 FROM levels l JOIN calls c ON c.conv_id = l.conv_id AND c.turn = l.turn + 2),
answers AS (SELECT conv_id, turn - 1 AS turn, text AS content FROM conversations WHERE role = 'assistant')
SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, 'turn-' || coalesce(c.turn, a.turn) AS call_id, c.turn AS turn, a.turn + 1 AS result_turn, CASE WHEN c.turn IS NOT NULL THEN 'respond' END AS name,
  CASE WHEN a.turn IS NULL THEN 'missing_result' WHEN c.turn IS NULL THEN 'orphan_result' ELSE 'linked' END AS status, l.level AS level, CAST(0 AS BIGINT) AS duplicates, '' AS errors,
  CASE WHEN a.turn IS NOT NULL AND c.turn IS NOT NULL THEN '{"arguments":{' || CASE WHEN follows THEN '"history":{"$ref":"turn-' || (c.turn - 2) || '"},' ELSE '' END || '"prompt":' || CAST(to_json(c.text) AS VARCHAR) || '},"id":"turn-' || c.turn || '","name":"respond","result":' || CAST(to_json(a.content) AS VARCHAR) || '}' END AS json
FROM calls c FULL JOIN answers a ON a.conv_id = c.conv_id AND a.turn = c.turn LEFT JOIN levels l ON l.conv_id = c.conv_id AND l.turn = c.turn
"""
