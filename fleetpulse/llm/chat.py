"""Chat formatting: tool calls linked with their results, ordered, validated and written as canonical JSON.

Calls and results meet by (conversation, identifier) in a hash join. A call may name the call whose result it uses
(`after`); levels of that order come from pointer jumping over the calls, so a conversation of any length is spread
over tasks and takes a logarithmic number of rounds. Arguments are validated against the tool's schema (a subset of
JSON Schema) and each call becomes one line of canonical JSON: sorted keys, no blanks, UTF-8.

(level, turn) orders the calls of a conversation: a call comes behind the one it uses.

Edge cases: of calls or results that repeat an identifier in a conversation the first counts (smallest turn, then
content) and `copies` tells how many calls there are. The others are rows of kind `repeated_call` or `repeated_result`
with the status `repeated` and no level; equal ones are one row, whose `copies` tells how many they are. Of results
without a call all are orphans. A call without identifier or conversation is unanswered and has
level 0; a result without either, or without a call, is an orphan. An `after` that names no call is as good as none.
Calls on a cycle, or using one, have no level and the status `cycle`. Arguments that are no JSON object are invalid and
written as null; so are the arguments of unknown tools, if they can't be read. Numbers beyond double precision, NaN
and the like, lone surrogates, and values nested deeper than NESTED levels are no JSON here, as they can't be written
again as such. A schema with a keyword value that this subset doesn't have is refused before any row is read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import pick
from fleetpulse.session import materialize

TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "number": (int, float), "null": type(None)}


NESTED = 100


def plain(x: Any, levels: int = NESTED) -> Any:
    """A JSON value in which whole numbers have no fraction; ValueError if it is nested deeper than so many levels."""
    if isinstance(x, (dict, list)):
        if not levels:
            raise ValueError("nested too deep")
        return {k: plain(v, levels - 1) for k, v in x.items()} if isinstance(x, dict) else [plain(v, levels - 1) for v in x]
    return int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 2**53 else x


def canonical(value: Any) -> str:
    """JSON with sorted keys and without blanks; ValueError for numbers that JSON doesn't have."""
    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def parsed(text: str | None) -> Any:
    """The value of a JSON text, None if it isn't one or can't be written again."""
    if text is None:
        return None
    try:
        value = plain(json.loads(text, parse_constant=_refuse))
        canonical(value).encode()  # fails for numbers out of range and lone surrogates
    except (ValueError, RecursionError):
        return None
    return value


def check_schema(schema: dict) -> None:
    """ValueError if a schema, or one inside it, has a type that TYPES doesn't have."""
    if schema.get("type") is not None and schema["type"] not in TYPES:
        raise ValueError(f"unknown type {schema['type']!r}")
    for inner in [*schema.get("properties", {}).values(), *([schema["items"]] if "items" in schema else [])]:
        check_schema(inner)


def violation(value: Any, schema: dict, path: str = "") -> str | None:
    """The first way in which a value breaks its schema (in order of name); None if it fits."""
    kind = schema.get("type")
    where = path or "arguments"
    if kind and (not isinstance(value, TYPES[kind]) or (kind in ("integer", "number") and isinstance(value, bool))):
        return f"{where}: not {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{where}: not one of the values"
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if number and ("minimum" in schema and value < schema["minimum"] or "maximum" in schema and value > schema["maximum"]):
        return f"{where}: out of range"
    if kind == "array" and "items" in schema:
        return next((e for i, x in enumerate(value) if (e := violation(x, schema["items"], f"{where}[{i}]"))), None)
    if kind == "object":
        known = schema.get("properties", {})
        for name in sorted({*value, *schema.get("required", [])}):
            inner = f"{path}.{name}" if path else name
            if name not in value:
                return f"{inner}: missing"
            if name in known:
                if error := violation(value[name], known[name], inner):
                    return error
            elif not schema.get("additionalProperties", True):
                return f"{inner}: unknown"
    return None


def _levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level (null on a cycle) of calls that have both, by pointer jumping along `after`."""
    nodes = calls.select("conv_id", "call_id", "after")
    known = nodes.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("known"))
    state = nodes.join(known, ["conv_id", "after"], "left").select(
        "conv_id", "call_id", F.when(F.col("known"), F.col("after")).alias("up"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("level")
    )
    state = materialize(state, "chat-levels")
    left = state.filter("up IS NOT NULL").count()
    while left:
        above = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("over"), F.col("level").alias("more"))
        moved = state.join(above, ["conv_id", "up"], "left")
        state = materialize(
            moved.select("conv_id", "call_id", F.col("over").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "chat-levels"
        )
        rest = state.filter("up IS NOT NULL").count()
        if rest == left:  # whoever still points upwards does so for ever
            break
        left = rest
    return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """conv_id, turn, call_id, kind, level, status, valid, error, copies, json for every call, orphan and repeated result.

    calls: conv_id, turn, call_id, name, arguments (JSON), after (call_id or null). results: conv_id, turn, call_id, content.
    """
    for schema in schemas.values():
        check_schema(schema)
    calls = pick(calls, conv_id="conv_id", turn="turn", call_id="call_id", name="name", arguments="arguments", after="after")
    results = pick(results, conv_id="conv_id", turn="turn", call_id="call_id", content="content")
    whole = "conv_id IS NOT NULL AND call_id IS NOT NULL"
    first = calls.filter(whole).groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "name", "arguments", "after")).alias("c"), F.count("*").alias("copies")
    )
    first = materialize(first.select("conv_id", "call_id", "c.*", "copies"), "chat-calls")
    answers = results.filter(whole).groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n")
    )
    later_calls = _repeated(calls.filter(whole), first.filter("copies > 1"), ["turn", "name", "arguments", "after"])
    answered = answers.filter("n > 1").select("conv_id", "call_id", "r.*").join(first.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_semi")
    later_results = _repeated(results.filter(whole), answered, ["turn", "content"])
    answers = answers.select("conv_id", "call_id", F.col("r.turn").alias("answer_turn"), F.col("r.content").alias("content"), F.lit(True).alias("answered"))
    linked = first.join(answers, ["conv_id", "call_id"], "left").join(_levels(first), ["conv_id", "call_id"])
    linked = linked.withColumn("status", F.expr("CASE WHEN level IS NULL THEN 'cycle' WHEN answered THEN 'linked' ELSE 'unanswered' END"))
    alone = calls.filter(f"NOT ({whole})").withColumns(
        {"copies": F.lit(1).cast("long"), "level": F.lit(0).cast("long"), "status": F.lit("unanswered"), "content": F.lit(None).cast("string")}
    )
    columns = ["conv_id", "turn", "call_id", "name", "arguments", "content", "level", "status", "copies"]
    rows = linked.select(columns).unionByName(alone.select(columns)).withColumn("kind", F.lit("call"))
    orphans = results.join(first.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").select(
        "conv_id", "turn", "call_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), "content",
        F.lit(None).cast("long").alias("level"), F.lit("orphan").alias("status"), F.lit(0).cast("long").alias("copies"), F.lit("result").alias("kind"),
    )
    for later, kind in ((later_calls, "repeated_call"), (later_results, "repeated_result")):
        later = later.withColumns({"level": F.lit(None).cast("long"), "status": F.lit("repeated"), "kind": F.lit(kind)})
        missing = {c: F.lit(None).cast("string") for c in ("name", "arguments", "content") if c not in later.columns}
        orphans = orphans.unionByName(later.withColumns(missing).select(orphans.columns))
    return _written(rows.unionByName(orphans), schemas)


def _repeated(rows: DataFrame, first: DataFrame, values: list[str]) -> DataFrame:
    """conv_id, call_id, values, copies: the rows of the identifiers in first, but for first itself; equal ones as one."""
    keys = ["conv_id", "call_id"]
    first = first.select(*keys, F.struct(*values).alias("__first"))
    found = rows.join(first, keys).groupBy(*keys, *values, "__first").agg(F.count("*").alias("copies"))
    own = F.struct(*values).eqNullSafe(F.col("__first"))
    return found.withColumn("copies", F.col("copies") - F.when(own, 1).otherwise(0)).filter("copies > 0").select(*keys, *values, "copies")


def _written(rows: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    kept = ["conv_id", "turn", "call_id", "kind", "level", "status", "copies"]
    types = dict(rows.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in kept) + ", valid boolean, error string, json string"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, errors, lines = [], [], []
            for kind, call_id, name, arguments, content in zip(
                *[batch.column(c).to_pylist() for c in ("kind", "call_id", "name", "arguments", "content")], strict=True
            ):
                if kind in ("result", "repeated_result"):
                    valid.append(None)
                    errors.append(None)
                    lines.append(canonical({"content": content, "tool_call_id": call_id}))
                    continue
                given = parsed(arguments)
                error = "tool: unknown" if name not in schemas else violation(given, schemas[name])
                valid.append(error is None)
                errors.append(error)
                lines.append(canonical({"arguments": given, "id": call_id, "name": name, "result": content, "valid": error is None}))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(valid, pa.bool_()), pa.array(errors, pa.string()), pa.array(lines, pa.string())],
                [*kept, "valid", "error", "json"],
            )

    return rows.select(*kept, "name", "arguments", "content").mapInArrow(write, schema)


# Tools of the test view.
SCHEMAS = {
    "search": {
        "type": "object", "required": ["query", "limit"],
        "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}},
    },
    "measure": {
        "type": "object", "required": ["chars"], "additionalProperties": False,
        "properties": {"chars": {"type": "integer", "minimum": 0}, "unit": {"type": "string", "enum": ["char", "word"]}},
    },
    "translate": {"type": "object", "required": ["text", "target"], "properties": {"text": {"type": "string"}, "target": {"type": "string"}}},
}


def calls_of(conversations: DataFrame) -> DataFrame:
    """Test view: every assistant turn calls a tool about its text, mostly using the call two turns before."""
    rows = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text").filter("role = 'assistant'")
    rows = rows.selectExpr("conv_id", "turn", "coalesce(text, '') AS text", "length(coalesce(text, '')) AS n")
    return rows.selectExpr(
        "conv_id", "turn", "concat('call_', conv_id, '_', turn) AS call_id",
        "element_at(array('search', 'measure', 'translate'), cast(turn % 3 AS int) + 1) AS name",
        """CASE turn % 3 WHEN 0 THEN to_json(named_struct('query', text, 'limit', n % 60))
           WHEN 1 THEN to_json(named_struct('unit', element_at(array('word', 'char', 'page'), n % 3 + 1), 'chars', n))
           WHEN 2 THEN CASE WHEN n % 7 = 0 THEN to_json(named_struct('text', text)) ELSE to_json(named_struct('text', text, 'target', 'en')) END END AS arguments""",
        "CASE WHEN turn >= 2 AND n % 5 <> 0 THEN concat('call_', conv_id, '_', turn - 2) END AS after",
    )


def results_of(conversations: DataFrame) -> DataFrame:
    """Test view: every user turn but the opening one answers the call of the turn before."""
    rows = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text").filter("role = 'user' AND turn >= 1")
    return rows.selectExpr("conv_id", "turn", "concat('call_', conv_id, '_', turn - 1) AS call_id", "text AS content")


def report(conversations: DataFrame) -> DataFrame:
    return link_calls(calls_of(conversations), results_of(conversations), SCHEMAS)


ORACLE = r"""
WITH RECURSIVE a AS (SELECT conv_id, turn, 'call_' || conv_id || '_' || turn AS call_id, coalesce(text, '') AS text,
    length(coalesce(text, '')) AS n, turn % 3 AS k FROM conversations WHERE role = 'assistant'),
c AS (SELECT *, CASE WHEN turn >= 2 AND n % 5 <> 0 THEN 'call_' || conv_id || '_' || (turn - 2) END AS after,
  CASE WHEN k = 0 THEN '{"limit":' || (n % 60) || ',"query":' || to_json(text) || '}'
    WHEN k = 1 THEN '{"chars":' || n || ',"unit":"' || (['word', 'char', 'page'])[n % 3 + 1] || '"}'
    WHEN n % 7 = 0 THEN '{"text":' || to_json(text) || '}' ELSE '{"target":"en","text":' || to_json(text) || '}' END AS arguments,
  CASE WHEN k = 0 AND n % 60 NOT BETWEEN 1 AND 50 THEN 'limit: out of range' WHEN k = 1 AND n % 3 = 2 THEN 'unit: not one of the values'
    WHEN k = 2 AND n % 7 = 0 THEN 'target: missing' END AS error FROM a),
r AS (SELECT conv_id, turn, 'call_' || conv_id || '_' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'user' AND turn >= 1),
l AS (SELECT conv_id, call_id, 0 AS level FROM c WHERE after IS NULL OR after NOT IN (SELECT call_id FROM c)
  UNION ALL SELECT c.conv_id, c.call_id, l.level + 1 FROM c JOIN l ON c.after = l.call_id AND c.conv_id = l.conv_id)
SELECT c.conv_id, c.turn, c.call_id, 'call' AS kind, CAST(l.level AS BIGINT) AS level,
  CASE WHEN r.call_id IS NOT NULL THEN 'linked' ELSE 'unanswered' END AS status, CAST(1 AS BIGINT) AS copies, error IS NULL AS valid, error,
  '{"arguments":' || arguments || ',"id":"' || c.call_id || '","name":"' || (['search', 'measure', 'translate'])[k + 1] || '","result":'
    || coalesce(to_json(r.text), 'null') || ',"valid":' || CASE WHEN error IS NULL THEN 'true' ELSE 'false' END || '}' AS json
FROM c JOIN l USING (conv_id, call_id) LEFT JOIN r USING (conv_id, call_id)
UNION ALL
SELECT conv_id, turn, call_id, 'result', NULL, 'orphan', 0, NULL, NULL,
  '{"content":' || coalesce(to_json(text), 'null') || ',"tool_call_id":"' || call_id || '"}'
FROM r WHERE call_id NOT IN (SELECT call_id FROM c)
"""
