"""Tool-call linking for chat data: join calls with results, order them, validate arguments, serialise canonical JSON.

Calls and results are hash-joined by (conversation, identifier). A call's level is one more than the highest level of the
calls that it depends on, so ascending levels are a topological order. Calls with one dependency at most form trees,
whose depths come from pointer doubling (log of the depth rounds). What is left of the graph, the edges of calls with
several dependencies, is settled in one task a conversation where these are GROUP edges at most, so that no depth costs
rounds; a conversation with more of them, which may hold a third of all rows, is never gathered: it is settled round by
round, a level each, in which only the calls settled in the one before are joined.

Arguments are parsed and validated against the tool's schema (a subset of JSON Schema: type, required, properties, items,
enum, additionalProperties, minimum, maximum, minLength, maxLength; an unknown type is refused before any work). A call
is written as JSON with sorted keys and no spaces.

Defined cases: a null identifier or conversation links nothing (the row stays, with no result); of calls, or results,
that repeat an identifier in a conversation the one of the lowest turn counts (then the least text), and n_repeats says
how many others there are; a result without a call is a row of its own, not linked, with a null level; a dependency on an unknown call counts in n_missing and is otherwise ignored; calls on or behind a cycle have a
null level; arguments that are no JSON object make a call invalid, and are written as a JSON string where they are no
JSON at all, hold NaN or Infinity, or are nested too deep; lone surrogates are written escaped; a tool without a
schema makes its calls invalid; numbers are compared by value (1.0 is the integer 1) and are never equal to booleans; a
task holds one batch of texts, whatever their length; empty tables give no rows; other columns play no part.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.llm.common import Scratch, table

#: Edges of one conversation that a task may hold.
GROUP = 50_000
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def _kinds(schema: dict) -> list[str]:
    kind = schema.get("type", [])
    return [kind] if isinstance(kind, str) else list(kind)


def check_schema(schema: dict, at: str = "$") -> None:
    """Raises ValueError for a type that is not one of JSON's."""
    if unknown := [k for k in _kinds(schema) if k not in _TYPES]:
        raise ValueError(f"{at}: unknown type {unknown[0]!r}")
    for k, field in [*schema.get("properties", {}).items(), *([("items", schema["items"])] if "items" in schema else [])]:
        check_schema(field, f"{at}.{k}")


def _is_kind(value: object, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    return isinstance(value, _TYPES[kind]) or (kind == "integer" and isinstance(value, float) and value.is_integer())


def _same(a: object, b: object) -> bool:
    """Equality of JSON values: booleans are no numbers, numbers are equal by value."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(v, b[k]) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return a == b


def schema_errors(value: object, schema: dict, at: str = "$") -> list[str]:
    """What in `value` breaks `schema`, in document order."""
    kinds = _kinds(schema)
    if kinds and not any(_is_kind(value, k) for k in kinds):
        return [f"{at}: not of type {' or '.join(kinds)}"]
    found = [f"{at}: not one of the listed values"] if "enum" in schema and not any(_same(value, x) for x in schema["enum"]) else []
    if isinstance(value, (int, float)) and not isinstance(value, bool) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        found.append(f"{at}: out of range")
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        found.append(f"{at}: length out of range")
    if isinstance(value, dict):
        fields = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in fields:
                found += schema_errors(value[k], fields[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += schema_errors(x, schema["items"], f"{at}[{i}]")
    return found


_SURROGATE = re.compile("[\ud800-\udfff]")


def canonical(value: object) -> str:
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _refuse(name: str) -> None:
    raise ValueError(name)


def _checked(name: str, arguments: str | None, schemas: dict[str, dict]) -> tuple[object, list[str]]:
    """The arguments, parsed where that is possible, and what is wrong with them."""
    try:
        value = json.loads(arguments or "", parse_constant=_refuse)
        wrong = schema_errors(value, schemas[name] | {"type": "object"}) if name in schemas else ["$: unknown tool"]
        canonical(value)
    except RecursionError:
        return arguments, ["$: nested too deep"]
    except ValueError:  # also a number that is no finite double
        return arguments, ["$: not JSON"]
    return value, wrong


def _written(schemas: dict[str, dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            linked = []
            for is_call, call_id, name, arguments, result in zip(*(b.column(c).to_pylist() for c in ("is_call", "call_id", "name", "arguments", "result")), strict=True):
                if is_call:
                    value, wrong = _checked(name, arguments, schemas)
                    texts.append(canonical({"arguments": value, "id": call_id, "name": name, "result": result}))
                else:
                    wrong = ["$: result without a call"]
                    texts.append(canonical({"id": call_id, "result": result}))
                errors.append(_SURROGATE.sub("?", "; ".join(wrong)))
                linked.append(is_call and result is not None)
            keep = [b.column(c) for c in ("conv_id", "call_id", "turn", "level", "n_missing", "n_repeats")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(linked, pa.bool_()), pa.array(errors, pa.string()), pa.array(texts, pa.string())], ["conv_id", "call_id", "turn", "level", "n_missing", "n_repeats", "linked", "errors", "json"])

    return run


def _first(rows: DataFrame, *tie: str) -> DataFrame:
    """One row of each (conv_id, call_id): the least (turn, tie...), and `repeats`, how many others there are."""
    named = rows.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    order = F.struct("turn", *tie, *[c for c in rows.columns if c not in ("conv_id", "call_id", "turn", *tie)])
    return named.groupBy("conv_id", "call_id").agg(F.min(order).alias("first"), (F.count("*") - 1).alias("repeats")).select("conv_id", "call_id", "first.*", "repeats")


def _settle(edges: pd.DataFrame) -> pd.DataFrame:
    """One conversation's edges (conv_id, head, dep_head, dist): the levels of the heads that are on or behind no cycle. A dep_head that is no head has no dependencies; a null one is behind a cycle."""
    waits: dict[str, int] = {}
    leads: dict[str, list[tuple[str, int]]] = {}
    for head, dep, dist in edges[["head", "dep_head", "dist"]].itertuples(index=False, name=None):
        waits[head] = waits.get(head, 0) + 1
        if isinstance(dep, str):
            leads.setdefault(dep, []).append((head, int(dist)))
    level, out = dict.fromkeys(leads, 0), []
    ready = [dep for dep in leads if dep not in waits]
    while ready:
        dep = ready.pop()
        for head, dist in leads.get(dep, ()):
            level[head] = max(level.get(head, 0), level[dep] + dist + 1)
            waits[head] -= 1
            if not waits[head]:
                out.append(head)
                ready.append(head)
    return pd.DataFrame({"conv_id": edges["conv_id"].iloc[0], "head": out, "level": [level[h] for h in out]}, columns=["conv_id", "head", "level"])


def levels(calls: DataFrame, scratch: Scratch, group: int = GROUP) -> DataFrame:
    """calls: (conv_id, call_id, depends_on), unique. (conv_id, call_id, level, n_missing): level 0 has no dependencies. group: see GROUP."""
    nodes = calls.select("conv_id", "call_id")
    edges = calls.select("conv_id", "call_id", F.explode(F.array_distinct(F.filter("depends_on", lambda d: d.isNotNull()))).alias("dep"))
    known = edges.join(nodes.select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("known")), ["conv_id", "dep"], "left")
    known = scratch.write(known, "edges")
    degree = known.groupBy("conv_id", "call_id").agg(F.count_if("known").alias("n"), F.count_if(F.col("known").isNull()).alias("n_missing"), F.max(F.when(F.col("known"), F.col("dep"))).alias("dep"))
    degree = scratch.write(nodes.join(degree, ["conv_id", "call_id"], "left").fillna(0, ["n", "n_missing"]), "degree")
    # Trees: jump to the nearest ancestor that has not exactly one dependency.
    single = F.col("n") == 1
    up = degree.select("conv_id", "call_id", F.when(single, F.col("dep")).otherwise(F.col("call_id")).alias("head"), F.when(single, 1).otherwise(0).cast("long").alias("dist"), single.alias("open"))
    up, rounds, limit = scratch.write(up, "up-0"), 0, max(1, degree.count()).bit_length() + 1
    while rounds < limit and up.where("open").limit(1).count():
        rounds += 1
        ahead = up.select("conv_id", F.col("call_id").alias("head"), F.col("head").alias("head_2"), F.col("dist").alias("dist_2"), F.col("open").alias("open_2"))
        moved = up.join(ahead, ["conv_id", "head"])
        up = scratch.write(moved.select("conv_id", "call_id", F.col("head_2").alias("head"), (F.col("dist") + F.col("dist_2")).alias("dist"), F.col("open_2").alias("open")), f"up-{rounds}")
        scratch.remove(f"up-{rounds - 1}")
    # Heads: no dependencies, or several. Calls still open are on or behind a cycle.
    settled = up.where("not open").select("conv_id", "call_id", "head", "dist")
    done = scratch.write(degree.where("n = 0").select("conv_id", F.col("call_id").alias("head"), F.lit(0).cast("long").alias("level")), "done-0")
    many = degree.where("n > 1").select("conv_id", "call_id", "n")
    wide = known.where("known").join(many, ["conv_id", "call_id"]).join(settled.select("conv_id", F.col("call_id").alias("dep"), F.col("head").alias("dep_head"), "dist"), ["conv_id", "dep"], "left")
    wide, rounds = scratch.write(wide.select("conv_id", F.col("call_id").alias("head"), "dep_head", "dist"), "wide"), 0
    # Few edges: one task a conversation.
    few = scratch.write(wide.groupBy("conv_id").agg(F.count("*").alias("edges")).where(F.col("edges") <= group).select("conv_id"), "few")
    scratch.write(wide.join(few, "conv_id", "left_semi").groupBy("conv_id").applyInPandas(_settle, "conv_id long, head string, level long"), "settled-few")
    scratch.write(done, "settled-0")
    # Many: what each unsettled head has met so far; a round joins only the heads that the one before has settled.
    wide = scratch.write(wide.join(few, "conv_id", "left_anti"), "wide-many")
    waiting = many.join(few, "conv_id", "left_anti").select("conv_id", F.col("call_id").alias("head"), "n", F.lit(0).cast("long").alias("met"), F.lit(0).cast("long").alias("level"))
    settled_now = done
    while not wide.isEmpty():
        rounds += 1
        hits = wide.join(settled_now.select("conv_id", F.col("head").alias("dep_head"), "level"), ["conv_id", "dep_head"])
        hits = hits.groupBy("conv_id", "head").agg(F.count("*").alias("more"), (F.max(F.col("level") + F.col("dist")) + 1).alias("high"))
        met = waiting.join(hits, ["conv_id", "head"], "left").select("conv_id", "head", "n", (F.col("met") + F.coalesce("more", F.lit(0))).alias("met"), F.greatest("level", F.coalesce("high", F.lit(0))).alias("level"))
        met = scratch.write(met, f"met-{rounds}")
        if rounds > 1:
            scratch.remove(f"met-{rounds - 1}")
        settled_now, waiting = scratch.write(met.where("met = n").select("conv_id", "head", "level"), f"settled-{rounds}"), met.where("met < n")
        if settled_now.isEmpty():
            break
    done = calls.sparkSession.read.schema(done.schema).parquet(f"{scratch.path}/settled-*")
    placed = settled.join(done, ["conv_id", "head"]).select("conv_id", "call_id", (F.col("level") + F.col("dist")).alias("level"))
    return degree.select("conv_id", "call_id", "n_missing").join(placed, ["conv_id", "call_id"], "left")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """calls: (conv_id, call_id, turn, name, arguments, depends_on); results: (conv_id, call_id, turn, content).

    (conv_id, call_id, turn, level, n_missing, n_repeats, linked, errors, json): `errors` is empty for valid arguments.
    """
    for name, schema in schemas.items():
        check_schema(schema, name)
    scratch = Scratch(calls.sparkSession, "tool-calls")
    calls = calls.select("conv_id", "call_id", "turn", "name", "arguments", "depends_on")
    results = results.select("conv_id", "call_id", "turn", "content")
    kept = scratch.write(_first(calls, "name", "arguments"), "calls")
    found = _first(results, "content").select("conv_id", "call_id", F.col("turn").alias("result_turn"), F.coalesce("content", F.lit("")).alias("result"), F.col("repeats").alias("result_repeats"))
    found = scratch.write(found, "results")
    placed = kept.join(levels(kept, scratch), ["conv_id", "call_id"])
    none, text, zero = F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(0).cast("long")
    # A full join: what has no call is a result alone.
    is_call = F.col("is_call").isNotNull()
    linked = placed.withColumn("is_call", F.lit(True)).join(found, ["conv_id", "call_id"], "full")
    linked = linked.select("conv_id", "call_id", F.coalesce("turn", "result_turn").alias("turn"), "level", "n_missing", (F.coalesce("repeats", zero) + F.coalesce("result_repeats", zero)).alias("n_repeats"), is_call.alias("is_call"), "name", "arguments", "result")
    unnamed = F.col("conv_id").isNull() | F.col("call_id").isNull()
    rest = calls.where(unnamed).select("conv_id", "call_id", "turn", zero.alias("level"), zero.alias("n_missing"), zero.alias("n_repeats"), F.lit(True).alias("is_call"), "name", "arguments", text.alias("result"))
    alone = results.where(unnamed).select("conv_id", "call_id", "turn", none.alias("level"), none.alias("n_missing"), zero.alias("n_repeats"), F.lit(False).alias("is_call"), text.alias("name"), text.alias("arguments"), F.coalesce("content", F.lit("")).alias("result"))
    whole = linked.unionByName(rest).unionByName(alone)
    return whole.mapInArrow(_written(schemas), "conv_id long, call_id string, turn long, level long, n_missing long, n_repeats long, linked boolean, errors string, json string")


#: The tool that stands for a turn of plain chat; turns that are longer or shorter make their calls invalid.
TURN_SCHEMAS = {"reply": {"required": ["n_chars", "text"], "properties": {"n_chars": {"type": "integer", "maximum": 350}, "text": {"type": "string", "minLength": 20}}, "additionalProperties": False}}


def calls_of_turns(chat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain chat (conv_id, turn, role, text) as calls and results: a user turn t calls `reply` under the identifier t<t>, after the call of turn t - 2; the assistant turn t + 1 is its result."""
    rows = chat.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))

    def named(turn: Column) -> Column:
        return F.concat(F.lit("t"), turn.cast("string"))

    arguments = F.to_json(F.struct(F.length("text").alias("n_chars"), "text"))
    calls = rows.where("role = 'user'").select("conv_id", named(F.col("turn")).alias("call_id"), "turn", F.lit("reply").alias("name"), arguments.alias("arguments"), F.array(named(F.col("turn") - 2)).alias("depends_on"))
    results = rows.where("role = 'assistant'").select("conv_id", named(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = calls_of_turns(table(spark, sf_dir, "conversations"))
    found = link_calls(calls, results, TURN_SCHEMAS)
    return found.select("conv_id", "call_id", "level", "n_missing", "n_repeats", "linked", (F.col("errors") == "").alias("valid"), F.sha2("json", 256).alias("json_sha256"))


SQL = """
WITH rows AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, count(*) OVER k - 1 AS repeats, row_number() OVER (k ORDER BY text) AS nth
  FROM conversations WINDOW k AS (PARTITION BY conv_id, turn, role)),
u AS (SELECT conv_id, turn, text, repeats, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM rows WHERE role = 'user' AND nth = 1),
a AS (SELECT conv_id, turn - 1 AS turn, text AS result, repeats FROM rows WHERE role = 'assistant' AND nth = 1),
c AS (SELECT u.*, row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS level FROM u)
SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, 't' || coalesce(c.turn, a.turn) AS call_id, level,
       CAST(CASE WHEN level = 0 THEN 1 WHEN level > 0 THEN 0 END AS BIGINT) AS n_missing,
       CAST(coalesce(c.repeats, 0) + coalesce(a.repeats, 0) AS BIGINT) AS n_repeats,
       c.text IS NOT NULL AND a.result IS NOT NULL AS linked, coalesce(length(c.text) BETWEEN 20 AND 350, false) AS valid,
       sha256(CASE WHEN c.text IS NULL THEN '{"id":"t' || a.turn || '","result":' || CAST(to_json(a.result) AS VARCHAR) || '}'
         ELSE '{"arguments":' || CAST(json_object('n_chars', length(c.text), 'text', c.text) AS VARCHAR) || ',"id":"t' || c.turn
         || '","name":"reply","result":' || coalesce(CAST(to_json(a.result) AS VARCHAR), 'null') || '}' END) AS json_sha256
FROM c FULL JOIN a ON c.conv_id = a.conv_id AND c.turn = a.turn
"""
