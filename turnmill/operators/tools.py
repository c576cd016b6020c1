"""Tool calls: validation, schema inference, and the policy for undeclared tools."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..batches import pieces
from ..functions.jsonschema import infer_parameters, json_type, merge, merge_types, validate


def observed_keys(calls: DataFrame, tool_col: str, args_col: str) -> DataFrame:
    """(tool, key, calls, seen, required, types): the flat level of a schema, in one aggregate without Python."""
    n = calls.groupBy(F.col(tool_col).alias("tool")).agg(F.count("*").alias("calls"))

    v = calls.select(F.col(tool_col).alias("tool"), F.try_parse_json(args_col).alias("v"))
    keys = calls.sparkSession.sql("SELECT tool, e.key AS key, schema_of_variant(e.value) AS kind FROM {v} AS c, LATERAL variant_explode(c.v) e", v=v)
    kind = F.when(F.col("kind") == "BIGINT", "integer").when(F.col("kind").startswith("DECIMAL") | (F.col("kind") == "DOUBLE"), "number").when(F.col("kind") == "STRING", "string").when(F.col("kind") == "BOOLEAN", "boolean").when(F.col("kind") == "VOID", "null").when(F.col("kind").startswith("ARRAY"), "array").otherwise("object")
    per = keys.groupBy("tool", "key").agg(F.count("*").alias("seen"), F.array_join(F.sort_array(F.collect_set(kind)), ",").alias("types"))
    return per.join(F.broadcast(n), "tool").select("tool", "key", "calls", "seen", (F.col("seen") == F.col("calls")).alias("required"), "types")  # a row a tool


def infer_tool_schemas(calls: DataFrame, tool_col: str = "name", args_col: str = "arguments", dialect: str = "anyOf", parts: int = 64) -> DataFrame:
    """(tool, parameters): nested schemas, as JSON, from every call.

    Distinct arguments meet first, so that repeated calls count once. They are
    inferred in ``parts`` by hash and merged then, so that no task sees all
    arguments of one tool; a call whose arguments are no object doesn't count.
    """
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        samples = []
        for a in sorted(pdf["a"]):
            try:
                value = json.loads(a)
            except ValueError:
                continue
            if isinstance(value, dict):
                samples.append(value)
        out = (_types(samples) if dialect == "types" else infer_parameters(samples)) if samples else None
        return pd.DataFrame({"tool": [key[0]], "s": [None if out is None else json.dumps(out, sort_keys=True)]})

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = [json.loads(x) for x in sorted(x for x in pdf["s"] if x)]
        out = functools.reduce(merge_types if dialect == "types" else merge, found) if found else infer_parameters([])
        return pd.DataFrame({"tool": [key[0]], "parameters": [json.dumps(out, sort_keys=True)]})

    each = calls.select(F.col(tool_col).alias("tool"), F.col(args_col).alias("a")).where("tool is not null and a is not null").distinct()
    part = F.pmod(F.xxhash64("a"), F.lit(parts)).alias("part")
    return each.select("tool", "a", part).groupBy("tool", "part").applyInPandas(run, "tool string, s string").groupBy("tool").applyInPandas(join, "tool string, parameters string")


def _types(samples: list) -> dict:
    def of(v):
        kind = json_type(v)
        return {"type": kind, "properties": {k: of(x) for k, x in v.items()}} if kind == "object" else {"type": kind}

    out = {"type": "object", "properties": {}}
    for s in samples:
        if isinstance(s, dict):
            out = merge_types(out, of(s))
    return out


def _known(tools: Iterable | None) -> dict:
    return {t["name"]: t["parameters"] for t in (tools if tools is not None else [])}


def _call_errors(n: str | None, a: str | None, known: dict) -> list[str]:
    if not n:
        return ["call without a name"]
    if n not in known:
        return [f"{n}: not declared"]
    try:
        value = json.loads(a) if a else {}
    except ValueError:
        value = None
    if not isinstance(value, dict):
        return [f"{n}: arguments are not a JSON object"]
    return validate(value, json.loads(known[n] or "{}"), f"{n}.arguments")


def argument_errors(name: pd.Series, arguments: pd.Series, tools: pd.Series) -> pd.Series:
    """Errors of each call against ARRAY<STRUCT<name, parameters>>; names and JSON are checked before the schema."""
    return pd.Series([_call_errors(n, a, _known(ts)) for n, a, ts in zip(name, arguments, tools)])


def _row_errors(calls: pa.Array, tools: pa.Array) -> pa.Array:
    out = []
    for b in pieces(pa.RecordBatch.from_arrays([calls, tools], ["calls", "tools"])):
        for cs, ts in zip(*[c.to_pylist() for c in b.columns]):
            known = _known(ts)
            out.append([e for c in cs or [] if c is not None for e in _call_errors(c["name"], c["arguments"], known)])
    return pa.array(out, pa.list_(pa.string()))


def validate_tool_calls(rows: DataFrame) -> DataFrame:
    """(all columns, errors) of training rows with ``messages`` and ``tools``; errors in the order of the calls. No shuffle: a row's calls are checked where it is."""
    calls = F.flatten(F.transform("messages", lambda m: F.coalesce(m["tool_calls"], F.array().cast("array<struct<id:string,type:string,name:string,arguments:string>>"))))
    known = F.transform("tools", lambda t: F.struct(t["name"].alias("name"), t["parameters"].alias("parameters")))
    made = F.arrow_udf(_row_errors, "array<string>").asNondeterministic()  # evaluated once
    return rows.withColumn("errors", made(calls, known))


def apply_unsupported_tool_policy(rows: DataFrame) -> DataFrame:
    """Rows cut before the user turn that led to an undeclared tool; ``unsupported_tool`` names it, and a row left without an answer goes."""
    names = F.transform("tools", lambda t: t["name"])
    bad = F.transform("messages", lambda m: F.get(F.filter(F.transform(F.coalesce(m["tool_calls"], F.array().cast("array<struct<id:string,type:string,name:string,arguments:string>>")), lambda c: c["name"]), lambda n: ~F.array_contains(names, n)), F.lit(0)))
    at = F.array_position(F.transform(bad, lambda b: b.isNotNull()), F.lit(True)).cast("int")
    out = rows.withColumn("__bad", bad).withColumn("__at", at)
    users = F.filter(F.sequence(F.lit(1), F.greatest(F.col("__at"), F.lit(1))), lambda i: F.element_at(F.col("messages"), i)["role"] == "user")
    cut = F.when(F.col("__at") == 0, F.col("messages")).otherwise(F.slice("messages", 1, F.greatest(F.coalesce(F.element_at(users, -1), F.lit(1)) - 1, F.lit(0))))
    out = out.withColumn("unsupported_tool", F.when(F.col("__at") > 0, F.element_at("__bad", F.greatest(F.col("__at"), F.lit(1))))).withColumn("messages", cut)
    return out.where((F.col("__at") == 0) | F.exists("messages", lambda m: m["role"] == "assistant")).drop("__bad", "__at")
