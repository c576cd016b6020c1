"""Session logs: one JSONL file is one ordered trace. A file is read whole by one task, so no shuffle groups its lines."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..batches import frames
from ..functions import values as V
from ..functions.traces import convert_file, convert_single, is_structured, stored_row, structured_row
from ..schema import TRAIN_ROW

SKIPPED = r"/(partials|failures)/"


def trace_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, text) of every JSONL file under a folder, but those in folders of partial or failed runs."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text")).where(~F.col("source_file").rlike(SKIPPED))


def scan_events(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, line_no, raw): lines that aren't blank, numbered from 1."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")), lambda x: x != "")
    return trace_files(spark, path).select("source_file", F.posexplode(lines).alias("pos", "raw")).select("source_file", (F.col("pos") + 1).alias("line_no"), "raw")


def parse(text: str, skip_invalid: bool, name: str = "") -> list:
    out = []
    for n, line in enumerate((x.strip() for x in text.split("\n")), 1):
        if line:
            try:
                out.append(json.loads(line))
            except ValueError as e:
                if not skip_invalid:
                    raise ValueError(f"{name}: line {n} is not JSON") from e
    return out


def _sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(key, side) of settings and metadata files: what lies beside ``x.jsonl`` as ``x.settings.json`` or ``x.metadata.json``."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{settings,metadata}.json").text(path, wholetext=True)
    key = F.regexp_replace(F.col("_metadata.file_path"), r"\.(settings|metadata)\.json$", "")
    return df.select(key.alias("key"), "value").groupBy("key").agg(F.min("value").alias("side"))


_COLUMNS = ["source_file", "source_line", "trace_type", "prompt", "system", "messages", "tools", "metadata", "category"]


def _stem(name: str) -> str:
    return unquote(name).rsplit("/", 1)[-1].removesuffix(".jsonl")


def convert_traces(spark: SparkSession, path: str, *, skip_invalid_lines: bool = False) -> DataFrame:
    """Training rows of all traces under ``path``; of a file of structured rows each line is one. The format is found by file.

    A file is read whole by one task. Sidecars meet their trace by file stem; one that is no JSON object counts as absent.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames(batches):
            rows = []
            for name, text, side in zip(pdf["source_file"], pdf["text"], pdf["side"]):
                for n, row in convert_file(parse(text, skip_invalid_lines, name), _stem(name), _object(side)):
                    rows.append(stored_row(row) | {"source_file": name, "source_line": n})
            yield pd.DataFrame(rows, columns=_COLUMNS)

    files = trace_files(spark, path)
    files = files.withColumn("key", F.regexp_replace("source_file", r"\.jsonl$", "")).join(_sidecars(spark, path), "key", "left").select("source_file", "text", "side")
    return files.mapInPandas(run, TRAIN_ROW)


def _object(text: str | None) -> dict:
    try:
        value = json.loads(text) if text else {}
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def convert_texts(files: DataFrame, *, skip_invalid_lines: bool = False) -> DataFrame:
    """The same for a table (source_file, text) that holds the files' texts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames(batches):
            rows = [
                stored_row(row) | {"source_file": name, "source_line": n}
                for name, text in zip(pdf["source_file"], pdf["text"]) for n, row in convert_file(parse(text, skip_invalid_lines, name), _stem(name))
            ]
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return files.select("source_file", "text").mapInPandas(run, TRAIN_ROW)


def convert_rows(spark: SparkSession, path: str, *, skip_invalid_lines: bool = False) -> DataFrame:
    """The same for files that hold training rows only, split by line, so that one large file is many tasks' work. ``source_line`` is null, as a line's number isn't known."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames(batches):
            rows = []
            for name, line in zip(pdf["source_file"], pdf["value"]):
                for e in parse(line, skip_invalid_lines, name):
                    if not is_structured(e):
                        if skip_invalid_lines:
                            continue
                        raise ValueError(f"{name}: a line that is no training row")
                    rows.append(stored_row(structured_row(e, _stem(name), None)) | {"source_file": name, "source_line": None})
            yield pd.DataFrame(rows, columns=_COLUMNS)

    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path).select(F.col("_metadata.file_path").alias("source_file"), "value")
    return lines.where(~F.col("source_file").rlike(SKIPPED)).mapInPandas(run, TRAIN_ROW)


def convert_trace(spark: SparkSession, path: str) -> dict:
    """The row of one file, on the driver; a file of several structured rows is an error."""
    text = spark.read.text(path, wholetext=True).first()
    return convert_single(parse(text[0] if text else "", False, path), _stem(path))


def split_folder(spark: SparkSession, path: str, split: str | None) -> str:
    """``path/split`` if there is such a folder, else ``path``."""
    if not split:
        return path
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{split}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return at.toString() if fs.exists(at) and fs.getFileStatus(at).isDirectory() else path


def tool_snapshot(spark: SparkSession, path: str) -> list[dict]:
    """Tools that a dataset lists for all rows: the JSON fence of its README after a summary of tools, else the first tools.json by path."""
    def texts(pattern: str) -> list[str]:
        df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
        return [r[0] for r in df.orderBy(F.length(F.regexp_replace("_metadata.file_path", "[^/]", "")), "_metadata.file_path").select("value").take(1)]

    for text in texts("README.md"):
        fence = re.search(r"(?s)<summary>[^<]*tools[^<]*</summary>.*?```json\s*\n(.*?)\n```", text, re.IGNORECASE)
        if fence and (found := [t for t in map(V.tool_entry, _list(fence[1])) if t]):
            return found
    return next(([t for t in map(V.tool_entry, _list(x)) if t] for x in texts("tools.json") if _list(x)), [])


def _list(text: str) -> list:
    try:
        value = json.loads(text)
    except ValueError:
        return []
    return value if isinstance(value, list) else V.obj(value).get("tools") or []


def with_snapshot(rows: DataFrame, tools: list[dict]) -> DataFrame:
    """Rows without tools get those of the dataset."""
    if not tools:
        return rows
    kind = rows.schema["tools"].dataType.simpleString()
    stored = stored_row({"tools": tools, "messages": [], "metadata": {}, "prompt": "", "system": None})["tools"]
    given = F.from_json(F.lit(json.dumps(stored)), kind)
    return rows.withColumn("tools", F.when(F.size(F.coalesce("tools", F.array().cast(kind))) > 0, F.col("tools")).otherwise(given))


def load_traces(spark: SparkSession, path: str, *, split: str | None = "train", drop_incomplete: bool = True, max_examples: int | None = None, seed: int = 3407) -> DataFrame:
    """Converted rows with a training signal, complete ones only unless told otherwise, and a seeded sample if ``max_examples`` is given.

    Rows without tools get those of the dataset's snapshot. ``path/split`` is read where it exists.
    """
    rows = with_snapshot(convert_traces(spark, split_folder(spark, path, split)), tool_snapshot(spark, path))
    return sample(trainable(rows, drop_incomplete), max_examples, seed)


def sample(rows: DataFrame, max_examples: int | None, seed: int = 3407) -> DataFrame:
    """The first rows in a seeded order; all without a number."""
    return rows if max_examples is None else rows.orderBy(F.xxhash64(F.lit(seed), "source_file", "source_line"), "source_file", "source_line").limit(max_examples)


def trainable(rows: DataFrame, drop_incomplete: bool = True) -> DataFrame:
    """Rows with an answer of text, reasoning or calls, and not ending in a tool's result."""
    answers = F.filter("messages", lambda m: m["role"].isin("assistant", "model", "tool"))
    signal = F.exists("messages", lambda m: (m["role"] == "assistant") & ((F.trim(F.coalesce(m["content"], F.lit(""))) != "") | (F.coalesce(m["reasoning_content"], F.lit("")) != "") | (F.size(F.coalesce(m["tool_calls"], F.array().cast("array<struct<id:string,type:string,name:string,arguments:string>>"))) > 0)))
    rows = rows.where(signal)
    if drop_incomplete:
        rows = rows.where(F.coalesce(F.try_element_at(answers, F.lit(-1))["role"] != "tool", F.lit(False)))
    return rows


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(prompt, system, follow_up_prompts) of a csv, jsonl, ndjson, json or text file; blank prompts are left out."""
    kind = path.rsplit(".", 1)[-1].lower()
    schema = "prompt string, system string, follow_up_prompts array<string>"
    if kind == "csv":
        df = spark.read.option("header", True).option("multiLine", True).option("mode", "FAILFAST").option("escape", '"').csv(path)
        names = [c.lstrip("﻿").strip().lower() for c in df.columns]
        if "prompt" not in names or len(set(names)) < len(names):
            raise ValueError("a prompt file has one column of each name, and one named prompt")
        df = df.toDF(*names)
        out = df.select("prompt", F.col("system") if "system" in names else F.lit(None).cast("string").alias("system"), F.array().cast("array<string>").alias("follow_up_prompts"))
    elif kind in ("jsonl", "ndjson"):
        out = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    elif kind == "json":
        out = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    else:
        lines = spark.read.text(path).where(~F.col("value").startswith("#"))
        out = lines.select(F.col("value").alias("prompt"), F.lit(None).cast("string").alias("system"), F.array().cast("array<string>").alias("follow_up_prompts"))
    return out.withColumn("prompt", F.trim("prompt")).where("prompt <> ''")


def write_rows(rows: DataFrame, path: str) -> None:
    """Training rows as compact JSONL whose lines no reader splits further."""
    from ..functions.text import escape_line_breaks

    rows.select(escape_line_breaks(F.to_json(F.struct("*"))).alias("value")).write.text(path)


def escape_line_breaks_of(spark: SparkSession, value: str) -> str:
    """One text as ``write_rows`` would escape it."""
    from ..functions.text import escape_line_breaks

    return spark.range(1).select(escape_line_breaks(F.lit(value))).first()[0]
