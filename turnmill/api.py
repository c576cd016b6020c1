"""The names most users need, in one place."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.templates import RENDERERS, Headers, Jinja, Qwen, Turns  # noqa: F401
from .functions.traces import convert_single, detect  # noqa: F401
from .operators.prepare import Settings, audit_labels, prepare, prepare_mix, prepared, preview, report_rows, report_totals  # noqa: F401
from .operators.render import CharTokenizer, FastTokenizer, WordTokenizer, mask  # noqa: F401
from .operators.tools import validate_tool_calls  # noqa: F401
from .sources.extract import anonymize_folder, default_stores, extract  # noqa: F401
from .sources.jsonl import convert_trace, convert_traces, load_traces, write_rows  # noqa: F401


def prepare_data(spark: SparkSession, source: Any, settings: Settings | None = None, *, split: str | None = "train", max_examples: int | None = None, drop_incomplete: bool = True) -> DataFrame:
    """Prepared rows of a table, a path, a list of both, or a mapping of names to sources with shares."""
    def table(s: Any) -> Any:
        if isinstance(s, DataFrame):
            return s
        if isinstance(s, str):
            return load_traces(spark, s, split=split, drop_incomplete=drop_incomplete)
        if isinstance(s, Mapping) and "source" in s:
            return dict(s) | {"source": table(s["source"])}
        raise TypeError(f"no source: {type(s).__name__}")

    if isinstance(source, (DataFrame, str)):
        rows = prepared(prepare(table(source), settings))
        return rows if max_examples is None else rows.orderBy(F.xxhash64(F.lit(3407), "raw_index"), "raw_index").limit(max_examples)
    if isinstance(source, Mapping):
        return prepare_mix({k: v if k == "max_examples" else table(v) for k, v in source.items()}, settings, max_examples)
    if isinstance(source, Sequence):
        return prepare_mix([table(s) for s in source], settings, max_examples)
    raise TypeError(f"no source: {type(source).__name__}")


def mask_data(rows: DataFrame, *, max_length: int | None = None, keep_end: bool = False, max_supervised_tokens: int | None = None, **flags: bool) -> DataFrame:
    """Labels of prepared rows by the spans they carry; see ``render.mask`` for the flags."""
    return mask(rows, max_length=max_length, keep_end=keep_end, max_supervised_tokens=max_supervised_tokens, **flags)


def row_fits_context(messages: list[dict], tools: list[dict], settings: Settings) -> tuple[int, bool]:
    """(tokens, fits) of one conversation under ``settings.max_length``."""
    from .functions.templates import render

    n = len(settings.tokenizer.encode(render(settings.renderer, messages, tools, settings.options))[0])
    return n, settings.max_length is None or n <= settings.max_length
