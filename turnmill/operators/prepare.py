"""Training rows to prepared rows: normalize, check tools, render, find spans, tokenize, fit, report. One pass, no shuffle.

The outcome of every row is kept in ``status``: kept, trimmed or dropped. Prepared
rows and the report are two selections of that one table, so that nothing is counted
beside the data.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..batches import batched, pieces
from ..functions import templates as T
from ..functions.jsonschema import validate
from ..functions.traces import normal_message, template_messages
from ..functions.values import obj, text
from .mixing_plan import mix, percentage
from .render import IGNORED, POLICIES, CharTokenizer, selected

SPAN = "struct<start:int,end:int,source_start:int,source_end:int,kind:string,role:string>"
OUTCOME = (
    f"raw_index bigint, row_id string, source string, source_key string, status string, reason string, token_length int, final_token_length int, max_length int, policy string, "
    f"unsupported_tool string, messages_kept int, text string, spans array<{SPAN}>, input_ids array<int>, attention_mask array<tinyint>, offsets array<struct<start:int,end:int>>"
)
_NAMES = [c.split()[0] for c in OUTCOME.split(", ") if " " in c]


@dataclass
class Settings:
    """How rows are prepared. ``max_length`` under 1 sets no limit."""

    renderer: Any = field(default_factory=T.Qwen)
    tokenizer: Any = field(default_factory=CharTokenizer)
    max_length: int | None = None
    policy: str = "drop"
    options: dict = field(default_factory=dict)
    masking: bool = True
    validate_tools: bool = False
    strict: bool = False
    source_key: str | None = None

    def __post_init__(self) -> None:
        if self.policy not in POLICIES:
            raise ValueError(f"policy must be one of {POLICIES}")
        self.options = T.checked_options(self.options)
        self.max_length = self.max_length if isinstance(self.max_length, int) and self.max_length > 0 else None


def oversized_policy(policy: str | None = None, *, drop: bool = True, trim: bool = False) -> str:
    """The policy by name, or by the older two flags."""
    chosen = policy or ("trim_followups" if trim else "drop" if drop else "keep")
    if chosen not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    return chosen


def row_label(meta: dict, explicit: Any = None) -> str | None:
    """What a row is called in reports: given, or the first of row_id, id, source_key and its file and line."""
    found = [explicit, *(meta.get(k) for k in ("row_id", "id", "source_key", "session_id"))]
    if meta.get("source_file"):
        found.append(f"{meta['source_file']}:{meta.get('source_line', 1)}")
    return next((str(v) for v in found if v is not None and v != ""), None)


def tool_call_errors(messages: list[dict], tools: list[dict]) -> list[str]:
    """What is wrong with each call: no function, no name, not declared, arguments that are no object or break the schema."""
    declared = {text(obj(t.get("function")).get("name")): obj(obj(t.get("function")).get("parameters")) for t in tools}
    out = []
    for i, m in enumerate(messages):
        calls = m.get("tool_calls") or []
        if not isinstance(calls, list):
            out.append(f"message {i}: tool_calls is no list")
            continue
        for k, c in enumerate(calls):
            f, at = obj(obj(c).get("function")), f"message {i} call {k}"
            name = text(f.get("name"))
            if not name:
                out.append(f"{at}: no name" if f else f"{at}: no function")
            elif name not in declared:
                out.append(f"{at}: {name} is not declared")
            else:
                given = f.get("arguments")
                try:
                    given = json.loads(given) if isinstance(given, str) and given.strip() else {} if given in (None, "") else given
                except ValueError:
                    given = None
                out += [f"{at}: {e}" for e in validate(given, declared[name], name)] if isinstance(given, dict) else [f"{at}: arguments of {name} are no object"]
    return out


def cut_unsupported(messages: list[dict], tools: list[dict]) -> tuple[list[dict] | None, str | None]:
    """Messages up to the user turn before the first call of an undeclared tool, and its name; None if no answer is left."""
    known = {text(obj(t.get("function")).get("name")) for t in tools}
    for i, m in enumerate(messages):
        bad = next((n for c in m.get("tool_calls") or [] if (n := text(obj(obj(c).get("function")).get("name"))) not in known), None)
        if bad is not None:
            user = next((k for k in range(i, -1, -1) if messages[k].get("role") == "user"), 0)
            kept = messages[:user]
            return (kept if any(map(T.is_answer, kept)) else None), bad
    return messages, None


class Preparer:
    """Prepares rows one by one; one for each task, as it remembers what it asked its template."""

    def __init__(self, s: Settings):
        self.s, self.template = s, T.Template(s.renderer, s.options, s.strict)

    def _render(self, messages: list[dict], tools: list[dict]) -> dict:
        if self.s.masking:
            rendered, spans = self.template.spans(messages, tools)
        else:
            rendered, spans = T.render(self.s.renderer, messages, tools, self.s.options), []
        ids, offsets = self.s.tokenizer.encode(rendered)
        return {"text": rendered, "spans": spans, "input_ids": list(ids), "offsets": offsets}

    def row(self, raw_messages: Any, tools: list[dict]) -> dict:
        """The outcome of one row."""
        s = self.s
        messages = [m for m in map(normal_message, raw_messages or []) if m]
        if not messages:
            return {"status": "dropped", "reason": "empty_messages"}
        messages = T.parsed_arguments(messages)
        messages, bad = cut_unsupported(messages, tools)
        if messages is None:
            return {"status": "dropped", "reason": "unsupported_tool_call", "unsupported_tool": bad}
        if s.validate_tools and (errors := tool_call_errors(messages, tools)):
            raise ValueError("; ".join(errors))
        out = self._render(messages, tools)
        if s.masking and not out["spans"]:
            return {"status": "dropped", "reason": "no_trainable_spans", "unsupported_tool": bad}
        size = len(out["input_ids"])
        found = {"status": "kept", "reason": None, "unsupported_tool": bad, "token_length": size, "messages_kept": len(messages)}
        if s.max_length and size > s.max_length and s.policy != "keep":
            found |= {"reason": "oversized", "max_length": s.max_length, "policy": s.policy}
            if s.policy == "error":
                raise ValueError(f"a row of {size} tokens is over the limit of {s.max_length}")
            made: dict[int, dict] = {}

            def measure(candidate: list) -> int:
                made[len(candidate)] = self._render(candidate, tools)
                return len(made[len(candidate)]["input_ids"])

            fit = T.longest_fitting(T.trim_candidates(messages), measure, s.max_length) if s.policy == "trim_followups" else None
            if fit is None or (s.masking and not made[len(fit)]["spans"]):
                return found | {"status": "dropped"}
            out, found = made[len(fit)], found | {"status": "trimmed", "messages_kept": len(fit)}
        return found | out | {"final_token_length": len(out["input_ids"]), "attention_mask": [1] * len(out["input_ids"])}


def prepare(rows: DataFrame, settings: Settings | None = None, preserve: Sequence[str] = ("source_file", "source_line", "metadata")) -> DataFrame:
    """The outcome of every training row: OUTCOME and the preserved columns. Dropped rows have no text.

    ``raw_index`` is the column of that name if there is one, else the row's place as
    Spark numbers it. Rows with a null or empty list of messages are dropped as empty.
    """
    s = settings or Settings()
    kept = [c for c in preserve if c in rows.columns]
    if "raw_index" not in rows.columns:
        rows = rows.withColumn("raw_index", F.monotonically_increasing_id())
    has = set(rows.columns)
    need = list(dict.fromkeys(["raw_index", "messages", "tools", *kept, *(c for c in ("metadata", "row_id", "source", "source_file", "source_line") if c in has)]))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)

    names = [*_NAMES, *kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Preparer(s)
        for piece in (piece for batch in batches for piece in pieces(batch)):
            out = []
            for r in piece.to_pylist():
                tools = [json.loads(t["raw"]) for t in r["tools"] or [] if t["raw"]]
                got = dict.fromkeys(_NAMES) | p.row(template_messages(r["messages"] or []), tools)
                meta = json.loads(r["metadata"]) if r.get("metadata") else {}
                got |= {"raw_index": r["raw_index"], "row_id": row_label(meta, r.get("row_id")), "source": meta.get("source") or r.get("source"), "source_key": s.source_key or meta.get("source_key")}
                out.append(got | {c: r[c] for c in kept})
            yield pa.RecordBatch.from_arrays([_column(n, [o[n] for o in out], piece) for n in names], names)

    return rows.select(*need).mapInArrow(run, OUTCOME + (", " + kinds if kinds else ""))


_PLAIN = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}
_TYPES = {c.split()[0]: _PLAIN[c.split()[1]] for c in OUTCOME.split(", ") if c.split()[1] in _PLAIN}
_SPAN_TYPE = pa.list_(pa.struct([(k, pa.int32()) for k in ("start", "end", "source_start", "source_end")] + [("kind", pa.string()), ("role", pa.string())]))


def _column(name: str, values: list, batch: pa.RecordBatch) -> pa.Array:
    """A column of outcomes; token columns are built flat."""
    if name in ("input_ids", "attention_mask", "offsets"):
        lengths = [len(v) if v is not None else 0 for v in values]
        edge = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        missing = pa.array([v is None for v in values], pa.bool_())
        flat = itertools.chain.from_iterable(v for v in values if v is not None)
        if name == "offsets":
            pairs = np.fromiter(itertools.chain.from_iterable(flat), np.int32, 2 * int(edge[-1])).reshape(-1, 2)
            inner: pa.Array = pa.StructArray.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["start", "end"])
        else:
            inner = pa.array(np.fromiter(flat, np.int32 if name == "input_ids" else np.int8, int(edge[-1])))
        return pa.ListArray.from_arrays(pa.array(edge), inner, mask=missing)
    if name == "spans":
        return pa.array(values, _SPAN_TYPE)
    return pa.array(values, _TYPES[name] if name in _TYPES else batch.schema.field(name).type)


def prepared(outcomes: DataFrame) -> DataFrame:
    """The rows to train on."""
    return outcomes.where("status IN ('kept', 'trimmed')")


def report_rows(outcomes: DataFrame) -> DataFrame:
    """One row a row: what became of it and why."""
    return outcomes.select("raw_index", "row_id", "source", "source_key", "status", "reason", "token_length", "final_token_length", "max_length", "policy", "unsupported_tool")


def report_totals(outcomes: DataFrame) -> DataFrame:
    """(total_rows, formatted_rows, dropped_rows, trimmed_rows, oversized_rows, max_token_length, max_final_token_length) and a count of each reason."""
    n = lambda cond: F.count_if(F.expr(cond))
    return outcomes.agg(
        F.count("*").alias("total_rows"), n("status IN ('kept', 'trimmed')").alias("formatted_rows"), n("status = 'dropped'").alias("dropped_rows"), n("status = 'trimmed'").alias("trimmed_rows"),
        n("reason = 'oversized'").alias("oversized_rows"), n("reason = 'empty_messages'").alias("empty_messages"), n("reason = 'unsupported_tool_call'").alias("unsupported_tool_call"),
        n("reason = 'no_trainable_spans'").alias("no_trainable_spans"), F.max("token_length").alias("max_token_length"), F.max("final_token_length").alias("max_final_token_length"),
    )


def prepare_mix(sources: Mapping[str, Any] | Sequence[Any], settings: Settings | None = None, max_examples: int | None = None) -> DataFrame:
    """Prepared rows of several sources: a table each, or {"source": table, "weight" | "percentage" | "proportion": share, ...} by name.

    Other keys of such an entry change ``settings`` for its source. With shares the
    ratio is exact and a source without a prepared row is an error.
    """
    base = settings or Settings()
    named = list(sources.items()) if isinstance(sources, Mapping) else [(str(i), s) for i, s in enumerate(sources)]
    if isinstance(sources, Mapping) and isinstance(sources.get("max_examples"), int):
        max_examples = sources["max_examples"]
    tables, weights = [], []
    for name, entry in named:
        if name == "max_examples":
            continue
        table, own, share = entry, {}, None
        if isinstance(entry, Mapping):
            table = entry["source"]
            share = next((percentage(entry[k]) if k == "percentage" else float(entry[k]) for k in ("weight", "percentage", "proportion") if entry.get(k) is not None), None)
            own = {k: v for k, v in entry.items() if k not in ("source", "weight", "percentage", "proportion")}
            if "options" in own:
                own["options"] = base.options | own["options"]
        s = Settings(**{f: getattr(base, f) for f in base.__dataclass_fields__} | own | {"source_key": name})
        tables.append(prepared(prepare(table, s)).withColumn("row_key", F.concat_ws(":", F.lit(name), F.col("raw_index").cast("string"))))
        weights.append(share)
    return mix(tables, weights if any(w is not None for w in weights) else None, max_examples)


# labels of prepared rows


def row_labels(prepared_text: str, spans: list[dict], ids: list[int], offsets: list[tuple[int, int]], policy: dict[str, bool]) -> list[int]:
    """Labels of one row by its spans, or by what is inferred from its text where it has none."""
    chosen = selected(spans, policy) if spans else T.infer(prepared_text, policy.get("reasoning", True))
    out, k = [IGNORED] * len(ids), 0
    for i, (a, b) in enumerate(offsets):
        while k < len(chosen) and chosen[k][1] <= a:
            k += 1
        if a < b and k < len(chosen) and chosen[k][0] <= a and b <= chosen[k][1]:
            out[i] = ids[i]
    return out


def align_labels(rows: DataFrame, ids: str = "input_ids", full_ids: str = "full_ids", full_labels: str = "labels", to: str = "aligned") -> DataFrame:
    """Labels of a trainer's own ids; null where they are not those of the text."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        given = zip(*[b.column(c).to_pylist() for c in (ids, full_ids, full_labels)])
        made = [None if x is None or y is None or z is None else T.align(x, y, z) for x, y, z in given]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.int32()))], [*b.schema.names, to])

    return rows.mapInArrow(batched(run), f"{_ddl(rows)}, {to} array<int>")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


FORBIDDEN = (
    "# Tools", *(f"{a}tool_response{b}" for a, b in (("<", ">"), ("</", ">"), ("<|", ">"), ("<", "|>"))), "<|turn>user", "<start_of_turn>user",
    *(f"<|start_{x}|>user<|end_{x}|>" for x in ("header_id", "of_role")), "<|im_start|>user",
)
USEFUL = ("</think>", "<|channel>thought", *(f"{a}tool_call{b}" for a, b in (("<", ">"), ("<|", ">"), ("<", "|>"))), "<turn|>", "<|im_end|>")


def audit_labels(masked: DataFrame, decode, sample_size: int | None = 8, order: str = "raw_index") -> DataFrame:
    """(row, tokens, supervised, ratio, errors, warnings) of the first rows with input_ids and labels, their text judged by ``decode(ids) -> str``."""
    rows = masked if sample_size is None else masked.orderBy(order).limit(max(sample_size, 0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, ids, labels in zip(pdf["k"], pdf["input_ids"], pdf["labels"]):
                ids, labels = list(ids), list(labels)
                used = [i for i, x in enumerate(labels) if x != IGNORED]
                errors, warnings = [], []
                if len(ids) != len(labels):
                    errors.append("input_ids and labels differ in length")
                elif not used:
                    errors.append("no supervised tokens")
                else:
                    if wrong := next((i for i in used if labels[i] != ids[i]), None):
                        errors.append(f"a label differs from its input id at {wrong}")
                    said = decode([ids[i] for i in used])
                    errors += [f"supervised text holds {m!r}" for m in FORBIDDEN if m in said]
                    if not any(m in said for m in USEFUL):
                        warnings.append("supervised text has no common delimiter")
                out.append((key, len(ids), len(used), round(len(used) / len(labels), 4) if labels else 0.0, errors, warnings))
            yield pd.DataFrame(out, columns=["row", "tokens", "supervised", "ratio", "errors", "warnings"])

    return rows.select(F.col(order).cast("string").alias("k"), "input_ids", "labels").mapInPandas(run, "row string, tokens int, supervised int, ratio double, errors array<string>, warnings array<string>")


def preview(ids: list[int], labels: list[int], decode) -> str:
    """A row's text with what is not trained on in grey, control characters as pictures."""
    out, at = [], 0
    while at < len(ids):
        end, off = at, labels[at] == IGNORED
        while end < len(ids) and (labels[end] == IGNORED) == off:
            end += 1
        said = "".join(c if c in "\t\n" or ord(c) >= 32 else chr(0x2400 + ord(c)) for c in decode(ids[at:end]))
        out.append(f"\x1b[90m{said}\x1b[0m" if off else said)
        at = end
    return "".join(out)


def search_rows(rows: DataFrame, query: str) -> DataFrame:
    """Rows whose canonical JSON holds the query in any case."""
    return rows.where(F.contains(F.lower(F.to_json(F.struct("*"))), F.lit(query.casefold().lower())))
