"""Rendering, supervision spans, length policies, token labels and audit."""

from __future__ import annotations

import itertools
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..batches import pieces
from ..functions.intervals import minus
from ..functions.spans import covered, select_supervised, truncate
from ..schema import KINDS

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
POLICY = {"reasoning": True, "final_answer": True, "tool_call": True, "tool_response": False, "user": False, "system": False, "developer": False}
IGNORED = -100
POLICIES = ("drop", "trim_followups", "error", "keep")


def kind_of(role: Column) -> Column:
    return F.when(role.isin("assistant", "model"), "final_answer").when(role == "tool", "tool_response").when(role.isin("user", "system", "developer"), role).otherwise("user")


def segment(role: Column, content: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("user")), F.lit("\n"), F.coalesce(content, F.lit("")), F.lit(CLOSE))


def turn_spans(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, kind, start, end, seg): each turn's content by its character offsets in the rendered conversation."""
    seg = segment(F.col("role"), F.col("text"))
    out = turns.select("conv_id", "turn", "role", kind_of(F.col("role")).alias("kind"), seg.alias("seg"), F.length(F.coalesce("text", F.lit(""))).alias("size"))
    before = "coalesce(sum(length(seg)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    start = F.expr(before) + F.length(F.lit(OPEN)) + F.length(F.coalesce("role", F.lit("user"))) + 1
    return out.withColumn("start", start.cast("int")).select("conv_id", "turn", "role", "kind", "start", (F.col("start") + F.col("size")).alias("end"), "seg")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, text, spans) of each conversation."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "seg", F.struct("start", "end", "kind", "role").alias("span"))))
    out = turn_spans(turns).groupBy("conv_id").agg(parts.alias("p"))
    return out.select("conv_id", F.array_join(F.transform("p", lambda p: p["seg"]), "").alias("text"), F.transform("p", lambda p: p["span"]).alias("spans"))


def supervised(rendered: DataFrame, **flags: bool) -> DataFrame:
    """Adds ``supervised``: the spans trained on, under POLICY changed by flags such as ``user=True``."""
    return rendered.withColumn("supervised", select_supervised(F.col("spans"), _policy(flags)))


def _policy(flags: dict[str, bool]) -> dict[str, bool]:
    if unknown := set(flags) - set(KINDS):
        raise ValueError(f"no such span kind: {sorted(unknown)}")
    return POLICY | flags


class CharTokenizer:
    """One id a code point."""

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        return [ord(c) for c in text], [(i, i + 1) for i in range(len(text))]


class WordTokenizer:
    """Runs of non-space, by a stable hash."""

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        import re
        import zlib

        found = list(re.finditer(r"\S+", text))
        return [zlib.crc32(m[0].encode()) & 0x7FFFFFFF for m in found], [m.span() for m in found]


class FastTokenizer:
    """A ``tokenizers`` file; loaded once a worker."""

    def __init__(self, path: str):
        self.path, self._t = path, None

    def __getstate__(self):
        return {"path": self.path, "_t": None}

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        if self._t is None:
            from tokenizers import Tokenizer

            self._t = Tokenizer.from_file(self.path)
            self._t.encode_special_tokens = True
        e = self._t.encode(text, add_special_tokens=False)
        return e.ids, e.offsets


def _lists(parts: list, kind) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, edges) of a list of sequences."""
    edge = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=edge[1:])
    return np.fromiter(itertools.chain.from_iterable(parts), kind, int(edge[-1])), edge


def tokenize(rendered: DataFrame, tokenizer, text_col: str = "text") -> DataFrame:
    """Adds ``input_ids``, ``offsets`` and ``token_length``; any object with ``encode(text) -> (ids, offsets)`` will do.

    A piece of a batch is one call where the tokenizer has ``encode_batch(texts)``. A null text has no tokens.
    """
    def piece(text: pa.Array) -> pa.Array:
        texts = [t or "" for t in text.to_pylist()]
        pairs = tokenizer.encode_batch(texts) if hasattr(tokenizer, "encode_batch") else [tokenizer.encode(t) for t in texts]
        ids, edge = _lists([p[0] for p in pairs], np.int32)
        starts, ends = (np.fromiter((o[k] for p in pairs for o in p[1]), np.int32, len(ids)) for k in (0, 1))
        spans = pa.StructArray.from_arrays([pa.array(starts), pa.array(ends)], ["start", "end"])
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(edge, pa.array(ids)), pa.ListArray.from_arrays(edge, spans)], ["input_ids", "offsets"])

    def run(text: pa.Array) -> pa.Array:
        return pa.concat_arrays([piece(t) for t in pieces(text)])

    # nondeterministic: evaluated once, and not again by filters that see through the projection
    made = F.arrow_udf(run, "struct<input_ids:array<int>,offsets:array<struct<start:int,end:int>>>").asNondeterministic()
    out = rendered.withColumn("__t", made(F.col(text_col)))
    out = out.withColumns({"input_ids": F.col("__t.input_ids"), "offsets": F.col("__t.offsets")}).drop("__t")
    return out.withColumn("token_length", F.size("input_ids"))


def selected(spans: Iterable[dict], policy: dict[str, bool]) -> list[tuple[int, int]]:
    """Union of the enabled kinds without what a disabled kind covers; a kind the policy doesn't name is enabled."""
    on, off = [], []
    for s in spans:
        (on if policy.get(s["kind"], True) else off).append((s["start"], s["end"]))
    return minus(on, off)


def labeller(policy: dict[str, bool]):
    """Labels of a batch: a token keeps its id if it lies wholly in one of its row's selected spans; one of no width is ignored."""
    def piece(ids: pa.Array, offsets: pa.Array, spans: pa.Array) -> pa.Array:
        n = np.asarray(ids.value_lengths().fill_null(0))
        row = np.repeat(np.arange(len(n), dtype=np.int64), n)
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        start, end = (offsets.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "end"))
        chosen = [(r << 32 | a, r << 32 | b) for r, ss in enumerate(spans.to_pylist()) for a, b in selected(ss or [], policy)]
        keep = np.zeros(len(flat), bool)
        if chosen and len(flat):
            a, b = np.array(chosen, np.int64).T
            k = np.searchsorted(a, row << 32 | start, "right") - 1
            keep = (end > start) & (k >= 0) & ((row << 32 | end) <= b[np.maximum(k, 0)])
        return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(n))).astype(np.int32), pa.array(np.where(keep, flat, IGNORED).astype(np.int32)))

    def run(ids: pa.Array, offsets: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.concat_arrays([piece(*b.columns) for b in pieces(pa.RecordBatch.from_arrays([ids, offsets, spans], ["ids", "offsets", "spans"]))])

    return run


def mask(tokenized: DataFrame, *, max_length: int | None = None, keep_end: bool = False, max_supervised_tokens: int | None = None, keep_all: bool = False, **flags: bool) -> DataFrame:
    """Adds ``supervised`` and ``labels``; rows without a supervised token, or with too many, are dropped unless ``keep_all``; ids and labels are truncated alike."""
    made = F.arrow_udf(labeller(_policy(flags)), "array<int>").asNondeterministic()
    out = supervised(tokenized, **flags).withColumn("labels", made("input_ids", "offsets", "spans"))
    used = F.size(F.filter("labels", lambda x: x != IGNORED))
    if not keep_all:
        out = out.where(used > 0) if max_supervised_tokens is None else out.where((used > 0) & (used <= max_supervised_tokens))
    return out.withColumns({c: truncate(F.col(c), max_length, keep_end) for c in ("input_ids", "labels")}).drop("offsets")


def audit(masked: DataFrame, sample_size: int | None = 8, order: str = "conv_id") -> DataFrame:
    """(row, tokens, supervised, ratio, issues) of the first rows, or of all with ``sample_size=None``."""
    rows = masked if sample_size is None else masked.orderBy(order).limit(sample_size)
    used = F.size(F.filter("labels", lambda x: x != -100))
    wrong = F.exists(F.arrays_zip("input_ids", "labels"), lambda z: (z["labels"] != -100) & (z["labels"] != z["input_ids"]))
    issue = lambda bad, text: F.when(bad, F.lit(text))
    found = F.array_compact(F.array(
        issue(F.size("input_ids") != F.size("labels"), "input_ids and labels differ in length"), issue(used == 0, "no supervised tokens"), issue(wrong, "a label differs from its input id"),
    ))
    return rows.select(F.col(order).alias("row"), F.size("input_ids").alias("tokens"), used.alias("supervised"), F.round(used / F.size("labels"), 4).alias("ratio"), found.alias("issues"))


def apply_length_policy(turns: DataFrame, max_length: int, policy: str = "drop") -> DataFrame:
    """(conv_id, status, reason, token_length, final_token_length, keep_turns): what becomes of each conversation, in characters.

    ``trim_followups`` keeps the longest start that ends right before a user turn
    after the first, or at the whole; the start must hold an assistant turn.
    ``max_length`` under 1 keeps everything. ``error`` fails on the first too long.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    spans = turn_spans(turns)
    run = spans.selectExpr(
        "conv_id", "turn", "role",
        "sum(length(seg)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto",
        "count_if(role IN ('assistant', 'model')) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS answers",
        "lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS following", "row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n",
    )
    fits = f"(following IS NULL OR following = 'user') AND answers > 0 AND upto <= {int(max_length)}"
    per = run.groupBy("conv_id").agg(F.max("upto").alias("token_length"), F.max("n").alias("turns"), F.expr(f"max(struct(n, upto)) FILTER (WHERE {fits})").alias("best"))
    limit = F.lit(int(max_length))
    over = (limit > 0) & (F.col("token_length") > limit)
    trimmed = over & F.lit(policy == "trim_followups") & F.col("best").isNotNull()
    status = F.when(~over, "kept").when(F.lit(policy == "keep"), "kept").when(trimmed, "trimmed").otherwise("dropped")
    if policy == "error":
        status = F.when(over, F.raise_error(F.concat(F.lit("conversation over the limit: "), F.col("conv_id").cast("string")))).otherwise(F.lit("kept"))
    final = F.when(status == "trimmed", F.col("best.upto")).when(status == "kept", F.col("token_length")).otherwise(F.lit(0))
    turns_kept = F.when(status == "trimmed", F.col("best.n")).when(status == "kept", F.col("turns")).otherwise(F.lit(0))
    return per.select("conv_id", status.alias("status"), F.when(over, F.lit("oversized")).alias("reason"), F.col("token_length").cast("bigint").alias("token_length"), final.cast("bigint").alias("final_token_length"), turns_kept.cast("bigint").alias("keep_turns"))


def row_fits_context(turns: DataFrame, max_length: int) -> DataFrame:
    """(conv_id, token_length, fits)."""
    per = turns.groupBy("conv_id").agg(F.sum(F.length(segment(F.col("role"), F.col("text")))).alias("token_length"))
    return per.select("conv_id", "token_length", (F.lit(max_length < 1) | (F.col("token_length") <= max_length)).alias("fits"))


def label_stats(turns: DataFrame, **flags: bool) -> DataFrame:
    """(conv_id, tokens, supervised, ratio_bp) under a policy, one token a character, ratio in hundredths of a per cent."""
    r = supervised(render(turns), **flags)
    return r.select("conv_id", F.length("text").cast("bigint").alias("tokens"), covered(F.col("supervised")).alias("supervised")).withColumn("ratio_bp", F.expr("supervised * 10000 div tokens"))

