"""Interval algebra over ARRAY<STRUCT<start, end>> as higher-order functions; ends are exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PAIR = "array<struct<start:int,end:int>>"


def pair(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def no_spans() -> Column:
    return F.array().cast(_PAIR)


def merge_spans(spans: Column) -> Column:
    """Union of spans; those that overlap or touch become one. Empty and reversed spans vanish."""
    bare = F.array_sort(F.transform(F.filter(spans, lambda s: s["end"] > s["start"]), lambda s: pair(s["start"], s["end"])))

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(pair(last["start"], F.greatest(last["end"], s["end"]))))
        return F.when((F.size(acc) > 0) & (s["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(bare, no_spans(), step)


def subtract_spans(spans: Column, excluded: Column) -> Column:
    """What of the merged ``spans`` lies outside every excluded span."""
    def cut(acc: Column, x: Column) -> Column:
        pieces = F.transform(acc, lambda s: F.array(pair(s["start"], F.least(s["end"], x["start"])), pair(F.greatest(s["start"], x["end"]), s["end"])))
        return F.filter(F.flatten(pieces), lambda s: s["end"] > s["start"])

    return F.array_sort(F.aggregate(merge_spans(excluded), merge_spans(spans), cut))


def covered(spans: Column) -> Column:
    """Number of positions in spans that don't overlap."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, s: a + (s["end"] - s["start"]))


def labels_from_offsets(input_ids: Column, offsets: Column, spans: Column, ignore: int = -100) -> Column:
    """A token keeps its id as label if it lies wholly in one span; one of no width is ignored."""
    def one(i: Column, o: Column) -> Column:
        inside = F.exists(spans, lambda s: (o["start"] >= s["start"]) & (o["end"] <= s["end"]))
        return F.when((o["end"] > o["start"]) & inside, i).otherwise(F.lit(ignore))

    return F.zip_with(input_ids, offsets, one)


def enabled(kind: Column, policy: dict[str, bool]) -> Column:
    """Whether a span kind is trained on; a kind that the policy doesn't name is."""
    off = [k for k, v in policy.items() if not v]
    return F.coalesce(~kind.isin(off), F.lit(True)) if off else F.lit(True)


def select_supervised(spans: Column, policy: dict[str, bool]) -> Column:
    """Union of the enabled kinds without the parts that a disabled kind covers."""
    on, off = F.filter(spans, lambda s: enabled(s["kind"], policy)), F.filter(spans, lambda s: ~enabled(s["kind"], policy))
    return subtract_spans(on, off)


def truncate(values: Column, limit: int | None, keep_end: bool = False) -> Column:
    """The first or last ``limit`` elements; none or a limit under 1 keeps all."""
    if not limit or limit < 1:
        return values
    return F.slice(values, F.greatest(F.size(values) - limit + 1, F.lit(1)), F.lit(limit)) if keep_end else F.slice(values, 1, limit)


def pad(values: Column, size: int, by: int = -100) -> Column:
    return F.concat(values, F.array_repeat(F.lit(by), F.greatest(F.lit(size) - F.size(values), F.lit(0))))
