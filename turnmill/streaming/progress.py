"""Progress of running sessions: tailing files, keyed totals, and suppression of updates that change nothing."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTERS = tuple("input_tokens output_tokens reasoning_tokens cache_read_tokens cache_write_tokens total_tokens est_total_tokens total_cost".split())


def tail(path: str, offset: int, rest: str = "") -> tuple[list[dict], int, str]:
    """(objects, offset, rest): what was appended to a growing file since ``offset``; the unfinished last line is kept for the next call, bad lines are skipped."""
    with open(path, "rb") as f:
        f.seek(offset)
        data = f.read()
    lines = (rest.encode("utf-8", "surrogateescape") + data).split(b"\n")
    out = []
    for line in lines[:-1]:
        try:
            value = json.loads(line)
        except ValueError:
            continue
        if isinstance(value, dict):
            out.append(value)
    return out, offset + len(data), lines[-1].decode("utf-8", "surrogateescape")


def signature(metrics: dict | None) -> tuple | None:
    """What must change for an update to be worth sending."""
    return None if metrics is None else tuple(metrics.get(k) for k in ("model", "provider", *COUNTERS))


def status_text(events: list[dict]) -> str | None:
    """A line on the latest event that tells what an agent does."""
    known = {"turn_start": "Thinking", "message_start": "Writing", "tool_execution_start": "Running", "tool_execution_end": "Ran", "turn_end": "Turn done", "agent_end": "Done"}
    for e in reversed(events):
        kind = e.get("type")
        if kind in known:
            name = e.get("toolName") or e.get("name")
            return f"{known[kind]} {name}" if name and kind.startswith("tool_") else known[kind]
    return None


def upsert(state: dict[str, dict], update: dict[str, Any]) -> dict[str, dict]:
    """The latest update by ``prompt_id``: a delta is added to what was known, the start is kept, a running one without metrics keeps them."""
    key, before = update["prompt_id"], state.get(update["prompt_id"], {})
    new = dict(update)
    if new.get("started_at") is None:
        new["started_at"] = before.get("started_at")
    had, got = before.get("metrics"), new.get("metrics")
    if new.pop("metrics_delta", False) and had and got:
        new["metrics"] = {k: (had.get(k) or 0) + (got.get(k) or 0) for k in COUNTERS} | {k: got.get(k) or had.get(k) for k in ("model", "provider")}
    elif got is None and new.get("status") == "running":
        new["metrics"] = had
    return state | {key: new}


def latest_progress(updates: DataFrame) -> DataFrame:
    """(prompt_id, status, started_at, COUNTERS) of (seq, prompt_id, status, started_at, metrics_delta, COUNTERS): the state after all updates.

    The counters are the last full ones and the deltas after them. Works on a stream in update mode too, as it is one aggregate by key.
    """
    has = F.coalesce(*[F.col(c) for c in COUNTERS]).isNotNull()
    full = has & ~F.coalesce("metrics_delta", F.lit(False))
    value = F.struct("seq", F.coalesce("metrics_delta", F.lit(False)).alias("delta"), *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in COUNTERS])
    got = F.array_sort(F.collect_list(F.when(has, value)))  # a few updates a prompt
    s = updates.groupBy("prompt_id").agg(
        F.max_by("status", "seq").alias("status"), F.max_by("started_at", F.when(F.col("started_at").isNotNull(), F.col("seq"))).alias("started_at"),
        F.coalesce(F.max(F.when(full, F.col("seq"))), F.lit(-1)).alias("base"), got.alias("u"),
    )
    total = lambda c: F.aggregate(F.filter("u", lambda x: x["seq"] >= F.col("base")), F.lit(0.0), lambda a, x: a + x[c])
    return s.select("prompt_id", "status", "started_at", *[total(c).alias(c) for c in COUNTERS])


def progress_snapshot(latest: DataFrame) -> DataFrame:
    """Grand totals of ``latest_progress``."""
    return latest.agg(F.count("*").alias("prompts"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in COUNTERS])


class EventLog:
    """An append-only log: entries are numbered and read from an offset; a closed one takes no more."""

    def __init__(self) -> None:
        self.entries: list[dict] = []
        self.closed = False

    def append(self, entry: dict, ts: str | None = None) -> int:
        if self.closed:
            raise ValueError("the log is closed")
        self.entries.append(entry | {"seq": len(self.entries), "ts": ts})
        return len(self.entries) - 1

    def after(self, seq: int) -> list[dict]:
        return self.entries[seq + 1 :]

    def close(self) -> None:
        self.closed = True
