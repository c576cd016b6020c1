"""Taking sessions out of local stores: where they lie, which ones count, and an output that is replaced whole or not at all.

Paths are local to the driver, as the stores are a person's own files.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import values as V
from ..functions.resume import plain_user_event
from ..operators.anonymize import anonymize_sessions
from ..operators.dataset import file_names, write_sessions, write_text
from ..operators.messages import dedupe_contained
from .jsonl import trace_files
from .stores import session_exports, store_chats, store_rows

#: (environment variable or None, path below it or below the home folder)
STORES = {
    "codex": (("CODEX_HOME", "sessions"), (None, ".codex/sessions")),
    "claude": (("CLAUDE_CONFIG_DIR", "projects"), ("CLAUDE_HOME", "projects"), (None, ".claude/projects")),
    "pi": (("PI_SESSION_DIR", ""), ("PI_CODING_AGENT_DIR", "sessions"), (None, ".pi/agent/sessions"), (None, ".pi/sessions")),
    "hermes": (("HERMES_STATE_DB", ""), ("HERMES_HOME", "state.db"), (None, ".hermes/state.db")),
    "cursor": ((None, ".config/Cursor/User"), (None, "Library/Application Support/Cursor/User"), (None, "AppData/Roaming/Cursor/User"), (None, ".cursor/projects")),
}


def distinct_paths(paths: Iterable[str | None]) -> list[str]:
    """Existing paths in order, each once."""
    return list(dict.fromkeys(os.path.realpath(os.path.expanduser(p)) for p in paths if p and os.path.exists(os.path.expanduser(p))))


def default_stores(provider: str, home: str | None = None, env: dict | None = None) -> list[str]:
    """Where a provider's sessions are likely to lie: environment first, then the home folder."""
    if provider not in STORES:
        raise ValueError(f"no such provider: {provider}")
    env, home = os.environ if env is None else env, home or os.path.expanduser("~")
    found = []
    for name, below in STORES[provider]:
        base = home if name is None else env.get(name)
        found.append(os.path.join(base, below) if base and below else base)
    return distinct_paths(found)


def whole_sessions(files: DataFrame, model: str | None = None) -> DataFrame:
    """(source_file, text) of sessions whose every line is an object; with ``model`` only those that name it somewhere.

    Wrapped prompt files are unwrapped, other lines keep their bytes.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, whole in zip(pdf["source_file"], pdf["text"]):
                lines = [x for x in (whole or "").split("\n") if x.strip()]
                try:
                    events = [json.loads(x) for x in lines]
                except ValueError:
                    continue
                if not events or not all(isinstance(e, dict) for e in events) or (model and not R.matches_model(events, model)):
                    continue
                made = [x if (p := plain_user_event(e)) == e else V.compact(p) for x, e in zip(lines, events)]
                out.append((name, "\n".join(made) + "\n"))
            yield pd.DataFrame(out, columns=["source_file", "text"])

    return files.select("source_file", "text").mapInPandas(run, "source_file string, text string")


def newest_session(folder: str, since: float | None = None) -> str | None:
    """The newest session changed since a time, else the newest of all."""
    found = [os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".jsonl")]
    recent = [f for f in found if since is not None and os.path.getmtime(f) >= since]
    return max(recent or found, key=lambda f: (os.path.getmtime(f), f), default=None)


def by_time(folder: str, suffix: str = ".jsonl") -> list[str]:
    """Files by time of change, newest first."""
    found = [os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs if f.endswith(suffix)]
    return sorted(found, key=lambda f: (-os.path.getmtime(f), f))


def project_tools(project: str) -> list[dict]:
    """Tools that an editor's project lists, one file a tool in mcps/SERVER/tools."""
    out = []
    root = os.path.join(project, "mcps")
    for folder, _, files in sorted(os.walk(root)):
        if os.path.basename(folder) == "tools":
            for f in sorted(files):
                if f.endswith(".json"):
                    try:
                        with open(os.path.join(folder, f), encoding="utf-8") as h:
                            entry = V.tool_entry(json.load(h))
                    except (OSError, ValueError):
                        continue
                    out += [entry] if entry else []
    return V.last_wins(out)


def tool_snapshots(servers: dict[str, list[dict]], kind: str | None = None) -> list[dict]:
    """Tools that servers list, as server.tool, with a harness's own."""
    listed = [t for s, tools in servers.items() for x in tools if (t := V.mcp_tool(s, x))]
    return V.last_wins([*V.catalog(kind), *listed])


def native_transcripts(spark: SparkSession, root: str) -> DataFrame:
    """(source_file, text) of an editor's own transcripts, with header and tools before them."""
    tools = {p: project_tools(os.path.join(root, p)) for p in (sorted(os.listdir(root)) if os.path.isdir(root) else [])}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, whole in zip(pdf["source_file"], pdf["text"]):
                events = []
                for line in (whole or "").split("\n"):
                    try:
                        events.append(json.loads(line))
                    except ValueError:
                        continue
                project = next((p for p in tools if f"/{p}/" in name), None)
                stem = name.rsplit("/", 1)[-1].removesuffix(".jsonl")
                out.append((name, "".join(V.compact(e) + "\n" for e in R.native_transcript(events, stem, tools.get(project, [])))))
            yield pd.DataFrame(out, columns=["source_file", "text"])

    files = trace_files(spark, f"file://{root}").where(F.col("source_file").contains("/agent-transcripts/"))
    return files.select("source_file", "text").mapInPandas(run, "source_file string, text string")


def editor_sessions(spark: SparkSession, root: str, model: str | None = None) -> DataFrame:
    """(source_file, text) of an editor's chats as session files, without chats that are a part of another; its own transcripts only where no store has a chat."""
    chats = store_chats(store_rows(spark, root))
    key = F.concat_ws("|", "source_db", "table_name", "row_no")
    turns = chats.select(key.alias("conv_id"), F.posexplode("sequence").alias("turn", "text")).withColumn("role", F.lit(""))
    kept = chats.withColumn("conv_id", key).join(dedupe_contained(turns).select("conv_id"), "conv_id", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, raw in zip(pdf["key"], pdf["row"]):
                row = json.loads(raw)
                if not model or R.matches_model([row], model):
                    meta = row["metadata"]
                    out.append((meta.get("cursor_composer_id") or name or "chat", "".join(V.compact(e) + "\n" for e in R.transcript(row))))
            yield pd.DataFrame(out, columns=["source_file", "text"])

    made = kept.select("key", "row").mapInPandas(run, "source_file string, text string")
    return native_transcripts(spark, root) if chats.isEmpty() else made


def state_sessions(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """(source_file, text) of the sessions of a state store, one line each."""
    s = session_exports(store_rows(spark, path, tables="sessions,messages"), model)
    return s.select(F.concat("session_id", F.lit(".jsonl")).alias("source_file"), F.concat("row", F.lit("\n")).alias("text"))


@dataclass
class Extracted:
    """What an extraction wrote."""

    files: int = 0
    sources: list[str] = field(default_factory=list)
    replaced: dict[str, int] = field(default_factory=dict)


def check_output(out: str, sources: list[str]) -> None:
    """An output that holds a source, or lies in one, would be lost with its replacement."""
    out = os.path.realpath(out)
    if os.path.exists(out) and not os.path.isdir(out):
        raise ValueError(f"{out} is no folder")
    for s in map(os.path.realpath, sources):
        if s == out or s.startswith(out + os.sep) or out.startswith(s + os.sep):
            raise ValueError(f"{out} and the source {s} lie in each other")


def extract(spark: SparkSession, provider: str, out: str, paths: list[str] | None = None, *, model: str | None = None, anonymize: bool = False) -> Extracted:
    """Write a provider's sessions to ``out``, one file each, and tell how many.

    They are written beside it and take its place in one step, so that a failed run
    leaves the earlier output. With ``anonymize`` people and secrets are replaced first.
    """
    sources = distinct_paths(paths) if paths else default_stores(provider)
    check_output(out, sources)
    if not sources:
        raise ValueError(f"no sessions of {provider} found")
    make: dict[str, Any] = {"cursor": editor_sessions, "hermes": state_sessions}
    tables = [make[provider](spark, s, model) if provider in make else whole_sessions(trace_files(spark, f"file://{s}"), model) for s in sources]
    found = tables[0]
    for t in tables[1:]:
        found = found.union(t)
    counts: dict[str, int] = {}
    if anonymize:
        found = anonymize_sessions(found)
        sums = found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("emails", "usernames", "api_keys")]).first()
        counts = sums.asDict()
    names = found.select("source_file").orderBy("source_file").toPandas()["source_file"].tolist()  # a person's sessions
    stems = [n.rsplit("/", 1)[-1].removesuffix(".jsonl") for n in names]
    named = spark.createDataFrame(list(zip(names, file_names(stems))), "source_file string, name string")
    if len(set(names)) < len(names):
        raise ValueError("two sessions of one name in a source")
    parent = os.path.dirname(os.path.realpath(out)) or "."
    os.makedirs(parent, exist_ok=True)
    staged = tempfile.mkdtemp(prefix=f".{os.path.basename(out)}.", dir=parent)
    try:
        write_sessions(found.join(named, "source_file").select("name", "text"), staged)
        replace_folder(staged, out)
    finally:
        shutil.rmtree(staged, ignore_errors=True)
    return Extracted(len(names), sources, counts)


def replace_folder(staged: str, out: str) -> None:
    """``staged`` takes the place of ``out``, which comes back if that fails."""
    old = f"{out}.replaced"
    if os.path.exists(out):
        os.replace(out, old)
    try:
        os.replace(staged, out)
    except OSError:
        if os.path.exists(old):
            os.replace(old, out)
        raise
    shutil.rmtree(old, ignore_errors=True)


def anonymize_folder(spark: SparkSession, source: str, out: str | None = None) -> dict[str, int]:
    """Scrub every session under ``source`` into ``out``, or in place; replacements by kind. Files keep their places, unchanged lines their bytes."""
    place = out or source
    if out:
        check_output(out, [source])
    root = os.path.realpath(source)
    done = anonymize_sessions(trace_files(spark, f"file://{root}"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.parse import unquote, urlparse

        for pdf in batches:
            for name, text in zip(pdf["source_file"], pdf["text"]):
                at = os.path.join(place, os.path.relpath(unquote(urlparse(name).path), root))
                os.makedirs(os.path.dirname(at), exist_ok=True)
                write_text(at, text or "")
            yield pdf[["emails", "usernames", "api_keys"]]

    got = done.mapInPandas(run, "emails int, usernames int, api_keys int").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("emails", "usernames", "api_keys")]).first()
    return got.asDict()
