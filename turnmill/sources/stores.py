"""SQLite stores as a Spark source, and the sessions and chats in them.

``spark.read.format("sqlite_rows").option("path", folder).load()`` gives every row of
every table of every store as JSON; one store is one task. Sessions then meet their
messages, and composers their bubbles, by joins.
"""

from __future__ import annotations

import json
import os
import shutil
import sqlite3
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import records as R
from ..functions import values as V

ROWS = "source_db string, table_name string, row_no bigint, key string, row string"


class _Store(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def read_store(path: str, tables: list[str] | None = None) -> Iterator[tuple]:
    """ROWS of one store, read from a copy taken with what is not yet merged into it; no rows of what is no store."""
    with tempfile.TemporaryDirectory() as place:  # the copy of one task, gone with it
        copy = os.path.join(place, "store.db")
        for end in ("", "-wal", "-shm"):
            if os.path.exists(path + end):
                shutil.copy2(path + end, copy + end)
        try:
            with sqlite3.connect(f"file:{copy}?mode=ro", uri=True, timeout=5) as db:
                names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY name")]
                for t in names:
                    if tables and t not in tables:
                        continue
                    cursor = db.execute(f"SELECT * FROM {_quoted(t)}")
                    columns = [c[0] for c in cursor.description]
                    for n, values in enumerate(cursor, 1):
                        row = {c: V.decoded(v) if R.holds_payload(c) or isinstance(v, bytes) else v for c, v in zip(columns, values)}
                        key = next((row[c] for c in columns if R.identifies(c) and isinstance(row[c], str)), None)
                        yield path, t, n, key, json.dumps(row, ensure_ascii=False, default=str)
        except sqlite3.DatabaseError:
            return


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffixes = options["path"].removeprefix("file://"), tuple(options.get("suffixes", ".vscdb,.db,.sqlite").split(","))
        self.tables = [t for t in options.get("tables", "").split(",") if t]

    def partitions(self) -> list[_Store]:
        if os.path.isfile(self.path):
            return [_Store(self.path)]
        found = [os.path.join(d, f) for d, _, files in os.walk(self.path) for f in files if f.endswith(self.suffixes)]
        return [_Store(p) for p in sorted(found, key=lambda p: (-os.path.getmtime(p), p))]

    def read(self, partition: _Store) -> Iterator[tuple]:
        return read_store(partition.path, self.tables) if partition else iter(())  # no store, no partition


class SqliteRows(DataSource):
    """Options: path (a store or a folder), suffixes, tables."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def store_rows(spark: SparkSession, path: str, tables: str = "", suffixes: str = ".vscdb,.db,.sqlite") -> DataFrame:
    spark.dataSource.register(SqliteRows)
    return spark.read.format("sqlite_rows").option("path", path).option("tables", tables).option("suffixes", suffixes).load()


def session_exports(rows: DataFrame, model: str | None = None) -> DataFrame:
    """(source_db, session_id, started_at, row): each session of the tables sessions and messages with its messages, as JSON.

    Columns are optional and read by name. Totals and cost that are missing come from
    their parts: actual before estimated before plain cost. A session without
    messages keeps an empty list; one without an id is left out.
    """
    of = lambda name: rows.where(F.lower("table_name") == name)
    get = lambda k: F.get_json_object("row", f"$.{k}")
    s = of("sessions").select("source_db", get("id").alias("session_id"), get("started_at").try_cast("double").alias("started_at"), F.col("row").alias("session")).where("session_id <> ''")
    m = of("messages").select("source_db", get("session_id").alias("session_id"), F.struct(get("id").try_cast("bigint").alias("id"), F.col("row_no"), F.col("row")).alias("m"))
    per = m.groupBy("source_db", "session_id").agg(F.transform(F.array_sort(F.collect_list("m")), lambda x: x["row"]).alias("messages"))  # one session
    both = s.join(per, ["source_db", "session_id"], "left").select("source_db", "session_id", "started_at", "session", F.coalesce("messages", F.array().cast("array<string>")).alias("messages"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [export_session(json.loads(s), [json.loads(m) for m in ms], db) for s, ms, db in zip(pdf["session"], pdf["messages"], pdf["source_db"])]
            pdf = pdf.drop(columns=["session", "messages"]).assign(row=[json.dumps(x, ensure_ascii=False) for x in made])
            yield pdf[[not model or R.matches_model([x], model) for x in made]]

    return both.mapInPandas(run, "source_db string, session_id string, started_at double, row string")


def export_session(session: dict, messages: list[dict], source_db: str) -> dict:
    """One session as the object that the converters read."""
    read, wrote = session.get("input_tokens"), session.get("output_tokens")
    total = session.get("total_tokens")
    if total is None and (read is not None or wrote is not None):
        total = (read or 0) + (wrote or 0)
    costs = (session.get("actual_cost_usd"), session.get("estimated_cost_usd"), session.get("total_cost"))
    out = []
    for m in messages:
        nested = {k: d for k in ("tool_calls", "reasoning_details", "codex_reasoning_items", "codex_message_items") if (d := V.decoded(m.get(k), 1)) not in (None, "")}
        out.append(m | {"content": V.decoded(m.get("content"), 1) or ""} | nested)
    return session | {
        "source": session.get("source") or "cli", "hermes_source": session.get("source"), "timestamp": V.timestamp(session.get("started_at")), "total_tokens": total,
        "total_cost": next((c for c in costs if c is not None), None), "model_config": V.decoded(session.get("model_config"), 1), "source_db": source_db, "messages": out,
    }


_CHAT = "source_db string, table_name string, row_no bigint, key string, row string"


def record_chats(rows: DataFrame) -> DataFrame:
    """(source_db, table_name, row_no, key, row): records of any table that hold a chat, as rows of training data in JSON.

    Tables and keys that name chats are looked at, and records whose values have a chat's shape.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for db, t, n, key, raw in pdf.itertuples(index=False):
                row = json.loads(raw)
                if not (R.is_candidate(t) or R.is_candidate(key) or R.has_chat_shape(R.payload(row))):
                    continue
                made = R.record_row(row, _store_meta(db, t, n))
                out.append((db, t, n, key, None if made is None else json.dumps(made, ensure_ascii=False)))
            yield pd.DataFrame([o for o in out if o[4]], columns=["source_db", "table_name", "row_no", "key", "row"])

    return rows.where("key IS NULL OR NOT (key LIKE 'composerData:%' OR key LIKE 'bubbleId:%')").mapInPandas(run, _CHAT)


def _store_meta(db: str, table: str, n: int) -> dict:
    scope, workspace = R.store_scope(db)
    return {"trace_type": "cursor", "source": "cursor", "source_db": db, "cursor_scope": scope, "cursor_workspace_id": workspace, "cursor_table": table, "cursor_row": n}


def composer_chats(rows: DataFrame) -> DataFrame:
    """The same of composers: their headers name the bubbles, which a join brings in the order of the headers; missing ones are left out."""
    get = lambda p: F.coalesce(*[F.get_json_object("row", f"$.{c}{p}") for c in ("value", "data", "json", "payload", "state")])
    c = rows.where("key LIKE 'composerData:%'").select("source_db", "table_name", "row_no", "key", get("").alias("data"), F.coalesce(get(".composerId"), F.substring_index("key", ":", -1)).alias("composer"))
    heads = F.from_json(F.get_json_object("data", "$.fullConversationHeadersOnly"), "array<string>")
    h = c.select("source_db", "table_name", "row_no", F.col("key").alias("composer_key"), "data", "composer", F.posexplode(heads).alias("pos", "header"))
    h = h.withColumn("key", F.concat(F.lit("bubbleId:"), "composer", F.lit(":"), F.get_json_object("header", "$.bubbleId")))
    b = rows.where("key LIKE 'bubbleId:%'").select("source_db", "table_name", "key", get("").alias("bubble"))
    met = h.select("source_db", "table_name", "composer_key", "pos", "header", "key").join(b, ["source_db", "table_name", "key"])
    per = met.groupBy("source_db", "table_name", "composer_key").agg(F.array_sort(F.collect_list(F.struct("pos", "header", "bubble"))).alias("b"))  # one chat
    both = c.select("source_db", "table_name", "row_no", F.col("key").alias("composer_key"), "data").join(per, ["source_db", "table_name", "composer_key"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for db, t, n, key, data, bubbles in zip(*(pdf[k] for k in ("source_db", "table_name", "row_no", "composer_key", "data", "b"))):
                pairs = [(V.obj(json.loads(x["header"])), V.obj(json.loads(x["bubble"]))) for x in bubbles]
                made = R.composer_row(V.obj(json.loads(data)), pairs, _store_meta(db, t, n) | {"cursor_key": key})
                if made:
                    out.append((db, t, n, key, json.dumps(made, ensure_ascii=False)))
            yield pd.DataFrame(out, columns=["source_db", "table_name", "row_no", "key", "row"])

    return both.mapInPandas(run, _CHAT)


def store_chats(rows: DataFrame) -> DataFrame:
    """(source_db, table_name, row_no, key, row, n_messages, sequence) of all chats of stores, cleaned; ``sequence`` holds a hash a message."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for pdf in batches:
            made = [R.sanitized(json.loads(x)) for x in pdf["row"]]
            pdf = pdf.assign(row=[None if m is None else json.dumps(m, ensure_ascii=False) for m in made])
            pdf["n_messages"] = [0 if m is None else len(m["messages"]) for m in made]
            pdf["sequence"] = [[] if m is None else [hashlib.md5(V.canonical({k: x[k] for k in ("role", "content", "tool_calls") if k in x}).encode()).hexdigest() for x in m["messages"]] for m in made]
            yield pdf[pdf["row"].notna()]

    return record_chats(rows).union(composer_chats(rows)).mapInPandas(run, _CHAT + ", n_messages int, sequence array<string>")
