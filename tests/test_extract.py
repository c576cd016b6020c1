import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from turnmill import api
from turnmill.sources import extract as E
from turnmill.streaming.ingest import watch_usage

EVENTS = [{"type": "session_meta", "payload": {"id": "s", "model": "Big-Model"}}, {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "mail ann.lee@corp.net"}]}}, {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "done"}]}}]


def session(path, events):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(e) + "\n" for e in events))


@pytest.fixture
def store(tmp_path):
    session(tmp_path / "codex/sessions/a/one.jsonl", EVENTS)
    session(tmp_path / "codex/sessions/b/ONE.jsonl", EVENTS)
    session(tmp_path / "codex/sessions/c.jsonl", [{"type": "session_meta", "payload": {"model": "other"}}])
    (tmp_path / "codex/sessions/bad.jsonl").write_text('{"a": 1}\n[1]\n')
    return tmp_path


def test_default_stores(store):
    assert E.default_stores("codex", str(store), {"CODEX_HOME": str(store / "codex")}) == [str(store / "codex/sessions")]
    assert E.default_stores("pi", str(store), {}) == []
    with pytest.raises(ValueError):
        E.default_stores("x")


def test_sessions_are_extracted_whole(spark, store):
    out, src = str(store / "out"), str(store / "codex/sessions")
    done = E.extract(spark, "codex", out, [src], model="big-model", anonymize=True)
    assert done.files == 2 and sorted(f.lower() for f in os.listdir(out)) == ["one.jsonl", "one_1.jsonl"] and done.replaced["emails"] == 2
    assert "ann.lee" not in (store / "out/one.jsonl").read_text() if os.path.exists(f"{out}/one.jsonl") else True
    assert E.extract(spark, "codex", out, [src]).files == 3 and len(os.listdir(out)) == 3 and not [f for f in os.listdir(store) if f.startswith(".out")]
    for bad in (src, str(store / "codex"), src + "/a/x"):
        with pytest.raises(ValueError):
            E.extract(spark, "codex", bad, [src])
    assert E.newest_session(src) and E.newest_session(str(store / "none")) is None and len(E.by_time(src)) == 4


def test_state_and_editor_stores(spark, tmp_path):
    with sqlite3.connect(tmp_path / "state.db") as db:
        db.execute("CREATE TABLE sessions(id TEXT, model TEXT)")
        db.execute("CREATE TABLE messages(id INTEGER, session_id TEXT, role TEXT, content TEXT)")
        db.execute("INSERT INTO sessions VALUES ('s1', 'm')")
        db.execute("INSERT INTO messages VALUES (1, 's1', 'user', 'q')")
    db.close()
    assert E.extract(spark, "hermes", str(tmp_path / "h"), [str(tmp_path / "state.db")]).files == 1
    assert json.loads((tmp_path / "h/s1.jsonl").read_text())["messages"][0]["content"] == "q"
    place = tmp_path / "User/globalStorage"
    place.mkdir(parents=True)
    chat = lambda *said: json.dumps({"messages": [{"role": r, "text": t} for r, t in said]})
    with sqlite3.connect(place / "state.vscdb") as db:
        db.execute("CREATE TABLE ItemTable(key TEXT, value TEXT)")
        db.executemany("INSERT INTO ItemTable VALUES (?,?)", [("chat.1", chat(("user", "a"), ("ai", "b"), ("user", "c"), ("ai", "d"))), ("chat.2", chat(("user", "a"), ("ai", "b"))), ("chat.3", chat(("user", "x"), ("ai", "y")))])
    db.close()
    assert E.extract(spark, "cursor", str(tmp_path / "c"), [str(tmp_path / "User")]).files == 2
    session(tmp_path / "P/proj/agent-transcripts/t.jsonl", [{"role": "user", "message": {"content": [{"type": "text", "text": "hi"}]}}])
    (tmp_path / "P/proj/mcps/s/tools").mkdir(parents=True)
    (tmp_path / "P/proj/mcps/s/tools/f.json").write_text('{"name": "f", "input_schema": {"type": "object"}}')
    assert E.extract(spark, "cursor", str(tmp_path / "n"), [str(tmp_path / "P")]).files == 1
    lines = [json.loads(x) for x in (tmp_path / "n/t.jsonl").read_text().splitlines()]
    assert [x.get("type") for x in lines] == ["cursor_session_meta", "cursor_available_tools", None]
    assert [t["function"]["name"] for t in E.tool_snapshots({"s": [{"name": "b"}, {"name": "a", "inputSchema": {"type": "object"}}]})] == ["s.a", "s.b"]


def test_folder_is_scrubbed(spark, store):
    src = str(store / "codex/sessions")
    assert E.anonymize_folder(spark, src, str(store / "clean"))["emails"] == 2
    assert "ann.lee" in (store / "codex/sessions/a/one.jsonl").read_text() and "ann.lee" not in (store / "clean/a/one.jsonl").read_text()
    E.anonymize_folder(spark, src)
    assert "ann.lee" not in (store / "codex/sessions/a/one.jsonl").read_text()


def test_api(spark, store):
    src = f"file://{store}/codex/sessions/a"
    p = api.prepare_data(spark, src)
    m = api.mask_data(p).first()
    assert "".join(chr(x) for x in m.labels if x != -100).startswith("done")
    assert api.prepare_data(spark, [src, api.load_traces(spark, src)]).count() == 2 and api.prepare_data(spark, {"a": {"source": src, "weight": 1}}).count() == 1
    assert api.row_fits_context([{"role": "user", "content": "x"}], [], api.Settings(max_length=5)) == (29, False)
    with pytest.raises(TypeError):
        api.prepare_data(spark, 5)


def test_usage_is_watched(spark, tmp_path):
    session(tmp_path / "w/x.jsonl", [{"type": "assistant", "message": {"model": "m", "usage": {"input_tokens": 3, "output_tokens": 4}}}])
    seen = []
    watch_usage(spark, f"file://{tmp_path}/w", lambda n, m: seen.append((n.rsplit("/", 1)[1], m["total_tokens"], m["model"]))).awaitTermination(120)
    assert seen == [("x.jsonl", 7, "m")]
    assert F is not None
