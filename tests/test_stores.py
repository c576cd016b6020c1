import json
import sqlite3

import pytest

from turnmill.functions import records as R
from turnmill.functions import traces as T
from turnmill.sources.stores import composer_chats, record_chats, session_exports, store_chats, store_rows


@pytest.fixture
def sessions(tmp_path):
    with sqlite3.connect(tmp_path / "state.db") as db:
        db.execute("CREATE TABLE sessions(id TEXT PRIMARY KEY, source TEXT, model TEXT, started_at REAL, input_tokens INT, output_tokens INT, estimated_cost_usd REAL)")
        db.execute("CREATE TABLE messages(id INTEGER PRIMARY KEY, session_id TEXT, role TEXT, content TEXT, tool_calls TEXT)")
        db.executemany("INSERT INTO sessions VALUES (?,?,?,?,?,?,?)", [("s1", "cli", "big-model", 1700000000.0, 3, 4, 0.5), ("s2", None, "small", 1700000001.0, None, None, None), ("", None, None, 0, None, None, None)])
        db.executemany("INSERT INTO messages VALUES (?,?,?,?,?)", [(2, "s1", "assistant", "yes", '[{"id":"c","function":{"name":"f","arguments":"{}"}}]'), (1, "s1", "user", "go", None), (3, "gone", "user", "x", None)])
    db.close()
    (tmp_path / "other.db").write_text("no store")
    return str(tmp_path)


def test_sessions_meet_their_messages(spark, sessions):
    rows = store_rows(spark, sessions)
    got = {r.session_id: json.loads(r.row) for r in session_exports(rows).collect()}
    assert sorted(got) == ["s1", "s2"]
    s = got["s1"]
    assert [m["content"] for m in s["messages"]] == ["go", "yes"] and (s["total_tokens"], s["total_cost"], s["timestamp"]) == (7, 0.5, "2023-11-14T22:13:20Z")
    assert s["messages"][1]["tool_calls"][0]["function"]["name"] == "f" and got["s2"]["messages"] == []
    assert [r.session_id for r in session_exports(rows, "BIG").collect()] == ["s1"]
    row = T.convert_events([s], "hermes", "x")
    assert (row["prompt"], [m["role"] for m in row["messages"]]) == ("go", ["user", "assistant"])
    assert store_rows(spark, sessions, tables="messages").count() == 3


@pytest.fixture
def editor(tmp_path):
    place = tmp_path / "workspaceStorage" / "w1"
    place.mkdir(parents=True)
    bubble = lambda kind, **more: json.dumps({"type": kind, **more})
    rich = json.dumps({"root": {"type": "root", "children": [{"type": "paragraph", "children": [{"type": "text", "text": "fix "}, {"type": "text", "text": "it"}]}, {"type": "paragraph", "children": [{"type": "text", "text": "now"}]}]}})
    rows = [
        ("composerData:c1", json.dumps({"composerId": "c1", "status": "done", "modelConfig": {"modelName": "model-x"}, "fullConversationHeadersOnly": [{"bubbleId": b, "type": 1 if b == "b1" else 2} for b in ("b1", "b3", "b2", "missing")]})),
        ("bubbleId:c1:b1", bubble(1, text="", richText=rich)), ("bubbleId:c1:b2", bubble(2, text="all done")),
        ("bubbleId:c1:b3", bubble(2, bubbleId="b3", thinking={"text": "hm"}, toolFormerData={"name": "edit", "rawArgs": '{"p": 1}', "result": "ok"})),
        ("settings", "{}"), ("aichat.data", json.dumps({"tabs": [{"messages": [{"role": "human", "text": "hi"}, {"role": "ai", "text": "hello"}, {"role": "ai", "text": "hello"}]}]})),
    ]
    with sqlite3.connect(place / "state.vscdb") as db:
        db.execute("CREATE TABLE ItemTable(key TEXT PRIMARY KEY, value BLOB)")
        db.executemany("INSERT INTO ItemTable VALUES (?,?)", [(k, v.encode()) for k, v in rows])
    db.close()
    return str(tmp_path)


def test_chats_of_an_editor(spark, editor):
    rows = store_rows(spark, editor)
    made = composer_chats(rows).first()
    c = json.loads(made.row)
    assert [(m["role"], m["content"]) for m in c["messages"]] == [("user", "fix it\nnow"), ("assistant", ""), ("tool", "ok"), ("assistant", "all done")]
    assert c["messages"][1]["tool_calls"][0]["function"] == {"name": "edit", "arguments": '{"p": 1}'} and c["messages"][1]["reasoning_content"] == "hm"
    assert (c["model"], c["metadata"]["cursor_scope"], c["metadata"]["cursor_workspace_id"], c["response"]) == ("model-x", "workspace", "w1", "all done")
    other = [json.loads(r.row) for r in record_chats(rows).collect()]
    assert [(r["prompt"], r["response"]) for r in other] == [("hi", "hello")]
    chats = {r.key: r for r in store_chats(rows).collect()}
    assert {k: r.n_messages for k, r in chats.items()} == {"composerData:c1": 4, "aichat.data": 2} and all(len(r.sequence) == r.n_messages for r in chats.values())
    events = R.transcript(json.loads(chats["composerData:c1"].row))
    back = T.convert_events(events, T.detect(events), "x")
    assert [m["role"] for m in back["messages"]] == ["user", "assistant", "tool", "assistant"] and back["metadata"]["session_id"] == "c1" and back["messages"][2]["name"] == "edit"


def test_parts():
    assert R.role_of("Human") == "user" and R.role_of("aiMessage") == "assistant" and R.role_of("x") == "user" and R.role_of("toolResult") == "tool"
    assert R.matches_model([{"a": {"model": "Big-1"}}], "big") and not R.matches_model([{"text": "big"}], "big") and R.matches_model([], " ")
    assert R.find_model({"x": {"availableModels": [{"name": "gpt-9"}]}, "modelName": "m"}) == "m"
    assert R.trimmed([{"role": "assistant", "content": "a"}, {"role": "user", "content": "q"}]) == []
    assert R.sanitized({"messages": [{"role": "assistant", "content": "a"}], "prompt": "p"})["messages"][0] == {"role": "user", "content": "p"}
    assert R.sanitized({"messages": [{"role": "user", "content": " "}]}) is None
    assert R.merged_tools([{"type": "function", "function": {"name": "f"}}], [{"type": "function", "function": {"name": "f", "description": "d", "parameters": {"properties": {"x": {}}}}}])[0]["function"]["description"] == "d"
    assert R.native_transcript([{"role": "user"}], "s", [{"x": 1}])[1]["type"] == "cursor_available_tools"
    assert R.observed_schema([{"a": 1, "b": "x"}, {"a": "y"}]) == {"type": "object", "properties": {"a": {"type": ["integer", "string"]}, "b": {"type": "string"}}, "required": ["a"]}
    assert R.store_scope("/x/globalStorage/state.vscdb") == ("global", None)
