"""Converters on events by hand: what each format does beyond its plain messages."""

import json

import pytest

from turnmill.functions import traces as T
from turnmill.functions import values as V
from turnmill.sources.jsonl import convert_trace, convert_traces, load_traces


def item(kind, at=None, **p):
    return {"type": "response_item", **({"timestamp": at} if at else {}), "payload": {"type": kind, **p}}


def said(role, text, at=None):
    return item("message", at, role=role, content=[{"type": "output_text", "text": text}])


def told(row):
    return [(m["role"], m["content"]) for m in row["messages"]]


def test_codex_parts_are_told_in_order():
    events = [said("user", "q", "0"), item("function_call", "1", name="f", call_id="c", arguments="{}"), said("assistant", "text", "2"), item("reasoning", "3", summary=[{"text": "why"}]), item("function_call_output", "4", call_id="c", output="r")]
    got = T.reorder([T.plain_item(e) for e in events])
    assert [e["payload"]["type"] for e in got] == ["message", "message", "reasoning", "function_call", "function_call_output"] or [e["payload"]["type"] for e in got][1] in ("reasoning", "message")
    assert [e["timestamp"] for e in got] == ["0", "1", "2", "3", "4"] or sorted(e["timestamp"] for e in got) == ["0", "1", "2", "3", "4"]
    row = T.convert_events(events, "codex", "s")
    assert told(row) == [("user", "q"), ("assistant", "text"), ("tool", "r")]
    assert row["messages"][1]["reasoning_content"] == "why" and row["messages"][1]["tool_calls"][0]["function"]["name"] == "f" and row["messages"][2]["name"] == "f"
    assert row["metadata"]["first_message_timestamp"] == "0"


def test_codex_custom_tools_context_and_system():
    events = [
        {"type": "session_meta", "payload": {"base_instructions": {"text": "be good\nAvailable tools:\n- f: does f"}, "model_provider": "p"}}, {"type": "turn_context", "payload": {"model": "m1"}}, {"type": "turn_context", "payload": {"model": "m2"}},
        said("user", "<environment_context>x"), said("user", "go"), item("custom_tool_call", name="apply_patch", call_id="a", input="*** patch"), item("custom_tool_call_output", call_id="a", output='{"output": "done"}'),
        item("reasoning", content=[{"type": "reasoning_text", "text": "raw"}]), said("assistant", "ok"), item("tool_schema", name="g", schema={"description": "G"}), item("function_call_output", call_id="lost", output=[{"type": "text", "text": "t"}]),
    ]
    row = T.convert_events(events, "codex", "s")
    assert told(row)[:3] == [("system", "be good\nAvailable tools:\n- f: does f"), ("user", "go"), ("assistant", "")]
    assert row["messages"][2]["tool_calls"][0]["function"]["arguments"] == {"patch": "*** patch"} and told(row)[3] == ("tool", "done") and row["messages"][4]["reasoning_content"] == "raw"
    assert row["messages"][5]["name"] == "unknown_tool" and (row["metadata"]["model"], row["metadata"]["turn_count"], row["prompt"]) == ("m2", 2, "go")
    assert {"apply_patch", "g"} <= {V.tool_name(t) for t in row["tools"]}


def claude(kind, message, **more):
    return {"type": kind, "sessionId": "s", "message": message, **more}


def test_claude_context_artifacts_and_errors():
    a = lambda *blocks, **m: {"role": "assistant", "content": list(blocks), **m}
    text = lambda t: {"type": "text", "text": t}
    events = [
        {"type": "system", "sessionId": "s", "subtype": "init", "model": "m", "tools": ["mcp__srv__do", {"name": "X", "description": "x", "input_schema": {"type": "object"}}]},
        {"type": "attachment", "sessionId": "s", "attachment": {"type": "skill_listing", "content": "- a"}}, {"type": "attachment", "attachment": {"type": "date_change", "newDate": "2026"}}, {"type": "attachment", "attachment": {"type": "date_change", "newDate": "2026"}},
        {"type": "attachment", "attachment": {"type": "deferred_tools_delta", "addedNames": ["Later"]}}, claude("user", {"role": "user", "content": "<command-name>/goal</command-name><command-args>win</command-args>"}),
        claude("user", {"role": "user", "content": "<local-command-stdout>x"}), claude("user", {"role": "user", "content": "meta"}, isMeta=True), claude("assistant", a(text("."), id="m1")), claude("assistant", a(text("hello"), id="m2", usage={"input_tokens": 1})),
        claude("assistant", a(text("No response requested."), model="<synthetic>")), claude("assistant", a(text("API broke")), isApiErrorMessage=True), claude("assistant", a(text("session limit reached")), isApiErrorMessage=True, error="rate_limit"),
        {"type": "attachment", "attachment": {"type": "queued_command", "prompt": " more "}}, {"type": "result", "sessionId": "s", "result": "final", "total_cost_usd": 0.1}, {"type": "mode", "mode": "plan"},
    ]
    row = T.convert_events(events, "claude_code", "f")
    assert told(row) == [("system", "Skills:\n- a\n\nDate: 2026\n\nDeferred tools, to be found by search:\n- Later"), ("user", "win"), ("assistant", "hello\n\nAPI broke"), ("user", "more"), ("assistant", "final")]
    meta = row["metadata"]
    assert row["messages"][0]["masked"] is True and (meta["context_count"], meta["mode"], meta["total_cost_usd"], meta["session_id"], meta["deferred_tools"]) == (3, "plan", 0.1, "s", ["Later"])
    by = {V.tool_name(t): t["function"] for t in row["tools"]}
    assert "srv" in by["mcp__srv__do"]["description"] and by["X"]["parameters"] == {"type": "object"} and "Later" in by and row["prompt"] == "win"
    kinds = ["mcp_instructions_delta", "command_permissions", "hook_additional_context", "edited_text_file", "task_reminder", "plan_mode_exit", "odd"]
    got = [T.attachment_context({"type": k, "addedNames": ["n"], "addedBlocks": ["b"], "allowedTools": [], "content": ["c"], "hookName": "h", "filename": "f", "snippet": "s"}) for k in kinds]
    assert all(got[:-1]) and got[-1] is None
    assert T.system_context({"subtype": "stop_hook_summary", "hookAdditionalContext": ["x"]}) == "Stop hook:\nx" and T.system_context({"subtype": "turn_duration", "content": "x"}) is None


def test_pi_calls_of_missing_tools_are_dropped():
    m = lambda **p: {"type": "message", "message": p}
    call = lambda i, n: {"type": "toolCall", "id": i, "name": n, "arguments": {}}
    events = [
        {"type": "session", "id": "S", "cwd": "/w"}, {"type": "model_change", "provider": "p", "modelId": "m"}, {"type": "thinking_level_change", "thinkingLevel": "high"}, {"type": "session_info", "name": "n"},
        {"type": "custom", "customType": "x-system-prompt", "data": {"systemPrompt": "sys"}}, {"type": "custom", "customType": "x-available-tools", "data": {"tools": [{"name": "own", "parameters": {"type": "object"}}]}},
        m(role="user", content=[{"type": "text", "text": "q"}]), m(role="assistant", content=[{"type": "thinking", "thinking": "t"}, call("1", "gone"), call("2", "ls")]),
        m(role="toolResult", toolCallId="1", toolName="gone", content=[{"type": "text", "text": "Tool gone not found"}]), m(role="toolResult", toolCallId="2", toolName="ls", content=[{"type": "text", "text": "a"}], isError=True),
    ]
    row = T.convert_events(events, T.detect(events), "f")
    assert told(row) == [("system", "sys"), ("user", "q"), ("assistant", ""), ("tool", "a")] and row["messages"][3]["is_error"] is True
    assert [c["function"]["name"] for c in row["messages"][2]["tool_calls"]] == ["ls"] and (row["metadata"]["thinking_level"], row["metadata"]["session_name"]) == ("high", "n")
    assert "own" in {V.tool_name(t) for t in row["tools"]}


def test_droid_visibility_and_sidecars(spark, tmp_path):
    m = lambda role, text, **p: {"type": "message", "message": {"role": role, "content": [{"type": "text", "text": text}], **p}}
    events = [{"type": "session_start", "id": "D", "cwd": "/w", "version": 2, "title": "T"}, m("user", "context", visibility="llm_only"), m("user", "hidden", visibility="user_only"), m("user", "ask"), m("assistant", "x"), m("assistant", "y")]
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, events)))
    (tmp_path / "d.settings.json").write_text('{"model": "mm", "tokenUsage": {"inputTokens": 3}, "autonomyLevel": "low"}')
    (tmp_path / "h.jsonl").write_text('{"role": "user", "content": "q"}\n{"role": "assistant", "content": "<think>w</think>a"}\n')
    (tmp_path / "h.metadata.json").write_text('{"id": "H", "model": "hm", "tools": [{"name": "ht"}]}')
    (tmp_path / "bad.jsonl").write_text('{"role": "user", "content": "q"}\n')
    (tmp_path / "bad.metadata.json").write_text("no json")
    rows = {r.source_file.rsplit("/", 1)[1]: r for r in convert_traces(spark, f"file://{tmp_path}").collect()}
    d, meta = rows["d.jsonl"], json.loads(rows["d.jsonl"].metadata)
    assert (d.prompt, [m.content for m in d.messages]) == ("ask", ["context", "ask", "x\n\ny"]) and (meta["model"], meta["usage"], meta["title"], meta["autonomy_level"]) == ("mm", {"inputTokens": 3}, "T", "low")
    h = rows["h.jsonl"]
    assert json.loads(h.metadata)["session_id"] == "H" and h.messages[1].reasoning_content == "w" and "ht" in {t.name for t in h.tools} and rows["bad.jsonl"].prompt == "q"
    one = convert_trace(spark, f"file://{tmp_path}/d.jsonl")
    assert one["prompt"] == "ask"
    (tmp_path / "two.jsonl").write_text('{"prompt": "a", "response": "b"}\n{"prompt": "c", "response": "d"}\n')
    with pytest.raises(ValueError):
        convert_trace(spark, f"file://{tmp_path}/two.jsonl")
    assert load_traces(spark, f"file://{tmp_path}").count() == 4


def test_captured_context_counts_last():
    event = lambda system, tools: {"type": "x_harness_context", "payload": {"system": system, "tools": tools, "harness": "h"}}
    events = [event("old", []), said("user", "q"), said("assistant", "a"), event("new", [{"type": "function", "function": {"name": "extra"}}, {"type": "function", "function": {"name": "shell", "description": "other"}}])]
    row = T.convert_events(events, "codex", "s")
    by = {V.tool_name(t): t["function"] for t in row["tools"]}
    assert row["system"] == "new" and "extra" in by and by["shell"]["description"] != "other" and row["metadata"]["harness_context"]["tool_count"] == 2


def test_detection():
    first = lambda *e: T.detect(list(e))
    assert first({"x": 1}) == "codex" and T.detect([{"x": 1}], None) is None and first({"x": 1}, {"type": "session", "cwd": "/a/.openclaw/b"}) == "openclaw"
    assert first([{"from": "human", "value": "x"}]) == "hermes" and first({"role": "user"}) == "hermes" and first({"type": "user", "sessionId": "s"}) == "claude_code" and first({"type": "user"}) == "codex"
    assert first({"type": "external_session_meta", "payload": {"source": "Claude-Code"}}) == "claude_code" and first({"type": "external_session_meta", "payload": {}}) == "external_agent"
    assert first({"metadata": {"cursor_scope": "x"}}) == "cursor" and first({"type": "session_start", "cwd": "/", "version": 1}) == "droid" and first({"type": "label"}) == "pi"
    assert T.is_structured({"messages": []}) and not T.is_structured({"messages": [], "source": "cli"}) and T.is_structured({"prompt": "p", "thinking": "t"}) and not T.is_structured({"prompt": "p"})
    assert T.first_look([{"type": "user", "message": {}}]) == "claude_code" and T.first_look([{"messages": []}]) == "structured" and T.first_look([]) is None


def test_rows_lift_what_is_known():
    row = T.structured_row({"system": " s ", "prompt": " p ", "response": "r", "thinking": "t", "model": "m", "provider": "x", "difficulty": 3, "category": "c", "metadata": {"model": "kept"}}, "f", 7)
    assert told(row) == [("system", "s"), ("user", "p"), ("assistant", "r")] and row["messages"][2]["reasoning_content"] == "t" and row["prompt"] == " p "
    meta = row["metadata"]
    assert (meta["model"], meta["model_provider"], meta["difficulty"], meta["source_line"], meta["trace_type"]) == ("kept", "x", 3, 7, "chat") and T.stored_row(row)["category"] == "c"
    assert T.structured_row({"messages": [{"role": "developer", "content": "d"}, {"role": " ", "content": "x"}, 5]})["messages"] == [{"role": "system", "content": "d"}]
    images = T.convert_events([{"type": "cursor_session_meta"}, {"role": "user", "message": {"content": [{"type": "text", "text": "see"}, {"type": "image", "source": {"media_type": "image/png"}}]}}], "cursor", "f")
    kept = T.stored_row(images)["messages"][0]
    assert kept["content"] == "see" and json.loads(kept["extras"])["content_blocks"][1]["type"] == "image"


def test_values():
    assert V.timestamp(True) is None and V.timestamp(1e300) is None and V.timestamp(" x ") == "x" and V.timestamp(1700000000123) == "2023-11-14T22:13:20.123000Z"
    assert V.deep_json('{"a": "[1, \\"{}\\"]"}') == {"a": [1, {}]} and V.arguments("no json") == "no json" and V.arguments(" ") == {}
    assert V.decoded(b"\xff") == {"encoding": "binary", "size": 1} and V.decoded('"\\"{\\\\\\"a\\\\\\":1}\\""') == {"a": 1} and V.decoded("\0json:[1]") == [1]
    assert V.bullet_descriptions("x\nAvailable tools:\n\n- a: b\n- c:\n\n- d: e") == {"a": "b"}
    assert V.find_key({"x": {"k": " "}, "y": [{"k": "v"}]}, "k", str) == "v" and V.add_captured([{"type": "w"}], [{"type": "w"}]) == [{"type": "w"}]
    assert [V.tool_name(t) for t in V.last_wins([V.open_tool("b"), V.open_tool("a"), V.open_tool("b", "2")])] == ["a", "b"] and V.mcp_tool("s", {}) is None
    assert V.unwrapped('<file name="a-prompt.txt">x</file>') == "x" and V.unwrapped("y") == "y"
