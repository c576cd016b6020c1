import json

import pytest

from turnmill.sources.jsonl import convert_rows, convert_traces, load_traces, read_prompts, scan_events, write_rows
from turnmill.streaming.ingest import progress_totals, read_events



def item(kind, **p):
    return {"type": "response_item", "payload": dict(p, type=kind)}


def block(kind, value, key="text"):
    return [{"type": kind, key: value}]


def turn(kind, content, **more):
    return {"type": kind, "sessionId": "s", "message": dict(more, role=kind, content=content)}


CODEX = [
    dict(type="session_meta", payload={"id": "s1"}), item("message", role="user", content=block("input_text", "<environment_context>x")), item("message", role="user", content=block("input_text", "do it")),
    item("reasoning", summary=block("summary_text", "think")), item("function_call", name="run", call_id="c1", arguments='{"n": 1}'), item("function_call_output", call_id="c1", output="ok"), item("message", role="assistant", content=block("output_text", "done")),
]
CLAUDE = [
    turn("user", "hi"), turn("assistant", block("thinking", "hm", "thinking"), usage=dict(input_tokens=3, output_tokens=4)), turn("assistant", [dict(type="tool_use", id="t", name="Read", input={"p": "x"})]),
    turn("user", [dict(type="tool_result", tool_use_id="t", content="body")]),
]
ROWS = [{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "<think>w</think>a"}]}, {"prompt": "p", "response": "r", "thinking": "z"}]


@pytest.fixture
def traces(tmp_path):
    for name, events in (("codex", CODEX), ("claude", CLAUDE), ("rows", ROWS), ("partials/bad", CODEX)):
        f = tmp_path / "in" / f"{name}.jsonl"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("\n\n".join(json.dumps(e) for e in events) + "\n")
    return f"file://{tmp_path}/in"


def test_conversion(spark, traces, tmp_path):
    rows = {(r.source_file.rsplit("/", 1)[1], r.source_line): r for r in convert_traces(spark, traces).collect()}
    assert sorted(rows) == [("claude.jsonl", 1), ("codex.jsonl", 1), ("rows.jsonl", 1), ("rows.jsonl", 2)]
    c = rows["codex.jsonl", 1]
    assert (c.trace_type, c.prompt, [m.role for m in c.messages]) == ("codex", "do it", ["user", "assistant", "tool", "assistant"])
    assert c.messages[1].reasoning_content == "think" and c.messages[1].tool_calls[0].name == "run" and c.messages[2].name == "run"
    assert json.loads({t.name: t.parameters for t in c.tools}["run"])["required"] == ["n"]
    a = rows["claude.jsonl", 1]
    assert a.trace_type == "claude-code" and [m.role for m in a.messages] == ["user", "assistant", "tool"] and a.messages[1].reasoning_content == "hm"
    assert [(m.content, m.reasoning_content) for m in rows["rows.jsonl", 1].messages] == [("q", None), ("a", "w")]
    assert load_traces(spark, traces).count() == 3 and load_traces(spark, traces, drop_incomplete=False).count() == 4 and load_traces(spark, traces, max_examples=2).count() == 2
    assert scan_events(spark, traces).count() == len(CODEX) + len(CLAUDE) + len(ROWS)
    write_rows(convert_traces(spark, traces), f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out").count() == 4


def test_rows_by_line(spark, traces):
    rows = traces + "/rows.jsonl"
    got = sorted(r.prompt for r in convert_rows(spark, rows).collect())
    assert got == sorted(r.prompt for r in convert_traces(spark, rows).collect()) and len(got) == 2
    with pytest.raises(Exception, match="no training row"):
        convert_rows(spark, traces).collect()
    assert convert_rows(spark, traces, skip_invalid_lines=True).count() == 2


def test_bad_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"type": "user", "sessionId": "s", "message": {"role": "user", "content": "hi"}}\nnot json\n')
    with pytest.raises(Exception, match="line 2"):
        convert_traces(spark, f"file://{tmp_path}").collect()
    assert convert_traces(spark, f"file://{tmp_path}", skip_invalid_lines=True).first().prompt == "hi"


def test_prompts(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Prompt,System\n"two\nlines",s\n" ",\n')
    (tmp_path / "b.jsonl").write_text('{"prompt": "x", "follow_up_prompts": ["y"]}\n')
    (tmp_path / "c.txt").write_text("# no\none\n\ntwo\n")
    read = lambda n: [tuple(r) for r in read_prompts(spark, f"file://{tmp_path}/{n}").collect()]
    assert read("a.csv") == [("two\nlines", "s", [])] and read("b.jsonl") == [("x", None, ["y"])] and [r[0] for r in read("c.txt")] == ["one", "two"]


def test_stream(spark, traces):
    q = progress_totals(read_events(spark, traces)).writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.source_file.rsplit("/", 1)[1]: r for r in spark.table("progress").where("source_file not like '%partials%'").collect()}
    assert (got["claude.jsonl"].input_tokens, got["claude.jsonl"].output_tokens, got["claude.jsonl"].events, got["codex.jsonl"].bad) == (3, 4, 4, 0)
