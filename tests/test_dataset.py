import json

import pytest
from pyspark.sql import functions as F

from turnmill.functions import capture as C
from turnmill.functions import resume as R
from turnmill.operators import anonymize as A
from turnmill.operators import dataset as D
from turnmill.sources.jsonl import convert_traces, escape_line_breaks_of, scan_events, trace_files, write_rows
from turnmill.sources.prompts import inline_prompts, parse_prompts, read_prompt_inputs, write_prompt_inputs
from turnmill.streaming import progress as P

ROWS = [
    {"messages": [{"role": "user", "content": "one"}, {"role": "assistant", "content": "1", "tool_calls": [{"id": "c", "function": {"name": "f", "arguments": "{}"}}]}], "tools": [{"type": "function", "function": {"name": "f", "description": "d", "parameters": {"type": "object", "properties": {"a": {"type": "string"}}, "required": ["a"]}}}], "metadata": {"model": "m"}},
    {"messages": [{"role": "user", "content": "two"}, {"role": "tool", "content": "r"}], "tools": [{"type": "function", "function": {"name": "f", "parameters": {"type": "object", "properties": {"a": {"type": "integer"}}}}}]},
]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "rows.jsonl").write_text("".join(json.dumps(r) + "\n" for r in ROWS))
    return tmp_path / "in"


def test_previews_features_and_tools(spark, folder):
    rows = convert_traces(spark, f"file://{folder}")
    got = D.preview_page(rows).collect()
    assert [(r.prompt, r.response, r.model, r.message_count, r.tool_count, r.complete) for r in got] == [("one", "1", "m", 1, 1, True), ("two", None, None, 1, 0, False)]
    assert [r.prompt for r in D.preview_page(rows, "TWO").collect()] == ["two"] and len(D.preview_page(rows, limit=0).collect()) == 1
    assert tuple(D.dataset_totals(rows).first()) == (1, 2, 1, 1) and D.rows_per_file(rows).first().rows == 2
    lines = scan_events(spark, f"file://{folder}")
    assert dict(D.json_features(lines, ["source_file", "line_no"]).collect()) == {"messages": "list<object>", "tools": "list<object>", "metadata": "object"}
    t = D.dataset_tools(rows).first()
    p = json.loads(t.parameters)
    assert (t.name, t.description) == ("f", "d") and len(p["properties"]["a"]["anyOf"]) == 2 and "required" not in p
    made = D.write_card(rows, lines, str(folder), "Set", D.card_tags("codex", "x", "x"), "m", "codex")
    assert (folder / "README.md").read_text() == made and "2 lines" in made and '"f"' in made and made.count('- "x"') == 1
    from turnmill.sources.jsonl import load_traces, tool_snapshot

    assert [V["function"]["name"] for V in tool_snapshot(spark, f"file://{folder}")] == ["f"]
    assert load_traces(spark, f"file://{folder}").count() == 1


def test_edits(folder):
    row = lambda n: {"metadata": {"source_file": "rows.jsonl", "source_line": n}}
    assert D.update_row(str(folder), row(2), {"prompt": "new"}, 2) == "line"
    assert json.loads((folder / "rows.jsonl").read_text().split("\n")[1])["metadata"]["source_line"] == 2
    assert D.delete_row(str(folder), row(1), 2) == "line" and len(D.read_lines(str(folder / "rows.jsonl"))) == 1
    (folder / "rows.metadata.json").write_text("{}")
    assert D.delete_row(str(folder), row(1)) == "line" and not list(folder.iterdir())
    (folder / "t.jsonl").write_text('{"type": "x"}\n{"type": "y"}\n')
    t = {"metadata": {"source_file": "t.jsonl"}}
    with pytest.raises(ValueError, match="several"):
        D.update_row(str(folder), t, {}, 2)
    assert D.update_row(str(folder), t, {"prompt": "p"}) == "file" and D.row_source(str(folder), {"source_file": "../x"}) is None
    (folder / "sub").mkdir()
    (folder / "sub" / "t.jsonl").write_text("x\n")
    with pytest.raises(ValueError, match="ambiguous"):
        D.row_source(str(folder), {"source_file": "t.jsonl"})
    with pytest.raises(ValueError, match="line 1"):
        D.read_lines(str(folder / "sub" / "t.jsonl"))
    D.append_line(str(folder / "t.jsonl"), {"a": 1})
    assert D.read_lines(str(folder / "t.jsonl"))[-1] == {"a": 1}


def test_sessions_as_files(spark, tmp_path):
    names = D.file_names(["a b", "A-B", "", "///"])
    assert names == ["a-b.jsonl", "A-B_1.jsonl", "session.jsonl", "session_1.jsonl"]
    D.write_sessions(spark.createDataFrame([(n, "{}\n") for n in names], "name string, text string"), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(names)


def test_line_breaks_are_escaped(spark, tmp_path):
    df = spark.createDataFrame([("a\u0085b c d",)], "t string")
    write_rows(df, f"file://{tmp_path}/w")
    raw = spark.read.text(f"file://{tmp_path}/w").first()[0]
    assert raw == '{"t":"a\\u0085b\\u2028c\\u2029d"}' and json.loads(raw)["t"] == "a\u0085b c d"
    assert escape_line_breaks_of(spark, "x ") == "x\\u2028"


def test_scrubbed_sessions(spark, tmp_path):
    (tmp_path / "s").mkdir()
    lines = ['{"a":  "plain"}', json.dumps({"role": "user", "content": "I am bob.lee@corp.net in /home/bob", "password": "hunter2hunter2"}), "", json.dumps({"role": "assistant", "content": "key sk-abcdefghijklmnop12345678 at /home/bob"})]
    (tmp_path / "s" / "x.jsonl").write_text("\n".join(lines))
    got = A.anonymize_sessions(trace_files(spark, f"file://{tmp_path}/s"))
    r = got.first()
    new = r.text.split("\n")
    assert new[0] == lines[0] and new[2] == "" and (r.emails, r.lines, r.changed) == (1, 3, 2)
    assert "bob" not in r.text and "hunter2" not in r.text and "sk-abc" in new[3]
    assert dict(A.anonymize_report(got).collect())["email"] == 1
    assert A.anonymize_sessions(spark.createDataFrame([("f", None)], "source_file string, text string")).first().text is None


def test_prompt_inputs(spark, tmp_path):
    assert parse_prompts('﻿Prompt,System\n"two\nlines",s\n,\n', "csv") == [{"prompt": "two\nlines", "system": "s", "github_repo": None, "follow_up_prompts": []}]
    assert [p["prompt"] for p in parse_prompts("# no\none\n\ntwo\n", "txt")] == ["one", "two"]
    assert parse_prompts('{"prompts": ["a", {"prompt": "b\\r\\nc", "github_repo": "o/r", "system": "None"}]}', "json")[1] == {"prompt": "b\nc", "system": None, "github_repo": "o/r", "follow_up_prompts": []}
    for bad, kind in (("a,b\n1,2", "csv"), ("prompt\na,b", "csv"), ("prompt,Prompt\na,b", "csv"), ("{}x", "jsonl"), ("[1]", "jsonl"), ('{"prompt": "a", "github_repo": "x"}', "jsonl"), ('{"prompt": "a", "image": "x"}', "jsonl"), ('{"prompt": "a", "follow_up_prompts": [" "]}', "jsonl"), ("[1]", "json")):
        with pytest.raises(ValueError):
            parse_prompts(bad, kind)
    with pytest.raises(ValueError):
        inline_prompts("x")
    (tmp_path / "p.jsonl").write_text('{"prompt": "f"}\n')
    df = read_prompt_inputs(spark, f"file://{tmp_path}/p.jsonl", ["i"])
    assert sorted(r.prompt for r in df.collect()) == ["f", "i"]
    write_prompt_inputs(df, f"file://{tmp_path}/o")
    assert spark.read.json(f"file://{tmp_path}/o").count() == 2


def test_resume():
    chat = lambda *said: {"messages": [{"role": r, "content": c} for r, c in said]}
    done = chat(("user", "a"), ("assistant", "x"), ("user", "b\r\nc "), ("assistant", "y"))
    assert R.completed_turns(done, ["a", "b\nc"]) and not R.completed_turns(done, ["b\nc", "a"]) and R.completed_key(done) == R.resume_key(["a", "b\nc"])
    assert R.completed_key(chat(("user", "a"), ("assistant", "API Error: no"))) is None and R.completed_key(chat(("user", "a"), ("tool", "t"))) is None
    assert R.completed_key({"prompt": "p", "response": "r"}) == "p" and R.completed_key({}) is None
    assert R.completion_key(["a"], " s ").startswith("s\n\n--- system") and R.prompt_key("a b\u2028c") == "a b\nc"
    rows = [chat(("user", "a"), ("assistant", "x")), done, chat(("system", "s"), ("user", "a"), ("assistant", "x"))]
    assert R.row_to_extend(rows, ["a", "b\nc", "d"]) == 1 and R.row_to_extend(rows, ["a", "z"]) == 0 and R.row_to_extend(rows, ["q", "z"]) is None and R.row_to_extend(rows, ["a", "b"], "s") == 2
    wrapped = '<file name="x-prompt.txt">\nhi\n</file>'
    assert R.plain_user_event({"message": {"role": "user", "content": [{"text": wrapped}, wrapped]}})["message"]["content"] == [{"text": "hi"}, "hi"]


def test_captured_context_and_display():
    a = C.captured_context("h", "1", "openai-responses", {"model": "m", "instructions": "be", "input": [{"role": "developer", "content": [{"text": "x"}]}, {"role": "user", "content": "u"}], "tools": [{"name": "f", "input_schema": {"type": "object"}}, {"type": "web"}], "temperature": 1, "api_key": "no"}, "t1")
    b = C.captured_context("h", "1", "openai-responses", {"api_key": "other"} | {"model": "m", "instructions": "be", "input": [{"role": "developer", "content": [{"text": "x"}]}], "tools": [{"name": "f", "input_schema": {"type": "object"}}, {"type": "web"}], "temperature": 1}, "t2")
    assert a["context_hash"] == b["context_hash"] and a["system"] == "be\n\nx" and "api_key" not in json.dumps(a) and a["tools"][1] == {"type": "web"}
    events = [
        {"type": "response_item", "payload": {"type": "function_call", "name": "run", "arguments": "{}"}}, {"type": "response_item", "payload": {"type": "function_call_output", "output": ""}},
        {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "t"}, {"type": "text", "text": "x" * 5000}]}}, {"type": "message", "message": {"role": "toolResult", "content": [{"type": "text", "text": "r"}]}}, 5, {"type": "odd"},
    ]
    got = C.trace_display(events)
    assert [d["kind"] for d in got] == ["tool_call", "tool_result", "thinking", "assistant", "tool_result"] and got[3]["text"].endswith("[+1000 characters]") and got[1]["text"] == "(no output)"


def test_progress(spark, tmp_path):
    f = tmp_path / "log"
    f.write_bytes('{"a": 1}\nbad\n{"b": "é'.encode())
    got, at, rest = P.tail(str(f), 0)
    assert got == [{"a": 1}]
    with open(f, "ab") as out:
        out.write(b'"}\n')
    assert P.tail(str(f), at, rest)[0] == [{"b": "é"}]
    updates = [(0, "p", "running", "t0", False, 5), (1, "p", "running", None, True, 3), (2, "p", "done", None, None, None), (3, "q", "running", "t1", False, 1), (4, "q", "running", None, False, 7)]
    state: dict = {}
    for _, key, status, start, delta, n in updates:
        state = P.upsert(state, {"prompt_id": key, "status": status, "started_at": start, "metrics_delta": bool(delta), "metrics": None if n is None else {"input_tokens": n}} if status != "done" else {"prompt_id": key, "status": "running", "metrics": None})
    assert state["p"]["metrics"]["input_tokens"] == 8 and state["p"]["started_at"] == "t0" and state["q"]["metrics"]["input_tokens"] == 7
    df = spark.createDataFrame(updates, "seq int, prompt_id string, status string, started_at string, metrics_delta boolean, input_tokens int")
    for c in P.COUNTERS[1:]:
        df = df.withColumn(c, F.lit(None).cast("double"))
    rows = {r.prompt_id: r for r in P.latest_progress(df).collect()}
    assert (rows["p"].status, rows["p"].started_at, rows["p"].input_tokens, rows["q"].input_tokens) == ("done", "t0", 8, 7)
    assert P.progress_snapshot(P.latest_progress(df)).first().input_tokens == 15
    assert P.signature(None) is None and P.signature({"input_tokens": 1}) != P.signature({"input_tokens": 2}) and P.status_text([{"type": "tool_execution_start", "toolName": "ls"}]) == "Running ls"
    log = P.EventLog()
    log.append({"x": 1})
    log.append({"x": 2})
    assert [e["seq"] for e in log.after(0)] == [1]
    log.close()
    with pytest.raises(ValueError):
        log.append({})
