"""Templates, marks, spans, alignment, and the pipeline of rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from turnmill.functions import templates as T
from turnmill.functions.intervals import minus, union
from turnmill.operators import prepare as P
from turnmill.operators.render import POLICY, CharTokenizer, selected
from turnmill.schema import TRAIN_ROW

CHAT = [
    {"role": "system", "content": "be kind"}, {"role": "user", "content": " do it "},
    {"role": "assistant", "content": "", "reasoning_content": "hm", "tool_calls": [{"id": "1", "type": "function", "function": {"name": "run", "arguments": {"cmd": "ls", "opts": ["-a", "-l"]}}}]},
    {"role": "tool", "tool_call_id": "1", "name": "run", "content": "a b"}, {"role": "assistant", "content": "done "},
]


def test_interval_algebra_against_sets():
    rng = random.Random(3)
    for _ in range(300):
        some = lambda: [(a, a + rng.randint(-1, 6)) for a in (rng.randint(0, 30) for _ in range(rng.randint(0, 6)))]
        a, b = some(), some()
        points = lambda s: {p for x, y in s for p in range(x, y)}
        assert points(union(a)) == points(a) and points(minus(a, b)) == points(a) - points(b)
        u = union(a)
        assert all(x[1] < y[0] for x, y in zip(u, u[1:]))


@pytest.mark.parametrize("name", sorted(T.RENDERERS))
def test_spans_cover_their_parts(name):
    renderer = T.RENDERERS[name]()
    plain = T.render(renderer, CHAT)
    text, spans = T.Template(renderer).spans(CHAT, [])
    assert text == plain
    answers = [text[s["source_start"] : s["source_end"]] for s in spans if s["kind"] == "final_answer"]
    assert any(a.startswith("done") for a in answers)
    assert not any("be kind" in text[s["start"] : s["end"]] for s in spans if s["kind"] != "system")
    trained = [text[a:b] for a, b in selected(spans, POLICY)]
    assert any("done" in t for t in trained) and not any("do it" in t or "a b" in t for t in trained)


def test_growth_to_blocks_and_tags():
    text, spans = T.Template(T.Qwen()).spans(CHAT, [])
    by = {s["kind"]: text[s["start"] : s["end"]] for s in spans}
    assert by["final_answer"] == "done <|im_end|>\n"
    assert by["reasoning"].startswith("<think>\nhm\n</think>") and by["tool_response"] == "<tool_response>\na b\n</tool_response>"
    assert by["tool_call"].startswith("<tool_call>") and by["tool_call"].endswith("<|im_end|>\n")
    assert [s["role"] for s in spans if s["kind"] == "tool_response"] == ["tool"]


def test_marks_of_many_and_of_escaped_text():
    n = 4000
    kinds = [("user", "user")] * n
    text = "".join(f"{i}a{'x' * (i % 7 + 1)}{i}b|" for i in range(n))
    got, spans = T.strip(text, kinds)
    assert got == "".join("x" * (i % 7 + 1) + "|" for i in range(n)) and len(spans) == n
    assert all(set(got[s["start"] : s["end"]]) == {"x"} for s in spans)
    escaped, spans = T.strip(json.dumps("0aq0b"), [("user", "user")])
    assert escaped == '"q"' and (spans[0]["start"], spans[0]["end"]) == (1, 2)


def test_reconciled_white_space():
    spans = [T.span(3, 9, "user"), T.span(12, 15, "user")]
    assert [("one  two"[s["start"] : s["end"]]) for s in T.reconcile("ab  xy  cd", [T.span(2, 8, "user")], "abxy cd") or []] is not None
    text, target = "u:  hi  |a: yes|", "u:hi|a: yes|"
    got = T.reconcile(text, [T.span(2, 8, "user"), T.span(12, 15, "final_answer")], target)
    assert [target[s["start"] : s["end"]] for s in got] == ["hi", "yes"]
    assert T.reconcile("a b", [], "ab") is None and T.reconcile("ab", spans, "ac") is None


def test_growth_of_many_blocks():
    one = "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n<think>\nt\n</think>\n\nanswer<|im_end|>\n"
    n, text, spans = 1200, "", []
    for _ in range(n):
        at = len(text)
        text += one
        spans += [T.span(at + one.index("\nt\n") + 1, at + one.index("\nt\n") + 2, "reasoning"), T.span(at + one.index("answer"), at + one.index("answer") + 6, "final_answer")]
    grown = T.grow(text, spans, ("<|im_start|>assistant\n",))
    assert len(grown) == 2 * n and all(text[s["start"] : s["end"]] == "<think>\nt\n</think>\n\nanswer<|im_end|>\n" for s in grown)


def test_inferred_spans():
    text = T.render(T.Qwen(), CHAT)
    got = [text[a:b] for a, b in T.infer(text)]
    assert got[-1] == "done <|im_end|>" and got[0].startswith("<think>")
    assert not any("<think>" in text[a:b] for a, b in T.infer(text, reasoning=False))
    turn = "<|turn>user\nq<turn|><|turn>model\nyes<|tool_response>r<tool_response|><turn|>"
    assert [turn[a:b] for a, b in T.infer(turn)] == ["yes"]
    assert T.infer("no chat") == []


def test_alignment_by_brute_force():
    ids, labels = [5, 6, 7, 8], [-100, 6, 7, -100]
    assert T.align(ids, ids, labels) == labels and T.align(ids[:3], ids, labels) == labels[:3]
    assert T.align([1, 5, 6, 7, 8, 2], ids, labels) == [-100, -100, 6, 7, -100, -100]
    assert T.align([1, 5, 6], ids, labels) == [-100, -100, 6]
    assert T.align([9, 9], ids, labels) is None
    assert T.decoded_offsets([1, 2], {1: "ab", 2: "c"}.get) == ("abc", [(0, 2), (2, 3)])


def test_options_and_fallbacks():
    with pytest.raises(ValueError, match="tools"):
        T.checked_options({"tools": []})
    seen = []

    class Picky:
        def apply_chat_template(self, messages, **kw):
            seen.append(kw)
            if "tools" in kw or any(m["role"] == "tool" for m in messages):
                raise TypeError("no")
            return "".join(p["text"] for m in messages for p in m["content"])

    out = T.render(Picky(), CHAT, [{"type": "function"}])
    assert "<tool_response name='run'>a b</tool_response>" in out and len(seen) == 5


def test_few_renders_to_trim():
    renders = 0

    def size(c):
        nonlocal renders
        renders += 1
        return 10 * len(c)

    chat = [{"role": r, "content": "x"} for _ in range(64) for r in ("user", "assistant")]
    got = T.longest_fitting(T.trim_candidates(chat), size, 180)
    assert len(got) == 18 and renders < 30
    brute = next(c for c in T.trim_candidates(chat) if 10 * len(c) <= 180)
    assert got == brute


def stored(messages, tools=()):
    from turnmill.functions.traces import stored_row

    r = stored_row({"prompt": "", "messages": messages, "tools": list(tools), "metadata": {"id": "r"}, "system": None})
    return (None, 1, r["trace_type"], r["prompt"], None, r["messages"], r["tools"], r["metadata"], None)


TOOL = {"type": "function", "function": {"name": "run", "parameters": {"type": "object", "properties": {"cmd": {"type": "string"}}, "required": ["cmd"]}}}


def test_outcomes_and_report(spark):
    long = [m for i in range(6) for m in ({"role": "user", "content": f"q{i} " + "w" * 40}, {"role": "assistant", "content": "a" * 40})]
    rows = [stored(CHAT, [TOOL]), stored(CHAT), stored([]), stored(long), stored([{"role": "user", "content": "only"}])]
    df = spark.createDataFrame(rows, TRAIN_ROW).withColumn("raw_index", F.monotonically_increasing_id())
    got = P.prepare(df, P.Settings(max_length=600, policy="trim_followups")).orderBy("raw_index").collect()
    assert [(r.status, r.reason) for r in got] == [("kept", None), ("dropped", "unsupported_tool_call"), ("dropped", "empty_messages"), ("trimmed", "oversized"), ("kept", None)]
    assert got[3].final_token_length <= 600 < got[3].token_length and got[3].messages_kept % 2 == 0 and got[1].unsupported_tool == "run" and got[0].row_id == "r"
    assert all(r.text is None for r in got if r.status == "dropped") and len(got[0].input_ids) == len(got[0].text) == got[0].token_length
    out = P.prepare(df, P.Settings(max_length=600))
    t = P.report_totals(out).first()
    assert (t.total_rows, t.formatted_rows, t.dropped_rows, t.oversized_rows, t.empty_messages) == (5, 2, 3, 1, 1)
    assert P.report_rows(out).count() == 5 and P.prepared(out).count() == 2
    with pytest.raises(Exception, match="over the limit"):
        P.prepare(df, P.Settings(max_length=600, policy="error")).collect()
    with pytest.raises(ValueError):
        P.Settings(policy="x")


def test_labels_of_prepared_rows(spark):
    df = spark.createDataFrame([stored(CHAT, [TOOL])], TRAIN_ROW)
    r = P.prepare(df).first()
    spans = [s.asDict() for s in r.spans]
    labels = P.row_labels(r.text, spans, r.input_ids, [(o.start, o.end) for o in r.offsets], POLICY)
    said = "".join(chr(x) for x in labels if x != -100)
    assert said.endswith("done <|im_end|>\n") and "a b" not in said and "do it" not in said
    bare = P.row_labels(r.text, [], r.input_ids, [(o.start, o.end) for o in r.offsets], POLICY)
    assert "done" in "".join(chr(x) for x in bare if x != -100)
    masked = spark.createDataFrame([(1, list(r.input_ids), labels), (2, [1, 2], [-100, -100]), (3, [1], [1, 2])], "raw_index bigint, input_ids array<int>, labels array<int>")
    got = {x.row: x for x in P.audit_labels(masked, lambda ids: "".join(map(chr, ids)), None).collect()}
    assert got["1"].errors == [] and got["2"].errors == ["no supervised tokens"] and got["3"].errors
    assert "\x1b[90m" in P.preview(list(r.input_ids), labels, lambda ids: "".join(map(chr, ids)))
    both = masked.where("raw_index = 1").withColumn("full_ids", F.col("input_ids")).withColumn("input_ids", F.concat(F.array(F.lit(1)), "input_ids"))
    assert list(P.align_labels(both).first().aligned) == [-100, *labels]


def test_mix_of_prepared_sources(spark):
    def table(n, word):
        return spark.createDataFrame([stored([{"role": "user", "content": f"{word}{i}"}, {"role": "assistant", "content": "a"}]) for i in range(n)], TRAIN_ROW)

    got = P.prepare_mix({"a": {"source": table(8, "x"), "percentage": 80}, "b": {"source": table(10, "y"), "percentage": 20}, "max_examples": 10})
    assert dict(got.groupBy("source_key").count().collect()) == {"a": 8, "b": 2}
    assert P.prepare_mix([table(2, "x"), table(3, "y")]).count() == 5
    with pytest.raises(ValueError):
        P.prepare_mix({"a": {"source": table(0, "x") if False else table(1, "x").limit(0), "weight": 1}, "b": {"source": table(1, "y"), "weight": 1}})


def test_call_errors():
    bad = [{"role": "assistant", "content": "", "tool_calls": [{"function": {"name": "run", "arguments": "[]"}}, {"function": {"name": "fly"}}, {}, {"function": {"name": "run", "arguments": {"cmd": 1}}}]}]
    assert len(P.tool_call_errors(bad, [TOOL])) == 4 and P.tool_call_errors(CHAT, [TOOL]) == []
    assert P.row_label({"session_id": "s", "source_file": "f"}) == "s" and P.row_label({"source_file": "f"}) == "f:1" and P.row_label({}, 7) == "7" and P.row_label({}) is None
    assert P.oversized_policy(trim=True) == "trim_followups" and P.oversized_policy(drop=False) == "keep"
    assert CharTokenizer().encode("ab")[1] == [(0, 1), (1, 2)]
