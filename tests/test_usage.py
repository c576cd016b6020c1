import json

from pyspark.sql import functions as F

from turnmill.operators import usage as U


def table(spark, files):
    return spark.createDataFrame([(n, i, e if isinstance(e, str) else json.dumps(e)) for n, es in files.items() for i, e in enumerate(es, 1)], "source_file string, line_no int, raw string")


def count(total=None, last=None):
    return {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": total, "last_token_usage": last}}}


def test_sessions_of_every_kind(spark):
    use = lambda a, b: {"input_tokens": a, "output_tokens": b, "total_tokens": a + b}
    files = {
        "codex": [{"type": "session_meta", "payload": {"model_provider": "p"}}, count(use(10, 5)), count(use(30, 9), use(20, 4)), count(use(30, 9))],
        "claude": [{"type": "system", "subtype": "init", "model": "m"}, {"type": "assistant", "message": {"model": "n", "usage": {"input": 0, "prompt_tokens": 7, "output_tokens": 2}}}, {"type": "result", "total_cost_usd": 0.5}, "not json"],
        "pi": [{"type": "model_change", "provider": "q", "modelId": "z"}, {"type": "message", "message": {"usage": {"input": 3, "output": 4, "cacheRead": 5, "totalTokens": 12, "cost": {"total": 0.25}}}}],
        "rows": [{"messages": [], "provider": "r", "metadata": {"model": "k", "usage": {"input": 1, "output": 1}}, "usage": {"input": 2, "output": 3, "cost": 1}}],
        "session": [{"messages": [], "source": "cli", "model": "h", "input_tokens": 4, "output_tokens": 6, "estimated_cost_usd": 2.0}],
        "none": [{"type": "user"}],
    }
    got = {r.source_file: r for r in U.session_usage(table(spark, files)).collect()}
    c = got["codex"]
    assert (c.provider, c.input_tokens, c.output_tokens, c.total_tokens, c.est_total_tokens, c.has_token_usage, c.has_cost) == ("p", 30, 9, 39, 24, True, False)
    a = got["claude"]
    assert (a.model, a.input_tokens, a.output_tokens, a.total_tokens, a.est_total_tokens, a.total_cost, a.has_cost) == ("m", 7, 2, 9, 9, 0.5, True)
    assert (got["pi"].model, got["pi"].provider, got["pi"].cache_read_tokens, got["pi"].total_tokens, got["pi"].total_cost) == ("z", "q", 5, 12, 0.25)
    assert (got["rows"].provider, got["rows"].model, got["rows"].input_tokens, got["rows"].output_tokens, got["rows"].total_tokens, got["rows"].total_cost) == ("r", "k", 3, 4, 7, 1.0)
    assert (got["session"].model, got["session"].total_tokens, got["session"].total_cost) == ("h", 10, 2.0)
    assert (got["none"].total_tokens, got["none"].has_token_usage, got["none"].model) == (0, False, None)
    total = U.merged_usage(U.session_usage(table(spark, files))).first()
    assert (total.input_tokens, total.model, total.has_cost) == (30 + 7 + 3 + 3 + 4, "h", True)


def test_chat_usage(spark):
    rows = [(1, 0, json.dumps({"prompt_tokens": 3, "completion_tokens": 4, "completion_tokens_details": {"reasoning_tokens": 2}, "generation_id": "gen-1"})), (1, 1, json.dumps({"input": 1, "output": 1, "total_tokens": 9, "cost": 0.5, "generation_ids": ["gen-1", "gen-2"]})), (2, 0, None)]
    got = U.chat_usage(spark.createDataFrame(rows, "chat int, turn int, usage string"), "chat", "turn").collect()
    assert [(r.chat, r.input, r.output, r.reasoning, r.totalTokens, r.cost, r.generation_ids) for r in got] == [(1, 4, 5, 2, 16, 0.5, ["gen-1", "gen-2"])]
    raw = json.dumps({"id": "gen-9", "x": [{"generation_ids": ["gen-8", "no"]}, {"generation_id": "gen-9"}], "id2": "gen-7"})
    assert spark.range(1).select(U.generation_ids(F.lit(raw)).alias("g")).first().g == ["gen-9", "gen-8"]
