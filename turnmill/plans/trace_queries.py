"""Queries over sessions: the given conversations are written as sessions of each format, and what comes back is compared.

A session holds every turn of its conversation. An assistant's turn also thinks
(``plan N``) and calls a tool, whose result follows, so that tools, thinking and
results pass through every converter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import epoch_iso
from ..operators import anonymize as anon
from ..operators import dataset, prepare, tools, usage
from ..operators.render import POLICY, covered, select_supervised
from ..scratch import scratch
from ..sources.jsonl import convert_texts, convert_traces, scan_events, trainable, write_rows
from .queries import _SEG, ORACLES, QUERIES, _query, _t


def _json(**parts: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()]))


def _obj(**parts: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def _is(role: str) -> Column:
    return F.col("role") == role


def _block(kind: str, key: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), value.alias(key))


def _turn_no() -> Column:
    return F.col("turn").cast("string")


def _text() -> Column:
    return F.col("text")


def _given() -> Column:
    return F.concat(F.lit('{"n":'), _turn_no(), F.lit("}"))


def _plan() -> Column:
    return F.concat(F.lit("plan "), _turn_no())


def _done() -> Column:
    return F.concat(F.lit("ok "), _turn_no())


def _id() -> Column:
    return F.concat(F.lit("c"), _turn_no())


def _n() -> Column:
    return _obj(n=F.col("turn"))


def _codex_lines() -> Column:
    item = lambda **p: _json(type=F.lit("response_item"), payload=_obj(**p))
    said = item(type=F.lit("message"), role=F.col("role"), content=F.array(_block("input_text", "text", _text())))
    return F.when(_is("assistant"), F.array(
        item(type=F.lit("reasoning"), summary=F.array(_block("summary_text", "text", _plan()))), said,
        item(type=F.lit("function_call"), name=F.lit("run"), call_id=_id(), arguments=_given()), item(type=F.lit("function_call_output"), call_id=_id(), output=_done()),
    )).when(_is("user"), F.array(_json(type=F.lit("turn_context"), payload=_obj(model=F.lit("m"))), said)).otherwise(F.array(said))


def _claude_lines() -> Column:
    line = lambda kind, message: _json(type=F.lit(kind), sessionId=F.lit("s"), message=message)
    parts = [_obj(role=F.lit("assistant"), id=F.concat(F.lit("m"), _turn_no()), content=F.array(b)) for b in (_block("thinking", "thinking", _plan()), _block("text", "text", _text()))]
    use = _obj(role=F.lit("assistant"), id=F.concat(F.lit("m"), _turn_no()), content=F.array(_obj(type=F.lit("tool_use"), id=_id(), name=F.lit("run"), input=_n())))
    # pieces of one message come in another order than they are told in
    return F.when(_is("assistant"), F.array(
        line("assistant", use), line("assistant", parts[1]), line("assistant", parts[0]),
        line("user", _obj(role=F.lit("user"), content=F.array(_obj(type=F.lit("tool_result"), tool_use_id=_id(), content=_done())))),
    )).when(_is("user"), F.array(line("user", _obj(role=F.lit("user"), content=_text())))).otherwise(F.array(_json(type=F.lit("system"), sessionId=F.lit("s"), subtype=F.lit("informational"), content=_text())))


def _pi_lines() -> Column:
    line = lambda **m: _json(type=F.lit("message"), message=_obj(**m))
    text = _block("text", "text", _text())
    call = F.to_json(_obj(type=F.lit("toolCall"), id=_id(), name=F.lit("run"), arguments=_n()))
    answer = F.concat(F.lit('{"type":"message","message":{"role":"assistant","content":['), F.to_json(_block("thinking", "thinking", _plan())), F.lit(","), F.to_json(text), F.lit(","), call, F.lit("]}}"))
    lost = _json(type=F.lit("message"), message=_obj(role=F.lit("toolResult"), toolCallId=F.concat(F.lit("x"), _turn_no()), toolName=F.lit("gone"), content=F.array(_block("text", "text", F.lit("Tool gone not found")))))
    return F.when(_is("assistant"), F.array(answer, lost, line(role=F.lit("toolResult"), toolCallId=_id(), toolName=F.lit("run"), content=F.array(_block("text", "text", _done()))))).otherwise(F.array(line(role=F.col("role"), content=F.array(text))))


def _blocks_lines(head: str) -> Column:
    """Cursor and Droid: blocks in messages, results in user messages."""
    wrap = lambda role, blocks: F.concat(F.lit(head.format(role)), blocks, F.lit("]}}"))
    use = F.to_json(_obj(type=F.lit("tool_use"), id=_id(), name=F.lit("run"), input=_n()))
    text = F.to_json(_block("text", "text", _text()))
    answer = F.concat_ws(",", F.to_json(_block("thinking", "thinking", _plan())), text, use)
    result = F.to_json(_obj(type=F.lit("tool_result"), tool_use_id=_id(), content=_done()))
    return F.when(_is("assistant"), F.array(wrap("assistant", answer), wrap("user", result))).when(_is("user"), F.array(wrap("user", text))).otherwise(F.array(wrap("system", text)))


def _dialogue_lines() -> Column:
    turn = lambda who, value: F.to_json(_obj(**{"from": F.lit(who), "value": value}))
    answer = F.concat(F.lit("<think>"), _plan(), F.lit("</think>"), _text(), F.lit('<tool_call>{"name": "run", "arguments": '), _given(), F.lit("}</tool_call>"))
    result = F.concat(F.lit('<tool_response>{"tool_call_id": "'), _id(), F.lit('", "name": "run", "content": "'), _done(), F.lit('"}</tool_response>'))
    return F.when(_is("assistant"), F.array(turn("gpt", answer), turn("tool", result))).when(_is("user"), F.array(turn("human", _text()))).otherwise(F.array(turn("system", _text())))


def _agent_lines() -> Column:
    line = lambda **p: _json(type=F.lit("external_message"), **p)
    call = F.array(_obj(id=_id(), type=F.lit("function"), function=_obj(name=F.lit("run"), arguments=_given())))
    return F.when(_is("assistant"), F.array(line(role=F.lit("assistant"), content=_text(), reasoning=_plan(), tool_calls=call), line(role=F.lit("tool"), tool_call_id=_id(), name=F.lit("run"), content=_done()))).otherwise(F.array(line(role=F.col("role"), content=_text())))


def _row_lines() -> Column:
    """Messages of a training row; thinking stands inline."""
    m = lambda **p: F.to_json(_obj(**p))
    call = F.array(_obj(id=_id(), type=F.lit("function"), function=_obj(name=F.lit("run"), arguments=_given())))
    inline = F.concat(F.lit("<think>"), _plan(), F.lit("</think>"), _text())
    return F.when(_is("assistant"), F.array(m(role=F.lit("model"), content=inline, tool_calls=call), m(role=F.lit("tool"), tool_call_id=_id(), name=F.lit("run"), content=_done()))).otherwise(
        F.array(m(role=F.when(_is("system"), "developer").otherwise(F.col("role")), content=_text())))


#: format: lines of a turn, first line, what the lines are wrapped in
_FORMATS = {
    "codex": (_codex_lines, '{"type":"session_meta","payload":{"id":"%s","model_provider":"p"}}', None),
    "claude_code": (_claude_lines, '{"type":"system","sessionId":"%s","subtype":"init","model":"m"}', None),
    "pi": (_pi_lines, '{"type":"session","id":"%s","cwd":"/w"}', None),
    "openclaw": (_pi_lines, '{"type":"session","id":"%s","cwd":"/x/.openclaw"}', None),
    "cursor": (lambda: _blocks_lines('{{"role":"{}","message":{{"content":['), '{"type":"cursor_session_meta","session_id":"%s"}', None),
    "droid": (lambda: _blocks_lines('{{"type":"message","message":{{"role":"{}","content":['), '{"type":"session_start","id":"%s","cwd":"/w","version":1}', None),
    "hermes": (_dialogue_lines, None, ('{"id":"%s","traces":[', "]}")),
    "external_agent": (_agent_lines, '{"type":"external_session_meta","payload":{"id":"%s","source":"other-agent"}}', None),
    "rows": (_row_lines, None, ('{"id":"%s","messages":[', "]}")),
}


def sessions(turns: DataFrame, kind: str) -> DataFrame:
    """(source_file, text): one session a conversation in the given format."""
    lines, head, wrap = _FORMATS[kind]
    per = turns.select("conv_id", "turn", lines().alias("l")).groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "l"))), lambda x: x["l"])).alias("l"))
    name = F.col("conv_id").cast("string")
    text = F.array_join(F.col("l"), "," if wrap else "\n")
    if head:
        text = F.concat(F.replace(F.lit(head), F.lit("%s"), name), F.lit("\n"), text)
    if wrap:
        text = F.concat(F.replace(F.lit(wrap[0]), F.lit("%s"), name), text, F.lit(wrap[1]))
    return per.select(F.concat(name, F.lit(".jsonl")).alias("source_file"), text.alias("text"))


def told(rows: DataFrame) -> DataFrame:
    """(conv_id, kind, prompt, n_messages, told, tool): converted rows in one line each."""
    calls = lambda m: F.array_join(F.transform(F.coalesce(m["tool_calls"], F.array().cast("array<struct<id:string,type:string,name:string,arguments:string>>")), lambda c: F.concat(c["name"], F.regexp_replace(c["arguments"], " ", ""))), ",")
    said = F.transform("messages", lambda m: F.concat_ws("|", m["role"], m["content"], F.coalesce(m["reasoning_content"], F.lit("")), calls(m), F.coalesce(m["name"], F.lit(""))))
    tool = F.filter("tools", lambda t: t["name"] == "run")
    return rows.select(
        F.regexp_extract("source_file", r"(\d+)\.jsonl$", 1).cast("bigint").alias("conv_id"), F.col("trace_type").alias("kind"), "prompt", F.size("messages").cast("bigint").alias("n_messages"),
        F.md5(F.array_join(said, "\n")).alias("told"), F.get_json_object(F.get(tool, F.lit(0))["parameters"], "$.properties.n.type").alias("tool"),
    )


def _told_sql(kind: str, system: str = "text", tool: str = "run", answered: str = "'integer'") -> str:
    return f"""
    SELECT conv_id, '{kind}' AS kind, coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), '') AS prompt, (count(*) + count(*) FILTER (WHERE role = 'assistant'))::BIGINT AS n_messages,
           md5(string_agg(CASE role WHEN 'assistant' THEN 'assistant|' || text || '|plan ' || turn || '|run{{"n":' || turn || '}}|' || chr(10) || 'tool|ok ' || turn || '|||{tool}'
                                    WHEN 'system' THEN 'system|' || {system} || '|||' ELSE role || '|' || text || '|||' END, chr(10) ORDER BY turn)) AS told,
           CASE WHEN count(*) FILTER (WHERE role = 'assistant') > 0 THEN {answered} END AS tool
    FROM conversations GROUP BY conv_id"""


def _convert(name: str, kind: str, sql: str) -> None:
    def query(spark, sf_dir):
        return told(convert_texts(sessions(_t(spark, sf_dir, "conversations"), kind)))

    query.__name__ = query.__qualname__ = name
    _query(sql)(query)


for _kind, _shown in (("codex", "codex"), ("pi", "pi"), ("openclaw", "openclaw"), ("cursor", "cursor"), ("droid", "droid"), ("hermes", "hermes"), ("external_agent", "other-agent"), ("rows", "structured")):
    if _kind == "droid":  # system messages are no part of this format
        _sql = _told_sql("droid").replace("FROM conversations", "FROM (SELECT * FROM conversations WHERE role <> 'system')")
        _sql = f"SELECT c.conv_id, coalesce(kind, 'droid') AS kind, coalesce(prompt, '') AS prompt, coalesce(n_messages, 0) AS n_messages, coalesce(told, md5('')) AS told, tool FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN ({_sql}) USING (conv_id)"
    else:
        # rows bring their own tools, and these bring none
        _sql = _told_sql(_shown, answered="NULL::VARCHAR" if _kind == "rows" else "'integer'")
    _convert(f"convert_{_kind}", _kind, _sql)
_convert("convert_claude", "claude_code", _told_sql("claude-code", "'Notice:' || chr(10) || text", "unknown_tool"))


@_query(f"""
    SELECT count(*)::BIGINT AS rows, count(DISTINCT conv_id)::BIGINT AS files, sum(n)::BIGINT AS messages FROM (
        SELECT conv_id, count(*) + count(*) FILTER (WHERE role = 'assistant') AS n FROM conversations GROUP BY conv_id)
""")
def jsonl_round_trip(spark, sf_dir):
    """Sessions written as JSONL files of rows, listed, read and converted again."""
    path = scratch(spark, "round-trip")
    call = "struct<id:string,type:string,function:struct<name:string,arguments:string>>"
    row = f"struct<id:string,messages:array<struct<role:string,content:string,tool_calls:array<{call}>,tool_call_id:string,name:string>>>"
    rows = sessions(_t(spark, sf_dir, "conversations"), "rows").select(F.from_json("text", row).alias("r")).select("r.id", "r.messages")
    write_rows(rows, path)
    _as_jsonl(spark, path)
    back = convert_traces(spark, path)
    return back.agg(F.count("*").alias("rows"), F.count_distinct(F.get_json_object("metadata", "$.id")).alias("files"), F.sum(F.size("messages")).cast("bigint").alias("messages"))


def _as_jsonl(spark, path: str) -> None:
    """Spark's text parts under the name that sessions go by."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for s in fs.listStatus(root):
        p = s.getPath()
        if p.getName().startswith("part-"):
            fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(root, p.getName().rsplit(".", 1)[0] + ".jsonl"))


@_query("SELECT conv_id, bool_or(role = 'assistant') AS answered, true AS called FROM conversations GROUP BY conv_id HAVING bool_or(role = 'assistant')")
def trainable_rows(spark, sf_dir):
    """Converted rows with a training signal; the incomplete ones, which end in a tool's result, are told apart and kept."""
    rows = convert_texts(sessions(_t(spark, sf_dir, "conversations"), "codex"))
    kept = trainable(rows, drop_incomplete=False)
    ends = F.element_at(F.filter("messages", lambda m: m["role"].isin("assistant", "tool")), -1)["role"] == "tool"
    return kept.select(F.regexp_extract("source_file", r"(\d+)", 1).cast("bigint").alias("conv_id"), F.exists("messages", lambda m: m["role"] == "assistant").alias("answered"), ends.alias("called"))


# prepared rows


def _plain_rows(turns: DataFrame) -> DataFrame:
    """One training row a conversation, without tools."""
    m = F.to_json(_obj(role=F.col("role"), content=_text()))
    per = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", m.alias("m")))), lambda x: x["m"]), ",").alias("m"))
    name = F.col("conv_id").cast("string")
    return convert_texts(per.select(F.concat(name, F.lit(".jsonl")).alias("source_file"), F.concat(F.lit('{"id":"'), name, F.lit('","messages":['), "m", F.lit("]}")).alias("text")))


def _conv() -> Column:
    return F.col("row_id").cast("bigint").alias("conv_id")


@_query(f"""
    SELECT conv_id, string_agg({_SEG}, '' ORDER BY turn) AS text, sum(length({_SEG}))::BIGINT AS token_length,
           coalesce(sum(length(text) + 11) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS supervised, count(*)::BIGINT AS spans
    FROM conversations GROUP BY conv_id
""")
def prepare_rows(spark, sf_dir):
    """Rows rendered and marked; answers grow to the end of their block."""
    p = prepare.prepared(prepare.prepare(_plain_rows(_t(spark, sf_dir, "conversations"))))
    return p.select(_conv(), "text", F.col("token_length").cast("bigint").alias("token_length"), covered(select_supervised(F.col("spans"), POLICY)).alias("supervised"), F.size("spans").cast("bigint").alias("spans"))


_HEAD = "'<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || text || '<|eot_id|>'"


@_query(f"""
    SELECT conv_id, string_agg({_HEAD}, '' ORDER BY turn) AS text, sum(length({_HEAD}))::BIGINT AS token_length,
           coalesce(sum(length(text) + 10) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS supervised
    FROM conversations GROUP BY conv_id
""")
def prepare_headers(spark, sf_dir):
    """Another template, which trims contents."""
    from ..functions.templates import Headers

    p = prepare.prepared(prepare.prepare(_plain_rows(_t(spark, sf_dir, "conversations")), prepare.Settings(renderer=Headers())))
    return p.select(_conv(), "text", F.col("token_length").cast("bigint").alias("token_length"), covered(select_supervised(F.col("spans"), POLICY)).alias("supervised"))


@_query(f"""
    WITH c AS (SELECT conv_id, sum(length({_SEG})) AS n FROM conversations GROUP BY conv_id)
    SELECT count(*) AS total_rows, count(*) FILTER (WHERE n <= 1500) AS formatted_rows, count(*) FILTER (WHERE n > 1500) AS dropped_rows, count(*) FILTER (WHERE n > 1500) AS oversized_rows,
           max(n)::BIGINT AS max_token_length, max(n) FILTER (WHERE n <= 1500)::BIGINT AS max_final_token_length FROM c
""")
def prepare_report(spark, sf_dir):
    t = prepare.report_totals(prepare.prepare(_plain_rows(_t(spark, sf_dir, "conversations")), prepare.Settings(max_length=1500)))
    return t.select("total_rows", "formatted_rows", "dropped_rows", "oversized_rows", F.col("max_token_length").cast("bigint").alias("max_token_length"), F.col("max_final_token_length").cast("bigint").alias("max_final_token_length"))


ORACLES["prepare_trim"] = f"""
    WITH s AS (SELECT *, sum(length({_SEG})) OVER w AS upto, row_number() OVER w AS n, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later,
                      count(*) FILTER (WHERE role = 'user') OVER w AS users, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS following
               FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
    g AS (SELECT conv_id, max(upto) AS total, max(upto) FILTER (WHERE role = 'assistant' AND following = 'user' AND users > 0 AND upto <= 1500) AS best FROM s GROUP BY conv_id)
    SELECT conv_id, CASE WHEN total <= 1500 THEN 'kept' WHEN best IS NOT NULL THEN 'trimmed' ELSE 'dropped' END AS status, total::BIGINT AS token_length,
           CASE WHEN total <= 1500 THEN total ELSE best END::BIGINT AS final_token_length FROM g
"""


def prepare_trim(spark, sf_dir):
    """Rows over the limit lose follow-up turns, found by bisection over renders."""
    p = prepare.prepare(_plain_rows(_t(spark, sf_dir, "conversations")), prepare.Settings(max_length=1500, policy="trim_followups"))
    return p.select(_conv(), "status", F.col("token_length").cast("bigint").alias("token_length"), F.col("final_token_length").cast("bigint").alias("final_token_length"))


QUERIES["prepare_trim"] = prepare_trim


@_query("""
    SELECT conv_id, (length(string_agg(text, '')) + 1)::BIGINT AS tokens, length(string_agg(text, ''))::BIGINT AS labelled FROM conversations GROUP BY conv_id
""")
def align_labels(spark, sf_dir):
    """Labels of ids that a trainer has put a special token before."""
    ids = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "").alias("t"))
    chars = F.filter(F.split("t", ""), lambda c: c != "")
    full = ids.select("conv_id", F.transform(chars, lambda c: (F.pmod(F.xxhash64(c), F.lit(50000)) + 2).cast("int")).alias("full_ids"))
    rows = full.select("conv_id", F.concat(F.array(F.lit(1)), "full_ids").alias("input_ids"), "full_ids", F.col("full_ids").alias("labels"))
    a = prepare.align_labels(rows)
    return a.select("conv_id", F.size("aligned").cast("bigint").alias("tokens"), F.size(F.filter("aligned", lambda x: x != -100)).cast("bigint").alias("labelled"))


# previews


@_query("""
    SELECT conv_id, coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), NULL) AS prompt, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS response,
           count(*) FILTER (WHERE role = 'user')::INTEGER AS message_count, count(*) FILTER (WHERE role = 'assistant')::INTEGER AS tool_count FROM conversations GROUP BY conv_id
""")
def row_previews(spark, sf_dir):
    p = dataset.row_previews(convert_texts(sessions(_t(spark, sf_dir, "conversations"), "rows")))
    return p.select(F.regexp_extract("source_file", r"(\d+)", 1).cast("bigint").alias("conv_id"), "prompt", "response", "message_count", "tool_count")


@_query("SELECT count(DISTINCT conv_id) AS files, count(DISTINCT conv_id) AS rows, 0::BIGINT AS complete_rows, count(DISTINCT conv_id) AS incomplete_rows FROM conversations")
def dataset_totals(spark, sf_dir):
    """Every session ends in a tool's result or has no answer, so that none is complete."""
    return dataset.dataset_totals(convert_texts(sessions(_t(spark, sf_dir, "conversations"), "codex")))


@_query("""SELECT DISTINCT 'k' AS "column", 'int64' AS type FROM events WHERE props LIKE '{"k": %'""")
def json_features(spark, sf_dir):
    return dataset.json_features(_t(spark, sf_dir, "events").select("event_id", F.col("props").alias("raw")), ["event_id"])


@_query("""
    SELECT conv_id, kind, count(*) AS shown, sum(length(text))::BIGINT AS characters FROM (
        SELECT conv_id, unnest(CASE role WHEN 'assistant' THEN ['thinking', 'assistant', 'tool_call', 'tool_result'] ELSE [role] END) AS kind,
               unnest(CASE role WHEN 'assistant' THEN ['plan ' || turn, text, '{"n":' || turn || '}', 'ok ' || turn] ELSE [text] END) AS text FROM conversations WHERE role IN ('assistant', 'user'))
    GROUP BY conv_id, kind
""")
def display_events(spark, sf_dir):
    d = dataset.display_events(sessions(_t(spark, sf_dir, "conversations"), "codex"))
    return d.groupBy(F.regexp_extract("source_file", r"(\d+)", 1).cast("bigint").alias("conv_id"), "kind").agg(F.count("*").alias("shown"), F.sum(F.length("text")).cast("bigint").alias("characters"))


# tools


_SCHEMA = '{"type":"object","properties":{"k":{"type":"integer"}},"required":["k"]}'


@_query("""
    SELECT event_type AS tool, '{"properties": {"k": {"type": "integer"}}, "required": ["k"], "type": "object"}' AS parameters FROM events
    GROUP BY 1 HAVING bool_and(json_type(props, '$.k') IN ('UBIGINT', 'BIGINT'))
""")
def tool_schemas(spark, sf_dir):
    """Nested schemas of every tool from all its arguments, merged in parts."""
    return tools.infer_tool_schemas(_t(spark, sf_dir, "events"), "event_type", "props")


def _event_rows(spark, sf_dir) -> DataFrame:
    """A training row a user: each event is a call of the tool of its type."""
    call = _obj(id=F.col("event_id").cast("string"), type=F.lit("function"), function=_obj(name=F.col("event_type"), arguments=F.col("props")))
    m = F.to_json(_obj(role=F.lit("assistant"), content=F.lit(""), tool_calls=F.array(call)))
    tool = F.concat(F.lit('{"type":"function","function":{"name":"'), F.col("event_type"), F.lit('","parameters":' + _SCHEMA + "}}"))
    e = _t(spark, sf_dir, "events").withColumn("declared", tool)
    per = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", m.alias("m")))), lambda x: x["m"]), ",").alias("m"), F.array_join(F.sort_array(F.collect_set("declared")), ",").alias("t"))
    text = F.concat(F.lit('{"messages":['), "m", F.lit('],"tools":['), "t", F.lit("]}"))
    return convert_texts(per.select(F.concat(F.col("user_id").cast("string"), F.lit(".jsonl")).alias("source_file"), text.alias("text")))


@_query("SELECT user_id, count(*)::INTEGER AS calls, count(*) FILTER (WHERE json_type(props, '$.k') NOT IN ('UBIGINT', 'BIGINT'))::INTEGER AS errors FROM events GROUP BY user_id")
def validate_calls(spark, sf_dir):
    """Every call's arguments against the declared JSON schema."""
    v = tools.validate_tool_calls(_event_rows(spark, sf_dir))
    calls = F.aggregate("messages", F.lit(0), lambda a, m: a + F.size(m["tool_calls"]))
    return v.select(F.regexp_extract("source_file", r"(\d+)", 1).cast("bigint").alias("user_id"), calls.alias("calls"), F.size("errors").alias("errors"))


@_query("SELECT DISTINCT event_type AS name, NULL::VARCHAR AS description, '{\"properties\": {\"k\": {\"type\": \"integer\"}}, \"required\": [\"k\"], \"type\": \"object\"}' AS parameters FROM events")
def dataset_tools(spark, sf_dir):
    return dataset.dataset_tools(_event_rows(spark, sf_dir))


# usage


_KV = "json_extract_string(props, '$.k')::BIGINT"


@_query(f"""
    SELECT user_id, sum({_KV})::BIGINT AS input_tokens, count(*)::BIGINT AS output_tokens, (sum({_KV}) + count(*))::BIGINT AS total_tokens, round(sum(value), 2) AS total_cost,
           arg_min(event_type, event_id) AS model FROM events GROUP BY user_id
""")
def session_usage(spark, sf_dir):
    """Usage of sessions whose answers name tokens by the second alias, the first being 0."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    line = _json(type=F.lit("assistant"), message=_obj(model=F.col("event_type"), usage=_obj(input=F.lit(0), prompt_tokens=k, output_tokens=F.lit(1), cost=F.col("value"))))
    s = usage.session_usage(_t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("source_file"), F.col("event_id").alias("line_no"), line.alias("raw")))
    return s.select(F.col("source_file").cast("bigint").alias("user_id"), "input_tokens", "output_tokens", "total_tokens", F.round("total_cost", 2).alias("total_cost"), "model")


@_query(f"""
    WITH r AS (SELECT user_id, event_id, {_KV} AS k, sum({_KV}) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS total FROM events)
    SELECT user_id, max(total)::BIGINT AS total_tokens, arg_max(k, event_id) FILTER (WHERE k > 0)::BIGINT AS est_total_tokens FROM r GROUP BY user_id
""")
def running_usage(spark, sf_dir):
    """Usage of sessions that log a running total: the last one, and how far it grew at last."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", k.alias("k")).selectExpr("user_id", "event_id", "sum(k) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS total")
    line = _json(type=F.lit("event_msg"), payload=_obj(type=F.lit("token_count"), info=_obj(total_token_usage=_obj(total_tokens=F.col("total")))))
    s = usage.session_usage(e.select(F.col("user_id").cast("string").alias("source_file"), F.col("event_id").alias("line_no"), line.alias("raw")))
    return s.select(F.col("source_file").cast("bigint").alias("user_id"), "total_tokens", "est_total_tokens")


@_query(f"SELECT user_id, sum({_KV})::BIGINT AS input, count(*)::BIGINT AS output, (sum({_KV}) + count(*))::BIGINT AS \"totalTokens\", count(DISTINCT event_type)::BIGINT AS generations FROM events GROUP BY user_id")
def chat_usage(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    u = _json(input_tokens=k, output_tokens=F.lit(1), generation_id=F.concat(F.lit("gen-"), "event_type"))
    c = usage.chat_usage(_t(spark, sf_dir, "events").select("user_id", "event_id", u.alias("usage")), "user_id", "event_id")
    return c.select("user_id", "input", "output", "totalTokens", F.size("generation_ids").cast("bigint").alias("generations"))


# scrubbing


@_query(r"""
    SELECT doc_id, len(regexp_extract_all(text, '[a-z]+\.[0-9]+@mail[0-9]*\.example\.com'))::INTEGER AS emails,
           (len(regexp_extract_all(text, 'password=[0-9a-f]{6,}')) + len(regexp_extract_all(text, 'AKIA[A-Z0-9]{16}')))::INTEGER AS api_keys FROM documents
""")
def scrub_sessions(spark, sf_dir):
    """Every document as a user's message in a session of its own, scrubbed as nested JSON; a null text has no session and no counts."""
    line = F.when(F.col("text").isNotNull(), _json(role=F.lit("user"), content=_text()))
    s = anon.anonymize_sessions(_t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_file"), line.alias("text")))
    return s.select(F.col("source_file").cast("bigint").alias("doc_id"), *[F.when(F.col("text").isNotNull(), F.col(c)).alias(c) for c in ("emails", "api_keys")])


@_query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN (epoch_us(ts) // 1000) % 1000 = 0 THEN '' ELSE '.' || lpad(((epoch_us(ts) // 1000) % 1000)::VARCHAR, 3, '0') || '000' END || 'Z' AS at FROM events")
def epoch_millis(spark, sf_dir):
    """Timestamps given in milliseconds, as text."""
    e = _t(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts")) if dict(e.dtypes)["ts"] == "timestamp" else F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return e.select("event_id", epoch_iso(ms).alias("at"))


@_query("SELECT conv_id, count(*)::BIGINT + count(*) FILTER (WHERE role = 'assistant') * 3 + count(*) FILTER (WHERE role = 'user') + 1 AS lines FROM conversations GROUP BY conv_id")
def scanned_lines(spark, sf_dir):
    """Lines of sessions as files, numbered without the blank ones."""
    path = scratch(spark, "sessions")
    dataset.write_sessions(sessions(_t(spark, sf_dir, "conversations"), "codex").withColumnRenamed("source_file", "name").withColumn("text", F.concat("text", F.lit("\n\n"))), path)
    e = scan_events(spark, path)
    return e.groupBy(F.regexp_extract("source_file", r"(\d+)\.jsonl$", 1).cast("bigint").alias("conv_id")).agg(F.max("line_no").cast("bigint").alias("lines"))


# resume, mixes, labels, progress


@_query("""
    WITH f AS (SELECT conv_id, min(turn) AS first, max(turn) AS last FROM conversations GROUP BY conv_id),
    u AS (SELECT c.conv_id, c.turn, c.text, lead(c.turn) OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS next FROM conversations c WHERE role = 'user'),
    a AS (SELECT u.*, EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = u.conv_id AND x.role = 'assistant' AND x.turn > u.turn AND x.turn < coalesce(u.next, 1000000000)) AS answered FROM u)
    SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) || '--- follow-up ---' || chr(10) || chr(10) ORDER BY turn)) AS resume_key FROM a GROUP BY conv_id HAVING bool_and(answered)
""")
def completed_prompts(spark, sf_dir):
    """Keys of conversations whose every prompt is answered, by the predicates of a resumed run."""
    import json

    import pandas as pd

    from ..functions.resume import completed_key
    from ..functions.traces import template_messages

    def run(batches):
        for pdf in batches:
            keys = [completed_key({"messages": template_messages(m)}) for m in pdf["messages"]]
            yield pd.DataFrame({"conv_id": [int(json.loads(x)["id"]) for x in pdf["metadata"]], "key": keys})

    rows = _plain_rows(_t(spark, sf_dir, "conversations")).select("messages", "metadata").mapInPandas(run, "conv_id bigint, key string")
    return rows.where("key is not null").select("conv_id", F.md5("key").alias("resume_key"))


@_query("""
    WITH s AS (SELECT conv_id, arg_min(role, turn) = 'system' AS led FROM conversations GROUP BY conv_id), n AS (SELECT count(*) FILTER (WHERE NOT led) AS plain, count(*) FILTER (WHERE led) AS led FROM s)
    SELECT source, rows FROM (SELECT 'plain' AS source, (CASE WHEN plain > led THEN led + 1 ELSE plain END)::BIGINT AS rows FROM n UNION ALL SELECT 'led', (CASE WHEN plain > led THEN led ELSE plain END)::BIGINT FROM n)
""")
def prepared_mix(spark, sf_dir):
    """Prepared rows of two sources in equal parts: the ratio stays, the total shrinks to what both can fill."""
    rows = _plain_rows(_t(spark, sf_dir, "conversations"))
    led = F.get("messages", F.lit(0))["role"] == "system"
    m = prepare.prepare_mix({"plain": {"source": rows.where(~led), "weight": 0.5}, "led": {"source": rows.where(led), "weight": 0.5}})
    return m.groupBy(F.col("source_key").alias("source")).agg(F.count("*").alias("rows"))


_STARTS = f"SELECT *, coalesce(sum(length({_SEG})) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 13 + length(role) AS s, sum(length({_SEG})) OVER (PARTITION BY conv_id) AS total FROM conversations"


@_query(f"""
    SELECT conv_id, least(total, 300)::BIGINT AS tokens, sum(greatest(0, least(s + length(text), 300) - s)) FILTER (WHERE role = 'assistant')::BIGINT AS first,
           sum(greatest(0, s + length(text) - greatest(s, total - 300))) FILTER (WHERE role = 'assistant')::BIGINT AS last
    FROM ({_STARTS}) GROUP BY conv_id, total HAVING bool_or(role = 'assistant')
""")
def truncated_labels(spark, sf_dir):
    """Labels of rows cut to 300 tokens at either end."""
    from ..operators import render

    t = render.tokenize(render.render(_t(spark, sf_dir, "conversations")), render.CharTokenizer())
    used = lambda d, name: d.select("conv_id", F.size("labels").cast("bigint").alias("tokens"), F.size(F.filter("labels", lambda x: x != render.IGNORED)).cast("bigint").alias(name))
    return used(render.mask(t, max_length=300), "first").join(used(render.mask(t, max_length=300, keep_end=True), "last").drop("tokens"), "conv_id")


@_query(f"SELECT sum({_KV})::BIGINT AS input_tokens, count(*)::BIGINT AS output_tokens, (sum({_KV}) + count(*))::BIGINT AS total_tokens FROM events")
def merged_usage(spark, sf_dir):
    """Usage of all sessions together."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    line = _json(type=F.lit("message"), message=_obj(usage=_obj(input=k, output=F.lit(1), totalTokens=k + 1)))
    s = usage.session_usage(_t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("source_file"), F.col("event_id").alias("line_no"), line.alias("raw")))
    return usage.merged_usage(s).select("input_tokens", "output_tokens", "total_tokens")


@_query(f"""
    WITH b AS (SELECT user_id, coalesce(max(event_id) FILTER (WHERE event_type = 'view'), -1) AS base, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id)
    SELECT e.user_id::VARCHAR AS prompt_id, any_value(b.status) AS status, sum({_KV})::DOUBLE AS input_tokens FROM events e JOIN b USING (user_id) WHERE event_id >= base GROUP BY e.user_id
""")
def latest_progress(spark, sf_dir):
    """Updates by key: a ``view`` states the counters anew, all others add to them."""
    from ..streaming import progress

    e = _t(spark, sf_dir, "events")
    u = e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("prompt_id"), F.col("event_type").alias("status"), F.lit(None).cast("string").alias("started_at"), (F.col("event_type") != "view").alias("metrics_delta"),
                 F.get_json_object("props", "$.k").cast("double").alias("input_tokens"), *[F.lit(None).cast("double").alias(c) for c in progress.COUNTERS[1:]])
    return progress.latest_progress(u).select("prompt_id", "status", "input_tokens")


@_query("""
    SELECT count(*)::BIGINT AS prompts, sum(length(text))::BIGINT AS characters, sum(n)::BIGINT AS follow_ups FROM (
        SELECT conv_id, arg_min(text, turn) AS text, count(*) - 1 AS n FROM conversations WHERE role = 'user' GROUP BY conv_id)
""")
def prompt_files(spark, sf_dir):
    """Prompts written as JSONL and read back."""
    from ..operators.messages import prompts
    from ..sources.jsonl import read_prompts

    path = scratch(spark, "prompts")
    p = prompts(_t(spark, sf_dir, "conversations")).where("turn_count > 0")
    p.select("prompt", "system", F.col("follow_ups").alias("follow_up_prompts")).write.json(path + "/p.jsonl")
    return read_prompts(spark, path + "/p.jsonl").agg(F.count("*").alias("prompts"), F.sum(F.length("prompt")).cast("bigint").alias("characters"), F.sum(F.size("follow_up_prompts")).cast("bigint").alias("follow_ups"))
