"""Registered queries of the core library and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import covered, merge_spans, pair, subtract_spans
from ..functions.text import micros_iso
from ..operators import anonymize as anon
from ..operators import messages as msg
from ..operators import mixing_plan, profile, render, tools

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SEG = "'<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_COMPLETE = "SELECT conv_id, coalesce(arg_max(role, turn) FILTER (WHERE role IN ('assistant', 'model', 'tool')) <> 'tool', false) AS complete FROM conversations GROUP BY conv_id"


@_query(f"""
    SELECT conv_id, string_agg({_SEG}, '' ORDER BY turn) AS text, count(*) AS turns,
           coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS supervised, sum(length({_SEG}))::BIGINT AS tokens
    FROM conversations GROUP BY conv_id
    HAVING coalesce(arg_max(role, turn) FILTER (WHERE role IN ('assistant', 'model', 'tool')) <> 'tool', false)
       AND bool_or(role IN ('assistant', 'model') AND {_STRIP.format('text')} <> '')
""")
def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete conversations with a training signal, rendered, with the characters trained on. One shuffle by conversation."""
    turns = _t(spark, sf_dir, "conversations")
    keep = msg.trace_is_complete(turns).where("complete").join(msg.training_signal(turns).where("signal"), "conv_id").select("conv_id")
    r = render.supervised(render.render(turns)).join(keep, "conv_id", "left_semi")
    return r.select("conv_id", "text", F.size("spans").cast("bigint").alias("turns"), covered(F.col("supervised")).alias("supervised"), F.length("text").cast("bigint").alias("tokens"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["conversation_turns"](spark, sf_dir)


@_query(_COMPLETE)
def trace_complete(spark, sf_dir):
    return msg.trace_is_complete(_t(spark, sf_dir, "conversations"))


@_query(f"SELECT conv_id, bool_or(role IN ('assistant', 'model') AND {_STRIP.format('text')} <> '') AS signal FROM conversations GROUP BY conv_id")
def training_signal(spark, sf_dir):
    return msg.training_signal(_t(spark, sf_dir, "conversations"))


_MERGE = """
    WITH m AS (SELECT *, CASE WHEN role = 'assistant' AND lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'assistant' THEN 0 ELSE 1 END AS opens FROM {}),
    r AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM m)
    SELECT conv_id, min(turn) AS turn, any_value(role) AS role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content, count(*) AS merged FROM r GROUP BY conv_id, run
"""


@_query(_MERGE.format("conversations"))
def merge_assistant(spark, sf_dir):
    return msg.merge_assistant(_t(spark, sf_dir, "conversations"))


@_query(_MERGE.format("(SELECT * REPLACE (CASE WHEN role = 'user' THEN 'assistant' ELSE role END AS role) FROM conversations)"))
def merge_assistant_runs(spark, sf_dir):
    """Users count as assistants here, as the table has no runs of its own."""
    role = F.when(F.col("role") == "user", "assistant").otherwise(F.col("role"))
    return msg.merge_assistant(_t(spark, sf_dir, "conversations").withColumn("role", role))


@_query(f"SELECT conv_id, string_agg({_SEG}, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def render_chat(spark, sf_dir):
    return render.render(_t(spark, sf_dir, "conversations")).select("conv_id", "text")


@_query(f"""
    SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN 'final_answer' ELSE role END AS kind, s::INTEGER AS start, (s + length(text))::INTEGER AS "end"
    FROM (SELECT *, coalesce(sum(length({_SEG})) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 13 + length(role) AS s FROM conversations)
""")
def supervised_spans(spark, sf_dir):
    return render.turn_spans(_t(spark, sf_dir, "conversations")).drop("seg")


def _policy_sql(limit: int, trim: bool) -> str:
    best = "max(upto) FILTER (WHERE fits)" if trim else "NULL::BIGINT"
    return f"""
    WITH s AS (SELECT *, sum(length({_SEG})) OVER w AS upto, count(*) FILTER (WHERE role = 'assistant') OVER w AS answers, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n,
                      lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS following
               FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
    f AS (SELECT *, (following IS NULL OR following = 'user') AND answers > 0 AND upto <= {limit} AS fits FROM s),
    g AS (SELECT conv_id, max(upto) AS total, max(n) AS turns, {best} AS best, {'max(n) FILTER (WHERE fits)' if trim else 'NULL::BIGINT'} AS best_n FROM f GROUP BY conv_id)
    SELECT conv_id, CASE WHEN total <= {limit} THEN 'kept' WHEN best IS NOT NULL THEN 'trimmed' ELSE 'dropped' END AS status,
           CASE WHEN total > {limit} THEN 'oversized' END AS reason, total::BIGINT AS token_length,
           CASE WHEN total <= {limit} THEN total WHEN best IS NOT NULL THEN best ELSE 0 END::BIGINT AS final_token_length,
           CASE WHEN total <= {limit} THEN turns WHEN best IS NOT NULL THEN best_n ELSE 0 END::BIGINT AS keep_turns
    FROM g"""


@_query(_policy_sql(1500, True))
def trim_followups(spark, sf_dir):
    return render.apply_length_policy(_t(spark, sf_dir, "conversations"), 1500, "trim_followups")


@_query(_policy_sql(1500, False))
def oversized_drop(spark, sf_dir):
    return render.apply_length_policy(_t(spark, sf_dir, "conversations"), 1500, "drop")


@_query(f"SELECT conv_id, sum(length({_SEG}))::BIGINT AS token_length, sum(length({_SEG})) <= 2000 AS fits FROM conversations GROUP BY conv_id")
def fits_context(spark, sf_dir):
    return render.row_fits_context(_t(spark, sf_dir, "conversations"), 2000)


@_query(f"""
    SELECT conv_id, tokens, supervised, supervised * 10000 // tokens AS ratio_bp FROM (
        SELECT conv_id, sum(length({_SEG}))::BIGINT AS tokens, coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS supervised FROM conversations GROUP BY conv_id)
""")
def label_stats(spark, sf_dir):
    return render.label_stats(_t(spark, sf_dir, "conversations"))


@_query("""
    SELECT p.policy, sum(length(text)) FILTER (WHERE list_contains(p.roles, role))::BIGINT AS supervised
    FROM conversations, (VALUES ('answers', ['assistant']), ('answers_user', ['assistant', 'user']), ('all', ['assistant', 'user', 'system'])) p(policy, roles) GROUP BY p.policy
""")
def policy_matrix(spark, sf_dir):
    r = render.render(_t(spark, sf_dir, "conversations"))
    flags = {"answers": {}, "answers_user": {"user": True}, "all": {"user": True, "system": True}}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("policy"), covered(render.select_supervised(F.col("spans"), render.POLICY | f)).alias("n")) for k, f in flags.items()]))
    return r.select(each.alias("p")).groupBy("p.policy").agg(F.sum("p.n").alias("supervised"))


@_query(f"""
    SELECT conv_id, sum(length({_SEG}))::BIGINT AS tokens, coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS supervised,
           CASE WHEN coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) = 0 THEN 'no supervised tokens' ELSE '' END AS issues
    FROM conversations GROUP BY conv_id
""")
def token_labels(spark, sf_dir):
    """Labels of every conversation by a character tokenizer, with what the audit finds."""
    masked = render.mask(render.tokenize(render.render(_t(spark, sf_dir, "conversations")), render.CharTokenizer()), keep_all=True)
    a = render.audit(masked, None)
    return a.select(F.col("row").alias("conv_id"), F.col("tokens").cast("bigint").alias("tokens"), F.col("supervised").cast("bigint").alias("supervised"), F.array_join("issues", "; ").alias("issues"))


_INTERVALS = "SELECT l_orderkey, (l_linenumber * 10)::INTEGER AS s, (l_linenumber * 10 + l_quantity)::INTEGER AS e FROM lineitem"
_UNION = f"""
    WITH i AS ({_INTERVALS}), m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM i),
    g AS (SELECT *, sum(opens) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM m),
    u AS (SELECT l_orderkey, run, min(s) AS s, max(e) AS e FROM g GROUP BY l_orderkey, run)
"""


def _intervals(spark, sf_dir):
    start = F.col("l_linenumber") * 10
    return _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(pair(start, start + F.col("l_quantity"))).alias("spans"))


@_query(_UNION + "SELECT l_orderkey, count(*) AS spans, sum(e - s)::BIGINT AS covered FROM u GROUP BY l_orderkey")
def span_merge(spark, sf_dir):
    m = _intervals(spark, sf_dir).select("l_orderkey", merge_spans(F.col("spans")).alias("m"))
    return m.select("l_orderkey", F.size("m").cast("bigint").alias("spans"), covered(F.col("m")).alias("covered"))


@_query(_UNION + """
    SELECT l_orderkey, count(*) FILTER (WHERE b > a) AS spans, coalesce(sum(b - a) FILTER (WHERE b > a), 0)::BIGINT AS covered
    FROM (SELECT l_orderkey, greatest(u.s, k.a) AS a, least(u.e, k.b) AS b FROM u, (VALUES (0, 15), (35, 50), (60, 1000000)) k(a, b)) GROUP BY l_orderkey
""")
def span_subtract(spark, sf_dir):
    cut = F.array(pair(F.lit(15), F.lit(35)), pair(F.lit(50), F.lit(60)))
    m = _intervals(spark, sf_dir).select("l_orderkey", subtract_spans(F.col("spans"), cut).alias("m"))
    return m.select("l_orderkey", F.size("m").cast("bigint").alias("spans"), covered(F.col("m")).alias("covered"))


_KEYED = f"SELECT conv_id, string_agg({_STRIP.format('text')}, ' --- follow-up --- ' ORDER BY turn) AS resume_key, count(*) AS turn_count FROM conversations WHERE role = 'user' GROUP BY conv_id"


@_query(f"SELECT conv_id, turn_count, resume_key FROM ({_KEYED})")
def prompt_turns(spark, sf_dir):
    p = msg.prompts(_t(spark, sf_dir, "conversations")).where("turn_count > 0")
    return p.select("conv_id", "turn_count", msg.resume_key(F.col("prompt"), F.col("follow_ups")).alias("resume_key"))


@_query(f"SELECT resume_key, min(conv_id) AS conv_id, count(*) AS n FROM ({_KEYED}) GROUP BY resume_key")
def unique_prompts(spark, sf_dir):
    return msg.unique_prompts(msg.prompts(_t(spark, sf_dir, "conversations")))


@_query(f"""
    WITH k AS ({_KEYED}), c AS ({_COMPLETE})
    SELECT conv_id, resume_key FROM k WHERE resume_key NOT IN (SELECT resume_key FROM k JOIN c USING (conv_id) WHERE complete)
""")
def resume_pending(spark, sf_dir):
    """Prompts that no complete conversation has answered."""
    turns = _t(spark, sf_dir, "conversations")
    return msg.pending_prompts(msg.prompts(turns), msg.trace_is_complete(turns))


@_query("SELECT event_id, user_id, event_type FROM events QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)")
def adjacent_dedup(spark, sf_dir):
    return msg.drop_adjacent_duplicates(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type"]).select("event_id", "user_id", "event_type")


@_query("""
    WITH s AS (SELECT conv_id, '|' || string_agg(md5(role || chr(31) || text), '|' ORDER BY turn) || '|' AS sig, count(*) AS n_turns FROM conversations GROUP BY conv_id)
    SELECT conv_id, n_turns FROM s a WHERE NOT EXISTS (
        SELECT 1 FROM s b WHERE b.conv_id <> a.conv_id AND contains(b.sig, a.sig) AND (b.n_turns > a.n_turns OR (b.n_turns = a.n_turns AND b.conv_id < a.conv_id)))
""")
def dedupe_containment(spark, sf_dir):
    return msg.dedupe_contained(_t(spark, sf_dir, "conversations"))


@_query("""
    SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE text END AS content,
           CASE WHEN role = 'assistant' THEN 'plan ' || turn END AS reasoning_content FROM conversations
""")
def think_split(spark, sf_dir):
    """Assistant turns get an inline block first, as the table has none."""
    turns = _t(spark, sf_dir, "conversations")
    tagged = F.when(F.col("role") == "assistant", F.concat(F.lit("<think> plan "), F.col("turn").cast("string"), F.lit("\n</think>"), F.col("text"))).otherwise(F.col("text"))
    return msg.split_inline_thinking(turns.withColumn("text", tagged))


@_query("SELECT event_type, count(*) AS calls, count(*) FILTER (WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT')) AS valid FROM events GROUP BY event_type")
def tool_args_valid(spark, sf_dir):
    """Arguments of every call against the declared schema."""
    tool = F.array(F.struct(F.col("event_type").alias("name"), F.lit('{"type":"object","properties":{"k":{"type":"integer"}},"required":["k"]}').alias("parameters")))
    errors = F.pandas_udf(tools.argument_errors, "array<string>")("event_type", "props", tool)
    return _t(spark, sf_dir, "events").withColumn("e", errors).groupBy("event_type").agg(F.count("*").alias("calls"), F.count_if(F.size("e") == 0).alias("valid"))


@_query("""
    WITH k AS (SELECT event_type AS tool, unnest(json_keys(props)) AS key, props FROM events), n AS (SELECT event_type AS tool, count(*) AS calls FROM events GROUP BY 1)
    SELECT tool, key, calls, count(*) AS seen, count(*) = calls AS required,
           string_agg(DISTINCT CASE json_type(props, '$.' || key) WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' ELSE 'object' END, ',') AS types
    FROM k JOIN n USING (tool) GROUP BY tool, key, calls
""")
def tool_schema_infer(spark, sf_dir):
    return tools.observed_keys(_t(spark, sf_dir, "events"), "event_type", "props")


_K = "json_extract_string(props, '$.k')::BIGINT"


@_query(f"""
    SELECT user_id, count(*) AS calls, sum({_K})::BIGINT AS input_tokens, sum({_K} + CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS total_tokens,
           arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id
""")
def usage_totals(spark, sf_dir):
    return profile.usage_totals(_t(spark, sf_dir, "events"))


@_query(f"""
    WITH d AS (SELECT user_id, ts, event_id, greatest(0, {_K} - lag({_K}) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS d, lag({_K}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
    SELECT user_id, coalesce(sum(d), 0)::BIGINT AS delta, arg_max(d, (ts, event_id)) FILTER (WHERE d > 0)::BIGINT AS last_delta FROM d GROUP BY user_id
""")
def usage_delta(spark, sf_dir):
    return profile.usage_delta(_t(spark, sf_dir, "events"))


@_query("""
    WITH v AS (SELECT 'event_type' AS "column", event_type::VARCHAR AS value FROM events UNION ALL SELECT 'user_id', user_id::VARCHAR FROM events),
    c AS (SELECT "column", value, count(*) AS "count" FROM v GROUP BY ALL),
    t AS (SELECT "column", coalesce(sum("count") FILTER (WHERE value IS NOT NULL), 0)::BIGINT AS present, coalesce(sum("count") FILTER (WHERE value IS NULL), 0)::BIGINT AS missing FROM c GROUP BY 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY "count" DESC, coalesce(value, 'null')) AS rank FROM c)
    SELECT "column", present, missing, coalesce(value, 'null') AS value, "count", rank FROM r JOIN t USING ("column") WHERE rank <= 5
""")
def column_stats(spark, sf_dir):
    return profile.column_statistics(_t(spark, sf_dir, "events"), ["event_type", "user_id"])


@_query("SELECT doc_id, lang, source, n_chars FROM documents WHERE contains(lower(text), 'the') ORDER BY doc_id LIMIT 20 OFFSET 10")
def search_page(spark, sf_dir):
    return profile.search_page(_t(spark, sf_dir, "documents"), "the", "text", "doc_id", 10, 20).select("doc_id", "lang", "source", "n_chars")


_QUOTA = """
    WITH p AS (SELECT coalesce(source, '') AS source, count(*) AS available FROM documents GROUP BY 1), t AS (SELECT *, sum(available) OVER () AS n FROM p),
    q AS (SELECT source, available, available * 100 // n AS low, available * 100 % n AS rest FROM t), r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, source) AS r, 100 - sum(low) OVER () AS more FROM q),
    quota AS (SELECT source, available, (low + CASE WHEN r <= more THEN 1 ELSE 0 END)::BIGINT AS quota FROM r)
"""


@_query(_QUOTA + "SELECT source, available, quota FROM quota")
def mix_quota(spark, sf_dir):
    return mixing_plan.proportional_quotas(_t(spark, sf_dir, "documents"), 100)


@_query(_QUOTA + f"""
    SELECT doc_id, d.source FROM documents d JOIN quota q ON coalesce(d.source, '') = q.source
    QUALIFY row_number() OVER (PARTITION BY q.source ORDER BY md5('{mixing_plan.SEED}:' || doc_id), doc_id) <= q.quota
""")
def mix_sample(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return mixing_plan.sample_quotas(docs, mixing_plan.proportional_quotas(docs, 100)).select("doc_id", "source")


@_query(f"""
    WITH e AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '{anon.EMAIL}'), lambda x: lower(x)),
               lambda x: split_part(x, '@', 2) NOT IN ('example.com', 'example.net', 'example.org') AND NOT ends_with(x, '.example')) AS found FROM documents)
    SELECT doc_id, len(found)::BIGINT AS emails, len(list_distinct(found))::BIGINT AS people FROM e WHERE len(found) > 0
""")
def anonymize_email(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").where(F.contains("text", F.lit("@"))).select("doc_id", anon.emails(F.col("text")).alias("found")).where(F.size("found") > 0)
    return d.select("doc_id", F.size("found").cast("bigint").alias("emails"), F.size(F.array_distinct("found")).cast("bigint").alias("people"))


@_query()
def anonymize_documents(spark, sf_dir):
    return anon.anonymize(_t(spark, sf_dir, "documents"))


@_query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@_query("""
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || 'Z' AS at FROM events
""")
def timestamp_norm(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) if dict(e.dtypes)["ts"] == "timestamp" else F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return e.select("event_id", micros_iso(micros).alias("at"))


@_query(r"SELECT count(*) AS rows, count(*) FILTER (WHERE NOT regexp_matches(text, '\S')) AS blank, sum(length(text))::BIGINT AS characters, sum(length(text) - length(replace(text, chr(10), '')))::BIGINT AS lines FROM documents")
def docs_card(spark, sf_dir):
    return profile.row_counts(_t(spark, sf_dir, "documents"))
