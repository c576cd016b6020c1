"""Token usage of sessions, from events as JSON text: all in expressions, one shuffle by file and no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBERS = tuple(
    "cacheRead cacheWrite cached_input_tokens completion_tokens input input_tokens output output_tokens prompt_tokens reasoning reasoning_output_tokens reasoning_tokens totalTokens total_tokens".split()
)
_DETAILS = "struct<cached_tokens:double,cache_write_tokens:double,reasoning_tokens:double>"
USAGE = "struct<" + ",".join(f"{n}:double" for n in _NUMBERS) + f",prompt_tokens_details:{_DETAILS},output_tokens_details:{_DETAILS},completion_tokens_details:{_DETAILS},cost:string,generation_id:string,generation_ids:array<string>>"
_SESSION = "input_tokens:double,output_tokens:double,reasoning_tokens:double,cache_read_tokens:double,cache_write_tokens:double,total_tokens:double,actual_cost_usd:double,estimated_cost_usd:double,total_cost:double"
EVENT = (
    f"struct<type:string,subtype:string,model:string,provider:string,modelId:string,source:string,messages:string,traces:string,usage:{USAGE},total_cost_usd:double,{_SESSION},"
    f"metadata:struct<model:string,model_provider:string,usage:{USAGE},{_SESSION}>,"
    f"payload:struct<type:string,model:string,model_provider:string,info:struct<total_token_usage:{USAGE},last_token_usage:{USAGE}>,{_SESSION}>,"
    f"message:struct<model:string,provider:string,usage:{USAGE}>>"
)
COUNTERS = tuple("input_tokens output_tokens reasoning_tokens cache_read_tokens cache_write_tokens total_tokens est_total_tokens".split())


def first_used(*values: Column) -> Column:
    """The first value that is neither null nor 0, else 0: a 0 falls through to the next name."""
    return F.coalesce(*[F.nullif(F.coalesce(v, F.lit(0.0)), F.lit(0.0)) for v in values], F.lit(0.0)).cast("bigint")


def cost_of(usage: Column) -> Column:
    """A number, or the total of an object."""
    return F.coalesce(F.get_json_object(usage["cost"], "$.total"), usage["cost"]).try_cast("double")


def counters(u: Column) -> Column:
    """STRUCT of the counters of one usage object under any of the names providers use; ``seen`` tells whether it counts tokens at all."""
    details = u["prompt_tokens_details"]
    total = first_used(u["totalTokens"], u["total_tokens"])
    return F.struct(
        first_used(u["input"], u["prompt_tokens"], u["input_tokens"]).alias("input_tokens"), first_used(u["output"], u["completion_tokens"], u["output_tokens"]).alias("output_tokens"),
        first_used(u["reasoning"], u["reasoning_tokens"], u["reasoning_output_tokens"], u["output_tokens_details"]["reasoning_tokens"], u["completion_tokens_details"]["reasoning_tokens"]).alias("reasoning_tokens"),
        first_used(u["cacheRead"], u["cached_input_tokens"], details["cached_tokens"]).alias("cache_read_tokens"), first_used(u["cacheWrite"], details["cache_write_tokens"]).alias("cache_write_tokens"),
        total.alias("total_tokens"), total.alias("est_total_tokens"), cost_of(u).alias("cost"), (F.coalesce(*[u[n] for n in _NUMBERS]).isNotNull() | details.isNotNull()).alias("seen"),
    )


def session_counters(s: Column) -> Column:
    """The same of a session's own totals: actual before estimated before plain cost."""
    n = lambda k: first_used(s[k])
    total = first_used(s["total_tokens"], F.coalesce(s["input_tokens"], F.lit(0.0)) + F.coalesce(s["output_tokens"], F.lit(0.0)))
    return F.struct(
        *[n(k).alias(k) for k in COUNTERS[:5]], total.alias("total_tokens"), total.alias("est_total_tokens"),
        F.coalesce(s["actual_cost_usd"], s["estimated_cost_usd"], s["total_cost"]).alias("cost"), F.coalesce(s["input_tokens"], s["output_tokens"], s["total_tokens"]).isNotNull().alias("seen"),
    )


def _cost_only(cost: Column) -> Column:
    return F.struct(*[F.lit(0).cast("bigint").alias(k) for k in COUNTERS], cost.alias("cost"), F.lit(False).alias("seen"))


def usage_events(events: DataFrame) -> DataFrame:
    """(source_file, line_no, kind, model, provider, c, total, last) of (source_file, line_no, raw): what each event adds.

    ``total`` and ``last`` are the running and the latest usage that one format logs. Lines that are no JSON object add nothing.
    """
    e = F.from_json("raw", EVENT)
    t = events.select("source_file", "line_no", e.alias("e")).where("e is not null")
    kind = (
        F.when(F.col("e.traces").isNotNull() & F.col("e.metadata").isNotNull(), "session_meta").when(F.col("e.messages").isNotNull() & (F.col("e.source") == "cli"), "session")
        .when(F.col("e.messages").isNotNull(), "row").when(F.col("e.type").endswith("_session_meta"), "header").when((F.col("e.type") == "event_msg") & (F.col("e.payload.type") == "token_count"), "count")
        .otherwise(F.col("e.type"))
    )
    t = t.withColumn("kind", kind)
    k = F.col("kind")
    name = lambda *cols: F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])
    col = F.col
    model = F.when(k == "row", name(col("e.metadata.model"), col("e.model"))).when(k.isin("assistant", "message"), name(col("e.message.model"))).when(k == "header", name(col("e.payload.model"))).when(
        k == "session_meta", name(col("e.metadata.model"))).when(k == "model_change", name(col("e.modelId"))).when((k == "session") | ((k == "system") & (col("e.subtype") == "init")), name(col("e.model")))
    provider = F.when(k == "row", name(col("e.provider"), col("e.metadata.model_provider"))).when(k == "message", name(col("e.message.provider"))).when(
        k.isin("header", "session_meta"), name(col("e.payload.model_provider"), col("e.metadata.model_provider"))).when(k == "model_change", name(col("e.provider")))
    adds = F.array_compact(F.array(
        F.when((k == "row") & col("e.metadata.usage").isNotNull(), counters(col("e.metadata.usage"))), F.when(k.isin("row", "result") & col("e.usage").isNotNull(), counters(col("e.usage"))),
        F.when(k.isin("assistant", "message") & col("e.message.usage").isNotNull(), counters(col("e.message.usage"))), F.when(k == "session_meta", session_counters(col("e.metadata"))),
        F.when(k == "header", session_counters(col("e.payload"))), F.when(k == "session", session_counters(col("e"))),
        F.when((k == "result") & col("e.total_cost_usd").isNotNull(), _cost_only(col("e.total_cost_usd"))),
    ))
    info = lambda f: F.when((k == "count") & col(f"e.payload.info.{f}").isNotNull(), counters(col(f"e.payload.info.{f}")))
    return t.select("source_file", "line_no", "kind", model.alias("model"), provider.alias("provider"), adds.alias("adds"), info("total_token_usage").alias("total"), info("last_token_usage").alias("last"))


_HAS = "({0}.input_tokens <> 0 OR {0}.output_tokens <> 0 OR {0}.reasoning_tokens <> 0 OR {0}.cache_read_tokens <> 0 OR {0}.total_tokens <> 0)"


def session_usage(events: DataFrame) -> DataFrame:
    """(source_file, model, provider, COUNTERS, total_cost, has_token_usage, has_cost) of every file of (source_file, line_no, raw).

    The first model and provider count. Where a running total is logged the last one
    replaces the sums, and the estimate is the last usage that isn't empty: the
    latest one logged, or how far the total has grown. Totals that no event gives
    are sums of the parts.
    """
    w = "(PARTITION BY source_file ORDER BY line_no)"
    t = usage_events(events)
    grown = ", ".join(f"'{c}', greatest(0L, total.{c} - before.{c})" for c in COUNTERS)
    t = t.selectExpr("*", f"lag(total, 1) IGNORE NULLS OVER {w} AS before")
    t = t.selectExpr("*", f"CASE WHEN before IS NULL THEN total WHEN total IS NOT NULL THEN named_struct({grown}, 'cost', total.cost, 'seen', true) END AS grown")
    t = t.selectExpr("*", f"CASE WHEN {_HAS.format('last')} THEN last WHEN {_HAS.format('grown')} THEN grown END AS estimate")
    # one row an addition; an event without one still carries its model, provider and totals
    t = t.select("source_file", "line_no", "model", "provider", "total", "last", "estimate", F.posexplode_outer("adds").alias("place", "c"))
    head = "coalesce(place, 0) = 0"
    agg = [F.min_by("model", F.expr("CASE WHEN model IS NOT NULL THEN line_no END")).alias("model"), F.min_by("provider", F.expr("CASE WHEN provider IS NOT NULL THEN line_no END")).alias("provider")]
    agg += [F.sum(F.expr(f"coalesce(c.{k}, 0) + CASE WHEN {head} THEN coalesce(last.{k}, 0) ELSE 0 END" if k != "est_total_tokens" else "coalesce(c.est_total_tokens, 0)")).alias(k) for k in COUNTERS]
    agg += [
        F.coalesce(F.sum("c.cost"), F.lit(0.0)).alias("total_cost"), F.coalesce(F.bool_or(F.coalesce("c.seen", F.lit(False)) | F.col("total").isNotNull() | F.col("last").isNotNull()), F.lit(False)).alias("has_token_usage"),
        (F.count("c.cost") > 0).alias("has_cost"), F.max_by("total", F.expr("CASE WHEN total IS NOT NULL THEN line_no END")).alias("end"), F.max_by("estimate", F.expr("CASE WHEN estimate IS NOT NULL THEN line_no END")).alias("estimate"),
    ]
    s = t.groupBy("source_file").agg(*agg)
    parts = "({0}input_tokens + {0}output_tokens + {0}reasoning_tokens + {0}cache_read_tokens)"
    s = s.withColumns({k: F.expr(f"coalesce(end.{k}, {k})") for k in ("input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens")} | {"total_tokens": F.expr("coalesce(nullif(end.total_tokens, 0), total_tokens)")})
    s = s.withColumn("est_total_tokens", F.expr(f"coalesce(nullif(estimate.total_tokens, 0), {parts.format('estimate.')}, est_total_tokens)"))
    s = s.withColumn("total_tokens", F.expr(f"CASE WHEN has_token_usage AND total_tokens = 0 THEN {parts.format('')} + cache_write_tokens ELSE total_tokens END"))
    s = s.withColumn("est_total_tokens", F.expr("CASE WHEN has_token_usage AND est_total_tokens = 0 THEN total_tokens ELSE est_total_tokens END"))
    return s.select("source_file", "model", "provider", *COUNTERS, "total_cost", "has_token_usage", "has_cost")


def merged_usage(sessions: DataFrame, by: str | None = None, order: str = "source_file") -> DataFrame:
    """Sums of ``session_usage`` rows; the last non-empty model and provider count."""
    agg = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in ("model", "provider")]
    agg += [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*COUNTERS, "total_cost")] + [F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("has_token_usage", "has_cost")]
    return (sessions.groupBy(by) if by else sessions).agg(*agg)


def chat_usage(calls: DataFrame, by: str, order: str, usage_col: str = "usage") -> DataFrame:
    """(by, input, output, reasoning, cacheRead, cacheWrite, totalTokens, cost, generation_ids) of JSON usages, one a call.

    Reasoning is part of the output here: a missing total is input and output. Ids
    are distinct, in the order of their calls.
    """
    u = F.from_json(usage_col, USAGE)
    t = calls.select(by, F.col(order).alias("o"), u.alias("u")).where("u is not null").select(by, "o", counters(F.col("u")).alias("c"), F.filter(F.concat(F.array("u.generation_id"), F.coalesce("u.generation_ids", F.array())), lambda g: F.trim(g) != "").alias("g"))
    total = F.when(F.col("c.total_tokens") != 0, F.col("c.total_tokens")).otherwise(F.col("c.input_tokens") + F.col("c.output_tokens"))
    ids = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("o", "g"))), lambda x: x["g"])))  # calls of one chat
    return t.groupBy(by).agg(
        F.sum("c.input_tokens").alias("input"), F.sum("c.output_tokens").alias("output"), F.sum("c.reasoning_tokens").alias("reasoning"), F.sum("c.cache_read_tokens").alias("cacheRead"),
        F.sum("c.cache_write_tokens").alias("cacheWrite"), F.sum(total).alias("totalTokens"), F.sum("c.cost").alias("cost"), ids.alias("generation_ids"),
    )


def generation_ids(raw: Column) -> Column:
    """Distinct generation ids anywhere in JSON text, in order."""
    named = F.regexp_extract_all(raw, F.lit(r'"(?:id|generation_id)"\s*:\s*"(gen-[^"]*)"'), F.lit(1))
    listed = F.flatten(F.transform(F.regexp_extract_all(raw, F.lit(r'"generation_ids"\s*:\s*\[([^\]]*)\]'), F.lit(1)), lambda x: F.regexp_extract_all(x, F.lit('"(gen-[^"]*)"'), F.lit(1))))
    return F.array_distinct(F.concat(named, listed))
