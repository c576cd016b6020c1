"""Conversations: filters, projections and neighbour-dependent rewrites over (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_role, resume_key, split_thinking, strip_ws

_ANSWERS = "('assistant', 'model', 'tool')"


def trace_is_complete(turns: DataFrame) -> DataFrame:
    """(conv_id, complete): the last assistant, model or tool turn isn't a tool's; without any it is false. One shuffle."""
    last = F.expr(f"max_by(role, turn) FILTER (WHERE role IN {_ANSWERS})")
    return turns.groupBy("conv_id").agg(F.coalesce(last != "tool", F.lit(False)).alias("complete"))


def training_signal(turns: DataFrame) -> DataFrame:
    """(conv_id, signal): some assistant or model turn has text."""
    has = F.col("role").isin("assistant", "model") & (strip_ws(F.col("text")) != "")
    return turns.groupBy("conv_id").agg(F.coalesce(F.bool_or(has), F.lit(False)).alias("signal"))


def merge_assistant(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, content, merged): runs of assistant turns as one, joined by a blank line."""
    w = "(PARTITION BY conv_id ORDER BY turn)"
    marked = turns.selectExpr("*", f"CASE WHEN role = 'assistant' AND lag(role) OVER {w} = 'assistant' THEN 0 ELSE 1 END AS opens")
    runs = marked.selectExpr("*", "sum(opens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run")
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    out = runs.groupBy("conv_id", "run").agg(F.min("turn").alias("turn"), F.any_value("role").alias("role"), parts.alias("p"))
    return out.select("conv_id", "turn", "role", F.array_join(F.transform("p", lambda p: p["text"]), "\n\n").alias("content"), F.size("p").cast("bigint").alias("merged"))


def drop_adjacent_duplicates(rows: DataFrame, key: str, order: list[str], same: list[str]) -> DataFrame:
    """Rows that differ in ``same`` from the row before them, within ``key`` by ``order``."""
    by = f"(PARTITION BY {key} ORDER BY {', '.join(order)})"
    sig = f"struct({', '.join(same)})"
    marked = rows.selectExpr("*", f"{sig} <=> lag({sig}) OVER {by} AS __same")
    return marked.where(~F.coalesce("__same", F.lit(False))).drop("__same")


def prompts(turns: DataFrame) -> DataFrame:
    """(conv_id, prompt, follow_ups, system, turn_count) of each conversation; user turns make the prompt and what follows."""
    users = F.sort_array(F.expr("collect_list(struct(turn, text)) FILTER (WHERE role = 'user')"))
    system = F.expr("min_by(text, turn) FILTER (WHERE role IN ('system', 'developer'))")
    out = turns.groupBy("conv_id").agg(users.alias("u"), system.alias("system"))
    texts = F.transform("u", lambda u: F.coalesce(u["text"], F.lit("")))
    return out.select("conv_id", F.get(texts, F.lit(0)).alias("prompt"), F.slice(texts, 2, F.greatest(F.size("u"), F.lit(1))).alias("follow_ups"), "system", F.size("u").cast("bigint").alias("turn_count"))


def unique_prompts(prompt_rows: DataFrame) -> DataFrame:
    """(resume_key, conv_id, n): the first conversation of each prompt. Partial aggregates meet; no rows are ranked."""
    keyed = prompt_rows.where("prompt is not null").select(resume_key(F.col("prompt"), F.col("follow_ups")).alias("resume_key"), "conv_id")
    return keyed.groupBy("resume_key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))


def pending_prompts(prompt_rows: DataFrame, completed: DataFrame) -> DataFrame:
    """(conv_id, resume_key) of the prompts that no completed conversation (conv_id, complete) answered. Null prompts are dropped."""
    keyed = prompt_rows.where("prompt is not null").select("conv_id", resume_key(F.col("prompt"), F.col("follow_ups")).alias("resume_key"))
    done = keyed.join(completed.where("complete").select("conv_id"), "conv_id", "left_semi").select("resume_key")
    return keyed.join(done, "resume_key", "left_anti").select("conv_id", "resume_key")


def dedupe_contained(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) without conversations whose turns are a contiguous part of another's; of equal ones the least id stays.

    Equal conversations meet first, by a hash of all turns, so that copies make no
    pairs. Of the rest candidates meet on the rarest pair of neighbouring turns of the
    shorter one, and the parts are compared by hash. A conversation of one turn is
    looked up among the turns of longer ones.
    """
    t = turns.select("conv_id", "turn", F.md5(F.concat_ws("\x1f", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))).alias("sig"))
    seqs = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "sig"))).alias("s"))
    seqs = seqs.select("conv_id", F.transform("s", lambda x: x["sig"]).alias("sigs"), F.size("s").cast("bigint").alias("n_turns"))
    seqs = seqs.groupBy(F.sha2(F.array_join("sigs", "|"), 256).alias("whole")).agg(F.min("conv_id").alias("conv_id"), F.any_value("sigs").alias("sigs"), F.any_value("n_turns").alias("n_turns")).drop("whole")
    pairs = F.transform(F.sequence(F.lit(1), F.col("n_turns").cast("int") - 1), lambda i: F.md5(F.concat(F.element_at("sigs", i), F.element_at("sigs", i + 1))))
    places = seqs.where("n_turns > 1").select("conv_id", "n_turns", F.posexplode(pairs).alias("pos", "sig"))
    count = places.groupBy("sig").agg(F.count("*").alias("df"))
    rare = places.join(count, "sig").groupBy("conv_id").agg(F.min(F.struct("df", "pos", "sig")).alias("r"))
    short = seqs.join(rare, "conv_id").select(F.col("conv_id").alias("a"), F.col("sigs").alias("a_sigs"), F.col("n_turns").alias("a_n"), F.col("r.pos").alias("a_pos"), F.col("r.sig").alias("sig"), F.col("r.df").alias("df"))
    at = places.select(F.col("conv_id").alias("b"), F.col("n_turns").alias("b_n"), F.col("pos").alias("b_pos"), "sig")
    pair = short.where("df > 1").join(at, "sig").where("b_pos >= a_pos AND b_n > a_n")
    whole = pair.join(seqs.select(F.col("conv_id").alias("b"), F.col("sigs").alias("b_sigs")), "b")
    gone = whole.where(F.slice("b_sigs", F.col("b_pos") - F.col("a_pos") + 1, F.col("a_n").cast("int")) == F.col("a_sigs")).select(F.col("a").alias("conv_id"))
    longer = seqs.where("n_turns > 1").select(F.explode("sigs").alias("sig")).distinct()
    single = seqs.where("n_turns = 1").select("conv_id", F.get("sigs", F.lit(0)).alias("sig")).join(longer, "sig", "left_semi").select("conv_id")
    return seqs.join(gone.union(single), "conv_id", "left_anti").select("conv_id", "n_turns")


def split_inline_thinking(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, content, reasoning_content), roles normalized and thinking moved out of assistant text."""
    role = normalize_role(F.col("role"))
    s = F.when(role == "assistant", split_thinking(F.col("text"))).otherwise(F.struct(F.col("text").alias("content"), F.lit(None).cast("string").alias("reasoning")))
    return turns.select("conv_id", "turn", role.alias("role"), s.alias("s")).select("conv_id", "turn", "role", F.col("s.content").alias("content"), F.col("s.reasoning").alias("reasoning_content"))
