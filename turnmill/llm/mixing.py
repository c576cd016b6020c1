"""Mixing sources to target weights.

Tokens are aggregated by source; a source of weight w gets the repetition rate
budget * w / tokens; each of its documents is emitted floor(rate) times and once
more if a hash of its id and the seed falls under the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import col, free, materialize, small

#: q_s is proportional to p_s ** ALPHA where no weights are given.
ALPHA, SEED = 0.7, 17


def tokens(text: Column) -> Column:
    """Number of runs of anything but space, tab, line feed, form feed and carriage return; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\f\\r]+")), F.lit(0)).cast("bigint")


def repetition_rates(
    docs: DataFrame, *, weights: dict[str | None, float] | None = None, budget: int | None = None, alpha: float = ALPHA,
    text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """(source, tokens, rate): one row a source. ``budget`` is the tokens to emit, by default as many as there are."""
    per = materialize(docs.groupBy(col(source_col).alias("source")).agg(F.sum(tokens(col(text_col))).alias("tokens")), "source-tokens")
    total = per.agg(F.sum("tokens").alias("all"))
    if weights is None:
        share = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("all"), F.lit(float(alpha)))).otherwise(0.0)
        per = per.crossJoin(F.broadcast(total)).withColumn("w", share)  # total is one row
    else:
        given = per.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, w double")
        per = per.crossJoin(F.broadcast(total)).join(given.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name")), "left")
        per = per.withColumn("w", F.when(F.col("tokens") > 0, F.coalesce("w", F.lit(0.0))).otherwise(0.0)).drop("name")
    norm = per.agg(F.sum("w").alias("w_all"))
    want = F.col("all") if budget is None else F.lit(budget)
    rate = F.when((F.col("tokens") > 0) & (F.col("w_all") > 0), F.round(want * F.col("w") / F.col("w_all") / F.col("tokens"), 9)).otherwise(0.0)
    return per.crossJoin(F.broadcast(norm)).select("source", "tokens", rate.alias("rate"))


def unit_hash(id_: Column, seed: int) -> Column:
    """A number in [0, 1) from the id: 52 bits of an MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(2**52)


def mix_sources(
    docs: DataFrame, *, weights: dict[str | None, float] | None = None, budget: int | None = None, alpha: float = ALPHA, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", copy_col: str | None = None,
) -> DataFrame:
    """Each document as often as its source's rate says. Columns are unchanged, with ``copy_col`` (from 1) if it is named.

    Null is a source of its own. A source that ``weights`` leaves out, or one
    without a token (all texts null or empty), has rate 0 and emits nothing.
    Rows that share an id share their draw; repeated rows each count. An empty
    table gives an empty table. Rows never shuffle while the sources' rates are
    few enough to broadcast, which is checked.
    """
    rates = materialize(repetition_rates(docs, weights=weights, budget=budget, alpha=alpha, text_col=text_col, source_col=source_col), "rates")
    src, rate, n = free(docs, "source", "rate", "copy")
    table = small(rates.select(F.col("source").alias(src), F.col("rate").alias(rate)), rates.count())
    joined = docs.join(table, col(source_col).eqNullSafe(F.col(src)))
    whole = F.floor(F.col(rate))
    copies = whole + (unit_hash(col(id_col), seed) < F.col(rate) - whole).cast("bigint")
    out = joined.where(copies > 0).withColumn(n, F.explode(F.sequence(F.lit(1).cast("bigint"), copies)))
    return out.select(*[col(c) for c in docs.columns], *([F.col(n).alias(copy_col)] if copy_col else []))


MIX_SQL = f"""
    WITH per AS (
        SELECT source, sum(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\f\\r]+')), 0)) AS tokens FROM documents GROUP BY source
    ), share AS (
        SELECT source, tokens, sum(tokens) OVER () AS all_tokens,
               CASE WHEN tokens > 0 THEN pow(tokens::DOUBLE / (sum(tokens) OVER ())::DOUBLE, {ALPHA}) ELSE 0 END AS w FROM per
    ), rates AS (
        SELECT source, CASE WHEN tokens > 0 THEN round(all_tokens::DOUBLE * w / (sum(w) OVER ()) / tokens::DOUBLE, 9) ELSE 0 END AS rate FROM share
    ), draws AS (
        SELECT d.*, r.rate,
               ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
        FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
    ), counts AS (
        SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM draws
    )
    SELECT doc_id, text, lang, source, n_chars, copy_no
    FROM (SELECT *, unnest(generate_series(1, copies)) AS copy_no FROM counts WHERE copies > 0)
"""
