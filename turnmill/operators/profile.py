"""Dataset statistics, search, paging and usage metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_statistics(df: DataFrame, columns: list[str], top: int = 5) -> DataFrame:
    """(column, present, missing, value, count, rank): the ``top`` values of each column; null counts as missing and ranks as ``null``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    counts = df.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("count"))
    total = counts.groupBy("column").agg(F.coalesce(F.expr("sum(count) FILTER (WHERE value IS NOT NULL)"), F.lit(0)).alias("present"), F.coalesce(F.expr("sum(count) FILTER (WHERE value IS NULL)"), F.lit(0)).alias("missing"))
    named = counts.withColumn("value", F.coalesce("value", F.lit("null")))
    ranked = named.selectExpr("*", "row_number() OVER (PARTITION BY column ORDER BY count DESC, value) AS rank").where(F.col("rank") <= top)
    return ranked.join(F.broadcast(total), "column").select("column", "present", "missing", "value", "count", F.col("rank").cast("bigint").alias("rank"))  # a row a column


def search_page(df: DataFrame, query: str, text_col: str, order: str, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page, of 1 to 100 rows, of the rows whose text holds the query in any case."""
    return df.where(F.contains(F.lower(F.col(text_col)), F.lit(query.lower()))).orderBy(order).offset(max(offset, 0)).limit(min(max(limit, 1), 100))


def row_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(rows, blank, characters, lines) for a dataset card."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    blank = ~text.rlike(r"(?U)\S")
    return docs.agg(
        F.count("*").alias("rows"), F.count_if(blank).alias("blank"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("characters"),
        F.coalesce(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))), F.lit(0)).alias("lines"),
    )


def usage_totals(events: DataFrame) -> DataFrame:
    """(user_id, calls, input_tokens, total_tokens, last_type): summed counters with 0 as absent, and the last kind of event."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = events.withColumn("input", F.coalesce(F.nullif(k, F.lit(0)), F.lit(0)))
    return e.groupBy("user_id").agg(
        F.count("*").alias("calls"), F.sum("input").cast("bigint").alias("input_tokens"),
        F.sum(F.col("input") + F.when(F.col("event_type") == "purchase", F.lit(1)).otherwise(F.lit(0))).cast("bigint").alias("total_tokens"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"),
    )


def usage_delta(events: DataFrame) -> DataFrame:
    """(user_id, delta, last_delta): growth of a counter from event to event, never under 0."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    w = "(PARTITION BY user_id ORDER BY ts, event_id)"
    d = events.withColumn("k", k).selectExpr("user_id", "ts", "event_id", f"greatest(0, k - lag(k) OVER {w}) AS d")
    return d.groupBy("user_id").agg(F.coalesce(F.sum("d"), F.lit(0)).cast("bigint").alias("delta"), F.max_by("d", F.expr("CASE WHEN d > 0 THEN struct(ts, event_id) END")).cast("bigint").alias("last_delta"))
