"""Incremental ingest of finished session files, and keyed progress totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of (source_file, raw); files that are still being written are not safe to read."""
    df = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", files_per_trigger).text(path)
    return df.select(F.col("_metadata.file_path").alias("source_file"), F.trim("value").alias("raw")).where("raw <> ''")


def progress_totals(events: DataFrame) -> DataFrame:
    """(source_file, events, bad, input_tokens, output_tokens), kept up to date by file."""
    usage = lambda k: F.coalesce(F.get_json_object("raw", f"$.message.usage.{k}").try_cast("bigint"), F.lit(0))
    return events.groupBy("source_file").agg(
        F.count("*").alias("events"), F.count_if(F.try_parse_json("raw").isNull()).alias("bad"),
        F.sum(usage("input_tokens")).alias("input_tokens"), F.sum(usage("output_tokens")).alias("output_tokens"),
    )


def watch_usage(spark: SparkSession, path: str, on_change, checkpoint: str | None = None):
    """A started stream that reports the usage of session files as they arrive: ``on_change(source_file, metrics)``, only if it differs from what was reported.

    What was reported is kept by the driver, one small row a session of this run.
    """
    from ..operators.usage import session_usage
    from .progress import signature

    sent: dict[str, tuple | None] = {}

    def batch(rows: DataFrame, _: int) -> None:
        lines = rows.withColumn("line_no", F.monotonically_increasing_id())  # lines of a file come in order
        for r in session_usage(lines).toLocalIterator():
            m = r.asDict()
            name = m.pop("source_file")
            if sent.get(name) != signature(m):
                sent[name] = signature(m)
                on_change(name, m)

    writer = read_events(spark, path).writeStream.foreachBatch(batch).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
