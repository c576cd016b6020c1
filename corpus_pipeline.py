"""The corpus pipeline: quality, exact dedup, near-dedup, mixing, packing, each over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnmill.llm._spark import materialize
from turnmill.llm.cotraining import quality_filter
from turnmill.llm.exact_dedup import exact_dedup
from turnmill.llm.mixing import mix_sources
from turnmill.llm.packing import pack
from turnmill.llm.simhash_dedup import simhash_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers don't reject.

    A null or empty text is judged by its metadata and the constant; null metadata
    are values of their own. Repeated rows are judged alike. Without labels of both
    classes nothing is rejected.
    """
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each distinct text, that with the least id.

    Null texts all stay; the empty text is a text. Null ids come last, equal ids are
    told apart by the row's JSON, and one of fully equal rows stays.
    """
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least id.

    Texts without a word (null, empty, punctuation) and rows with a null id stay. Of
    repeated rows one stays, that with the least JSON.
    """
    return simhash_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or dropped to the sources' target weights.

    A null source is a source. A source without a token emits nothing. Rows that
    share an id share their draw, repeated rows each count.
    """
    return mix_sources(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of document pieces: (bin_id, n_tokens, doc_ids, starts, lengths).

    Rows without a token are in no bin, longer ones than a bin are cut, repeated rows
    are packed each, and a null id is carried as null.
    """
    return pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("pack", packed)]

#: Column generation and co-training can't be written in SQL; tests/llm/test_pipeline.py checks the stages instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written as Parquet and read again.

    The result is that of ``packed``; an empty table of documents gives no bins.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
