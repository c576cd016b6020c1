"""One query opN_<name> for each operator of the subpackage, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ._spark import scratch
from .cotraining import quality_scores
from .embedding_dedup import embedding_groups
from .exact_dedup import exact_dedup
from .mixing import MIX_SQL, mix_sources
from .packing import pack
from .records import VOCABULARY, write_records
from .reply_trees import REPLY_SQL, reply_trees
from .sanitise import sanitise
from .simhash_dedup import simhash_dedup
from .toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise(_table(spark, sf_dir, "documents"))


def op4_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_trees(_table(spark, sf_dir, "conversations"))


def op5_token_records(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The index, read back, of the shard files that the query writes to the shared folder."""
    return write_records(_table(spark, sf_dir, "documents"), scratch(spark, "records"), vocabulary=vocabulary)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"), copy_col="copy_no")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(_table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(_table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_cotraining, op3_sanitise, op4_reply_trees, op5_token_records,
        op6_mixing, op7_simhash_dedup, op8_embedding_dedup, op9_packing, op10_exact_dedup,
    )
}

ORACLES: dict[str, str] = {
    "op4_reply_trees": REPLY_SQL,
    "op6_mixing": MIX_SQL,
    "op10_exact_dedup": """
        SELECT doc_id, text, lang, source, n_chars FROM documents
        WHERE text IS NULL
        UNION ALL
        SELECT doc_id, text, lang, source, n_chars FROM documents WHERE text IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) = 1
    """,
}
