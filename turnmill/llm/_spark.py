"""Session helpers: the shared folder, written intermediate tables, free column names, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only up to this many rows of a few machine words each.
BROADCAST_ROWS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Unset, a local session gets a temporary one; on a cluster it is an error."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    known = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="turnmill-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; the folder's owner clears it
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, deleted as the session's program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and survives lost executors."""
    return _written(df, name, *partition_by)[0]


def _written(df: DataFrame, name: str, *partition_by: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def free(df: DataFrame, *names: str) -> list[str]:
    """Column names that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        c = f"__{name}"
        while c.lower() in taken:
            c += "_"
        taken.add(c.lower())
        out.append(c)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if ``rows``, its counted size, allows; else Spark's own choice."""
    return F.broadcast(df) if rows <= limit else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (u BIGINT, v BIGINT): one row (node, root) for each node, root the least node.

    Alternating large-star and small-star rounds (Kiveris et al. 2014), each
    written to the shared folder: O(log^2 n) rounds, no node's neighbours gathered.
    """
    spark = edges.sparkSession
    e, path = _written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(lower, "u")
        small_ = star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = path
        e, path = _written(small_.union(lower.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "star")
        _delete(spark, before)  # nothing reads it any more
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.col("m").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
