"""Arrow batches in pieces of bounded bytes, so that what a Python step holds doesn't grow with its table. A row is never cut."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of input that are worked on at once; a token as Python objects takes some 200.
PIECE = 256 << 10
#: Bytes that Spark sends to a Python worker at once, besides its limit of rows.
BATCH, _SETTING = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


def bound(spark: SparkSession) -> None:
    """Limit the bytes of the session's batches, unless the session has a limit of its own."""
    if str(spark.conf.get(_SETTING, None) or 2**31 - 1) in (f"{2**31 - 1}", f"{2**31 - 1}b"):
        spark.conf.set(_SETTING, BATCH)


def pieces(batch, most: int = PIECE) -> Iterator:
    """Runs of rows of a record batch or array of at most so many bytes, or single rows; nothing is copied."""
    n = len(batch)
    if n < 2 or batch.nbytes <= most:
        yield batch
    else:
        yield from pieces(batch.slice(0, n // 2), most)
        yield from pieces(batch.slice(n // 2), most)


def frames(batches: Iterator[pd.DataFrame], most: int = PIECE) -> Iterator[pd.DataFrame]:
    """The same of frames of texts, by their characters."""
    for pdf in batches:
        start = size = 0
        for i, row in enumerate(zip(*[pdf[c] for c in pdf.columns])):
            more = sum(len(v) for v in row if isinstance(v, str))
            if i > start and size + more > most:
                yield pdf.iloc[start:i]
                start, size = i, 0
            size += more
        yield pdf.iloc[start:]


def batched(run):
    """A function of record batches applied piece by piece, for ``mapInArrow``."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                yield run(piece)

    return each
