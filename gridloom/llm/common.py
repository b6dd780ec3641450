"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialised as written
from ..session import passing, shared_dir

#: Rows in one Arrow batch sent to Python. Texts may be very long, so batches are kept small.
ARROW_ROWS = 256
#: Rows of ids that may be broadcast (some tens of MB); larger frames are shuffled.
BROADCAST_ROWS = 500_000


def small_batches(spark: SparkSession) -> None:
    """Bound the rows (and, where the setting exists, the bytes) of an Arrow batch for long texts. Batches are cut when a
    query runs, so the bounds stay with the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written frame of a few whole numbers a row, to be broadcast if it has no more than `rows` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32(doc_id as text) mod parts; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame, key: str, groups: list[tuple[Column, int]], bound: int, seed: int = 7) -> DataFrame:
    """About `bound` rows of each group at most, chosen by a hash of `key`, with no sort or shuffle.
    groups: conditions, each with the number of rows that meet it."""
    keep = F.lit(False)
    share = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 20))
    for cond, n in groups:
        keep = keep | (cond & (share < F.lit(max(1, int((1 << 20) * min(1.0, bound / max(1, n)))))))
    return df.filter(keep)


__all__ = ["bounded", "fold", "passing", "scratch", "small", "small_batches", "table", "written"]
