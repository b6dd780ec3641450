"""Streaming forms of the batch operators: composites by day of year, and upserts by key in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import composite_day


def composite_counts(events: DataFrame, at: str, keys: list[str], value: str, late: str = "2 days") -> DataFrame:
    """Counts and sums by key and eight-day composite. Rows later than the watermark are dropped; the day is kept as
    a window, so that state can be released, and composites are summed from days by the reader."""
    day = F.window(at, "1 day")
    out = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(day.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    start = F.col("w.start")
    return out.select(*keys, F.to_date(start).alias("d"), F.year(start).alias("yr"), composite_day(F.dayofyear(start)).alias("composite"), "n", "total")


#: Batches between two full versions of an upserted table.
COMPACT = 16


def read_upserted(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key of a table that upsert_batches() keeps."""
    from ..operators.relational import first_by
    from ..sources.io import read_current

    return first_by(read_current(spark, path), keys, F.col(order).desc())


def upsert_batches(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str):
    """Start a query that keeps the newest row of each key. A micro-batch adds its own newest rows as a delta; only
    every COMPACT batches is the whole table written. A batch that is run again writes the same folder again. A row
    older than the table's is ignored, so the order of files does not matter."""
    from ..operators.relational import first_by
    from ..sources.io import add_version, has_version

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = first_by(batch, keys, F.col(order).desc())
        if number % COMPACT == COMPACT - 1 and has_version(spark, path):
            whole = first_by(read_upserted(spark, path, keys, order).unionByName(new), keys, F.col(order).desc())
            add_version(whole, path, number, "full")
        else:
            add_version(new, path, number, "delta")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
