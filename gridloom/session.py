"""Session factory, and the shared folder for data that is written to cut lineage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "gridloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and ANSI semantics; on a cluster give the rest by spark-submit."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where it is unset and the session is local."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


#: Paths of tables that go when the `passing` block in which they were written ends, the innermost block last.
_passing: list[list[tuple[SparkSession, str]]] = []


def materialised(df: DataFrame, name: str, outlive: bool = False) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors. In a `passing` block
    the table goes at its end, with outlive at the end of the block around it, if there is one."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    around = _passing[:-1] if outlive else _passing
    if around:
        around[-1].append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def passing() -> Iterator[None]:
    """Tables written within are removed at the end, but for those that outlive it. Frames over them must be done by then."""
    _passing.append([])
    try:
        yield
    finally:
        for spark, path in _passing.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
