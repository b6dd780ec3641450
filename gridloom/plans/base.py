"""What the plan modules share: the query decorator, table access, and the driver tables seen as soundings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables of one folder, read with the columns that a query uses (the scan prunes the rest)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def s(self) -> DataFrame:
        return soundings(self("lineitem"))


def query(name: str, sql: str | None = None):
    """Register a function of Tables under a name, with its SQL."""

    def wrap(f):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return f

    return wrap


#: The columns that name a sounding, and the text made of them: numbers go through joins, the text is made at the end.
SID = ["ok", "ln", "pk", "sk", "d"]


def sid(of: str = ""):
    return F.concat_ws("-", *[F.col(f"{of}{c}").cast("string") for c in SID[:4]], F.date_format(f"{of}d", "yyyyMMdd"))


def soundings(li: DataFrame) -> DataFrame:
    """Line items as point measurements: id, place on a 109.8 km square, tile, date, values, flags."""
    d = F.to_date("l_shipdate")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")).alias("sid"),
        F.col("l_orderkey").alias("ok"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), F.col("l_linenumber").cast("bigint").alias("ln"),
        d.alias("d"), F.year(d).cast("bigint").alias("yr"), F.month(d).cast("bigint").alias("mo"), F.dayofyear(d).cast("bigint").alias("doy"),
        ((F.col("l_partkey") * 7919 + F.col("l_linenumber") * 104729) % 109800 + 0.5).cast("double").alias("x"),
        ((F.col("l_orderkey") * 15485863 + F.col("l_suppkey") * 32452) % 109800 + 0.5).cast("double").alias("y"),
        F.concat(F.lit("T"), (F.col("l_suppkey") % 8).cast("string")).alias("tile"),
        F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("mode"),
    )


S = """WITH s AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS sid,
    l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, CAST(l_linenumber AS BIGINT) AS ln, CAST(l_shipdate AS DATE) AS d,
    year(l_shipdate) AS yr, month(l_shipdate) AS mo, dayofyear(l_shipdate) AS doy,
    CAST((l_partkey * 7919 + l_linenumber * 104729) % 109800 + 0.5 AS DOUBLE) AS x,
    CAST((l_orderkey * 15485863 + l_suppkey * 32452) % 109800 + 0.5 AS DOUBLE) AS y,
    concat('T', l_suppkey % 8) AS tile, l_extendedprice AS v, l_quantity AS q, l_discount AS disc, l_tax AS tax,
    l_returnflag AS flag, l_linestatus AS mode
  FROM lineitem) """


def mean_sql(x: str) -> str:
    """The exact mean of mean_exact()."""
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,2))) AS DOUBLE) / COUNT({x})"
