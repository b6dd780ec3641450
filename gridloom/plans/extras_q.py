"""Queries of the custom-function surface, keyed patches, raster statistics, chunked files and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import finite
from ..operators.relational import exact_quantiles, left_join_null_safe
from ..session import shared_dir
from ..sources import io
from . import base
from .base import S, query
from .spatial_q import PX, pixels


@query("p02_p11_p18_keyed_patch", "SELECT s_suppkey, CASE WHEN s_suppkey = 3 THEN 7 ELSE s_nationkey END AS s_nationkey, s_acctbal * 2 AS twice FROM supplier")
def p18(t):
    s = io.require(t("supplier"), ["s_suppkey", "s_nationkey", "s_acctbal"])
    patch = t.spark.createDataFrame([(3, 7)], "s_suppkey bigint, fixed int")
    out = s.join(F.broadcast(patch), "s_suppkey", "left")
    return out.select("s_suppkey", F.coalesce("fixed", "s_nationkey").alias("s_nationkey"), (F.col("s_acctbal") * 2).alias("twice"))


@query("a30_a42_a45_raster_stats", PX + "SELECT label, mode(code ORDER BY code) AS modal, min(val) AS low, round(quantile_cont(val, 0.1), 8) AS q10, round(median(val), 8) AS mid, max(val) AS high, round(100 * avg(val), 6) AS mean_100, avg(CAST(code = 1 AS DOUBLE)) AS flagged_share FROM px GROUP BY label")
def a30(t):
    px = pixels(t)
    plain = px.groupBy("label").agg(F.mode("code", True).alias("modal"), F.min("val").alias("low"), F.max("val").alias("high"), F.round(100 * F.avg("val"), 6).alias("mean_100"), F.avg((F.col("code") == 1).cast("double")).alias("flagged_share"))
    q = exact_quantiles(px, ["label"], "val", (0.1, 0.5)).select("label", *[F.round(F.col("p")[k], 8).alias(n) for k, n in enumerate(("q10", "mid"))])
    return left_join_null_safe(plain, q, ["label"])


@query("u01_u04_custom_aggregates", S + "SELECT tile, mo, round(avg(v) FILTER (WHERE q > 40), 6) AS mean_or_na, coalesce(CAST(SUM(CAST(q AS DECIMAL(18,2))) FILTER (WHERE q > 40) AS DOUBLE), 0) AS sum_or_zero, CAST(max(CASE WHEN flag = 'A' THEN ln * 10 ELSE ln END) AS BIGINT) AS best_row_score FROM s GROUP BY tile, mo")
def u04(t):
    big = F.when((F.col("q") > 40) & finite("v"), F.col("v"))
    total = F.coalesce(F.sum(F.when(F.col("q") > 40, F.col("q").cast("decimal(18,2)"))).cast("double"), F.lit(0.0))
    score = F.when(F.col("flag") == "A", F.col("ln") * 10).otherwise(F.col("ln"))
    return t.s.groupBy("tile", "mo").agg(F.round(F.avg(big), 6).alias("mean_or_na"), total.alias("sum_or_zero"), F.max(score).alias("best_row_score"))


@query("u03_u05_u06_table_function", "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 AS even FROM events")
def u03(t):
    import json

    def parse(frames):
        for f in frames:
            k = f["props"].map(lambda x: json.loads(x)["k"]).astype("int64")
            yield f[["event_id", "event_type"]].assign(k=k, even=k % 2 == 0)

    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("k", T.LongType()), T.StructField("even", T.BooleanType())])
    return t("events").select("event_id", "event_type", "props").mapInPandas(parse, schema)


@query("u07_m19_plugged_model", S + "SELECT sid, round(0.3 * q + 2 * disc, 8) AS prediction FROM s")
def u07(t):
    from ..operators.models import predict_with

    out = predict_with(t.s.select("sid", "q", "disc"), ["q", "disc"], lambda x: 0.3 * x["q"] + 2 * x["disc"])
    return out.select("sid", F.round("prediction", 8).alias("prediction"))


@query("s01_s03_chunked_files", S + "SELECT yr, COUNT(*) AS n, max(v) AS max_v FROM s GROUP BY yr")
def s03(t):
    at = f"{shared_dir(t.spark)}/spill-{uuid.uuid4().hex}"
    t.s.select("yr", "sid", "v").withColumn("part", F.col("yr")).write.partitionBy("part").parquet(at)
    return io.read_union(t.spark, [at]).groupBy("yr").agg(F.count("*").alias("n"), F.max("v").alias("max_v"))


@query("d10_stream_upsert", "SELECT user_id, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM events GROUP BY user_id")
def stream(t):
    from ..streaming.windows import read_upserted, upsert_batches

    at = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    e = t("events").select("event_id", "user_id", "ts")
    e.select("event_id", "user_id", F.struct("ts", "event_id").alias("at")).write.parquet(f"{at}/in")
    src = t.spark.readStream.schema(t.spark.read.parquet(f"{at}/in").schema).option("maxFilesPerTrigger", 4).parquet(f"{at}/in")
    upsert_batches(src, f"{at}/table", ["user_id"], "at", f"{at}/state").awaitTermination()
    return read_upserted(t.spark, f"{at}/table", ["user_id"], "at").select("user_id", "event_id")


QUERIES, SQL = base.QUERIES, base.SQL
