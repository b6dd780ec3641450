"""Queries that write and read back through the sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import relational as R
from ..session import shared_dir
from ..sources import io
from . import base
from .base import query


def _place(t, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("s04_s21_csv_round_trip", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def s04(t):
    at = _place(t, "csv")
    io.write_pair(t("part").select("p_partkey", "p_name", "p_size", "p_retailprice"), at)
    return io.read_csv(t.spark, f"{at}.csv", "p_partkey bigint, p_name string, p_size int, p_retailprice double")


@query("s05_decimal_comma", "SELECT s_name AS name, CASE WHEN s_acctbal < 0 THEN NULL ELSE round(s_acctbal, 2) END AS amount, s_nationkey FROM supplier")
def s05(t):
    at = _place(t, "comma")
    text = F.when(F.col("s_acctbal") < 0, F.lit("/")).otherwise(F.regexp_replace(F.format_string("%.2f", "s_acctbal"), "\\.", ","))
    t("supplier").select(F.col("s_name").alias("name"), text.alias("amount"), F.col("s_nationkey").cast("string").alias("s_nationkey")).write.options(header="true", sep=";").csv(at)
    got = io.read_decimal_comma(t.spark, at, ["name", "amount", "s_nationkey"], ["amount"])
    return got.select("name", "amount", F.col("s_nationkey").cast("int").alias("s_nationkey"))


@query("s06_legend_slug", "SELECT n_nationkey AS code, n_name AS label, concat('count_', regexp_replace(regexp_replace(lower(trim(n_name)), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g')) AS column_name FROM nation")
def s06(t):
    at = _place(t, "legend")
    t("nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label")).write.options(header="true", sep="\t").csv(at)
    return io.read_legend(t.spark, at)


@query("s08_s19_shards", "SELECT c_custkey, c_mktsegment FROM customer")
def s08(t):
    at = _place(t, "shards")
    io.write_shards(t("customer"), at, 500)
    return io.read_selected(t.spark, at, ["c_custkey", "c_mktsegment", "not_there"])


@query("s09_s11_manifest", "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey")
def s09(t):
    at = _place(t, "manifest")
    t("customer").repartition(4, "c_nationkey").write.parquet(at)
    listed = t.spark.read.parquet(at).select(F.col("_metadata.file_path").alias("path")).distinct()
    return io.read_manifest(t.spark, listed).groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query("s02_s15_corners_valid_range", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS \"Lat_corner1\", CAST(embedding[4] AS DOUBLE) AS \"Lat_corner4\", CAST(embedding[6] AS DOUBLE) AS \"Lon_corner2\", CASE WHEN CAST(embedding[1] AS DOUBLE) BETWEEN 0 AND 0.2 THEN CAST(embedding[1] AS DOUBLE) * 10 END AS scaled FROM embeddings")
def s02(t):
    e = t("embeddings").select("vec_id", F.slice("embedding", 1, 4).cast("array<double>").alias("lat"), F.slice("embedding", 5, 4).cast("array<double>").alias("lon"))
    f = io.flatten_corners(e, "lat", "lon")
    return f.select("vec_id", "Lat_corner1", "Lat_corner4", "Lon_corner2", io.valid_range("Lat_corner1", 0.0, 0.2, 10.0).alias("scaled"))


@query("s24_r09_atomic_upsert", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def s24(t):
    at = _place(t, "log")
    s = t("supplier").select("s_suppkey", "s_acctbal")
    io.replace_atomically(s, at)
    new = s.filter("s_acctbal < 0").withColumn("s_acctbal", F.lit(0.0))
    io.replace_atomically(R.upsert(io.read_current(t.spark, at), new, ["s_suppkey"]), at)
    return io.read_current(t.spark, at)


@query("s26_listing_filter", "SELECT url FROM pages WHERE regexp_matches(url, '(page=|utm_)') AND NOT regexp_matches(url, '\\.html')")
def s26(t):
    return t("pages").filter(F.col("url").rlike("(page=|utm_)") & ~F.col("url").rlike("\\.html")).select("url")


QUERIES, SQL = base.QUERIES, base.SQL
