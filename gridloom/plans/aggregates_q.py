"""Queries of aggregates, windows, order and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import relational as R
from ..operators import sampling
from . import base
from .base import S, mean_sql, query

PRED = S + ", p AS (SELECT *, v / 100000 AS obs, (v * 0.8 + q * 400 + disc * 9000) / 100000 AS pred FROM s) "


def metrics_sql(y: str = "obs", p: str = "pred") -> str:
    e = f"({p} - {y})"
    return f"""COUNT(*) AS n, round(sqrt(avg({e} * {e})), 8) AS rmse, round(avg(abs({e})), 8) AS mae, round(avg({e}), 8) AS bias,
 round(CASE WHEN var_pop({y}) > 0 THEN 1 - avg({e} * {e}) / var_pop({y}) END, 8) AS r2, round(regr_slope({p}, {y}), 8) AS slope, round(regr_intercept({p}, {y}), 8) AS intercept,
 round(corr({y}, {p}), 8) AS pearson_r, round(CASE WHEN stddev_samp({y}) > 0 THEN sqrt(avg({e} * {e})) / stddev_samp({y}) END, 8) AS normalized_rmse, round(stddev_samp({e}), 8) AS residual_sd"""


def predictions(t):
    return t.s.withColumn("obs", F.col("v") / 100000).withColumn("pred", (F.col("v") * 0.8 + F.col("q") * 400 + F.col("disc") * 9000) / 100000)


@query("a02_a03_sorted_lists", S + "SELECT tile, mo, string_agg(DISTINCT flag, ';' ORDER BY flag) AS flags, string_agg(DISTINCT CAST(yr AS VARCHAR), ';' ORDER BY CAST(yr AS VARCHAR)) AS years FROM s GROUP BY tile, mo")
def a02(t):
    return t.s.groupBy("tile", "mo").agg(R.sorted_distinct(F.col("flag")).alias("flags"), R.sorted_distinct(F.col("yr")).alias("years"))


@query("a04_a05_conditional", S + "SELECT tile, COUNT(*) FILTER (WHERE q > 25) AS n_big, avg(CAST(q > 25 AS DOUBLE)) AS share_big, CAST(SUM(CAST(q AS DECIMAL(18,2))) FILTER (WHERE q >= 10) AS DOUBLE) AS sum_ge_10 FROM s GROUP BY tile")
def a04(t):
    big = F.col("q") > 25
    return t.s.groupBy("tile").agg(F.count_if(big).alias("n_big"), F.avg(big.cast("double")).alias("share_big"), F.sum(F.when(F.col("q") >= 10, F.col("q").cast("decimal(18,2)"))).cast("double").alias("sum_ge_10"))


@query("a06_two_level_mean", S + f", a AS (SELECT tile, yr, mo, d, {mean_sql('v')} AS daily FROM s GROUP BY tile, yr, mo, d) SELECT tile, yr, mo, round(avg(daily), 8) AS monthly, COUNT(*) AS n_dates FROM a GROUP BY tile, yr, mo")
def a06(t):
    daily = t.s.groupBy("tile", "yr", "mo", "d").agg(R.mean_exact(F.col("v")).alias("daily"))
    return daily.groupBy("tile", "yr", "mo").agg(F.round(F.avg("daily"), 8).alias("monthly"), F.count("*").alias("n_dates"))


@query("a07_a08_weighted_mean", S + "SELECT tile, mo, round(SUM(v * disc) FILTER (WHERE disc > 0) / SUM(disc) FILTER (WHERE disc > 0), 6) AS wmean FROM s GROUP BY tile, mo")
def a07(t):
    return t.s.groupBy("tile", "mo").agg(F.round(R.weighted_mean(F.col("v"), F.col("disc")), 6).alias("wmean"))


@query("a09_g26_arg_extremes", S + "SELECT d, mode, arg_min(sid, struct_pack(a := y, b := sid)) AS south, arg_max(sid, struct_pack(a := y, b := sid)) AS north, min(y) AS y0, max(y) AS y1 FROM s GROUP BY d, mode")
def a09(t):
    at = F.struct("y", "sid")
    return t.s.groupBy("d", "mode").agg(F.min(at)["sid"].alias("south"), F.max(at)["sid"].alias("north"), F.min("y").alias("y0"), F.max("y").alias("y1"))


@query("a10_a11_mad_fences", S + ", m AS (SELECT tile, median(v) AS med, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM s GROUP BY tile) SELECT m.tile, round(med, 6) AS med, round(median(abs(v - med)), 6) AS mad, round(1.4826 * median(abs(v - med)), 6) AS mad_sd, round(any_value(q1) - 1.5 * (any_value(q3) - any_value(q1)), 6) AS low_fence, round(any_value(q3) + 1.5 * (any_value(q3) - any_value(q1)), 6) AS high_fence FROM s JOIN m ON s.tile = m.tile GROUP BY m.tile, med")
def a10(t):
    m = R.exact_quantiles(t.s, ["tile"], "v", (0.25, 0.5, 0.75))
    dev = t.s.join(m, "tile").select("tile", F.abs(F.col("v") - F.col("p")[1]).alias("dev"))
    g = m.join(R.exact_quantiles(dev, ["tile"], "dev", (0.5,), "mad").select("tile", F.col("mad")[0].alias("mad0")), "tile")
    q1, med, q3 = (F.col("p")[i] for i in range(3))
    r = lambda c, n: F.round(c, 6).alias(n)
    return g.select("tile", r(med, "med"), r(F.col("mad0"), "mad"), r(1.4826 * F.col("mad0"), "mad_sd"), r(q1 - 1.5 * (q3 - q1), "low_fence"), r(q3 + 1.5 * (q3 - q1), "high_fence"))


@query("a12_quantile_profile", S + "SELECT flag, " + ", ".join(f"round(quantile_cont(v, {p}), 6) AS p{int(p * 1000):03d}" for p in (0.001, 0.01, 0.05, 0.5, 0.95, 0.99, 0.999)) + " FROM s GROUP BY flag")
def a12(t):
    ps = (0.001, 0.01, 0.05, 0.5, 0.95, 0.99, 0.999)
    g = R.exact_quantiles(t.s, ["flag"], "v", ps)
    return g.select("flag", *[F.round(F.col("p")[i], 6).alias(f"p{int(p * 1000):03d}") for i, p in enumerate(ps)])


@query("a13_binned_summary", S + "SELECT floor(q / 10) * 10 AS q_bin, COUNT(*) AS n, COUNT(*) / CAST((SELECT COUNT(*) FROM s) AS DOUBLE) AS share, avg(CAST(disc < 0.03 AS DOUBLE)) AS low_share, round(quantile_cont(v, 0.5), 6) AS p50 FROM s GROUP BY 1")
def a13(t):
    b = t.s.withColumn("q_bin", X.bin_floor("q", 10.0))
    g = b.groupBy("q_bin").agg(F.count("*").alias("n"), F.avg((F.col("disc") < 0.03).cast("double")).alias("low_share"))
    g = R.left_join_null_safe(g, R.exact_quantiles(b, ["q_bin"], "v", (0.5,)).select("q_bin", F.round(F.col("p")[0], 6).alias("p50")), ["q_bin"])
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").cast("double").alias("total")))).select("q_bin", "n", (F.col("n") / F.col("total")).alias("share"), "low_share", "p50")


@query("a14_candidate_filters", S + " SELECT 'all' AS filter_set, COUNT(*) AS n, max(v) AS max_v FROM s UNION ALL SELECT 'flag_n', COUNT(*), max(v) FROM s WHERE flag = 'N' UNION ALL SELECT 'season', COUNT(*), max(v) FROM s WHERE mo BETWEEN 4 AND 9 UNION ALL SELECT 'both', COUNT(*), max(v) FROM s WHERE flag = 'N' AND mo BETWEEN 4 AND 9")
def a14(t):
    n, season = F.col("flag") == "N", F.col("mo").between(4, 9)
    return R.candidate_sets(t.s, {"all": F.lit(True), "flag_n": n, "season": season, "both": n & season}, [F.count("*").alias("n"), F.max("v").alias("max_v")])


@query("a15_w07_share_of_total", S + "SELECT tile, flag, COUNT(*) AS n, COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE) AS share, COUNT(*) / CAST(SUM(COUNT(*)) OVER (PARTITION BY tile) AS DOUBLE) AS tile_share FROM s GROUP BY tile, flag")
def a15(t):
    g = t.s.groupBy("tile", "flag").agg(F.count("*").alias("n"))
    over = lambda *k: (F.col("n") / F.sum("n").over(Window.partitionBy(*k)).cast("double"))
    total = F.broadcast(g.agg(F.sum("n").cast("double").alias("total")))
    return g.crossJoin(total).select("tile", "flag", "n", (F.col("n") / F.col("total")).alias("share"), over("tile").alias("tile_share"))


@query("a16_w08_w09_count_of_counts", S + ", c AS (SELECT tile, d, COUNT(*) AS k FROM s GROUP BY tile, d), g AS (SELECT k, COUNT(*) AS n FROM c GROUP BY k) SELECT k, n, CAST(SUM(n) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS n_at_least, CAST(SUM(n) OVER (ORDER BY k) AS BIGINT) AS n_up_to FROM g")
def a16(t):
    g = t.s.groupBy("tile", "d").agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    w = Window.orderBy("k")  # one row a count: small
    return g.select("k", "n", F.sum("n").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("n_at_least"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("n_up_to"))


@query("a17_a22_homogeneity", S + "SELECT ok, COUNT(DISTINCT tile) AS n_tiles, COUNT(DISTINCT mode) AS n_modes, COUNT(DISTINCT tile) = 1 AS homogeneous FROM s GROUP BY ok")
def a17(t):
    return t.s.groupBy("ok").agg(F.countDistinct("tile").alias("n_tiles"), F.countDistinct("mode").alias("n_modes"), (F.countDistinct("tile") == 1).alias("homogeneous"))


@query("a19_a20_null_counts", "SELECT 'seg' AS column_name, COUNT(*) - COUNT(nullif(c_mktsegment, 'BUILDING')) AS n_null FROM customer UNION ALL SELECT 'bal', COUNT(*) FILTER (WHERE c_acctbal < 0) FROM customer")
def a19(t):
    return R.null_counts(t("customer").select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("bal")))


@query("a21_describe", S + f"SELECT COUNT(v) AS n, {mean_sql('v')} AS mean, round(stddev_samp(v), 6) AS sd, min(v) AS min, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, max(v) AS max FROM s")
def a21(t):
    plain = t.s.agg(F.count("v").alias("n"), R.mean_exact(F.col("v")).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("sd"), F.min("v").alias("min"), F.max("v").alias("max"))
    q = R.exact_quantiles(t.s, [], "v", (0.25, 0.5, 0.75)).select(*[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p25", "p50", "p75"))])
    return plain.join(F.broadcast(q), F.lit(True), "left")  # one row a side


@query("a23_a49_category_counts", S + "SELECT tile, " + ", ".join(f"COUNT(*) FILTER (WHERE ln = {k}) AS count_{k}" for k in range(1, 8)) + ", COUNT(*) AS total FROM s GROUP BY tile")
def a23(t):
    wide = t.s.groupBy("tile").pivot("ln", list(range(1, 8))).count().fillna(0)
    cols = [F.col(str(k)).alias(f"count_{k}") for k in range(1, 8)]
    return wide.select("tile", *cols, sum((F.col(str(k)) for k in range(2, 8)), F.col("1")).alias("total"))


@query("a24_row_means", S + ", a AS (SELECT sid, CASE WHEN ln > 2 THEN v END AS a, CASE WHEN ln > 4 THEN q * 100 END AS b, disc * 1000 AS c FROM s) SELECT sid, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / (CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT) + CAST(c IS NOT NULL AS INT)), 8) AS observed_mean, round(a + b + c, 8) AS strict_sum FROM a")
def a24(t):
    a = t.s.select("sid", F.when(F.col("ln") > 2, F.col("v")).alias("a"), F.when(F.col("ln") > 4, F.col("q") * 100).alias("b"), (F.col("disc") * 1000).alias("c"))
    return a.select("sid", F.round(R.row_mean(["a", "b", "c"]), 8).alias("observed_mean"), F.round(F.col("a") + F.col("b") + F.col("c"), 8).alias("strict_sum"))


@query("a26_m14_standardise", S + ", m AS (SELECT avg(v) AS mv, coalesce(nullif(stddev_pop(v), 0), 1) AS sv FROM s WHERE yr < 2000) SELECT sid, round((v - mv) / sv, 6) AS z FROM s, m")
def a26(t):
    m = t.s.filter("yr < 2000").agg(F.avg("v").alias("mv"), F.stddev_pop("v").alias("sd")).select("mv", F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")).alias("sv"))
    return t.s.crossJoin(F.broadcast(m)).select("sid", F.round((F.col("v") - F.col("mv")) / F.col("sv"), 6).alias("z"))


@query("a27_channel_stats", "SELECT pos, round(avg(val), 6) AS mean, round(sqrt(greatest(avg(val * val) - avg(val) * avg(val), 1e-8)), 6) AS sd FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS val, CAST(generate_subscripts(embedding, 1) AS BIGINT) - 1 AS pos FROM embeddings) GROUP BY pos")
def a27(t):
    e = t("embeddings").select(F.posexplode("embedding").alias("p", "x")).select(F.col("p").cast("bigint").alias("pos"), F.col("x").cast("double").alias("val"))
    var = F.avg(F.col("val") * F.col("val")) - F.avg("val") * F.avg("val")
    return e.groupBy("pos").agg(F.round(F.avg("val"), 6).alias("mean"), F.round(F.sqrt(F.greatest(var, F.lit(1e-8))), 6).alias("sd"))


@query("a28_elementwise_mean", "SELECT label, pos, round(avg(val) FILTER (WHERE val > -0.05), 6) AS mean FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS val, CAST(generate_subscripts(embedding, 1) AS BIGINT) - 1 AS pos FROM embeddings) GROUP BY label, pos")
def a28(t):
    e = t("embeddings").select("label", F.posexplode("embedding").alias("p", "x")).select("label", F.col("p").cast("bigint").alias("pos"), F.col("x").cast("double").alias("val"))
    return e.groupBy("label", "pos").agg(F.round(F.avg(F.when(F.col("val") > -0.05, F.col("val"))), 6).alias("mean"))


@query("a31_regression_metrics", PRED + f"SELECT flag, {metrics_sql()} FROM p GROUP BY flag")
def a31(t):
    return predictions(t).groupBy("flag").agg(*R.regression_metrics("obs", "pred"))


@query("a32_metrics_by_many", PRED + " UNION ALL ".join(f"SELECT '{k}' AS group_variable, CAST({c} AS VARCHAR) AS group_value, {metrics_sql()} FROM p GROUP BY {c}" for k, c in (("tile", "tile"), ("month", "mo"), ("mode", "mode"), ("year", "yr"))))
def a32(t):
    return R.metrics_by(predictions(t), {"tile": "tile", "month": "mo", "mode": "mode", "year": "yr"}, "obs", "pred")


@query("a33_metrics_with_empty_bins", PRED + f", b AS (SELECT CAST(i AS DOUBLE) * 0.25 AS lo FROM range(0, 8) r(i)) SELECT lo, COUNT(obs) AS n, round(sqrt(avg((pred - obs) * (pred - obs))), 8) AS rmse, round(avg(pred - obs), 8) AS bias FROM b LEFT JOIN p ON obs >= lo AND obs < lo + 0.25 GROUP BY lo")
def a33(t):
    b = t.spark.range(0, 8).select((F.col("id").cast("double") * 0.25).alias("lo"))
    e = F.col("pred") - F.col("obs")
    g = predictions(t).groupBy((F.floor(F.col("obs") / 0.25).cast("double") * 0.25).alias("lo")).agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(e * e)), 8).alias("rmse"), F.round(F.avg(e), 8).alias("bias"))
    return R.complete(g, b, ["lo"], {"n": 0})


@query("a34_metric_matrix", PRED + "SELECT tile, " + ", ".join(f"CASE WHEN COUNT(*) FILTER (WHERE mo = {m}) >= 10 THEN round(avg(pred - obs) FILTER (WHERE mo = {m}), 8) END AS bias_{m}" for m in (4, 5, 6)) + " FROM p GROUP BY tile")
def a34(t):
    p = predictions(t)
    e = F.when(F.count("*") >= 10, F.round(F.avg(F.col("pred") - F.col("obs")), 8))
    cell = p.filter("mo in (4, 5, 6)").groupBy("tile", "mo").agg(e.alias("bias"))
    return cell.groupBy("tile").pivot("mo", [4, 5, 6]).agg(F.first("bias")).select("tile", *[F.col(str(m)).alias(f"bias_{m}") for m in (4, 5, 6)])


@query("a35_a36_a37_support", PRED + "SELECT mo, COUNT(*) AS n, COUNT(DISTINCT d) AS n_dates, COUNT(DISTINCT tile) AS n_tiles, COUNT(*) FILTER (WHERE yr < 2000) AS n_train, round(quantile_cont(pred - obs, 0.25), 8) AS q25, round(quantile_cont(pred - obs, 0.75), 8) AS q75 FROM p GROUP BY mo")
def a35(t):
    p = predictions(t).withColumn("e", F.col("pred") - F.col("obs"))
    g = p.groupBy("mo").agg(F.count("*").alias("n"), F.countDistinct("d").alias("n_dates"), F.countDistinct("tile").alias("n_tiles"), F.count_if(F.col("yr") < 2000).alias("n_train"))
    quartiles = R.exact_quantiles(p, ["mo"], "e", (0.25, 0.75)).select("mo", *[F.round(F.col("p")[k], 8).alias(n) for k, n in enumerate(("q25", "q75"))])
    return R.left_join_null_safe(g, quartiles, ["mo"])


@query("a38_stability_reduction", S + f", g AS (SELECT tile, d, {mean_sql('v')} AS m FROM s GROUP BY tile, d) SELECT round(100 * (1 - (SELECT stddev_samp(m) FROM g) / (SELECT stddev_samp(v) FROM s)), 6) AS sd_reduction")
def a38(t):
    g = t.s.groupBy("tile", "d").agg(R.mean_exact(F.col("v")).alias("m")).agg(F.stddev_samp("m").alias("a"))
    return g.crossJoin(t.s.agg(F.stddev_samp("v").alias("b"))).select(F.round(100 * (1 - F.col("a") / F.col("b")), 6).alias("sd_reduction"))


@query("a40_a41_log_rollup", "SELECT o_custkey, COUNT(*) AS n, string_agg(DISTINCT o_orderstatus, ';' ORDER BY o_orderstatus) AS statuses, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS n_ok, date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) AS span_days, median(o_totalprice) AS mid FROM orders GROUP BY o_custkey")
def a40(t):
    d = F.to_date("o_orderdate")
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), R.sorted_distinct(F.col("o_orderstatus")).alias("statuses"), F.count_if(F.col("o_orderstatus") == "F").alias("n_ok"), F.datediff(F.max(d), F.min(d)).cast("bigint").alias("span_days"), F.percentile("o_totalprice", 0.5).alias("mid"))


@query("a43_a44_two_level_loss", PRED + ", l AS (SELECT ok, avg(CASE WHEN abs(pred - obs) < 0.1 THEN 0.5 * (pred - obs) * (pred - obs) / 0.1 ELSE abs(pred - obs) - 0.05 END) AS loss, SUM(pred * disc) / greatest(SUM(disc), 1e-8) AS wpred FROM p GROUP BY ok) SELECT round(avg(loss), 8) AS loss, round(avg(wpred), 6) AS mean_wpred, COUNT(*) AS n FROM l")
def a43(t):
    e = F.abs(F.col("pred") - F.col("obs"))
    huber = F.when(e < 0.1, 0.5 * e * e / 0.1).otherwise(e - 0.05)
    g = predictions(t).groupBy("ok").agg(F.avg(huber).alias("loss"), (F.sum(F.col("pred") * F.col("disc")) / F.greatest(F.sum("disc"), F.lit(1e-8))).alias("wpred"))
    return g.agg(F.round(F.avg("loss"), 8).alias("loss"), F.round(F.avg("wpred"), 6).alias("mean_wpred"), F.count("*").alias("n"))


@query("a45_a47_threshold_profile", S + "SELECT COUNT(*) FILTER (WHERE v > 1000) AS gt_1000, COUNT(*) FILTER (WHERE v > 10000) AS gt_10000, COUNT(*) FILTER (WHERE v > 50000) AS gt_50000, COUNT(*) FILTER (WHERE v < 1000 OR v > 100000) AS n_outside, min(v) AS lo, max(v) AS hi FROM s")
def a47(t):
    v = F.col("v")
    return t.s.agg(*[F.count_if(v > k).alias(f"gt_{k}") for k in (1000, 10000, 50000)], F.count_if((v < 1000) | (v > 100000)).alias("n_outside"), F.min("v").alias("lo"), F.max("v").alias("hi"))


@query("a48_selected_band_mean", S + f"SELECT tile, 'q' AS band, {mean_sql('q')} AS mean_q FROM s GROUP BY tile")
def a48(t):
    long = R.stack(t.s, ["tile"], ["v", "q", "disc"], "band", "value").filter("band = 'q'")
    return long.groupBy("tile", "band").agg(R.mean_exact(F.col("value")).alias("mean_q"))


@query("w01_w10_global_rank", S + "SELECT sid, row_number() OVER (ORDER BY d, sid) AS rank FROM s")
def w01(t):
    return R.global_rank(t.s.select("sid", "d"), F.struct("d", F.substring("sid", 1, 1)), F.col("d"), F.col("sid")).select("sid", "rank")


@query("w02_w03_w13_in_group", S + "SELECT sid, row_number() OVER (PARTITION BY ok ORDER BY sid) AS idx, COUNT(*) OVER (PARTITION BY ok) AS size, 1 / CAST(COUNT(*) OVER (PARTITION BY ok) AS DOUBLE) AS weight FROM s")
def w02(t):
    w = Window.partitionBy("ok")
    n = F.count("*").over(w)
    return t.s.select("sid", F.row_number().over(w.orderBy("sid")).cast("bigint").alias("idx"), n.alias("size"), (1 / n.cast("double")).alias("weight"))


@query("w04_o07_top_n_per_group", S + "SELECT tile, mo, sid, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY tile, mo ORDER BY v DESC, sid) AS r FROM s) WHERE r <= 3")
def w04(t):
    return R.first_by(t.s, ["tile", "mo"], F.col("v").desc(), F.col("sid"), n=3, rank="rank").select("tile", "mo", "sid", "rank")


@query("w06_w11_dominant_class", S + ", c AS (SELECT tile, ln, COUNT(*) AS n FROM s GROUP BY tile, ln) SELECT tile, ln AS dominant, n FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY n DESC, ln) AS r FROM c) WHERE r = 1")
def w06(t):
    c = t.s.groupBy("tile", "ln").agg(F.count("*").alias("n"))
    return R.first_by(c, ["tile"], F.col("n").desc(), F.col("ln")).select("tile", F.col("ln").alias("dominant"), "n")


@query("w12_quintile_by_rank", S + ", r AS (SELECT sid, row_number() OVER (ORDER BY v, sid) AS k, COUNT(*) OVER () AS n FROM s) SELECT sid, CAST(CAST(k > 1 + (n - 1) * 1 / 5.0::DOUBLE AS INT) + CAST(k > 1 + (n - 1) * 2 / 5.0::DOUBLE AS INT) + CAST(k > 1 + (n - 1) * 3 / 5.0::DOUBLE AS INT) + CAST(k > 1 + (n - 1) * 4 / 5.0::DOUBLE AS INT) AS BIGINT) AS bin FROM r")
def w12(t):
    return R.quantile_bins_by_rank(t.s.select("sid", "v"), F.floor(F.col("v") / 100), F.col("v"), F.col("sid")).select("sid", "bin")


@query("w14_weight_by_mean", S + f"SELECT sid, round(v / ({mean_sql('v')} OVER ()), 8) AS w FROM s".replace("CAST(SUM(CAST(v AS DECIMAL(18,2))) AS DOUBLE) / COUNT(v) OVER ()", "(SELECT CAST(SUM(CAST(v AS DECIMAL(18,2))) AS DOUBLE) / COUNT(v) FROM s)"))
def w14(t):
    m = t.s.agg(R.mean_exact(F.col("v")).alias("m"))
    return t.s.crossJoin(F.broadcast(m)).select("sid", F.round(F.col("v") / F.col("m"), 8).alias("w"))


@query("w15_level_fraction", S + "SELECT mode, flag, COUNT(*) AS n, COUNT(*) / CAST(SUM(COUNT(*)) OVER (PARTITION BY mode) AS DOUBLE) AS fraction FROM s GROUP BY mode, flag")
def w15(t):
    g = t.s.groupBy("mode", "flag").agg(F.count("*").alias("n"))
    return g.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy("mode")).cast("double"))


@query("w16_group_offsets", S + ", r AS (SELECT tile, ok, row_number() OVER (PARTITION BY tile ORDER BY ok, sid) - 1 AS k FROM s) SELECT tile, ok, min(k) AS first_row, max(k) + 1 AS end_row FROM r GROUP BY tile, ok")
def w16(t):
    r = t.s.select("tile", "ok", (F.row_number().over(Window.partitionBy("tile").orderBy("ok", "sid")) - 1).cast("bigint").alias("k"))
    return r.groupBy("tile", "ok").agg(F.min("k").alias("first_row"), (F.max("k") + 1).alias("end_row"))


@query("o01_o04_top_n", S + "SELECT sid, v, q FROM s ORDER BY v DESC, q, sid LIMIT 100")
def o01(t):
    return t.s.orderBy(F.col("v").desc(), "q", "sid").limit(100).select("sid", "v", "q")


@query("o02_o03_category_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY list_position(['3-MEDIUM', '1-URGENT', '5-LOW'], o_orderpriority) NULLS LAST, o_orderkey) AS rank FROM orders")
def o02(t):
    order = F.array_position(F.array(F.lit("3-MEDIUM"), F.lit("1-URGENT"), F.lit("5-LOW")), F.col("o_orderpriority"))
    w = Window.partitionBy("o_custkey").orderBy(F.nullif(order, F.lit(0)).asc_nulls_last(), "o_orderkey")
    return t("orders").select("o_orderkey", F.row_number().over(w).cast("bigint").alias("rank"))


@query("o06_hash_sample", S + "SELECT sid FROM s ORDER BY md5(concat_ws('-', sid, '42')), sid LIMIT 500")
def o06(t):
    return sampling.hash_sample(t.s.select("sid"), 500, "sid")


@query("o10_one_per_date", S + "SELECT d, sid FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY md5(concat_ws('-', sid, '42')), sid) AS r FROM s) WHERE r = 1")
def o10(t):
    return R.first_by(t.s, ["d"], R.hash_order("sid"), F.col("sid")).select("d", "sid")


@query("o12_candidate_ranking", S + "SELECT tile, sid, CAST(round(q * 2 - abs(mo - 6)) AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY round(q * 2 - abs(mo - 6)) DESC, sid) AS r FROM s WHERE flag <> 'R') WHERE r = 1")
def o12(t):
    score = F.round(F.col("q") * 2 - F.abs(F.col("mo") - 6)).cast("bigint")
    best = t.s.filter("flag <> 'R'").groupBy("tile").agg(F.min(F.struct((-score).alias("k"), F.col("sid"))).alias("b"))
    return best.select("tile", "b.sid", (-F.col("b.k")).alias("score"))


QUERIES, SQL = base.QUERIES, base.SQL
