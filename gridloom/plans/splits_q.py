"""Queries of allocation, splits by groups and strata, leakage components, and the bootstrap."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import algorithms as A
from ..operators import sampling
from . import base
from .aggregates_q import PRED, predictions
from .base import S, query

_QUOTA = """, c AS (SELECT tile, mo, flag, COUNT(*) AS n FROM s GROUP BY tile, mo, flag), t AS (SELECT *, least({total}, SUM(n) OVER (PARTITION BY tile)) AS tot, SUM(n) OVER (PARTITION BY tile) AS alln, COUNT(*) OVER (PARTITION BY tile) AS k FROM c),
f AS (SELECT *, CAST(n * tot AS DOUBLE) / alln AS share FROM t), b AS (SELECT *, greatest(CAST(floor(share) AS BIGINT), CASE WHEN tot >= k THEN 1 ELSE 0 END) AS base FROM f), o AS (SELECT *, SUM(base) OVER (PARTITION BY tile) - tot AS over FROM b),
u AS (SELECT *, unnest(range(1, CAST(least(base - 1, over) AS BIGINT) + 1)) AS j FROM o WHERE over > 0), ur AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY base - (j - 1) - share DESC, mo, flag) AS r FROM u), g AS (SELECT tile, mo, flag, COUNT(*) AS gone FROM ur WHERE r <= over GROUP BY tile, mo, flag),
a AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY CAST(base < n AS INT) DESC, share - base DESC, mo, flag) AS r FROM o), quota AS (SELECT a.tile, a.mo, a.flag, n, CAST(base + CASE WHEN base < n AND r <= -over THEN 1 ELSE 0 END - coalesce(gone, 0) AS BIGINT) AS quota FROM a LEFT JOIN g USING (tile, mo, flag)) """


@query("o08_allocation", S + _QUOTA.format(total=150) + "SELECT * FROM quota")
def o08(t):
    return sampling.largest_remainder(t.s.groupBy("tile", "mo", "flag").agg(F.count("*").alias("n")), ["mo", "flag"], 150, within=["tile"])


@query("o08_too_many_strata", S + _QUOTA.format(total=30) + "SELECT * FROM quota")
def o08b(t):
    return sampling.largest_remainder(t.s.groupBy("tile", "mo", "flag").agg(F.count("*").alias("n")), ["mo", "flag"], 30, within=["tile"])


@query("o07_o09_stratified_sample", S + _QUOTA.format(total=100) + "SELECT tile, mo, flag, sid FROM (SELECT s.*, quota, row_number() OVER (PARTITION BY s.tile, s.mo, s.flag ORDER BY md5(concat_ws('-', sid, '42')), sid) AS r FROM s JOIN quota USING (tile, mo, flag)) WHERE r <= quota")
def o09(t):
    return sampling.stratified(t.s, ["mo", "flag"], 100, "sid", within=["tile"]).select("tile", "mo", "flag", "sid")


@query("m08_date_split", S + """, d1 AS (SELECT d, any_value(mo) AS mo, min(mode) AS mode FROM s GROUP BY d), r AS (SELECT *, COUNT(*) OVER (PARTITION BY mo, mode) AS n, row_number() OVER (PARTITION BY mo, mode ORDER BY md5(concat_ws('-', CAST(d AS VARCHAR), '42')), d) AS r FROM d1),
k AS (SELECT *, greatest(1, CAST(round_even(n * 0.15::DOUBLE, 0) AS BIGINT)) AS v0 FROM r), v AS (SELECT *, CASE WHEN v0 + v0 >= n THEN 1 ELSE v0 END AS v FROM k) SELECT d, mo, mode, CASE WHEN n < 3 THEN 'train' WHEN r <= v THEN 'val' WHEN r <= v + v THEN 'test' ELSE 'train' END AS split FROM v""")
def m08(t):
    dates = t.s.groupBy("d").agg(F.any_value("mo").alias("mo"), F.min("mode").alias("mode"))
    some = F.greatest(F.lit(1), F.bround(F.col("__n") * 0.15))
    n = F.when(some + some >= F.col("__n"), 1).otherwise(some)
    return sampling.split_by_rank(dates, ["mo", "mode"], "d", n, n, least=3).select("d", "mo", "mode", "split")


@query("m09_stratified_split", "WITH r AS (SELECT o_orderkey, o_orderpriority, COUNT(*) OVER (PARTITION BY o_orderpriority, o_orderstatus) AS n, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY md5(concat_ws('-', o_orderkey, '42')), o_orderkey) AS r FROM orders), k AS (SELECT *, greatest(1, CAST(floor(n * 0.15::DOUBLE) AS BIGINT)) AS v FROM r) SELECT o_orderkey, CASE WHEN r <= v THEN 'val' WHEN r <= v + v THEN 'test' ELSE 'train' END AS split FROM k")
def m09(t):
    n = F.greatest(F.lit(1), F.floor(F.col("__n") * 0.15))
    return sampling.split_by_rank(t("orders"), ["o_orderpriority", "o_orderstatus"], "o_orderkey", n, n).select("o_orderkey", "split")


@query("m11_group_folds", "WITH c AS (SELECT o_custkey, o_orderpriority, COUNT(*) AS c FROM orders GROUP BY 1, 2), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY c DESC, o_orderpriority) AS k FROM c) WHERE k = 1), f AS (SELECT o_custkey, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(concat_ws('-', o_custkey, '42')), o_custkey) - 1) % 5 AS fold FROM top) SELECT o_orderkey, fold, fold = 0 AS held_out FROM orders JOIN f USING (o_custkey)")
def m11(t):
    folds = sampling.group_folds(t("orders"), "o_custkey", "o_orderpriority", 5)
    return t("orders").join(folds, "o_custkey").select("o_orderkey", "fold", (F.col("fold") == 0).alias("held_out"))


@query("m12_two_stage_split", "WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY md5(concat_ws('-', c_custkey, '42')), c_custkey) AS r, ceil(round(COUNT(*) OVER () * 0.15::DOUBLE, 9)) AS n FROM customer), b AS (SELECT c_custkey, row_number() OVER (ORDER BY md5(concat_ws('-', c_custkey, '43')), c_custkey) AS r, ceil(round(COUNT(*) OVER () * (0.15::DOUBLE / 0.85::DOUBLE), 9)) AS n FROM a WHERE r > n) SELECT c_custkey, 'test' AS split FROM a WHERE r <= n UNION ALL SELECT c_custkey, CASE WHEN r <= n THEN 'val' ELSE 'train' END FROM b")
def m12(t):
    return sampling.two_stage_split(t("customer"), "c_custkey", 0.15, 0.15)


def _leakage_sql(rounds: int = 12) -> str:
    """Labels of dates pass to the products they hold and back, the smallest wins; so many rounds are enough here."""
    out = ["WITH e AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, o_custkey AS p FROM orders WHERE o_orderkey % 1 = 0), l0 AS (SELECT DISTINCT d, d AS l FROM e)"]
    for k in range(rounds):
        out.append(f"p{k} AS (SELECT p, min(l) AS l FROM e JOIN l{k} USING (d) GROUP BY p), l{k + 1} AS (SELECT d, min(p{k}.l) AS l FROM e JOIN p{k} USING (p) GROUP BY d)")
    return ", ".join(out) + f" SELECT concat('d:', CAST(l AS VARCHAR)) AS component, COUNT(*) AS n_rows, COUNT(DISTINCT CAST(o_orderdate AS DATE)) AS n_dates, COUNT(DISTINCT o_custkey) AS n_products FROM orders JOIN l{rounds} ON CAST(o_orderdate AS DATE) = d GROUP BY l"


@query("m05_m06_leakage_components", _leakage_sql().replace(" WHERE o_orderkey % 1 = 0", ""))
def m05(t):
    orders = t("orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), F.col("o_custkey").alias("product"))
    return A.leakage_components(orders, "d", "product").groupBy("component").agg(F.count("*").alias("n_rows"), F.countDistinct("d").alias("n_dates"), F.countDistinct("product").alias("n_products"))


@query("m07_balanced_split")
def m07(t):
    rows = t("orders").select("o_custkey", F.month("o_orderdate").alias("mo"), "o_orderpriority", "o_orderstatus")
    return A.balanced_component_split(rows, "o_custkey", ["mo", "o_orderpriority", "o_orderstatus"], {"train": 0.7, "val": 0.15, "test": 0.15}, restarts=16)


#: The test rows of the bootstrap: one a tile and month.
_REGIONS = PRED + ", g AS (SELECT tile, yr, mo, avg(obs) AS obs, avg(pred) AS a, avg(q) / 80 AS b FROM p GROUP BY tile, yr, mo), i AS (SELECT *, row_number() OVER (ORDER BY tile, yr, mo) - 1 AS i, COUNT(*) OVER () AS n FROM g)"


@query("o11_paired_bootstrap", _REGIONS + """, k AS (SELECT r.r AS draw, CAST(('0x' || substr(md5(concat_ws('-', r.r, i.i, '42')), 1, 12)) AS BIGINT) % n AS pick FROM range(0, 1000) r(r), i), w AS (SELECT draw, sqrt(avg((a - obs) * (a - obs))) AS ra, sqrt(avg((b - obs) * (b - obs))) AS rb FROM k JOIN i ON pick = i.i GROUP BY draw)
SELECT round(avg(rb - ra), 8) AS mean_gain, round(quantile_cont(rb - ra, 0.025), 8) AS low, round(quantile_cont(rb - ra, 0.975), 8) AS high, round(avg(100 * (rb - ra) / rb), 6) AS mean_reduction_pct, avg(CAST(rb - ra > 0 AS DOUBLE)) AS p_lower, round((SELECT sqrt(avg((b - obs) * (b - obs))) - sqrt(avg((a - obs) * (a - obs))) FROM i), 8) AS observed_gain FROM w""")
def o11(t):
    g = predictions(t).groupBy("tile", "yr", "mo").agg(F.avg("obs").alias("obs"), F.avg("pred").alias("a"), (F.avg("q") / 80).alias("b"))
    # one row a region and month: few, however many soundings there are
    i = g.withColumn("i", (F.row_number().over(Window.orderBy("tile", "yr", "mo")) - 1).cast("bigint"))
    from ..session import materialised

    i = materialised(i, "regions")
    rmse = lambda c: F.sqrt(F.avg((F.col(c) - F.col("obs")) * (F.col(c) - F.col("obs"))))
    draws = sampling.bootstrap_draws(i, "i", i.count(), 1000, [rmse("a").alias("ra"), rmse("b").alias("rb")]).withColumn("gain", F.col("rb") - F.col("ra"))
    ends = F.percentile("gain", F.array(F.lit(0.025), F.lit(0.975)))
    out = draws.agg(F.round(F.avg("gain"), 8).alias("mean_gain"), ends.alias("ci"), F.round(F.avg(100 * F.col("gain") / F.col("rb")), 6).alias("mean_reduction_pct"), F.avg((F.col("gain") > 0).cast("double")).alias("p_lower"))
    seen = i.agg(F.round(rmse("b") - rmse("a"), 8).alias("observed_gain"))
    return out.crossJoin(F.broadcast(seen)).select("mean_gain", F.round(F.col("ci")[0], 8).alias("low"), F.round(F.col("ci")[1], 8).alias("high"), "mean_reduction_pct", "p_lower", "observed_gain")


_PERMUTED = ", ".join(f"coalesce(lead({c}) OVER w, first_value({c}) OVER w) AS {c}_p" for c in ("q", "disc"))


@query("m22_a39_channel_importance", PRED + f""", e AS (SELECT p.*, r.r AS repeat FROM p, range(1, 4) r(r)), o AS (SELECT *, {_PERMUTED} FROM e WINDOW w AS (PARTITION BY repeat, tile, mo ORDER BY md5(concat_ws('-', sid, CAST(repeat AS VARCHAR))), sid)),
m AS (SELECT repeat, avg(abs(pred - obs)) AS base, avg(abs((v * 0.8 + q_p * 400 + disc * 9000) / 100000 - obs)) AS q, avg(abs((v * 0.8 + q * 400 + disc_p * 9000) / 100000 - obs)) AS disc FROM o GROUP BY repeat), l AS (SELECT 'q' AS channel, q - base AS rise FROM m UNION ALL SELECT 'disc', disc - base FROM m)
SELECT channel, round(avg(rise), 8) AS mean, round(stddev_samp(rise), 8) AS sd, round(min(rise), 8) AS low, round(max(rise), 8) AS high FROM l GROUP BY channel""")
def m22(t):
    p = predictions(t).select("sid", "tile", "mo", "v", "q", "disc", "obs", "pred").withColumn("repeat", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])))
    w = Window.partitionBy("repeat", "tile", "mo").orderBy(F.md5(F.concat_ws("-", "sid", F.col("repeat").cast("string"))), "sid")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    o = p.select("*", *[F.coalesce(F.lead(c).over(w), F.first(c).over(every)).alias(f"{c}_p") for c in ("q", "disc")])
    model = lambda q, disc: (F.col("v") * 0.8 + F.col(q) * 400 + F.col(disc) * 9000) / 100000
    mae = lambda m: F.avg(F.abs(m - F.col("obs")))
    m = o.groupBy("repeat").agg(mae(F.col("pred")).alias("base"), mae(model("q_p", "disc")).alias("q"), mae(model("q", "disc_p")).alias("disc"))
    rise = m.select((F.col("q") - F.col("base")).alias("q"), (F.col("disc") - F.col("base")).alias("disc")).unpivot([], ["q", "disc"], "channel", "rise")
    r = lambda c, n: F.round(c, 8).alias(n)
    return rise.groupBy("channel").agg(r(F.avg("rise"), "mean"), r(F.stddev_samp("rise"), "sd"), r(F.min("rise"), "low"), r(F.max("rise"), "high"))


QUERIES, SQL = base.QUERIES, base.SQL
