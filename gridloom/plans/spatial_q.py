"""Queries of spatial operators, rasters in long form, and algorithms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import algorithms as A
from ..operators import near as N
from ..operators import relational as R
from . import base
from .aggregates_q import PRED, predictions
from .base import S, query

#: A raster of 8 x 8 cells for each vector: row, col, value, and a class code from the value.
PX = """WITH px AS (SELECT vec_id, label, CAST((pos - 1) // 8 AS BIGINT) AS row, CAST((pos - 1) % 8 AS BIGINT) AS col, CAST(val AS DOUBLE) AS val,
 CAST(abs(CAST(floor(CAST(val AS DOUBLE) * 1000) AS BIGINT)) % 5 AS BIGINT) AS code FROM (SELECT vec_id, label, unnest(embedding) AS val, generate_subscripts(embedding, 1) AS pos FROM embeddings)) """


def pixels(t):
    e = t("embeddings").select("vec_id", "label", F.posexplode("embedding").alias("p", "x"))
    return e.select("vec_id", "label", F.expr("p div 8").alias("row"), F.expr("cast(p % 8 as bigint)").alias("col"), F.col("x").cast("double").alias("val")).withColumn("code", F.abs(F.floor(F.col("val") * 1000)) % 5)


_CORNERS = ("x", "x + 1300", "x + 1500 + q", "x + 100"), ("y", "y + 50", "y + 2200", "y + 2100 + q")


def _shoelace_sql() -> str:
    xs, ys = _CORNERS
    return " + ".join(f"(({xs[i]}) * ({ys[(i + 1) % 4]}) - ({xs[(i + 1) % 4]}) * ({ys[i]}))" for i in range(4))


@query("g01_g02_g05_centroid_area", S + f""", c AS (SELECT sid, CASE WHEN ln = 7 THEN 0 ELSE 1 END AS ok, x, y, q, {_shoelace_sql()} AS a2, """ + ", ".join(f"(({_CORNERS[0][i]}) * ({_CORNERS[1][(i + 1) % 4]}) - ({_CORNERS[0][(i + 1) % 4]}) * ({_CORNERS[1][i]})) AS c{i}" for i in range(4)) + " FROM s) SELECT sid, round(abs(a2) / 2, 4) AS area, round((" + " + ".join(f"(({_CORNERS[0][i]}) + ({_CORNERS[0][(i + 1) % 4]})) * c{i}" for i in range(4)) + ") / (3 * a2), 4) AS cx, round((" + " + ".join(f"(({_CORNERS[1][i]}) + ({_CORNERS[1][(i + 1) % 4]})) * c{i}" for i in range(4)) + ") / (3 * a2), 4) AS cy FROM c")
def g02(t):
    xs, ys = [F.expr(e) for e in _CORNERS[0]], [F.expr(e) for e in _CORNERS[1]]
    cx, cy = X.centroid(xs, ys)
    return t.s.select("sid", F.round(X.shoelace_area(xs, ys), 4).alias("area"), F.round(cx, 4).alias("cx"), F.round(cy, 4).alias("cy"))


@query("g03_g04_g32_projections", S + """, ll AS (SELECT sid, 6 + x / 12000 AS lon, 47 + y / 14000 AS lat FROM s), k AS (SELECT *, 6371007.181 * sqrt(2 / (1 + sin(radians(52)) * sin(radians(lat)) + cos(radians(52)) * cos(radians(lat)) * cos(radians(lon - 10)))) AS kk FROM ll)
SELECT sid, round(6371007.181 * radians(lon) * cos(radians(lat)), 2) AS sx, round(6371007.181 * radians(lat), 2) AS sy, round(kk * cos(radians(lat)) * sin(radians(lon - 10)), 2) AS ex, round(kk * (cos(radians(52)) * sin(radians(lat)) - sin(radians(52)) * cos(radians(lat)) * cos(radians(lon - 10))), 2) AS ey FROM k""")
def g04(t):
    ll = t.s.select("sid", (6 + F.col("x") / 12000).alias("lon"), (47 + F.col("y") / 14000).alias("lat"))
    (sx, sy), (ex, ey) = X.sinusoidal("lon", "lat"), X.laea("lon", "lat")
    return ll.select("sid", *[F.round(c, 2).alias(n) for c, n in ((sx, "sx"), (sy, "sy"), (ex, "ex"), (ey, "ey"))])


@query("g06_g24_grid_cells", S + "SELECT sid, CAST(floor(x / 4000) AS BIGINT) AS cell_col, CAST(floor((109800 - y) / 4000) AS BIGINT) AS cell_row, floor(x / 4000) * 4000 AS cell_xmin, 109800 - (floor((109800 - y) / 4000) + 1) * 4000 AS cell_ymin, floor(x / 4000) < 27 AND floor((109800 - y) / 4000) < 27 AS inside FROM s")
def g06(t):
    c, r = F.floor(F.col("x") / 4000), F.floor((109800 - F.col("y")) / 4000)
    return t.s.select("sid", c.alias("cell_col"), r.alias("cell_row"), (c * 4000.0).alias("cell_xmin"), (109800 - (r + 1) * 4000.0).alias("cell_ymin"), ((c < 27) & (r < 27)).alias("inside"))


@query("g07_several_sizes", S + "SELECT size, CAST(floor(x / (size * 250)) AS BIGINT) AS gx, CAST(floor(y / (size * 250)) AS BIGINT) AS gy, COUNT(*) AS n FROM s CROSS JOIN (SELECT unnest([16, 24, 32]) AS size) GROUP BY 1, 2, 3")
def g07(t):
    e = t.s.select("x", "y", F.explode(F.array(*[F.lit(k) for k in (16, 24, 32)])).alias("size"))
    cell = lambda c: F.floor(F.col(c) / (F.col("size") * 250))
    return e.groupBy("size", cell("x").alias("gx"), cell("y").alias("gy")).agg(F.count("*").alias("n"))


@query("g08_g09_snap_and_reasons", S + "SELECT sid, CAST(greatest(0, least(5490 - 64, floor(x / 20) - 32)) AS BIGINT) AS col_off, CASE WHEN floor(x / 20) < 32 THEN 'west_border' WHEN floor(x / 20) > 5490 - 32 THEN 'east_border' WHEN floor(y / 20) < 32 OR floor(y / 20) > 5490 - 32 THEN 'row_border' ELSE 'ok' END AS reason FROM s")
def g08(t):
    px, py = F.floor(F.col("x") / 20), F.floor(F.col("y") / 20)
    why = F.when(px < 32, "west_border").when(px > 5490 - 32, "east_border").when((py < 32) | (py > 5490 - 32), "row_border").otherwise("ok")
    return t.s.select("sid", F.greatest(F.lit(0), F.least(F.lit(5490 - 64), px - 32)).cast("bigint").alias("col_off"), why.alias("reason"))


@query("g10_g11_chunks_extents", S + "SELECT CAST(floor(x / 25000) AS BIGINT) AS chunk_x, CAST(floor(y / 25000) AS BIGINT) AS chunk_y, COUNT(*) AS n, CASE WHEN least(max(x) + 500, 100000) > greatest(min(x) - 500, 10000) THEN greatest(min(x) - 500, 10000) END AS xmin, CASE WHEN least(max(x) + 500, 100000) > greatest(min(x) - 500, 10000) THEN least(max(x) + 500, 100000) END AS xmax FROM s GROUP BY 1, 2")
def g10(t):
    lo, hi = F.greatest(F.min("x") - 500, F.lit(10000.0)), F.least(F.max("x") + 500, F.lit(100000.0))
    return t.s.groupBy(F.floor(F.col("x") / 25000).alias("chunk_x"), F.floor(F.col("y") / 25000).alias("chunk_y")).agg(F.count("*").alias("n"), F.when(hi > lo, lo).alias("xmin"), F.when(hi > lo, hi).alias("xmax"))


@query("g14_a25_zonal_mean", PX + "SELECT label, code, round(avg(val), 8) AS mean, COUNT(*) AS n, round(SUM(val), 6) AS total FROM px GROUP BY label, code")
def g14(t):
    return pixels(t).groupBy("label", "code").agg(F.round(F.avg("val"), 8).alias("mean"), F.count("*").alias("n"), F.round(F.sum("val"), 6).alias("total"))


@query("g15_g31_mosaics", PX + "SELECT label, row, col, round(avg(val), 8) AS mosaic_mean, arg_min(val, vec_id) FILTER (WHERE val > 0) AS first_valid FROM px GROUP BY label, row, col")
def g15(t):
    first = F.min(F.when(F.col("val") > 0, F.struct("vec_id", "val")))["val"]
    return pixels(t).groupBy("label", "row", "col").agg(F.round(F.avg("val"), 8).alias("mosaic_mean"), first.alias("first_valid"))


@query("g16_a29_block_average", PX + "SELECT vec_id, row // 2 AS row2, col // 2 AS col2, round(avg(val), 8) AS mean FROM px GROUP BY 1, 2, 3")
def g16(t):
    return pixels(t).groupBy("vec_id", F.expr("row div 2").alias("row2"), F.expr("col div 2").alias("col2")).agg(F.round(F.avg("val"), 8).alias("mean"))


@query("g16_bilinear", PX + "SELECT a.vec_id, a.row, a.col, round(0.25 * (a.val + b.val + c.val + e.val), 8) AS half_step FROM px a JOIN px b ON a.vec_id = b.vec_id AND b.row = a.row AND b.col = a.col + 1 JOIN px c ON a.vec_id = c.vec_id AND c.row = a.row + 1 AND c.col = a.col JOIN px e ON a.vec_id = e.vec_id AND e.row = a.row + 1 AND e.col = a.col + 1")
def g16b(t):
    # each pixel gives a quarter to the four half-step places around it: one aggregate instead of three joins
    p = pixels(t)
    give = F.explode(F.array(*[F.struct((F.col("row") - i).alias("r"), (F.col("col") - j).alias("c")) for i in (0, 1) for j in (0, 1)]))
    g = p.select("vec_id", "val", give.alias("g")).groupBy("vec_id", F.col("g.r").alias("row"), F.col("g.c").alias("col")).agg(F.sum("val").alias("s"), F.count("*").alias("n"))
    return g.filter("n = 4").select("vec_id", "row", "col", F.round(0.25 * F.col("s"), 8).alias("half_step"))


@query("g17_g19_masks", PX + ", m AS (SELECT *, CASE WHEN code IN (1, 2) THEN val * 10 END AS kept, code = 0 AND val <= 0.1 AS bad FROM px) SELECT vec_id, COUNT(kept) AS n_kept, avg(CAST(bad AS DOUBLE)) AS bad_fraction, avg(CAST(bad AS DOUBLE)) > 0.1 AS contaminated FROM m GROUP BY vec_id")
def g17(t):
    m = pixels(t).select("vec_id", F.when(F.col("code").isin(1, 2), F.col("val") * 10).alias("kept"), ((F.col("code") == 0) & (F.col("val") <= 0.1)).alias("bad"))
    bad = F.avg(F.col("bad").cast("double"))
    return m.groupBy("vec_id").agg(F.count("kept").alias("n_kept"), bad.alias("bad_fraction"), (bad > 0.1).alias("contaminated"))


@query("g18_g20_g21_class_fractions", PX + "SELECT vec_id, avg(CAST(code IN (1, 2) AS DOUBLE)) AS crop, avg(CAST(code = 0 AS DOUBLE)) AS none, avg(CAST(code IN (1, 2) AS DOUBLE)) >= 1 - 1e-6 AS strict, mode(code ORDER BY code) AS modal FROM px GROUP BY vec_id")
def g20(t):
    f = lambda c: F.avg(c.cast("double"))
    crop = f(F.col("code").isin(1, 2))
    return pixels(t).groupBy("vec_id").agg(crop.alias("crop"), f(F.col("code") == 0).alias("none"), (crop >= 1 - 1e-6).alias("strict"), F.mode("code", True).alias("modal"))


@query("g22_g23_occupied_blocks", S + "SELECT tile, CAST(floor(x / 10240) AS BIGINT) AS bx, CAST(floor(y / 10240) AS BIGINT) AS block_y, greatest(0, floor(x / 10240) * 10240 - 320) AS x_from, least(109800, floor(x / 10240) * 10240 + 10560) AS x_to, COUNT(*) AS n FROM s GROUP BY 1, 2, 3, 4, 5")
def g22(t):
    b = lambda c: F.floor(F.col(c) / 10240)
    lo = b("x").cast("double") * 10240
    return t.s.groupBy("tile", b("x").alias("bx"), b("y").alias("block_y"), F.greatest(F.lit(0.0), lo - 320).alias("x_from"), F.least(F.lit(109800.0), lo + 10560).alias("x_to")).agg(F.count("*").alias("n"))


@query("g25_pair_distance", "SELECT c_custkey, round(sqrt((c_custkey % 97 - 50) * (c_custkey % 97 - 50) + (c_nationkey - 10) * (c_nationkey - 10)), 8) AS dist FROM customer")
def g25(t):
    return t("customer").select("c_custkey", F.round(F.hypot(F.col("c_custkey") % 97 - 50, F.col("c_nationkey") - 10), 8).alias("dist"))


@query("g29_local_moran", PX + ", z AS (SELECT vec_id, row, col, (val - avg(val) OVER (PARTITION BY vec_id)) / stddev_pop(val) OVER (PARTITION BY vec_id) AS z FROM px) SELECT a.vec_id, a.row, a.col, round(any_value(a.z) * avg(b.z), 6) + 0.0 AS moran_i FROM z a JOIN z b ON a.vec_id = b.vec_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND NOT (a.row = b.row AND a.col = b.col) GROUP BY 1, 2, 3")
def g29(t):
    w = Window.partitionBy("vec_id")
    z = pixels(t).withColumn("z", (F.col("val") - F.avg("val").over(w)) / F.stddev_pop("val").over(w))
    give = F.explode(F.array(*[F.struct((F.col("row") + i).alias("r"), (F.col("col") + j).alias("c")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]))
    near = z.select("vec_id", "z", give.alias("g")).groupBy("vec_id", F.col("g.r").alias("row"), F.col("g.c").alias("col")).agg(F.avg("z").alias("m"))
    return z.join(near, ["vec_id", "row", "col"]).select("vec_id", "row", "col", (F.round(F.col("z") * F.col("m"), 6) + 0.0).alias("moran_i"))


@query("g30_s14_windowed_pixels", PX + "SELECT vec_id, row, col, 300000 + (col + 0.5::DOUBLE) * 20 AS px, 5900000 - (row + 0.5::DOUBLE) * 20 AS py, val FROM px WHERE row BETWEEN 2 AND 5 AND col BETWEEN 1 AND 6")
def g30(t):
    w = pixels(t).filter(F.col("row").between(2, 5) & F.col("col").between(1, 6))
    return w.select("vec_id", "row", "col", (300000 + (F.col("col") + 0.5) * 20).alias("px"), (5900000 - (F.col("row") + 0.5) * 20).alias("py"), "val")


@query("m01_density_clusters", S + """, pts AS (SELECT sid, tile, yr, mo, x, y FROM s), nb AS (SELECT a.sid AS a, b.sid AS b FROM pts a JOIN pts b ON a.tile = b.tile AND a.yr = b.yr AND a.mo = b.mo AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 36000000),
core AS (SELECT a FROM nb GROUP BY a HAVING COUNT(*) >= 4), ce AS (SELECT nb.a, nb.b FROM nb WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)),
reach AS (WITH RECURSIVE r AS (SELECT a AS root, a AS node FROM core UNION SELECT r.root, ce.b FROM r JOIN ce ON r.node = ce.a) SELECT node, min(root) AS cluster FROM r GROUP BY node),
mem AS (SELECT nb.b AS sid, cluster, row_number() OVER (PARTITION BY nb.b ORDER BY CAST(nb.a <> nb.b AS INT), nb.a) AS k, nb.a = nb.b AS core FROM nb JOIN reach ON nb.a = reach.node) SELECT sid, cluster, core FROM mem WHERE k = 1""")
def m01(t):
    return A.density_clusters(t.s, "sid", ["tile", "yr", "mo"], "x", "y", 6000.0, 4)


@query("m02_principal_axis", S + ", c AS (SELECT tile, yr, mo, avg(x) AS mx, avg(y) AS my, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS an, var_pop(x) + var_pop(y) AS tot FROM s GROUP BY 1, 2, 3) SELECT sid, round(CASE WHEN tot > 0 THEN (CASE WHEN round(cos(an), 9) < 0 OR (round(cos(an), 9) = 0 AND sin(an) < 0) THEN -1 ELSE 1 END) * ((x - mx) * cos(an) + (y - my) * sin(an)) ELSE x END, 3) + 0.0 AS score FROM s JOIN c USING (tile, yr, mo)")
def m02(t):
    return A.principal_axis_score(t.s, ["tile", "yr", "mo"], "x", "y").select("sid", (F.round("score", 3) + 0.0).alias("score"))


@query("m03_m04_balanced_chunks", S + """, r AS (SELECT sid, tile, yr, mo, COUNT(*) OVER (PARTITION BY tile, yr, mo) AS n, row_number() OVER (PARTITION BY tile, yr, mo ORDER BY sid) - 1 AS r FROM s), k AS (SELECT *, CAST(greatest(1, least(ceil(n / 10.0::DOUBLE), floor(n / 4.0::DOUBLE))) AS BIGINT) AS k FROM r)
SELECT sid, CAST(CASE WHEN r < (n % k) * (n // k + 1) THEN r // (n // k + 1) ELSE n % k + (r - (n % k) * (n // k + 1)) // (n // k) END + 1 AS BIGINT) AS chunk FROM k""")
def m03(t):
    return A.balanced_chunks(t.s, ["tile", "yr", "mo"], F.col("sid"), low=4, high=10).select("sid", "chunk")


@query("m10_year_split", S + "SELECT CASE WHEN yr < 1999 THEN 'train' WHEN yr < 2001 THEN 'val' ELSE 'test' END AS split, COUNT(*) AS n FROM s GROUP BY 1")
def m10(t):
    return t.s.groupBy(F.when(F.col("yr") < 1999, "train").when(F.col("yr") < 2001, "val").otherwise("test").alias("split")).agg(F.count("*").alias("n"))


@query("m13_train_mean_impute", S + ", a AS (SELECT sid, yr, CASE WHEN ln <> 3 THEN q END AS q FROM s), m AS (SELECT avg(q) AS m FROM a WHERE yr < 1999) SELECT sid, round(coalesce(q, m), 8) AS q FROM a, m")
def m13(t):
    a = t.s.select("sid", "yr", F.when(F.col("ln") != 3, F.col("q")).alias("q"))
    return A.impute_train_mean(a, F.col("yr") < 1999, ["q"]).select("sid", F.round("q", 8).alias("q"))


@query("m15_linear_calibration", PRED + ", l AS (SELECT regr_slope(obs, pred) AS b, regr_intercept(obs, pred) AS a FROM p WHERE yr = 1999) SELECT sid, round(a + b * pred, 6) AS calibrated FROM p, l")
def m15(t):
    return A.calibrate(predictions(t), F.col("yr") == 1999, "obs", "pred").select("sid", F.round("calibrated", 6).alias("calibrated"))


@query("m20_m21_weight_maps", PX + ", w AS (SELECT label, row, col, SUM(CAST(code IN (1, 2) AS DOUBLE)) AS m FROM px GROUP BY 1, 2, 3), n AS (SELECT label, row, col, m / SUM(m) OVER (PARTITION BY label) AS w FROM w) SELECT label, round(SUM(w), 8) AS total, round(1 / SUM(w * w), 6) AS effective_pixels FROM n GROUP BY label")
def m21(t):
    w = pixels(t).groupBy("label", "row", "col").agg(F.sum(F.col("code").isin(1, 2).cast("double")).alias("m"))
    n = w.withColumn("w", F.col("m") / F.sum("m").over(Window.partitionBy("label")))
    return n.groupBy("label").agg(F.round(F.sum("w"), 8).alias("total"), F.round(1 / F.sum(F.col("w") * F.col("w")), 6).alias("effective_pixels"))


@query("m23_reliability", S + """, nb AS (SELECT * FROM (SELECT a.sid, b.v / 10000 AS o, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist, row_number() OVER (PARTITION BY a.sid ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.v) AS r FROM s a JOIN s b ON a.d = b.d AND a.sid <> b.sid AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 144000000) WHERE r <= 14),
m AS (SELECT sid, median(o) AS med, COUNT(*) AS n, max(dist) AS max_d FROM nb GROUP BY sid), e AS (SELECT nb.sid, median(abs(o - med)) AS mad FROM nb JOIN m ON nb.sid = m.sid GROUP BY nb.sid), x AS (SELECT sid, max(v) / 10000 AS x FROM s GROUP BY sid),
z AS (SELECT x.sid, x, coalesce(n, 0) AS n, max_d, med, mad, abs(x - med) / greatest(mad, 0.01) AS score FROM x LEFT JOIN m ON x.sid = m.sid LEFT JOIN e ON x.sid = e.sid)
SELECT sid, n, round(max_d, 4) AS max_d, round(med, 8) AS med, round(mad, 8) AS mad, round(CASE WHEN med IS NOT NULL THEN score END, 6) AS score, CASE WHEN n < 5 OR med IS NULL THEN 'keep' WHEN score >= 4 AND x < med THEN 'suspicious_low' WHEN score >= 4 AND x > med THEN 'suspicious_high' ELSE 'keep' END AS flag FROM z""")
def m23(t):
    rows = t.s.select(*base.SID, "x", "y", (F.col("v") / 10000).alias("value"))
    near = N.neighbour_statistics(rows, "sid", ["d"], "x", "y", 12000.0, 14, "value", late={"sid": base.sid()})
    r = A.reliability_flags(near)
    return r.select("sid", "n", F.round("max_d", 4).alias("max_d"), F.round("med", 8).alias("med"), F.round("mad", 8).alias("mad"), F.round("score", 6).alias("score"), "flag")


@query("m24_feature_range", S + ", r AS (SELECT min(v) AS lo, quantile_cont(v, 0.01) AS q01, avg(v) AS mean, quantile_cont(v, 0.99) AS q99, max(v) AS hi FROM s WHERE yr < 1999) SELECT tile, COUNT(*) FILTER (WHERE v BETWEEN lo AND hi) AS n_in, COUNT(*) FILTER (WHERE v BETWEEN q01 AND q99) AS n_core FROM s, r GROUP BY tile")
def m24(t):
    # the range is the quantiles 0 and 1
    r = R.exact_quantiles(t.s.filter("yr < 1999"), [], "v", (0.0, 0.01, 0.99, 1.0)).select(*[F.col("p")[i].alias(n) for i, n in enumerate(("lo", "q01", "q99", "hi"))])
    v = F.col("v")
    return t.s.crossJoin(F.broadcast(r)).groupBy("tile").agg(F.count_if(v.between(F.col("lo"), F.col("hi"))).alias("n_in"), F.count_if(v.between(F.col("q01"), F.col("q99"))).alias("n_core"))


@query("m25_d12_assembled_vectors", PX + "SELECT vec_id, label, round(list_sum(list(val ORDER BY row, col)), 6) AS total, len(list(val)) AS n, array_to_string(list(code ORDER BY row, col)[1:3], ',') AS first_codes, avg(CAST(val > 0 AS DOUBLE)) AS valid_fraction FROM px GROUP BY vec_id, label")
def m25(t):
    cells = F.array_sort(F.collect_list(F.struct("row", "col", "val", "code")))
    g = pixels(t).groupBy("vec_id", "label").agg(cells.alias("c"), F.avg((F.col("val") > 0).cast("double")).alias("valid_fraction"))
    total = F.aggregate("c", F.lit(0.0), lambda a, x: a + x["val"])
    return g.select("vec_id", "label", F.round(total, 6).alias("total"), F.size("c").cast("bigint").alias("n"), F.array_join(F.slice(F.transform("c", lambda x: x["code"].cast("string")), 1, 3), ",").alias("first_codes"), "valid_fraction")


@query("m26_slots_with_reasons", S + ", r AS (SELECT sid, ok, CASE WHEN q < 5 THEN 'too_small' WHEN disc > 0.09 THEN 'low_quality' ELSE 'kept' END AS reason FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY ok, reason ORDER BY sid) AS slot FROM r) SELECT ok, sid, CASE WHEN reason = 'kept' AND slot > 10 THEN 'over_cap' ELSE reason END AS reason, COUNT(*) FILTER (WHERE reason = 'kept') OVER (PARTITION BY ok) >= 4 AS enough FROM k")
def m26(t):
    r = t.s.withColumn("reason", F.when(F.col("q") < 5, "too_small").when(F.col("disc") > 0.09, "low_quality").otherwise("kept"))
    k = r.withColumn("slot", F.row_number().over(Window.partitionBy("ok", "reason").orderBy("sid")))
    n = F.sum((F.col("reason") == "kept").cast("int")).over(Window.partitionBy("ok"))
    return k.select("ok", "sid", F.when((F.col("reason") == "kept") & (F.col("slot") > 10), "over_cap").otherwise(F.col("reason")).alias("reason"), (n >= 4).alias("enough"))


@query("m27_early_stopping", S + """, h AS (SELECT tile, yr * 12 + mo - 1995 * 12 AS epoch, min(v) AS loss FROM s GROUP BY 1, 2), b AS (SELECT *, min(loss) OVER (PARTITION BY tile ORDER BY epoch) AS best FROM h), e AS (SELECT b.*, (SELECT min(h2.epoch) FROM h h2 WHERE h2.tile = b.tile AND h2.epoch <= b.epoch AND h2.loss = b.best) AS best_at FROM b),
st AS (SELECT tile, min(epoch) FILTER (WHERE epoch - best_at >= 12) AS stop_epoch FROM e GROUP BY tile) SELECT e.tile, arg_min(e.epoch, struct_pack(a := e.loss, b := e.epoch)) AS best_epoch, min(e.loss) AS best_loss, any_value(stop_epoch) AS stop_epoch FROM e JOIN st ON e.tile = st.tile WHERE stop_epoch IS NULL OR e.epoch <= stop_epoch GROUP BY e.tile""")
def m27(t):
    h = t.s.groupBy("tile", (F.col("yr") * 12 + F.col("mo") - 1995 * 12).alias("epoch")).agg(F.min("v").alias("loss"))
    return A.early_stop(h, "tile", "epoch", "loss", 12)


@query("m16_m17_m18_regressors")
def m16(t):
    from ..operators.models import compare_regressors

    data = t.s.groupBy("ok").agg(F.avg("q").alias("q"), F.avg("disc").alias("disc"), F.avg("tax").alias("tax"), F.count("*").cast("double").alias("n"), F.avg("v").alias("y"), F.min("yr").alias("yr"))
    return compare_regressors(data, ["q", "disc", "tax", "n"], "y", F.col("yr") < 1999)


QUERIES, SQL = base.QUERIES, base.SQL
