"""Queries of joins, set operations and reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import near as N
from ..operators import relational as R
from . import base
from .base import S, query


@query("j01_tile_domain_join", S + ", dom AS (SELECT concat('T', i) AS tile, i * 1000 AS domain_min FROM range(0, 6) r(i)) SELECT tile, domain_min, COUNT(*) AS n FROM s JOIN dom USING (tile) GROUP BY tile, domain_min")
def j01(t):
    dom = t.spark.range(0, 6).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("tile"), (F.col("id") * 1000).alias("domain_min"))
    return t.s.join(F.broadcast(dom), "tile").groupBy("tile", "domain_min").agg(F.count("*").alias("n"))


@query("j02_attach_group_aggregate", S + "SELECT sid, COUNT(*) OVER (PARTITION BY tile, d) AS n_group, max(v) OVER (PARTITION BY tile, d) AS max_v FROM s")
def j02(t):
    w = Window.partitionBy("tile", "d")
    return t.s.select("sid", F.count("*").over(w).alias("n_group"), F.max("v").over(w).alias("max_v"))


@query("j03_validity_interval", S + """, p AS (SELECT DISTINCT concat('T', o_custkey % 6) AS tile, year(o_orderdate) AS yr, month(o_orderdate) AS mo FROM orders WHERE month(o_orderdate) <> 2),
q AS (SELECT tile, yr, mo, make_date(yr, mo, 5) AS temporal_low, make_date(yr, mo, 20) AS temporal_high FROM p)
SELECT CASE WHEN temporal_low IS NULL THEN 'no_product' WHEN d BETWEEN temporal_low AND temporal_high THEN 'inrange' ELSE 'outrange' END AS date_align, s.tile, COUNT(*) AS n FROM s LEFT JOIN q ON s.tile = q.tile AND s.yr = q.yr AND s.mo = q.mo GROUP BY 1, 2""")
def j03(t):
    p = t("orders").select(F.concat(F.lit("T"), (F.col("o_custkey") % 6).cast("string")).alias("tile"), F.year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("mo"))
    p = p.filter("mo <> 2").select("tile", "yr", "mo").distinct()
    day = lambda n: F.make_date("yr", "mo", F.lit(n))
    p = p.withColumn("temporal_low", day(5)).withColumn("temporal_high", day(20))
    return R.interval_join(t.s, p, ["tile", "yr", "mo"], "d", "temporal_low", "temporal_high").groupBy("date_align", "tile").agg(F.count("*").alias("n"))


@query("j04_multi_key_join", "SELECT c_custkey, c_name, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j04(t):
    n = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return t("customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_name", "n_name", "r_name")


@query("j05_j06_checked_join", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j05(t):
    c = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return R.join_checked(t("orders"), c, ["o_custkey"], "left", "many_to_one").select("o_orderkey", "c_mktsegment")


@query("j07_rounded_key_join", S + ", a AS (SELECT sid, round(x / 3, 6) AS kx, round(y / 7, 6) AS ky, d FROM s), b AS (SELECT DISTINCT round(x / 3, 6) AS kx, round(y / 7, 6) AS ky, d, tile FROM s) SELECT sid, b.tile FROM a JOIN b ON a.kx = b.kx AND a.ky = b.ky AND a.d = b.d")
def j07(t):
    keys = [F.bround(F.col("x") / 3, 6).alias("kx"), F.bround(F.col("y") / 7, 6).alias("ky"), F.col("d")]
    a, b = t.s.select("sid", *keys), t.s.select(*keys, "tile").distinct()
    return a.join(b, ["kx", "ky", "d"]).select("sid", "tile")


@query("j08_full_outer_suffixes", "WITH a AS (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1), b AS (SELECT s_nationkey AS k, COUNT(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, a.n AS n_x, b.n AS n_y FROM a FULL JOIN b ON a.k = b.k")
def j08(t):
    a = t("customer").filter("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_x"))
    b = t("supplier").filter("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_y"))
    return a.join(b, "k", "full").select("k", "n_x", "n_y")


@query("j09_j10_fold_joins", S + """SELECT t.tile, m.mo, COUNT(s.sid) AS n, COUNT(s.sid) FILTER (WHERE flag = 'A') AS n_a, max(v) AS max_v, min(q) AS min_q FROM (SELECT DISTINCT tile FROM s) t CROSS JOIN (SELECT i AS mo FROM range(1, 13) r(i)) m LEFT JOIN s ON s.tile = t.tile AND s.mo = m.mo GROUP BY 1, 2""")
def j09(t):
    spine = t.s.select("tile").distinct().crossJoin(t.spark.range(1, 13).withColumnRenamed("id", "mo"))
    wide = t.s.groupBy("tile", "mo").agg(F.count("*").alias("n"), F.count_if(F.col("flag") == "A").alias("n_a"), F.max("v").alias("max_v"), F.min("q").alias("min_q"))
    return R.complete(wide, spine, ["tile", "mo"], {"n": 0, "n_a": 0})


@query("j12_j13_anti_joins", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j12(t):
    return t("customer").join(t("orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


_RING = [(10000.0, 10000.0), (70000.0, 20000.0), (90000.0, 80000.0), (40000.0, 60000.0), (15000.0, 95000.0)]


def _pip_sql() -> str:
    parts = []
    for (x1, y1), (x2, y2) in zip(_RING, _RING[1:] + _RING[:1], strict=True):
        parts.append(f"CASE WHEN y >= {min(y1, y2)} AND y < {max(y1, y2)} AND x < (y - {y1}) * ({(x2 - x1) / (y2 - y1)!r}::DOUBLE) + {x1} THEN 1 ELSE 0 END")
    return " + ".join(parts)


@query("j14_j22_point_in_polygon", S + f"SELECT sid FROM s WHERE x BETWEEN 10000 AND 90000 AND y BETWEEN 10000 AND 95000 AND ({_pip_sql()}) % 2 = 1")
def j14(t):
    box = F.col("x").between(10000, 90000) & F.col("y").between(10000, 95000)
    return t.s.filter(box & X.in_polygon("x", "y", _RING)).select("sid")


_BOXES = "SELECT i AS box_id, CAST((i * 7919) % 90000 AS DOUBLE) AS x0, CAST((i * 7919) % 90000 + 9000 AS DOUBLE) AS x1, CAST((i * 104729) % 90000 AS DOUBLE) AS y0, CAST((i * 104729) % 90000 + 12000 AS DOUBLE) AS y1 FROM range(0, 60) r(i)"


def _boxes(t) -> DataFrame:
    b = t.spark.range(0, 60).withColumnRenamed("id", "box_id")
    x, y = (F.col("box_id") * 7919) % 90000, (F.col("box_id") * 104729) % 90000
    return b.select("box_id", x.cast("double").alias("x0"), (x + 9000).cast("double").alias("x1"), y.cast("double").alias("y0"), (y + 12000).cast("double").alias("y1"))


@query("j14_boxes_containing", S + f", b AS ({_BOXES}) SELECT box_id, COUNT(*) AS n FROM s JOIN b ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY box_id")
def j14b(t):
    return R.boxes_containing(t.s.select("sid", "x", "y"), _boxes(t), "x", "y", 5000.0, ("x0", "y0"), ("x1", "y1")).groupBy("box_id").agg(F.count("*").alias("n"))


@query("j15_first_match", S + f", b AS ({_BOXES}) SELECT sid, min(box_id) AS box_id FROM s JOIN b ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY sid")
def j15(t):
    hit = R.boxes_containing(t.s.select("sid", "x", "y"), _boxes(t), "x", "y", 5000.0, ("x0", "y0"), ("x1", "y1"))
    return R.first_by(hit, ["sid"], F.col("box_id")).select("sid", "box_id")


@query("j16_j17_overlay_area", f"WITH b AS ({_BOXES}), o AS (SELECT a.box_id AS a_id, b.box_id AS b_id, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS area, a.x0 >= b.x0 AND a.x1 <= b.x1 AND a.y0 >= b.y0 AND a.y1 <= b.y1 AS covered FROM b a JOIN b b ON a.box_id < b.box_id) SELECT a_id, b_id, area, area / (9000.0::DOUBLE * 12000) AS share, covered FROM o WHERE area > 0")
def j16(t):
    b = _boxes(t)
    # overlapping boxes meet in the cell of their common lower corner
    w = 5000.0
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / w), F.floor(F.col(hi) / w)))
    cells = b.withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1"))
    p = cells.select(*[F.col(c).alias(f"a_{c}") for c in ("box_id", "x0", "x1", "y0", "y1")], "cx", "cy")
    q = cells.select(*[F.col(c).alias(f"b_{c}") for c in ("box_id", "x0", "x1", "y0", "y1")], "cx", "cy")
    lx, ly = F.greatest("a_x0", "b_x0"), F.greatest("a_y0", "b_y0")
    j = p.join(q, ["cx", "cy"]).filter((F.col("a_box_id") < F.col("b_box_id")) & (F.floor(lx / w) == F.col("cx")) & (F.floor(ly / w) == F.col("cy")))
    area = F.greatest(F.lit(0.0), F.least("a_x1", "b_x1") - lx) * F.greatest(F.lit(0.0), F.least("a_y1", "b_y1") - ly)
    covered = (F.col("a_x0") >= F.col("b_x0")) & (F.col("a_x1") <= F.col("b_x1")) & (F.col("a_y0") >= F.col("b_y0")) & (F.col("a_y1") <= F.col("b_y1"))
    return j.select(F.col("a_box_id").alias("a_id"), F.col("b_box_id").alias("b_id"), area.alias("area"), (area / (9000.0 * 12000)).alias("share"), covered.alias("covered")).filter("area > 0")


@query("j18_w05_neighbours_same_date", S + """, n AS (SELECT a.sid, b.sid AS other, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM s a JOIN s b ON a.d = b.d AND a.sid <> b.sid AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 36000000)
SELECT sid, other, round(dist, 4) AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY dist, other) AS rank FROM n) WHERE rank <= 14""")
def j18(t):
    near = N.nearest_within(t.s.select(*base.SID, "x", "y"), "sid", ["d"], "x", "y", 6000.0, 14, late={"sid": base.sid()})
    g = near.select("sid", F.posexplode("near").alias("pos", "o"))
    return g.select("sid", "o.other", F.round("o.dist", 4).alias("dist"), (F.col("pos") + 1).cast("bigint").alias("rank"))


@query("j19_k_nearest", S + f", b AS ({_BOXES}), n AS (SELECT box_id, s_suppkey, sqrt((x0 - sx) * (x0 - sx) + (y0 - sy) * (y0 - sy)) AS dist FROM b, (SELECT s_suppkey, CAST((s_suppkey * 7907) % 100000 AS DOUBLE) AS sx, CAST((s_suppkey * 6101) % 100000 AS DOUBLE) AS sy FROM supplier)) SELECT box_id, s_suppkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY box_id ORDER BY dist, s_suppkey) AS rank FROM n) WHERE rank <= 5")
def j19(t):
    p = t("supplier").select("s_suppkey", ((F.col("s_suppkey") * 7907) % 100000).cast("double").alias("sx"), ((F.col("s_suppkey") * 6101) % 100000).cast("double").alias("sy"))
    return R.k_nearest(_boxes(t), p, "box_id", "s_suppkey", ("x0", "y0"), ("sx", "sy"), 5, 10000.0).select("box_id", "s_suppkey", "rank")


@query("j21_asof_backward", "SELECT event_id, o_orderkey AS asof_key FROM events ASOF LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') ON event_id >= o_orderkey")
def j21(t):
    keys = t("orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("key"))
    return R.asof_backward(t("events").select("event_id"), keys, "event_id", "key", 1000).select("event_id", F.col("key").alias("asof_key"))


@query("j23_lookup_map", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END AS level FROM orders")
def j23(t):
    m = F.create_map(F.lit("1-URGENT"), F.lit(1), F.lit("2-HIGH"), F.lit(2), F.lit("3-MEDIUM"), F.lit(3))
    return t("orders").select("o_orderkey", F.try_element_at(m, F.col("o_orderpriority")).alias("level"))


@query("j25_latest_version", "SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def j25(t):
    return R.first_by(t("orders"), ["o_custkey"], F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("d"))


@query("r01_union_by_name", "SELECT 'c' AS src, c_custkey AS id, c_mktsegment AS seg, CAST(NULL AS VARCHAR) AS brand FROM customer UNION ALL SELECT 'p', p_partkey, NULL, p_brand FROM part")
def r01(t):
    a = t("customer").select(F.lit("c").alias("src"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"))
    return a.unionByName(t("part").select(F.lit("p").alias("src"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand")), allowMissingColumns=True)


@query("r02_j24_complete_spine", "SELECT seg, nk, coalesce(n, 0) AS n FROM (SELECT seg, nk FROM (SELECT DISTINCT c_mktsegment AS seg FROM customer) CROSS JOIN (SELECT n_nationkey AS nk FROM nation)) LEFT JOIN (SELECT c_mktsegment AS seg, c_nationkey AS nk, COUNT(*) AS n FROM customer GROUP BY 1, 2) USING (seg, nk)")
def r02(t):
    c = t("customer").select(F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nk"))
    spine = c.select("seg").distinct().crossJoin(F.broadcast(t("nation").select(F.col("n_nationkey").alias("nk"))))
    return R.complete(c.groupBy("seg", "nk").agg(F.count("*").alias("n")), spine, ["seg", "nk"], {"n": 0})


@query("r03_long_to_wide", S + "SELECT tile, " + ", ".join(f"CAST(SUM(CAST(q AS DECIMAL(18,2))) FILTER (WHERE mo = {m}) AS DOUBLE) AS q_{n}" for m, n in ((3, "march"), (4, "april"), (5, "may"))) + " FROM s GROUP BY tile")
def r03(t):
    wide = t.s.filter("mo in (3, 4, 5)").groupBy("tile").pivot("mo", [3, 4, 5]).agg(F.sum(F.col("q").cast("decimal(18,2)")).cast("double"))
    return wide.select("tile", *[F.col(m).alias(f"q_{n}") for m, n in (("3", "march"), ("4", "april"), ("5", "may"))])


@query("r04_wide_to_long", S + "SELECT sid, 'v' AS name, v AS value FROM s UNION ALL SELECT sid, 'q', q FROM s UNION ALL SELECT sid, 'disc', disc FROM s")
def r04(t):
    return R.stack(t.s, ["sid"], ["v", "q", "disc"], "name", "value")


@query("r06_distinct_keep_first", S + "SELECT tile, d, sid FROM (SELECT *, row_number() OVER (PARTITION BY tile, d ORDER BY v DESC, sid) AS r FROM s) WHERE r = 1")
def r06(t):
    return R.first_by(t.s, ["tile", "d"], F.col("v").desc(), F.col("sid")).select("tile", "d", "sid")


@query("r07_r08_split_checks", S + ", a AS (SELECT DISTINCT d FROM s WHERE flag = 'A'), b AS (SELECT DISTINCT d FROM s WHERE flag <> 'A'), c AS (SELECT DISTINCT mode FROM s WHERE flag = 'A'), e AS (SELECT DISTINCT mode FROM s) SELECT (SELECT COUNT(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS n_shared_dates, (SELECT COUNT(*) FROM (SELECT * FROM e EXCEPT SELECT * FROM c)) AS n_missing_levels")
def r07(t):
    one, other = t.s.filter("flag = 'A'"), t.s.filter("flag <> 'A'")
    n = one.select("d").intersect(other.select("d")).agg(F.count("*").alias("n_shared_dates"))
    return n.crossJoin(t.s.select("mode").subtract(one.select("mode")).agg(F.count("*").alias("n_missing_levels")))


@query("r09_upsert", "SELECT c_custkey, c_acctbal, 'old' AS version FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, -c_acctbal, 'new' FROM customer WHERE c_custkey % 5 = 0")
def r09(t):
    c = t("customer").select("c_custkey", "c_acctbal")
    new = c.filter("c_custkey % 5 = 0").select("c_custkey", (-F.col("c_acctbal")).alias("c_acctbal"), F.lit("new").alias("version"))
    return R.upsert(c.withColumn("version", F.lit("old")), new, ["c_custkey"])


@query("r10_split_tag_union", S + "SELECT CASE WHEN sk % 10 < 7 THEN 'train' WHEN sk % 10 < 9 THEN 'val' ELSE 'test' END AS split, COUNT(*) AS n, COUNT(DISTINCT d) AS n_dates FROM s GROUP BY 1")
def r10(t):
    k = F.col("sk") % 10
    parts = [t.s.filter(c).withColumn("split", F.lit(n)) for n, c in (("train", k < 7), ("val", (k >= 7) & (k < 9)), ("test", k == 9))]
    return reduce(DataFrame.unionByName, parts).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("d").alias("n_dates"))


@query("r11_u02_group_map", S + "SELECT tile, mo, round(regr_slope(v, q), 8) AS slope, COUNT(*) AS n FROM s GROUP BY tile, mo")
def r11(t):
    return t.s.groupBy("tile", "mo").agg(F.round(F.regr_slope("v", "q"), 8).alias("slope"), F.count("*").alias("n"))


@query("r12_one_hot", "SELECT p_partkey, " + ", ".join(f"CAST(p_size = {k} AS INTEGER) AS size_{k}" for k in (1, 5, 10, 20)) + ", CAST(p_size NOT IN (1, 5, 10, 20) AS INTEGER) AS size_other FROM part")
def r12(t):
    codes = (1, 5, 10, 20)
    return t("part").select("p_partkey", *[(F.col("p_size") == k).cast("int").alias(f"size_{k}") for k in codes], (~F.col("p_size").isin(*codes)).cast("int").alias("size_other"))


@query("r13_array_to_long", "SELECT vec_id, CAST((pos - 1) // 8 AS BIGINT) AS y, CAST((pos - 1) % 8 AS BIGINT) AS x, CAST(val AS DOUBLE) AS value FROM (SELECT vec_id, unnest(embedding) AS val, generate_subscripts(embedding, 1) AS pos FROM embeddings)")
def r13(t):
    e = t("embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "val"))
    return e.select("vec_id", F.expr("pos div 8").alias("y"), F.expr("cast(pos % 8 as bigint)").alias("x"), F.col("val").cast("double").alias("value"))


@query("r14_a46_found_and_missing", S + "SELECT t.tile, m.mo, COUNT(s.sid) > 0 AS found, CASE WHEN COUNT(s.sid) > 0 THEN 'ok' ELSE 'missing' END AS status, COUNT(s.sid) FILTER (WHERE q > 25) AS n_good FROM (SELECT DISTINCT tile FROM s) t CROSS JOIN (SELECT i AS mo FROM range(1, 15) r(i)) m LEFT JOIN s ON s.tile = t.tile AND s.mo = m.mo GROUP BY 1, 2")
def r14(t):
    spine = t.s.select("tile").distinct().crossJoin(t.spark.range(1, 15).withColumnRenamed("id", "mo"))
    got = t.s.groupBy("tile", "mo").agg(F.lit(True).alias("found"), F.lit("ok").alias("status"), F.count_if(F.col("q") > 25).alias("n_good"))
    return R.complete(got, spine, ["tile", "mo"], {"found": False, "status": "missing", "n_good": 0})


@query("s07_s16_catalog_regex", "SELECT regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '://([^/]+)/', 1) AS host, regexp_extract(url, '/(en|de|fr|es)/', 1) AS lang, COUNT(*) AS n FROM pages GROUP BY 1, 2, 3")
def s07(t):
    part = lambda p, n: F.regexp_extract("url", p, 1).alias(n)
    return t("pages").groupBy(part("^(https?)://", "scheme"), part("://([^/]+)/", "host"), part("/(en|de|fr|es)/", "lang")).agg(F.count("*").alias("n"))


@query("s17_a18_exactly_one", S + "SELECT ok, ln, COUNT(*) AS n FROM s GROUP BY ok, ln HAVING COUNT(*) > 1")
def s17(t):
    return t.s.groupBy("ok", "ln").agg(F.count("*").alias("n")).filter("n > 1")


@query("s20_batches", S + "SELECT tile, CAST((row_number() OVER (PARTITION BY tile ORDER BY md5(concat_ws('-', sid, '42')), sid) - 1) // 500 AS BIGINT) AS batch_id, sid FROM s")
def s20(t):
    w = Window.partitionBy("tile").orderBy(R.hash_order("sid"), "sid")
    return t.s.select("tile", "sid", F.row_number().over(w).alias("r")).select("tile", F.expr("(r - 1) div 500").alias("batch_id"), "sid")


@query("s23_resume_checklist", "SELECT o_custkey, COUNT(*) AS n, coalesce(max(CASE WHEN o_orderstatus = 'F' THEN 'done' END), 'pending') AS status FROM orders GROUP BY o_custkey")
def s23(t):
    wanted = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    done = t("orders").filter("o_orderstatus = 'F'").select("o_custkey", F.lit("done").alias("status")).distinct()
    return R.complete(done, wanted, ["o_custkey"], {"status": "pending"}).select("o_custkey", "n", "status")


QUERIES, SQL = base.QUERIES, base.SQL
