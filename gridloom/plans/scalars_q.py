"""Queries of scalar functions, projections, filters and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import relational as R
from . import base
from .base import S, mean_sql, query


@query("a01_group_summary", S + f""", g AS (SELECT *, CAST(floor(x / 4000) AS BIGINT) AS cell_col, CAST(floor((109800 - y) / 4000) AS BIGINT) AS cell_row FROM s)
SELECT tile, d, cell_row, cell_col, concat_ws('_', tile, lpad(CAST(cell_row AS VARCHAR), 2, '0'), lpad(CAST(cell_col AS VARCHAR), 2, '0'), strftime(d, '%Y%m%d')) AS aggregation_id,
 COUNT(*) AS n_footprints, {mean_sql('v')} AS mean_v, median(v) AS median_v, min(v) AS min_v, max(v) AS max_v,
 round(stddev_samp(v), 6) AS sd_v, round(stddev_samp(v) / sqrt(COUNT(*)), 6) AS se_v, {mean_sql('q')} AS mean_q, CAST(SUM(CAST(q AS DECIMAL(18,2))) AS DOUBLE) AS total_q,
 string_agg(DISTINCT flag, ';' ORDER BY flag) AS flags, string_agg(DISTINCT mode, ';' ORDER BY mode) AS modes,
 COUNT(*) FILTER (WHERE flag = 'A') AS n_flag_a, COUNT(*) FILTER (WHERE flag = 'N') AS n_flag_n, COUNT(*) FILTER (WHERE mode = 'O') AS n_mode_o,
 COUNT(*) FILTER (WHERE flag = 'A') / CAST(COUNT(*) AS DOUBLE) AS flag_a_fraction, COUNT(*) FILTER (WHERE mode = 'O') / CAST(COUNT(*) AS DOUBLE) AS mode_o_fraction,
 COUNT(DISTINCT sk) AS n_suppliers, COUNT(DISTINCT sk % 8) = 1 AS one_tile, string_agg(sid, ',' ORDER BY sid) AS row_ids, COUNT(*) >= 3 AS eligible_n3, COUNT(*) >= 5 AS eligible_n5
FROM g WHERE isfinite(v) AND q > 0 GROUP BY tile, d, cell_row, cell_col""")
def a01_group_summary(t):
    g = t.s.filter(X.all_finite("v", "x", "y") & (F.col("q") > 0))
    g = g.withColumn("cell_col", F.floor(F.col("x") / 4000)).withColumn("cell_row", F.floor((109800 - F.col("y")) / 4000))
    frac = lambda c: F.count_if(c) / F.count("*").cast("double")
    # one list a group, of narrow rows; median, sets and ids are taken from it within the row
    keys = ["tile", "d", "cell_row", "cell_col"]
    out = g.groupBy(*keys).agg(
        F.count("*").alias("n_footprints"), R.mean_exact(F.col("v")).alias("mean_v"), F.min("v").alias("min_v"), F.max("v").alias("max_v"),
        F.round(F.stddev_samp("v"), 6).alias("sd_v"), F.round(F.stddev_samp("v") / F.sqrt(F.count("*")), 6).alias("se_v"), R.mean_exact(F.col("q")).alias("mean_q"), F.sum(F.col("q").cast("decimal(18,2)")).cast("double").alias("total_q"),
        F.count_if(F.col("flag") == "A").alias("n_flag_a"), F.count_if(F.col("flag") == "N").alias("n_flag_n"), F.count_if(F.col("mode") == "O").alias("n_mode_o"),
        frac(F.col("flag") == "A").alias("flag_a_fraction"), frac(F.col("mode") == "O").alias("mode_o_fraction"),
        (F.count("*") >= 3).alias("eligible_n3"), (F.count("*") >= 5).alias("eligible_n5"), F.collect_list(F.struct("v", "flag", "mode", "sk", "sid")).alias("rows"),
    )
    of = lambda k, f=lambda x: x: F.transform("rows", lambda r: f(r[k]))
    several = lambda k: F.array_join(F.array_sort(F.array_distinct(of(k))), ";")
    out = out.select(
        "*", R.array_median(of("v")).alias("median_v"), several("flag").alias("flags"), several("mode").alias("modes"),
        F.size(F.array_distinct(of("sk"))).cast("bigint").alias("n_suppliers"), (F.size(F.array_distinct(of("sk", lambda x: x % 8))) == 1).alias("one_tile"), F.array_join(F.array_sort(of("sid")), ",").alias("row_ids"),
    ).drop("rows")
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    return out.withColumn("aggregation_id", F.concat_ws("_", "tile", two("cell_row"), two("cell_col"), F.date_format("d", "yyyyMMdd")))


@query("f01_f03_target_and_flags", S + """, a AS (SELECT sid, (v / 10000 + 1.5 * (q / 10)) / 2 AS target, 0.5 * sqrt(disc * disc + 2.25 * tax * tax) AS sigma, disc * 20 - 1.2 AS dev FROM s),
b AS (SELECT *, CASE WHEN dev >= -2 * sigma THEN 'accept' WHEN dev >= -3 * sigma THEN 'questionable' WHEN dev < -3 * sigma THEN 'reject' END AS sigma_class FROM a)
SELECT sid, round(target, 8) AS target, round(sigma, 8) AS sigma, sigma_class, CASE WHEN target >= 1 AND target < 6 AND sigma_class <> 'reject' THEN 'accept' ELSE 'reject' END AS final_check FROM b""")
def f01(t):
    a = t.s.select("sid", X.two_band_target(F.col("v") / 10000, F.col("q") / 10).alias("target"), X.two_band_error("disc", "tax").alias("sigma"), (F.col("disc") * 20 - 1.2).alias("dev"))
    a = a.withColumn("sigma_class", X.sigma_class("dev", "sigma")).withColumn("final_check", X.final_flag("target", 1.0, 6.0, "sigma_class"))
    return a.select("sid", F.round("target", 8).alias("target"), F.round("sigma", 8).alias("sigma"), "sigma_class", "final_check")


@query("f04_phase_angle", S + """, a AS (SELECT sid, q AS sza, disc * 300 AS vza, CAST(pk % 720 - 360 AS DOUBLE) AS raw FROM s),
w AS (SELECT *, raw + 180 - 360 * floor((raw + 180) / 360) - 180 AS az FROM a),
c AS (SELECT *, degrees(acos(greatest(-1.0, least(1.0, cos(radians(sza)) * cos(radians(vza)) + sin(radians(sza)) * sin(radians(vza)) * cos(radians(az)))))) AS ph FROM w)
SELECT sid, az, round(ph, 4) AS phase, round(CASE WHEN az < 0 THEN -ph ELSE ph END, 4) AS signed_phase FROM c""")
def f04(t):
    a = t.s.select("sid", F.col("q").alias("sza"), (F.col("disc") * 300).alias("vza"), X.wrap180((F.col("pk") % 720 - 360).cast("double")).alias("az"))
    ph = X.phase_angle("sza", "vza", "az")
    return a.select("sid", "az", F.round(ph, 4).alias("phase"), F.round(F.when(F.col("az") < 0, -ph).otherwise(ph), 4).alias("signed_phase"))


@query("f05_cyclic_month", S + "SELECT mo, round(sin(2 * pi() * mo / 12), 8) + 0.0 AS month_sin, round(cos(2 * pi() * mo / 12), 8) + 0.0 AS month_cos, COUNT(*) AS n FROM s GROUP BY mo")
def f05(t):
    a, b = X.cyclic_month("mo")
    return t.s.groupBy("mo").agg(F.count("*").alias("n")).select("mo", (F.round(a, 8) + 0.0).alias("month_sin"), (F.round(b, 8) + 0.0).alias("month_cos"), "n")


_BANDS = "v / 100000 AS nir, (q + 1) / 100 AS red, (disc * 50 + 3) / 100 AS green, (tax * 50 + 2) / 100 AS blue, (q + 5) / 90 AS edge1, (q + 9) / 80 AS edge2, v / 110000 AS narrow, (ln + 20) / 100.0::DOUBLE AS swir1, (ln + 10) / 100.0::DOUBLE AS swir2"


@query("f06_f09_spectral_indices", S + f""", b AS (SELECT sid, {_BANDS} FROM s), i AS (SELECT *, CASE WHEN abs(nir + 6 * red - 7.5 * blue + 1) > 1e-6 THEN 2.5 * (nir - red) / (nir + 6 * red - 7.5 * blue + 1) END AS evi0 FROM b)
SELECT sid, round((nir - red) / nullif(nir + red, 0), 6) AS ndvi, round((nir - edge1) / nullif(nir + edge1, 0), 6) AS ndre, round((narrow - edge1) / nullif(narrow + edge1, 0), 6) AS ndre8a,
 round((red - green) / nullif(edge2, 0), 6) AS psri, round(1.16 * (nir - red) / (nir + red + 0.16), 6) AS osavi, round((green - nir) / nullif(green + nir, 0), 6) AS ndwi,
 round((nir - red) / nullif(nir + red, 0) * nir, 6) AS nirv, round(3 * ((edge1 - red) - 0.2 * (edge1 - green) * (edge1 / nullif(red, 0))), 6) AS tcari,
 round((nir - swir1) / nullif(nir + swir1, 0), 6) AS ndmi, round(swir1 / nullif(nir, 0), 6) AS msi, round((nir - swir2) / nullif(nir + swir2, 0), 6) AS ndmi_swir2, round(swir2 / nullif(nir, 0), 6) AS msi_swir2,
 round((nir - (swir1 - swir2)) / nullif(nir + (swir1 - swir2), 0), 6) AS nmdi, CASE WHEN evi0 BETWEEN -1 AND 1 THEN round(evi0, 6) END AS evi FROM i""")
def f06(t):
    c = F.col
    b = {"nir": c("v") / 100000, "red": (c("q") + 1) / 100, "green": (c("disc") * 50 + 3) / 100, "blue": (c("tax") * 50 + 2) / 100, "edge1": (c("q") + 5) / 90, "edge2": (c("q") + 9) / 80, "narrow": c("v") / 110000, "swir1": (c("ln") + 20) / 100.0, "swir2": (c("ln") + 10) / 100.0}
    p = t.s.select("sid", *[e.alias(k) for k, e in b.items()])
    out = {k: F.round(e, 6) for k, e in X.spectral_indices({k: k for k in b}).items()}
    return p.select("sid", *[e.alias(k) for k, e in out.items()], F.round(X.evi("blue", "red", "nir"), 6).alias("evi"))


@query("f10_apar_variants", S + f"SELECT tile, mo, round(({mean_sql('v')}) * ({mean_sql('q')}), 4) AS product_of_means, round(CAST(SUM(CAST(v * q AS DECIMAL(20,4))) AS DOUBLE) / COUNT(*), 4) AS mean_of_product FROM s GROUP BY tile, mo")
def f10(t):
    mp = F.sum((F.col("v") * F.col("q")).cast("decimal(20,4)")).cast("double") / F.count("*")
    return t.s.groupBy("tile", "mo").agg(F.round(R.mean_exact(F.col("v")) * R.mean_exact(F.col("q")), 4).alias("product_of_means"), F.round(mp, 4).alias("mean_of_product"))


@query("f11_f29_active_share", S + """, k AS (SELECT sid, mo, ln, q FROM s), a AS (SELECT sid, mo, ln, q, CASE ln WHEN 1 THEN mo IN (3,4,5,6,7) WHEN 2 THEN mo IN (4,5,6,7,8,9) WHEN 3 THEN mo IN (10,11,12) ELSE false END AS active FROM k)
SELECT mo, CAST(SUM(CASE WHEN active THEN CAST(q AS BIGINT) ELSE 0 END) AS BIGINT) AS active_q, round(SUM(CASE WHEN active THEN q ELSE 0 END) / SUM(q), 8) AS active_share, round(SUM(CASE WHEN ln = 1 THEN q ELSE 0 END) / SUM(q), 8) AS first_share FROM a GROUP BY mo""")
def f11(t):
    months = {1: [3, 4, 5, 6, 7], 2: [4, 5, 6, 7, 8, 9], 3: [10, 11, 12]}
    calendar = F.create_map(*[x for k, m in months.items() for x in (F.lit(k).cast("bigint"), F.array(*[F.lit(i).cast("bigint") for i in m]))])
    active = F.coalesce(F.array_contains(F.try_element_at(calendar, F.col("ln")), F.col("mo")), F.lit(False))
    a = t.s.withColumn("active", active)
    share = lambda cond: F.round(F.sum(F.when(cond, F.col("q")).otherwise(0.0)) / F.sum("q"), 8)
    return a.groupBy("mo").agg(F.sum(F.when(F.col("active"), F.col("q").cast("bigint")).otherwise(0)).alias("active_q"), share(F.col("active")).alias("active_share"), share(F.col("ln") == 1).alias("first_share"))


@query("f12_calibrate_zscore", S + """, m AS (SELECT avg(v) AS a, stddev_pop(v) AS b FROM s) SELECT sid, round(0.1 + 0.9 * v, 6) AS calibrated, round((v - a) / b, 6) AS z FROM s, m""")
def f12(t):
    m = t.s.agg(F.avg("v").alias("a"), F.stddev_pop("v").alias("b"))
    return t.s.crossJoin(F.broadcast(m)).select("sid", F.round(0.1 + 0.9 * F.col("v"), 6).alias("calibrated"), F.round((F.col("v") - F.col("a")) / F.col("b"), 6).alias("z"))


@query("f13_fixed_bins", S + """SELECT CASE WHEN q >= 1 AND q < 10 THEN 'low' WHEN q >= 10 AND q < 25 THEN 'mid' WHEN q >= 25 AND q <= 50 THEN 'high' END AS left_bin,
 CASE WHEN q > 0 AND q <= 10 THEN 'low' WHEN q > 10 AND q <= 25 THEN 'mid' WHEN q > 25 AND q <= 50 THEN 'high' END AS right_bin, COUNT(*) AS n FROM s GROUP BY 1, 2""")
def f13(t):
    names = ["low", "mid", "high"]
    return t.s.groupBy(X.cut_bins("q", [1, 10, 25, 50], names).alias("left_bin"), X.cut_bins("q", [0, 10, 25, 50], names, True).alias("right_bin")).agg(F.count("*").alias("n"))


@query("f14_data_driven_bins", S + "SELECT floor(v / 2500) * 2500 AS bin_low, COUNT(*) AS n, min(v) AS min_v, max(v) AS max_v FROM s GROUP BY 1")
def f14(t):
    return t.s.groupBy(X.bin_floor("v", 2500.0).alias("bin_low")).agg(F.count("*").alias("n"), F.min("v").alias("min_v"), F.max("v").alias("max_v"))


@query("f15_j20_j21_composites", S + """SELECT doy, CAST(1 + 8 * floor((doy - 1) / 8) AS BIGINT) AS composite, (SELECT arg_min(c, abs(c - doy) * 1000 + c) FROM range(33, 210, 8) r(c)) AS nearest, CAST(greatest(33, least(209, 1 + 8 * floor((doy - 1) / 8))) AS BIGINT) AS clamped, COUNT(*) AS n FROM s GROUP BY doy""")
def f15(t):
    comp = X.composite_day("doy")
    return t.s.groupBy("doy").agg(F.count("*").alias("n")).select("doy", comp.alias("composite"), X.nearest_composite("doy", 33, 209).alias("nearest"), F.greatest(F.lit(33), F.least(F.lit(209), comp)).cast("bigint").alias("clamped"), "n")


@query("f16_density_2d", S + """, b AS (SELECT sid, CAST(least(19, floor(q / 2.5)) AS BIGINT) AS bx, CAST(least(19, floor(v / 5500)) AS BIGINT) AS bin_y FROM s) SELECT bx, bin_y, COUNT(*) AS n, COUNT(*) / CAST((SELECT COUNT(*) FROM s) AS DOUBLE) AS density FROM b GROUP BY bx, bin_y""")
def f16(t):
    b = t.s.select(F.least(F.lit(19), F.floor(F.col("q") / 2.5)).cast("bigint").alias("bx"), F.least(F.lit(19), F.floor(F.col("v") / 5500)).cast("bigint").alias("bin_y"))
    g = b.groupBy("bx", "bin_y").agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("total")))).select("bx", "bin_y", "n", (F.col("n") / F.col("total").cast("double")).alias("density"))


@query("f17_p15_guards", S + """, a AS (SELECT sid, CASE WHEN ln = 7 THEN 'inf'::DOUBLE WHEN ln = 6 THEN 'nan'::DOUBLE ELSE v END AS w FROM s) SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE isfinite(w) AND abs(w) <= 65504) AS n_half, COUNT(*) FILTER (WHERE isfinite(w)) AS n_finite, COUNT(*) FILTER (WHERE NOT isfinite(w)) AS n_bad FROM a""")
def f17(t):
    w = F.when(F.col("ln") == 7, F.lit(float("inf"))).when(F.col("ln") == 6, F.lit(float("nan"))).otherwise(F.col("v"))
    a = t.s.select(w.alias("w"))
    return a.agg(F.count("*").alias("n"), F.count(X.float16_guard("w")).alias("n_half"), F.count(X.finite_or_null("w")).alias("n_finite"), F.count_if(~X.finite("w")).alias("n_bad"))


@query("f18_f19_f35_calendar", S + """SELECT d, yr, mo, doy, strftime(d, '%Y-%m') AS year_month, CAST(date_trunc('month', d) AS DATE) AS month_start, CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE) AS next_month,
 strftime(d, '%Y%m') || '15' AS mid_month, CAST(make_date(yr, 1, 1) + CAST(doy - 1 AS INTEGER) AS DATE) AS back, COUNT(*) AS n FROM s GROUP BY d, yr, mo, doy""")
def f18(t):
    g = t.s.groupBy("d", "yr", "mo", "doy").agg(F.count("*").alias("n"))
    start = F.trunc("d", "month")
    return g.select("d", "yr", "mo", "doy", F.date_format("d", "yyyy-MM").alias("year_month"), start.alias("month_start"), F.add_months(start, 1).alias("next_month"), F.concat(F.date_format("d", "yyyyMM"), F.lit("15")).alias("mid_month"), X.day_of_year_date("yr", "doy").alias("back"), "n")


@query("f20_month_composites", "SELECT y AS yr, m AS mo, array_to_string(list(c ORDER BY c), ',') AS composites FROM (SELECT y, m, c FROM range(1995, 2002) a(y), range(1, 13) b(m), range(1, 362, 8) e(c) WHERE month(make_date(y, 1, 1) + CAST(c - 1 AS INTEGER)) = m) GROUP BY y, m")
def f20(t):
    spine = t.spark.range(1995, 2002).withColumnRenamed("id", "yr").crossJoin(t.spark.range(1, 13).withColumnRenamed("id", "mo"))
    return spine.select("yr", "mo", F.array_join(X.composites_in_month("yr", "mo").cast("array<string>"), ",").alias("composites"))


@query("f21_epoch_1990", "SELECT event_id, TIMESTAMP '1990-01-01 00:00:00' + to_seconds(event_id * 86461) AS at, try_strptime(CASE WHEN event_id % 3 = 0 THEN '2020-05-01 13' WHEN event_id % 3 = 1 THEN '2020/05/01' ELSE 'none' END, ['%Y-%m-%d %H', '%Y/%m/%d']) AS parsed FROM events")
def f21(t):
    raw = F.when(F.col("event_id") % 3 == 0, "2020-05-01 13").when(F.col("event_id") % 3 == 1, "2020/05/01").otherwise("none")
    parsed = F.coalesce(F.try_to_timestamp(raw, F.lit("yyyy-MM-dd HH")), F.try_to_timestamp(raw, F.lit("yyyy/MM/dd"))).cast("timestamp_ntz")
    return t("events").select("event_id", X.epoch_1990(F.col("event_id") * 86461).alias("at"), parsed.alias("parsed"))


@query("f22_validity_offsets", "SELECT o_orderkey, CAST(o_orderdate AS DATE) - CAST(coalesce(nullif(o_orderkey % 5, 0), nullif(o_orderkey % 7, 0), 30) AS INTEGER) AS temporal_low, CAST(o_orderdate AS DATE) + CAST(coalesce(nullif(o_custkey % 5, 0), nullif(o_custkey % 7, 0), 30) AS INTEGER) AS temporal_high FROM orders")
def f22(t):
    n = lambda c, m: F.nullif(F.col(c) % m, F.lit(0))
    d = F.to_date("o_orderdate")
    return t("orders").select("o_orderkey", X.validity_interval(d, n("o_orderkey", 5), n("o_orderkey", 7), F.lit(30)).alias("temporal_low"), X.validity_interval(d, -n("o_custkey", 5), -n("o_custkey", 7), F.lit(-30)).alias("temporal_high"))


@query("f23_f24_strings", "SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS slug, upper(p_brand) AS brand_up, regexp_extract(p_brand, '([0-9]+)', 1) AS brand_no, regexp_matches(p_brand, '^Brand#[0-9]{2}$') AS brand_ok, lpad(CAST(p_size AS VARCHAR), 4, '0') AS size4, starts_with(p_type, 'S') AS s_type, regexp_replace(p_brand, '^Brand#', '') AS tail FROM part")
def f23(t):
    return t("part").select("p_partkey", X.slug("p_name").alias("slug"), F.upper("p_brand").alias("brand_up"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("brand_no"), F.col("p_brand").rlike("^Brand#[0-9]{2}$").alias("brand_ok"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("size4"), F.col("p_type").startswith("S").alias("s_type"), F.regexp_replace("p_brand", "^Brand#", "").alias("tail"))


@query("f25_f26_ids_labels", "SELECT concat(lpad(CAST(o_custkey AS VARCHAR), 8, '0'), '_', strftime(o_orderdate, '%Y%m%d')) AS id, COUNT(*) AS n, printf('<b>%d</b> rows, last %s', COUNT(*), strftime(max(o_orderdate), '%Y-%m-%d')) AS label FROM orders GROUP BY 1")
def f25(t):
    ident = F.concat(F.lpad(F.col("o_custkey").cast("string"), 8, "0"), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"))
    return t("orders").groupBy(ident.alias("id")).agg(F.count("*").alias("n"), F.format_string("<b>%d</b> rows, last %s", F.count("*"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd")).alias("label"))


@query("f27_f28_r05_arrays", S + "SELECT sid, generate_subscripts(string_split(sid, '-'), 1) AS pos, unnest(string_split(sid, '-')) AS part FROM s")
def f27(t):
    return t.s.select("sid", F.posexplode(F.split("sid", "-")).alias("p", "part")).select("sid", (F.col("p") + 1).cast("bigint").alias("pos"), "part")


@query("f30_json", "SELECT event_type, COUNT(*) AS n, CAST(SUM(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY event_type")
def f30(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k_sum"))


@query("f31_md5_key", "SELECT p_type, md5(string_agg(DISTINCT p_brand, '|' ORDER BY p_brand)) AS cache_key FROM part GROUP BY p_type")
def f31(t):
    return t("part").groupBy("p_type").agg(F.md5(R.sorted_distinct(F.col("p_brand"), "|")).alias("cache_key"))


@query("f32_f33_p14_conditionals", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'full' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'other' END AS status, coalesce(nullif(o_orderpriority, '5-LOW'), 'none') AS priority, lower(trim(CASE WHEN o_orderkey % 4 = 0 THEN ' TRUE ' WHEN o_orderkey % 4 = 1 THEN 't' WHEN o_orderkey % 4 = 2 THEN 'yes' ELSE 'no' END)) IN ('true', 't', '1', 'yes') AS flag, TRY_CAST(CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE 'n/a' END AS DOUBLE) AS number FROM orders")
def f32(t):
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, " TRUE ").when(k % 4 == 1, "t").when(k % 4 == 2, "yes").otherwise("no")
    return t("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "full").when(F.col("o_orderstatus") == "O", "open").otherwise("other").alias("status"), F.coalesce(F.nullif("o_orderpriority", F.lit("5-LOW")), F.lit("none")).alias("priority"), X.truthy(raw).alias("flag"), F.when(k % 2 == 0, k.cast("string")).otherwise("n/a").try_cast("double").alias("number"))


@query("f34_stretch_pack", S + """, p AS (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM s), r AS (SELECT sid, CAST(floor(CASE WHEN hi > lo THEN greatest(0.0, least(1.0, (v - lo) / (hi - lo))) * 255 ELSE 0 END) AS BIGINT) AS red, CAST(q AS BIGINT) AS green, ln AS blue FROM s, p)
SELECT sid, red, red * 65536 + green * 256 + blue AS packed, (red * 65536 + green * 256 + blue) // 256 % 256 AS green_back FROM r""")
def f34(t):
    p = R.exact_quantiles(t.s, [], "v", (0.02, 0.98)).select(F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))
    r = t.s.crossJoin(F.broadcast(p)).select("sid", F.floor(X.stretch("v", "lo", "hi")).alias("red"), F.col("q").cast("bigint").alias("green"), F.col("ln").alias("blue"))
    packed = X.pack_rgb("red", "green", "blue")
    return r.select("sid", "red", packed.alias("packed"), F.pmod(F.shiftright(packed, 8), F.lit(256)).alias("green_back"))


@query("f36_keyword_score", "SELECT p_partkey, CAST(5 * CAST(contains(lower(p_type), 'steel') AS INT) + 3 * CAST(contains(lower(p_name), '1') AS INT) - 4 * CAST(contains(lower(p_brand), '3') AS INT) AS BIGINT) AS score FROM part")
def f36(t):
    s = X.keyword_score("p_type", {"steel": 5}) + X.keyword_score("p_name", {"1": 3}) + X.keyword_score("p_brand", {"3": -4})
    return t("part").select("p_partkey", s.cast("bigint").alias("score"))


@query("f37_date_token", "SELECT event_type, CASE datediff('day', DATE '2024-01-15', CAST(ts AS DATE)) WHEN 0 THEN 'target' WHEN -1 THEN 'previous' WHEN 1 THEN 'next' ELSE 'other' END AS token, COUNT(*) AS n FROM events GROUP BY 1, 2")
def f37(t):
    return t("events").groupBy("event_type", X.date_token_class(F.to_date("ts"), F.lit("2024-01-15").cast("date")).alias("token")).agg(F.count("*").alias("n"))


@query("p01_p03_project_many", "SELECT o_orderkey AS id, round(o_totalprice / 2, 6) AS half_price, round(o_custkey / 2.0::DOUBLE, 6) AS half_custkey FROM orders")
def p01(t):
    o = t("orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("custkey")).drop("not_there")
    return o.select(F.col("o_orderkey").alias("id"), *[F.round(F.col(c) / 2.0, 6).alias(f"half_{c}") for c in ("price", "custkey")])


@query("p04_p05_row_predicates", S + "SELECT COUNT(*) FILTER (WHERE isfinite(v) AND isfinite(q)) AS n_all, COUNT(*) FILTER (WHERE disc > 0.05 OR tax > 0.05) AS n_any FROM s")
def p04(t):
    cols = [c for c in t.s.columns if c in ("disc", "tax")]
    return t.s.agg(F.count_if(X.all_finite("v", "q")).alias("n_all"), F.count_if(X.any_true(*[F.col(c) > 0.05 for c in cols])).alias("n_any"))


@query("p06_p07_p19_box_in_list", S + "SELECT sid FROM s WHERE x BETWEEN 20000 AND 60000 AND y BETWEEN 10000 AND 90000 AND mo IN (4, 5, 6) AND flag = 'N' AND d NOT IN (DATE '1996-05-01', DATE '1997-05-02')")
def p06(t):
    return t.s.filter(F.col("x").between(20000, 60000) & F.col("y").between(10000, 90000) & F.col("mo").isin(4, 5, 6) & (F.col("flag") == "N") & ~F.col("d").isin(F.lit("1996-05-01").cast("date"), F.lit("1997-05-02").cast("date"))).select("sid")


@query("p08_j11_semi_join", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def p08(t):
    return t("orders").join(t("customer").filter("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("p09_p17_incomplete_rows", "SELECT COUNT(*) AS n_complete, COUNT(*) FILTER (WHERE c_nationkey <> 3) AS n_known, CAST(SUM(coalesce(nullif(c_nationkey, 3), -1)) AS BIGINT) AS patched FROM customer WHERE nullif(c_mktsegment, 'MACHINERY') IS NOT NULL")
def p09(t):
    c = t("customer").select(F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("seg"), F.nullif("c_nationkey", F.lit(3)).alias("nk")).dropna(subset=["seg"])
    return c.agg(F.count("*").alias("n_complete"), F.count("nk").alias("n_known"), F.sum(F.coalesce("nk", F.lit(-1))).alias("patched"))


@query("p10_filter_funnel", S + """, f AS (SELECT COUNT(*) FILTER (WHERE flag = 'N') AS a, COUNT(*) FILTER (WHERE flag = 'N' AND mo BETWEEN 4 AND 9) AS b, COUNT(*) FILTER (WHERE flag = 'N' AND mo BETWEEN 4 AND 9 AND q > 10) AS c FROM s) SELECT 'quality' AS stage, a AS n_rows FROM f UNION ALL SELECT 'season', b FROM f UNION ALL SELECT 'value', c FROM f""")
def p10(t):
    return R.funnel(t.s, {"quality": F.col("flag") == "N", "season": F.col("mo").between(4, 9), "value": F.col("q") > 10})


@query("p12_p13_domain_range", S + "SELECT COUNT(*) FILTER (WHERE flag NOT IN ('A', 'N')) AS n_outside, min(disc) AS lo, max(disc) AS hi, min(disc) >= 0 AND max(disc) <= 1.000001 AS is_fraction FROM s")
def p12(t):
    return t.s.agg(F.count_if(~F.col("flag").isin("A", "N")).alias("n_outside"), F.min("disc").alias("lo"), F.max("disc").alias("hi"), ((F.min("disc") >= 0) & (F.max("disc") <= 1.000001)).alias("is_fraction"))


@query("p16_p20_clamp", S + "SELECT sid, greatest(5.0, least(45.0, q)) AS clamped FROM s")
def p16(t):
    return t.s.select("sid", X.clamp("q", 5.0, 45.0).alias("clamped"))


QUERIES, SQL = base.QUERIES, base.SQL
