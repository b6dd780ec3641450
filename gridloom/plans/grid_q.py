"""Queries of grid squares, dissolved cells, classes by sigma, guarded indices and further sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import grid
from ..functions import scalars as C
from ..operators.polygons import dissolve
from ..session import shared_dir
from ..sources import io
from . import base
from .base import S, query

_n, _r, _e = grid._N, grid.SCALE * grid._RADIUS, grid._ECC
_TERM = lambda f, g: " + ".join(f"{a!r} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, a in enumerate(grid._SERIES, 1))
#: Places of soundings in two zones, with their grid coordinates.
UTM = S + f""", ll AS (SELECT sid, 5 + x / 10000 AS lon, 47 + y / 13000 AS lat FROM s),
z AS (SELECT sid, lon, lat, CAST(floor((lon + 180) / 6) + 1 AS INT) AS zone FROM ll),
t AS (SELECT *, sinh(atanh(sin(radians(lat))) - {_e!r} * atanh({_e!r} * sin(radians(lat)))) AS t, radians(lon - (zone * 6 - 183)) AS dl FROM z),
k AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM t),
u AS (SELECT sid, zone, lat, 500000 + {_r!r} * (eta + {_TERM("cos", "sinh")}) AS e, {_r!r} * (xi + {_TERM("sin", "cosh")}) AS n FROM k),
m AS (SELECT *, concat(zone, CASE WHEN lat < 48 THEN 'T' ELSE 'U' END,
    substr(CASE zone % 3 WHEN 1 THEN 'ABCDEFGH' WHEN 2 THEN 'JKLMNPQR' ELSE 'STUVWXYZ' END, CAST(floor(e / 100000) AS INT), 1),
    substr('ABCDEFGHJKLMNPQRSTUV', CAST((floor(n / 100000) + CASE WHEN zone % 2 = 0 THEN 5 ELSE 0 END) % 20 AS INT) + 1, 1)) AS square FROM u) """


@query("g28_mgrs_squares", UTM + "SELECT square, COUNT(*) AS n, floor(min(e) / 100000) * 100000 AS easting_min, floor(min(n) / 100000) * 100000 AS northing_min, CAST(floor(max(e)) AS BIGINT) AS furthest_east FROM m GROUP BY square")
def g28(t):
    ll = t.s.select((5 + F.col("x") / 10000).alias("lon"), (47 + F.col("y") / 13000).alias("lat"))
    squares = ll.groupBy(grid.mgrs_square("lon", "lat").alias("square")).agg(F.count("*").alias("n"), F.floor(F.max(grid.utm("lon", "lat")[1])).alias("furthest_east"))
    east, north = grid.square_bounds("square")
    return squares.select("square", "n", east.alias("easting_min"), north.alias("northing_min"), "furthest_east")


@query("g27_dissolve_cells", S + """, c AS (SELECT DISTINCT tile, floor(x / 4000) * 4000 AS a, floor(y / 4000) * 4000 AS b FROM s WHERE (pk + ok) % 3 = 0),
e AS (SELECT tile, a AS x1, b AS y1, a + 4000 AS x2, b AS y2 FROM c UNION ALL SELECT tile, a, b, a, b + 4000 FROM c
  UNION ALL SELECT tile, a, b + 4000, a + 4000, b + 4000 FROM c UNION ALL SELECT tile, a + 4000, b, a + 4000, b + 4000 FROM c)
SELECT tile, x1, y1, x2, y2 FROM e GROUP BY ALL HAVING COUNT(*) = 1""")
def g27(t):
    a, b = F.floor(F.col("x") / 4000) * 4000.0, F.floor(F.col("y") / 4000) * 4000.0
    cells = t.s.filter("(pk + ok) % 3 = 0").select("tile", a.alias("a"), b.alias("b")).distinct()
    a, b = F.col("a"), F.col("b")
    return dissolve(cells.select("tile", F.array(a, a + 4000, a + 4000, a).alias("lon"), F.array(b, b, b + 4000, b + 4000).alias("lat")), ["tile"])


@query("f02_sigma_class", S + ", a AS (SELECT sid, disc - q / 50 AS value, tax * 5 + 0.01 AS sigma FROM s) SELECT sid, CASE WHEN value >= -2 * sigma THEN 'accept' WHEN value >= -3 * sigma THEN 'questionable' ELSE 'reject' END AS class FROM a")
def f02(t):
    return t.s.select("sid", C.sigma_class(F.col("disc") - F.col("q") / 50, F.col("tax") * 5 + 0.01).alias("class"))


@query("f07_f08_guarded_ratio_evi", S + ", b AS (SELECT sid, disc AS red, tax AS nir, q / 500 AS blue FROM s), d AS (SELECT *, 2.5 * (nir - red) AS num, nir + 6.0 * red - 7.5 * blue + 1.0 AS den FROM b) SELECT sid, round(CASE WHEN abs(nir + red) > 0 THEN (nir - red) / (nir + red) END, 8) + 0.0 AS nd, round(CASE WHEN abs(den) > 1e-6 AND num / den BETWEEN -1 AND 1 THEN num / den END, 8) + 0.0 AS evi FROM d")
def f08(t):
    b = t.s.select("sid", F.col("disc").alias("red"), F.col("tax").alias("nir"), (F.col("q") / 500).alias("blue"))
    return b.select("sid", (F.round(C.normalized_difference("nir", "red"), 8) + 0.0).alias("nd"), (F.round(C.evi("blue", "red", "nir"), 8) + 0.0).alias("evi"))


@query("o05_smoke_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 16")
def o05(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(16)


@query("s10_s12_s22_geojson_layer", "SELECT n_nationkey, n_name, CAST([5 + n_nationkey, 6 + n_nationkey, 6 + n_nationkey, 5 + n_nationkey] AS DOUBLE[]) AS lon, CAST([47, 47, 48, 48] AS DOUBLE[]) AS lat FROM nation")
def s12(t):
    at = f"{shared_dir(t.spark)}/layer-{uuid.uuid4().hex}"
    # a layer of 25 features, written as one document
    made = [
        {"type": "Feature", "properties": {"n_nationkey": k, "n_name": name}, "geometry": {"type": "Polygon", "coordinates": [[[5.0 + k + dx, 47.0 + dy] for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1))]]}}
        for k, name in t("nation").select("n_nationkey", "n_name").collect()
    ]
    io.write_json(t.spark, f"{at}.geojson", {"type": "FeatureCollection", "features": made})
    io.read_geojson(t.spark, f"{at}.geojson", "n_nationkey:int,n_name:string").write.parquet(at)
    return t.spark.read.parquet(at)


@query("s18_shard_index", "SELECT vec_id AS id, concat('shard-', vec_id // 128, '.npz') AS shard, row_number() OVER (PARTITION BY vec_id // 128 ORDER BY vec_id) - 1 AS local_index FROM embeddings")
def s18(t):
    import io as bytes_io

    import numpy as np
    import pandas as pd

    def pack(ids):
        held = bytes_io.BytesIO()
        np.savez(held, ids=np.sort(ids["vec_id"].to_numpy()))
        return pd.DataFrame({"path": [f"shard-{ids['shard'][0]}.npz"], "content": [held.getvalue()]})

    # a shard holds 128 ids at most, so that no group grows with the table
    shards = t("embeddings").select("vec_id", F.floor(F.col("vec_id") / 128).alias("shard")).groupBy("shard").applyInPandas(pack, "path string, content binary")
    at = f"{shared_dir(t.spark)}/npz-{uuid.uuid4().hex}"
    shards.write.parquet(at)
    return io.contents_index(t.spark.read.parquet(at))


QUERIES, SQL = base.QUERIES, base.SQL
