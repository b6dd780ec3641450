"""Queries of polygons held in a table: points and cells within them, region codes, clips and hulls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import polygons as P
from ..operators import zonal as Z
from . import base
from .base import S, query

#: A polygon of five corners, not convex, for each supplier.
_SHAPE = ((0.0, -1.0), (1.0, 0.1), (0.2, 0.3), (0.3, 1.0), (-1.0, 0.4))
_PLACE = "SELECT s_suppkey, CAST((s_suppkey * 7919) % 100000 AS DOUBLE) AS px, CAST((s_suppkey * 104729) % 100000 AS DOUBLE) AS py, 2500.5 * (1 + s_suppkey % 4) AS r FROM supplier"


def _polygons(t):
    s = t("supplier").select("s_suppkey", ((F.col("s_suppkey") * 7919) % 100000).cast("double").alias("px"), ((F.col("s_suppkey") * 104729) % 100000).cast("double").alias("py"), (2500.5 * (1 + F.col("s_suppkey") % 4)).alias("r"))
    return s.select("s_suppkey", F.array(*[F.struct((F.col("px") + F.lit(dx) * F.col("r")).alias("x"), (F.col("py") + F.lit(dy) * F.col("r")).alias("y")) for dx, dy in _SHAPE]).alias("ring"))


def _inside_sql(x: str, y: str) -> str:
    n = len(_SHAPE)
    d = lambda v: f"{v}::DOUBLE"
    parts = []
    for (ax, ay), (bx, by) in ((_SHAPE[i], _SHAPE[(i + 1) % n]) for i in range(n)):
        xa, ya, xb, yb = f"(px + {d(ax)} * r)", f"(py + {d(ay)} * r)", f"(px + {d(bx)} * r)", f"(py + {d(by)} * r)"
        parts.append(f"CASE WHEN ({ya} > {y}) <> ({yb} > {y}) AND {x} < ({xb} - {xa}) * ({y} - {ya}) / nullif({yb} - {ya}, 0) + {xa} THEN 1 ELSE 0 END")
    return "(" + " + ".join(parts) + ") % 2 = 1"


@query("j14_j22_g14_points_in_polygons", S + f", p AS ({_PLACE}) SELECT s_suppkey, COUNT(*) AS n, round(avg(v), 4) AS mean_v FROM s JOIN p ON x BETWEEN px - r AND px + r AND y BETWEEN py - r AND py + r WHERE {_inside_sql('x', 'y')} GROUP BY s_suppkey")
def j14(t):
    met = Z.statistics_within(t.s.select("x", "y", "v"), _polygons(t), "x", "y", "ring", ["s_suppkey"], "v", 2000.0)
    return met.select("s_suppkey", "n", F.round("mean", 4).alias("mean_v"))


_CELLS = "SELECT *, unnest(range(CAST(floor((px - r) / 2000) AS BIGINT), CAST(floor((px + r) / 2000) AS BIGINT) + 1)) AS cx FROM p"


@query("g12_cell_fractions", f"WITH p AS ({_PLACE}), c AS ({_CELLS}), d AS (SELECT *, unnest(range(CAST(floor((py - r) / 2000) AS BIGINT), CAST(floor((py + r) / 2000) AS BIGINT) + 1)) AS cy FROM c), k AS (SELECT d.*, (cx + (i + 0.5::DOUBLE) / 4) * 2000 AS sx, (cy + (j + 0.5::DOUBLE) / 4) * 2000 AS sy FROM d, range(0, 4) a(i), range(0, 4) b(j)) SELECT s_suppkey, cx, cy, avg(CASE WHEN {_inside_sql('sx', 'sy')} THEN 1.0::DOUBLE ELSE 0 END) AS fraction FROM k GROUP BY 1, 2, 3 HAVING avg(CASE WHEN {_inside_sql('sx', 'sy')} THEN 1.0::DOUBLE ELSE 0 END) > 0")
def g12(t):
    return P.cell_fractions(_polygons(t), "ring", 2000.0).select("s_suppkey", "cx", "cy", "fraction")


@query("g13_region_codes", f"WITH p AS ({_PLACE}), c AS ({_CELLS}), d AS (SELECT *, unnest(range(CAST(floor((py - r) / 2000) AS BIGINT), CAST(floor((py + r) / 2000) AS BIGINT) + 1)) AS cy FROM c) SELECT cx, cy, max(s_suppkey) AS code FROM d WHERE {_inside_sql('(cx + 0.5::DOUBLE) * 2000', '(cy + 0.5::DOUBLE) * 2000')} GROUP BY cx, cy")
def g13(t):
    return P.region_codes(_polygons(t), "ring", 2000.0, "s_suppkey")


#: Every polygon against the boxes of a 10 km grid: a box is convex, so the clip's area is exact. Summed over the boxes
#: it is the polygon's own area, which is what the SQL has.
@query("j16_j17_polygon_clip", f"WITH p AS ({_PLACE}) SELECT s_suppkey, round(r * r * {abs(sum(_SHAPE[i][0] * _SHAPE[(i + 1) % 5][1] - _SHAPE[(i + 1) % 5][0] * _SHAPE[i][1] for i in range(5))) / 2!r}::DOUBLE / 1e6, 6) AS km2 FROM p")
def j16(t):
    w = 10000.0
    cells = P.polygon_cells(_polygons(t), "ring", w)
    low, high = lambda c: F.col(c) * w, lambda c: (F.col(c) + 1) * w
    box = F.array(*[F.struct(a("cx").alias("x"), b("cy").alias("y")) for a, b in ((low, low), (high, low), (high, high), (low, high))])
    # a box that lies within needs no clip
    left = cells.withColumn("box", box).withColumn("part", F.when(~F.col("whole"), P.clip(F.col("ring"), F.col("box"))))
    area = F.when(F.col("whole"), w * w).otherwise(F.abs(P.ring_area(F.col("part"))))
    return left.withColumn("area", area).groupBy("s_suppkey").agg(F.round(F.sum("area") / 1e6, 6).alias("km2"))


@query("g01_hull_repair", S + " SELECT sid, round(100 * (q + 50.5) / CASE WHEN ln = 1 THEN 2 ELSE 1 END, 4) AS area FROM s")
def g01(t):
    # corners in crossed order (a bow tie), or one of them within the others' triangle
    x, y, w, h = F.col("x"), F.col("y"), F.lit(100.0), F.col("q") + 50.5
    point = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    last = F.when(F.col("ln") == 1, point(w / 4, h / 4)).otherwise(point(w, h))
    ring = F.array(point(F.lit(0.0), F.lit(0.0)), last, point(w, F.lit(0.0)), point(F.lit(0.0), h))
    hulls = P.repaired(t.s.select("sid", ring.alias("ring")), "ring")
    return hulls.select("sid", F.round(F.abs(P.ring_area(F.col("ring"))), 4).alias("area"))


QUERIES, SQL = base.QUERIES, base.SQL
