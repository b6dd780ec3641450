"""Polygon coverages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dissolve(polygons: DataFrame, by: list[str], x: str = "lon", y: str = "lat") -> DataFrame:
    """The outline of each group's union: (by, x1, y1, x2, y2), the lower end of an edge first. Polygons are arrays of
    corners, closed or not; those of a group must not overlap, and neighbours must share whole edges, as cells of a
    grid do. An edge that two polygons share is inside. One shuffle by group and edge, so a large group is spread."""
    corner = F.arrays_zip(F.col(x).alias("x"), F.col(y).alias("y"))
    follow = F.concat(F.slice("corners", 2, F.size("corners")), F.slice("corners", 1, 1))
    edges = polygons.select(*by, corner.alias("corners")).select(*by, F.explode(F.arrays_zip(F.col("corners").alias("a"), follow.alias("b"))).alias("e"))
    edges = edges.filter("e.a <> e.b").select(*by, F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b"))
    outline = edges.groupBy(*by, "a", "b").agg(F.count("*").alias("n")).filter("n % 2 = 1")
    return outline.select(*by, F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test of a point against a ring, an array of (x, y) corners."""
    corner = lambda i: F.get(ring, i)

    def cross(n, i):
        a, b = corner(i), corner(F.pmod(i + 1, F.size(ring)))
        over = (a["y"] > y) != (b["y"] > y)
        return n + F.when(over & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]), 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.size(ring) - 1), F.lit(0), cross) % 2 == 1


def polygon_cells(polygons: DataFrame, ring: str, width: float) -> DataFrame:
    """One row a polygon and grid cell that it may touch: cx, cy, and whole, true where the cell lies inside. A cell that no
    edge comes near is all inside or all outside; those outside go."""
    cell = lambda c: F.floor(c / width)
    axis = lambda k: F.transform(ring, lambda p: p[k])
    span = lambda k: F.explode(F.sequence(cell(F.array_min(axis(k))), cell(F.array_max(axis(k)))))
    out = polygons.withColumn("cx", span("x")).withColumn("cy", span("y"))
    low, high = lambda c: F.col(c) * width, lambda c: (F.col(c) + 1) * width

    def near(i):
        a, b = F.get(F.col(ring), i), F.get(F.col(ring), F.pmod(i + 1, F.size(ring)))
        return (F.least(a["x"], b["x"]) <= high("cx")) & (F.greatest(a["x"], b["x"]) >= low("cx")) & (F.least(a["y"], b["y"]) <= high("cy")) & (F.greatest(a["y"], b["y"]) >= low("cy"))

    edge = F.exists(F.sequence(F.lit(0), F.size(ring) - 1), near)
    out = out.withColumn("edge", edge).withColumn("whole", ~F.col("edge") & inside(low("cx") + width / 2, low("cy") + width / 2, F.col(ring)))
    return out.filter("edge or whole").drop("edge")


def points_in_polygons(points: DataFrame, polygons: DataFrame, x: str, y: str, ring: str, width: float) -> DataFrame:
    """Points joined to the polygons that hold them: an equi join on grid cells, and the exact test only in cells that an
    edge comes near."""
    p = points.withColumn("__px", F.floor(F.col(x) / width)).withColumn("__py", F.floor(F.col(y) / width))
    c = polygon_cells(polygons, ring, width).withColumnsRenamed({"cx": "__cx", "cy": "__cy", "whole": "__whole"})
    met = p.join(c, (F.col("__px") == F.col("__cx")) & (F.col("__py") == F.col("__cy")))
    return met.filter(F.col("__whole") | inside(F.col(x), F.col(y), F.col(ring))).drop("__px", "__py", "__cx", "__cy", "__whole")


def cell_fractions(polygons: DataFrame, ring: str, width: float, parts: int = 4) -> DataFrame:
    """The share of each grid cell that a polygon covers, by parts x parts points in it: cx, cy, fraction (above zero)."""
    cells = polygon_cells(polygons, ring, width)
    steps = F.sequence(F.lit(0), F.lit(parts * parts - 1))
    at = lambda c, k: (F.col(c) + (k + 0.5) / parts) * width
    hit = F.size(F.filter(steps, lambda k: inside(at("cx", k % parts), at("cy", F.floor(k / parts)), F.col(ring))))
    return cells.withColumn("fraction", F.when(F.col("whole"), 1.0).otherwise(hit / float(parts * parts))).filter("fraction > 0").drop("whole")


def region_codes(polygons: DataFrame, ring: str, width: float, order: str) -> DataFrame:
    """(cx, cy, code): grid cells whose centre a polygon holds; of several the one with the largest `order` wins."""
    cells = polygon_cells(polygons, ring, width)
    centre = lambda c: (F.col(c) + 0.5) * width
    return cells.filter(F.col("whole") | inside(centre("cx"), centre("cy"), F.col(ring))).groupBy("cx", "cy").agg(F.max(order).alias("code"))


def ring_area(ring: Column) -> Column:
    """Signed area of a ring, positive if its corners turn left; zero for fewer than three."""
    corner = lambda i: F.get(ring, F.pmod(i, F.size(ring)))
    twice = F.aggregate(F.sequence(F.lit(0), F.size(ring) - 1), F.lit(0.0), lambda a, i: a + corner(i)["x"] * corner(i + 1)["y"] - corner(i + 1)["x"] * corner(i)["y"])
    return F.when(F.size(ring) > 2, twice / 2).otherwise(0.0)


def clip(ring: Column, by: Column) -> Column:
    """The part of a ring within a convex ring whose corners turn left: cut by one edge after the other."""

    def cut(left, i):
        a, b = F.get(by, i), F.get(by, F.pmod(i + 1, F.size(by)))
        side = lambda p: (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])

        def step(p, k):
            q = F.get(left, F.pmod(k - 1, F.size(left)))
            t = side(q) / F.nullif(side(q) - side(p), F.lit(0.0))
            meet = F.struct((q["x"] + (p["x"] - q["x"]) * t).alias("x"), (q["y"] + (p["y"] - q["y"]) * t).alias("y"))
            keep, was = side(p) >= 0, side(q) >= 0
            return F.when(keep & was, F.array(p)).when(keep, F.array(meet, p)).when(was, F.array(meet)).otherwise(F.array().cast("array<struct<x:double,y:double>>"))

        return F.flatten(F.transform(left, step))

    return F.aggregate(F.sequence(F.lit(0), F.size(by) - 1), ring, cut)


def repaired(polygons: DataFrame, ring: str) -> DataFrame:
    """Quadrilaterals become their convex hull, turning left: corners stand by their angle about the mean, and one within
    the triangle of the others goes. Valid convex ones stay as they are but for direction and start."""
    p = polygons.withColumn("__n", F.size(ring))
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda a, c: a + c[k]) / F.size(ring)
    p = p.withColumn("__x", mean("x")).withColumn("__y", mean("y"))
    p = p.withColumn("__t", F.array_sort(F.transform(ring, lambda c: F.struct(F.atan2(c["y"] - F.col("__y"), c["x"] - F.col("__x")).alias("at"), c["x"].alias("x"), c["y"].alias("y")))))

    def convex(c, i):
        q, r = F.get("__t", F.pmod(i - 1, F.col("__n"))), F.get("__t", F.pmod(i + 1, F.col("__n")))
        return (c["x"] - q["x"]) * (r["y"] - c["y"]) - (c["y"] - q["y"]) * (r["x"] - c["x"]) > 0

    return p.withColumn(ring, F.transform(F.filter("__t", convex), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y")))).drop("__n", "__x", "__y", "__t")
