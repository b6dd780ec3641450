"""Statistics of points within polygons against brute force: shared keys, copies, crossed rings, nulls, blocks, and dense places."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import zonal as Z

KIND = "id long, ring array<struct<x:double,y:double>>"


def holds(ring, x, y) -> bool:
    n = 0
    if any(None in c for c in ring):
        return False
    for (xa, ya), (xb, yb) in zip(ring, ring[1:] + ring[:1]):
        n += (ya > y) != (yb > y) and x < (xb - xa) * (y - ya) / (yb - ya) + xa
    return n % 2 == 1


def brute(points, polygons) -> dict:
    out = {}
    for k, ring in polygons:
        for x, y, v in points:
            if None not in (x, y) and math.isfinite(x) and math.isfinite(y) and holds(ring, x, y):
                n, values = out.get(k, (0, []))
                out[k] = (n + 1, values + [v] * (v is not None))
    return {k: (n, math.fsum(v) / len(v) if v else None) for k, (n, v) in out.items()}


def same(got, want) -> None:
    assert set(got) == set(want)
    for k, (n, mean) in want.items():
        assert got[k][0] == n, k
        assert got[k][1] == mean or mean is not None and (got[k][1] == pytest.approx(mean, rel=1e-12, nan_ok=True)), k


def cases():
    r = np.random.default_rng(3)
    points = [(float(a), float(b), float(c)) for a, b, c in r.uniform(-20, 80, (600, 3))]
    # on corners and edges, copies, one place with many values, a dense place, and rows that are in no polygon
    points += [(float(i), float(j), 0.25 * i) for i in range(-3, 12) for j in range(-3, 12)]
    points += [(5.0, 5.0, 1.5)] * 40 + [(5.5, 5.25, float(i)) for i in range(40)] + [(7 + i * 1e-9, 7 - i * 1e-9, 1.0) for i in range(100)]
    points += [(None, 1.0, 1.0), (1.0, None, 1.0), (math.nan, 1.0, 1.0), (math.inf, 1.0, 1.0), (2.0, 6.0, None), (50.0, 50.5, None)]
    ring = lambda *c: [(float(a), float(b)) for a, b in c]
    polygons = [(1, ring((1, 1), (9, 2), (4, 4), (5, 9), (0.5, 6))), (2, ring((3, 3), (7, 3), (7, 7), (3, 7))), (3, ring((200, 200), (210, 200), (200, 210)))]
    # crossed, closed, touching itself, without area, empty, with a null corner, around all, and two polygons of one key
    polygons += [(4, ring((0, 0), (10, 10), (10, 0), (0, 10))), (5, ring((3, 3), (7, 3), (7, 7), (3, 3))), (6, ring((0, 0), (6, 0), (3, 3), (6, 6), (0, 6), (3, 3)))]
    polygons += [(7, ring((1, 1), (9, 9))), (8, []), (9, [(0.0, 0.0), (None, 5.0), (8.0, 8.0), (8.0, 0.0)]), (10, ring((-90, -90), (90, -90), (90, 90), (-90, 90)))]
    polygons += [(11, ring((0, 0), (6, 0), (0, 6))), (11, ring((1, 1), (7, 1), (1, 7))), (None, ring((0, 0), (6, 0), (0, 6))), (13, ring((49.9, 50.4), (50.1, 50.4), (50, 50.6)))]
    polygons += [(14, ring((7, 6), (8, 7), (7, 8), (6, 7 + 1e-12))), (15, ring((7 + 2e-8, 0), (7 + 2e-8, 9), (0, 9)))]
    star = [(30 + (25 if i % 2 else 9) * math.cos(i / 40 * math.pi), 30 + (25 if i % 2 else 9) * math.sin(i / 40 * math.pi)) for i in range(80)]
    return points, [*polygons, (16, star)]


@pytest.mark.parametrize("most", [None, (50, None), (None, 3), (20, 2)])
@pytest.mark.parametrize("width", [3.0, 1000.0])
def test_statistics_equal_brute_force(spark, width, most):
    points, polygons = cases()
    p, q = spark.createDataFrame(points, "x double, y double, v double"), spark.createDataFrame(polygons, KIND)
    got = Z.statistics_within(p, q, "x", "y", "ring", ["id"], "v", width, *(most or ())).collect()
    want = brute(points, polygons)
    assert len(got) == len(want)
    same({r.id: (r.n, r["mean"]) for r in got}, want)


def test_small_steps(spark, monkeypatch):
    """Trees are as deep and work is in as small parts as can be."""
    for name, value in (("BUDGET", 7), ("TESTS", 9), ("LEAF", 1)):
        monkeypatch.setattr(Z, name, value)
    import pyarrow as pa

    points, polygons = cases()
    polygons = [r for r in polygons if None not in sum(r[1], ())]
    x, y, v = (pa.array(c, pa.float64()) for c in zip(*[r for r in points if None not in r[:2] and math.isfinite(r[0])]))
    zero = lambda n: pa.array([0] * n, pa.int64())
    p = pa.table({"__x": x, "__y": y, "__v": v, "__n": pa.array([1] * len(x), pa.int64()), "__part": zero(len(x))})
    flat = pa.array([[c for corner in ring for c in corner] for _, ring in polygons], pa.list_(pa.float64()))
    q = pa.table({"__ring": flat} | {c: zero(len(polygons)) for c in ("__cx", "__cy", "__part")})
    near = [r for r in points if None not in r[:2] and 0 <= r[0] < 100 and 0 <= r[1] < 100]
    n, known, whole, rest = Z.sums(p, q, 100.0)
    for i, (_, ring) in enumerate(polygons):
        want = brute(near, [(0, ring)]).get(0, (0, None))
        assert n[i] == want[0] and (want[1] is None or (whole[i] + rest[i]) / known[i] == pytest.approx(want[1], rel=1e-12))


def test_values_that_are_not_finite(spark):
    square = lambda k, a: (k, [(float(x), float(y)) for x, y in ((a, 0), (a + 1, 0), (a + 1, 1), (a, 1))])
    inf, nan = math.inf, math.nan
    points = [(0.5, 0.5, 1.0), (0.5, 0.6, inf), (1.5, 0.5, -inf), (2.5, 0.5, inf), (2.5, 0.6, -inf), (3.5, 0.5, nan), (4.5, 0.5, 2.0)]
    p, q = spark.createDataFrame(points, "x double, y double, v double"), spark.createDataFrame([square(k, k) for k in range(5)], KIND)
    got = {r.id: r["mean"] for r in Z.statistics_within(p, q, "x", "y", "ring", ["id"], "v", 10.0).collect()}
    assert got[0] == inf and got[1] == -inf and math.isnan(got[2]) and math.isnan(got[3]) and got[4] == 2.0


def test_no_tables(spark):
    points, polygons = cases()
    p, q = spark.createDataFrame(points, "x double, y double, v double"), spark.createDataFrame(polygons, KIND)
    for a, b in ((p.limit(0), q), (p, q.limit(0))):
        assert Z.statistics_within(a, b, "x", "y", "ring", ["id"], "v", 3.0).count() == 0


def test_no_pair_is_a_row(spark, sf):
    """The query joins no points to polygons, so that its rows do not grow with the pairs."""
    from gridloom.plans import registry

    plan = registry.queries()["j14_j22_g14_points_in_polygons"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_many_pairs(spark):
    """A hundred million pairs in one cell are counted without being met one by one."""
    n, m = 50_000, 2_000
    p = spark.range(n).select((F.rand(1) * 90).alias("x"), (F.rand(2) * 90).alias("y"), F.lit(2.5).alias("v"))
    corner = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), (F.lit(y) + F.col("id") * 1e-6).alias("y"))
    q = spark.range(m).select("id", F.array(corner(-1, -1), corner(91, -1), corner(91, 91), corner(-1, 91)).alias("ring"))
    got = Z.statistics_within(p, q, "x", "y", "ring", ["id"], "v", 100.0).agg(F.count("*"), F.sum("n"), F.min("mean"), F.max("mean")).first()
    assert tuple(got) == (m, n * m, 2.5, 2.5)
