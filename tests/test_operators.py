"""Operators on tiny frames, where the driver tables do not reach: nulls, ties, edges, degenerate shapes."""

import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalars as X
from gridloom.operators import algorithms as A
from gridloom.operators import relational as R
from gridloom.operators import sampling
from gridloom.sources import io


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_finite_rejects_null_nan_inf(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (float("inf"),), (-math.inf,)], "x double")
    assert [r[0] for r in df.select(X.finite("x")).collect()] == [True, False, False, False, False]


def test_centroid_falls_back_on_flat_quadrilaterals(spark):
    cx, cy = X.centroid([F.lit(v) for v in (0.0, 2.0, 2.0, 0.0)], [F.lit(v) for v in (0.0, 0.0, 2.0, 2.0)])
    fx, fy = X.centroid([F.lit(float(v)) for v in (0, 1, 2, 3)], [F.lit(0.0)] * 4)
    assert tuple(one(spark, a=cx, b=cy, c=fx, d=fy)) == (1.0, 1.0, 1.5, 0.0)


def test_wrap_is_floored(spark):
    r = one(spark, a=X.wrap180(F.lit(-190.0)), b=X.wrap180(F.lit(180.0)), c=X.wrap180(F.lit(540.5)))
    assert tuple(r) == (170.0, -180.0, -179.5)


def test_bins_close_on_the_stated_side(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (2.1,), (None,)], "x double")
    left = [r[0] for r in df.select(X.cut_bins("x", [0, 1, 2], ["a", "b"])).collect()]
    right = [r[0] for r in df.select(X.cut_bins("x", [0, 1, 2], ["a", "b"], True)).collect()]
    assert left == ["a", "b", "b", None, None] and right == [None, "a", "b", None, None]


def test_composites(spark):
    df = spark.createDataFrame([(1,), (32,), (33,), (209,), (216,), (217,), (366,)], "d int")
    assert [r[0] for r in df.select(X.composite_day("d")).collect()] == [1, 25, 33, 209, 209, 217, 361]
    assert [r[0] for r in df.select(X.nearest_composite("d", 33, 209)).collect()] == [33, 33, 33, 209, 209, 209, 209]
    assert one(spark, a=X.nearest_composite(F.lit(37), 33, 209))[0] == 33  # a tie goes to the earlier


def test_interval_join_closed_ends(spark):
    left = spark.createDataFrame([(1, "2020-01-05"), (1, "2020-01-10"), (1, "2020-01-11"), (2, "2020-01-05")], "k int, d string")
    right = spark.createDataFrame([(1, "2020-01-05", "2020-01-10")], "k int, lo string, hi string")
    got = {(r.k, r.d): r.date_align for r in R.interval_join(left, right, ["k"], "d", "lo", "hi").collect()}
    assert list(got.values()).count("inrange") == 2 and got[1, "2020-01-11"] == "outrange" and got[2, "2020-01-05"] == "no_product"


def test_checked_join_rejects_repeated_keys(spark):
    a = spark.createDataFrame([(1,)], "k int")
    b = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(R.CardinalityError):
        R.join_checked(a, b, ["k"], validate="many_to_one")


def test_weighted_mean_ignores_bad_weights(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0), (9.0, 0.0), (float("nan"), 5.0), (7.0, None)], "x double, w double")
    assert df.agg(R.weighted_mean(F.col("x"), F.col("w"))).first()[0] == 2.5
    assert df.filter("w = 0").agg(R.weighted_mean(F.col("x"), F.col("w"))).first()[0] is None


def test_asof_and_rank(spark):
    left = spark.createDataFrame([(0,), (5,), (2500,), (2500,), (99,)], "at long")
    right = spark.createDataFrame([(5,), (50,), (1200,)], "key long")
    got = sorted((r.at, r.key) for r in R.asof_backward(left, right, "at", "key", 100).collect() if r.key is not None)
    assert got == [(5, 5), (99, 50), (2500, 1200), (2500, 1200)]
    ranked = R.global_rank(spark.range(100).withColumnRenamed("id", "x"), F.floor(F.col("x") / 7), F.col("x"))
    assert all(r["rank"] == r.x + 1 for r in ranked.collect())


def test_asof_carries_over_blocks_of_steps(spark):
    left = spark.createDataFrame([(-1,), (7,), (2_500_000,), (9_000_123,)], "at long")
    right = spark.createDataFrame([(6,), (3,), (1_200_000,)], "key long")
    got = {r.at: r.key for r in R.asof_backward(left, right, "at", "key", 100).collect()}
    assert got == {-1: None, 7: 6, 2_500_000: 1_200_000, 9_000_123: 1_200_000}


def test_left_join_null_safe(spark):
    a, b = spark.createDataFrame([(1, 1), (None, 2), (3, 3)], "k int, x int"), spark.createDataFrame([(1, 10), (None, 20)], "k int, y int")
    assert sorted((r.x, r.y) for r in R.left_join_null_safe(a, b, ["k"]).collect() if r.y) == [(1, 10), (2, 20)]
    assert R.left_join_null_safe(a, b, ["k"]).columns == ["k", "x", "y"]


def test_k_nearest_equals_brute_force(spark):
    points = [(i, float(i * 37 % 101), float(i * 53 % 97)) for i in range(60)] + [(100, 5.0, 5.0), (101, 5.0, 5.0), (102, 900.0, 900.0), (103, None, 1.0)]
    targets = [(1, 5.0, 5.0), (2, 50.0, 50.0), (3, 1000.0, -1000.0), (4, None, 0.0)]
    p, t = spark.createDataFrame(points, "p long, px double, py double"), spark.createDataFrame(targets, "t long, x double, y double")
    for k in (1, 4, 70):
        got = sorted((r.t, r["rank"], r.p) for r in R.k_nearest(t, p, "t", "p", ("x", "y"), ("px", "py"), k, 3.0).collect())
        want = []
        for i, x, y in targets[:3]:
            order = sorted((math.hypot(x - px, y - py), j) for j, px, py in points if px is not None)
            want += [(i, n + 1, j) for n, (_, j) in enumerate(order[:k])]
        assert got == sorted(want)
    assert R.k_nearest(t.limit(0), p, "t", "p", ("x", "y"), ("px", "py"), 2, 3.0).count() == 0
    assert R.k_nearest(t, p.limit(0), "t", "p", ("x", "y"), ("px", "py"), 2, 3.0).count() == 0


def test_exact_quantiles(spark):
    inf, nan = float("inf"), float("nan")
    groups = {
        "a": [3.0, -1.5, 0.0, -0.0, 1e-300, -1e300, 2.0, 2.0, 2.0, 7.25, None], "one": [4.0], None: [5.0, 1.0, None], "none": [None, None],
        "close": [1e6 + i / 7 for i in range(50)], "ends": [-inf, inf, nan, 0.0, 1.0, -1.0, -2.0], "same": [0.1] * 9,
    }
    df = spark.createDataFrame([(k, x, 1) for k, xs in groups.items() for x in xs], "k string, x double, p int").repartition(5)
    ps = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    got = {r.k: r.q for r in R.exact_quantiles(df, ["k"], "x", ps, "q").collect()}
    want = {r.k: r.q for r in df.filter("x is not null").groupBy("k").agg(F.percentile("x", F.array(*[F.lit(p) for p in ps])).alias("q")).collect()}
    plain = lambda d: sorted((str(k), [str(x + 0.0) for x in xs]) for k, xs in d.items())  # noqa: E731  (one zero)
    assert set(got) == {"a", "one", None, "close", "ends", "same"} and plain(got) == plain(want)
    assert R.exact_quantiles(df, [], "x", (0.5,)).count() == 1 and R.exact_quantiles(df.limit(0), ["k"], "x", ps).count() == 0


def test_metrics_of_constant_and_single_groups(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 1.0), ("b", 1.0, 3.0)], "g string, y double, p double")
    r = {x.g: x for x in df.groupBy("g").agg(*R.regression_metrics("y", "p")).collect()}
    assert r["a"].n == 1 and r["a"].r2 is None and r["a"].residual_sd is None and r["b"].r2 is None and r["b"].bias == 1.0


def test_components_of_a_chain(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in A.components(edges).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and got[101] == 100


def test_density_clusters_border_and_noise(spark):
    pts = [(f"a{i}", "t", float(i), 0.0) for i in range(5)] + [("far", "t", 100.0, 0.0), ("border", "t", 5.0, 0.0), ("other", "u", 2.0, 0.0)]
    df = spark.createDataFrame(pts, "id string, g string, x double, y double")
    got = {r.id: (r.cluster, r.core) for r in A.density_clusters(df, "id", ["g"], "x", "y", 1.0, 3).collect()}
    assert set(got) == {"a0", "a1", "a2", "a3", "a4", "border"} and got["border"] == ("a1", False) and got["a0"][1] is False


def test_balanced_chunks(spark):
    sizes = {n: [r["count"] for r in A.balanced_chunks(spark.range(n), [], F.col("id"), low=4, high=10).groupBy("chunk").count().orderBy("chunk").collect()] for n in (3, 4, 10, 11, 23)}
    assert sizes == {3: [3], 4: [4], 10: [10], 11: [6, 5], 23: [8, 8, 7]}


def test_largest_remainder_meets_the_total(spark):
    import random

    def one_by_one(sizes, total):
        """Unit after unit, as the rule says."""
        total = min(total, sum(sizes))
        share = [n * total / sum(sizes) for n in sizes]
        out = [int(x) for x in share]
        if total >= len(sizes):
            out = [max(1, x) for x in out]
        while sum(out) > total:
            k = max((k for k in range(len(sizes)) if out[k] > 1), key=lambda k: (out[k] - share[k], -k))
            out[k] -= 1
        while sum(out) < total:
            k = max((k for k in range(len(sizes)) if out[k] < sizes[k]), key=lambda k: (share[k] - out[k], -k))
            out[k] += 1
        return out

    r = random.Random(4)
    groups = [[1, 50, 149, 300], [1] * 40 + [500, 700], [3, 3, 3], [1, 1, 1, 1, 90]]
    groups += [[r.choice([1, 1, 2, 9, 200, 1000]) for _ in range(r.randint(1, 30))] for _ in range(20)]
    rows = [(g, k, n) for g, sizes in enumerate(groups) for k, n in enumerate(sizes)]
    counts = spark.createDataFrame(rows, "g long, k long, n long")
    for total in (1, 7, 45, 100):
        got = {(x.g, x.k): x.quota for x in sampling.largest_remainder(counts, ["k"], total, within=["g"]).collect()}
        for g, sizes in enumerate(groups):
            assert [got[g, k] for k in range(len(sizes))] == one_by_one(sizes, total)


def test_group_split_keeps_groups_whole(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 50)
    s = sampling.group_split(df, ["g"], {"train": 0.7, "val": 0.15, "test": 0.15})
    assert s.select("g", "split").distinct().count() == 50


def test_reliability_flags(spark):
    from statistics import median

    import numpy as np

    r = np.random.default_rng(3)
    rows = [(i, int(r.integers(2)), float(r.uniform(0, 100)), float(r.uniform(0, 100)), float(r.choice([1.0, 1.1, 9.0, -7.0]))) for i in range(90)] + [(200, 0, 900.0, 900.0, 5.0)]
    df = spark.createDataFrame(rows, "id long, g long, x double, y double, v double")
    pairs = R.self_pairs(df, ["id"], ["v"], "x", "y", 25.0, ["g"])
    got = {x.id: x for x in A.reliability(df, ["id"], pairs, "v", nearest=6).collect()}
    assert set(got) == {x[0] for x in rows}
    seen = set()
    for i, g, x, y, v in rows:
        near = sorted((np.hypot(x - p, y - q), w) for j, h, p, q, w in rows if j != i and h == g and np.hypot(x - p, y - q) <= 25)[:6]
        o = [w for _, w in near]
        assert got[i].n == len(o)
        if not o:
            assert got[i].med is None and got[i].flag == "keep"
            continue
        med = median(o)
        score = abs(v - med) / max(median([abs(w - med) for w in o]), 0.01)
        want = "keep" if len(o) < 5 or score < 4 or v == med else "suspicious_low" if v < med else "suspicious_high"
        seen.add(want)
        assert got[i].med == pytest.approx(med) and got[i].score == pytest.approx(score) and got[i].flag == want
    assert seen == {"keep", "suspicious_low", "suspicious_high"}


def test_early_stop(spark):
    h = spark.createDataFrame([("r", e, v) for e, v in enumerate([5.0, 3.0, 4.0, 4.0, 4.0, 1.0])], "run string, e int, loss double")
    r = A.early_stop(h, "run", "e", "loss", 3).first()
    assert (r.best_epoch, r.best_loss, r.stop_epoch) == (1, 3.0, 4)


def test_component_split(spark):
    rows = [(c, k % 3, "ab"[c % 2]) for c in range(30) for k in range(3 + c % 5 * 4)]
    df = spark.createDataFrame(rows, "c long, mo long, kind string")
    shares = {"train": 0.7, "val": 0.15, "test": 0.15}
    got = {r.c: r.split for r in A.balanced_component_split(df, "c", ["mo", "kind"], shares, restarts=12).collect()}
    assert set(got) == set(range(30))
    for name, share in shares.items():
        mine = [x for x in rows if got[x[0]] == name]
        assert abs(len(mine) / len(rows) - share) < 0.05 and {x[1] for x in mine} == {0, 1, 2} and {x[2] for x in mine} == {"a", "b"}
    with pytest.raises(ValueError, match="fewer components"):
        A.balanced_component_split(df.filter("c < 2"), "c", ["kind"], shares)


def test_greedy_restart_takes_the_least_error():
    import numpy as np

    v, w, share = np.array([[70.0, 70], [15, 15], [15, 15]]), np.array([4.0, 1]), np.array([0.7, 0.15, 0.15])
    score, part = A._greedy(v, w, share, 1)
    assert score == pytest.approx(0) and part[0] == 0 and set(part[1:]) == {1, 2}


def test_polygons(spark):
    from gridloom.operators import polygons as P

    ring = lambda *c: [(float(a), float(b)) for a, b in c]
    kind = "id long, ring array<struct<x:double,y:double>>"
    shapes = {1: ring((1, 1), (9, 2), (4, 4), (5, 9), (0.5, 6)), 2: ring((3, 3), (7, 3), (7, 7), (3, 7)), 3: ring((20, 20), (21, 20), (20, 21))}

    def holds(r, x, y):
        n = 0
        for (xa, ya), (xb, yb) in zip(r, r[1:] + r[:1]):
            n += (ya > y) != (yb > y) and x < (xb - xa) * (y - ya) / (yb - ya) + xa
        return n % 2 == 1

    polygons = spark.createDataFrame(list(shapes.items()), kind)
    spots = [(i * 0.37 + 0.011, j * 0.41 + 0.007) for i in range(30) for j in range(28)]
    points = spark.createDataFrame(spots, "px double, py double")
    want = {(x, y, k) for x, y in spots for k, r in shapes.items() if holds(r, x, y)}
    for width in (0.7, 3.0, 50.0):
        met = P.points_in_polygons(points, polygons, "px", "py", "ring", width)
        assert {(r.px, r.py, r.id) for r in met.collect()} == want
        assert "NestedLoop" not in met._jdf.queryExecution().toString()
    codes = {(r.cx, r.cy): r.code for r in P.region_codes(polygons, "ring", 1.0, "id").collect()}
    assert codes == {(i, j): max(k for k, r in shapes.items() if holds(r, i + 0.5, j + 0.5)) for i in range(25) for j in range(25) if any(holds(r, i + 0.5, j + 0.5) for r in shapes.values())}
    part = {(r.id, r.cx, r.cy): r.fraction for r in P.cell_fractions(polygons, "ring", 1.0).collect()}
    for k, r in shapes.items():
        for i in range(22):
            for j in range(22):
                share = sum(holds(r, i + (a + 0.5) / 4, j + (b + 0.5) / 4) for a in range(4) for b in range(4)) / 16
                assert part.get((k, i, j), 0) == share
    assert P.points_in_polygons(points, polygons.limit(0), "px", "py", "ring", 1.0).count() == 0


def test_clip_and_hull(spark):
    from gridloom.operators import polygons as P

    kind = "id long, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>"
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    rows = [(1, square, [(2.0, 2.0), (6.0, 2.0), (6.0, 6.0), (2.0, 6.0)]), (2, square, [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]), (3, square, [(9.0, 9.0), (10.0, 9.0), (9.0, 10.0)]), (4, [(0.0, 0.0), (6.0, 0.0), (0.0, 6.0)], square)]
    got = spark.createDataFrame(rows, kind).withColumn("c", P.clip(F.col("a"), F.col("b"))).select("id", P.ring_area(F.col("c")).alias("area")).collect()
    assert {r.id: pytest.approx(r.area) for r in got} == {1: 4.0, 2: 1.0, 3: 0.0, 4: 14.0}
    crossed, dented = [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0)], [(0.0, 0.0), (4.0, 0.0), (1.0, 1.0), (0.0, 4.0)]
    rings = spark.createDataFrame([(1, crossed), (2, dented), (3, square[::-1])], "id long, ring array<struct<x:double,y:double>>")
    hulls = P.repaired(rings, "ring").select("id", F.size("ring").alias("n"), P.ring_area(F.col("ring")).alias("area")).collect()
    assert {r.id: (r.n, r.area) for r in hulls} == {1: (4, 16.0), 2: (3, 8.0), 3: (4, 16.0)}


def test_versions_survive_a_crash(spark, tmp_path):
    at = str(tmp_path / "log")
    table = lambda *v: spark.createDataFrame([(x,) for x in v], "v long")
    read = lambda: sorted(r.v for r in io.read_current(spark, at).collect())
    io.replace_atomically(table(*range(10)), at)
    # a writer that dies leaves a folder without its mark
    table(99).write.parquet(f"{at}/v-{2:012d}-full")
    (tmp_path / "log" / f"v-{2:012d}-full" / "_SUCCESS").unlink()
    assert read() == list(range(10))
    old = io.read_current(spark, at)
    io.replace_atomically(old.unionByName(table(10)), at)
    assert read() == list(range(11)) and old.count() == 10
    io.replace_atomically(table(1), at)
    io.replace_atomically(table(2), at)
    assert read() == [2] and len(list((tmp_path / "log").iterdir())) == 2


def test_no_nested_loop_in_spatial_joins(spark):
    a = spark.createDataFrame([(0.0, 0.0)], "x double, y double")
    b = spark.createDataFrame([(1.0, 1.0)], "rx double, ry double")
    plan = R.binned_pairs(a, b, "x", "y", "rx", "ry", 2.0)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sources(spark, tmp_path):
    import numpy as np

    (tmp_path / "wheat_2021.csv").write_bytes("name;value\nMünchen \x96;7,5\nAu;/\n".encode("latin-1"))
    got = io.read_decimal_comma(spark, str(tmp_path / "wheat_2021.csv"), ["name", "value"], ["value"]).collect()
    assert [(r.name, r.value, r.year) for r in got] == [("München –", 7.5, 2021), ("Au", None, 2021)]
    for k in range(2):
        np.savez(tmp_path / f"shard{k}.npz", ids=np.arange(3) + 10 * k)
    assert io.shard_index(spark, str(tmp_path / "shard*.npz")).count() == 6
    (tmp_path / "z.geojson").write_text('{"type":"FeatureCollection","features":[{"properties":{"name":"z"},"geometry":{"type":"Polygon","coordinates":[[[0,1],[2,3],[4,5],[0,1]]]}}]}')
    g = io.read_geojson(spark, str(tmp_path / "z.geojson"), "name string").first()
    assert g.name == "z" and g.lon == [0, 2, 4, 0] and g.lat == [1, 3, 5, 1]
    io.write_json(spark, str(tmp_path / "m.json"), {"b": 1})
    assert '"b": 1' in (tmp_path / "m.json").read_text()


def test_streams(spark, tmp_path):
    from gridloom.streaming import windows as W

    src = str(tmp_path / "in")
    spark.createDataFrame([("k", "2022-05-01 01:00:00", 1.0), ("k", "2022-05-08 01:00:00", 2.0), ("k", "2022-05-30 00:00:00", 5.0)], "k string, at string, v double").write.json(src)
    stream = spark.readStream.schema("k string, at string, v double").json(src)
    q = W.composite_counts(stream, "at", ["k"], "v").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.composite for r in spark.read.parquet(str(tmp_path / "out")).collect()} <= {121, 145}
    W.upsert_batches(spark.readStream.schema("k string, at string, v double").json(src), str(tmp_path / "table"), ["k"], "at", str(tmp_path / "c2")).awaitTermination()
    assert [r.v for r in W.read_upserted(spark, str(tmp_path / "table"), ["k"], "at").collect()] == [5.0]


def test_upserts_compact_and_run_again(spark, tmp_path, monkeypatch):
    from gridloom.streaming import windows as W

    monkeypatch.setattr(W, "COMPACT", 3)
    src, at = str(tmp_path / "in"), str(tmp_path / "table")
    for k in range(8):
        rows = [("a", k, k * 10), (f"k{k}", 1, k)] + ([("a", 0, -1)] if k == 7 else [])
        spark.createDataFrame(rows, "k string, at long, v long").coalesce(1).write.mode("append").json(src)
    stream = spark.readStream.schema("k string, at long, v long").option("maxFilesPerTrigger", 1).json(src)
    W.upsert_batches(stream, at, ["k"], "at", str(tmp_path / "c")).awaitTermination()
    got = {r.k: r.v for r in W.read_upserted(spark, at, ["k"], "at").collect()}
    assert got == {"a": 70} | {f"k{k}": k for k in range(8)}
    io.add_version(io.read_current(spark, at).limit(0), at, 6, "delta")  # a batch that is run again replaces its folder
    assert len(W.read_upserted(spark, at, ["k"], "at").collect()) <= len(got)


def test_grid_squares(spark):
    from gridloom.functions import grid

    known = {(11.575, 48.137): "32UPU", (-77.0353, 38.8895): "18SUJ", (151.2153, -33.8568): "56HLH"}
    rows = [(lon, lat, code) for (lon, lat), code in known.items()] + [(10.0, 86.0, None), (None, 1.0, None)]
    got = spark.createDataFrame(rows, "lon double, lat double, code string").select("code", grid.mgrs_square("lon", "lat").alias("square")).collect()
    assert all(r.code == r.square for r in got)


def test_square_bounds_hold_their_places(spark):
    from gridloom.functions import grid

    places = spark.range(4000).select((F.rand(1) * 360 - 180).alias("lon"), (F.rand(2) * 164 - 80).alias("lat"))
    zone, east, north = grid.utm("lon", "lat")
    low_e, low_n = grid.square_bounds("code")
    off = places.select(grid.mgrs_square("lon", "lat").alias("code"), (F.floor(east / 100000) * 100000.0).alias("e"), (F.floor(north / 100000) * 100000.0).alias("n"))
    assert off.filter((F.col("e") != low_e) | (F.col("n") != low_n) | F.col("code").isNull()).count() == 0


def test_dissolve_outline(spark):
    from gridloom.operators.polygons import dissolve

    cell = lambda g, a, b: (g, [a, a + 1.0, a + 1.0, a], [b, b, b + 1.0, b + 1.0])
    closed = ("y", [0.0, 1.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 1.0, 0.0])
    cells = spark.createDataFrame([cell("x", 0.0, 0.0), cell("x", 1.0, 0.0), cell("x", 0.0, 1.0), closed], "g string, lon array<double>, lat array<double>")
    n = {r.g: r["count"] for r in dissolve(cells, ["g"]).groupBy("g").count().collect()}
    assert n == {"x": 8, "y": 4}
    assert dissolve(cells.limit(0), ["g"]).count() == 0
