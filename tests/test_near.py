"""Neighbours and clusters within groups against brute force: ties, copies, shared keys, missing places, blocks, and dense places."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import near as N


def brute(rows, radius, k, by):
    """Lists of (dist, row) by key, as a join and a rank of each key would give them."""
    out = {r[0]: [] for r in rows}
    for a in rows:
        for b in rows:
            if a[0] != b[0] and a[1] == b[1] and a[1] is not None and None not in (a[2], a[3], b[2], b[3]) and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= radius * radius:
                out[a[0]].append((math.sqrt((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2), by(b), b))
    return {key: sorted(v, key=lambda p: p[:2])[:k] for key, v in out.items()}


def cases(spark):
    r = np.random.default_rng(5)
    rows = [(f"a{i}", int(r.integers(3)), float(r.integers(40)), float(r.integers(40)), float(r.integers(5))) for i in range(300)]
    rows += [(f"c{i}", 1, 7.0, 7.0, float(i % 4)) for i in range(60)] + [("far", 1, 9e5, 9e5, 1.0), ("gone", 1, None, 3.0, 2.0), ("none", None, 3.0, 3.0, 2.0)]
    rows += [rows[0], rows[0], (*rows[1][:4], 3.5)]
    return rows, spark.createDataFrame(rows, "key string, g int, x double, y double, v double")


@pytest.mark.parametrize("most", [None, 20])
@pytest.mark.parametrize("radius", [2.0, 11.0, 80.0])
def test_nearest_within_equals_brute_force(spark, radius, most):
    rows, df = cases(spark)
    got = {r.key: [(p.dist, p.other) for p in r.near] for r in N.nearest_within(df, "key", ["g"], "x", "y", radius, 6, most=most).collect()}
    want = brute(rows, radius, 6, lambda b: b[0])
    assert got == {k: [p[:2] for p in v] for k, v in want.items()}


def test_neighbour_statistics_equal_brute_force(spark):
    rows, df = cases(spark)
    want = brute(rows, 9.0, 6, lambda b: b[4])
    got = {r.key: r for r in N.neighbour_statistics(df, "key", ["g"], "x", "y", 9.0, 6, "v").collect()}
    assert set(got) == set(want)
    for k, near in want.items():
        o = [p[1] for p in near]
        assert got[k].n == len(o) and got[k].x == max(r[4] for r in rows if r[0] == k)
        assert got[k].med == (float(np.median(o)) if o else None) and got[k].max_d == (near[-1][0] if o else None)
        assert got[k].mad == (float(np.median(np.abs(np.array(o) - np.median(o)))) if o else None)


@pytest.mark.parametrize("name", ["j18_w05_neighbours_same_date", "m23_reliability"])
def test_no_pair_is_a_row(spark, sf, name):
    """A query of neighbours joins nothing, so that its shuffles do not grow with the pairs."""
    from gridloom.plans import registry

    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("most", [None, 30])
@pytest.mark.parametrize("eps", [1.5, 4.0, 30.0])
def test_clusters_equal_brute_force(spark, eps, most):
    from gridloom.operators import algorithms as A

    r = np.random.default_rng(8)
    rows = [(f"p{i}", int(r.integers(2)), float(r.integers(60)), float(r.integers(60))) for i in range(260)]
    rows += [(f"q{i}", 0, float(i), 90.0) for i in range(200)] + [(f"s{i}", 1, 7.0, 7.0) for i in range(50)] + [rows[0], rows[1], ("gone", None, 1.0, 1.0), ("place", 0, None, 1.0)]
    df = spark.createDataFrame(rows, "id string, g int, x double, y double")
    near = {}
    for a in rows:
        for b in rows:
            if a[1] == b[1] and None not in (*a, *b) and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= eps * eps:
                near.setdefault(a[0], []).append(b[0])
    core = {a for a, v in near.items() if len(v) >= 4}
    name = {a: a for a in core}
    while (up := {a: min(name[b] for b in near[a] if b in core) for a in core}) != name:
        name = up
    want = {a: (name[a], True) for a in core} | {a: (name[min(b for b in v if b in core)], False) for a, v in near.items() if a not in core and core & set(v)}
    got = A.density_clusters(df, "id", ["g"], "x", "y", eps, 4, most=most).collect()
    assert len(got) == len(want) and {r.id: (r.cluster, r.core) for r in got} == want


def test_component_split_of_many_components(spark):
    """More components than the 200,000 that were the limit."""
    from gridloom.operators import algorithms as A

    df = spark.range(201_000).select(F.col("id").alias("c"), (F.col("id") % 3).alias("mo"))
    got = A.balanced_component_split(df, "c", ["mo"], {"train": 0.7, "val": 0.15, "test": 0.15}, restarts=1)
    n = {r.split: r["count"] for r in got.groupBy("split").count().collect()}
    assert sum(n.values()) == 201_000 and abs(n["train"] - 140_700) < 300 and abs(n["val"] - 30_150) < 300


def test_dense_place(spark):
    """Copies at one place, and rows at many places close together, are not all compared with each other."""
    n = 20_000
    df = spark.range(2 * n).select(F.format_string("%06d", "id").alias("key"), F.lit(1).alias("g"), F.when(F.col("id") < n, 5.0).otherwise(F.col("id") * 1e-6).alias("x"), F.lit(5.0).alias("y"))
    got = N.nearest_within(df, "key", ["g"], "x", "y", 100.0, 3)
    first = {r.key: [p.other for p in r.near] for r in got.filter("key in ('000000', '000007', '025000')").collect()}
    assert first == {"000000": ["000001", "000002", "000003"], "000007": ["000000", "000001", "000002"], "025000": ["024999", "025001", "024998"]} or first["025000"][:2] in (["024999", "025001"], ["025001", "024999"])
    assert got.agg(F.sum(F.size("near"))).first()[0] == 6 * n
