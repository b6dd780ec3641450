"""Statistics of the points within polygons: points and polygons are dealt to tasks by grid cell and met there in numpy, on
quadtrees of the points. A node that no edge of a polygon comes near counts whole, by sums made once; points are tested one by
one only in small nodes along the edges. A pair of point and polygon is never a row of Spark."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near import numbers

#: Points and polygons that a call of Python gets, about; a cell with more of either than MOST or MOST_RINGS is split.
ROWS, RINGS, MOST, MOST_RINGS = 60_000, 10_000, 200_000, 50_000
#: Edges of nodes, and points against edges, that are worked on at a time.
BUDGET, TESTS = 50_000, 500_000
#: Nodes of at most so many points are tested point by point; a cell is halved so often at most.
LEAF, DEEPEST = 16, 20


def statistics_within(points: DataFrame, polygons: DataFrame, x: str, y: str, ring: str, by: list[str], value: str, width: float, most: int | None = None, most_rings: int | None = None) -> DataFrame:
    """(by, n, mean): how many points the polygons of each key hold by the even-odd test of polygons.inside(), and the mean of
    their values that are not null. Keys without a point have no row; a ring with a corner that is null or not finite holds nothing.
    width: of the cells by which work is dealt."""
    most, most_rings = most or MOST, most_rings or MOST_RINGS
    p = points.select(*[F.col(c).cast("double").alias(a) for c, a in ((x, "__x"), (y, "__y"), (value, "__v"))])
    p = p.filter((F.abs("__x") < float("inf")) & (F.abs("__y") < float("inf")))
    cell = lambda c: F.floor(c / width)
    p = p.withColumn("__cx", cell(F.col("__x"))).withColumn("__cy", cell(F.col("__y")))
    axis = lambda k: F.transform(ring, lambda c: c[k].cast("double"))
    span = lambda k: F.sequence(cell(F.array_min(axis(k))), cell(F.array_max(axis(k))))
    flat = F.flatten(F.transform(ring, lambda c: F.array(c["x"].cast("double"), c["y"].cast("double"))))
    q = polygons.filter(F.forall(flat, lambda v: F.abs(v) < float("inf"))).select(*by, flat.alias("__ring"), span("x").alias("__cx"), span("y").alias("__cy"))
    q = q.withColumn("__cx", F.explode("__cx")).withColumn("__cy", F.explode("__cy"))

    at = ["__cx", "__cy"]
    sizes = p.groupBy(*at).agg(F.count("*").alias("__np")).join(q.groupBy(*at).agg(F.count("*").alias("__nq")), at)
    total, rings, largest, fullest = sizes.agg(F.sum("__np"), F.sum("__nq"), F.max("__np"), F.max("__nq")).first()
    p, q = p.withColumn("__n", F.lit(1).cast("bigint")), q.withColumn("__part", F.lit(0).cast("bigint"))
    if (largest or 0) > most or (fullest or 0) > most_rings:
        # points that agree in all become one; each part of a large cell's points meets each part of its polygons
        p = p.groupBy(*at, "__x", "__y", "__v").agg(F.sum("__n").alias("__n"))
        large = sizes.filter((F.col("__np") > most) | (F.col("__nq") > most_rings))
        large = F.broadcast(large.select(*at, F.ceil(F.col("__np") / most).alias("__i"), F.ceil(F.col("__nq") / most_rings).alias("__j")))
        one = F.lit(1).cast("bigint")
        own = lambda k, *c: F.pmod(F.xxhash64(*c), F.coalesce(k, one))
        each = lambda k: F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col(k), one) - 1))
        p = p.join(large, at, "left").withColumn("__own", own(F.col("__i"), "__x", "__y", "__v")).withColumn("__other", each("__j"))
        p = p.withColumn("__part", F.col("__own") * F.coalesce("__j", one) + F.col("__other")).drop("__i", "__j", "__own", "__other")
        q = q.join(large, at, "left").withColumn("__own", own(F.col("__j"), *by, "__ring")).withColumn("__other", each("__i"))
        q = q.withColumn("__part", F.col("__other") * F.coalesce("__j", one) + F.col("__own")).drop("__i", "__j", "__own", "__other")
    else:
        p = p.withColumn("__part", F.lit(0).cast("bigint"))
    buckets = F.lit(1 + max((total or 0) // ROWS, (rings or 0) // RINGS))
    bucket = F.pmod(F.xxhash64(*at, "__part"), buckets).alias("__bucket")
    p, q = p.select(bucket, "__x", "__y", "__v", "__n", "__part"), q.select(bucket, *by, *at, "__part", "__ring")

    def call(left, right):
        import pyarrow as pa

        n, known, whole, rest = sums(left, right, width)
        some = np.flatnonzero(n)
        return pa.table({c: right[c].take(pa.array(some)) for c in by} | {"n": n[some], "known": known[some], "whole": whole[some], "rest": rest[some]})

    kinds = ", ".join(f"`{c}` {polygons.schema[c].dataType.simpleString()}" for c in by)
    met = p.groupBy("__bucket").cogroup(q.groupBy("__bucket")).applyInArrow(call, f"{kinds}, n bigint, known bigint, whole double, rest double")
    out = met.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("known").alias("__known"), (F.sum("whole") + F.sum("rest")).alias("__sum"))
    return out.select(*by, "n", F.when(F.col("__known") > 0, F.col("__sum") / F.col("__known")).alias("mean"))


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The ranges start, start + 1, … of count numbers each, one after the other."""
    ends = np.cumsum(count)
    return np.repeat(start - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def sums(points, rings, width: float):
    """(n, known, whole, rest) for each row of rings: the points that it holds, those with a value, and the sum of these in
    two parts, of the whole numbers below the values and of what is left, so that the first has no rounding."""
    import pyarrow.compute as pc

    m = rings.num_rows
    out = [np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m), np.zeros(m)]
    if not m or not points.num_rows:
        return out
    column = lambda t, c: t[c].to_numpy()
    x, y, v, n = numbers(points["__x"]), numbers(points["__y"]), points["__v"], column(points, "__n")
    # cells that have a polygon, by number
    cell, code, known = np.zeros(m, np.int64), np.zeros(len(x), np.int64), np.ones(len(x), bool)
    for c, mine in (("__cx", np.floor(x / width)), ("__cy", np.floor(y / width)), ("__part", column(points, "__part"))):
        u, at = np.unique(column(rings, c), return_inverse=True)
        place = np.minimum(np.searchsorted(u, mine), len(u) - 1)
        known &= u[place] == mine
        cell, code = cell * len(u) + at, code * len(u) + place
    cells, cell = np.unique(cell, return_inverse=True)
    place = np.minimum(np.searchsorted(cells, code), len(cells) - 1)
    use = np.flatnonzero(known & (cells[place] == code))
    if not len(use):
        return out
    valued = v.is_valid().to_numpy()[use]
    x, y, v, n, place = x[use], y[use], numbers(v)[use], n[use], place[use]
    tree = Tree(place, x, y)
    valued, v, n = valued[tree.order], v[tree.order], n[tree.order]
    finite = np.isfinite(v)
    below = np.floor(np.where(finite, v, 0.0))
    odd = [np.isnan(v) & valued, np.isposinf(v), np.isneginf(v)]
    odd = odd if any(o.any() for o in odd) else []
    per = [n, n * valued, below * n, (np.where(finite, v, 0.0) - below) * n, *[o.astype(np.int64) for o in odd]]
    out += [np.zeros(m, np.int64) for _ in odd]
    run = [np.concatenate([[0], np.cumsum(w)])[tree.sites] for w in per]

    def add(r, low, high):
        low_r = r.min()
        for total, s in zip(out, run, strict=True):
            part = np.bincount(r - low_r, weights=s[high] - s[low])
            total[low_r : low_r + len(part)] += part.astype(total.dtype)

    ring = rings["__ring"]
    size = pc.fill_null(pc.list_value_length(ring), 0).to_numpy().astype(np.int64) // 2
    tree.meet(cell, size, numbers(pc.list_flatten(ring)).reshape(-1, 2), add)
    if odd:
        nan, up, down = out[4:]
        out[3] += np.where((nan > 0) | (up > 0) & (down > 0), np.nan, np.where(up > 0, np.inf, np.where(down > 0, -np.inf, 0.0)))
    return out[:4]


class Tree:
    """Quadtrees of the points of each cell. A site is a place with its points (copies at one place are one site where they are
    many). `order` sorts the points, and site i has those from sites[i] on; a node is a range of sites with its box."""

    def __init__(self, cell: np.ndarray, x: np.ndarray, y: np.ndarray):
        k = int(cell.max()) + 1
        code = cell.astype(np.int64)
        for v, shift in ((x, 0), (y, 1)):
            low, high = np.full(k, np.inf), np.full(k, -np.inf)
            np.minimum.at(low, cell, v)
            np.maximum.at(high, cell, v)
            side = np.where(high > low, high - low, 1.0)
            b = np.clip((v - low[cell]) / side[cell] * 2**DEEPEST, 0, 2**DEEPEST - 1).astype(np.int64)
            for by, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
                b = (b | (b << by)) & mask
            code = (code << (0 if shift else 2 * DEEPEST)) | (b << shift)
        self.order = np.argsort(code, kind="stable")
        sorted_code = code[self.order]
        new = np.diff(sorted_code) != 0
        self.sites = np.arange(len(x) + 1)
        if np.diff(np.flatnonzero(np.concatenate([[True], new, [True]]))).max() > LEAF:
            self.order = np.lexsort((y, x, code))
            sorted_code, a, b = code[self.order], x[self.order], y[self.order]
            first = np.concatenate([[True], (sorted_code[1:] != sorted_code[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]), [True]])
            self.sites = np.flatnonzero(first)
            sorted_code = sorted_code[self.sites[:-1]]
        at = self.order[self.sites[:-1]]
        self.x, self.y = x[at], y[at]
        step = sorted_code[1:] ^ sorted_code[:-1]
        self.levels = []
        for level in range(DEEPEST + 1):
            start = np.concatenate([[0], np.flatnonzero(step >> 2 * (DEEPEST - level)) + 1])
            end = np.append(start[1:], len(at))
            box = [f.reduceat(w, start) for w in (self.x, self.y) for f in (np.minimum, np.maximum)]
            self.levels.append((start, end, *box))
            if (end - start).max() <= LEAF:
                break
        self.cells = sorted_code[self.levels[0][0]] >> 2 * DEEPEST
        self.children = []
        for one, two in zip(self.levels, self.levels[1:]):
            first = np.searchsorted(two[0], one[0])
            self.children.append((first, np.diff(np.append(first, len(two[0])))))

    def meet(self, cell: np.ndarray, size: np.ndarray, corners: np.ndarray, add: Callable) -> None:
        """add(polygons, first sites, sites after the last) for what each polygon (its cell, number of corners, and the corners of
        all) holds."""
        start = np.cumsum(size) - size
        follow = np.arange(len(corners)) + 1
        follow[(start + size - 1)[size > 0]] = start[size > 0]
        self.edges = np.concatenate([corners, corners[follow]], axis=1).T.copy()
        node = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
        r = np.flatnonzero((self.cells[node] == cell) & (size > 0))
        # what is left to do: level, polygons, nodes, whether an odd number of edges is crossed besides those kept, kept edges
        todo = [(0, r, node[r], np.zeros(len(r), np.int64), size[r], spread(start[r], size[r]))]
        while todo:
            level, r, node, odd, count, e = todo.pop()
            if len(e) <= BUDGET or len(r) == 1:
                todo += self.step(level, r, node, odd, count, e, add)
                continue
            ends = np.cumsum(count)
            i = min(max(int(np.searchsorted(ends, len(e) // 2)), 1), len(r) - 1)
            todo += [(level, r[i:], node[i:], odd[i:], count[i:], e[ends[i - 1] :]), (level, r[:i], node[:i], odd[:i], count[:i], e[: ends[i - 1]])]

    def crossed(self, e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which edges a ray from the point to the right crosses, in the arithmetic of polygons.inside()."""
        xa, ya, xb, yb = (v[e] for v in self.edges)
        hit = np.flatnonzero((ya > y) != (yb > y))
        xa, ya, xb, yb = xa[hit], ya[hit], xb[hit], yb[hit]
        return hit[x[hit] < (xb - xa) * (y[hit] - ya) / (yb - ya) + xa]

    def step(self, level, r, node, odd, count, e, add) -> list:
        """Settles nodes away from edges and small ones; returns the children of the others."""
        if not len(r):
            return []
        start, end, *box = self.levels[level]
        p = np.repeat(np.arange(len(r)), count)
        xa, ya, xb, yb = (v[e] for v in self.edges)
        x0, x1, y0, y1 = (b[node][p] for b in box)
        # far more than rounding, so what is not near is on the same side in floating point
        slack = 1e-12 * (np.abs(xa) + np.abs(xb) + np.abs(ya) + np.abs(yb) + np.abs(x0) + np.abs(x1) + np.abs(y0) + np.abs(y1))
        low, high = np.minimum(ya, yb), np.maximum(ya, yb)
        never = (high < y0 - slack) | (low > y1 + slack) | (np.maximum(xa, xb) < x0 - slack)
        right = np.minimum(xa, xb) > x1 + slack
        dx, dy = xb - xa, yb - ya
        side = dx * ((y0 + y1) / 2 - ya) - dy * ((x0 + x1) / 2 - xa)
        near = ~never & ~right & (np.abs(side) <= ((x1 - x0) / 2 + slack) * np.abs(dy) + ((y1 - y0) / 2 + slack) * np.abs(dx))
        # an edge beside the node over all its height is crossed from all of its points or from none
        beside = ~never & ~near & (low < y0 - slack) & (high > y1 + slack)
        always = beside & (right | ((side > 0) == (dy > 0)))
        odd = odd ^ (np.bincount(p[always], minlength=len(r)) & 1)
        keep = ~never & ~beside
        close = np.bincount(p[near], minlength=len(r)) > 0
        e, p = e[keep], p[keep]
        count = np.bincount(p, minlength=len(r))
        first = np.cumsum(count) - count

        far = np.flatnonzero(~close)
        if len(far):
            at, c = start[node[far]], count[far]
            i, k = np.repeat(np.arange(len(far)), c), spread(first[far], c)
            hit = self.crossed(e[k], self.x[at[i]], self.y[at[i]])
            within = far[((np.bincount(i[hit], minlength=len(far)) + odd[far]) & 1) == 1]
            if len(within):
                add(r[within], start[node[within]], end[node[within]])
        small = close & ((end[node] - start[node] <= LEAF) | (level == len(self.levels) - 1))
        leaf = np.flatnonzero(small)
        if len(leaf):
            size = end[node[leaf]] - start[node[leaf]]
            who, site = np.repeat(leaf, size), spread(start[node[leaf]], size)
            cut = np.flatnonzero(np.diff(np.cumsum(count[who]) // TESTS)) + 1
            for i, j in zip([0, *cut], [*cut, len(who)]):
                w, s = who[i:j], site[i:j]
                t = np.repeat(np.arange(len(w)), count[w])
                hit = self.crossed(e[spread(first[w], count[w])], self.x[s[t]], self.y[s[t]])
                within = ((np.bincount(t[hit], minlength=len(w)) + odd[w]) & 1) == 1
                if within.any():
                    add(r[w[within]], s[within], s[within] + 1)
        large = np.flatnonzero(close & ~small)
        if not len(large):
            return []
        child, n = self.children[level]
        child, n = child[node[large]], n[node[large]]
        of = np.repeat(large, n)
        return [(level + 1, r[of], spread(child, n), odd[of], count[of], e[spread(first[of], count[of])])]
