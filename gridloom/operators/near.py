"""Nearest rows and density clusters within groups: rows are dealt to tasks by group and place, and met there on grids in
numpy. A pair of rows is never a row of Spark, so shuffles and disk grow with the rows alone, however dense they lie."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a call of Python gets, about. A group of more than MOST rows is split into blocks by place.
ROWS, MOST = 30_000, 400_000
#: Pairs that are compared at a time.
BUDGET = 100_000
#: Cells are halved so often at most.
DEEPEST = 16


def dealt(df: DataFrame, groups: list[str], x: str, y: str, reach: float, late: dict[str, Column], fn: Callable, schema: str, most: int | None = None) -> DataFrame:
    """fn over tables of whole groups, or of blocks of a large one with the rows at most `reach` around them. fn gets
    (table, group codes with -1 for rows without a place or group, own); own is false for rows of other blocks. The columns of
    `late` are computed after the shuffle."""
    most = most or MOST
    sizes = df.groupBy(*groups).agg(F.count("*").alias("__n"))
    total, largest = sizes.agg(F.sum("__n"), F.max("__n")).first()
    out = df
    if (largest or 0) > most:
        large = sizes.filter(F.col("__n") > most).select(*[F.col(g).alias(f"__g_{g}") for g in groups], F.lit(True).alias("__large"))
        side, edge = 8 * reach, reach * (1 + 1e-9)
        cells = lambda c: F.explode_outer(F.when(F.col("__large"), F.sequence(F.floor((F.col(c) - edge) / side), F.floor((F.col(c) + edge) / side))))
        out = out.join(F.broadcast(large), [F.col(g) == F.col(f"__g_{g}") for g in groups], "left").drop(*[f"__g_{g}" for g in groups])
        out = out.withColumn("__bx", cells(x)).withColumn("__by", cells(y)).drop("__large")
        own = (F.col("__bx") == F.floor(F.col(x) / side)) & (F.col("__by") == F.floor(F.col(y) / side))
        out = out.withColumn("__own", F.coalesce(own, F.lit(True)))
    else:
        out = out.withColumns({"__bx": F.lit(0).cast("bigint"), "__by": F.lit(0).cast("bigint"), "__own": F.lit(True)})
    buckets = max(1, (total or 0) // ROWS)
    out = out.withColumn("__bucket", F.pmod(F.xxhash64(*groups, "__bx", "__by"), F.lit(buckets)))
    out = out.repartition("__bucket").withColumns(late)

    def call(table):
        code = np.zeros(table.num_rows, np.int64)
        bad = np.zeros(table.num_rows, bool)
        for c in (*groups, "__bx", "__by"):
            d = table[c].combine_chunks().dictionary_encode()
            if c in groups:
                bad |= d.indices.is_null().to_numpy(zero_copy_only=False)
            code = np.unique(code * (len(d.dictionary) + 1) + d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False), return_inverse=True)[1]
        at = [numbers(table[c]) for c in (x, y)]
        bad |= ~(np.isfinite(at[0]) & np.isfinite(at[1]))
        return fn(table, np.where(bad, -1, code), *at, table["__own"].to_numpy())

    return out.groupBy("__bucket").applyInArrow(call, schema)


def numbers(column) -> np.ndarray:
    """A column as doubles, null as NaN."""
    import pyarrow as pa

    return column.cast(pa.float64()).to_numpy().astype(float)


def ranks(column) -> np.ndarray:
    """The place of each row in ascending order (texts by bytes), nulls last; equal rows differ."""
    import pyarrow.compute as pc

    order = pc.sort_indices(column).to_numpy()
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def first_of(keys: tuple, rank: np.ndarray, n: int) -> np.ndarray:
    """Which rows are among the first n by rank of those that agree in keys."""
    order = np.lexsort((rank, *keys))
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    out = np.empty(len(order), bool)
    out[order] = place < n
    return out


def steps(v: np.ndarray, width: float, gap: int) -> np.ndarray:
    """Cell numbers along an axis; gaps of over `gap` empty cells are shortened to it."""
    u, at = np.unique(np.floor((v - v.min()) / width), return_inverse=True)
    return np.concatenate([[0], np.cumsum(np.minimum(np.diff(u), gap).astype(np.int64))])[at]


class Grid:
    """Points `of` all, by cells of groups. A cell's neighbours in a column of cells lie together."""

    def __init__(self, g, x, y, width: float, of: np.ndarray):
        cx, cy = steps(x, width, 3), steps(y, width, 3)
        self.ny = int(cy.max()) + 6
        self.code = (g * (int(cx.max()) + 6) + cx + 3) * self.ny + cy + 3
        self.order = of[np.argsort(self.code[of], kind="stable")]
        self.sorted = self.code[self.order]
        self.x, self.y = x[self.order], y[self.order]

    def around(self, q: np.ndarray):
        """Three ranges of places in the order for each point: those of its cell and the eight around it."""
        cells, at = np.unique(self.code[q], return_inverse=True)
        mid = cells[:, None] + np.array([-self.ny, 0, self.ny])
        return np.searchsorted(self.sorted, mid - 1, "left")[at], np.searchsorted(self.sorted, mid + 1, "right")[at]


def nearest(g, x, y, radius: float, k: int, query: np.ndarray, same: np.ndarray | None, rank: Callable[[], np.ndarray]):
    """(rows, distances): for each query (a row number) the k nearest rows of its group at most `radius` away, but for those
    that are the `same` (by default itself); of equal distance the smaller rank first. -1 and inf where there are fewer.
    A query looks within a width at which it has some tens of candidates, and wider if it finds fewer than k. Of rows at
    one place only the first can be among anyone's nearest, so copies are not compared with each other."""
    n = len(x)
    found, dist = np.full((n, k), -1, np.int64), np.full((n, k), np.inf)
    if not len(query):
        return found[query], dist[query]
    of, cache, grids = np.arange(n), [], {}

    def tie() -> np.ndarray:
        if not cache:
            cache.append(rank())
        return cache[0]

    def thin(keys: tuple, most: int) -> None:
        nonlocal of
        o = np.lexsort(tuple(v[of] for v in keys))
        new = np.flatnonzero(np.concatenate([[True], np.any([v[of][o][1:] != v[of][o][:-1] for v in keys], axis=0), [True]]))
        if np.diff(new).max() > most:
            of = of[first_of(tuple(v[of] for v in keys), tie()[of], most)]

    if same is not None:
        thin((g, same), k)
    thin((g, x, y), k + 1 if same is None else 2 * k)

    def grid(level: int) -> Grid:
        if level not in grids:
            grids[level] = Grid(g, x, y, radius / 2**level * (1 + 1e-9), of)
        return grids[level]

    def process(q: np.ndarray, level: int) -> np.ndarray:
        """Settles the queries that find k within the level's width (on the last level all) and returns the others."""
        if not len(q):
            return q
        w, b = radius / 2**level, grid(level)
        lo, hi = b.around(q)
        size = hi - lo
        total = size.sum(1)
        by = np.argsort(-total, kind="stable")
        left, i = [], 0
        while i < len(by):
            wide = max(int(total[by[i]]), k)
            part = by[i : i + max(1, BUDGET // wide)]
            i += len(part)
            s, a, rows = size[part], lo[part], q[part]
            col = np.arange(wide)[None, :]
            one, two = s[:, :1], s[:, :1] + s[:, 1:2]
            at = np.where(col < one, a[:, :1], np.where(col < two, a[:, 1:2] - one, a[:, 2:] - two)) + col
            out = col >= total[part][:, None]
            at[out] = 0
            dx, dy = b.x[at] - x[rows][:, None], b.y[at] - y[rows][:, None]
            d = dx * dx + dy * dy
            out |= d > w * w
            out |= (b.order[at] == rows[:, None]) if same is None else (same[b.order[at]] == same[rows][:, None])
            d = np.sqrt(d)
            d[out] = np.inf
            if level:
                done = (wide - out.sum(1)) >= k
                left.append(rows[~done])
                if not done.any():
                    continue
                d, at, rows = d[done], at[done], rows[done]
            pick = np.argpartition(d, k - 1, axis=1)[:, :k] if wide > k else np.broadcast_to(np.arange(wide), d.shape)
            top = np.take_along_axis(d, pick, 1)
            o = np.argsort(top, axis=1)
            pick, top = np.take_along_axis(pick, o, 1), np.take_along_axis(top, o, 1)
            f = b.order[np.take_along_axis(at, pick, 1)]
            f[np.isinf(top)] = -1
            last = top[:, -1:]
            equal = ((top[:, 1:] == top[:, :-1]) & np.isfinite(top[:, 1:])).any(1) | (np.isfinite(last[:, 0]) & ((d <= last).sum(1) > k))
            if equal.any():
                e = np.flatnonzero(equal)
                r, c = np.nonzero((d[e] <= last[e]) & np.isfinite(d[e]))
                who, far = b.order[at[e[r], c]], d[e[r], c]
                o = np.lexsort((tie()[who], far, r))
                r, who, far = r[o], who[o], far[o]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                keep = place < k
                f[e[r[keep]], place[keep]] = who[keep]
                top[e[r[keep]], place[keep]] = far[keep]
            found[rows], dist[rows] = f, top
        return np.concatenate(left) if left else q[:0]

    def run(q: np.ndarray, level: int) -> np.ndarray:
        """As process(), but queries with too many candidates look within half the width first."""
        if len(q) and level < DEEPEST:
            lo, hi = grid(level).around(q)
            many = (hi - lo).sum(1) > 40 * k
            q = np.concatenate([q[~many], run(q[many], level + 1)])
        return process(q, level)

    # a group starts where its mean density gives about five candidates for each wanted
    codes, at, count = np.unique(g, return_inverse=True, return_counts=True)
    ends = []
    for v in (x, y):
        low, high = np.full(len(codes), np.inf), np.full(len(codes), -np.inf)
        np.minimum.at(low, at, v)
        np.maximum.at(high, at, v)
        ends.append(high - low)
    cell = np.maximum(ends[0], radius) * np.maximum(ends[1], radius) / count
    start = np.clip(np.floor(np.log2(radius / np.sqrt(5 * k * cell / 9))), 0, DEEPEST).astype(int)[at]
    left = query[:0]
    for level in range(int(start.max()), -1, -1):
        left = np.concatenate([run(query[start[query] == level], level), process(left, level)])
    return found[query], dist[query]


def _queries(table, key: str, code, own):
    """What stands for each key: rows that share it count as one that is there so many times. (column of keys, all rows with a
    place, the row of each key, how many have it, codes of keys or None)"""
    ids = table[key].combine_chunks()
    d = ids.dictionary_encode()
    same = d.indices.to_numpy(zero_copy_only=False) if not ids.null_count else d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False)
    if len(d.dictionary) == len(ids):
        return ids, np.flatnonzero(own), np.ones(int(own.sum()), np.int64), None
    mine = np.flatnonzero(own)
    _, first, times = np.unique(same[mine], return_index=True, return_counts=True)
    return ids, mine[first], times, same.astype(np.int64)


def _lists(table, code, x, y, own, key: str, radius: float, k: int, tie: str):
    """(keys, rows, rows' place in the table or -1, distances, codes of keys): the nearest of each key, repeated as often as the key is there."""
    ids, rows, times, same = _queries(table, key, code, own)
    good = np.flatnonzero(code >= 0)
    pos = np.full(len(code), -1, np.int64)
    pos[good] = np.arange(len(good))
    found, dist = np.full((len(rows), k), -1, np.int64), np.full((len(rows), k), np.inf)
    has = pos[rows] >= 0
    if has.any():
        f, d = nearest(code[good], x[good], y[good], radius, k, pos[rows[has]], None if same is None else same[good], lambda: ranks(table[tie].combine_chunks().take(good)))
        found[has], dist[has] = np.where(f >= 0, good[f], -1), d
    if (times > 1).any():
        turn = np.arange(k)[None, :] // times[:, None]
        found, dist = np.take_along_axis(found, turn, 1), np.take_along_axis(dist, turn, 1)
    return ids, rows, found, dist, same


def nearest_within(df: DataFrame, key: str, groups: list[str], x: str, y: str, radius: float, k: int, tie: str | None = None, late: dict[str, Column] | None = None, most: int | None = None) -> DataFrame:
    """(key, near): the k nearest other rows of the group at most `radius` away, as an array of (other, dist) in order, of equal
    distance the smaller `tie` (by default the key) first. A key is text and belongs to one place; one that several rows share has
    each neighbour so many times. Rows without a group or place have none. late: columns made of others after the shuffle."""
    tie = tie or key

    def lists(table, code, px, py, own):
        import pyarrow as pa

        ids, rows, found, dist, _ = _lists(table, code, px, py, own, key, radius, k, tie)
        some = found >= 0
        ends = np.concatenate([[0], np.cumsum(some.sum(1))]).astype(np.int32)
        near = pa.StructArray.from_arrays([ids.take(pa.array(found[some])), pa.array(dist[some])], ["other", "dist"])
        return pa.table({key: ids.take(pa.array(rows)), "near": pa.ListArray.from_arrays(pa.array(ends), near)})

    return dealt(df, groups, x, y, radius, late or {}, lists, f"`{key}` string, near array<struct<other:string,dist:double>>", most)


def neighbour_statistics(df: DataFrame, key: str, groups: list[str], x: str, y: str, radius: float, k: int, value: str, late: dict[str, Column] | None = None, most: int | None = None) -> DataFrame:
    """(key, x, n, max_d, med, mad): each key's value (its largest), the number of its k nearest as in nearest_within(), of equal
    distance the smaller value first, the farthest one's distance, and the median of their values and of what these differ from it."""

    def median(v):
        v = np.sort(v, axis=1)
        n = (~np.isnan(v)).sum(1)
        mid = lambda i: np.take_along_axis(v, np.maximum(i, 0)[:, None], 1)[:, 0]
        return (mid((n - 1) // 2) + mid(n // 2)) / 2

    def stats(table, code, px, py, own):
        import pyarrow as pa

        ids, rows, found, dist, same = _lists(table, code, px, py, own, key, radius, k, value)
        v = numbers(table[value])
        mine = v[rows]
        if same is not None:
            top = np.full(same.max() + 1, -np.inf)
            np.maximum.at(top, same[~np.isnan(v)], v[~np.isnan(v)])
            mine = np.where(np.isinf(top[same[rows]]), np.nan, top[same[rows]])
        o = np.where(found >= 0, v[found], np.nan)
        med = median(o)
        n = (found >= 0).sum(1)
        far = np.where(found >= 0, dist, -1.0).max(1)
        number = lambda a: pa.array(a, pa.float64(), from_pandas=True)
        return pa.table({key: ids.take(pa.array(rows)), "x": number(mine), "n": pa.array(n.astype(np.int64)), "max_d": number(np.where(n > 0, far, np.nan)), "med": number(med), "mad": number(median(np.abs(o - med[:, None])))})

    return dealt(df, groups, x, y, radius, late or {}, stats, f"`{key}` string, x double, n bigint, max_d double, med double, mad double", most)


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each a root's number) after the roots of a and b have become one."""
    while True:
        one, two = label[a], label[b]
        if (one == two).all():
            return label
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while ((up := label[label]) != label).any():
            label = up


def linked(g, x, y, eps: float) -> np.ndarray:
    """The component of each point, where points of a group at most eps apart are linked. Those of one cell whose diagonal is
    eps are; two cells are compared only while they are not linked through others, by a few of their points first."""
    order = np.lexsort((y, x, g))
    new = np.ones(len(g), bool)
    new[1:] = np.any([v[order][1:] != v[order][:-1] for v in (g, x, y)], axis=0)
    place = np.empty(len(g), np.int64)
    place[order] = np.cumsum(new) - 1
    g, x, y = (v[order][new] for v in (g, x, y))
    side = eps / np.sqrt(2) * (1 - 1e-9)
    cx, cy = steps(x, side, 3), steps(y, side, 3)
    ny = int(cy.max()) + 6
    code = (g * (int(cx.max()) + 6) + cx + 3) * ny + cy + 3
    by = np.argsort(code, kind="stable")
    cells, start, size = np.unique(code[by], return_index=True, return_counts=True)
    px, py = x[by], y[by]
    label = np.arange(len(cells))

    def touch(a, b, most: int):
        """Which pairs of cells have points at most eps apart, among the first `most` of each."""
        na, nb = np.minimum(size[a], most), np.minimum(size[b], most)
        hit, n = np.zeros(len(a), bool), na * nb
        for i in np.flatnonzero(n > BUDGET):
            step = max(1, BUDGET // int(nb[i]))
            u = slice(start[b[i]], start[b[i]] + nb[i])
            for k in range(start[a[i]], start[a[i]] + na[i], step):
                t = slice(k, min(k + step, start[a[i]] + na[i]))
                if ((px[t, None] - px[None, u]) ** 2 + (py[t, None] - py[None, u]) ** 2 <= eps * eps).any():
                    hit[i] = True
                    break
        rest = np.flatnonzero(n <= BUDGET)
        part = np.cumsum(n[rest]) // BUDGET
        for i in np.split(rest, np.flatnonzero(np.diff(part)) + 1):
            if len(i):
                r = np.repeat(np.arange(len(i)), n[i])
                t = np.arange(len(r)) - np.repeat(np.cumsum(n[i]) - n[i], n[i])
                one, two = start[a[i]][r] + t // nb[i][r], start[b[i]][r] + t % nb[i][r]
                near = (px[one] - px[two]) ** 2 + (py[one] - py[two]) ** 2 <= eps * eps
                hit[i[np.unique(r[near])]] = True
        return hit

    half = sorted(((i, j) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0)), key=lambda o: o[0] ** 2 + o[1] ** 2)
    for i, j in half:
        at = np.minimum(np.searchsorted(cells, cells + i * ny + j), len(cells) - 1)
        a = np.flatnonzero(cells[at] == cells + i * ny + j)
        b = at[a]
        for most in (5, len(px)):
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            hit = touch(a, b, most)
            label = _merged(label, a[hit], b[hit])
    of = np.empty(len(x), np.int64)
    of[by] = np.repeat(label, size)
    return of[place]


def clusters(df: DataFrame, key: str, groups: list[str], x: str, y: str, eps: float, least: int, most: int | None = None) -> DataFrame:
    """(key, cluster, core, own) of density clusters as algorithms.density_clusters() has them, by tasks. In a group that is split
    into blocks, cluster is that of the block, and the cores around it are there too, with own false."""

    def call(table, code, px, py, own):
        import pyarrow as pa

        ids = table[key].combine_chunks()
        good = np.flatnonzero((code >= 0) & ids.is_valid().to_numpy(zero_copy_only=False))
        ids, g, ax, ay, mine = ids.take(pa.array(good)), code[good], px[good], py[good], own[good]
        empty = pa.table({key: ids.slice(0, 0), "cluster": ids.slice(0, 0), "core": pa.array([], pa.bool_()), "own": pa.array([], pa.bool_())})
        if not len(good):
            return empty
        same = ids.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, first, rep, times = np.unique(g * len(ids) + same, return_index=True, return_inverse=True, return_counts=True)
        rank = ranks(ids)
        k = max(1, least - 1)
        found, _ = nearest(g, ax, ay, eps, k, first, same if len(first) < len(ids) else None, lambda: rank)
        core = times * (times + (found >= 0).sum(1)) >= least
        if not core.any():
            return empty
        c = first[core]
        label = linked(g[c], ax[c], ay[c], eps)
        low = np.full(len(c), len(ids), np.int64)
        np.minimum.at(low, label, rank[c])
        name = np.full(len(first), -1, np.int64)
        name[core] = low[label]
        # a border point has fewer neighbours than `least`, so it knows them all
        other = rep[np.maximum(found, 0)]
        seen = (found >= 0) & core[other] & ~core[:, None]
        rival = np.where(seen, rank[first[other]], len(ids))
        border = seen.any(1)
        best = np.take_along_axis(other, rival.argmin(1)[:, None], 1)[:, 0]
        name[border] = name[best[border]]
        out = np.flatnonzero((core | border & mine[first]))
        row = np.empty(len(ids), np.int64)
        row[rank] = np.arange(len(ids))
        return pa.table({key: ids.take(pa.array(first[out])), "cluster": ids.take(pa.array(row[name[out]])), "core": pa.array(core[out]), "own": pa.array(mine[first[out]])})

    kind = df.schema[key].dataType.simpleString()
    return dealt(df.select(key, *groups, x, y), groups, x, y, 2 * eps, {}, call, f"`{key}` {kind}, cluster {kind}, core boolean, own boolean", most)
