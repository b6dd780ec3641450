"""Joins, aggregates, windows, sampling and reshaping as DataFrame -> DataFrame functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class CardinalityError(ValueError):
    """A join key is not as unique as declared."""


def _unique(df: DataFrame, keys: list[str], side: str) -> None:
    if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise CardinalityError(f"{side} keys {keys} are not unique")


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str = "many_to_one") -> DataFrame:
    """A join that fails if a side declared `one` repeats a key; the check is one aggregate of the keys alone."""
    a, b = validate.split("_to_")
    if a == "one":
        _unique(left, on, "left")
    if b == "one":
        _unique(right, on, "right")
    return left.join(right, on, how)


def left_join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join by keys in which null equals null, as groups do."""
    other = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    return left.join(other, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys], "left").drop(*[f"__r_{k}" for k in keys])


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, low: str, high: str) -> DataFrame:
    """Left join by keys, with date_align: no_product, inrange (low <= at <= high) or outrange."""
    out = left.join(right, keys, "left")
    return out.withColumn("date_align", F.when(F.col(low).isNull(), "no_product").when(F.col(at).between(F.col(low), F.col(high)), "inrange").otherwise("outrange"))


def binned_pairs(left: DataFrame, right: DataFrame, x: str, y: str, rx: str, ry: str, radius: float, keys: list[tuple[str, str]] = ()) -> DataFrame:
    """Pairs at most `radius` apart: an equi join on grid cells as wide as the radius (each left row asks its nine
    neighbouring cells), then the exact distance. Never a nested loop."""
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = left.withColumn("__o", F.explode(around)).withColumn("__cx", cell(x) + F.col("__o.i")).withColumn("__cy", cell(y) + F.col("__o.j")).drop("__o")
    b = right.withColumn("__rx", cell(rx)).withColumn("__ry", cell(ry))
    cond = [F.col("__cx") == F.col("__rx"), F.col("__cy") == F.col("__ry"), *[F.col(p) == F.col(q) for p, q in keys]]
    out = a.join(b, cond).withColumn("dist", F.hypot(F.col(x) - F.col(rx), F.col(y) - F.col(ry)))
    return out.filter(F.col("dist") <= radius).drop("__cx", "__cy", "__rx", "__ry")


def self_pairs(df: DataFrame, ids: list[str], carry: list[str], x: str, y: str, radius: float, keys: list[str]) -> DataFrame:
    """(row, other, dist): pairs of rows of a frame at most `radius` apart that agree in `keys`, in both directions; row and
    other are structs of ids and carried columns. Each row asks its own cell and four of the eight around it, so a
    pair meets once and is turned round after the exact test. Ids tell rows apart and are best numbers."""
    cell = lambda c: F.floor(F.col(c) / radius)
    half = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))])
    side = lambda name: df.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], F.struct(*dict.fromkeys([*ids, *carry])).alias(name), F.col(x).alias(f"{name}x"), F.col(y).alias(f"{name}y"), cell(x).alias(f"{name}i"), cell(y).alias(f"{name}j"))
    a = side("a").withColumn("o", F.explode(half)).withColumn("ai", F.col("ai") + F.col("o.i")).withColumn("aj", F.col("aj") + F.col("o.j"))
    b = side("b")
    own = (F.col("o.i") == 0) & (F.col("o.j") == 0)
    less = F.struct(*[F.col(f"a.{c}") for c in ids]) < F.struct(*[F.col(f"b.{c}") for c in ids])
    dist = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    met = a.join(b, [F.col("ai") == F.col("bi"), F.col("aj") == F.col("bj"), *[F.col(f"a_{k}") == F.col(f"b_{k}") for k in keys], (dist <= radius), (~own | less)])
    both = F.explode(F.array(F.struct(F.col("a").alias("row"), F.col("b").alias("other")), F.struct(F.col("b").alias("row"), F.col("a").alias("other"))))
    return met.select(dist.alias("dist"), both.alias("p")).select("p.row", "p.other", "dist")


def k_nearest(targets: DataFrame, points: DataFrame, tid: str, pid: str, at: tuple[str, str], where: tuple[str, str], k: int, width: float) -> DataFrame:
    """(tid, pid, dist, rank): the k nearest points of each target, of equal distance the smaller pid; fewer where there
    are not k. Targets look within `width` by an equi join on cells; those that find fewer than k look again twice as
    far, so only a sparse place widens, and no target meets all points unless there are under k within the extent.
    Rows without a place are left out. A pass reads the points once; there are log2(extent / width) passes at most."""
    from ..session import materialised

    targets = targets.select(F.col(tid).alias("__t"), F.col(at[0]).alias("__x"), F.col(at[1]).alias("__y")).dropna()
    points = points.select(F.col(pid).alias("__p"), F.col(where[0]).alias("__px"), F.col(where[1]).alias("__py")).dropna()
    ends = lambda df, x, y: df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    a, b = ends(targets, "__x", "__y"), ends(points, "__px", "__py")
    extent = 0.0 if a[0] is None or b[0] is None else max(max(a[1], b[1]) - min(a[0], b[0]), max(a[3], b[3]) - min(a[2], b[2])) * 1.5
    found, left = [], targets
    while True:
        near = first_by(binned_pairs(left, points, "__x", "__y", "__px", "__py", width), ["__t"], F.col("dist"), F.col("__p"), n=k, rank="rank").select("__t", "__p", "dist", "rank")
        if width >= extent:
            found.append(near)
            break
        near = materialised(near, "nearest")
        done = near.filter(F.col("rank") == k).select("__t")
        found.append(near.join(done, "__t", "left_semi"))
        left = materialised(left.join(done, "__t", "left_anti"), "unsettled")
        if left.isEmpty():
            break
        width *= 2
    return reduce(DataFrame.unionAll, found).select(F.col("__t").alias(tid), F.col("__p").alias(pid), "dist", "rank")


def array_median(values: Column) -> Column:
    """Median of an array of numbers, null if it is empty."""
    a = F.array_sort(values)
    mid = lambda k: F.get(a, F.floor((F.size(a) - 1 + k) / 2).cast("int"))
    return F.when(F.size(values) > 0, (mid(0) + mid(1)) / 2)


def boxes_containing(points: DataFrame, boxes: DataFrame, x: str, y: str, width: float, low: tuple[str, str], high: tuple[str, str]) -> DataFrame:
    """Points joined to the boxes that hold them (edges included): boxes are dealt to the grid cells they touch."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    cells = boxes.withColumn("__bx", span(low[0], high[0])).withColumn("__by", span(low[1], high[1]))
    p = points.withColumn("__px", F.floor(F.col(x) / width)).withColumn("__py", F.floor(F.col(y) / width))
    inside = F.col(x).between(F.col(low[0]), F.col(high[0])) & F.col(y).between(F.col(low[1]), F.col(high[1]))
    return p.join(cells, (F.col("__px") == F.col("__bx")) & (F.col("__py") == F.col("__by")) & inside).drop("__px", "__py", "__bx", "__by")


def first_by(df: DataFrame, keys: list[str], *order: Column, n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each group under a total order."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def asof_backward(left: DataFrame, right: DataFrame, at: str, key: str, step: int) -> DataFrame:
    """Left rows with the greatest right `key` that is not above `at` (null if none). Both sides are dealt by steps
    of the value and sorted within; what the steps before hold is carried over by one row a step and one a thousand
    steps, so no task sees more than a step of rows. Both columns are whole numbers."""
    marks = right.select(F.col(key).alias("__at"), F.col(key).alias("__key")).distinct()
    rows = left.withColumn("__at", F.col(at)).withColumn("__is", F.lit(True)).unionByName(marks, allowMissingColumns=True).withColumn("__step", F.floor(F.col("__at") / step))
    last = rows.groupBy("__step").agg(F.max("__key").alias("__m")).withColumn("__block", F.floor(F.col("__step") / 1000))
    earlier = lambda of, w: F.max(of).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # a thousand steps are one block, so the one window without a partition has a row for a million whole numbers
    blocks = last.groupBy("__block").agg(F.max("__m").alias("__m")).select("__block", earlier("__m", Window.orderBy("__block")).alias("__far"))
    carry = last.withColumn("__near", earlier("__m", Window.partitionBy("__block").orderBy("__step"))).join(blocks, "__block").select("__step", F.coalesce("__near", "__far").alias("__before"))
    w = Window.partitionBy("__step").orderBy("__at", F.col("__key").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("__seen", F.max("__key").over(w)).join(carry, "__step")
    return out.filter("__is").select(*left.columns, F.coalesce("__seen", "__before").alias(key))


def complete(df: DataFrame, spine: DataFrame, keys: list[str], fill: dict) -> DataFrame:
    """All rows of the spine, with defaults where df has none."""
    return spine.join(df, keys, "left").fillna(fill)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` replace those of `existing` with equal keys."""
    return existing.join(new, keys, "left_anti").unionByName(new)


def hash_order(*cols: str, seed: int = 42) -> Column:
    """A text whose order shuffles rows the same way on any cluster and in any engine."""
    return F.md5(F.concat_ws("-", *[F.col(c).cast("string") for c in cols], F.lit(str(seed))))


def mean_exact(x: Column, digits: int = 2) -> Column:
    """Mean by an exact decimal sum, so the order of summation does not show."""
    return F.sum(x.cast(f"decimal(18,{digits})")).cast("double") / F.count(x)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, ps: tuple[float, ...], name: str = "p") -> DataFrame:
    """(keys, name): the quantiles ps of a group's values, interpolated between the ranks at either side, as an array.
    No task holds a group: values are counted, the counts summed in 1,024 buckets an octave, and only buckets with a
    wanted rank are sorted. Nulls are left out (a group of nulls only has no row), NaN is above all, both zeros
    are one value; null keys are a group. Values that differ by less than a thousandth of themselves share a bucket, as one row a different value."""
    by = [*keys, "__all"]
    v = F.col("__v")
    size = F.floor(F.log2(F.abs(v)) * 1024) + 1_200_000
    bucket = F.when(F.isnan(v), F.lit(1 << 23)).when(v == 0, F.lit(0)).when(F.abs(v) == float("inf"), F.signum(v) * (1 << 22)).otherwise(F.signum(v) * size)
    rows = df.select(*keys, F.lit(0).alias("__all"), F.col(value).cast("double").alias("__v")).filter(v.isNotNull())
    counts = rows.groupBy(*by, "__v").agg(F.count("*").alias("__n")).withColumn("__b", bucket.cast("bigint")).filter("__b is not null")  # as the join infers, so both uses share one shuffle
    w = Window.partitionBy(*by)
    sizes = counts.groupBy(*by, "__b").agg(F.sum("__n").alias("__n"))
    sizes = sizes.withColumn("__upto", F.sum("__n").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("__total", F.sum("__n").over(w))
    ranks = [(F.floor if k == 0 else F.ceil)((F.col("__total") - 1) * p) for p in ps for k in (0, 1)]
    held = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), r.alias("r")) for i, r in enumerate(ranks)]), lambda x: (x["r"] < F.col("__upto")) & (x["r"] >= F.col("__upto") - F.col("__n")))
    wanted = sizes.select(*[F.col(k).alias(f"__k_{k}") for k in by], F.col("__b").alias("__wb"), (F.col("__upto") - F.col("__n")).alias("__before"), "__total", held.alias("__held")).filter(F.size("__held") > 0)
    met = counts.join(wanted, [F.col("__b") == F.col("__wb"), *[F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in by]])
    met = met.withColumn("__to", F.col("__before") + F.sum("__n").over(Window.partitionBy(*by, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    hits = met.select(*by, "__v", "__total", F.explode(F.filter("__held", lambda x: (x["r"] < F.col("__to")) & (x["r"] >= F.col("__to") - F.col("__n")))).alias("__h"))
    at = lambda i: F.max(F.when(F.col("__h.i") == i, v))
    got = hits.groupBy(*by).agg(F.max("__total").alias("__total"), *[at(i).alias(f"__q{i}") for i in range(2 * len(ps))])

    def between(k: int, p: float) -> Column:
        lo, hi, pos = F.col(f"__q{2 * k}"), F.col(f"__q{2 * k + 1}"), (F.col("__total") - 1) * p
        return F.when(lo == hi, lo).otherwise((F.ceil(pos) - pos) * lo + (pos - F.floor(pos)) * hi)

    return got.select(*keys, F.array(*[between(k, p) for k, p in enumerate(ps)]).alias(name))


def weighted_mean(x: Column, w: Column) -> Column:
    """Sum of x * w over sum of w where both are finite and w > 0; null if there is none."""
    from ..functions.scalars import finite

    ok = finite(x) & finite(w) & (w > 0)
    total = F.sum(F.when(ok, w))
    return F.when(total > 0, F.sum(F.when(ok, x * w)) / total)


def sorted_distinct(x: Column, sep: str = ";") -> Column:
    return F.array_join(F.array_sort(F.collect_set(x.cast("string"))), sep)


def regression_metrics(y: str, p: str, digits: int = 8) -> list[Column]:
    """n, rmse, mae, bias, r2 (about the group's mean), slope, intercept, pearson_r, normalized_rmse, residual_sd."""
    a, b = F.col(y), F.col(p)
    e = b - a
    mse = F.avg(e * e)
    r = lambda c, n: F.round(c, digits).alias(n)
    sst = F.var_pop(a)
    return [
        F.count("*").alias("n"), r(F.sqrt(mse), "rmse"), r(F.avg(F.abs(e)), "mae"), r(F.avg(e), "bias"),
        r(F.when(sst > 0, 1.0 - mse / sst), "r2"), r(F.regr_slope(b, a), "slope"), r(F.regr_intercept(b, a), "intercept"),
        r(F.when((sst > 0) & (F.var_pop(b) > 0), F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b))), "pearson_r"), r(F.when(F.stddev_samp(a) > 0, F.sqrt(mse) / F.stddev_samp(a)), "normalized_rmse"), r(F.stddev_samp(e), "residual_sd"),
    ]


def metrics_by(df: DataFrame, groups: dict[str, str], y: str, p: str) -> DataFrame:
    """The metrics by each grouping column in turn, stacked long: one scan, rows exploded by group label."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("group_variable"), F.col(c).cast("string").alias("group_value")) for k, c in groups.items()]))
    return df.select(y, p, each.alias("g")).groupBy("g.group_variable", "g.group_value").agg(*regression_metrics(y, p))


def null_counts(df: DataFrame) -> DataFrame:
    cols = [F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in df.columns]
    return df.agg(*cols).unpivot([], df.columns, "column_name", "n_null")


def funnel(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """Rows left after each filter stage, in one pass."""
    seen, cols = F.lit(True), []
    for name, cond in stages.items():
        seen = seen & F.coalesce(cond, F.lit(False))
        cols.append(F.sum(seen.cast("bigint")).alias(name))
    return df.agg(*cols).unpivot([], list(stages), "stage", "n_rows")


def candidate_sets(df: DataFrame, sets: dict[str, Column], aggs: list[Column]) -> DataFrame:
    """The same aggregates over several filters, in one pass."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in sets.items()]))
    return df.withColumn("filter_set", F.explode(names)).groupBy("filter_set").agg(*aggs)


def stack(df: DataFrame, keys: list[str], cols: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(keys, cols, name, value)


def row_mean(cols: list[str]) -> Column:
    """Mean of the observed ones among some columns; null if none is."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in cols])
    n = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in cols])
    return F.when(n > 0, total / n)


def global_rank(df: DataFrame, bucket: Column, *order: Column, name: str = "rank") -> DataFrame:
    """1..n under a total order without one window over all rows: `bucket` must rise with the order (a month, a
    rounded value); rows are ranked within their bucket and the sizes of the buckets before are added. The sizes
    are one row a bucket, so their running sum and its broadcast are small."""
    spread = df.withColumn("__b", bucket)
    local = spread.withColumn("__local", F.row_number().over(Window.partitionBy("__b").orderBy(*order)))
    sizes = spread.groupBy("__b").agg(F.count("*").alias("__size"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("__b").alias("__bb"), "__before")
    return local.join(before, F.col("__b").eqNullSafe(F.col("__bb"))).withColumn(name, (F.col("__local") + F.col("__before")).cast("bigint")).drop("__b", "__bb", "__local", "__before")


def quantile_bins_by_rank(df: DataFrame, bucket: Column, *order: Column, bins: int = 5, name: str = "bin") -> DataFrame:
    """Quantile bins of the rank (first come on ties): cut at the interpolated ranks 1 + (n - 1) k / bins."""
    ranked = global_rank(df, bucket, *order, name="__rank")
    n = df.agg(F.count("*").alias("__n"))
    edges = reduce(lambda a, b: a + b, [(F.col("__rank") > 1 + (F.col("__n") - 1) * F.lit(k) / bins).cast("int") for k in range(1, bins)])
    return ranked.crossJoin(F.broadcast(n)).withColumn(name, edges.cast("bigint")).drop("__rank", "__n")
