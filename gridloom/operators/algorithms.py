"""Iterative and composed algorithms: components, density clusters, chunking, splits, reliability, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialised
from . import near
from .relational import array_median, hash_order


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable. edges: (a, b). Alternating large-star and small-star steps:
    each is one aggregate and one join, their number grows with the logarithm of a component's size, and every
    step is written to the shared folder, so a lost executor costs one step."""
    e = materialised(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    loops, e, before = nodes, e.filter("u <> v"), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        turned = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialised(turned.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    top = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
    return loops.join(top, "node", "left").select("node", F.coalesce("m", "node").alias("component"))


def leakage_components(df: DataFrame, date: str, product: str) -> DataFrame:
    """Rows that share a date or a product, directly or through others, are one component."""
    pairs = df.select(F.concat(F.lit("d:"), F.col(date).cast("string")).alias("a"), F.concat(F.lit("p:"), F.col(product).cast("string")).alias("b")).distinct()
    named = components(pairs)
    return df.join(named, F.concat(F.lit("d:"), F.col(date).cast("string")) == named["node"]).drop("node")


def density_clusters(points: DataFrame, key: str, groups: list[str], x: str, y: str, eps: float, least: int, most: int | None = None) -> DataFrame:
    """Density clusters within groups: (key, cluster, core). A core point has at least `least` points within eps,
    itself included; cores within eps share a cluster, named by its smallest core; a border point goes to its
    smallest core's cluster; noise is dropped. Groups of over `most` rows are clustered in blocks, whose clusters are joined
    through the cores that they share."""
    part = near.clusters(points, key, groups, x, y, eps, least, most)
    largest = points.groupBy(*groups).count().agg(F.max("count")).first()[0] or 0
    if largest <= (most or near.MOST):
        return part.select(key, "cluster", "core")
    part = materialised(part, "clusters")
    met = part.filter("core").groupBy(key).agg(F.min("cluster").alias("a"), F.collect_set("cluster").alias("b")).filter(F.size("b") > 1)
    named = components(met.select("a", F.explode("b").alias("b")).distinct())
    out = part.filter("own").join(named, part["cluster"] == named["node"], "left")
    return out.select(key, F.coalesce("component", "cluster").alias("cluster"), "core")


def principal_axis_score(df: DataFrame, groups: list[str], x: str, y: str, name: str = "score") -> DataFrame:
    """Place along the first principal axis of each group, by the closed form of a 2 x 2 covariance; the axis points
    to larger x (then y). Groups without spread fall back to x."""
    s = df.groupBy(*groups).agg(F.avg(x).alias("__mx"), F.avg(y).alias("__my"), F.var_pop(x).alias("__a"), F.covar_pop(x, y).alias("__b"), F.var_pop(y).alias("__c"))
    angle = F.lit(0.5) * F.atan2(2.0 * F.col("__b"), F.col("__a") - F.col("__c"))
    cx, cy = F.cos(angle), F.sin(angle)
    flip = F.when((F.round(cx, 9) < 0) | ((F.round(cx, 9) == 0) & (cy < 0)), -1.0).otherwise(1.0)
    along = flip * ((F.col(x) - F.col("__mx")) * cx + (F.col(y) - F.col("__my")) * cy)
    out = df.join(s, groups).withColumn(name, F.when(F.col("__a") + F.col("__c") > 0, along).otherwise(F.col(x)))
    return out.drop("__mx", "__my", "__a", "__b", "__c")


def chunk_count(n: Column, low: int, high: int) -> Column:
    """Number of chunks of n rows: as few as `high` allows, fewer while a chunk would have under `low`."""
    return F.greatest(F.lit(1), F.least(F.ceil(n / high), F.floor(n / low))).cast("bigint")


def balanced_chunks(df: DataFrame, groups: list[str], *order: Column, low: int, high: int, name: str = "chunk") -> DataFrame:
    """Chunk numbers (from 1) of each group's ordered rows; sizes differ by one at most, larger ones first."""
    w = Window.partitionBy(*groups)
    n, r = F.count("*").over(w), F.row_number().over(w.orderBy(*order)) - 1
    out = df.withColumn("__n", n).withColumn("__r", r).withColumn("__k", chunk_count(F.col("__n"), low, high))
    size, extra = F.expr("__n div __k"), F.expr("__n % __k")
    head = extra * (size + 1)
    chunk = F.when(F.col("__r") < head, F.floor(F.col("__r") / (size + 1))).otherwise(extra + F.floor((F.col("__r") - head) / size)) + 1
    return out.withColumn(name, chunk.cast("bigint")).drop("__n", "__r", "__k")


def _greedy(vectors, weights, fractions, seed: int):
    """One restart: components in the order of their size, with jitter, each to the split whose error stays least (the
    first on ties). Returns the objective and the split of each component."""
    import numpy as np

    r = np.random.default_rng(seed)
    target = fractions[:, None] * vectors.sum(0)[None, :]
    scale = np.maximum(target, 1.0)
    have = np.zeros_like(target)
    part = ((have - target) / scale) ** 2 @ weights
    out = np.zeros(len(vectors), np.int64)
    for c in np.argsort(-vectors[:, 0] * r.uniform(0.75, 1.25, len(vectors)), kind="stable"):
        # only the row that takes the component changes
        after = ((have + vectors[c] - target) / scale) ** 2 @ weights
        best = int(np.rint((after - part) * 1e12).argmin())
        out[c] = best
        have[best] += vectors[c]
        part[best] = after[best]
    return float(part.sum() + 1e6 * (have[:, 1:] <= 0).sum()), out


def balanced_component_split(rows: DataFrame, component: str, levels: list[str], fractions: dict[str, float], restarts: int = 200, seed: int = 42) -> DataFrame:
    """(component, split): whole components dealt so that sizes (weight 4) and the levels of some columns (weight 1 a column)
    come near to the fractions in every split, the best of some greedy restarts; a level that a split lacks costs a
    million. Counts are summed in the cluster, and restarts run side by side. A level needs one component a split."""
    import numpy as np

    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in levels]))
    kinds = sorted((r[0], r[1]) for r in rows.select(each.alias("x")).filter("x.level is not null").select("x.column", "x.level").distinct().collect())
    # a row a component and a whole number a level, in Arrow: 4 bytes a number on the driver and in each task
    counts = [F.count_if(F.col(c).cast("string") == level).cast("int").alias(f"__k{i}") for i, (c, level) in enumerate(kinds)]
    table = rows.groupBy(component).agg(F.count("*").cast("int").alias("__n"), *counts).orderBy(component).toArrow()
    names = table[component]
    place = {k: 1 + i for i, k in enumerate(kinds)}
    vectors = np.zeros((table.num_rows, 1 + len(kinds)), np.int32)
    for i in range(1 + len(kinds)):
        vectors[:, i] = table.column(i + 1).to_numpy()
    lacking = [k for k in kinds if (vectors[:, place[k]] > 0).sum() < len(fractions)]
    if lacking:
        raise ValueError(f"levels in fewer components than there are splits: {lacking}")
    share = np.array(list(fractions.values()), float)
    weights = np.array([4.0] + [1.0 / sum(c == k[0] for c, _ in kinds) for k in kinds])
    spark = rows.sparkSession
    data = spark.sparkContext.broadcast((vectors, weights, share))

    def run(batches):
        import pandas as pd

        for b in batches:
            got = [_greedy(*data.value, seed + int(k)) for k in b["id"]]
            yield pd.DataFrame({"seed": b["id"], "objective": [o for o, _ in got], "parts": [p.astype(np.int32).tobytes() for _, p in got]})

    # the best restart brings its splits along
    best = spark.range(restarts).repartition(min(restarts, 64)).mapInPandas(run, "seed bigint, objective double, parts binary").orderBy("objective", "seed").first()
    objective, parts = best["objective"], np.frombuffer(bytes(best["parts"]), np.int32)
    if objective >= 1e6:
        raise ValueError("no restart gives every split every level")
    import pyarrow as pa

    splits = pa.array(list(fractions)).take(pa.array(parts))
    kind = rows.schema[component].dataType.simpleString()
    return spark.createDataFrame(pa.table({component: names, "split": splits}), f"`{component}` {kind}, split string")


def impute_train_mean(df: DataFrame, train: Column, cols: list[str]) -> DataFrame:
    """Nulls become the means of the training rows."""
    m = df.filter(train).agg(*[F.avg(c).alias(f"__m_{c}") for c in cols])
    return df.crossJoin(F.broadcast(m)).withColumns({c: F.coalesce(F.col(c), F.col(f"__m_{c}")) for c in cols}).drop(*[f"__m_{c}" for c in cols])


def calibrate(df: DataFrame, fit_on: Column, y: str, p: str, name: str = "calibrated") -> DataFrame:
    """Least squares of observed on predicted over the validation rows, applied to all."""
    line = df.filter(fit_on).agg(F.regr_slope(y, p).alias("__s"), F.regr_intercept(y, p).alias("__i"))
    return df.crossJoin(F.broadcast(line)).withColumn(name, F.col("__i") + F.col("__s") * F.col(p)).drop("__s", "__i")


def reliability(rows: DataFrame, ids: list[str], pairs: DataFrame, value: str, nearest: int = 14, floor: float = 0.01, least: int = 5, limit: float = 4.0) -> DataFrame:
    """Local outlier score |x - median| / max(MAD, floor) over each row's nearest neighbours, and a flag: suspicious_low,
    suspicious_high or keep. A row with fewer neighbours than `least`, or none, is kept. pairs: (row, other, dist) of
    self_pairs(); of neighbours equally far the smaller value comes first. Neighbours meet in one array of the row."""
    own = rows.select(*ids, F.col(value).alias("x"), F.lit(None).cast(f"struct<dist:double,o:{rows.schema[value].dataType.simpleString()}>").alias("near"))
    met = pairs.select(*[F.col(f"row.{c}").alias(c) for c in ids], F.lit(None).cast(rows.schema[value].dataType).alias("x"), F.struct("dist", F.col(f"other.{value}").alias("o")).alias("near"))
    # keys as columns of their own: a struct has no sort prefix
    g = own.unionByName(met).groupBy(*ids).agg(F.max("x").alias("x"), F.slice(F.array_sort(F.collect_list("near")), 1, nearest).alias("near"))
    g = g.withColumn("o", F.transform("near", lambda p: p["o"])).withColumn("med", array_median(F.col("o")))
    g = g.withColumn("mad", array_median(F.transform("o", lambda v: F.abs(v - F.col("med")))))
    g = g.select(*ids, "x", F.size("near").cast("bigint").alias("n"), F.array_max(F.transform("near", lambda p: p["dist"])).alias("max_d"), "med", "mad")
    return reliability_flags(g, floor, least, limit).drop("x")


def reliability_flags(rows: DataFrame, floor: float = 0.01, least: int = 5, limit: float = 4.0) -> DataFrame:
    """Score and flag of rows with their value x and, of their neighbours, the number n, the median med and its deviation mad."""
    g = rows.withColumn("score", F.abs(F.col("x") - F.col("med")) / F.greatest(F.col("mad"), F.lit(floor)))
    flag = F.when((F.col("n") < least) | F.col("score").isNull(), "keep").when((F.col("score") >= limit) & (F.col("x") < F.col("med")), "suspicious_low").when((F.col("score") >= limit) & (F.col("x") > F.col("med")), "suspicious_high").otherwise("keep")
    return g.withColumn("flag", flag)


def permuted_column(df: DataFrame, key: str, groups: list[str], col: str, seed: int = 42) -> DataFrame:
    """`col` permuted within groups: each row takes the value of the next row in hash order (the last takes the first)."""
    w = Window.partitionBy(*groups).orderBy(hash_order(key, seed=seed), key)
    first = F.first(col).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn(f"{col}_permuted", F.coalesce(F.lead(col).over(w), first))


def early_stop(history: DataFrame, run: str, epoch: str, loss: str, patience: int) -> DataFrame:
    """Best epoch, its loss, and the first epoch that is `patience` after the best so far."""
    w = Window.partitionBy(run).orderBy(epoch)
    best = F.min(F.struct(F.col(loss), F.col(epoch))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    h = history.withColumn("__b", best).withColumn("__over", F.col(epoch) - F.col(f"__b.{epoch}") >= patience)
    stop = h.groupBy(run).agg(F.min(F.when(F.col("__over"), F.col(epoch))).alias("stop_epoch"))
    upto = h.join(stop, run).filter(F.col("stop_epoch").isNull() | (F.col(epoch) <= F.col("stop_epoch")))
    return upto.groupBy(run).agg(F.min(F.struct(F.col(loss).alias("l"), F.col(epoch).alias("e"))).alias("b"), F.first("stop_epoch").alias("stop_epoch")).select(run, F.col("b.e").alias("best_epoch"), F.col("b.l").alias("best_loss"), "stop_epoch")
