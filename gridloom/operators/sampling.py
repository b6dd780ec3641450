"""Deterministic sampling and allocation: every choice is by a hash of the key, so any cluster draws the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import first_by, global_rank, hash_order


def hash_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows in the order of their hashes (each task keeps its own n, then they are merged)."""
    return df.orderBy(hash_order(key, seed=seed), key).limit(n)


def largest_remainder(counts: DataFrame, keys: list[str], total: int, n: str = "n", within: list[str] | None = None) -> DataFrame:
    """Quotas of strata in proportion to their size that add up to `total` (to all rows, if there are fewer), in each group
    of `within`. Shares are rounded down; a stratum gets one at least if the total allows for all. What is too much is
    taken one by one from where the quota is furthest above its share (not the last one of a stratum), what is left
    goes where it is furthest below. counts: one row a stratum."""
    within = within or []
    w = Window.partitionBy(*within)
    q = counts.withColumn("__N", F.sum(n).over(w)).withColumn("__T", F.least(F.lit(total), F.col("__N")))
    q = q.withColumn("__share", F.col(n) * F.col("__T") / F.col("__N")).withColumn("__k", F.count("*").over(w))
    q = q.withColumn("__base", F.greatest(F.floor("__share"), F.when(F.col("__T") >= F.col("__k"), 1).otherwise(0)).cast("bigint"))
    q = q.withColumn("__over", F.sum("__base").over(w) - F.col("__T"))
    # the j-th unit of a stratum goes at the excess that is left after those before
    units = q.filter("__over > 0 and __base > 1").withColumn("__j", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.col("__base") - 1, F.col("__over")))))
    first = F.row_number().over(w.orderBy((F.col("__base") - (F.col("__j") - 1) - F.col("__share")).desc(), *keys))
    gone = units.withColumn("__r", first).filter("__r <= __over").groupBy(*within, *[k for k in keys if k not in within]).agg(F.count("*").alias("__gone"))
    room = (F.col("__base") < F.col(n)).cast("int")
    below = F.row_number().over(w.orderBy(room.desc(), (F.col("__share") - F.col("__base")).desc(), *keys))
    more = ((room == 1) & (F.col("__below") <= -F.col("__over"))).cast("bigint")
    names = [*within, *[k for k in keys if k not in within]]
    out = q.withColumn("__below", below).join(F.broadcast(gone), names, "left")
    return out.select(*names, n, (F.col("__base") + more - F.coalesce("__gone", F.lit(0))).alias("quota"))


def stratified(df: DataFrame, strata: list[str], total: int, key: str, within: list[str] | None = None) -> DataFrame:
    """`total` rows (of each group of `within`), each stratum by its quota of largest_remainder(), rows by the hash of their key."""
    names = [*(within or []), *strata]
    quota = largest_remainder(df.groupBy(*names).agg(F.count("*").alias("n")), strata, total, within=within).drop("n")
    ranked = df.join(quota, names).withColumn("__r", F.row_number().over(Window.partitionBy(*names).orderBy(hash_order(key), key)))
    return ranked.filter("__r <= quota").drop("__r", "quota")


def split_by_rank(df: DataFrame, strata: list[str], key: str, val: Column, test: Column, least: int = 0, seed: int = 42) -> DataFrame:
    """The keys of each stratum in the order of their hashes: the first `val` rows are val, the next `test` rows test, the rest
    train. val and test are of __n, the rows of the stratum; a stratum of fewer than `least` rows is train."""
    w = Window.partitionBy(*strata)
    r = df.withColumn("__n", F.count("*").over(w)).withColumn("__r", F.row_number().over(w.orderBy(hash_order(key, seed=seed), key)))
    split = F.when(F.col("__n") < least, "train").when(F.col("__r") <= val, "val").when(F.col("__r") <= val + test, "test").otherwise("train")
    return r.withColumn("split", split).drop("__n", "__r")


def group_folds(df: DataFrame, group: str, stratum: str, folds: int, seed: int = 42) -> DataFrame:
    """(group, fold): whole groups dealt in turn to folds, in hash order within their most frequent stratum, so that folds are
    alike in strata and no group is in two."""
    c = df.groupBy(group, stratum).agg(F.count("*").alias("__c"))
    top = first_by(c, [group], F.col("__c").desc(), F.col(stratum))
    w = Window.partitionBy(stratum).orderBy(hash_order(group, seed=seed), group)
    return top.select(group, ((F.row_number().over(w) - 1) % folds).cast("bigint").alias("fold"))


def two_stage_split(df: DataFrame, key: str, val: float, test: float, seed: int = 42) -> DataFrame:
    """(key, split) of distinct keys: a share of all, rounded up, is test; of the rest, val / (1 - test), rounded up, is val. Keys are
    ranked by their hash in buckets of its first byte, so no task ranks all."""

    def cut(rows: DataFrame, share: float, at: int, name: str) -> DataFrame:
        h = hash_order(key, seed=at)
        ranked = global_rank(rows.withColumn("__h", h), F.substring("__h", 1, 2), F.col("__h"), F.col(key), name="__rank").drop("__h")
        n = rows.agg(F.ceil(F.round(F.count("*") * F.lit(share), 9)).alias("__n"))
        return ranked.crossJoin(F.broadcast(n)).withColumn("split", F.when(F.col("__rank") <= F.col("__n"), name)).drop("__rank", "__n")

    one = cut(df.select(key).distinct(), test, seed, "test")
    two = cut(one.filter("split is null").drop("split"), val / (1 - test), seed + 1, "val")
    return one.filter("split is not null").unionByName(two.fillna("train", ["split"]))


def group_split(df: DataFrame, group: list[str], shares: dict[str, float], seed: int = 42) -> DataFrame:
    """Whole groups dealt to splits by the hash of their key: no group is in two splits."""
    u = F.conv(F.substring(hash_order(*group, seed=seed), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    out, top = None, 0.0
    for name, share in shares.items():
        top += share
        out = F.when(u < top, name) if out is None else out.when(u < top, name)
    return df.withColumn("split", out.otherwise(list(shares)[-1]))


def bootstrap_draws(rows: DataFrame, index: str, n: int, draws: int, aggs: list[Column], seed: int = 42) -> DataFrame:
    """(draw, aggregates): in each draw n rows are taken with replacement, the same for all aggregates. Rows have an `index` of
    0 to n - 1; place p of a draw takes the row that the hash of (draw, p) names."""
    slot = rows.sparkSession.range(draws * n).select(F.expr(f"id div {n}").alias("draw"), (F.col("id") % n).alias("p"))
    pick = F.conv(F.substring(F.md5(F.concat_ws("-", "draw", "p", F.lit(str(seed)))), 1, 12), 16, 10).cast("bigint") % n
    return slot.select("draw", pick.alias(index)).join(rows, index).groupBy("draw").agg(*aggs)


__all__ = ["bootstrap_draws", "first_by", "group_folds", "group_split", "hash_sample", "largest_remainder", "split_by_rank", "stratified", "two_stage_split"]
