"""SimHash near-duplicates with multi-index hashing.

A document's 64-bit fingerprint is the bitwise majority of the XXH64 hashes of its word shingles.
Two fingerprints that differ in at most three bits differ in at most one bit within one of the two
halves. Each distinct fingerprint is therefore stored in one table row for each half, asks for every
value in the radius-one Hamming ball of each half, and the whole distance of each match is verified.

Only distinct fingerprints are searched, so exact copies cost nothing. Fingerprints that are one bit
apart are joined first, by their 64 neighbours, a number of rows linear in the fingerprints; matches
found later within one such cluster need no row of their own, so dense groups do not give all pairs.
Components come from alternating large-star and small-star steps, each written to the shared folder.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; a null id is
never the smallest (a component of null ids only has a null id); repeated rows each keep a row; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.algorithms import components as components_of
from .common import passing, small, small_batches, table, written

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15
#: Near copies of a corpus stage: words of a shingle, and the least Jaccard similarity (4 / 5). op5 keeps its own.
NEAR_WORDS = 5
NEAR = (4, 5)
#: Shingles are ordered by how often their bucket occurs: so many bits of the hash name it. Any order gives the same pairs.
SKETCH_BITS = 20
SKETCH_PARTS = 64
#: Classes, and shingles of all of them, in one block of a group that is compared as a whole.
BLOCK_CLASSES = 512
BLOCK_SHINGLES = 1 << 20
#: Shingles in one step of that comparison.
STEP = 4096


def _hashes(text: str | None, words: int) -> list[int]:
    """XXH64 of the word shingles, repeats included; ASCII letters are lower-cased, ASCII white space separates
    words. Fewer words are one shingle; none have none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(w) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(w), SEED)] if w else []
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    whole = b" ".join(w)
    starts = [0, *ends[:-words].tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(whole[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]


def _majority(hashes: list[int]) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(np.array(hashes[at : at + BLOCK], ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of one text; zero if it has no words."""
    return _majority(_hashes(text, words))


def fingerprints(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and fp, the fingerprint as a signed 64-bit number."""
    small_batches(docs.sparkSession)
    src = docs.select(*[docs[c] for c in keep], docs[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(b.num_columns - 1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns - 1)], pa.array(fp)], [*b.schema.names[:-1], "fp"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{head}, fp bigint")


def _bit(k: int) -> int:
    return (1 << k) if k < 63 else -(1 << 63)


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, root) for every node; root is the smallest fp reachable. edges: (u, v), either direction."""
    found = components_of(edges.select(F.col("u").alias("a"), F.col("v").alias("b")))
    return nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"))


def link_components(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root) of distinct fingerprints: those linked, directly or through others, share a root."""
    if max_bits > 3:
        raise ValueError("two halves with balls of one bit find distances of 3 at most")
    near = F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(_bit(k))) for k in range(64)]))
    ask = fps.select("fp", near.alias("other")).filter("other < fp")
    one = ask.join(fps.select(F.col("fp").alias("other")), "other").select(F.col("fp").alias("u"), F.col("other").alias("v"))
    first = written(_components(fps, one), "clusters")

    half = lambda c, seg: F.shiftrightunsigned(c, 32) if seg else c.bitwiseAND(F.lit(0xFFFFFFFF))
    rows = lambda seg, keys, name: first.select(F.lit(seg).alias("seg"), keys.alias("key"), F.col("fp").alias(name), F.col("root").alias(f"{name}_root"))
    stored = rows(0, half(F.col("fp"), 0), "b").unionByName(rows(1, half(F.col("fp"), 1), "b"))
    ball = lambda seg: F.explode(F.array(half(F.col("fp"), seg), *[half(F.col("fp"), seg).bitwiseXOR(F.lit(1 << k)) for k in range(32)]))
    asked = rows(0, ball(0), "a").unionByName(rows(1, ball(1), "a"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    found = asked.join(stored, ["seg", "key"]).filter((F.col("a_root") > F.col("b_root")) & (apart <= max_bits))
    between = found.select(F.col("a_root").alias("u"), F.col("b_root").alias("v")).distinct()
    roots = first.select(F.col("root").alias("fp")).distinct()
    second = _components(roots, between).select(F.col("fp").alias("root"), F.col("root").alias("top"))
    return first.join(second, "root").select("fp", F.col("top").alias("root"))


def components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), max_bits: int = MAX_BITS) -> DataFrame:
    """(key, columns `keep`, fp, component_id): component_id is the smallest key reachable by links."""
    rows = written(fingerprints(docs, text=text, keep=(key, *keep)), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min(key).alias("least")), "classes")
    with passing():
        linked = written(link_components(classes.select("fp"), max_bits), "roots", outlive=True).join(classes, "fp")
    ids = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(ids, "fp").select(key, *keep, "fp", "component_id")


def shingles(text: str | None, words: int = NEAR_WORDS) -> np.ndarray:
    """Sorted distinct 62-bit hashes of the word shingles of one text; a text without words has one."""
    return np.unique(np.array(_hashes(text, words) or [0], np.uint64) >> np.uint64(2)).view(np.int64)


def _sketch(docs: DataFrame, text: str) -> np.ndarray:
    """How often shingles occur, by bucket of the hash, on a scale of logarithms in one byte. What a task sends and
    what is broadcast have a fixed size; more shingles make the order less sharp, not wrong."""
    buckets, width = 1 << SKETCH_BITS, max(1, (1 << SKETCH_BITS) // SKETCH_PARTS)

    def parts(total: np.ndarray, names) -> pa.RecordBatch:
        held = [k for k in names if total[k * width : (k + 1) * width].any()]
        return pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([zlib.compress(total[k * width : (k + 1) * width].tobytes(), 1) for k in held], pa.binary())], ["part", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            some = [shingles(t) for t in b.column(0).to_pylist()]
            if some:
                total += np.bincount(np.concatenate(some) >> (62 - SKETCH_BITS), minlength=buckets)
        yield parts(total, range(buckets // width))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[k * width : (k + 1) * width] += np.frombuffer(zlib.decompress(c), np.int64)
        yield parts(total, range(buckets // width))

    kind = "part int, counts binary"
    total = np.zeros(buckets, np.int64)
    for r in docs.select(text).mapInArrow(count, kind).repartition("part").mapInArrow(add, kind).collect():
        total[r.part * width : (r.part + 1) * width] += np.frombuffer(zlib.decompress(bytes(r.counts)), np.int64)
    return np.minimum(255, np.round(8 * np.log2(1 + total))).astype(np.uint8)


def _prefixes(docs: DataFrame, text: str) -> DataFrame:
    """(c, n, fp, s): class, number of shingles and fingerprint of each different text, and those shingles that a near
    copy must share one of: the first n - 0.8 n + 1, rare ones first."""
    small_batches(docs.sparkSession)
    often = docs.sparkSession.sparkContext.broadcast(_sketch(docs, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = often.value
        for b in batches:
            n, fp, some = [], [], []
            for t in b.column(1).to_pylist():
                whole = _hashes(t, NEAR_WORDS)
                fp.append(_majority(whole))
                h = np.unique(np.array(whole or [0], np.uint64) >> np.uint64(2)).view(np.int64)
                n.append(len(h))
                # the level goes before the hash, so that the order is that of the numbers
                h = np.sort((level[h >> (62 - SKETCH_BITS)].astype(np.int64) << 54) | (h >> 8))
                some.append(h[: len(h) + 1 - -(-len(h) * NEAR[0] // NEAR[1])])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(some, pa.list_(pa.int64()))], ["c", "n", "fp", "s"])

    return docs.select("__copy", text).mapInArrow(run, "c bigint, n bigint, fp bigint, s array<bigint>").dropDuplicates(["c"])


def _texts(docs: DataFrame, asked: DataFrame, text: str) -> DataFrame:
    """(c, t): the text of each class asked for, once. Texts are dealt out and not their shingles, which take two to three
    times the room; who needs shingles makes them."""
    asked = small(written(asked.select(F.col("c").alias("__copy")).distinct(), "asked"))
    return docs.select("__copy", text).join(asked, "__copy", "left_semi").dropDuplicates(["__copy"]).toDF("c", "t")


def _linked(pairs: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The pairs (u, v) of classes whose shingle sets have a Jaccard similarity of NEAR or more."""
    small_batches(docs.sparkSession)
    pairs = written(pairs, "pairs")
    # read twice, with a pair's other text each time
    texts = written(_texts(docs, pairs.select(F.col("u").alias("c")).unionByName(pairs.select(F.col("v").alias("c"))), text), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: dict[int, np.ndarray] = {}

            def of(c: int, t: str | None) -> np.ndarray:
                if c not in made:
                    made[c] = shingles(t)
                return made[c]

            u, v, t_u, t_v = (b.column(k).to_pylist() for k in range(4))
            near = []
            for k in range(len(u)):
                a, z = of(u[k], t_u[k]), of(v[k], t_v[k])
                near.append(len(np.intersect1d(a, z, assume_unique=True)) * sum(NEAR) >= (len(a) + len(z)) * NEAR[0])
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(near, pa.bool_())), b.column(1).filter(pa.array(near, pa.bool_()))], ["u", "v"])

    side = lambda k: texts.select(F.col("c").alias(k), F.col("t").alias(f"t_{k}"))
    both = side("u").join(small(pairs), "u").join(side("v"), "v")
    return both.select("u", "v", "t_u", "t_v").mapInArrow(run, "u bigint, v bigint")


def labels(sets: list[np.ndarray]) -> np.ndarray:
    """The smallest place reachable from each by near copies, all sets against all: overlaps are sums of products of
    0/1 matrices over the shingles that two of them hold."""
    k, n = len(sets), np.array([len(s) for s in sets])
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, twice = np.repeat(np.arange(k), n), times[col] > 1
    row, col = row[twice], (np.cumsum(times > 1) - 1)[col[twice]]
    by = np.argsort(col, kind="stable")
    row, col = row[by], col[by]
    both = np.zeros((k, k), np.float32)
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, STEP):
        a, z = np.searchsorted(col, [at, at + STEP])
        m = np.zeros((k, min(STEP, int(col[-1]) + 1 - at)), np.float32)
        m[row[a:z], col[a:z] - at] = 1
        both += m @ m.T
    near = both * sum(NEAR) >= (n[:, None] + n[None, :]) * NEAR[0]
    np.fill_diagonal(near, True)
    out = np.arange(k)
    while True:
        low = np.where(near, out[None, :], k).min(1)
        if (low == out).all():
            return out
        out = low


def _group_links(members: DataFrame, first: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Links (u, v) within groups, all members against all in blocks of a bounded size. members: (kind, g, c); first: (c, n)."""
    rows = members.join(first.select("c", "n"), "c")
    size = rows.groupBy("kind", "g").agg(F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    b, other = F.pmod(F.xxhash64("c"), F.col("blocks")), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    dealt = members.join(size, ["kind", "g"]).withColumn("b", b)
    # each block meets each other one; a group of one block is compared as it is
    dealt = dealt.withColumn("o", F.explode(F.when(F.col("blocks") == 1, other).otherwise(F.filter(other, lambda x: x != F.col("b")))))
    dealt = written(dealt.select("kind", "g", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "c"), "dealt")

    def compare(t: pa.Table) -> pa.Table:
        c = t["c"].to_numpy()
        top = labels([shingles(x) for x in t["t"].to_pylist()])
        far = top != np.arange(len(c))
        return pa.table({"u": c[far], "v": c[top[far]]})

    return _texts(docs, members, text).join(small(dealt), "c").groupBy("kind", "g", "i", "j").applyInArrow(compare, "u bigint, v bigint")


def near_classes(docs: DataFrame, text: str) -> DataFrame:
    """(c, root) of the different texts (by `__copy`): those linked by near copies, directly or through others, share
    a root. Linked is a Jaccard similarity of NEAR or more, always verified on all shingles.

    Multi-index hashing of the fingerprints gives groups of what is closest. Fingerprints of near copies may differ in
    many more bits than it can search, so the rest is found by shingles: two sets that are similar share one among the
    first of both in any one order. A list holds the classes with one such shingle. Each class gets a pivot, the head
    of its lists that heads most classes; a pivot and its classes are a group too. Groups are compared in blocks, and
    only pairs that do not share a pivot are taken from the lists."""
    first = written(_prefixes(docs, text), "prefixes")
    prints = first.groupBy("fp").agg(F.min("c").alias("c"))
    with passing():
        roots = written(link_components(prints.select("fp")), "hashed", outlive=True)
    hashed = first.select("c", "fp").join(roots, "fp").select("c", F.col("root").alias("g"))
    hashed = hashed.join(hashed.groupBy("g").agg(F.count("*").alias("k")).filter("k > 1"), "g").select(F.lit(0).alias("kind"), "g", "c")

    # place and number of shingles in one number: these rows are the many
    lists = first.select("c", "n", F.posexplode("s").alias("pos", "s")).select("s", "c", F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("n")).alias("at"))
    # over a window, so that they are dealt out once; a list has one row of ids for each class that has its shingle
    one = Window.partitionBy("s")
    many = lists.withColumn("k", F.count("*").over(one)).withColumn("h", F.min("c").over(one)).filter("k > 1")
    post = written(many.select("s", "c", F.shiftright("at", 32).alias("pos"), F.col("at").bitwiseAND((1 << 32) - 1).alias("n"), "h"), "lists")
    alike = lambda a, b: F.least(a, b) * NEAR[1] >= F.greatest(a, b) * NEAR[0]

    met = post.filter("c <> h").select("c", "n", "h").distinct().join(first.select(F.col("c").alias("h"), F.col("n").alias("h_n")), "h")
    met = written(met.filter(alike("n", "h_n")).select("c", "h"), "heads")
    # a class and the number of those it heads; then each class asks where the heads it meets have gone
    led = met.groupBy("h").agg(F.count("*").alias("d"))
    rank = lambda d, h: F.struct(F.col(d).alias("d"), F.bitwise_not(F.col(h)).alias("h"))  # noqa: E731  more first, then the smaller
    best = met.join(led, "h").groupBy("c").agg(F.max(rank("d", "h")).alias("to"))
    gone = led.select("h", rank("d", "h").alias("own")).join(best.withColumnRenamed("c", "h"), "h", "left").select("h", F.greatest("own", "to").alias("at"))
    moved = met.join(gone, "h").filter(F.bitwise_not(F.col("at.h")) != F.col("c"))
    pivots = written(moved.groupBy("c").agg(F.max("at").alias("at")).select("c", F.bitwise_not(F.col("at.h")).alias("g")), "pivots")
    centres = pivots.select("g").distinct()
    members = pivots.join(centres.select(F.col("g").alias("c")), "c", "left_anti").select("g", "c").unionByName(centres.select("g", F.col("g").alias("c")))
    members = written(members, "members")
    groups = written(hashed.unionByName(members.select(F.lit(1).alias("kind"), "g", "c")), "groups")
    with passing():
        within = written(_group_links(groups, first, docs, text), "links", outlive=True)
        roots = written(_components(first.select(F.col("c").alias("fp")), within), "clusters", outlive=True).select(F.col("fp").alias("c"), "root")

    # only lists that still hold several clusters
    held = written(post.select("s", "c", "n", "pos").join(roots, "c").join(members, "c", "left"), "held")
    mixed = held.groupBy("s").agg(F.min("root").alias("a"), F.max("root").alias("z")).filter("a < z").select("s")
    held = written(held.join(mixed, "s", "left_semi"), "held")
    side = lambda k: held.select("s", *[F.col(x).alias(f"{k}_{x}") for x in ("c", "n", "pos", "root", "g")])
    before = (F.col("u_n") < F.col("v_n")) | ((F.col("u_n") == F.col("v_n")) & (F.col("u_c") < F.col("v_c")))
    # the smaller set shares one among its first n - 8/9 n + 1, and both have room for what must still be shared
    early = F.col("u_pos") * sum(NEAR) <= F.col("u_n")
    room = F.least("u_pos", "v_pos") + F.least(F.col("u_n") - F.col("u_pos"), F.col("v_n") - F.col("v_pos"))
    enough = room * sum(NEAR) >= (F.col("u_n") + F.col("v_n")) * NEAR[0]
    apart = (F.col("u_root") != F.col("v_root")) & F.coalesce(F.col("u_g") != F.col("v_g"), F.lit(True))
    pairs = side("u").join(side("v"), "s").filter(before & early & apart & alike("u_n", "v_n") & enough).select(F.col("u_c").alias("u"), F.col("v_c").alias("v")).distinct()
    with passing():
        links = written(_linked(pairs, docs, text), "links", outlive=True)
    between = links.join(roots.select(F.col("c").alias("u"), F.col("root").alias("ru")), "u").join(roots.select(F.col("c").alias("v"), F.col("root").alias("rv")), "v")
    tops = _components(roots.select(F.col("root").alias("fp")).distinct(), between.select(F.col("ru").alias("u"), F.col("rv").alias("v")))
    return roots.join(tops.select(F.col("fp").alias("root"), F.col("root").alias("top")), "root").select("c", F.col("top").alias("root"))


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one row of each component of near copies (five-word shingles, Jaccard of 0.8 or more, verified):
    the one with the smallest key (a null key comes last; rows of one key go by a hash of their text; of rows
    repeated whole, one stays)."""
    named = docs.withColumn("__copy", F.xxhash64(F.coalesce(docs[text], F.lit(""))))
    order = F.struct(F.col(key).isNull().alias("z"), F.col(key).alias("k"), F.col("__copy").alias("c"))
    rows = named.groupBy("__copy").agg(F.min(order).alias("o"))
    with passing():
        found = written(near_classes(named, text), "near", outlive=True).withColumnRenamed("c", "__copy")
    row = F.xxhash64("k", F.col("k").isNull(), "c").alias("__row")
    first = written(rows.join(found, "__copy").groupBy("root").agg(F.min("o").alias("o")).select("o.k", "o.c").select(row), "first")
    mark = F.xxhash64(key, F.col(key).isNull(), "__copy")
    kept = named.withColumn("__row", mark).join(small(first), "__row", "left_semi")
    # rows repeated whole are few: only they are dealt out with their texts
    twice = small(written(kept.groupBy("__row").count().filter("count > 1").select("__row"), "twice"))
    out = kept.join(twice, "__row", "left_anti").unionByName(kept.join(twice, "__row", "left_semi").dropDuplicates(["__row"]))
    return out.drop("__copy", "__row")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
