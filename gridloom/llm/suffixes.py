"""Exact repeated-substring dedup with suffix arrays built by two-stage sorting.

A byte is removed if a 200-byte string that covers it starts at some other place, in any document. To bring
equal strings together without a suffix array of the whole corpus, every 200-byte window names its anchor, the
leftmost smallest hash of the k-grams inside it: equal windows have equal anchors at equal offsets. Windows in a
row with one anchor form a segment (their text is one short string). Segments are counted by anchor first: an
anchor seen once repeats nothing; an anchor whose segments are all alike repeats wholly. Only where one anchor
has different segments is text gathered, one copy of each different segment, and a suffix array tells which
windows repeat: suffixes smaller than their successors are sorted directly, the others are induced by scanning
the buckets, and neighbours' common prefixes of 200 bytes or more mark the repeats.

Counts are summed on the map side, so a passage in a third of all documents is one row a task. An anchor with over
SPLIT different segments (a common phrase in many contexts) is split by content: its windows are banded by the
anchor's place in them, and the bytes that all windows of a band share are the key of a smaller group, since equal
windows lie in one band and share those bytes. Groups still too large are banded again by two, where at most one byte
on each side differs, so that no group has more than 65,536 different pieces. Blocks hold whole groups and about
BLOCK bytes.

Defined cases: a null text is empty; texts under 200 bytes lose nothing; rows of one id are told apart by text,
and a row repeated whole counts as another place; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, written

WIDTH = 200
GRAM = 32
BLOCK = 1 << 20
#: Different texts of one group from which it is split, and the windows in a band at each split.
SPLIT = 2048
BANDS = (16, 2)
#: Bytes of a text whose windows are anchored at once.
PART = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.array([xxhash.xxh64_intdigest(bytes([b]), 3) for b in range(256)], np.uint64)


def gram_hashes(data: bytes, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each k-gram, by doubling; gram is a power of two."""
    h, k, base = _BYTE[np.frombuffer(data, np.uint8)], 1, int(_MIX)
    while k < gram:
        h = h[:-k] * np.uint64(base) + h[k:]
        base = base * base % (1 << 64)
        k *= 2
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def segments(data: bytes, width: int = WIDTH, gram: int = GRAM) -> list[tuple[int, int, int]]:
    """(anchor hash, first window, last window) of each segment, in order."""
    out: list[tuple[int, int, int]] = []
    for at in range(0, max(0, len(data) - width + 1), PART):
        part = data[at : at + PART + width - 1]
        h = gram_hashes(part, gram)
        span = width - gram + 1
        best, place, k = h, np.arange(len(h), dtype=np.int32), 1
        while k < span:
            step = min(k, span - k)
            right = best[step:] < best[: len(best) - step]
            place = np.where(right, place[step:], place[: len(place) - step])
            best = np.where(right, best[step:], best[: len(best) - step])
            k += step
        edge = np.flatnonzero(np.diff(place)) + 1
        first = np.concatenate([[0], edge])
        last = np.concatenate([edge, [len(place)]]) - 1
        out += zip(best[first].view(np.int64).tolist(), (first + at).tolist(), (last + at).tolist(), strict=True)
    return out


def words_of(x: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, the first byte highest; zeros follow the end."""
    w = np.concatenate([x, np.zeros(8, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):
        w = (w[: len(w) - k] << np.uint64(8 * k)) | w[k:]
    return w[: len(x)]


def suffix_array(data: bytes, depth: int | None = None) -> np.ndarray:
    """Suffixes in order, by two-stage sorting; with `depth`, in order of their first `depth` bytes."""
    x = np.frombuffer(data, np.uint8)
    n = len(x)
    if n < 2:
        return np.arange(n)
    # small[i]: suffix i is smaller than suffix i + 1; equal bytes take the type of what follows
    rise = np.sign(x[1:].astype(np.int16) - x[:-1])
    nxt = np.where(rise != 0, np.arange(n - 1), n)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    small = np.zeros(n, bool)
    small[:-1] = (nxt < n) & (rise[np.minimum(nxt, n - 2)] > 0)

    direct = np.flatnonzero(small)
    by_byte = direct[np.argsort(x[direct], kind="stable")]
    cut = np.searchsorted(x[by_byte], np.arange(257))
    end = n if depth is None else depth
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    smaller: list[np.ndarray] = []
    for c in range(256):
        own = by_byte[cut[c] : cut[c + 1]].tolist()
        own.sort(key=lambda i: data[i : i + end])
        smaller.append(np.array(own, np.int64))

    def induce(places: np.ndarray, c: int) -> np.ndarray:
        """Put each larger-type predecessor at the end of its bucket's front; return those of this bucket."""
        before = places[places > 0] - 1
        before = before[~small[before]]
        ch = x[before]
        order = np.argsort(ch, kind="stable")
        before, ch = before[order], ch[order]
        edges = np.flatnonzero(np.diff(ch)) + 1
        same = before[:0]
        for piece in np.split(before, edges):
            if len(piece):
                larger[x[piece[0]]].append(piece)
                if x[piece[0]] == c:
                    same = piece
        return same

    larger[x[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        done = 0
        while done < len(larger[c]):
            todo = larger[c][done:]
            done = len(larger[c])
            induce(np.concatenate(todo), c)
        induce(smaller[c], c)
        out += larger[c]
        out.append(smaller[c])
    return np.concatenate(out)


def common_prefixes(words: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in order, `cap` (a multiple of eight) at most; the
    text counts as followed by zeros. The first suffix has 0."""
    n = len(words)
    lcp = np.zeros(len(sa), np.int64)
    live = np.arange(1, len(sa))
    for k in range(0, cap, 8):
        a, b = sa[live] + k, sa[live - 1] + k
        diff = np.where(a < n, words[np.minimum(a, n - 1)], 0) ^ np.where(b < n, words[np.minimum(b, n - 1)], 0)
        part = sum((diff < np.uint64(1 << (8 * j))).astype(np.int64) for j in range(8))
        lcp[live] += part
        live = live[part == 8]
    return lcp


def repeated_windows(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """For each text, whether each of its windows is found anywhere else in these texts."""
    data = b"".join(texts)
    sa = suffix_array(data, width)
    lcp = common_prefixes(words_of(np.frombuffer(data, np.uint8)), sa, width)
    ends = np.cumsum([len(t) for t in texts])
    whole = np.repeat(ends, [len(t) for t in texts])[sa] - sa >= width
    run = np.cumsum(lcp < width)
    many = np.bincount(run, whole)[run] >= 2
    flag = np.zeros(len(data), bool)
    flag[sa] = many & whole
    return [flag[e - len(t) : e - width + 1] for t, e in zip(texts, ends.tolist(), strict=True)]


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


PARTS = "grp bigint, piece bigint, off int, part binary"
RANGES = "array<struct<a:int,z:int>>"
_RANGES = pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(docs[key].alias("doc_id"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("copy"), docs[text].alias("text"))


def _bytes(t) -> bytes:
    return (t or "").encode("utf-8", "surrogatepass")


def anchored(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, copy, anchor, seg, a, z): segments of all texts; seg hashes the segment's text, a and z are its
    first and last window."""
    src = _rows(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, anchor, seg, first, last = [], [], [], [], []
            for r, t in enumerate(b.column(2).to_pylist()):
                data = _bytes(t)
                found = segments(data)
                row += [r] * len(found)
                for h, a, z in found:
                    anchor.append(h)
                    first.append(a)
                    last.append(z)
                    seg.append(xxhash.xxh3_64_intdigest(data[a : z + WIDTH]))
            if row:
                at = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(anchor, pa.int64()), pa.array(np.array(seg, np.uint64).view(np.int64)), pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["doc_id", "copy", "anchor", "seg", "a", "z"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, copy bigint, anchor bigint, seg bigint, a int, z int")


def _gathered(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(grp, piece, off, part): the text of each wanted segment (doc_id, copy, anchor, seg, a, z); a row repeated
    whole gives its segments again. off, the anchor's place in the first window, is not known yet: -1."""
    rows = _rows(docs, key, text)
    lists = wanted.groupBy("doc_id", "copy").agg(F.collect_set(F.struct("anchor", "seg", "a", "z")).alias("want"))
    both = rows.join(lists, rows["doc_id"].eqNullSafe(lists["doc_id"]) & (rows["copy"] == lists["copy"])).select("text", "want")

    def run(batches):
        for b in batches:
            anchor, seg, part = [], [], []
            for t, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = _bytes(t)
                for w in want:
                    anchor.append(w["anchor"])
                    seg.append(w["seg"])
                    part.append(data[w["a"] : w["z"] + WIDTH])
            off = pa.array(np.full(len(part), -1, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(seg, pa.int64()), off, pa.array(part, pa.binary())], ["grp", "piece", "off", "part"])

    return both.mapInArrow(run, PARTS)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def bands(part: bytes, off: int, band: int, width: int = WIDTH) -> list[tuple[int, int, int, bytes]]:
    """(shift, group, off, text) of each band of a part's windows: those whose anchor lies in the same `band` places.
    The group hashes the bytes that every window of the band has, wherever the part begins and ends."""
    out, at, last = [], 0, len(part) - width
    while at <= last:
        low = (off - at) // band * band
        end = min(last, off - low)
        # a window whose anchor is at `low` begins at off - low, one at low + band - 1 ends so much earlier
        core = part[off - low : off - low + width - band + 1]
        out.append((at, _signed(xxhash.xxh3_64_intdigest(core, seed=low * 256 + band)), off - at, part[at : end + width]))
        at = end + 1
    return out


def _split(parts: DataFrame, band: int) -> DataFrame:
    """(up_grp, up_piece, shift, grp, piece, off, part): the bands of each part; shift is the place of a band's
    first window in its part."""

    def run(batches):
        for b in batches:
            row, shift, grp, piece, off, part = [], [], [], [], [], []
            for r, (g, o, text) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if o < 0:
                    # the anchor is the first of its hash that the last window has
                    z = len(text) - WIDTH
                    o = z + int(np.argmax(gram_hashes(text[z:]).view(np.int64) == g))
                for s, k, at, t in bands(text, o, band):
                    row.append(r)
                    shift.append(s)
                    grp.append(k)
                    piece.append(_signed(xxhash.xxh3_64_intdigest(t)))
                    off.append(at)
                    part.append(t)
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(shift, pa.int32()), pa.array(grp, pa.int64()), pa.array(piece, pa.int64()), pa.array(off, pa.int32()), pa.array(part, pa.binary())],
                ["up_grp", "up_piece", "shift", "grp", "piece", "off", "part"],
            )

    return parts.select("grp", "piece", "off", "part").mapInArrow(run, f"up_grp bigint, up_piece bigint, shift int, {PARTS}")


def _compared(parts: DataFrame) -> DataFrame:
    """(grp, piece, found): runs of windows, counted from the part's start, that other parts of the group hold too."""

    def flush(rows):
        flags = repeated_windows([r[2] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([[{"a": a, "z": z} for a, z in _ranges(f)] for f in flags], _RANGES)], ["grp", "piece", "found"])

    def run(batches):
        rows, size = [], 0
        for b in batches:
            for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if rows and row[:2] == rows[-1][:2]:
                    continue
                if size >= BLOCK and row[0] != rows[-1][0]:
                    yield from flush(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[2])
        if rows:
            yield from flush(rows)

    return parts.select("grp", "piece", "part").repartition("grp").sortWithinPartitions("grp", "piece").mapInArrow(run, f"grp bigint, piece bigint, found {RANGES}")


def _shifted(by: str) -> Column:
    return F.transform("found", lambda x: F.struct((F.col(by) + x["a"]).alias("a"), (F.col(by) + x["z"]).alias("z")))


def _found(parts: DataFrame, pairs: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """(grp, piece, found) of parts (grp, piece, off, part), whose different (grp, piece) are pairs. Groups of over
    SPLIT pieces are split into bands of the first width, and theirs by the next."""
    if not widths:
        return _compared(parts)
    hot = written(pairs.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") > SPLIT).select("grp"), "hot")
    if hot.isEmpty():
        return _compared(parts)
    kids = written(_split(parts.join(hot, "grp", "left_semi"), widths[0]), "bands")
    texts = kids.groupBy("grp", "piece").agg(F.first("off").alias("off"), F.first("part").alias("part"))
    told = _found(texts, kids.select("grp", "piece").distinct(), widths[1:])
    # a text that several parts have repeats whole
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("z").alias("z"))).cast(RANGES)
    size = kids.groupBy("grp", "piece").agg(F.count("*").alias("n"), F.max(F.length("part") - WIDTH).alias("z"))
    told = size.join(told, ["grp", "piece"], "left").filter("n > 1 or size(found) > 0")
    told = written(told.select("grp", "piece", F.when(F.col("n") > 1, whole).otherwise(F.col("found")).alias("found")), "told")
    back = kids.select("up_grp", "up_piece", "shift", "grp", "piece").join(told, ["grp", "piece"]).select("up_grp", "up_piece", _shifted("shift").alias("found"))
    back = back.groupBy(F.col("up_grp").alias("grp"), F.col("up_piece").alias("piece")).agg(F.flatten(F.collect_list("found")).alias("found"))
    return _compared(parts.join(hot, "grp", "left_anti")).unionByName(back)


def repeated_ranges(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, copy, found): runs of windows of each document that start anywhere else too."""
    small_batches(docs.sparkSession)
    all_segs = written(anchored(docs, key=key, text=text), "segments")
    seen = all_segs.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("seg") == F.max("seg")).alias("alike")).filter("n > 1").select("anchor", "alike")
    # written, as are the results below, so that both sides of a join are dealt out anew and a hot key can be split
    seen = written(seen, "seen")
    # by document: the windows that repeat for certain, and the segments still to be compared
    hit = written(all_segs.join(seen, "anchor"), "hits")
    mixed = hit.filter("not alike")
    place = F.struct("doc_id", "copy", "a", "z")
    groups = written(mixed.groupBy("anchor", "seg").agg(F.count("*").alias("n"), F.min(place).alias("p")).select("anchor", "seg", "n", "p.*"), "groups")
    parts = written(_gathered(docs, groups, key, text), "parts")
    compared = _found(parts, groups.select(F.col("anchor").alias("grp"), F.col("seg").alias("piece")), BANDS).select(F.col("grp").alias("anchor"), F.col("piece").alias("seg"), "found")
    told = groups.select("anchor", "seg", "n").join(compared, ["anchor", "seg"], "left").filter("n > 1 or size(found) > 0")
    part = mixed.join(written(told, "compared"), ["anchor", "seg"]).select(
        "doc_id", "copy", F.when(F.col("n") > 1, F.array(F.struct("a", "z")).cast(RANGES)).otherwise(_shifted("a")).alias("found")
    )
    alike = hit.filter("alike").select("doc_id", "copy", F.array(F.struct("a", "z")).cast(RANGES).alias("found"))
    return alike.unionByName(part).groupBy("doc_id", "copy").agg(F.sort_array(F.flatten(F.collect_set("found"))).alias("found"))


def removed(ranges: list[tuple[int, int]], width: int = WIDTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes (end exclusive) that the windows of these sorted runs cover."""
    out: list[tuple[int, int]] = []
    for a, z in ranges:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z + width))
        else:
            out.append((a, z + width))
    return out


def dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """One row a document: doc_id, kept (the bytes left) or kept_sha256, n_bytes, n_removed, n_spans."""
    found = repeated_ranges(docs, key=key, text=text)
    rows = _rows(docs, key, text)
    both = rows.join(found, rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["copy"] == found["copy"]), "left").select(rows["doc_id"], "text", "found")
    name, kind = ("kept_sha256", "string") if digest else ("kept", "binary")

    def run(batches):
        for b in batches:
            kept, counts = [], []
            for t, ranges in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = _bytes(t)
                gone = removed([(x["a"], x["z"]) for x in ranges or []])
                edges = [0, *[e for g in gone for e in g], len(data)]
                left = b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                kept.append(hashlib.sha256(left).hexdigest() if digest else left)
                counts.append((len(data), len(data) - len(left), len(gone)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string() if digest else pa.binary()), *[pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]], ["doc_id", name, "n_bytes", "n_removed", "n_spans"])

    return both.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {name} {kind}, n_bytes bigint, n_removed bigint, n_spans bigint")


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), digest=True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
