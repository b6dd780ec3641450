"""Substring dedup by content-defined chunking with a gear rolling hash.

A text's UTF-8 bytes are cut where the gear hash of the last 16 bytes starts with zero bits, so an insertion moves
only the cuts near it. Chunks are counted by digest over all documents; a chunk's first occurrence (smallest
document id, then place) is kept and each later one is removed. A digest has 64 bits: a chance equality only
matters inside a run of truly repeated neighbours. Short chunks repeat by chance in any prose, so
a chunk counts as repeated only within a run of neighbouring repeated chunks of at least MIN_RUN bytes.

Only digests and places are shuffled for the count, summed on the map side first; texts are dealt out once by
document to be rewritten. A hot chunk's rows are split by the skew join, its count by the partial sums.

A row of the count is a digest with a place, packed into eight bytes: a tag of the text (24 bits), start and size.

Defined cases: null and empty texts have no chunks; rows of one id are told apart by the tag, count as repeated
and are not later than each other; a null id is never first where another id holds the chunk; an empty table gives an empty table; other
columns are ignored. Long texts are hashed in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, written

#: A cut falls where so many bits of the hash are zero: chunks of about 2**CUT_BITS bytes.
CUT_BITS = 5
MIN_CHUNK = 8
MAX_CHUNK = 256
#: Repeated bytes in a row that count as a repeated passage.
MIN_RUN = 90
BLOCK = 1 << 20
SEED = 0x9E3779B97F4A7C15


def _gear() -> np.ndarray:
    """One 32-bit random value a byte, from a rule."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), SEED & 0xFFFFFFFF) for b in range(256)], np.uint32)


GEAR = _gear()


def gear_hashes(data: bytes) -> np.ndarray:
    """The gear hash after each byte: the sum of the last 16 bytes' values, each shifted by its age. Built by
    doubling: sums over 1, 2, 4, 8 and 16 bytes."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8):
        nxt = h.copy()
        nxt[k:] += h[:-k] << np.uint32(k)
        h = nxt
    return h


def cuts(data: bytes) -> np.ndarray:
    """Ends of the chunks of a text; the last is its length."""
    found = []
    for at in range(0, len(data), BLOCK):
        lead = min(at, 15)
        h = gear_hashes(data[at - lead : at + BLOCK])[lead:]
        # high bits depend on all 16 bytes
        found.append(np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + at + 1)
    ends, last = [], 0
    for e in (np.concatenate(found).tolist() if found else []) + ([len(data)] if data else []):
        if e - last < MIN_CHUNK and e != len(data):
            continue
        while e - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if e > last:
            ends.append(e)
            last = e
    return np.array(ends, np.int64)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    tag = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    return docs.select(docs[key].alias("doc_id"), F.shiftright(tag, 40).alias("tag"), docs[text].alias("text"))


def chunks(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, place) of every chunk; place is tag << 40 | start << 9 | size."""
    small_batches(docs.sparkSession)
    src = _rows(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, place, digest = [], [], []
            for r, (tag, t) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                data = (t or "").encode("utf-8", "surrogatepass")
                ends = cuts(data)
                if not len(ends):
                    continue
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                row.append(np.full(len(ends), r))
                place.append((begins << 9) + (ends - begins) + (tag << 40))
                digest += [xxhash.xxh3_64_intdigest(data[a:z]) for a, z in zip(begins.tolist(), ends.tolist(), strict=True)]
            if digest:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(row))), pa.array(np.array(digest, np.uint64).view(np.int64)), pa.array(np.concatenate(place))], ["doc_id", "digest", "place"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, digest bigint, place bigint")


def repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tag, spans) of each document with repeated chunks: spans holds (place, digest, later), later being
    false in the document that holds the chunk first."""
    all_chunks = written(chunks(docs, key=key, text=text), "chunks")
    seen = all_chunks.groupBy("digest").agg(F.count("*").alias("times"), F.min("doc_id").alias("first")).filter("times > 1").select("digest", "first")
    # written, so that both sides of the join are dealt out anew and a hot digest can be split
    seen = written(seen, "seen")
    hit = all_chunks.join(seen, "digest").select("doc_id", F.shiftright("place", 40).alias("tag"), F.struct("place", "digest", (~F.col("doc_id").eqNullSafe(F.col("first"))).alias("later")).alias("span"))
    return hit.groupBy("doc_id", "tag").agg(F.collect_list("span").alias("spans"))


def judge(data: bytes, spans: list[tuple[int, int, bool]]) -> tuple[int, list[tuple[int, int]]]:
    """Bytes in repeated passages, and the maximal runs to remove. spans: (place, digest, later), in any order; a
    chunk that the document holds before is later too."""
    held: set[int] = set()
    found: list[tuple[int, int, bool]] = []
    for place, digest, later in sorted(set(spans)):
        start = (place >> 9) & 0x7FFFFFFF
        found.append((start, start + (place & 0x1FF), later or digest in held))
        held.add(digest)
    repeated, gone, at = 0, [], 0
    while at < len(found):
        end = at + 1
        while end < len(found) and found[end][0] == found[end - 1][1]:
            end += 1
        size = found[end - 1][1] - found[at][0]
        if size >= MIN_RUN or size == len(data):
            repeated += size
            for a, z, later in found[at:end]:
                if later and gone and gone[-1][1] == a:
                    gone[-1] = (gone[-1][0], z)
                elif later:
                    gone.append((a, z))
        at = end
    return repeated, gone


def dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, kept (the bytes left), n_bytes, n_repeated (bytes in repeated passages, first
    occurrences included), n_removed, n_spans (maximal removed runs)."""
    small_batches(docs.sparkSession)
    found = repeats(docs, key=key, text=text)
    rows = _rows(docs, key, text)
    both = rows.join(found, rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["tag"] == found["tag"]), "left").select(rows["doc_id"], "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = (t or "").encode("utf-8", "surrogatepass")
                repeated, gone = judge(data, [(x["place"], x["digest"], x["later"]) for x in spans or []])
                edges = [0, *[e for g in gone for e in g], len(data)]
                kept = b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                out.append((kept, len(data), repeated, len(data) - len(kept), len(gone)))
            kept, *counts = zip(*out, strict=True) if out else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), *[pa.array(c, pa.int64()) for c in counts]], ["doc_id", "kept", "n_bytes", "n_repeated", "n_removed", "n_spans"])

    return both.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, kept binary, n_bytes bigint, n_repeated bigint, n_removed bigint, n_spans bigint")


def op7_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_repeated", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
