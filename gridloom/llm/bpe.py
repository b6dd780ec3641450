"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts are split by the tokenizer's pattern and each match is merged by rank. Long texts are first
cut at safe boundaries, places where a match always ends whatever stands around them, so that the
ids of the parts, put together, equal the ids of the whole and memory stays bounded.

Defined cases: a null text counts as empty and gives no ids; repeated rows are encoded each;
an empty table gives an empty table; columns of other names are dropped unless listed in `keep`.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import small_batches

#: A rank file beyond this is refused: its bytes are broadcast.
MAX_RANK_BYTES = 64 << 20
#: Texts longer than this are cut at safe boundaries.
PART_CHARS = 1 << 16
#: After the first character of such a match every token ends: before white space, between a
#: letter and a digit, and between a letter or digit and punctuation.
SAFE = regex.compile(r"[^\s](?=[ \t\r\n])|[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])|[A-Za-z0-9À-ɏぁ-ゖァ-ヺ一-龥가-힣](?=[!-/:-@\[-`{-~])")

_encodings: dict[str, object] = {}


def read_ranks(path: str) -> bytes:
    """The rank file's bytes, read where the caller runs."""
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} has more than {MAX_RANK_BYTES} bytes")
    return data


def encoding(ranks: bytes, pattern: str):
    """A tiktoken encoding for these ranks, built once in each process."""
    import tiktoken

    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _encodings:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _encodings[key] = tiktoken.Encoding(key, pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encodings[key]


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Cut a text at safe boundaries into parts of about `size` characters. Where no safe boundary
    follows, the part runs to the end: the result is exact in any case."""
    at = 0
    while len(text) - at > size:
        m = SAFE.search(text, at + size)
        if m is None:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


def encode_text(enc, text: str | None, size: int = PART_CHARS) -> np.ndarray:
    """Ids of one text as little-endian unsigned 32-bit integers."""
    if not text:
        return np.empty(0, "<u4")
    found = [np.array(enc.encode_ordinary(p), "<u4") for p in parts(text, size)]
    return found[0] if len(found) == 1 else np.concatenate(found)


def encode(docs: DataFrame, rank_path: str, pattern: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True, digests: bool = False) -> DataFrame:
    """Columns `keep`, then `ids` and/or the digests of the ids and of the bytes decoded from them."""
    spark = docs.sparkSession
    small_batches(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(rank_path))
    src = docs.select(*[docs[c] for c in keep], docs[text].alias("__text"))
    fields = list(src.schema.fields[: len(keep)])
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else []
    fields += [T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] if digests else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value, pattern)
        for b in batches:
            got = [encode_text(enc, t) for t in b.column(b.num_columns - 1).to_pylist()]
            out = [b.column(i) for i in range(b.num_columns - 1)]
            names = b.schema.names[:-1]
            if ids:
                flat = np.concatenate(got) if got else np.empty(0, "<u4")
                offs = np.cumsum([0, *map(len, got)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(offs), pa.array(flat.astype(np.int32))))
                names = [*names, "ids"]
            out.append(pa.array([len(x) for x in got], pa.int64()))
            names = [*names, "n_tokens"]
            if digests:
                out.append(pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in got], pa.string()))
                out.append(pa.array([hashlib.sha256(enc.decode_bytes(x.tolist())).hexdigest() for x in got], pa.string()))
                names = [*names, "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(out, names)

    return src.mapInArrow(run, T.StructType(fields))


def decode(tokens: DataFrame, rank_path: str, pattern: str, *, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and `bytes`: the raw bytes of the ids (null ids: no bytes). An id without a rank raises."""
    spark = tokens.sparkSession
    small_batches(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(rank_path))
    src = tokens.select(*[tokens[c] for c in keep], tokens[ids].alias("__ids"))
    schema = T.StructType([*src.schema.fields[: len(keep)], T.StructField("bytes", T.BinaryType())])

    def run(batches):
        enc = encoding(ranks.value, pattern)
        for b in batches:
            raw = [enc.decode_bytes(x or []) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns - 1)], pa.array(raw, pa.binary())], [*b.schema.names[:-1], "bytes"])

    return src.mapInArrow(run, schema)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False, digests=True)
