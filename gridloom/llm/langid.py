"""Language identification: multinomial naive Bayes over hashed character n-grams.

N-grams of one to three characters of the lower-cased text are hashed into a fixed number of
buckets. Training counts are summed in the cluster; only the matrix of log probabilities
(languages x buckets) reaches the driver and is broadcast. The texts of a batch are hashed together, in blocks of a
bounded number of characters; their bucket counts are the rows of a sparse matrix, multiplied by that matrix.

Defined cases: a null, empty or letterless text is `und` with score 0; equal posteriors go to the
language that sorts first; an empty training set makes every text `und`; repeated rows are scored
each; other columns are ignored. Long texts are counted in blocks, so memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, fold, small_batches, table

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
#: Documents of one language that the model is trained on, chosen by a hash of the id.
TRAIN_DOCS_PER_LANG = 3000
#: More languages than this are refused: the matrix is broadcast.
MAX_LANGS = 256
BLOCK_CHARS = 1 << 18
LETTER = regex.compile(r"\p{L}")
_MIX = np.uint32(2654435761)


def _blocks(texts: list[str]) -> Iterator[list[tuple[int, str, int]]]:
    """Lists of (row, piece, starts): pieces of the lower-cased texts, each padded with one space, BLOCK_CHARS characters
    a list at most. N-grams begin at the first `starts` characters of a piece; two more may follow."""
    block, room = [], BLOCK_CHARS
    for row, text in enumerate(texts):
        low, at = f" {text.lower()} ", 0
        while at < len(low):
            n = min(room, len(low) - at)
            block.append((row, low[at : at + n + 2], n))
            at, room = at + n, room - n
            if not room:
                yield block
                block, room = [], BLOCK_CHARS
    if block:
        yield block


def sparse_counts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, bucket, count) of the hashed 1-, 2- and 3-grams of some texts, by row and bucket, a block at a time (a
    long text goes over several)."""
    for block in _blocks(texts):
        c = np.frombuffer("".join(p for _, p, _ in block).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(p) for _, p, _ in block])
        piece = np.repeat(np.arange(len(block)), size)
        place = np.arange(len(c)) - np.repeat(np.cumsum(size) - size, size)
        begins = place < np.array([n for _, _, n in block])[piece]
        row = np.array([r for r, _, _ in block])[piece]
        one = c * np.uint32(0x9E3779B1) + np.uint32(1)
        two = c[:-1] * np.uint32(0x85EBCA77) + c[1:] * np.uint32(0xC2B2AE3D) + np.uint32(2)
        three = c[:-2] * np.uint32(0x27D4EB2F) + c[1:-1] * np.uint32(0x165667B1) + c[2:] * np.uint32(0x9E3779B1) + np.uint32(3)
        # an n-gram does not run on into the next piece
        keep = [begins, begins[:-1] & (piece[:-1] == piece[1:]), begins[:-2] & (piece[:-2] == piece[2:])]
        h = np.concatenate([x[k] for x, k in zip((one, two, three), keep, strict=True)])
        h ^= h >> np.uint32(15)
        of = np.concatenate([row[: len(k)][k] for k in keep])
        cell, n = np.unique((of << BUCKET_BITS) | ((h * _MIX) >> np.uint32(32 - BUCKET_BITS)), return_counts=True)
        yield cell >> BUCKET_BITS, cell & (BUCKETS - 1), n


class LanguageModel:
    """Languages in sorted order, log priors, and the log probability of each bucket in each language."""

    def __init__(self, langs: list[str], prior: np.ndarray, logp: np.ndarray):
        self.langs, self.prior, self.logp = langs, prior, logp

    @classmethod
    def from_counts(cls, langs: list[str], docs: np.ndarray, counts: np.ndarray, alpha: float = 0.1) -> LanguageModel:
        p = counts + alpha
        logp = np.log(p / p.sum(0)).astype(np.float32)
        return cls(langs, np.log(docs / docs.sum()), logp)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language of each text and its posterior."""
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.langs else []
        out = [("und", 0.0)] * len(texts)
        z = np.tile(self.prior, (len(known), 1))
        for row, bucket, n in sparse_counts([texts[i] for i in known]):
            for k in range(len(self.langs)):
                z[:, k] += np.bincount(row, n * self.logp[bucket, k].astype(float), len(known))
        for i, x in zip(known, z, strict=True):
            best = int(x.argmax())
            out[i] = (self.langs[best], float(1.0 / np.exp(x - x[best]).sum()))
        return out


def train(labelled: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = TRAIN_DOCS_PER_LANG) -> LanguageModel:
    """Fit on rows with a non-null text and language, about `per_lang` documents of each at most."""
    rows = labelled.select(labelled[key].alias("k"), labelled[text].alias("text"), labelled[lang].alias("lang")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    place = {x: i for i, x in enumerate(langs)}
    sample = bounded(rows, "k", [(F.col("lang") == x, sizes[x]) for x in langs], per_lang).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(langs), BUCKETS), np.int64)
        for b in batches:
            label = np.array([place[x] for x in b.column(1).to_pylist()], int)
            for row, bucket, n in sparse_counts(b.column(0).to_pylist()):
                np.add.at(sums, (label[row], bucket), n)
        for x, n in zip(langs, sums, strict=True):
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])

    got = sample.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((BUCKETS, len(langs)))
    counts[got["bucket"].to_numpy(), [place[x] for x in got["lang"].to_pylist()]] = got["n"].to_numpy()
    return LanguageModel.from_counts(langs, np.array([sizes[x] for x in langs], float), counts)


def predict(docs: DataFrame, model: LanguageModel, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, lang_pred and score (the posterior of the language predicted)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    src = docs.select(*[docs[c] for c in keep], docs[text].alias("__text"))

    def run(batches):
        m = shared.value
        for b in batches:
            got = m.predict(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns - 1)], pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], [*b.schema.names[:-1], "lang_pred", "score"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{head}, lang_pred string, score double")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(fold("doc_id", 3) != 1))
    return predict(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
