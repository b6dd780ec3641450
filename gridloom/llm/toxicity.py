"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence scores z = bias + the weights of its words and word
beginnings (hashed); p = sigmoid(z). The document's score is the noisy-or 1 - prod(1 - p), and only
document labels are used to fit weights and bias. The fitted sentence scores locate what offends.

With S = sum softplus(z) the document's score is 1 - exp(-S), so the loss and its gradient need only
S and sigmoid(z). Features that occur no more often in toxic documents than in others get no weight.

Defined cases: a null or empty text has no sentences and scores 0; without labels of both kinds every
score is 0; copies of a text are fitted once, as toxic if one of them is labelled so; repeated rows are scored each;
other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, fold, small_batches, table, written

#: Labelled documents of each class that the model is fitted on at most, chosen by a hash of the id.
TRAIN_DOCS_PER_CLASS = 4000
#: And about so many characters in all, of which very long documents leave room for fewer.
TRAIN_CHARS = 64_000_000
FEATURE_BITS = 20
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"\w+")
#: Words remembered with their weight in each process.
CACHE_WORDS = 400_000


def features(word: str) -> list[int]:
    """Buckets of a word and of its beginnings of four to seven characters."""
    names = ["w" + word, *(f"{n}{word[:n]}" for n in (4, 5, 6, 7) if len(word) >= n)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << FEATURE_BITS) - 1) for x in names]


class ToxicityModel:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self._cache: dict[str, float] = {}

    def __getstate__(self):
        at = np.flatnonzero(self.weights)
        return at, self.weights[at], self.bias

    def __setstate__(self, state):
        at, w, self.bias = state
        self.weights = np.zeros(1 << FEATURE_BITS, np.float32)
        self.weights[at] = w
        self._cache = {}

    def word(self, w: str) -> float:
        if len(self._cache) > CACHE_WORDS:
            self._cache.clear()
        x = self._cache[w] = float(self.weights[features(w)].sum())
        return x

    def score(self, text: str | None) -> tuple[float, list[dict]]:
        """The document's score and the sentences with a score of at least one half."""
        total, found, cache, word = 0.0, [], self._cache, self.word
        if not text:
            return 0.0, found
        plain = np.log1p(np.exp(self.bias))
        for m in SENTENCE.finditer(text):
            z = 0.0
            # by sentence: lower-casing may change a text's length, and spans are those of the text as written
            for w in WORD.findall(m.group().lower()):
                x = cache.get(w)
                z += word(w) if x is None else x
            if z == 0.0:
                total += plain
                continue
            z += self.bias
            total += float(np.logaddexp(0.0, z))
            if z >= 0:
                found.append({"start": m.start(), "end": m.end(), "score": float(1 / (1 + np.exp(-z)))})
        return float(-np.expm1(-total)), found


def fit(texts: list[str], labels: list[int], *, steps: int = 400, rate: float = 0.1, l2: float = 2e-5) -> ToxicityModel:
    """Full-batch Adam on the noisy-or likelihood over bags of sentences."""
    y = np.array(labels, float)
    none = ToxicityModel(np.zeros(1 << FEATURE_BITS, np.float32), -50.0)
    if not len(y) or y.min() == y.max():
        return none
    of_word: dict[str, list[int]] = {}

    def buckets(w):
        if w not in of_word:
            of_word[w] = features(w)
        return of_word[w]

    kept: dict[str, int] = {}
    for t, label in zip(texts, labels, strict=True):
        kept[t] = max(label, kept.get(t, 0))
    texts, labels = list(kept), list(kept.values())
    y = np.array(labels, float)
    if y.min() == y.max():
        return none
    bags = [[WORD.findall(m.group().lower()) for m in SENTENCE.finditer(t)] for t in texts]
    df = [Counter(), Counter()]
    for bag, c in zip(bags, labels, strict=True):
        df[int(c)].update({f for s in bag for w in s for f in buckets(w)})
    n1, n0 = y.sum(), len(y) - y.sum()
    # log-likelihood ratio of presence in toxic and in other documents, against the number of features tried
    least = 2 * np.log(max(2, len(df[0] | df[1]))) + 6

    def ratio(k1: int, k0: int) -> float:
        p = (k1 + k0) / (n1 + n0)
        part = lambda k, n: (k * np.log(k / n / p) if k else 0) + ((n - k) * np.log((1 - k / n) / (1 - p)) if k < n else 0)
        return 2 * (part(k1, n1) + part(k0, n0)) if p < 1 else 0.0

    chosen = [f for f, k in df[1].items() if k * n0 > 1.5 * df[0][f] * n1 and ratio(k, df[0][f]) > least]
    if not chosen:
        return none
    place = {f: i for i, f in enumerate(sorted(chosen))}
    rows, cols, doc, idle = [], [], [], np.zeros(len(y))
    for d, bag in enumerate(bags):
        for s in bag:
            got = [place[f] for w in s for f in buckets(w) if f in place]
            if not got:
                idle[d] += 1
                continue
            rows += [len(doc)] * len(got)
            cols += got
            doc.append(d)
    rows, cols, doc = np.array(rows), np.array(cols), np.array(doc)
    weight = np.where(y == 1, np.sqrt(n0 / n1), 1.0)  # half way to balanced classes
    theta = np.zeros(len(place) + 1)
    theta[-1] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, b = theta[:-1], theta[-1]
        z = np.bincount(rows, w[cols], len(doc)) + b
        s = np.bincount(doc, np.logaddexp(0, z), len(y)) + idle * np.logaddexp(0, b)
        # d loss / d S: 1 for clean documents, -exp(-S) / (1 - exp(-S)) for toxic ones
        slope = np.where(y == 1, -1 / np.maximum(np.expm1(np.minimum(s, 500)), 1e-9), 1.0) * weight
        gz = slope[doc] / (1 + np.exp(-z))
        g = np.append(np.bincount(cols, gz[rows], len(place)), gz.sum() + (slope * idle).sum() / (1 + np.exp(-b))) / len(y)
        g[:-1] += l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(1 << FEATURE_BITS, np.float32)
    weights[np.array(sorted(chosen))] = theta[:-1]
    return ToxicityModel(weights, float(theta[-1]))


def train_on(docs: DataFrame, known: DataFrame, per_class: int = TRAIN_DOCS_PER_CLASS) -> ToxicityModel:
    """Fit from document labels held in another table (doc_id, toxic): the bounded sample is taken from the
    labels, so its ids can be broadcast (at most about 2 * per_class rows)."""
    sizes = {r["toxic"]: r["n"] for r in known.filter("toxic in (0, 1)").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    some = bounded(known, "doc_id", [(F.col("toxic") == c, n) for c, n in sizes.items()], per_class)
    picked = F.broadcast(some.groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    some = written(docs.select("doc_id", "text").filter("text is not null").join(picked, "doc_id"), "labelled")
    chars = some.agg(F.sum(F.length("text"))).first()[0] or 0
    some = bounded(some, "doc_id", [(F.lit(True), chars)], TRAIN_CHARS, seed=11)
    got = some.orderBy("doc_id", "text").select("text", "toxic").toArrow()
    return fit(got["text"].to_pylist(), got["toxic"].to_pylist())


def score(docs: DataFrame, model: ToxicityModel, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, score, and offending: the spans (code points) of sentences that score one half or more."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    src = docs.select(*[docs[c] for c in keep], docs[text].alias("__text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.score(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns - 1)], pa.array([x for x, _ in got], pa.float64()), pa.array([s for _, s in got], kind)], [*b.schema.names[:-1], "score", "offending"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{head}, score double, offending array<struct<start:bigint,end:bigint,score:double>>")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.filter((fold("doc_id", 5) != 0) & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    model = train_on(docs, known)
    out = score(docs, model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"))
