"""Near copies of the pipeline's stage against all pairs."""

import random

import numpy as np
import pytest

from gridloom.llm import simhash


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def edited(words, share, r):
    return [("x" + w if r.random() < share else w) for w in words]


def linked(sets):
    """The smallest place that each set's links lead to."""
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(sets))]


@pytest.mark.parametrize("step", [7, 4096])
def test_labels_equal_all_pairs(monkeypatch, step):
    monkeypatch.setattr(simhash, "STEP", step)
    r = random.Random(11)
    pool = list(range(90))
    for k in (1, 2, 30):
        sets = [set(r.sample(pool, r.randint(1, 60))) for _ in range(k)]
        for _ in range(k):
            sets.append(set(r.choice(sets)) ^ set(r.sample(pool, r.randint(0, 6))) or {0})
        assert simhash.labels([np.array(sorted(s), np.int64) for s in sets]).tolist() == linked(sets)


def test_group_of_many_edits(spark, monkeypatch):
    """One large group around one text, each copy edited in other places: in one block, and in many."""
    r = random.Random(5)
    base = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(150)]
    texts = [" ".join(base)]
    for k in range(90):
        w = list(base)
        for at in r.sample(range(150), r.randint(1, 6)):
            w[at] = "x" + w[at]
        texts.append(" ".join(w))
    top = linked([set(simhash.shingles(t).tolist()) for t in texts])
    want = {i for i in range(len(texts)) if top[i] == i}
    assert 1 < len(want) < len(texts)
    for block in (512, 10):
        monkeypatch.setattr(simhash, "BLOCK_CLASSES", block)
        assert {x.doc_id for x in simhash.keep_one(frame(spark, texts)).collect()} == want


@pytest.mark.parametrize("bits", [20, 6])
def test_stage_links_every_near_pair(spark, monkeypatch, bits):
    monkeypatch.setattr(simhash, "SKETCH_BITS", bits)
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    shared = [word() for _ in range(40)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(r.randint(30, 200))] + shared
        texts += [" ".join(base), *(" ".join(edited(base, r.choice([0.01, 0.02, 0.03]), r)) for _ in range(3))]
    texts += ["", None, " \n", "one two", "One  TWO", "one two three"]
    sets = [set(simhash.shingles(t).tolist()) for t in texts]
    top = linked(sets)
    far = [(simhash.fingerprint(texts[i], 5) ^ simhash.fingerprint(texts[j], 5)).bit_count() > simhash.MAX_BITS for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert sum(far) > 5  # three bits would not link these
    assert {x.doc_id for x in simhash.keep_one(frame(spark, texts)).collect()} == {i for i in range(len(texts)) if top[i] == i}


def test_stage_finds_its_links_on_the_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    top = linked([set(simhash.shingles(t).tolist()) for _, t in rows])
    assert {r.doc_id for r in simhash.keep_one(docs).select("doc_id").collect()} == {i for k, (i, _) in enumerate(rows) if top[k] == k}


def shuffled(spark):
    stages = spark._jvm.org.apache.spark.sql.SparkSession.active().sparkContext().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_groups_deal_out_texts_and_not_their_shingles(spark):
    """A word takes one byte or two here, a shingle eight."""
    r = random.Random(17)
    texts = []
    for _ in range(6):
        base = [r.choice("abcdefgh") + r.choice("xyz") for _ in range(4000)]
        for _ in range(12):
            w = list(base)
            for at in r.sample(range(4000), 20):
                w[at] = "q"
            texts.append(" ".join(w))
    before = shuffled(spark)
    assert simhash.keep_one(frame(spark, texts)).count() == 6
    assert shuffled(spark) - before < 7 * sum(map(len, texts)), (shuffled(spark) - before) / sum(map(len, texts))
