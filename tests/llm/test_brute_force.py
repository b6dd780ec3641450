"""Decontamination, substring dedup and toxicity scores against versions by the definition, and filters of quality rules."""

import random
import time
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from gridloom.llm import chunks, decontaminate, quality, toxicity

WORD = "[^\\x20\\x09-\\x0D]+"
EDGES = ".,;:!?\"'()[]"


def template(text):
    """Words as written, and their template in both forms."""
    space, gone = "[\\x20\\x09-\\x0D]", "[^\\x20\\x09-\\x0D]"
    units, edge, start = "|".join(decontaminate.UNITS), "[.,;:!?)\\]\"'%]*(?![^\\x20\\x09-\\x0D])", "(?<![^\\x20\\x09-\\x0D])[(\\[\"'$]*"
    number = "[+-]?[0-9][0-9.,:/]*"
    out = regex.sub(f"(?<=[^.!?:\\x20\\x09-\\x0D]{space}{{1,8}})\\p{{Lu}}{gone}*", "<name>", text)
    starts = [w[0].isupper() for w in regex.findall(WORD, out)]
    out = regex.sub(f"{start}{number}(?i:{units}){edge}", "<quantity>", out)
    out = regex.sub(f"{start}{number}{edge}", "<number>", out)
    out = regex.sub(f"(?<=<number>{space}{{1,8}})(?i:{units}){edge}", "<unit>", out)
    first = [w.lower().strip(EDGES) for w in regex.findall(WORD, out)]
    other = ["<number>" if w in decontaminate.NUMBER_WORDS else "<name>" if s else w for w, s in zip(first, starts, strict=True)]
    return [w.strip(EDGES) for w in regex.findall(WORD, text)], first, other


def brute_matches(docs, items):
    found = {}
    plain = lambda t: sum(not w.startswith("<") and w != "" for w in t)
    for i, item in items:
        was, *forms = template(item or "")
        counted = [p for p in range(len(was) - 4) if plain(forms[0][p : p + 5]) >= 3]
        for d, doc in docs:
            if not counted:
                line = " ".join(w for x in regex.findall(WORD, (item or "").lower()) if (w := x.strip(EDGES)))
                lines = {" ".join(w for x in regex.findall(WORD, n.lower()) if (w := x.strip(EDGES))) for n in (doc or "").split("\n")}
                if line and line in lines:
                    found[d, i] = (0, 0, True)
                continue
            here, *theirs = template(doc or "")
            by_shift = {}
            for p in counted:
                for a, mine in enumerate(forms):
                    if a and (forms[1][p : p + 5] == forms[0][p : p + 5] or plain(mine[p : p + 5]) < 2):
                        continue
                    for q in range(len(here) - 4):
                        for b, form in enumerate(theirs):
                            if b and theirs[1][q : q + 5] == theirs[0][q : q + 5]:
                                continue
                            if form[q : q + 5] == mine[p : p + 5]:
                                slots = {(was[p + k], here[q + k]) for k in range(5) if mine[p + k].startswith("<")}
                                by_shift.setdefault(q - p, []).append((p, a or b, slots))
            places, same = set(), True
            fits = lambda s: len({x for x, _ in s}) == len(s)
            for hits in by_shift.values():
                every = set().union(*(s for *_, s in hits))
                alone = [h for h in hits if not h[1]]
                if not fits(every):
                    every = set().union(*(s for *_, s in alone)) if alone else {(0, 0), (0, 1)}
                    hits = alone
                if hits and fits(every):
                    places |= {p for p, *_ in hits}
                    same &= all(x == y for x, y in every)
            if len(places) >= 0.8 * len(counted):
                found[d, i] = (len(counted), len(places), same)
    return found


def test_decontamination_equals_brute_force(spark, monkeypatch):
    r = random.Random(21)
    names, plain = ["Anna", "Ben", "Carlos", "Östen"], "buys sells apples train from the of and with two pears at noon twelve dozen late".split()

    def item():
        words = [r.choice([r.choice(names), str(r.randint(1, 30)), f"{r.randint(2, 9)}km", "7 kg", *[r.choice(plain)] * 7]) for _ in range(r.randint(2, 16))]
        words[0] = words[0].capitalize()
        return " ".join(w + r.choice(["", "", "", ". " + r.choice(names), ","]) for w in words)

    def changed(text):
        swap = {n: r.choice(names) for n in names} | {str(k): str(r.randint(1, 30)) for k in range(31)}
        return regex.sub(r"\w+", lambda m: swap.get(m.group(), m.group()) if r.random() < 0.97 else m.group(), text)

    items = [(k, item()) for k in range(14)] + [(20, None), (21, ""), (22, "Yes."), (23, "12 7 9 3 1 8")]
    docs = [(k, " ".join([item(), r.choice([str, changed])(r.choice(items[:14])[1]), item()])) for k in range(50)]
    docs += [(100, None), (101, ""), (102, "so\n YES \nno"), (103, "yes no"), (104, "12 7 9 3 1 8"), (105, items[0][1] + " " + items[0][1])]
    frame = lambda rows, k: spark.createDataFrame(rows, f"{k} long, text string")
    want = brute_matches(docs, items)
    assert len(want) > 25 and (102, 22) in want and (104, 23) in want
    for windows, hashes in ((decontaminate.BLOCK_WINDOWS, decontaminate.BLOCK_HASHES), (10, 25)):
        monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", windows)
        monkeypatch.setattr(decontaminate, "BLOCK_HASHES", hashes)
        got = decontaminate.matches(frame(docs, "doc_id"), frame(items, "item_id")).collect()
        assert {(x.doc_id, x.item_id): (x.n_windows, x.n_matched, x.verbatim) for x in got} == want and len(got) == len(want)


def test_decontamination_of_a_long_text(spark):
    item = "A train leaves with 40 passengers and Maria buys 3 apples before the station closes."
    text = "Word, and Other Words of 12 things follow one another. " * 20_000
    docs = spark.createDataFrame([(1, text + item.replace("40", "55")), (2, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(x.doc_id, x.verbatim) for x in decontaminate.matches(docs, bench).collect()] == [(1, False)]


def test_chunks_equal_brute_force(spark):
    r = random.Random(31)
    prose = ["".join(r.choice("abcdefgh ") for _ in range(r.choice([30, 200, 400]))) for _ in range(14)]
    docs = [(k, "".join(r.sample(prose, r.randint(1, 5))) if r.random() < 0.9 else None) for k in range(40)]
    docs += [(50, docs[0][1]), (51, ""), (3, "another text of the same id " + prose[1])]
    cut = {}
    for row, (_, t) in enumerate(docs):
        data = (t or "").encode()
        ends = chunks.cuts(data).tolist()
        cut[row] = [(a, z, data[a:z]) for a, z in zip([0, *ends], ends)]
    times, first = {}, {}
    for row, (d, _) in enumerate(docs):
        for *_, c in cut[row]:
            times[c] = times.get(c, 0) + 1
            first[c] = min(first.get(c, d), d)
    want = []
    for row, (d, t) in enumerate(docs):
        held, run, removed, repeated, kept = set(), [], 0, 0, []
        rows = [(a, z, c, times[c] > 1, first[c] != d) for a, z, c in cut[row]]
        marks = []
        for a, z, c, twice, later in rows:
            marks.append((a, z, twice, later or c in held))
            if twice:
                held.add(c)
        at = 0
        while at < len(marks):
            end = at
            while end < len(marks) and marks[end][2]:
                end += 1
            size = marks[end - 1][1] - marks[at][0] if end > at else 0
            if end > at and (size >= chunks.MIN_RUN or size == len((t or "").encode())):
                repeated += size
                removed += sum(z - a for a, z, _, later in marks[at:end] if later)
            at = end + 1 if end == at else end
        want.append((d, len((t or "").encode()), repeated, removed))
    got = chunks.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.n_bytes, x.n_repeated, x.n_removed) for x in got) == sorted(want)
    assert sum(w[3] for w in want) > 1000


def test_toxicity_scores_equal_the_definition():
    r = np.random.default_rng(2)
    w = np.zeros(1 << toxicity.FEATURE_BITS, np.float32)
    words = "idiot idiotic fool foolish nice day street loweich".split()
    for x in words:
        for f in toxicity.features(x):
            w[f] = r.normal()
    m = toxicity.ToxicityModel(w, -1.5)
    for _ in range(40):
        text = "".join(str(r.choice([*words, *(x.upper() for x in words)])) + str(r.choice([" ", ", ", ". ", "!\n", "? "])) for _ in range(r.integers(0, 30)))
        clean, spans = 1.0, []
        for s in regex.finditer(r"[^.!?\n]+[.!?]*", text):
            z = -1.5
            for x in regex.findall(r"\w+", s.group().lower()):
                for name in ["w" + x, *(f"{n}{x[:n]}" for n in (4, 5, 6, 7) if len(x) >= n)]:
                    z += float(w[zlib.crc32(name.encode()) % (1 << toxicity.FEATURE_BITS)])
            p = 1 / (1 + np.exp(-z))
            clean *= 1 - p
            if p >= 0.5:
                spans.append((s.start(), s.end()))
        score, found = m.score(text)
        assert score == pytest.approx(1 - clean, abs=1e-5) and [(f["start"], f["end"]) for f in found] == spans


def test_toxicity_held_out(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    known = labels.filter((toxicity.fold("doc_id", 5) != 0) & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    m = toxicity.train_on(docs, known)
    held = docs.join(labels.filter((toxicity.fold("doc_id", 5) == 0) & F.col("toxic").isNotNull()).select("doc_id", "toxic"), "doc_id")
    told = [(r.score >= 0.5) == (r.toxic == 1) for r in toxicity.score(held, m, keep=("doc_id", "toxic")).collect()]
    assert len(told) > 50 and sum(told) >= 0.9 * len(told)  # 65 of 70, with some 60 toxic documents to learn from


def test_copies_with_different_labels_are_toxic():
    texts = [f"you idiot {chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    m = toxicity.fit([x for t in texts for x in (t, t)] + [f"nice day {k}" for k in range(60)], [1, 0] * 60 + [0] * 60)
    assert m.score("you idiot")[0] > 0.5 and m.score("nice day")[0] < 0.5


@pytest.mark.parametrize("verdict", ["kept", "not kept", "base_failed", "n_repeat_words > 3 and n_words > 20"])
def test_quality_verdicts_can_be_filtered(spark, sf, verdict):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    began = time.time()
    some = quality.judge(docs).filter(verdict)
    got = some.collect()
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 4 and time.time() - began < 60
    every = quality.judge(docs).collect()
    test = {"kept": lambda x: x.kept, "not kept": lambda x: not x.kept, "base_failed": lambda x: x.base_failed}.get(verdict, lambda x: x.n_repeat_words > 3 and x.n_words > 20)
    assert sorted(x.doc_id for x in got) == sorted(x.doc_id for x in every if test(x))
