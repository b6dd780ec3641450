"""A band text that several parts share, and that shares no window with any other band of its group, is removed."""

import random

from gridloom.llm import suffixes


def test_band_shared_by_two_parents_alone(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SPLIT", 2)
    used = []
    split = suffixes._split
    monkeypatch.setattr(suffixes, "_split", lambda parts, band: used.append(band) or split(parts, band))
    r = random.Random(8)
    some = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    texts = []
    for k in range(16):
        phrase = some(199)
        both = some(k) + phrase + some(16 - k)
        texts += [some(90) + phrase + some(90) for _ in range(6)] + [some(90) + both + some(90) for _ in range(2)]
    seen = {}
    for i, t in enumerate(texts):
        for a in range(len(t) - 199):
            seen.setdefault(t[a : a + 200], []).append((i, a))
    gone = {(i, b) for places in seen.values() if len(places) > 1 for i, a in places for b in range(a, a + 200)}
    assert gone
    got = {x.doc_id: bytes(x.kept).decode() for x in suffixes.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: "".join(c for b, c in enumerate(t) if (i, b) not in gone) for i, t in enumerate(texts)}
    assert used == [16, 2]
