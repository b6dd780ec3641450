"""Every stage of the pipeline on odd and empty tables, and the whole against brute force."""

import hashlib
import re

import numpy as np
import pytest
from test_brute_force import brute_matches
from test_near_stage import linked
from test_operators_llm import LONG, ODD, SECRETS, brute_base, brute_spans, frame, tokens

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from gridloom.llm import bpe, simhash  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "copy", "digest", "host", "blob", "fp", "spans"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_and_empty_tables(spark, sf, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    secret = [(50, "say " + SECRETS[1] + " and " + " ".join(f"word{chr(97 + k)}" for k in range(20)), "en", "a")]
    odd = frame(spark, ODD + secret)
    out = stage(spark, odd, sf)
    rows = out.collect()
    none = stage(spark, frame(spark, []), sf)
    assert none.count() == 0
    if name == "byte_bpe":
        assert len(rows) == len(ODD) + 1 and {"doc_id", "n_tokens", "ids"} <= set(out.columns)
        return
    assert out.columns == COLUMNS == none.columns
    ids = sorted((r.doc_id or -1) for r in rows)
    every = sorted((i or -1) for i, *_ in ODD + secret)
    if name == "quality_rules":  # nulls, blanks and one word fail; the rest stays, repeated rows too
        assert ids == [-1, 4, 5, 5, 6, 50]
    elif name == "near_dedup":
        assert ids == [-1, 1, 4, 5, 7, 8, 50]
    else:
        assert ids == every
    for r in rows:
        if name == "secret_scans" and r.doc_id == 50:
            assert "AKIA" not in r.text and "[access]" in r.text and r.n_chars == len(r.text)
        elif r.doc_id == 4:
            assert r.text == LONG


def brute_lines(docs):
    """Texts without the lines that too many different documents of a host hold, and who is kept."""
    plain = lambda x: re.sub("[\\x20\\x09-\\x0D]+", " ", re.sub("[0-9]+", "0", x.lower())).strip(" ")
    hosts, held = {}, {}
    for _, t, h in docs:
        hosts.setdefault(h, set()).add(t or "")
        for x in {plain(x) for x in (t or "").split("\n") if x.strip(" \t\n\v\f\r")}:
            held.setdefault((h, x), set()).add(t or "")
    bad = {k for k, v in held.items() if len(v) > min(20, max(3, 0.05 * len(hosts[k[0]])))}
    out = []
    for i, t, h in docs:
        n, *_, repeats = brute_base(t)
        lines = (t or "").split("\n")
        gone = sum(len(plain(x).split(" ")) for x in lines if x.strip(" \t\n\v\f\r") and (h, plain(x)) in bad)
        if n >= 10 and 100 * repeats <= 20 * n and n - gone >= 0.2 * n:
            out.append((i, "\n".join(x for x in lines if not (x.strip(" \t\n\v\f\r") and (h, plain(x)) in bad))))
    return out


def test_pipeline_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = brute_lines(docs)
    docs.sort()
    top = linked([set(simhash.shingles(t).tolist()) for _, t in docs])
    docs = [d for k, d in enumerate(docs) if top[k] == k]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {d for d, _ in brute_matches(docs, items)}
    docs = [d for d in docs if d[0] not in hit]
    path, pattern = tokens()
    enc = bpe.encoding(bpe.read_ranks(path), pattern)
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(out) == {i for i, _ in docs} and len(hit) > 0
    checked = 0
    for i, t in docs:
        if not re.search("BEGIN|eyJ|://[^ ]*@", t):  # the kinds that the method adds
            at, text = 0, ""
            for kind, s, e in brute_spans(t):
                if s >= at:
                    text += t[at:s] + f"[{kind}]"
                at = max(at, e)
            ids = np.array(enc.encode_ordinary(text + t[at:]), "<u4")
            assert out[i].n_tokens == len(ids) and out[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
            checked += 1
    assert checked > 0.9 * len(docs)
