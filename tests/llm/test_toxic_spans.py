"""Offending sentences are located in texts whose length lower-casing changes."""

import numpy as np

from gridloom.llm import toxicity


def test_spans_in_texts_that_lower_to_another_length():
    weights = np.zeros(1 << toxicity.FEATURE_BITS, np.float32)
    weights[toxicity.features("vile")[0]] = 9.0
    text = "İstanbul is İ fine. You VILE one! Bye İ."
    score, found = toxicity.ToxicityModel(weights, -4.0).score(text)
    assert score > 0.5 and [text[x["start"] : x["end"]] for x in found] == [" You VILE one!"]
