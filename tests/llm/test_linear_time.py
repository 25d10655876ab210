"""Toxicity features take linear time, whatever one text holds."""

import time

import pytest

from lumenlog.llm import toxicity

AT = {name: i for i, name in enumerate(toxicity.NAMES)}


@pytest.mark.parametrize("text", ["a" * 1_000_000 + "1b", "a1" * 500_000, "a.b-" * 250_000, "1" * 1_000_000 + "a", "a b " * 250_000, "idiot " * 150_000, "!" * 1_000_000, "you1diot" * 100_000])
def test_long_texts(text):
    began = time.perf_counter()
    toxicity.statistics(text.encode())
    assert time.perf_counter() - began < 1


def test_masked_words():
    masked = lambda text: toxicity.statistics(text.encode())[AT["masked"]]
    assert masked("you are an 1d10t") == 1 and masked("you id10t and you m*ron") == 1 and masked("what an idi0t!!! you are") == 1
    assert masked("idiot and moron, 2 of 10") == 0 and masked("version a1b2c3, well-known") == 0


def test_burst_counts_every_word():
    dense = " ".join(["idiot"] * 35)
    assert toxicity.statistics(dense.encode())[AT["burst"]] == 35
    assert toxicity.statistics(" ".join(["idiot", *["word"] * 39, "idiot"]).encode())[AT["burst"]] == 1
    assert toxicity.statistics(" ".join(["idiot", *["word"] * 38, "idiot"]).encode())[AT["burst"]] == 2
