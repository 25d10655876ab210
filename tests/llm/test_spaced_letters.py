"""Spaced-out letters count in runs of any length."""

import pytest

from lumenlog.llm import toxicity


@pytest.mark.parametrize("before", [0, 10, 150, 195, 400, 5000])
def test_spaced_letters(before):
    word = max((w for w in toxicity.STRONG if w.isalpha() and w.isascii()), key=len).decode()
    at = toxicity.NAMES.index("spaced")
    assert toxicity.statistics(" ".join("z" * before + word).encode())[at] == 1.0
    assert toxicity.statistics(" ".join("z" * (before + 9)).encode())[at] == 0.0
