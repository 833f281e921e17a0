import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from groundwork.llm import suffix_array as S


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.sampled_from([0, 2, 1000]))
def test_against_sorting(symbols, small):
    before, S.SMALL = S.SMALL, small
    try:
        assert S.suffix_array(np.array(symbols, np.int64)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])
    finally:
        S.SMALL = before


def test_text_both_ways():
    rng = random.Random(1)
    words = ["the", "cat", "sat", "on", "mat", "and", "a", "dog"]
    text = " ".join(rng.choice(words) for _ in range(4000)) + "a" * 300
    x = np.frombuffer(text.encode(), np.uint8)
    want = sorted(range(len(text)), key=lambda i: text[i:])
    assert S.suffix_array(x).tolist() == want


def test_equal_windows():
    x = np.frombuffer(b"abcabcabxabc", np.uint8)
    starts = np.array([0, 1, 3, 4, 9])
    got = S.equal_windows(x, 3, starts)
    w = [x[s : s + 3].tobytes() for s in starts]
    assert all((got[a] == got[b]) == (w[a] == w[b]) for a in range(5) for b in range(5))
