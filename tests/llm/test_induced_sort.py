"""Suffix arrays by induction against sorting all suffixes."""

import numpy as np
from hypothesis import given, settings, strategies as st

from millrace.llm.induced_sort import suffix_array


def naive(text, cap):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    common = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while k < cap and a + k < len(text) and b + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        common.append(k)
    return order, common[: len(order)]


def check(text, cap):
    order, common = suffix_array(np.frombuffer(text, np.uint8), cap)
    assert (order.tolist(), common.tolist()) == naive(text, cap)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.binary(max_size=80), st.text("ab", max_size=80).map(str.encode), st.text("abc", max_size=60).map(lambda s: (s * 3).encode())), st.sampled_from([1, 3, 8, 200]))
def test_against_sorting(text, cap):
    check(text, cap)


def test_repeats_and_extremes():
    rng = np.random.default_rng(4)
    base = rng.integers(97, 103, 300).astype(np.uint8).tobytes()
    for text in (b"", b"a", b"aaaaaaaaaa", b"ba" * 40, bytes(range(256)) * 2, bytes(range(255, -1, -1)), base + b"\0" + base[:250] + b"\0" + base[40:]):
        check(text, 200)
