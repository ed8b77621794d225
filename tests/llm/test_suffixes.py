"""Suffix order, previous factors and deep nodes against brute force."""

import numpy as np
import pytest

from skeinery.llm import suffixes


def match(a, b):
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


@pytest.mark.parametrize("seed", range(40))
def test_order_factors_nodes(seed):
    rng = np.random.default_rng(seed)
    segments = [rng.integers(0, 3, rng.integers(1, 60)).astype(np.uint8) for _ in range(rng.integers(1, 9))]
    segments += segments[:1] if seed % 3 == 0 else []
    data = np.concatenate(segments)
    left = np.concatenate([np.arange(len(s), 0, -1) for s in segments])
    least = int(rng.integers(4, 20))
    order = suffixes.Order(data if seed % 2 else data.astype(np.int32), left, least)
    deep = 2 * order.levels[-1][0]
    assert deep >= least
    at = np.arange(len(data))
    by, common = order.sort(at)
    text = [tuple(data[i : i + left[i]][:deep]) for i in at]
    # suffixes that share too little with any other are left out
    half = order.levels[-1][0]
    pads = [(*t[:half], *[-1] * (half - len(t[:half]))) for t in text]
    some = sorted((i for i in at if pads.count(pads[i]) > 1), key=lambda i: (text[i], i))
    assert [text[i] for i in by] == [text[i] for i in some]
    want = [0] + [match(text[by[i - 1]], text[by[i]]) for i in range(1, len(by))]
    assert [c for c in common if c >= least] == [w for w in want if w >= least]
    place = rng.permutation(len(data))
    got = np.zeros(len(data), int)
    got[by] = suffixes.previous_factors(place[by], common, least)
    for i in at:
        best = max((match(text[i], text[j]) for j in at if place[j] < place[i]), default=0)
        assert got[i] == (best if best >= least else 0)
    depth, low, high = suffixes.nodes(common, least)
    leaves = {int(by[k]) for a, b in zip(low, high, strict=True) for k in range(a, b + 1)}
    assert leaves == {i for i in at for j in at if i != j and match(text[i], text[j]) >= least}
    for d, a, b in zip(depth, low, high, strict=True):
        assert min(match(text[by[a]], text[by[k]]) for k in range(a, b + 1)) == d


def test_many_positions():
    """Beyond the packed sort key the order is the same."""
    rng = np.random.default_rng(0)
    a, b = rng.integers(1, 50, 1000).astype(np.uint64), rng.integers(1, 50, 1000).astype(np.uint64)
    _, want = suffixes.dense(a, b)
    bits, suffixes.BITS = suffixes.BITS, 5
    try:
        _, got = suffixes.dense(a, b)
    finally:
        suffixes.BITS = bits
    assert (got == want).all()


def test_equal_segments():
    data = np.frombuffer(b"abcabxabc", np.uint8)
    lead, many = suffixes.distinct(data, np.array([3, 6, 9]), np.array([9, 5, 2]))
    assert lead.tolist() == [2, 1, 2] and many.tolist() == [2, 1, 2]
    lead, many = suffixes.distinct(data[:0], np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert not len(lead) and not len(many)
