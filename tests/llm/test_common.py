"""Packing and bucketing of messages."""
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from fluxsieve.llm import common as C


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2 ** 40), st.just(255), st.just(254))))
def test_small_round_trip(values):
    x = np.array(values, np.int64)
    assert C.wide(C.small(x)).tolist() == values


def test_small_lists_the_few_large_values():
    x = np.zeros(10_000, np.int64)
    x[::1000] = 10 ** 9
    assert len(C.small(x)) < 11_000 and C.wide(C.small(x)).tolist() == x.tolist()


def test_pack_round_trip():
    cols = [np.arange(5, dtype=np.uint64), b"raw", np.zeros(0, np.int64)]
    a, b, c = C.unpack(C.pack(*cols), np.uint64, None, np.int64)
    assert a.tolist() == list(range(5)) and b == b"raw" and len(c) == 0


@pytest.mark.parametrize("buckets", [1, 32, 1000, 10 ** 7])
def test_buckets_tile_the_hashes(buckets):
    h = np.sort(C.mix(np.arange(5000, dtype=np.uint64)))
    got = C.by_bucket(h, buckets)
    assert got[0][1] == 0 and got[-1][2] == len(h) and all(x[2] == y[1] and x[0] < y[0] for x, y in zip(got, got[1:]))
    assert all(0 <= b < buckets for b, _, _ in got) and C.by_bucket(h[:0], buckets) == []
