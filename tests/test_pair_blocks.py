"""Memory of the pair measures is square blocks and a bounded number of held values."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from prosemill.operators.semantic import percentile_of_pairs


def exact(m):
    s = m.astype(np.float64) @ m.astype(np.float64).T
    v = s[np.triu_indices(len(m), 2)]
    return v.max(), np.percentile(v, 95)


@pytest.mark.parametrize("n, block", [(3, 1024), (50, 7), (257, 64), (300, 1)])
@pytest.mark.parametrize("held", [1, 50, 1 << 22])
def test_blocks_and_divided_bins(n, block, held):
    m = np.random.default_rng(n).normal(size=(n, 8)).astype(np.float32)
    m[n // 2 :: 3] = m[0]
    assert np.allclose(percentile_of_pairs(m, 95, block, bins=16, held=held), exact(m), atol=1e-9)


def test_copies_hold_no_pairs():
    m = np.ones((3000, 16), np.float32) / 4
    tracemalloc.start()
    assert np.allclose(percentile_of_pairs(m, 95, 256, held=1000), (1.0, 1.0))
    assert tracemalloc.get_traced_memory()[1] < 20e6
    tracemalloc.stop()
