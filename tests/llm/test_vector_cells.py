"""How many near pairs the lattice cells find, and how many unlike vectors meet in them, for vectors of any length."""

import numpy as np
import pytest

from pixeltide.llm import e8dedup


def near_pairs(rng, n, length, low, high):
    a = rng.standard_normal((n, length))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((n, length))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = rng.uniform(low, high, (n, 1))
    return a, c * a + np.sqrt(1 - c * c) * b


def met(a, b):
    """Rows of cells that meet: one's own cell is among the other's."""
    return ((a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)).any(1)


def share_of_all(cells):
    n, total = len(cells), 0
    for t in range(cells.shape[1]):
        own, count = np.unique(cells[:, t, 0], return_counts=True)
        for k in range(cells.shape[2]):
            at = np.minimum(np.searchsorted(own, cells[:, t, k]), len(own) - 1)
            total += count[at][own[at] == cells[:, t, k]].sum()
    return (total - n * cells.shape[1]) / n**2


@pytest.mark.parametrize("length", [2, 8, 16, 64, 256, 768])
@pytest.mark.parametrize("n", [500, 50_000, 500_000])
def test_pairs_at_the_bound_are_found(length, n):
    a, b = near_pairs(np.random.default_rng(length), 500, length, 0.95, 0.955)
    blocks, tables = e8dedup.setting(n)
    assert met(e8dedup.cells(a, tables, blocks), e8dedup.cells(b, tables, blocks)).mean() >= 0.95


@pytest.mark.parametrize("length", [64, 768])
def test_unlike_vectors_rarely_meet(length):
    x = np.random.default_rng(1).standard_normal((8000, length))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    shares = []
    for n in (2000, 8000, 500_000):
        blocks, tables = e8dedup.setting(n)
        shares.append(share_of_all(e8dedup.cells(x[: min(n, 8000)], tables, blocks)))
    assert shares[0] < 0.04 and shares[1] < 0.01 and shares[2] < 0.001
    assert all(s * n < 200 for s, n in zip(shares, (2000, 8000, 500_000), strict=True))


def test_settings_grow_slowly():
    assert e8dedup.setting(0) == e8dedup.setting(1) == e8dedup.setting(5000) == (2, 8)
    sizes = [e8dedup.setting(10**k) for k in range(3, 10)]
    assert sizes == sorted(sizes) and sizes[-1][0] <= 8 and sizes[-1][1] <= 120


@pytest.mark.parametrize("length", [8, 16, 128])
def test_links_of_short_and_long_vectors(spark, length):
    a, b = near_pairs(np.random.default_rng(length), 150, length, 0.951, 0.955)
    rows = [(2 * i + k, v.tolist()) for i, pair in enumerate(zip(a, b, strict=True)) for k, v in enumerate(pair)]
    got = {r.vec_id: r for r in e8dedup.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = np.stack([v for _, v in rows])
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    assert sum(r.n_links for r in got.values()) >= 0.98 * near.sum()
