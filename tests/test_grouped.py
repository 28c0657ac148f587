"""Clusters and groups of large recordings and speakers: as the plain methods, without their matrices and searches."""

import random
import time
import tracemalloc

import numpy as np

from vecspan.operators import clustering as C


def test_cosine_linkage_is_average_linkage():
    for seed in range(40):
        r = np.random.default_rng(seed)
        x = r.normal(size=(int(r.integers(1, 60)), 5)) + 2 * r.normal(size=(4, 5))[r.integers(0, 4)]
        x = np.concatenate([x, x[: len(x) // 3], np.zeros((seed % 3, 5))])
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        for threshold in (0.0001, 0.1, 0.3, 0.45, 0.4999, 1.0):
            assert (C.cosine_linkage(x, threshold) == C.average_linkage(1 - 0.5 * (1 + u @ u.T), threshold)).all()


def test_cosine_linkage_has_no_matrix():
    """6,000 rows: a matrix of distances would take 288 MB."""
    x = np.random.default_rng(0).normal(size=(6000, 8))
    tracemalloc.start()
    began = time.time()
    labels = C.cosine_linkage(x, 0.1)
    assert tracemalloc.get_traced_memory()[1] < 20e6 and time.time() - began < 60
    tracemalloc.stop()
    assert len(set(labels.tolist())) > 1


def test_balance_of_many_durations():
    """100,000 utterances of a speaker, in time that grows with their number."""
    r = random.Random(0)
    began = time.time()
    groups = C.balance_durations([r.uniform(0, 9) for _ in range(100_000)], 20.0)
    assert time.time() - began < 10
    assert [s for s, _ in groups] == [0] + [e for _, e in groups[:-1]] and groups[-1][1] == 100_000


def test_sparse_spectral_is_dense_spectral():
    """Clouds that touch, parts without an edge between them, one alone, copies, rows of zeros: the same clusters by the smallest eigenvectors alone."""
    for seed in range(6):
        r = np.random.default_rng(seed)
        x = r.normal(size=(300, 6)) + (0, 2, 2, 4, 30, 30)[seed] * r.normal(size=(3 + seed, 6))[r.integers(0, 3 + seed, 300)]
        if seed in (1, 3):
            x = np.concatenate([x, x[:60], np.zeros((2, 6))])
        assert (C.spectral(x, dense=0) == C.spectral(x, dense=1000)).all()
        if seed < 4:  # with more than four parts, four of their null vectors are any
            assert (C.spectral(x, 4, dense=0) == C.spectral(x, 4, dense=1000)).all()


def test_repeated_eigenvalues_are_found():
    """Two parts and values that repeat up to nine times, which one start of Lanczos finds once."""
    r = np.random.default_rng(0)
    w = np.sort(np.r_[0, 0, np.full(9, 0.5), np.full(4, 0.7), 0.9, np.linspace(1, 8, 184)])
    q = np.linalg.qr(r.normal(size=(200, 200)))[0]
    got, v = C.smallest_eigenpairs(lambda x: q @ (w * (q.T @ x)), q[:, :2], 21, 8.0, held=60)
    assert np.abs(got - w[:21]).max() < 1e-9 and np.abs(q @ (w[:, None] * (q.T @ v)) - v * got).max() < 1e-8
    assert np.abs(v.T @ v - np.eye(21)).max() < 1e-9
    none, null = C.smallest_eigenpairs(lambda x: 0 * x, np.eye(200)[:, :21], 21, 8.0)
    assert not none.any() and null.shape == (200, 21)


def test_spectral_has_no_matrix():
    """3,000 rows: a matrix of similarities would take 72 MB, and there were several."""
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 8)) + 10 * np.eye(8)[np.arange(3000) % 4]
    tracemalloc.start()
    labels = C.spectral(x)
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    assert (labels == np.arange(3000) % 4).all()
