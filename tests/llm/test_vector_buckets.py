"""Buckets of vectors in whole batches: groups over batch ends, the bound on cosines, roots."""

import numpy as np
import pyarrow as pa
import pytest

from quillmere.llm import vectors


@pytest.mark.parametrize("most", [0, 3])
def test_groups_are_whole_over_batches(most):
    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(0, 40, 300)).astype("i8")
    rows = pa.table({"key": keys, "row": np.arange(300)})
    for size in (1, 2, 7, 50, 300):
        got = list(vectors._whole_groups(rows.to_batches(max_chunksize=size), 1, most))
        assert np.concatenate([t.column("row").to_numpy() for t, _ in got]).tolist() == list(range(300))
        small = [set(t.column("key").to_pylist()) for t, large in got if not large]
        large = [set(t.column("key").to_pylist()) for t, large in got if large]
        assert sum(map(len, small)) == len(set().union(*small)) and all(len(k) == 1 for k in large) and not set().union(*small) & set().union(*large)
        assert most or not large


def test_sketches_lose_no_link():
    """Every row with a partner at the threshold is kept; unrelated ones mostly are not."""
    rng = np.random.default_rng(4)
    for dim in (1, 3, 24, 64):
        x = rng.standard_normal((600, dim))
        x[1::3] = x[::3] + rng.standard_normal((200, dim)) * rng.uniform(0, 0.6, (200, 1))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, : int(np.ceil(dim * vectors.SKETCH))]
        starts, sizes = np.arange(0, 600, 6), np.full(100, 6)
        keep = vectors._promising(vectors._sketches(x, turn), starts, sizes, 0.93, 1500)
        near = np.zeros(600, dtype=bool)
        for s in starts:
            g = x[s : s + 6] @ x[s : s + 6].T >= 0.93
            np.fill_diagonal(g, False)
            near[s : s + 6] = g.any(axis=1)
        assert (keep >= near).all() and near.any()
        assert dim < 64 or keep[2::3].sum() < 20


def test_roots_are_the_smallest_places():
    rng = np.random.default_rng(5)
    p, q = rng.integers(0, 200, 120), rng.integers(0, 200, 120)
    want = np.arange(200)
    for _ in range(200):
        for a, b in zip(p, q):
            want[a] = want[b] = min(want[a], want[b])
    assert vectors._settle(np.arange(200), p, q).tolist() == want.tolist()
