"""Links, components and counts against brute force; the multi-sequence order; odd vectors."""

import numpy as np

from shelfwise.llm import multi_index as M
from tests.llm.test_simhash import brute_components


def _brute(rows, threshold):
    ids = [i for i, _ in rows]
    u = np.array([v for _, v in rows], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        new = np.minimum(label, np.where(near, label[None, :], 1 << 60).min(axis=1))
        if (new == label).all():
            return sorted(zip(ids, near.sum(axis=1).tolist(), label.tolist()))
        label = new


def _clusters(n, dim, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, n // 2, 7):  # loose groups around the threshold
        x[i : i + 7] = x[i] + rng.uniform(0.05, 0.5) * rng.normal(size=(len(x[i : i + 7]), dim))
    x[n // 2 : n // 2 + 150] = x[0] + 0.02 * rng.normal(size=(150, dim))  # one dense group
    x[-20:] = x[5]  # equal vectors
    x[-30:-25] = 3 * x[-35:-30]  # other lengths
    return x


def test_multi_sequence_visits_by_rising_sum():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = np.sort(rng.random(6)), np.sort(rng.random(5))
        a[0] = b[0] = 0
        got = M._multi_sequence(a, b, np.arange(6), np.arange(5), 5, 0.7)
        sums = [a[c // 5] + b[c % 5] for c in got]
        assert sums == sorted(sums) and len(set(got.tolist())) == len(got) == int((a[:, None] + b[None, :] <= 0.7).sum())


def test_against_brute_force(spark):
    for n, dim, block in ((900, 16, 1024), (700, 9, 40)):
        x = _clusters(n, dim, dim)
        rows = [(int(3 * i % 1009), [float(c) for c in v]) for i, v in enumerate(x)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in M.near_duplicates(df, cell_rows=8, recall=0.999, block_rows=block).collect())
        want = _brute(rows, 0.95)
        wrong = sum(a != b for a, b in zip(got, want))
        assert len(got) == len(want) and wrong <= 0.01 * n
        assert sum(g[1] for g in got) >= 0.995 * sum(w[1] for w in want)
        assert all(g[1] <= w[1] for g, w in zip(got, want))  # no link below the threshold


def test_spanning_links_of_a_block():
    rng = np.random.default_rng(4)
    for _ in range(30):
        h, g = rng.integers(0, 12, 9), rng.integers(0, 10, 9)
        hid, gid = rng.permutation(12) + 100, rng.permutation(10) + 200
        src, dst = M._spanning(h, g, hid, gid)
        pairs = list(zip(hid[h].tolist(), gid[g].tolist()))
        ids = [*hid.tolist(), *gid.tolist()]
        assert brute_components(list(zip(src.tolist(), dst.tolist())), ids) == brute_components(pairs, ids)


def test_odd_vectors(spark):
    big = [1e200, 2e200]
    rows = [(1, [1.0, 2.0], 0), (2, [2.0, 4.0], 0), (3, big, 0), (4, None, 0), (5, [0.0, 0.0], 0), (6, [float("nan"), 1.0], 0), (7, [float("inf"), 1.0], 0),
            (8, [None, 1.0], 0), (9, [], 0), (None, [1.0, 2.0], 0), (10, [-1.0, -2.0], 0), (11, [1.0, 2.0, 0.0], 0), (12, [5.0], 0), (0, [7.0], 0), (1, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in M.near_duplicates(df).collect()), key=str)
    linked = [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False)]
    alone = [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, None, 10, 11)]
    assert got == sorted([*linked, *alone, (12, 1, 0, False), (0, 1, 0, True)], key=str)
    assert M.near_duplicates(df.limit(0)).count() == 0
