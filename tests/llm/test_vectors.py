"""Operators on embeddings against plain numpy."""

import numpy as np
import pytest

from strophe.llm import projection_passes, whitening

KIND = "vec_id long, embedding array<float>, label int, n long, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 0, "own") for i, v, label in rows], KIND).repartition(3)


def odd_vectors(d):
    nan, inf = float("nan"), float("inf")
    return [(900, None, 1), (901, [], 1), (902, [nan] + [0.0] * (d - 1), 1), (903, [inf] + [1.0] * (d - 1), 1), (904, [None] + [1.0] * (d - 1), 1), (905, [1.0], 1)]


@pytest.mark.parametrize("d", [5, 20])
def test_whitening(spark, d):
    rng = np.random.default_rng(d)
    x = (rng.normal(size=(60, d)) @ rng.normal(size=(d, d))).astype(np.float32)
    rows = [(i, [float(c) for c in v], None) for i, v in enumerate(x)]
    rows += [rows[3], rows[3], (None, rows[5][1], 1)]
    v = table(spark, rows + odd_vectors(d))
    got = whitening.transform(v, whitening.fit(v)).toPandas()
    whole = np.floor(64 * np.array([r[1] for r in rows])).astype(np.int64) + 1_000_000
    fit = np.unique(whole, axis=0)
    n, sums = len(fit), fit.sum(0)
    cov = np.cov(fit.T, bias=True)
    e, u = np.linalg.eigh(cov)
    k = min(d, 16)
    assert len(got) == len(rows) * k and got.identity_error.max() < 1e-9 and set(got.n) == {n}
    assert {r[0] for r in rows} == set(got.vec_id.dropna().astype(int)) | {None}
    for c in range(1, k + 1):
        part = got[got.component == c].dropna().sort_values("vec_id")
        z = (whole[:60] - sums / n) @ u[:, -c] / np.sqrt(e[-c])
        ours = part.drop_duplicates("vec_id").whitened.to_numpy()
        assert min(np.abs(ours - z).max(), np.abs(ours + z).max()) < 1e-6
        assert np.allclose(part.explained, e[-c] / np.trace(cov), rtol=1e-9)
        assert list(part.drop_duplicates("vec_id").deviation) == [int(((n * w - sums) ** 2).sum()) for w in whole[:60]]


def test_whitening_of_little(spark):
    for rows in ([], odd_vectors(1)[:4], [(1, [0.5, 2.0], 1), (2, [0.5, 2.0], 1)]):
        v = table(spark, rows)
        assert whitening.transform(v, whitening.fit(v)).count() == 0
    v = table(spark, [(1, [1e30, 0.0], 1), (2, [-1e30, 1.0], 1), (3, [0.0, 0.5], 1)])
    got = whitening.transform(v, whitening.fit(v)).collect()
    assert len(got) == 6 or len(got) == 3
    assert sum(r.deviation is None for r in got if r.component == 1) == 2


def plain_links(rows, threshold=0.93):
    """(vec_id, links, smallest id of the class, kept) of every row."""
    fine = [label is not None and v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v, label in rows]
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if f else None for (_, v, _), f in zip(rows, fine, strict=True)]
    near = [[j for j in range(len(rows)) if j != i and fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        new = [min([root[i], *(root[j] for j in near[i])]) for i in range(len(rows))]
        if new == root:
            break
        root = new
    best = {}
    for r, (i, _, _) in zip(root, rows, strict=True):
        if i is not None:
            best[r] = min(best.get(r, i), i)
    return [(i, len(n), best.get(r), i == best.get(r)) for (i, _, _), n, r in zip(rows, near, root, strict=True)]


def clustered(seed, d=24, families=30, size=6, spread=0.06, labels=3):
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(families):
        base = rng.normal(size=d)
        for _ in range(int(rng.integers(1, size + 1))):
            rows.append((base + rng.normal(size=d) * spread * rng.uniform(0, 6)) * rng.uniform(0.5, 3))
    order = rng.permutation(len(rows))
    return [(int(k), [float(c) for c in np.float32(rows[i])], int(i) % 2 if labels > 1 else 0) for k, i in enumerate(order)]


def same_links(spark, rows):
    v = table(spark, rows)
    got = [tuple(r) for r in projection_passes.near_duplicates(v).collect()]
    assert sorted(got, key=str) == sorted(plain_links(rows), key=str)


def test_projection_passes(spark):
    rows = clustered(1, labels=2)
    copies = [(1000 + k, rows[k % 3][1], rows[k % 3][2]) for k in range(9)]
    scaled = [(2000, [2 * c for c in rows[5][1]], rows[5][2]), (2001, [-c for c in rows[5][1]], rows[5][2]), (2002, rows[5][1], None), (None, rows[5][1], rows[5][2]), rows[7], rows[7]]
    none = [(3000, [0.0] * 24, 1), (3001, [0.0] * 24, 1), (3002, [1.0, 2.0], 1), (3003, [1.0, 2.0], 1), (3004, [3e38, 3e38], 1), (3005, [-0.0, 1.0], 0), (3006, [0.0, 1.0], 0)]
    same_links(spark, rows + copies + scaled + none + odd_vectors(24))


def test_projection_passes_of_nothing(spark):
    same_links(spark, [])
    same_links(spark, odd_vectors(3))


@pytest.mark.parametrize("spread", [0.02, 0.05, 0.09])
def test_large_components(spark, monkeypatch, spread):
    """Rings and pieces: all certain, some compared, most compared."""
    monkeypatch.setattr(projection_passes, "PIECE", 16)
    rows = clustered(4, families=2, size=150, spread=spread, labels=1) + [(5000 + i, r[1], r[2]) for i, r in enumerate(clustered(4, families=2, size=150, spread=spread, labels=1)[:5])]
    same_links(spark, rows)


def test_windows_and_seams(spark, monkeypatch):
    """Small windows in many partitions still find nearly all links."""
    monkeypatch.setattr(projection_passes, "WINDOW", 16)
    monkeypatch.setattr(projection_passes, "BLOCK", 32)
    rows = clustered(7, d=32, families=400, size=2, spread=0.05, labels=1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.vec_id: r.n_links for r in projection_passes.near_duplicates(table(spark, rows)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = plain_links(rows)
    assert all(got[i] <= n for i, n, _, _ in want)
    assert sum(got.values()) >= 0.99 * sum(n for _, n, _, _ in want) > 100
