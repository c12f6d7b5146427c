import math

import numpy as np

from fathom.llm import hard_negatives
from fathom.llm.hard_negatives import Index, mine_hard_negatives, scaled


def usable(row):
    i, label, v = row
    return None not in (i, label, v) and all(x is not None and math.isfinite(x) and abs(x) < 2.0**53 / 256 for x in v) and sum(math.floor(256 * x) ** 2 for x in v) < 2**62


def brute_force(rows, every=100):
    rows = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in filter(usable, rows)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, label, x in {(i, k, tuple(v)) for i, k, v in rows if i % every == 0}:
        scored = [(-dot(x, v), i, k) for i, k, v in rows if i != a]
        for minus, p, _ in sorted(s for s in scored if s[2] == label)[:5]:
            inside = sorted((s, i) for s, i, k in scored if k != label and 80 * -minus <= 100 * -s <= 100 * -minus)[:5]
            out += [(a, p, r + 1, i, -minus, -s) for r, (s, i) in enumerate(inside)]
    return sorted(out)


def run(spark, rows, **options):
    made = spark.createDataFrame([(i, k, v, "clash") for i, k, v in rows], "vec_id long, label int, embedding array<float>, x string").repartition(3)
    return sorted(map(tuple, mine_hard_negatives(scaled(made), **options).collect()))


def made(n=400, dim=12, labels=3, common=0.0, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) + common
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    return [(i, int(rng.integers(labels)), v.tolist()) for i, v in enumerate(x)]


def test_equals_brute_force(spark, monkeypatch):
    for common, labels in ((0.0, 3), (1.5, 2), (0.0, 60)):
        rows = made(common=common, labels=labels)
        want = brute_force(rows, 20)
        assert run(spark, rows, every=20) == want
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", 300)
    assert run(spark, rows, every=20, block_values=30) == want


def test_edges(spark):
    v = [0.5, -0.25, 0.125]
    rows = [(i, i % 2, v) for i in range(0, 240, 3)]  # ties everywhere
    rows += [(100, 0, v), (100, 0, v), (200, 1, [1.0]), (300, 0, []), (400, 1, [0.0, 0.0, 0.0]), (500, 0, [-x for x in v]), (7, 1, [x / 1.1 for x in v]), (7, 1, [x / 1.1 for x in v])]
    want = brute_force(rows)
    assert want and run(spark, rows) == want
    odd = [(None, 0, v), (600, None, v), (700, 0, None), (800, 0, [1.0, None]), (900, 1, [math.nan, 1.0]), (1000, 1, [math.inf]), (1100, 0, [1e30, 1.0]), (1200, 0, [3e7, 1.0])]
    assert run(spark, rows + odd) == brute_force(rows + odd)
    assert run(spark, []) == [] and run(spark, [(0, 1, v)]) == [] and run(spark, odd[:-1]) == []


def test_index_leaves_out_dimensions_and_loses_nothing():
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(500, 16)) * np.linspace(0.05, 0.5, 16)).astype(np.int64)
    q = x[3]
    prefix = np.sqrt(np.concatenate([np.zeros((500, 1)), np.cumsum(x.astype(float) ** 2, axis=1)], axis=1))
    product = x @ q
    least = int(np.sort(product)[-8])
    index = Index(x, prefix, least / np.linalg.norm(q))
    assert len(index.rows) < 0.8 * np.count_nonzero(x)
    found, scores = index.reach(q, least, np.arange(500))
    assert sorted(found) == np.flatnonzero(product >= least).tolist() and (scores == product[found]).all()
