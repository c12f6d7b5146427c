"""Boosted trees against growing them row by row from the definition."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathom.operators import boosting as B

T0 = datetime(2024, 1, 1)


def plain_forest(x, y, names, fold, cuts, how, allowed=None):
    """(predict, gain by feature): every node scans all splits of its own rows."""
    n, k = x.shape
    scale = 2.0 ** (30 - math.ceil(math.log2(max(abs(y).max(), 1.0 if how.loss == "logistic" else 2.0**-40))))
    mean = np.rint(y * scale).sum() / n / scale
    base = mean if how.loss == "squared" else math.log(mean / (1 - mean))
    soft = lambda g: np.sign(g) * max(abs(g) - how.alpha, 0)
    worth = lambda g, h: soft(g) ** 2 / (h + how.ridge)
    margin, trees, gains = np.full(n, base), [], []

    def node(rows, g, h, columns, depth):
        gs, hs = g[rows].sum(), h[rows].sum()
        best = None
        for j in columns if depth else []:
            gone = np.isnan(x[rows, j])
            for b, cut in enumerate(cuts[j]):
                for missing_left in (False, True) if gone.any() else (False,):
                    left = np.where(gone, missing_left, x[rows, j] <= cut)
                    hl = h[rows][left].sum()
                    if hl >= how.min_child and hs - hl >= how.min_child and 0 < hl < hs:
                        gl = g[rows][left].sum()
                        gain = worth(gl, hl) + worth(gs - gl, hs - hl) - worth(gs, hs)
                        if gain > 1e-6 and (best is None or gain > best[0]):
                            best = (gain, j, cut, missing_left)
        if best is None:
            return ("leaf", -how.rate * soft(gs) / (hs + how.ridge))
        gain, j, cut, missing_left = best
        gains.append((j, gain))
        left = np.where(np.isnan(x[rows, j]), missing_left, x[rows, j] <= cut)
        return ("split", j, cut, missing_left, node(rows[left], g, h, columns, depth - 1), node(rows[~left], g, h, columns, depth - 1))

    def at(tree, row):
        while tree[0] == "split":
            _, j, cut, missing_left, left, right = tree
            tree = left if (missing_left if math.isnan(row[j]) else row[j] <= cut) else right
        return tree[1]

    for t in range(how.trees):
        if how.loss == "squared":
            g, h = margin - y, np.ones(n)
        else:
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
        g, h = np.rint(g * scale) / scale, np.rint(h * 2.0**20) / 2.0**20
        rows = np.flatnonzero(B.drawn_rows(names, how.seed, t, how.rows))
        tree = node(rows, g, h, B.drawn_columns(np.ones(k, bool) if allowed is None else allowed, how.seed, fold, t, how.columns), how.depth)
        trees.append(tree)
        margin = margin + [at(tree, r) for r in x]
    return (lambda z: base + sum(np.array([at(t, r) for r in z]) for t in trees)), gains


def made(n=300, k=5, seed=0, missing=0.1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, k)), 2)
    y = np.round(np.where(x[:, 1] > 0.3, 1.0, -0.5) + 0.4 * x[:, 3] * (x[:, 0] > 0) + 0.3 * rng.normal(size=n), 3)
    x[rng.random((n, k)) < missing] = np.nan
    return x, y


def table(spark, parts):
    rows = [(f, i, float(v), [None if math.isnan(a) else float(a) for a in r]) for f, (x, y) in parts.items() for i, (r, v) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "fold int, id long, y double, x array<double>")
    return df.withColumn("name", F.xxhash64("id")).repartition(3)


@pytest.mark.parametrize("how", [
    B.Boosting(trees=4, depth=3, rate=0.3, rows=0.7, columns=0.5, min_child=8, bins=12),
    B.Boosting(trees=3, depth=2, rate=0.5, rows=1.0, columns=1.0, min_child=2, alpha=0.0, ridge=0.5, bins=8, loss="logistic"),
])
def test_equals_the_definition_for_all_folds_at_once(spark, monkeypatch, how):
    parts = {0: made(seed=1), 1: made(180, seed=2), 7: made(20, seed=3)}
    if how.loss == "logistic":
        parts = {f: (x, (y > 0).astype(float)) for f, (x, y) in parts.items()}
    df = table(spark, parts)
    monkeypatch.setattr(B, "KEPT", 2)
    forests = B.grow(df, 5, how)
    assert set(forests) == {0, 1}  # too few rows in the third
    names = {(r.fold, r.id): r.name for r in df.select("fold", "id", "name").collect()}
    made_for = {(r.fold, r.id): r.prediction for r in B.predict(df, forests, 5).collect()}
    assert made_for[7, 0] is None
    for fold in (0, 1):
        x, y = parts[fold]
        name = np.array([names[fold, i] for i in range(len(x))])
        cuts = [[c for c in cut if (x[:, j][~np.isnan(x[:, j])] > c).any()] for j, cut in enumerate(forests[fold].cuts)]
        predict, gains = plain_forest(x, y, name, fold, cuts, how)
        assert np.allclose([made_for[fold, i] for i in range(len(x))], predict(x), atol=1e-9)
        mean = np.zeros(5)
        for j in range(5):
            own = [g for f, g in gains if f == j]
            mean[j] = np.mean(own) if own else 0
        assert len(gains) >= 6 and np.allclose(forests[fold].importance(), mean / mean.sum(), atol=1e-9)


def test_two_phases_keep_the_best_and_what_must_stay(spark):
    df = table(spark, {0: made(400, missing=0.0)})
    forests = B.two_phase(df, list("abcde"), B.Boosting(trees=3, depth=2, rate=0.3, rows=1.0, columns=1.0, bins=16), 1, ["e"])
    assert forests[0].allowed.tolist() == [False, True, False, False, True]
    assert {int(f) for t in forests[0].trees for f in t.feature if f >= 0} <= {1, 4}


def test_walk_forward_does_not_look_ahead(spark):
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"symbol": "a", "ts": [T0 + timedelta(hours=i) for i in range(500)], "a": rng.normal(size=500), "b": rng.normal(size=500)})
    rows["y"] = np.where(rows.a > 0, 1.0, -1.0) + 0.1 * rng.normal(size=500)
    rows.loc[430, "a"] = np.nan
    how = B.Boosting(trees=3, depth=2, rate=0.5, columns=1.0, bins=16)
    run = lambda df, **more: B.walk_forward(spark.createDataFrame(df), ["symbol"], "ts", ["a", "b"], "y", 200, 150, 3, how, **more).toPandas().set_index("ts").prediction
    found = run(rows)
    assert len(found) == 300 and found.isna().sum() == 1 and np.corrcoef(found.fillna(0), rows.set_index("ts").y[found.index])[0, 1] > 0.8
    later = rows.copy()
    later.loc[340:, "y"] *= -5  # after the training rows of the second refit (150 .. 342 less 8)
    moved = run(later)
    first = rows.ts[200:350]
    assert np.allclose(found[first], moved[first]) and not np.allclose(found.fillna(0), run(rows.assign(y=-rows.y)).fillna(0))
    assert len(run(rows, backfill=True)) == 500
    few = spark.createDataFrame(rows[:150])
    assert B.walk_forward(few, ["symbol"], "ts", ["a", "b"], "y", 200, 150, 3, how).count() == 0
