from itertools import combinations
from math import factorial, isnan

import numpy as np
from pyspark.sql import functions as F

from fathom.operators import boosting as B
from fathom.operators import shapley as H


def expected(forest, x, known, tree, node=0):
    """What a tree gives a row of which only the features ``known`` are seen."""
    if tree.feature[node] < 0:
        return tree.weight[node]
    j = int(tree.feature[node])
    left, right = 2 * node + 1, 2 * node + 2
    if j in known:
        goes_left = tree.missing_left[node] if isnan(x[j]) else x[j] <= forest.cuts[j][tree.bin[node] - 1]
        return expected(forest, x, known, tree, left if goes_left else right)
    return sum(tree.cover[c] / tree.cover[node] * expected(forest, x, known, tree, c) for c in (left, right))


def by_subsets(forest, x, k):
    value = lambda s: sum(expected(forest, x, s, t) for t in forest.trees)
    out = np.zeros(k)
    for j in range(k):
        others = [i for i in range(k) if i != j]
        for size in range(k):
            for s in combinations(others, size):
                out[j] += factorial(size) * factorial(k - size - 1) / factorial(k) * (value({*s, j}) - value(set(s)))
    return out


def table(spark, x, y):
    rows = [(i % 2, i, float(v), [None if isnan(a) else float(a) for a in r]) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "fold int, id long, y double, x array<double>").withColumn("name", F.xxhash64("id"))


def test_equals_enumeration_of_subsets(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 4)), 2)
    y = x[:, 0] * (x[:, 1] > 0) + 0.5 * np.abs(x[:, 0]) + 0.2 * x[:, 3]
    x[rng.random(x.shape) < 0.15] = np.nan
    df = table(spark, x, y)
    how = B.Boosting(trees=4, depth=3, rate=0.5, rows=0.8, columns=0.8, min_child=4, bins=16)
    forests = B.grow(df, 4, how)
    few = df.where("id < 40")
    found = {(r.id, r.feature): r.phi for r in H.tree_shapley(few, H.leaf_table(spark, forests), how.depth).collect()}
    made = {r.id: r.prediction for r in B.predict(few, forests, 4).collect()}
    repeats = any(len(set(f[f >= 0])) < len(f[f >= 0]) for forest in forests.values() for t in forest.trees for f in [t.feature])
    assert repeats  # a feature that comes twice on a path
    for i in range(40):
        forest = forests[i % 2]
        want = by_subsets(forest, x[i], 4)
        assert np.allclose([found.get((i, j), 0.0) for j in range(4)], want, atol=1e-9)
        assert abs(forest.base + sum(expected(forest, x[i], set(), t) for t in forest.trees) + want.sum() - made[i]) < 1e-9


def test_factors_that_carry_the_label_persist(spark):
    from datetime import datetime, timedelta

    rng = np.random.default_rng(3)
    n, names = 800, list("abcdef")
    x = rng.normal(size=(n, 6))
    y = np.where(x[:, 1] > 0, 1.0, -1.0) + 0.7 * x[:, 4] + 0.1 * rng.normal(size=n)
    rows = [("s", datetime(2024, 1, 1) + timedelta(hours=i), *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, " + ", ".join(f"{c} double" for c in names) + ", label double")
    how = B.Boosting(trees=3, depth=2, rate=0.5, columns=1.0, bins=16)
    run = lambda **more: [tuple(r) for r in H.persistent_factors(df, ["symbol"], "ts", names, "label", how, top=2, least=3, **more).collect()]
    assert sorted(run(must=["f"])) == [("b", 3, False), ("e", 3, False), ("f", 0, True)]  # 3 of the 4 folds have 200 rows before them
    assert sorted(run(must=["f"], most=2)) == [("b", 3, False), ("f", 0, True)]
