"""Factor-set search against its definitions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathom.operators import search as R


def icir(value, label, window):
    """Stepped windows one by one."""
    n, step, found = len(value), max(1, window // 5), []
    if n < max(30, window // 2):
        return 0.0
    for start in range(0, n - window + 1, step):
        pair = pd.DataFrame({"a": value[start : start + window], "b": label[start : start + window]}).dropna()
        if len(pair) >= window // 2:
            c = pair.a.rank().corr(pair.b.rank())
            if not np.isnan(c):
                found.append(c)
    return np.mean(found) / (np.std(found) + 1e-9) if len(found) >= 3 else 0.0


def test_stepped_icir(spark):
    rng, rows, expected = np.random.default_rng(2), [], {}
    for key, n in (("a", 200), ("b", 29), ("c", 61), ("d", 120)):
        value, label = rng.integers(0, 9, n).astype(float), rng.normal(size=n)
        value[rng.random(n) < 0.3] = np.nan
        if key == "d":
            value[:] = 1.0
        rows += [(key, i, None if np.isnan(v) else float(v), float(y), "x") for i, (v, y) in enumerate(zip(value, label))]
        expected[key] = icir(value, label, 30)
    found = {r.key: r.icir for r in R.stepped_icir(spark.createDataFrame(rows, "key string, rn long, value double, label double, ic string"), ["key"], 30).collect()}
    assert found == {k: pytest.approx(v) for k, v in expected.items()} and expected["a"] != 0


def test_split_leaves_gaps_between_folds(spark):
    rows = spark.createDataFrame([(s, i, n) for s, n in (("a", 1000), ("b", 60)) for i in range(n)], "symbol string, rn long, total long").withColumn("at", F.col("rn"))
    found = R.three_way_split(rows).toPandas()
    big = found[found.symbol == "a"].groupby("part")["at"].agg(["min", "max"])
    assert big.loc[-1].tolist() == [0, 499] and big.loc[99].tolist() == [800, 999]
    assert big.loc[[0, 1, 2]].values.tolist() == [[503, 598], [603, 698], [703, 798]]
    assert sorted(found[found.symbol == "b"].part.unique()) == [-1, 0, 99]
    assert (found.groupby(["symbol", "part"]).rn.agg(lambda x: sorted(x) == list(range(int(x.min()), int(x.max()) + 1)))).all()


def test_moves_stay_in_their_cluster():
    clusters = (("a", "b"), ("c", "d"), ("e",))
    assert R.moves(("a", "c"), clusters) == [("a",), ("a", "c", "e"), ("a", "d"), ("b", "c"), ("c",)]
    assert R.moves(("a", "c"), clusters, must=("a",)) == [("a",), ("a", "c", "e"), ("a", "d")]


def test_refinement_climbs_to_a_set_without_better_moves():
    clusters = (("a", "b"), ("c", "d"), ("e",))
    worth = {"a": 1.0, "b": 2.0, "c": -1.0, "d": 0.5, "e": 0.2}
    score = lambda sets: {"|".join(s): sum(worth[f] for f in s) for s in sets}
    path = R.refine(("a", "c"), clusters, score)
    assert path[0] == (0, "a|c", 0.0) and path[-1][1] == "b|d|e"
    assert [p[2] for p in path] == sorted(p[2] for p in path)


def test_guards_and_flags(spark):
    icirs = spark.createDataFrame([("a", 1, "s", p, x) for p, x in ((-1, 2.0), (0, 1.0), (1, 3.0), (99, 9.0))] + [("b|c", 2, "s", 0, 0.5)], "set_id string, n int, symbol string, part int, icir double")
    mac = spark.createDataFrame([("a", "s", 0.0), ("b|c", "s", 0.4)], "set_id string, symbol string, mac double")
    found = {r.set_id: r for r in R.guarded_scores(icirs, mac, cap=0.5, must=("b",)).collect()}
    assert (found["a"].raw, found["a"].sigma, found["a"].gap) == (1.0, 1.0, 1.0) and found["a"].score == pytest.approx(1.0 - 0.05 - 0.5 - 0.3)
    assert found["b|c"].score == pytest.approx(0.5 - 0.1 - 0.05)
    sharpe = lambda *rows: spark.createDataFrame([(s, "s", x) for s, x in rows], "set_id string, symbol string, sharpe double")
    flags = R.overfit_flags(sharpe(("a", 1.0), ("b", 1.0), ("c", -999.0)), sharpe(("a", 0.4), ("b", 1.4), ("c", 2.0)))
    assert {r.set_id: r.overfit for r in flags.collect()} == {"a": True, "b": False, "c": None}


def test_two_level_weights(spark):
    groups = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "y")], "factor string, cluster string")
    icirs = spark.createDataFrame([("s", f, 120, v) for f, v in (("a", 0.6), ("b", 0.3), ("c", 0.1), ("d", 0.2))], "symbol string, factor string, at long, icir double")
    found = {r.factor: r.weight for r in R.two_level_weights(icirs, groups, 0.3).collect()}
    own = {"x": (0.6 * 0.6 + 0.3 * 0.3) / 0.9, "y": 0.2}
    total = sum(own.values())
    assert found == {"a": pytest.approx(2 / 3 * own["x"] / total), "b": pytest.approx(1 / 3 * own["x"] / total), "d": pytest.approx(own["y"] / total)}
