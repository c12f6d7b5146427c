from datetime import datetime, timedelta

import numpy as np
import pytest

from fathom.operators import labels as L
from fathom.operators import moments as M

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    out = []
    for symbol, n in (("a", 400), ("b", 260), ("short", 90)):
        x = rng.normal(size=(n, 3))
        y = x @ [0.5, -1.0, 0.0] + rng.normal(size=n)
        x[rng.random(x.shape) < 0.03] = np.nan
        out += [(symbol, T0 + timedelta(hours=i), *(None if np.isnan(v) else float(v) for v in r), float(t) if i % 37 else None) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(out, "symbol string, ts timestamp, a double, b double, c double, y double").repartition(5)


@pytest.mark.parametrize("rolling", [True, False])
def test_equals_fits_of_whole_folds(rows, rolling):
    grid, ridges = [(120, 40), (100, 7), (150, 400)], (1e-8, 2.0)
    made = M.walk_forward_grid(rows, ["symbol"], "ts", ["a", "b", "c"], "y", grid, 3, ridges, rolling)
    found = {(r.train, r.every, r.ridge, r.symbol, r.ts): (r.fold, r.prediction) for r in made.collect()}
    seen = 0
    for train, every in grid:
        for ridge in ridges:
            L.MODELS["_"] = lambda x, y, ridge=ridge: L.least_squares(x, y, None, ridge)
            want = L.walk_forward(rows, ["symbol"], "ts", ["a", "b", "c"], "y", train, every, 3, model="_", rolling=rolling, scale=False).collect()
            del L.MODELS["_"]
            for r in want:
                fold, prediction = found[train, every, ridge, r.symbol, r.ts]
                assert fold == r.fold and (prediction is None) == (r.prediction is None)
                if prediction is not None:
                    assert prediction == pytest.approx(r.prediction, rel=1e-7, abs=1e-9)
                    seen += 1
    assert seen > 1500 and len(found) == sum(max(0, n - t) * 2 for t, _ in grid for n in (400, 260, 90))


def test_no_rows(rows):
    assert M.walk_forward_grid(rows.where("symbol = 'short'"), ["symbol"], "ts", ["a"], "y", [(120, 40)], 3).count() == 0
