from datetime import datetime, timedelta

import numpy as np
import pytest

from fathom.operators import recurrent as G


@pytest.mark.parametrize("layers", [1, 2])
def test_gradients_equal_differences(layers):
    how = G.Recurrent(length=5, hidden=4, layers=layers)
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(7, 5, 3)), rng.normal(size=7) * 2
    p = G.new_weights(3, how)
    loss = lambda: G.huber(G.forward(p, x, layers)[0] - y, 1.0)[0]
    made, seen = G.forward(p, x, layers)
    grads = G.backward(p, seen, G.huber(made - y, 1.0)[1], layers)
    assert set(grads) == set(p)
    for k, w in p.items():
        for at in rng.integers(0, w.size, 6):
            place = np.unravel_index(at, w.shape)
            old = w[place]
            w[place] = old + 1e-6
            up = loss()
            w[place] = old - 1e-6
            down = loss()
            w[place] = old
            assert grads[k][place] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-8), k


def test_learns_what_lies_steps_back_and_stops_early():
    rng = np.random.default_rng(1)
    series = rng.normal(size=(900, 3))
    x = G.windows(series, 6)
    y = np.tanh(series[2:-3, 1]) + 0.05 * rng.normal(size=len(x))  # three steps before the last
    how = G.Recurrent(length=6, hidden=12, epochs=60, rate=1e-2, patience=10)
    p, picked = G.two_phase(x[:700], y[:700], how, 1)
    assert picked.tolist() == [1]
    made = G.forward(p, x[700:, :, picked], 1)[0]
    assert np.corrcoef(made, y[700:])[0, 1] > 0.9
    noise = rng.normal(size=700)
    few = G.train(x[:700], noise, how)
    assert np.abs(G.forward(few, x[700:], 1)[0]).mean() < 0.5  # the best epoch of pure noise is an early one


def test_walk_forward(spark):
    rng = np.random.default_rng(2)
    n = 1100
    x = rng.normal(size=(n, 2))
    y = np.r_[0.0, x[:-1, 0]] + 0.1 * rng.normal(size=n)
    x[50, 1] = np.nan
    rows = [("s", datetime(2024, 1, 1) + timedelta(hours=i), float(a), None if np.isnan(b) else float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))]
    rows += [("short", r[1], *r[2:]) for r in rows[:80]]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, a double, b double, y double")
    how = G.Recurrent(length=4, hidden=8, epochs=60, batch=16, rate=1e-2, patience=15)
    found = G.walk_forward(df, ["symbol"], "ts", ["a", "b"], "y", 800, 150, 3, how).toPandas().sort_values("ts")
    assert len(found) == 300 and sorted(found.fold.unique()) == [0, 1] and found.prediction.notna().all()
    assert np.corrcoef(found.prediction, y[800:])[0, 1] > 0.8
    again = G.walk_forward(df, ["symbol"], "ts", ["a", "b"], "y", 800, 150, 3, how).toPandas().sort_values("ts")
    assert np.allclose(found.prediction, again.prediction)
