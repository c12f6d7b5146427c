import time

import numpy as np
import pandas as pd
import pytest

from fathom.operators import scan as X


def run(make, *columns):
    step = make()
    return np.array([step(*row) for row in zip(*(np.asarray(c, float) for c in columns), strict=True)])


def series(n, seed=0, ties=False):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 30, n).astype(float) if ties else np.round(rng.normal(size=n), 3)
    x[rng.random(n) < 0.1] = np.nan
    return pd.Series(x)


@pytest.mark.parametrize("ties", [False, True])
def test_ranks_and_quantiles_equal_pandas(ties):
    for n, least in ((7, 3), (50, 50), (60, 1)):
        x = series(800, n, ties)
        assert np.allclose(run(lambda: X.rolling_rank(n, least), x), x.rolling(n, least).rank(pct=True), equal_nan=True)
        assert np.allclose(run(lambda: X.rolling_rank(n, least, share=False), x), x.rolling(n, least).rank(), equal_nan=True)
        for q in (0.0, 0.3, 0.7, 1.0):
            assert np.allclose(run(lambda: X.rolling_quantile(n, q, least), x), x.rolling(n, least).quantile(q), equal_nan=True)
    for q in (0.0, 0.25, 0.7, 1.0):
        assert np.allclose(run(lambda: X.expanding_quantile(q), x), x.expanding(1).quantile(q), equal_nan=True)


def test_long_windows_in_good_time():
    x = series(60_000, 1)
    began = time.perf_counter()
    ranks, quantiles, grown = run(lambda: X.rolling_rank(5000, 100), x), run(lambda: X.rolling_quantile(5000, 0.7, 100), x), run(lambda: X.expanding_quantile(0.7), x)
    assert time.perf_counter() - began < 15
    assert np.allclose(ranks, x.rolling(5000, 100).rank(pct=True), equal_nan=True) and np.allclose(quantiles, x.rolling(5000, 100).quantile(0.7), equal_nan=True)
    assert np.allclose(grown, x.expanding(1).quantile(0.7), equal_nan=True)


def spearman(x, y, n):
    out = np.full(len(x), np.nan)
    for i in range(n, len(x)):
        a, b = x[i - n : i], y[i - n : i]
        if not np.isnan(a).any() and not np.isnan(b).any():
            d = np.argsort(np.argsort(a, kind="stable")) - np.argsort(np.argsort(b, kind="stable"))
            out[i] = 1 - 6.0 * (d @ d) / (n * (n * n - 1))
    return out


def test_strict_correlation_equals_its_definition():
    for n in (2, 5, 30):
        for ties in (False, True):
            x, y = series(400, 3, ties), series(400, 4, ties)
            x[x.isna() & (np.arange(400) % 4 > 0)] = 1.0
            y = y.fillna(2.0)
            found = run(lambda: X.rolling_spearman(n), x, y)
            assert np.allclose(found, spearman(x.to_numpy(), y.to_numpy(), n), equal_nan=True) and (n == 30 or (~np.isnan(found)).sum() > 100)
    x, y = np.random.default_rng(0).normal(size=(2, 12_000))
    began = time.perf_counter()
    found = run(lambda: X.rolling_spearman(5000), x, y)
    assert time.perf_counter() - began < 20
    assert np.allclose(found[[5000, 9000, 11_999]], [spearman(x[i - 5000 : i + 1], y[i - 5000 : i + 1], 5000)[-1] for i in (5000, 9000, 11_999)])
