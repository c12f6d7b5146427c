"""Labels, folds and walk-forward fits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.windows import Series, ratio


def forward_return(series: Series, price: str, ahead: int, check: int = 0, factor: float = 2.0, points: bool = False) -> Column:
    """Change of price ``ahead`` rows on, replaced by the first of the next ``check`` rows' that
    reverses its sign and is more than ``factor`` times as large.  ``points``: not divided."""

    def change(k: int) -> Column:
        moved = series.lead(price, k) - F.col(price)
        return moved if points else ratio(moved, price)

    base = change(ahead)
    turns = [F.when((F.signum(change(ahead + k)) == -F.signum(base)) & (F.signum(base) != 0) & (F.abs(change(ahead + k)) > factor * F.abs(base)), change(ahead + k)) for k in range(1, check + 1)]
    return F.when(base.isNotNull(), F.coalesce(*turns, base))


def forward_sum(series: Series, returns: str, ahead: int) -> Column:
    """Sum of the next ``ahead`` returns, NULL where one is missing."""
    frame = series.w.rowsBetween(1, ahead)
    return F.when(F.count(returns).over(frame) >= ahead, F.sum(returns).over(frame))


def purged_fold(rn: Column, total: Column, folds: int, purge: int) -> Column:
    """Fold number of a row, NULL for the first ``purge`` rows of every fold."""
    size = F.floor(total / folds)
    fold = F.least(F.floor(rn / size), F.lit(folds - 1))
    return F.when(rn - fold * size >= purge, fold)


def walk_forward_folds(rows: DataFrame, keys: Sequence[str], train: int, every: int, ahead: int, rolling: bool = True) -> DataFrame:
    """One row per fold: its key, fold number, training rows [first, last) and rows to predict [begin, end).

    A fold is refitted at ``train``, ``train + every`` ...; training ends ``ahead + 5`` rows
    before, so that no label reaches into what is predicted.
    """
    totals = rows.groupBy(*keys).agg((F.max("rn") + 1).alias("total")).where(F.col("total") > train)
    each = totals.withColumn("begin", F.explode(F.sequence(F.lit(train).cast("long"), F.col("total").cast("long") - 1, F.lit(every).cast("long"))))
    last = F.col("begin") - ahead - 5
    return each.select(
        *keys,
        ((F.col("begin") - train) / every).cast("int").alias("fold"),
        (F.greatest(last - train, F.lit(0)) if rolling else F.lit(0)).cast("long").alias("first"),
        last.alias("last"),
        "begin",
        F.least(F.col("begin") + every, F.col("total")).alias("end"),
    )


def least_squares(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, ridge: float = 1e-8) -> np.ndarray:
    """Intercept and slopes; the ridge holds the slopes only."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.ones(len(x)) if weights is None else weights
    gram = (a * w[:, None]).T @ a
    gram[1:, 1:] += ridge * np.eye(x.shape[1])
    try:
        return np.linalg.solve(gram, (a * w[:, None]).T @ y)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(gram) @ ((a * w[:, None]).T @ y)


def park_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights from a fit of log squared residuals on the factors."""
    off = y - np.column_stack([np.ones(len(x)), x]) @ least_squares(x, y)
    line = least_squares(x, np.log(off**2 + 1e-12))
    return 1 / np.sqrt(np.exp(np.clip(np.column_stack([np.ones(len(x)), x]) @ line, -50, 50)))


def rolling_weights(x: np.ndarray, y: np.ndarray, window: int = 100) -> np.ndarray:
    """One over the rolling deviation of residuals; expanding, then overall, where it is too short."""
    off = pd.Series(y - np.column_stack([np.ones(len(x)), x]) @ least_squares(x, y))
    spread = off.rolling(window, min_periods=max(5, window // 4)).std()
    spread = spread.fillna(off.expanding(5).std()).fillna(off.std()).to_numpy()
    return 1 / np.maximum(spread, 1e-8)


def ewma_weights(x: np.ndarray, y: np.ndarray, halflife: float = 50) -> np.ndarray:
    off = pd.Series(y - np.column_stack([np.ones(len(x)), x]) @ least_squares(x, y))
    spread = np.sqrt((off**2).ewm(halflife=halflife, min_periods=5).mean()).bfill().to_numpy()
    weights = 1 / np.maximum(spread, 1e-8)
    return np.clip(weights, *np.quantile(weights, [0.01, 0.99]))


def ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> np.ndarray:
    return least_squares(x, y, None, alpha)


def elastic_net(x: np.ndarray, y: np.ndarray, alpha: float, l1_ratio: float = 1.0, rounds: int = 500, tolerance: float = 1e-8) -> np.ndarray:
    """Coordinate descent on half the mean squared error plus the mixed penalty (lasso at 1)."""
    centre, level = x.mean(0), y.mean()
    a, off = x - centre, y - level
    size = (a**2).mean(0)
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        moved = 0.0
        for j in np.flatnonzero(size):
            old = beta[j]
            pull = a[:, j] @ off / len(x) + size[j] * old
            beta[j] = np.sign(pull) * max(abs(pull) - alpha * l1_ratio, 0) / (size[j] + alpha * (1 - l1_ratio))
            if beta[j] != old:
                off -= a[:, j] * (beta[j] - old)
                moved = max(moved, abs(beta[j] - old))
        if moved < tolerance:
            break
    return np.r_[level - centre @ beta, beta]


def partial_least_squares(x: np.ndarray, y: np.ndarray, parts: int = 1) -> np.ndarray:
    """One-response PLS by successive deflation."""
    centre, level = x.mean(0), y.mean()
    a, b = x - centre, y - level
    w, p, q = [], [], []
    for _ in range(min(parts, x.shape[1])):
        direction = a.T @ b
        norm = np.linalg.norm(direction)
        if norm < 1e-12:
            break
        direction /= norm
        score = a @ direction
        size = score @ score
        load = a.T @ score / size
        w.append(direction), p.append(load), q.append(b @ score / size)
        a = a - np.outer(score, load)
        b = b - score * q[-1]
    if not w:
        return np.r_[level, np.zeros(x.shape[1])]
    w, p = np.array(w).T, np.array(p).T
    beta = w @ np.linalg.solve(p.T @ w, np.array(q))
    return np.r_[level - centre @ beta, beta]


MODELS = {
    "ols": lambda x, y: least_squares(x, y),
    "park": lambda x, y: least_squares(x, y, park_weights(x, y)),
    "rolling": lambda x, y: least_squares(x, y, rolling_weights(x, y)),
    "ewma": lambda x, y: least_squares(x, y, ewma_weights(x, y)),
    "ridge": lambda x, y: ridge(x, y, 1.0),
    "lasso": lambda x, y: elastic_net(x, y, 1e-4),
    "elastic": lambda x, y: elastic_net(x, y, 1e-4, 0.5),
    "pls": lambda x, y: partial_least_squares(x, y, 1),
}


def scaled(x: np.ndarray, low: float = 0.1, high: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
    """Median and quantile range of each column (1 where the range is 0)."""
    middle = np.median(x, axis=0)
    reach = np.quantile(x, high, axis=0) - np.quantile(x, low, axis=0)
    return middle, np.where(reach > 0, reach, 1.0)


def walk_forward(rows: DataFrame, keys: Sequence[str], order: str, factors: Sequence[str], label: str, train: int, every: int, ahead: int, model: str = "ols", rolling: bool = True, scale: bool = True, least: int = 50) -> DataFrame:
    """Out-of-sample prediction of each row from the last refit before it.

    Every fold is a group of its own: its training rows and the rows that it predicts, a
    number bounded by ``train`` + ``every`` in rolling mode.  Folds run in parallel.
    """
    numbered = rows.withColumn("rn", Series(tuple(keys), (order,)).rn())
    folds = walk_forward_folds(numbered, keys, train, every, ahead, rolling)
    inside = (F.col("rn") >= F.col("first")) & (F.col("rn") < F.col("end"))
    dealt = numbered.select(*keys, order, "rn", *factors, label).join(folds, list(keys)).where(inside & ((F.col("rn") < F.col("last")) | (F.col("rn") >= F.col("begin"))))
    schema = ", ".join(f"{c} {kind}" for c, kind in dealt.select(*keys, order, "fold").dtypes) + ", prediction double"
    names, fit = list(factors), MODELS[model]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rn")
        known = group[group.rn < group["last"]].dropna(subset=[*names, label])
        ahead_rows = group[group.rn >= group.begin]
        out = ahead_rows[[*keys, order, "fold"]].assign(prediction=np.nan)
        if len(known) >= least:
            x, y = known[names].to_numpy(float), known[label].to_numpy(float)
            middle, reach = scaled(x) if scale else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
            beta = fit((x - middle) / reach, y)
            out["prediction"] = beta[0] + ((ahead_rows[names].to_numpy(float) - middle) / reach) @ beta[1:]
        return out

    found = dealt.groupBy(*keys, "fold").applyInPandas(run, schema)
    return found.withColumn("prediction", F.when(~F.isnan("prediction"), F.col("prediction")))


def coefficients(rows: DataFrame, factors: Sequence[str], label: str) -> dict[str, float]:
    """Slopes of one linear fit over all complete rows, from sums of centred products.

    Only a matrix of the size of ``factors`` reaches the driver.
    """
    names = [*factors, label]
    full = rows.dropna(subset=names)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = full.agg(*(F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    moments = np.array([[sums[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(names))] for i in range(len(names))])
    return dict(zip(factors, np.linalg.lstsq(moments[:-1, :-1], moments[:-1, -1], rcond=None)[0].tolist(), strict=True))


def sequences(rows: DataFrame, series: Series, factors: Sequence[str], length: int) -> DataFrame:
    """The last ``length`` factor rows of each row as an array of arrays, once there are so many."""
    frame = series.last_n(length)
    seen = F.collect_list(F.array(*factors)).over(frame)
    return rows.withColumn("sequence", seen).where(F.size("sequence") >= length)


