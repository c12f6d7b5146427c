"""Walk-forward least squares from sums of products: expanding windows, and grids of them in one job.

A row belongs to the training rows of a run of folds, so it is added to the first of them and, in
rolling mode, taken off after the last.  Tasks add up the products of their rows by fold; a
running sum over the folds of a key is then the matrix of each fold.  So a fold costs k x k
numbers, however long its window, and all folds of all settings read the rows once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from fathom.functions.windows import Series, finite

#: Numbers that a task holds before it hands its sums on.
HELD = 4_000_000


def _products(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, gram): sums of products of ``row`` (array) with itself, times ``sign``; one row a group and task or more."""
    names = list(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def told() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in held], kinds[i]) for i in range(len(names))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([g.ravel().tolist() for g in held.values()], pa.list_(pa.float64()))], [*names, "gram"])

        kinds: list[pa.DataType] = []
        for batch in batches:
            if not len(batch):
                continue
            kinds = [batch.schema.field(c).type for c in names]
            x = batch.column("row").flatten().to_numpy().reshape(len(batch), -1)
            signed = x * batch.column("sign").to_numpy()[:, None]
            groups = pa.table([batch.column(c) for c in names], names=names).to_pandas().groupby(names, dropna=False, sort=False).indices
            keys = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
            for own in groups.values():
                key = keys[own[0]]
                gram = signed[own].T @ x[own]
                held[key] = held[key] + gram if key in held else gram
            if sum(g.size for g in held.values()) > HELD:
                yield told()
                held = {}
        if held:
            yield told()

    return rows.mapInArrow(run, rows.select(*names).schema.add("gram", ArrayType(DoubleType())))


def solved(gram: np.ndarray, ridge: float) -> np.ndarray:
    """Intercept and slopes from the products of (1, factors, label); the ridge holds the slopes only."""
    a = gram[:-1, :-1].copy()
    a[1:, 1:] += ridge * np.eye(len(a) - 1)
    try:
        return np.linalg.solve(a, gram[:-1, -1])
    except np.linalg.LinAlgError:
        return np.linalg.pinv(a) @ gram[:-1, -1]


def walk_forward_grid(rows: DataFrame, keys: Sequence[str], order: str, factors: Sequence[str], label: str, grid: Sequence[tuple[int, int]], ahead: int, ridges: Sequence[float] = (1e-8,), rolling: bool = True, least: int = 50) -> DataFrame:
    """Predictions of every setting (train, every) and ridge: train, every, ridge, keys, order, fold, prediction.

    Folds are those of ``walk_forward_folds``; rows with a missing factor or label are not
    trained on, and rows with a missing factor, or of a fold of fewer than ``least`` complete
    training rows, have no prediction.
    """
    values = F.array(F.lit(1.0), *(finite(f) for f in (*factors, label)))
    numbered = rows.select(*keys, order, values.alias("row")).withColumn("rn", Series(tuple(keys), (order,)).rn())
    numbered = numbered.withColumn("total", F.count("*").over(Window.partitionBy(*keys)))
    steps: list[Column] = []
    asked: list[Column] = []
    for g, (train, every) in enumerate(grid):
        begin, folds = train - ahead - 5, F.ceil((F.col("total") - train) / every)
        first = F.greatest(F.lit(0), F.floor((F.col("rn") - begin) / every) + 1)
        ends = [(first, 1.0)]
        if rolling:
            after = F.floor((F.col("rn") + train - begin) / every) + 1
            ends.append((F.when(after >= first, F.greatest(after, F.lit(0))), -1.0))
        steps += [F.when((F.col("total") > train) & (k < folds), F.struct(F.lit(g).alias("g"), k.cast("int").alias("fold"), F.lit(s).alias("sign"))) for k, s in ends]
        own = F.floor((F.col("rn") - train) / every).cast("int")
        asked.append(F.when(F.col("rn") >= train, F.struct(F.lit(g).alias("g"), F.lit(train).alias("train"), F.lit(every).alias("every"), own.alias("fold"))))
    known = numbered.where(F.forall("row", lambda v: v.isNotNull()))
    each = known.withColumn("s", F.explode(F.filter(F.array(*steps), lambda s: s.isNotNull()))).select(*keys, "s.*", "row")
    sums = _products(each, [*keys, "g", "fold"])
    size = len(factors) + 2
    fits = numbered.select(*keys, "total").distinct()
    schema = ", ".join(f"{c} {kind}" for c, kind in rows.select(*keys).dtypes) + ", g int, fold int, ridge double, beta array<double>"
    names = list(keys)

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        """All folds of one key and setting, from their sums in order."""
        train, every = grid[int(group.g.iloc[0])]
        gram, out = np.zeros((size, size)), []
        by_fold = {int(k): sum(np.asarray(v).reshape(size, size) for v in own) for k, own in group.groupby("fold").gram}
        for k in range(-(-(int(group.total.iloc[0]) - train) // every)):
            gram = gram + by_fold.get(k, 0.0)
            if gram[0, 0] >= least - 0.5:
                out += [(*(group[c].iloc[0] for c in names), int(group.g.iloc[0]), k, r, solved(gram, r).tolist()) for r in ridges]
        return pd.DataFrame(out, columns=[*names, "g", "fold", "ridge", "beta"])

    beta = sums.join(fits, names).groupBy(*names, "g").applyInPandas(solve, schema)
    wanted = numbered.withColumn("a", F.explode(F.filter(F.array(*asked), lambda s: s.isNotNull()))).select(*keys, order, "a.*", "row")
    wanted = wanted.withColumn("ridge", F.explode(F.array(*(F.lit(float(r)) for r in ridges))))
    made = wanted.join(beta, [*names, "g", "fold", "ridge"], "left")
    product = F.zip_with(F.slice("row", 1, len(factors) + 1), "beta", lambda x, b: x * b)
    prediction = F.aggregate(product, F.lit(0.0), lambda s, v: s + v)
    return made.select("train", "every", "ridge", *keys, order, "fold", prediction.alias("prediction"))
