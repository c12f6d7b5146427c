"""Linear recurrences over one long key in many tasks: y = a * y before + b.

Such steps compose: a block of rows is one step (a, b) too.  First every block is reduced to
its step; then the few steps of a key, one row a block, give the value before each block; then
all blocks run again from there.  Both passes over the rows deal them by key and block, so a key
with many rows is spread over as many tasks as it has blocks, and no block waits for another.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.operators.scan import NAN, Kernel, ordered_scan


def _step(y: float, a: float, b: float) -> float:
    """One row; a missing step leaves y as it is, and a step with a = 0 starts it anew."""
    if math.isnan(a) or math.isnan(b):
        return y
    return b if a == 0 else a * y + b


def _from(before: str) -> Kernel:
    """The recurrence from a column that holds the value before the first row."""
    y, begun = NAN, False

    def step(a: float, b: float, start: float) -> float:
        nonlocal y, begun
        if not begun:
            y, begun = start, True
        y = _step(y, a, b)
        return y

    return step


def _slope() -> Kernel:
    """Product of the steps' slopes so far."""
    made = 1.0

    def step(a: float, b: float) -> float:
        nonlocal made
        if not (math.isnan(a) or math.isnan(b)):
            made = 0.0 if a == 0 else made * a
        return made

    return step


def _offset() -> Kernel:
    """The recurrence from 0."""
    y = 0.0

    def step(a: float, b: float) -> float:
        nonlocal y
        y = _step(y, a, b)
        return y

    return step


def _carry() -> Kernel:
    """The value before each block, from the steps of the blocks before it."""
    y = NAN

    def step(a: float, b: float) -> float:
        nonlocal y
        before, y = y, _step(y, a, b)
        return before

    return step


def affine_scan(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], a: Column, b: Column, into: str) -> DataFrame:
    """``df`` with ``into``: y = a * y + b in order, NULL until a step with a = 0 sets it.

    ``block`` cuts a key into pieces that follow one another in its order, such as days; a NULL
    step leaves y as it was.
    """
    part = [*keys, block]
    rows = df.withColumns({"_a": a, "_b": b})
    within = Window.partitionBy(*part).orderBy(*(F.col(c).desc() for c in order))
    steps = ordered_scan(rows.select(*part, *order, "_a", "_b"), part, order, {"_slope": (_slope, ["_a", "_b"]), "_offset": (_offset, ["_a", "_b"])})
    last = steps.withColumn("_k", F.row_number().over(within)).where("_k = 1").select(*part, "_slope", "_offset")
    starts = ordered_scan(last, keys, [block], {"_start": (_carry, ["_slope", "_offset"])}).select(*(F.col(c).alias(f"_at_{c}") for c in part), "_start")
    joined = rows.join(starts, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in part]).drop(*(f"_at_{c}" for c in part))
    return ordered_scan(joined, part, order, {into: (lambda: _from("_start"), ["_a", "_b", "_start"])}).drop("_a", "_b", "_start")


def _count_so_far(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], x: str) -> DataFrame:
    """``df`` with _n and _sum: number and sum of the values of ``x`` at or before each row of its key."""
    part = [*keys, block]
    blocks = df.groupBy(*(F.col(c).alias(f"_at_{c}") for c in part)).agg(F.count(x).alias("_c"), F.sum(x).alias("_s"))
    before = Window.partitionBy(*(f"_at_{c}" for c in keys)).orderBy(f"_at_{block}").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({"_c": F.coalesce(F.sum("_c").over(before), F.lit(0)), "_s": F.coalesce(F.sum("_s").over(before), F.lit(0.0))})
    own = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    made = df.join(blocks, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in part]).drop(*(f"_at_{c}" for c in part))
    return made.withColumns({"_n": F.col("_c") + F.count(x).over(own), "_sum": F.col("_s") + F.coalesce(F.sum(x).over(own), F.lit(0.0))}).drop("_c", "_s")


def block_ema(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], x: str, alpha: float, into: str) -> DataFrame:
    """Exponential mean from the first value on; gaps are passed over.  Equal to ``scan.ema``."""
    return block_wilder(df, keys, block, order, x, 1, into, alpha)


def block_wilder(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], x: str, n: int, into: str, alpha: float | None = None) -> DataFrame:
    """Exponential mean (1 / n) that starts as the plain mean of the first n values.  Equal to ``scan.wilder``."""
    alpha = 1 / n if alpha is None else alpha
    value = F.col("_x")
    made = df.withColumn("_x", F.col(x).cast("double")).withColumn("_x", F.when(~F.isnan("_x"), value))
    made = _count_so_far(made, keys, block, order, "_x")
    there = value.isNotNull()
    a = F.when(there & (F.col("_n") == n), 0.0).when(there & (F.col("_n") > n), 1 - alpha)
    b = F.when(F.col("_n") == n, F.col("_sum") / n).when(F.col("_n") > n, alpha * value)
    return affine_scan(made, keys, block, order, a, b, into).drop("_x", "_n", "_sum")
