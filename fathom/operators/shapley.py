"""Path-dependent Shapley values of boosted trees, as expressions over a table of leaves.

A tree without knowledge of some features follows both children of a split on them, weighted by
their covers.  What a leaf then gives is its value times one factor per feature of its path:
1 or 0 for a known feature, as the row takes the path or not, and the product of its cover
shares for an unknown one.  So a leaf's Shapley values are sums over the subsets of its own few
features, by size, and those of a row are the sums over all leaves.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import factorial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions.windows import Series
from fathom.operators.boosting import Boosting, Forest, Tree, as_features, grow

_PATH = "array<struct<feature: int, low: double, high: double, missing: boolean, ratio: double>>"


def _paths(tree: Tree, cuts: Sequence[np.ndarray], node: int = 0, path: dict[int, tuple] | None = None):
    """(value, path) of every leaf: per feature the interval that leads there, what missing does, the share of cover."""
    path = path or {}
    if tree.feature[node] < 0:
        yield float(tree.weight[node]), path
        return
    j, cut = int(tree.feature[node]), float(cuts[tree.feature[node]][tree.bin[node] - 1])
    for child, left in ((2 * node + 1, True), (2 * node + 2, False)):
        low, high, missing, ratio = path.get(j, (-np.inf, np.inf, True, 1.0))
        own = (low, min(high, cut)) if left else (max(low, cut), high)
        yield from _paths(tree, cuts, child, path | {j: (*own, missing and bool(tree.missing_left[node]) == left, ratio * tree.cover[child] / tree.cover[node])})


def leaf_table(spark: SparkSession, forests: Mapping[int, Forest]) -> DataFrame:
    """(fold, tree, value, path) of all leaves that hang below a split."""
    rows = []
    for fold, forest in forests.items():
        for k, tree in enumerate(forest.trees):
            for value, path in _paths(tree, forest.cuts):
                if path:
                    rows.append((fold, k, value, [(j, float(a), float(b), m, float(r)) for j, (a, b, m, r) in sorted(path.items())]))
    return spark.createDataFrame(rows, f"fold int, tree int, value double, path {_PATH}")


def _known(x: Column, step: Column) -> Column:
    """1 if the row takes this feature's part of the path, else 0."""
    value = F.element_at(x, step["feature"] + 1)
    there = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(there, (value > step["low"]) & (value <= step["high"])).otherwise(step["missing"]).cast("double")


def _by_size(path: Column, but: Column) -> Column:
    """Sums of the products over the subsets of a path without one feature, by size of the subset."""
    one = F.array(F.lit(1.0))

    def add(sums: Column, step: Column) -> Column:
        more = F.transform(F.concat(sums, F.array(F.lit(0.0))), lambda s, i: s * step["ratio"] + F.when(i > 0, F.get(sums, i - 1)).otherwise(0.0) * step["known"])
        return F.when(step["feature"] == but, sums).otherwise(more)

    return F.aggregate(path, one, add)


def tree_shapley(rows: DataFrame, leaves: DataFrame, depth: int) -> DataFrame:
    """(fold, id, feature, phi) of every row (fold, id, x) and feature on a path of its fold's trees.

    ``leaves`` grow with folds, trees and leaves, not with the rows; every row meets those of its
    fold, and its values are summed before they leave the task.
    """
    met = rows.select("fold", "id", F.col("x").cast("array<double>").alias("x")).join(leaves, "fold")
    met = met.withColumn("path", F.transform("path", lambda s: F.struct(s["feature"].alias("feature"), s["ratio"].alias("ratio"), _known(F.col("x"), s).alias("known"))))
    # A subset of size s of the m - 1 other features weighs s! (m - 1 - s)! / m!.
    weights = F.array(*(F.array(*(F.lit(factorial(s) * factorial(m - 1 - s) / factorial(m)) for s in range(m))) for m in range(1, depth + 1)))

    def share(step: Column) -> Column:
        sums = F.zip_with(_by_size(F.col("path"), step["feature"]), F.element_at(weights, F.size("path")), lambda a, b: a * b)
        return F.struct(step["feature"].alias("feature"), (F.col("value") * (step["known"] - step["ratio"]) * F.aggregate(sums, F.lit(0.0), lambda a, b: a + b)).alias("phi"))

    each = met.select("fold", "id", F.explode(F.transform("path", share)).alias("s"))
    return each.groupBy("fold", "id", F.col("s.feature").alias("feature")).agg(F.sum("s.phi").alias("phi"))


def persistent_factors(rows: DataFrame, keys: Sequence[str], order: str, factors: Sequence[str], label: str, how: Boosting, folds: int = 5, ahead: int = 3, top: int = 10, least: int = 2, must: Sequence[str] = (), most: int = 30, least_train: int = 200) -> DataFrame:
    """Factors that are among the ``top`` by mean absolute Shapley value in ``least`` folds or more.

    A series is cut into ``folds`` pieces; trees are grown on all pieces before one and explain
    that one, ``ahead`` rows late.  Series count in a fold with ``least_train`` rows before it.
    Missing factors and labels are 0.  Columns: factor, appear_folds, is_must; ``must`` are kept
    always, and at most ``most`` factors in all.
    """
    filled = rows.select(*keys, order, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in (*factors, label)))
    made = as_features(filled, [*keys, order], factors).withColumn("rn", Series(tuple(keys), (order,)).rn())
    total = F.count("*").over(Window.partitionBy(*keys))
    made = made.withColumn("_size", F.floor(total / folds)).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds - 1))))
    made = made.withColumn("_end", F.col("fold") * F.col("_size")).where(F.col("_end") >= least_train)
    forests = grow(made.where("rn < _end").select("fold", "name", F.col(label).alias("y"), "x"), len(factors), how)
    start = F.col("_end") + ahead
    asked = made.where((F.col("rn") >= start) & (F.col("rn") < start + F.col("_size"))).select("fold", F.struct(*keys, order).alias("id"), "x")
    each = tree_shapley(asked, leaf_table(rows.sparkSession, forests), how.depth)
    # Rows in which a feature is on no path count as 0: every row of a fold meets the same paths.
    size = each.groupBy("fold", "feature").agg(F.avg(F.abs("phi")).alias("size"))
    place = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc(F.round("size", 12)), "feature"))
    names = F.array(*map(F.lit, factors))
    seen = size.withColumn("place", place).where(F.col("place") <= top).groupBy(F.element_at(names, F.col("feature") + 1).alias("factor")).agg(F.count("*").cast("int").alias("appear_folds"))
    every = rows.sparkSession.createDataFrame([(f, f in set(must)) for f in factors], "factor string, is_must boolean")
    kept = every.join(seen, "factor", "left").withColumn("appear_folds", F.coalesce("appear_folds", F.lit(0))).where(F.col("is_must") | (F.col("appear_folds") >= least))
    ranked = F.row_number().over(Window.orderBy(F.desc("is_must"), F.desc("appear_folds"), "factor"))
    return kept.withColumn("_k", ranked).where(F.col("_k") <= most).select("factor", "appear_folds", "is_must")
