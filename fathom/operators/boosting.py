"""Penalised second-order boosted trees, grown level by level from histograms.

All folds of a walk-forward grow together.  One level of one tree is one job: every task sums
gradients and hessians of its rows by (fold, node, feature, bin), the sums are added up in one
shuffle, running sums over the bins give the gain of every split, and only the best split of
each node reaches the driver.  Rows are dealt by no key, so folds of any length share the tasks,
and no task holds more than its batch and its histograms.

Sums are integers (gradients in fixed point), so trees do not depend on how rows are dealt.
Columns are drawn per tree by a seeded generator, rows by a hash of their key.  Rows keep their
margin in a written table that is renewed every ``KEPT`` trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.windows import Series, finite
from fathom.operators.labels import walk_forward_folds
from fathom.operators.quantiles import written

#: Trees after which rows' margins are written anew.
KEPT = 20
#: Histograms that a task holds before it hands them on.
HELD = 4_000_000
#: Least gain of a split.
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Boosting:
    """Settings; the defaults are those of the survey (fixed values).

    ``rows`` and ``columns``: shares drawn for each tree.  ``min_child``: least hessian of a
    child.  ``alpha`` and ``ridge``: absolute and squared penalty of leaf weights.  ``bins``: at
    most 255.  ``loss``: "squared", or "logistic" for labels 0 and 1 (predictions are log odds).
    """

    trees: int = 300
    depth: int = 3
    rate: float = 0.03
    rows: float = 0.7
    columns: float = 0.5
    min_child: float = 20.0
    alpha: float = 1.0
    ridge: float = 8.0
    bins: int = 64
    seed: int = 42
    loss: str = "squared"


class Tree(NamedTuple):
    """Nodes in heap order; node i has the children 2 i + 1 and 2 i + 2, a leaf the feature -1."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    weight: np.ndarray
    gain: np.ndarray
    cover: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n), np.zeros(n), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row of bins (0: missing) ends in."""
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(int(math.log2(len(self.feature) + 1)) - 1):
            split = self.feature[node]
            own = bins[rows, np.maximum(split, 0)]
            left = np.where(own == 0, self.missing_left[node], own <= self.bin[node])
            node = np.where(split >= 0, 2 * node + 2 - left, node)
        return node


@dataclass
class Forest:
    """Trees of one fold.  ``cuts``: upper ends of the bins of each feature but the last."""

    base: float
    scale: float
    cuts: list[np.ndarray]
    allowed: np.ndarray
    trees: list[Tree] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape, np.uint8)
        for j, cuts in enumerate(self.cuts):
            out[:, j] = np.where(np.isfinite(x[:, j]), np.searchsorted(cuts, x[:, j], "left") + 1, 0)
        return out

    def margin(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        """Sum of the weights of the trees from ``first`` on."""
        out = np.zeros(len(bins))
        for tree in self.trees[first:]:
            out += tree.weight[tree.nodes(bins)]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.margin(self.binned(x))

    def importance(self) -> np.ndarray:
        """Mean gain of the splits on each feature, as shares of their sum."""
        gain, splits = np.zeros(len(self.cuts)), np.zeros(len(self.cuts))
        for tree in self.trees:
            own = tree.feature >= 0
            np.add.at(gain, tree.feature[own], tree.gain[own])
            np.add.at(splits, tree.feature[own], 1)
        mean = np.divide(gain, splits, out=np.zeros_like(gain), where=splits > 0)
        return mean / mean.sum() if mean.sum() else mean


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn_rows(name: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """Which rows, by the hash of their key, a tree is grown on."""
    if share >= 1:
        return np.ones(len(name), bool)
    mixed = _mixed(name.view(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) % (1 << 62)))
    return (mixed >> np.uint64(11)).astype(np.float64) < share * 2.0**53


def drawn_columns(allowed: np.ndarray, seed: int, fold: int, tree: int, share: float) -> np.ndarray:
    """Features that a tree may split on."""
    own = np.flatnonzero(allowed)
    return np.sort(np.random.default_rng([seed, fold, tree]).permutation(own)[: max(1, int(share * len(own)))])


def _by_fold(fold: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(fold, kind="stable")
    edge = np.flatnonzero(np.diff(fold[order], prepend=-1))
    for a, b in zip(edge, [*edge[1:], len(order)], strict=True):
        yield int(fold[order[a]]), order[a:b]


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(rows, -1)


def _slopes(margin: np.ndarray, y: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss."""
    if loss == "squared":
        return margin - y, np.ones(len(y))
    share = 1 / (1 + np.exp(-margin))
    return share - y, share * (1 - share)


_SUMS = "fold int, node int, feature int, bin int, g long, h long"


def _histograms(rows: DataFrame, forests: Mapping[int, Forest], growing: Mapping[int, tuple[Tree, np.ndarray]], level: int, number: int, first: int, how: Boosting) -> DataFrame:
    """Sums of gradients and hessians by fold, node of ``level``, feature and bin."""
    sent = rows.sparkSession.sparkContext.broadcast((dict(forests), dict(growing)))
    width = how.bins + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests, growing = sent.value
        held: dict[int, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for fold, sums in held.items():
                node, at, bin_ = np.nonzero(sums[1])
                columns = [np.full(len(node), fold), node + 2**level - 1, growing[fold][1][at], bin_]
                yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), *(pa.array(s[node, at, bin_]) for s in sums)], [c.split()[0] for c in _SUMS.split(", ")])

        for batch in batches:
            folds, name, y, margin = (batch.column(k).to_numpy() for k in ("fold", "name", "y", "margin"))
            for fold, own in _by_fold(folds):
                if fold not in growing:
                    continue
                own = own[drawn_rows(name[own], how.seed, number, how.rows)]
                bins = _matrix(batch.column("bins").take(pa.array(own)), len(own)) if len(own) else np.zeros((0, 1), np.uint8)
                tree, columns = growing[fold]
                node = tree.nodes(bins) - (2**level - 1) if len(own) else own
                bins, own, node = bins[node >= 0], own[node >= 0], node[node >= 0]
                if not len(own):
                    continue
                g, h = _slopes(margin[own] + forests[fold].margin(bins, first), y[own], how.loss)
                g, h = np.rint(g * forests[fold].scale), np.rint(h * 2.0**20)
                if fold not in held:
                    held[fold] = np.zeros((2, 2**level, len(columns), width), np.int64)
                for at, j in enumerate(columns.tolist()):
                    for sums, value in zip(held[fold], (g, h), strict=True):
                        sums[:, at] += np.bincount(node * width + bins[:, j], value, 2**level * width).reshape(-1, width).astype(np.int64)
            if sum(s.size for s in held.values()) > HELD:
                yield from told()
                held = {}
        yield from told()

    return rows.mapInArrow(add, _SUMS).groupBy("fold", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def shrunk(g: Column, alpha: float) -> Column:
    """Sum of gradients less the absolute penalty."""
    return F.signum(g) * F.greatest(F.abs(g) - alpha, F.lit(0.0))


def best_splits(sums: DataFrame, scales: DataFrame, how: Boosting) -> DataFrame:
    """The split of each node that gains most; of equal ones that of the first feature, then bin, missing to the right.

    ``sums``: fold, node, feature, bin (0: missing), g, h; ``scales``: fold, scale.  A node whose
    every split is ruled out has its sums alone.
    """
    each = sums.join(F.broadcast(scales), "fold").withColumns({"g": F.col("g") / F.col("scale"), "h": F.col("h") / 2.0**20})
    own = Window.partitionBy("fold", "node", "feature")
    so_far = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    there = lambda c: F.when(F.col("bin") > 0, F.col(c)).otherwise(0.0)
    each = each.select(
        "fold", "node", "feature", "bin",
        *(F.sum(there(c)).over(so_far).alias(f"{c}_left") for c in "gh"),
        *(F.sum(F.when(F.col("bin") == 0, F.col(c)).otherwise(0.0)).over(own).alias(f"{c}_gone") for c in "gh"),
        *(F.sum(c).over(own).alias(f"{c}_all") for c in "gh"),
    )
    sides = F.explode(F.array(F.struct(F.lit(False).alias("missing_left"), F.col("g_left").alias("g"), F.col("h_left").alias("h")), F.struct(F.lit(True).alias("missing_left"), (F.col("g_left") + F.col("g_gone")).alias("g"), (F.col("h_left") + F.col("h_gone")).alias("h"))))
    each = each.withColumn("side", sides).where("not side.missing_left or h_gone > 0")
    worth = lambda g, h: shrunk(g, how.alpha) * shrunk(g, how.alpha) / (h + how.ridge)
    g, h = F.col("side.g"), F.col("side.h")
    gain = worth(g, h) + worth(F.col("g_all") - g, F.col("h_all") - h) - worth(F.col("g_all"), F.col("h_all"))
    fits = (F.col("bin") > 0) & (h >= how.min_child) & (F.col("h_all") - h >= how.min_child) & (F.col("h_all") > h) & (h > 0) & (gain > LEAST_GAIN)
    split = F.struct(gain.alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("bin")).alias("bin"), (~F.col("side.missing_left")).alias("missing_right"), g.alias("g"), h.alias("h"))
    return each.groupBy("fold", "node").agg(F.max(F.when(fits, split)).alias("best"), F.max_by("g_all", -F.col("feature")).alias("g_all"), F.max_by("h_all", -F.col("feature")).alias("h_all"))


def _leaf(g: float, h: float, how: Boosting) -> float:
    return -how.rate * math.copysign(max(abs(g) - how.alpha, 0.0), g) / (h + how.ridge)


def bin_cuts(rows: DataFrame, width: int, how: Boosting) -> dict[int, list[np.ndarray]]:
    """Upper ends of the bins per fold and feature: quantiles of ``x`` (array) in ``rows``."""
    shares = F.array(*(F.lit(k / how.bins) for k in range(1, how.bins)))
    found = rows.groupBy("fold").agg(F.array(*(F.percentile_approx(finite(F.col("x")[j]), shares, 20_000) for j in range(width))).alias("cuts")).collect()
    return {r.fold: [np.unique(np.array(c if c is not None else [], float)) for c in r.cuts] for r in found}


def grow(rows: DataFrame, width: int, how: Boosting, cuts: Mapping[int, list[np.ndarray]] | None = None, allowed: Mapping[int, np.ndarray] | None = None, least: int = 50) -> dict[int, Forest]:
    """Forests of all folds of ``rows``: fold, name (hash of the row's key), y, x (array of ``width`` features).

    Missing features are NULL, NaN or infinite.  Folds of fewer than ``least`` rows have none.
    ``cuts`` and ``allowed`` (features) per fold: by default quantiles of the fold, and all.
    """
    rows = rows.select("fold", "name", F.col("y").cast("double").alias("y"), F.col("x").cast("array<double>").alias("x"))
    cuts = bin_cuts(rows, width, how) if cuts is None else cuts
    extent = rows.groupBy("fold").agg(F.count("*").alias("n"), F.max(F.abs("y")).alias("top")).where(F.col("n") >= least).collect()
    scale = {r.fold: 2.0 ** (30 - math.ceil(math.log2(max(r.top, 1.0 if how.loss == "logistic" else 2.0**-40)))) for r in extent}
    if not scale:
        return {}
    scales = rows.sparkSession.createDataFrame(sorted(scale.items()), "fold int, scale double")
    total = rows.join(F.broadcast(scales), "fold").groupBy("fold").agg(F.sum(F.rint(F.col("y") * F.col("scale")).cast("long")).alias("s"), F.count("*").alias("n"))
    mean = {r.fold: r.s / r.n / scale[r.fold] for r in total.collect()}
    base = mean if how.loss == "squared" else {f: math.log(min(max(m, 1e-6), 1 - 1e-6) / (1 - min(max(m, 1e-6), 1 - 1e-6))) for f, m in mean.items()}
    forests = {f: Forest(base[f], scale[f], list(cuts[f]), np.ones(width, bool) if allowed is None else allowed[f]) for f in scale}
    sent = rows.sparkSession.sparkContext.broadcast(dict(forests))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = batch.column("fold").to_numpy()
            bins, margin, known = [b""] * len(batch), np.zeros(len(batch)), np.zeros(len(batch), bool)
            for fold, own in _by_fold(folds):
                if fold in sent.value:
                    x = _values(batch.column("x").take(pa.array(own)), width)
                    for i, row in zip(own.tolist(), sent.value[fold].binned(x), strict=True):
                        bins[i] = row.tobytes()
                    margin[own], known[own] = sent.value[fold].base, True
            out = pa.RecordBatch.from_arrays([batch.column("fold"), batch.column("name"), batch.column("y"), pa.array(margin), pa.array(bins, pa.binary())], ["fold", "name", "y", "margin", "bins"])
            yield out.filter(pa.array(known))

    dealt = written(rows.mapInArrow(binned, "fold int, name long, y double, margin double, bins binary"))
    first = 0
    for number in range(how.trees):
        growing = {f: (Tree.empty(how.depth), drawn_columns(x.allowed, how.seed, f, number, how.columns)) for f, x in forests.items()}
        for level in range(how.depth):
            split = False
            for r in best_splits(_histograms(dealt, forests, growing, level, number, first, how), scales, how).collect():
                tree = growing[r.fold][0]
                tree.weight[r.node], tree.cover[r.node] = _leaf(r.g_all, r.h_all, how), r.h_all
                if r.best is None:
                    continue
                split = True
                left, right = 2 * r.node + 1, 2 * r.node + 2
                tree.feature[r.node], tree.bin[r.node], tree.missing_left[r.node], tree.gain[r.node] = -r.best.feature, -r.best.bin, not r.best.missing_right, r.best.gain
                tree.weight[left], tree.weight[right] = _leaf(r.best.g, r.best.h, how), _leaf(r.g_all - r.best.g, r.h_all - r.best.h, how)
                tree.cover[left], tree.cover[right] = r.best.h, r.h_all - r.best.h
            if not split:
                break
        for f, (tree, _) in growing.items():
            forests[f].trees.append(tree)
        if (number + 1) % KEPT == 0 and number + 1 < how.trees:
            dealt, first = written(_renewed(dealt, forests, first)), number + 1
    return forests


def _renewed(dealt: DataFrame, forests: Mapping[int, Forest], first: int) -> DataFrame:
    """Rows with the trees from ``first`` on added to their margin."""
    sent = dealt.sparkSession.sparkContext.broadcast(dict(forests))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = batch.column("margin").to_numpy().copy()
            for fold, own in _by_fold(batch.column("fold").to_numpy()):
                margin[own] += sent.value[fold].margin(_matrix(batch.column("bins").take(pa.array(own)), len(own)), first)
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margin))

    return dealt.mapInArrow(add, dealt.schema)


def _values(column: pa.Array, width: int) -> np.ndarray:
    return np.array([[np.nan if v is None else v for v in row] for row in column.to_pylist()], float).reshape(len(column), width)


def two_phase(rows: DataFrame, factors: Sequence[str], how: Boosting, top: int = 0, must: Sequence[str] = (), least: int = 50) -> dict[int, Forest]:
    """Forests grown on all features, then on each fold's ``top`` by importance and ``must``; 0: all."""
    forests = grow(rows, len(factors), how, least=least)
    if not 0 < top < len(factors):
        return forests
    allowed = {}
    for f, forest in forests.items():
        ranked = sorted(range(len(factors)), key=lambda j, share=forest.importance(): (-share[j], j))
        allowed[f] = np.isin(np.arange(len(factors)), ranked[:top]) | np.isin(np.array(factors), list(must))
    return grow(rows, len(factors), how, {f: x.cuts for f, x in forests.items()}, allowed, least)


def predict(rows: DataFrame, forests: Mapping[int, Forest], width: int) -> DataFrame:
    """``rows`` (fold, x and others) with the prediction of their fold's forest, NULL without one."""
    sent = rows.sparkSession.sparkContext.broadcast(dict(forests))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, known = np.zeros(len(batch)), np.zeros(len(batch), bool)
            for fold, own in _by_fold(batch.column("fold").to_numpy()):
                if fold in sent.value:
                    out[own], known[own] = sent.value[fold].predict(_values(batch.column("x").take(pa.array(own)), width)), True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, mask=~known)], [*batch.schema.names, "prediction"])

    kinds = rows.schema
    return rows.mapInArrow(run, kinds.fromDDL(kinds.toDDL()).add("prediction", "double"))


def as_features(rows: DataFrame, keys: Sequence[str], factors: Sequence[str]) -> DataFrame:
    """``rows`` with x (array of the factors) and name (hash of the key columns)."""
    return rows.withColumns({"x": F.array(*(F.col(f).cast("double") for f in factors)), "name": F.xxhash64(*(F.col(k).cast("string") for k in keys))})


def walk_forward(rows: DataFrame, keys: Sequence[str], order: str, factors: Sequence[str], label: str, train: int, every: int, ahead: int, how: Boosting, top: int = 0, must: Sequence[str] = (), rolling: bool = True, backfill: bool = False) -> DataFrame:
    """Prediction of each row by the trees refitted last before it: (keys, order, fold, prediction).

    A fold's trees are grown on the training rows of all keys whose label and factors are all
    there; folds grow together, one job a level.  ``backfill``: the rows before the first refit
    are predicted by its trees too.  Rows with a missing factor have no prediction.
    """
    numbered = as_features(rows, [*keys, order], factors).withColumn("rn", Series(tuple(keys), (order,)).rn())
    dealt = numbered.join(walk_forward_folds(numbered, keys, train, every, ahead, rolling), list(keys))
    whole = F.lit(True)
    for f in factors:
        whole = whole & finite(f).isNotNull()
    known = dealt.where((F.col("rn") >= F.col("first")) & (F.col("rn") < F.col("last")) & whole & finite(label).isNotNull())
    forests = two_phase(known.select("fold", "name", F.col(label).alias("y"), "x"), factors, how, top, must)
    begin = F.when((F.col("fold") == 0) & F.lit(backfill), 0).otherwise(F.col("begin"))
    asked = dealt.where((F.col("rn") >= begin) & (F.col("rn") < F.col("end"))).withColumn("whole", whole).select(*keys, order, "fold", "x", "whole")
    made = predict(asked, forests, len(factors))
    return made.select(*keys, order, "fold", F.when(F.col("whole"), F.col("prediction")).alias("prediction"))
