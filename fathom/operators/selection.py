"""Information coefficients, factor ranking, clustering and ensembles."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.windows import Series, correlation, finite, ratio
from fathom.operators.scan import ordered_scan, rolling_rank, rolling_spearman


def long_form(df: DataFrame, keys: Sequence[str], factors: Sequence[str]) -> DataFrame:
    """(keys, factor, value) of the named columns."""
    return df.select(*keys, *(F.col(f).cast("double").alias(f) for f in factors)).unpivot(list(keys), list(factors), "factor", "value")


def rolling_ic(df: DataFrame, series: Series, factors: Sequence[str], label: str, window: int) -> DataFrame:
    """Rolling Pearson correlation of rolling ranks, at least half a window, 0 where undefined."""
    least = window // 2
    ranked = ordered_scan(df, series.keys, series.order, {f"_r_{x}": (lambda: rolling_rank(window, least, share=False), [x]) for x in (*factors, label)})
    return ranked.withColumns({f"ic_{x}": F.coalesce(series.corr(f"_r_{x}", f"_r_{label}", window, least), F.lit(0.0)) for x in factors}).drop(*(f"_r_{x}" for x in (*factors, label)))


def strict_ic(df: DataFrame, series: Series, factor: str, label: str, window: int, into: str = "ic") -> DataFrame:
    """``df`` with the Spearman correlation over the ``window`` rows before each row, if all are complete.

    Ranks are ordinal, so their variance is known and squared rank differences are enough.
    """
    return ordered_scan(df, series.keys, series.order, {into: (lambda: rolling_spearman(window), [factor, label])})


def segment_ic(df: DataFrame, keys: Sequence[str], order: str, factors: Sequence[str], label: str, size: int) -> DataFrame:
    """Spearman correlation per key, factor and segment of ``size`` rows, ties averaged."""
    rn = Series(tuple(keys), (order,)).rn()
    long = long_form(df.withColumn("segment", F.floor(rn / size)).withColumn("_y", F.col(label).cast("double")), [*keys, order, "segment", "_y"], factors).where("value is not null and _y is not null")
    part = [*keys, "factor", "segment"]

    def average_rank(x: str) -> Column:
        ties = Window.partitionBy(*part, x)
        return F.rank().over(Window.partitionBy(*part).orderBy(x)) + (F.count("*").over(ties) - 1) / 2

    ranked = long.withColumn("_a", average_rank("value")).withColumn("_b", average_rank("_y"))
    return ranked.groupBy(*part).agg(correlation("_a", "_b").alias("ic"), F.count("*").alias("n"))


def ic_summary(ics: DataFrame, keys: Sequence[str], ic: str = "ic", hit: float = 0.02) -> DataFrame:
    mean, std = F.avg(ic), F.stddev_samp(ic)
    return ics.groupBy(*keys).agg(mean.alias("mean_ic"), std.alias("std_ic"), F.avg(F.abs(F.col(ic))).alias("mean_abs_ic"), F.when(F.count(ic) >= 10, F.abs(mean) / (std + 1e-9)).otherwise(0.0).alias("icir"), F.avg((F.abs(F.col(ic)) > hit).cast("double")).alias("hit_rate"))


def column_correlations(df: DataFrame, column: str) -> DataFrame:
    """Pearson correlation of all pairs of components of an array column: (a, b, corr) with a < b, from 0.

    Pairs are made within a row and summed before they are shuffled.  Null and NaN components
    are left out pair by pair.
    """
    values = df.select(F.transform(F.col(column).cast("array<double>"), lambda v: F.when(~F.isnan(v), v)).alias("v"))
    one = values.select("v", F.posexplode("v").alias("a", "x"))
    two = one.select("a", "x", F.posexplode("v").alias("b", "y")).where("a < b and x is not null and y is not null")
    return two.groupBy("a", "b").agg(correlation("x", "y").alias("corr"))


def residual(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """y less its no-intercept projection on x, per key."""
    w = Window.partitionBy(*keys)
    return df.withColumn("residual", F.col(y) - F.coalesce(ratio(F.sum(F.col(y) * F.col(x)).over(w), F.sum(F.col(x) * F.col(x)).over(w)), F.lit(0.0)) * F.col(x))


def residual_on(df: DataFrame, keys: Sequence[str], y: str, factors: Sequence[str], least: int = 100) -> DataFrame:
    """``df`` with y less its no-intercept projection on a set of factors, per key.

    Rows with a missing value have no residual; a key of fewer than ``least`` complete rows keeps
    y as it is.  One row of sums a key is solved, dependent factors by least squares.
    """
    names = [y, *factors]
    values = {c: finite(c) for c in names}
    whole = F.forall(F.array(*values.values()), lambda v: v.isNotNull())
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = df.where(whole).groupBy(*keys).agg(F.count("*").alias("_n"), *(F.sum(values[names[i]] * values[names[j]]).alias(f"_s{i}_{j}") for i, j in pairs))
    schema = ", ".join(f"_k{i} {kind}" for i, (_, kind) in enumerate(df.select(*keys).dtypes)) + ", _beta array<double>"

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.to_dict("records"):
                full = np.array([[r[f"_s{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))])
                rows.append((*(r[k] for k in keys), np.linalg.lstsq(full[1:, 1:], full[1:, 0], rcond=None)[0].tolist()))
            yield pd.DataFrame(rows, columns=[*(f"_k{i}" for i in range(len(keys))), "_beta"])

    beta = sums.where(F.col("_n") >= least).mapInPandas(solve, schema)
    joined = df.join(beta, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left")
    fitted = sum((values[f] * F.col("_beta")[k] for k, f in enumerate(factors)), F.lit(0.0))
    out = F.when(F.col("_beta").isNull(), F.col(y)).when(whole, values[y] - fitted)
    return joined.withColumn("residual", out).drop("_beta", *(f"_k{i}" for i in range(len(keys))))


def cluster_picks(scores: Mapping[str, float], clusters: Mapping[str, int], most: int, least: float = 0.0) -> list[tuple[int, int, str, float, str]]:
    """(cluster, size, top factor, its score, candidates) of clusters whose best factor reaches ``least``.

    Candidates are the ``most`` best factors of a cluster, joined by " | "; ties go by name.
    """
    out = []
    for c in sorted(set(clusters.values())):
        members = sorted((f for f in clusters if clusters[f] == c), key=lambda f: (-scores[f], f))
        if scores[members[0]] >= least:
            out.append((c, len(members), members[0], float(scores[members[0]]), " | ".join(members[:most])))
    return out


def medoids(distance: np.ndarray, clusters: Sequence[int]) -> list[tuple[int, int, int]]:
    """(cluster, size, medoid): the member nearest to all others of its cluster on average, the first of equals."""
    out = []
    for c in sorted(set(clusters)):
        members = np.flatnonzero(np.array(clusters) == c)
        inner = distance[np.ix_(members, members)].mean(1)
        out.append((int(c), len(members), int(members[int(np.argmin(np.round(inner, 12)))])))
    return out


def linkage_clusters(distance: np.ndarray, count: int = 0, height: float = 0.0, method: str = "ward") -> list[int]:
    """Hierarchical clusters of at most a few hundred factors, cut by count or height.

    Lance-Williams updates; ward works on squared distances, average on distances.
    """
    n = len(distance)
    d = distance.astype(float) ** 2 if method == "ward" else distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, members = [1] * n, {i: [i] for i in range(n)}
    while len(members) > max(count, 1):
        live = sorted(members)
        part = d[np.ix_(live, live)]
        at = np.unravel_index(part.argmin(), part.shape)
        i, j = sorted((live[at[0]], live[at[1]]))
        if not count and (d[i, j] ** 0.5 if method == "ward" else d[i, j]) > height:
            break
        for k in live:
            if k not in (i, j):
                if method == "ward":
                    new = ((size[i] + size[k]) * d[i, k] + (size[j] + size[k]) * d[j, k] - size[k] * d[i, j]) / (size[i] + size[j] + size[k])
                else:
                    new = (size[i] * d[i, k] + size[j] * d[j, k]) / (size[i] + size[j])
                d[i, k] = d[k, i] = new
        members[i] += members.pop(j)
        size[i] += size[j]
        d[j, :] = d[:, j] = np.inf
    out = [0] * n
    for c, key in enumerate(sorted(members)):
        for i in members[key]:
            out[i] = c
    return out


def greedy_diverse(scores: Mapping[str, float], corr: Mapping[tuple[str, str], float], pick: int, weight: float = 0.5) -> list[str]:
    """Names picked one by one by normalised score and lack of correlation with those picked."""
    low, high = min(scores.values()), max(scores.values())
    norm = {k: (v - low) / (high - low) if high > low else 1.0 for k, v in scores.items()}
    chosen: list[str] = []
    while len(chosen) < min(pick, len(scores)):
        left = [k for k in sorted(scores) if k not in chosen]
        worth = lambda k: (1 - weight) * norm[k] + weight * (1 - max((abs(corr.get((k, c), corr.get((c, k), 0.0))) for c in chosen), default=0.0))
        chosen.append(max(left, key=worth))
    return chosen


def parse_strength_map(text: str) -> list[tuple[float, float, float]]:
    """``"lo-hi:pos,lo-hi:pos"`` as intervals by their lower ends; the last one is closed above.

    Positions lie in [0, 1].  An empty text gives no intervals: positions then go by sign alone.
    """
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        m = re.fullmatch(r"([\d.]+)-([\d.]+):([\d.]+)", part)
        if not m or not float(m[1]) < float(m[2]) or float(m[3]) > 1:
            raise ValueError(f"not an interval with a position in [0, 1]: {part!r}")
        out.append((float(m[1]), float(m[2]), float(m[3])))
    return sorted(out, key=lambda x: x[0])


def strength_position(strength: Column, sign: Column, intervals: Sequence[tuple[float, float, float]]) -> Column:
    """Position of the interval that holds ``strength``, by sign; 0 outside all."""
    out = F.lit(0.0)
    for k, (low, high, size) in enumerate(intervals):
        inside = (strength >= low) & ((strength <= high) if k == len(intervals) - 1 else (strength < high))
        out = F.when(inside, size).otherwise(out)
    return F.coalesce(out * F.signum(sign), F.lit(0.0))


def signal_zscore(series: Series, x: str, window: int = 500, least: int = 50) -> Column:
    return (F.col(x) - series.mean(x, window, least)) / F.greatest(series.std(x, window, least), F.lit(1e-8))


def vote(signals: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Majority of model positions in a long table: 1 or -1 where enough agree, the short test last."""
    made = signals.groupBy(*keys).agg(F.count("*").alias("models"), F.count(F.when(F.col("position") == 1, 1)).alias("longs"), F.count(F.when(F.col("position") == -1, 1)).alias("shorts"))
    need = F.ceil(F.col("models") * threshold)
    return made.withColumn("signal", F.when(F.col("shorts") >= need, -1).when(F.col("longs") >= need, 1).otherwise(0))


def weighted_vote(signals: DataFrame, keys: Sequence[str], weight: str, level: float = 0.3) -> DataFrame:
    """Weighted mean position, to 1 or -1 beyond ``level``; equal weights if none is positive."""
    positive = F.greatest(F.col(weight), F.lit(0.0))
    mean = F.coalesce(ratio(F.sum(positive * F.col("position")), F.sum(positive)), F.avg("position"))
    return signals.groupBy(*keys).agg(mean.alias("score")).withColumn("signal", F.when(F.col("score") > level, 1).when(F.col("score") < -level, -1).otherwise(0))


def vote_strength(longs: Column, shorts: Column, models: Column, intervals: Sequence[tuple[float, float, float]], min_agree: int = 1) -> Column:
    """Fractional position from votes: sized by intervals of the share of models that agree.

    The side with more votes gives the sign, longs at a tie.  The size is that of the highest
    interval in which either side's share lies.  Without intervals a side of ``min_agree``
    votes or more holds a whole position, shorts before longs.
    """
    if not intervals:
        return F.when(shorts >= min_agree, -1.0).when(longs >= min_agree, 1.0).otherwise(0.0)
    places = list(range(len(intervals)))

    def place(votes: Column, least: int) -> Column:
        """Number of the highest interval that holds the share of votes, -1 outside all."""
        share, top = votes / models, places[-1]
        held = [F.when((share >= low) & ((share <= high) if k == top else (share < high)), k) for k, (low, high, _) in enumerate(intervals)]
        return F.when(votes >= least, F.coalesce(*reversed(held), F.lit(-1))).otherwise(-1)

    long_at, short_at = place(longs, 0), place(shorts, 1)
    highest = F.greatest(long_at, short_at)
    size = F.coalesce(*(F.when(highest == k, intervals[k][2]) for k in places), F.lit(0.0))
    both = (longs >= 1) & (shorts >= 1)
    down = F.when(both, shorts > longs).otherwise((short_at >= 0) & (short_at >= long_at))
    return F.when(down, -size).otherwise(size)


def stacking_weights(signals: DataFrame, models: Sequence[str], label: str, alpha: float = 1e-5, least: int = 30) -> list[float]:
    """Ridge weights without intercept, from the sums of products of a wide table.

    Only the k x k sums reach the driver.  Equal weights if fewer than ``least`` rows are complete.
    """
    full = signals.dropna(subset=[*models, label])
    pairs = [(i, j) for i in range(len(models)) for j in range(i, len(models))]
    sums = full.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(models[i]) * F.col(models[j])).alias(f"p{i}_{j}") for i, j in pairs), *(F.sum(F.col(m) * F.col(label)).alias(f"q{i}") for i, m in enumerate(models))).first()
    if sums["n"] < least:
        return [1 / len(models)] * len(models)
    gram = np.array([[sums[f"p{min(i, j)}_{max(i, j)}"] for j in range(len(models))] for i in range(len(models))])
    return np.linalg.solve(gram + alpha * np.eye(len(models)), [sums[f"q{i}"] for i in range(len(models))]).tolist()


def refresh_weights(ics: DataFrame, window: int, least: float = 0.0) -> DataFrame:
    """Weights per refresh segment from the ICs of the ``window`` segments before it.

    ``ics``: symbol, factor, segment, ic.  A factor's weight is its signed ICIR (mean over
    deviation) where its size reaches ``least``; the weights of a segment sum to 1 in size.
    """
    before = Window.partitionBy("symbol", "factor").orderBy("segment").rowsBetween(-window, -1)
    mean, std = F.avg("ic").over(before), F.stddev_samp("ic").over(before)
    scored = ics.withColumn("icir", F.when(F.count("ic").over(before) >= 2, mean / (std + 1e-9)))
    kept = scored.withColumn("w", F.when(F.abs("icir") >= least, F.col("icir")).otherwise(0.0))
    total = F.sum(F.abs("w")).over(Window.partitionBy("symbol", "segment"))
    return kept.select("symbol", "factor", "segment", F.coalesce(ratio("w", total), F.lit(0.0)).alias("weight"))


def composite(df: DataFrame, factors: Sequence[str], weights: DataFrame, size: int) -> DataFrame:
    """Weighted sum of factors, the weights held constant between refreshes (a join on the segment)."""
    rn = Series(("symbol",), ("ts",)).rn()
    long = long_form(df.withColumn("segment", F.floor(rn / size)), ["symbol", "ts", "segment"], factors)
    return long.join(weights, ["symbol", "factor", "segment"]).groupBy("symbol", "ts").agg(F.sum(F.col("value") * F.col("weight")).alias("composite"))


def permutation_importance(predicted: DataFrame, keys: Sequence[str], order: str, factors: Sequence[str], coefficients: Mapping[str, float], label: str, seed: int = 0) -> DataFrame:
    """Rise of the squared error of a linear model when one factor's values change places.

    Places are a hash order, so the shuffle is the same in every run.  One row per factor.
    """
    own = Window.partitionBy(*keys).orderBy(order)
    dealt = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), F.col(order)), order)
    rows = predicted.dropna(subset=[*factors, label]).withColumns({"_a": F.row_number().over(own), "_b": F.row_number().over(dealt)})
    moved = rows.select(*keys, F.col("_b").alias("_a"), *(F.col(f).alias(f"_m_{f}") for f in factors))
    both = rows.join(moved, [*keys, "_a"])
    base = sum((F.col(f) * coefficients[f] for f in factors), F.lit(0.0))
    errors = both.agg(F.avg((F.col(label) - base) ** 2).alias("base"), *(F.avg((F.col(label) - (base - F.col(f) * coefficients[f] + F.col(f"_m_{f}") * coefficients[f])) ** 2).alias(f) for f in factors))
    return errors.unpivot(["base"], list(factors), "factor", "moved").select("factor", (F.col("moved") - F.col("base")).alias("importance"))
