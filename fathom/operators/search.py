"""Search over factor sets: signed coefficients by stepped windows, guarded scores, refinement.

A set of factors is rows (set_id, n, factor).  Every measure is taken for all sets at once: the
sets are joined to the rows of their factors, and groups are (set, symbol, part of the time).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.windows import correlation
from fathom.operators.performance import windowed_sharpe

TRAIN, TEST = -1, 99


def average_rank(x: str, part: Sequence[str]) -> Column:
    """Rank from 1 within ``part``, equals at their mean place."""
    ties = F.count("*").over(Window.partitionBy(*part, x))
    return F.rank().over(Window.partitionBy(*part).orderBy(x)) + (ties - 1) / 2


def stepped_icir(rows: DataFrame, keys: Sequence[str], window: int) -> DataFrame:
    """(keys, icir): mean over population deviation of Spearman coefficients of stepped windows.

    ``rows``: keys, rn (from 0 without gaps), value, label.  A window begins at every fifth of
    ``window`` rows and counts with half of its rows complete; 0 under three coefficients,
    or under 30 rows.
    """
    step = max(1, window // 5)
    sized = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where((F.col("_n") >= max(window, 30)) & F.col("value").isNotNull() & F.col("label").isNotNull())
    first = F.greatest(F.lit(0), F.ceil((F.col("rn") - window + 1) / step)).cast("long")
    last = F.least(F.floor(F.col("rn") / step), F.floor((F.col("_n") - window) / step)).cast("long")
    each = sized.withColumns({"_first": first, "_last": last}).where("_first <= _last").withColumn("_w", F.explode(F.sequence("_first", "_last")))
    part = [*keys, "_w"]
    ranked = each.withColumns({"_a": average_rank("value", part), "_b": average_rank("label", part)})
    ics = ranked.groupBy(*part).agg(correlation("_a", "_b").alias("ic"), F.count("*").alias("c")).where((F.col("c") >= window // 2) & F.col("ic").isNotNull())
    found = ics.groupBy(*keys).agg(F.when(F.count("*") >= 3, F.avg("ic") / (F.stddev_pop("ic") + 1e-9)).otherwise(0.0).alias("icir"))
    return rows.select(*keys).distinct().join(found, list(keys), "left").withColumn("icir", F.coalesce("icir", F.lit(0.0)))


def three_way_split(rows: DataFrame, validate: float = 0.5, test: float = 0.8, folds: int = 3, purge: int = 3, least: int = 150) -> DataFrame:
    """``rows`` (symbol, rn, total) with part and rn within it; purged rows are left out.

    Parts: ``TRAIN``, folds of the validation time from 0, ``TEST``.  A fold starts ``purge`` rows
    late and ends a row early, so that no label reaches across.  A validation time under
    ``least`` rows is one fold.
    """
    rn, begin, end = F.col("rn"), F.floor(F.col("total") * validate), F.floor(F.col("total") * test)
    count = F.when(end - begin < least, 1).otherwise(folds)
    size = F.greatest(F.floor((end - begin) / count), F.lit(1))
    fold = F.least(F.floor((rn - begin) / size), count - 1).cast("int")
    start = begin + fold * size + purge
    stop = F.when(fold == count - 1, end).otherwise(begin + (fold + 1) * size) - 1
    made = rows.withColumn("part", F.when(rn < begin, TRAIN).when(rn >= end, TEST).when((rn >= start) & (rn < stop), fold))
    origin = F.when(F.col("part") == TRAIN, 0).when(F.col("part") == TEST, end).otherwise(start)
    return made.withColumn("rn", rn - origin).where("part is not null")


def all_sets(names: Sequence[str], most: int, spark) -> DataFrame:
    """Every set of up to ``most`` names: (set_id, n, factor)."""
    return named_sets([c for k in range(1, most + 1) for c in combinations(sorted(names), k)], spark)


def named_sets(sets: Sequence[Sequence[str]], spark) -> DataFrame:
    return spark.createDataFrame([("|".join(sorted(s)), len(s), f) for s in sets for f in sorted(s)], "set_id string, n int, factor string")


def signed_mean(sets: DataFrame, long: DataFrame, signs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(set_id, n, keys, rn, value, label): mean of a set's factors, each turned by its sign.

    ``long``: keys, rn, factor, value, label, missing ones as 0; ``signs``: factor, sign and some of the keys.
    """
    on = [c for c in ("symbol", "part", "factor") if c in signs.columns]
    turned = long.join(signs, on).join(sets, "factor")
    return turned.groupBy("set_id", "n", *keys, "rn").agg((F.sum(F.col("value") * F.col("sign")) / F.first("n")).alias("value"), F.max("label").alias("label"))


def composite_icir(sets: DataFrame, long: DataFrame, window: int) -> DataFrame:
    """(set_id, n, symbol, part, icir) of each set's signed mean, signs by each part's own coefficients."""
    keys = ["symbol", "part"]
    filled = long.withColumns({"value": F.coalesce("value", F.lit(0.0)), "label": F.coalesce("label", F.lit(0.0))})
    own = stepped_icir(filled, [*keys, "factor"], window)
    signs = own.select(*keys, "factor", F.when(F.col("icir") >= 0, 1.0).otherwise(-1.0).alias("sign"))
    return stepped_icir(signed_mean(sets, filled, signs, keys), ["set_id", "n", *keys], window)


def set_correlation(sets: DataFrame, wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """(set_id, symbol, mac): mean absolute correlation of the pairs of a set, 0 for one factor."""
    pairs = list(combinations(sorted(names), 2))
    each = wide.groupBy("symbol").agg(*(correlation(a, b).alias(f"{a}|{b}") for a, b in pairs)).unpivot(["symbol"], [f"`{a}|{b}`" for a, b in pairs], "pair", "corr")
    each = each.select("symbol", F.split("pair", r"\|")[0].alias("_a"), F.split("pair", r"\|")[1].alias("_b"), F.abs("corr").alias("corr"))
    a, b = sets.select("set_id", F.col("factor").alias("_a")), sets.select(F.col("set_id").alias("_set"), F.col("factor").alias("_b"))
    within = a.join(b, (F.col("set_id") == F.col("_set")) & (F.col("_a") < F.col("_b"))).join(each, ["_a", "_b"])
    found = within.groupBy("set_id", "symbol").agg(F.avg("corr").alias("mac"))
    every = sets.select("set_id").distinct().crossJoin(wide.select("symbol").distinct())
    return every.join(found, ["set_id", "symbol"], "left").withColumn("mac", F.coalesce("mac", F.lit(0.0)))


def guarded_scores(icirs: DataFrame, mac: DataFrame, w: float = 0.25, per_factor: float = 0.05, spread: float = 1.0, cap: float = 1.5, gap: float = 0.3, must: Sequence[str] = ()) -> DataFrame:
    """(set_id, symbol, raw, sigma, gap, mac, score) from composite coefficients by part.

    raw: mean of the folds less ``spread`` deviations.  The score takes off correlation inside
    the set, its size (factors of ``must`` are free), deviation beyond ``cap`` and what the
    training time has over raw.
    """
    fold = (F.col("part") >= 0) & (F.col("part") != TEST)
    made = icirs.groupBy("set_id", "n", "symbol").agg(
        F.avg(F.when(fold, F.col("icir"))).alias("m"), F.stddev_pop(F.when(fold, F.col("icir"))).alias("sigma"), F.max(F.when(F.col("part") == TRAIN, F.col("icir"))).alias("train")
    )
    made = made.withColumn("raw", F.col("m") - spread * F.col("sigma")).withColumn("gap", F.greatest(F.lit(0.0), F.coalesce(F.col("train") - F.col("raw"), F.lit(0.0))))
    free = sum((F.when(F.array_contains(F.split("set_id", r"\|"), f), 1).otherwise(0) for f in must), F.lit(0))
    penalty = w * F.col("mac") + per_factor * (F.col("n") - free) + spread * F.greatest(F.lit(0.0), F.col("sigma") - cap) + gap * F.col("gap")
    return made.join(mac, ["set_id", "symbol"]).select("set_id", "symbol", "raw", "sigma", "gap", "mac", (F.col("raw") - penalty).alias("score"))


def set_returns(sets: DataFrame, long: DataFrame, signs: DataFrame, bars: DataFrame) -> DataFrame:
    """(set_id, symbol, rn, ts, r): each bar's return held at the sign of the signed mean of the bar before.

    ``bars``: symbol, rn, ts, ret.  ``signs``: symbol, factor, sign.
    """
    filled = long.withColumns({"value": F.coalesce("value", F.lit(0.0)), "label": F.coalesce("label", F.lit(0.0))})
    mean = signed_mean(sets, filled, signs, ["symbol"])
    held = F.coalesce(F.lag(F.signum("value")).over(Window.partitionBy("set_id", "symbol").orderBy("rn")), F.lit(0.0))
    return mean.withColumn("held", held).join(bars, ["symbol", "rn"]).select("set_id", "symbol", "rn", "ts", (F.col("held") * F.coalesce("ret", F.lit(0.0))).alias("r"))


def set_sharpe(returns: DataFrame, least: int = 20, recent: int | None = None) -> DataFrame:
    """(set_id, symbol, sharpe) of daily sums; of the ``recent`` last days only, if given."""
    days = returns.groupBy("set_id", "symbol", F.to_date("ts").alias("date")).agg(F.sum("r").alias("r"))
    if recent is not None:
        days = days.withColumn("_k", F.row_number().over(Window.partitionBy("set_id", "symbol").orderBy(F.desc("date")))).where(F.col("_k") <= recent)
    return windowed_sharpe(days, ["set_id", "symbol"], least)


def must_include(scored: DataFrame, keep: int = 10) -> DataFrame:
    """The best ``keep`` sets of each size by sharpe, ranked together per symbol; the first is the choice.

    ``scored``: symbol, set_id, n, sharpe.  Triples count only around one of the pairs kept.
    """
    best = Window.partitionBy("symbol", "n").orderBy(F.desc("sharpe"), "set_id")
    small = scored.where("n < 3").withColumn("place", F.row_number().over(best)).where(F.col("place") <= keep)
    pairs = small.where("n = 2").select("symbol", F.split("set_id", r"\|").alias("_pair"))
    triples = scored.where("n = 3").join(pairs, "symbol").where(F.size(F.array_intersect(F.split("set_id", r"\|"), "_pair")) == 2).drop("_pair").distinct()
    triples = triples.withColumn("place", F.row_number().over(best)).where(F.col("place") <= keep)
    pooled = Window.partitionBy("symbol").orderBy(F.desc("sharpe"), "n", "set_id")
    return small.unionByName(triples).withColumn("place", F.row_number().over(pooled))


def moves(chosen: Sequence[str], clusters: Sequence[Sequence[str]], must: Sequence[str] = ()) -> list[tuple[str, ...]]:
    """Sets one move away: swap within a cluster, remove, or add the first of a cluster not in use."""
    out, free = set(), [f for f in chosen if f not in must]
    for old in free:
        mates = next((c for c in clusters if old in c), [old])
        rest = [f for f in chosen if f != old]
        out |= {tuple(sorted({*rest, f})) for f in mates if f != old}
        out |= {tuple(sorted(rest))} if rest else set()
    out |= {tuple(sorted({*chosen, c[0]})) for c in clusters if not set(c) & set(free)}
    return sorted(out - {tuple(sorted(chosen))})


def refine(start: Sequence[str], clusters: Sequence[Sequence[str]], score, rounds: int = 5, least: float = 1e-4, must: Sequence[str] = ()) -> list[tuple[int, str, float]]:
    """(round, set_id, score) of a greedy climb; ``score`` maps a list of sets to {set_id: score}.

    The sets of one round are scored in one job; only their scores reach the driver.
    """
    name = lambda s: "|".join(sorted(s))
    now = tuple(sorted(start))
    best = score([now])[name(now)]
    path = [(0, name(now), best)]
    for k in range(1, rounds + 1):
        found: Mapping[str, float] = score(near) if (near := moves(now, clusters, must)) else {}
        if not found:
            break
        top = max(sorted(found), key=lambda s: found[s])
        if found[top] - best <= least:
            break
        now, best = tuple(top.split("|")), found[top]
        path.append((k, top, best))
    return path


def overfit_flags(validation: DataFrame, test: DataFrame, most: float = 0.5) -> DataFrame:
    """Sharpe of both times side by side, and whether they differ by more than ``most``; NULL where one has too few days."""
    both = validation.withColumnRenamed("sharpe", "val_sharpe").join(test.withColumnRenamed("sharpe", "test_sharpe"), ["set_id", "symbol"])
    known = (F.col("val_sharpe") > -900) & (F.col("test_sharpe") > -900)
    return both.withColumn("overfit", F.when(known, F.abs(F.col("val_sharpe") - F.col("test_sharpe")) > most))


def trailing_icir(rows: DataFrame, keys: Sequence[str], window: int, every: int, segment: int = 100) -> DataFrame:
    """(keys, at, icir): size of mean over sample deviation of segment coefficients before each refresh.

    A refresh at row ``at`` looks at the ``window`` rows before it.  Complete rows are cut into
    segments of ``segment``, or into three if they are under three segments; under twice
    ``segment`` rows one coefficient stands for all, under 30 the value is 0.
    """
    total = F.count("*").over(Window.partitionBy(*keys))
    reach = rows.withColumn("_n", total).where("value is not null and label is not null")
    first = F.greatest(F.lit(0), F.ceil((F.col("rn") + 1 - window) / every)).cast("long")
    last = F.least(F.floor(F.col("rn") / every), F.floor((F.col("_n") - 1 - window) / every)).cast("long")
    each = reach.withColumns({"_first": first, "_last": last}).where("_first <= _last").withColumn("at", F.explode(F.transform(F.sequence("_first", "_last"), lambda k: k * every + window)))
    # Row rn is within reach of refresh at if at - window <= rn < at.
    each = each.where((F.col("rn") < F.col("at")) & (F.col("rn") >= F.col("at") - window)).drop("_first", "_last", "_n")
    part = [*keys, "at"]
    each = each.withColumns({"c": F.count("*").over(Window.partitionBy(*part)), "k": F.row_number().over(Window.partitionBy(*part).orderBy("rn")) - 1})
    size = F.when(F.col("c") < 2 * segment, F.col("c")).when(F.col("c") < 3 * segment, F.floor(F.col("c") / 3)).otherwise(segment)
    each = each.withColumn("s", F.floor(F.col("k") / size)).where(F.col("s") < F.floor(F.col("c") / size))
    cut = [*part, "c", "s"]
    ranked = each.withColumns({"_a": average_rank("value", cut), "_b": average_rank("label", cut)})
    ics = ranked.groupBy(*cut).agg(correlation("_a", "_b").alias("ic"))
    made = ics.groupBy(*part, "c").agg(F.avg("ic").alias("m"), F.stddev_samp("ic").alias("sd"), F.count("ic").alias("k"))
    whole = F.abs("m") * F.sqrt(F.greatest(F.lit(1), F.floor(F.col("c") / segment)))
    several = F.when(F.col("k") < 3, 0.0).when(F.col("sd") < 1e-9, F.abs("m") * 10).otherwise(F.abs("m") / F.nullif("sd", F.lit(0.0)))
    return made.select(*part, F.coalesce(F.when(F.col("c") < 30, 0.0).when(F.col("c") < 2 * segment, whole).otherwise(several), F.lit(0.0)).alias("icir"))


def two_level_weights(icirs: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """(symbol, at, factor, weight): factors by their ICIR within a sub-cluster, sub-clusters by theirs.

    Factors under ``least`` are left out, all but the best one if none reaches it.  A
    sub-cluster's own ICIR is the weighted mean of its factors'.  Equal weights where a sum is 0.
    """
    inner, at = Window.partitionBy("symbol", "at", "cluster"), Window.partitionBy("symbol", "at")
    named = icirs.join(groups, "factor")
    named = named.withColumns({"_any": F.max("icir").over(inner) >= least, "_place": F.row_number().over(inner.orderBy(F.desc("icir"), "factor"))})
    kept = named.where((F.col("_any") & (F.col("icir") >= least)) | (~F.col("_any") & (F.col("_place") == 1)))
    total = F.sum("icir").over(inner)
    kept = kept.withColumn("w", F.when(total < 1e-9, 1 / F.count("*").over(inner)).otherwise(F.try_divide("icir", total)))
    clusters = kept.groupBy("symbol", "at", "cluster").agg(F.sum(F.col("w") * F.col("icir")).alias("own"))
    every = F.sum("own").over(at)
    clusters = clusters.withColumn("iw", F.when(every < 1e-9, 1 / F.count("*").over(at)).otherwise(F.try_divide("own", every)))
    return kept.join(clusters, ["symbol", "at", "cluster"]).select("symbol", "at", "factor", (F.col("w") * F.col("iw")).alias("weight"))


def held_composite(rows: DataFrame, weights: DataFrame, window: int, every: int) -> DataFrame:
    """(symbol, ts, composite): factors under the weights of the last refresh, missing values left out."""
    at = (F.floor((F.col("rn") - window) / every) * every + window).cast("long")
    held = rows.where(F.col("rn") >= window).withColumn("at", at).where("value is not null").join(weights.where("weight >= 1e-9"), ["symbol", "at", "factor"])
    return held.groupBy("symbol", "ts").agg(F.sum(F.col("value") * F.col("weight")).alias("composite"))
