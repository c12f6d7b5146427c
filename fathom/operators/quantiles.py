"""Exact quantiles of any number of rows a key, by histograms that narrow down.

Every wanted rank has a range that holds it.  One job counts, for all keys and ranks, the rows
in equal parts of their ranges, with the least and the greatest value of each part; the part
that holds the rank is the next range.  A range ends once its least and greatest value are
equal.  Only counts are shuffled, and no task holds the values of a key.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PARTS = 4096


def written(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the session's shared folder, its lineage cut."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def exact_quantiles(df: DataFrame, keys: Sequence[str], x: str, shares: Sequence[float], parts: int = PARTS) -> DataFrame:
    """(keys, share, value): quantiles of ``x`` per key, linear between the two nearest values.

    NULL and NaN are left out, and a key without other values has no rows; infinities are
    values, but nothing is interpolated towards them.
    """
    rows = df.select(*keys, F.col(x).cast("double").alias("_x")).where("_x is not null and not isnan(_x)")
    extent = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    asked = extent.withColumn("share", F.explode(F.array(*(F.lit(float(q)) for q in shares)))).withColumn("_at", (F.col("_n") - 1) * F.col("share"))
    asked = written(asked.withColumns({"_low": F.floor("_at").cast("long"), "_high": F.ceil("_at").cast("long")}))
    state = asked.select(*keys, "_lo", "_hi", F.explode(F.array("_low", "_high")).alias("_rank"), F.lit(0).cast("long").alias("_before")).distinct()
    state = written(state)
    by_rank = Window.partitionBy(*keys, "_rank")
    while state.where("_lo < _hi").limit(1).count():
        wide = state.where("_lo < _hi").select(*(F.col(k).alias(f"_k_{k}") for k in keys), "_lo", "_hi", "_rank", "_before")
        inside = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [(F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi"))]
        met = rows.join(wide, inside)
        # Infinite ends are parts of their own; quarters keep the width finite.
        finite = (F.abs("_lo") != float("inf")) & (F.abs("_hi") != float("inf"))
        inner = F.floor((F.col("_x") / 4 - F.col("_lo") / 4) / (F.col("_hi") / 4 - F.col("_lo") / 4) * parts)
        part = F.when(F.col("_x") == F.col("_lo"), 0).when(F.col("_x") == F.col("_hi"), parts + 1).when(finite, F.least(inner, F.lit(parts - 1)) + 1).otherwise(1)
        found = met.groupBy(*keys, "_rank", "_before", part.alias("_part")).agg(F.count("*").alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        end = F.col("_before") + F.sum("_c").over(by_rank.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
        found = found.withColumn("_end", end).where("_end > _rank and _end - _c <= _rank").withColumn("_before", F.col("_end") - F.col("_c"))
        state = written(state.where("_lo = _hi").unionByName(found.select(*state.columns)))
    value = state.select(*keys, "_rank", F.col("_lo").alias("_v"))
    low, high = (value.select(*(F.col(k).alias(f"_{side}_{k}") for k in keys), F.col("_rank").alias(f"_{side}"), F.col("_v").alias(f"_v_{side}")) for side in ("l", "h"))
    same = lambda side, rank: [F.col(k).eqNullSafe(F.col(f"_{side}_{k}")) for k in keys] + [F.col(rank) == F.col(f"_{side}")]
    both = asked.join(low, same("l", "_low")).join(high, same("h", "_high"))
    part = F.col("_at") - F.col("_low")
    return both.select(*keys, "share", F.when((part == 0) | (F.col("_v_l") == F.col("_v_h")), F.col("_v_l")).otherwise(F.col("_v_l") + (F.col("_v_h") - F.col("_v_l")) * part).alias("value"))
