"""Time-aware joins: as-of, as-of with offset, interval, irregular interval aggregation.

As-of joins are a union of both sides and one running ``last`` per key and day, with what the
days before leave carried over; that is linear, and no task takes all rows of a key.  Spark's
own as-of plan is a Cartesian product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.operators.clean import carried_value


def asof_backward(left: DataFrame, right: DataFrame, by: Sequence[str], ts: str = "ts", columns: Sequence[str] = (), tie: str | None = None, strict: bool = False) -> DataFrame:
    """``left`` with ``columns`` of the latest ``right`` row at or before it (``strict``: before it).

    ``tie`` orders right rows of one time; the last one counts.
    """
    value = F.struct(*columns)
    order = F.lit(0).cast("long") if tie is None else F.col(tie).cast("long")
    probe = left.select(*by, F.col(ts).alias("_at"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_value"), F.lit(0 if strict else 2).alias("_side"), F.lit(0).cast("long").alias("_tie"))
    build = right.select(*by, F.col(ts).alias("_at"), F.lit(None).cast(probe.schema["_row"].dataType).alias("_row"), value.alias("_value"), F.lit(1).alias("_side"), order.alias("_tie"))
    both = probe.unionByName(build).withColumn("_day", F.to_date("_at"))
    found = carried_value(both, by, "_day", ["_at", "_side", "_tie"], "_value", "_found")
    return found.where(F.col("_row").isNotNull()).select("_row.*", *(F.col(f"_found.{c}").alias(c) for c in columns))


def asof_offsets(probe: DataFrame, tape: DataFrame, by: Sequence[str], value: str, hours: Sequence[int], ts: str = "ts", tie: str | None = None, prefix: str = "ago") -> DataFrame:
    """``probe`` with the tape's value at or before ``ts`` minus each number of hours.

    All horizons are one as-of join of the distinct keys and times of ``probe``, repeated per
    horizon with shifted times; the tape is read once for all of them.  The rows of ``probe``
    take their values by key and time, so repeated ones stay and no other column is repeated.
    """
    asked = probe.select(*by, F.col(ts).alias("_when")).distinct()
    shifted = asked.select(*by, "_when", F.explode(F.array(*(F.lit(h) for h in hours))).alias("_h"))
    shifted = shifted.withColumn("_t", F.expr("_when - make_interval(0, 0, 0, 0, _h)"))
    order = F.lit(0).cast("long") if tie is None else F.col(tie).cast("long")
    known = tape.select(*by, F.col(ts).alias("_t"), F.col(value).cast("double").alias("_v"), order.alias("_seq"))
    found = asof_backward(shifted, known, by, ts="_t", columns=["_v"], tie="_seq")
    names = [f"{prefix}_{h}" for h in hours]
    wide = found.groupBy(*(F.col(c).alias(f"_by_{c}") for c in by), "_when").agg(*(F.max(F.when(F.col("_h") == h, F.col("_v"))).alias(n) for h, n in zip(hours, names, strict=True)))
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by] + [F.col(ts).eqNullSafe(F.col("_when"))]
    return probe.join(wide, same, "left").select(*probe.columns, *names)


def interval_join(ticks: DataFrame, periods: DataFrame, ts: str = "ts", start: str = "start_ts", end: str = "end_ts", closed: str = "right", keys: Sequence[str] = (), step: str = "1 day") -> DataFrame:
    """Ticks with the period that holds them: (start, end] for ``closed="right"``, [start, end) for "left".

    Both sides are cut into steps of time and joined on the step, an equi-join of any size;
    a period lies in every step that it touches.
    """
    inside = (F.col(ts) > F.col(start)) & (F.col(ts) <= F.col(end)) if closed == "right" else (F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))
    seconds = {"1 day": 86400, "1 hour": 3600}[step]
    cell = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / 1e6 / seconds).cast("long")
    cut = periods.withColumn("_cell", F.explode(F.sequence(cell(F.col(start)), cell(F.col(end)))))
    return ticks.withColumn("_cell", cell(F.col(ts))).join(cut, [*keys, "_cell"]).where(inside).drop("_cell")


def interval_ohlc(bar_ends: DataFrame, tape: DataFrame, by: Sequence[str], price: str, ts: str = "ts", tie: str = "seq") -> DataFrame:
    """OHLC of the tape over (previous bar end, bar end]; empty intervals give NULLs and n = 0.

    A tape row belongs to the next bar end at or after it; the first bar end takes only the
    last row at or before it.
    """
    ends = bar_ends.select(*by, F.col(ts).alias("bar_end")).distinct()
    w = Window.partitionBy(*by)
    ends = ends.withColumn("first_end", F.min("bar_end").over(w))
    marks = ends.select(*by, F.col("bar_end").alias("_t"), "bar_end", F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_p"), F.lit(0).cast("long").alias("_tie"))
    rows = tape.select(*by, F.col(ts).alias("_t"), F.lit(None).cast(ends.schema["bar_end"].dataType).alias("bar_end"), F.lit(0).alias("_side"), F.col(price).cast("double").alias("_p"), F.col(tie).cast("long").alias("_tie"))
    both = marks.unionByName(rows).withColumn("_day", F.to_date("_t"))
    dealt = carried_value(both, by, "_day", ["_t", "_side", "_tie"], "bar_end", "next_end", ahead=True).where("_side = 0 and next_end is not null")
    dealt = dealt.drop("bar_end").withColumnRenamed("next_end", "bar_end")
    at = F.struct("_t", "_tie")
    found = dealt.groupBy(*by, "bar_end").agg(
        F.min_by("_p", at).alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"), F.max_by("_p", at).alias("close"), F.count("_p").alias("n")
    )
    joined = ends.join(found, [*by, "bar_end"], "left")
    first = F.col("bar_end") == F.col("first_end")
    last = F.col("close")
    return joined.select(
        *by,
        "bar_end",
        *(F.when(first, last).otherwise(F.col(x)).alias(x) for x in ("open", "high", "low", "close")),
        F.when(first & (F.col("n") > 0), 1).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n"),
    )


def one_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join that fails at run time if a key occurs twice on either side."""

    def checked(df: DataFrame, side: str) -> DataFrame:
        n = F.count(F.lit(1)).over(Window.partitionBy(*on))
        return df.withColumn("_once", n).where(F.assert_true(F.col("_once") == 1, F.lit(f"duplicate key on the {side} side")).isNull()).drop("_once")

    return checked(left, "left").join(checked(right, "right"), list(on), how)


def index_intersection(frames: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Keys that every frame has."""
    out = frames[0].select(*key).distinct()
    for f in frames[1:]:
        out = out.join(f.select(*key).distinct(), list(key), "left_semi")
    return out



def aligned(frames: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Columns of all frames side by side on every key that any of them has."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, list(key), "full")
    return out


def reindexed(df: DataFrame, index: DataFrame, key: Sequence[str], fill: dict[str, object] | None = None) -> DataFrame:
    """``df`` on the keys of ``index``, missing values as ``fill`` says."""
    out = index.join(df, list(key), "left")
    return out.select(*(F.coalesce(c, F.lit(fill[c])).alias(c) if fill and c in fill else F.col(c) for c in out.columns))
