"""Lineage cuts and connected components as plain DataFrame work."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the session's checkpoint folder and forget its lineage.

    The folder is ``spark.checkpoint.dir``; only a session without one (a local test) gets
    a temporary folder, so on a cluster every executor reads the same shared files.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


#: A key with more rows than this, and than its share of all rows, is dealt over several tasks.
HUB = 1000
#: Most keys that are dealt that way, which bounds what is broadcast.
HUBS = 10_000


def join_spread(rows: DataFrame, other: DataFrame, key: str, total: int, counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined to ``other``, which has at most one row a ``key``; no task takes all rows of a hub.

    Keys of more than ``total / HUBS`` of the ``total`` rows, hence at most ``HUBS`` of them, are
    cut into parts; only their rows of ``other`` are repeated, once a part.  ``counts``: (key, n).
    """
    limit = max(HUB, total // HUBS)
    counts = rows.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    parts = F.broadcast(counts.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("_parts")))
    dealt = rows.join(parts, key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_parts")).cast("int"), F.lit(0)))
    spread = other.join(parts, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)))
    return dealt.drop("_parts").join(spread.drop("_parts"), [key, "_part"]).drop("_part")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component: its smallest node.

    Alternates large-star and small-star steps until the edge set no longer changes, which
    takes O(log^2 n) rounds; each step is an aggregation and a join that deals hubs over
    several tasks, and each round ends in a checkpoint.
    """

    def least(star: DataFrame, total: int, own: bool) -> DataFrame:
        """Edges (u, v) with m, the smallest neighbour of u (or u, with ``own``)."""
        low = star.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        low = low.withColumn("m", F.least("u", "m")) if own else low
        return join_spread(star, low.select("u", "m"), "u", total, low.select("u", "n"))

    star = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = [F.count("*"), F.bit_xor(F.xxhash64("u", "v"))]
    now = star.agg(*state).first()
    while now[0]:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(least(both, 2 * now[0], True).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = least(large, 2 * now[0], False)
        linked = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = cut(linked.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        before, now = now, star.agg(*state).first()
        if now == before:
            break
    own = star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)
