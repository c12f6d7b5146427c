"""Mixing sources to target weights by Poisson replication, all DataFrame expressions.

Each source has a repetition rate: its target share of all characters over its own.  Each
document draws its number of copies from a Poisson distribution with that mean, by
inverting the distribution at a point hashed from a seed and doc_id, so a rerun or a lost
executor draws the same again.  Copies are then dealt by a hash over all partitions and
sorted by it, which is one shuffle of the result and a random order of the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most sources whose rates are broadcast; a longer list of sources is joined by a salted shuffle.
BROADCAST_SOURCES = 10_000
SALTS = 64


def hashed_point(*parts: Column) -> Column:
    """A number in [0, 1) with 52 random bits, from the MD5 of the parts joined by colons."""
    digest = F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_count(rate: Column, point: Column) -> Column:
    """Smallest n whose Poisson distribution function at mean ``rate`` exceeds ``point``.

    Terms are added in log space, up to a count beyond which less than 1e-16 is left.
    """
    most = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.lit(0).alias("n"))

    def step(state: Column, k: Column) -> Column:
        log = state["log"] + F.log(rate) - F.log(k.cast("double"))
        over = point < state["sum"]
        return F.struct(log.alias("log"), (state["sum"] + F.exp(log)).alias("sum"), F.when(over, state["n"]).otherwise(k).alias("n"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), most), start, step)["n"]).otherwise(0)


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5) -> DataFrame:
    """source, rate: target share of all characters over the source's own share.

    ``weights`` gives target weights by source (absent sources: 0, which drops them, as
    asked); without it a source's weight is its size to the power ``temperature``.  The
    expected size of the result is that of the input.  Null sources are one source, ''.
    A source without characters keeps rate 1 unless ``weights`` names it 0.
    """
    sizes = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).agg(F.sum(F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).alias("size"))
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(temperature))
    else:
        weight = F.lit(0.0)
        for source, value in weights.items():
            weight = F.when(F.col("source") == source, float(value)).otherwise(weight)
    sizes = sizes.withColumn("weight", weight)
    total = sizes.agg(F.sum("weight").alias("all_weight"), F.sum("size").alias("all_size"))
    joined = sizes.crossJoin(F.broadcast(total))  # one row, by construction
    share = F.try_divide(F.col("weight") * F.col("all_size"), F.col("all_weight"))
    rate = F.when(F.col("size") == 0, F.lit(1.0) if weights is None else F.signum("weight")).otherwise(F.coalesce(share / F.nullif("size", F.lit(0)), F.lit(0.0)))
    return joined.select("source", rate.alias("rate"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, seed: int = 17) -> DataFrame:
    """``docs`` with each row repeated its number of copies, in random order.

    Added columns: rate, copies, copy (1 to copies) and shuffle_key; an input column of such
    a name is replaced.  A row whose count is 0 is not in the result.  Rows repeated with one
    doc_id draw the same count; rows without doc_id draw by their text.
    """
    plain = docs.drop("rate", "copies", "copy", "shuffle_key")
    rates = source_rates(plain, weights, temperature).withColumnRenamed("source", "_source")
    keyed = plain.withColumn("_source", F.coalesce(F.col("source").cast("string"), F.lit("")))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rated = keyed.join(F.broadcast(rates), "_source")
    else:
        keyed = keyed.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        spread = rates.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        rated = keyed.join(spread, ["_source", "_salt"]).drop("_salt")
    own = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    counted = rated.withColumn("copies", poisson_count(F.col("rate"), hashed_point(F.lit(seed), own)))
    copied = counted.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    keyed = copied.drop("_source").withColumn("shuffle_key", hashed_point(F.lit(seed + 1), own, F.col("copy")))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "copy")
