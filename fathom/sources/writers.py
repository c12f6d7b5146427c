"""Sinks: tables, CSV tails, result files and run reports."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Parquet, one directory per value of ``by``, whose rows are brought together first."""
    if by:
        df.repartition(*by).write.mode(mode).partitionBy(*by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def write_csv_tail(df: DataFrame, path: str, order: tuple[str, ...] = ("ts",), rows: int = 10_000) -> None:
    """The last rows by ``order``, in order, as CSV: a top-k, not a sort of the table."""
    tail = df.orderBy(*(F.desc(c) for c in order)).limit(rows)
    tail.orderBy(*order).write.mode("overwrite").option("header", "true").csv(path)


def split_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """datetime, date and time columns in place of ``ts``."""
    rest = [c for c in df.columns if c != ts]
    return df.select(F.col(ts).alias("datetime"), F.to_date(ts).alias("date"), F.date_format(ts, "HH:mm").alias("time"), *rest)


def write_results(df: DataFrame, path: str, ts: str = "ts") -> None:
    split_time(df, ts).write.mode("overwrite").option("header", "true").csv(path)


def write_report(metrics: DataFrame, config: dict, path: str) -> None:
    """One JSON line per metrics row and one for the parameters."""
    spark = metrics.sparkSession
    parameters = spark.createDataFrame([(json.dumps(config, sort_keys=True, default=str),)], "value string")
    metrics.select(F.to_json(F.struct("*")).alias("value")).unionByName(parameters).coalesce(1).write.mode("overwrite").text(path)


def equity_data(results: DataFrame, keys: tuple[str, ...], split: str | None = None) -> DataFrame:
    """What an equity plot shows: daily equity per key, and the part (in or out of sample)."""
    days = results.groupBy(*keys, F.to_date("ts").alias("date")).agg(F.max_by("cumulative_value", "ts").alias("equity"))
    return days if split is None else days.withColumn("part", F.when(F.col("date") < F.lit(split).cast("date"), "in").otherwise("out"))


def write_selection(path: str, ranking: DataFrame, clusters: DataFrame, trials: DataFrame, best: Sequence[dict], correlations: DataFrame | None = None) -> None:
    """What a factor search leaves: ranking, clusters and trials as CSV, the best sets as JSON lines."""
    tables = {"ranking": ranking, "clusters": clusters, "trials": trials} | ({"signal_corr": correlations} if correlations is not None else {})
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", "true").csv(f"{path}/{name}")
    lines = [(k, json.dumps(b, sort_keys=True, default=str)) for k, b in enumerate(best)]
    ranking.sparkSession.createDataFrame(lines, "k int, value string").coalesce(1).sortWithinPartitions("k").select("value").write.mode("overwrite").text(f"{path}/best")


def save_trials(spark: SparkSession, path: str, trials: DataFrame) -> None:
    """Add the trials of one round to the state of a search; rounds are never rewritten."""
    trials.write.mode("append").json(path)


def resume_trials(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All trials so far, each set once with its best score; no rows before the first round."""
    try:
        found = spark.read.schema(schema).json(path)
    except AnalysisException:  # nothing saved so far
        found = spark.createDataFrame([], schema)
    return found.groupBy("set_id").agg(F.max("score").alias("score"))
