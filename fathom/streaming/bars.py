"""Structured Streaming forms of the tick operators.

Bars of closed windows equal the batch bars.  State is bounded by watermarks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators.bars import ohlcv
from fathom.operators.joins import interval_join


def tick_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files_per_batch: int = 10) -> DataFrame:
    """``name`` of a folder as a stream of ticks: a file, or a table that is a folder of part files.

    Part files of one table come in no order of time, so those that are there go into one
    micro-batch; dealt out to several, the watermark of the first would drop ticks of the next.
    """
    path = f"{folder}/{name}"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if store.exists(place) and store.getFileStatus(place).isDirectory():
        raw = reader.parquet(path)
    else:
        raw = reader.option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.col("user_id").alias("size"))


def tumbling_bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars per window, each once its window has passed the watermark; later ticks are dropped."""
    made = ohlcv(ticks.withWatermark("ts", late), [F.window("ts", width).alias("w"), "symbol"])
    return made.select("symbol", F.col("w.start").alias("bar_start"), F.col("w.end").alias("bar_end"), "open", "high", "low", "close", "volume", "n_ticks")


def sliding_vwap(ticks: DataFrame, width: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    made = ticks.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "symbol").agg(F.sum(F.col("price") * F.col("size")).alias("pv"), F.sum("size").alias("v"))
    return made.select("symbol", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), F.try_divide("pv", F.nullif("v", F.lit(0))).alias("vwap"))


def session_bars(ticks: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """One bar per run of ticks without a pause of ``gap``."""
    made = ohlcv(ticks.withWatermark("ts", late), [F.session_window("ts", gap).alias("w"), "symbol"])
    return made.select("symbol", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "open", "high", "low", "close", "volume", "n_ticks")


def matched(left: DataFrame, right: DataFrame, within: int = 300, late: str = "10 minutes") -> DataFrame:
    """Pairs of ticks of two streams, the right one at most ``within`` seconds before the left one.

    Time is cut into steps of ``within`` and the streams are joined on the step: a left tick
    looks into its own and the one before.  The bounds on time let old state go.
    """
    step = lambda c: F.floor(F.unix_micros(c) / (1_000_000 * within))
    a = left.withWatermark("ts", late).select(F.col("ts").alias("ts_a"), F.col("seq").alias("seq_a"), F.col("price").alias("price_a"), F.explode(F.array(step(F.col("ts")), step(F.col("ts")) - 1)).alias("step_a"))
    b = right.withWatermark("ts", late).select(F.col("ts").alias("ts_b"), F.col("seq").alias("seq_b"), F.col("price").alias("price_b"), step(F.col("ts")).alias("step_b"))
    met = a.join(b, F.expr(f"step_a = step_b AND ts_b <= ts_a AND ts_b >= ts_a - interval {within} seconds"))
    return met.drop("step_a", "step_b")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, or a temporary one where a local test sets none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-stream-")
    return f"{base}/stream-{uuid.uuid4().hex}"


def run_once(stream: DataFrame, folder: str) -> DataFrame:
    """Everything that is there now, through the stream into Parquet, and what was written."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def with_calendar(ticks: DataFrame, calendar: str, folder: str) -> DataFrame:
    """Everything that is there now, each tick with the period of a Parquet calendar that holds it.

    The calendar (start_ts, end_ts and others) is read anew for every micro-batch, so rows that
    are added between two of them count from the next one on.  A batch that is run again after a
    failure writes its own folder again.
    """
    spark = ticks.sparkSession

    def join(batch: DataFrame, number: int) -> None:
        periods = batch.sparkSession.read.parquet(calendar)
        interval_join(batch, periods).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = ticks.writeStream.foreachBatch(join).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")
