"""Scans: tick files, bar tables, text tables in doubtful encodings, run configurations."""

from __future__ import annotations

import ast
import csv
import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.operators.clean import carried_value, to_number

#: Columns of a tick file and their types (fixed values); depth beyond level 1 may be absent.
TICK_COLUMNS = {"datetime": "timestamp", "last": "double", "volume": "long", "total_turnover": "double", "open_interest": "long"} | {
    f"{side}{i}{end}": kind for i in range(1, 6) for side in "ba" for end, kind in (("", "double"), ("_v", "long"))
}
OPTIONAL = ("trading_date", "dominant_id", "order_book_id")


def read_ticks(spark: SparkSession, path: str, start_date: str | None = None) -> DataFrame:
    """Tick files of many days as one table, missing depth levels as NULL columns.

    The day comes from the partition column ``trading_date`` or else from the file name
    (``..._YYYY-MM-DD.parquet``); ``start_date`` prunes partitions or files' rows by it.
    """
    raw = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "false").parquet(path)
    day = F.col("trading_date").cast("date") if "trading_date" in raw.columns else F.to_date(F.regexp_extract("_metadata.file_name", r"(\d{4}-\d{2}-\d{2})\.parquet$", 1))
    picked = [(F.col(c) if c in raw.columns else F.lit(None)).cast(kind).alias(c) for c, kind in TICK_COLUMNS.items()]
    extra = [F.col(c) for c in (*OPTIONAL[1:], "symbol") if c in raw.columns]
    out = raw.select(day.alias("trading_date"), *picked, *extra)
    return out.where(F.col("trading_date") >= F.lit(start_date).cast("date")) if start_date else out


def symbols(spark: SparkSession, path: str) -> DataFrame:
    """Symbols that have files, from the partition column alone."""
    return spark.read.parquet(path).select("symbol").distinct()


#: Encodings of text tables, in the order in which they are tried (fixed values).
ENCODINGS = ("utf-8", "gbk", "gb18030", "latin1")


@F.pandas_udf(T.IntegerType())
def _readable(raw: pd.Series) -> pd.Series:
    """Bit k is set if ``ENCODINGS[k]`` reads the bytes."""

    def bits(line: bytes) -> int:
        out = 0
        for k, name in enumerate(ENCODINGS):
            try:
                line.decode(name)
                out |= 1 << k
            except UnicodeDecodeError:
                pass
        return out

    return raw.map(bits)


@F.pandas_udf(T.StringType())
def _decoded(raw: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series([line.decode(name) for line, name in zip(raw, encoding, strict=True)])


def read_csv(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header, each file in the first of ``ENCODINGS`` that reads all of it; all strings without a schema.

    Every file has a header of its own, read in the encoding of the file; its values go to the
    columns that it names, in whatever order, and columns that it lacks are NULL.  Columns come
    in the order in which files, by path, name them; ``schema`` picks and casts them, NULL where
    a value is none of the type.  Later lines equal to the header are left out too.

    Files are read by lines, so a quoted value holds no line break.  Lines that are UTF-8 as
    they stand stay in the JVM; only files with others are decoded by Python.  Files are listed
    by the driver, so one row a file may be collected and broadcast.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    lines = spark.read.text(path).select("value", F.col("value").cast("binary").alias("raw"), F.col("_metadata.file_path").alias("file"), place.alias("place"))
    heads = lines.where(F.trim("value") != "").groupBy("file").agg(F.min_by("raw", "place").alias("head"))
    others = lines.where(~F.is_valid_utf8("value")).groupBy("file").agg(F.bit_and(_readable("raw")).alias("bits"))
    name = F.coalesce(*(F.when(F.col("bits").bitwiseAND(1 << k) != 0, F.lit(e)) for k, e in enumerate(ENCODINGS)))
    files = heads.join(others, "file", "left").select("file", name.alias("encoding"), _decoded("head", F.coalesce(name, F.lit("utf-8"))).alias("head")).orderBy("file").collect()
    if not files:
        raise ValueError(f"no lines in {path}")
    heads = list(dict.fromkeys(f.head.lstrip("\ufeff").rstrip("\r") for f in files))
    named = [[n or f"_c{k}" for k, n in enumerate(next(csv.reader([h])))] for h in heads]
    known = spark.createDataFrame([(f.file, f.encoding, heads.index(f.head.lstrip("\ufeff").rstrip("\r"))) for f in files], "file string, encoding string, head int")
    lines = lines.drop("place").join(F.broadcast(known), "file")
    plain = lines.where("encoding is null").select("head", "value")
    lines = plain.unionByName(lines.where("encoding is not null").select("head", _decoded("raw", "encoding").alias("value"))).where(F.trim("value") != "")
    lines = lines.withColumn("value", F.ltrim("value", F.lit("\ufeff")))
    rows = lines.where(F.rtrim("value", F.lit("\r")) != F.element_at(F.array(*map(F.lit, heads)), F.col("head") + 1))
    width = max(map(len, named))
    rows = rows.select("head", F.from_csv("value", ", ".join(f"v{k} string" for k in range(width)), {"mode": "PERMISSIVE"}).alias("row"))

    def value(column: str) -> Column:
        held = [(h, names.index(column)) for h, names in enumerate(named) if column in names]
        return F.coalesce(*(F.when(F.col("head") == h, F.col(f"row.v{k}")) for h, k in held)) if held else F.lit(None).cast("string")

    if schema is None:
        kinds = {c: "string" for names in named for c in names}
    else:
        kinds = {f.name: f.dataType.simpleString() for f in (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)}
    df = rows.select(*((value(c) if kind == "string" else F.trim(value(c)).try_cast(kind)).alias(c) for c, kind in kinds.items()))
    return df.select(*columns) if columns else df


#: Names that a time index may have, in order of preference (fixed values).
INDEX_NAMES = ("date", "datetime", "trading_date", "Unnamed: 0", "_c0")


def with_index(df: DataFrame) -> DataFrame:
    """``ts`` from the first index-like column, and every ``x_`` or ``y_`` column as a number.

    Missing index values are filled from the rows before them, in the order of the file, and
    then parsed.
    """
    name = next((n for n in INDEX_NAMES if n in df.columns), None)
    if name is None:
        raise ValueError(f"no index column among {INDEX_NAMES}")
    numbers = {c: to_number(c) for c, kind in df.dtypes if c[:2] in ("x_", "y_") and kind == "string"}
    # Row numbers hold the number of the partition in their upper bits.
    placed = df.withColumn("_row", F.monotonically_increasing_id()).withColumns({"_all": F.lit(0), "_part": F.shiftright("_row", 33)})
    filled = carried_value(placed, ["_all"], "_part", ["_row"], name, "_index").drop("_row", "_all", "_part")
    return filled.drop(*({name} - {"ts"})).withColumn("ts", F.col("_index").try_cast("timestamp")).drop("_index").withColumns(numbers)


def parse_run_config(text: str) -> dict:
    """JSON run configuration; lists that were saved as their string form are read back."""
    config = json.loads(text)
    for key, value in list(config.items()):
        if isinstance(value, str) and value.strip()[:1] in "[({":
            try:
                config[key] = ast.literal_eval(value)
            except (ValueError, SyntaxError):
                pass
    return config


def parse_path_list(text: str) -> list[tuple[str, bool]]:
    """(path, marked) per line; ``#`` starts a comment, a trailing ``^`` marks a path."""
    lines = (line.split("#")[0].strip() for line in text.splitlines())
    return [(line.rstrip("^").strip(), line.endswith("^")) for line in lines if line]
