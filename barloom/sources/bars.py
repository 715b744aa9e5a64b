"""Bars and ticks in, step tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import DATE, SYMBOL
from barloom.sources.store import shared_folder, stored  # noqa: F401

OHLCV = ["open", "high", "low", "close", "volume"]
BARS = T.StructType([T.StructField(SYMBOL, T.StringType()), T.StructField(DATE, T.DateType()), *[T.StructField(c, T.DoubleType()) for c in OHLCV]])
# The ten columns of a vendor sheet, all read as text
VENDOR = ["name", "market", "bar_type", "dt", "time", *OHLCV]
VENDOR_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in VENDOR])


def read_vendor(spark: SparkSession, path: str, symbol: str | None = None, fmt: str = "csv", skip: int = 0) -> DataFrame:
    """Rows of vendor sheets as text, with a symbol column: the given one, or that of a folder symbol=..., or the file's
    name without its ending.

    skip: whether CSV files have preamble lines (not 0), however many; they are the ones with fewer than ten fields. A
    line that repeats the names goes in clean(), as its date does not parse.
    """
    read = spark.read.schema(VENDOR_SCHEMA)
    sheet = read.csv(path, mode="PERMISSIVE", header=False) if fmt == "csv" else read.format(fmt).load(path)
    if skip:
        sheet = sheet.where(F.col("volume").isNotNull())
    file = F.input_file_name()
    folder = F.nullif(F.regexp_extract(file, rf"{SYMBOL}=([^/]+)/", 1), F.lit(""))
    name = F.lit(symbol) if symbol is not None else F.coalesce(folder, F.regexp_extract(file, r"([^/]+?)(\.[A-Za-z]+)?$", 1))
    return sheet.select(*VENDOR, name.alias(SYMBOL))


def write_vendor(bars: DataFrame, path: str, date: str = DATE, bar_type: str = "D") -> str:
    """Bars as vendor sheets in CSV, one folder a symbol; the path."""
    text = [F.lit("").alias("name"), F.lit("").alias("market"), F.lit(bar_type).alias("bar_type"), F.col(date).cast("string").alias("dt"), F.lit("").alias("time"), *[F.col(c).cast("string").alias(c) for c in OHLCV]]
    bars.select(SYMBOL, *text).write.mode("overwrite").partitionBy(SYMBOL).csv(path)
    return path


def write_sheets(bars: DataFrame, path: str, preamble: tuple[str, ...] = ("price data", "daily,adjusted"), date: str = DATE, bar_type: str = "D", days: int = 4096) -> str:
    """Bars as sheets that begin with preamble lines and a line of names and have junk rows between, one folder a symbol; the path.

    A sheet holds the bars of a range of days, so that one task does not write a long history."""
    cut = bars.withColumn("__range", F.floor(F.unix_date(date) / days))
    row = F.concat_ws(",", F.lit(""), F.lit(""), F.lit(bar_type), F.col(date).cast("string"), F.lit(""), *[F.col(c).cast("string") for c in OHLCV])
    top = [*preamble, ",".join(VENDOR)]
    heads = cut.select(SYMBOL, "__range").distinct().withColumn("__line", F.explode(F.array(*[F.struct(F.lit(k).alias("at"), F.lit(x).alias("value")) for k, x in enumerate(top)])))
    junk = F.when(F.dayofmonth(date) == 1, F.array(row, F.lit(f",,{bar_type},--------,,-,-,-,-,-"))).otherwise(F.array(row))
    body = cut.select(SYMBOL, "__range", (F.unix_date(date) + (1 << 32)).alias("at"), F.explode(junk).alias("value"))
    lines = heads.select(SYMBOL, "__range", F.col("__line.at").cast("long").alias("at"), F.col("__line.value").alias("value")).unionByName(body)
    lines.repartition(SYMBOL, "__range").sortWithinPartitions(SYMBOL, "__range", "at").select(SYMBOL, "value").write.mode("overwrite").partitionBy(SYMBOL).text(path)
    return path


def clean(sheet: DataFrame, date: str = DATE) -> DataFrame:
    """Bars from a vendor sheet: rows whose date does not parse go, then rows with any field that is no number."""
    number = [F.when(~F.isnan(F.col(c).try_cast("double")), F.col(c).try_cast("double")).alias(c) for c in OHLCV]
    parsed = sheet.select(SYMBOL, F.col("dt").try_cast("date").alias(date), *number)
    return parsed.dropna()


def ticks_of_lineitem(lineitem: DataFrame, symbol: str = "l_returnflag") -> DataFrame:
    """(symbol, dt, price, qty, key) ticks: the unit price of a line on its shipping day; key orders a day's ticks."""
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return lineitem.select(F.col(symbol).alias(SYMBOL), F.to_date("l_shipdate").alias(DATE), (F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("price"), F.col("l_quantity").cast("double").alias("qty"), key.alias("key"))


def daily_bars(ticks: DataFrame) -> DataFrame:
    """First, highest, lowest and last price and summed quantity of each symbol and day."""
    return ticks.groupBy(SYMBOL, DATE).agg(
        F.min_by("price", "key").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "key").alias("close"), F.sum("qty").alias("volume")
    )


def weekly_bars(daily: DataFrame) -> DataFrame:
    """Weeks from Saturday to Friday, dated by that Friday; weeks without a bar have no row."""
    week = F.next_day(F.date_sub(DATE, 1), "FRI").alias("week_end")
    return daily.groupBy(SYMBOL, week).agg(F.min_by("open", DATE).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", DATE).alias("close"), F.sum("volume").alias("volume"))


def repeated_keys(bars: DataFrame, date: str = DATE) -> DataFrame:
    """(symbol, date, n) of keys that stand more than once; operators need this to be empty."""
    return bars.groupBy(SYMBOL, date).agg(F.count("*").alias("n")).where("n > 1")


def select_symbols(bars: DataFrame, *symbols: str) -> DataFrame:
    """Rows of these symbols; unknown ones give nothing."""
    return bars.where(F.col(SYMBOL).isin(*symbols))


def write_step(df: DataFrame, root: str, step: str, fmt: str = "parquet") -> str:
    """Writes a step's table as <root>/<step>/symbol=...; the path."""
    path = f"{root.rstrip('/')}/{step}"
    df.write.mode("overwrite").partitionBy(SYMBOL).format(fmt).save(path)
    return path


def read_step(spark: SparkSession, root: str, step: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(f"{root.rstrip('/')}/{step}").withColumn(SYMBOL, F.col(SYMBOL).cast("string"))
