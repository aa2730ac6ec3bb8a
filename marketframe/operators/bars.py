"""Bars: buckets of ticks, roll-ups, merges, grids and bounded fill.

Ticks have symbol, ts (timestamp), price, seq (order among equal times); bars have symbol, ts, open,
high, low, close, volume. Bars of a symbol are bounded by calendar time, so windows per symbol are;
ticks are not, and are only ever aggregated by (symbol, bucket) with partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.functions.windows import by_symbol

PERIODS = (60, 120, 180, 300, 600, 900, 1800, 3600, 7200, 14400, 86400)


def bucket(ts: Column, seconds: int) -> Column:
    """Start of the bucket that a time falls into."""
    s = F.unix_timestamp(ts.cast("timestamp"))
    return F.timestamp_seconds(s - F.pmod(s, F.lit(seconds))).cast("timestamp_ntz")


def from_ticks(ticks: DataFrame, seconds: int, drop_open: bool = False) -> DataFrame:
    """OHLC bars and tick counts by event time; `drop_open` leaves out each symbol's last bucket."""
    t = F.struct("ts", "seq")
    bars = ticks.groupBy("symbol", bucket(F.col("ts"), seconds).alias("ts_")).agg(
        F.min_by("price", t).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", t).alias("close"), F.count(F.lit(1)).alias("ticks")
    ).withColumnRenamed("ts_", "ts")
    if not drop_open:
        return bars
    last = F.max("ts").over(Window.partitionBy("symbol"))
    return bars.withColumn("__last", last).filter("ts < __last").drop("__last")


def candles_in_order(ticks: DataFrame, seconds: int) -> DataFrame:
    """Bars with their end and tick count, all buckets but the open one."""
    return from_ticks(ticks, seconds, drop_open=True).withColumn("end_ts", F.timestamp_seconds(F.unix_timestamp(F.col("ts").cast("timestamp")) + seconds).cast("timestamp_ntz"))


def roll_up(partials: DataFrame, seconds: int) -> DataFrame:
    """Partial candles (symbol, ts, seq, open, high, low, close) as one candle for each bucket."""
    t = F.struct("ts", "seq")
    return partials.groupBy("symbol", bucket(F.col("ts"), seconds).alias("ts_")).agg(F.min_by("open", t).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", t).alias("close")).withColumnRenamed("ts_", "ts")


def current(bars: DataFrame, seconds: int, now: Column) -> DataFrame:
    """Each symbol's newest candle with its opening, closing and remaining seconds."""
    newest = bars.groupBy("symbol").agg(F.max_by(F.struct(*[c for c in bars.columns if c != "symbol"]), "ts").alias("b")).select("symbol", "b.*")
    opening = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return newest.withColumns({"opening": opening, "closing": opening + seconds, "remaining": opening + seconds - now})


def keep_by_key(df: DataFrame, key: list[str], by: list[str], last: bool = True) -> DataFrame:
    """One row for each key: the one with the largest `by`, or the smallest unless `last`; ties go by the
    other columns. Rows of one key are reduced before they are shuffled."""
    rest = [c for c in df.columns if c not in key and c not in by]
    row = F.struct(*by, *rest)
    best = df.groupBy(*key).agg((F.max(row) if last else F.min(row)).alias("__row"))
    return best.select(*(F.col(c) if c in key else F.col(f"__row.{c}").alias(c) for c in df.columns))


def merge(batches: DataFrame, seq: str = "seq") -> DataFrame:
    """One bar for each (symbol, ts): the last in."""
    return keep_by_key(batches, ["symbol", "ts"], [seq])


def splice(history: DataFrame, live: DataFrame) -> DataFrame:
    """History without its first candle, and live candles, which win."""
    first = F.min("ts").over(Window.partitionBy("symbol"))
    old = history.withColumn("__f", first).filter("ts > __f").drop("__f").withColumn("seq", F.lit(0))
    return merge(old.unionByName(live.withColumn("seq", F.lit(1)))).drop("seq")


def newest(df: DataFrame, n: int, order: str = "ts") -> DataFrame:
    """The newest n rows of each symbol."""
    return df.withColumn("__k", F.row_number().over(by_symbol(F.desc(order)))).filter(F.col("__k") <= n).drop("__k")


def grid(bars: DataFrame, seconds: int, columns: list[str], most: int = 20_000_000) -> DataFrame:
    """Every bucket from a symbol's first to its last; per column the last value in it, or null. A symbol of
    over `most` buckets (38 years of minutes) is an error: one odd time would make as many rows."""
    found = bars.groupBy("symbol", bucket(F.col("ts"), seconds).alias("ts_")).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c) for c in columns)).withColumnRenamed("ts_", "ts")
    ends = found.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    first, last = (F.unix_timestamp(F.col(x).cast("timestamp")) for x in "az")
    far = F.raise_error(F.concat(F.lit("too many buckets from the first to the last time of symbol "), "symbol")).cast("array<bigint>")
    steps = F.when((last - first) / seconds >= most, far).otherwise(F.sequence(first, last, F.lit(seconds).cast("bigint")))
    slots = ends.select("symbol", F.explode(steps).alias("s")).select("symbol", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"))
    return slots.join(found, ["symbol", "ts"], "left")


def fill(gridded: DataFrame, columns: list[str], limit: int = 5) -> DataFrame:
    """Nulls of a grid filled from at most `limit` slots before."""
    w = by_symbol().rowsBetween(-limit, 0)
    return gridded.withColumns({c: F.last(c, True).over(w) for c in columns})


def resample(bars: DataFrame, seconds: int) -> DataFrame:
    """OHLCV of longer buckets; buckets without a bar are left out."""
    return bars.groupBy("symbol", bucket(F.col("ts"), seconds).alias("ts_")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    ).withColumnRenamed("ts_", "ts")


def history(bars: DataFrame, seconds: int, periods: int = 50) -> DataFrame:
    """The bars that an indicator over `periods` needs; the bucket length must be a known one."""
    if seconds not in PERIODS:
        raise ValueError(f"period {seconds} is none of {PERIODS}")
    return newest(bars, max(periods, 50))


def colour(open_: Column, close: Column) -> Column:
    return F.when(open_ < close, "green").when(open_ > close, "red").when(open_ == close, "gray")
