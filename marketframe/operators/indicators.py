"""Indicators by name over bars. Full precision inside recurrences; round only what is shown.

Each function adds its columns to the bars; rows before the warm part hold null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.functions.recurrence import Ewm, ewm, span
from marketframe.functions.windows import by_symbol, nonzero, strict

c = F.col


def sma(df: DataFrame, period: int = 14, x: str = "close") -> DataFrame:
    return df.withColumn("SMA", strict(F.avg, c(x), period))


def _moves(df: DataFrame) -> DataFrame:
    w = by_symbol()
    prev = F.lag("close").over(w)
    d = c("close") - prev
    up, down = c("high") - F.lag("high").over(w), F.lag("low").over(w) - c("low")
    return df.withColumns({
        "__gain": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), "__loss": F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0))),
        "__tr": F.when(prev.isNotNull(), F.greatest(c("high") - c("low"), F.abs(c("high") - prev), F.abs(c("low") - prev))),
        "__pdm": F.when(prev.isNotNull(), F.when((up > down) & (up > 0), up).otherwise(0.0)),
        "__mdm": F.when(prev.isNotNull(), F.when((down > up) & (down > 0), down).otherwise(0.0)),
    })


def _bare(df: DataFrame) -> DataFrame:
    return df.drop(*[x for x in df.columns if x.startswith("__")])


def recurrent(df: DataFrame, names: list[str], period: int = 14, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Any of EMA, RSI, MACD, ATR and ADX with all their means in one ordered pass; ADX and MACD take
    a second pass over the same order for their means of means.

    EMA is seeded with the mean of the first `period` values; RSI, ATR and ADX are Wilder's, seeded
    alike, a zero loss counts as 1e-5; true ranges start at the second bar; of two opposite moves the
    larger counts, as means of moves over means of ranges."""
    mean = lambda x: Ewm(x, 1 / period, seed=period)
    first = {
        "EMA": {"EMA": Ewm("close", span(period), seed=period)},
        "RSI": {"__ag": mean("__gain"), "__al": mean("__loss")},
        "ATR": {"ATR": mean("__tr")},
        "ADX": {"__p": mean("__pdm"), "__m": mean("__mdm"), "__t": mean("__tr")},
        "MACD": {"__f": Ewm("close", span(fast), seed=fast), "__s": Ewm("close", span(slow), seed=slow)},
    }
    rows = _moves(df) if {"RSI", "ATR", "ADX"} & set(names) else df
    out, second = ewm(rows, {k: e for n in names for k, e in first[n].items()}), {}
    if "RSI" in names:
        out = out.withColumn("RSI", 100 - 100 / (1 + c("__ag") / F.when(c("__al") == 0, 1e-5).otherwise(c("__al"))))
    if "ADX" in names:
        out = out.withColumns({"PLUS_DI": 100 * c("__p") / nonzero(c("__t")), "MINUS_DI": 100 * c("__m") / nonzero(c("__t"))})
        out = out.withColumn("__dx", 100 * F.abs(c("PLUS_DI") - c("MINUS_DI")) / nonzero(c("PLUS_DI") + c("MINUS_DI")))
        second["ADX"] = mean("__dx")
    if "MACD" in names:
        out = out.withColumn("MACD", c("__f") - c("__s"))
        second["SIGNAL"] = Ewm("MACD", span(signal), seed=signal)
    out = ewm(out, second, in_order=True) if second else out
    return _bare(out.withColumn("HISTOGRAM", c("MACD") - c("SIGNAL")) if "MACD" in names else out)


def ema(df: DataFrame, period: int = 14, x: str = "close", out: str = "EMA") -> DataFrame:
    """Seeded with the mean of the first `period` values."""
    return ewm(df, {out: Ewm(x, span(period), seed=period)})


def rsi(df: DataFrame, period: int = 14) -> DataFrame:
    return recurrent(df, ["RSI"], period)


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    return recurrent(df, ["MACD"], fast=fast, slow=slow, signal=signal)


def atr(df: DataFrame, period: int = 14) -> DataFrame:
    return recurrent(df, ["ATR"], period)


def adx(df: DataFrame, period: int = 14) -> DataFrame:
    return recurrent(df, ["ADX"], period)


def bollinger(df: DataFrame, period: int = 20, width: float = 2.0) -> DataFrame:
    """Population deviation."""
    mean, sd = strict(F.avg, c("close"), period), strict(F.stddev_pop, c("close"), period)
    return df.withColumns({"MIDDLE": mean, "UPPER": mean + width * sd, "LOWER": mean - width * sd})


def stochastic(df: DataFrame, k: int = 14, d: int = 3) -> DataFrame:
    high, low = strict(F.max, c("high"), k), strict(F.min, c("low"), k)
    out = df.withColumn("K", F.when(high == low, 100.0).otherwise((c("close") - low) / (high - low) * 100))
    return out.withColumn("D", strict(F.avg, c("K"), d))


def ichimoku(df: DataFrame, tenkan: int = 9, kijun: int = 26, senkou: int = 52) -> DataFrame:
    """Midpoints of ranges, aligned in time: spans as computed at the row `kijun` before, and the
    close `kijun` rows ahead as the lagging span."""
    w = by_symbol()
    mid = lambda n: (strict(F.max, c("high"), n) + strict(F.min, c("low"), n)) / 2
    out = df.withColumns({"TENKAN": mid(tenkan), "KIJUN": mid(kijun), "__b": mid(senkou)})
    out = out.withColumns({"SENKOU_A": F.lag((c("TENKAN") + c("KIJUN")) / 2, kijun).over(w), "SENKOU_B": F.lag("__b", kijun).over(w), "CHIKOU": F.lead("close", kijun).over(w)})
    return out.drop("__b")


BY_NAME = {"SMA": sma, "EMA": ema, "RSI": rsi, "MACD": macd, "BOLLINGER": bollinger, "STOCHASTIC": stochastic, "ATR": atr, "ADX": adx, "ICHIMOKU": ichimoku}


def indicator(df: DataFrame, name: str, **params) -> DataFrame:
    """Dispatch by name, upper or lower case."""
    if name.upper() not in BY_NAME:
        raise ValueError(f"unknown indicator {name!r}; known: {sorted(BY_NAME)}")
    return BY_NAME[name.upper()](df, **params)


def last_values(df: DataFrame, names: list[str]) -> DataFrame:
    """Each symbol's newest time and values."""
    return df.groupBy("symbol").agg(F.max_by(F.struct("ts", *names), "ts").alias("r")).select("symbol", "r.*")


def quick_rsi(df: DataFrame, period: int = 14) -> DataFrame:
    """RSI from plain sums of the last deltas; no loss gives 100."""
    out = _moves(df)
    gain, loss = strict(F.avg, c("__gain"), period), strict(F.avg, c("__loss"), period)
    return _bare(out.withColumn("RSI", F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / loss))))


def quick_sma(df: DataFrame, period: int = 14) -> DataFrame:
    """Mean of the last values, of all there are while the series is short."""
    return df.withColumn("SMA", F.avg("close").over(by_symbol().rowsBetween(-(period - 1), 0)))


def cross_rule(df: DataFrame, low: float = 30, high: float = 70) -> DataFrame:
    """call where RSI crosses `low` upwards above the mean, put where it crosses `high` downwards below it."""
    prev = F.lag("RSI").over(by_symbol())
    call = (prev < low) & (c("RSI") > low) & (c("close") > c("SMA"))
    put = (prev > high) & (c("RSI") < high) & (c("close") < c("SMA"))
    return df.withColumn("rule", F.when(call, "call").when(put, "put"))
