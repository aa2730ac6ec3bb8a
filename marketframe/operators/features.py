"""Feature columns over bars (symbol, ts, open, high, low, close, volume), as window expressions.

Periods and factors are fixed values. `compat` restores the known faults of older matrices: products
of features left at zero, and longer-timeframe values keyed by the left edge of their own
unfinished bucket; by default a bar sees the last finished bucket only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.functions.recurrence import Ewm, Rolling, ewm, span
from marketframe.functions.windows import by_symbol, flag, nonzero, run_length, running, strict
from marketframe.operators.bars import bucket, resample
from marketframe.operators.quality import zero_filled

VERSION = "1"

# Feature columns by group, in schema order.
GROUPS = {
    "MOMENTUM": ["RSI", "MACD_VALUE", "MACD_SIGNAL", "MACD_HIST", "RETURN_1", "RETURN_3", "MOMENTUM_OSCILLATOR", "CCI"],
    "VOLATILITY": ["ATR", "BB_UPPER_DIST", "BB_LOWER_DIST", "BB_WIDTH", "BB_PERCENT_B", "KC_WIDTH", "NATR", "RELATIVE_VOLUME_RVOL"],
    "PRICE_ACTION": ["BODY_TO_RANGE_RATIO", "UPPER_WICK_TO_BODY_RATIO", "LOWER_WICK_TO_BODY_RATIO", "CONSECUTIVE_BULL_BARS", "CONSECUTIVE_BEAR_BARS", "CLOSE_POSITION_IN_CANDLE", "TWO_BAR_REVERSAL"],
    "CONTEXT": ["HOUR_OF_DAY_NORMALIZED"],
    "MULTI_TIMEFRAME": ["RSI_5T", "TREND_5T", "CLOSE_POS_5T", "RSI_15T", "TREND_15T", "CLOSE_POS_15T"],
    "REGIME": ["VOLATILITY_REGIME", "ADX", "DIST_SMA20", "DIST_SMA50", "DIST_SMA200", "BB_KC_SQUEEZE"],
    "INTERACTION": ["RSI_TREND_5T", "CLOSEPOS_VOLREGIME", "BB_MOMENTUM", "STREAK_TREND", "ADX_RETURN"],
    "LAGGED": [
        "CLOSE_POSITION_IN_CANDLE_LAG1", "CLOSE_POSITION_IN_CANDLE_LAG2", "CLOSE_POSITION_IN_CANDLE_LAG3", "CLOSE_POSITION_IN_CANDLE_LAG5",
        "RETURN_1_LAG1", "RETURN_1_LAG2", "RETURN_1_LAG3", "RETURN_1_LAG5", "RSI_LAG1", "RSI_LAG2", "RSI_LAG3", "RSI_LAG5",
        "RETURN_1_MEAN_5", "RETURN_1_STD_5", "RSI_MEAN_10", "CLOSE_POS_MEAN_5",
    ],
    "SESSION_INTENSITY": ["RVOL_LONDON", "RVOL_NEWYORK", "RVOL_TOKYO"],
}
COLUMNS = [c for group in GROUPS.values() for c in group]
SESSIONS = {"LONDON": (7, 16), "NEWYORK": (12, 21), "TOKYO": (0, 9)}  # first and last hour, UTC
ALIASES = {"RVOL": "RELATIVE_VOLUME_RVOL"}

def c(name: str):
    return F.col(name)


def price_action(df: DataFrame) -> DataFrame:
    w = by_symbol()
    rng, body = nonzero(c("high") - c("low")), c("close") - c("open")
    size = F.abs(body)
    prev, prev_open = F.lag(body).over(w), F.lag("open").over(w)
    out = df.withColumns({
        "BODY_TO_RANGE_RATIO": size / rng,
        "UPPER_WICK_TO_BODY_RATIO": (c("high") - F.greatest("open", "close")) / nonzero(size),
        "LOWER_WICK_TO_BODY_RATIO": (F.least("open", "close") - c("low")) / nonzero(size),
        "TWO_BAR_REVERSAL": flag(((prev < 0) & (body > 0) & (c("close") > prev_open)) | ((prev > 0) & (body < 0) & (c("close") < prev_open))),
        "CLOSE_POSITION_IN_CANDLE": (c("close") - c("low")) / rng,
        "CONSECUTIVE_BULL_BARS": run_length(body > 0),
        "CONSECUTIVE_BEAR_BARS": run_length(body < 0),
    })
    return out


def _with_deltas(df: DataFrame) -> DataFrame:
    w = by_symbol()
    d = c("close") - F.lag("close").over(w)
    prev = F.lag("close").over(w)
    return df.withColumns({
        "__gain": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))),
        "__loss": F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0))),
        "__tr": F.greatest(c("high") - c("low"), F.abs(c("high") - prev), F.abs(c("low") - prev)),
        "__up": F.when(prev.isNotNull(), F.greatest(c("high") - F.lag("high").over(w), F.lit(0.0))),
        "__down": F.when(prev.isNotNull(), F.greatest(F.lag("low").over(w) - c("low"), F.lit(0.0))),
    })


def rsi_of(gain: str, loss: str):
    return 100 - 100 / (1 + c(gain) / nonzero(c(loss)))


WILDER, ADX = 1 / 5, 1 / 14
#: Means that one pass over the bars gives, and those of columns that it gave.
MEANS = {
    "__ag": Ewm("__gain", WILDER, 5), "__al": Ewm("__loss", WILDER, 5), "__fast": Ewm("close", span(6)), "__slow": Ewm("close", span(18)),
    "ATR": Ewm("__tr", WILDER, 5), "__kc": Ewm("close", span(10)), "__pdm": Ewm("__up", ADX, 14), "__mdm": Ewm("__down", ADX, 14), "__atr14": Ewm("__tr", ADX, 14),
}
MEANS_OF_MEANS = {"MACD_SIGNAL": Ewm("MACD_VALUE", span(5)), "ADX": Ewm("__dx", ADX, 14)}


def _of_means(df: DataFrame) -> DataFrame:
    plus, minus = 100 * c("__pdm") / nonzero(c("__atr14")), 100 * c("__mdm") / nonzero(c("__atr14"))
    return df.withColumns({
        "RSI": rsi_of("__ag", "__al"), "MACD_VALUE": c("__fast") - c("__slow"), "__dx": 100 * F.abs(plus - minus) / nonzero(plus + minus),
        "NATR": c("ATR") / nonzero(c("close")) * 100, "KC_WIDTH": 3 * c("ATR") / nonzero(c("__kc")),
    })


def _bare(df: DataFrame) -> DataFrame:
    return df.drop(*[x for x in df.columns if x.startswith("__")])


def recurrent(df: DataFrame) -> DataFrame:
    """RSI, MACD, ATR, KC and ADX: two passes of the scan in one order, the second for means of means."""
    out = ewm(_of_means(ewm(_with_deltas(df), MEANS, in_order=True)), MEANS_OF_MEANS, in_order=True)
    return _bare(out.withColumn("MACD_HIST", c("MACD_VALUE") - c("MACD_SIGNAL")))


FRAMES = {
    "__m10": Rolling("close", 10), "__s10": Rolling("close", 10, "std"), "__tm": Rolling("__tp", 10), "__ts": Rolling("__tp", 10, "std"), "__v10": Rolling("volume", 10),
    **{f"__m{n}": Rolling("close", n) for n in (20, 50, 200)}, **{f"__v_{name}": Rolling(f"__in_{name}", 100) for name in SESSIONS},
}


def _with_returns(df: DataFrame) -> DataFrame:
    w = by_symbol()
    inside = {f"__in_{name}": F.when(F.hour("ts").between(*hours), c("volume")) for name, hours in SESSIONS.items()}
    return df.withColumns({
        "__tp": (c("high") + c("low") + c("close")) / 3,
        "RETURN_1": F.log(c("close") / nonzero(F.lag("close", 1).over(w))),
        "RETURN_3": F.log(c("close") / nonzero(F.lag("close", 3).over(w))),
        "MOMENTUM_OSCILLATOR": c("close") - F.lag("close", 3).over(w),
        "HOUR_OF_DAY_NORMALIZED": (F.hour("ts") + F.minute("ts") / 60) / 24,
        **inside,
    })


def _of_frames(df: DataFrame) -> DataFrame:
    mean, sd = c("__m10"), c("__s10")
    upper, lower = mean + 2 * sd, mean - 2 * sd
    return df.withColumns({
        "CCI": (c("__tp") - c("__tm")) / (0.015 * nonzero(c("__ts"))),
        "BB_WIDTH": (upper - lower) / nonzero(mean),
        "BB_UPPER_DIST": (upper - c("close")) / nonzero(c("close")),
        "BB_LOWER_DIST": (c("close") - lower) / nonzero(c("close")),
        "BB_PERCENT_B": (c("close") - lower) / nonzero(upper - lower),
        "RELATIVE_VOLUME_RVOL": c("volume") / nonzero(c("__v10")),
        **{f"DIST_SMA{n}": (c("close") - c(f"__m{n}")) / nonzero(c(f"__m{n}")) * 100 for n in (20, 50, 200)},
        **{f"RVOL_{name}": F.coalesce(c("volume") / nonzero(c(f"__v_{name}")), F.lit(1.0)) for name in SESSIONS},
    })


def plain_windows(df: DataFrame) -> DataFrame:
    return _bare(_of_frames(ewm(_with_returns(df), FRAMES, in_order=True)))


def timeframe(bars: DataFrame, seconds: int, name: str) -> DataFrame:
    """RSI, trend and close position on bars of a longer bucket."""
    long = _with_deltas(resample(bars, seconds))
    long = ewm(long, {"__ag": Ewm("__gain", 1 / 5, 5), "__al": Ewm("__loss", 1 / 5, 5), "__e5": Ewm("close", span(5)), "__e13": Ewm("close", span(13))})
    high, low = strict(F.max, c("high"), 10), strict(F.min, c("low"), 10)
    return long.select("symbol", c("ts").alias("__bucket"), rsi_of("__ag", "__al").alias(f"RSI_{name}"), F.signum(c("__e5") - c("__e13")).alias(f"TREND_{name}"), ((c("close") - low) / nonzero(high - low)).alias(f"CLOSE_POS_{name}"))


def multi_timeframe(df: DataFrame, bars: DataFrame, step: int, compat: bool = False) -> DataFrame:
    """As-of join of 5 and 15 step features: an equi join on the bucket, then the last value seen."""
    out, every = df, []
    for k in (5, 15):
        long = timeframe(bars, k * step, f"{k}T")
        shift = F.expr(f"interval {0 if compat else k * step} seconds")
        keyed = long.withColumn("__bucket", c("__bucket") + shift)
        names = [f"{x}_{k}T" for x in ("RSI", "TREND", "CLOSE_POS")]
        out = out.withColumn("__bucket", bucket(c("ts"), k * step)).join(keyed, ["symbol", "__bucket"], "left").drop("__bucket")
        every += names
    # a bucket whose predecessor had no bars takes the last one that had
    return out.withColumns({n: F.last(n, True).over(running()) for n in every})


#: Rolling aggregates of features.
FEATURE_FRAMES = {
    "__atr100": Rolling("ATR", 100), "RETURN_1_MEAN_5": Rolling("RETURN_1", 5), "RETURN_1_STD_5": Rolling("RETURN_1", 5, "std"),
    "RSI_MEAN_10": Rolling("RSI", 10), "CLOSE_POS_MEAN_5": Rolling("CLOSE_POSITION_IN_CANDLE", 5),
}


def derived(df: DataFrame, compat: bool = False) -> DataFrame:
    """Regime, interactions and lags of features; `df` has the columns of FEATURE_FRAMES."""
    w = by_symbol()
    zero = F.lit(0.0)
    product = lambda a, b: zero if compat else c(a) * c(b)
    out = df.withColumns({"VOLATILITY_REGIME": c("ATR") / nonzero(c("__atr100")), "BB_KC_SQUEEZE": flag(c("BB_WIDTH") < c("KC_WIDTH"))})
    return out.withColumns({
        "RSI_TREND_5T": product("RSI", "TREND_5T"),
        "CLOSEPOS_VOLREGIME": product("CLOSE_POSITION_IN_CANDLE", "VOLATILITY_REGIME"),
        "BB_MOMENTUM": c("BB_WIDTH") * F.abs("MOMENTUM_OSCILLATOR"),
        "STREAK_TREND": product("CONSECUTIVE_BEAR_BARS", "TREND_5T"),
        "ADX_RETURN": product("ADX", "RETURN_1"),
        "MACD_HIST_SLOPE": (c("MACD_HIST") - F.lag("MACD_HIST", 3).over(w)) / 3,
        **{f"{x}_LAG{n}": F.lag(x, n).over(w) for x in ("CLOSE_POSITION_IN_CANDLE", "RETURN_1", "RSI") for n in (1, 2, 3, 5)},
    })


def transform(bars: DataFrame, step: int = 60, compat: bool = False) -> DataFrame:
    """All feature columns of bars whose step is `step` seconds; incomplete rows keep their nulls.

    Joins see narrow rows. Windows and both passes then share one shuffle and sort by symbol, the lags
    of what the passes gave take another."""
    base = bars.select("symbol", "ts", *(c(x).cast("double").alias(x) for x in ("open", "high", "low", "close", "volume")))
    rows = _with_returns(_with_deltas(price_action(multi_timeframe(base, base, step, compat))))
    rows = _of_frames(_of_means(ewm(rows, MEANS | FRAMES, in_order=True)))
    rows = rows.drop(*[x for x in rows.columns if x.startswith("__") and x != "__dx"])
    rows = ewm(rows, MEANS_OF_MEANS | FEATURE_FRAMES, in_order=True).withColumn("MACD_HIST", c("MACD_VALUE") - c("MACD_SIGNAL"))
    return _bare(derived(rows, compat))


def matrix(bars: DataFrame, step: int = 60, compat: bool = False) -> DataFrame:
    """Complete rows in schema order, stamped with the feature version."""
    return transform(bars, step, compat).select("symbol", "ts", *COLUMNS, F.lit(VERSION).alias("feature_version")).na.drop("any", subset=COLUMNS)


def latest(features: DataFrame) -> DataFrame:
    """Each symbol's last row, non-finite values as 0."""
    values = [x for x in features.columns if x not in ("symbol", "ts", "feature_version")]
    last = features.groupBy("symbol").agg(F.max_by(F.struct(*[x for x in features.columns if x != "symbol"]), "ts").alias("r")).select("symbol", "r.*")
    return zero_filled(last, values)


def expiry_features(features: DataFrame, key: str, rules: dict[str, list[str]]) -> DataFrame:
    """The columns that a rule set names for an expiry, aliases resolved, as far as present."""
    if key not in rules:
        raise ValueError(f"unknown expiry key {key!r}; known: {sorted(rules)}")
    names = [ALIASES.get(x, x) for x in rules[key]]
    return features.select(*[x for x in names if x in features.columns])
