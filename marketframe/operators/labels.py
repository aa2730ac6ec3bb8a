"""Labels, joins of features with labels, time-ordered splits and sequence windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.functions.recurrence import Ewm, ewm
from marketframe.functions.windows import by_symbol

HORIZONS = {"1_MIN": 1, "5_MIN": 5, "15_MIN": 15}  # rows ahead


def direction(bars: DataFrame, key: str = "1_MIN", min_move_atr: float = 0.0) -> DataFrame:
    """label: 1 if the close `horizon` rows ahead is higher, else 0; -1 where the move is below
    min_move_atr times the ATR (5); null at the tail, which has no future."""
    if key not in HORIZONS:
        raise ValueError(f"unknown expiry key {key!r}; known: {sorted(HORIZONS)}")
    ahead = F.lead("close", HORIZONS[key]).over(by_symbol())
    out = bars
    label = F.when(ahead.isNotNull(), F.when(ahead > F.col("close"), 1).otherwise(0))
    if min_move_atr > 0:
        if "ATR" not in bars.columns:
            prev = F.lag("close").over(by_symbol())
            tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
            out = ewm(out.withColumn("__tr", tr), {"ATR": Ewm("__tr", 1 / 5, 5)}).drop("__tr")
        label = F.when(F.abs(ahead - F.col("close")) < min_move_atr * F.col("ATR"), -1).otherwise(label)
    return out.withColumn("label", label.cast("int"))


def metadata(labels: DataFrame) -> DataFrame:
    """Per symbol: labels, calls, puts, skipped, and shares of calls and puts to 4 places."""
    one = lambda v: F.count_if(F.col("label") == v)
    out = labels.groupBy("symbol").agg(F.count("label").alias("total"), one(1).alias("calls"), one(0).alias("puts"), one(-1).alias("skipped"))
    return out.withColumns({"call_pct": F.round(F.col("calls") / F.greatest(F.col("total"), F.lit(1)), 4), "put_pct": F.round(F.col("puts") / F.greatest(F.col("total"), F.lit(1)), 4)})


def labelled(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features with their label, rows without a usable label left out."""
    return features.join(labels.select("symbol", "ts", "label"), ["symbol", "ts"]).filter("label >= 0")


def time_split(rows: DataFrame, train: float = 0.70, validate: float = 0.15, least: int = 100) -> DataFrame:
    """split: train, val or test by place in time, cut at floor(n r) per symbol; symbols with fewer
    than `least` rows are left out."""
    place = F.row_number().over(by_symbol()) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    out = rows.withColumns({"__i": place, "__n": n}).filter(F.col("__n") >= least)
    a, b = F.floor(F.col("__n") * train), F.floor(F.col("__n") * train) + F.floor(F.col("__n") * validate)
    return out.withColumn("split", F.when(F.col("__i") < a, "train").when(F.col("__i") < b, "val").otherwise("test")).drop("__i", "__n")


def sequences(rows: DataFrame, columns: list[str], width: int = 30, last: bool = False, least: int = 10) -> DataFrame:
    """symbol, ts, label and window: the `width` rows up to each row. The last window of a symbol is
    left out unless `last`; symbols with fewer than `least` windows are left out."""
    w = by_symbol()
    vector = F.array(*(F.col(c).cast("double") for c in columns))
    out = rows.withColumns({"__v": vector, "__i": F.row_number().over(w), "__n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    out = out.withColumn("window", F.collect_list("__v").over(w.rowsBetween(-(width - 1), 0)))
    out = out.filter((F.col("__i") >= width) & (F.col("__n") - width + int(last) >= least))
    if not last:
        out = out.filter(F.col("__i") < F.col("__n"))
    return out.select("symbol", "ts", "label", "window")


def reward(action: Column, label: Column, payout: float = 0.85) -> Column:
    """0 for SKIP, the payout for the right direction, -1 for the wrong one."""
    right = ((action == "CALL") & (label == 1)) | ((action == "PUT") & (label == 0))
    return F.when(action == "SKIP", 0.0).when(right, payout).otherwise(-1.0)


def policy(rows: DataFrame, payout: float = 0.85) -> DataFrame:
    """Mean, deviation (population, plus 1e-9), their ratio and steps of rewards per symbol."""
    out = rows.withColumn("reward", reward(F.col("action"), F.col("label"), payout)).groupBy("symbol").agg(F.avg("reward").alias("mean"), (F.stddev_pop("reward") + 1e-9).alias("std"), F.count(F.lit(1)).alias("steps"))
    return out.withColumn("ratio", F.col("mean") / F.col("std"))


def class_weight(rows: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """`rows` with weight: negatives over positives for label 1, else 1; within each `key` if one is
    given. Pass the rows that are trained on only."""
    ratio = (F.count_if(F.col("label") == 0) / F.greatest(F.count_if(F.col("label") == 1), F.lit(1))).alias("__r")
    found = rows.groupBy(*key).agg(ratio) if key else rows.agg(ratio)
    joined = rows.join(found, list(key)) if key else rows.join(F.broadcast(found))  # one row
    return joined.withColumn("weight", F.when(F.col("label") == 1, F.col("__r")).otherwise(1.0)).drop("__r")
