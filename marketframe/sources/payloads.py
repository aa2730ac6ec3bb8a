"""JSON payloads: messages by kind, instruments and payouts, pages of candles.

No message stops a job or a stream: what is missing, short or no number reads as null, and split_ticks()
puts what can't be used in quarantine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.operators import quality
from marketframe.operators.bars import keep_by_key
from marketframe.operators.signals import toggled

NESTED = "array<array<string>>"


def _at(x: Column, n: int) -> Column:
    """Element n (from 1, or from the end) of an array; null where there is none."""
    return F.try_element_at(x, F.lit(n))


def _kind(raw: Column, rows: Column) -> Column:
    has = lambda key: F.get_json_object(raw, f"$.{key}").isNotNull()
    is_list = F.startswith(F.ltrim(raw), F.lit("["))
    width = F.size(_at(rows, 1))
    return (
        F.when(is_list & (width == 4), "tick").when(is_list & (width == 2), "sentiment").when(is_list, "other")
        .when(has("signals"), "signals").when(has("liveBalance") | has("demoBalance"), "balance").when(has("deals"), "deals").when(has("history") | has("candles"), "history").otherwise("other")
    )


def kind(raw: Column) -> Column:
    """What a message is, by its shape: rows of four are ticks, of two sentiment; objects by their keys. An
    empty list, a text that is no JSON, and null are `other`."""
    return _kind(raw, F.from_json(raw, NESTED))


def parsed(messages: DataFrame) -> DataFrame:
    """raw, rows (a message that is a list, parsed once) and kind."""
    rows = messages.select("raw", F.when(F.startswith(F.ltrim("raw"), F.lit("[")), F.from_json("raw", NESTED)).alias("rows"))
    return rows.select("raw", "rows", _kind(F.col("raw"), F.col("rows")).alias("kind"))


def _ticks(messages: DataFrame) -> DataFrame:
    r = _at(F.col("rows"), 1)
    return parsed(messages).filter("kind = 'tick'").select("raw", _at(r, 1).alias("symbol"), _at(r, 2).try_cast("double").alias("time"), _at(r, 3).try_cast("double").alias("price"), _at(r, 4).try_cast("int").alias("direction"))


def ticks(messages: DataFrame) -> DataFrame:
    """symbol, time, price and direction; what is no number is null."""
    return _ticks(messages).drop("raw")


def split_ticks(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ticks that can be used, raw messages in quarantine with what is wrong with them): tick messages
    without a symbol, time or price, and those of no known kind."""
    rules = {"symbol": F.length("symbol") > 0, "time": quality.finite(F.col("time")), "price": quality.finite(F.col("price")) & (F.col("price") > 0)}
    good, bad = quality.split(_ticks(messages), rules)
    unknown = messages.filter(F.coalesce(kind(F.col("raw")) == "other", F.lit(True))).select("raw", F.array(F.lit("kind")).alias("violations"))
    return good.drop("raw"), bad.select("raw", "violations").unionByName(unknown)


def sentiments(messages: DataFrame) -> DataFrame:
    rows = parsed(messages).filter("kind = 'sentiment'").select(F.explode("rows").alias("r"))
    buy = _at(F.col("r"), 2).try_cast("int")
    return rows.select(_at(F.col("r"), 1).alias("asset"), buy.alias("buy"), (100 - buy).alias("sell"))


def candles(messages: DataFrame) -> DataFrame:
    """Candles of history messages: time, open, close, high, low, ticks stand in this order; what is missing
    or no number is null."""
    rows = messages.filter(kind(F.col("raw")) == "history")
    each = rows.select(F.get_json_object("raw", "$.asset").alias("symbol"), F.explode(F.from_json(F.get_json_object("raw", "$.candles"), NESTED)).alias("r"))
    names = ("time", "open", "close", "high", "low", "ticks")
    value = lambda i, n: _at(F.col("r"), i + 1).try_cast("double").try_cast("bigint" if n in ("time", "ticks") else "double")
    return each.select("symbol", *(value(i, n).alias(n) for i, n in enumerate(names)))


def balances(messages: DataFrame) -> DataFrame:
    return messages.filter(kind(F.col("raw")) == "balance").select(F.get_json_object("raw", "$.liveBalance").try_cast("double").alias("live"), F.get_json_object("raw", "$.demoBalance").try_cast("double").alias("demo"))


def deals(messages: DataFrame) -> DataFrame:
    rows = messages.filter(kind(F.col("raw")) == "deals").select(F.explode(F.from_json(F.get_json_object("raw", "$.deals"), "array<struct<id:string,profit:string>>")).alias("d"))
    profit = F.col("d.profit").try_cast("double")
    return rows.select("d.id", profit.alias("profit"), (profit > 0).alias("win"))


def signal_feed(messages: DataFrame) -> DataFrame:
    """asset, direction and duration of feed entries [asset, [{signal, timeFrame}], time]; an entry without a
    signal has none of the latter two."""
    rows = messages.filter(kind(F.col("raw")) == "signals").select(F.explode(F.from_json(F.get_json_object("raw", "$.signals"), NESTED)).alias("s"))
    first = _at(F.from_json(_at(F.col("s"), 2), "array<struct<signal:string,timeFrame:string>>"), 1)
    return rows.select(_at(F.col("s"), 1).alias("asset"), _at(F.col("s"), 3).try_cast("bigint").alias("time"), first["signal"].alias("direction"), first["timeFrame"].try_cast("int").alias("duration"))


def instruments(raw: DataFrame) -> DataFrame:
    """One row per instrument from positional arrays: fixed places from the front and from the end; places
    that a short array lacks are null."""
    rows = raw.select(F.explode(F.from_json("raw", NESTED)).alias("i"))
    at = lambda n: _at(F.col("i"), n)
    clean = lambda x: F.regexp_replace(x, "\n", "")
    number = lambda n: at(n).try_cast("double")
    return rows.select(
        at(1).try_cast("bigint").alias("id"), clean(at(2)).alias("asset"), clean(at(3)).alias("name"), number(6).alias("payment"), at(15).try_cast("boolean").alias("open"), number(19).alias("turbo_payment"),
        number(-10).alias("profit_24h"), number(-9).alias("profit_1m"), number(-8).alias("profit_5m"),
    )


def payout(table: DataFrame, timeframe: str = "1") -> DataFrame:
    names = {"1": "profit_1m", "5": "profit_5m", "24H": "profit_24h"}
    return table.select("asset", F.col(names[timeframe]).alias("payout"))


def available(wanted: DataFrame, table: DataFrame) -> DataFrame:
    """The asset to use for each wanted one: itself if open, else its other market if that is open."""
    open_ = table.filter("open").select("asset")
    out = wanted.join(open_.withColumn("a", F.col("asset")), "asset", "left")
    out = out.withColumn("__other", toggled(F.col("asset"))).join(open_.select(F.col("asset").alias("__other"), F.col("asset").alias("b")), "__other", "left")
    return out.withColumn("use", F.coalesce("a", "b")).drop("a", "b", "__other")


def merge_pages(pages: DataFrame, order: str = "page_seq") -> DataFrame:
    """Candles of overlapping pages, the first seen of each time."""
    return keep_by_key(pages, ["symbol", "time"], [order], last=False).drop(order)
