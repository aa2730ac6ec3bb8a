"""Validation: every violation of a row in one array, quarantine, guards and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES, DIRECTIONS = ("CALL", "PUT"), ("CALL", "PUT", "SKIP")


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks; a rule that can't be decided counts as broken."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))


def tick_rules(sources: tuple[str, ...]) -> dict[str, Column]:
    """`sources` are the names that a tick's source may have."""
    return {"bid": F.col("bid") > 0, "ask": F.col("ask") > 0, "spread": F.col("bid") <= F.col("ask"), "source": F.col("source").isin(*sources)}


def bar_rules() -> dict[str, Column]:
    inside = lambda c: (F.col(c) >= F.col("low")) & (F.col(c) <= F.col("high"))
    return {"range": F.col("low") <= F.col("high"), "open": inside("open"), "close": inside("close"), "volume": F.col("volume") >= 0}


def trade_rules() -> dict[str, Column]:
    return {"side": F.col("side").isin(*SIDES), "entry_price": F.col("entry_price") > 0, "exit_price": F.col("exit_price") > 0, "duration": F.col("duration_seconds") > 0, "signal_id": F.trim("signal_id") != ""}


def signal_rules() -> dict[str, Column]:
    return {"confidence": F.col("confidence").between(0, 1), "direction": F.col("direction").isin(*DIRECTIONS), "model_version": F.trim("model_version") != ""}


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return df.withColumn("violations", violations(rules))


def split(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, rows in quarantine with their violations)."""
    rows = checked(df, rules)
    return rows.filter("size(violations) = 0").drop("violations"), rows.filter("size(violations) > 0")


def utc(text: Column) -> Column:
    """A naive UTC time from ISO text; null where an offset other than zero is given."""
    offset = F.regexp_extract(text, r"(Z|[+-]\d{2}:?\d{2})$", 1)
    plain = F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "")
    return F.when(offset.isin("", "Z", "+00:00", "+0000", "-00:00", "-0000"), F.try_to_timestamp(plain)).cast("timestamp_ntz")


def mixed_batches(df: DataFrame, batch: str) -> DataFrame:
    """Batches that hold more than one symbol or timeframe."""
    return df.groupBy(batch).agg(F.count_distinct("symbol").alias("symbols"), F.count_distinct("timeframe").alias("timeframes")).filter("symbols > 1 OR timeframes > 1")


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def known_symbols(df: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of listed symbols, other rows); the list is broadcast only if Spark measures it small."""
    return df.join(symbols.select("symbol"), "symbol", "left_semi"), df.join(symbols.select("symbol"), "symbol", "left_anti")


def well_formed_symbol(symbol: Column) -> Column:
    return symbol.rlike("^[A-Z]{6}(_otc)?$")


def missing_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def schema_check(df: DataFrame, wanted: list[str]) -> DataFrame:
    """name, present, rows and filled (rows with a value) of every wanted column, in one pass."""
    have = [F.when(F.lit(c in df.columns), F.count(F.col(c)) if c in df.columns else F.lit(0)).otherwise(0).cast("bigint") for c in wanted]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *(x.alias(f"__{i}") for i, x in enumerate(have)))
    each = F.array(*(F.struct(F.lit(c).alias("name"), F.lit(c in df.columns).alias("present"), F.col("rows"), F.col(f"__{i}").alias("filled")) for i, c in enumerate(wanted)))
    return one.select(F.inline(each))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns all hold finite numbers."""
    out = df
    for c in columns:
        out = out.filter(finite(F.col(c).cast("double")))
    return out


def zero_filled(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(finite(F.col(c).cast("double")), F.col(c)).otherwise(F.lit(0.0)) for c in columns})
