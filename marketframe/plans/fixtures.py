"""How the given tables stand in for market tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.operators import bars

NUMBERS = ("double", "float", "decimal")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ticks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.col("event_id").alias("seq"))


def hourly(spark: SparkSession, d: str, seconds: int = 3600) -> DataFrame:
    return bars.from_ticks(ticks(spark, d), seconds).withColumn("volume", F.col("ticks").cast("double"))


def results(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a ledger of results: F wins, O loses, P is a draw."""
    o = table(spark, d, "orders")
    outcome = F.when(F.col("o_orderstatus") == "F", "win").when(F.col("o_orderstatus") == "O", "loss").otherwise("draw")
    amount = F.col("o_totalprice") / 1000
    return o.select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"), outcome.alias("outcome"), amount.alias("payout"), amount.alias("stake"), F.col("o_totalprice").alias("open_price"), (F.col("o_totalprice") * F.when(F.col("o_orderkey") % 10 == 0, 0).otherwise(1)).alias("close_price"))


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Times as text and doubles rounded, for comparison between engines."""
    out = []
    for f in df.schema:
        kind = f.dataType.simpleString()
        if kind.startswith("timestamp"):
            out.append(F.date_format(f.name, "yyyy-MM-dd HH:mm:ss").alias(f.name))
        elif kind == "date":
            out.append(F.date_format(f.name, "yyyy-MM-dd").alias(f.name))
        elif kind.startswith(NUMBERS):
            # a zero has one sign, and no value is missing in two ways
            x = F.round(F.col(f.name).cast("double"), digits)
            out.append((F.when(F.isnan(x), None).otherwise(x) + F.lit(0.0)).alias(f.name))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(F.col(f.name).cast("bigint").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


T = "t AS (SELECT event_type AS symbol, ts, value AS price, event_id AS seq FROM events)"


def bars_sql(name: str = "b", seconds: int = 3600, source: str = "t") -> str:
    at = f"to_timestamp(floor(epoch(ts) / {seconds}) * {seconds}) AT TIME ZONE 'UTC'"
    return f"{name} AS (SELECT symbol, {at} AS ts, first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close, count(*) AS ticks, CAST(count(*) AS DOUBLE) AS volume FROM {source} GROUP BY symbol, {at})"


R = "r AS (SELECT o_orderpriority AS symbol, o_orderdate AS ts, o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 'win' WHEN 'O' THEN 'loss' ELSE 'draw' END AS outcome, o_totalprice / 1000 AS payout, o_totalprice / 1000 AS stake, o_totalprice AS open_price, o_totalprice * CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 1 END AS close_price FROM orders)"

SHOW_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
W = "(PARTITION BY symbol ORDER BY ts)"


def rolled(agg: str, x: str, n: int) -> str:
    """A strict rolling aggregate as SQL."""
    w = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} = {n} THEN {agg}({x}) {w} END"


def safe(x: str) -> str:
    return f"(CASE WHEN ({x}) = 0 THEN 1e-9 ELSE ({x}) END)"


def select(names: dict[str, str], source: str, keys: str = f"symbol, {SHOW_TS}") -> str:
    return f"SELECT {keys}, " + ", ".join(f"round({x}, 6) + 0.0 AS {n}" for n, x in names.items()) + f" FROM {source}"
