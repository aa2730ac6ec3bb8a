"""Stored tables: scans, upserts, ledgers, statistics and load plans.

Bars are stored as Parquet by symbol, timeframe and month, features by symbol and expiry, ledgers and
the registry as append-only Parquet. The schema version stands in each column's metadata; every read
and every write to an existing table checks it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "1"
PARTITIONS = ("symbol", "timeframe", "month", "expiry_key", "batch")
BARS = "symbol string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


class SchemaMismatch(ValueError):
    """The stored version is not the one this code writes."""


def stamped(df: DataFrame, version: str = VERSION) -> DataFrame:
    """`df` with the version in every column's metadata."""
    return df.select(*(F.col(f.name).alias(f.name, metadata={**f.metadata, "schema_version": version}) for f in df.schema))


def check_version(df: DataFrame, version: str = VERSION) -> DataFrame:
    found = {f.metadata.get("schema_version") for f in df.schema if f.name not in PARTITIONS}
    if found != {version}:
        raise SchemaMismatch(f"stored version {sorted(map(str, found))}, expected {version}")
    return df


_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; in local mode, where that is unset, a temporary one."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root and (context.master == "local" or context.master.startswith("local[")):
        root = _LOCAL.setdefault("root", tempfile.mkdtemp(prefix="marketframe-"))
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _file_system(spark, path)
    return fs.exists(jpath)


def remove(spark: SparkSession, path: str) -> None:
    fs, jpath = _file_system(spark, path)
    fs.delete(jpath, True)


def stored(spark: SparkSession, path: str, version: str = VERSION) -> DataFrame:
    """A stored table whose version is the one this code writes; another version is an error."""
    return check_version(spark.read.parquet(path), version)


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def _place(*columns: str) -> Column:
    """One value for a partition; U+001F stands in no symbol."""
    return F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in columns))


def only_partitions(rows: DataFrame, wanted: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows of a stored table in the partitions that `wanted` lists (`columns` of both).

    A semi join with the broadcast list, whose values prune the scan's partitions while the query runs: the
    driver neither collects them nor builds a filter of them, however many there are. The list has a row for
    each partition, of which the driver's file index holds all anyway."""
    places = wanted.select(_place(*columns).alias("__place")).distinct().filter("__place > ''")  # Spark prunes by filtered sides
    return rows.join(F.broadcast(places), _place(*columns) == F.col("__place"), "left_semi")


def tail_months(rows: DataFrame, max_rows: int) -> DataFrame:
    """symbol and month of the partitions that the newest `max_rows` rows of each symbol reach into, from
    row counts by partition, which read no column of the files."""
    held = rows.groupBy("symbol", "month").count()
    newer = F.coalesce(F.sum("count").over(Window.partitionBy("symbol").orderBy(F.desc("month")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.withColumn("newer", newer).filter(F.col("newer") < max_rows).select("symbol", "month")


def scan_bars(spark: SparkSession, path: str, symbols: list[str] | None = None, timeframe: str = "M1", max_rows: int | None = None) -> DataFrame:
    """Bars of a timeframe, newest `max_rows` of each symbol; symbol, timeframe and, with `max_rows`, the
    months that each symbol's own newest rows lie in prune partitions. A missing table is empty."""
    columns = T.StructType.fromDDL(BARS).names
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType.fromDDL(BARS))
    rows = stored(spark, path).withColumn("month", F.col("month").cast("string")).filter(F.col("timeframe") == timeframe)
    rows = rows if symbols is None else rows.filter(F.col("symbol").isin(symbols))
    if max_rows is None:
        return rows.select(*columns)
    rows = only_partitions(rows, tail_months(rows, max_rows), ("symbol", "month"))
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    return rows.withColumn("__k", rank).filter(F.col("__k") <= max_rows).select(*columns)


def scan_ticks(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("symbol") == symbol)


def upserted(stored: DataFrame, new: DataFrame, key: tuple[str, ...] = ("symbol", "timeframe", "ts"), seq: str | None = None) -> DataFrame:
    """Stored rows with new ones in their place; of new rows with one key the last in (by `seq`, then by
    value). Rows of one key are reduced before they are shuffled."""
    values = [c for c in stored.columns if c not in key]
    order = lambda place, number: F.struct(F.lit(place).alias("in"), number.cast("bigint").alias("seq"), *values).alias("__row")
    both = stored.select(*key, order(0, F.lit(0))).unionByName(new.select(*key, order(1, F.col(seq) if seq else F.lit(0))))
    best = both.groupBy(*key).agg(F.max("__row").alias("__row"))
    return best.select(*(F.col(c) if c in key else F.col(f"__row.{c}").alias(c) for c in stored.columns))


def complete_only(bars: DataFrame) -> DataFrame:
    return bars.filter("is_complete").drop("is_complete")


def write_bars(spark: SparkSession, path: str, new: DataFrame, seq: str | None = None) -> None:
    """Upserts bars; only partitions (symbol, timeframe, month) that `new` touches are read and rewritten.
    A table of another version is an error. Two writers of one partition at a time are not supported."""
    rows = complete_only(new) if "is_complete" in new.columns else new
    rows = rows.withColumn("month", month(F.col("ts")))
    columns = [*T.StructType.fromDDL(BARS).names, "month"]
    if exists(spark, path):
        old = stored(spark, path).withColumn("month", F.col("month").cast("string")).select(*columns)
        old = only_partitions(old, rows, ("symbol", "timeframe", "month"))
    else:
        old = spark.createDataFrame([], T.StructType.fromDDL(BARS + ", month string"))
    merged = stamped(upserted(old, rows, ("symbol", "timeframe", "month", "ts"), seq).select(*columns))
    # rows of the touched partitions are staged, as Spark can't overwrite what a query still reads
    staged = f"{path.rstrip('/')}__staged-{uuid.uuid4().hex}"
    merged.write.parquet(staged)
    spark.read.schema(merged.schema).parquet(staged).repartition("symbol", "timeframe", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "timeframe", "month").parquet(path)
    remove(spark, staged)


def stats(df: DataFrame) -> DataFrame:
    """Rows, first and last time per symbol."""
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def append(path: str, rows: DataFrame) -> None:
    """Appends to a ledger; rows carry a `seq` that grows with each append. A ledger of another version
    is an error."""
    if exists(rows.sparkSession, path):
        stored(rows.sparkSession, path)
    stamped(rows).write.mode("append").parquet(path)


def append_batch(path: str, rows: DataFrame, batch: int) -> None:
    """Appends a stream's batch to a ledger, in a folder of its number: a batch that is run again after a
    failure replaces what it had written before, so that no row stands twice."""
    stamped(rows).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions of a published table, the newest first. A version is whole once its
    marker of success stands, which is written last."""
    fs, jpath = _file_system(spark, path)
    if not fs.exists(jpath):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(jpath)]
    return sorted((int(n[2:]) for n in names if n.startswith("v=") and exists(spark, f"{path}/{n}/_SUCCESS")), reverse=True)


def publish(path: str, rows: DataFrame, keep: int = 3) -> None:
    """`rows` as the next version of a table that readers always find whole; `keep` versions stay for
    readers that have begun with one. One writer at a time."""
    spark, path = rows.sparkSession, path.rstrip("/")
    found = versions(spark, path)
    rows.write.mode("overwrite").parquet(f"{path}/v={found[0] + 1 if found else 0}")
    for old in found[keep - 1 :]:
        remove(spark, f"{path}/v={old}")


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest whole version; None if there is none."""
    found = versions(spark, path)
    return spark.read.parquet(f"{path.rstrip('/')}/v={found[0]}") if found else None


def tail(ledger: DataFrame, limit: int = 100) -> DataFrame:
    """The newest `limit` rows in append order; 0 means all."""
    if not limit:
        return ledger.orderBy("ts", "seq")
    return ledger.orderBy(F.desc("ts"), F.desc("seq")).limit(limit).orderBy("ts", "seq")


def load_start(symbols: DataFrame, stored: DataFrame, now: Column, years: int = 2) -> DataFrame:
    """Where loading starts: the minute after the last bar, else midnight `years` years before `now`."""
    last = stored.groupBy("symbol").agg(F.max("ts").alias("__last"))
    fresh = F.add_months(F.to_date(now), -12 * years).cast("timestamp_ntz")
    return symbols.join(last, "symbol", "left").withColumn("start", F.coalesce(F.col("__last") + F.expr("interval 1 minute"), fresh)).drop("__last")


def load_windows(starts: DataFrame, now: Column, days: int = 3) -> DataFrame:
    """(symbol, start, end) chunks of at most `days` days; each starts a minute after the one before."""
    step = F.expr(f"interval {days} days 1 minute")
    rows = starts.filter(F.col("start") <= now).select("symbol", F.explode(F.sequence(F.col("start"), now, step)).alias("start"))
    return rows.withColumn("end", F.least(F.col("start") + F.expr(f"interval {days} days"), now))


def vendor_bars(rows: DataFrame) -> DataFrame:
    """Vendor rows as complete one-minute bars; volume is 1 at least."""
    return rows.select("symbol", F.lit("M1").alias("timeframe"), F.col("ts").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", F.greatest(F.coalesce(F.col("volume").cast("double"), F.lit(1.0)), F.lit(1.0)).alias("volume"), F.lit(True).alias("is_complete"))


def write_features(path: str, features: DataFrame, expiry_key: str) -> None:
    """The feature matrix of an expiry, by symbol: partitions that it holds replace the stored ones."""
    if exists(features.sparkSession, path):
        stored(features.sparkSession, path)
    rows = stamped(features).withColumn("expiry_key", F.lit(expiry_key))
    rows.repartition("symbol").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "expiry_key").parquet(path)


def scan_features(spark: SparkSession, path: str, expiry_key: str) -> DataFrame:
    return stored(spark, path).filter(F.col("expiry_key") == expiry_key).drop("expiry_key")


def write_run(path: str, run: DataFrame) -> None:
    """Appends runs that hold all required fields to the registry."""
    from marketframe.operators.models import registered

    append(path, registered(run).filter("size(violations) = 0").drop("violations"))


def coverage(bars: DataFrame, features: DataFrame, symbols: DataFrame, least: int = 250) -> DataFrame:
    """Before a run, for every wanted symbol: bars, complete feature rows, and whether it is ready, with
    at least `least` bars and some features. A symbol without bars is listed with 0."""
    rows = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))
    full = features.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_features"))
    out = symbols.select("symbol").distinct().join(rows, "symbol", "left").join(full, "symbol", "left")
    out = out.select("symbol", F.coalesce("n_bars", F.lit(0)).alias("n_bars"), F.coalesce("n_features", F.lit(0)).alias("n_features"))
    return out.withColumn("ready", (F.col("n_bars") >= least) & (F.col("n_features") > 0))


def require_coverage(found: DataFrame) -> None:
    """Raises an error that names the first symbols that aren't ready."""
    short = found.filter("NOT ready").orderBy("symbol").limit(20).collect()
    if short:
        raise ValueError("not enough bars or features: " + ", ".join(f"{r.symbol} ({r.n_bars} bars, {r.n_features} feature rows)" for r in short))
