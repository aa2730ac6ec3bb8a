"""Structured Streaming forms: bars of tick streams, upserting sinks, keyed gate state, stream joins.

Stream times are `timestamp` (UTC session); batch operators use timestamp_ntz.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from marketframe.operators import indicators
from marketframe.sources import tables


def bars(ticks: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Closed tumbling bars of a tick stream (symbol, ts, price, seq); append mode."""
    t = F.struct("ts", "seq")
    out = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", f"{seconds} seconds").alias("w"))
    out = out.agg(F.min_by("price", t).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", t).alias("close"), F.count(F.lit(1)).alias("ticks"))
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "ticks")


def new_bars(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each (symbol, ts) once, within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "ts"])


def _start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_sink(stream: DataFrame, path: str, checkpoint: str, seq: str | None = None) -> StreamingQuery:
    """Micro-batches of bars upserted into a bar table: a repeated bar replaces the stored one, also
    when a batch is run again after a failure. Of one batch the last by `seq` stays."""
    return _start(stream, lambda batch, _: tables.write_bars(batch.sparkSession, path, batch, seq), checkpoint)


def tick_sink(stream: DataFrame, path: str, checkpoint: str, flush: int = 1000) -> StreamingQuery:
    """Ticks appended losslessly by symbol in batches; no file holds more than 10 `flush` rows. The file
    sink writes every batch once, so a restart repeats and loses none."""
    out = stream.writeStream.format("parquet").partitionBy("symbol").option("path", path).option("maxRecordsPerFile", 10 * flush)
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ledger_sink(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-only ledger; Spark's file sink writes every batch once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class TailState(StatefulProcessor):
    """Per symbol the newest `tail` rows. A batch's rows come out with the rows kept before them, marked by
    __new, so that no batch reads a stored history again. A row of a time that is kept replaces it."""

    def __init__(self, schema: T.StructType, tail: int):
        self.schema, self.tail = schema, tail

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("tail", self.schema)

    def _keep(self, rows: pd.DataFrame) -> None:
        newest = rows.sort_values("ts", kind="stable").tail(self.tail).astype(object)
        self.rows.put(list(newest.where(newest.notna(), None).itertuples(index=False, name=None)))

    def _kept(self) -> pd.DataFrame:
        return pd.DataFrame(list(self.rows.get()), columns=self.schema.names)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._keep(initialState[self.schema.names])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[self.schema.names].drop_duplicates("ts", keep="last")
        old = self._kept()
        old = old[~old["ts"].isin(set(new["ts"]))]
        both = pd.concat([old.astype(new.dtypes.to_dict()), new]) if len(old) else new
        self._keep(both)
        yield both.assign(__new=[False] * len(old) + [True] * len(new)).sort_values("ts", kind="stable")

    def close(self) -> None:
        pass


def keyed_state(spark: SparkSession) -> None:
    """Has Spark keep state in RocksDB, which keyed state of several values needs, unless a session has
    chosen a provider of its own. A stream goes on with the provider that its checkpoint began with."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in spark.conf.get(key):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def with_tail(stream: DataFrame, history: DataFrame, tail: int = 250) -> DataFrame:
    """The rows of a stream of bars, each batch with the `tail` rows before them of its symbols, and __new. The
    tails are keyed state, filled from `history` in the first batch only."""
    from marketframe.operators.bars import newest

    keyed_state(stream.sparkSession)
    columns = stream.columns
    first = newest(history, tail).select(*columns).groupBy("symbol")
    out = T.StructType([*stream.schema.fields, T.StructField("__new", T.BooleanType())])
    return stream.groupBy("symbol").transformWithStateInPandas(TailState(stream.schema, tail), out, "append", "none", initialState=first)


def score_loop(stream: DataFrame, history: Callable[[SparkSession], DataFrame], features: Callable[[DataFrame], DataFrame], decide: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, tail: int = 250) -> StreamingQuery:
    """For each batch of bars: features of the new bars and the tails of their symbols, decisions on the new
    bars only, then sink(rows, number of the batch). A batch that is run again has the same number and rows, so
    a sink that replaces what it wrote under a number (tables.append_batch) holds every decision once."""

    def each(batch: DataFrame, number: int) -> None:
        path = tables.scratch(batch.sparkSession, "batch")  # its features and its list of new bars are one reading
        batch.write.parquet(path)
        rows = batch.sparkSession.read.schema(batch.schema).parquet(path)
        new = rows.filter("__new").select("symbol", "ts")
        sink(decide(features(rows.drop("__new")).join(new, ["symbol", "ts"], "left_semi")), number)
        tables.remove(batch.sparkSession, path)

    return _start(with_tail(stream, history(stream.sparkSession), tail), each, checkpoint)


def indicator_subscription(stream: DataFrame, history: Callable[[SparkSession], DataFrame], name: str, sink: Callable[[DataFrame, int], None], checkpoint: str, **params) -> StreamingQuery:
    """An indicator of the new bars of every batch, over them and the tails of their symbols."""
    return score_loop(stream, history, lambda df: indicators.indicator(df, name, **params), lambda df: df, sink, checkpoint)


class GateState(StatefulProcessor):
    """Per symbol: loss streak, threshold, last fired time, wins and net of the UTC day.

    A result row (outcome set) moves the state; a signal row fires if it is confident enough, the
    cooldown has passed, the streak hasn't halted trading and the day's target isn't reached. A new
    day resets the day's counters and the halt. A day ends with a row of its own, without seq, at the midnight
    after it: when a row of a later day comes, or when the watermark has passed that midnight."""

    def __init__(self, base: float = 0.6, step: float = 0.05, most: int = 5, cooldown: float = 80.0, target: int = 10):
        self.base, self.step, self.most, self.cooldown, self.target = base, step, most, cooldown, target

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("gate", "streak int, fired double, day bigint, wins int, net double")

    def _threshold(self, streak: int) -> float:
        return min(self.base + streak * self.step, 0.999)

    def _ended(self, symbol: str, day: int, streak: int, wins: int, net: float) -> tuple:
        return (symbol, pd.Timestamp(day + 1, unit="D"), None, None, int(streak), float(self._threshold(streak)), int(wins), float(net))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["symbol", "ts", "seq", "fired", "streak", "threshold", "wins", "net"])
        return out.astype({"seq": "Int64", "fired": "boolean"})

    def _after(self, streak: int) -> int:
        """The streak of the next day: what halted trading is forgotten."""
        return 0 if streak >= self.most else streak

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        streak, fired, day, wins, net = self.state.get() if self.state.exists() else (0, None, None, 0, 0.0)
        out, began = [], day
        for r in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples(index=False):
            t = r.ts.timestamp()
            today = int(t // 86400)
            if today != day:
                if day is not None:
                    out.append(self._ended(key[0], day, streak, wins, net))
                day, wins, net, streak = today, 0, 0.0, self._after(streak)
            if isinstance(r.outcome, str):
                streak = 0 if r.outcome == "win" else streak + (r.outcome == "loss")
                wins += r.outcome == "win"
                net += r.amount
                continue
            threshold = self._threshold(streak)
            fire = r.confidence >= threshold and streak < self.most and wins < self.target and (fired is None or t - fired >= self.cooldown)
            fired = t if fire else fired
            out.append((key[0], r.ts, r.seq, bool(fire), int(streak), float(threshold), int(wins), float(net)))
        if day != began:
            if began is not None:
                self.handle.deleteTimer((began + 1) * 86_400_000)
            self.handle.registerTimer((day + 1) * 86_400_000)
        self.state.update((int(streak), fired, day, int(wins), float(net)))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        streak, fired, day, wins, net = self.state.get()
        if day is None or (day + 1) * 86_400_000 != expiredTimerInfo.getExpiryTimeInMs():
            return
        self.state.update((int(self._after(streak)), fired, None, 0, 0.0))
        yield self._frame([self._ended(key[0], day, streak, wins, net)])

    def close(self) -> None:
        pass


GATED = "symbol string, ts timestamp, seq bigint, fired boolean, streak int, threshold double, wins int, net double"


def gated(stream: DataFrame, late: str = "10 minutes", **params) -> DataFrame:
    """Signals and results (symbol, ts, seq, confidence, outcome, amount) through the keyed gate: a row for each
    signal, and one for each day that has ended. Days end by timer, also where no row follows. Rows later than
    `late` are dropped."""
    keyed_state(stream.sparkSession)
    return stream.withWatermark("ts", late).groupBy("symbol").transformWithStateInPandas(GateState(**params), GATED, "append", "eventTime")


def signal_results(signals: DataFrame, results: DataFrame, tolerance: int = 30, late: str = "2 minutes") -> DataFrame:
    """Left outer stream join of signals with results of the same pair and direction at most
    `tolerance` seconds away; unmatched signals come once the watermark has passed them."""
    s = signals.withWatermark("ts", late).alias("s")
    r = results.withWatermark("ts", late).alias("r")
    gap = F.expr(f"interval {tolerance} seconds")
    on = (F.col("s.pair") == F.col("r.pair")) & (F.col("s.direction") == F.col("r.direction")) & (F.col("r.ts") > F.col("s.ts") - gap) & (F.col("r.ts") < F.col("s.ts") + gap)
    return s.join(r, on, "leftOuter").select("s.signal_id", F.col("s.ts").alias("ts"), "s.pair", "s.direction", F.col("r.trade_id").alias("trade_id"))


def latest_by_asset(feed: DataFrame, value: str, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The newest value per asset, by `order`; complete or update mode."""
    return feed.groupBy("asset").agg(F.max_by(value, F.struct(*order)).alias(value), F.max("ts").alias("ts"))


def latest_sink(latest: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A table of a row per asset, upserted with the assets that each batch changes. Every batch is a new
    version of it (tables.publish), so that a reader finds one whole version at any time, and a batch that
    is run again changes nothing."""

    def each(batch: DataFrame, _: int) -> None:
        old = tables.published(batch.sparkSession, path)
        rows = batch if old is None else old.join(batch.select("asset"), "asset", "left_anti").unionByName(batch)
        tables.publish(path, rows)

    return latest.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
