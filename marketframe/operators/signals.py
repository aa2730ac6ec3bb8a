"""Signals, gates, matching of signals with trades, and ledger analytics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.functions.windows import by_symbol, flag, run_length, running

c = F.col

# Outcomes by side, words for sides.
DIRECTIONS = {"UP": "call", "CALL": "call", "0": "call", "DOWN": "put", "PUT": "put", "1": "put"}
KILLS = ("kill_switch", "fatal_error", "engine_crash", "webhook_failed", "journal_failed")
PART_ROWS = 500_000  # rows of both sides of a lookup in a task


def decide(p: Column, threshold: float | Column) -> tuple[Column, Column]:
    """(direction, confidence) of a probability of rising prices; no probability is a SKIP of 0."""
    t = F.lit(threshold) if isinstance(threshold, float) else threshold
    direction = F.when(p >= t, "CALL").when(p <= 1 - t, "PUT").otherwise("SKIP")
    return direction, F.when(p.isNull(), 0.0).when((p <= 1 - t) & (p < t), 1 - p).otherwise(p)


def executable(signals: DataFrame) -> DataFrame:
    return signals.filter("direction <> 'SKIP'")


def cooldown(signals: DataFrame, seconds: int = 80) -> DataFrame:
    """Signals at least `seconds` after the last kept one of their symbol; of equal times the smallest
    seq comes first. The kept signal before each decides, so rows go in time order through one pass
    that holds a batch and the last kept time, however dense the signals are."""
    step = seconds * 1_000_000
    t = F.unix_micros(c("ts").cast("timestamp"))
    names = signals.columns
    rows = signals.withColumn("__t", t).repartition("symbol").sortWithinPartitions("symbol", "__t", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, last = None, None
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            times = batch.column("__t").to_numpy(zero_copy_only=False)
            codes = batch.column("symbol").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            ends = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows]
            for i, j in zip(ends, ends[1:]):
                if i == j:
                    continue
                own = batch.column("symbol")[i].as_py()
                if own != symbol:
                    symbol, last = own, None
                while i < j:  # from one kept signal to the first that is far enough behind it
                    at = i if last is None else i + int(np.searchsorted(times[i:j], last + step))
                    if at < j:
                        keep[at], last = True, times[at]
                    i = at + 1
            yield batch.filter(pa.array(keep)).select(names)

    return rows.mapInArrow(run, signals.schema)


def streaks(results: DataFrame, base: float = 0.6, step: float = 0.05, most: int = 5) -> DataFrame:
    """After each result: losses since the last win, the raised threshold (0.999 at most) and
    whether the streak halts trading."""
    losses = F.sum(flag(c("outcome") == "loss")).over(running(by_symbol("ts", "seq")))
    out = results.withColumn("__l", losses)
    at_win = F.last(F.when(c("outcome") == "win", c("__l")), True).over(running(by_symbol("ts", "seq")))
    out = out.withColumn("streak", c("__l") - F.coalesce(at_win, F.lit(0))).drop("__l")
    return out.withColumns({"threshold": F.least(base + c("streak") * step, F.lit(0.999)), "halted": c("streak") >= most})


def first_halt(rows: DataFrame) -> DataFrame:
    return rows.filter("halted").groupBy("symbol").agg(F.min("ts").alias("halted_at"))


def daily_target(results: DataFrame, wins: int | None = None, net: float | None = None) -> DataFrame:
    """Running wins and net of the UTC day, whether the day's target is reached, and `blocked` on all
    later rows of that day."""
    day = F.to_date("ts")
    w = Window.partitionBy("symbol", "day").orderBy("ts", "seq")
    out = results.withColumn("day", day)
    amount = F.when(c("outcome") == "win", c("payout")).when(c("outcome") == "loss", -c("stake")).otherwise(0.0)
    out = out.withColumns({"day_wins": F.sum(flag(c("outcome") == "win")).over(running(w)), "day_net": F.sum(amount).over(running(w))})
    reached = (c("day_wins") >= wins) if wins is not None else (c("day_net") >= net)
    out = out.withColumn("reached", reached)
    return out.withColumn("blocked", F.coalesce(F.max("reached").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))


def trade_entries(results: DataFrame) -> DataFrame:
    """Trades of results whose prices are set, with their profit or loss."""
    rows = results.filter((c("open_price") != 0) & (c("close_price") != 0))
    return rows.withColumn("result", F.when(c("outcome") == "win", c("payout")).when(c("outcome") == "loss", -c("stake")).otherwise(0.0))


def result_schedule(signals: DataFrame, expiry_seconds: int = 60, tries: int = 3) -> DataFrame:
    """When to ask for each signal's result: 5 s after expiry, then 15 s times the attempt later."""
    attempt = F.sequence(F.lit(0), F.lit(tries - 1))
    rows = signals.withColumn("attempt", F.explode(attempt))
    due = F.unix_timestamp(c("ts").cast("timestamp")) + expiry_seconds + 5 + F.when(c("attempt") > 0, 15 * c("attempt")).otherwise(0)
    return rows.withColumn("due", F.timestamp_seconds(due).cast("timestamp_ntz"))


def unresolved(signals: DataFrame, results: DataFrame) -> DataFrame:
    return signals.join(results.select("signal_id").distinct(), "signal_id", "left_anti")


def balance_changes(balances: DataFrame, least: float = 0.001) -> DataFrame:
    delta = c("balance") - F.lag("balance").over(by_symbol())
    return balances.withColumn("delta", delta).filter(F.abs("delta") > least).withColumn("guess", F.when(c("delta") > 0, "win").otherwise("loss"))


def stake_ladder(results: DataFrame, stake: float, steps: int) -> DataFrame:
    """Stake of each trade: doubled after every loss, up to `steps` times, then from the start; a win
    or draw ends the ladder."""
    w = by_symbol("ts", "seq")
    losses = F.coalesce(F.lag(run_length(c("outcome") == "loss", w)).over(w), F.lit(0))
    return results.withColumn("next_stake", stake * F.pow(F.lit(2.0), F.pmod(losses, F.lit(steps))))


def activity(event: Column, outcome: Column) -> Column:
    """Class of an event: a result by its outcome, signals, failures that stop trading, else info."""
    result = F.when(outcome.isin("win", "loss"), outcome).otherwise("info")
    return F.when(event == "result", result).when(event == "signal", "signal").when(event.isin(*KILLS), "kill").otherwise("info")


def summary(results: DataFrame) -> DataFrame:
    """wins, losses, draws and net per symbol and day."""
    one = lambda v: F.count_if(c("outcome") == v)
    net = F.sum(F.when(c("outcome") == "win", c("payout")).when(c("outcome") == "loss", -c("stake")).otherwise(0.0))
    return results.groupBy("symbol", F.to_date("ts").alias("day")).agg(one("win").alias("wins"), one("loss").alias("losses"), one("draw").alias("draws"), net.alias("net"))


def win_rate(wins: Column, losses: Column) -> Column:
    return F.round(wins / F.greatest(wins + losses, F.lit(1)) * 100, 1)


def status(wins: Column, target: int, open_: Column) -> Column:
    return F.when(wins >= target, "TARGET REACHED").when(open_, "ACTIVE").otherwise("CLOSED")


def session_report(results: DataFrame, target: int = 10, base: float = 0.6, step: float = 0.05, now: Column | None = None) -> DataFrame:
    """One row per symbol and day: summary, win rate, and the streak and threshold after its last result.
    Days before that of `now` are closed; without it every day counts as open."""
    days = summary(results).withColumn("win_rate", win_rate(c("wins"), c("losses")))
    state = streaks(results, base, step).withColumn("day", F.to_date("ts"))
    t = F.struct("ts", "seq")
    last = state.groupBy("symbol", "day").agg(F.max_by("streak", t).alias("streak"), F.max_by("threshold", t).alias("threshold"), ((F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp"))) / 60).alias("minutes"))
    return days.join(last, ["symbol", "day"]).withColumn("status", status(c("wins"), target, F.lit(True) if now is None else c("day") >= F.to_date(now)))


def recent(trades: DataFrame, n: int = 10) -> DataFrame:
    """The n newest trades with their outcome by the sign of the result."""
    outcome = F.when(c("result") > 0, "win").when(c("result") < 0, "loss").otherwise("draw")
    return trades.orderBy(F.desc("ts"), F.desc("seq")).limit(n).withColumn("outcome", outcome)


def recent_events(events: DataFrame, n: int = 100) -> DataFrame:
    """The n newest events (ts, seq, event, outcome) with their class."""
    return events.orderBy(F.desc("ts"), F.desc("seq")).limit(n).withColumn("class", activity(c("event"), c("outcome")))


def asset_name(name: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(name, "\n", "")))


def toggled(name: Column) -> Column:
    """The other market of an asset: with `_otc` where it lacks it, without where it has it."""
    return F.when(F.endswith(name, F.lit("_otc")), F.regexp_replace(name, "_otc$", "")).otherwise(F.concat(name, F.lit("_otc")))


def side(*fields: Column) -> Column:
    """call or put from the first field that is set."""
    word = F.upper(F.trim(F.coalesce(*(f.cast("string") for f in fields))))
    out = F.when(F.lit(False), "")
    for k, v in DIRECTIONS.items():
        out = out.when(word == k, v)
    return out


def close_time(epoch: Column, text: Column) -> Column:
    return F.coalesce(F.timestamp_millis((epoch * 1000).cast("bigint")), F.try_to_timestamp(F.left(text, F.lit(19)))).cast("timestamp_ntz")


def to_pairs(trades: DataFrame, assets: DataFrame) -> DataFrame:
    """Trades with the pair of their asset; names are compared trimmed and in upper case."""
    names = assets.select(asset_name(c("asset")).alias("__a"), "pair").distinct()
    return trades.withColumn("__a", asset_name(c("asset"))).join(names, "__a").drop("__a")


def match(signals: DataFrame, trades: DataFrame, tolerance: float = 30.0) -> DataFrame:
    """signal_id, trade_id and delta: each signal's nearest trade of its pair and direction less than
    `tolerance` seconds away, ties to the earlier trade_id; null where there is none.

    Trades stand in their own time bucket and the two beside it, so this is an equi join."""
    t = lambda x: F.unix_micros(c(x).cast("timestamp")) / 1e6
    b = lambda x: F.floor(t(x) / tolerance)
    near = trades.select("trade_id", "pair", "direction", t("ts").alias("__t"), F.explode(F.array(b("ts") - 1, b("ts"), b("ts") + 1)).alias("__b"))
    keyed = signals.select("signal_id", "pair", "direction", t("ts").alias("__s"), b("ts").alias("__b"))
    pairs = keyed.join(near, ["pair", "direction", "__b"]).withColumn("delta", F.abs(c("__t") - c("__s"))).filter(c("delta") < tolerance)
    best = pairs.groupBy("signal_id").agg(F.min(F.struct("delta", "trade_id")).alias("m")).select("signal_id", "m.trade_id", "m.delta")
    return signals.join(best, "signal_id", "left")


def lookup(tickets: DataFrame, operations: DataFrame) -> DataFrame:
    """status of each ticket: win, loss, or that it was not found.

    Both sides are counted and dealt by ticket into parts of about PART_ROWS rows, so that the sort of a task,
    and what is grouped by ticket behind it, don't grow with the tables."""
    found = operations.select("ticket", "profit")
    parts = math.ceil((tickets.count() + found.count()) / PART_ROWS)
    if parts > 1:
        parts = max(parts, tickets.sparkSession.sparkContext.defaultParallelism)
        tickets, found = tickets.repartition(parts, "ticket"), found.repartition(parts, "ticket")
    return tickets.join(found, "ticket", "left").withColumn("status", F.when(c("profit").isNull(), "OperationID Not Found.").when(c("profit") > 0, "win").otherwise("loss"))


def outcome_of_profit(profit: Column) -> Column:
    return F.when(profit > 0, "win").when(profit < 0, "loss").otherwise("draw")


def outcome_of_prices(direction: Column, open_: Column, close: Column) -> Column:
    """call wins if the close is higher, put if lower; equal prices lose."""
    return F.when(((direction == "call") & (close > open_)) | ((direction == "put") & (close < open_)), "win").otherwise("loss")


def profit(payout_percent: Column, amount: Column) -> Column:
    return payout_percent / 100 * amount


def stake(balance: Column, risk_percent: float) -> Column:
    return F.greatest(balance * risk_percent / 100, F.lit(1.0))


def orders(signals: DataFrame, symbol_map: DataFrame, amount: float = 1.0) -> DataFrame:
    """Outbound orders of executable signals under the receiver's symbol names."""
    rows = executable(signals).join(symbol_map, "symbol", "left")
    return rows.select("signal_id", F.coalesce("target", "symbol").alias("symbol"), F.when(c("direction") == "CALL", "buy").otherwise("sell").alias("action"), F.lit(amount).alias("amount"), "confidence")


def sentiment(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sell", 100 - c("buy"))
