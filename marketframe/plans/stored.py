"""Named queries over stored tables, streams, payloads and rules that need more than one given table.

Round trips write to a new folder under spark.checkpoint.dir and return what is read back. Streams read
the given events as files, run until nothing is left, and return what their sink holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.functions import timefn
from marketframe.operators import bars, features, indicators, models, quality, signals
from marketframe.plans.fixtures import SHOW_TS, T, W, bars_sql, hourly, rolled, table, ticks
from marketframe.plans.queries import OHLC, RUNS, query, runs
from marketframe.sources import payloads, tables
from marketframe.streaming import streams

B = bars_sql()
c = F.col


def as_bars(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars of the events as rows of a bar table."""
    return hourly(spark, d).select("symbol", F.lit("H1").alias("timeframe"), "ts", "open", "high", "low", "close", "volume")


# ---- stored tables ----------------------------------------------------------------------------

@query(f"WITH {T}, {B} SELECT symbol, 'H1' AS timeframe, {SHOW_TS}, {OHLC}, round(volume, 6) AS volume FROM b WHERE symbol IN ('click', 'view') QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 40")
def table_scan_bars(spark, d):
    path = tables.scratch(spark, "bars")
    tables.write_bars(spark, path, as_bars(spark, d))
    return tables.scan_bars(spark, path, ["click", "view"], "H1", max_rows=40)


@query(f"WITH {T}, {B} SELECT symbol, 'H1' AS timeframe, {SHOW_TS}, round(CASE WHEN ts >= TIMESTAMP '2024-01-20' AND volume > 1 THEN close + 1 ELSE close END, 6) AS close FROM b")
def table_write_bars(spark, d):
    path = tables.scratch(spark, "bars")
    rows = as_bars(spark, d)
    tables.write_bars(spark, path, rows)
    again = rows.filter("ts >= timestamp_ntz'2024-01-20'").withColumns({"close": c("close") + 1, "is_complete": c("volume") > 1})
    tables.write_bars(spark, path, again)  # incomplete bars replace nothing
    return tables.scan_bars(spark, path, timeframe="H1").select("symbol", "timeframe", "ts", "close")


@query("SELECT event_type AS symbol, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type = 'click' GROUP BY event_type")
def table_scan_ticks(spark, d):
    path = tables.scratch(spark, "ticks")
    ticks(spark, d).write.partitionBy("symbol").parquet(path)
    return tables.scan_ticks(spark, path, "click").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 4).alias("total"))


@query(f"WITH {T}, {B} SELECT symbol, {SHOW_TS}, round(close, 6) AS close FROM b WHERE ticks > 2")
def table_complete_bars(spark, d):
    return tables.complete_only(hourly(spark, d).withColumn("is_complete", c("ticks") > 2)).select("symbol", "ts", "close")


@query("SELECT event_id AS seq, event_type AS symbol FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def ledger_appended(spark, d):
    path = tables.scratch(spark, "ledger")
    rows = ticks(spark, d).select("symbol", "ts", "seq")
    for half in ("seq % 2 = 0", "seq % 2 = 1"):
        tables.append(path, rows.filter(half))
    return tables.tail(tables.stored(spark, path), 50).select("seq", "symbol")


@query(f"WITH {T}, {B} SELECT symbol, {SHOW_TS}, round(close * CASE WHEN symbol = 'view' THEN 2 ELSE 1 END, 6) AS x FROM b")
def table_features(spark, d):
    path = tables.scratch(spark, "features")
    rows = hourly(spark, d).select("symbol", "ts", c("close").alias("x"))
    tables.write_features(path, rows, "5_MIN")
    tables.write_features(path, rows.withColumn("x", c("x") * 3), "15_MIN")
    tables.write_features(path, rows.filter("symbol = 'view'").withColumn("x", c("x") * 2), "5_MIN")  # one symbol anew
    return tables.scan_features(spark, path, "5_MIN").select("symbol", "ts", "x")


@query(f"WITH {RUNS} SELECT symbol, expiry_key, count(*) AS n, round(max(auc), 6) AS top FROM ru WHERE auc >= 0.2 GROUP BY symbol, expiry_key")
def model_registry(spark, d):
    path = tables.scratch(spark, "registry")
    rows = runs(spark, d)
    tables.write_run(path, rows.withColumn("auc", F.when(c("auc") >= 0.2, c("auc"))))  # runs without auc are not registered
    return tables.stored(spark, path).groupBy("symbol", "expiry_key").agg(F.count(F.lit(1)).alias("n"), F.max("auc").alias("top"))


@query(f"WITH {T}, {B}, s AS (SELECT symbol, {rolled('avg', 'close', 100)} AS x FROM b), w AS (SELECT DISTINCT event_type AS symbol FROM events UNION SELECT n_name FROM nation) SELECT w.symbol, (SELECT count(*) FROM b WHERE b.symbol = w.symbol) AS n_bars, (SELECT count(x) FROM s WHERE s.symbol = w.symbol) AS n_features, (SELECT count(*) FROM b WHERE b.symbol = w.symbol) >= 250 AND (SELECT count(x) FROM s WHERE s.symbol = w.symbol) > 0 AS ready FROM w")
def table_coverage(spark, d):
    rows = hourly(spark, d)
    wanted = rows.select("symbol").unionByName(table(spark, d, "nation").select(c("n_name").alias("symbol")))
    full = indicators.sma(rows, 100).filter("SMA IS NOT NULL")
    return tables.coverage(rows, full, wanted)


# ---- rules ------------------------------------------------------------------------------------

BROKEN = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), ',') AS violations, count(*) AS n FROM k GROUP BY ALL"


def broken(rules: dict[str, str]) -> str:
    return BROKEN.format(", ".join(f"CASE WHEN {ok} THEN NULL ELSE '{name}' END" for name, ok in rules.items()))


def counted(rows: DataFrame, rules) -> DataFrame:
    return quality.checked(rows, rules).groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count(F.lit(1)).alias("n"))


TRADES = "k AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'CALL' WHEN 'O' THEN 'PUT' ELSE 'HOLD' END AS side, o_totalprice - 50000 AS entry_price, o_totalprice - 60000 AS exit_price, o_orderkey % 7 AS duration_seconds, CASE WHEN o_orderkey % 5 = 0 THEN '  ' WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'id' END AS signal_id FROM orders)"


@query(f"WITH {TRADES} SELECT " + broken({"side": "side IN ('CALL', 'PUT')", "entry_price": "entry_price > 0", "exit_price": "exit_price > 0", "duration": "duration_seconds > 0", "signal_id": "trim(signal_id) <> ''"}))
def quality_trades(spark, d):
    k, p = c("o_orderkey"), c("o_totalprice")
    side = F.when(c("o_orderstatus") == "F", "CALL").when(c("o_orderstatus") == "O", "PUT").otherwise("HOLD")
    rows = table(spark, d, "orders").select(side.alias("side"), (p - 50000).alias("entry_price"), (p - 60000).alias("exit_price"), (k % 7).alias("duration_seconds"), F.when(k % 5 == 0, "  ").when(k % 11 == 0, None).otherwise("id").alias("signal_id"))
    return counted(rows, quality.trade_rules())


@query("WITH k AS (SELECT value / 60 - 0.1 AS confidence, CASE event_type WHEN 'click' THEN 'CALL' WHEN 'view' THEN 'PUT' WHEN 'purchase' THEN 'SKIP' ELSE event_type END AS direction, CASE WHEN event_id % 9 = 0 THEN ' ' ELSE 'v1' END AS model_version FROM events) SELECT " + broken({"confidence": "confidence BETWEEN 0 AND 1", "direction": "direction IN ('CALL', 'PUT', 'SKIP')", "model_version": "trim(model_version) <> ''"}))
def quality_signals(spark, d):
    kind = c("event_type")
    direction = F.when(kind == "click", "CALL").when(kind == "view", "PUT").when(kind == "purchase", "SKIP").otherwise(kind)
    rows = table(spark, d, "events").select((c("value") / 60 - 0.1).alias("confidence"), direction.alias("direction"), F.when(c("event_id") % 9 == 0, " ").otherwise("v1").alias("model_version"))
    return counted(rows, quality.signal_rules())


@query("SELECT p_partkey, round((p_retailprice + p_retailprice * 1.1) / 2, 6) AS mid FROM part")
def quality_mid(spark, d):
    return table(spark, d, "part").select("p_partkey", quality.mid(c("p_retailprice"), c("p_retailprice") * 1.1).alias("mid"))


@query("SELECT 'c_name' AS name, true AS present, count(*) AS rows, count(c_name) AS filled FROM customer UNION ALL SELECT 'c_nope', false, count(*), 0 FROM customer UNION ALL SELECT 'c_acctbal', true, count(*), count(c_acctbal) FROM customer")
def quality_schema(spark, d):
    return quality.schema_check(table(spark, d, "customer"), ["c_name", "c_nope", "c_acctbal"])


ODD = "k AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN CAST('nan' AS DOUBLE) WHEN event_id % 11 = 0 THEN CAST('inf' AS DOUBLE) ELSE value END AS x FROM events)"


def odd_values(spark, d):
    k = c("event_id")
    return table(spark, d, "events").select("event_id", F.when(k % 5 == 0, None).when(k % 7 == 0, float("nan")).when(k % 11 == 0, float("inf")).otherwise(c("value")).alias("x"))


@query(f"WITH {ODD} SELECT event_id, round(x, 6) AS x FROM k WHERE x IS NOT NULL AND isfinite(x)")
def quality_complete(spark, d):
    return quality.complete(odd_values(spark, d), ["x"])


@query(f"WITH {ODD} SELECT event_id, round(CASE WHEN x IS NOT NULL AND isfinite(x) THEN x ELSE 0 END, 6) AS x FROM k")
def quality_zero_filled(spark, d):
    return quality.zero_filled(odd_values(spark, d), ["x"])


@query(f"WITH {T}, {B}, k AS (SELECT symbol, ts, close / lag(close) OVER {W} AS r, volume FROM b) SELECT round(ln(r), 6) + 0.0 AS RETURN_1, round(volume / (CASE WHEN m = 0 THEN 1e-9 ELSE m END), 6) AS RELATIVE_VOLUME_RVOL FROM (SELECT *, {rolled('avg', 'volume', 10)} AS m FROM k)")
def features_expiry(spark, d):
    every = features.plain_windows(hourly(spark, d))
    return features.expiry_features(every, "5_MIN", {"5_MIN": ["RETURN_1", "RVOL", "NOT_THERE"]})


# ---- models -----------------------------------------------------------------------------------

@query("SELECT event_type AS symbol, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS ts, round(max(value) FILTER (WHERE user_id % 2 = 0), 6) AS a, round(max(value) FILTER (WHERE user_id % 2 = 1), 6) AS b FROM events GROUP BY event_type, date_trunc('hour', ts)")
def model_stacked_predictions(spark, d):
    rows = table(spark, d, "events").select(c("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.when(c("user_id") % 2 == 0, "a").otherwise("b").alias("model"), c("value").alias("p"))
    return models.stack_predictions(rows, ["a", "b"])


@query(f"WITH {RUNS} SELECT array_to_string(list_filter([CASE WHEN symbol = '5-LOW' THEN 'symbol' END, CASE WHEN auc < 0.1 THEN 'auc' END], lambda x: x IS NOT NULL), ',') AS missing, count(*) AS n FROM ru GROUP BY ALL")
def model_registered(spark, d):
    rows = runs(spark, d).withColumns({"symbol": F.when(c("symbol") != "5-LOW", c("symbol")), "auc": F.when(c("auc") >= 0.1, c("auc"))})
    return models.registered(rows).groupBy(F.array_join("violations", ",").alias("missing")).agg(F.count(F.lit(1)).alias("n"))


# ---- payloads ---------------------------------------------------------------------------------

@query("SELECT event_type AS symbol, event_id AS time, round(value, 6) AS open, round(value + 1, 6) AS close, round(value + 2, 6) AS high, round(value - 1, 6) AS low, event_id % 9 AS ticks FROM events")
def payload_candles(spark, d):
    n, v = c("event_id"), c("value")
    raw = F.format_string('{"asset": "%s", "candles": [[%d, %s, %s, %s, %s, %d]]}', "event_type", n, v.cast("string"), (v + 1).cast("string"), (v + 2).cast("string"), (v - 1).cast("string"), n % 9)
    return payloads.candles(table(spark, d, "events").select(raw.alias("raw")))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, round(o_totalprice - 150000, 6) AS profit, o_totalprice - 150000 > 0 AS win FROM orders")
def payload_deals(spark, d):
    raw = F.format_string('{"deals": [{"id": "%d", "profit": %s}]}', "o_orderkey", F.format_string("%.2f", c("o_totalprice") - 150000))
    return payloads.deals(table(spark, d, "orders").select(raw.alias("raw")))


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE round(c_acctbal, 6) END AS live, CASE WHEN c_custkey % 3 = 1 THEN NULL ELSE round(c_acctbal, 6) END AS demo FROM customer")
def payload_balances(spark, d):
    x, k = c("c_acctbal").cast("string"), c("c_custkey")
    raw = F.when(k % 3 == 0, F.format_string('{"demoBalance": %s}', x)).when(k % 3 == 1, F.format_string('{"liveBalance": %s}', x)).otherwise(F.format_string('{"liveBalance": %s, "demoBalance": %s}', x, x))
    return payloads.balances(table(spark, d, "customer").select(raw.alias("raw")))


@query("SELECT event_type AS asset, event_id AS time, CASE WHEN user_id % 2 = 0 THEN 'call' ELSE 'put' END AS direction, CAST(60 * (1 + user_id % 3) AS BIGINT) AS duration FROM events")
def payload_signal_feed(spark, d):
    u = c("user_id")
    raw = F.format_string('{"signals": [["%s", [{"signal": "%s", "timeFrame": %d}], %d]]}', "event_type", F.when(u % 2 == 0, "call").otherwise("put"), 60 * (1 + u % 3), "event_id")
    return payloads.signal_feed(table(spark, d, "events").select(raw.alias("raw")))


@query("WITH t AS (SELECT n_name || CASE WHEN n_nationkey % 4 = 0 THEN '_otc' ELSE '' END AS asset, n_nationkey % 3 > 0 AS open FROM nation UNION ALL SELECT n_name || '_otc', n_nationkey % 4 = 3 FROM nation WHERE n_nationkey % 4 <> 0), o AS (SELECT asset FROM t WHERE open) SELECT n_name AS asset, CASE WHEN n_name IN (SELECT asset FROM o) THEN n_name WHEN n_name || '_otc' IN (SELECT asset FROM o) THEN n_name || '_otc' END AS use FROM nation")
def payload_available(spark, d):
    n, k = table(spark, d, "nation"), c("n_nationkey")
    first = n.select(F.concat("n_name", F.when(k % 4 == 0, "_otc").otherwise("")).alias("asset"), (k % 3 > 0).alias("open"))
    other = n.filter(k % 4 != 0).select(F.concat("n_name", F.lit("_otc")).alias("asset"), (k % 4 == 3).alias("open"))
    return payloads.available(n.select(c("n_name").alias("asset")), first.unionByName(other))


@query("SELECT n_name AS asset, CAST(n_nationkey * 2 AS DOUBLE) AS payout FROM nation")
def payload_payout(spark, d):
    rows = table(spark, d, "nation").select(c("n_name").alias("asset"), c("n_nationkey").cast("double").alias("profit_1m"), (c("n_nationkey") * 2).cast("double").alias("profit_5m"), F.lit(0.0).alias("profit_24h"))
    return payloads.payout(rows, "5")


# ---- times ------------------------------------------------------------------------------------

@query("SELECT event_id, s - 7200 AS server, s - 900 AS start, CASE WHEN event_id % 3 = 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') WHEN event_id % 3 = 1 THEN strftime(to_timestamp(s) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') END AS closed FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)")
def time_server(spark, d):
    s, k = F.unix_timestamp(c("ts").cast("timestamp")), c("event_id")
    text = F.when(k % 3 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" and more"))).when(k % 3 == 2, "no time at all")
    closed = signals.close_time(F.when(k % 3 == 1, s.cast("double")), text)
    return table(spark, d, "events").select("event_id", timefn.server_time(s, 7200).alias("server"), timefn.period_start(s, 900).alias("start"), closed.alias("closed"))


# ---- streams ----------------------------------------------------------------------------------

def event_stream(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    """The events as a stream of (symbol, ts, price, seq, user_id)."""
    schema = table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").filter(where)
    return rows.select(c("event_type").alias("symbol"), c("ts").cast("timestamp").alias("ts"), c("value").alias("price"), c("event_id").alias("seq"), "user_id")


def drained(spark: SparkSession, start) -> DataFrame:
    """What `start(path, checkpoint)` has written once its stream has nothing left."""
    path = tables.scratch(spark, "stream")
    start(f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out")


def naive(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", c("ts").cast("timestamp_ntz"))


@query(f"WITH {T}, {B} SELECT symbol, {SHOW_TS}, {OHLC}, ticks FROM b WHERE ts + INTERVAL 70 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM t)")
def stream_bars(spark, d):
    return naive(drained(spark, lambda out, at: streams.ledger_sink(streams.bars(event_stream(spark, d), 3600), out, at)))


@query("SELECT event_type AS symbol, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS ts FROM events GROUP BY event_type, date_trunc('hour', ts)")
def stream_new_bars(spark, d):
    rows = event_stream(spark, d).select("symbol", F.date_trunc("hour", "ts").alias("ts"))
    return naive(drained(spark, lambda out, at: streams.ledger_sink(streams.new_bars(rows, "40 days"), out, at)))


@query("SELECT event_type AS symbol, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS ts, round(last(value ORDER BY event_id), 6) AS close FROM events GROUP BY event_type, date_trunc('hour', ts)")
def stream_upsert(spark, d):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")
    rows = event_stream(spark, d).select("symbol", F.lit("H1").alias("timeframe"), hour, *(c("price").alias(x) for x in ("open", "high", "low", "close", "volume")), "seq")
    path = tables.scratch(spark, "stream")
    streams.upsert_sink(rows, f"{path}/out", f"{path}/checkpoint", seq="seq").awaitTermination()
    return tables.scan_bars(spark, f"{path}/out", timeframe="H1").select("symbol", "ts", "close")


@query(f"WITH {T}, {B}, k AS (SELECT symbol, ts, {rolled('avg', 'close', 14)} AS sma FROM b) SELECT symbol, {SHOW_TS}, round(sma, 6) AS SMA FROM k WHERE ts >= TIMESTAMP '2024-01-20'")
def stream_subscription(spark, d):
    """An indicator over the new bars of a stream, its history before them taken from the store."""
    rows = hourly(spark, d).select("symbol", "ts", "close")
    src, path = tables.scratch(spark, "source"), tables.scratch(spark, "stream")
    rows.filter("ts >= timestamp_ntz'2024-01-20'").write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    sink = lambda out, n: tables.append_batch(f"{path}/out", out.select("symbol", "ts", "SMA"), n)
    streams.indicator_subscription(stream, lambda _: rows.filter("ts < timestamp_ntz'2024-01-20'"), "SMA", sink, f"{path}/checkpoint").awaitTermination()
    return tables.stored(spark, f"{path}/out").drop("batch")


@query(f"WITH {T}, {B}, k AS (SELECT symbol, ts, close - {rolled('avg', 'close', 14)} AS x FROM b), p AS (SELECT *, 1 / (1 + exp(-x)) AS p FROM k WHERE ts >= TIMESTAMP '2024-01-20') SELECT symbol, {SHOW_TS}, CASE WHEN p >= 0.9 THEN 'CALL' ELSE 'PUT' END AS direction FROM p WHERE p >= 0.9 OR p <= 1 - CAST(0.9 AS DOUBLE)")
def stream_scored(spark, d):
    """The live loop: stored tail and new bars, features, decisions on new bars, executable ones to a ledger."""
    rows = hourly(spark, d).select("symbol", "ts", "close")
    src, path = tables.scratch(spark, "source"), tables.scratch(spark, "stream")
    rows.filter("ts >= timestamp_ntz'2024-01-20'").write.parquet(src)

    def decide(df: DataFrame) -> DataFrame:
        direction, confidence = signals.decide(1 / (1 + F.exp(-(c("close") - c("SMA")))), 0.9)
        return signals.executable(df.withColumns({"direction": direction, "confidence": confidence}))

    stream = spark.readStream.schema(rows.schema).parquet(src)
    streams.score_loop(stream, lambda _: rows.filter("ts < timestamp_ntz'2024-01-20'"), indicators.sma, decide, lambda out, n: tables.append_batch(f"{path}/out", out.select("symbol", "ts", "direction"), n), f"{path}/checkpoint").awaitTermination()
    return tables.stored(spark, f"{path}/out").drop("batch")


@query("WITH s AS (SELECT event_id AS signal_id, ts, user_id AS pair FROM events WHERE event_type = 'click'), r AS (SELECT event_id AS trade_id, ts, user_id AS pair FROM events WHERE event_type = 'purchase') SELECT s.signal_id, s.pair, r.trade_id FROM s LEFT JOIN r ON s.pair = r.pair AND r.ts > s.ts - INTERVAL 1800 SECOND AND r.ts < s.ts + INTERVAL 1800 SECOND WHERE r.trade_id IS NOT NULL OR s.ts < (SELECT min(m) FROM (SELECT max(ts) AS m FROM events WHERE event_type IN ('click', 'purchase') GROUP BY event_type)) - INTERVAL 2 MINUTE - INTERVAL 1801 SECOND")
def stream_results(spark, d):
    """Signals with their results; a signal without one comes when the watermark has passed it."""
    side = lambda kind, name: event_stream(spark, d).filter(c("symbol") == kind).select(c("seq").alias(name), "ts", c("user_id").alias("pair"), F.lit("call").alias("direction"))
    joined = streams.signal_results(side("click", "signal_id"), side("purchase", "trade_id"), 1800)
    # what lies within a second of the watermark may or may not be out yet
    limit = table(spark, d, "events").filter("event_type IN ('click', 'purchase')").groupBy("event_type").agg(F.max("ts").alias("m")).agg(F.min("m")).first()[0]
    bound = F.lit(limit).cast("timestamp_ntz") - F.expr("interval 2 minutes") - F.expr("interval 1801 seconds")
    out = naive(drained(spark, lambda path, at: streams.ledger_sink(joined, path, at)))
    return out.filter(c("trade_id").isNotNull() | (c("ts") < bound)).select("signal_id", "pair", "trade_id")


@query("SELECT event_type AS asset, round(last(value ORDER BY ts, event_id), 6) AS price FROM events GROUP BY event_type")
def stream_latest(spark, d):
    path = tables.scratch(spark, "stream")
    feed = event_stream(spark, d).select(c("symbol").alias("asset"), "ts", "seq", "price")
    streams.latest_sink(streams.latest_by_asset(feed, "price", ("ts", "seq")), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return tables.published(spark, f"{path}/out").select("asset", "price")


@query("SELECT event_type AS symbol, event_id AS seq, round(value, 6) AS price FROM events")
def stream_ticks(spark, d):
    return drained(spark, lambda out, at: streams.tick_sink(event_stream(spark, d).drop("user_id"), out, at)).select("symbol", "seq", "price")


DESKS = "CASE event_type WHEN 'purchase' THEN CASE WHEN value >= 10 THEN 'win' ELSE 'loss' END WHEN 'error' THEN 'loss' END"
GATE = f"""e AS (SELECT 'd' || user_id % 10 AS symbol, ts, event_id AS seq, least(0.5 + value / 50, 0.999) AS confidence, {DESKS} AS outcome, CASE WHEN {DESKS} = 'win' THEN value WHEN {DESKS} = 'loss' THEN -value END AS amount FROM events WHERE event_type <> 'signup'),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS k, epoch(ts) AS t, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day FROM e),
g AS (SELECT symbol, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS day, CAST(0 AS BIGINT) AS streak, CAST(NULL AS DOUBLE) AS fired_at, CAST(0 AS BIGINT) AS wins, CAST(0 AS DOUBLE) AS net, CAST(NULL AS BOOLEAN) AS fired, CAST(NULL AS DOUBLE) AS threshold FROM n GROUP BY symbol
UNION ALL SELECT symbol, k, seq, outcome, day, CASE outcome WHEN 'win' THEN 0 WHEN 'loss' THEN streak0 + 1 ELSE streak0 END, CASE WHEN fire THEN t ELSE fired_at END, CASE WHEN outcome = 'win' THEN wins0 + 1 ELSE wins0 END, CASE WHEN outcome IS NOT NULL THEN net0 + amount ELSE net0 END, CASE WHEN outcome IS NULL THEN fire END, CASE WHEN outcome IS NULL THEN bar END
FROM (SELECT *, outcome IS NULL AND confidence >= bar AND streak0 < 3 AND wins0 < 2 AND (fired_at IS NULL OR t - fired_at >= 1800) AS fire FROM (SELECT *, least(0.55 + streak0 * 0.05, 0.999) AS bar FROM (
SELECT n.*, g.fired_at, CASE WHEN n.day IS DISTINCT FROM g.day AND g.streak >= 3 THEN 0 ELSE g.streak END AS streak0, CASE WHEN n.day IS DISTINCT FROM g.day THEN 0 ELSE g.wins END AS wins0, CASE WHEN n.day IS DISTINCT FROM g.day THEN 0.0 ELSE g.net END AS net0 FROM g JOIN n ON n.symbol = g.symbol AND n.k = g.k + 1)))),
s AS (SELECT g.*, n.ts FROM g JOIN n ON n.symbol = g.symbol AND n.k = g.k),
z AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY k DESC) AS back FROM s)"""


@query(f"WITH RECURSIVE {GATE} SELECT symbol, {SHOW_TS}, seq, fired, streak, round(threshold, 6) AS threshold, wins, round(net, 6) + 0.0 AS net FROM s WHERE outcome IS NULL UNION ALL SELECT symbol, strftime(to_timestamp((day + 1) * 86400) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S'), NULL, NULL, streak, round(least(0.55 + streak * 0.05, 0.999), 6), wins, round(net, 6) + 0.0 FROM z WHERE back = 1 AND (day + 1) * 86400 <= (SELECT floor(epoch(max(ts))) - 600 FROM e)")
def stream_gate(spark, d):
    """Signals and results of ten desks through the gate, and the days that have ended."""
    rows = event_stream(spark, d, "event_type <> 'signup'")
    outcome = F.when(c("symbol") == "purchase", F.when(c("price") >= 10, "win").otherwise("loss")).when(c("symbol") == "error", "loss")
    rows = rows.select(F.concat(F.lit("d"), c("user_id") % 10).alias("symbol"), "ts", "seq", F.least(0.5 + c("price") / 50, F.lit(0.999)).alias("confidence"), outcome.alias("outcome"), F.when(outcome == "win", c("price")).when(outcome == "loss", -c("price")).alias("amount"))
    gate = streams.gated(rows, base=0.55, most=3, target=2, cooldown=1800.0)
    return naive(drained(spark, lambda out, at: streams.ledger_sink(gate, out, at)))
