"""Named queries over the given tables, with equivalent SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.functions import timefn
from marketframe.operators import bars, calendar, ensembles, features, indicators, labels, models, quality, signals
from marketframe.plans.fixtures import R, SHOW_TS, T, W, bars_sql, hourly, results, rolled, safe, select, shown, table, ticks
from marketframe.sources import payloads, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
B = bars_sql()
OHLC = "round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close"
c = F.col


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        name = f.__name__
        QUERIES[name] = lambda spark, d: shown(f(spark, d))
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- bars -------------------------------------------------------------------------------------

@query(f"WITH {T}, {B} SELECT symbol, {SHOW_TS}, {OHLC}, ticks FROM b QUALIFY ts < max(ts) OVER (PARTITION BY symbol)")
def bars_ohlc(spark, d):
    return bars.from_ticks(ticks(spark, d), 3600, drop_open=True)


@query(f"WITH {T}, {B} SELECT symbol, {SHOW_TS}, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS end_ts, {OHLC}, ticks FROM b QUALIFY ts < max(ts) OVER (PARTITION BY symbol)")
def bars_candles_in_order(spark, d):
    return bars.candles_in_order(ticks(spark, d), 3600)


@query(f"WITH {T}, {B} SELECT symbol, {SHOW_TS}, {OHLC} FROM b")
def bars_roll_up(spark, d):
    part = bars.from_ticks(ticks(spark, d), 900).withColumn("seq", F.lit(0))
    return bars.roll_up(part, 3600)


@query(f"WITH {T}, {B} SELECT symbol, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS ts, round(first(open ORDER BY ts), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(last(close ORDER BY ts), 6) AS close, round(sum(volume), 6) AS volume FROM b GROUP BY symbol, date_trunc('day', ts)")
def bars_resample(spark, d):
    return bars.resample(hourly(spark, d), 86400)


GRID = "x AS (SELECT symbol, min(ts) AS a, max(ts) AS z FROM b GROUP BY symbol), s AS (SELECT symbol, unnest(generate_series(a, z, INTERVAL 15 MINUTE)) AS ts FROM x), g AS (SELECT s.symbol, s.ts, b.close, b.volume FROM s LEFT JOIN b ON s.symbol = b.symbol AND s.ts = b.ts)"
Q = bars_sql(seconds=900)
FILL = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"


@query(f"WITH {T}, {Q}, {GRID} SELECT symbol, {SHOW_TS}, round(last_value(close IGNORE NULLS) {FILL}, 6) AS close, round(last_value(volume IGNORE NULLS) {FILL}, 6) AS volume FROM g")
def bars_grid_fill(spark, d):
    return bars.fill(bars.grid(hourly(spark, d, 900), 900, ["close", "volume"]), ["close", "volume"])


@query(f"WITH {T}, {B} SELECT symbol, {SHOW_TS}, {OHLC} FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 3")
def bars_newest(spark, d):
    return bars.newest(hourly(spark, d), 3).select("symbol", "ts", "open", "high", "low", "close")


@query("SELECT event_type AS symbol, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS ts, round(last(value ORDER BY event_id), 6) AS price FROM events GROUP BY event_type, date_trunc('minute', ts)")
def bars_merge(spark, d):
    return bars.merge(ticks(spark, d).withColumn("ts", F.date_trunc("minute", "ts"))).drop("seq")


@query("SELECT event_type AS symbol, epoch_ms(date_trunc('minute', ts)) // 1000 AS time, round(first(value ORDER BY event_id), 6) AS price FROM events GROUP BY event_type, date_trunc('minute', ts), epoch_ms(date_trunc('minute', ts)) // 1000")
def bars_pages(spark, d):
    rows = ticks(spark, d).withColumn("time", F.unix_timestamp(F.date_trunc("minute", "ts").cast("timestamp")))
    return payloads.merge_pages(rows.select("symbol", "time", "price", c("seq").alias("page_seq")))


@query(f"WITH {T}, {B}, h AS (SELECT * FROM b WHERE ts < TIMESTAMP '2024-01-20' QUALIFY ts > min(ts) OVER (PARTITION BY symbol)), l AS (SELECT *, close + 1 AS c2 FROM b WHERE ts >= TIMESTAMP '2024-01-19') SELECT symbol, {SHOW_TS}, round(c2, 6) AS close FROM l UNION ALL SELECT symbol, {SHOW_TS}, round(close, 6) AS close FROM h WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.symbol = h.symbol AND l.ts = h.ts)")
def bars_splice(spark, d):
    rows = hourly(spark, d).select("symbol", "ts", "close")
    return bars.splice(rows.filter("ts < timestamp_ntz'2024-01-20'"), rows.filter("ts >= timestamp_ntz'2024-01-19'").withColumn("close", c("close") + 1))


@query(f"WITH {T}, {B} SELECT symbol, {SHOW_TS}, {OHLC}, CAST(epoch(ts) AS BIGINT) AS opening, CAST(epoch(ts) AS BIGINT) + 3600 AS closing, CAST(epoch(ts) AS BIGINT) + 3600 - 1706659200 AS remaining FROM b QUALIFY ts = max(ts) OVER (PARTITION BY symbol)")
def bars_current(spark, d):
    rows = hourly(spark, d).select("symbol", "ts", "open", "high", "low", "close")
    return bars.current(rows, 3600, F.lit(1706659200).cast("bigint"))


@query(f"WITH {T}, {B} SELECT symbol, CASE WHEN open < close THEN 'green' WHEN open > close THEN 'red' ELSE 'gray' END AS colour, count(*) AS n FROM b GROUP BY ALL")
def bars_colour(spark, d):
    return hourly(spark, d).groupBy("symbol", bars.colour(c("open"), c("close")).alias("colour")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {T}, {B} SELECT symbol, {SHOW_TS}, round(close, 6) AS close FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 50")
def bars_history(spark, d):
    return bars.history(hourly(spark, d), 3600).select("symbol", "ts", "close")


# ---- tables and loads -------------------------------------------------------------------------

@query("SELECT event_type AS symbol, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM events GROUP BY event_type")
def table_stats(spark, d):
    return tables.stats(ticks(spark, d))


@query("SELECT symbol, timeframe, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(price, 6) AS price FROM (SELECT event_type AS symbol, 'M1' AS timeframe, date_trunc('hour', ts) AS ts, last(value ORDER BY event_id % 2, event_id) AS price FROM events GROUP BY event_type, date_trunc('hour', ts))")
def table_upsert(spark, d):
    rows = ticks(spark, d).select("symbol", F.lit("M1").alias("timeframe"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "price", "seq")
    old = bars.keep_by_key(rows.filter("seq % 2 = 0"), ["symbol", "ts"], ["seq"]).drop("seq")
    return tables.upserted(old, rows.filter("seq % 2 = 1"), seq="seq")


@query("SELECT c_mktsegment AS symbol, strftime(coalesce(m + INTERVAL 1 MINUTE, TIMESTAMP '2022-01-31'), '%Y-%m-%d %H:%M:%S') AS start FROM (SELECT DISTINCT c_mktsegment FROM customer UNION SELECT DISTINCT n_name FROM nation) LEFT JOIN (SELECT c_mktsegment AS s, max(o_orderdate) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) ON s = c_mktsegment")
def load_start(spark, d):
    people = table(spark, d, "customer")
    stored = table(spark, d, "orders").join(people, c("o_custkey") == c("c_custkey")).select(c("c_mktsegment").alias("symbol"), c("o_orderdate").alias("ts"))
    wanted = people.select(c("c_mktsegment").alias("symbol")).unionByName(table(spark, d, "nation").select(c("n_name").alias("symbol"))).distinct()
    return tables.load_start(wanted, stored, F.lit("2024-01-31 08:00:00").cast("timestamp_ntz"))


@query("WITH s AS (SELECT event_type AS symbol, max(ts) + INTERVAL 1 MINUTE AS a FROM events GROUP BY event_type), w AS (SELECT symbol, unnest(generate_series(a, TIMESTAMP '2024-03-15', INTERVAL 3 DAY + INTERVAL 1 MINUTE)) AS ts FROM s) SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS start, strftime(least(ts + INTERVAL 3 DAY, TIMESTAMP '2024-03-15'), '%Y-%m-%d %H:%M:%S') AS \"end\" FROM w")
def load_windows(spark, d):
    last = ticks(spark, d).groupBy("symbol").agg((F.max("ts") + F.expr("interval 1 minute")).alias("start"))
    return tables.load_windows(last, F.lit("2024-03-15 00:00:00").cast("timestamp_ntz"))


@query("SELECT event_type AS symbol, 'M1' AS timeframe, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(value, 6) AS close, round(value * 0.5, 6) AS low, round(value * 2, 6) AS high, round(value + 1, 6) AS open, greatest(coalesce(CAST(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 3 - 1 END AS DOUBLE), 1.0), 1.0) AS volume, true AS is_complete FROM events")
def vendor_bars(spark, d):
    p = c("price")
    rows = ticks(spark, d).select("symbol", "ts", (p + 1).alias("open"), (p * 2).alias("high"), (p * 0.5).alias("low"), p.alias("close"), F.when(c("seq") % 3 != 0, c("seq") % 3 - 1).alias("volume"))
    return tables.vendor_bars(rows)


@query("SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, seq FROM (SELECT event_type AS symbol, ts, event_id AS seq FROM events ORDER BY ts DESC, seq DESC LIMIT 100)")
def ledger_tail(spark, d):
    return tables.tail(ticks(spark, d).select("symbol", "ts", "seq"), 100)


# ---- quality ----------------------------------------------------------------------------------

@query("SELECT array_to_string(list_filter([CASE WHEN value - 2 > 0 THEN NULL ELSE 'bid' END, CASE WHEN value + event_id % 5 - 3 > 0 THEN NULL ELSE 'ask' END, CASE WHEN value - 2 <= value + event_id % 5 - 3 THEN NULL ELSE 'spread' END, CASE WHEN event_id % 7 > 0 THEN NULL ELSE 'source' END], lambda x: x IS NOT NULL), ',') AS violations, count(*) AS n FROM events GROUP BY ALL")
def quality_ticks(spark, d):
    rows = ticks(spark, d).select((c("price") - 2).alias("bid"), (c("price") + c("seq") % 5 - 3).alias("ask"), F.when(c("seq") % 7 > 0, "live").alias("source"))
    return quality.checked(rows, quality.tick_rules(("historical", "live"))).groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH x AS (SELECT l_extendedprice AS open, l_extendedprice * (1 + l_tax) AS high, l_extendedprice * (1 - l_discount / 2) AS low, l_extendedprice * (1 - l_discount + l_tax) AS close, l_quantity - 2 AS volume FROM lineitem) SELECT array_to_string(list_filter([CASE WHEN low <= high THEN NULL ELSE 'range' END, CASE WHEN open BETWEEN low AND high THEN NULL ELSE 'open' END, CASE WHEN close BETWEEN low AND high THEN NULL ELSE 'close' END, CASE WHEN volume >= 0 THEN NULL ELSE 'volume' END], lambda x: x IS NOT NULL), ',') AS violations, count(*) AS n FROM x GROUP BY ALL")
def quality_bars(spark, d):
    p = c("l_extendedprice")
    rows = table(spark, d, "lineitem").select(p.alias("open"), (p * (1 + c("l_tax"))).alias("high"), (p * (1 - c("l_discount") / 2)).alias("low"), (p * (1 - c("l_discount") + c("l_tax"))).alias("close"), (c("l_quantity") - 2).alias("volume"))
    return quality.checked(rows, quality.bar_rules()).groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, strftime(CASE WHEN event_id % 4 = 2 THEN NULL ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS ts FROM events")
def quality_utc(spark, d):
    zones = F.element_at(F.array(*map(F.lit, ("", "Z", "+02:00", "+00:00"))), (c("event_id") % 4 + 1).cast("int"))
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zones)
    return table(spark, d, "events").select("event_id", quality.utc(text).alias("ts"))


@query("SELECT n_name AS symbol, count(*) AS n, r_name = 'ASIA' AS known FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def quality_whitelist(spark, d):
    nations = table(spark, d, "nation")
    rows = table(spark, d, "customer").join(nations, c("c_nationkey") == c("n_nationkey")).select(c("n_name").alias("symbol"))
    listed = nations.join(table(spark, d, "region").filter("r_name = 'ASIA'"), c("n_regionkey") == c("r_regionkey")).select(c("n_name").alias("symbol"))
    good, other = quality.known_symbols(rows, listed)
    both = good.withColumn("known", F.lit(True)).unionByName(other.withColumn("known", F.lit(False)))
    return both.groupBy("symbol", "known").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey AS batch, count(DISTINCT l_returnflag) AS symbols, count(DISTINCT l_linestatus) AS timeframes FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1 OR count(DISTINCT l_linestatus) > 1")
def quality_batches(spark, d):
    return quality.mixed_batches(table(spark, d, "lineitem").select(c("l_orderkey").alias("batch"), c("l_returnflag").alias("symbol"), c("l_linestatus").alias("timeframe")), "batch")


# ---- calendar ---------------------------------------------------------------------------------

EASTER = "make_date(y, CAST((h + l - 7 * m + 114) // 31 AS BIGINT), CAST((h + l - 7 * m + 114) % 31 + 1 AS BIGINT))"
HOLIDAYS = f"""y0 AS (SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS y FROM orders), y1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS cc FROM y0),
y2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM y1), y3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (cc // 4) - h - cc % 4) % 7 AS l FROM y2),
y4 AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM y3), y5 AS (SELECT y, {EASTER} AS e FROM y4),
f AS (SELECT make_date(y, mm, dd) AS d FROM y0, (VALUES (1, 1), (12, 25), (12, 26), (12, 31), (7, 4)) AS v(mm, dd)),
hol AS (SELECT CASE isodow(d) WHEN 6 THEN d - 1 WHEN 7 THEN d + 1 ELSE d END AS date FROM f UNION SELECT e - 2 FROM y5 UNION SELECT e + 1 FROM y5)"""


def order_holidays(spark, d):
    years = table(spark, d, "orders").agg(F.year(F.min("o_orderdate")).alias("a"), F.year(F.max("o_orderdate")).alias("z")).first()
    return calendar.holidays(spark, years["a"], years["z"])


@query(f"WITH {HOLIDAYS} SELECT isodow(o_orderdate) >= 6 AS is_weekend, hol.date IS NOT NULL AS is_holiday, count(*) AS n FROM orders LEFT JOIN hol ON CAST(o_orderdate AS DATE) = hol.date GROUP BY ALL")
def calendar_closed(spark, d):
    rows = calendar.with_closed(table(spark, d, "orders"), order_holidays(spark, d), "o_orderdate")
    return rows.groupBy("is_weekend", "is_holiday").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {T}, {Q}, p AS (SELECT symbol, lag(ts) OVER {W} AS gap_start, ts AS gap_end FROM b) SELECT symbol, strftime(gap_start, '%Y-%m-%d %H:%M:%S') AS gap_start, strftime(gap_end, '%Y-%m-%d %H:%M:%S') AS gap_end, CAST((epoch(gap_end) - epoch(gap_start)) / 900 - 1 AS BIGINT) AS size FROM p WHERE gap_end - gap_start > INTERVAL 15 MINUTE")
def calendar_gaps(spark, d):
    return calendar.gaps(hourly(spark, d, 900), 900)


CLOSED = "(isodow(x) = 6 OR (isodow(x) = 7 AND hour(x) < 21) OR (isodow(x) = 5 AND hour(x) >= 21))"
#: holidays of the years of the events, and of one on either side
EVENT_HOLIDAYS = HOLIDAYS.replace("SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS y FROM orders", "SELECT unnest(range(min(year(ts)) - 1, max(year(ts)) + 2)) AS y FROM events")
MARKED = "mm AS (SELECT *, CAST(x AS DATE) IN (SELECT date FROM hol) AS hd FROM m)"


@query(f"WITH {EVENT_HOLIDAYS}, {T}, {Q}, p AS (SELECT symbol, lag(ts) OVER {W} AS gap_start, ts AS gap_end FROM b), g AS (SELECT * FROM p WHERE gap_end - gap_start > INTERVAL 15 MINUTE), m AS (SELECT symbol, gap_start, gap_end, unnest(generate_series(gap_start, gap_end, INTERVAL 1 MINUTE)) AS x FROM g), {MARKED}, k AS (SELECT symbol, gap_start, CASE WHEN bool_and({CLOSED}) THEN 'weekend' WHEN bool_and({CLOSED} OR hd) THEN 'holiday' ELSE 'unexpected' END AS kind FROM mm GROUP BY symbol, gap_start) SELECT symbol, kind, count(*) AS n FROM k GROUP BY ALL")
def calendar_gap_kinds(spark, d):
    rows = hourly(spark, d, 900)
    _, table_ = calendar.calendar_of(table(spark, d, "events"))
    return calendar.classified(calendar.gaps(rows, 900), table_).groupBy("symbol", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EVENT_HOLIDAYS}, u AS (SELECT user_id, date_trunc('minute', min(ts)) AS a, date_trunc('minute', max(ts)) AS z FROM events GROUP BY user_id), m AS (SELECT user_id, unnest(generate_series(a, z, INTERVAL 1 MINUTE)) AS x FROM u), {MARKED} SELECT user_id, count(*) FILTER (WHERE NOT {CLOSED} AND NOT hd) AS minutes FROM mm GROUP BY user_id")
def calendar_minutes(spark, d):
    spans = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    _, table_ = calendar.calendar_of(table(spark, d, "events"))
    return calendar.trading_minutes(spans, table_, "a", "z").select("user_id", c("minutes").cast("bigint").alias("minutes"))


@query(f"WITH {EVENT_HOLIDAYS}, {T}, {Q}, p AS (SELECT symbol, lag(ts) OVER {W} AS a, ts AS z FROM b), g AS (SELECT *, CAST((epoch(z) - epoch(a)) / 900 - 1 AS BIGINT) AS size FROM p WHERE z - a > INTERVAL 15 MINUTE), e AS (SELECT * FROM g WHERE size > 5 AND a >= (SELECT CAST(max(ts) AS DATE) - 90 FROM t) AND NOT (isodow(a) IN (5, 6) AND isodow(z) IN (6, 7)) AND NOT {CLOSED.replace('x)', 'a)')} AND NOT {CLOSED.replace('x)', 'z)')} AND CAST(a AS DATE) NOT IN (SELECT date FROM hol) AND CAST(z AS DATE) NOT IN (SELECT date FROM hol)) SELECT symbol, strftime(a + INTERVAL 15 MINUTE, '%Y-%m-%d %H:%M:%S') AS start, strftime(z - INTERVAL 15 MINUTE, '%Y-%m-%d %H:%M:%S') AS \"end\" FROM e")
def calendar_repairs(spark, d):
    events = table(spark, d, "events")
    now = events.agg(F.max("ts")).first()[0]
    found = calendar.unexpected(calendar.gaps(hourly(spark, d, 900), 900), calendar.holidays_of(events), F.lit(now).cast("timestamp_ntz"))
    return calendar.repair_windows(found, 900)


GAP_X = CLOSED.replace("x)", "ts)")


@query(f"WITH {EVENT_HOLIDAYS}, {T}, {Q}, {GRID}, gg AS (SELECT *, CAST(ts AS DATE) IN (SELECT date FROM hol) AS hd FROM g) SELECT symbol, count(*) AS slots, count(*) FILTER (WHERE close IS NULL AND {GAP_X}) AS weekend, count(*) FILTER (WHERE close IS NULL AND NOT {GAP_X} AND hd) AS holiday, count(*) FILTER (WHERE close IS NULL AND NOT {GAP_X} AND NOT hd) AS unexpected, round(100 * (count(*) - count(close)) / count(*), 2) AS percent FROM gg GROUP BY symbol")
def calendar_gap_summary(spark, d):
    return calendar.gap_summary(bars.grid(hourly(spark, d, 900), 900, ["close"]), calendar.holidays_of(table(spark, d, "events")))


# ---- features ---------------------------------------------------------------------------------

BODY, RNG = "(close - open)", safe("high - low")
RUN = "sum(CASE WHEN {} THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY ts)"
ACTION = f"""a0 AS (SELECT *, {BODY} AS body, lag(close - open) OVER {W} AS pb, lag(open) OVER {W} AS po, {RUN.format('close > open')} AS ru, {RUN.format('close < open')} AS rd FROM b),
a AS (SELECT *, sum(CASE WHEN close > open THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, ru ORDER BY ts) AS bull, sum(CASE WHEN close < open THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, rd ORDER BY ts) AS bear FROM a0)"""


@query(f"WITH {T}, {B}, {ACTION} " + select({"BODY_TO_RANGE_RATIO": f"abs(body) / {RNG}", "UPPER_WICK_TO_BODY_RATIO": f"(high - greatest(open, close)) / {safe('abs(body)')}", "LOWER_WICK_TO_BODY_RATIO": f"(least(open, close) - low) / {safe('abs(body)')}", "CLOSE_POSITION_IN_CANDLE": f"(close - low) / {RNG}"}, "a", f"symbol, {SHOW_TS}, CAST(coalesce((pb < 0 AND body > 0 AND close > po) OR (pb > 0 AND body < 0 AND close < po), false) AS BIGINT) AS TWO_BAR_REVERSAL, CAST(bull AS BIGINT) AS CONSECUTIVE_BULL_BARS, CAST(bear AS BIGINT) AS CONSECUTIVE_BEAR_BARS"))
def features_price_action(spark, d):
    out = features.price_action(hourly(spark, d))
    return out.select("symbol", "ts", *features.GROUPS["PRICE_ACTION"])


TP = "p AS (SELECT *, (high + low + close) / 3 AS tp, CASE WHEN hour(ts) BETWEEN 7 AND 16 THEN volume END AS vl, CASE WHEN hour(ts) BETWEEN 12 AND 21 THEN volume END AS vn, CASE WHEN hour(ts) BETWEEN 0 AND 9 THEN volume END AS vt FROM b)"
MEAN10, SD10 = rolled("avg", "close", 10), rolled("stddev_samp", "close", 10)
PLAIN = {
    "CCI": f"(tp - {rolled('avg', 'tp', 10)}) / (0.015 * {safe(rolled('stddev_samp', 'tp', 10))})",
    "RETURN_1": f"ln(close / {safe(f'lag(close) OVER {W}')})",
    "RETURN_3": f"ln(close / {safe(f'lag(close, 3) OVER {W}')})",
    "MOMENTUM_OSCILLATOR": f"close - lag(close, 3) OVER {W}",
    "BB_WIDTH": f"4 * {SD10} / {safe(MEAN10)}",
    "BB_UPPER_DIST": f"({MEAN10} + 2 * {SD10} - close) / {safe('close')}",
    "BB_LOWER_DIST": f"(close - {MEAN10} + 2 * {SD10}) / {safe('close')}",
    "BB_PERCENT_B": f"(close - {MEAN10} + 2 * {SD10}) / {safe(f'4 * {SD10}')}",
    "RELATIVE_VOLUME_RVOL": f"volume / {safe(rolled('avg', 'volume', 10))}",
    "HOUR_OF_DAY_NORMALIZED": "(hour(ts) + minute(ts) / 60) / 24",
    **{f"DIST_SMA{n}": f"(close - {rolled('avg', 'close', n)}) / {safe(rolled('avg', 'close', n))} * 100" for n in (20, 50, 200)},
    **{f"RVOL_{s}": f"coalesce(volume / {safe(rolled('avg', v, 100))}, 1.0)" for s, v in (("LONDON", "vl"), ("NEWYORK", "vn"), ("TOKYO", "vt"))},
}


@query(f"WITH {T}, {B}, {TP} " + select(PLAIN, "p"))
def features_windows(spark, d):
    return features.plain_windows(hourly(spark, d)).select("symbol", "ts", *PLAIN)


def ewm_sql(outs: dict[str, tuple[str, float, int]], source: str, name: str = "e") -> str:
    """Exponential means by recursion over the rows of a symbol: name -> (x, alpha, min_periods)."""
    state = ", ".join(f"CASE WHEN x.{x} IS NULL THEN s.{n} WHEN s.{n} IS NULL THEN x.{x} ELSE (1 - {a!r}) * s.{n} + {a!r} * x.{x} END AS {n}, s.n_{n} + CASE WHEN x.{x} IS NULL THEN 0 ELSE 1 END AS n_{n}" for n, (x, a, _) in outs.items())
    first = ", ".join(f"CAST({x} AS DOUBLE) AS {n}, CASE WHEN {x} IS NULL THEN 0 ELSE 1 END AS n_{n}" for n, (x, _, _) in outs.items())
    shown_ = ", ".join(f"CASE WHEN n_{n} >= {m} THEN {n} END AS {n}" for n, (_, _, m) in outs.items())
    rows = f"(SELECT *, row_number() OVER {W} AS i FROM {source})"
    return f"{name}x AS MATERIALIZED {rows}, {name}r AS (WITH RECURSIVE s AS (SELECT symbol, i, {first} FROM {name}x WHERE i = 1 UNION ALL SELECT s.symbol, x.i, {state} FROM s JOIN {name}x AS x ON x.symbol = s.symbol AND x.i = s.i + 1) SELECT * FROM s), {name} AS (SELECT {name}x.*, {shown_} FROM {name}x JOIN {name}r ON {name}x.symbol = {name}r.symbol AND {name}x.i = {name}r.i)"


MOVES_OF = f"mv0{{0}} AS (SELECT *, lag(close) OVER {W} AS pc, lag(high) OVER {W} AS ph, lag(low) OVER {W} AS pl FROM {{1}}), mv{{0}} AS (SELECT * EXCLUDE (pc, ph, pl), CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS gain, CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS loss, coalesce(greatest(high - low, abs(high - pc), abs(low - pc)), high - low) AS tr, CASE WHEN pc IS NOT NULL THEN greatest(high - ph, 0) END AS up, CASE WHEN pc IS NOT NULL THEN greatest(pl - low, 0) END AS down FROM mv0{{0}})"
MOVES = MOVES_OF.replace('{0}', '').replace('{1}', '{}')
PDI, MDI = f"(100 * pdm / {safe('atr14')})", f"(100 * mdm / {safe('atr14')})"
RECURRENT = f"{MOVES.format('b')}, {ewm_sql({'ag': ('gain', 0.2, 5), 'al': ('loss', 0.2, 5), 'fast': ('close', 2 / 7, 1), 'slow': ('close', 2 / 19, 1), 'atr': ('tr', 0.2, 5), 'kc': ('close', 2 / 11, 1), 'pdm': ('up', 1 / 14, 14), 'mdm': ('down', 1 / 14, 14), 'atr14': ('tr', 1 / 14, 14)}, 'mv', 'e')}, l1 AS (SELECT * EXCLUDE (i), fast - slow AS macd, 100 * abs({PDI} - {MDI}) / {safe(f'{PDI} + {MDI}')} AS dx FROM e), {ewm_sql({'sig': ('macd', 2 / 6, 1), 'adx': ('dx', 1 / 14, 14)}, 'l1', 'f')}"


@query(f"WITH {T}, {B}, {RECURRENT} " + select({"RSI": f"100 - 100 / (1 + ag / {safe('al')})", "MACD_VALUE": "macd", "MACD_SIGNAL": "sig", "MACD_HIST": "macd - sig", "ATR": "atr", "NATR": f"atr / {safe('close')} * 100", "KC_WIDTH": f"3 * atr / {safe('kc')}", "ADX": "adx"}, "f"))
def features_recurrent(spark, d):
    out = features.recurrent(hourly(spark, d))
    return out.select("symbol", "ts", "RSI", "MACD_VALUE", "MACD_SIGNAL", "MACD_HIST", "ATR", "NATR", "KC_WIDTH", "ADX")


def long_sql(k: int) -> str:
    """Features of buckets of k hours as CTEs; k{k} has them by (symbol, ts) of the hourly bars."""
    at = f"to_timestamp(floor(epoch(ts) / {k * 3600}) * {k * 3600}) AT TIME ZONE 'UTC'"
    long = f"lg{k} AS (SELECT symbol, {at} AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close FROM b GROUP BY symbol, {at})"
    means = ewm_sql({"ag": ("gain", 0.2, 5), "al": ("loss", 0.2, 5), "e5": ("close", 2 / 6, 1), "e13": ("close", 2 / 14, 1)}, f"mv{k}", f"e{k}")
    high, low = rolled("max", "high", 10), rolled("min", "low", 10)
    known = f"v{k} AS (SELECT symbol, ts + INTERVAL {k} HOUR AS known, 100 - 100 / (1 + ag / {safe('al')}) AS rsi, CAST(sign(e5 - e13) AS DOUBLE) AS trend, (close - {low}) / {safe(f'{high} - {low}')} AS pos FROM e{k})"
    joined = f"j{k} AS (SELECT b.symbol, b.ts, rsi, trend, pos FROM b LEFT JOIN v{k} AS v ON v.symbol = b.symbol AND v.known = {at.replace('(ts)', '(b.ts)')})"
    seen = ", ".join(f"last_value({x} IGNORE NULLS) OVER {W} AS {y}_{k}T" for x, y in (("rsi", "RSI"), ("trend", "TREND"), ("pos", "CLOSE_POS")))
    return f"{long}, {MOVES_OF.format(k, f'lg{k}')}, {means}, {known}, {joined}, k{k} AS (SELECT symbol, ts, {seen} FROM j{k})"


LONGER = [f"{x}_{k}T" for k in (5, 15) for x in ("RSI", "TREND", "CLOSE_POS")]


@query(f"WITH {T}, {B}, {long_sql(5)}, {long_sql(15)}, k AS (SELECT * FROM k5 JOIN k15 USING (symbol, ts)) " + select({x: x for x in LONGER}, "k"))
def features_timeframe(spark, d):
    rows = hourly(spark, d)
    return features.multi_timeframe(rows.select("symbol", "ts"), rows, 3600).select("symbol", "ts", *LONGER)


ACTION_OF = {"BODY_TO_RANGE_RATIO": f"abs(body) / {RNG}", "UPPER_WICK_TO_BODY_RATIO": f"(high - greatest(open, close)) / {safe('abs(body)')}", "LOWER_WICK_TO_BODY_RATIO": f"(least(open, close) - low) / {safe('abs(body)')}", "CLOSE_POSITION_IN_CANDLE": f"(close - low) / {RNG}"}
RECURRENT_OF = {"RSI": f"100 - 100 / (1 + ag / {safe('al')})", "MACD_VALUE": "macd", "MACD_SIGNAL": "sig", "MACD_HIST": "macd - sig", "ATR": "atr", "NATR": f"atr / {safe('close')} * 100", "KC_WIDTH": f"3 * atr / {safe('kc')}", "ADX": "adx"}
COUNTS_OF = {"TWO_BAR_REVERSAL": "CAST(coalesce((pb < 0 AND body > 0 AND close > po) OR (pb > 0 AND body < 0 AND close < po), false) AS BIGINT)", "CONSECUTIVE_BULL_BARS": "CAST(bull AS BIGINT)", "CONSECUTIVE_BEAR_BARS": "CAST(bear AS BIGINT)"}
DERIVED_OF = {
    "VOLATILITY_REGIME": f"ATR / {safe(rolled('avg', 'ATR', 100))}",
    "BB_MOMENTUM": "BB_WIDTH * abs(MOMENTUM_OSCILLATOR)",
    "RSI_TREND_5T": "RSI * TREND_5T",
    "STREAK_TREND": "CONSECUTIVE_BEAR_BARS * TREND_5T",
    "ADX_RETURN": "ADX * RETURN_1",
    "RETURN_1_MEAN_5": rolled("avg", "RETURN_1", 5),
    "RETURN_1_STD_5": rolled("stddev_samp", "RETURN_1", 5),
    "RSI_MEAN_10": rolled("avg", "RSI", 10),
    "CLOSE_POS_MEAN_5": rolled("avg", "CLOSE_POSITION_IN_CANDLE", 5),
    "MACD_HIST_SLOPE": f"(MACD_HIST - lag(MACD_HIST, 3) OVER {W}) / 3",
    **{f"{x}_LAG{n}": f"lag({x}, {n}) OVER {W}" for x in ("CLOSE_POSITION_IN_CANDLE", "RETURN_1", "RSI") for n in (1, 2, 3, 5)},
}


def columns_sql(names: dict[str, str]) -> str:
    return ", ".join(f"{x} AS {n}" for n, x in names.items())


STACK = f"""{RECURRENT}, {TP.replace('SELECT *', 'SELECT * EXCLUDE (i)').replace('FROM b', 'FROM f')}, {ACTION.replace('FROM b', 'FROM p')}, {long_sql(5)}, {long_sql(15)},
m1 AS (SELECT symbol, ts, {columns_sql(PLAIN | ACTION_OF | RECURRENT_OF | COUNTS_OF)} FROM a),
m2 AS (SELECT * FROM m1 JOIN k5 USING (symbol, ts) JOIN k15 USING (symbol, ts)),
m3 AS (SELECT *, CAST(CASE WHEN BB_WIDTH < KC_WIDTH THEN 1 ELSE 0 END AS BIGINT) AS BB_KC_SQUEEZE, {columns_sql(DERIVED_OF)} FROM m2),
m AS (SELECT *, CLOSE_POSITION_IN_CANDLE * VOLATILITY_REGIME AS CLOSEPOS_VOLREGIME FROM m3)"""
WHOLE = ("BB_KC_SQUEEZE", *COUNTS_OF)  # columns of whole numbers
DERIVED = [*DERIVED_OF, "CLOSEPOS_VOLREGIME"]


@query(f"WITH {T}, {B}, {STACK} " + select({x: x for x in DERIVED}, "m", f"symbol, {SHOW_TS}, BB_KC_SQUEEZE"))
def features_derived(spark, d):
    return features.transform(hourly(spark, d), 3600).select("symbol", "ts", "BB_KC_SQUEEZE", *DERIVED)


FULL = " AND ".join(f"{x} IS NOT NULL AND NOT isnan({x})" for x in features.COLUMNS if x not in WHOLE)


@query(f"WITH {T}, {B}, {STACK} " + select({x: x for x in features.COLUMNS if x not in WHOLE}, f"m WHERE {FULL}", f"symbol, {SHOW_TS}, '1' AS feature_version, {', '.join(WHOLE)}"))
def features_matrix(spark, d):
    return features.matrix(hourly(spark, d), 3600)


@query(f"WITH {T}, {B}, {STACK} " + select({x: f"CASE WHEN isfinite(CAST({x} AS DOUBLE)) THEN CAST({x} AS DOUBLE) ELSE 0 END" for x in features.COLUMNS}, "m QUALIFY ts = max(ts) OVER (PARTITION BY symbol)"))
def features_latest(spark, d):
    return features.latest(features.transform(hourly(spark, d), 3600).select("symbol", "ts", *features.COLUMNS))


LAGS = {f"RETURN_1_LAG{n}": f"lag(r1, {n}) OVER {W}" for n in (1, 2, 3, 5)} | {"RETURN_1_MEAN_5": rolled("avg", "r1", 5), "RETURN_1_STD_5": rolled("stddev_samp", "r1", 5), "CLOSE_POS_MEAN_5": rolled("avg", "cp", 5)}


@query(f"WITH {T}, {B}, z AS (SELECT *, ln(close / {safe(f'lag(close) OVER {W}')}) AS r1, (close - low) / {RNG} AS cp FROM b) " + select(LAGS, "z"))
def features_lagged(spark, d):
    return features.transform(hourly(spark, d), 3600).select("symbol", "ts", *LAGS)


# ---- indicators -------------------------------------------------------------------------------

@query(f"WITH {T}, {B} " + select({"SMA": rolled("avg", "close", 14), "MIDDLE": rolled("avg", "close", 20), "UPPER": f"{rolled('avg', 'close', 20)} + 2 * {rolled('stddev_pop', 'close', 20)}", "LOWER": f"{rolled('avg', 'close', 20)} - 2 * {rolled('stddev_pop', 'close', 20)}"}, "b"))
def indicator_bands(spark, d):
    return indicators.indicator(indicators.indicator(hourly(spark, d), "sma"), "bollinger").select("symbol", "ts", "SMA", "MIDDLE", "UPPER", "LOWER")


HI14, LO14 = rolled("max", "high", 14), rolled("min", "low", 14)


@query(f"WITH {T}, {B}, k AS (SELECT symbol, ts, CASE WHEN {HI14} = {LO14} THEN 100.0 ELSE (close - {LO14}) / ({HI14} - {LO14}) * 100 END AS k FROM b) " + select({"K": "k", "D": rolled("avg", "k", 3)}, "k"))
def indicator_stochastic(spark, d):
    return indicators.stochastic(hourly(spark, d)).select("symbol", "ts", "K", "D")


def mid_sql(n):
    return f"({rolled('max', 'high', n)} + {rolled('min', 'low', n)}) / 2"


@query(f"WITH {T}, {B}, k AS (SELECT *, {mid_sql(9)} AS tk, {mid_sql(26)} AS kj, {mid_sql(52)} AS sb FROM b) " + select({"TENKAN": "tk", "KIJUN": "kj", "SENKOU_A": f"lag((tk + kj) / 2, 26) OVER {W}", "SENKOU_B": f"lag(sb, 26) OVER {W}", "CHIKOU": f"lead(close, 26) OVER {W}"}, "k"))
def indicator_ichimoku(spark, d):
    return indicators.ichimoku(hourly(spark, d)).select("symbol", "ts", "TENKAN", "KIJUN", "SENKOU_A", "SENKOU_B", "CHIKOU")


def seeded_sql(outs: dict[str, tuple[str, float, int]], source: str, name: str) -> str:
    """Seeded means by recursion: name -> (x, alpha, seed); x may start with nulls."""
    first = ", ".join(f"CAST(NULL AS DOUBLE) AS {n}, CASE WHEN {x} IS NULL THEN 0 ELSE 1 END AS n_{n}, coalesce({x}, 0) AS s_{n}" for n, (x, _, _) in outs.items())
    state = ", ".join(f"CASE WHEN x.{x} IS NULL THEN s.{n} WHEN s.n_{n} + 1 < {k} THEN NULL WHEN s.n_{n} + 1 = {k} THEN (s.s_{n} + x.{x}) / {k} ELSE (1 - {a!r}) * s.{n} + {a!r} * x.{x} END AS {n}, s.n_{n} + CASE WHEN x.{x} IS NULL THEN 0 ELSE 1 END AS n_{n}, s.s_{n} + coalesce(x.{x}, 0) AS s_{n}" for n, (x, a, k) in outs.items())
    keep = ", ".join(f"r.{n}" for n in outs)
    return f"{name}x AS MATERIALIZED (SELECT *, row_number() OVER {W} AS i FROM {source}), {name}r AS (WITH RECURSIVE s AS (SELECT symbol, i, {first} FROM {name}x WHERE i = 1 UNION ALL SELECT s.symbol, x.i, {state} FROM s JOIN {name}x AS x ON x.symbol = s.symbol AND x.i = s.i + 1) SELECT * FROM s), {name} AS (SELECT x.* EXCLUDE (i), {keep} FROM {name}x AS x JOIN {name}r AS r ON x.symbol = r.symbol AND x.i = r.i)"


WILDER = f"mv0 AS (SELECT *, lag(close) OVER {W} AS pc, high - lag(high) OVER {W} AS u, lag(low) OVER {W} - low AS dn FROM b), mv AS (SELECT symbol, ts, close, CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS gain, CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS loss, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, CASE WHEN pc IS NOT NULL THEN CASE WHEN u > dn AND u > 0 THEN u ELSE 0 END END AS pd, CASE WHEN pc IS NOT NULL THEN CASE WHEN dn > u AND dn > 0 THEN dn ELSE 0 END END AS md FROM mv0)"
A14 = 1 / 14
PD2, MD2 = f"(100 * p / {safe('t14')})", f"(100 * m / {safe('t14')})"


@query(f"WITH {T}, {B}, {WILDER}, {seeded_sql({'ag': ('gain', A14, 14), 'al': ('loss', A14, 14), 't14': ('tr', A14, 14), 'p': ('pd', A14, 14), 'm': ('md', A14, 14), 'ema': ('close', 2 / 15, 14)}, 'mv', 'e')}, l1 AS (SELECT *, 100 * abs({PD2} - {MD2}) / {safe(f'{PD2} + {MD2}')} AS dx FROM e), {seeded_sql({'adx': ('dx', A14, 14)}, 'l1', 'f')} " + select({"EMA": "ema", "RSI": "100 - 100 / (1 + ag / CASE WHEN al = 0 THEN 1e-5 ELSE al END)", "ATR": "t14", "PLUS_DI": PD2, "MINUS_DI": MD2, "ADX": "adx"}, "f"))
def indicator_wilder(spark, d):
    out = indicators.recurrent(hourly(spark, d), ["EMA", "RSI", "ATR", "ADX"])
    return out.select("symbol", "ts", "EMA", "RSI", "ATR", "PLUS_DI", "MINUS_DI", "ADX")


@query(f"WITH {T}, {B}, {seeded_sql({'ef': ('close', 2 / 13, 12), 'es': ('close', 2 / 27, 26)}, 'b', 'e')}, l1 AS (SELECT *, ef - es AS macd FROM e), {seeded_sql({'sig': ('macd', 0.2, 9)}, 'l1', 'f')} " + select({"MACD": "macd", "SIGNAL": "sig", "HISTOGRAM": "macd - sig"}, "f"))
def indicator_macd(spark, d):
    return indicators.macd(hourly(spark, d)).select("symbol", "ts", "MACD", "SIGNAL", "HISTOGRAM")


@query(f"WITH {T}, {B}, mv AS (SELECT *, greatest(close - lag(close) OVER {W}, 0) AS g0, greatest(lag(close) OVER {W} - close, 0) AS l0, lag(close) OVER {W} AS pc FROM b), mm AS (SELECT *, CASE WHEN pc IS NOT NULL THEN g0 END AS gain, CASE WHEN pc IS NOT NULL THEN l0 END AS loss FROM mv), q AS (SELECT symbol, ts, close, {rolled('avg', 'gain', 14)} AS ag, {rolled('avg', 'loss', 14)} AS al, avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS sma FROM mm), v AS (SELECT *, CASE WHEN al = 0 THEN 100.0 ELSE 100 - 100 / (1 + ag / al) END AS rsi FROM q), w AS (SELECT *, lag(rsi) OVER {W} AS prev FROM v) SELECT symbol, {SHOW_TS}, round(rsi, 6) AS RSI, round(sma, 6) AS SMA, CASE WHEN prev < 40 AND rsi > 40 AND close > sma THEN 'call' WHEN prev > 60 AND rsi < 60 AND close < sma THEN 'put' END AS rule FROM w")
def indicator_cross_rule(spark, d):
    out = indicators.quick_sma(indicators.quick_rsi(hourly(spark, d)))
    return indicators.cross_rule(out, 40, 60).select("symbol", "ts", "RSI", "SMA", "rule")


@query(f"WITH {T}, {B}, s AS (SELECT symbol, ts, {rolled('avg', 'close', 14)} AS sma FROM b) SELECT symbol, {SHOW_TS}, round(sma, 6) AS SMA FROM s QUALIFY ts = max(ts) OVER (PARTITION BY symbol)")
def indicator_last(spark, d):
    return indicators.last_values(indicators.sma(hourly(spark, d)), ["SMA"])


# ---- labels and models ------------------------------------------------------------------------

LABEL = f"lb AS (SELECT symbol, ts, close, CASE WHEN lead(close, 5) OVER {W} IS NOT NULL THEN CASE WHEN lead(close, 5) OVER {W} > close THEN 1 ELSE 0 END END AS label FROM b)"


@query(f"WITH {T}, {B}, {LABEL} SELECT symbol, {SHOW_TS}, CAST(label AS BIGINT) AS label FROM lb")
def label_direction(spark, d):
    return labels.direction(hourly(spark, d), "5_MIN").select("symbol", "ts", "label")


@query(f"WITH {T}, {B}, {MOVES.format('b')}, {ewm_sql({'atr': ('tr', 0.2, 5)}, 'mv', 'e')}, x AS (SELECT symbol, CASE WHEN abs(lead(close, 5) OVER {W} - close) < 0.5 * atr THEN -1 WHEN lead(close, 5) OVER {W} > close THEN 1 WHEN lead(close, 5) OVER {W} IS NOT NULL THEN 0 END AS label FROM e) SELECT symbol, count(label) AS total, count(*) FILTER (WHERE label = 1) AS calls, count(*) FILTER (WHERE label = 0) AS puts, count(*) FILTER (WHERE label = -1) AS skipped, round(count(*) FILTER (WHERE label = 1) / count(label), 4) AS call_pct, round(count(*) FILTER (WHERE label = 0) / count(label), 4) AS put_pct FROM x GROUP BY symbol")
def label_metadata(spark, d):
    return labels.metadata(labels.direction(hourly(spark, d), "5_MIN", min_move_atr=0.5))


@query(f"WITH {T}, {B}, {LABEL}, g AS (SELECT *, row_number() OVER {W} - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM lb WHERE label >= 0), k AS (SELECT *, CASE WHEN i < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN i < floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM g WHERE n >= 100) SELECT symbol, split, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts FROM k GROUP BY ALL")
def label_split(spark, d):
    rows = hourly(spark, d)
    joined = labels.labelled(rows, labels.direction(rows, "5_MIN"))
    return labels.time_split(joined).groupBy("symbol", "split").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))


@query(f"WITH {T}, {B}, {LABEL}, g AS (SELECT *, row_number() OVER {W} AS i, count(*) OVER (PARTITION BY symbol) AS n, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS w FROM lb WHERE label >= 0) SELECT symbol, {SHOW_TS}, CAST(label AS BIGINT) AS label, len(w) AS width, round(list_sum(w), 6) AS total FROM g WHERE i >= 30 AND n - 30 >= 10 AND i < n")
def label_sequences(spark, d):
    rows = labels.direction(hourly(spark, d), "5_MIN").filter("label >= 0")
    out = labels.sequences(rows, ["close"])
    return out.select("symbol", "ts", "label", F.size("window").cast("bigint").alias("width"), F.aggregate("window", F.lit(0.0), lambda a, x: a + x[0]).alias("total"))


@query(f"WITH {T}, {B}, {LABEL}, k AS (SELECT symbol, label, CASE CAST(hour(ts) % 3 AS BIGINT) WHEN 0 THEN 'CALL' WHEN 1 THEN 'PUT' ELSE 'SKIP' END AS action FROM lb WHERE label >= 0), r AS (SELECT symbol, CASE WHEN action = 'SKIP' THEN 0.0 WHEN (action = 'CALL') = (label = 1) THEN 0.85 ELSE -1.0 END AS x FROM k) SELECT symbol, round(avg(x), 6) AS mean, round(stddev_pop(x) + 1e-9, 6) AS std, count(*) AS steps, round(avg(x) / (stddev_pop(x) + 1e-9), 6) AS ratio FROM r GROUP BY symbol")
def label_policy(spark, d):
    rows = labels.direction(hourly(spark, d), "5_MIN").filter("label >= 0")
    action = F.element_at(F.array(F.lit("CALL"), F.lit("PUT"), F.lit("SKIP")), F.hour("ts") % 3 + 1)
    return labels.policy(rows.withColumn("action", action))


@query(f"WITH {T}, {B}, {LABEL} SELECT CAST(label AS BIGINT) AS label, count(*) AS n, round(CASE WHEN label = 1 THEN (SELECT count(*) FILTER (WHERE label = 0) / count(*) FILTER (WHERE label = 1) FROM lb) ELSE 1.0 END, 6) AS weight FROM lb WHERE label >= 0 GROUP BY label")
def label_weight(spark, d):
    rows = labels.direction(hourly(spark, d), "5_MIN").filter("label >= 0")
    return labels.class_weight(rows).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"))


SCORES = "sc AS (SELECT lang AS symbol, quality AS label, CAST(n_chars % 1000 AS DOUBLE) / 1000 AS p FROM labels JOIN documents ON labels.doc_id = documents.doc_id)"


@query(f"WITH {SCORES}, m AS (SELECT symbol, count(*) FILTER (WHERE p >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND label = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND label = 0) AS tn FROM sc GROUP BY symbol), u AS (SELECT a.symbol, avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS auc FROM sc AS a JOIN sc AS b ON a.symbol = b.symbol AND a.label = 1 AND b.label = 0 GROUP BY a.symbol) SELECT m.symbol, round(CASE WHEN u.auc IS NULL THEN 0 ELSE (tp + tn) / (tp + fp + fn + tn) END, 6) AS accuracy, round(CASE WHEN u.auc IS NULL OR tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN u.auc IS NULL OR tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN u.auc IS NULL OR tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1, round(coalesce(u.auc, 0), 6) AS auc FROM m LEFT JOIN u ON m.symbol = u.symbol")
def model_metrics(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(c("lang").alias("symbol"), c("quality").alias("label"), ((c("n_chars") % 1000).cast("double") / 1000).alias("p"))
    return models.metrics(rows)


RUNS = "ru AS (SELECT 'm' || CAST(o_orderkey % 7 AS VARCHAR) AS model_name, o_orderpriority AS symbol, o_orderstatus AS expiry_key, CASE WHEN o_orderkey % 3 = 0 THEN '0' ELSE '1' END AS feature_version, o_orderdate + to_seconds(o_orderkey) AS trained_at, round(o_totalprice / 600000, 4) AS auc, o_orderkey % 7 = 0 AS is_policy FROM orders)"


def runs(spark, d):
    k = c("o_orderkey")
    return table(spark, d, "orders").select(F.concat(F.lit("m"), (k % 7).cast("string")).alias("model_name"), c("o_orderpriority").alias("symbol"), c("o_orderstatus").alias("expiry_key"), F.when(k % 3 == 0, "0").otherwise("1").alias("feature_version"), (F.timestamp_seconds(F.unix_timestamp(c("o_orderdate").cast("timestamp")) + k)).cast("timestamp_ntz").alias("trained_at"), F.round(c("o_totalprice") / 600000, 4).alias("auc"), (k % 7 == 0).alias("is_policy"))


@query(f"WITH {RUNS}, v AS (SELECT *, max(auc) OVER k AS top, max(CASE WHEN is_policy THEN trained_at END) OVER k AS np FROM ru WHERE feature_version = '1' WINDOW k AS (PARTITION BY symbol, expiry_key)) SELECT model_name, symbol, expiry_key, feature_version, strftime(trained_at, '%Y-%m-%d %H:%M:%S') AS trained_at, auc, is_policy FROM v QUALIFY row_number() OVER (PARTITION BY symbol, expiry_key ORDER BY coalesce(is_policy AND trained_at = np AND auc >= top, false) DESC, auc DESC, trained_at DESC, model_name) = 1")
def model_best(spark, d):
    return models.best(runs(spark, d), "1")


@query(f"WITH {RUNS} SELECT symbol, expiry_key, strftime(max(trained_at), '%Y-%m-%d %H:%M:%S') AS last FROM ru GROUP BY symbol, expiry_key HAVING epoch(TIMESTAMP '2001-12-31') - epoch(max(trained_at)) >= 200000")
def model_retrain_due(spark, d):
    return models.retrain_due(runs(spark, d), F.lit("2001-12-31").cast("timestamp_ntz"), 200000)


@query(f"WITH {RUNS} SELECT model_name, symbol, strftime(trained_at, '%Y-%m-%d %H:%M:%S') AS trained_at, auc FROM ru WHERE expiry_key = 'F'")
def model_list(spark, d):
    return models.listed(runs(spark, d), expiry_key="F").select("model_name", "symbol", "trained_at", "auc")


@query(f"WITH {T}, {B} SELECT symbol, {SHOW_TS}, round(close, 6) AS close FROM b QUALIFY symbol NOT IN ('click', 'view') OR row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 100")
def model_retrain_rows(spark, d):
    rows = hourly(spark, d).select("symbol", "ts", "close")
    return models.retrain_rows(rows, rows.filter("symbol IN ('click', 'view')"), 100)


@query()
def model_scores(spark, d):
    x = ["RSI", "CCI", "RETURN_1", "BB_PERCENT_B"]
    bars_ = hourly(spark, d)
    known = features.recurrent(features.plain_windows(bars_)).select("symbol", "ts", *x).na.drop("any")
    rows = labels.labelled(known, labels.direction(bars_))
    path = tables.scratch(spark, "splits")
    labels.time_split(rows).write.parquet(path)  # the fit reads it again and again
    rows = spark.read.parquet(path)
    return models.probability(models.forest(rows, x), rows.filter("split = 'test'")).select("symbol", "ts", "label", "p")


# A stored ensemble: (feature, threshold, left, right, value) of every node of three trees over these columns.
TREE_COLUMNS = {"close": "close", "volume": "volume", "span": "high - low"}
TREES = [
    [(0, 10.0, 1, 2, None), (-1, None, -1, -1, 0.62), (1, 2.0, 3, 4, None), (-1, None, -1, -1, 0.41), (-1, None, -1, -1, 0.55)],
    [(1, 1.0, 1, 2, None), (0, 7.5, 3, 4, None), (-1, None, -1, -1, 0.48), (-1, None, -1, -1, 0.7), (-1, None, -1, -1, 0.52)],
    [(2, 12.0, 1, 2, None), (2, 3.0, 3, 4, None), (0, 20.0, 5, 6, None), (-1, None, -1, -1, 0.5), (-1, None, -1, -1, 0.57), (-1, None, -1, -1, 0.6), (-1, None, -1, -1, 0.33)],
]


def stored_trees(spark: SparkSession) -> ensembles.Ensemble:
    rows = [(t, i, f, thr, left, right, v, None, None) for t, nodes in enumerate(TREES) for i, (f, thr, left, right, v) in enumerate(nodes)]
    return ensembles.Ensemble.read(spark.createDataFrame(rows, ensembles.NODES), list(TREE_COLUMNS), False)


def tree_case(nodes: list[tuple], at: int = 0) -> str:
    f, thr, left, right, v = nodes[at]
    return str(v) if f < 0 else f"CASE WHEN {list(TREE_COLUMNS)[f]} <= {thr} THEN {tree_case(nodes, left)} ELSE {tree_case(nodes, right)} END"


def tree_splits(nodes: list[tuple], at: int = 0, where: str = "true") -> list[tuple[str, str, str]]:
    """(column, condition of the node, condition of its left child) of every split."""
    f, thr, left, right, _ = nodes[at]
    if f < 0:
        return []
    low = f"{list(TREE_COLUMNS)[f]} <= {thr}"
    return [(list(TREE_COLUMNS)[f], where, f"{where} AND {low}"), *tree_splits(nodes, left, f"{where} AND {low}"), *tree_splits(nodes, right, f"{where} AND NOT {low}")]


TREE_ROWS = f"{T}, {B}, {LABEL}, f AS (SELECT b.symbol, b.ts, {', '.join(f'b.{x} AS {n}' if x == n else f'b.high - b.low AS {n}' for n, x in TREE_COLUMNS.items())}, lb.label FROM b JOIN lb ON b.symbol = lb.symbol AND b.ts = lb.ts)"


def tree_rows(spark, d):
    rows = hourly(spark, d)
    return labels.direction(rows, "5_MIN").select("symbol", "ts", "label", *(F.expr(x).alias(n) for n, x in TREE_COLUMNS.items()))


@query(f"WITH {TREE_ROWS} SELECT symbol, {SHOW_TS}, round(({' + '.join(map(tree_case, TREES))}) / 3, 6) AS p FROM f")
def model_tree_scores(spark, d):
    """A stored ensemble over all bars."""
    return models.probability(stored_trees(spark), tree_rows(spark, d)).select("symbol", "ts", "p")


IMPURE = "2.0 * sum(label) FILTER (WHERE {0}) * (count(*) FILTER (WHERE {0}) - sum(label) FILTER (WHERE {0})) / count(*) FILTER (WHERE {0})"


def split_gain(tree: int, column: str, node: str, left: str) -> str:
    one = lambda where: f"coalesce({IMPURE.format(where)}, 0)"
    return f"SELECT {tree} AS tree, '{column}' AS feature, {one(node)} - {one(left)} - {one(f'({node}) AND NOT ({left})')} AS g FROM f WHERE label IS NOT NULL"


@query(f"WITH {TREE_ROWS}, g AS ({' UNION ALL '.join(split_gain(t, *x) for t, nodes in enumerate(TREES) for x in tree_splits(nodes))}), s AS (SELECT feature, sum(g / t) AS w FROM (SELECT *, sum(g) OVER (PARTITION BY tree) AS t FROM g) GROUP BY feature), w AS (SELECT feature, w / sum(w) OVER () AS weight FROM s) SELECT row_number() OVER (ORDER BY weight DESC, feature) AS rank, feature, round(weight, 6) AS weight FROM w")
def model_importance(spark, d):
    """What the splits of a stored ensemble gain on all labelled bars."""
    return models.importance(stored_trees(spark).measured(tree_rows(spark, d).filter("label IS NOT NULL")), list(TREE_COLUMNS))


@query()
def model_boosted_rounds(spark, d):
    """The area under the curve after every round of one fit."""
    x = list(TREE_COLUMNS)
    path = tables.scratch(spark, "splits")
    labels.time_split(tree_rows(spark, d).filter("label IS NOT NULL")).write.parquet(path)
    rows = spark.read.parquet(path)
    return models.round_areas(models.boosted(rows, x, rounds=10), rows.filter("split = 'val'"))


AREA = "SELECT a.block, avg(CASE WHEN a.{0} > b.{0} THEN 1.0 WHEN a.{0} = b.{0} THEN 0.5 ELSE 0 END) AS area FROM o AS a JOIN o AS b ON a.block = b.block AND a.label = 1 AND b.label = 0 GROUP BY a.block"


@query(f"WITH {T}, {B}, {LABEL}, l AS (SELECT symbol, ts, label, hour(ts) AS hour, epoch_us(ts) AS u FROM lb WHERE label IS NOT NULL), q AS (SELECT *, CAST(least(floor((u - (SELECT min(u) FROM l)) * 4.0 / ((SELECT max(u) - min(u) FROM l))), 3) AS BIGINT) AS block FROM l), k AS (SELECT DISTINCT block, symbol, hour FROM q), p AS (SELECT k.*, (SELECT (sum(q.label) + 1.0) / (count(*) + 2) FROM q WHERE q.block < k.block AND q.symbol = k.symbol) AS s, (SELECT (sum(q.label) + 1.0) / (count(*) + 2) FROM q WHERE q.block < k.block AND q.hour = k.hour) AS h FROM k WHERE block > 0), o AS (SELECT q.block, q.label, coalesce(p.s, 0.5) AS by_symbol, coalesce(p.h, 0.5) AS by_hour FROM q JOIN p ON p.block = q.block AND p.symbol = q.symbol AND p.hour = q.hour), n AS (SELECT block, count(*) AS n, round(avg(by_symbol), 6) AS mean_symbol, round(avg(by_hour), 6) AS mean_hour FROM o GROUP BY block), x AS ({AREA.format('by_symbol')}), y AS ({AREA.format('by_hour')}) SELECT n.block, n.n, mean_symbol, mean_hour, round(x.area, 6) AS auc_symbol, round(y.area, 6) AS auc_hour FROM n JOIN x ON n.block = x.block JOIN y ON n.block = y.block")
def model_out_of_fold(spark, d):
    """Two learners over four blocks of time, each block scored by what was fitted before it."""
    rows = labels.direction(hourly(spark, d), "5_MIN").filter("label IS NOT NULL").select("symbol", "ts", "label", F.hour("ts").alias("hour"))
    out = models.out_of_fold(rows, {"by_symbol": models.frequency("symbol"), "by_hour": models.frequency("hour")})
    found = out.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.avg("by_symbol").alias("mean_symbol"), F.avg("by_hour").alias("mean_hour"))
    for name in ("symbol", "hour"):
        found = found.join(models.metrics(out.withColumnRenamed(f"by_{name}", "p"), key="block").select("block", c("auc").alias(f"auc_{name}")), "block")
    return found


# ---- signals and ledger -----------------------------------------------------------------------

@query("SELECT event_id, CASE WHEN p >= 0.6 THEN 'CALL' WHEN p <= 0.4 THEN 'PUT' ELSE 'SKIP' END AS direction, round(CASE WHEN p <= 0.4 THEN 1 - p ELSE p END, 6) AS confidence FROM (SELECT event_id, CAST(event_id % 100 AS DOUBLE) / 100 AS p FROM events)")
def signal_decide(spark, d):
    direction, confidence = signals.decide((c("event_id") % 100).cast("double") / 100, 0.6)
    return table(spark, d, "events").select("event_id", direction.alias("direction"), confidence.alias("confidence"))


@query("WITH RECURSIVE k AS (SELECT event_type AS symbol, min(ts) AS ts FROM events GROUP BY event_type UNION ALL SELECT k.symbol, (SELECT min(e.ts) FROM events AS e WHERE e.event_type = k.symbol AND e.ts >= k.ts + INTERVAL 3000 SECOND) AS ts FROM k WHERE k.ts IS NOT NULL) SELECT symbol, count(ts) AS kept, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM k GROUP BY symbol")
def signal_cooldown(spark, d):
    return signals.cooldown(ticks(spark, d), 3000).groupBy("symbol").agg(F.count(F.lit(1)).alias("kept"), F.max("ts").alias("last_ts"))


STREAK = f"s0 AS (SELECT *, sum(CASE WHEN outcome = 'win' THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts, seq) AS w FROM r), s1 AS (SELECT *, sum(CASE WHEN outcome = 'loss' THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, w ORDER BY ts, seq) AS streak FROM s0)"


@query(f"WITH {R}, {STREAK} SELECT symbol, seq, CAST(streak AS BIGINT) AS streak, round(least(CAST(0.6 AS DOUBLE) + streak * CAST(0.05 AS DOUBLE), CAST(0.999 AS DOUBLE)), 6) AS threshold, streak >= 5 AS halted FROM s1")
def signal_streaks(spark, d):
    return signals.streaks(results(spark, d)).select("symbol", "seq", "streak", "threshold", "halted")


@query(f"WITH {R}, {STREAK} SELECT symbol, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS halted_at FROM s1 WHERE streak >= 5 GROUP BY symbol")
def signal_first_halt(spark, d):
    return signals.first_halt(signals.streaks(results(spark, d)))


DAY = "OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts, seq)"


@query(f"WITH {R}, k AS (SELECT *, sum(CASE outcome WHEN 'win' THEN 1 ELSE 0 END) {DAY} AS day_wins, sum(CASE outcome WHEN 'win' THEN payout WHEN 'loss' THEN -stake ELSE 0 END) {DAY} AS day_net FROM r) SELECT symbol, seq, CAST(day_wins AS BIGINT) AS day_wins, round(day_net, 6) AS day_net, day_wins >= 2 AS reached, coalesce(max(CASE WHEN day_wins >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS blocked FROM k")
def signal_daily_target(spark, d):
    return signals.daily_target(results(spark, d), wins=2).select("symbol", "seq", "day_wins", "day_net", "reached", "blocked")


@query(f"WITH {R}, k AS (SELECT *, coalesce(sum(CASE WHEN outcome <> 'loss' THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM r) SELECT symbol, seq, 2.0 * pow(2.0, coalesce(sum(CASE WHEN outcome = 'loss' THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, e ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 3) AS next_stake FROM k")
def signal_stake_ladder(spark, d):
    return signals.stake_ladder(results(spark, d), 2.0, 3).select("symbol", "seq", "next_stake")


SUMMARY = "su AS (SELECT symbol, CAST(ts AS DATE) AS day, count(*) FILTER (WHERE outcome = 'win') AS wins, count(*) FILTER (WHERE outcome = 'loss') AS losses, count(*) FILTER (WHERE outcome = 'draw') AS draws, sum(CASE outcome WHEN 'win' THEN payout WHEN 'loss' THEN -stake ELSE 0 END) AS net FROM r GROUP BY symbol, CAST(ts AS DATE))"


@query(f"WITH {R}, {SUMMARY}, {STREAK}, z AS (SELECT symbol, CAST(ts AS DATE) AS day, last(streak ORDER BY ts, seq) AS streak FROM s1 GROUP BY symbol, CAST(ts AS DATE)) SELECT su.symbol, strftime(su.day, '%Y-%m-%d') AS day, wins, losses, draws, round(net, 6) AS net, round(wins / greatest(wins + losses, 1) * 100, 1) AS win_rate, CAST(streak AS BIGINT) AS streak, round(least(CAST(0.6 AS DOUBLE) + streak * CAST(0.05 AS DOUBLE), CAST(0.999 AS DOUBLE)), 6) AS threshold, CAST(0 AS DOUBLE) AS minutes, CASE WHEN wins >= 2 THEN 'TARGET REACHED' WHEN su.day >= DATE '1998-01-01' THEN 'ACTIVE' ELSE 'CLOSED' END AS status FROM su JOIN z ON su.symbol = z.symbol AND su.day = z.day")
def ledger_session_report(spark, d):
    return signals.session_report(results(spark, d), target=2, now=F.lit("1998-01-01"))


@query(f"WITH {R} SELECT symbol, seq, round(CASE outcome WHEN 'win' THEN payout WHEN 'loss' THEN -stake ELSE 0 END, 6) AS result FROM r WHERE open_price <> 0 AND close_price <> 0")
def ledger_trade_entries(spark, d):
    return signals.trade_entries(results(spark, d)).select("symbol", "seq", "result")


@query(f"WITH {R}, q AS (SELECT seq, ts, symbol, CASE outcome WHEN 'win' THEN payout WHEN 'loss' THEN -stake ELSE 0 END AS result FROM r WHERE close_price <> 0 ORDER BY ts DESC, seq DESC LIMIT 10) SELECT seq, symbol, CASE WHEN result > 0 THEN 'win' WHEN result < 0 THEN 'loss' ELSE 'draw' END AS outcome FROM q")
def ledger_recent_trades(spark, d):
    return signals.recent(signals.trade_entries(results(spark, d)).drop("outcome")).select("seq", "symbol", "outcome")


EVENT = "CASE o_orderpriority WHEN '1-URGENT' THEN 'result' WHEN '2-HIGH' THEN 'signal' WHEN '3-MEDIUM' THEN 'skip' WHEN '5-LOW' THEN 'kill_switch' ELSE event_type || '_signal' END"


@query(f"WITH k AS (SELECT o_orderkey AS seq, o_orderdate AS ts, {EVENT} AS event, CASE o_orderstatus WHEN 'F' THEN 'win' WHEN 'O' THEN 'loss' ELSE 'draw' END AS outcome FROM (SELECT orders.*, 'window' AS event_type FROM orders)) SELECT seq, event, CASE WHEN event = 'result' THEN CASE WHEN outcome IN ('win', 'loss') THEN outcome ELSE 'info' END WHEN event = 'signal' THEN 'signal' WHEN event = 'kill_switch' THEN 'kill' ELSE 'info' END AS class FROM k ORDER BY ts DESC, seq DESC LIMIT 100")
def ledger_recent_events(spark, d):
    return signals.recent_events(order_events(spark, d)).select("seq", "event", "class")


def order_events(spark, d):
    """Orders as a log of events; every class occurs."""
    names = {"1-URGENT": "result", "2-HIGH": "signal", "3-MEDIUM": "skip", "5-LOW": "kill_switch"}
    event = F.coalesce(*(F.when(c("o_orderpriority") == k, v) for k, v in names.items()), F.lit("window_signal"))
    outcome = F.when(c("o_orderstatus") == "F", "win").when(c("o_orderstatus") == "O", "loss").otherwise("draw")
    return table(spark, d, "orders").select(c("o_orderdate").alias("ts"), c("o_orderkey").alias("seq"), event.alias("event"), outcome.alias("outcome"))


@query(f"WITH k AS (SELECT {EVENT} AS event, CASE o_orderstatus WHEN 'F' THEN 'win' WHEN 'O' THEN 'loss' ELSE 'draw' END AS outcome FROM (SELECT orders.*, 'window' AS event_type FROM orders)) SELECT event, outcome, CASE WHEN event = 'result' THEN CASE WHEN outcome IN ('win', 'loss') THEN outcome ELSE 'info' END WHEN event = 'signal' THEN 'signal' WHEN event = 'kill_switch' THEN 'kill' ELSE 'info' END AS class, count(*) AS n FROM k GROUP BY ALL")
def ledger_event_classes(spark, d):
    rows = order_events(spark, d).withColumn("class", signals.activity(c("event"), c("outcome")))
    return rows.groupBy("event", "outcome", "class").agg(F.count(F.lit(1)).alias("n"))


@query("WITH k AS (SELECT c_mktsegment AS symbol, c_custkey, c_acctbal - lag(c_acctbal) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS delta FROM customer) SELECT symbol, c_custkey AS ts, round(delta, 6) AS delta, CASE WHEN delta > 0 THEN 'win' ELSE 'loss' END AS guess FROM k WHERE abs(delta) > 0.001")
def ledger_balance_changes(spark, d):
    rows = table(spark, d, "customer").select(c("c_mktsegment").alias("symbol"), c("c_custkey").alias("ts"), c("c_acctbal").alias("balance"))
    return signals.balance_changes(rows).select("symbol", "ts", "delta", "guess")


PAIRS = "sg AS (SELECT event_id AS signal_id, ts, user_id AS pair FROM events WHERE event_type = 'click'), tr AS (SELECT event_id AS trade_id, ts, user_id AS pair FROM events WHERE event_type = 'purchase')"


@query(f"WITH {PAIRS}, m AS (SELECT signal_id, trade_id, abs(epoch(sg.ts) - epoch(tr.ts)) AS delta FROM sg JOIN tr ON sg.pair = tr.pair AND abs(epoch(sg.ts) - epoch(tr.ts)) < 1800), k AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY delta, trade_id) = 1) SELECT sg.signal_id, k.trade_id, round(k.delta, 3) AS delta FROM sg LEFT JOIN k ON sg.signal_id = k.signal_id")
def match_nearest(spark, d):
    e = table(spark, d, "events")
    rows = lambda kind, name: e.filter(c("event_type") == kind).select(c("event_id").alias(name), "ts", c("user_id").alias("pair"), F.lit("call").alias("direction"))
    out = signals.match(rows("click", "signal_id"), rows("purchase", "trade_id"), 1800.0)
    return out.select("signal_id", "trade_id", F.round("delta", 3).alias("delta"))


DAY_OF_USER = "user_id || ' ' || CAST(CAST(ts AS DATE) AS VARCHAR)"


@query(f"SELECT event_id AS signal_id FROM events WHERE event_type = 'click' AND {DAY_OF_USER} NOT IN (SELECT {DAY_OF_USER} FROM events WHERE event_type = 'purchase')")
def match_unresolved(spark, d):
    """Clicks without a purchase of the same user on the same day."""
    e = table(spark, d, "events").withColumn("key", F.concat_ws(" ", "user_id", F.to_date("ts")))
    mine = e.filter("event_type = 'click'").select(c("key").alias("signal_id"), "event_id")
    done = e.filter("event_type = 'purchase'").select(c("key").alias("signal_id"))
    return signals.unresolved(mine, done).select(c("event_id").alias("signal_id"))


@query("SELECT l_orderkey AS ticket, l_linenumber AS line, CASE WHEN o_orderkey IS NULL THEN 'OperationID Not Found.' WHEN o_totalprice - 200000 > 0 THEN 'win' ELSE 'loss' END AS status, count(*) AS n FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem) LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey GROUP BY ALL")
def match_tickets(spark, d):
    lines = table(spark, d, "lineitem").select(c("l_orderkey").alias("ticket"), c("l_linenumber").alias("line"))
    ops = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(c("o_orderkey").alias("ticket"), (c("o_totalprice") - 200000).alias("profit"))
    return signals.lookup(lines, ops).groupBy("ticket", "line", "status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name AS pair, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def match_assets(spark, d):
    names = table(spark, d, "nation")
    both = names.select(F.concat(F.lit(" "), F.lower("n_name"), F.lit("_otc\n")).alias("asset"), c("n_name").alias("pair"))
    trades = table(spark, d, "customer").join(names, c("c_nationkey") == c("n_nationkey")).select(F.concat("n_name", F.lit("_otc ")).alias("asset"))
    return signals.to_pairs(trades, both).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, attempt, strftime(date_trunc('second', ts) + to_seconds(60 + 5 + 15 * attempt), '%Y-%m-%d %H:%M:%S') AS due FROM events, (VALUES (0), (1), (2)) AS a(attempt) WHERE event_type = 'click'")
def signal_schedule(spark, d):
    rows = table(spark, d, "events").filter("event_type = 'click'").select("event_id", "ts")
    return signals.result_schedule(rows).select("event_id", "attempt", "due")


@query("SELECT o_orderkey AS signal_id, upper(o_orderpriority) AS symbol, CASE WHEN o_orderstatus = 'F' THEN 'buy' ELSE 'sell' END AS action, CAST(1 AS DOUBLE) AS amount, round(o_totalprice / 1048576, 6) AS confidence FROM orders WHERE o_orderstatus <> 'P'")
def signal_orders(spark, d):
    o = table(spark, d, "orders").select(c("o_orderkey").alias("signal_id"), c("o_orderpriority").alias("symbol"), F.when(c("o_orderstatus") == "F", "CALL").when(c("o_orderstatus") == "O", "PUT").otherwise("SKIP").alias("direction"), (c("o_totalprice") / 1048576).alias("confidence"))
    names = o.select("symbol", F.upper("symbol").alias("target")).distinct()
    return signals.orders(o, names)


# ---- scalar functions and payloads ------------------------------------------------------------

SEC = "CAST(floor(epoch(ts)) AS BIGINT)"
MID = "(s - s % 86400)"


@query(f"WITH k AS (SELECT event_id, {SEC} AS s FROM events) SELECT event_id, s - s % 60 + 60 + CASE WHEN s % 60 >= 30 THEN 60 ELSE 0 END AS expiry_30, {MID} + ((s % 86400) // 300 + CASE WHEN (s % 86400) % 300 > 150 THEN 2 ELSE 1 END) * 300 AS expiry_300, strftime(to_timestamp((s - s % 3600 + ((s % 3600) // 300 + 2) * 300) // 60 * 60) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') AS next_300, s - 432000 AS ago_5, floor(s / 7.0 * 1000) / 1000 AS cut FROM k")
def time_expiries(spark, d):
    s = F.unix_timestamp(c("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", timefn.expiration(s, 30).alias("expiry_30"), timefn.expiration(s, 300).alias("expiry_300"), timefn.next_timeframe(s, 300).alias("next_300"), timefn.days_ago(s, 5).alias("ago_5"), timefn.truncated(s / 7, 3).alias("cut"))


@query(f"WITH k AS (SELECT event_id, {SEC} AS s FROM events), m AS (SELECT *, s - s % 60 AS m FROM k), a AS (SELECT event_id, i + 1 AS minutes, m + CASE WHEN m + 60 - s > 30 THEN 60 ELSE 120 END + 60 * i AS expiry FROM m, range(5) AS r(i)), q AS (SELECT event_id, s, (m + 899) // 900 * 900 AS q FROM m), b AS (SELECT event_id, 15 * (i + 1) AS minutes, q + CASE WHEN q - s > 300 THEN 0 ELSE 900 END + 900 * i AS expiry FROM q, range(11) AS r(i)) SELECT event_id, CAST(minutes AS BIGINT) AS minutes, CAST(expiry AS BIGINT) AS expiry FROM a UNION ALL SELECT event_id, CAST(minutes AS BIGINT), CAST(expiry AS BIGINT) FROM b")
def time_selectable(spark, d):
    s = F.unix_timestamp(c("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", F.inline(timefn.selectable_expiries(s)))


@query("SELECT o_orderkey, CASE WHEN d > 0 THEN 'win' WHEN d < 0 THEN 'loss' ELSE 'draw' END AS by_profit, CASE WHEN o_orderstatus = 'F' AND d > 0 OR o_orderstatus <> 'F' AND d < 0 THEN 'win' ELSE 'loss' END AS by_price, round(d * 0.85, 6) AS profit, round(greatest(o_totalprice * 2 / 100, 1.0), 6) AS stake, CASE o_orderstatus WHEN 'F' THEN 'call' WHEN 'O' THEN 'put' END AS side, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority || '_otc' ELSE o_orderpriority END AS toggled FROM (SELECT *, round(o_totalprice - 200000, 2) AS d FROM orders)")
def scalar_outcomes(spark, d):
    delta = F.round(c("o_totalprice") - 200000, 2)
    name = F.when(c("o_orderkey") % 2 == 0, c("o_orderpriority")).otherwise(F.concat("o_orderpriority", F.lit("_otc")))
    word = F.when(c("o_orderstatus") == "F", "up").when(c("o_orderstatus") == "O", " PUT ")
    way = F.when(c("o_orderstatus") == "F", "call").otherwise("put")
    return table(spark, d, "orders").select("o_orderkey", signals.outcome_of_profit(delta).alias("by_profit"), signals.outcome_of_prices(way, F.lit(0), delta).alias("by_price"), signals.profit(F.lit(85.0), delta).alias("profit"), signals.stake(c("o_totalprice"), 2).alias("stake"), signals.side(F.lit(None).cast("string"), word).alias("side"), signals.toggled(name).alias("toggled"))


@query("SELECT event_type AS symbol, count(*) AS n, round(sum(value), 4) AS total, CAST(sum(event_id % 2) AS BIGINT) AS up FROM events WHERE event_id % 3 = 0 GROUP BY event_type")
def payload_ticks(spark, d):
    e = table(spark, d, "events")
    tick = F.format_string('[["%s",%d,%s,%d]]', "event_type", "event_id", c("value").cast("string"), c("event_id") % 2)
    raw = F.when(c("event_id") % 3 == 0, tick).when(c("event_id") % 3 == 1, F.format_string('[["%s",%d]]', "event_type", c("event_id") % 100)).otherwise(c("props"))
    rows = payloads.ticks(e.select(raw.alias("raw")))
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 4).alias("total"), F.sum("direction").alias("up"))


@query("SELECT event_type AS asset, CAST(sum(event_id % 100) AS BIGINT) AS buy, CAST(sum(100 - event_id % 100) AS BIGINT) AS sell FROM events GROUP BY event_type")
def payload_sentiment(spark, d):
    raw = F.format_string('[["%s",%d]]', "event_type", c("event_id") % 100)
    return payloads.sentiments(table(spark, d, "events").select(raw.alias("raw"))).groupBy("asset").agg(F.sum("buy").alias("buy"), F.sum("sell").alias("sell"))


@query("SELECT CASE event_id % 4 WHEN 0 THEN 'other' WHEN 1 THEN 'balance' WHEN 2 THEN 'deals' ELSE 'history' END AS kind, count(*) AS n FROM events GROUP BY ALL")
def payload_kinds(spark, d):
    e = table(spark, d, "events")
    k, n = c("event_id") % 4, c("event_id")
    raw = F.when(k == 0, c("props")).when(k == 1, F.format_string('{"demoBalance": %d}', n)).when(k == 2, F.format_string('{"deals": [{"id": "%d", "profit": 1.5}]}', n)).otherwise(F.format_string('{"asset": "a", "candles": [[%d, 1, 2, 3, 0.5, 7]]}', n))
    return e.select(payloads.kind(raw).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name AS asset, CAST(c_custkey AS BIGINT) AS id, CAST(80 AS DOUBLE) AS payment, c_custkey % 2 = 0 AS open, CAST(c_custkey % 90 AS DOUBLE) AS profit_1m, CAST(c_custkey % 80 AS DOUBLE) AS profit_5m FROM customer JOIN nation ON c_nationkey = n_nationkey")
def payload_instruments(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), c("c_nationkey") == c("n_nationkey"))
    k = c("c_custkey")
    cells = [k.cast("string"), F.concat("n_name", F.lit("\\n")), F.lit("x"), F.lit("y"), F.lit("z"), F.lit("80"), *([F.lit("0")] * 8), F.when(k % 2 == 0, "true").otherwise("false"), *([F.lit("0")] * 3), F.lit("85"), F.lit("9"), (k % 90).cast("string"), (k % 80).cast("string"), *([F.lit("0")] * 7)]
    raw = F.concat(F.lit('[["'), F.array_join(F.array(*cells), '","'), F.lit('"]]'))
    return payloads.instruments(rows.select(raw.alias("raw"))).select("asset", "id", "payment", "open", "profit_1m", "profit_5m")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """All feature columns of the hourly bars of every event type; rows before the warm part hold nulls."""
    return features.transform(hourly(spark, d), 3600).select("symbol", "ts", *features.COLUMNS, F.lit(features.VERSION).alias("feature_version"))
