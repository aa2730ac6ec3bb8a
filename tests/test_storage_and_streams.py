"""Round trips of stored tables; streams against the same rows in batch."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from marketframe.operators import bars
from marketframe.sources import payloads, tables
from marketframe.streaming import streams

T0 = dt.datetime(2024, 3, 4)
BARS = tables.BARS + ", seq bigint, is_complete boolean"


def bar(i, close, seq, complete=True, symbol="A"):
    return (symbol, "M1", T0 + dt.timedelta(minutes=i), 1.0, 2.0, 0.5, close, 1.0, seq, complete)


def test_upsert_round_trip(spark, tmp_path):
    path = str(tmp_path / "bars")
    assert tables.scan_bars(spark, path).count() == 0
    tables.write_bars(spark, path, spark.createDataFrame([bar(0, 1.0, 0), bar(1, 1.1, 0), bar(2, 9.9, 0, False), bar(0, 5.0, 0, symbol="B")], BARS), seq="seq")
    tables.write_bars(spark, path, spark.createDataFrame([bar(1, 1.2, 1), bar(1, 1.3, 2), bar(3, 1.4, 1)], BARS), seq="seq")
    got = [(r.symbol, r.ts.minute, r.close) for r in tables.scan_bars(spark, path).orderBy("symbol", "ts").collect()]
    assert got == [("A", 0, 1.0), ("A", 1, 1.3), ("A", 3, 1.4), ("B", 0, 5.0)]
    assert [r.ts.minute for r in tables.scan_bars(spark, path, ["A"], max_rows=1).collect()] == [3]
    with pytest.raises(tables.SchemaMismatch):
        tables.check_version(spark.read.parquet(path), "2")
    with pytest.raises(tables.SchemaMismatch):
        tables.check_version(spark.range(1).toDF("x"))


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for i in range(3):
        tables.append(path, spark.createDataFrame([(T0, i)], "ts timestamp_ntz, seq bigint"))
    assert [r.seq for r in tables.tail(spark.read.parquet(path), 2).collect()] == [1, 2]
    assert tables.tail(spark.read.parquet(path), 0).count() == 3


def test_leap_day_start(spark):
    symbols = spark.createDataFrame([("A",)], "symbol string")
    none = spark.createDataFrame([], "symbol string, ts timestamp_ntz")
    now = F.lit("2024-02-29 10:00:00").cast("timestamp_ntz")
    assert tables.load_start(symbols, none, now, 1).first()["start"] == dt.datetime(2023, 2, 28)


def test_open_asset_fallback(spark):
    table = spark.createDataFrame([("EURUSD", False), ("EURUSD_otc", True), ("GBPUSD", True), ("X", False)], "asset string, open boolean")
    wanted = spark.createDataFrame([("EURUSD",), ("GBPUSD",), ("X",)], "asset string")
    assert {r.asset: r.use for r in payloads.available(wanted, table).collect()} == {"EURUSD": "EURUSD_otc", "GBPUSD": "GBPUSD", "X": None}


def staged(spark, df, path, parts):
    """Files whose times follow the order of `parts`."""
    os.makedirs(path)
    for i, part in enumerate(parts):
        df.filter(part).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)


def test_bars_of_stream_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.col("event_id").alias("seq"))
    src = str(tmp_path / "src")
    staged(spark, events, src, [f"seq >= {a} AND seq < {a + 250}" for a in range(0, 1000, 250)])
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = streams.ledger_sink(streams.bars(stream, 3600), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.ticks) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    last = events.agg(F.max("ts")).first()[0]
    batch = bars.from_ticks(events.withColumn("ts", F.col("ts").cast("timestamp_ntz")), 3600).collect()
    want = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.ticks) for r in batch if r.ts + dt.timedelta(minutes=70) <= last.replace(tzinfo=None)}
    assert got == want
    q = streams.ledger_sink(streams.bars(stream, 3600), str(tmp_path / "out"), str(tmp_path / "cp"))  # nothing new after a restart
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(want)


def test_upsert_stream(spark, tmp_path):
    df = spark.createDataFrame([bar(0, 1.0, 0), bar(1, 1.1, 0), bar(1, 1.2, 1)], BARS)
    src = str(tmp_path / "src")
    staged(spark, df, src, ["seq = 0", "seq = 1"])
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    streams.upsert_sink(stream, str(tmp_path / "bars"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.ts.minute, r.close) for r in tables.scan_bars(spark, str(tmp_path / "bars")).collect()) == [(0, 1.0), (1, 1.2)]


def test_gate(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [("A", at(0), 0, 0.7, None, 0.0), ("A", at(40), 1, 0.9, None, 0.0), ("A", at(90), 2, None, "loss", -1.0), ("A", at(100), 3, 0.62, None, 0.0), ("A", at(200), 4, 0.7, None, 0.0), ("B", at(5), 0, 0.5, None, 0.0)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, seq bigint, confidence double, outcome string, amount double")
    src = str(tmp_path / "src")
    staged(spark, df, src, ["seq < 3", "seq >= 3"])
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    streams.ledger_sink(streams.gated(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.symbol, r.seq): r.fired for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("A", 0): True, ("A", 1): False, ("A", 3): False, ("A", 4): True, ("B", 0): False}  # the day isn't over


def test_upserts_read_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "bars")
    many = spark.range(3000).selectExpr("concat('S', id % 6) AS symbol", "'M1' AS timeframe", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, int(id DIV 6) % 90) AS ts", *(f"double(id) AS {x}" for x in ("open", "high", "low", "close", "volume")))
    tables.write_bars(spark, path, many.dropDuplicates(["symbol", "ts"]))
    before = {f: os.path.getmtime(f"{path}/{f}") for f in files(path)}
    tables.write_bars(spark, path, spark.createDataFrame([bar(0, 7.0, 0, symbol="S1")], BARS))
    after = {f: os.path.getmtime(f"{path}/{f}") for f in files(path)}
    changed = {f.rsplit("/", 1)[0] for f in before.keys() ^ after.keys()} | {f.rsplit("/", 1)[0] for f in before.keys() & after.keys() if before[f] != after[f]}
    assert {c for c in changed if c.startswith("symbol=")} == {"symbol=S1/timeframe=M1/month=2024-03"}
    # the partitions that are read are those of each symbol's own newest months
    tables.write_bars(spark, path, spark.createDataFrame([bar(60 * 24 * 40, 1.0, 0, symbol="S2")], BARS))
    newest = tables.scan_bars(spark, path, ["S1", "S2"], max_rows=1)
    assert sorted((r.symbol, r.ts.month) for r in newest.collect()) == [("S1", 3), ("S2", 4)]
    assert partitions_read(newest) == 2 and partitions_read(tables.scan_bars(spark, path, ["S1", "S2"])) == 7
    assert not [f for f in os.listdir(tmp_path) if "staged" in f]


def partitions_read(df):
    """How many partitions the executed plan's scan of bars has read."""
    df.collect()
    nodes, found = [df._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            nodes.append(node.plan())
        elif name.startswith("Scan parquet") and "close" in node.schema().fieldNames():
            found.append(node.metrics().apply("numPartitions").value())
        else:
            nodes += [node.children().apply(i) for i in range(node.children().length())]
    (n,) = found
    return n


def files(path):
    return [os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_other_versions_are_errors(spark, tmp_path):
    rows = spark.createDataFrame([bar(0, 1.0, 0)], BARS)
    for name, write in {
        "bars": lambda p: tables.write_bars(spark, p, rows),
        "ledger": lambda p: tables.append(p, rows),
        "features": lambda p: tables.write_features(p, rows.select("symbol", "ts", "close"), "1_MIN"),
    }.items():
        path = str(tmp_path / name)
        rows.withColumns({"month": F.lit("2024-03"), "expiry_key": F.lit("1_MIN")}).write.parquet(path)  # without a stamp
        with pytest.raises(tables.SchemaMismatch):
            write(path)
    with pytest.raises(tables.SchemaMismatch):
        tables.scan_bars(spark, str(tmp_path / "bars"))


def test_coverage(spark):
    have = spark.createDataFrame([("A", i) for i in range(250)] + [("B", i) for i in range(249)], "symbol string, ts int")
    found = tables.coverage(have, have.filter("ts > 100"), spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string"))
    assert sorted(map(tuple, found.collect())) == [("A", 250, 149, True), ("B", 249, 148, False), ("C", 0, 0, False)]
    with pytest.raises(ValueError, match="B .*C "):
        tables.require_coverage(found)
    tables.require_coverage(found.filter("ready"))


def test_tick_sink_loses_nothing(spark, tmp_path):
    df = spark.range(500).selectExpr("concat('S', id % 2) AS symbol", "id AS seq")
    src = str(tmp_path / "src")
    staged(spark, df, src, ["seq < 300", "seq >= 300"])
    for _ in range(2):  # a restart adds nothing
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
        streams.tick_sink(stream, str(tmp_path / "out"), str(tmp_path / "cp"), flush=5).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.seq for r in got.collect()) == list(range(500))
    assert got.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 50


def test_gate_begins_each_day_anew(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = lambda d, s: T0 + dt.timedelta(days=d, seconds=s)
    rows = [("A", at(0, i), i, None, "loss", -1.0) for i in range(5)] + [("A", at(0, 10), 5, 0.999, None, 0.0)]  # halted by the streak
    rows += [("B", at(0, i), i, None, "win", 1.0) for i in range(2)] + [("B", at(0, 10), 2, 0.99, None, 0.0)]  # the day's target is reached
    rows += [(s, at(1, 10), 9, 0.999, None, 0.0) for s in "AB"]  # a new day
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, seq bigint, confidence double, outcome string, amount double")
    src = str(tmp_path / "src")
    staged(spark, df, src, ["seq < 9", "seq = 9"])
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    streams.ledger_sink(streams.gated(stream, target=2), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.symbol, r.seq): (r.fired, r.streak) for r in rows if r.seq is not None} == {("A", 5): (False, 5), ("B", 2): (False, 0), ("A", 9): (True, 0), ("B", 9): (True, 0)}
    midnight = T0 + dt.timedelta(days=1)
    assert {(r.symbol, r.ts, r.streak, r.wins, r.net) for r in rows if r.seq is None} == {("A", midnight, 5, 0, -5.0), ("B", midnight, 0, 2, 2.0)}


def test_a_day_ends_without_a_row(spark, tmp_path):
    """B's day ends by timer: another symbol moves the watermark over midnight, and B has no row after it."""
    at = lambda d, s: T0 + dt.timedelta(days=d, seconds=s)
    rows = [("B", at(0, 5), 0, None, "win", 2.5), ("B", at(0, 9), 1, 0.9, None, 0.0), ("A", at(2, 0), 2, 0.9, None, 0.0)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, seq bigint, confidence double, outcome string, amount double")
    src = str(tmp_path / "src")
    staged(spark, df, src, ["seq < 2", "seq = 2"])
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    streams.ledger_sink(streams.gated(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.symbol, r.seq, r.ts, r.wins, r.net) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("B", 1, at(0, 9), 1, 2.5), ("A", 2, at(2, 0), 0, 0.0), ("B", None, at(1, 0), 1, 2.5)}


def test_join_gives_up_behind_the_watermark(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    sig = spark.createDataFrame([(0, at(0), "P", "call"), (1, at(100), "P", "call"), (2, at(900), "P", "call")], "signal_id int, ts timestamp, pair string, direction string")
    res = spark.createDataFrame([(7, at(20), "P", "call"), (8, at(110), "P", "put"), (9, at(900), "Q", "call")], "trade_id int, ts timestamp, pair string, direction string")
    for name, df, key in (("s", sig, "signal_id"), ("r", res, "trade_id")):
        ids = [r[0] for r in df.select(key).orderBy(key).collect()]
        staged(spark, df, str(tmp_path / name), [f"{key} = {i}" for i in ids])
    side = lambda name, df: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    joined = streams.signal_results(side("s", sig), side("r", res))
    streams.ledger_sink(joined, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.signal_id: r.trade_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: 7, 1: None}  # signal 2 may still get a result


def loop(spark, tmp_path, history, fail=()):
    """A subscription over the files of src; `fail` are batches whose sink stops after it has written."""
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    stream = spark.readStream.schema("symbol string, ts timestamp_ntz, close double").option("maxFilesPerTrigger", 1).parquet(src)

    def sink(rows, number):
        tables.append_batch(out, rows.select("symbol", "ts", "SMA"), number)
        if number in fail:
            raise RuntimeError("stopped behind the write")

    return streams.indicator_subscription(stream, history, "SMA", sink, str(tmp_path / "cp"), period=3)


def closes(spark):
    return spark.createDataFrame([(s, T0 + dt.timedelta(minutes=i), float(i) * k) for i in range(30) for s, k in (("A", 1), ("B", 10))], "symbol string, ts timestamp_ntz, close double")


def minute(n):
    return F.lit(T0 + dt.timedelta(minutes=n))


def test_live_loop_restarts_in_mid_batch(spark, tmp_path):
    """A batch that fails after its write is run again and stands once; history is read in the first batch only."""
    df = closes(spark)
    staged(spark, df, str(tmp_path / "src"), [(F.col("ts") >= minute(20)) & (F.col("ts") < minute(25)), (F.col("ts") >= minute(25)) & (F.col("ts") < minute(26)) & (F.col("symbol") == "A")])
    history = df.filter(F.col("ts") < minute(20))
    with pytest.raises(Exception, match="stopped behind the write"):
        loop(spark, tmp_path, lambda s: history, fail={1}).awaitTermination()
    untouchable = history.withColumn("close", F.raise_error(F.lit("history was read")).cast("double"))
    loop(spark, tmp_path, lambda s: untouchable).awaitTermination()
    df.filter((F.col("ts") >= minute(26)) | ((F.col("symbol") == "B") & (F.col("ts") == minute(25)))).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    loop(spark, tmp_path, lambda s: untouchable).awaitTermination()
    rows = tables.stored(spark, str(tmp_path / "out")).collect()
    got = {(r.symbol, r.ts): r.SMA for r in rows}
    assert len(rows) == len(got) == 20
    assert got == {(s, T0 + dt.timedelta(minutes=i)): (i - 1.0) * k for i in range(20, 30) for s, k in (("A", 1), ("B", 10))}


def test_tail_state_keeps_the_newest(spark, tmp_path):
    df = closes(spark)
    staged(spark, df, str(tmp_path / "src"), [F.col("ts") < minute(10), F.col("ts") == minute(10), F.col("ts") == minute(3)])
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
    seen = []
    each = lambda batch, n: seen.append([(r.symbol, r.ts.minute, r["__new"]) for r in batch.orderBy("symbol", "ts").collect()])
    streams._start(streams.with_tail(stream, df.limit(0), tail=4), each, str(tmp_path / "cp")).awaitTermination()
    seen = [s for s in seen if s]
    assert seen[0] == [(s, i, True) for s in "AB" for i in range(10)]
    assert seen[1] == [(s, i, i == 10) for s in "AB" for i in (6, 7, 8, 9, 10)]
    assert seen[2] == [(s, i, i == 3) for s in "AB" for i in (3, 7, 8, 9, 10)]  # late ones come with what is kept


def test_latest_is_whole_at_any_time(spark, tmp_path):
    path = str(tmp_path / "latest")
    assert tables.published(spark, path) is None
    rows = lambda n: spark.createDataFrame([("A", n), ("B", n)], "asset string, price int")
    tables.publish(path, rows(0))
    before = tables.published(spark, path)
    os.makedirs(f"{path}/v=1")  # a version that is being written
    assert {r.price for r in tables.published(spark, path).collect()} == {0}
    for n in (1, 2):
        tables.publish(path, rows(n))
    assert {r.price for r in before.collect()} == {0}  # a reader that began before goes on
    assert {r.price for r in tables.published(spark, path).collect()} == {2} and tables.versions(spark, path) == [2, 1, 0]
    tables.publish(path, rows(3))
    assert tables.versions(spark, path) == [3, 2, 1]


def test_latest_sink_upserts(spark, tmp_path):
    df = spark.createDataFrame([("A", T0, 0, 1.0), ("B", T0, 1, 2.0), ("A", T0 + dt.timedelta(minutes=1), 2, 3.0), ("C", T0, 3, 4.0), ("A", T0, 4, 9.0)], "asset string, ts timestamp_ntz, seq bigint, price double")
    staged(spark, df, str(tmp_path / "src"), ["seq < 2", "seq BETWEEN 2 AND 3", "seq = 4"])
    for _ in range(2):  # a restart changes nothing
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
        streams.latest_sink(streams.latest_by_asset(stream, "price"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert sorted((r.asset, r.price) for r in tables.published(spark, str(tmp_path / "out")).collect()) == [("A", 3.0), ("B", 2.0), ("C", 4.0)]


def test_upserts_of_many_symbols(spark, tmp_path):
    """Touched partitions are pruned by a join: nothing in the plan grows with their number."""
    path = str(tmp_path / "bars")
    many = lambda price, n: spark.range(n).selectExpr("concat('S', id) AS symbol", "'M1' AS timeframe", "timestamp_ntz'2024-03-04' AS ts", *(f"double({price}) AS {x}" for x in ("open", "high", "low", "close", "volume")))
    tables.write_bars(spark, path, many(1, 700))
    tables.write_bars(spark, path, many(2, 600))
    got = spark.read.parquet(path).groupBy("close").count().collect()
    assert {r["close"]: r["count"] for r in got} == {1.0: 100, 2.0: 600}
    touched = tables.only_partitions(tables.stored(spark, path), many(2, 5000).filter("symbol NOT LIKE 'S1%'").withColumn("month", F.lit("2024-03")), ("symbol", "timeframe", "month"))
    plan = touched._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and len(plan) < 20_000
    assert partitions_read(touched) == sum(not str(i).startswith("1") for i in range(700))


def test_messages_that_are_malformed(spark):
    raw = ["[]", "[[]]", "", None, "null", "no json", "{", '{"signals": []}', '{"signals": [["A"]]}', '{"signals": [["A", [], 5]]}', '[["A", "x", "y", 1]]', '[["A", 1, 2, "z"]]', '[["A", 5, 1.5, 1]]', '[["", 5, 1.5, 1]]', '[["A", 5, -1, 1]]',
           '[["B", "many"]]', '{"deals": [{"id": "q", "profit": "much"}, {}]}', '{"deals": 7}', '{"liveBalance": "none"}', '{"asset": "A", "candles": [[1, "x"], [], [2, 1, 1, 1, 1, 3, 9]]}', '{"asset": "A", "candles": 5}', '[[1, "short"]]', '[["x", "y", "z"]]']
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    kinds = {r.raw: r.kind for r in payloads.parsed(df).collect()}
    assert kinds["[]"] == kinds["[[]]"] == kinds[""] == kinds["no json"] == kinds["{"] == kinds["null"] == "other"
    good, bad = payloads.split_ticks(df)
    assert [tuple(r) for r in good.collect()] == [("A", 5.0, 1.5, 1), ("A", 1.0, 2.0, None)] or sorted(tuple(r) for r in good.select("symbol", "time").collect()) == [("A", 1.0), ("A", 5.0)]
    broken = {r.raw: list(r.violations) for r in bad.collect()}
    assert broken['[["A", "x", "y", 1]]'] == ["time", "price"] and broken['[["", 5, 1.5, 1]]'] == ["symbol"] and broken['[["A", 5, -1, 1]]'] == ["price"] and broken["[]"] == ["kind"] and broken[None] == ["kind"]
    assert {tuple(r) for r in payloads.sentiments(df).collect()} >= {("B", None, None)}
    assert {(r.id, r.profit, r.win) for r in payloads.deals(df).collect()} == {("q", None, None), (None, None, None)}
    assert [tuple(r) for r in payloads.balances(df).collect()] == [(None, None)]
    assert {(r.symbol, r.time, r.open, r.ticks) for r in payloads.candles(df).collect()} == {("A", 1, None, None), ("A", None, None, None), ("A", 2, 1.0, 3)}
    assert {(r.asset, r.time, r.direction) for r in payloads.signal_feed(df).collect()} == {("A", None, None), ("A", 5, None)}
    assert len(payloads.instruments(df.filter("raw IN ('[[1, \"short\"]]', '[]')")).collect()) == 1
