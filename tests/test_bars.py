"""Golden and edge cases of bars, recurrences, calendar and labels."""

import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketframe.functions import timefn
from marketframe.functions.recurrence import Ewm, ewm
from marketframe.operators import bars, calendar, features, indicators, labels, models, quality, signals

T0 = dt.datetime(2024, 3, 4)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def frame(spark, closes, step=60, symbol="A"):
    rows = [(symbol, at(i * step), x, x + 1.0, x - 1.0, x, 1.0) for i, x in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def test_golden_ticks(spark):
    prices = [1.0, 1.5, 0.5, 1.2, 2.0, 2.5, 1.5, 2.2, 2.0]
    ticks = spark.createDataFrame([("A", dt.datetime(1970, 1, 12, 13, 46, 40) + dt.timedelta(seconds=i), p, i) for i, p in enumerate(prices)], "symbol string, ts timestamp_ntz, price double, seq long")
    got = [(r.open, r.close, r.high, r.low, r.ticks) for r in bars.from_ticks(ticks, 4, drop_open=True).orderBy("ts").collect()]
    assert got == [(1.0, 1.2, 1.5, 0.5, 4), (2.0, 2.2, 2.5, 1.5, 4)]
    shuffled = bars.from_ticks(ticks.orderBy(F.rand(3)).repartition(3), 4, drop_open=True)
    assert [(r.open, r.close) for r in shuffled.orderBy("ts").collect()] == [(1.0, 1.2), (2.0, 2.2)]


def test_colour(spark):
    df = spark.createDataFrame([(1.1, 1.105), (1.105, 1.1), (1.0, 1.0)], "o double, c double")
    assert [r[0] for r in df.select(bars.colour(F.col("o"), F.col("c"))).collect()] == ["green", "red", "gray"]


def test_fill_of_five_and_six(spark):
    rows = [("A", at(60 * i), 1.0) for i in (0, 6, 13)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double")
    got = [r.close for r in bars.fill(bars.grid(df, 60, ["close"]), ["close"]).orderBy("ts").collect()]
    assert len(got) == 14 and got.count(None) == 1 and got[12] is None


@pytest.mark.parametrize("alpha,least", [(0.2, 5), (1 / 14, 14), (2 / 7, 1)])
def test_ewm_equals_pandas(spark, alpha, least):
    rng = random.Random(4)
    rows = []
    for s in "AB":
        for i in range(700):
            rows.append((s, at(60 * i), None if i < 3 or 200 <= i < 399 or rng.random() < 0.15 else rng.uniform(1, 2)))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double")
    results = []
    for batch in ("7", "10000"):  # state goes on from batch to batch
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = ewm(df, {"y": Ewm("x", alpha, least)}).toPandas().sort_values(["symbol", "ts"])
        for s, g in got.groupby("symbol"):
            x = pd.Series([r[2] for r in rows if r[0] == s], dtype=float)
            want = x.ewm(alpha=alpha, adjust=False, min_periods=least).mean()
            assert (g["y"].isna().to_numpy() == want.isna().to_numpy()).all()
            assert (g["y"].to_numpy() - want.to_numpy())[~want.isna().to_numpy()].__abs__().max() < 1e-12
        results.append(got["y"].fillna(-1).to_numpy())
    assert abs(results[0] - results[1]).max() < 1e-12


def test_flat_and_extremes(spark):
    flat = indicators.stochastic(frame(spark, [1.0] * 20).withColumn("high", F.col("close")).withColumn("low", F.col("close")))
    assert indicators.last_values(flat, ["K"]).first()["K"] == 100.0
    up = indicators.rsi(frame(spark, [float(i) for i in range(1, 40)]))
    assert indicators.last_values(up, ["RSI"]).first()["RSI"] > 99.9
    out = features.price_action(frame(spark, [1.0, 2.0]).withColumn("open", F.col("close") - 0.5)).collect()
    assert [r.CONSECUTIVE_BULL_BARS for r in out] == [1, 2]
    with pytest.raises(ValueError):
        indicators.indicator(flat, "nope")


def test_compat_switch(spark):
    rng = random.Random(1)
    df = frame(spark, [10 + rng.random() for _ in range(300)])
    new, old = (features.transform(df, 60, compat=c).orderBy("ts").collect() for c in (False, True))
    assert all(r.RSI_TREND_5T == 0 for r in old) and any(r.RSI_TREND_5T for r in new if r.RSI_TREND_5T is not None)
    assert len(features.matrix(df, 60).collect()) == 300 - 199
    # by default a bar sees finished buckets only
    changed = features.transform(df.withColumn("close", F.when(F.col("ts") >= F.lit(at(60 * 299)), 99.0).otherwise(F.col("close"))), 60).orderBy("ts").collect()
    assert changed[298].RSI_5T == new[298].RSI_5T and changed[299].RSI_5T == new[299].RSI_5T


def test_calendar(spark):
    days = calendar.holidays(spark, 2023, 2025)
    names = {r.date: r.name for r in days.collect()}
    assert names[dt.date(2024, 3, 29)] == "Good Friday" and names[dt.date(2025, 4, 21)] == "Easter Monday"
    table = calendar.holiday_minutes(days)
    gaps = [("A", dt.datetime(2024, 3, 8, 21), dt.datetime(2024, 3, 10, 20, 59)), ("A", dt.datetime(2024, 3, 8, 20, 59), dt.datetime(2024, 3, 10, 21)), ("A", dt.datetime(2024, 3, 29, 3), dt.datetime(2024, 3, 29, 5)), ("A", dt.datetime(2024, 3, 6, 3), dt.datetime(2024, 3, 6, 5))]
    df = spark.createDataFrame(gaps, "symbol string, gap_start timestamp_ntz, gap_end timestamp_ntz")
    assert [r.kind for r in calendar.classified(df, table).orderBy("gap_start", "gap_end").collect()] == ["unexpected", "unexpected", "weekend", "holiday"]


def test_labels_and_metrics(spark):
    df = frame(spark, [float(i % 3) for i in range(30)])
    assert sum(r.label is None for r in labels.direction(df, "15_MIN").collect()) == 15
    rows = labels.direction(df).filter("label >= 0")
    assert labels.time_split(rows).count() == 0
    assert labels.sequences(rows, ["close"], width=10).count() == 29 - 10 and labels.sequences(rows, ["close"], width=10, last=True).count() == 29 - 9
    one = spark.createDataFrame([("A", 1, 0.9), ("A", 1, 0.1)], "symbol string, label int, p double")
    assert models.metrics(one).first()["auc"] == 0.0
    tied = spark.createDataFrame([("A", 1, 0.5), ("A", 0, 0.5)], "symbol string, label int, p double")
    assert models.metrics(tied).first()["auc"] == 0.5


def test_models(spark):
    rng = random.Random(2)
    rows = [("A", at(60 * i), x := rng.gauss(0, 1), rng.gauss(0, 1), int(x + rng.gauss(0, 0.3) > 0)) for i in range(600)]
    df = labels.time_split(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double, y double, label int")).cache()
    base = [models.boosted(df, ["x", "y"], rounds=(5,)), models.forest(df, ["x", "y"], trees=10)]
    _, scored = models.stacked(df, base)
    assert models.metrics(scored).first()["auc"] > 0.85
    assert models.importance(base[1], ["x", "y"], 1).first()["feature"] == "x"


def test_signals(spark):
    sig = spark.createDataFrame([("A", at(s), i) for i, s in enumerate((0, 79, 80, 159, 161, 400))], "symbol string, ts timestamp_ntz, seq long")
    assert sorted(r.seq for r in signals.cooldown(sig).collect()) == [0, 2, 4, 5]
    res = spark.createDataFrame([("A", at(i), i, o) for i, o in enumerate(("loss", "loss", "draw", "loss", "win", "loss"))], "symbol string, ts timestamp_ntz, seq long, outcome string")
    assert [r.streak for r in signals.streaks(res).orderBy("seq").collect()] == [1, 2, 2, 3, 0, 1]
    s = spark.createDataFrame([(1, at(0), "EURUSD", "call"), (2, at(100), "EURUSD", "call")], "signal_id int, ts timestamp_ntz, pair string, direction string")
    t = spark.createDataFrame([(7, at(30), "EURUSD", "call"), (8, at(80), "EURUSD", "call"), (9, at(120), "EURUSD", "call")], "trade_id int, ts timestamp_ntz, pair string, direction string")
    assert {r.signal_id: r.trade_id for r in signals.match(s, t).collect()} == {1: None, 2: 8}


def test_lookup_deals_large_tables_into_more_parts(spark, monkeypatch):
    monkeypatch.setattr(signals, "PART_ROWS", 100, raising=False)
    tickets = spark.sql("SELECT IF(id = 7, NULL, id) AS ticket, id % 3 AS line FROM range(1000)")
    ops = spark.sql("SELECT id * 2 AS ticket, double(id % 5) - 2 AS profit FROM range(500) UNION ALL SELECT 4, 1D")
    out = signals.lookup(tickets, ops)
    parts = out.groupBy("ticket", "line", "status").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.spark_partition_id()).cache()
    assert max(r["count"] for r in parts.groupBy("part").count().collect()) < 200
    found = {r.status: r.s for r in parts.groupBy("status").agg(F.sum("n").alias("s")).collect()}
    assert found == {"win": 201, "loss": 300, "OperationID Not Found.": 500}
    assert parts.filter("ticket IS NULL").count() == 1


def test_quality(spark):
    df = spark.createDataFrame([(1.0, 2.0, "live"), (0.0, -1.0, None), (math.nan, 1.0, "live")], "bid double, ask double, source string")
    good, bad = quality.split(df, quality.tick_rules(("historical", "live")))
    assert good.count() == 1 and good.count() + bad.count() == df.count()
    assert bad.filter("source IS NULL").first()["violations"] == ["bid", "ask", "spread", "source"]
    assert quality.complete(df, ["bid"]).count() == 2 and quality.zero_filled(df, ["bid"]).filter("bid = 0").count() == 2


def test_empty(spark):
    none = frame(spark, [1.0]).limit(0)
    assert features.transform(none, 60).count() == 0 and indicators.adx(none).count() == 0 and calendar.gaps(none, 60).count() == 0


def test_dense_signals_in_bounded_memory(spark):
    n, gap = 100_000, 30
    df = spark.range(n).selectExpr("'A' AS symbol", "timestamp_ntz'2024-03-04' + make_dt_interval(0, 0, 0, id * 0.7) AS ts", "id AS seq").unionByName(spark.createDataFrame([("B", at(0), 0), ("B", at(0), 1), ("B", at(30), 2)], "symbol string, ts timestamp_ntz, seq bigint"))
    got = {}
    for r in signals.cooldown(df, gap).orderBy("symbol", "ts").collect():
        got.setdefault(r.symbol, []).append(r.seq)
    want, last = [], None
    for i in range(n):
        t = round(i * 0.7, 6)
        if last is None or t - last >= gap - 1e-9:
            want.append(i)
            last = t
    assert got["A"] == want and got["B"] == [0, 2]
    assert signals.cooldown(df.limit(0)).count() == 0


def test_classes_of_events(spark):
    rows = [("result", "win", "win"), ("result", "loss", "loss"), ("result", "draw", "info"), ("result", None, "info"), ("signal", None, "signal"), ("skip", None, "info"), ("skip_signal", None, "info"), ("window", None, "info"), ("kill_switch", None, "kill"), ("fatal_error", None, "kill"), ("engine_crash", None, "kill"), ("webhook_failed", None, "kill"), ("journal_failed", None, "kill"), (None, "win", "info")]
    df = spark.createDataFrame(rows, "event string, outcome string, want string")
    assert df.filter(signals.activity(F.col("event"), F.col("outcome")) != F.col("want")).count() == 0


def test_known_easter_dates(spark):
    known = ["1818-03-22", "1943-04-25", "1954-04-18", "1981-04-19", "2000-04-23", "2008-03-23", "2011-04-24", "2019-04-21", "2024-03-31", "2025-04-20", "2038-04-25", "2076-04-19", "2285-03-22"]
    df = spark.createDataFrame([(int(x[:4]), x) for x in known], "year int, want string")
    assert df.filter(timefn.easter(F.col("year")).cast("string") != F.col("want")).count() == 0


def test_times_outside_of_the_calendar_are_errors(spark):
    table = calendar.holiday_minutes(calendar.holidays(spark, 2020, 2020))
    rows = spark.createDataFrame([(at(0), at(60)), (None, at(0))], "a timestamp_ntz, z timestamp_ntz")
    with pytest.raises(Exception, match="outside"):
        calendar.trading_minutes(rows.filter("a IS NOT NULL"), table, "a", "z").collect()
    days, wide = calendar.calendar_of(rows.filter("a IS NOT NULL"), "a")
    assert [r.minutes for r in calendar.trading_minutes(rows, wide, "a", "z").orderBy("z").collect()].count(None) == 1


def test_minutes_equal_a_count_of_minutes(spark):
    days = calendar.holidays(spark, 2020, 2027)
    off = {r.date for r in days.collect()}
    rng = random.Random(2)
    spans = [(t := dt.datetime(2021, 1, 1) + dt.timedelta(minutes=rng.randrange(5 * 525_600), seconds=rng.randrange(60)), t + dt.timedelta(minutes=rng.choice([0, 1, 700, 3000, 20_000]), seconds=rng.randrange(60))) for _ in range(60)]
    spans += [(dt.datetime(2021, 12, 24, 0), dt.datetime(2022, 1, 3, 23)), (dt.datetime(2024, 12, 31, 23, 59, 59), dt.datetime(2025, 1, 1)), (dt.datetime(1969, 12, 26), dt.datetime(1970, 1, 9))]
    table = calendar.holiday_minutes(days.unionByName(calendar.holidays(spark, 1969, 1970)))
    off |= {r.date for r in calendar.holidays(spark, 1969, 1970).collect()}

    def minutes(a, z):
        t, last = a.replace(second=0), z.replace(second=0)
        while t <= last:
            closed = t.weekday() == 5 or t.weekday() == 4 and t.hour >= 21 or t.weekday() == 6 and t.hour < 21
            yield not closed, not closed and t.date() not in off
            t += dt.timedelta(minutes=1)

    df = spark.createDataFrame(spans, "a timestamp_ntz, z timestamp_ntz")
    both = calendar.trading_minutes(calendar.trading_minutes(df, table, "a", "z", "open"), table, "a", "z", "week", "weekday_minutes")
    got = {(r.a, r.z): (r.week, r.open) for r in both.collect()}
    for a, z in spans:
        found = list(minutes(a, z))
        assert got[a, z] == (sum(w for w, _ in found), sum(o for _, o in found)), (a, z)
    far = spark.createDataFrame([(dt.datetime(2024, 1, 1), dt.datetime(9999, 12, 31))], "a timestamp_ntz, z timestamp_ntz")
    years = calendar.holiday_minutes(calendar.holidays_of(far.select("a").union(far.select("z")), "a"))
    assert years.count() < 8000 and calendar.trading_minutes(far, years, "a", "z").first()["minutes"] > 10**9  # no table of hours


def test_one_odd_time_makes_no_endless_grid(spark):
    df = spark.createDataFrame([("A", at(0), 1.0), ("A", at(120), 2.0)], "symbol string, ts timestamp_ntz, close double")
    assert bars.grid(df, 60, ["close"], most=3).count() == 3
    with pytest.raises(Exception, match="too many buckets"):
        bars.grid(df, 60, ["close"], most=2).collect()


def test_boosted_and_importance(spark):
    rows = spark.range(400).selectExpr("'A' AS symbol", "id AS ts", "double(id % 7) AS x", "double(hash(id) % 11) AS noise", "int(id % 7 > 3) AS label", "CASE WHEN id < 280 THEN 'train' WHEN id < 340 THEN 'val' ELSE 'test' END AS split")
    for incremental in (False, True):
        model = models.boosted(rows, ["x", "noise"], rounds=4, incremental=incremental)
        scored = models.probability(model, rows.filter("split = 'test'"))
        assert models.metrics(scored).first()["auc"] == 1.0
    ranked = models.importance(model, ["x", "noise"]).orderBy("rank").collect()
    assert [r.feature for r in ranked] == ["x", "noise"] and abs(sum(r.weight for r in ranked) - 1) < 1e-9
    weights = labels.class_weight(rows.filter("split = 'train'"), ("symbol",)).groupBy("label").agg(F.max("weight").alias("w"))
    assert {r.label: round(r.w, 6) for r in weights.collect()} == {0: 1.0, 1: round(160 / 120, 6)}


def noisy(spark):
    return spark.range(600).selectExpr("'A' AS symbol", "id AS ts", "double(id % 7) AS x", "double(abs(hash(id)) % 11) AS noise", "int(abs(hash(id, 3)) % 10 < (id % 7)) AS label", "CASE WHEN id < 400 THEN 'train' WHEN id < 500 THEN 'val' ELSE 'test' END AS split")


def test_compiled_ensembles_score_as_the_models_do(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier

    from marketframe.operators.ensembles import Ensemble

    rows, x = noisy(spark), ["x", "noise"]
    weighted = labels.class_weight(rows.filter("split = 'train'"))
    boosted = Pipeline(stages=[models.assembler(x), GBTClassifier(labelCol="label", weightCol="weight", maxIter=6, stepSize=0.3, seed=7)]).fit(weighted)
    for model in (models.forest(rows, x, trees=12), boosted):
        plain = Ensemble.of(model, x)
        both = models.probability(plain, models.probability(model, rows, "p"), "q")
        assert both.filter("abs(p - q) > 1e-9").count() == 0 and both.select("q").distinct().count() > 5
        own = {r.feature: r.weight for r in models.importance(model, x).collect()}
        assert {r.feature: round(r.weight, 6) for r in models.importance(plain, x).collect()} == {f: round(w, 6) for f, w in own.items()}


def test_splits_that_gain_nothing_have_no_shares(spark):
    from marketframe.operators.ensembles import Ensemble

    leaf = lambda v: (-1, None, -1, -1, v, None, None)
    trees = {0: [(0, 1.0, 1, 2, None, None, None), leaf(0.1), leaf(0.9)], 1: [(1, 9.0, 1, 2, None, None, None), leaf(0.4), leaf(0.6)], 2: [leaf(0.5)]}
    rows = spark.createDataFrame([(float(i), float(i % 2), int(i > 1)) for i in range(4)], "b double, a double, label int")
    one_gains_nothing = Ensemble(["b", "a"], False, trees).measured(rows)
    got = models.importance(one_gains_nothing, ["b", "a"]).collect()
    assert [(r["rank"], r.feature) for r in got] == [(1, "a"), (2, "b")] and all(math.isnan(r.weight) for r in got)
    assert Ensemble(["b", "a"], True, trees).measured(rows).importance() == [1.0, 0.0]
    assert Ensemble(["b", "a"], False, {0: trees[0], 2: trees[2]}).measured(rows).importance() == [1.0, 0.0]


def test_best_round_equals_a_search_over_fits(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier

    from marketframe.operators.ensembles import Ensemble

    rows, x = noisy(spark), ["x", "noise"]
    val = rows.filter("split = 'val'")
    weighted = labels.class_weight(rows.filter("split = 'train'"))
    areas = {}
    for n in range(1, 6):
        gbt = GBTClassifier(labelCol="label", weightCol="weight", maxIter=n, stepSize=0.1, seed=7)
        fitted = Ensemble.of(Pipeline(stages=[models.assembler(x), gbt]).fit(weighted), x)  # a fit for each number of rounds
        areas[n] = models.metrics(models.probability(fitted, val)).first()["auc"]
    model = models.boosted(rows, x, rounds=5)
    assert len(model.trees) == max(areas, key=lambda n: (round(areas[n], 12), -n))
    staged = {r["round"]: r.auc for r in models.round_areas(model, val).collect()}
    assert all(abs(a - areas[n]) < 1e-12 for n, a in staged.items())


def test_out_of_fold(spark):
    rows = noisy(spark).withColumn("ts", F.timestamp_seconds("ts"))
    out = models.out_of_fold(rows, {"f": models.frequency("x")}, blocks=3).collect()
    base = rows.collect()
    cut = lambda r: min(2, int(r.ts.timestamp() * 3 / 599))
    assert len(out) == sum(cut(r) > 0 for r in base)
    for r in out:
        seen = [b.label for b in base if cut(b) < r.block and b.x == r.x]
        assert r.block == cut(r) and r.f == pytest.approx((sum(seen) + 1) / (len(seen) + 2))
    fits = {"trees": models.learner(lambda df: models.forest(df, ["x", "noise"], trees=5)), "f": models.frequency("x")}
    _, scored = models.stacked_out_of_fold(rows, fits, blocks=3)
    assert models.metrics(scored).first()["auc"] > 0.7 and scored.count() == 100


@pytest.mark.parametrize("rows_a_batch", [1, 7, 10_000])
def test_rolling_sums_know_their_window_only(spark, rows_a_batch):
    import numpy as np

    from marketframe.functions.recurrence import Frame, Rolling, sliding_sums

    rng = np.random.default_rng(rows_a_batch)
    special = [np.nan, np.inf, -np.inf, 1e17, -1e17, 0.0, 1e-9]
    for n in (1, 2, 3, 10, 50):
        x = np.where(rng.random(400) < 0.1, rng.choice(special, 400), rng.normal(size=400))
        frame, out = Frame(Rolling("x", n)), []
        for i in range(0, 400, rows_a_batch):
            out.append(frame.feed(x[i : i + rows_a_batch], i))
        got = np.concatenate(out)
        for i in range(400):
            w = x[max(0, i - n + 1) : i + 1]
            if len(w) < n or np.isnan(w).any():
                assert np.isnan(got[i])
            elif not np.isfinite(w).all():
                want = math.nan if {np.inf, -np.inf} <= set(w) else w[~np.isfinite(w)][0]
                assert got[i] == want or math.isnan(want) and math.isnan(got[i])
            else:  # as near as one rounding of its own largest value allows
                assert abs(got[i] - math.fsum(w) / n) <= 1e-15 * np.abs(w).max() * n
    assert sliding_sums(np.array([1e17, 1.0, 1.0, 1.0, 1.0]), 2, 3).tolist() == [1e17, 2.0, 2.0, 2.0]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    try:
        df = spark.createDataFrame([("A", i, v) for i, v in enumerate([1.0, 2.0, 3.0, math.inf, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0])], "symbol string, ts int, x double")
        got = [r.m for r in ewm(df, {"m": Rolling("x", 2)}).orderBy("ts").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [None, 1.5, 2.5, math.inf, math.inf, 5.5, 6.5, 7.5, 8.5, 9.5]
