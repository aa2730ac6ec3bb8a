"""Market calendar and gaps. The market is closed on Saturdays, on Sundays before 21:00, on Fridays
from 21:00 on and on holidays, all UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketframe.functions.timefn import easter
from marketframe.functions.windows import by_symbol

# Month, day and name of the yearly holidays.
FIXED = [(1, 1, "New Year"), (12, 25, "Christmas"), (12, 26, "Boxing Day"), (12, 31, "New Year's Eve"), (7, 4, "Independence Day")]


def holidays(spark: SparkSession, first: int, last: int) -> DataFrame:
    """date and name: fixed days (of a Saturday on the Friday before, of a Sunday on the Monday
    after), Good Friday and Easter Monday."""
    years = spark.range(first, last + 1).withColumnRenamed("id", "year")
    days = F.array(*(F.struct(F.make_date(F.col("year").cast("int"), F.lit(m), F.lit(d)).alias("d"), F.lit(n).alias("name")) for m, d, n in FIXED))
    fixed = years.select(F.explode(days).alias("x")).select("x.*")
    shift = F.when(F.weekday("d") == 5, -1).when(F.weekday("d") == 6, 1).otherwise(0)
    sunday = easter(F.col("year"))
    moving = years.select(F.explode(F.array(F.struct(F.date_sub(sunday, 2).alias("d"), F.lit("Good Friday").alias("name")), F.struct(F.date_add(sunday, 1).alias("d"), F.lit("Easter Monday").alias("name")))).alias("x")).select("x.*")
    return fixed.select(F.date_add("d", shift).alias("date"), "name").unionByName(moving.select(F.col("d").alias("date"), "name")).groupBy("date").agg(F.min("name").alias("name"))


def weekend(ts: Column) -> Column:
    day, hour = F.weekday(ts), F.hour(ts)
    return (day == 5) | ((day == 6) & (hour < 21)) | ((day == 4) & (hour >= 21))


def with_closed(df: DataFrame, days: DataFrame, ts: str = "ts") -> DataFrame:
    """is_weekend, is_holiday and closed for every row; the holiday table has at most eight rows a year."""
    marks = days.select(F.col("date").alias("__date"), F.lit(True).alias("__holiday"))
    out = df.join(F.broadcast(marks), F.to_date(F.col(ts)) == F.col("__date"), "left")
    holiday = F.coalesce("__holiday", F.lit(False))
    return out.withColumns({"is_weekend": weekend(F.col(ts)), "is_holiday": holiday, "closed": weekend(F.col(ts)) | holiday}).drop("__date", "__holiday")


WEEK, CLOSED = 7 * 1440, 2880  # minutes; the market closes once a week, for two days
FIRST_CLOSE = 1440 + 21 * 60  # the first Friday 21:00 after 1970-01-01, a Thursday


def weekday_minutes(m: Column) -> Column:
    """Minutes outside of weekends from 1970-01-02 21:00 to minute m of the epoch, by whole weeks and the rest."""
    since = m - FIRST_CLOSE
    return since - F.floor(since / WEEK) * CLOSED - F.least(F.pmod(since, F.lit(WEEK)), F.lit(CLOSED))


def _minute(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / 60)


def holiday_minutes(days: DataFrame) -> DataFrame:
    """A row per year: its holidays as minutes of the epoch, and the minutes of all holidays of the years
    before it that no weekend has closed."""
    start = F.unix_date("date").cast("bigint") * 1440
    each = days.select(F.year("date").alias("__year"), start.alias("d"), (weekday_minutes(start + 1440) - weekday_minutes(start)).alias("n"))
    years = each.groupBy("__year").agg(F.array_sort(F.collect_list("d")).alias("__days"), F.sum("n").alias("n"))
    before = F.sum("n").over(by_symbol("__year").rowsBetween(Window.unboundedPreceding, -1))  # a row per year
    return years.withColumn("symbol", F.lit("market")).withColumn("__before", F.coalesce(before, F.lit(0))).select("__year", "__days", "__before")


def holidays_of(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """The holidays of the years that `rows` span, and of one year on either side."""
    a, z = rows.agg(F.min(F.year(ts)), F.max(F.year(ts))).first()
    return holidays(rows.sparkSession, max(1, (a or 1970) - 1), min(9999, (z or 1970) + 1))


def calendar_of(rows: DataFrame, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(holidays, holiday_minutes) of the years that `rows` span."""
    days = holidays_of(rows, ts)
    return days, holiday_minutes(days)


def trading_minutes(spans: DataFrame, years: DataFrame, start: str, end: str, out: str = "minutes", of: str = "open_minutes") -> DataFrame:
    """Minutes from start to end, both ends counted, in which the market trades, or with of="weekday_minutes"
    those outside of weekends; a difference of two counts that are closed forms of the time and of its year's
    holidays (`years`, from holiday_minutes(), at most ten thousand rows). A time in a year that the table
    doesn't hold is an error; a null start or end gives null."""
    if of == "weekday_minutes":
        upto = lambda m: weekday_minutes(m)
        both = spans.withColumns({"__s": upto(_minute(F.col(start))), "__e": upto(_minute(F.col(end)) + 1)})
    else:
        def counted(df: DataFrame, ts: Column, m: Column, name: str) -> DataFrame:
            joined = df.join(F.broadcast(years), F.year(ts) == F.col("__year"), "left")
            own = F.aggregate("__days", F.lit(0).cast("bigint"), lambda acc, d: acc + F.when(d < m, weekday_minutes(F.least(m, d + 1440)) - weekday_minutes(d)).otherwise(0))
            outside = F.raise_error(F.lit("a time lies outside of the table of holidays")).cast("bigint")
            return joined.withColumn(name, F.when(ts.isNull(), None).when(F.col("__year").isNull(), outside).otherwise(weekday_minutes(m) - F.col("__before") - own)).drop(*years.columns)

        both = counted(counted(spans, F.col(start), _minute(F.col(start)), "__s"), F.col(end), _minute(F.col(end)) + 1, "__e")
    return both.withColumn(out, F.greatest(F.col("__e") - F.col("__s"), F.lit(0)).cast("bigint")).withColumn(out, F.when(F.col("__e").isNotNull() & F.col("__s").isNotNull(), F.col(out))).drop("__s", "__e")


def classified(gaps: DataFrame, years: DataFrame, start: str = "gap_start", end: str = "gap_end") -> DataFrame:
    """kind: weekend if no minute is outside weekends, holiday if none is open, else unexpected."""
    out = trading_minutes(trading_minutes(gaps, years, start, end, "__open"), years, start, end, "__weekday", "weekday_minutes")
    return out.withColumn("kind", F.when(F.col("__weekday") == 0, "weekend").when(F.col("__open") == 0, "holiday").otherwise("unexpected")).drop("__open", "__weekday")


def gaps(bars: DataFrame, seconds: int) -> DataFrame:
    """symbol, gap_start and gap_end (the bars around), size in steps missing."""
    prev = F.lag("ts").over(by_symbol())
    delta = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("prev").cast("timestamp"))
    return bars.select("symbol", "ts", prev.alias("prev")).withColumn("d", delta).filter(F.col("d") > seconds).select("symbol", F.col("prev").alias("gap_start"), F.col("ts").alias("gap_end"), (F.col("d") / seconds - 1).cast("bigint").alias("size"))


def unexpected(found: DataFrame, days: DataFrame, now: Column, least: int = 5, within_days: int = 90) -> DataFrame:
    """Gaps of over `least` steps, not from Friday or Saturday into a weekend day, neither end in
    closed hours, begun within the last days."""
    day = lambda c: F.weekday(F.col(c))
    over = ((day("gap_start") == 4) & day("gap_end").isin(5, 6)) | ((day("gap_start") == 5) & day("gap_end").isin(5, 6))
    some = found.filter((F.col("size") > least) & ~over & (F.col("gap_start") >= F.date_sub(F.to_date(now), within_days)))
    ends = with_closed(with_closed(some, days, "gap_start").withColumnRenamed("closed", "__a").drop("is_weekend", "is_holiday"), days, "gap_end")
    return ends.filter(~F.col("__a") & ~F.col("closed")).select(*found.columns)


def repair_windows(found: DataFrame, seconds: int) -> DataFrame:
    """symbol, start and end of what is missing in each gap; empty windows are left out."""
    step = F.expr(f"interval {seconds} seconds")
    return found.select("symbol", (F.col("gap_start") + step).alias("start"), (F.col("gap_end") - step).alias("end")).filter("start < end")


def gap_summary(gridded: DataFrame, days: DataFrame, column: str = "close") -> DataFrame:
    """Per symbol: slots, empty slots by weekend, holiday and other, and their share in percent."""
    rows = with_closed(gridded, days)
    empty = F.col(column).isNull()
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("slots"), F.count_if(empty & F.col("is_weekend")).alias("weekend"), F.count_if(empty & ~F.col("is_weekend") & F.col("is_holiday")).alias("holiday"), F.count_if(empty & ~F.col("closed")).alias("unexpected"), F.round(100 * F.count_if(empty) / F.count(F.lit(1)), 2).alias("percent")
    )
