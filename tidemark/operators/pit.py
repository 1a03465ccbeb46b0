"""Point-in-time joins: to the next session, to the session of the day, to the last bar before a day.

Calendars hold one row a trading day and are broadcast; everything keyed by symbol is an equi-join on
(symbol, day), so no join compares all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def weekday_calendar(spark: SparkSession, first: str, last: str, opens: str = "14:30:00", closes: str = "21:00:00", holidays: DataFrame | None = None) -> DataFrame:
    """market_open and market_close of every weekday from `first` to `last`, without the days in `holidays` (date)."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date")).where(F.weekday("date") < 5)
    if holidays is not None:
        days = days.join(F.broadcast(holidays.select("date")), "date", "left_anti")
    at = lambda clock: F.to_timestamp(F.concat(F.col("date").cast("string"), F.lit(f" {clock}")))
    return days.select(at(opens).alias("market_open"), at(closes).alias("market_close"))


def exchange_calendar(spark: SparkSession, first: str, last: str, zone: str = "America/New_York", opens: str = "09:30:00", closes: str = "16:00:00", holidays: list[str] | DataFrame = (), early: dict[str, str] | None = None) -> DataFrame:
    """market_open and market_close in UTC of every weekday from `first` to `last` by the clock of `zone`, summer time included.

    `holidays` are days without a session; `early` maps days to the clock time at which they close.
    """
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date")).where(F.weekday("date") < 5)
    if isinstance(holidays, DataFrame):
        days = days.join(F.broadcast(holidays.select("date")), "date", "left_anti")
    elif holidays:
        days = days.where(~F.col("date").isin([F.lit(d).cast("date") for d in holidays]))
    close = F.lit(closes)
    for day, clock in sorted((early or {}).items()):
        close = F.when(F.col("date") == F.lit(day).cast("date"), clock).otherwise(close)
    at = lambda clock: F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", F.col("date").cast("string"), clock)), zone)
    return days.select(at(F.lit(opens)).alias("market_open"), at(close).alias("market_close"))


def align_next_open(articles: DataFrame, schedule: DataFrame, ts: str = "timestamp_utc", out: str = "session_open", strict: bool = True) -> DataFrame:
    """Adds the first market open strictly after each timestamp.

    Every half-open interval between two opens is filed under the days it touches, so the join is an
    equality on the day with the interval as residual, and a timestamp meets exactly one interval.
    With `strict`, timestamps before the first or from the last open on raise; otherwise they get NULL.
    """
    opens = schedule.select("market_open").distinct()
    gaps = opens.select(F.lag("market_open").over(W.orderBy("market_open")).alias("_from"), F.col("market_open").alias("_open")).where("_from is not null")
    filed = gaps.select("_from", "_open", F.explode(F.sequence(F.to_date("_from"), F.to_date("_open"))).alias("_day"))
    t = F.col(ts)
    joined = articles.withColumn("_at", F.to_date(t)).join(
        F.broadcast(filed), (F.col("_at") == F.col("_day")) & (t >= F.col("_from")) & (t < F.col("_open")), "left"
    )
    found = F.col("_open")
    if strict:
        found = F.when(t.isNotNull() & F.col("_open").isNull(), F.raise_error(F.lit(f"{ts} lies outside the calendar")).cast("timestamp")).otherwise(F.col("_open"))
    return joined.withColumn(out, found).drop("_at", "_day", "_from", "_open")


def session_bucket(articles: DataFrame, schedule: DataFrame, ts: str = "timestamp_utc", out: str = "session") -> DataFrame:
    """Adds pre-market, market-hours (both ends included) or after-hours, by the session of the UTC day."""
    days = schedule.groupBy(F.to_date("market_open").alias("_day")).agg(F.min(F.struct("market_open", "market_close")).alias("_s"))
    joined = articles.withColumn("_at", F.to_date(ts)).join(F.broadcast(days), F.col("_at") == F.col("_day"), "left")
    t = F.col(ts)
    bucket = F.when(t < F.col("_s.market_open"), "pre-market").when((t >= F.col("_s.market_open")) & (t <= F.col("_s.market_close")), "market-hours").otherwise("after-hours")
    return joined.withColumn(out, bucket).drop("_at", "_day", "_s")


def as_of_previous_bar(articles: DataFrame, bars: DataFrame, by: str = "symbol", ts: str = "timestamp_utc", day: str = "bar_date") -> DataFrame:
    """Left join of each article to the columns of the last bar strictly before its UTC day.

    A bar is filed under every day from the next one to that of its successor, and met on (key, day). A
    key's last bar, one row a key, serves all later days.
    """
    values = [c for c in bars.columns if c != by]
    marked = bars.select(by, F.struct(*values).alias("_bar"), F.col(day).alias("_from"), F.lead(day).over(W.partitionBy(by).orderBy(day)).alias("_until"))
    filed = marked.where("_until is not null").select(by, F.explode(F.sequence(F.date_add("_from", 1), F.col("_until"))).alias("_day"), "_bar")
    last = marked.where("_until is null").select(F.col(by).alias("_by"), "_from", F.col("_bar").alias("_last"))
    met = articles.withColumn("_day", F.to_date(ts)).join(filed, [by, "_day"], "left")
    met = met.join(last, (F.col(by) == F.col("_by")) & (F.col("_day") > F.col("_from")), "left")
    bar = F.coalesce("_bar", "_last")
    return met.select(*[F.col(c) for c in articles.columns], *[bar[c].alias(c) for c in values])


def next_event(rows: DataFrame, events: DataFrame, by: str, day: str, event_day: str, out: str = "next_event") -> DataFrame:
    """Adds the first event day on or after each row's day, NULL without one.

    Rows and events are merged into one sequence for each key and the next event is carried backward.
    """
    event = events.select(F.col(by), F.to_date(event_day).alias("_d")).where(F.col("_d").isNotNull()).distinct()
    days = rows.select(F.col(by), F.to_date(day).alias("_d")).where(F.col("_d").isNotNull()).distinct()
    merged = days.withColumn("_e", F.lit(None).cast("date")).unionByName(event.withColumn("_e", F.col("_d")))
    ahead = W.partitionBy(by).orderBy(F.col("_d").desc(), F.col("_e").desc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    known = merged.withColumn(out, F.last("_e", ignorenulls=True).over(ahead)).where("_e is null").select(by, "_d", out).distinct()
    return rows.withColumn("_d", F.to_date(day)).join(known, [by, "_d"], "left").drop("_d")
