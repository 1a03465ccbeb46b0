"""Daily bars: trailing features, labels, news volume, and the market table of an article.

All windows are partitioned by symbol and look at bars only; articles meet them by (symbol, day).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions import fixed
from tidemark.functions.scores import direction
from tidemark.operators import pit

#: Microseconds of a day.
DAY = 86_400_000_000

MARKET_COLUMNS = [
    "article_id", "ticker", "timestamp_utc", "session_open", "abnormal_return_1d", "label_direction",
    "momentum_1d", "momentum_5d", "momentum_20d", "volatility_20d", "beta_20d", "relative_volume_20d",
    "daily_range_ratio_1d", "days_to_earnings", "session", "news_volume",
]


def _by(symbol: str = "symbol", day: str = "bar_date") -> W:
    return W.partitionBy(symbol).orderBy(day)


def long_bars(wide: DataFrame, symbols: list[str], day: str = "Date") -> DataFrame:
    """Wide columns named field_symbol to one row for each (symbol, bar_date); a symbol without columns raises."""
    fields = ["high", "low", "close", "volume"]
    lacking = [s for s in symbols if any(f"{f}_{s}" not in wide.columns for f in fields)]
    if lacking:
        raise KeyError(f"no prices for {lacking}")
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("symbol"), *[F.col(f"`{f}_{s}`").cast("double").alias(f) for f in fields]) for s in symbols]))
    return wide.select(F.to_date(day).alias("bar_date"), rows.alias("r")).select("r.symbol", "bar_date", *[f"r.{f}" for f in fields])


def empty_symbols(bars: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested symbols without a single close."""
    held = bars.groupBy("symbol").agg(F.count("close").alias("n")).where("n > 0")
    return requested.select("symbol").distinct().join(held, "symbol", "left_anti")


def daily_return(close: str = "close") -> Column:
    before = F.lag(close).over(_by())
    return F.try_divide(F.col(close), before) - 1


def cumulative_return(k: int) -> Column:
    """Last close over the close k bars before; NULL without so many bars."""
    return F.try_divide(F.col("close"), F.lag("close", k).over(_by())) - 1


def bar_features(bars: DataFrame) -> DataFrame:
    """`bars` (symbol, bar_date, high, low, close, volume) with the asset's trailing features as of each bar.

    Returns are taken over the last WINDOW prices, so over one fewer returns.
    """
    n = fixed.WINDOW
    prices, returns = _by().rowsBetween(1 - n, 0), _by().rowsBetween(2 - n, 0)
    out = bars.withColumn("_ret", daily_return())
    for k in fixed.MOMENTUM_LOOKBACKS:
        out = out.withColumn(f"momentum_{k}d", cumulative_return(k))
    out = out.withColumn("volatility_20d", F.stddev_samp("_ret").over(returns))
    median = F.percentile("volume", F.lit(0.5)).over(prices)
    out = out.withColumn("relative_volume_20d", F.when(median != 0, F.col("volume") / median))
    return out.withColumn("daily_range_ratio_1d", F.when(F.col("close") != 0, (F.col("high") - F.col("low")) / F.col("close"))).drop("_ret")


def joined_days(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(symbol, bar_date, close, market_close) on every day that the symbol or the benchmark has a bar.

    Each symbol's days are a date spine over the benchmark's span and its own, so all joins are on equal keys.
    """
    days = benchmark.select("bar_date", F.col("market_close").cast("double").alias("market_close"))
    span = days.agg(F.min("bar_date"), F.max("bar_date")).first()
    low, high = (F.lit(x).cast("date") for x in span)
    spine = bars.groupBy("symbol").agg(F.explode(F.sequence(F.least(F.min("bar_date"), low), F.greatest(F.max("bar_date"), high))).alias("bar_date"))
    both = spine.join(bars.select("symbol", "bar_date", "close"), ["symbol", "bar_date"], "left").join(days, "bar_date", "left")
    return both.where("close is not null or market_close is not null").select("symbol", "bar_date", "close", "market_close")


def betas(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(symbol, bar_date, beta_20d): slope of the asset's on the benchmark's return over the last WINDOW joined days.

    A day that either side lacks has no return, nor has the next. NULL with fewer than 3 days or where a
    side's returns are all equal.
    """
    w, frame = _by(), _by().rowsBetween(2 - fixed.WINDOW, 0)
    x = F.try_divide(F.col("market_close"), F.lag("market_close").over(w)) - 1
    y = F.try_divide(F.col("close"), F.lag("close").over(w)) - 1
    pairs = joined_days(bars, benchmark).withColumn("_x", F.when(y.isNotNull(), x)).withColumn("_y", F.when(x.isNotNull(), y))
    varied = (F.min("_x").over(frame) < F.max("_x").over(frame)) & (F.min("_y").over(frame) < F.max("_y").over(frame))
    slope = F.expr(f"regr_slope(_y, _x) over (partition by symbol order by bar_date rows between {fixed.WINDOW - 2} preceding and current row)")
    return pairs.select("symbol", "bar_date", F.when((F.row_number().over(w) >= 3) & varied, slope).alias("beta_20d"))


def session_returns(bars: DataFrame, benchmark: DataFrame, horizon: int = 1) -> DataFrame:
    """(symbol, bar_date, abnormal_return_{h}d): the asset's return from the bar before to the end of the horizon, less the benchmark's.

    The horizon stops at the symbol's last bar. NULL on the first bar and where the benchmark lacks a day.
    """
    ahead = max(horizon - 1, 0)
    w = _by()
    joined = bars.select("symbol", "bar_date", "close").join(benchmark.select("bar_date", "market_close"), "bar_date", "left")
    rest = w.rowsBetween(0, ahead)

    def ret(column: str) -> Column:
        return F.try_divide(F.last(column).over(rest), F.lag(column).over(w)) - 1

    return joined.select("symbol", "bar_date", (ret("close") - ret("market_close")).alias(f"abnormal_return_{horizon}d"))


def news_volume(articles: DataFrame, by: str = "ticker", ts: str = "timestamp_utc", days: int = fixed.NEWS_VOLUME_DAYS, daily: DataFrame | None = None) -> DataFrame:
    """Adds the number of the key's articles in the `days` before each one, others at the same instant left out.

    With `daily`, a table of (key, day) and other columns, these are added too, NULL for days it lacks: the counts
    meet it on their way, so the articles are shuffled once for both.

    The span ends in the article's own day, so the count has three parts: earlier articles of that day;
    whole days between; and, of the day where the span begins, the articles from that instant on. The
    first and last come from one running sum inside each (key, day), in which a day's articles and the
    span starts that fall on it are merged by time; a sliding frame would add up every span anew.
    """
    span = days * DAY
    own = articles.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_day", F.floor(F.col("_t") / F.lit(DAY)).cast("long"))
    points = own.where("_t is not null").groupBy(by, "_day", "_t").agg(F.count("*").alias("_n"))
    between = W.partitionBy(by).orderBy("_day").rangeBetween(1 - days, -1)
    totals = points.groupBy(by, "_day").agg(F.sum("_n").alias("_all"))
    middle = totals.select(by, "_day", (F.coalesce(F.sum("_all").over(between), F.lit(0)) if days > 1 else F.lit(0)).alias("_mid"))
    written = points.select(by, F.col("_day").alias("_cell"), F.col("_t").alias("_x"), F.lit(1).alias("_own"), "_n", "_day", "_t")
    starts = points.select(by, (F.col("_day") - days).alias("_cell"), (F.col("_t") - span).alias("_x"), F.lit(0).alias("_own"), F.lit(0).cast("long").alias("_n"), "_day", "_t")
    cell = W.partitionBy(by, "_cell")
    before = F.coalesce(F.sum("_n").over(cell.orderBy("_x", "_own").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    merged = written.unionByName(starts).withColumn("_before", before).withColumn("_all", F.sum("_n").over(cell))
    part = F.when(F.col("_own") == 1, F.col("_before")).otherwise(F.col("_all") - F.col("_before"))
    ends = merged.groupBy(by, "_day", "_t").agg(F.sum(part).alias("_ends")).join(middle, [by, "_day"])
    counts = ends.select(by, "_day", "_t", (F.col("_ends") + F.col("_mid")).cast("long").alias("news_volume"))
    if daily is not None:
        counts = counts.join(daily.withColumn("_day", F.unix_date("day").cast("long")).drop("day"), [by, "_day"], "left")
    return own.join(counts, [by, "_day", "_t"], "left").withColumn("news_volume", F.coalesce("news_volume", F.lit(0)).cast("long")).drop("_day", "_t")


def days_to_next(rows: DataFrame, events: DataFrame, by: str, ts: str, event_ts: str, out: str = "days_to_earnings") -> DataFrame:
    """Adds the days from each row's UTC day to the next event on or after it, in any order of `events`."""
    found = pit.next_event(rows, events, by, ts, event_ts, "_next")
    return found.withColumn(out, F.datediff("_next", F.to_date(ts))).drop("_next")


def day_table(bars: DataFrame, benchmark: DataFrame, schedule: DataFrame, earnings: DataFrame | None = None) -> DataFrame:
    """(ticker, day, asset's features, beta_20d, _today, _next, _event): what an article of each UTC day may know, and its labels.

    One row for each symbol and each day of the calendar's, the benchmark's and its own span. Features are those of the last
    bar before the day, the beta that of the last joined day before it. _today and _next are the labels of a session on the
    day and of the first one after it, _event the first earnings day on or after it. Bars are dealt out by symbol once;
    every window runs inside a symbol, over its days. The benchmark and the calendar have one row a day and are broadcast.
    """
    n = fixed.WINDOW
    bench = F.broadcast(benchmark.select("bar_date", F.col("market_close").cast("double").alias("market_close")))
    low, high = benchmark.select(F.col("bar_date").alias("d")).unionByName(schedule.select(F.to_date("market_open").alias("d"))).agg(F.min("d"), F.max("d")).first()
    own = bar_features(bars.repartition("symbol").join(bench, "bar_date", "left"))
    features = [c for c in own.columns if c not in (*bars.columns, "market_close")]
    ret = lambda c: F.try_divide(F.col(c), F.lag(c).over(_by())) - 1
    own = own.select("symbol", F.col("bar_date").alias("day"), F.col("close"), F.struct(*features).alias("_bar"), F.struct((ret("close") - ret("market_close")).alias("r")).alias("_label"))
    spine = own.groupBy("symbol").agg(F.explode(F.sequence(F.least(F.min("day"), F.lit(low).cast("date")), F.greatest(F.max("day"), F.lit(high).cast("date")))).alias("day"))
    every = own.withColumn("_event", F.lit(None).cast("date")).unionByName(spine, allowMissingColumns=True)
    if earnings is not None:
        days = earnings.select(F.col("ticker").alias("symbol"), F.to_date("earnings_ts").alias("day")).where("day is not null").distinct()
        every = every.unionByName(days.withColumn("_event", F.col("day")), allowMissingColumns=True)
    cells = every.repartition("symbol").groupBy("symbol", "day").agg(*[F.max(c).alias(c) for c in ("close", "_bar", "_label", "_event")])
    sessions = schedule.select(F.to_date("market_open").alias("day")).distinct().withColumn("_open", F.lit(True))
    cells = cells.join(bench.withColumnRenamed("bar_date", "day"), "day", "left").join(F.broadcast(sessions), "day", "left")
    # Joined days are counted, so that frames of so many of them can be told on rows of every day.
    w = W.partitionBy("symbol").orderBy("day")
    # What lies ahead is read in falling order: frames that reach to the end would be added up anew for every row.
    falling = W.partitionBy("symbol").orderBy(F.desc("day"))
    before, ahead = w.rowsBetween(W.unboundedPreceding, -1), falling.rowsBetween(W.unboundedPreceding, -1)
    joined = F.col("close").isNotNull() | F.col("market_close").isNotNull()
    cells = cells.withColumn("_joined", joined).withColumn("_i", F.count_if("_joined").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    cells = cells.withColumn("_last", F.last(F.when(joined, F.struct("close", "market_close")), ignorenulls=True).over(before))
    x, y = (F.when(F.col("_joined"), F.try_divide(F.col(c), F.col(f"_last.{c}")) - 1) for c in ("market_close", "close"))
    cells = cells.withColumn("_x", F.when(y.isNotNull(), x)).withColumn("_y", F.when(x.isNotNull(), y))
    frame = W.partitionBy("symbol").orderBy("_i").rangeBetween(2 - n, 0)
    varied = (F.min("_x").over(frame) < F.max("_x").over(frame)) & (F.min("_y").over(frame) < F.max("_y").over(frame))
    slope = F.expr(f"regr_slope(_y, _x) over (partition by symbol order by _i range between {n - 2} preceding and current row)")
    cells = cells.withColumn("_beta", F.when(F.col("_joined"), F.struct(F.when((F.col("_i") >= 3) & varied, slope).alias("b"))))
    nearest = lambda c, over: F.last(c, ignorenulls=True).over(over)
    return cells.select(
        F.col("symbol").alias("ticker"), "day", nearest("_bar", before).alias("_bar"), nearest("_beta", before)["b"].alias("beta_20d"), F.col("_label.r").alias("_today"),
        nearest(F.when(F.col("_open"), F.coalesce("_label", F.struct(F.lit(None).cast("double").alias("r")))), ahead)["r"].alias("_next"),
        nearest("_event", falling.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("_event"),
    ).select("ticker", "day", *[F.col("_bar")[c].alias(c) for c in features], "beta_20d", "_today", "_next", "_event")


def build_market_features(articles: DataFrame, bars: DataFrame, benchmark: DataFrame, schedule: DataFrame, earnings: DataFrame | None = None) -> DataFrame:
    """One market row for each article (article_id, ticker, timestamp_utc) with a label, in MARKET_COLUMNS.

    Features see only bars before the article's day; the label is that of the next session. News volume
    counts articles that end up without a label too. Articles meet the calendar by broadcast, and the day table
    and their news volume in one join.
    """
    out = articles.select("article_id", "ticker", F.col("timestamp_utc").cast("timestamp").alias("timestamp_utc"))
    out = news_volume(out, daily=day_table(bars, benchmark, schedule, earnings))
    out = pit.align_next_open(pit.session_bucket(out, schedule), schedule)
    day = F.to_date("timestamp_utc")
    out = out.withColumn("abnormal_return_1d", F.when(F.to_date("session_open") == day, F.col("_today")).otherwise(F.col("_next")))
    out = out.withColumns({"label_direction": direction(F.col("abnormal_return_1d")), "days_to_earnings": F.datediff("_event", day)})
    return out.na.drop("all", subset=["abnormal_return_1d"]).select(*MARKET_COLUMNS)
