"""Batch sources that pull articles, price bars and earnings days from a feed: partitions of days or symbols, retries, a rate limit.

The feed is a function of the caller. What it raises as FEED_ERRORS is tried again and in the end becomes a row that
says so, so that one bad window neither loses the run nor goes unseen; any other error is one of code and stops the job.
"""

from __future__ import annotations

import datetime as dt
import threading
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions.fixed import FETCH_CAP
from tidemark.session import ship

STATUS = "window_ticker string, window_first date, window_last date, window_rows long, window_error string"
ARTICLES = "article_id bigint, headline string, summary string, source string, url string, timestamp_utc timestamp, ticker string, capped boolean"
BARS = "symbol string, bar_date date, high double, low double, close double, volume double"
EARNINGS = "ticker string, earnings_ts timestamp"
ATTEMPTS = 3
#: Days of bars before and after the articles' span: what 20-day features and 3-day labels at its ends need.
PAD_DAYS = 45


class FeedError(Exception):
    """For feeds to say that an answer cannot be used and may be had on another try."""


#: Errors of a feed: of the network and the file system, and what the feed says itself.
FEED_ERRORS = (OSError, FeedError)
#: fetch(ticker, first_day, last_day) -> rows; for articles id, headline, summary, source, url, datetime (UNIX seconds).
Fetch = Callable[[str, dt.date, dt.date], list[dict]]


class Pacer:
    """At most `per_second` calls a second among the threads of this process."""

    def __init__(self, per_second: float):
        self.gap, self.next, self.lock = 1.0 / per_second, 0.0, threading.Lock()

    def wait(self) -> None:
        with self.lock:
            start = max(time.monotonic(), self.next)
            self.next = start + self.gap
        time.sleep(max(0.0, start - time.monotonic()))

    def hold(self) -> None:
        """Until the next call is due: a process that ends here has used up its share."""
        time.sleep(max(0.0, self.next - time.monotonic()))


_PACERS: dict[float, Pacer] = {}


def pacer(share: float) -> Pacer:
    """This process's pacer for a share of a rate, the same for all partitions it reads."""
    return _PACERS.setdefault(share, Pacer(share))


class DayWindow(InputPartition):
    def __init__(self, ticker: str, first: dt.date, last: dt.date):
        self.ticker, self.first, self.last = ticker, first, last


def day_windows(ticker: str, first: dt.date, last: dt.date, days: int) -> list[DayWindow]:
    out, at = [], first
    while at <= last:
        end = min(at + dt.timedelta(days=days - 1), last)
        out.append(DayWindow(ticker, at, end))
        at = end + dt.timedelta(days=1)
    return out


def pull(fetch: Fetch, window: DayWindow, attempts: int = ATTEMPTS, backoff: float = 0.0, pace: Pacer | None = None, least: int = 0) -> tuple[list[dict], str | None]:
    """(rows, None), or after `attempts` failures ([], the last error). With `least` an answer of fewer rows is a failure."""
    error = None
    for n in range(attempts):
        if pace:
            pace.wait()
        try:
            rows = fetch(window.ticker, window.first, window.last)
            if len(rows) >= least:
                return rows, None
            error = f"{len(rows)} rows"
        except FEED_ERRORS as e:
            error = f"{type(e).__name__}: {e}"
        if backoff and n + 1 < attempts:
            time.sleep(backoff)
    return [], error


class _Reader(DataSourceReader):
    """One partition a window; its rows, then one row about the window. `rate` is parted among the tasks that run at once."""

    def __init__(self, windows: list[DayWindow], fetch: Fetch, row: Callable[[DayWindow, dict, list[dict]], tuple], width: int, share: float, backoff: float, least: int):
        self.windows, self.fetch, self.row, self.width, self.share, self.backoff, self.least = windows, fetch, row, width, share, backoff, least

    def partitions(self) -> list[DayWindow]:
        return self.windows

    def read(self, partition: DayWindow) -> Iterator[tuple]:
        pace = pacer(self.share) if self.share else None
        rows, error = pull(self.fetch, partition, backoff=self.backoff, pace=pace, least=self.least)
        for r in rows:
            yield (*self.row(partition, r, rows), None, None, None, None, None)
        yield (*[None] * self.width, partition.ticker, partition.first, partition.last, len(rows), error)
        if pace:
            pace.hold()


def _read(spark: SparkSession, source: str, columns: str, windows: list[DayWindow], fetch: Fetch, row: Callable, rate: float, backoff: float, least: int) -> DataFrame:
    ship(spark)
    share = rate / max(1, min(len(windows), spark.sparkContext.defaultParallelism)) if rate else 0.0
    reader = _Reader(windows, fetch, row, columns.count(",") + 1, share, backoff, least)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return source

        def schema(self) -> str:
            return f"{columns}, {STATUS}"

        def reader(self, schema) -> DataSourceReader:
            return reader

    spark.dataSource.register(Source)
    return spark.read.format(source).load()


def _time(seconds: float) -> dt.datetime:
    return dt.datetime.fromtimestamp(seconds, dt.timezone.utc)


def _article(window: DayWindow, r: dict, rows: list[dict]) -> tuple:
    return (r["id"], r.get("headline"), r.get("summary"), r.get("source"), r.get("url"), _time(r["datetime"]), window.ticker, len(rows) >= FETCH_CAP)


def _bar(window: DayWindow, r: dict, rows: list[dict]) -> tuple:
    number = lambda k: None if r.get(k) is None else float(r[k])
    return (window.ticker, r["date"], number("high"), number("low"), number("close"), number("volume"))


def _earnings(window: DayWindow, r: dict, rows: list[dict]) -> tuple:
    return (window.ticker, _time(r["datetime"]))


def read_windows(spark: SparkSession, fetch: Fetch, tickers: list[str], first: str, last: str, days: int = 1, rate: float = 0.0, backoff: float = 0.0) -> DataFrame:
    """Articles of all windows, as they come, and one row about each window: read once, write it, and part it by rows_of() and report_of().

    An article that two windows return is there twice. `capped` marks the rows of a window that reached the feed's
    cap and may lack some.
    """
    windows = [w for t in tickers for w in day_windows(t, dt.date.fromisoformat(first), dt.date.fromisoformat(last), days)]
    return _read(spark, "article_windows", ARTICLES, windows, fetch, _article, rate, backoff, 0)


def read_articles(spark: SparkSession, fetch: Fetch, tickers: list[str], first: str, last: str, days: int = 1, rate: float = 0.0, backoff: float = 0.0) -> DataFrame:
    """The articles alone."""
    return rows_of(read_windows(spark, fetch, tickers, first, last, days, rate, backoff))


def read_prices(spark: SparkSession, fetch: Fetch, symbols: list[str], first: str, last: str, pad: int = PAD_DAYS, rate: float = 0.0, backoff: float = 0.0) -> DataFrame:
    """Daily bars of each symbol from `pad` days before `first` to as many after `last`, and one row about each symbol.

    fetch gives rows of date, high, low, close, volume. A symbol without bars is tried again and then reported, as one
    that is the benchmark would null every label.
    """
    start, end = dt.date.fromisoformat(first) - dt.timedelta(days=pad), dt.date.fromisoformat(last) + dt.timedelta(days=pad)
    return _read(spark, "price_bars", BARS, [DayWindow(s, start, end) for s in sorted(set(symbols))], fetch, _bar, rate, backoff, 1)


def read_earnings(spark: SparkSession, fetch: Fetch, tickers: list[str], first: str, last: str, rate: float = 0.0, backoff: float = 0.0) -> DataFrame:
    """Earnings times of each ticker from `first` on, in any order, and one row about each ticker; fetch gives rows of datetime (UNIX seconds)."""
    start, end = dt.date.fromisoformat(first), dt.date.fromisoformat(last)
    later = lambda t, a, b: [r for r in fetch(t, a, b) if _time(r["datetime"]).date() >= a]
    return _read(spark, "earnings_days", EARNINGS, [DayWindow(t, start, end) for t in sorted(set(tickers))], later, _earnings, rate, backoff, 1)


def rows_of(read: DataFrame) -> DataFrame:
    """What the feed returned."""
    return read.where("window_ticker is null").drop("window_ticker", "window_first", "window_last", "window_rows", "window_error")


def report_of(read: DataFrame) -> DataFrame:
    """(window_ticker, window_first, window_last, window_rows, window_error), one row a window; the error is NULL where it was read."""
    return read.where("window_ticker is not null").select("window_ticker", "window_first", "window_last", "window_rows", "window_error")
