import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import integrity, market, pit

UTC = dt.timezone.utc


def at(text):
    return dt.datetime.fromisoformat(text).replace(tzinfo=UTC)


def series(spark, closes, start="2025-01-01", symbol="T", volumes=None):
    days = pd.bdate_range(start, periods=len(closes))
    rows = [(symbol, d.date(), c * 1.02, c * 0.98, float(c), float(volumes[i] if volumes else 1000 + i)) for i, (d, c) in enumerate(zip(days, closes))]
    return spark.createDataFrame(rows, "symbol string, bar_date date, high double, low double, close double, volume double")


def articles(spark, times, ticker="T"):
    return spark.createDataFrame([(i, ticker, at(t)) for i, t in enumerate(times)], "article_id long, ticker string, timestamp_utc timestamp")


@pytest.mark.parametrize(
    "time,opens",
    [
        ("2025-01-03T15:00:00", "2025-01-06"),  # Friday in the session
        ("2025-01-06T14:30:00", "2025-01-07"),  # exactly at the open
        ("2025-01-06T14:29:59", "2025-01-06"),
        ("2025-01-05T12:00:00", "2025-01-06"),  # Sunday
        ("2025-01-08T22:00:00", "2025-01-10"),  # before a holiday
    ],
)
def test_next_open(spark, time, opens):
    off = spark.createDataFrame([(dt.date(2025, 1, 9),)], "date date")
    schedule = pit.weekday_calendar(spark, "2025-01-01", "2025-01-31", holidays=off)
    row = pit.align_next_open(articles(spark, [time]), schedule).select(F.date_format("session_open", "yyyy-MM-dd HH:mm")).first()
    assert row[0] == f"{opens} 14:30"


@pytest.mark.parametrize("time", ["2025-01-01T10:00:00", "2025-01-31T14:30:00"])
def test_outside_the_calendar_raises(spark, time):
    schedule = pit.weekday_calendar(spark, "2025-01-01", "2025-01-31")
    with pytest.raises(Exception, match="outside the calendar"):
        pit.align_next_open(articles(spark, [time]), schedule).collect()
    assert pit.align_next_open(articles(spark, [time]), schedule, strict=False).first()["session_open"] is None


def test_session_bucket_bounds(spark):
    schedule = pit.weekday_calendar(spark, "2025-01-01", "2025-01-31")
    schedule = schedule.unionByName(schedule.limit(1))
    times = ["2025-01-06T14:29:59", "2025-01-06T14:30:00", "2025-01-06T21:00:00", "2025-01-06T21:00:01", "2025-01-05T15:00:00"]
    got = [r.session for r in pit.session_bucket(articles(spark, times), schedule).orderBy("article_id").collect()]
    assert got == ["pre-market", "market-hours", "market-hours", "after-hours", "after-hours"]


CLOSES = [100, 102, 104, 103, 106, 108, 107, 110, 112, 111, 114, 116, 119, 117, 121, 124, 120, 126, 128, 127, 131, 133, 130, 136]


def features_at(spark, bars, bench, time):
    f = market.bar_features(bars).withColumnRenamed("symbol", "ticker")
    b = market.betas(bars, bench).withColumnRenamed("symbol", "ticker")
    out = pit.as_of_previous_bar(articles(spark, [time]), f, by="ticker").drop("bar_date")
    return pit.as_of_previous_bar(out, b, by="ticker").drop("bar_date").first().asDict()


def test_features_by_definition(spark):
    bars, bench = series(spark, CLOSES), [100 + 0.5 * i + (i % 3) for i in range(len(CLOSES))]
    days = pd.bdate_range("2025-01-01", periods=len(CLOSES))
    benchmark = spark.createDataFrame([(d.date(), float(c)) for d, c in zip(days, bench)], "bar_date date, market_close double")
    got = features_at(spark, bars, benchmark, f"{days[22].date()}T15:30:00")
    past = np.array(CLOSES[:22], float)
    ret = past[1:] / past[:-1] - 1
    assert got["momentum_1d"] == pytest.approx(past[-1] / past[-2] - 1)
    assert got["momentum_20d"] == pytest.approx(past[-1] / past[-21] - 1)
    assert got["volatility_20d"] == pytest.approx(ret[-19:].std(ddof=1))
    m = np.array(bench[:22])
    mret = m[1:] / m[:-1] - 1
    assert got["beta_20d"] == pytest.approx(np.polyfit(mret[-19:], ret[-19:], 1)[0])
    v = np.array([1000 + i for i in range(22)], float)
    assert got["relative_volume_20d"] == pytest.approx(v[-1] / np.median(v[-20:]))
    assert got["daily_range_ratio_1d"] == pytest.approx(0.04)


def test_same_day_bar_is_never_seen(spark):
    days = pd.bdate_range("2025-01-01", periods=len(CLOSES))
    benchmark = spark.createDataFrame([(d.date(), 100.0 + i + i % 4) for i, d in enumerate(days)], "bar_date date, market_close double")
    day = days[15].date()
    other = CLOSES[:15] + [9999] + CLOSES[16:]
    for time in ("00:00:00", "00:00:01", "08:00:00", "23:59:59"):
        assert features_at(spark, series(spark, CLOSES), benchmark, f"{day}T{time}") == features_at(spark, series(spark, other), benchmark, f"{day}T{time}")


def test_short_history_is_missing(spark):
    days = pd.bdate_range("2025-01-01", periods=2)
    benchmark = spark.createDataFrame([(d.date(), 100.0) for d in days], "bar_date date, market_close double")
    got = features_at(spark, series(spark, CLOSES[:2]), benchmark, "2025-02-01T00:00:00")
    assert got["momentum_1d"] == pytest.approx(0.02) and got["momentum_5d"] is None and got["volatility_20d"] is None and got["beta_20d"] is None
    none = features_at(spark, series(spark, CLOSES[:2]), benchmark, "2025-01-01T12:00:00")
    assert none["momentum_1d"] is None and none["relative_volume_20d"] is None


def test_flat_benchmark_has_no_beta(spark):
    days = pd.bdate_range("2025-01-01", periods=len(CLOSES))
    benchmark = spark.createDataFrame([(d.date(), 100.0) for d in days], "bar_date date, market_close double")
    assert features_at(spark, series(spark, CLOSES), benchmark, "2025-03-01T00:00:00")["beta_20d"] is None


def test_news_volume_matches_definition(spark):
    rng = random.Random(0)
    start = at("2025-01-01T00:00:00")
    rows = [(i, rng.choice("AB"), start + dt.timedelta(hours=rng.randint(0, 240), minutes=rng.choice([0, 0, 30]))) for i in range(300)]
    df = spark.createDataFrame(rows, "article_id long, ticker string, timestamp_utc timestamp")
    got = {r.article_id: r.news_volume for r in market.news_volume(df).collect()}
    three = dt.timedelta(days=3)
    for i, k, t in rows:
        assert got[i] == sum(1 for _, k2, t2 in rows if k2 == k and t - three <= t2 < t)


def test_days_to_next_in_any_order(spark):
    a = articles(spark, ["2025-01-06T10:00:00", "2025-01-10T23:00:00", "2025-03-01T00:00:00"])
    e = spark.createDataFrame([("T", at("2025-02-01T21:00:00")), ("T", at("2025-01-10T21:00:00")), ("X", at("2025-01-07T00:00:00")), ("T", None)], "ticker string, earnings_ts timestamp")
    got = [r.days_to_earnings for r in market.days_to_next(a, e, "ticker", "timestamp_utc", "earnings_ts").orderBy("article_id").collect()]
    assert got == [4, 0, None]


def drifting(spark):
    bars = series(spark, [100 * 1.01**i for i in range(40)])
    days = pd.bdate_range("2025-01-01", periods=40)
    return bars, spark.createDataFrame([(d.date(), 400 * 1.005**i) for i, d in enumerate(days)], "bar_date date, market_close double")


def test_market_table(spark):
    bars, benchmark = drifting(spark)
    schedule = pit.weekday_calendar(spark, "2025-01-01", "2025-03-31")
    a = articles(spark, ["2025-01-20T12:30:00", "2025-01-20T16:30:00", "2025-01-20T23:00:00", "2025-03-20T10:00:00"])
    got = market.build_market_features(a, bars, benchmark, schedule)
    assert got.columns == market.MARKET_COLUMNS
    rows = got.orderBy("article_id").collect()
    assert [r.article_id for r in rows] == [0, 1, 2]  # the last has no bar for its session
    assert [r.session for r in rows] == ["pre-market", "market-hours", "after-hours"]
    assert all(r.abnormal_return_1d == pytest.approx(0.005) and r.label_direction == 1 for r in rows)
    assert [r.news_volume for r in rows] == [0, 1, 2]


def test_session_return_stops_at_the_last_bar(spark):
    bars, benchmark = drifting(spark)
    got = {r.bar_date: r.abnormal_return_3d for r in market.session_returns(bars, benchmark, 3).collect()}
    days = sorted(got)
    assert got[days[0]] is None
    assert got[days[5]] == pytest.approx(1.01**3 - 1.005**3)
    assert got[days[-1]] == pytest.approx(0.005)


@pytest.mark.parametrize("leaky", [False, True])
def test_leakage_is_caught_only_when_there(spark, leaky):
    closes = [100 + 3 * i for i in range(20)]
    bars = series(spark, closes)
    days = pd.bdate_range("2025-01-01", periods=20)
    rows = []
    for i in range(5, 20):
        last = i if leaky else i - 1
        rows.append((i, "T", at(f"{days[i].date()}T15:00:00"), "market-hours", closes[last] / closes[last - 1] - 1))
    df = spark.createDataFrame(rows, "article_id long, ticker string, timestamp_utc timestamp, session string, momentum_1d double")
    s = integrity.leakage_summary(integrity.leakage_rows(df, bars)).first()
    assert s.passed is not leaky and s.real_leaks == (15 if leaky else 0) and s.rows_tested == 15


def test_weekend_article_is_ambiguous_and_null_fails(spark):
    bars = series(spark, [100 + 3 * i for i in range(10)])
    df = spark.createDataFrame([(1, "T", at("2025-01-11T15:00:00"), "after-hours", 121 / 118 - 1), (2, "T", at("2025-01-09T15:00:00"), "market-hours", None)], "article_id long, ticker string, timestamp_utc timestamp, session string, momentum_1d double")
    rows = {r.article_id: r for r in integrity.leakage_rows(df, bars).collect()}
    assert rows[1].ambiguous and not rows[1].real_leak and not rows[2].matches_correct
    assert integrity.leakage_summary(integrity.leakage_rows(df, bars)).first().passed is False


def test_merge_raises_on_repeats(spark):
    t = spark.createDataFrame([(1, 0.5), (2, 0.1)], "article_id long, score double")
    m = spark.createDataFrame([(1, "T", 3.0), (3, "T", 4.0)], "article_id long, ticker string, price double")
    assert [tuple(r) for r in integrity.merge_validated(t, m).collect()] == [(1, 0.5, 3.0)]
    with pytest.raises(Exception, match="repeats in the text"):
        integrity.merge_validated(t.union(t), m).collect()
    with pytest.raises(Exception, match="repeats in the market"):
        integrity.merge_validated(t, m.union(m)).collect()
    a = integrity.merge_accounting(t, m).first()
    assert (a.merged_rows, a.text_only, a.market_only, a.join_rate) == (1, 1, 1, 0.5)


def test_pool(spark):
    df = spark.createDataFrame([(1, "A"), (1, "B")], "article_id long, ticker string")
    assert integrity.pool([df.where("ticker = 'A'"), df.where("ticker = 'B'")]).count() == 2
    with pytest.raises(Exception, match="repeats in the pooled"):
        integrity.pool([df, df]).collect()
    with pytest.raises(ValueError):
        integrity.pool([])


def test_checks(spark):
    df = spark.createDataFrame([(i % 30, i) for i in range(60)], "article_id long, x long")
    check = integrity.check_unique(df, "t").first()
    assert not check.passed and check.n_offenders == 30 and len(check.offenders) == 20
    none = integrity.check_same_article(df.withColumn("timestamp_utc", F.lit(1)), df, "t").first()
    assert none.passed
    with pytest.raises(RuntimeError):
        integrity.require_signal(spark.createDataFrame([("unsure",), (None,)], "answer string"))
    assert integrity.require_signal(spark.createDataFrame([], "answer string")).count() == 0


def test_long_bars(spark):
    wide = spark.createDataFrame([(dt.date(2025, 1, 1), 2.0, 1.0, 1.5, 10.0)], "Date date, high_A double, low_A double, close_A double, volume_A double")
    assert [tuple(r) for r in market.long_bars(wide, ["A"]).collect()] == [("A", dt.date(2025, 1, 1), 2.0, 1.0, 1.5, 10.0)]
    with pytest.raises(KeyError):
        market.long_bars(wide, ["A", "B"])


def test_as_of_plan_is_an_equality_join(spark):
    schedule = pit.weekday_calendar(spark, "2025-01-01", "2025-01-31")
    plan = pit.align_next_open(articles(spark, ["2025-01-06T10:00:00"]), schedule)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan
