"""Registered queries of the point-in-time, market, merge and coverage operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidemark.operators import aggregates, coverage, integrity, market, pit
from tidemark.plans.inputs import ART, BARS, CAL, ORD, POOLED, articles, bars, benchmark, calendar, ntz, order_articles, pooled, r6, r9, registry, table

QUERIES: dict = {}
ORACLES: dict = {}
query = registry(QUERIES, ORACLES)


_MEANS = {
    "entity_share": "(i % 5) / (i % 11 + 1)", "has_ceo_mention": "CAST(i % 3 > 0 AS DOUBLE)", "fus_sentiment_mean": "xm", "fus_median": "x * 0.9", "fus_lead": "x * 0.5", "fus_top3_pos": "abs(x)", "fus_top3_neg": "-abs(x)",
    "fus_spread": "abs(x) * 2", "fus_ceo_mean": "CASE WHEN i % 4 = 0 THEN x END", "fus_headline": "x * 0.8", "fus_maxmag": "x", "fus_trusted_mean": "x * 0.7", "fus_scorer_gap": "abs(x) / 2", "fus_headline_gap": "x * 0.1", "fus_lead_gap": "-x * 0.1",
}
_SUMS = {"n_total_sents": "i % 11 + 1", "n_entity_sents": "i % 5", "n_ceo_sents": "i % 3", "n_boilerplate_sents": "i % 2", "article_length": "i % 1000"}
_SNAP = ["momentum_1d", "momentum_5d", "momentum_20d", "volatility_20d", "beta_20d", "relative_volume_20d", "daily_range_ratio_1d"]
_SHARE = {"published_pre-market_share": "pre-market", "published_market-hours_share": "market-hours", "published_after-hours_share": "after-hours"}


@query(f"""WITH {POOLED}
SELECT session_open, ticker, max(ts) AS timestamp_utc, CAST(sign(min(lab)) AS INTEGER) AS label_direction, round(min(lab) / 100.0, 9) + 0.0 AS abnormal_return_1d,
  count(*) AS n_articles, count(DISTINCT source) AS n_sources, {", ".join(f"CAST(sum({e}) AS BIGINT) AS {n}" for n, e in _SUMS.items())},
  {", ".join(f"round(avg({e}), 9) + 0.0 AS {n}" for n, e in _MEANS.items())},
  round(coalesce(stddev_samp(xm), 0), 9) + 0.0 AS fus_sentiment_std,
  round(arg_max(xm, {{'a': abs(xm), 't': -epoch_us(ts), 'i': -i}}) FILTER (xm IS NOT NULL), 9) + 0.0 AS fus_sentiment_loudest,
  {", ".join(f"round(arg_max((i % {7 + k}) / 100.0, {{'t': ts, 'i': -i}}), 9) + 0.0 AS {n}" for k, n in enumerate(_SNAP))},
  CAST(arg_max(i % 90, {{'t': ts, 'i': -i}}) AS INTEGER) AS days_to_earnings, CAST(arg_max(i % 17, {{'t': ts, 'i': -i}}) AS BIGINT) AS news_volume,
  {", ".join(f'round(avg(CASE WHEN session = {chr(39)}{s}{chr(39)} THEN 1.0 ELSE 0.0 END), 9) AS "{n}"' for n, s in _SHARE.items())}
FROM pooled GROUP BY session_open, ticker""", times=("session_open", "timestamp_utc"))
def session_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.session_table(pooled(spark, sf_dir))
    doubles = [c for c, t in out.dtypes if t == "double"]
    return out.withColumns({c: r9(c) for c in doubles} | {"session_open": ntz("session_open"), "timestamp_utc": ntz("timestamp_utc")})


@query(f"WITH {ART}, {CAL} SELECT a.article_id, n.op AS session_open FROM art a ASOF JOIN cal n ON a.ts < n.op", times=("session_open",))
def asof_next_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.align_next_open(articles(spark, sf_dir), calendar(spark)).select("article_id", ntz("session_open").alias("session_open"))


@query(f"""WITH {ART}, {CAL} SELECT a.article_id, CASE WHEN c.d IS NULL THEN 'after-hours' WHEN a.ts < c.op THEN 'pre-market' WHEN a.ts <= c.cl THEN 'market-hours' ELSE 'after-hours' END AS session
FROM art a LEFT JOIN cal c ON CAST(a.ts AS DATE) = c.d""")
def session_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.session_bucket(articles(spark, sf_dir), calendar(spark)).select("article_id", "session")


#: Days of 2024 without a session, and with an early close.
HOLIDAYS = ["2024-01-01", "2024-01-15", "2024-02-19", "2024-03-29", "2024-05-27", "2024-06-19", "2024-07-04", "2024-09-02", "2024-11-28", "2024-12-25"]
EARLY = {"2024-07-03": "13:00:00", "2024-11-29": "13:00:00", "2024-12-24": "13:00:00"}


@query(f"""WITH d AS (SELECT CAST(d AS DATE) AS d FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2025-01-01', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6 AND CAST(d AS DATE) NOT IN ({', '.join(f"DATE '{h}'" for h in HOLIDAYS)})),
  z AS (SELECT d, CASE WHEN d >= DATE '2024-03-10' AND d < DATE '2024-11-03' THEN 240 ELSE 300 END AS ahead FROM d)
SELECT d + to_minutes(570 + ahead) AS market_open, d + to_minutes(CASE WHEN d IN ({', '.join(f"DATE '{e}'" for e in EARLY)}) THEN 780 ELSE 960 END + ahead) AS market_close FROM z""", times=("market_open", "market_close"))
def trading_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New York's sessions of 2024: both changes of summer time, holidays, early closes."""
    days = pit.exchange_calendar(spark, "2024-01-01", "2024-12-31", holidays=HOLIDAYS, early=EARLY)
    return days.select(ntz("market_open").alias("market_open"), ntz("market_close").alias("market_close"))


def _features(spark, sf_dir, *columns):
    return market.bar_features(bars(spark, sf_dir)).select("symbol", "bar_date", *[r6(c).alias(c) for c in columns])


_BAR_W = "WINDOW w AS (PARTITION BY symbol ORDER BY bar_date)"
_RET = f"rets AS (SELECT *, close / lag(close) OVER w - 1 AS ret FROM bars {_BAR_W})"


@query(f"WITH {BARS} SELECT symbol, bar_date, {', '.join(f'round(close / lag(close, {k}) OVER w - 1, 6) + 0.0 AS momentum_{k}d' for k in (1, 5, 20))} FROM bars {_BAR_W}", days=("bar_date",))
def momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, "momentum_1d", "momentum_5d", "momentum_20d")


@query(f"WITH {BARS}, {_RET} SELECT symbol, bar_date, round(stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY bar_date ROWS 18 PRECEDING), 6) + 0.0 AS volatility_20d FROM rets", days=("bar_date",))
def volatility_20d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, "volatility_20d")


@query(f"WITH {BARS} SELECT symbol, bar_date, round(volume / nullif(median(volume) OVER (PARTITION BY symbol ORDER BY bar_date ROWS 19 PRECEDING), 0), 6) + 0.0 AS relative_volume_20d FROM bars", days=("bar_date",))
def relative_volume_20d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, "relative_volume_20d")


@query(f"WITH {BARS} SELECT symbol, bar_date, round((high - low) / nullif(close, 0), 6) + 0.0 AS daily_range_ratio_1d FROM bars", days=("bar_date",))
def daily_range_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, "daily_range_ratio_1d")


_BETA = """joint AS (SELECT s.symbol, n.bar_date, b.close, n.market_close FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN bench n LEFT JOIN bars b ON b.symbol = s.symbol AND b.bar_date = n.bar_date),
  moves AS (SELECT *, market_close / lag(market_close) OVER w - 1 AS x0, close / lag(close) OVER w - 1 AS y0, row_number() OVER w AS n FROM joint WINDOW w AS (PARTITION BY symbol ORDER BY bar_date)),
  xy AS (SELECT *, CASE WHEN y0 IS NOT NULL THEN x0 END AS x, CASE WHEN x0 IS NOT NULL THEN y0 END AS y FROM moves),
  slopes AS (SELECT symbol, bar_date, CASE WHEN n >= 3 AND min(x) OVER f < max(x) OVER f AND min(y) OVER f < max(y) OVER f THEN regr_slope(y, x) OVER f END AS b
    FROM xy WINDOW f AS (PARTITION BY symbol ORDER BY bar_date ROWS 18 PRECEDING))"""


@query(f"WITH {BARS}, {_BETA} SELECT symbol, bar_date, round(CASE WHEN isnan(b) THEN NULL ELSE b END, 4) + 0.0 AS beta_20d FROM slopes", days=("bar_date",))
def beta_20d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.betas(bars(spark, sf_dir), benchmark(spark, sf_dir)).select("symbol", "bar_date", (F.round("beta_20d", 4) + 0.0).alias("beta_20d"))


@query(f"""WITH {BARS}, {ORD}, f AS (SELECT symbol, bar_date, close / lag(close) OVER w - 1 AS m FROM bars {_BAR_W})
SELECT a.article_id, f.bar_date, round(f.m, 6) + 0.0 AS momentum_1d FROM ord a ASOF LEFT JOIN f ON a.ticker = f.symbol AND CAST(a.ts AS DATE) > f.bar_date""", days=("bar_date",))
def asof_previous_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = market.bar_features(bars(spark, sf_dir)).select(F.col("symbol").alias("ticker"), "bar_date", "momentum_1d")
    return pit.as_of_previous_bar(order_articles(spark, sf_dir), f, by="ticker").select("article_id", "bar_date", r6("momentum_1d").alias("momentum_1d"))


@query("SELECT event_id AS article_id, CAST((SELECT 0) + count(*) OVER (PARTITION BY user_id % 4 ORDER BY epoch_us(ts) RANGE BETWEEN 259200000000 PRECEDING AND 1 PRECEDING) AS BIGINT) AS news_volume FROM events")
def news_volume_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.news_volume(articles(spark, sf_dir)).select("article_id", "news_volume")


#: Orders in part delivered stand for earnings days.
_EARN = "earn AS (SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus = 'P')"


def _earnings(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").cast("timestamp").alias("earnings_ts"))


@query(f"""WITH {ORD}, {_EARN} SELECT a.article_id, CAST(datediff('day', CAST(a.ts AS DATE), e.d) AS INTEGER) AS days_to_earnings
FROM ord a ASOF LEFT JOIN (SELECT DISTINCT ticker, d FROM earn) e ON a.ticker = e.ticker AND CAST(a.ts AS DATE) <= e.d""")
def next_event_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.days_to_next(order_articles(spark, sf_dir), _earnings(spark, sf_dir), "ticker", "timestamp_utc", "earnings_ts").select("article_id", "days_to_earnings")


_LABEL = f"""lab AS (SELECT b.symbol, b.bar_date, b.close / lag(b.close) OVER w - n.market_close / lag(n.market_close) OVER w AS r
    FROM bars b LEFT JOIN bench n USING (bar_date) WINDOW w AS (PARTITION BY b.symbol ORDER BY bar_date))"""


@query(f"WITH {BARS}, {_LABEL} SELECT symbol, bar_date, round(r, 6) + 0.0 AS abnormal_return_1d, CAST(coalesce(sign(round(r, 9)), 0) AS INTEGER) AS label_direction FROM lab", days=("bar_date",))
def abnormal_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.functions.scores import direction

    out = market.session_returns(bars(spark, sf_dir), benchmark(spark, sf_dir))
    return out.select("symbol", "bar_date", r6("abnormal_return_1d").alias("abnormal_return_1d"), direction(F.round("abnormal_return_1d", 9)).alias("label_direction"))


@query(f"""WITH {BARS}, p AS (SELECT b.symbol, b.bar_date, lag(b.close) OVER w AS c0, lag(n.market_close) OVER w AS m0,
    last_value(b.close) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS c1, last_value(n.market_close) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS m1
    FROM bars b LEFT JOIN bench n USING (bar_date) WINDOW w AS (PARTITION BY b.symbol ORDER BY bar_date))
SELECT symbol, bar_date, round(c1 / c0 - m1 / m0, 6) + 0.0 AS abnormal_return_3d FROM p""", days=("bar_date",))
def abnormal_return_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.session_returns(bars(spark, sf_dir), benchmark(spark, sf_dir), 3).select("symbol", "bar_date", r6("abnormal_return_3d").alias("abnormal_return_3d"))


def _market(spark, sf_dir):
    a = order_articles(spark, sf_dir)
    span = pit.exchange_calendar(spark, "1991-12-01", "2002-01-31")
    return market.build_market_features(a, bars(spark, sf_dir), benchmark(spark, sf_dir), span, _earnings(spark, sf_dir))


_MARKET_SQL = f"""{BARS}, {ORD}, {_EARN}, {_RET}, {_BETA}, {_LABEL},
  -- Summer time of those years: from the first Sunday of April to the last of October.
  cal AS (SELECT CAST(d AS DATE) AS d, d + to_minutes(570 + ahead) AS op, d + to_minutes(960 + ahead) AS cl
    FROM (SELECT d, CASE WHEN d >= a + to_days(CAST((7 - isodow(a)) % 7 AS INTEGER)) AND d < o - to_days(CAST(isodow(o) % 7 AS INTEGER)) THEN 240 ELSE 300 END AS ahead
      FROM (SELECT d, make_date(year(d), 4, 1) AS a, make_date(year(d), 10, 31) AS o FROM range(TIMESTAMP '1991-12-01', TIMESTAMP '2002-02-01', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6))),
  f AS (SELECT symbol, bar_date, close / lag(close, 1) OVER w - 1 AS m1, close / lag(close, 5) OVER w - 1 AS m5, close / lag(close, 20) OVER w - 1 AS m20,
    stddev_samp(ret) OVER (w ROWS 18 PRECEDING) AS vol, volume / nullif(median(volume) OVER (w ROWS 19 PRECEDING), 0) AS rv, (high - low) / nullif(close, 0) AS dr FROM rets {_BAR_W}),
  e AS (SELECT DISTINCT ticker, d FROM earn),
  a1 AS (SELECT *, CAST(count(*) OVER (PARTITION BY ticker ORDER BY epoch_us(ts) RANGE BETWEEN 259200000000 PRECEDING AND 1 PRECEDING) AS BIGINT) AS news_volume, CAST(ts AS DATE) AS day FROM ord),
  a2 AS (SELECT a.*, n.op AS session_open FROM a1 a ASOF JOIN cal n ON a.ts < n.op),
  a3 AS (SELECT a.*, f.m1, f.m5, f.m20, f.vol, f.rv, f.dr FROM a2 a ASOF LEFT JOIN f ON a.ticker = f.symbol AND a.day > f.bar_date),
  a4 AS (SELECT a.*, s.b FROM a3 a ASOF LEFT JOIN slopes s ON a.ticker = s.symbol AND a.day > s.bar_date),
  a5 AS (SELECT a.*, e.d AS next FROM a4 a ASOF LEFT JOIN e ON a.ticker = e.ticker AND a.day <= e.d),
  mkt AS (SELECT a.article_id, a.ticker, a.ts AS timestamp_utc, a.session_open, l.r AS abnormal_return_1d, CAST(coalesce(sign(round(l.r, 9)), 0) AS INTEGER) AS label_direction, a.m1 AS momentum_1d, a.m5 AS momentum_5d, a.m20 AS momentum_20d,
    a.vol AS volatility_20d, CASE WHEN isnan(a.b) THEN NULL ELSE a.b END AS beta_20d, a.rv AS relative_volume_20d, a.dr AS daily_range_ratio_1d, CAST(datediff('day', a.day, a.next) AS INTEGER) AS days_to_earnings,
    CASE WHEN c.d IS NULL THEN 'after-hours' WHEN a.ts < c.op THEN 'pre-market' WHEN a.ts <= c.cl THEN 'market-hours' ELSE 'after-hours' END AS session, a.news_volume
    FROM a5 a JOIN lab l ON a.ticker = l.symbol AND CAST(a.session_open AS DATE) = l.bar_date LEFT JOIN cal c ON a.day = c.d WHERE l.r IS NOT NULL)"""
_DIGITS = {"beta_20d": 4}
_MARKET_DOUBLES = ["abnormal_return_1d", "momentum_1d", "momentum_5d", "momentum_20d", "volatility_20d", "beta_20d", "relative_volume_20d", "daily_range_ratio_1d"]


@query(f"WITH {_MARKET_SQL} SELECT * REPLACE ({', '.join(f'round({c}, {4 if c == chr(98) + "eta_20d" else 6}) + 0.0 AS {c}' for c in _MARKET_DOUBLES)}) FROM mkt", times=("timestamp_utc", "session_open"))
def market_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _market(spark, sf_dir)
    return out.withColumns({c: r6(c) for c in _MARKET_DOUBLES} | {"beta_20d": F.round("beta_20d", 4) + 0.0, "timestamp_utc": ntz("timestamp_utc"), "session_open": ntz("session_open")})


def _text_side(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("article_id")).agg(F.max("l_quantity").alias("score"), F.max("l_shipdate").alias("timestamp_utc"))


def _market_side(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_id"), F.lit("T").alias("ticker"), F.col("o_orderdate").alias("timestamp_utc"), F.col("o_totalprice").alias("price"))


_SIDES = """l AS (SELECT l_orderkey AS article_id, max(l_quantity) AS score, max(l_shipdate) AS timestamp_utc FROM lineitem GROUP BY 1),
  r AS (SELECT o_orderkey AS article_id, 'T' AS ticker, o_orderdate AS timestamp_utc, o_totalprice AS price FROM orders)"""


@query(f"WITH {_SIDES} SELECT l.article_id, l.score, l.timestamp_utc, r.price FROM l JOIN r USING (article_id)", times=("timestamp_utc",))
def merge_inner_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.merge_validated(_text_side(spark, sf_dir), _market_side(spark, sf_dir))


@query(f"""WITH {_SIDES}, g AS (SELECT l.article_id IS NOT NULL AS a, r.article_id IS NOT NULL AS b FROM l FULL JOIN r USING (article_id))
SELECT CAST(count(*) FILTER (a) AS BIGINT) AS text_rows, CAST(count(*) FILTER (b) AS BIGINT) AS market_rows, CAST(count(*) FILTER (a AND b) AS BIGINT) AS merged_rows, CAST(count(*) FILTER (a AND NOT b) AS BIGINT) AS text_only,
  CAST(count(*) FILTER (b AND NOT a) AS BIGINT) AS market_only, round(count(*) FILTER (a AND b) / count(*) FILTER (a), 6) + 0.0 AS join_rate FROM g""")
def merge_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = integrity.merge_accounting(_text_side(spark, sf_dir), _market_side(spark, sf_dir))
    return out.withColumn("join_rate", r6("join_rate"))


@query(f"WITH {_SIDES} SELECT article_id, CASE WHEN l.article_id IS NULL THEN 'right' ELSE 'left' END AS side FROM l FULL JOIN r USING (article_id) WHERE l.article_id IS NULL OR r.article_id IS NULL")
def dropped_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.dropped_rows(_text_side(spark, sf_dir), _market_side(spark, sf_dir))


def _flat(check: DataFrame) -> DataFrame:
    return check.select("name", "passed", "n_offenders", F.array_join("offenders", ",").alias("offenders"))


@query("""WITH d AS (SELECT l_orderkey AS k FROM lineitem GROUP BY 1 HAVING count(*) > 1)
SELECT 'article_id is unique within lines' AS name, count(*) = 0 AS passed, count(*) AS n_offenders, (SELECT coalesce(string_agg(k, ',' ORDER BY k), '') FROM (SELECT CAST(k AS VARCHAR) AS k FROM d ORDER BY 1 LIMIT 20)) AS offenders FROM d""")
def unique_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(integrity.check_unique(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "article_id"), "lines"))


@query("""WITH d AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'))
SELECT 'every lines article_id exists in the corpus' AS name, count(*) = 0 AS passed, count(*) AS n_offenders, (SELECT coalesce(string_agg(k, ',' ORDER BY k), '') FROM (SELECT CAST(k AS VARCHAR) AS k FROM d ORDER BY 1 LIMIT 20)) AS offenders FROM d""")
def subset_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("article_id"))
    corpus = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("article_id"))
    return _flat(integrity.check_subset(lines, corpus, "lines"))


@query(f"""WITH {_SIDES}, d AS (SELECT l.article_id AS k FROM l JOIN r USING (article_id) WHERE l.timestamp_utc IS DISTINCT FROM r.timestamp_utc)
SELECT 'one article_id means one article (text vs market)' AS name, count(*) = 0 AS passed, count(*) AS n_offenders, (SELECT coalesce(string_agg(k, ',' ORDER BY k), '') FROM (SELECT CAST(k AS VARCHAR) AS k FROM d ORDER BY 1 LIMIT 20)) AS offenders FROM d""")
def witness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(integrity.check_same_article(_text_side(spark, sf_dir), _market_side(spark, sf_dir), "text vs market"))


_CORP = "corp AS (SELECT DISTINCT event_type AS ticker, user_id AS article_id, CASE WHEN user_id % 19 = 0 THEN event_type ELSE 'same' END AS headline FROM events)"


def _corpora(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("ticker"), F.col("user_id").alias("article_id"), F.when(F.col("user_id") % 19 == 0, F.col("event_type")).otherwise("same").alias("headline"))


@query(f"WITH {_CORP} SELECT a.ticker AS a, b.ticker AS b, a.article_id FROM corp a JOIN corp b ON a.article_id = b.article_id AND a.ticker < b.ticker WHERE a.headline <> b.headline")
def cross_group_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.conflicting_ids(_corpora(spark, sf_dir))


@query(f"""WITH {_CORP}, d AS (SELECT a.ticker || '/' || b.ticker || ':' || CAST(a.article_id AS VARCHAR) AS k FROM corp a JOIN corp b ON a.article_id = b.article_id AND a.ticker < b.ticker WHERE a.headline <> b.headline)
SELECT 'a shared article_id is the same article in every ticker' AS name, count(*) = 0 AS passed, count(*) AS n_offenders, (SELECT coalesce(string_agg(k, ',' ORDER BY k), '') FROM (SELECT k FROM d ORDER BY 1 LIMIT 20)) AS offenders FROM d""")
def cross_group_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(integrity.check_cross_group(_corpora(spark, sf_dir)))


@query(f"""WITH {_CORP}, ids AS (SELECT DISTINCT ticker, article_id FROM corp), own AS (SELECT ticker, count(*) AS n FROM ids GROUP BY 1)
SELECT a.ticker, b.ticker AS other, count(*) AS shared_articles, round(count(*) / any_value(o.n), 6) + 0.0 AS share_of_own FROM ids a JOIN ids b ON a.article_id = b.article_id AND a.ticker <> b.ticker JOIN own o ON o.ticker = a.ticker GROUP BY 1, 2""")
def overlap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = integrity.overlap_summary(_corpora(spark, sf_dir))
    return out.withColumn("share_of_own", r6("share_of_own"))


@query("SELECT event_id AS article_id, 'T' || CAST(user_id % 4 AS VARCHAR) AS ticker, round((value - 50) / 50, 6) + 0.0 AS score FROM events")
def pooled_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = articles(spark, sf_dir).select("article_id", "ticker", r6("score").alias("score"))
    return integrity.pool([a.where(F.col("ticker") == f"T{i}") for i in range(4)])


_LEAK = f"""{_MARKET_SQL}, steps AS (SELECT symbol, bar_date, close / lag(close) OVER w - 1 AS m FROM bars {_BAR_W}),
  c1 AS (SELECT k.*, s.m AS correct FROM mkt k ASOF LEFT JOIN steps s ON k.ticker = s.symbol AND CAST(k.timestamp_utc AS DATE) > s.bar_date),
  c2 AS (SELECT c.*, s.m AS leaky FROM c1 c ASOF LEFT JOIN steps s ON c.ticker = s.symbol AND c.timestamp_utc > CAST(s.bar_date AS TIMESTAMP)),
  c3 AS (SELECT *, coalesce(abs(stored - correct) <= 1e-9 + 1e-5 * abs(correct), false) AS ok, coalesce(abs(stored - leaky) <= 1e-9 + 1e-5 * abs(leaky), false) AS bad, coalesce(abs(leaky - correct) <= 1e-9 + 1e-5 * abs(correct), false) AS amb
    FROM (SELECT *, CASE WHEN article_id % 10 = 3 THEN leaky ELSE momentum_1d END AS stored FROM c2))"""


def _tested(spark, sf_dir):
    rows = _market(spark, sf_dir).select("article_id", "ticker", "timestamp_utc", "session", "momentum_1d")
    both = integrity.cutoffs(rows, bars(spark, sf_dir))
    return integrity.leakage_flags(both.withColumn("momentum_1d", F.when(F.col("article_id") % 10 == 3, F.col("leaky")).otherwise(F.col("momentum_1d"))))


@query(f"""WITH {_LEAK} SELECT session, count(*) AS rows, count(*) FILTER (ok) AS matches_correct, count(*) FILTER (bad AND NOT amb) AS real_leaks, count(*) FILTER (amb) AS ambiguous, round(count(*) FILTER (ok) / count(*), 6) + 0.0 AS correct_rate FROM c3 GROUP BY 1""")
def leakage_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = integrity.leakage_by_session(_tested(spark, sf_dir))
    return out.withColumn("correct_rate", r6("correct_rate"))


@query(f"""WITH {_LEAK} SELECT count(*) AS rows_tested, count(*) FILTER (ok) AS matches_correct, count(*) FILTER (bad) AS matches_leaky, count(*) FILTER (amb) AS ambiguous, count(*) FILTER (bad AND NOT amb) AS real_leaks,
  count(*) FILTER (bad AND NOT amb) = 0 AND count(*) FILTER (ok) = count(*) AS passed FROM c3""")
def leakage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.leakage_summary(_tested(spark, sf_dir))


_DAYS = f"""{ORD}, cnt AS (SELECT ticker, CAST(ts AS DATE) AS day, count(*) AS n FROM ord GROUP BY 1, 2),
  spine AS (SELECT ticker, CAST(unnest(range(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM cnt GROUP BY 1),
  days AS (SELECT s.ticker, s.day, coalesce(c.n, 0) AS articles FROM spine s LEFT JOIN cnt c USING (ticker, day)),
  months AS (SELECT ticker, CAST(date_trunc('month', day) AS DATE) AS month, CAST(sum(articles) AS BIGINT) AS articles, count(*) FILTER (articles > 0) AS active_days, count(*) AS days_in_month FROM days GROUP BY 1, 2)"""


def _days(spark, sf_dir):
    return coverage.daily_counts(order_articles(spark, sf_dir), by="ticker")


@query(f"WITH {_DAYS} SELECT * FROM days", days=("day",))
def date_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir)


@query(f"WITH {_DAYS} SELECT * FROM months", days=("month",))
def monthly_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.monthly(_days(spark, sf_dir), "ticker")


@query(f"""WITH {_DAYS}, isl AS (SELECT ticker, day, articles, sum(CASE WHEN articles > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY day) AS g FROM days),
  gaps AS (SELECT ticker, max(n) AS longest FROM (SELECT ticker, g, count(*) FILTER (articles = 0) AS n FROM isl GROUP BY 1, 2) GROUP BY 1)
SELECT d.ticker, min(day) AS span_start, max(day) AS span_end, count(*) AS days_in_span, count(*) FILTER (articles > 0) AS active_days, round(count(*) FILTER (articles > 0) / count(*), 6) + 0.0 AS active_day_share, any_value(g.longest) AS longest_gap_days
FROM days d JOIN gaps g USING (ticker) GROUP BY 1""", days=("span_start", "span_end"))
def longest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage.coverage_summary(_days(spark, sf_dir), "ticker")
    return out.withColumn("active_day_share", r6("active_day_share"))


_PEAKS = f"{_DAYS}, ranked AS (SELECT ticker, month, articles, row_number() OVER (PARTITION BY ticker ORDER BY articles DESC, month) AS rank FROM months), top AS (SELECT * FROM ranked WHERE rank <= 3)"


@query(f"WITH {_PEAKS} SELECT ticker, month, articles, CAST(rank AS INTEGER) AS rank FROM top", days=("month",))
def peak_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.peak_months(coverage.monthly(_days(spark, sf_dir), "ticker"), "ticker").select("ticker", "month", "articles", "rank")


@query(f"WITH {_PEAKS} SELECT month, count(DISTINCT ticker) AS keys, count(DISTINCT ticker) = (SELECT count(DISTINCT ticker) FROM top) AS in_all FROM top GROUP BY 1 HAVING count(DISTINCT ticker) >= 2", days=("month",))
def peak_months_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.shared_peaks(coverage.peak_months(coverage.monthly(_days(spark, sf_dir), "ticker"), "ticker"), "ticker")


@query(f"""WITH {ORD}, s AS (SELECT article_id, ticker, ts, CASE WHEN floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY ticker ORDER BY ts))) / 86400000000) > 1 THEN 1 ELSE 0 END AS new FROM ord)
SELECT article_id, CAST(sum(new) OVER (PARTITION BY ticker ORDER BY ts RANGE UNBOUNDED PRECEDING) + 1 AS BIGINT) AS burst FROM s""")
def burst_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.bursts(order_articles(spark, sf_dir), "ticker", "timestamp_utc", 1).select("article_id", "burst")


_BAL = f"{BARS}, {_LABEL}, lb AS (SELECT bar_date, CAST(coalesce(sign(round(r, 9)), 0) AS INTEGER) AS label FROM lab), mb AS (SELECT CAST(date_trunc('month', bar_date) AS DATE) AS month, count(*) AS n, avg(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END) AS up FROM lb GROUP BY 1)"


def _labels(spark, sf_dir):
    from tidemark.functions.scores import direction

    out = market.session_returns(bars(spark, sf_dir), benchmark(spark, sf_dir))
    return out.select("symbol", "bar_date", F.col("abnormal_return_1d"), direction(F.round("abnormal_return_1d", 9)).alias("label_direction"))


@query(f"WITH {_BAL} SELECT month, n, round(up, 6) + 0.0 AS up_share FROM mb", days=("month",))
def monthly_label_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage.monthly_balance(_labels(spark, sf_dir), "bar_date")
    return out.withColumn("up_share", r6("up_share"))


@query(f"""WITH {_BAL}, u AS (SELECT *, n >= 105 OR NOT (SELECT bool_or(n >= 105) FROM mb) AS use FROM mb)
SELECT arg_min(month, {{'u': up, 'm': month}}) FILTER (use) AS lowest_month, round(min(up) FILTER (use), 6) + 0.0 AS lowest, arg_max(month, {{'u': up, 'm': -datediff('day', DATE '1970-01-01', month)}}) FILTER (use) AS highest_month,
  round(max(up) FILTER (use), 6) + 0.0 AS highest, round(max(up) FILTER (use) - min(up) FILTER (use), 6) + 0.0 AS spread, count(*) FILTER (NOT use) AS set_aside FROM u""", days=("lowest_month", "highest_month"))
def label_balance_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage.balance_extremes(coverage.monthly_balance(_labels(spark, sf_dir), "bar_date"), 105)
    return out.withColumns({c: r6(c) for c in ("lowest", "highest", "spread")})


@query(f"""WITH {_BAL}, s AS (SELECT avg(CASE WHEN label = 1 THEN 1.0 ELSE 0 END) AS up, avg(CASE WHEN label = -1 THEN 1.0 ELSE 0 END) AS down, avg(CASE WHEN label = 0 THEN 1.0 ELSE 0 END) AS flat FROM lb)
SELECT round(up, 6) AS up, round(down, 6) AS down, round(flat, 6) AS flat, round(greatest(up, down, flat), 6) AS majority_rate FROM s""")
def label_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage.label_balance(_labels(spark, sf_dir))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query(f"""WITH {_SIDES}, j AS (SELECT r.timestamp_utc AS ts, l.article_id IS NOT NULL AS kept FROM r LEFT JOIN l USING (article_id))
SELECT CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS total, count(*) FILTER (NOT kept) AS dropped, count(*) FILTER (kept) AS kept FROM j GROUP BY 1""", days=("month",))
def dropped_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.dropped_by_month(_market_side(spark, sf_dir), _text_side(spark, sf_dir), "article_id", "timestamp_utc")


_PROFILE = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderpriority", "string")]


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) AS n_rows, round(count({c}) / count(*), 6) + 0.0 AS coverage, " + (f"round(avg(CAST({c} AS DOUBLE)), 4) + 0.0 AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), 4) + 0.0 AS std" if t != "string" else "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std") + " FROM orders"
    for c, t in _PROFILE))
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage.column_profile(table(spark, sf_dir, "orders"), [c for c, _ in _PROFILE])
    return out.withColumns({"coverage": r6("coverage"), "mean": F.round("mean", 4) + 0.0, "std": F.round("std", 4) + 0.0})


@query("SELECT 'event_type' AS \"column\", count(*) FILTER (event_type IS NULL OR trim(event_type) = '') AS n_empty FROM events UNION ALL SELECT 'props', count(*) FILTER (props IS NULL OR trim(props) = '') FROM events")
def emptiness_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.emptiness(table(spark, sf_dir, "events").select("event_type", "props"))


@query("SELECT count(o_totalprice) AS count, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.5), 4) AS q50, round(quantile_cont(o_totalprice, 0.75), 4) AS q75, max(o_totalprice) AS max FROM orders")
def describe_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage.describe(table(spark, sf_dir, "orders"), "o_totalprice")
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "q25", "q50", "q75")})


@query("SELECT event_type AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) + 0.0 AS share FROM events GROUP BY 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage.value_counts(table(spark, sf_dir, "events"), "event_type")
    return out.withColumn("share", r6("share"))


@query("SELECT n_values, count(*) AS n_keys FROM (SELECT user_id, count(DISTINCT event_type) AS n_values FROM events GROUP BY 1) GROUP BY 1")
def count_of_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.count_of_counts(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("SELECT CAST(h AS INTEGER) AS hour, count(e.ts) AS n FROM range(24) t(h) LEFT JOIN events e ON hour(e.ts) = h GROUP BY 1")
def hour_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.histogram(table(spark, sf_dir, "events"), F.hour("ts"), range(0, 24), "hour")


@query("SELECT CAST(d AS INTEGER) AS weekday, count(e.ts) AS n FROM range(7) t(d) LEFT JOIN events e ON isodow(e.ts) - 1 = d GROUP BY 1")
def weekday_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.histogram(table(spark, sf_dir, "events"), F.weekday("ts"), range(0, 7), "weekday")


@query(f"WITH {ART}, {CAL}, p AS (SELECT a.*, n.op AS session_open FROM art a ASOF JOIN cal n ON a.ts < n.op) SELECT article_id, round(score - avg(score) OVER (PARTITION BY session_open, ticker), 9) + 0.0 AS within_session, round(score - avg(score) OVER (PARTITION BY session_open), 9) + 0.0 AS across, count(*) OVER (PARTITION BY session_open, ticker) AS group_size FROM p")
def relative_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pit.align_next_open(articles(spark, sf_dir), calendar(spark))
    size = F.count("*").over(W.partitionBy("session_open", "ticker"))
    return p.select("article_id", r9(aggregates.demeaned("score", "session_open", "ticker")).alias("within_session"), r9(aggregates.demeaned("score", "session_open")).alias("across"), size.alias("group_size"))


@query("SELECT event_id AS article_id, count(*) OVER (PARTITION BY event_type, user_id) AS group_size FROM events")
def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("article_id"), "event_type", "user_id")
    return aggregates.with_group_size(e, ["event_type", "user_id"]).select("article_id", "group_size")


@query(f"WITH {ORD}, r AS (SELECT CASE WHEN ts <= TIMESTAMP '1995-06-30' THEN 'climb' ELSE 'descent' END AS regime, CAST(ts AS DATE) AS d FROM ord) SELECT regime, CAST(datediff('day', min(d), max(d)) + 1 AS INTEGER) AS days, count(*) AS rows, round(count(*) / (datediff('day', min(d), max(d)) + 1), 6) + 0.0 AS rows_a_day FROM r GROUP BY 1")
def regime_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage.regimes(order_articles(spark, sf_dir), "timestamp_utc", "1995-06-30")
    return out.withColumn("rows_a_day", r6("rows_a_day"))


@query(f"""WITH {_MARKET_SQL}, m AS (SELECT *, round(abnormal_return_1d, 6) + 0.0 AS r FROM mkt)
SELECT session_open, ticker, any_value(r) AS abnormal_return_1d, count(*) AS n_articles, count(DISTINCT r) AS n_returns, CAST(sum(news_volume) AS BIGINT) AS news_volume FROM m GROUP BY 1, 2""", times=("session_open",))
def day_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles rolled up to the day their label is of: the return is constant within it, so the session and ticker are its key."""
    m = _market(spark, sf_dir).withColumn("r", r6("abnormal_return_1d"))
    out = m.groupBy("session_open", "ticker").agg(F.min("r").alias("abnormal_return_1d"), F.count("*").alias("n_articles"), F.countDistinct("r").alias("n_returns"), F.sum("news_volume").alias("news_volume"))
    return out.withColumn("session_open", ntz("session_open"))


@query("SELECT o_orderkey AS article_id, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def largest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select(F.col("o_orderkey").alias("article_id"), F.col("o_totalprice").alias("price"))


@query("""WITH c AS (SELECT o_orderpriority AS source, CASE WHEN o_orderkey % 4 = 0 THEN '403' ELSE '200' END AS status, CAST(o_custkey % 9 AS VARCHAR) AS true_source, o_custkey % 700 AS body FROM orders)
SELECT source, count(*) AS n, count(*) FILTER (status = '200') AS reached, round(avg(CASE WHEN status = '200' THEN 1.0 ELSE 0 END), 6) AS reach_rate, count(DISTINCT true_source) AS n_sources, round(median(CAST(body AS DOUBLE)), 6) AS median_body,
  string_agg(DISTINCT status, ', ' ORDER BY status) AS statuses, CASE WHEN avg(CASE WHEN status = '200' THEN 1.0 ELSE 0 END) < 0.5 THEN 'blocked' WHEN median(CAST(body AS DOUBLE)) < 500 THEN 'no body' ELSE 'open' END AS verdict FROM c GROUP BY 1""")
def source_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.when(F.col("o_orderkey") % 4 == 0, "403").otherwise("200").alias("status"), (F.col("o_custkey") % 9).cast("string").alias("true_source"), F.repeat(F.lit("x"), (F.col("o_custkey") % 700).cast("int")).alias("processed_body"))
    out = coverage.open_or_blocked(coverage.source_access(o))
    return out.withColumns({"reach_rate": r6("reach_rate"), "median_body": r6("median_body")})


@query("SELECT symbol FROM (VALUES ('1-URGENT'), ('9-NONE')) v(symbol) WHERE symbol NOT IN (SELECT DISTINCT o_orderpriority FROM orders)")
def empty_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.empty_symbols(bars(spark, sf_dir), spark.createDataFrame([("1-URGENT",), ("9-NONE",)], "symbol string"))


@query("""WITH w AS (SELECT CAST(o_orderdate AS DATE) AS d, max(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS h1, max(o_totalprice) FILTER (o_orderpriority = '2-HIGH') AS h2 FROM orders GROUP BY 1)
SELECT '1-URGENT' AS symbol, d AS bar_date, h1 AS high FROM w UNION ALL SELECT '2-HIGH', d, h2 FROM w""", days=("bar_date",))
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    symbols = ["1-URGENT", "2-HIGH"]
    cells = [F.max(F.when(F.col("o_orderpriority") == s, F.col("o_totalprice"))).alias(f"{f}_{s}") for s in symbols for f in ("high", "low", "close", "volume")]
    return market.long_bars(o.groupBy(F.to_date("o_orderdate").alias("Date")).agg(*cells), symbols).select("symbol", "bar_date", "high")
