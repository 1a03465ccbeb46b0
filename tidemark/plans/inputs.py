"""The driver's tables in the roles of the engine's inputs, and the same views in SQL for DuckDB."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators import pit

FIRST_DAY, LAST_DAY = "2023-12-20", "2024-02-10"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Rounded to six digits, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def r9(c: Column | str) -> Column:
    """As r6, to nine digits: for means of numbers with few decimals, which would tie at six."""
    return F.round(F.col(c) if isinstance(c, str) else c, 9) + F.lit(0.0)


def registry(queries: dict, oracles: dict):
    """A decorator that files a query, and its SQL, under the function's name.

    Days and times leave as text, the same on both sides: `days` and `times` name those columns.
    """

    def query(sql: str | None = None, days: tuple[str, ...] = (), times: tuple[str, ...] = ()):
        def add(f):
            @wraps(f)
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                out = f(spark, sf_dir)
                shown = {c: F.date_format(c, "yyyy-MM-dd") for c in days} | {c: F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd HH:mm:ss") for c in times}
                return out.withColumns(shown) if shown else out

            queries[f.__name__] = run
            if sql is not None:
                shown = [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in days] + [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in times]
                oracles[f.__name__] = f"SELECT * REPLACE ({', '.join(shown)}) FROM ({sql}) q" if shown else sql
            return f

        return add

    return query


def ntz(c: str) -> Column:
    return F.col(c).cast("timestamp_ntz")


def calendar(spark: SparkSession) -> DataFrame:
    return pit.exchange_calendar(spark, FIRST_DAY, LAST_DAY)


#: New York keeps winter time on these days.
CAL = f"""cal AS (SELECT CAST(d AS DATE) AS d, d + INTERVAL 870 MINUTE AS op, d + INTERVAL 1260 MINUTE AS cl
  FROM range(TIMESTAMP '{FIRST_DAY}', TIMESTAMP '{LAST_DAY}' + INTERVAL 1 DAY, INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6)"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("article_id"), F.concat(F.lit("T"), (F.col("user_id") % 4).cast("string")).alias("ticker"), F.col("ts").cast("timestamp").alias("timestamp_utc"),
        F.col("event_type").alias("source"), ((F.col("value") - 50) / 50).alias("score"),
    )


ART = "art AS (SELECT event_id AS article_id, 'T' || CAST(user_id % 4 AS VARCHAR) AS ticker, ts, event_type AS source, (value - 50) / 50 AS score FROM events)"


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    p = F.col("o_totalprice")
    return o.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("bar_date")).agg(
        F.max(p).alias("high"), F.min(p).alias("low"), (F.round(F.avg(p), 4)).alias("close"), F.count("*").cast("double").alias("volume")
    )


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("bar_date")).agg(F.round(F.avg("o_totalprice"), 4).alias("market_close"))


BARS = """bars AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS bar_date, max(o_totalprice) AS high, min(o_totalprice) AS low,
    round(avg(o_totalprice), 4) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2),
  bench AS (SELECT CAST(o_orderdate AS DATE) AS bar_date, round(avg(o_totalprice), 4) AS market_close FROM orders GROUP BY 1)"""


def order_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as articles of the symbol they make bars of: times within the bars' span."""
    o = table(spark, sf_dir, "orders")
    at = F.col("o_orderdate").cast("timestamp") + F.expr("make_interval(0, 0, 0, 0, cast(o_orderkey % 24 as int), cast(o_orderkey % 60 as int), 0)")
    return o.select(F.col("o_orderkey").alias("article_id"), F.col("o_orderpriority").alias("ticker"), at.alias("timestamp_utc"), F.col("o_orderstatus").alias("source"))


ORD = """ord AS (SELECT o_orderkey AS article_id, o_orderpriority AS ticker,
    o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) + to_minutes(CAST(o_orderkey % 60 AS INTEGER)) AS ts, o_orderstatus AS source FROM orders)"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.sentences import explode_sentences

    return explode_sentences(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text"))


#: RE2 has no lookaround: a mark is put where a sentence ends, and the text is split at the marks.
SENT = r"""pieces AS (SELECT doc_id AS article_id, unnest(string_split(regexp_replace(text, '([.!?])\s+([A-Z("])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS piece,
    generate_subscripts(string_split(regexp_replace(text, '([.!?])\s+([A-Z("])', '\1' || chr(1) || '\2', 'g'), chr(1)), 1) AS pos FROM documents),
  sent AS (SELECT article_id, CAST(row_number() OVER (PARTITION BY article_id ORDER BY pos) - 1 AS INTEGER) AS sent_idx, text
    FROM (SELECT article_id, pos, regexp_replace(piece, '^\s+|\s+$', '', 'g') AS text FROM pieces) WHERE length(text) >= 20)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as scored sentences; lines that share their key are folded into one."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("article_id"), F.col("l_linenumber").alias("sent_idx")).agg(
        F.max("l_discount").alias("d"), F.max("l_tax").alias("t"), F.max("l_quantity").alias("q"), F.max("l_returnflag").alias("f"), F.max("l_linestatus").alias("s")
    )
    return li.select(
        "article_id", "sent_idx", (F.col("q") / 50).alias("pos"), (F.col("d") * 8).alias("neg"), (F.col("t") * 5).alias("neu"),
        F.when(F.col("q") % 9 != 0, F.col("t") * 10).alias("absa_pos"), (F.col("d") * 6).alias("absa_neg"), (F.col("t") * 3).alias("absa_neu"),
        F.col("f").isin("A", "R").alias("mentions_target"), (F.col("s") == "O").alias("mentions_ceo"), (F.col("f") == "R").alias("resolved_by_coref"),
        (F.col("q") % 11 == 0).alias("is_boilerplate"), F.col("q").cast("int").alias("char_len"), F.when(F.col("q") > 25, F.lit(3)).alias("mention_char_start"),
    )


SCORED = """line AS (SELECT l_orderkey AS article_id, l_linenumber AS sent_idx, max(l_discount) AS d, max(l_tax) AS t, max(l_quantity) AS q,
    max(l_returnflag) AS f, max(l_linestatus) AS s FROM lineitem GROUP BY 1, 2),
  scored AS (SELECT article_id, sent_idx, q / 50 AS pos, d * 8 AS neg, t * 5 AS neu, CASE WHEN q % 9 <> 0 THEN t * 10 END AS absa_pos, d * 6 AS absa_neg, t * 3 AS absa_neu,
    f IN ('A', 'R') AS mentions_target, s = 'O' AS mentions_ceo, f = 'R' AS resolved_by_coref, q % 11 = 0 AS is_boilerplate, CAST(q AS INTEGER) AS char_len,
    CASE WHEN q > 25 THEN 3 END AS mention_char_start FROM line),
  fusd AS (SELECT *, pos - neg AS fin, absa_pos - absa_neg AS absa, sign(absa_pos - absa_neg) * abs(pos - neg) * (0.7 + 0.3 * abs(absa_pos - absa_neg)) AS x,
    mentions_target AND NOT is_boilerplate AS tgt, mentions_ceo AND NOT is_boilerplate AS ceo,
    CASE WHEN mentions_target THEN CASE WHEN NOT resolved_by_coref THEN 'surface' WHEN mention_char_start IS NOT NULL THEN 'coref_span' ELSE 'coref_nospan' END END AS channel FROM scored)"""


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pooled article rows with every column the session table reads."""
    out = pit.align_next_open(pit.session_bucket(articles(spark, sf_dir), calendar(spark)), calendar(spark))
    i, x = F.col("article_id"), F.col("score")
    day = F.datediff(F.to_date("session_open"), F.lit("2024-01-01").cast("date"))
    fus = {"mean": F.when(i % 13 != 0, x), "median": x * 0.9, "lead": x * 0.5, "top3_pos": F.abs(x), "top3_neg": -F.abs(x), "spread": F.abs(x) * 2}
    out = out.withColumns({f"fus_conf_graft_floor_{k}": v for k, v in fus.items()})
    out = out.withColumns({
        "abnormal_return_1d": (day % 7 - 3) / 100.0, "label_direction": F.signum((day % 7 - 3).cast("double")).cast("int"),
        "n_total_sents": i % 11 + 1, "n_entity_sents": i % 5, "n_ceo_sents": i % 3, "n_boilerplate_sents": i % 2, "article_length": i % 1000,
        "entity_share": (i % 5) / (i % 11 + 1), "has_ceo_mention": i % 3 > 0, "fus_ceo_mean": F.when(i % 4 == 0, x), "fus_headline": x * 0.8, "fus_maxmag": x, "fus_trusted_mean": x * 0.7,
        "fus_scorer_gap": F.abs(x) / 2, "fus_headline_gap": x * 0.1, "fus_lead_gap": -x * 0.1,
    })
    market = ["momentum_1d", "momentum_5d", "momentum_20d", "volatility_20d", "beta_20d", "relative_volume_20d", "daily_range_ratio_1d"]
    return out.withColumns({**{c: (i % (7 + k)) / 100.0 for k, c in enumerate(market)}, "days_to_earnings": (i % 90).cast("int"), "news_volume": i % 17})


POOLED = f"""{ART}, {CAL},
  nxt AS (SELECT a.*, n.op AS session_open FROM art a ASOF JOIN cal n ON a.ts < n.op),
  pooled AS (SELECT n.*, n.article_id AS i, n.score AS x, CASE WHEN n.article_id % 13 <> 0 THEN n.score END AS xm,
    CASE WHEN c.d IS NULL THEN 'after-hours' WHEN n.ts < c.op THEN 'pre-market' WHEN n.ts <= c.cl THEN 'market-hours' ELSE 'after-hours' END AS session,
    (datediff('day', DATE '2024-01-01', CAST(n.session_open AS DATE)) % 7 - 3) AS lab FROM nxt n LEFT JOIN cal c ON CAST(n.ts AS DATE) = c.d)"""
