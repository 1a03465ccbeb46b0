"""Registered queries of whole pipelines, sources and sinks."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import aggregates, caching, integrity, models
from tidemark.plans import pipelines, reports
from tidemark.plans.inputs import POOLED, SENT, bars, ntz, order_articles, pooled, r6, r9, registry, sentences, table
from tidemark.plans.market_queries import _MARKET_SQL, _market
from tidemark.sources import pages, tables

QUERIES: dict = {}
ORACLES: dict = {}
query = registry(QUERIES, ORACLES)

GOOD, BAD = ["gained", "rose"], ["lost", "fell"]
SCORER = caching.lexicon_scorer(GOOD, BAD)
#: What a document's first sentence, and its headline, say of the company.
MOVES = ["gained ground", "lost ground", "gained and rose again", "held still", "fell and lost but rose"]


def _mark(sf_dir: str) -> int:
    return zlib.crc32(sf_dir.encode())


def _move(shift: int):
    return F.element_at(F.array(*map(F.lit, MOVES)), ((F.col("doc_id") + shift) % 5 + 1).cast("int"))


def _stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a story about the company: a made sentence that names it, then the document's own text."""
    d = table(spark, sf_dir, "documents")
    first = F.concat(F.lit("Tesla plant "), F.col("doc_id").cast("string"), F.lit(" "), _move(0), F.lit(" in the north today."))
    body = F.concat(first, F.lit(" Numbers follow: "), F.col("n_chars").cast("string"), F.lit(" and "), F.col("doc_id").cast("string"), F.lit(" in all of them."))
    return d.select(F.col("doc_id").alias("article_id"), F.concat(F.lit("Tesla "), _move(1)).alias("headline"), "source", F.lit("2024-01-05 10:00:00").cast("timestamp").alias("timestamp_utc"), body.alias("processed_body"))


_M = "CASE CAST((doc_id + {}) % 5 AS INTEGER) " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MOVES)) + " END"
_N = "len(list_filter(regexp_extract_all({}, '[a-z]+'), lambda w: w IN ({})))"
_STORY = f"""d AS (SELECT doc_id AS article_id, source, {_M.format(0)} AS m, {_M.format(1)} AS h, 'Tesla plant ' || doc_id || ' ' || {_M.format(0)} || ' in the north today.' AS s0, 'Numbers follow: ' || n_chars || ' and ' || doc_id || ' in all of them.' AS s1 FROM documents),
  c AS (SELECT *, {_N.format('m', "'gained', 'rose'")} AS p, {_N.format('m', "'lost', 'fell'")} AS n, {_N.format('h', "'gained', 'rose'")} AS hp, {_N.format('h', "'lost', 'fell'")} AS hn FROM d),
  f AS (SELECT *, (p - n) / (p + n + 1) AS fin, (hp - hn) / (hp + hn + 1) AS hfin FROM c),
  x AS (SELECT *, sign(fin) * abs(fin) * (0.7 + 0.3 * abs(fin)) AS x, sign(hfin) * abs(hfin) * (0.7 + 0.3 * abs(hfin)) AS hx FROM f)"""
_PLAIN = {"n_total_sents": "2", "n_entity_sents": "1", "n_ceo_sents": "0", "n_ceo_mention_sents": "0", "n_boilerplate_sents": "0", "article_length": "length(s0) + length(s1)"}
_DOUBLE = {
    "entity_share": "0.5", "fus_conf_graft_floor_mean": "x / 5", "fus_conf_graft_floor_median": "x", "fus_conf_graft_floor_lead": "x", "fus_conf_graft_floor_top3_pos": "x", "fus_conf_graft_floor_top3_neg": "x", "fus_conf_graft_floor_spread": "0",
    "fus_headline": "hx", "fus_maxmag": "x", "fus_trusted_mean": "x / 5", "fus_scorer_gap": "0", "fus_headline_gap": "hx - x / 5", "fus_lead_gap": "x - x / 5",
}


@query(f"""WITH {_STORY} SELECT article_id, 'TSLA' AS ticker, source, {', '.join(f'CAST({e} AS BIGINT) AS {c}' for c, e in _PLAIN.items())}, {', '.join(f'round(CAST({e} AS DOUBLE), 9) + 0.0 AS {c}' for c, e in _DOUBLE.items())}, CAST(NULL AS DOUBLE) AS fus_ceo_mean, false AS has_ceo_mention FROM x""")
def text_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies to model columns: sentences, tags, both scorers, aggregates, headline, identity."""
    out = pipelines.text_features(_stories(spark, sf_dir), "TSLA", pipelines.Scorers(SCORER, SCORER)).drop("timestamp_utc")
    return out.withColumns({c: r9(c) for c in _DOUBLE} | {c: F.col(c).cast("long") for c in _PLAIN})


@query(f"WITH {_STORY} SELECT article_id, 'Tesla ' || h AS headline, round(hp / (hp + hn + 1), 9) + 0.0 AS pos, round(hn / (hp + hn + 1), 9) + 0.0 AS neg, round(1 / (hp + hn + 1), 9) + 0.0 AS absa_neu FROM x")
def headline_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pipelines.headline_triples(_stories(spark, sf_dir), "TSLA", pipelines.Scorers(SCORER, SCORER))
    return out.select("article_id", "headline", r9("pos").alias("pos"), r9("neg").alias("neg"), r9("absa_neu").alias("absa_neu"))


_WORDS = "len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: w IN ({})))"


@query(f"""WITH {SENT}, m AS (SELECT *, article_id % 3 <> 0 AS has, {_WORDS.format("'the', 'le', 'der'")} AS p, {_WORDS.format("'of', 'de', 'und'")} AS n FROM sent)
SELECT article_id, sent_idx, CASE WHEN has THEN round(p / (p + n + 1), 6) + 0.0 END AS absa_pos, CASE WHEN has THEN round(n / (p + n + 1), 6) + 0.0 END AS absa_neg, CASE WHEN has THEN round(1 / (p + n + 1), 6) + 0.0 END AS absa_neu FROM m""")
def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = sentences(spark, sf_dir).withColumns({"absa_text": F.col("text"), "absa_aspect": F.when(F.col("article_id") % 3 != 0, "Tesla").otherwise("")})
    out = caching.score_pairs(pairs, caching.lexicon_scorer(["the", "le", "der"], ["of", "de", "und"]))
    return out.select("article_id", "sent_idx", *[r6(f"absa_{c}").alias(f"absa_{c}") for c in ("pos", "neg", "neu")])


@query(f"WITH {_MARKET_SQL} SELECT m.article_id, m.ticker, o.o_custkey % 10 / 10.0 AS score, m.session_open, m.label_direction, m.session, m.news_volume FROM mkt m JOIN orders o ON o.o_orderkey = m.article_id WHERE o.o_orderstatus <> 'O'", times=("session_open",))
def merged_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and market rows of all tickers merged; texts of open orders are missing. The first articles have no bar before them, so the leak check alone reports rows."""
    whole = order_articles(spark, sf_dir)
    scores = table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("article_id"), (F.col("o_custkey") % 10 / 10.0).alias("score"))
    text = whole.join(scores, "article_id").select("article_id", "ticker", "timestamp_utc", "source", "score")
    out, _ = pipelines.merged(text, _market(spark, sf_dir), whole, bars(spark, sf_dir))
    return out.select("article_id", "ticker", "score", ntz("session_open").alias("session_open"), "label_direction", "session", "news_volume")


@query(f"""WITH {SENT}, m AS (SELECT *, {_WORDS.format("'the', 'le', 'der'")} AS p, {_WORDS.format("'of', 'de', 'und'")} AS n FROM sent WHERE article_id = (SELECT min(doc_id) FROM documents))
SELECT sent_idx, text, round(p / (p + n + 1), 6) + 0.0 AS pos, round((p - n) / (p + n + 1), 6) + 0.0 AS signed, false AS mentions_target FROM m""")
def article_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of one article, the first, with its tags and scores: what the demonstration shows of a text."""
    text = table(spark, sf_dir, "documents").orderBy("doc_id").limit(1).first()["text"]
    out = pipelines.sentence_view(spark, text, "TSLA", pipelines.Scorers(caching.lexicon_scorer(["the", "le", "der"], ["of", "de", "und"])))
    return out.select("sent_idx", "text", r6("pos").alias("pos"), r6("signed").alias("signed"), "mentions_target")


@query("SELECT doc_id AS article_id, CASE WHEN doc_id % 3 = 0 THEN 'yes' ELSE 'unsure' END AS answer FROM documents")
def signal_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.when(F.col("doc_id") % 3 == 0, "yes").otherwise("unsure").alias("answer"))
    return integrity.require_signal(d)


@query("SELECT o_orderkey AS article_id, o_orderstatus AS ticker, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS timestamp_utc FROM orders")
def stored_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders written as a table parted by ticker, found among several, and read back as a corpus."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_id"), F.col("o_orderstatus").alias("ticker"), F.col("o_orderdate").alias("timestamp_utc"), "o_totalprice")
    path = tables.scratch(spark, f"corpus-{_mark(sf_dir)}")
    tables.write_table(o, path, ["ticker"])
    tables.read_all(spark, {"corpus": path})
    out = tables.read_corpus(spark, path, ("article_id", "ticker", "timestamp_utc"))
    return out.withColumn("timestamp_utc", F.date_format("timestamp_utc", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT o_orderkey AS article_id, o_orderpriority AS ticker, round(o_totalprice, 2) AS price FROM orders")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_id"), F.col("o_orderpriority").alias("ticker"), F.round("o_totalprice", 2).alias("price"))
    path = tables.scratch(spark, f"csv-{_mark(sf_dir)}")
    tables.write_csv(o, path)
    return tables.read_csv(spark, path, "article_id long, ticker string, price double")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def built_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is built where it is not yet there and only read the second time; a cache whose columns have changed is empty."""
    path = tables.scratch(spark, f"built-{_mark(sf_dir)}")
    for build in (lambda: table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")), lambda: spark.range(1)):
        out = tables.read_or_build(spark, path, build)
    lacking = tables.read_cache(spark, path, "user_id long, other string")
    return out.unionByName(lacking.select("user_id", F.lit(0).cast("long").alias("n")))


@query(f"WITH {POOLED} SELECT DISTINCT session_open, ticker, true AS is_share, true AS agrees FROM pooled", times=("session_open",))
def trained_and_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session model trained, saved with its features, loaded and applied: one prediction a session, its direction that of its probability."""
    rows = pooled(spark, sf_dir)
    path = tables.scratch(spark, f"bundle-{_mark(sf_dir)}")
    pipelines.train(rows, path, models.logistic)
    out = pipelines.predict(rows, path)
    p = F.col("proba_up")
    return out.select(F.col("session_open").cast("timestamp_ntz").alias("session_open"), "ticker", p.between(0, 1).alias("is_share"), ((p >= 0.5) == (F.col("pred_direction") == 1)).alias("agrees"))


@query("SELECT 'Model card' AS report, true AS titled, true AS tabled UNION ALL SELECT 'Coverage by ticker', true, true UNION ALL SELECT 'Feature dictionary', true, true")
def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports over the orders as articles: each a Markdown document with its title and tables."""
    from tidemark.plans.inputs import order_articles

    a = order_articles(spark, sf_dir)
    texts = [reports.model_card({"features": aggregates.SESSION_FEATURES, "n": 1}, a.groupBy("ticker").agg(F.count("*").alias("n")).orderBy("ticker")), reports.cross_report(a), reports.feature_dictionary(a.select("article_id", "ticker"), {"ticker": "the company"})]
    return spark.createDataFrame([(t.split("\n")[0].removeprefix("# "), t.startswith("# "), "| --- |" in t or "|---|" in t) for t in texts], "report string, titled boolean, tabled boolean")


def _site(url: str) -> tuple[int, str, str]:
    """A web of pages made from their addresses: queries are not found, fragments are refused, every third page tells its time."""
    if "#" in url:
        raise ConnectionError(url)
    if "?" in url:
        return 404, url, ""
    linked = '<script type="application/ld+json">{"datePublished": "2024-01-05T08:00:00Z", "publisher": "x"}</script>' if len(url) % 3 == 0 else ""
    return 200, url, f"{linked}<p>{url}</p><p>{'text ' * (len(url) * 3)}</p>"


@query("""WITH p AS (SELECT page_id AS article_id, url, length(url) AS n, CASE WHEN strpos(url, '#') > 0 THEN 'ConnectionError' WHEN strpos(url, '?') > 0 THEN '404' ELSE '200' END AS status FROM pages)
SELECT article_id, status, CAST(CASE WHEN status = 'ConnectionError' THEN 0 ELSE 1 END AS INTEGER) AS n_fetch, CASE WHEN status = '200' THEN regexp_extract(url, '://([^/]*)', 1) END AS true_source, status = '200' AND n % 3 = 0 AS corrected,
  CASE WHEN status = '200' THEN CASE WHEN n % 3 = 0 THEN '2024-01-05 08:00:00' ELSE '2024-01-05 06:00:00' END END AS utc, CAST(CASE WHEN status = '200' THEN n + n * 15 END AS INTEGER) AS n_chars, status = '200' AND n * 16 >= 500 AS text_ok FROM p""")
def fetched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' addresses fetched from a made web by threads in every partition: status, outlet, time and body of each."""
    a = table(spark, sf_dir, "pages").select(F.col("page_id").alias("article_id"), "url", F.lit("2024-01-05 06:00:00").cast("timestamp").alias("timestamp_utc"))
    out = pages.fetched(a, _site)
    return out.select("article_id", "status", "n_fetch", "true_source", "corrected", F.date_format("utc", "yyyy-MM-dd HH:mm:ss").alias("utc"), F.length("processed_body").alias("n_chars"), "text_ok")
