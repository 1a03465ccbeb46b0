"""End-to-end pipelines: text, market, merge, train and predict, each a chain of the operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import scores as S
from tidemark.functions import text as T
from tidemark.operators import aggregates, caching, integrity, market, models, sentences as ops
from tidemark.sources import tables

IDENTITY = ["article_id", "ticker", "timestamp_utc", "source"]


@dataclass(frozen=True)
class Scorers:
    """The models that a deployment plugs in; a missing one leaves NULL scores, no clusters, or no gate."""

    sentence: caching.Scorer
    pair: caching.Scorer | None = None
    resolver: Callable[[list[str]], list] | None = None
    judge: Callable[[dict], str] | None = None
    judge_id: str = "none"
    prompt_version: str = "v1"


def tagged(articles: DataFrame, ticker: str, scorers: Scorers, body: str = "processed_body", corpus_wide: bool = True) -> DataFrame:
    """Sentences of (article_id, body) with their tags; boilerplate is a matter of the whole corpus."""
    docs = articles.select("article_id", F.coalesce(F.col(body), F.lit("")).alias("text"))
    mentions = None
    if scorers.resolver is not None:
        found = caching.resolve_mentions(docs, scorers.resolver)
        joined = docs.withColumn("text_hash", T.text_hash(F.col("text"))).join(found, "text_hash")
        mentions = ops.map_clusters(joined, ticker)
    out = ops.tag_sentences(ops.located_sentences(docs), ticker, mentions)
    return aggregates.flag_boilerplate(out) if corpus_wide else out


def scored(sentences: DataFrame, ticker: str, scorers: Scorers, only_relevant: bool = True) -> DataFrame:
    """Both scorers' columns on a tagged sentence table."""
    out = ops.build_pairs(caching.score_sentences(sentences, scorers.sentence, only_relevant=only_relevant), ticker)
    return caching.score_pairs(out, scorers.pair) if scorers.pair else caching.without_scorer(out)


def judged(sentences: DataFrame, headlines: DataFrame, ticker: str, scorers: Scorers) -> DataFrame:
    """provenance_channel, judge_answer and judge_accepted; all pass without a judge."""
    out = sentences.withColumn("provenance_channel", S.provenance_channel(sentences))
    if scorers.judge is None:
        return out.withColumn("judge_answer", F.lit(None).cast("string")).withColumn("judge_accepted", F.lit(True))
    built = ops.contexts(out, headlines).where(S.judge_population(out))
    rows = built.select("article_id", "sent_idx", F.lit(ticker).alias("target"), "context", F.substr("text", F.col("mention_char_start") + 1, F.col("mention_char_end") - F.col("mention_char_start")).alias("mention"))
    verdicts = caching.judge_pending(rows, None, scorers.judge, scorers.judge_id, scorers.prompt_version)
    return caching.gate(out, integrity.require_signal(verdicts))


def headline_triples(headlines: DataFrame, ticker: str, scorers: Scorers) -> DataFrame:
    """(article_id, headline, pos, neg, neu, absa_pos, absa_neg, absa_neu) of headlines; the aspect is the company."""
    named = headlines.select("article_id", F.coalesce("headline", F.lit("")).alias("headline"))
    marked = named.select("article_id", F.col("headline").alias("text"), F.lit(True).alias("mentions_target"), F.lit(False).alias("mentions_ceo"))
    first = caching.score_sentences(marked, scorers.sentence, only_relevant=False).select("article_id", F.col("text").alias("headline"), "pos", "neg", "neu")
    pairs = first.withColumn("absa_text", F.col("headline")).withColumn("absa_aspect", F.lit(T.company_name(ticker)))
    out = caching.score_pairs(pairs, scorers.pair) if scorers.pair else caching.without_scorer(pairs)
    return out.drop("absa_text", "absa_aspect")


def text_features(articles: DataFrame, ticker: str, scorers: Scorers, body: str = "processed_body") -> DataFrame:
    """IDENTITY and the model columns for each article (article_id, headline, source, timestamp_utc, body) that is about the company."""
    heads = articles.select("article_id", "headline")
    sentences = judged(scored(tagged(articles, ticker, scorers, body), ticker, scorers), heads, ticker, scorers).where("judge_accepted")
    triples = headline_triples(heads, ticker, scorers)
    features = aggregates.article_features(sentences, triples, named=T.names_any(F.col("headline"), T.aliases(ticker, "names")))
    identity = articles.select("article_id", F.lit(ticker).alias("ticker"), "timestamp_utc", "source")
    return identity.join(features, "article_id").select(*IDENTITY, *aggregates.MODEL_COLUMNS)


def analyze(spark: SparkSession, article: str, ticker: str, scorers: Scorers, headline: str | None = None) -> dict:
    """One article through the same steps; counts 0 and scores NULL where it has no sentence."""
    one = spark.createDataFrame([("one", article, headline)], "article_id string, processed_body string, headline string")
    sentences = scored(tagged(one, ticker, scorers, corpus_wide=False), ticker, scorers)
    heads = headline_triples(one, ticker, scorers) if headline else None
    found = aggregates.article_features(sentences, heads).first()
    if found is not None:
        return found.asDict()
    empty = {c: None for c in aggregates.MODEL_COLUMNS} | {c: 0 for c in aggregates.SHAPE_COLUMNS} | {"has_ceo_mention": False, "fus_conf_graft_floor_lead": 0.0}
    if heads is not None:
        empty["fus_headline"] = heads.select(S.fuse().alias("f")).first().f
    return {"article_id": "one", **empty}


def sentence_view(spark: SparkSession, article: str, ticker: str, scorers: Scorers) -> DataFrame:
    """Every sentence of one article with its tags and scores, relevant or not."""
    one = spark.createDataFrame([("one", article)], "article_id string, processed_body string")
    out = scored(tagged(one, ticker, scorers, corpus_wide=False), ticker, scorers, only_relevant=False)
    return out.withColumn("signed", S.signed("pos", "neg")).withColumn("fused", S.fuse())


def market_table(articles: DataFrame, bars: DataFrame, benchmark: DataFrame, schedule: DataFrame, earnings: DataFrame | None = None) -> DataFrame:
    """Market features of all tickers in one job; a ticker without a single close raises."""
    lacking = market.empty_symbols(bars, articles.select(F.col("ticker").alias("symbol"))).limit(20).collect()
    if lacking:
        raise KeyError(f"no prices for {[r.symbol for r in lacking]}")
    return market.build_market_features(articles, bars, benchmark, schedule, earnings)


def merged(text: DataFrame, markets: DataFrame, corpus: DataFrame, bars: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(merged rows of all tickers, checks). With `strict` a failed check raises; without, it is only reported.

    Rows are keyed by article within a ticker, so uniqueness is checked on the pair.
    """
    key = F.concat_ws(":", "ticker", F.col("article_id").cast("string"))
    t, m = text.withColumn("_key", key), markets.withColumn("_key", key)
    whole = corpus.withColumn("_key", key)
    leak = integrity.leakage_summary(integrity.leakage_rows(markets, bars))
    checks = [integrity.check_unique(t, "text", "_key"), integrity.check_unique(m, "market", "_key"), integrity.check_same_article(t, m, "text vs market", "_key"), integrity.check_subset(t, whole, "text", "_key"), integrity.check_subset(m, whole, "market", "_key")]
    if "headline" in corpus.columns:
        checks.append(integrity.check_cross_group(corpus))
    checks.append(leak.select(F.lit("momentum_1d has no leak").alias("name"), "passed", F.col("real_leaks").alias("n_offenders"), F.array().cast("array<string>").alias("offenders")))
    table = checks[0]
    for c in checks[1:]:
        table = table.unionByName(c)
    if strict:
        failed = table.where(~F.col("passed")).select("name").collect()
        if failed:
            raise ValueError(f"failed: {[r.name for r in failed]}")
    out = integrity.merge_validated(t, m.drop("article_id"), "_key").drop("_key")
    return integrity.pool([out]), table


def train(pooled: DataFrame, path: str, factory: Callable = models.boosted_trees) -> PipelineModel:
    """Fits the session model on all labelled sessions of pooled article rows and saves it with its feature list."""
    spark = pooled.sparkSession
    sessions = aggregates.session_table(pooled)
    model = models.fit(sessions, aggregates.SESSION_FEATURES, "label_direction", factory)
    span = sessions.agg(F.count("*").alias("n"), F.min("session_open").alias("a"), F.max("session_open").alias("b")).first()
    models.save_bundle(model, aggregates.SESSION_FEATURES, {"n_sessions": span.n, "first_session": str(span.a), "last_session": str(span.b)}, path, spark)
    return model


def predict(pooled: DataFrame, path: str) -> DataFrame:
    """session_open, ticker, timestamp_utc, pred_direction, proba_up; the features are those the bundle names."""
    model, metadata = models.load_bundle(path, pooled.sparkSession)
    return models.predict(model, aggregates.session_table(pooled), metadata["features"]).select("session_open", "ticker", "timestamp_utc", "pred_direction", "proba_up")


def load_pooled(spark: SparkSession, path: str) -> DataFrame:
    if not tables.exists(spark, path):
        raise FileNotFoundError(f"no pooled table at {path}; run the merge pipeline first")
    return spark.read.parquet(path)
