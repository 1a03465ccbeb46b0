import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates, integrity, market, models, pit
from tidemark.operators.caching import lexicon_scorer
from tidemark.plans import pipelines, reports

WORDS = lexicon_scorer(["rose", "gained", "strong"], ["fell", "lost", "weak"])
SCORERS = pipelines.Scorers(WORDS, WORDS)
UTC = dt.timezone.utc


@pytest.fixture(scope="module")
def corpus(spark):
    bodies = [
        "Tesla rose strongly and gained on its rivals today. It gained more than analysts had expected so far. Nothing else of note happened there.",
        "A rival fell hard and lost much of its market today. Elon Musk spoke about a weak quarter in public today.",
        "Short.",
        "Analysts met in the city to talk about the weather at length.",
    ]
    heads = ["Tesla gained", "Rivals lost", "Tesla fell", "Weather"]
    rows = [(i, heads[i % 4], "Yahoo", dt.datetime(2025, 1, 6 + i // 4, 10 + i % 4, tzinfo=UTC), bodies[i % 4]) for i in range(40)]
    return spark.createDataFrame(rows, "article_id long, headline string, source string, timestamp_utc timestamp, processed_body string")


def test_text_pipeline(spark, corpus):
    out = pipelines.text_features(corpus, "TSLA", SCORERS)
    assert out.columns == [*pipelines.IDENTITY, *aggregates.MODEL_COLUMNS]
    kinds = {r.article_id % 4: r for r in out.collect()}
    # Bodies repeat in ten articles, so every sentence is boilerplate, and only named headlines keep an article with sentences.
    assert set(kinds) == {0} and kinds[0].n_boilerplate_sents == 3 and kinds[0].fus_conf_graft_floor_mean == 0.0
    few = pipelines.text_features(corpus.where("article_id < 4"), "TSLA", SCORERS)
    kinds = {r.article_id: r for r in few.collect()}
    assert set(kinds) == {0} and kinds[0].n_entity_sents == 1 and kinds[0].fus_conf_graft_floor_mean > 0 and kinds[0].fus_headline > 0


def test_text_pipeline_with_resolver_and_judge(spark, corpus):
    def resolver(texts):
        return [[[(0, 5), (52, 54)]] if t.startswith("Tesla") else [] for t in texts]

    asked = pipelines.Scorers(WORDS, WORDS, resolver, lambda row: "yes" if "gained" in row["context"] else "no", "m", "v1")
    one = corpus.where("article_id = 0")
    with_it = pipelines.text_features(one, "TSLA", asked).first()
    assert with_it.n_entity_sents == 2
    refused = pipelines.Scorers(WORDS, WORDS, resolver, lambda row: "no", "m", "v1")
    assert pipelines.text_features(one, "TSLA", refused).first().n_entity_sents == 1
    silent = pipelines.Scorers(WORDS, WORDS, resolver, lambda row: "unsure", "m", "v1")
    with pytest.raises(RuntimeError):
        pipelines.text_features(one, "TSLA", silent)


def test_analyze_equals_batch(spark, corpus):
    body = corpus.where("article_id = 0").first().processed_body
    one = pipelines.analyze(spark, body, "TSLA", SCORERS, "Tesla gained")
    batch = pipelines.text_features(corpus.where("article_id = 0"), "TSLA", SCORERS).first().asDict()
    assert {k: one[k] for k in aggregates.MODEL_COLUMNS} == {k: batch[k] for k in aggregates.MODEL_COLUMNS}
    empty = pipelines.analyze(spark, "", "TSLA", SCORERS)
    assert empty["n_total_sents"] == 0 and empty["fus_headline"] is None and set(aggregates.MODEL_COLUMNS) <= set(empty)
    assert pipelines.sentence_view(spark, body, "TSLA", SCORERS).where("fused is null").count() == 2


@pytest.fixture(scope="module")
def prices(spark):
    days = pd.bdate_range("2024-11-01", periods=80)
    rows = [("TSLA", d.date(), 102.0 + i, 98.0 + i, 100.0 + i + (i % 3), 1000.0 + i % 7) for i, d in enumerate(days)]
    bars = spark.createDataFrame(rows, "symbol string, bar_date date, high double, low double, close double, volume double")
    bench = spark.createDataFrame([(d.date(), 400.0 + i + i % 5) for i, d in enumerate(days)], "bar_date date, market_close double")
    return bars, bench, pit.weekday_calendar(spark, "2024-12-01", "2025-02-28")


def test_market_merge_and_reports(spark, corpus, prices):
    bars, bench, schedule = prices
    articles = corpus.withColumn("ticker", F.lit("TSLA"))
    m = pipelines.market_table(articles, bars, bench, schedule)
    assert m.count() == 40
    with pytest.raises(KeyError):
        pipelines.market_table(articles.withColumn("ticker", F.lit("KO")), bars, bench, schedule)
    t = pipelines.text_features(corpus.where("article_id < 8"), "TSLA", SCORERS)
    out, checks = pipelines.merged(t, m, articles, bars, strict=True)
    assert out.count() == 2 and checks.where("not passed").count() == 0 and len(out.columns) == len(t.columns) + len(market.MARKET_COLUMNS) - 3
    leaked = m.withColumn("momentum_1d", F.lit(0.5))
    with pytest.raises(ValueError, match="leak"):
        pipelines.merged(t, leaked, articles, bars, strict=True)
    tested = integrity.leakage_rows(m, bars)
    texts = [
        reports.fetch_report(corpus, "TSLA"), reports.cross_report(articles), reports.market_report(m, "TSLA", 40),
        reports.merge_report(t, m, out, checks, tested, out, "TSLA"), reports.feature_dictionary(t, {"source": "where it came from"}), reports.model_card({"features": ["a"], "n": 1}, spark.createDataFrame([(1,)], "fold int")),
    ]
    assert all(x.startswith("# ") and "|" in x for x in texts) and "where it came from" in texts[4] and "| 40 | 40 |" in texts[2]


def test_train_and_predict(spark, tmp_path):
    from tidemark.plans.inputs import pooled

    rows = pooled(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "bundle")
    pipelines.train(rows, path, models.logistic)
    out = pipelines.predict(rows, path)
    assert out.columns == ["session_open", "ticker", "timestamp_utc", "pred_direction", "proba_up"]
    assert out.count() == rows.select("session_open", "ticker").distinct().count() and out.where("proba_up between 0 and 1").count() == out.count()
    with pytest.raises(FileNotFoundError):
        pipelines.load_pooled(spark, path + "x")
