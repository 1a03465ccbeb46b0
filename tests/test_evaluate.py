import random
from math import comb

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.operators import aggregates, coverage, evaluate, models


def chunks(counts, n):
    cuts = evaluate.fold_cuts(counts, n)
    bounds = [-1, *cuts, len(counts) - 1]
    return [counts[a + 1 : b + 1] for a, b in zip(bounds, bounds[1:])]


@given(st.lists(st.integers(1, 60), min_size=2, max_size=60), st.integers(1, 8))
@settings(max_examples=300, deadline=None)
def test_cuts_leave_no_chunk_empty(counts, n):
    got = chunks(counts, n)
    assert all(got) and sum(got, []) == counts and len(got) <= n + 1


def test_cuts_even_out_bursts():
    rng = random.Random(3)
    counts = [rng.randint(3, 67) for _ in range(21)]
    sizes = [sum(c) for c in chunks(counts, 5)]
    assert len(sizes) == 6 and max(sizes) <= 1.8 * sum(counts) / 6
    assert [sum(c) for c in chunks([6] * 60, 5)] == [60] * 6
    assert evaluate.fold_cuts([2, 2], 1) == [0]


def test_folds_are_disjoint_and_expand(spark):
    df = spark.createDataFrame([(i, i // 7) for i in range(210)], "i long, g long")
    rows = evaluate.folds(evaluate.assign_chunks(df, "g")).collect()
    train = {}
    for k in range(1, 6):
        tr, te = ({r.i for r in rows if r.fold == k and r.role == role} for role in ("train", "test"))
        assert tr and te and not tr & te and max(tr) < min(te)
        assert train.get(k - 1, set()) <= tr
        train[k] = tr
    assert evaluate.assign_chunks(df.limit(0), "g").count() == 0


def test_exact_tail():
    assert evaluate.binomial_tail(0, 0) is None and evaluate.binomial_tail(3, 3) == 0.125
    assert evaluate.binomial_tail(8, 10) == pytest.approx(sum(comb(10, i) for i in (8, 9, 10)) / 1024)


def test_auc_and_ranks_match_numpy(spark):
    rng = np.random.default_rng(0)
    score, truth = rng.integers(0, 30, 500) / 7.0, rng.integers(0, 2, 500)
    df = spark.createDataFrame([(float(s), int(t)) for s, t in zip(score, truth)], "s double, t int")
    wins = sum((a > b) + 0.5 * (a == b) for a in score[truth == 1] for b in score[truth == 0])
    assert evaluate.auc(df, "t", "s").first().auc == pytest.approx(wins / ((truth == 1).sum() * (truth == 0).sum()))
    assert evaluate.auc(df.where("t = 1"), "t", "s").first().auc is None
    ranked = coverage.distributed_rank(df.repartition(5), "s", "r").withColumn("e", coverage.average_rank("s"))
    assert ranked.where(F.abs(F.col("r") - F.col("e")) > 1e-9).count() == 0


def test_correlation_of_a_constant_is_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "x double, y double")
    assert coverage.pearson(df, "x", "y").first().pearson is None
    assert coverage.spearman(df, "x", "y").first().spearman is None
    assert coverage.pearson(df, "y", "y").first().pearson == pytest.approx(1)


def test_sample_metrics(spark):
    df = spark.createDataFrame([(1, 1.5), (1, 0.2), (0, 1.0), (0, 0.1), (None, 9.0)], "hand int, s double")
    r = evaluate.evaluate_sample(df, "hand", "s").first()
    assert (r.tp, r.fp, r.fn, r.tn, r.n) == (1, 1, 1, 1, 4) and r.precision == r.recall == 0.5
    empty = evaluate.evaluate_sample(df.where("hand = 0 and s < 0.5"), "hand", "s").first()
    assert empty.precision == 0.0 and empty.recall == 0.0
    sweep = evaluate.threshold_analysis(df, "hand", "s", [0.0, 1.0, 2.0]).orderBy("threshold").collect()
    assert [x.tp + x.fp for x in sweep] == [4, 2, 0]


def test_kappa_by_table(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 5, 300), rng.integers(0, 5, 300)
    b = np.where(rng.random(300) < 0.5, a, b)
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a int, b int")
    w = (np.arange(5)[:, None] - np.arange(5)[None, :]) ** 2
    o = np.histogram2d(a, b, bins=[range(6), range(6)])[0] / 300
    e = np.outer(o.sum(1), o.sum(0))
    assert evaluate.kappa_quadratic(df, "a", "b").first().kappa == pytest.approx(1 - (w * o).sum() / (w * e).sum())


def test_score_card_baseline_accepts_all(spark):
    df = spark.createDataFrame([(i % 7 != 0, i % 3 == 0, i % 2 == 0, i % 10 == 0) for i in range(100)], "is_target boolean, accepted boolean, has_span boolean, borderline boolean")
    rows = evaluate.judge_score_card(df).collect()
    assert len(rows) == 12
    for r in rows:
        if r.judge == "baseline":
            assert r.n_accepted == r.n and r.error_recall == 0 and r.correct_lost == 0 and r.accept_precision == r.baseline_precision
        assert r.accept_precision_lo <= r.accept_precision <= r.accept_precision_hi


def test_skill_is_found_and_noise_is_not(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i // 10, float(x), 1 if x > 0 else -1, int(rng.choice([-1, 1]))) for i, x in enumerate(rng.normal(size=600))]
    df = spark.createDataFrame(rows, "i long, g long, x double, good int, noise int")
    for label, skilled in (("good", True), ("noise", False)):
        p = models.walk_forward(df, ["x"], label, "g", ["i"], 3, models.logistic)
        m = models.fold_metrics(p, label).collect()
        assert len(m) == 3 and all(r.significantly_beats_baseline is skilled for r in m) if skilled else sum(r.significantly_beats_baseline for r in m) <= 1


def test_bundle_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 7), None if i % 5 == 0 else 1.0, 1 if i % 7 > 3 else -1) for i in range(140)], "i long, x double, y double, l int")
    model = models.fit(df, ["x", "y"], "l", lambda: models.boosted_trees(maxIter=2))
    models.save_bundle(model, ["x", "y"], {"label": "l"}, str(tmp_path / "b"), spark)
    loaded, meta = models.load_bundle(str(tmp_path / "b"), spark)
    assert meta["features"] == ["x", "y"]
    a, b = (sorted((r.i, r.proba_up) for r in models.predict(m, df, ["x", "y"]).collect()) for m in (model, loaded))
    assert a == b and all(0 <= p <= 1 for _, p in a)
    with pytest.raises(ValueError):
        models.predict(model, df.drop("y"), ["x", "y"])
    assert models.importances(model, ["x", "y"], spark).count() == 2 and models.telltale_features(df, ["x", "y"], "l", 1) == ["x"]
    assert models.neighbours({"a": 2}, {"a": [1, 2, 3]}) == [{"a": 1}, {"a": 3}]
    found = models.search(df, ["x"], "l", "i", ["i"], {"maxIter": [5, 10]}, 3, factory=models.logistic)
    assert found and found[0][0] >= found[-1][0]


def test_coverage(spark):
    rows = [("A", f"2025-01-0{d} 10:00:00") for d in (1, 1, 2, 6)] + [("B", "2025-03-01 00:00:00")]
    df = spark.createDataFrame(rows, "ticker string, t string").withColumn("timestamp_utc", F.col("t").cast("timestamp"))
    days = coverage.daily_counts(df, by="ticker")
    assert [r.articles for r in days.where("ticker = 'A'").orderBy("day").collect()] == [2, 1, 0, 0, 0, 1]
    s = {r.ticker: r for r in coverage.coverage_summary(days, "ticker").collect()}
    assert (s["A"].longest_gap_days, s["A"].active_days, s["A"].days_in_span) == (3, 3, 6) and s["B"].longest_gap_days == 0
    b = [r.burst for r in coverage.bursts(df.where("ticker = 'A'"), "ticker", "timestamp_utc", 3).orderBy("t").collect()]
    assert b == [1, 1, 1, 2]
    assert coverage.daily_counts(df.limit(0), by="ticker").count() == 0


def test_session_table(spark):
    cols = "article_id long, ticker string, session_open timestamp, timestamp_utc timestamp, source string, session string, label_direction int, abnormal_return_1d double"
    base = "select * from values (1L,'A',timestamp'2025-01-02 14:30:00',timestamp'2025-01-01 10:00:00','x','pre-market',cast(null as int),cast(null as double)), (2L,'A',timestamp'2025-01-02 14:30:00',timestamp'2025-01-01 12:00:00','y','after-hours',1,0.5), (3L,'A',timestamp'2025-01-02 14:30:00',timestamp'2025-01-01 12:00:00','y','after-hours',1,0.5) as t(article_id,ticker,session_open,timestamp_utc,source,session,label_direction,abnormal_return_1d)"
    df = spark.sql(base)
    assert [f.name for f in df.schema] == [c.split()[0] for c in cols.split(", ")]
    extra = {c: F.col("article_id") for c in aggregates.SESSION_SUMS} | {c: F.col("article_id") / 10.0 for c in aggregates.SESSION_MEANS.values()} | {c: F.col("article_id") for c in aggregates.MARKET_SNAPSHOT}
    extra["fus_conf_graft_floor_mean"] = F.when(F.col("article_id") == 1, F.lit(-0.5)).when(F.col("article_id") == 2, F.lit(0.5))
    r = aggregates.session_table(df.withColumns(extra)).first()
    assert (r.n_articles, r.n_sources, r.label_direction, r.abnormal_return_1d, r.n_total_sents) == (3, 2, 1, 0.5, 6)
    assert r.fus_sentiment_loudest == -0.5 and r.fus_sentiment_mean == 0.0 and r.momentum_1d == 2
    assert r["published_pre-market_share"] == pytest.approx(1 / 3) and r["published_after-hours_share"] == pytest.approx(2 / 3) and r["published_market-hours_share"] == 0
    assert set(aggregates.SESSION_FEATURES) <= set(r.asDict())
    single = aggregates.session_table(df.withColumns(extra).where("article_id = 3")).first()
    assert single.fus_sentiment_std == 0.0 and single.fus_sentiment_loudest is None
