"""Operators at their seams: ranges, hot keys, rows without a key, long tails."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates, caching, coverage, evaluate, models, sentences
from tidemark.plans import catalogue
from tidemark.sources import tables


@pytest.mark.parametrize("held", [7, 100_000])
def test_counted_values_over_ranges(spark, monkeypatch, held):
    monkeypatch.setattr(coverage, "RANGE", held)
    rng = np.random.default_rng(0)
    x = [None if i % 17 == 0 else float(v) for i, v in enumerate(rng.integers(0, 120, 900) / 4)]
    df = spark.createDataFrame([(i, v, None if v is None else f"k{v:06.2f}") for i, v in enumerate(x)], "i long, x double, s string")
    known = sorted(v for v in x if v is not None)
    for column in ("x", "s"):
        got = {r.i: r.rank for r in coverage.distributed_rank(df, column, "rank").collect()}
        assert len(got) == 900
        for i, v in enumerate(x):
            assert got[i] == (None if v is None else sum(y < v for y in known) + (known.count(v) + 1) / 2)
    shares = [0.0, 0.2, 0.25, 0.5, 0.9, 1.0]
    assert np.allclose(coverage.quantiles(df, "x", shares).first().q, np.quantile(known, shares))
    assert coverage.quantiles(df.where("x is null"), "x", shares).first().q == [None] * 6


@pytest.mark.parametrize("held", [7, 100_000])
def test_ranks_within_large_groups(spark, monkeypatch, held):
    monkeypatch.setattr(coverage, "RANGE", held)
    rng = np.random.default_rng(1)
    rows = [(i, [None, "a", "b"][i % 3], i % 2, None if i % 17 == 0 else float(v)) for i, v in enumerate(rng.integers(0, 60, 900) / 4)]
    df = spark.createDataFrame(rows, "i long, g string, h int, x double")
    for by in (["g"], ["g", "h"]):
        got = coverage.rank_within(df.withColumn("e", coverage.average_rank("x", *by)), "x", by, "k")
        assert got.columns == ["i", "g", "h", "x", "e", "k"] and got.count() == 900 and got.where("not k <=> e").count() == 0


def test_no_window_of_average_ranks_runs_over_rows(spark):
    out = catalogue.QUERIES["average_ranks"](spark, "/root/testdata/sf0.001")
    todo, held = [out._jdf.queryExecution().optimizedPlan()], []
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        held += [node.output().mkString(" ")] if node.nodeName() == "Window" else []
    assert held and not any("l_orderkey" in columns for columns in held)


def test_bounds_do_not_depend_on_the_run(spark, monkeypatch):
    monkeypatch.setattr(coverage, "RANGE", 500)
    df = spark.range(20_000).select((F.col("id") * 7 % 20_000).alias("x"))
    bounds = coverage._bounds(df, "x")
    assert bounds == sorted(bounds) == coverage._bounds(df.repartition(3), "x") and 2 <= len(bounds) <= 8


def test_binomial_tail_of_many_rows():
    began = time.perf_counter()
    assert evaluate.binomial_tail(500_500, 10**6) == pytest.approx(0.15888, rel=1e-3)
    assert evaluate.binomial_tail(10**6, 10**6) == 0.0 and evaluate.binomial_tail(0, 10**6) == 1.0
    assert time.perf_counter() - began < 1
    for n in (1, 2, 3, 10, 57):
        for b in range(n + 2):
            assert evaluate.binomial_tail(b, n) == pytest.approx(sum(math.comb(n, i) for i in range(b, n + 1)) / 2**n, rel=1e-9, abs=1e-15)


def test_rows_without_a_hash_do_not_meet_in_one_task(spark):
    rows = [(i, 0, f"some text {i % 5}", i % 10 == 0, False) for i in range(400)]
    df = spark.createDataFrame(rows, "article_id long, sent_idx int, text string, mentions_target boolean, mentions_ceo boolean")
    out = caching.score_sentences(df, caching.lexicon_scorer(["some"], ["none"]))
    got = {r.article_id: r.pos for r in out.collect()}
    assert all((got[i] == 0.5) == (i % 10 == 0) and (got[i] is None) == (i % 10 != 0) for i in range(400))
    keyed = df.withColumn("_hash", F.lit(None).cast("string"))
    aside = caching._joined_back(keyed, spark.createDataFrame([], "_hash string, pos double"))
    assert aside.columns == [*df.columns, "pos"] and aside.count() == 400
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan


def test_frequent_sentences_are_dealt_out(spark):
    rows = [(i, 0, "the same line in every article") for i in range(300)] + [(i, 1, f"a line of article {i}") for i in range(300)] + [(i, 2, None) for i in range(9)] + [(7, 3 + i, "often, but in one article") for i in range(20)]
    df = spark.createDataFrame(rows, "article_id long, sent_idx int, text string")
    out = aggregates.flag_boilerplate(df)
    assert {(r.text or "").split()[0] if r.text else None for r in out.where("is_boilerplate").collect()} == {"the"}
    assert out.count() == len(rows) and out.where("is_boilerplate").count() == 300
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_share" in plan


def test_group_sizes_with_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "i long, k string")
    assert {r.i: r.group_size for r in aggregates.with_group_size(df, ["k"]).collect()} == {1: 2, 2: 2, 3: 2, 4: 2, 5: 1}


def test_regimes(spark):
    df = spark.createDataFrame([("2025-01-01 10:00:00",), ("2025-01-03 00:00:00",), ("2025-01-03 00:00:01",), ("2025-01-06 00:00:00",), (None,)], "t string").withColumn("t", F.col("t").cast("timestamp"))
    assert {r.regime: (r.days, r.rows, r.rows_a_day) for r in coverage.regimes(df, "t", "2025-01-03").collect()} == {"climb": (3, 2, 2 / 3), "descent": (4, 2, 0.5)}


def test_local_search_climbs(spark):
    rows = [(i, i // 10, float(i % 2), 1 if i % 2 else -1) for i in range(120)]
    df = spark.createDataFrame(rows, "article_id long, session long, x double, label int")
    asked = []

    def factory(maxIter, regParam):
        asked.append((maxIter, regParam))
        return models.logistic(maxIter=maxIter, regParam=regParam)

    space = {"maxIter": [1, 5, 20], "regParam": [0.01, 100.0]}
    seen = models.search(df, ["x"], "label", "session", ["article_id"], space, 2, factory=factory)
    found = models.local_search(df, ["x"], "label", "session", ["article_id"], space, seen[-1][1], seen, most=4, factory=factory)
    assert found[0][0] >= seen[0][0] and {p["maxIter"] for _, p in found} <= {1, 5, 20} and len({str(p) for _, p in found}) == len(found)


def test_persons_and_expletives_of_a_parse(spark):
    body = "Tesla opened a plant in the north. It rained there for many days. The company hired Elon there too."
    it, who = body.index("It rained"), body.index("The company")
    spans = lambda *x: [{"s": a, "e": b} for a, b in x]
    df = spark.createDataFrame([(1, body, [spans((0, 5), (it, it + 2), (who, who + 11))], spans((who, who + 11)), spans((it, it + 2)))], "article_id long, text string, clusters array<array<struct<s:int,e:int>>>, persons array<struct<s:int,e:int>>, dummies array<struct<s:int,e:int>>")
    located = sentences.located_sentences(df)
    tagged = lambda **k: {r.sent_idx: (r.mentions_target, r.mention_char_start) for r in sentences.tag_sentences(located, "TSLA", sentences.map_clusters(df, "TSLA", **k)).collect()}
    assert tagged() == {0: (True, None), 1: (True, 0), 2: (True, 0)}
    assert tagged(expletives="dummies") == {0: (True, None), 1: (False, None), 2: (True, 0)}
    assert tagged(persons="persons") == {0: (True, None), 1: (True, 0), 2: (True, None)}


def test_scratch_is_shared(spark):
    assert tables.scratch(spark, "x").startswith((spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/"))
