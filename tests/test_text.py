import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.functions import fixed
from tidemark.functions import scores as S
from tidemark.functions import text as T
from tidemark.operators import aggregates, caching, sentences as ops


def one(spark, expr, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(expr.alias("r")).first().r


def test_sentences(spark):
    text = "  This is the first sentence here.  Short one. (A second) long sentence! \"Quoted and long enough too? Next sentence number four"
    assert one(spark, T.sentences(F.col("t")), t=text) == ["This is the first sentence here.", "(A second) long sentence!", '"Quoted and long enough too?', "Next sentence number four"]
    assert one(spark, T.fix_missing_space(F.col("t")), t="ended.Then 3.5 up.Next") == "ended. Then 3.5 up. Next"


@pytest.mark.parametrize("text,hit", [("TESLA rose", True), ("buy $TSLA now", True), ("tsla-stock-analysis", False), ("Teslas", False), ("(Tesla, Inc.)", True), (None, False)])
def test_names(spark, text, hit):
    assert one(spark, T.names_any(F.lit(text).cast("string"), T.aliases("TSLA", "names"))) is hit


@pytest.mark.parametrize(
    "text,score",
    [("Shares quickly rose today", 1.0), ("market shares rose", 0.0), ("stock closed up 3.5 %", 2.0), ("here's why", 0.5), ("a rally and a slump and a rout", 0.5), ("the stocks are down", 0.5), ("", 0.0), ("Stock surges 5% higher to hit a new record high", 3.0)],
)
def test_reactive(spark, text, score):
    assert one(spark, T.reactive_score(F.col("t")), t=text) == score


def test_words_of_patterns_lose_no_hit(spark):
    known = ["shares of it ROSE", "Stocks quickly fell", "stock finished", "up 3.5 %", "5% rebound", "extended slide", "hits a new all-time low", "fifty-two week high", "52-week low", "a sell-off", "heres why", "Investors shrugged",
             "underperformed", "after-hours movers", "pre-market trading", "moving the markets", "biggest losers", "what's behind", "shares are down"]
    odd = ["\u017fhare\u017f ro\u017fe", "h\u0130t a record h\u0131gh", "52-wee\u212a high", "I\u0307nvestors cheered", "market shares fell", "stock", "", None]
    rows = [(t,) for t in known + odd + [" ".join(known), "\u0130 " + " ".join(known).upper()]]
    df = spark.createDataFrame(rows, "t string").withColumn("t", F.coalesce("t", F.lit("")))
    plain = lambda patterns: sum((F.col("t").rlike(f"(?iU){p}").cast("int") for p in patterns), F.lit(0))
    out = df.select("t", T.reactive_score(F.col("t")).alias("s"), (1.0 * plain(fixed.STRONG_PATTERNS) + 0.5 * plain(fixed.WEAK_PATTERNS)).alias("e"), F.size(T.reactive_hits(F.col("t"))).alias("n"), plain(fixed.STRONG_PATTERNS + fixed.WEAK_PATTERNS).alias("m"))
    assert [r for r in out.collect() if r.s != r.e or r.n != r.m] == []
    assert out.where("m > 0").count() >= len(known) + 5 and out.agg(F.max("m")).first()[0] == 17
    assert "contains(" in df.select(T.reactive_score(F.col("t")))._jdf.queryExecution().optimizedPlan().toString().lower()


def test_reactive_hits_and_article(spark):
    assert one(spark, T.reactive_hits(F.col("t"), "H"), t="Shares rose, here's why") == ["H! Shares rose", "H? here's why"]
    s = spark.createDataFrame([(1, True, "shares fell hard"), (1, True, "nothing"), (1, False, "stock rose"), (2, False, "x")], "article_id long, mentions_target boolean, text string")
    tagged = ops.tag_reactive(s)
    got = {r.article_id: r for r in tagged.groupBy("article_id").agg(*aggregates.reactive_aggregates(tagged)).collect()}
    assert (got[1].n_reactive_sents, got[1].reactive_share, got[1].reactive_mean, got[1].reactive_max) == (1, 0.5, 0.5, 1.0)
    assert (got[2].n_reactive_sents, got[2].reactive_share) == (0, None)
    with pytest.raises(ValueError):
        aggregates.reactive_aggregates(s)


@pytest.mark.parametrize(
    "surface,ok",
    [("it", True), ("They’re", True), ("the company's", True), ("stock", True), ("the electric carmaker", True), ("company products", False), ("he", False), ("the earnings call", False), ("", False), ("a school bus with its stop brand", False), ("this", False), ("our firm,", True)],
)
def test_substitutable(spark, surface, ok):
    assert one(spark, T.is_substitutable(F.col("s")), s=surface) is ok


@pytest.mark.parametrize(
    "text,span,out,outcome",
    [
        ("It's also profitable", (0, 2), "Tesla is also profitable", "substituted"),
        ("It'll grow", (0, 2), "Tesla will grow", "substituted"),
        ("Its margin", (0, 3), "Tesla's margin", "substituted"),
        ("They're growing", (0, 7), "Tesla are growing", "substituted"),
        ("the company's plan", (0, 13), "Tesla's plan", "substituted"),
        ("the CEO spoke", (0, 7), "the CEO spoke", "person"),
        ("a bus came", (0, 5), "a bus came", "not_mention"),
        ("It grew", (None, None), "It grew", "no_span"),
        ("grew it", (5, 70), "grew it", "bad_span"),
    ],
)
def test_substitution(spark, text, span, out, outcome):
    df = spark.createDataFrame([(text, *span)], "t string, a int, b int")
    new, how = T.substitution(F.col("t"), F.col("a"), F.col("b"), F.lit("Tesla"))
    assert tuple(df.select(new, how).first()) == (out, outcome)


def test_pairs(spark):
    rows = [(1, "Tesla rose", True, False, False, None, None), (2, "It rose", True, False, True, 0, 2), (3, "Elon Musk spoke", False, True, False, None, None), (4, "other", False, False, False, None, None)]
    df = spark.createDataFrame(rows, "i int, text string, mentions_target boolean, mentions_ceo boolean, resolved_by_coref boolean, mention_char_start int, mention_char_end int")
    got = {r.i: (r.absa_text, r.absa_aspect) for r in ops.build_pairs(df, "TSLA").collect()}
    assert got == {1: ("Tesla rose", "Tesla"), 2: ("Tesla rose", "Tesla"), 3: ("Elon Musk spoke", "Elon Musk"), 4: ("", "")}


def test_tagging_with_clusters(spark):
    body = "Tesla opened a plant in the north. It hired many hundred people there. Elon Musk visited the new plant."
    docs = spark.createDataFrame([(1, body, [[(0, 5), (35, 37)], [(71, 80)]])], "article_id long, text string, clusters array<array<struct<s:int,e:int>>>")
    tagged = ops.tag_sentences(ops.located_sentences(docs), "TSLA", ops.map_clusters(docs, "TSLA")).orderBy("sent_idx").collect()
    assert [(r.mentions_target, r.mentions_ceo, r.resolved_by_coref, r.mention_char_start, r.mention_char_end) for r in tagged] == [(True, False, False, None, None), (True, False, True, 0, 2), (False, True, False, None, None)]
    titled = docs.withColumn("clusters", F.expr("array(array(named_struct('s', 0, 'e', 5), named_struct('s', 35, 'e', 37)))")).withColumn("p", F.expr("array(named_struct('s', 0, 'e', 5))"))
    assert ops.map_clusters(titled, "TSLA", persons="p").count() == 0


def test_boilerplate_needs_five_articles(spark):
    df = spark.createDataFrame([(i % n, n, f"text {n}") for n in (4, 5) for i in range(10)], "article_id long, sent_idx int, text string")
    got = {r.text: r.is_boilerplate for r in aggregates.flag_boilerplate(df).collect()}
    assert got == {"text 4": False, "text 5": True}


def sentence_rows(spark, rows):
    names = "article_id long, sent_idx int, pos double, neg double, neu double, absa_pos double, absa_neg double, absa_neu double, mentions_target boolean, mentions_ceo boolean, is_boilerplate boolean, resolved_by_coref boolean, mention_char_start int, char_len int"
    return spark.createDataFrame(rows, names)


def test_fusion_by_hand(spark):
    df = sentence_rows(spark, [(1, 0, 0.8, 0.1, 0.1, 0.2, 0.6, 0.2, True, False, False, False, None, 10), (1, 1, None, 0.1, 0.1, 0.2, 0.6, 0.2, True, False, False, False, None, 10)])
    a, b = df.select("sent_idx", *[c.alias(n) for n, c in S.score_variants(0.5).items()]).orderBy("sent_idx").collect()
    assert a.fin == pytest.approx(0.7) and a.absa == pytest.approx(-0.4) and a.mean_blend == pytest.approx(0.15) and a.sign_graft == 0.0
    assert a.conf_graft == pytest.approx(-0.28) and a.conf_graft_soft == pytest.approx(-0.49) and a.conf_graft_floor == pytest.approx(-0.7 * 0.82)
    assert a.gated == pytest.approx(0.56) and a.agree_only == 0.0
    assert all(b[n] is None for n in S.VARIANTS if n != "absa")


def test_article_aggregates(spark):
    rows = [(1, i, p, 0.0, 0.0, 1.0, 0.0, 0.0, True, False, False, i == 3, 1 if i == 3 else None, 5) for i, p in enumerate([0.1, -0.9, 0.5, 0.9, 0.3])]
    rows += [(1, 5, 0.7, 0.0, 0.0, 1.0, 0.0, 0.0, True, False, True, False, None, 5), (2, 0, 0.7, 0.0, 0.0, 1.0, 0.0, 0.0, False, True, False, False, None, 5), (3, 0, None, None, None, None, None, None, False, False, False, False, None, 5)]
    df = sentence_rows(spark, rows)
    out = aggregates.article_features(df)
    assert out.columns == ["article_id", *aggregates.MODEL_COLUMNS]
    got = {r.article_id: r for r in out.collect()}
    scores = [0.1, 0.9, 0.5, 0.9, 0.3]  # the sign is the second scorer's
    assert got[1].fus_conf_graft_floor_mean == pytest.approx(sum(scores) / 5 * 5 / 9)
    assert got[1].fus_conf_graft_floor_median == pytest.approx(0.5) and got[1].fus_conf_graft_floor_top3_pos == pytest.approx(2.3 / 3) and got[1].fus_conf_graft_floor_top3_neg == pytest.approx(0.3)
    assert got[1].n_total_sents == 5 and got[1].n_boilerplate_sents == 1 and got[1].article_length == 30 and got[1].fus_maxmag == pytest.approx(0.9)
    assert got[2].fus_conf_graft_floor_mean is None and got[2].fus_conf_graft_floor_lead == 0.0 and got[2].has_ceo_mention and got[2].fus_ceo_mean == pytest.approx(0.7)
    heads = spark.createDataFrame([(2, 0.9, 0.1, 0.9, 0.1), (3, 0.9, 0.1, 0.9, 0.1)], "article_id long, pos double, neg double, absa_pos double, absa_neg double")
    kept = {r.article_id: r for r in aggregates.article_features(df, heads, named=F.col("article_id") == 2).collect()}
    assert set(kept) == {1, 2} and kept[2].fus_conf_graft_floor_mean == 0.0 and kept[2].fus_headline_gap == kept[2].fus_headline and kept[1].fus_headline is None


#: Two scores of one size and opposite signs, as order lines make them.
EVEN = [(0.94, 0.64, 0.1, 0.2, 0.48, 0.1), (0.86, 0.56, 0.1, 0.7000000000000001, 0.42000000000000004, 0.1)]


def test_article_keeps_the_first_of_equally_loud_scores(spark):
    df = sentence_rows(spark, [(a, i, *EVEN[(a + i) % 2], True, False, False, False, None, 5) for a in (0, 1) for i in (0, 1)])
    got = {r.article_id: r.fus_maxmag for r in aggregates.article_features(df).collect()}
    assert got == {0: pytest.approx(-0.2352), 1: pytest.approx(0.2352)}


def test_extra_aggregates_keep_the_first_of_equally_loud_scores(spark):
    df = sentence_rows(spark, [(a, i, *EVEN[(a + i) % 2], True, False, False, False, None, 5) for a in (0, 1) for i in (0, 1)])
    got = {r.article_id: r for r in df.groupBy("article_id").agg(*aggregates.extra_aggregates(df)).collect()}
    assert {a: r.fus_maxmag for a, r in got.items()} == {0: pytest.approx(-0.2352), 1: pytest.approx(0.2352)} and got[0].n_trusted_sents == 2


def test_equally_loud_scores_of_lines_without_a_number_come_first(spark, tmp_path):
    loud = [(0.08, 0.02, 47.0), (0.07, 0.07, 43.0)]
    orders = [(None, 0), (0, None), (1, 2), (2, 1), (-1, None)]
    rows = [(k, n, *x, "A", "F") for k, pair in enumerate(orders) for n, x in zip(pair, loud)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_discount double, l_tax double, l_quantity double, l_returnflag string, l_linestatus string").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = __spark_entry__.queries()["extra_fusion_aggs"](spark, str(tmp_path)).orderBy("article_id").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(f"SELECT * FROM ({__spark_entry__.oracle_sql()['extra_fusion_aggs']}) q ORDER BY article_id").fetchall()
    assert [tuple(r) for r in got] == want and [r.fus_maxmag for r in got] == [-0.2352, 0.2352, -0.2352, 0.2352, 0.2352]


def test_channels_partition_the_population(spark):
    rows = [(1, i, 0.5, 0.1, 0.1, 0.5, 0.1, 0.1, i % 5 != 0, False, i % 7 == 0, i % 3 == 0, 1 if i % 2 else None, 5) for i in range(60)]
    df = sentence_rows(spark, rows)
    r = df.groupBy("article_id").agg(*aggregates.provenance_aggregates(df), *aggregates.shape_aggregates(df)).first()
    assert r.prov_surface_n + r.prov_coref_span_n + r.prov_coref_nospan_n == r.n_entity_sents
    assert r.prov_surface_share + r.prov_coref_span_share + r.prov_coref_nospan_share == pytest.approx(1)


def test_empty_sentences_keep_the_schema(spark):
    df = sentence_rows(spark, [])
    out = aggregates.article_features(df)
    assert out.count() == 0 and out.columns == ["article_id", *aggregates.MODEL_COLUMNS]


def test_cache_is_used_and_merged(spark):
    seen = spark.sparkContext.accumulator(0)

    def scorer(frame):
        seen.add(len(frame))
        return pd.DataFrame({"pos": [0.5] * len(frame), "neg": 0.25, "neu": 0.25})

    df = spark.createDataFrame([(1, "alpha", True), (2, "alpha", True), (3, "beta", True), (4, "beta", False)], "i int, text string, mentions_target boolean").withColumn("mentions_ceo", F.lit(False))
    cache = spark.createDataFrame([("alpha", 0.9, 0.05, 0.05)], "text string, pos double, neg double, neu double").select(T.text_hash(F.col("text")).alias("_hash"), "pos", "neg", "neu")
    got = {r.i: r.pos for r in caching.score_sentences(df, scorer, cache).collect()}
    assert got == {1: 0.9, 2: 0.9, 3: 0.5, 4: None} and seen.value == 1
    merged = {r["_hash"]: r.pos for r in caching.merge_cache(cache, cache.withColumn("pos", F.lit(0.1)), ["_hash"]).collect()}
    assert list(merged.values()) == [0.1]


def test_pair_scores(spark):
    df = spark.createDataFrame([("a b", "X"), ("a b", ""), (None, None)], "absa_text string, absa_aspect string")
    got = caching.score_pairs(df, caching.lexicon_scorer(["a"], ["b"])).collect()
    assert sorted((r.absa_aspect or "", r.absa_pos) for r in got if r.absa_pos is not None) == [("X", pytest.approx(1 / 3))]
    assert set(caching.without_scorer(df).columns) >= {"absa_pos", "absa_neg", "absa_neu"}


def test_judge_fails_closed(spark):
    rows = spark.createDataFrame([(1, i, "T") for i in range(4)], "article_id long, sent_idx int, target string")

    def judge(row):
        if row["sent_idx"] == 1:
            raise RuntimeError
        return {0: "yes", 2: "no"}.get(row["sent_idx"], "maybe")

    first = caching.judge_pending(rows, None, judge, "m", "v1")
    assert {r.sent_idx: r.answer for r in first.collect()} == {0: "yes", 1: "unsure", 2: "no", 3: "unsure"}
    known = spark.createDataFrame(first.where("sent_idx < 3").collect(), first.schema)
    again = caching.judge_pending(rows, known, lambda r: "yes", "m", "v1")
    assert {r.sent_idx: r.answer for r in again.collect()} == {0: "yes", 1: "unsure", 2: "no", 3: "yes"}
    other = caching.judge_pending(rows, known, lambda r: "no", "m", "v2")
    assert other.where("prompt_version = 'v2'").count() == 4


def test_resolver_that_fails_leaves_no_clusters(spark):
    docs = spark.createDataFrame([("a text",), ("a text",), ("",)], "text string")

    def broken(texts):
        raise RuntimeError

    assert [r.clusters for r in caching.resolve_mentions(docs, broken).collect()] == [[], []]
    found = caching.resolve_mentions(docs, lambda texts: [[[(0, 1)]] for _ in texts]).collect()
    assert sorted(len(r.clusters) for r in found) == [0, 1]


def test_contexts_and_prompt(spark):
    s = spark.createDataFrame([(1, i, f"Sentence {i}.", None, None) for i in (0, 1, 2, 3, 4, 6, 7)], "article_id long, sent_idx int, text string, mention_char_start int, mention_char_end int")
    h = spark.createDataFrame([(1, "Head")], "article_id long, headline string")
    built = ops.contexts(s, h)
    r = built.where("sent_idx = 6").first()
    assert r.preceding == ["Sentence 2.", "Sentence 3.", "Sentence 4."] and r.following == ["Sentence 7."]
    assert r.context == "HEADLINE: Head\n\n  Sentence 2.\n  Sentence 3.\n  Sentence 4.\n> Sentence 6.\n  Sentence 7."
    p = ops.prompts(built, "TSLA", "sys", "span {company}", "nospan {company}").where("sent_idx = 0").first().prompt
    assert p.startswith("<|im_start|>system\nsys<|im_end|>\n<|im_start|>user\nnospan Tesla\n\n---\nHEADLINE: Head")
    assert one(spark, T.marked(F.col("t"), F.lit(0), F.lit(2)), t="It rose") == "**It** rose"


def test_sample_caps(spark):
    df = spark.createDataFrame([("s", i // 10, i) for i in range(200)], "stratum string, article_id long, sent_idx long")
    a = ops.stratified_sample(df, ["article_id", "sent_idx"], per_stratum=30)
    rows = a.collect()
    assert len(rows) == 30 and max(pd.Series([r.article_id for r in rows]).value_counts()) <= 2
    assert rows == ops.stratified_sample(df.repartition(7), ["article_id", "sent_idx"], per_stratum=30).collect() or sorted(rows) == sorted(ops.stratified_sample(df.repartition(7), ["article_id", "sent_idx"], per_stratum=30).collect())
