"""Sentence tables to article tables to session tables, each in one grouped pass of conditional aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import fixed
from tidemark.functions import scores as S

FUSION_COLUMNS = [f"fus_conf_graft_floor_{a}" for a in ("mean", "median", "lead", "top3_pos", "top3_neg", "spread")]
EXTRA_COLUMNS = ["fus_maxmag", "fus_trusted_mean", "fus_scorer_gap"]
SHAPE_COLUMNS = ["n_total_sents", "n_entity_sents", "n_ceo_sents", "n_ceo_mention_sents", "n_boilerplate_sents", "entity_share", "article_length"]
MODEL_COLUMNS = [*SHAPE_COLUMNS, *FUSION_COLUMNS, "fus_ceo_mean", "has_ceo_mention", "fus_headline", *EXTRA_COLUMNS, "fus_headline_gap", "fus_lead_gap"]

MARKET_SNAPSHOT = ["momentum_1d", "momentum_5d", "momentum_20d", "volatility_20d", "beta_20d", "relative_volume_20d", "daily_range_ratio_1d", "days_to_earnings", "news_volume"]
SESSION_SUMS = ["n_total_sents", "n_entity_sents", "n_ceo_sents", "n_boilerplate_sents", "article_length"]
SESSION_MEANS = {
    "entity_share": "entity_share", "has_ceo_mention": "has_ceo_mention", "fus_sentiment_mean": "fus_conf_graft_floor_mean", "fus_median": "fus_conf_graft_floor_median",
    "fus_lead": "fus_conf_graft_floor_lead", "fus_top3_pos": "fus_conf_graft_floor_top3_pos", "fus_top3_neg": "fus_conf_graft_floor_top3_neg", "fus_spread": "fus_conf_graft_floor_spread",
    "fus_ceo_mean": "fus_ceo_mean", "fus_headline": "fus_headline", "fus_maxmag": "fus_maxmag", "fus_trusted_mean": "fus_trusted_mean",
    "fus_scorer_gap": "fus_scorer_gap", "fus_headline_gap": "fus_headline_gap", "fus_lead_gap": "fus_lead_gap",
}
SESSION_TEXT = ["n_articles", "n_sources", *SESSION_SUMS[:4], "article_length", "entity_share", "has_ceo_mention", "fus_sentiment_mean", "fus_sentiment_std", "fus_sentiment_loudest", *list(SESSION_MEANS)[3:]]
#: Shares of a frequent text's rows that are joined apart.
SPREAD = 32
SESSION_FEATURES = [*SESSION_TEXT, *MARKET_SNAPSHOT, *[f"published_{s}_share" for s in fixed.SESSIONS]]


def _mean(x: Column, where: Column) -> Column:
    return F.avg(F.when(where, x))


def _n(where: Column) -> Column:
    return F.count_if(where).cast("long")


def flag_boilerplate(sentences: DataFrame, least: int = fixed.BOILERPLATE_ARTICLES) -> DataFrame:
    """Sets is_boilerplate where the exact text occurs in at least `least` articles.

    Texts go by their SHA-256, and are counted by (text, article) first, so a text of very many rows folds before
    it is dealt out. Frequent texts, of which there are at most a `least`-th of the articles' texts, are joined back once
    for each of SPREAD shares of the articles: a hot text's rows meet it in as many tasks, and as both sides of that
    join are shuffled for it, adaptive execution splits what is still too large.
    """
    keyed = sentences.drop("is_boilerplate").withColumn("_sha", F.sha2("text", 256))
    pairs = keyed.where("text is not null").select("_sha", "article_id").distinct()
    often = pairs.groupBy("_sha").agg(F.count("article_id").alias("_n")).where(F.col("_n") >= least)
    often = often.select("_sha", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_share"), F.lit(True).alias("_often"))
    dealt = keyed.withColumn("_share", F.pmod(F.xxhash64("article_id"), F.lit(SPREAD).cast("long")).cast("int"))
    return dealt.join(often, ["_sha", "_share"], "left").withColumn("is_boilerplate", F.coalesce("_often", F.lit(False))).drop("_often", "_sha", "_share")


def with_group_size(df: DataFrame, keys: list[str], out: str = "group_size") -> DataFrame:
    """`df` with the number of rows of its group. Rows are counted before they are dealt out, and no task holds a group; NULL keys are a group."""
    sizes = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count("*").cast("long").alias(out))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return df.join(sizes, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def fusion_aggregates(df: DataFrame) -> list[Column]:
    """mean, median, lead, top3_pos, top3_neg, spread of the shipped score over the target population."""
    x = F.when(S.target_population(df), S.fuse())
    early = F.when(F.col("sent_idx") < fixed.LEAD_SENTENCES, x)
    high, low = S.top_mean(x), S.top_mean(x, largest=False)
    made = [F.avg(x), F.percentile(x, F.lit(0.5)), F.coalesce(F.avg(early), F.lit(0.0)), high, low, high - low]
    return [c.alias(name) for c, name in zip(made, FUSION_COLUMNS)]


def provenance_aggregates(df: DataFrame) -> list[Column]:
    """For each channel its number of target sentences, their share and their mean score."""
    target, x = S.target_population(df), S.fuse()
    out = []
    for name in fixed.CHANNELS:
        mine = target & F.coalesce(S.provenance_channel(df) == name, F.lit(False))
        out += [_n(mine).alias(f"prov_{name}_n"), F.try_divide(_n(mine), _n(target)).alias(f"prov_{name}_share"), _mean(x, mine).alias(f"prov_{name}_conf_graft_floor_mean")]
    return out


def extra_aggregates(df: DataFrame, *tie: str) -> list[Column]:
    """Loudest score, mean over the trusted channels, mean distance of the two scorers, number of trusted sentences."""
    target, x = S.target_population(df), S.fuse()
    mine = F.when(target, x)
    trusted = target & F.coalesce(S.provenance_channel(df).isin(fixed.TRUSTED_CHANNELS), F.lit(False)) & x.isNotNull()
    gap = F.abs(S.signed("pos", "neg") - S.signed("absa_pos", "absa_neg"))
    return [S.loudest(mine, F.col("sent_idx")).alias("fus_maxmag"), _mean(x, trusted).alias("fus_trusted_mean"), _mean(gap, target).alias("fus_scorer_gap"), _n(trusted).alias("n_trusted_sents")]


def chief_aggregate(df: DataFrame) -> Column:
    return _mean(S.fuse(), S.chief_any(df)).alias("fus_ceo_mean")


def shape_aggregates(df: DataFrame) -> list[Column]:
    boiler, target = S.flag("is_boilerplate", df), S.target_population(df)
    return [
        _n(~boiler).alias("n_total_sents"), _n(target).alias("n_entity_sents"), _n(S.chief_only(df)).alias("n_ceo_sents"), _n(S.chief_any(df)).alias("n_ceo_mention_sents"),
        _n(boiler).alias("n_boilerplate_sents"), F.coalesce(F.try_divide(_n(target), _n(~boiler)), F.lit(0.0)).alias("entity_share"), F.coalesce(F.sum("char_len"), F.lit(0)).cast("long").alias("article_length"),
    ]


def wide_aggregates(df: DataFrame) -> list[Column]:
    """The diagnostic columns: mean triples by population, the loudest triple, the opening, both scorers."""
    target, chief = S.target_population(df), S.chief_only(df)
    early = target & (F.col("sent_idx") < fixed.LEAD_SENTENCES)
    absa = all(c in df.columns for c in ("absa_pos", "absa_neg", "absa_neu"))
    out = []
    for part in ("pos", "neg", "neu"):
        out += [_mean(F.col(part), target).alias(f"sent_entity_{part}"), _mean(F.col(part), early).alias(f"sent_entity_lead_{part}"), _mean(F.col(part), chief).alias(f"sent_ceo_{part}")]
        scored = F.col(f"absa_{part}") if absa else F.lit(None).cast("double")
        out += [_mean(scored, target).alias(f"absa_entity_{part}"), _mean(scored, chief).alias(f"absa_ceo_{part}")]
    size = F.abs(S.signed("pos", "neg"))
    rank = F.when(target & size.isNotNull(), F.struct(size, -F.col("sent_idx")))
    for part in ("pos", "neg", "neu"):
        out.append(F.max_by(F.col(part), rank).alias(f"sent_entity_maxmag_{part}"))
    return out


def reactive_aggregates(df: DataFrame) -> list[Column]:
    """n_reactive_sents, and share, mean and maximum over the target population, NULL where that is empty."""
    absent = [c for c in ("is_reactive", "reactive_score", "mentions_target") if c not in df.columns]
    if absent:
        raise ValueError(f"sentence table lacks {absent}")
    target = S.target_population(df)
    hit = target & (F.col("is_reactive").cast("int") == 1)
    return [
        _n(F.coalesce(hit, F.lit(False))).alias("n_reactive_sents"), F.try_divide(_n(F.coalesce(hit, F.lit(False))), _n(target)).alias("reactive_share"),
        _mean(F.col("reactive_score"), target).alias("reactive_mean"), F.max(F.when(target, F.col("reactive_score"))).alias("reactive_max"),
    ]


def reactive_article(share: Column, headline: Column, least_headline: float = 1.0, least_share: float = 0.5) -> Column:
    return F.coalesce(headline >= least_headline, F.lit(False)) | (F.coalesce(share, F.lit(0.0)) >= least_share)


def article_features(sentences: DataFrame, headlines: DataFrame | None = None, named: Column | None = None) -> DataFrame:
    """article_id with MODEL_COLUMNS, from sentences scored by both scorers.

    `headlines` is (article_id, pos, neg, absa_pos, absa_neg, ...), a side NULL where a scorer lacks it.
    With `named`, a condition on the headlines, articles with neither a target sentence nor a named
    headline go, and those without a target sentence get zeros for their body scores.
    """
    aggregates = [*shape_aggregates(sentences), *fusion_aggregates(sentences), chief_aggregate(sentences), *extra_aggregates(sentences)]
    out = sentences.groupBy("article_id").agg(*aggregates)
    if headlines is None:
        out = out.withColumn("fus_headline", F.lit(None).cast("double"))
    else:
        keep = headlines.select("article_id", S.fuse().alias("fus_headline"), (F.coalesce(named, F.lit(False)) if named is not None else F.lit(True)).alias("_named"))
        out = out.join(keep, "article_id", "left")
        if named is not None:
            out = out.where((F.col("n_entity_sents") > 0) | F.coalesce("_named", F.lit(False)))
            for name in [*FUSION_COLUMNS, "fus_ceo_mean", *EXTRA_COLUMNS]:
                out = out.withColumn(name, F.when(F.col("n_entity_sents") == 0, F.coalesce(name, F.lit(0.0))).otherwise(F.col(name)))
    out = out.withColumn("fus_conf_graft_floor_mean", S.shrink(F.col("fus_conf_graft_floor_mean"), F.col("n_entity_sents")))
    out = out.withColumn("fus_trusted_mean", S.shrink(F.col("fus_trusted_mean"), F.col("n_trusted_sents")))
    out = out.withColumn("has_ceo_mention", F.col("n_ceo_mention_sents") > 0)
    body = F.col("fus_conf_graft_floor_mean")
    out = out.withColumn("fus_headline_gap", F.col("fus_headline") - body).withColumn("fus_lead_gap", F.col("fus_conf_graft_floor_lead") - body)
    return out.select("article_id", *MODEL_COLUMNS)


def headline_scores(first: DataFrame, second: DataFrame) -> DataFrame:
    """(article_id, fus_headline): both scorers' headlines joined in full and fused, NULL where either lacks one."""
    return first.select("article_id", "pos", "neg").join(second.select("article_id", "absa_pos", "absa_neg"), "article_id", "full_outer").select("article_id", S.fuse().alias("fus_headline"))


def session_mix() -> list[Column]:
    """Share of a group's rows in each session; rows of no known session do not count."""
    known = F.col("session").isin(fixed.SESSIONS)
    return [F.coalesce(F.try_divide(F.count_if(F.col("session") == s), F.count_if(known)), F.lit(0.0)).alias(f"published_{s}_share") for s in fixed.SESSIONS]


def session_table(articles: DataFrame) -> DataFrame:
    """One row for each (session_open, ticker) of pooled article rows, with SESSION_FEATURES.

    Counts add up, scores average, the loudest score keeps its sign, and market columns are those of the
    latest article, the smaller id among equals. The first label is that of the earliest article with one.
    Sources are a small set in each group: collecting them keeps all in one hash aggregation and one shuffle.
    """
    order = F.struct("timestamp_utc", "article_id")
    x = F.col("fus_conf_graft_floor_mean")
    latest = F.max_by(F.struct(*MARKET_SNAPSHOT), F.struct(F.col("timestamp_utc"), -F.col("article_id"))).alias("_market")
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c)
    loud = F.max_by(x, F.when(x.isNotNull(), F.struct(F.abs(x), -F.unix_micros(F.col("timestamp_utc").cast("timestamp")), -F.col("article_id"))))
    aggregates = [
        first("label_direction"), first("abnormal_return_1d"), F.max("timestamp_utc").alias("timestamp_utc"), F.count("*").alias("n_articles"), F.size(F.collect_set("source")).cast("long").alias("n_sources"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in SESSION_SUMS], *[F.avg(F.col(c).cast("double")).alias(name) for name, c in SESSION_MEANS.items()],
        F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("fus_sentiment_std"), loud.alias("fus_sentiment_loudest"), latest, *session_mix(),
    ]
    out = articles.groupBy("session_open", "ticker").agg(*aggregates)
    return out.select("session_open", "ticker", "timestamp_utc", "label_direction", "abnormal_return_1d", *SESSION_TEXT, *[F.col(f"_market.{c}").alias(c) for c in MARKET_SNAPSHOT], *[f"published_{s}_share" for s in fixed.SESSIONS])


def demeaned(x: str, *groups: str) -> Column:
    """Value less the mean of its group, over the group's rows."""
    from pyspark.sql import Window as W

    return F.col(x) - F.avg(x).over(W.partitionBy(*groups))
