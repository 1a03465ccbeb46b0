"""Key integrity, merge accounting and the leakage regression. Checks are one-row frames.

A check has name, passed, n_offenders and offenders, of which at most LISTED are listed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions.scores import isclose
from tidemark.operators import market, pit

LISTED = 20


def as_check(offenders: DataFrame, name: str, key: str = "offender") -> DataFrame:
    """One row (name, passed, n_offenders, offenders) from a frame of offending keys.

    The listed ones are the smallest, taken by a top-k, so no list grows with the data.
    """
    some = offenders.select(F.col(key).cast("string").alias("o")).orderBy("o").limit(LISTED)
    listed = some.agg(F.sort_array(F.collect_list("o")).alias("offenders"))
    counted = offenders.agg(F.count("*").cast("long").alias("n_offenders"))
    return counted.join(F.broadcast(listed), F.lit(True)).select(F.lit(name).alias("name"), (F.col("n_offenders") == 0).alias("passed"), "n_offenders", "offenders")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def check_unique(df: DataFrame, label: str, key: str = "article_id") -> DataFrame:
    return as_check(duplicates(df, key).withColumnRenamed(key, "offender"), f"{key} is unique within {label}")


def check_subset(df: DataFrame, corpus: DataFrame, label: str, key: str = "article_id") -> DataFrame:
    unknown = df.select(key).distinct().join(corpus.select(key).distinct(), key, "left_anti")
    return as_check(unknown.withColumnRenamed(key, "offender"), f"every {label} {key} exists in the corpus")


def check_same_article(left: DataFrame, right: DataFrame, label: str, key: str = "article_id", witness: str = "timestamp_utc") -> DataFrame:
    """Shared keys agree on the witness column; passes when either side lacks it or no key is shared."""
    name = f"one {key} means one article ({label})"
    if witness not in left.columns or witness not in right.columns:
        none = left.limit(0).select(F.col(key).alias("offender"))
        return as_check(none, name)
    shared = left.select(key, F.col(witness).alias("_l")).join(right.select(key, F.col(witness).alias("_r")), key)
    return as_check(shared.where("_l is distinct from _r").withColumnRenamed(key, "offender"), name)


def conflicting_ids(corpora: DataFrame, key: str = "article_id", group: str = "ticker", witness: str = "headline") -> DataFrame:
    """(a, b, key): pairs of groups in which a shared key's first row differs in the witness."""
    first = corpora.groupBy(group, key).agg(F.min(F.struct(witness)).alias("_w"))
    a, b = first.alias("a"), first.alias("b")
    met = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{group}") < F.col(f"b.{group}")))
    return met.where(F.col("a._w") != F.col("b._w")).select(F.col(f"a.{group}").alias("a"), F.col(f"b.{group}").alias("b"), F.col(f"a.{key}").alias(key))


def check_cross_group(corpora: DataFrame, key: str = "article_id", group: str = "ticker", witness: str = "headline") -> DataFrame:
    bad = conflicting_ids(corpora, key, group, witness).select(F.concat_ws(":", F.concat_ws("/", "a", "b"), F.col(key).cast("string")).alias("offender"))
    return as_check(bad, f"a shared {key} is the same article in every {group}")


def overlap_summary(merged: DataFrame, key: str = "article_id", group: str = "ticker") -> DataFrame:
    """(group, other, shared_articles, share_of_own) for every ordered pair of groups that share a key."""
    ids = merged.select(group, key).distinct()
    sizes = ids.groupBy(group).agg(F.count("*").alias("_own"))
    a, b = ids.alias("a"), ids.alias("b")
    met = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{group}") != F.col(f"b.{group}")))
    shared = met.groupBy(F.col(f"a.{group}").alias(group), F.col(f"b.{group}").alias("other")).agg(F.count("*").alias("shared_articles"))
    return shared.join(F.broadcast(sizes), group).select(group, "other", "shared_articles", (F.col("shared_articles") / F.col("_own")).alias("share_of_own"))


def describe_gap(left: DataFrame, right: DataFrame, key: str = "article_id") -> DataFrame:
    """One row of set sizes: left_total, right_total, shared, only_left, only_right."""
    sides = left.select(key).distinct().withColumn("_l", F.lit(1)).join(right.select(key).distinct().withColumn("_r", F.lit(1)), key, "full_outer")
    n = lambda c: F.count_if(c).cast("long")
    l, r = F.col("_l").isNotNull(), F.col("_r").isNotNull()
    return sides.agg(n(l).alias("left_total"), n(r).alias("right_total"), n(l & r).alias("shared"), n(l & ~r).alias("only_left"), n(r & ~l).alias("only_right"))


def merge_validated(text: DataFrame, markets: DataFrame, key: str = "article_id", drop: tuple[str, ...] = ("ticker", "timestamp_utc")) -> DataFrame:
    """Inner join of one row to one row; a key that repeats on either side raises when the result is read."""
    def once(df: DataFrame, label: str) -> DataFrame:
        # The guard stands on a column of its own, so the join finds the rows already dealt out by key.
        guard = F.when(F.count("*").over(W.partitionBy(key)) > 1, F.raise_error(F.lit(f"{key} repeats in the {label} table")).cast("boolean")).otherwise(F.lit(True))
        return df.withColumn(f"_{label}", guard).where(f"_{label}").drop(f"_{label}")

    right = markets.drop(*[c for c in drop if c != key])
    return once(text, "text").join(once(right, "market"), key, "inner")


def dropped_rows(left: DataFrame, right: DataFrame, key: str = "article_id") -> DataFrame:
    """(key, side): the keys that an inner join of the two tables drops, and which of them has them."""
    sides = left.select(key).distinct().withColumn("_l", F.lit(1)).join(right.select(key).distinct().withColumn("_r", F.lit(1)), key, "full_outer")
    return sides.where("_l is null or _r is null").select(key, F.when(F.col("_r").isNull(), "left").otherwise("right").alias("side"))


def merge_accounting(text: DataFrame, markets: DataFrame, key: str = "article_id") -> DataFrame:
    """One row: text_rows, market_rows, merged_rows, text_only, market_only, join_rate (of the text rows)."""
    gap = describe_gap(text, markets, key)
    return gap.select(
        F.col("left_total").alias("text_rows"), F.col("right_total").alias("market_rows"), F.col("shared").alias("merged_rows"),
        F.col("only_left").alias("text_only"), F.col("only_right").alias("market_only"), F.try_divide(F.col("shared"), F.col("left_total")).alias("join_rate"),
    )


def pool(frames: list[DataFrame], keys: tuple[str, str] = ("article_id", "ticker")) -> DataFrame:
    """All rows of the frames; none raises at once, a repeated key pair when the result is read."""
    if not frames:
        raise ValueError("nothing to pool")
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    n = F.count("*").over(W.partitionBy(*keys))
    guard = F.when(n > 1, F.raise_error(F.lit(f"{keys} repeats in the pooled table")).cast("boolean")).otherwise(F.lit(True))
    return every.withColumn("_once", guard).where("_once").drop("_once")


def cutoffs(rows: DataFrame, bars: DataFrame, by: str = "ticker", ts: str = "timestamp_utc") -> DataFrame:
    """`rows` with the one-day momentum under both cutoffs: correct sees bars before the article's day, leaky those before its instant.

    With day bars stamped at midnight the leaky one is that of the day's own bar, if it has one and the article is
    not of midnight itself, so both are met by one join on (key, day).
    """
    w = W.partitionBy("symbol").orderBy("bar_date")
    steps = bars.withColumn("_m", market.cumulative_return(1)).select(F.col("symbol").alias(by), F.col("bar_date").alias("_from"), F.col("_m").alias("_correct"), F.lead("bar_date").over(w).alias("_until"), F.lead("_m").over(w).alias("_new"))
    filed = steps.where("_until is not null").select(by, F.explode(F.sequence(F.date_add("_from", 1), F.col("_until"))).alias("_day"), "_correct", "_until", "_new")
    filed = filed.select(by, "_day", "_correct", F.when(F.col("_day") == F.col("_until"), F.col("_new")).otherwise(F.col("_correct")).alias("_leaky"))
    last = steps.where("_until is null").select(F.col(by).alias("_by"), "_from", F.col("_correct").alias("_last"))
    t = F.col(ts).cast("timestamp")
    met = rows.withColumn("_day", F.to_date(t)).join(filed, [by, "_day"], "left").join(last, (F.col(by) == F.col("_by")) & (F.col("_day") > F.col("_from")), "left")
    correct = F.coalesce("_correct", "_last")
    leaky = F.when(t > F.date_trunc("day", t), F.coalesce("_leaky", "_last")).otherwise(correct)
    return met.select(*[F.col(c) for c in rows.columns], correct.alias("correct"), leaky.alias("leaky"))


def leakage_rows(rows: DataFrame, bars: DataFrame, by: str = "ticker", ts: str = "timestamp_utc", stored: str = "momentum_1d") -> DataFrame:
    """cutoffs(), and whether the stored momentum matches each: matches_correct, matches_leaky, ambiguous, real_leak."""
    return leakage_flags(cutoffs(rows, bars, by, ts), stored)


def leakage_flags(out: DataFrame, stored: str = "momentum_1d") -> DataFrame:
    out = out.withColumn("matches_correct", isclose(F.col(stored), F.col("correct"))).withColumn("matches_leaky", isclose(F.col(stored), F.col("leaky")))
    out = out.withColumn("ambiguous", isclose(F.col("leaky"), F.col("correct")))
    return out.withColumn("real_leak", F.col("matches_leaky") & ~F.col("ambiguous"))


def leakage_by_session(tested: DataFrame, session: str = "session") -> DataFrame:
    n = lambda c: F.count_if(F.col(c)).cast("long")
    return tested.groupBy(session).agg(
        F.count("*").cast("long").alias("rows"), n("matches_correct").alias("matches_correct"), n("real_leak").alias("real_leaks"), n("ambiguous").alias("ambiguous"),
        (F.count_if("matches_correct") / F.count("*")).alias("correct_rate"),
    )


def leakage_summary(tested: DataFrame) -> DataFrame:
    """One row of totals; passed when no leak is real and every row matches the correct cutoff."""
    n = lambda c: F.count_if(F.col(c)).cast("long")
    out = tested.agg(F.count("*").cast("long").alias("rows_tested"), n("matches_correct").alias("matches_correct"), n("matches_leaky").alias("matches_leaky"), n("ambiguous").alias("ambiguous"), n("real_leak").alias("real_leaks"))
    return out.withColumn("passed", (F.col("real_leaks") == 0) & (F.col("matches_correct") == F.col("rows_tested")))


def require_signal(verdicts: DataFrame, answer: str = "answer") -> DataFrame:
    """The verdicts; raises when there are some and all are `unsure`."""
    found = verdicts.agg(F.count("*"), F.count_if(F.coalesce(F.col(answer), F.lit("unsure")) != "unsure")).first()
    if found[0] and not found[1]:
        raise RuntimeError("every verdict is unsure")
    return verdicts


def contexts_differ(stored: DataFrame, built: DataFrame, keys: tuple[str, str] = ("article_id", "sent_idx"), text: str = "text") -> DataFrame:
    """Keys whose stored text is not the rebuilt one; keys without a rebuilt text too."""
    found = stored.select(*keys, F.col(text).alias("_s")).join(built.select(*keys, F.col(text).alias("_b")), list(keys), "left")
    return found.where("_s is distinct from _b").select(*keys)


def outside_domain(df: DataFrame, column: str, allowed: list) -> DataFrame:
    return df.where(F.col(column).isNull() | ~F.col(column).isin(allowed))


def divided_groups(folds: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """Groups that lie in more than one fold."""
    return folds.groupBy(group).agg(F.countDistinct(fold).alias("n_folds")).where("n_folds > 1")


def varying_within(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys within which a value is not constant."""
    return df.groupBy(*keys).agg(F.countDistinct(value).alias("n_values")).where("n_values > 1")
