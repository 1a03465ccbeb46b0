"""Coverage over calendar days: spines, gaps, months, bursts, profiles, distributions and correlations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def daily_counts(rows: DataFrame, ts: str = "timestamp_utc", by: str | None = None) -> DataFrame:
    """(by, day, articles) for every calendar day from a key's first to its last row, 0 where there is none."""
    keys = [by] if by else []
    some = rows.select(*keys, F.to_date(ts).alias("day")).where("day is not null").groupBy(*keys, "day").agg(F.count("*").alias("_n"))
    span = some.groupBy(*keys).agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    spine = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias("day"))
    return spine.join(some, [*keys, "day"], "left").select(*keys, "day", F.coalesce("_n", F.lit(0)).cast("long").alias("articles"))


def monthly(days: DataFrame, by: str | None = None) -> DataFrame:
    """(by, month, articles, active_days, days_in_month) of daily counts."""
    keys = [by] if by else []
    return days.groupBy(*keys, F.to_date(F.date_trunc("month", F.col("day"))).alias("month")).agg(
        F.sum("articles").cast("long").alias("articles"), F.count_if(F.col("articles") > 0).cast("long").alias("active_days"), F.count("*").cast("long").alias("days_in_month")
    )


def coverage_summary(days: DataFrame, by: str | None = None) -> DataFrame:
    """(by, span_start, span_end, days_in_span, active_days, active_day_share, longest_gap_days) of daily counts.

    A gap is a run of days without rows between two days with some, so its length is the distance of
    neighbouring active days less one; the spine begins and ends with an active day.
    """
    keys = [by] if by else []
    w = W.partitionBy(*keys).orderBy("day") if keys else W.orderBy("day")
    active = days.where("articles > 0").withColumn("_gap", F.datediff("day", F.lag("day").over(w)) - 1)
    out = active.groupBy(*keys).agg(
        F.min("day").alias("span_start"), F.max("day").alias("span_end"), F.count("*").cast("long").alias("active_days"), F.coalesce(F.max("_gap"), F.lit(0)).cast("long").alias("longest_gap_days")
    )
    out = out.withColumn("days_in_span", (F.datediff("span_end", "span_start") + 1).cast("long"))
    return out.select(*keys, "span_start", "span_end", "days_in_span", "active_days", (F.col("active_days") / F.col("days_in_span")).alias("active_day_share"), "longest_gap_days")


def peak_months(months: DataFrame, by: str, n: int = 3) -> DataFrame:
    """Each key's n heaviest months, the earlier among equals."""
    w = W.partitionBy(by).orderBy(F.desc("articles"), F.asc("month"))
    return months.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def shared_peaks(peaks: DataFrame, by: str) -> DataFrame:
    """(month, keys, in_all): months that are a peak of two keys or more."""
    n = peaks.agg(F.countDistinct(by).alias("_all"))
    return peaks.groupBy("month").agg(F.countDistinct(by).cast("long").alias("keys")).where("keys >= 2").join(F.broadcast(n), F.lit(True)).select("month", "keys", (F.col("keys") == F.col("_all")).alias("in_all"))


def bursts(rows: DataFrame, by: str, ts: str, days: int = 3) -> DataFrame:
    """`rows` with burst: numbered from 1 within the key, a new one after a gap of more than `days` whole days (one at least).

    Such a gap lies between two days, so the window runs over the first and last instants of a key's days,
    and the rows, however many a key has, only meet their day's number.
    """
    micros, day = F.unix_micros(F.col(ts).cast("timestamp")), F.to_date(ts)
    daily = rows.groupBy(by, day.alias("_day")).agg(F.min(micros).alias("_a"), F.max(micros).alias("_b"))
    w = W.partitionBy(by).orderBy("_day")
    new = F.coalesce(F.floor((F.col("_a") - F.lag("_b").over(w)) / 86_400_000_000) > days, F.lit(False)).cast("long")
    numbered = daily.withColumn("_new", new).select(by, "_day", (F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)) + 1).alias("burst"))
    return rows.withColumn("_day", day).join(numbered, [by, "_day"], "left").drop("_day")


def label_balance(labels: DataFrame, label: str = "label_direction") -> DataFrame:
    """One row: up, down, flat shares and the largest of them."""
    share = lambda v: F.avg((F.col(label) == v).cast("double"))
    out = labels.agg(share(1).alias("up"), share(-1).alias("down"), share(0).alias("flat"))
    return out.withColumn("majority_rate", F.greatest("up", "down", "flat"))


def monthly_balance(labels: DataFrame, ts: str, label: str = "label_direction") -> DataFrame:
    """(month, n, up_share)."""
    return labels.groupBy(F.to_date(F.date_trunc("month", F.col(ts))).alias("month")).agg(F.count("*").cast("long").alias("n"), F.avg((F.col(label) == 1).cast("double")).alias("up_share"))


def balance_extremes(months: DataFrame, least: int = 100) -> DataFrame:
    """One row: lowest and highest month by up share among months with `least` rows (all if none has), spread, months set aside."""
    any_full = months.agg(F.coalesce(F.bool_or(F.col("n") >= least), F.lit(False)).alias("_some"))
    used = months.join(F.broadcast(any_full), F.lit(True)).withColumn("_use", (F.col("n") >= least) | ~F.col("_some"))
    pick = lambda f, sign: f(F.when(F.col("_use"), F.struct(F.col("up_share"), sign)))
    low, high = pick(F.min, F.datediff("month", F.lit("1970-01-01"))), pick(F.max, -F.datediff("month", F.lit("1970-01-01")))
    day = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), F.abs(F.col(c)))
    out = used.agg(low.alias("_l"), high.alias("_h"), F.count_if(~F.col("_use")).cast("long").alias("set_aside"))
    return out.select(day("_l.col2").alias("lowest_month"), F.col("_l.up_share").alias("lowest"), day("_h.col2").alias("highest_month"), F.col("_h.up_share").alias("highest"), (F.col("_h.up_share") - F.col("_l.up_share")).alias("spread"), "set_aside")


def dropped_by_month(corpus: DataFrame, kept: DataFrame, key: str, ts: str) -> DataFrame:
    """(month, total, dropped, kept) of corpus rows with and without a kept key."""
    have = kept.select(key).distinct().withColumn("_k", F.lit(True))
    return corpus.join(have, key, "left").groupBy(F.to_date(F.date_trunc("month", F.col(ts))).alias("month")).agg(
        F.count("*").cast("long").alias("total"), F.count_if(F.col("_k").isNull()).cast("long").alias("dropped"), F.count_if(F.col("_k").isNotNull()).cast("long").alias("kept")
    )


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, dtype, n_rows, coverage, mean, std): one pass over all columns, then one row for each."""
    columns = columns or df.columns
    numeric = {c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")}
    stats = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double") if c in numeric else F.lit(None).cast("double")
        stats += [F.count(F.col(f"`{c}`")).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}")]
    one = df.agg(F.count("*").cast("long").alias("n_rows"), *stats)
    types = dict(df.dtypes)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"), F.col("n_rows"), F.try_divide(F.col(f"n{i}"), F.col("n_rows")).alias("coverage"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std")) for i, c in enumerate(columns)]))
    return one.select(rows.alias("r")).select("r.*")


def emptiness(df: DataFrame) -> DataFrame:
    """(column, n_empty): null or blank values of each column."""
    cells = [F.count_if(F.col(f"`{c}`").isNull() | (F.trim(F.col(f"`{c}`").cast("string")) == "")).cast("long").alias(f"n{i}") for i, c in enumerate(df.columns)]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_empty")) for i, c in enumerate(df.columns)]))
    return df.agg(*cells).select(rows.alias("r")).select("r.*")


def describe(df: DataFrame, column: str) -> DataFrame:
    x = F.col(column).cast("double")
    one = df.agg(F.count(x).cast("long").alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    q = [F.col("q")[i].alias(f"q{int(p * 100)}") for i, p in enumerate((0.25, 0.5, 0.75))]
    return one.join(F.broadcast(quantiles(df, column, [0.25, 0.5, 0.75])), F.lit(True)).select("count", "mean", "std", "min", *q, "max")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share), NULL a value of its own, heaviest first."""
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count("*").cast("long").alias("n"))
    total = counted.agg(F.sum("n").alias("_t"))
    return counted.join(F.broadcast(total), F.lit(True)).select("value", "n", (F.col("n") / F.col("_t")).alias("share")).orderBy(F.desc("n"), F.asc_nulls_first("value"))


def count_of_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """(n_values, n_keys): how many keys have so many distinct values."""
    return df.groupBy(key).agg(F.countDistinct(value).cast("long").alias("n_values")).groupBy("n_values").agg(F.count("*").cast("long").alias("n_keys"))


def histogram(df: DataFrame, part: Column, domain: range, name: str) -> DataFrame:
    """(name, n) over a fixed domain, 0 where nothing falls."""
    counted = df.groupBy(part.cast("int").alias(name)).agg(F.count("*").cast("long").alias("n"))
    spine = df.sparkSession.range(domain.start, domain.stop).select(F.col("id").cast("int").alias(name))
    return spine.join(F.broadcast(counted), name, "left").select(name, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def word_counts(df: DataFrame, text: str, stopwords: list[str], top: int = 20, pattern: str = "[a-z']{3,}") -> DataFrame:
    """The `top` most frequent words of lower-cased text, the first in the alphabet among equals."""
    words = df.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), F.lit(0))).alias("word"))
    return words.where(~F.col("word").isin(stopwords)).groupBy("word").agg(F.count("*").cast("long").alias("n")).orderBy(F.desc("n"), "word").limit(top)


def average_rank(x: str, *by: str) -> Column:
    """Rank with ties sharing their mean rank; NULL ranks NULL. A task holds a group: rank_within() is for groups of any size."""
    low, tied = W.partitionBy(*by).orderBy(F.col(x).asc_nulls_last()), W.partitionBy(*by, x)
    return F.when(F.col(x).isNotNull(), F.rank().over(low) + (F.count("*").over(tied) - 1) / 2.0)


#: A range of values that one task ranks holds about so many distinct ones, as long as there are no more ranges than shuffle partitions; values drawn for each bound.
RANGE, DRAWN = 100_000, 20


def _bounds(df: DataFrame, x: str) -> list:
    """Values that part the distinct values of `x` into ranges of about equal size: every DRAWN-th of those that a hash draws."""
    n = df.agg(F.approx_count_distinct(x)).first()[0]
    parts = min(-(-n // RANGE), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if parts < 2:
        return []
    drawn = df.select(x).where(F.col(x).isNotNull() & (F.pmod(F.xxhash64(x), F.lit(max(1, n // (parts * DRAWN))).cast("long")) == 0)).distinct()
    return [r[0] for r in drawn.orderBy(x).collect()][DRAWN::DRAWN]


def _above(x: Column, bounds: list) -> Column:
    """How many of the ordered `bounds` are below x, by halving."""
    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        at = (low + high) // 2
        return F.when(x > F.lit(bounds[at]), among(at + 1, high)).otherwise(among(low, at))

    return among(0, len(bounds))


def counted_values(df: DataFrame, x: str, *by: str) -> DataFrame:
    """(by, value, n, upto): each distinct value of a group that is not NULL, its rows, and the group's rows up to it, ordered by value.

    Values are dealt to ranges by bounds that are literals of the plan, so a row's range does not depend on the run; each
    range is summed on its own and the ranges' totals, one row each, give its offset. NULL keys are a group.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("value")).agg(F.count("*").alias("n"))
    parted = counts.withColumn("_p", _above(F.col("value"), _bounds(df, x)))
    before = W.partitionBy(*by).orderBy("_p") if by else W.orderBy("_p")
    totals = parted.groupBy(*by, "_p").agg(F.sum("n").alias("_t")).withColumn("_off", F.coalesce(F.sum("_t").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    upto = F.sum("n").over(W.partitionBy(*by, "_p").orderBy("value"))
    summed = parted.withColumn("_c", upto)
    if by:
        offsets = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.col("_p").alias("_q"), "_off")
        out = summed.join(offsets, _same(by) & (F.col("_p") == F.col("_q")))
    else:
        out = summed.join(F.broadcast(totals.select("_p", "_off")), "_p")
    return out.select(*by, "value", "n", (F.col("_off") + F.col("_c")).alias("upto"))


def _same(by: tuple[str, ...]) -> Column:
    """Keys equal to the columns _k0, _k1, ..., NULL to NULL."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)])


def rank_within(df: DataFrame, x: str, by: list[str], out: str) -> DataFrame:
    """`df` with average_rank() of a column within groups of any size: windows run over the distinct values of a group, not its rows.

    The ranks are broadcast where there are at most about RANGE of them, so that no row is shuffled.
    """
    ranks = counted_values(df, x, *by).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.col("value").alias("_x"), (F.col("upto") - (F.col("n") - 1) / 2.0).alias(out))
    few = df.agg(F.approx_count_distinct(F.struct(*by, x))).first()[0] <= RANGE
    return df.join(F.broadcast(ranks) if few else ranks, _same(tuple(by)) & (F.col(x) == F.col("_x")), "left").drop("_x", *[f"_k{i}" for i in range(len(by))])


def distributed_rank(df: DataFrame, x: str, out: str) -> DataFrame:
    """`df` with the average rank of a column over all rows, without bringing them into one partition."""
    ranks = counted_values(df, x).select(F.col("value").alias("_x"), (F.col("upto") - (F.col("n") - 1) / 2.0).alias(out))
    return df.join(ranks, df[x] == ranks["_x"], "left").drop("_x")


def quantiles(df: DataFrame, x: str, shares: list[float]) -> DataFrame:
    """One row (q: array<double>): the exact quantiles of a column, between two values in proportion; NULLs without any value.

    No task holds the column's distinct values: they are ranked in ranges, and each quantile picks at most two.
    """
    values = counted_values(df.select(F.col(x).cast("double").alias("_v")), "_v")
    total = df.agg(F.count(x).alias("_m"))
    at = lambda k: F.max(F.when((F.col("upto") - F.col("n") <= k) & (k < F.col("upto")), F.col("value")))
    picked = []
    for i, p in enumerate(shares):
        place = (F.col("_m") - 1) * F.lit(p)
        picked += [at(F.floor(place)).alias(f"a{i}"), at(F.ceil(place)).alias(f"b{i}"), F.max(place - F.floor(place)).alias(f"f{i}")]
    one = values.join(F.broadcast(total), F.lit(True)).agg(*picked)
    return one.select(F.array(*[F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * F.col(f"f{i}") for i in range(len(shares))]).alias("q"))


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson's correlation over rows with both values; NULL where either does not vary.

    (corr() divides by zero there under ANSI arithmetic.)
    """
    a, b = F.when(y.isNotNull(), x.cast("double")), F.when(x.isNotNull(), y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def pearson(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """(by, n, pearson) over rows that have both values."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*by).agg(F.count("*").cast("long").alias("n"), correlation(F.col(x), F.col(y)).alias("pearson"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_a"), F.col(y).alias("_b"))
    ranked = distributed_rank(distributed_rank(both, "_a", "_ra"), "_b", "_rb")
    return ranked.agg(F.count("*").cast("long").alias("n"), correlation(F.col("_ra"), F.col("_rb")).alias("spearman"))


def bands(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins; NULL outside."""
    out = F.when((x > edges[0]) & (x <= edges[1]), labels[0])
    return reduce(lambda acc, i: acc.when((x > edges[i]) & (x <= edges[i + 1]), labels[i]), range(1, len(labels)), out)


def quantile_bins(df: DataFrame, x: str, q: int = 5, out: str = "bin") -> DataFrame:
    """`df` with the 0-based equal-frequency bin of a column, edges from exact percentiles, right-closed."""
    cuts = quantiles(df, x, [i / q for i in range(1, q)]).withColumnRenamed("q", "_e")
    with_cuts = df.join(F.broadcast(cuts), F.lit(True))
    return with_cuts.withColumn(out, F.when(F.col(x).isNotNull(), F.size(F.filter("_e", lambda e: F.col(x) > e)))).drop("_e")


def regimes(df: DataFrame, ts: str, peak: str) -> DataFrame:
    """(regime, days, rows, rows_a_day): `climb` up to the peak's day, that day included, and `descent` after it."""
    day = F.to_date(ts)
    span = F.datediff(F.max("_d"), F.min("_d")) + 1
    out = df.where(F.col(ts).isNotNull()).select(day.alias("_d"), F.when(F.col(ts) <= F.lit(peak).cast("timestamp"), "climb").otherwise("descent").alias("regime"))
    return out.groupBy("regime").agg(span.alias("days"), F.count("*").cast("long").alias("rows"), (F.count("*") / span).alias("rows_a_day"))


def lead_lag(df: DataFrame, x: str, y: str, by: str, order: str, lags: range = range(-5, 6), least: int = 10) -> DataFrame:
    """(lag, n, correlation): of x with y that many sessions later within the key; NULL under `least` pairs."""
    w = W.partitionBy(by).orderBy(order)
    ahead = [F.lead(y, k).over(w).alias(f"_y{i}") if k >= 0 else F.lag(y, -k).over(w).alias(f"_y{i}") for i, k in enumerate(lags)]
    wide = df.select(F.col(x).alias("_x"), *ahead)
    aggs = []
    for i in range(len(lags)):
        both = F.col("_x").isNotNull() & F.col(f"_y{i}").isNotNull()
        aggs += [F.count_if(both).cast("long").alias(f"n{i}"), correlation(F.col("_x"), F.col(f"_y{i}")).alias(f"c{i}")]
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"n{i}").alias("n"), F.when(F.col(f"n{i}") >= least, F.col(f"c{i}")).alias("correlation")) for i, k in enumerate(lags)]))
    return wide.agg(*aggs).select(rows.alias("r")).select("r.*")


def source_access(results: DataFrame, by: str = "source") -> DataFrame:
    """Reach of each source: n, reached, reach_rate, n_sources, median_body, statuses (distinct, sorted).

    The exact median keeps a source's distinct body lengths, of which there are at most as many as the longest body has characters.
    """
    return results.groupBy(by).agg(
        F.count("*").cast("long").alias("n"), F.count_if(F.col("status") == "200").cast("long").alias("reached"), F.avg((F.col("status") == "200").cast("double")).alias("reach_rate"),
        F.countDistinct("true_source").cast("long").alias("n_sources"), F.percentile(F.length("processed_body").cast("double"), F.lit(0.5)).alias("median_body"),
        F.array_join(F.sort_array(F.collect_set("status")), ", ").alias("statuses"),
    )


def open_or_blocked(access: DataFrame, least_rate: float = 0.5, least_body: int = 500) -> DataFrame:
    return access.withColumn("verdict", F.when(F.col("reach_rate") < least_rate, "blocked").when(F.coalesce("median_body", F.lit(0.0)) < least_body, "no body").otherwise("open"))
