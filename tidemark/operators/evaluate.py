"""Walk-forward folds, metrics, exact tests, agreement, and the judge's score card."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidemark.functions import scores as S
from tidemark.operators import coverage


def fold_cuts(counts: list[int], n_splits: int = 5) -> list[int]:
    """Indices of the last group of each chunk but the last, for ordered groups of these sizes.

    Cut k lies at the group boundary nearest to k / (n_splits + 1) of the rows, the later of two equally
    near, after the cut before and before the last group; a cut that has no room is left out.
    """
    total, upto = sum(counts), []
    for n in counts:
        upto.append(n + (upto[-1] if upto else 0))
    cuts: list[int] = []
    for k in range(1, n_splits + 1):
        target = total * k / (n_splits + 1)
        near = min(range(len(upto)), key=lambda i: (abs(upto[i] - target), -i))
        at = min(max(near, cuts[-1] + 1 if cuts else 0), len(counts) - 2)
        if at > (cuts[-1] if cuts else -1):
            cuts.append(at)
    return cuts


def assign_chunks(rows: DataFrame, group: str, n_splits: int = 5, out: str = "chunk") -> DataFrame:
    """`rows` with their chunk, 0 .. n; fold k trains on chunks below k and tests on chunk k. No group is divided.

    Only the sizes of the groups, one row a session, come to the driver.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("n")).orderBy(group).collect()
    if not sizes:
        return rows.withColumn(out, F.lit(None).cast("int"))
    cuts = fold_cuts([r["n"] for r in sizes], n_splits)
    bounds = [sizes[c][group] for c in cuts]
    chunk = F.lit(0)
    for b in bounds:
        chunk = chunk + (F.col(group) > F.lit(b)).cast("int")
    return rows.withColumn(out, chunk)


def folds(chunked: DataFrame, chunk: str = "chunk") -> DataFrame:
    """(.., fold, role) rows: each row once for every fold it trains or tests in."""
    last = chunked.agg(F.max(chunk)).first()[0] or 0
    if not last:
        return chunked.withColumn("fold", F.lit(None).cast("int")).withColumn("role", F.lit(None).cast("string")).limit(0)
    every = chunked.withColumn("fold", F.explode(F.sequence(F.greatest(F.col(chunk), F.lit(1)), F.lit(last))))
    return every.withColumn("role", F.when(F.col("fold") == F.col(chunk), "test").otherwise("train"))


def holdout(rows: DataFrame, group: str, share: float = 0.2, out: str = "holdout") -> DataFrame:
    """Marks the rows of the last ceil(share) of the groups."""
    groups = rows.select(group).distinct()
    n = groups.count()
    k = math.ceil(n * share)
    if not k:
        return rows.withColumn(out, F.lit(False))
    first = groups.orderBy(F.desc(group)).limit(k).agg(F.min(group)).first()[0]
    return rows.withColumn(out, F.col(group) >= F.lit(first))


def binomial_tail(b: int, n: int) -> float | None:
    """P(X >= b) for X ~ Binomial(n, 1/2); None when n is 0.

    Terms follow from one another, the first, of many rows, from the log of its factorials, and are summed from the middle outwards
    until they no longer count; the shorter tail is summed.
    """
    if n == 0:
        return None
    if 2 * b <= n:
        return 1.0 if b <= 0 else 1.0 - binomial_tail(n - b + 1, n)
    if n <= 1000:
        term = math.comb(n, b) / 2**n
    else:
        term = math.exp(math.lgamma(n + 1) - math.lgamma(b + 1) - math.lgamma(n - b + 1) - n * math.log(2)) if b <= n else 0.0
    total = 0.0
    while b <= n and term > total * 1e-17:
        total += term
        term *= (n - b) / (b + 1)
        b += 1
    return total


def mcnemar_counts(df: DataFrame, truth: str, model: str, baseline: str, *by: str) -> DataFrame:
    """(by, b, c): rows that only the model, and only the baseline, gets right."""
    m, o = F.col(model).eqNullSafe(F.col(truth)), F.col(baseline).eqNullSafe(F.col(truth))
    return df.groupBy(*by).agg(F.count_if(m & ~o).cast("long").alias("b"), F.count_if(~m & o).cast("long").alias("c"))


def mcnemar(counts: DataFrame) -> DataFrame:
    """Adds the one-sided exact p_value; the frame has one row a fold."""
    rows = [(*r, binomial_tail(r["b"], r["b"] + r["c"])) for r in counts.collect()]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema) + ", p_value double"
    return counts.sparkSession.createDataFrame(rows, schema)


def confusion(truth: Column, pred: Column) -> list[Column]:
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False))).cast("long")
    return [n(truth & pred).alias("tp"), n(~truth & pred).alias("fp"), n(truth & ~pred).alias("fn"), n(~truth & ~pred).alias("tn")]


def with_rates(counts: DataFrame) -> DataFrame:
    """Adds n, agreement, precision, recall, f1 to tp, fp, fn, tn; 0 where a denominator is."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = counts.withColumn("n", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).cast("long"))
    return out.withColumn("agreement", rate(tp + tn, tp + fp + fn + tn)).withColumn("precision", rate(tp, tp + fp)).withColumn("recall", rate(tp, tp + fn)).withColumn("f1", rate(2 * tp, 2 * tp + fp + fn))


def evaluate_sample(df: DataFrame, truth: str, score: str, threshold: float = 1.0) -> DataFrame:
    """One row: confusion counts, rates and both base rates of score >= threshold, over rows with a label."""
    labelled = df.where(F.col(truth).isNotNull())
    t, p = F.col(truth) == 1, F.col(score) >= threshold
    base = [F.avg(p.cast("double")).alias("base_rate_pred"), F.avg(t.cast("double")).alias("base_rate_true")]
    return with_rates(labelled.agg(*confusion(t, p), *base))


def threshold_analysis(df: DataFrame, truth: str, score: str, thresholds: list[float] = (0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0)) -> DataFrame:
    """evaluate_sample() for each threshold, in one pass: counts are conditional aggregates, unpivoted after."""
    labelled = df.where(F.col(truth).isNotNull())
    t = F.col(truth) == 1
    aggs = []
    for i, x in enumerate(thresholds):
        p = F.col(score) >= x
        aggs += [c.alias(f"{n}{i}") for n, c in zip(("tp", "fp", "fn", "tn"), confusion(t, p))] + [F.avg(p.cast("double")).alias(f"bp{i}")]
    one = labelled.agg(F.avg(t.cast("double")).alias("bt"), *aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("threshold"), *[F.col(f"{n}{i}").alias(n) for n in ("tp", "fp", "fn", "tn")], F.col(f"bp{i}").alias("base_rate_pred"), F.col("bt").alias("base_rate_true")) for i, x in enumerate(thresholds)]))
    return with_rates(one.select(rows.alias("r")).select("r.*"))


def binary_metrics(predictions: DataFrame, truth: str, pred: str, score: str, *by: str) -> DataFrame:
    """Accuracy, precision, recall, f1, log loss and Brier score of 0/1 truth, pred and a probability."""
    t, p = F.col(truth) == 1, F.col(pred) == 1
    x = F.greatest(F.least(F.col(score), F.lit(1 - 2.0**-52)), F.lit(2.0**-52))
    loss = -F.avg(F.when(t, F.log(x)).otherwise(F.log(1 - x)))
    brier = F.avg((F.col(score) - t.cast("double")) ** 2)
    counts = predictions.groupBy(*by).agg(*confusion(t, p), loss.alias("log_loss"), brier.alias("brier_score"))
    return with_rates(counts).withColumnRenamed("agreement", "accuracy")


def auc(predictions: DataFrame, truth: str, score: str) -> DataFrame:
    """One row (n_pos, n_neg, auc) by the rank sum, ties sharing ranks; NULL with one class only."""
    ranked = coverage.distributed_rank(predictions.where(F.col(score).isNotNull()), score, "_rank")
    t = F.col(truth) == 1
    out = ranked.agg(F.count_if(t).cast("long").alias("n_pos"), F.count_if(~t).cast("long").alias("n_neg"), F.sum(F.when(t, F.col("_rank"))).alias("_s"))
    return out.select("n_pos", "n_neg", F.try_divide(F.col("_s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0, F.col("n_pos") * F.col("n_neg")).alias("auc"))


def majority(train: DataFrame, label: str, *by: str) -> DataFrame:
    """(by, majority): the most frequent label, the smallest among equals."""
    counted = train.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("_n"))
    return counted.groupBy(*by).agg(F.max_by(label, F.struct("_n", -F.col(label))).alias("majority"))


def by_group_edge(df: DataFrame, group: str, truth: str, pred: str) -> DataFrame:
    """(group, n, accuracy, majority_rate, edge)."""
    out = df.groupBy(group).agg(F.count("*").cast("long").alias("n"), F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy"), F.avg((F.col(truth) == 1).cast("double")).alias("_up"))
    return out.select(group, "n", "accuracy", F.greatest(F.col("_up"), 1 - F.col("_up")).alias("majority_rate")).withColumn("edge", F.col("accuracy") - F.col("majority_rate"))


def weighted_means(metrics: DataFrame, weight: str, columns: list[str]) -> DataFrame:
    return metrics.agg(*[F.try_divide(F.sum(F.col(weight) * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), F.col(weight)))).alias(c) for c in columns])


def mean_and_std(metrics: DataFrame, columns: list[str]) -> DataFrame:
    return metrics.agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))])


def stratified_accuracy(df: DataFrame, stratum: str, correct: str, weights: dict[str, float]) -> DataFrame:
    """One row (accuracy): the strata's accuracies under the given population weights."""
    table = df.sparkSession.createDataFrame(list(weights.items()), f"{stratum} string, _w double")
    by = df.groupBy(stratum).agg(F.avg(F.col(correct).cast("double")).alias("_a"))
    return by.join(F.broadcast(table), stratum).agg((F.sum(F.col("_w") * F.col("_a")) / F.sum("_w")).alias("accuracy"))


def kappa_quadratic(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, kappa): quadratic-weighted agreement of two ordinal ratings.

    With quadratic weights the disagreements are sums of squares, so no contingency table is needed:
    observed is the mean of (a - b)^2, expected the mean over independent pairs of both ratings.
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    both = df.where(x.isNotNull() & y.isNotNull())
    out = both.agg(F.count("*").cast("long").alias("n"), F.avg((x - y) ** 2).alias("_o"), F.avg(x * x).alias("_xx"), F.avg(y * y).alias("_yy"), F.avg(x).alias("_x"), F.avg(y).alias("_y"))
    expected = F.col("_xx") + F.col("_yy") - 2 * F.col("_x") * F.col("_y")
    return out.select("n", (1 - F.try_divide(F.col("_o"), expected)).alias("kappa"))


def rater_agreement(ratings: DataFrame, item: str = "sample_id", rater: str = "rater", label: str = "label") -> DataFrame:
    """(a, b, n, exact, same_sign, n_sign_differs, n_strength_differs) for every pair of raters."""
    l, r = ratings.alias("l"), ratings.alias("r")
    met = l.join(r, (F.col(f"l.{item}") == F.col(f"r.{item}")) & (F.col(f"l.{rater}") < F.col(f"r.{rater}")))
    x, y = F.col(f"l.{label}"), F.col(f"r.{label}")
    same = F.signum(x) == F.signum(y)
    return met.groupBy(F.col(f"l.{rater}").alias("a"), F.col(f"r.{rater}").alias("b")).agg(
        F.count("*").cast("long").alias("n"), F.avg((x == y).cast("double")).alias("exact"), F.avg(same.cast("double")).alias("same_sign"),
        F.count_if(~same).cast("long").alias("n_sign_differs"), F.count_if(same & (x != y)).cast("long").alias("n_strength_differs"),
    )


def direction_accuracy(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row (n, accuracy) over rows whose score and label both point somewhere."""
    some = df.where((F.col(score) != 0) & (F.col(label) != 0))
    return some.agg(F.count("*").cast("long").alias("n"), F.avg((F.signum(score) == F.signum(label)).cast("double")).alias("accuracy"))


def blend(first: DataFrame, second: DataFrame, keys: list[str], weight: float, proba: str = "proba_up") -> DataFrame:
    """Keys with the weighted mean of two models' probabilities and its side of one half."""
    joined = first.select(*keys, F.col(proba).alias("_a")).join(second.select(*keys, F.col(proba).alias("_b")), keys)
    mixed = weight * F.col("_a") + (1 - weight) * F.col("_b")
    return joined.select(*keys, mixed.alias(proba), F.when(mixed >= 0.5, 1).otherwise(-1).alias("pred_direction"))


def projected_errors(rates: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """One row (population, errors, error_rate): error rates by stratum put on the strata's population sizes."""
    met = rates.join(F.broadcast(sizes), key)
    return met.agg(F.sum("size").cast("double").alias("population"), F.sum(F.col("size") * F.col("error_rate")).alias("errors")).withColumn("error_rate", F.try_divide("errors", "population"))


def judge_score_card(df: DataFrame, is_target: str = "is_target", accepted: str = "accepted", spanned: str = "has_span", borderline: str = "borderline") -> DataFrame:
    """A row for each judge (baseline, judge), population (span, no-span, all) and borderline (included, excluded).

    Each labelled row is put into its slices once and everything is counted in one grouped pass.
    """
    pops = F.array(F.lit("all"), F.when(F.col(spanned), "span").otherwise("no-span"))
    modes = F.when(F.coalesce(F.col(borderline), F.lit(False)), F.array(F.lit("included"))).otherwise(F.array(F.lit("included"), F.lit("excluded")))
    judges = F.array(F.struct(F.lit("baseline").alias("judge"), F.lit(True).alias("_in")), F.struct(F.lit("judge").alias("judge"), F.col(accepted).alias("_in")))
    sliced = df.select(F.col(is_target).alias("_t"), F.explode(pops).alias("population"), modes.alias("_m"), judges.alias("_j"))
    sliced = sliced.select("_t", "population", F.explode("_m").alias("borderline"), "_j").select("_t", "population", "borderline", F.inline("_j"))
    n = lambda c: F.count_if(c).cast("long")
    t, a = F.col("_t"), F.col("_in")
    out = sliced.groupBy("judge", "population", "borderline").agg(
        F.count("*").cast("long").alias("n"), n(~t).alias("n_errors"), n(a).alias("n_accepted"), n(a & t).alias("_right"), n(~a & ~t).alias("_caught"), n(~a & t).alias("correct_lost"), n(t).alias("_correct")
    )
    low, high = S.wilson(F.col("_right"), F.col("n_accepted"))
    rate = lambda x, y: F.try_divide(F.col(x), F.col(y))
    return out.select(
        "judge", "population", "borderline", "n", "n_errors", rate("_correct", "n").alias("baseline_precision"), "n_accepted", rate("n_accepted", "n").alias("accept_rate"), rate("_right", "n_accepted").alias("accept_precision"),
        low.alias("accept_precision_lo"), high.alias("accept_precision_hi"), rate("_caught", "n_errors").alias("error_recall"), "correct_lost", rate("correct_lost", "_correct").alias("correct_lost_rate"),
    )
