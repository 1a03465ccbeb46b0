"""Registered queries of the evaluation, statistics, model and source operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import scores as S
from tidemark.operators import coverage, evaluate, integrity, models, pit
from tidemark.plans.inputs import ART, CAL, articles, calendar, r6, r9, registry, table
from tidemark.sources import tables, windows

QUERIES: dict = {}
ORACLES: dict = {}
query = registry(QUERIES, ORACLES)

_GRP = f"{ART}, {CAL}, grp AS (SELECT a.*, n.op AS session_open FROM art a ASOF JOIN cal n ON a.ts < n.op)"


def _grouped(spark, sf_dir):
    return pit.align_next_open(articles(spark, sf_dir), calendar(spark))


#: Cuts by the rule in SQL: each cut the boundary nearest to its share of the rows, the later of two as near.
_CUTS = f"""{_GRP}, sizes AS (SELECT session_open, count(*) AS n FROM grp GROUP BY 1), upto AS (SELECT session_open, sum(n) OVER (ORDER BY session_open) AS c, row_number() OVER (ORDER BY session_open) AS i FROM sizes),
  cuts AS (SELECT k, arg_min(session_open, {{'d': abs(c - (SELECT sum(n) FROM sizes) * k / 6.0), 'i': -i}}) AS cut FROM upto, range(1, 6) r(k) GROUP BY k)"""


@query(f"WITH {_CUTS} SELECT article_id, CAST((SELECT count(*) FROM cuts WHERE g.session_open > cut) AS INTEGER) AS chunk FROM grp g")
def fold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.assign_chunks(_grouped(spark, sf_dir), "session_open").select("article_id", "chunk")


@query(f"""WITH {_CUTS}, ch AS (SELECT article_id, CAST((SELECT count(*) FROM cuts WHERE g.session_open > cut) AS INTEGER) AS chunk FROM grp g)
SELECT CAST(k AS INTEGER) AS fold, CASE WHEN chunk = k THEN 'test' ELSE 'train' END AS role, count(*) AS n FROM ch, range(1, 6) r(k) WHERE chunk <= k GROUP BY 1, 2""")
def fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.folds(evaluate.assign_chunks(_grouped(spark, sf_dir), "session_open")).groupBy("fold", "role").agg(F.count("*").alias("n"))


@query(f"WITH {_GRP}, r AS (SELECT article_id, dense_rank() OVER (ORDER BY session_open DESC) AS k, (SELECT ceil(count(DISTINCT session_open) * 0.2) FROM grp) AS n FROM grp) SELECT article_id, k <= n AS holdout FROM r")
def locked_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.holdout(_grouped(spark, sf_dir), "session_open").select("article_id", "holdout")


@query("SELECT CAST(0 AS BIGINT) AS divided")
def folds_divide_no_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunked = evaluate.assign_chunks(_grouped(spark, sf_dir), "session_open")
    return integrity.divided_groups(chunked, "session_open", "chunk").agg(F.count("*").alias("divided"))


@query("SELECT user_id, count(DISTINCT event_type) AS n_values FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def varying_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.varying_within(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("SELECT doc_id, lang FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'de', 'fr')")
def outside_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.outside_domain(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["en", "de", "fr"])


@query("SELECT a.doc_id AS article_id, CAST(0 AS INTEGER) AS sent_idx FROM documents a WHERE doc_id % 7 = 0")
def contexts_differ(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.lit(0).alias("sent_idx"), "text")
    built = d.withColumn("text", F.when(F.col("article_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return integrity.contexts_differ(d, built)


_LD = "lab AS (SELECT l.doc_id, l.quality, l.toxic, (d.n_chars % 97) / 97.0 AS score FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL)"


def _scored_labels(spark, sf_dir):
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return l.join(d, "doc_id").where("quality is not null").select("doc_id", "quality", "toxic", ((F.col("n_chars") % 97) / 97.0).alias("score"))


_RATES = "round((tp + tn) / (tp + fp + fn + tn), 6) + 0.0 AS agreement, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) + 0.0 AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) + 0.0 AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) + 0.0 AS f1"


def _conf(truth: str, pred: str) -> str:
    return f"count(*) FILTER ({truth} AND {pred}) AS tp, count(*) FILTER (NOT {truth} AND {pred}) AS fp, count(*) FILTER ({truth} AND NOT {pred}) AS fn, count(*) FILTER (NOT {truth} AND NOT {pred}) AS tn"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: r6(c) for c, t in df.dtypes if t == "double"})


@query(f"WITH {_LD}, c AS (SELECT {_conf('quality = 1', 'score >= 0.5')}, round(avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0 END), 6) + 0.0 AS base_rate_pred, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0 END), 6) + 0.0 AS base_rate_true FROM lab) SELECT *, tp + fp + fn + tn AS n, {_RATES} FROM c")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.evaluate_sample(_scored_labels(spark, sf_dir), "quality", "score", 0.5))


@query(f"WITH {_LD}, c AS (SELECT CAST(t AS DOUBLE) AS threshold, {_conf('quality = 1', 'score >= t')}, round(avg(CASE WHEN score >= t THEN 1.0 ELSE 0 END), 6) + 0.0 AS base_rate_pred, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0 END), 6) + 0.0 AS base_rate_true FROM lab, (VALUES (0.25), (0.5), (0.75), (1.0), (1.25), (1.5), (2.0)) v(t) GROUP BY 1, t) SELECT *, tp + fp + fn + tn AS n, {_RATES} FROM c")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.threshold_analysis(_scored_labels(spark, sf_dir), "quality", "score"))


@query(f"""WITH {_LD}, p AS (SELECT *, doc_id % 3 AS fold, greatest(least(score, 1 - 2.220446049250313e-16), 2.220446049250313e-16) AS s FROM lab),
  c AS (SELECT fold, {_conf('quality = 1', 'score >= 0.5')}, round(-avg(CASE WHEN quality = 1 THEN ln(s) ELSE ln(1 - s) END), 6) + 0.0 AS log_loss, round(avg((score - quality) ** 2), 6) + 0.0 AS brier_score FROM p GROUP BY 1)
SELECT *, tp + fp + fn + tn AS n, {_RATES.replace('AS agreement', 'AS accuracy')} FROM c""")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _scored_labels(spark, sf_dir).withColumn("fold", F.col("doc_id") % 3).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    return _rounded(evaluate.binary_metrics(p, "quality", "pred", "score", "fold"))


@query(f"WITH {_LD}, r AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM lab), s AS (SELECT count(*) FILTER (quality = 1) AS n_pos, count(*) FILTER (quality <> 1) AS n_neg, sum(k) FILTER (quality = 1) AS t FROM r) SELECT n_pos, n_neg, round((t - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg), 6) + 0.0 AS auc FROM s")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.auc(_scored_labels(spark, sf_dir), "quality", "score"))


@query(f"WITH {_LD} SELECT doc_id % 3 AS fold, count(*) FILTER ((score >= 0.5) = (quality = 1) AND quality <> 1) AS b, count(*) FILTER ((score >= 0.5) <> (quality = 1) AND quality = 1) AS c FROM lab GROUP BY 1")
def mcnemar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _scored_labels(spark, sf_dir).withColumns({"fold": F.col("doc_id") % 3, "t": (F.col("quality") == 1).cast("int"), "m": (F.col("score") >= 0.5).cast("int"), "o": F.lit(1)})
    return evaluate.mcnemar_counts(p, "t", "m", "o", "fold")


@query(f"""WITH {_LD}, n AS (SELECT doc_id % 3 AS fold, count(*) FILTER ((score >= 0.5) = (quality = 1) AND quality <> 1) AS b, count(*) FILTER ((score >= 0.5) <> (quality = 1) AND quality = 1) AS c FROM lab GROUP BY 1),
  t AS (SELECT fold, b, c, unnest(range(b, b + c + 1)) AS i FROM n WHERE b + c > 0)
SELECT fold, any_value(b) AS b, any_value(c) AS c, round(sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))), 6) + 0.0 AS p_value FROM t GROUP BY 1""")
def mcnemar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.mcnemar(mcnemar_counts(spark, sf_dir)))


@query("WITH k AS (SELECT event_type, count(*) FILTER (value > 60) AS k, count(*) AS n FROM events GROUP BY 1), p AS (SELECT *, k / n AS s, 1 + 1.96 * 1.96 / n AS d FROM k) SELECT event_type, round(((s + 1.96 * 1.96 / (2 * n)) / d) - 1.96 * sqrt(s * (1 - s) / n + 1.96 * 1.96 / (4.0 * n * n)) / d, 6) + 0.0 AS low, round(((s + 1.96 * 1.96 / (2 * n)) / d) + 1.96 * sqrt(s * (1 - s) / n + 1.96 * 1.96 / (4.0 * n * n)) / d, 6) + 0.0 AS high FROM p")
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 60).alias("k"), F.count("*").alias("n"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return k.select("event_type", r6(low).alias("low"), r6(high).alias("high"))


@query("""WITH r AS (SELECT l_linenumber % 5 AS a, CAST(l_quantity AS BIGINT) % 5 AS b FROM lineitem), o AS (SELECT a, b, count(*) AS n FROM r GROUP BY 1, 2), t AS (SELECT sum(n) AS n FROM o), ra AS (SELECT a, sum(n) AS n FROM o GROUP BY 1), rb AS (SELECT b, sum(n) AS n FROM o GROUP BY 1),
  e AS (SELECT sum((ra.a - rb.b) ** 2 * ra.n * rb.n) / (SELECT n * n FROM t) AS x FROM ra, rb), w AS (SELECT sum((a - b) ** 2 * n) / (SELECT n FROM t) AS x FROM o)
SELECT CAST((SELECT n FROM t) AS BIGINT) AS n, round(1 - (SELECT x FROM w) / (SELECT x FROM e), 6) + 0.0 AS kappa""")
def kappa_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 5).alias("a"), (F.col("l_quantity").cast("long") % 5).alias("b"))
    return _rounded(evaluate.kappa_quadratic(r, "a", "b"))


_RATE = "rate AS (SELECT page_id AS sample_id, r AS rater, CAST((page_id * (ascii(r) - 60)) % 5 - 2 AS DOUBLE) / 2 AS label FROM pages, (VALUES ('A'), ('B'), ('C')) v(r))"


def _ratings(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("sample_id"), F.explode(F.array(F.lit("A"), F.lit("B"), F.lit("C"))).alias("rater")).withColumn("label", ((F.col("sample_id") * (F.ascii("rater") - 60)) % 5 - 2).cast("double") / 2)


@query(f"""WITH {_RATE} SELECT l.rater AS a, r.rater AS b, count(*) AS n, round(avg(CASE WHEN l.label = r.label THEN 1.0 ELSE 0 END), 6) + 0.0 AS exact, round(avg(CASE WHEN sign(l.label) = sign(r.label) THEN 1.0 ELSE 0 END), 6) + 0.0 AS same_sign,
  count(*) FILTER (sign(l.label) <> sign(r.label)) AS n_sign_differs, count(*) FILTER (sign(l.label) = sign(r.label) AND l.label <> r.label) AS n_strength_differs FROM rate l JOIN rate r ON l.sample_id = r.sample_id AND l.rater < r.rater GROUP BY 1, 2""")
def rater_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.rater_agreement(_ratings(spark, sf_dir)))


@query("WITH s AS (SELECT (value - 50) / 50 AS score, user_id % 3 - 1 AS label FROM events) SELECT count(*) AS n, round(avg(CASE WHEN sign(score) = sign(label) THEN 1.0 ELSE 0 END), 6) + 0.0 AS accuracy FROM s WHERE score <> 0 AND label <> 0")
def direction_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(((F.col("value") - 50) / 50).alias("score"), (F.col("user_id") % 3 - 1).alias("label"))
    return _rounded(evaluate.direction_accuracy(e, "score", "label"))


@query("WITH a AS (SELECT l_returnflag AS f, avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0 END) AS a FROM lineitem GROUP BY 1) SELECT round(sum(w * a) / sum(w), 6) + 0.0 AS accuracy FROM a JOIN (VALUES ('A', 0.5), ('N', 0.3), ('R', 0.2)) v(f, w) USING (f)")
def stratified_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("ok", F.col("l_quantity") > 25)
    return _rounded(evaluate.stratified_accuracy(li, "l_returnflag", "ok", {"A": 0.5, "N": 0.3, "R": 0.2}))


@query("WITH g AS (SELECT event_type, count(*) AS n, avg(CASE WHEN (user_id % 2) = (event_id % 2) THEN 1.0 ELSE 0 END) AS acc, avg(CASE WHEN user_id % 2 = 1 THEN 1.0 ELSE 0 END) AS up FROM events GROUP BY 1) SELECT event_type, n, round(acc, 6) + 0.0 AS accuracy, round(greatest(up, 1 - up), 6) + 0.0 AS majority_rate, round(acc - greatest(up, 1 - up), 6) + 0.0 AS edge FROM g")
def edge_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 2).alias("t"), (F.col("event_id") % 2).alias("p"))
    return _rounded(evaluate.by_group_edge(e, "event_type", "t", "p"))


@query("WITH c AS (SELECT event_type, user_id % 7 AS label, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, arg_max(label, {'n': n, 'l': -label}) AS majority FROM c GROUP BY 1")
def majority_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.majority(table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 7).alias("label")), "label", "event_type")


@query("WITH m AS (SELECT event_type, CAST(count(*) AS DOUBLE) AS w, avg(value) AS x, CASE WHEN min(event_id) > 1 THEN max(value) END AS y FROM events GROUP BY 1) SELECT round(sum(w * x) / sum(w), 6) + 0.0 AS x, round(sum(w * y) / sum(w) FILTER (y IS NOT NULL), 6) + 0.0 AS y FROM m")
def weighted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").cast("double").alias("w"), F.avg("value").alias("x"), F.when(F.min("event_id") > 1, F.max("value")).alias("y"))
    return _rounded(evaluate.weighted_means(m, "w", ["x", "y"]))


@query("WITH m AS (SELECT event_type, avg(value) AS x FROM events GROUP BY 1) SELECT round(avg(x), 6) + 0.0 AS x_mean, round(stddev_samp(x), 6) + 0.0 AS x_std FROM m")
def fold_mean_and_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("x"))
    return _rounded(evaluate.mean_and_std(m, ["x"]))


@query("WITH r AS (SELECT l_returnflag AS f, avg(CASE WHEN l_quantity < 5 THEN 1.0 ELSE 0 END) AS e, count(*) * 10 AS size FROM lineitem GROUP BY 1) SELECT CAST(sum(size) AS DOUBLE) AS population, round(sum(size * e), 6) + 0.0 AS errors, round(sum(size * e) / sum(size), 6) + 0.0 AS error_rate FROM r")
def projected_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("f")).agg(F.avg((F.col("l_quantity") < 5).cast("double")).alias("error_rate"), (F.count("*") * 10).alias("size"))
    return _rounded(evaluate.projected_errors(g.select("f", "error_rate"), g.select("f", "size"), "f"))


@query("""WITH e AS (SELECT page_id % 4 <> 0 AS t, page_id % 5 <> 1 AS acc, page_id % 3 = 0 AS span, page_id % 6 = 0 AS bl FROM pages),
  s AS (SELECT j AS judge, p AS population, m AS borderline, t, CASE WHEN j = 'baseline' THEN true ELSE acc END AS a FROM e, (VALUES ('baseline'), ('judge')) jj(j), (VALUES ('all'), ('span'), ('no-span')) pp(p), (VALUES ('included'), ('excluded')) mm(m)
    WHERE (p = 'all' OR (p = 'span') = span) AND (m = 'included' OR NOT bl)),
  g AS (SELECT judge, population, borderline, count(*) AS n, count(*) FILTER (NOT t) AS n_errors, count(*) FILTER (a) AS n_accepted, count(*) FILTER (a AND t) AS r, count(*) FILTER (NOT a AND NOT t) AS c, count(*) FILTER (NOT a AND t) AS correct_lost, count(*) FILTER (t) AS k FROM s GROUP BY 1, 2, 3)
SELECT judge, population, borderline, n, n_errors, round(k / n, 6) + 0.0 AS baseline_precision, n_accepted, round(n_accepted / n, 6) + 0.0 AS accept_rate, round(r / n_accepted, 6) + 0.0 AS accept_precision,
  round((r / n_accepted + 3.8416 / (2 * n_accepted) - 1.96 * sqrt(r / n_accepted * (1 - r / n_accepted) / n_accepted + 3.8416 / (4.0 * n_accepted * n_accepted))) / (1 + 3.8416 / n_accepted), 6) + 0.0 AS accept_precision_lo,
  round((r / n_accepted + 3.8416 / (2 * n_accepted) + 1.96 * sqrt(r / n_accepted * (1 - r / n_accepted) / n_accepted + 3.8416 / (4.0 * n_accepted * n_accepted))) / (1 + 3.8416 / n_accepted), 6) + 0.0 AS accept_precision_hi,
  round(c / n_errors, 6) + 0.0 AS error_recall, correct_lost, round(correct_lost / k, 6) + 0.0 AS correct_lost_rate FROM g""")
def judge_score_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    e = table(spark, sf_dir, "pages").select((k % 4 != 0).alias("is_target"), (k % 5 != 1).alias("accepted"), (k % 3 == 0).alias("has_span"), (k % 6 == 0).alias("borderline"))
    return _rounded(evaluate.judge_score_card(e))


@query("WITH a AS (SELECT event_id AS k, (event_id % 100) / 100 AS p, value / 100 AS q FROM events) SELECT k, round(0.3 * p + 0.7 * q, 9) + 0.0 AS proba_up, CAST(CASE WHEN 0.3 * p + 0.7 * q >= 0.5 THEN 1 ELSE -1 END AS INTEGER) AS pred_direction FROM a")
def blended_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    a = e.select(F.col("event_id").alias("k"), ((F.col("event_id") % 100) / 100.0).alias("proba_up"))
    out = evaluate.blend(a, e.select(F.col("event_id").alias("k"), (F.col("value") / 100).alias("proba_up")), ["k"], 0.3)
    return out.withColumn("proba_up", r9("proba_up"))


@query("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS b FROM lineitem) SELECT count(*) AS n, round(corr(a, b), 6) + 0.0 AS spearman FROM r")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(coverage.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount"))


@query("SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) + 0.0 AS pearson FROM lineitem GROUP BY 1")
def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(coverage.pearson(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag"))


@query("WITH b AS (SELECT l_returnflag, CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN 'thin' WHEN l_quantity > 10 AND l_quantity <= 30 THEN 'middle' WHEN l_quantity > 30 AND l_quantity <= 50 THEN 'dense' END AS band, l_discount, l_tax FROM lineitem) SELECT l_returnflag, band, count(*) AS n, round(corr(l_discount, l_tax), 6) + 0.0 AS pearson FROM b GROUP BY 1, 2")
def coverage_band_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("band", coverage.bands(F.col("l_quantity"), [0, 10, 30, 50], ["thin", "middle", "dense"]))
    return _rounded(coverage.pearson(li, "l_discount", "l_tax", "l_returnflag", "band"))


@query("WITH e AS (SELECT quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8]) AS q FROM lineitem), b AS (SELECT len(list_filter(q, lambda c: l_extendedprice > c)) AS bin, l_extendedprice AS p, l_discount AS d FROM lineitem, e) SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, min(p) AS low, max(p) AS high, round(avg(d), 6) + 0.0 AS mean FROM b GROUP BY 1")
def quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = coverage.quantile_bins(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return _rounded(b.groupBy("bin").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.avg("l_discount").alias("mean")))


@query("WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS k FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(k AS DOUBLE) AS k FROM r")
def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    return coverage.rank_within(li, "l_quantity", ["l_returnflag"], "k").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("k").cast("double").alias("k"))


_LAG = f"{_GRP}, day AS (SELECT ticker, session_open, round(avg(score), 9) AS x, round(stddev_samp(score), 9) AS y FROM grp GROUP BY 1, 2), w AS (SELECT x, " + ", ".join((f"lead(y, {k}) OVER v" if k >= 0 else f"lag(y, {-k}) OVER v") + f" AS y{k + 5}" for k in range(-5, 6)) + " FROM day WINDOW v AS (PARTITION BY ticker ORDER BY session_open))"


@query("WITH " + _LAG + " " + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS lag, count(*) FILTER (x IS NOT NULL AND y{k + 5} IS NOT NULL) AS n, round(corr(x, y{k + 5}), 6) + 0.0 AS correlation FROM w" for k in range(-5, 6)))
def lead_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = _grouped(spark, sf_dir).groupBy("ticker", "session_open").agg(F.round(F.avg("score"), 9).alias("x"), F.round(F.stddev_samp("score"), 9).alias("y"))
    return _rounded(coverage.lead_lag(day, "x", "y", "ticker", "session_open"))


def _model_rows(spark, sf_dir):
    g = _grouped(spark, sf_dir)
    i = F.col("article_id")
    label = F.when(F.col("score") + ((i % 7) - 3) / 10.0 > 0, 1).otherwise(-1)
    return g.select("article_id", "session_open", "score", (i % 11).alias("f1"), F.when(i % 5 != 0, F.col("score") * 2).alias("f2"), label.alias("label_direction"))


_FOLDS = f"""{_GRP}, rws AS (SELECT article_id, session_open, CASE WHEN score + (article_id % 7 - 3) / 10.0 > 0 THEN 1 ELSE -1 END AS label FROM grp), sizes AS (SELECT session_open, count(*) AS n FROM rws GROUP BY 1),
  upto AS (SELECT session_open, sum(n) OVER (ORDER BY session_open) AS c, row_number() OVER (ORDER BY session_open) AS i FROM sizes),
  cuts AS (SELECT k, arg_min(session_open, {{'d': abs(c - (SELECT sum(n) FROM sizes) * k / 4.0), 'i': -i}}) AS cut FROM upto, range(1, 4) r(k) GROUP BY k),
  ch AS (SELECT *, (SELECT count(*) FROM cuts WHERE g.session_open > cut) AS chunk FROM rws g),
  maj AS (SELECT k, CASE WHEN count(*) FILTER (label = 1) > count(*) FILTER (label = -1) THEN 1 ELSE -1 END AS m FROM ch, range(1, 4) r(k) WHERE chunk < k GROUP BY 1)"""


@query(f"WITH {_FOLDS} SELECT CAST(k AS INTEGER) AS fold, count(*) AS n, round(avg(CASE WHEN label = m THEN 1.0 ELSE 0 END), 6) + 0.0 AS majority_baseline_accuracy, true AS better, true AS agrees FROM ch JOIN maj ON chunk = k GROUP BY 1")
def model_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fold's rows and baseline; whether the model, which sees the number the label is made of, is better, and the test says so."""
    p = models.walk_forward(_model_rows(spark, sf_dir), ["score", "f1", "f2"], "label_direction", "session_open", ["article_id"], 3, models.logistic)
    m = models.fold_metrics(p, "label_direction")
    return m.select("fold", "n", r6("majority_baseline_accuracy").alias("majority_baseline_accuracy"), F.col("beats_baseline").alias("better"), (F.col("significantly_beats_baseline") == (F.col("p_value") < 0.05)).alias("agrees"))


@query(f"WITH {_GRP} SELECT article_id, true AS is_share, true AS agrees FROM grp")
def model_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction a row, its direction that of its probability."""
    rows = _model_rows(spark, sf_dir)
    model = models.fit(rows, ["score", "f1"], "label_direction", models.logistic)
    p = F.col("proba_up")
    return models.predict(model, rows, ["score", "f1"]).select("article_id", p.between(0, 1).alias("is_share"), ((p >= 0.5) == (F.col("pred_direction") == 1)).alias("agrees"))


@query("SELECT * FROM (VALUES ('score', true, true), ('f1', false, true), ('f2', false, true)) v(feature, most, is_share)")
def model_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feature with whether it weighs most: the label is made of the score."""
    rows = _model_rows(spark, sf_dir).withColumn("f2", F.col("article_id") % 3)
    fitted = models.fit(rows, ["score", "f1", "f2"], "label_direction", lambda: models.boosted_trees(maxIter=3))
    found = models.importance_summary(models.importances(fitted, ["score", "f1", "f2"], spark))
    return found.select("feature", (F.col("mean") > 0.5).alias("most"), F.col("mean").between(0, 1).alias("is_share"))


@query("SELECT * FROM (VALUES ('score', true), ('f1', false), ('f2', false)) v(feature, dropped)")
def telltale_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features by which a model tells two periods, here that of the score, and what is left without them."""
    rows = _model_rows(spark, sf_dir).withColumns({"period": F.when(F.col("score") > 0, 1).otherwise(-1), "f2": F.col("article_id") % 3})
    names = ["score", "f1", "f2"]
    dropped = models.telltale_features(rows, names, "period", 1)
    return spark.createDataFrame([(n, n in dropped) for n in names], "feature string, dropped boolean")


def _feed(ticker, first, last):
    days = (last - first).days + 1
    if ticker == "T1" and first.day == 15:
        raise OSError("refused")
    return [{"id": first.toordinal() * 10 + d, "headline": f"{ticker} {d}", "datetime": 86_400 * (first.toordinal() + d - 719_163)} for d in range(days)]


_WINDOWS = "w AS (SELECT t, DATE '2024-01-01' + 7 * CAST(k AS INTEGER) AS f, least(7, 31 - 7 * CAST(k AS INTEGER)) AS n FROM range(5) r(k), (VALUES ('T0'), ('T1')) v(t))"


@query(f"WITH {_WINDOWS} SELECT (datediff('day', DATE '1970-01-01', f) + 719163) * 10 + d AS article_id, t || ' ' || CAST(d AS VARCHAR) AS headline, f + CAST(d AS INTEGER) AS day, t AS ticker FROM w, range(7) x(d) WHERE d < n AND NOT (t = 'T1' AND f = DATE '2024-01-15')", days=("day",))
def windowed_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed read by windows of seven days, one of which always fails; its rows do not come from the tables."""
    out = windows.read_articles(spark, _feed, ["T0", "T1"], "2024-01-01", "2024-01-31", 7)
    return out.select("article_id", "headline", F.to_date("timestamp_utc").alias("day"), "ticker")


@query(f"WITH {_WINDOWS} SELECT t AS window_ticker, f AS window_first, CAST(CASE WHEN t = 'T1' AND f = DATE '2024-01-15' THEN 0 ELSE n END AS BIGINT) AS window_rows, CASE WHEN t = 'T1' AND f = DATE '2024-01-15' THEN 'OSError: refused' END AS window_error FROM w", days=("window_first",))
def window_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.report_of(windows.read_windows(spark, _feed, ["T0", "T1"], "2024-01-01", "2024-01-31", 7)).drop("window_last")


@query("SELECT o_orderkey AS article_id, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 500) AS BIGINT) AS chunk FROM orders")
def numbered_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.numbered_chunks(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_id")), "article_id")


@query("SELECT event_id AS article_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp_utc FROM events")
def pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.read_columns(spark, f"{sf_dir}/events.parquet", ["event_id", "ts"])
    return out.select(F.col("event_id").alias("article_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp_utc"))


@query("SELECT CAST(user_id AS BIGINT) AS user_id, strftime(make_timestamp(CAST(event_id AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS t FROM events")
def unix_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", F.date_format(S.from_unix(F.col("event_id")), "yyyy-MM-dd HH:mm:ss").alias("t"))
