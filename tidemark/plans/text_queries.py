"""Registered queries of the text, scoring, fusion and sampling operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import fixed
from tidemark.functions import scores as S
from tidemark.functions import text as T
from tidemark.operators import aggregates, caching, sentences as ops
from tidemark.plans.inputs import SCORED, SENT, r6, r9, registry, scored, sentences, table
from tidemark.sources import pages

QUERIES: dict = {}
ORACLES: dict = {}
query = registry(QUERIES, ORACLES)

#: Words of the synthetic corpus in the roles of a company's aliases.
ALIASES = ["thing", "the ion", "erer"]
RE2_ALIASES = r"(?i)(^|[^A-Za-z0-9-])(?:the ion|thing|erer)($|[^A-Za-z0-9-])"


def _re2(pattern: str) -> str:
    return "(?i)" + pattern.replace(r"(?<!market\s)", "").replace("'", "''")


def _fired(text: str, patterns: list[str]) -> str:
    return " + ".join(f"CAST(regexp_matches({text}, '{_re2(p)}') AS INTEGER)" for p in patterns)


@query(f"WITH {SENT} SELECT article_id, sent_idx, text FROM sent")
def sentence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir)


@query(f"WITH {SENT} SELECT count(*) AS n_sentences, count(DISTINCT text) AS n_texts, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM sent")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir).agg(F.count("*").alias("n_sentences"), F.countDistinct("text").alias("n_texts"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@query(f"WITH {SENT}, often AS (SELECT text FROM sent GROUP BY 1 HAVING count(DISTINCT article_id) >= 5) SELECT article_id, sent_idx, text IN (SELECT text FROM often) AS is_boilerplate FROM sent")
def boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.flag_boilerplate(sentences(spark, sf_dir)).select("article_id", "sent_idx", "is_boilerplate")


@query(rf"SELECT doc_id AS article_id, regexp_replace(text, '([a-z0-9])([.!?])([A-Z])', '\1\2 \3', 'g') AS text FROM documents")
def missing_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), T.fix_missing_space(F.col("text")).alias("text"))


@query(f"WITH {SENT} SELECT article_id, sent_idx, regexp_matches(text, '{RE2_ALIASES}') AS mentions_target, CAST(length(text) AS INTEGER) AS char_len FROM sent")
def alias_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir).select("article_id", "sent_idx", T.names_any(F.col("text"), ALIASES).alias("mentions_target"), F.length("text").alias("char_len"))


@query(f"SELECT doc_id AS article_id, regexp_matches(coalesce(text, ''), '{RE2_ALIASES}') AS named FROM documents")
def headline_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), T.names_any(F.col("text"), ALIASES).alias("named"))


#: Price commentary does not occur in the synthetic prose: a phrase of it is put before, inside or behind each document's text.
PHRASES = ["Shares of it rose 5% higher", "Stock closed up 3.5 % on a rally", "Here's why investors cheered", "The shares quickly fell to a 52-week low", "Top gainers in premarket trading", "", "Stocks are down and hit a new record low", "A quiet day"]
_PHRASE = "CASE CAST(doc_id % 8 AS INTEGER) " + " ".join("WHEN {} THEN '{}'".format(i, p.replace("'", "''")) for i, p in enumerate(PHRASES)) + " END"
_HEAD = f"""head AS (SELECT doc_id AS article_id, CASE doc_id % 3 WHEN 0 THEN p || ' ' || text WHEN 1 THEN left(text, CAST(length(text) // 2 AS INTEGER)) || ' ' || p || '. ' || substr(text, CAST(length(text) // 2 AS INTEGER) + 1) ELSE text || ' ' || p END AS headline, text, p
    FROM (SELECT doc_id, text, {_PHRASE} AS p FROM documents))"""


def _headlines(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    p = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % 8 + 1).cast("int"))
    half = F.floor(F.length("text") / 2).cast("int")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(p, F.lit(" "), "text")).when(F.col("doc_id") % 3 == 1, F.concat(F.substr("text", F.lit(1), half), F.lit(" "), p, F.lit(". "), F.substr("text", half + 1))).otherwise(F.concat("text", F.lit(" "), p))
    return d.select(F.col("doc_id").alias("article_id"), text.alias("headline"), "text", p.alias("p"))


_STRONG, _WEAK = _fired("coalesce(headline, '')", fixed.STRONG_PATTERNS), _fired("coalesce(headline, '')", fixed.WEAK_PATTERNS)


@query(f"WITH {_HEAD} SELECT article_id, CAST({_STRONG} AS DOUBLE) + 0.5 * ({_WEAK}) AS reactive_score, CAST(CAST({_STRONG} AS DOUBLE) + 0.5 * ({_WEAK}) >= 1 AS INTEGER) AS is_reactive FROM head")
def reactive_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.tag_reactive(_headlines(spark, sf_dir).drop("text").withColumnRenamed("headline", "text")).select("article_id", "reactive_score", "is_reactive")


def _weighed(column: str, weight: float) -> str:
    text = f"coalesce({column}, '')"
    return f"{weight} * CAST({_fired(text, fixed.STRONG_PATTERNS)} AS DOUBLE) + {weight / 2} * ({_fired(text, fixed.WEAK_PATTERNS)})"


@query(f"WITH {_HEAD} SELECT article_id, round({_weighed('p', 1.0)} + {_weighed('text', 0.5)} + {_weighed('headline', 0.2)}, 6) + 0.0 AS score FROM head")
def reactive_three_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrase as headline, the document as summary, both as body."""
    return _headlines(spark, sf_dir).select("article_id", r6(T.reactive_article_score(F.col("p"), F.col("text"), F.col("headline"))).alias("score"))


_HITS = ", ".join(f"CASE WHEN regexp_matches(h, '{_re2(p)}') THEN 'H{m} ' || regexp_extract(h, '{_re2(p)}') END" for m, ps in (("!", fixed.STRONG_PATTERNS), ("?", fixed.WEAK_PATTERNS)) for p in ps)


@query(f"WITH {_HEAD} SELECT article_id, array_to_string(list_filter([{_HITS}], lambda x: x IS NOT NULL), '; ') AS hits FROM (SELECT article_id, coalesce(headline, '') AS h FROM head)")
def reactive_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headlines(spark, sf_dir).select("article_id", F.array_join(T.reactive_hits(F.col("headline"), "H"), "; ").alias("hits"))




def _reactive_sentences(spark, sf_dir):
    q = F.round(F.col("pos") * 50)
    s = scored(spark, sf_dir).withColumn("reactive_score", (q % 5) / 2.0)
    return s.withColumn("is_reactive", (F.col("reactive_score") >= 1).cast("int"))


@query(f"""WITH {SCORED}, rs AS (SELECT article_id, tgt, CAST(round(pos * 50) % 5 AS DOUBLE) / 2 AS score FROM fusd)
SELECT article_id, count(*) FILTER (tgt AND score >= 1) AS n_reactive_sents, round(count(*) FILTER (tgt AND score >= 1) / nullif(count(*) FILTER (tgt), 0), 6) + 0.0 AS reactive_share,
  round(avg(score) FILTER (tgt), 6) + 0.0 AS reactive_mean, max(score) FILTER (tgt) AS reactive_max, coalesce(count(*) FILTER (tgt AND score >= 1) / nullif(count(*) FILTER (tgt), 0), 0) >= 0.5 AS reactive_article FROM rs GROUP BY 1""")
def reactive_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _reactive_sentences(spark, sf_dir)
    out = s.groupBy("article_id").agg(*aggregates.reactive_aggregates(s))
    out = out.withColumn("reactive_article", aggregates.reactive_article(F.col("reactive_share"), F.lit(0.0)))
    return out.withColumns({"reactive_share": r6("reactive_share"), "reactive_mean": r6("reactive_mean")})


@query(r"SELECT doc_id AS article_id, left(sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')), 16) AS text_hash, left(sha256(regexp_replace(text, '^\s+|\s+$', '', 'g') || chr(0) || source), 16) AS pair_hash FROM documents")
def text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("article_id"), T.text_hash(F.col("text")).alias("text_hash"), T.pair_hash(F.col("text"), F.col("source")).alias("pair_hash"))


@query("SELECT text_hash, arg_max(doc_id, doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars FROM (SELECT left(sha256(text), 16) AS text_hash, doc_id, n_chars FROM documents) GROUP BY 1")
def dedupe_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.substring(F.sha2("text", 256), 1, 16).alias("text_hash"), "doc_id", "n_chars")
    return caching.keep_last(d, ["text_hash"], "doc_id")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n = 1")
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caching.keep_first(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@query("""WITH old AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 3 = 0), new AS (SELECT o_orderkey AS k, -o_totalprice AS v FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v FROM old o FULL JOIN new n ON o.k = n.k""")
def cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    new = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), (-F.col("o_totalprice")).alias("v"))
    return caching.merge_cache(old, new, ["k"])


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    todo = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return caching.not_cached(todo, table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("k")), ["k"])


_WORDS = "len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: w IN ({})))"


@query(f"""WITH {SENT}, m AS (SELECT *, article_id % 3 <> 0 AS tgt, {_WORDS.format("'the', 'le', 'der'")} AS p, {_WORDS.format("'of', 'de', 'und'")} AS n FROM sent)
SELECT article_id, sent_idx, CASE WHEN tgt THEN round(p / (p + n + 1), 6) + 0.0 END AS pos, CASE WHEN tgt THEN round(n / (p + n + 1), 6) + 0.0 END AS neg, CASE WHEN tgt THEN round(1 / (p + n + 1), 6) + 0.0 END AS neu FROM m""")
def scored_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sentences(spark, sf_dir).withColumns({"mentions_target": F.col("article_id") % 3 != 0, "mentions_ceo": F.lit(False)})
    out = caching.score_sentences(s, caching.lexicon_scorer(["the", "le", "der"], ["of", "de", "und"]))
    return out.select("article_id", "sent_idx", r6("pos").alias("pos"), r6("neg").alias("neg"), r6("neu").alias("neu"))


@query(f"""WITH {SCORED} SELECT article_id, sent_idx, (mentions_target OR mentions_ceo) AND NOT is_boilerplate AS needs_score, tgt AS target, ceo AND NOT mentions_target AS chief_only, ceo AS chief_any, tgt AND resolved_by_coref AS judged, channel FROM fusd""")
def populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    return s.select("article_id", "sent_idx", S.needs_score(s).alias("needs_score"), S.target_population(s).alias("target"), S.chief_only(s).alias("chief_only"), S.chief_any(s).alias("chief_any"), S.judge_population(s).alias("judged"), S.provenance_channel(s).alias("channel"))


_V = {
    "fin": "fin", "absa": "absa", "mean_blend": "(fin + absa) / 2", "sign_graft": "CASE WHEN abs(absa) < 0.05 THEN 0 ELSE sign(absa) * abs(fin) END", "conf_graft": "absa * abs(fin)",
    "conf_graft_soft": "sign(absa) * abs(fin) * (0.5 + 0.5 * abs(absa))", "conf_graft_floor": "x", "gated": "fin * (1 - absa_neu)", "agree_only": "CASE WHEN absa IS NULL THEN NULL WHEN sign(fin) = sign(absa) THEN fin ELSE 0 END",
}


@query(f"WITH {SCORED} SELECT article_id, sent_idx, {', '.join(f'round({e}, 9) + 0.0 AS {n}' for n, e in _V.items())} FROM fusd")
def fusion_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("article_id", "sent_idx", *[r9(c).alias(n) for n, c in S.score_variants(0.05).items()])


_TOP = "list_sort(list(x) FILTER (tgt AND x IS NOT NULL), '{}')[1:3]"
_TOPM = "CASE WHEN len({0}) > 0 THEN list_sum({0}) / len({0}) END"
_HI, _LO = _TOPM.format(_TOP.format("DESC")), _TOPM.format(_TOP.format("ASC"))
_FUS = f"""round(avg(x) FILTER (tgt), 9) + 0.0 AS fus_conf_graft_floor_mean, round(median(x) FILTER (tgt), 9) + 0.0 AS fus_conf_graft_floor_median, round(coalesce(avg(x) FILTER (tgt AND sent_idx < 5), 0), 9) + 0.0 AS fus_conf_graft_floor_lead,
  round({_HI}, 9) + 0.0 AS fus_conf_graft_floor_top3_pos, round({_LO}, 9) + 0.0 AS fus_conf_graft_floor_top3_neg, round({_HI} - {_LO}, 9) + 0.0 AS fus_conf_graft_floor_spread"""


@query(f"WITH {SCORED} SELECT article_id, {_FUS} FROM fusd GROUP BY 1")
def article_fusion_aggs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    out = s.groupBy("article_id").agg(*aggregates.fusion_aggregates(s))
    return out.select("article_id", *[r9(c).alias(c) for c in out.columns[1:]])


_EXTRA = """round(arg_max(x, {'a': abs(x), 'i': -sent_idx}) FILTER (tgt AND x IS NOT NULL), 9) + 0.0 AS fus_maxmag, round(avg(x) FILTER (tgt AND channel IN ('surface', 'coref_span')), 9) + 0.0 AS fus_trusted_mean,
  round(avg(abs(fin - absa)) FILTER (tgt), 9) + 0.0 AS fus_scorer_gap, count(*) FILTER (tgt AND x IS NOT NULL AND channel IN ('surface', 'coref_span')) AS n_trusted_sents"""


@query(f"WITH {SCORED} SELECT article_id, {_EXTRA}, round(avg(x) FILTER (ceo), 9) + 0.0 AS fus_ceo_mean FROM fusd GROUP BY 1")
def extra_fusion_aggs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    out = s.groupBy("article_id").agg(*aggregates.extra_aggregates(s), aggregates.chief_aggregate(s))
    return out.withColumns({c: r9(c) for c in ("fus_maxmag", "fus_trusted_mean", "fus_scorer_gap", "fus_ceo_mean")})


@query(f"""WITH {SCORED} SELECT article_id, {', '.join(f"count(*) FILTER (tgt AND channel = '{c}') AS prov_{c}_n, round(count(*) FILTER (tgt AND channel = '{c}') / nullif(count(*) FILTER (tgt), 0), 9) + 0.0 AS prov_{c}_share, round(avg(x) FILTER (tgt AND channel = '{c}'), 9) + 0.0 AS prov_{c}_conf_graft_floor_mean" for c in fixed.CHANNELS)} FROM fusd GROUP BY 1""")
def provenance_aggs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    out = s.groupBy("article_id").agg(*aggregates.provenance_aggregates(s))
    return out.withColumns({c: r9(c) for c in out.columns if c.endswith(("_share", "_mean"))})


_WIDE = ", ".join(
    f"round(avg({p}) FILTER (tgt), 9) + 0.0 AS sent_entity_{p}, round(avg({p}) FILTER (tgt AND sent_idx < 5), 9) + 0.0 AS sent_entity_lead_{p}, round(avg({p}) FILTER (ceo AND NOT mentions_target), 9) + 0.0 AS sent_ceo_{p}, "
    f"round(avg(absa_{p}) FILTER (tgt), 9) + 0.0 AS absa_entity_{p}, round(avg(absa_{p}) FILTER (ceo AND NOT mentions_target), 9) + 0.0 AS absa_ceo_{p}, round(arg_max({p}, {{'a': abs(fin), 'i': -sent_idx}}) FILTER (tgt), 9) + 0.0 AS sent_entity_maxmag_{p}"
    for p in ("pos", "neg", "neu")
)


@query(f"WITH {SCORED} SELECT article_id, {_WIDE} FROM fusd GROUP BY 1")
def article_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    out = s.groupBy("article_id").agg(*aggregates.wide_aggregates(s))
    return out.select("article_id", *[r9(c).alias(c) for c in out.columns[1:]])


_SHAPE = """count(*) FILTER (NOT is_boilerplate) AS n_total_sents, count(*) FILTER (tgt) AS n_entity_sents, count(*) FILTER (ceo AND NOT mentions_target) AS n_ceo_sents, count(*) FILTER (ceo) AS n_ceo_mention_sents,
  count(*) FILTER (is_boilerplate) AS n_boilerplate_sents, coalesce(count(*) FILTER (tgt) / nullif(count(*) FILTER (NOT is_boilerplate), 0), 0) AS entity_share, CAST(sum(char_len) AS BIGINT) AS article_length"""
_NOROUND = lambda s: s.replace("round(", "(").replace(", 9) + 0.0", ")")
_ROUNDED = ["entity_share", *aggregates.FUSION_COLUMNS, "fus_ceo_mean", "fus_headline", *aggregates.EXTRA_COLUMNS, "fus_headline_gap", "fus_lead_gap"]
_ZERO = ", ".join(f"CASE WHEN n_entity_sents = 0 THEN coalesce({c}, 0) ELSE {c} END AS {c}" for c in [*aggregates.FUSION_COLUMNS, "fus_ceo_mean", *aggregates.EXTRA_COLUMNS])


@query(f"""WITH {SCORED},
  agg AS (SELECT article_id, {_SHAPE}, {_NOROUND(_FUS)}, {_NOROUND(_EXTRA)}, avg(x) FILTER (ceo) AS fus_ceo_mean FROM fusd GROUP BY 1),
  hd AS (SELECT o_orderkey AS article_id, sign(ap - an) * abs(p - n) * (0.7 + 0.3 * abs(ap - an)) AS fus_headline, o_orderkey % 3 = 0 AS named
    FROM (SELECT o_orderkey, (o_orderkey % 10) / 10 AS p, (o_orderkey % 7) / 10 AS n, (o_custkey % 10) / 10 AS ap, (o_custkey % 7) / 10 AS an FROM orders)),
  kept AS (SELECT a.*, h.fus_headline FROM agg a LEFT JOIN hd h USING (article_id) WHERE n_entity_sents > 0 OR coalesce(h.named, false)),
  zeros AS (SELECT * REPLACE ({_ZERO}) FROM kept),
  shrunk AS (SELECT * REPLACE (fus_conf_graft_floor_mean * (n_entity_sents / (n_entity_sents + 4.0)) AS fus_conf_graft_floor_mean, fus_trusted_mean * (n_trusted_sents / (n_trusted_sents + 4.0)) AS fus_trusted_mean) FROM zeros),
  done AS (SELECT *, n_ceo_mention_sents > 0 AS has_ceo_mention, fus_headline - fus_conf_graft_floor_mean AS fus_headline_gap, fus_conf_graft_floor_lead - fus_conf_graft_floor_mean AS fus_lead_gap FROM shrunk)
SELECT article_id, {', '.join(c if c not in _ROUNDED else f'round({c}, 9) + 0.0 AS {c}' for c in aggregates.MODEL_COLUMNS)} FROM done""")
def article_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    part = lambda c, m: (F.col(c) % m) / 10.0
    heads = o.select(F.col("o_orderkey").alias("article_id"), part("o_orderkey", 10).alias("pos"), part("o_orderkey", 7).alias("neg"), part("o_custkey", 10).alias("absa_pos"), part("o_custkey", 7).alias("absa_neg"))
    out = aggregates.article_features(scored(spark, sf_dir), heads, named=F.col("article_id") % 3 == 0)
    return out.withColumns({c: r9(c) for c in _ROUNDED})


@query("""WITH a AS (SELECT o_orderkey AS article_id, (o_orderkey % 10) / 10 AS p, (o_orderkey % 7) / 10 AS n FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey AS article_id, (o_custkey % 10) / 10 AS ap, (o_custkey % 7) / 10 AS an FROM orders WHERE o_orderkey % 3 = 0)
SELECT article_id, round(sign(ap - an) * abs(p - n) * (0.7 + 0.3 * abs(ap - an)), 9) + 0.0 AS fus_headline FROM a FULL JOIN b USING (article_id)""")
def headline_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("article_id", F.col("o_orderkey"))
    part = lambda c, m: (F.col(c) % m) / 10.0
    a = o.where("o_orderkey % 2 = 0").select("article_id", part("o_orderkey", 10).alias("pos"), part("o_orderkey", 7).alias("neg"))
    b = o.where("o_orderkey % 3 = 0").select("article_id", part("o_custkey", 10).alias("absa_pos"), part("o_custkey", 7).alias("absa_neg"))
    out = aggregates.headline_scores(a, b)
    return out.withColumn("fus_headline", r9("fus_headline"))


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z'']{3,}')) AS w FROM documents) WHERE w NOT IN ('the', 'and', 'that') GROUP BY 1 ORDER BY n DESC, w LIMIT 20")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators import coverage

    return coverage.word_counts(table(spark, sf_dir, "documents"), "text", ["the", "and", "that"])


@query(f"""WITH {SENT} SELECT article_id, sent_idx, array_to_string(coalesce(list(text) OVER (PARTITION BY article_id ORDER BY sent_idx RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING), []), '|') AS preceding,
  array_to_string(coalesce(list(text) OVER (PARTITION BY article_id ORDER BY sent_idx RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING), []), '|') AS following FROM sent""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sentences(spark, sf_dir)
    heads = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.col("text").alias("headline"))
    out = ops.contexts(s, heads)
    return out.select("article_id", "sent_idx", F.array_join("preceding", "|").alias("preceding"), F.array_join("following", "|").alias("following"))


@query(f"""WITH {SENT}, h AS (SELECT *, article_id % 4 AS stratum, md5('0|' || CAST(article_id AS VARCHAR) || '|' || CAST(sent_idx AS VARCHAR)) AS o FROM sent),
  a AS (SELECT *, row_number() OVER (PARTITION BY stratum, article_id ORDER BY o) AS n FROM h), b AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY o) AS m FROM a WHERE n <= 2)
SELECT CAST(stratum AS VARCHAR) || '-' || CAST(article_id AS VARCHAR) || '-' || CAST(sent_idx AS VARCHAR) AS sample_id, text FROM b WHERE m <= 50""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sentences(spark, sf_dir).withColumn("stratum", F.col("article_id") % 4)
    out = ops.stratified_sample(s, ["article_id", "sent_idx"])
    return out.select(T.sample_id(F.col("stratum").cast("string"), F.col("article_id"), F.col("sent_idx")).alias("sample_id"), "text")


@query("SELECT doc_id FROM documents ORDER BY md5('7|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sample_rows(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 100, 7)


@query("SELECT page_id AS article_id, CASE WHEN page_id % 5 = 0 THEN 'five' WHEN page_id % 3 = 0 THEN 'three' ELSE 'rest' END AS stratum FROM pages")
def stratum_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("article_id"))
    return ops.stratum(p, [("five", F.col("article_id") % 5 == 0), ("three", F.col("article_id") % 3 == 0)], "rest")


#: A mention before each sentence of the documents, to put a name in.
MENTIONS = ["it", "It", "its", "they're", "the carmaker", "the CEO", "a school bus", "the company's"]
_SURFACE = "CASE CAST((article_id + sent_idx) % 8 AS INTEGER) " + " ".join("WHEN {} THEN '{}'".format(i, m.replace("'", "''")) for i, m in enumerate(MENTIONS)) + " END"
_MENTION = f"""{SENT}, m AS (SELECT article_id, sent_idx, {_SURFACE} AS s, ' gained, and ' || text AS rest FROM sent), t AS (SELECT *, s || rest AS text FROM m)"""


def _mentions(spark, sf_dir):
    s = F.element_at(F.array(*map(F.lit, MENTIONS)), ((F.col("article_id") + F.col("sent_idx")) % 8 + 1).cast("int"))
    return sentences(spark, sf_dir).select("article_id", "sent_idx", s.alias("s"), F.concat(s, F.lit(" gained, and "), "text").alias("text"))


@query(f"""WITH {_MENTION} SELECT article_id, sent_idx, CASE WHEN s IN ('the CEO', 'a school bus') THEN text ELSE CASE s WHEN 'its' THEN 'Tesla''s' WHEN 'they''re' THEN 'Tesla are' WHEN 'the company''s' THEN 'Tesla''s' ELSE 'Tesla' END || rest END AS new_text,
  CASE s WHEN 'the CEO' THEN 'person' WHEN 'a school bus' THEN 'not_mention' ELSE 'substituted' END AS outcome FROM t""")
def substitute(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mentions(spark, sf_dir)
    new, outcome = T.substitution(F.col("text"), F.lit(0), F.length("s"), F.lit("Tesla"))
    return m.select("article_id", "sent_idx", new.alias("new_text"), outcome.alias("outcome"))


@query(f"""WITH {_MENTION} SELECT article_id, sent_idx, CASE s WHEN 'It' THEN 'Tesla' WHEN 'its' THEN 'tesla''s' WHEN 'they''re' THEN 'tesla are' WHEN 'the company''s' THEN 'tesla''s' ELSE 'tesla' END AS inflected FROM t""")
def inflect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(spark, sf_dir).select("article_id", "sent_idx", T.inflected(F.lit("tesla"), F.col("s")).alias("inflected"))


@query(f"""WITH {_MENTION} SELECT article_id, sent_idx, CASE WHEN s IN ('the CEO', 'a school bus') THEN text ELSE CASE s WHEN 'its' THEN 'Tesla''s' WHEN 'they''re' THEN 'Tesla are' WHEN 'the company''s' THEN 'Tesla''s' ELSE 'Tesla' END || rest END AS absa_text, 'Tesla' AS absa_aspect FROM t""")
def scoring_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mentions(spark, sf_dir).withColumns({"mentions_target": F.lit(True), "mentions_ceo": F.lit(False), "resolved_by_coref": F.lit(True), "mention_char_start": F.lit(0), "mention_char_end": F.length("s")})
    return ops.build_pairs(m, "TSLA").select("article_id", "sent_idx", "absa_text", "absa_aspect")


@query("""WITH d AS (SELECT doc_id AS article_id, 'Tesla opened plant ' || CAST(doc_id AS VARCHAR) || ' in the north of ' || coalesce(source, 'there') || '.' AS a, 'It hired ' || CAST(n_chars AS VARCHAR) || ' people in all of them.' AS b FROM documents)
SELECT article_id, CAST(i AS INTEGER) AS sent_idx, CASE WHEN i = 0 THEN a ELSE b END AS text, true AS mentions_target, false AS mentions_ceo, i = 1 AS resolved_by_coref, false AS is_boilerplate, CAST(length(CASE WHEN i = 0 THEN a ELSE b END) AS INTEGER) AS char_len,
  CAST(CASE WHEN i = 1 THEN 0 END AS INTEGER) AS mention_char_start, CAST(CASE WHEN i = 1 THEN 2 END AS INTEGER) AS mention_char_end
FROM d, (VALUES (0), (1)) v(i)""")
def coref_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies made from each document's id, source and length, with one cluster of a name and a pronoun: the pronoun's sentence becomes the target's."""
    first = F.concat(F.lit("Tesla opened plant "), F.col("doc_id").cast("string"), F.lit(" in the north of "), F.coalesce("source", F.lit("there")), F.lit("."))
    second = F.concat(F.lit("It hired "), F.col("n_chars").cast("string"), F.lit(" people in all of them."))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.concat(first, F.lit(" "), second).alias("text"), F.length(first).alias("n"))
    d = d.withColumn("clusters", F.expr("array(array(named_struct('s', 0, 'e', 5), named_struct('s', n + 1, 'e', n + 3)))")).drop("n")
    return ops.tag_sentences(ops.located_sentences(d), "TSLA", ops.map_clusters(d, "TSLA"))


@query()
def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages.parsed(table(spark, sf_dir, "pages").select("page_id", "html"))
    return p.select("page_id", "processed_body", F.length("processed_body").alias("n_chars"))


_LD = """ld AS (SELECT page_id, CASE CAST(page_id % 4 AS INTEGER) WHEN 0 THEN '2024-01-05T10:00:00Z' WHEN 1 THEN '2024-01-05T10:00:00+02:00' WHEN 2 THEN '2024-01-05T10:00:00' END AS published, page_id % 3 = 0 AS cross_host,
  TIMESTAMP '2024-01-05 06:00:00' AS api, CASE WHEN page_id % 2 = 0 THEN 'Wire ' || CAST(page_id AS VARCHAR) END AS provider FROM pages)"""


@query(f"""WITH {_LD}, c AS (SELECT *, CASE CAST(page_id % 4 AS INTEGER) WHEN 0 THEN TIMESTAMP '2024-01-05 10:00:00' WHEN 1 THEN TIMESTAMP '2024-01-05 08:00:00' END AS cand FROM ld)
SELECT page_id, coalesce(provider, 'Paper') AS true_source, CASE WHEN cand IS NOT NULL AND abs(epoch(cand) - epoch(api)) <= CASE WHEN cross_host THEN 30 * 86400 ELSE 3 * 3600 + 3 * 3600 END THEN cand ELSE api END AS utc,
  CASE WHEN cand IS NOT NULL THEN 'corrected' ELSE 'api' END AS time_source FROM c""", times=("utc",))
def jsonld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, each with linked data made from its number put before it, read back through the page parser."""
    k = F.col("page_id") % 4
    when = F.when(k == 0, F.lit("2024-01-05T10:00:00Z")).when(k == 1, F.lit("2024-01-05T10:00:00+02:00")).when(k == 2, F.lit("2024-01-05T10:00:00"))
    provider = F.when(F.col("page_id") % 2 == 0, F.struct(F.concat(F.lit("Wire "), F.col("page_id").cast("string")).alias("name")))
    obj = F.to_json(F.struct(when.alias("datePublished"), provider.alias("provider"), F.struct(F.lit("Paper").alias("name")).alias("publisher")))
    made = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit('<script type="application/ld+json">{bad</script><script type="application/ld+json">['), obj, F.lit("]</script>"), F.coalesce("html", F.lit(""))).alias("html"))
    p = pages.parsed(made)
    utc, source = pages.resolved_time(pages.to_utc(pages.published(F.col("ld_objects"), F.col("meta_time"))), F.lit("2024-01-05 06:00:00").cast("timestamp"), F.col("page_id") % 3 == 0)
    return p.select("page_id", pages.true_source(F.col("ld_objects"), F.lit("host")).alias("true_source"), utc.alias("utc"), source.alias("time_source"))


@query("""WITH r AS (SELECT o_orderkey AS article_id, CASE WHEN o_orderkey % 5 = 0 THEN '404' ELSE '200' END AS status, o_orderkey % 7 <> 0 AS timed, o_custkey % 900 AS body FROM orders)
SELECT article_id, CASE WHEN status <> '200' THEN 'unreached' WHEN NOT timed THEN 'time failed' WHEN body < 500 THEN 'body failed' END AS reason FROM r""")
def loss_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    status, utc = F.when(k % 5 == 0, "404").otherwise("200"), F.when(k % 7 != 0, F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select(k.alias("article_id"), pages.loss_reason(status, utc, F.col("o_custkey") % 900 >= 500).alias("reason"))


@query("""SELECT o_orderkey AS article_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Wire' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'Yahoo' ELSE 'Benzinga' END END AS source, o_custkey % 900 AS n_chars FROM orders WHERE o_custkey % 900 >= 500 AND o_orderkey % 4 <> 1""")
def accepted_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    source = F.when(k % 4 == 1, "CNBC").when(k % 2 == 0, "Yahoo").otherwise("Benzinga")
    a = o.select(k.alias("article_id"), F.lit("h").alias("headline"), F.lit("s").alias("summary"), source.alias("source"), F.lit("u").alias("url"), F.col("o_orderdate").alias("timestamp_utc"))
    body = F.repeat(F.lit("x"), (F.col("o_custkey") % 900).cast("int"))
    r = o.select(k.alias("article_id"), F.lit("Wire").alias("true_source"), (k % 3 == 0).alias("source_ok"), F.col("o_orderdate").alias("utc"), body.alias("raw_body"), body.alias("processed_body"))
    return pages.accepted(a, r).select("article_id", "source", F.length("processed_body").cast("long").alias("n_chars"))


@query("SELECT key, len(names) AS n_names, names[1] AS display_name FROM (VALUES " + ", ".join("('{}', [{}])".format(k, ", ".join(f"'{n}'" for n in v["names"])) for k, v in fixed.COMPANIES.items()) + ") v(key, names)")
def company_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.company_registry(spark).select("key", F.size("names").cast("long").alias("n_names"), F.element_at("names", 1).alias("display_name"))


@query(f"WITH {SCORED}, a AS (SELECT article_id, sent_idx, tgt AND resolved_by_coref AS inside, CASE CAST((article_id + sent_idx) % 3 AS INTEGER) WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unsure' END AS answer FROM fusd) SELECT article_id, sent_idx, CASE WHEN inside THEN answer END AS judge_answer, NOT inside OR answer = 'yes' AS judge_accepted FROM a")
def judge_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    rows = s.where(S.judge_population(s)).select("article_id", "sent_idx", F.lit("TSLA").alias("target"))
    verdicts = caching.judge_pending(rows, None, lambda r: ["yes", "no", "perhaps"][(r["article_id"] + r["sent_idx"]) % 3], "stand-in", "v1")
    return caching.gate(s, verdicts).select("article_id", "sent_idx", "judge_answer", "judge_accepted")
