"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import embedding_dedup, exact_dedup, html_extract, language, packing, pii, secrets, sentencepiece_scan, simhash, url_filter

TRIAL_KEY = "not a secret"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SentencePiece ids, and whether decoding them gives the text back."""
    return sentencepiece_scan.encode(_table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's spans with their bin and offset."""
    return packing.best_fit(_table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its number of links at cosine 0.9 or more and the component they make."""
    return embedding_dedup.near_dedup(_table(spark, sf_dir, "embeddings"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, by a conditional random field learned from the held-in labels."""
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(language.labelled_sample(docs)))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the id that stays for its text, by two-pass Bloom filtering."""
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: base patterns, and formats learned from what they find and from public ones."""
    docs = _table(spark, sf_dir, "documents")
    labelled, background = secrets.labelled_sample(docs)
    return secrets.scan(docs, secrets.learn(labelled + secrets.seeds(), background))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the host and path rules."""
    return url_filter.judge(_table(spark, sf_dir, "pages"), url_filter.rules_table(spark))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text by line-block distribution."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def pii_key(spark: SparkSession) -> str:
    """The key that the session names in spark.tidemark.pii.key; where it names none, one that is no secret and serves trials alone."""
    return spark.conf.get("spark.tidemark.pii.key", TRIAL_KEY)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with private values under format-preserving pseudonyms, and their counts."""
    return pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its 64-bit fingerprint and the component of fingerprints within 3 bits."""
    found = simhash.near_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: All pairs and their closure, for small tables; the operator's recall is calibrated, not certain.
OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
whole AS (
  SELECT vec_id, list_filter(e, lambda x: x IS NOT NULL AND isfinite(x)) AS e, len(e) AS n FROM v),
fine AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM whole WHERE len(e) = n AND n > 0 AND list_dot_product(e, e) > 0),
pairs AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
reach AS (
  SELECT vec_id AS u, vec_id AS w FROM v UNION SELECT r.u, p.w FROM reach r JOIN pairs p ON r.w = p.u)
SELECT vec_id, (SELECT count(*) FROM pairs WHERE u = vec_id) AS n_links, low AS component_id, vec_id = low AS kept
FROM v JOIN (SELECT u, min(w) AS low FROM reach GROUP BY u) r ON r.u = vec_id
"""

OP5_SQL = """
WITH keyed AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents),
grouped AS (
  SELECT doc_id, text_sha256, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER (PARTITION BY text_sha256, doc_id) AS copy
  FROM keyed)
SELECT doc_id, keep_id, group_size, (doc_id IS NOT DISTINCT FROM keep_id) AND copy = 1 AS kept, text_sha256 FROM grouped
"""

OP7_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
judged AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_language_id": op4_language_id,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_url_filter": op7_url_filter,
    "op8_html_extract": op8_html_extract,
    "op9_pii": op9_pii,
    "op10_simhash_dedup": op10_simhash_dedup,
}

ORACLES: dict[str, str] = {"op3_embedding_dedup": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op7_url_filter": OP7_SQL}
