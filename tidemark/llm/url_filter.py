"""URL rules by host suffix and path prefix, with DataFrame functions only.

Each URL is expanded into host-suffix + path-prefix expressions; these are equi-joined with the rules
on the first 32 bits of their SHA-256, confirmed by the full digest, and the longest rule wins (of
equal ones the longer host, then block before allow). Only those pairs of suffix labels and prefix
length are made that occur among the rules, so a URL of any shape gives a bounded number.

Edges: the host is what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; the
path follows up to `?`, `#` or the end. A null URL or one without `://` has empty host and path and
fits no rule, as does an empty path a rule that asks for `/`. Rules with a null host, path or verdict
are left out; repeated rules count once. URLs are judged once each; a very frequent URL is joined back
by broadcast. Empty tables give empty results. Other columns of the pages are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.common import lookup, materialise
from tidemark.llm.exact_dedup import LOWER, UPPER

#: Rules of up to so many bytes are broadcast; more are joined by shuffling distinct expressions.
MOST_BROADCAST = 20_000_000
#: Bytes that a rule takes beside its text.
RULE_BYTES = 200
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Rules (host, path, verdict) as literals of the plan."""
    kind = "struct<host: string, path: string, verdict: string>"
    rows = F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(("host", "path", "verdict"), rule)]) for rule in rules]).cast(f"array<{kind}>")
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    rules = rules.dropna(subset=["host", "path", "verdict"]).select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.select(F.concat("host", "path").alias("rule"), "host", "path", "verdict")
    size = rules.agg(F.coalesce(F.sum(2 * F.octet_length("rule") + RULE_BYTES), F.lit(0))).first()[0]
    shapes = sorted(map(tuple, rules.select(F.size(F.split("host", r"\.")).alias("d"), F.length("path").alias("n")).distinct().collect()))
    keyed = rules.select(F.sha2("rule", 256).alias("full"), "rule", F.struct(F.length("rule").alias("len"), F.length("host").alias("host_len"), F.col("verdict"), F.col("rule")).alias("rank"))
    keyed = keyed.withColumn("short", _short("full"))

    urls = materialise(pages.groupBy(F.col(url_col).alias("url")).agg(F.count("*").alias("n")), "urls")
    total = urls.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    labels = F.size(F.split("host", r"\."))
    pairs = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(n).alias("n")) for d, n in shapes]).cast("array<struct<d: int, n: int>>")
    fit = F.filter(pairs, lambda p: (labels >= p["d"]) & (F.length("path") >= p["n"]))
    made = F.transform(fit, lambda p: F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -p["d"]), F.substr("path", F.lit(1), p["n"])))
    parts = urls.where("instr(url, '://') > 0").select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    exprs = parts.select("url", F.explode(made).alias("e")).select("url", F.sha2("e", 256).alias("full")).withColumn("short", _short("full"))
    if size <= MOST_BROADCAST:
        hits = exprs.alias("e").join(F.broadcast(keyed).alias("r"), F.col("e.short") == F.col("r.short")).where("e.full = r.full").select("e.url", "r.rank")
    else:
        seen = materialise(exprs.groupBy("short", "full").agg(F.count("*").alias("m")), "exprs")
        known = seen.alias("s").join(keyed.alias("r"), F.col("s.short") == F.col("r.short")).where("s.full = r.full").select("s.full", "s.m", "r.rank")
        hits = lookup(exprs.select("url", "full"), "full", known, "m", seen.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0], "url").where("rank is not null").select("url", "rank")
    best = hits.groupBy("url").agg(F.max("rank").alias("rank"))
    # All URLs, those without a rule too: the lookup must know every frequent one.
    best = urls.join(best, "url", "left").select("url", "n", F.col("rank.rule").alias("rule"), F.col("rank.verdict").alias("verdict"))
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    out = lookup(own, "url", best, "n", total, "page_id")
    return out.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _short(full: str) -> Column:
    return F.conv(F.substring(full, 1, 8), 16, 10).cast("long")
