"""Content-keyed caches around pluggable scorers: compute once for each text, join back, keep the newest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions import scores as S
from tidemark.functions import text as T
from tidemark.session import ship

TRIPLE = "pos double, neg double, neu double"
Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def keep_last(df: DataFrame, keys: list[str], version: Column | str) -> DataFrame:
    """The row with the largest version of each key."""
    version = F.col(version) if isinstance(version, str) else version
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def merge_cache(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both caches, the new row where a key is in both."""
    every = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    return keep_last(every, keys, "_v").drop("_v")


def not_cached(rows: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(cache.select(*keys).distinct(), keys, "left_anti")


def score_texts(texts: DataFrame, scorer: Scorer, cache: DataFrame | None, key: str, inputs: list[str]) -> DataFrame:
    """(key, pos, neg, neu) for the distinct keys of `texts`: what the cache has, and the scorer's for the rest.

    Texts are sorted by length inside a partition, so that a batch pads little.
    """
    ship(texts.sparkSession)
    wanted = texts.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.first(c).alias(c) for c in inputs])
    todo = wanted if cache is None else not_cached(wanted, cache, [key])
    kind = texts.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.concat([frame[[key]].reset_index(drop=True), scorer(frame[inputs].reset_index(drop=True))[["pos", "neg", "neu"]]], axis=1)

    fresh = todo.sortWithinPartitions(F.length(inputs[0])).mapInPandas(run, f"{key} {kind}, {TRIPLE}")
    if cache is None:
        return fresh
    known = cache.join(wanted.select(key), key, "left_semi").select(key, "pos", "neg", "neu")
    return known.unionByName(fresh)


def score_sentences(sentences: DataFrame, scorer: Scorer, cache: DataFrame | None = None, only_relevant: bool = True) -> DataFrame:
    """Adds pos, neg, neu; sentences that need no score keep NULL even where the same text was scored elsewhere."""
    mask = S.needs_score(sentences) if only_relevant else F.lit(True)
    keyed = sentences.withColumn("_hash", F.when(mask, T.text_hash(F.col("text"))))
    found = score_texts(keyed.select(F.col("_hash"), F.col("text")), scorer, cache, "_hash", ["text"])
    return _joined_back(keyed, found)


def _joined_back(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """Left join on _hash, which goes. Rows without one, often most of them, are dealt out by what they hold instead of meeting in one task."""
    aside = F.concat(F.lit("-"), F.xxhash64(*[c for c, t in keyed.dtypes if not t.startswith("map")]).cast("string"))
    return keyed.withColumn("_hash", F.coalesce("_hash", aside)).join(found, "_hash", "left").drop("_hash")


def score_pairs(pairs: DataFrame, scorer: Scorer, cache: DataFrame | None = None, text: str = "absa_text", aspect: str = "absa_aspect") -> DataFrame:
    """Adds absa_pos, absa_neg, absa_neu for (text, aspect) pairs; an empty aspect has none."""
    keyed = pairs.withColumn("_hash", F.when(F.coalesce(F.col(aspect), F.lit("")) != "", T.pair_hash(F.col(text), F.col(aspect))))
    found = score_texts(keyed.select("_hash", text, aspect), scorer, cache, "_hash", [text, aspect])
    return _joined_back(keyed, found.select("_hash", *[F.col(c).alias(f"absa_{c}") for c in ("pos", "neg", "neu")]))


def without_scorer(pairs: DataFrame) -> DataFrame:
    """What an unavailable pair scorer leaves: NULL scores."""
    return pairs.withColumns({f"absa_{c}": F.lit(None).cast("double") for c in ("pos", "neg", "neu")})


def lexicon_scorer(positive: list[str], negative: list[str]) -> Scorer:
    """A deterministic stand-in for a sentiment model: smoothed shares of listed words, summing to 1."""
    good, bad = set(positive), set(negative)

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        words = frame.iloc[:, 0].fillna("").str.lower().str.findall("[a-z]+")
        p = words.map(lambda w: sum(x in good for x in w))
        n = words.map(lambda w: sum(x in bad for x in w))
        total = p + n + 1
        return pd.DataFrame({"pos": p / total, "neg": n / total, "neu": 1 / total})

    return score


def resolve_mentions(docs: DataFrame, resolver: Callable[[list[str]], list] | None, cache: DataFrame | None = None) -> DataFrame:
    """(text_hash, clusters) of each distinct text; without a resolver, or where it fails, no clusters.

    Clusters are arrays of arrays of (s, e) spans. An empty text has none.
    """
    ship(docs.sparkSession)
    kind = "array<array<struct<s: int, e: int>>>"
    wanted = docs.select(T.text_hash(F.col("text")).alias("text_hash"), "text").where("text is not null").dropDuplicates(["text_hash"])
    todo = wanted if cache is None else not_cached(wanted, cache, ["text_hash"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            try:
                found = resolver(texts) if resolver else [[] for _ in texts]
            except Exception:  # noqa: BLE001 a model that fails leaves texts unresolved
                found = [[] for _ in texts]
            clusters = [[[{"s": int(s), "e": int(e)} for s, e in c] for c in doc] if t.strip() else [] for t, doc in zip(texts, found)]
            yield pd.DataFrame({"text_hash": frame["text_hash"], "clusters": clusters})

    fresh = todo.mapInPandas(run, f"text_hash string, clusters {kind}")
    return fresh if cache is None else cache.join(wanted.select("text_hash"), "text_hash", "left_semi").select("text_hash", "clusters").unionByName(fresh)


def judge_pending(rows: DataFrame, answered: DataFrame | None, judge: Callable[[dict], str], model_id: str, prompt_version: str) -> DataFrame:
    """The judge's cache after judging the rows it lacks: article_id, sent_idx, target, model_id, prompt_version, answer.

    A judge that raises, or answers outside yes, no and unsure, counts as unsure.
    """
    ship(rows.sparkSession)
    keys = ["article_id", "sent_idx", "target", "model_id", "prompt_version"]
    keyed = rows.withColumn("model_id", F.lit(model_id)).withColumn("prompt_version", F.lit(prompt_version)).dropDuplicates(keys)
    todo = keyed if answered is None else not_cached(keyed, answered, keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = []
            for row in frame.to_dict("records"):
                try:
                    answer = judge(row)
                except Exception:  # noqa: BLE001 fail closed
                    answer = "unsure"
                answers.append(answer if answer in ("yes", "no", "unsure") else "unsure")
            yield frame[keys].assign(answer=answers)

    fresh = todo.mapInPandas(run, ", ".join(f"{k} {todo.schema[k].dataType.simpleString()}" for k in keys) + ", answer string")
    return fresh if answered is None else answered.select(*keys, "answer").unionByName(fresh)


def gate(sentences: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Adds judge_answer and judge_accepted: rows outside the judged population pass without an answer."""
    mine = S.judge_population(sentences)
    out = sentences.join(verdicts.select("article_id", "sent_idx", F.col("answer").alias("_a")), ["article_id", "sent_idx"], "left")
    return out.withColumn("judge_answer", F.when(mine, F.col("_a"))).withColumn("judge_accepted", ~mine | S.accept_only(F.col("_a"))).drop("_a")
