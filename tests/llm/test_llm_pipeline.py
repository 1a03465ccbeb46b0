import re

import duckdb
import pytest
import xxhash
from test_llm_queries import lowered, placed, plain_bins, plain_pseudonyms

import __spark_entry__
import corpus_pipeline
from tidemark.llm import common, language

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 10


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    extra = spark.createDataFrame([(10_001, None, "en", "a", 0), (10_002, "", "en", "a", 0), (10_003, "123 456", None, None, 7)], docs.schema)
    docs = docs.unionByName(extra)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before.count()
    assert {10_001, 10_002, 10_003}.isdisjoint({r.doc_id for r in docs.select("doc_id").collect()})
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_shared_folder_is_asked_for_on_clusters():
    class Context:
        master = "spark://host:7077"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Session:
        conf = {}
        sparkContext = Context()

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        Context.master = master
        with pytest.raises(ValueError):
            common.shared_folder(Session())


def test_pipeline_on_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", lowered(text)) if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_run_matches_brute_force(spark):
    docs = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    model = language.train(language.labelled_sample(spark.read.parquet(f"{SF}/documents.parquet")))
    known = {i: model.label([t], True)[0] for i, t in docs.items()}
    docs = {i: t for i, t in docs.items() if known[i][0] != "und" and known[i][2] <= language.MOST_SURPRISE}
    last = {}
    for i in sorted(docs):
        last[lowered(docs[i])] = i
    docs = {i: docs[i] for i in sorted(last.values())}
    prints = {i: fingerprint(t) for i, t in docs.items()}
    label = {i: i for i in docs}
    for _ in range(8):
        label = {i: min(label[j] for j in docs if (prints[i] ^ prints[j]).bit_count() <= 3) for i in docs}
    docs = {i: plain_pseudonyms(t) for i, t in docs.items() if label[i] == i}
    sources = dict(duckdb.sql(f"select doc_id, source from '{SF}/documents.parquet'").fetchall())
    got = corpus_pipeline.run(spark, SF).collect()
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.span_end - r.span_start
    assert total == {i: len(t) + 1 for i, t in docs.items()}
    assert placed(got) == plain_bins({i: (t, sources[i]) for i, t in docs.items()})


def test_junk_and_foreign_texts_go_and_clean_ones_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(90_001, "litwo ojczyzno moja ty jestes jak zdrowie ile cie trzeba cenic ten tylko sie dowie kto cie stracil", None, "a", 90), (90_002, "xqzt kjvw qqzx wvkj zzxq jkqv xwzq vvkq zjxw qkzv xjqw " * 20, None, "a", 900), (90_003, "....", "en", "a", 4)]
    kept = {r.doc_id for r in corpus_pipeline.keep_known_languages(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), SF).select("doc_id").collect()}
    assert kept.isdisjoint({90_001, 90_002, 90_003}) and len(kept) >= 0.99 * docs.where("text rlike '[A-Za-z]'").count()
