import collections

from oracle import same
from pyspark.sql import functions as F

import corpus_pipeline
from trailweave.llm import mixing, quality, queries


def test_sql_of_the_operators(spark, sf):
    for name, sql in queries.oracle_sql().items():
        same(spark, sf, queries.queries()[name], sql)


def test_stages_on_their_own_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    (_, quality), (_, dedup), (_, mixed), (_, tokens) = corpus_pipeline.STAGES
    good = quality(spark, docs, sf)
    assert good.columns == docs.columns and 0 < good.count() <= docs.count()
    one = dedup(spark, good, sf)
    texts = [r["text"] for r in one.select("text").collect()]
    assert one.columns == docs.columns and len(texts) == len(set(texts)) > 0
    mix = mixed(spark, one, sf)
    copies = collections.Counter(r["doc_id"] for r in mix.select("doc_id").collect())
    assert mix.columns == docs.columns and max(copies.values()) <= 3
    assert tokens(spark, mix, sf).count() == sum(copies.values())


def test_decisions_reach_rows_with_null_or_shared_ids(spark):
    good = [" ".join(f"word{i}{k}" for k in range(40)) for i in range(30)]
    docs = [(None if i % 2 else 7, t, "en", f"s{i % 3}") for i, t in enumerate(good)] + [(7, "too short", "en", "s0"), (None, None, "en", "s1"), (None, "", "en", "s1")]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    assert sorted(r["text"] for r in quality.kept_rows(table).collect()) == sorted(good)
    # of one word each, so that the mix takes whole documents
    docs = [(None, f"w{i}", f"s{i % 3}") for i in range(300)] + [(None, "", "s0"), (None, None, "s1")]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string")
    want = {r["source"]: r["n"] for r in mixing.mix(table).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    got = mixing.mixed_rows(table).collect()
    assert collections.Counter(r["source"] for r in got) == want and all(r["text"] for r in got)


def test_pipeline_runs(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
