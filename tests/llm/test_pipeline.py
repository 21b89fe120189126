"""The stages in order, each against what it should do to its own input."""

import random
from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from locusflow.llm import nbsvm, ngram_join, packing, secret_scan
from test_operators import DOCS, awkward, labelled, prose

SECRET = "9f8b7c6d5e4f3a2b1c0d9f8b7c6d5e4f3a2b1c0d"
STAGES = dict(corpus_pipeline.STAGES)


def tables(spark, tmp_path, docs, labels, bench):
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_pipeline_is_its_stages(spark, tmp_path):
    rng = random.Random(12)
    docs, labels = labelled(spark, 300, 11)
    item = prose(rng, 30)
    more = [(1000, "", "en", "s", 0), (None, None, None, None, None), (1001, docs.first()["text"], "en", "s", 1)]
    docs = docs.withColumn("text", F.when(F.col("doc_id") == 8, F.concat(F.lit(f'password = "{SECRET}" '), "text")).otherwise(F.col("text")))
    docs = docs.withColumn("text", F.when(F.col("doc_id") == 7, F.concat("text", F.lit(f" {item}"))).otherwise(F.col("text"))).union(spark.createDataFrame(more, DOCS))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    d = tables(spark, tmp_path, docs, labels, bench)
    at = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, d)
        assert out.columns == at.columns, name
        if name == "quality_classifier":
            heads = nbsvm.fit(at, labels)
            assert set(heads) == {"quality", "toxic"}
        if name == "benchmark_decontamination":
            assert out.filter("doc_id = 7").count() == 0
        if name == "secret_scans":
            assert out.count() == at.count()
        path = f"{tmp_path}/out-{name}"
        out.write.parquet(path)
        at = spark.read.parquet(path)
    want = sorted(map(str, packing.pack(at).collect()))
    assert sorted(map(str, corpus_pipeline.run(spark, d).collect())) == want and want
    tokens = sum(len(r["text"].split()) for r in at.collect())
    packed = Counter(w for r in corpus_pipeline.run(spark, d).collect() for w in r["text"].split())
    assert packed == Counter(w for r in at.collect() for w in r["text"].split())  # the redacted text itself
    assert SECRET in docs.filter("doc_id = 8").first()["text"] and SECRET not in packed and SECRET not in " ".join(packed)
    assert corpus_pipeline.run(spark, d).agg(F.sum("n_tokens")).first()[0] == tokens


def test_stages_take_awkward_and_empty_tables(spark, tmp_path):
    _, labels = labelled(spark, 50, 13)
    odd = awkward(spark)
    d = tables(spark, tmp_path, odd, labels.limit(0), spark.createDataFrame([], "item_id long, text string"))
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, odd.limit(0)):
            out = stage(spark, docs, d)
            assert out.count() >= 0
            assert name == "best_fit_packing" or out.columns == docs.columns


def test_registered(spark):
    q = __spark_entry__.queries()
    assert q["pipeline"] is corpus_pipeline.run
    assert [k for n in range(1, 11) for k in q if k.startswith(f"op{n}_")] == list(q)[-12:-2]
    assert ngram_join.bands_for(0.6, 0.9995, 3) > 1 and secret_scan.MASK
