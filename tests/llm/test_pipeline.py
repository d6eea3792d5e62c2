"""The pipeline: each stage against its operator by hand on the smallest tables."""

import corpus_pipeline


def test_stages_and_run(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.4 * seen[0]
    pieces = corpus_pipeline.run(spark, sf)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_every_stage_begins_without_the_garbage_of_those_before(spark):
    sf, jvm = "/root/testdata/sf0.001", spark.sparkContext._jvm
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        garbage = jvm.java.lang.ref.WeakReference(f"before {name}")  # a string that nothing else holds
        assert garbage.get()
        stage(spark, docs, sf)
        assert garbage.get() is None, name
