"""The stages, each on what its predecessor kept, and the pipeline's run."""

import cases

import corpus_pipeline
from cases import docs, no_docs  # noqa: F401
from leaksieve.session import materialise

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs):
    from pyspark.sql import functions as F

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "packing"]
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = items.first()
    planted = docs.withColumn("text", F.when(F.col("doc_id") == 12, F.concat("text", F.lit("\n" + item.text))).otherwise(F.col("text")))
    kept = planted
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = materialise(stage(spark, before, SF), name)
        assert kept.columns == docs.columns and kept.count() <= before.count()
        if name == "language_id":
            assert all(t and any(map(str.isalpha, t)) for _, t in cases.pairs(kept))
    rows = [(r.item_id, r.text) for r in items.collect()]
    assert not any(r[5] for r in cases.contamination(cases.pairs(kept), rows))
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert packed.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_empty(spark, no_docs):
    kept = no_docs
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF)
        assert kept.count() == 0
