"""The pipeline: stages chain, their decisions hold, clean documents stay."""

import corpus_pipeline
from hortus.llm import decontaminate, exact_dedup, minhash

SF = "/root/testdata/sf0.001"


def test_stages_apply_their_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
    out = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in kept.select("doc_id").collect())
    assert exact_dedup.exact_duplicates(kept).where("not kept").count() == 0
    assert minhash.near_duplicates(kept).where("not kept").count() == 0
    assert decontaminate.contaminated(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert out.count() > 0.6 * docs.count()
