"""The pipeline against its stages' plain meaning on the smallest table."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from panelworks.llm import neardup, packing, repetition, toxicity

DATA = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES[:3]:
        steps.append(stage(spark, steps[-1], DATA).cache())
        assert steps[-1].columns == docs.columns
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in steps]
    assert ids[1] == {r["doc_id"] for r in repetition.assess(docs).where("kept").collect()}
    model = toxicity.train(steps[1], spark.read.parquet(f"{DATA}/labels.parquet"))
    assert ids[2] == {r["doc_id"] for r in toxicity.score(steps[1], model).where("score < 0.7").collect()}
    assert ids[3] == {r["doc_id"] for r in neardup.near_duplicates(steps[2]).where("kept").collect()}
    out = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"] for r in out} == ids[3]
    h = np.bincount([r["length"] for r in out], minlength=4097)
    assert len({r["sequence_id"] for r in out}) <= packing.lower_bound(h, 4096) + 1


def test_stages_on_odd_rows(spark, docs, no_docs):
    """Null and repeated ids, null texts, columns of clashing names, and no rows at all."""
    odd = docs.withColumnRenamed("lang", "toxicity_score_")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for rows in (odd, no_docs):
            got = stage(spark, rows, DATA)
            if i < 3:
                assert got.columns == rows.columns
                assert got.exceptAll(rows).count() == 0
            if rows is no_docs:
                assert got.count() == 0
            elif i == 3:
                assert got.select("doc_id").distinct().count() == rows.select("doc_id").distinct().count()
            else:
                assert got.count() > 0


def test_run_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{DATA}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
