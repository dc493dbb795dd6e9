"""The pipeline's stages on small inputs; their decisions against brute force."""

from __future__ import annotations

import corpus_pipeline as C

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in C.STAGES[:-1]:
        out = C.stored(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        sizes.append(out.count())
        docs = out
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    texts = [r["text"] or "" for r in docs.collect()]
    assert not any(b in t for b in bench for t in texts)
    assert not any("@mail" in t for t in texts)
    packed = C.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}


def test_empty_and_odd_rows(spark, docs_frame):
    odd = docs_frame([(1, None), (None, ""), (2, "Some words here."), (2, "Some words here.")]).withColumnRenamed("uid", "drop_key")
    for _, stage in C.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0
    for _, stage in C.STAGES[1:-1]:
        assert stage(spark, odd, SF).columns == odd.columns
