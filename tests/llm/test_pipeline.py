"""The pipeline's stages on the small tables."""

import corpus_pipeline as C

DATA = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes = [docs.count()]
    bad = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 0").collect()}
    for i, (_, stage) in enumerate(C.STAGES):
        out = C.written(stage(spark, docs, DATA))
        if i < len(C.STAGES) - 1:
            assert out.columns == docs.columns
            sizes.append(out.count())
            assert 0 < sizes[-1] <= sizes[-2]
            if i == 0:
                left = {r.doc_id for r in out.select("doc_id").collect()}
                assert len(left & bad) < 0.1 * len(bad)
        docs = out
    assert docs.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 4096").count() == 0
    assert docs.select("doc_id").distinct().count() == sizes[-1]
    assert all(a > b for a, b in zip(sizes, sizes[1:], strict=False))
