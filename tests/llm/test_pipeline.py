"""The pipeline's stages on the smallest tables."""

import corpus_pipeline as cp

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs.count()]
    for name, stage in cp.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()] if "text" in docs.columns else None
        docs = stage(spark, docs, SF).cache()
        seen.append(docs.count())
        if name != "mixing":
            assert docs.columns == columns
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "near_duplicates":
            assert ids == {i for i, n, c in brute.groups(before) if not n or i == c}
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert ids == {r[0] for r in brute.contamination(before, items) if not r[5]}
        if name in ("secrets", "mixing"):
            assert ids == {i for i, _ in before}
    assert seen == sorted(seen, reverse=True) and 0.6 * seen[0] < seen[-1] < seen[0]
    assert docs.columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_run(spark):
    assert cp.run(spark, SF).count() > 0
