"""The pipeline: every stage's effect on its own input."""

import collections

import corpus_pipeline
from paneflow.llm import line_dedup, packing, prob_minhash, quality_ledger, skip_chain_crf


def test_stages(spark, docs_sf, tmp_path):
    docs, seen = docs_sf, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == docs_sf.columns
    b, a = seen["quality_rules"]
    keep = {r["doc_id"] for r in quality_ledger.digest(b).collect() if r["kept"]}
    assert {r["doc_id"] for r in a.collect()} == keep
    b, a = seen["line_dedup"]
    dropped = {r["doc_id"]: r["n_dropped"] for r in line_dedup.digest(b).collect()}
    lines = lambda df: {r["doc_id"]: (r["text"] or "").count("\n") + 1 for r in df.collect()}
    before, after = lines(b), lines(a)
    assert all(after[i] == max(1, before[i] - dropped[i]) for i in before)
    b, a = seen["near_duplicates"]
    classes = {r["doc_id"]: r["class_id"] for r in prob_minhash.digest(b).collect()}
    assert {r["doc_id"] for r in a.collect()} == set(classes.values())
    b, a = seen["personal_data"]
    assert b.count() == a.count()
    assert not any(skip_chain_crf.base_spans(r["text"] or "") for r in a.collect())
    b, a = seen["packing"]
    assert a.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    size = collections.Counter()
    for r in a.collect():
        size[r["sequence_id"]] += r["length"]
    assert max(size.values()) <= packing.WINDOW


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_empty(spark, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
        if "text" not in docs.columns:
            break


def test_odd_rows(spark, odd_docs, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns through all stages in turn."""
    docs, left = odd_docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name != "packing":
            assert docs.columns == odd_docs.columns and docs.select("row").distinct().count() <= 1
        left[name] = collections.Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    kept = collections.Counter(r["doc_id"] for r in quality_ledger.digest(odd_docs).collect() if r["kept"])
    assert left["quality_rules"] == kept == left["line_dedup"]
    classes = {r["doc_id"] for r in odd_docs.collect() if r["doc_id"] in kept}
    assert set(left["near_duplicates"]) <= classes | {None} and left["near_duplicates"] == left["personal_data"]
    assert all(left["near_duplicates"][i] <= 1 for i in classes if i is not None)
    assert set(left["packing"]) == set(left["personal_data"])
