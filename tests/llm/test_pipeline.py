import corpus_pipeline as P
from stratus.llm import decontaminate, quality, secrets, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_chain_and_take_effect(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "packing"]
    stages = dict(P.STAGES)
    labels = spark.read.parquet(f"{sf_small}/labels.parquet")
    good = stages["quality_classifier"](spark, docs, sf_small).cache()
    want = {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    assert good.columns == COLUMNS and {r.doc_id for r in good.collect()} == want and len(want) < docs.count()
    one = stages["simhash_near_dedup"](spark, good, sf_small).cache()
    groups = {r.component_id for r in simhash.near_duplicates(good).collect()}
    assert one.columns == COLUMNS and sorted(r.doc_id for r in one.collect()) == sorted(groups)
    clean = stages["benchmark_decontamination"](spark, one, sf_small).cache()
    bench = spark.read.parquet(f"{sf_small}/benchmark.parquet")
    dirty = {r.doc_id for r in decontaminate.scan(one, bench).where("contaminated").collect()}
    assert {r.doc_id for r in clean.collect()} == groups - dirty
    masked = stages["secret_scan"](spark, clean, sf_small).cache()
    before = {r.doc_id: r.text for r in clean.collect()}
    for r in masked.collect():
        if not secrets.find_spans(before[r.doc_id]):
            assert r.text == before[r.doc_id]
        else:
            assert "[SECRET]" in r.text and r.n_chars == len(r.text)
    assert masked.columns == COLUMNS and masked.count() == clean.count()
    packed = P.run(spark, sf_small)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == groups - dirty


def test_empty_documents(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf_small)
        assert docs.count() == 0
