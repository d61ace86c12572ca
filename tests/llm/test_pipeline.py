"""The corpus pipeline: stages keep the documents' columns and do their work; the whole equals its parts."""

import corpus_pipeline

from driftmill.llm import simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    prints = [simhash.simhash(r["text"]) for r in docs.collect()]
    assert len(set(prints)) == len(prints)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).drop("sequence_id").collect())) == sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], r["offset"]) for r in packed)
    assert toxicity.Sample().positives
