"""The pipeline's stages on a small table, each judged on its own input."""

import collections

from frameloom.llm import lsh_forest, mixing, quality_ledger

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    folder = str(tmp_path / "sf")
    source.write.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "pii", "mixing", "packing"]
    docs, seen = source, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen.append(docs)
    quality, near, pii, mixed, packed = seen
    assert all(d.columns == source.columns for d in seen[:4])
    ledger = quality_ledger.ledger(source)
    assert quality.count() == ledger.where(quality_ledger.verdict()).count() < source.count()
    groups = lsh_forest.near_duplicates(quality)
    assert near.count() == groups.select("component_id").distinct().count()
    assert {r[0] for r in near.select("doc_id").collect()} == {r[0] for r in groups.where("kept").select("doc_id").collect()}
    assert pii.count() == near.count()
    copies = {r["row_key"]: r["copies"] for r in mixing.plan(pii).collect()}
    assert collections.Counter(r[0] for r in mixed.select("doc_id").collect()) == collections.Counter({k: c for k, c in copies.items() if c})
    tokens = packed.groupBy("doc_id").sum("length").collect()
    assert {r[0] for r in tokens} == {k for k, c in copies.items() if c}
    again = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, packed.collect()))
