import corpus_pipeline
from wayfarer.llm import bpe, registry

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids, texts = docs.columns, {r["doc_id"] for r in docs.collect()}, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        kept = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(kept) <= ids and (name != "pii" or set(kept) == ids)
        ids, texts = set(kept), kept
    whole = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, SF).collect()}
    again = {r["doc_id"]: r["ids_sha256"] for r in bpe.round_trip(docs).collect()}
    assert whole == again and len(whole) == len(texts)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "decontamination", "pii", "bpe"]


def test_every_operator_is_registered():
    names = set(registry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
