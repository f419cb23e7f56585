import corpus_pipeline
from procsight.llm import decontaminate, langid, packing, simhash, toxicity
from procsight.llm.queries import tokenizer_path
from tests.conftest import SF


def test_stages_and_their_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect() if r.predicted}
    stay = sorted(set(rows) - toxic)
    kept = docs.where(docs.doc_id.isin(stay))
    network = langid.learn(kept)
    stay = [r.doc_id for r in langid.identify(kept, network).collect() if r.lang_pred != "und" and r.score >= 0.3]
    kept = docs.where(docs.doc_id.isin(stay))
    stay = [r.doc_id for r in simhash.near_duplicates(kept).collect() if r.doc_id == r.component_id]
    kept = docs.where(docs.doc_id.isin(stay))
    stay = set(stay) - {r.doc_id for r in decontaminate.leaks(kept, benchmark).collect()}
    found = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in found} == stay
    want = packing.pack(docs.where(docs.doc_id.isin(sorted(stay))), tokenizer_path()).groupBy("doc_id").sum("length").collect()
    tokens = {}
    for r in found:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens == {r[0]: r[1] for r in want}


def test_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
