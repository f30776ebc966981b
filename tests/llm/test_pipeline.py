import corpus_pipeline
from waymark.llm import jaccard_join, source_mix, token_files

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in docs.collect()}
    assert [f for _, f in corpus_pipeline.STAGES] == [corpus_pipeline.quality, corpus_pipeline.near_duplicates, corpus_pipeline.benchmark, corpus_pipeline.mix, corpus_pipeline.tokens]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = jaccard_join.stored(stage(spark, docs, SF))
        assert out.columns == docs.columns
        now = [r.doc_id for r in out.collect()]
        assert set(now) <= kept and now
        if k == 1:
            groups = {r.doc_id: r.component_id for r in jaccard_join.groups(docs).collect()}
            assert sorted(now) == sorted(set(groups.values()))
        if k == 3:
            want = {r.doc_id: r.copies if r.size else 1 for r in source_mix.plan(docs).select("row.doc_id", "size", "copies").collect()}
            assert {d: now.count(d) for d in want} == want
        docs, kept = out, set(now)
    last = corpus_pipeline.tokens(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in last) == sorted(now) and max(r.start + r.n_tokens for r in last) == sum(r.n_tokens for r in last)
    assert token_files.read(spark, token_files.write(docs.limit(0), __import__("public_tokenizers").path("word_bpe_49k.json"), 1)).count() == 0
