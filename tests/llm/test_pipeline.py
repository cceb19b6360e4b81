import corpus_pipeline as p

from lodestrata.llm import mixing, near_dedup, secret_scans, sentencepiece_codec

D = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality classifier", "near dedup", "secret scans", "mixing", "sentencepiece"]
    labels = spark.read.parquet(f"{D}/labels.parquet")
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    for n, (_, f) in enumerate(p.STAGES):
        before = docs
        docs = f(spark, docs, D).cache()
        if n < 4:
            assert docs.columns == before.columns
        if n == 0:
            assert len(bad & {r.doc_id for r in docs.select("doc_id").collect()}) <= 0.2 * len(bad)
        if n == 1:
            assert near_dedup.near_classes(docs).count() == 0
        if n == 2:
            assert docs.count() == before.count()
            found = secret_scans.find_secrets(docs)
            assert found.where("size(assigns) + size(accesses) + size(hexes) > 0").count() == 0
        if n == 3:
            planned = {}
            for r in mixing.plan(before).collect():
                planned[r.id] = planned.get(r.id, 0) + r.m * r.whole + r.ups
            got = {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}
            assert got == {i: c for i, c in planned.items() if c}
        if n == 4:
            codec = sentencepiece_codec.Codec(sentencepiece_codec.Vocabulary(sentencepiece_codec.default_path()))
            for r in docs.limit(20).collect():
                assert codec.encode(r.text).tolist() == r.ids and r.n_ids == len(r.ids)
    assert p.run(spark, D).count() == docs.count()
