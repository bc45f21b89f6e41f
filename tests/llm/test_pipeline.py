import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(1).select((F.col("doc_id") + 10**6).alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars")
    docs, before = docs.union(odd), None
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "minhash_dedup", "secret_scans", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        assert out.count() > 0
        if name != "packing":
            assert sorted(out.columns) == sorted(docs.columns)
            ids = {r.doc_id for r in out.select("doc_id").collect()}
            assert before is None or ids <= before
            before = ids
        docs = out
    assert 10**6 not in before and {r.doc_id for r in docs.select("doc_id").collect()} == before
