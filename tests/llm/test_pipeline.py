import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns
        counts.append(kept.count())
    assert counts[0] >= counts[1] == counts[2] > 0
    assert set(r.doc_id for r in kept.select("doc_id").collect()) <= set(r.doc_id for r in docs.select("doc_id").collect())


def test_run_and_registry(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.where(F.col("ids_sha256").isNull()).count() == 0 and out.count() > 0
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    odd = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(1).withColumn("source", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long")))
    clash = docs.withColumns({c: F.lit("x") for c in ("cut_id", "kept_text", "toxic_id", "gone_id", "taken", "content", "size", "index", "s", "block", "rep", "key", "label", "toxic")})
    for rows in (odd, docs.limit(0), clash):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            columns, rows = rows.columns, stage(spark, rows, SF)
            assert rows.columns == columns
        for _, stage in corpus_pipeline.STAGES[-1:]:
            rows = stage(spark, rows, SF)
        rows.count()
