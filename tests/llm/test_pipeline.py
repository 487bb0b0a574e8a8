import corpus_pipeline
from pyspark.sql import functions as F

from quarry.llm import decontaminate, packing, queries, simhash, substring


def test_stages_on_real_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, now, seen = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf).cache()
        seen[name] = now
        assert now.columns == columns
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert simhash.components(seen["near_dedup"]).groupBy("_d_first").count().filter("count > 1").count() == 0
    assert decontaminate.leaks(now, bench).count() == 0
    kept = {r.doc_id: r.text for r in seen["near_dedup"].collect()}
    want = {r.doc_id: r._x_kept for r in substring.without_repeats(seen["near_dedup"]).collect()}
    assert {r.doc_id: r.text for r in seen["substring_dedup"].collect()} == want and set(want) == set(kept)
    last = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    whole = corpus_pipeline.run(spark, sf)
    total = lambda df: df.agg(F.sum("length"), F.countDistinct("doc_id")).first()
    assert total(last) == total(whole) and total(last)[1] == now.select("doc_id").distinct().count()
    assert whole.filter(F.col("length") > packing.WINDOW).count() == 0


def test_queries_are_registered():
    assert [k.partition("_")[0] for k in queries.QUERIES] == [*(f"op{n}" for n in range(1, 11)), "pipeline"]
