"""Streams give what a table gives."""

from pyspark.sql import functions as F

from corvane.operators import postings
from corvane.streaming import ingest

import oracle


def test_postings_of_a_stream(spark, tmp_path):
    docs = spark.read.parquet(f"{oracle.ROOT}/sf0.001/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    like = spark.read.parquet(f"{tmp_path}/in")
    run = lambda: ingest.postings_sink(ingest.arriving(spark, f"{tmp_path}/in", like, 1), key="doc_id", text=F.col("text"), path=f"{tmp_path}/out", checkpoint=f"{tmp_path}/cp").awaitTermination()
    run()
    want = postings.term_counts(postings.tokenized(docs, key="doc_id", text=F.col("text")))
    assert sorted(map(tuple, ingest.read_postings(spark, f"{tmp_path}/out").collect())) == sorted(map(tuple, want.collect()))
    docs.limit(5).withColumn("doc_id", F.col("doc_id") + 1000).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert ingest.read_postings(spark, f"{tmp_path}/out").filter("doc_id > 1000").select("doc_id").distinct().count() == 5


def test_windows_of_a_stream(spark, tmp_path):
    log = spark.read.parquet(f"{oracle.ROOT}/sf0.001/search_log.parquet").withColumn("served_at", F.col("served_at").cast("timestamp"))
    log.orderBy("served_at").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = ingest.served_per_window(ingest.arriving(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in")))
    q = stream.writeStream.outputMode("update").format("memory").queryName("per_window").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination()
    table = {tuple(r) for r in ingest.served_per_window(log).collect()}
    assert table and {tuple(r) for r in spark.table("per_window").collect()} == table
