"""Keep postings up to date as new documents arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.functions import text as T
from corvane.operators.postings import term_counts, tokenized


def arriving(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 64) -> DataFrame:
    """A stream of the parquet files that arrive in a folder, with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def postings_sink(documents: DataFrame, *, key: str, text: Column, path: str, checkpoint: str, chain=T.preprocess) -> StreamingQuery:
    """Append the postings of each batch of documents to ``path``.

    Each batch is its own folder, overwritten if the batch is repeated after a
    failure, so no document is indexed twice. Stops when all files are in.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        term_counts(tokenized(batch, key=key, text=text, chain=chain)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """All postings so far, without the batch number."""
    return spark.read.parquet(path).drop("batch")


def served_per_window(log: DataFrame, *, time: str = "served_at", late: str = "2 days", width: str = "1 day") -> DataFrame:
    """(``window_start``, ``ranker``, ``hits``): hits by event time; each hit id counts once within the watermark.

    Works on a stream, where rows later than the watermark are dropped and the
    first of equal ids to arrive counts, and on a table, where all rows count
    and of equal ids the one served first, then that of the first ranker.
    """
    if log.isStreaming:
        once = log.withWatermark(time, late).dropDuplicatesWithinWatermark(["hit_id"])
    else:
        once = log.filter(F.col(time).isNotNull()).groupBy("hit_id").agg(F.min(F.struct(time, "ranker")).alias("h")).select("h.*")
    grouped = once.groupBy(F.window(time, width), "ranker").agg(F.count(F.lit(1)).alias("hits"))
    return grouped.select(F.col("window.start").alias("window_start"), "ranker", "hits")
