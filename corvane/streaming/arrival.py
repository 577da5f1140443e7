"""Train and index anew when files of the collection arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corvane import api
from corvane.config import Settings


def on_arrival(spark: SparkSession, settings: Settings, *, checkpoint: str, done: Callable[[dict], None] | None = None) -> StreamingQuery:
    """Watch the folder ``settings.corpus``; after new files, train the model and build the index of the whole collection.

    The stream only tells that files came; what is read is the folder, so a
    batch that is repeated after a failure finds the model of the same
    fingerprint and does nothing twice. ``done`` gets the manifest of each new
    index. Stops when all files are in; start it again, or on a schedule, for
    later ones.
    """

    def build(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        api.train_model(spark, settings)
        made = api.build_index(spark, settings)
        if done is not None:
            done(made)

    files = spark.readStream.text(settings.corpus)
    return files.writeStream.foreachBatch(build).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
