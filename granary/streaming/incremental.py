"""Incremental runs: documents cleaned as they land, and event windows with late data.

Order across micro-batches is arrival order, so manual-first priority can't be kept on a stream: the first copy that
arrives is kept. Offsets and state live in the checkpoint, and a stopped query goes on where it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T


def document_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def clean_stream(docs: DataFrame) -> DataFrame:
    """The quality gate, then the first row of each prefix hash. State grows by one hash a kept document."""
    good = docs.where(T.good_document(F.col("text")))
    return good.withColumn("prefix", T.prefix_hash(F.col("text"))).dropDuplicates(["prefix"])


def clean_stream_bounded(docs: DataFrame, time: str, horizon: str) -> DataFrame:
    """Like clean_stream with state only for copies that arrive within a horizon of one another."""
    good = docs.where(T.good_document(F.col("text"))).withWatermark(time, horizon)
    return good.withColumn("prefix", T.prefix_hash(F.col("text"))).dropDuplicatesWithinWatermark(["prefix"])


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy("event_type", F.window("ts", width).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def append_metrics(metrics: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream of metric events added to a log of JSON lines; what was written before is never changed."""
    return metrics.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stop_after_batch(query: StreamingQuery) -> None:
    """Lets the batch in work end and its offsets be written, then stops; the next start goes on behind it."""
    query.processAllAvailable()
    query.stop()


def write_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that has landed, exactly once, then stop."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
