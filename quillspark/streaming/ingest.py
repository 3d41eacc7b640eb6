"""Incremental ingestion: new files of a folder are picked up once, by Structured Streaming."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest_new(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, format: str = "json") -> None:
    """Run transform over the files that have come since the last call and append to a Parquet table; then stop.

    The checkpoint remembers files, so calling again without new files does nothing. A batch that is tried again
    after a failure replaces its own output, so that each file's rows are written once.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(sink)

    stream = spark.readStream.schema(schema).format(format).load(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, time: str, late: str, window: str, slide: str | None, *keys: Column | str) -> DataFrame:
    """Counts over tumbling or sliding windows of a stream or table, with a watermark for late rows."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, window, slide) if slide else F.window(time, window), *keys).agg(F.count("*").alias("n"))
