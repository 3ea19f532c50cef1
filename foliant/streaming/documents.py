"""The clean-up as a stream: documents that arrive in a folder are cleaned batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from foliant.plans.book import BookConfig, clean_book


def clean_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, config: BookConfig = BookConfig()) -> StreamingQuery:
    """Reads Parquet files (doc_id, text) as they come, and writes each batch to a folder of its own, so a batch that is
    run again replaces itself. Every operator works on whole documents and keeps no state between batches."""

    def write(batch: DataFrame, number: int) -> None:
        clean_book(batch, config).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema("doc_id long, text string").parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
