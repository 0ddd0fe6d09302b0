"""Micro-batch ingestion: a folder of JSON lines becomes index segments.

Each batch is one segment. Its number is the batch's, and a batch that is run
again replaces its own segment, so a restart never doubles postings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import GROUP, Index, build
from ..sources.corpus import parsed_lines


def ingest(spark: SparkSession, source: str, index: str, checkpoint: str, available_now: bool = True, interval: str = "3 seconds") -> StreamingQuery:
    """Start the stream; with ``available_now`` it ends when the present files are done."""
    lines = spark.readStream.format("text").load(source)

    def batch(rows: DataFrame, number: int) -> None:
        corpus = parsed_lines(rows).where("ok").select("doc_id", "text").withColumn(GROUP, F.lit(number))
        made = build(corpus)
        for name, table in (("postings", made.postings), ("meta", made.meta)):
            table.drop(GROUP).write.mode("overwrite").parquet(f"{index}/{name}/{GROUP}={number}")

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def streamed_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.option("basePath", f"{path}/postings").parquet(f"{path}/postings"), spark.read.option("basePath", f"{path}/meta").parquet(f"{path}/meta"))


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and hour, for a stream or a table; late rows within the watermark still count."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
