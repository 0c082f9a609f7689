"""Stateless streaming: files that arrive in a folder are detected and redacted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import detect
from ..operators.replace import redact


def redact_stream(docs: DataFrame, text: str = "text", lists=None) -> DataFrame:
    """A stream (or table) of documents with `spans` and `redacted` added; no state, so no watermark."""
    return detect(docs, text, lists).withColumn("redacted", redact(F.col(text), F.col("spans")))


def redact_folder(spark: SparkSession, schema: str, source: str, sink: str, checkpoint: str, text: str = "text") -> StreamingQuery:
    """Parquet files appearing below source, redacted into Parquet below sink; exactly once by the file sink's log."""
    stream = spark.readStream.schema(schema).parquet(source)
    out = redact_stream(stream, text).drop(text, "spans")
    return out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
