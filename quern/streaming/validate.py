"""Validation of streams: stateless, one document a row; counts by event-time window are an extra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators.validate import CompiledSchema, with_verdict


def files(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream, with the columns it has now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")


def validated(stream: DataFrame, schema: CompiledSchema, doc: str) -> DataFrame:
    """The stream with ``valid`` and ``error_code``; no state, so any trigger and any output mode."""
    return with_verdict(stream, schema, doc, error_code="error_code")


def verdicts_by_window(stream: DataFrame, schema: CompiledSchema, doc: str, time: str, *, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Documents by window and error code; state is dropped ``late`` after a window's end."""
    w = F.window(time, width)
    timed = schema.over(stream.withColumn(time, F.col(time).cast("timestamp")), doc, error_code="error_code")
    by = timed.withWatermark(time, late).groupBy(w, "error_code")
    return by.agg(F.count("*").alias("documents")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "error_code", "documents")


def write(stream: DataFrame, path: str, checkpoint: str, *, once: bool = True, output: str = "append") -> StreamingQuery:
    """Parquet with exactly-once commits; ``once`` takes what is there and stops."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(output)
    return (writer.trigger(availableNow=True) if once else writer).start()
