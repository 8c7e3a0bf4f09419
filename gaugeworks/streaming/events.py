"""The event log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def counts(events: DataFrame, *keys: str) -> DataFrame:
    """Events by key; the same plan over a table and over a stream."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def windowed(events: DataFrame, at: str, width: str, lateness: str, *keys: str) -> DataFrame:
    """Events per tumbling window and key; on a stream, later ones than `lateness` are left out."""
    rows = events.withWatermark(at, lateness) if events.isStreaming else events
    told = rows.groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return told.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def replay(spark: SparkSession, path: str, schema, build, checkpoint: str, out: str) -> DataFrame:
    """Run a streaming plan over what is in a folder now, and return the complete result, written to the folder `out`."""
    stream = build(spark.readStream.schema(schema).parquet(path))
    writer = stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
