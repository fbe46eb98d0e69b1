"""Streams of evidence: windows with late data, and keyed tables kept up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmark.sources.sinks import upserted


def event_files(spark: SparkSession, path: str, like: DataFrame, files_at_once: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str, late: str) -> DataFrame:
    """Counts by window and key; rows later than ``late`` are not waited for."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.window(time, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def first_seen(events: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each key once within the time that late rows are waited for."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def keep_upserted(stream: DataFrame, path: str, keys: list[str], is_error: Column, version: str, checkpoint: str) -> StreamingQuery:
    """Upsert each batch into a table of versions under ``path``.

    A batch writes its version in full under its own number, so a batch that
    is repeated writes the same again and a reader of the last finished
    version never sees part of one.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v{number - 1}") if number else None
        rows = upserted(batch.limit(0) if old is None else old, batch, keys, is_error, version)
        rows.write.mode("overwrite").parquet(f"{path}/v{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
