"""Streams of change events: windows, debounced changes, logs, incremental catch-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, schema, files_a_batch: int = 16) -> DataFrame:
    """Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def windowed_counts(events: DataFrame, at: str, keys: list[str], width: str, late: str | None = None) -> DataFrame:
    """Counts by window of time and keys; on a stream, rows later than `late` are left out."""
    rows = events.withWatermark(at, late) if late else events
    return (
        rows.groupBy(F.window(at, width), *keys)
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")
    )


def debounced(events: DataFrame, at: str, key: str, wait: str, late: str | None = None) -> DataFrame:
    """One row for each burst of a key's events: a burst ends when the key is quiet for `wait`."""
    rows = events.withWatermark(at, late) if late else events
    return (
        rows.groupBy(F.session_window(at, wait), key)
        .agg(F.count("*").alias("n"))
        .select(key, F.col("session_window.start").alias("first"), F.col("session_window.end").alias("due"), "n")
    )


def latest_changes(events: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """Each key's last event."""
    last = F.max_by(F.struct(*columns), at)
    return events.groupBy(key).agg(F.max(at).alias(at), last.alias("last")).select(key, at, "last.*")


def write_log(stream: DataFrame, path: str, checkpoint: str, at: str, every: str | None = None) -> StreamingQuery:
    """Appends to a log partitioned by year; without `every`, what is there now."""
    writer = (
        stream.withColumn("year", F.year(at))
        .writeStream.format("parquet")
        .partitionBy("year")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start(path)


def write_updates(stream: DataFrame, sink, checkpoint: str) -> StreamingQuery:
    """Hands each batch and its number to `sink`, once for each number."""
    return (
        stream.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )


def above_mark(rows: DataFrame, id_column: str, mark) -> DataFrame:
    """Rows after the last one that was seen."""
    return rows.filter(F.col(id_column) > mark)


def catch_up(rows: DataFrame, id_column: str, mark: int) -> tuple[DataFrame, int]:
    """Rows above the mark, and the new mark."""
    new = above_mark(rows, id_column, mark)
    top = new.agg(F.max(id_column)).first()[0]
    return new, mark if top is None else top


def counted(rows: DataFrame, keys: list[str], conditions: dict[str, Column]) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.count_if(c).alias(k) for k, c in conditions.items()))
