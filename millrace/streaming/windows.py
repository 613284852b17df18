"""Structured streams over files of events: windows with late data, sessions, duplicates, last states.

Each query runs the stream over what is there (availableNow) and gives the result as a
table, which batch SQL can check; the same plans run continuously with another trigger.
Executors write the results to Parquet, nothing goes through the driver.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder
from .merge import KeyedTable


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    """The stream of one Parquet file or folder."""
    schema = spark.read.parquet(path).schema
    folder, name = posixpath.split(path.rstrip("/"))
    # A single file is read by a glob of its folder, as streams read folders.
    single = spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder).select("path").limit(1).collect() if "." in name else []
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)


def events(spark: SparkSession, path: str, watermark: str = "1 hour", time: str = "ts") -> DataFrame:
    """The stream of one events file or folder, with a watermark on its time."""
    return rows_of(spark, path).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, watermark)


def _run(stream: DataFrame, mode: str, put, checkpoint: str) -> None:
    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def updated(stream: DataFrame, key: list[str], folder: str | None = None) -> DataFrame:
    """The latest state of every key of a stream that runs in update mode: state below the watermark goes, late rows are dropped."""
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    table = KeyedTable(spark, f"{folder}/table", key, ["_batch"], buckets=16)
    _run(stream, "update", lambda batch, n: table.merge(batch.withColumn("_batch", F.lit(n).cast("long")), n), f"{folder}/checkpoint")
    out = table.read()
    return (spark.createDataFrame([], stream.schema) if out is None else out).select(*stream.columns)


def appended(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """All rows of a stream in append mode, or its whole result in complete mode; a batch that comes again replaces itself."""
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    name = (lambda n: f"{folder}/rows/batch={n}") if mode == "append" else (lambda n: f"{folder}/rows/batch=0")
    seen = []

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(name(n))
        seen.append(n)

    _run(stream, mode, put, f"{folder}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows") if seen else spark.createDataFrame([], stream.schema)


def _counted(grouped) -> DataFrame:
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def tumbling(spark: SparkSession, path: str, size: str = "1 hour") -> DataFrame:
    w = _counted(events(spark, path).groupBy(F.window("ts", size).alias("w"), "event_type"))
    out = updated(w.select(F.col("w.start").alias("start"), "event_type", "n", "total"), ["start", "event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


def sliding(spark: SparkSession, path: str, size: str = "2 hours", slide: str = "1 hour") -> DataFrame:
    w = _counted(events(spark, path).groupBy(F.window("ts", size, slide).alias("w")))
    out = updated(w.select(F.col("w.start").alias("start"), "n", "total"), ["start"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("window_start"), "n", F.round("total", 2).alias("total"))


def sessions(spark: SparkSession, path: str, gap: str = "6 hours") -> DataFrame:
    """Session windows run in complete mode, as update mode is not offered for them."""
    w = _counted(events(spark, path).groupBy(F.session_window("ts", gap).alias("w"), "user_id"))
    out = appended(w.select(F.col("w.start").alias("start"), "user_id", "n", "total"), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("session_start"), "n", F.round("total", 2).alias("total"))


def deduplicated(spark: SparkSession, path: str) -> DataFrame:
    w = events(spark, path).dropDuplicatesWithinWatermark(["event_id"]).select("user_id", "event_type")
    return appended(w).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


def merged_batches(stream: DataFrame, table: KeyedTable, checkpoint: str) -> DataFrame | None:
    """Merges what is there into ``table`` (last write wins) and gives its state; the checkpoint names the stream."""
    _run(stream, "append", lambda batch, n: table.merge(batch, n, checkpoint), checkpoint)
    return table.read()


def last_states(spark: SparkSession, path: str, key: list[str], order: list[str], *, removed: str | None = None, folder: str | None = None) -> DataFrame:
    """The last row of each key of a change stream, without the keys whose last change removes them."""
    folder = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = rows_of(spark, path)
    out = merged_batches(stream, KeyedTable(spark, f"{folder}/table", key, order, removed=removed), f"{folder}/checkpoint")
    return spark.createDataFrame([], stream.schema) if out is None else out
