"""Streaming ingest: files that arrive in a folder, and the latest state of extraction records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fernlode.library import Library
from fernlode.sources import files

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder as a stream of (path, modified, size, content)."""
    rows = spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", "true").load(folder)
    return files.wanted(rows)


def ingest_stream(library: Library, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Ingests arriving files batch by batch. A batch that is repeated after a failure changes
    nothing, as content that is done already is skipped."""

    def take(batch: DataFrame, _: int) -> None:
        library.ingest_rows(batch)

    writer = stream_files(library.spark, folder).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def status_counts_stream(records: DataFrame, window: str = "1 hour", late: str = "6 hours") -> DataFrame:
    """(start, status, n): records by status and event-time window; later ones than `late` are left out."""
    timed = records.where("updated_at is not null").withWatermark("updated_at", late)
    counted = timed.groupBy(F.window("updated_at", window), "status").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "status", "n")
