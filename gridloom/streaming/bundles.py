"""Bundling small files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.bundle import BUNDLE_BYTES, next_fit, pack_bundles


def stream_files(spark: SparkSession, folder: str, glob: str = "*", files_per_batch: int = 1000) -> DataFrame:
    """A stream of (path, length, content) of new files."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(folder).select("path", "length", "content")


def bundle_stream(files: DataFrame, out: str, checkpoint: str, cap: int = BUNDLE_BYTES):
    """Writes the bundles of each batch to ``out``; a batch that is run again overwrites its own folder, so none counts twice."""

    def write(batch: DataFrame, number: int) -> None:
        own = batch.withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
        packed = pack_bundles(next_fit(own, "length", "path", "folder", cap).withColumn("bundle", F.xxhash64("folder", "bundle")))
        packed.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key, n) of a stream with event times; rows later than the watermark are dropped by Spark."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
