"""Streams of event files, and sinks that are read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.session import shared_dir, table


def event_stream(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """events as a stream, a bounded number of files a trigger (back-pressure)."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")


def drain(stream: DataFrame) -> DataFrame:
    """Run a stream over all that its source holds now and read what it appended."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/kinetra-{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex[:12]}"
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def windowed_counts(stream: DataFrame, ts: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """Tumbling windows by event time; rows later than the watermark are dropped, windows it has passed are final."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    out = timed.groupBy(F.window("_ts", width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total")
