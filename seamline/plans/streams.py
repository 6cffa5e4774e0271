"""Streams over the driver's tables, run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import watch
from . import scratch


def counted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type, n, value: partial counts of each batch are appended under the batch's number, so that a repeated batch replaces its own."""
    folder = scratch.folder(spark, "streams")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events*")

    def take(batch: DataFrame, number: int) -> None:
        part = batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
        part.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    watch.watch(events, take, f"{folder}/checkpoint", once=True).awaitTermination()
    done = spark.read.schema("event_type string, n long, value double").parquet(f"{folder}/out")
    return done.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("value"), 4).alias("value"))
