"""Submissions as a stream of files: through the batch sinks, so that a replayed batch adds nothing, or deduplicated in the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plotsage.sources import tables
from plotsage.sources.submissions import parse_csv_text, parse_geojson, source_format


def features_of(files: DataFrame) -> DataFrame:
    """Features of files (submission, value), by the format of each."""
    told = files.withColumn("format", source_format(F.col("submission"), F.col("value")))
    return parse_geojson(told.filter("format = 'geojson'")).unionByName(parse_csv_text(told.filter("format = 'csv'")))


def files_of(spark: SparkSession, source: str) -> DataFrame:
    """Files of a folder as they come: submission and value."""
    return spark.readStream.format("text").option("wholetext", True).load(source).select(F.input_file_name().alias("submission"), "value")


def packed_of(spark: SparkSession, source: str) -> DataFrame:
    """Submissions of a folder of Parquet files, each of which holds many, as they come: submission and value."""
    return spark.readStream.schema("submission string, value string").parquet(source)


def ingest_unique(spark: SparkSession, source: str, target: str, checkpoint: str, within: str = "30 days", packed: bool = False) -> StreamingQuery:
    """Watch a folder of submissions; write the plots with geometry under target, the first of each geom_hash.

    The hashes seen are the stream's own state, by key, which the checkpoint keeps: no batch reads the table, and files that
    come at one time or in different batches give a plot once. A hash is forgotten once it was first seen longer ago than
    within, which bounds the state. Ends when all files are read.

    packed: the folder holds Parquet files of many submissions. Small submissions should come so, as a file of its own for each
    costs more than reading it.
    """
    files = packed_of(spark, source) if packed else files_of(spark, source)
    features = features_of(files).filter("parts is not null").withColumn("seen_at", F.current_timestamp())
    unique = features.withWatermark("seen_at", within).dropDuplicatesWithinWatermark(["geom_hash"])
    rows = unique.withColumn("plot_id", F.substring("geom_hash", 1, 16))
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Watch a folder of submissions; write plots and ingestion runs under target. Ends when all files are read."""

    def batch(files: DataFrame, _: int) -> None:
        features = features_of(files).persist()
        tables.append_plots(features, f"{target}/plots")
        tables.append_runs(features, f"{target}/runs")
        features.unpersist()

    return files_of(spark, source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
