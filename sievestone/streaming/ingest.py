"""Runs as they arrive: files of measurements in a folder, graded batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievestone.operators import classification, grading, quality

SCHEMA = "run_id string, label long, length_px double, width_px double, area_px double, aspect_ratio double, circularity double, solidity double, eccentricity double, orientation_angle double"


def graded(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    return grading.grade(quality.quality(classification.classify(rows)), grading.rules(spark)).select("run_id", "grade", "grade_key", "explanation")


def grade_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str, schema: str = SCHEMA, every: str | None = None) -> StreamingQuery:
    """Grades the runs of each batch of new CSV files (a run must arrive within one batch) and appends
    them to ``out``; a batch that is repeated after a failure replaces its own rows."""

    def batch(rows: DataFrame, number: int) -> None:
        graded(rows).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")

    stream = spark.readStream.schema(schema).option("header", True).csv(folder)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def event_windows(events: DataFrame, length: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts and means of event values in windows of event time, for streams and tables alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    made = rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return made.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "mean")
