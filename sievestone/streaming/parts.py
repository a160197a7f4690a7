"""Runs that arrive in parts: rows are kept until a run is whole, then it is graded once.

A store is a folder with three tables, each by part (the number of the batch that wrote it) and bucket
(a hash of the run): ``rows`` as they came, ``counts`` of each batch's rows by run, and ``graded``.  A batch
writes only its own part, so one that is repeated after a failure replaces what it wrote and changes
nothing else; it reads only buckets in which it has rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructType

from .ingest import graded

BUCKETS = 64
COUNTS = "run_id {kind}, n long, total long"
GRADED = "run_id {kind}, grade string, grade_key string, explanation string"


def bucket(run_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(run_id), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, store: str, name: str, part: int) -> None:
    rows.withColumn("bucket", bucket(F.col("run_id"))).write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/{name}/part={part}")


def _read(spark: SparkSession, store: str, name: str, schema: StructType | str) -> DataFrame:
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    whole = StructType([*fields.fields]).add("part", LongType()).add("bucket", IntegerType())
    return spark.read.schema(whole).parquet(f"{store}/{name}")


def _first_rows(rows: DataFrame) -> DataFrame:
    """One row of each object: that of the earliest part, the least of several in it."""
    others = [c for c in rows.columns if c not in ("run_id", "label", "part", "bucket")]
    kept = rows.groupBy("run_id", "label").agg(F.min(F.struct("part", *others)).alias("_r"))
    return kept.select("run_id", "label", *(F.col(f"_r.`{c}`").alias(c) for c in others))


def _whole(rows: DataFrame, total: str) -> DataFrame:
    """Rows of the runs that have as many objects as they announce."""
    first = _first_rows(rows)
    runs = first.groupBy("run_id").agg(F.count("*").alias("_n"), F.max(total).alias("_t")).where("_n >= _t").select("run_id")
    return first.join(runs, "run_id", "left_semi")


def absorb(rows: DataFrame, part: int, store: str, total: str = "expected") -> None:
    """Stores the rows of a batch and grades the runs that it completes.

    A run is whole once it has as many different labels as the greatest number in ``total`` of its rows
    announces; runs that announce none, and rows without a run, wait.  Sums of the parts' counts find runs
    that may be whole, and only their rows are read and counted exactly, so rows sent twice complete
    nothing.  Rows that come after a run was graded are stored and do not change its grade.
    """
    spark, schema = rows.sparkSession, rows.schema
    kind = dict(rows.dtypes)["run_id"]
    _write(rows, store, "rows", part)
    stored = _read(spark, store, "rows", schema).where(F.col("part") <= part)
    now = stored.where(F.col("part") == part)
    by_run = now.groupBy("run_id").agg(F.count_distinct("label").alias("n"), F.max(F.col(total).cast("long")).alias("total"))
    _write(by_run, store, "counts", part)
    touched = [r.bucket for r in now.select("bucket").distinct().collect()]  # at most BUCKETS numbers
    here = F.col("bucket").isin(touched)
    counts = _read(spark, store, "counts", COUNTS.format(kind=kind)).where(here & (F.col("part") <= part))
    known = _read(spark, store, "graded", GRADED.format(kind=kind)).where(here & (F.col("part") < part))
    sums = counts.groupBy("run_id").agg(F.sum("n").alias("n"), F.max("total").alias("total"), F.max("part").alias("_last"))
    ready = sums.where((F.col("n") >= F.col("total")) & (F.col("_last") == part)).join(known, "run_id", "left_anti").select("run_id")
    _write(graded(_whole(stored.where(here).join(ready, "run_id", "left_semi"), total)), store, "graded", part)


def grade_parts(stream: DataFrame, store: str, checkpoint: str, total: str = "expected", every: str | None = None) -> StreamingQuery:
    """Grades the runs of a stream of measured objects as they become whole (``absorb``)."""
    kind = dict(stream.dtypes)["run_id"]
    spark = stream.sparkSession
    # the first batch looks for earlier grades as well
    spark.createDataFrame([], GRADED.format(kind=kind)).write.mode("ignore").parquet(f"{store}/graded/part=-1/bucket=-1")
    writer = stream.writeStream.foreachBatch(lambda rows, number: absorb(rows, number, store, total)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def grades(spark: SparkSession, store: str, kind: str = "string") -> DataFrame:
    return _read(spark, store, "graded", GRADED.format(kind=kind)).drop("part", "bucket")


def open_runs(spark: SparkSession, store: str, kind: str = "string") -> DataFrame:
    """Runs that are not graded yet: rows so far (those sent twice in different batches count twice) and the announced number."""
    counts = _read(spark, store, "counts", COUNTS.format(kind=kind)).groupBy("run_id").agg(F.sum("n").alias("n"), F.max("total").alias("total"))
    return counts.join(grades(spark, store, kind), "run_id", "left_anti")


def grade_rest(spark: SparkSession, store: str, schema: StructType) -> DataFrame:
    """Grades of the runs that are not whole, as they are: for the end of a stream, or runs that announce nothing."""
    rest = open_runs(spark, store, dict((f.name, f.dataType.simpleString()) for f in schema)["run_id"]).select("run_id")
    return graded(_first_rows(_read(spark, store, "rows", schema).join(rest, "run_id", "left_semi")))
