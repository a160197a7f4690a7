"""The shared folder, and tables written there to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Where that is unset a local one is made, in local mode only."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext._conf.set("spark.checkpoint.dir", root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/llm-{tag}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_end_with_the_query(spark: SparkSession) -> Iterator[None]:
    """Queries run inside leave no shuffle files behind, where this version of Spark can do that."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there and lost executors cost nothing."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, tag)
    with _shuffles_end_with_the_query(spark):
        df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.shared_folder = path
    if _recording:
        _side.append(path)
    return made


#: Folders of tables that steps have made beside their results, and whether such are noted now.
_side: list[str] = []
_recording = False


@contextmanager
def side_tables(docs: DataFrame) -> Iterator[None]:
    """Notes the tables that a step makes beside its result, and deletes those of steps before it.

    They are deleted only where the files that ``docs`` reads show that it needs none of them: what
    came before it has been written and read again.
    """
    global _recording
    read = docs.inputFiles() if _side else []
    if read and not any(path.rpartition("/")[2] in file for file in read for path in _side):
        for path in _side:
            _delete(docs.sparkSession, path)
        _side.clear()
        gc.collect()
    _recording = True
    try:
        yield
    finally:
        _recording = False


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with as many underscores as it takes not to clash with ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and that nothing reads any more."""
    for made in tables:
        _delete(made.sparkSession, made.shared_folder)
    gc.collect()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
