"""The folder that driver and executors share, for cut lineages and files on their way."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """As spark.checkpoint.dir names it. Where it is unset a local session gets a temporary folder; a cluster session must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spanweave-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the interpreter ends."""
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


@atexit.register
def release() -> None:
    context = SparkContext._active_spark_context
    for p in _MADE if context is not None else ():
        remove(context, p)
    _MADE.clear()


def remove(context: SparkContext, path: str) -> None:
    """Delete a table from whatever store holds it."""
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def settled(df: DataFrame, then: Sequence[str] = ()) -> DataFrame:
    """df computed once, as Parquet in the shared folder, so that rounds do not repeat one another and survive lost executors. Tables at the paths `then` go afterwards.

    A checkpoint would carry on the size that the planner derives for its plan. A join's is the product of its sides', so over rounds it becomes a number of so many digits that the driver runs out of memory; a file's size is its own.
    """
    spark, schema = df.sparkSession, df.schema
    path = fresh_path(spark, "settled")
    df.write.parquet(path)
    for p in then:
        remove(spark.sparkContext, p)
        _MADE.remove(p)
    return spark.read.schema(schema).parquet(path)


def last_path() -> str:
    """Where the table of the last settled() lies."""
    return _MADE[-1]
