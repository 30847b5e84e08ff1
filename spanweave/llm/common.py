"""What the operators share: table access, packed rows and durable intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where it is unset a local session gets a temporary folder; a cluster session must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spanweave-")
        spark.sparkContext.setCheckpointDir(root)  # a setting of its own: spark.checkpoint.dir can't be changed in a session
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let batches of whole texts to Python hold at most `rows` rows in this session, so that memory follows a few texts.

    Spark bounds a batch's bytes itself. The setting stays, since results are lazy and read it when they run.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, rows)


#: Tables of the calls that run, innermost last: (path, whether the call's result reads it). The first list is the session's own.
_SCOPES: list[list[tuple[str, bool]]] = [[]]


def remove(spark_context, paths: list[str]) -> None:
    """Delete tables from whatever store holds them."""
    jvm, conf = spark_context._jvm, spark_context._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that durable() makes inside go at the end, but for those that a result reads: these go with the scope around it, or with the session."""
    _SCOPES.append([])
    try:
        yield
    finally:
        made = _SCOPES.pop()
        _SCOPES[-1] += [(path, False) for path, keep in made if keep]
        remove(spark.sparkContext, [path for path, keep in made if not keep])


def scoped(operator):
    """An operator whose first argument is a table: its tables go when it returns, but for those that its result reads."""

    @functools.wraps(operator)
    def run(df: DataFrame, *args, **kwargs):
        with scratch(df.sparkSession):
            return operator(df, *args, **kwargs)

    return run


@atexit.register
def release() -> None:
    """Remove what results of this session still read. Runs when the interpreter ends; a session that has been stopped keeps its tables."""
    context = SparkContext._active_spark_context
    if context is not None and _SCOPES[0]:
        remove(context, [path for path, _ in _SCOPES[0]])
        _SCOPES[0].clear()


def durable(df: DataFrame, name: str, *, keep: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back. keep: the call's result reads it, so it outlives the call.

    The lineage ends there: lost executors cost no recomputation, and readers see exact sizes and pruned columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    _SCOPES[-1].append((path, keep))
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def col(name: str):
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame):
    """All columns as one struct, so that names of working columns can't clash with the caller's."""
    return F.struct(*[col(c) for c in df.columns])


def unpacked(df: DataFrame, columns: list[str], packed: str = "r") -> DataFrame:
    """The caller's columns again, out of the struct whole_row() made."""
    return df.select(*[F.col(packed).getField(c).alias(c) for c in columns])


def rows_literal(spark: SparkSession, rows_json: str, ddl: str) -> DataFrame:
    """A small driver-side table, of bounded size, as a plain SQL relation."""
    return spark.sql(f"SELECT inline(from_json(:rows, 'array<struct<{ddl}>>'))", args={"rows": rows_json})
