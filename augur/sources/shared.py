"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Where the calls of this thread note the tables that they make.
_made: ContextVar[list[str] | None] = ContextVar("_made", default=None)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system, as tasks need it that don't know Spark's default one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else the context's checkpoint folder, with its file
    system, so that tasks and driver mean the same. Where neither is set a session on one machine
    gets a temporary folder; a cluster is refused."""
    sc = spark.sparkContext
    context = sc._jsc.sc()
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found and context.getCheckpointDir().isDefined():
        return context.getCheckpointDir().get()
    if not found and not context.isLocal():
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not context.getCheckpointDir().isDefined():
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="augur-"))
    return qualified(spark, found or context.getCheckpointDir().get())


def new_path(spark: SparkSession, kind: str = "table") -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(path)
    return path


def written_at(df: DataFrame, group: int | None = None) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table of its own, and the table's path, which the caller may
    :func:`remove`."""
    spark = df.sparkSession
    path = new_path(spark)
    (df.write if group is None else df.write.option("parquet.block.size", group)).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, group: int | None = None) -> DataFrame:
    """``df`` as a Parquet table of its own, so that a lost executor costs a re-read and not
    the whole history. Readers take up to thousands of rows of a row group at once, so tables
    with large rows should have small row groups, of ``group`` bytes."""
    return written_at(df, group)[0]


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of one's own; frames that still read them must be written before."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def own_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end the intermediate tables that calls within it made in this thread, and
    none of other threads or of the calls around it. What is to outlive it must be written to
    a path that was made before."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
        remove(spark, *made)
