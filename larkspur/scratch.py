"""Tables that operators write for themselves, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in spark.checkpoint.dir.

    Where it names none, a local master (tests) gets a folder of its own, as its executors are on this machine; on a
    cluster that would be a folder that other executors cannot see, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, on whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: The run that tables are written for. Each thread, and each task of an event loop, has its own.
RUN: ContextVar[str | None] = ContextVar("run", default=None)


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[str]:
    """A run: what written() makes inside, in a folder of the run's own, goes with its end, and nothing else does.

    Results made inside must be read or written inside. Tables made outside of any run stay, as results that are still
    to be read need them; they are in the shared folder under the application's id.
    """
    folder = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    token = RUN.set(folder)
    try:
        yield folder
    finally:
        RUN.reset(token)
        remove(spark, folder)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a table of this name, in the run's folder or the application's."""
    return f"{RUN.get() or f'{shared_dir(spark)}/{spark.sparkContext.applicationId}'}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: list[str] | None = None, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs no recomputation.

    by: columns, the last ones of df, whose values have folders of their own, so that a filter on them reads no others.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.options(**options)
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
