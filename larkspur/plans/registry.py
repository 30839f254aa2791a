"""How queries and their SQL are put down: by decorator, in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Bytes of rows that go to Python at once: what a worker holds is a few times that, however long the texts are.
BATCH_BYTES = 1 << 22
BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


class Tables:
    """The driver's tables of a folder, by name. Rows go to Python in batches of BATCH_BYTES, if the session does not say of how many."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        if spark.conf.get(BYTES, None) is None:
            spark.conf.set(BYTES, BATCH_BYTES)

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def put(f: Callable[[Tables], DataFrame]):
            self.queries[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                self.sql[f.__name__] = sql
            return f

        return put
