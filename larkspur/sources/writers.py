"""Writers, and upkeep of what they wrote."""

from __future__ import annotations

import datetime as dt
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str) -> None:
    """With a header, quotes doubled, null as nothing."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="")


def csv_line(columns: list[Column]) -> Column:
    """A row as a CSV line: values with a comma, quote or line end are quoted, null is nothing."""
    cell = lambda c: F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    return F.concat_ws(",", *[cell(c.cast("string")) for c in columns])


#: Folders that small files are dealt out to, so that they are listed side by side.
FOLDERS = 256


def files_by(rows: DataFrame, path: str) -> None:
    """A JSONL file for each value of the first column of rows, whose second column has its lines. Rows of a value are in one
    partition, one after another.

    Tasks write through Arrow's file systems, as Spark's writer makes a folder for each value and, on a local store, starts three
    processes for each. A file has its name only once it is whole, so a task may run again. On stores that Arrow cannot reach
    Spark's writer writes them.
    """
    name = rows.columns[0]
    try:
        store, root = pa.fs.FileSystem.from_uri(path)
        store.create_dir(root)
    except (OSError, pa.ArrowException):
        rows.write.partitionBy(name).text(path)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa.fs.FileSystem.from_uri(path)
        folders, n, last, out, made = set(), 0, None, None, ()

        def close() -> None:
            out.close()
            try:
                store.move(*made)
            except OSError:  # another attempt's, on stores that do not replace files
                if store.get_file_info(made[1]).type != pa.fs.FileType.File:
                    raise
                store.delete_file(made[0])

        for batch in batches:
            pairs = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for key, group in groupby(pairs, lambda r: r[0]):
                if out is None or key != last:
                    if out is not None:
                        close()
                    file = f"{name}={'' if key is None else key}.jsonl"
                    folder = f"{root}/part={zlib.crc32(file.encode()) % FOLDERS}"
                    if folder not in folders:
                        store.create_dir(folder)
                        folders.add(folder)
                    made = (f"{folder}/_{uuid.uuid4().hex}", f"{folder}/{file}")
                    n, last, out = n + 1, key, store.open_output_stream(made[0])
                out.write("".join(f"{value}\n" for _, value in group).encode())
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    rows.mapInArrow(write, "files long").agg(F.sum("files")).collect()


def archive(memories: DataFrame, path: str) -> None:
    """JSON files by year and month of `ts`, each row with the hash of its content."""
    d = memories.withColumns({"checksum": F.sha2("content", 256), "year": F.year("ts"), "month": F.lpad(F.month("ts").cast("string"), 2, "0")})
    d.write.mode("append").partitionBy("year", "month").json(path)


def rehydrated(spark, path: str, schema: str) -> DataFrame:
    """Archived rows with defaults, and whether their content still has its hash."""
    d = spark.read.schema(f"{schema}, checksum string").json(path)
    return d.withColumns({"importance": F.coalesce("importance", F.lit(0.5)), "intact": F.sha2("content", 256) == F.col("checksum")})


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the rows that new replaces, and new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last in order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def replaced(df: DataFrame, path: str) -> str:
    """Writes a new version beside the old ones and returns its place; readers move to it only once it is whole."""
    version = f"{path}/v={dt.datetime.now(dt.UTC):%Y%m%d%H%M%S%f}"
    df.write.mode("error").parquet(version)
    return version


def newest_version(spark, path: str) -> DataFrame:
    """The last whole version that replaced() has written; one that has no _SUCCESS is not whole."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/_SUCCESS")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return spark.read.parquet(max(x.getPath().getParent().toString() for x in found))


def optimised(df: DataFrame, path: str, files: int, by: list[str]) -> str:
    """A new version in fewer files, rows in order of `by`, so that a filter on them skips most."""
    return replaced(df.repartitionByRange(files, *by).sortWithinPartitions(*by), path)


def cleared(df: DataFrame, path: str) -> str:
    """A new version without rows."""
    return replaced(df.limit(0), path)


DAILY = ["date", "inputTokens", "outputTokens", "cacheReadTokens", "cacheWriteTokens", "totalTokens", "inputCost", "outputCost", "cacheReadCost", "cacheWriteCost", "totalCost"]


def daily_lines(daily: DataFrame) -> DataFrame:
    """date, line: the eleven columns of a day's totals (named as in DAILY) as a CSV line."""
    return daily.select("date", csv_line([F.col(c) for c in DAILY]).alias("line"))


def last_lines(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The last rows of each log."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def fresh(rows: DataFrame, updated: str, now: Column, max_age_days: float) -> DataFrame:
    return rows.where(F.unix_micros(F.col(updated).cast("timestamp")) >= F.unix_micros(now.cast("timestamp")) - F.lit(int(max_age_days * 86_400_000_000)))


def swept(sessions: DataFrame, now: Column, retention_hours: float) -> DataFrame:
    """Cron-run sessions beyond retention whose session id no other session has: those to archive."""
    old = F.col("key").rlike("^agent:[^:]+:cron:[^:]+:run:[^:]+$") & (F.unix_micros(F.col("updated").cast("timestamp")) < F.unix_micros(now.cast("timestamp")) - F.lit(int(retention_hours * 3_600_000_000)))
    gone, stay = sessions.where(old), sessions.where(~old)
    return gone.join(stay.select("session_id"), "session_id", "left_anti")


def overflow_summary(dropped: DataFrame, by: str, order: str, noun: str) -> DataFrame:
    """A text for each queue: how many were dropped, and a line for each."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: F.concat(F.lit("- "), x["line"]))
    g = dropped.groupBy(by).agg(F.count("*").alias("n"), listed.alias("lines"))
    head = F.concat(F.lit("[Queue overflow] Dropped "), F.col("n"), F.lit(f" {noun}"), F.when(F.col("n") == 1, "").otherwise("s"), F.lit(" due to cap."))
    return g.select(by, F.concat_ws("\n", head, F.array_join("lines", "\n")).alias("summary"))
