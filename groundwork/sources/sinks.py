"""Plain sinks: session logs that are appended to and archived, and lists of one item a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_turns(turns: DataFrame, path: str) -> None:
    """Add turns (session, ...) to a log, a folder a session."""
    turns.write.mode("append").partitionBy("session").parquet(path)


def archive(spark: SparkSession, path: str, session: str, to: str) -> bool:
    """Move a session's turns out of the log under `to`; whether there were any. What lies there is never overwritten."""
    new = spark._jvm.org.apache.hadoop.fs.Path
    where, target = new(f"{path}/session={session}"), new(f"{to}/session={session}")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return False
    if fs.exists(target):
        raise FileExistsError(target.toString())
    fs.mkdirs(target.getParent())
    return fs.rename(where, target)


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    """One item a line, in files under path; nulls are left out, and an item's own line ends become blanks."""
    line = F.regexp_replace(F.col(column).cast("string"), r"[\r\n]+", " ")
    rows.select(line.alias("value")).filter("value is not null").write.mode("overwrite").text(path)
