"""Shared plumbing of the training-data operators: column picking, tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.session import shared_dir, ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, found by exact name and first position.

    Extra columns are ignored, also those that differ from a wanted one by case only.
    """
    places = [df.columns.index(n) for n in names]
    return numbered(df).select(*(F.col(f"_c{i}").alias(n) for i, n in zip(places, names)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return pick(table(spark, sf_dir, "documents"), *(names or ("doc_id", "text")))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table that materialize() wrote, once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def per_text(df: DataFrame, fn: Callable[[Iterator[list]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow over small slices of rows: fn gets the columns as Python lists, slice by slice.

    fn sees at most ROWS rows and about BYTES of text at once, so one batch of very long texts stays bounded.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for columns in fn(slices(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)

    return map_arrow(df, run, schema)


def map_arrow(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """mapInArrow, after this package has been sent to the workers; each task gives its memory back, since workers live on."""
    ship(df.sparkSession)

    def run(batches: Iterable) -> Iterator:
        yield from fn(batches)
        give_back()

    return numbered(df).mapInArrow(run, schema)


def give_back() -> None:
    """Return memory that Python and Arrow have freed but hold to the system, where its C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named by place, so that names which differ by case only do not clash."""
    return df.toDF(*(f"_c{i}" for i in range(len(df.columns))))


ROWS, BYTES = 512, 4 << 20


def slices(batches: Iterable) -> Iterator[list]:
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(ROWS, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).nbytes > BYTES:
                n = max(1, n // 2)
            yield [c.to_pylist() for c in batch.slice(at, n).columns]
            at += n


def splitmix(x):
    """splitmix64 finaliser over a numpy uint64 array."""
    import numpy as np

    x = x.astype(np.uint64)
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
