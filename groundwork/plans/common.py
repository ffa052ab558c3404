"""Tables and SQL fragments that several families' queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def normalize(x: str) -> str:
    """DuckDB's twin of functions.text.normalize."""
    return collapse(f"translate(coalesce({x}, ''), '’“”–—', '''\"\"--')")


def quote_hash(x: str) -> str:
    return f"substr(sha1({normalize(x)}), 1, 12)"
