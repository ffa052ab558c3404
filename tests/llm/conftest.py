from __future__ import annotations

import pytest

#: Nulls in any column, empty, white space alone, long, repeated rows, ties.
EDGES = [
    (1, "The MIT License covers it. " * 40, "en", "a", 1),
    (1, "The MIT License covers it. " * 40, "en", "a", 1),
    (2, None, "en", None, None),
    (3, "", None, "a", 0),
    (None, "no id but words here", "en", "a", 3),
    (4, " \t\n\r\x0b\x0c ", "fr", "a", 6),
    (5, "x", "fr", "a", 1),
    (6, "L'été dernier j'ai vu 123 oiseaux … 日本語のテキスト <|endoftext|> I'll we've", "fr", "b", 5),
    (7, "word " * 30_000, "de", "b", 150_000),
    (8, "a" * 40_000, "de", "b", 40_000),
    (9, "Released under the MIT-License; Apache\nLicense, Version 2.0 GENERAL Public license", "en", "b", 9),
    (10, "0123456789 $$$ ### \x00\x01\x1c\x85\xa0", None, "c", 4),
]


@pytest.fixture(scope="session")
def edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(EDGES, schema).repartition(3)


@pytest.fixture(scope="session")
def clashing(edges):
    """The same rows with columns of the names that results and joins use."""
    from pyspark.sql import functions as F

    return edges.select("*", *[F.lit("clash").alias(c) for c in ("n_tokens", "shard", "fp", "component_id", "words", "row", "task", "TEXT", "score")])


@pytest.fixture(scope="session")
def empty(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def sample(spark):
    from tests.conftest import SF

    return spark.read.parquet(f"{SF}/documents.parquet")
