"""Vector codes against a full search over every entry, in Python's integers."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwork.llm import codes, oracles
from groundwork.llm.queries import QUERIES
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows, parts=16, entries=64, rounds=2):
    good = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not good:
        return []
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(good[0][1])
    step = -(-width // parts)
    good = [r for r in good if len(r[1]) == width]
    cut = []
    for _, v, _ in good:
        whole = [math.floor(256 * x) for x in v] + [0] * (step * parts - width)
        cut.append([tuple(whole[p * step : (p + 1) * step]) for p in range(parts)])
    books = [[x[p] for x in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x[p], c)), k) for k, c in enumerate(books[p])) for p in range(parts)] for x in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [x[p] for x, f in zip(cut, found) if f[p][1] == k]
                if own:
                    books[p][k] = tuple(sum(col) // len(own) for col in zip(*own))
    found = assign()
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    error = [sum(d for d, _ in f) for f in found]
    by_label: dict = {}
    for (_, _, label), e in zip(good, error):
        by_label[label] = by_label.get(label, 0) + e
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, by_label[label], sha) for (i, _, label), f, e in zip(good, found, error)), key=str)


def found(df):
    return sorted((tuple(r) for r in codes.digests(df).collect()), key=str)


def random_rows(rng, n, width, values):
    return [(i, [rng.choice(values) for _ in range(width)], rng.choice([None, 0, 1])) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("width, values", [(64, [x / 64 for x in range(-40, 40)]), (32, [0.0, 0.004, -0.004, 1.0]), (48, [-1e4, 1e4, 3.25, -0.001]), (20, [0.5, -0.5, 0.1])])
def test_codes_equal_a_full_search(spark, width, values):
    rows = random_rows(random.Random(width), 300, width, values)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == expected(rows)


def test_codes_of_edges(spark):
    """Nulls everywhere, values that are not finite, other widths, repeated rows, rows without an id, names that clash."""
    rng = random.Random(1)
    rows = random_rows(rng, 90, 32, [0.1, 0.2, -0.7])
    same = [0.25] * 32
    rows += [(-3, None, 1), (-2, [None] + same[1:], 1), (-1, [float("nan")] + same[1:], None), (-1, [float("inf")] + same[1:], None), (5000, same[:16], 0), (5001, same + same, 0), (5002, [], 0)]
    rows += [(6000, same, 2)] * 3 + [(None, same, None), (None, [0.5] * 32, None)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("x").alias("code"), F.lit("y").alias("error"), F.lit("z").alias("LABEL"), F.lit(0).alias("vector")).repartition(4)
    assert found(df) == expected(rows)


def test_codes_of_few_rows_and_of_none(spark):
    for rows in ([], [(1, None, 0)], [(1, [1.0] * 16, None)], [(1, [], 0), (2, [], None)], [(2, [0.5] * 16, 0), (1, [0.25] * 16, 0)]):
        assert found(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_values_beyond_a_long_are_held(spark):
    rows = [(k, [1e38 * (-1) ** k] + [0.5] * 31, 0) for k in range(70)]
    got = codes.digests(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 70 and all(0 <= r["error"] < 1 << 60 for r in got) and len({r["code"] for r in got}) == 2


def test_exponion_search_scans_less_than_all_and_gives_the_same():
    rng = np.random.default_rng(2)
    centres = rng.integers(-1000, 1000, (64, 4))
    x = (centres[rng.integers(0, 64, 4000)] + rng.integers(-5, 5, (4000, 4)))[:, None, :]
    books = codes.Books(centres[None])
    d = ((x[:, 0, None, :] - centres[None]) ** 2).sum(axis=2)
    at, least = books.nearest(x, np.zeros((4000, 1), np.int64))
    assert (at[:, 0] == d.argmin(axis=1)).all() and (least[:, 0] == d.min(axis=1)).all()
    again = codes.Books(centres[None])
    assert (again.apart[0, at[:, 0]] <= 4 * least).sum(axis=1).mean() < 4  # from the right entry hardly any other is looked at


def test_the_query_equals_its_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    cursor = con.execute(oracles.codes_sql())
    names = [d[0] for d in cursor.description]
    assert sorted(tuple(r) for r in QUERIES["op12_codes"](spark, SF).select(*names).collect()) == sorted(cursor.fetchall())
