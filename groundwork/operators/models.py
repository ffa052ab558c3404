"""Interfaces for models: embedders, entailment and rerankers, as pandas UDFs over iterators of batches.

A backend is a factory: called once a task, it gives a function from a list of inputs to a list of
outputs. Inputs go to it in order, BATCH at a time; where a call fails, its outputs are NULL, and
nothing else is lost. Backends have names; one that is not registered is an error when the query is
made. `offline` ones need no network and no weights.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.session import ship

BATCH = 8
WIDTH = 64
_registered: dict[str, dict[str, Callable]] = {"embed": {}, "entail": {}, "rerank": {}}


def register(kind: str, name: str, factory: Callable[[], Callable[[list], list]]) -> None:
    """Make a backend known. embed: texts to vectors; entail: (claim, passage) pairs to scores; rerank: (query, text) pairs to scores."""
    _registered[kind][name] = factory


def backend(kind: str, name: str) -> Callable:
    if name not in _registered[kind]:
        raise ValueError(f"unknown {kind} backend {name!r}; there are {', '.join(sorted(_registered[kind]))}")
    return _registered[kind][name]


def in_batches(model: Callable[[list], list], inputs: list, size: int = BATCH) -> list:
    """The model's outputs in order. Nulls are not sent; a call that fails, or gives another number of outputs, gives NULLs."""
    out: list = [None] * len(inputs)
    sent = [k for k, x in enumerate(inputs) if x is not None]
    for at in range(0, len(sent), size):
        some = sent[at : at + size]
        try:
            found = list(model([inputs[k] for k in some]))
        except Exception:  # a model's failure is an answer here: NULL, and the rows go on
            continue
        if len(found) == len(some):
            for k, x in zip(some, found):
                out[k] = x
    return out


def embed(rows: DataFrame, name: str = "offline", text: str = "text", to: str = "vector", size: int = BATCH) -> DataFrame:
    """rows with a vector of each text, by the named backend."""
    ship(rows.sparkSession)
    factory = backend("embed", name)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            yield pd.Series(in_batches(model, [None if pd.isna(x) else x for x in texts], size), dtype=object)

    return rows.withColumn(to, run(F.col(text)))


def scored(rows: DataFrame, kind: str, name: str, left: Column, right: Column, to: str, size: int = BATCH) -> DataFrame:
    """rows with a score of each pair of texts, by the named backend; NULL where a text is."""
    ship(rows.sparkSession)
    factory = backend(kind, name)

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for a, b in batches:
            pairs = [None if pd.isna(x) or pd.isna(y) else (x, y) for x, y in zip(a, b)]
            yield pd.Series(in_batches(model, pairs, size), dtype="float64")

    return rows.withColumn(to, run(left, right))


def entail(rows: DataFrame, claim: str = "claim", passage: str = "passage", name: str = "offline", to: str = "entailed") -> DataFrame:
    return scored(rows, "entail", name, F.col(claim), F.col(passage), to)


def rerank(rows: DataFrame, query: str = "query", text: str = "text", name: str = "offline", to: str = "relevance") -> DataFrame:
    return scored(rows, "rerank", name, F.col(query), F.col(text), to)


def words(text: str) -> set[str]:
    return {w for w in re.split("[^a-z0-9]+", text.lower()) if w}


def share(pair: tuple[str, str]) -> float:
    """The share of the first text's distinct words that the second has."""
    a, b = words(pair[0]), words(pair[1])
    return len(a & b) / len(a) if a else 0.0


def hashed(text: str) -> list[float]:
    """Hashed letter 3-grams, unit length: what retrieval.embed gives."""
    import numpy as np
    import xxhash

    grams = [text[i : i + 3].lower().encode() for i in range(max(1, len(text) - 2))]
    cells = [(h - (1 << 64) if h >> 63 else h) % WIDTH for h in (xxhash.xxh64_intdigest(g, 42) for g in grams)]
    counts = np.bincount(cells, minlength=WIDTH).astype(np.float64)
    return (counts / np.sqrt((counts**2).sum())).tolist()


register("embed", "offline", lambda: lambda texts: [hashed(t) for t in texts])
register("entail", "offline", lambda: lambda pairs: [share(p) for p in pairs])
register("rerank", "offline", lambda: lambda pairs: [share(p) for p in pairs])
