"""An inverted-file index with product quantisation, kept as a table.

Vectors are of unit length in the index, so nearness is cosine. Cells, about the root of the rows,
and the codebooks of the residuals' parts are trained by k-means on a bounded sample; every row is
indexed. The rows lie in folders by cell with their codes and vectors. A search probes the nearest
cells of each query: tables of distances from the query's residual to each codebook entry give an
approximate distance a row from its code alone, each task keeps its own best, and the vectors of
the short list alone are then read and compared exactly.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwork.operators import retrieval
from groundwork.session import shared_dir, ship

PARTS, ENTRIES = 16, 256
SAMPLE, SAMPLE_BYTES = 1 << 16, 64 << 20  # rows, and bytes of them, that centres and codebooks are trained on
STEP = 1 << 20  # distances to centres that are held at a time
SHORT = 20  # rows of the short list for one that is asked for
RECALL, ASKED = 0.96, 64  # the probes are those that find this share of the neighbours of so many queries


def cells_for(rows: int) -> int:
    """Cells of an index over so many rows: about the root of the rows, so that no cell is hot."""
    return min(4096, max(4, round(rows**0.5)))


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def closest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row; STEP distances are held at a time."""
    own, step = (centres**2).sum(axis=1)[None, :], max(1, STEP // len(centres))
    return np.concatenate([(own - 2 * rows[at : at + step] @ centres.T).argmin(axis=1) for at in range(0, max(1, len(rows)), step)])


def kmeans(rows: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Centres by Lloyd's rounds; an empty cell moves to a row of its own."""
    draw = np.random.default_rng(seed)
    centres = rows[draw.permutation(len(rows))[: min(k, len(rows))]].copy()
    for _ in range(rounds):
        at = closest(rows, centres)
        n = np.bincount(at, minlength=len(centres))
        order = np.argsort(at, kind="stable")
        used = np.flatnonzero(n)
        centres[used] = np.add.reduceat(rows[order], (np.cumsum(n) - n)[used]) / n[used, None]
        empty = np.flatnonzero(n == 0)
        centres[empty] = rows[draw.integers(0, len(rows), len(empty))]
    return centres


class Index:
    """centres (cell, width), books (part, entry, step); the rows under path."""

    def __init__(self, spark: SparkSession, path: str, centres: np.ndarray, books: np.ndarray, width: int):
        self.spark, self.path, self.centres, self.books, self.width = spark, path, centres, books, width

    @classmethod
    def build(cls, base: DataFrame, path: str, cells: int | None = None, parts: int = PARTS, entries: int = ENTRIES) -> Index:
        """Index base (id, vector) under path. Rows without a vector are left out; vectors of another width are refused."""
        spark = base.sparkSession
        rows = base.select(F.col("id").cast("long").alias("id"), "vector").filter("vector is not null")
        n = rows.count()
        first = rows.select(F.size("vector").alias("w")).first()
        width = first["w"] if first else 0
        some = rows.orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE, max(1000, SAMPLE_BYTES // (8 * max(width, 1))))).select("vector").collect()
        if odd := {len(r["vector"]) for r in some} - {width}:
            raise ValueError(f"vectors of width {min(odd)}, not {width}")
        parts = max(1, min(parts, width))
        step = -(-width // parts)
        centres, books = np.zeros((1, width)), np.zeros((parts, 1, step))
        if some:
            sample = unit(np.array([r["vector"] for r in some], np.float64))
            centres = kmeans(sample, cells or cells_for(n))
            rest = cut(sample - centres[closest(sample, centres)], parts, step)
            books = np.stack([kmeans(rest[:, p], min(entries, len(rest))) for p in range(parts)])
        index = cls(spark, path, centres, books, width)
        index._coded(rows).repartitionByRange("cell", "id").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        meta = [(centres.tobytes(), books.tobytes(), *books.shape, width)]
        spark.createDataFrame(meta, "centres binary, books binary, parts long, entries long, step long, width long").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        m = spark.read.parquet(f"{path}/meta").first()
        return cls(spark, path, np.frombuffer(m["centres"]).reshape(-1, m["width"]), np.frombuffer(m["books"]).reshape(m["parts"], m["entries"], m["step"]), m["width"])

    def rows(self) -> DataFrame:
        return self.spark.read.schema("id long, code binary, vector array<double>, cell int").parquet(f"{self.path}/rows")

    def _coded(self, rows: DataFrame) -> DataFrame:
        ship(self.spark)
        centres, books, width = self.centres, self.books, self.width
        parts, _, step = books.shape

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                x, _ = retrieval.matrix(batch.column(1), width)
                if not len(x):
                    continue
                whole = unit(x)
                cell = closest(whole, centres)
                rest = cut(whole - centres[cell], parts, step)
                code = np.stack([closest(rest[:, p], books[p]) for p in range(parts)], axis=1).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(list(x), pa.list_(pa.float64())), pa.array(cell.astype(np.int32))], ["id", "code", "vector", "cell"])

        return rows.select("id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, "id long, code binary, vector array<double>, cell int")

    def probed(self, unit_queries: np.ndarray, probes: int) -> np.ndarray:
        """The nearest cells of each query, nearest first."""
        d = (self.centres**2).sum(axis=1)[None, :] - 2 * unit_queries @ self.centres.T
        return np.argsort(d, axis=1, kind="stable")[:, :probes]

    def search(self, queries: DataFrame, k: int, probes: int, short: int = SHORT) -> DataFrame:
        """queries (query_id, vector) -> query_id, id, distance, rank from 0. Queries beyond retrieval.QUERY_BYTES or retrieval.HITS, counting their short lists or probes, go in blocks."""
        blocks = retrieval.blocks_for(queries, max(short * k, probes))
        if blocks == 1:
            return self._search(queries, k, probes, short)
        path = f"{shared_dir(self.spark)}/indexed-{uuid.uuid4().hex}"
        for at in range(blocks):
            found = self._search(queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == at), k, probes, short)
            found.write.mode("append").parquet(path)
        return self.spark.read.schema(found.schema).parquet(path)

    def _search(self, queries: DataFrame, k: int, probes: int, short: int) -> DataFrame:
        ship(self.spark)
        ids, asked = retrieval.gathered(queries, self.width)
        whole, centres, books = unit(asked) if len(asked) else asked, self.centres, self.books
        parts, entries, step = books.shape
        cells = self.probed(whole, probes) if len(ids) else np.zeros((0, 0), np.int64)
        asks = {int(c): np.flatnonzero((cells == c).any(axis=1)) for c in np.unique(cells)}
        most = short * k

        def near(batches):
            held, size = [], 0
            for batch in batches:
                cell, found = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
                for c in np.unique(cell).tolist():
                    who, own = asks.get(c, ()), np.flatnonzero(cell == c)
                    for at in range(0, len(who), 256):
                        q = who[at : at + 256]
                        rest = cut(whole[q] - centres[c], parts, step)
                        d = np.zeros((len(q), len(own)))
                        for p in range(parts):
                            table = ((rest[:, p, None, :] - books[p][None]) ** 2).sum(axis=2)
                            d += table[:, code[own, p]]
                        i, j = retrieval.smallest(d, most)
                        held.append((q[i], found[own[j]], np.full(len(i), c), d[i, j]))
                        size += len(i)
                        if size > retrieval.HELD:
                            held = [best_by_query(held, most)]
                            size = len(held[0][0])
                            if size > retrieval.HELD // 2:
                                yield sent(held[0])
                                held, size = [], 0
            if held:
                yield sent(best_by_query(held, most))

        def sent(part):
            import pyarrow as pa

            q, found, cell, d = part
            return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(found), pa.array(cell.astype(np.int32)), pa.array(d)], ["q", "id", "cell", "d"])

        rows = self.rows().filter(F.col("cell").isin([*asks])) if len(asks) < len(centres) else self.rows()
        first = rows.select("cell", "id", "code").mapInArrow(near, "q long, id long, cell int, d double")
        place = F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))
        listed = first.withColumn("place", place).filter(F.col("place") <= most).select("q", "id", "cell")
        few = len(ids) * most * 24 <= retrieval.QUERY_BYTES
        pairs = rows.select("cell", "id", "vector").join(F.broadcast(listed) if few else listed, ["cell", "id"]).select("q", "id", "vector")
        width = self.width

        def exact(batches):
            import pyarrow as pa

            for batch in batches:
                q = batch.column(0).to_numpy()
                x, _ = retrieval.matrix(batch.column(2), width)
                with np.errstate(invalid="ignore", divide="ignore"):
                    d = 1 - (asked[q] * x).sum(axis=1) / (np.linalg.norm(asked[q], axis=1) * np.linalg.norm(x, axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), batch.column(1), pa.array(np.abs(np.round(d, 9)))], ["query_id", "id", "distance"])

        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")) - 1
        return pairs.mapInArrow(exact, "query_id long, id long, distance double").withColumn("rank", rank.cast("long")).filter(F.col("rank") < k)

    def probes_needed(self, queries: DataFrame, k: int, recall: float = RECALL, asked: int = ASKED) -> int:
        """How many cells a query must probe, measured: of `asked` queries drawn by hash the true neighbours are searched exactly.

        Each lies in one cell, at some place in the order of the query's cells; the wanted share of these places tells the probes.
        """
        some = queries.filter("vector is not null").orderBy(F.xxhash64("query_id"), "query_id").limit(asked).select(F.col("query_id").cast("long").alias("query_id"), "vector")
        near = retrieval.nearest(some, self.rows().select("id", "vector"), k).select("query_id", "id")
        found = self.rows().select("id", "cell").join(F.broadcast(near), "id").select("query_id", "cell").collect()  # asked * k rows
        if not found:
            return 1
        ids, matrix = retrieval.gathered(some, self.width)
        order = dict(zip(ids.tolist(), self.probed(unit(matrix), len(self.centres))))
        places = [int(np.flatnonzero(order[r["query_id"]] == r["cell"])[0]) + 1 for r in found]
        return int(np.quantile(places, recall, method="higher"))


def cut(rows: np.ndarray, parts: int, step: int) -> np.ndarray:
    """Rows in equal parts, filled up with zeros."""
    return np.pad(rows, ((0, 0), (0, parts * step - rows.shape[1]))).reshape(len(rows), parts, step)


def best_by_query(parts: list[tuple], k: int) -> tuple:
    """The k of least distance, then id, of each query; parts hold arrays of query, id, cell, distance."""
    q, found, cell, d = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((found, d, q))
    q = q[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    kept = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k
    return q[kept], found[order][kept], cell[order][kept], d[order][kept]


def search(queries: DataFrame, base: DataFrame, k: int, rows: int = retrieval.INDEX_ROWS, path: str | None = None) -> DataFrame:
    """k nearest by cosine: exact up to `rows` vectors, beyond by the index under `path`, which is built where there is none."""
    if base.count() <= rows:
        return retrieval.nearest(queries, base, k)
    index = opened(base, path)
    return index.search(queries, k, index.probes_needed(queries, k))


def opened(base: DataFrame, path: str | None = None) -> Index:
    """The index under path, or a new one there or in the shared folder."""
    spark = base.sparkSession
    if path:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta/_SUCCESS")
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return Index.open(spark, path)
    return Index.build(base, path or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
